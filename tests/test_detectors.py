"""The sliding scorer and the projection against plain loops."""

import numpy as np
import pytest

from kithmark.operators import detectors

PICTURE = "space string, id long, width long, height long, pixels array<double>"


def plain_boxes(picture, scorer, plan, least, overlap):
    found, k = [], len(scorer.kernel)
    for scale in plan:
        h, w = max(1, round(picture.shape[0] * scale)), max(1, round(picture.shape[1] * scale))
        big = np.array([[picture[int((y + 0.5) * picture.shape[0] / h), int((x + 0.5) * picture.shape[1] / w)] for x in range(w)] for y in range(h)])
        fx, fy = w / picture.shape[1], h / picture.shape[0]
        for y in range(0, h - k + 1, scorer.stride):
            for x in range(0, w - k + 1, scorer.stride):
                s = 1 / (1 + np.exp(-((big[y : y + k, x : x + k] * scorer.kernel).sum() + scorer.bias)))
                if s >= least:
                    l, t, r, b = scorer.reach
                    found.append(((x + k / 2 - l) / fx, (y + k / 2 - t) / fy, (l + r) / fx, (t + b) / fy, s))
    kept = []
    for n, (x, y, w, h, s) in sorted(enumerate(found, 1), key=lambda f: (-f[1][4], f[0])):
        def iou(o):
            inter = max(0, min(x + w, o[1] + o[3]) - max(x, o[1])) * max(0, min(y + h, o[2] + o[4]) - max(y, o[2]))
            return inter / (w * h + o[3] * o[4] - inter)

        if all(iou(o) <= overlap for o in kept):
            kept.append((n, x, y, w, h, s))
    return kept


@pytest.fixture(scope="module")
def shots():
    rng = np.random.default_rng(4)
    return {i: rng.integers(0, 256, shape).astype(float) for i, shape in enumerate([(20, 30), (33, 17), (3, 50), (40, 40)])}


def test_boxes_and_vectors_match_plain_loops(spark, shots):
    rng = np.random.default_rng(5)
    scorer = detectors.Scorer(rng.normal(scale=0.01, size=(5, 5)), -0.3, 2, (2.0, 3.0, 4.0, 1.0))
    rows = [("a", i, p.shape[1], p.shape[0], p.ravel().tolist()) for i, p in shots.items()]
    bad = [("a", 50, 4, 4, [1.0]), ("a", 51, 4, 4, None), ("a", 52, None, 4, [1.0]), ("b", 53, 0, 0, [])]
    pictures = spark.createDataFrame(rows + bad, PICTURE)
    matrix = rng.normal(size=(3, 9))
    boxes, failed = detectors.extract(pictures, scorer, matrix, [1.0, 2.0, 2.0, 0.5], 45, 0.9)
    got = {}
    for r in boxes.collect():
        got.setdefault(r.photo_id, {})[r.n] = r
    assert {r.photo_id for r in failed.collect()} == {50, 51, 52, 53} and all(r.error for r in failed.collect())
    many = 0
    for i, p in shots.items():
        cap = 45 / max(p.shape)
        plan = list(dict.fromkeys(s for s in (round(min(x, cap), 4) for x in (1.0, 2.0, 2.0, 0.5)) if s > 0))
        want = plain_boxes(p, scorer, plan, 0.9, 0.45)
        many += len(want)
        assert {n: (r.x, r.y, r.w, r.h, r.det_score) for n, r in got.get(i, {}).items()} == {w[0]: pytest.approx(w[1:]) for w in want}
        for n, x, y, w, h, _ in want:
            x0, y0, x1, y1 = max(0, int(np.floor(x))), max(0, int(np.floor(y))), min(p.shape[1], int(np.ceil(x + w))), min(p.shape[0], int(np.ceil(y + h)))
            crop = np.array([p[y0 + int((a + 0.5) * (y1 - y0) / 3), x0 + int((b + 0.5) * (x1 - x0) / 3)] for a in range(3) for b in range(3)])
            v = matrix @ crop
            assert got[i][n].vec == pytest.approx((v / np.linalg.norm(v)).tolist())
    assert many >= 20


def test_no_pictures(spark):
    scorer = detectors.Scorer(np.ones((2, 2)), 0.0, 1, (1.0, 1.0, 1.0, 1.0))
    boxes, failed = detectors.extract(spark.createDataFrame([], PICTURE), scorer, np.ones((2, 4)), [1.0], 10)
    assert boxes.count() == 0 and failed.count() == 0
