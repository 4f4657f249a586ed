"""From clusters and known faces to proposals: votes, mapping, assign, reassign, new person, merge.

Frames: members (face_id, cluster), labels (face_id, space, person_id, syno_face_id), vectors (face_id, vec),
meta (face_id, space, photo_id), tags (space, person_id, photo_id).

Mean cosines to a set are dot products with the set's mean, so no face meets every labelled face.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .cells import close_pairs


def mean_vector(dim: int, vec: str = "vec") -> Column:
    """Mean of vectors as an aggregate: one running mean for each part, combined before the shuffle."""
    return F.array(*(F.avg(F.get(F.col(vec), F.lit(i)).cast("double")) for i in range(dim)))


def sum_vector(dim: int, vec: str = "vec") -> Column:
    return F.array(*(F.sum(F.get(F.col(vec), F.lit(i)).cast("double")) for i in range(dim)))


def votes(members: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, space, person_id, n, labeled: votes for each person, and all of the cluster."""
    n = members.join(labels, "face_id").groupBy("cluster", "space", "person_id").agg(F.count("*").alias("n"))
    return n.withColumn("labeled", F.sum("n").over(Window.partitionBy("cluster")))


def map_clusters(counted: DataFrame, min_labeled: int = 3, majority: float = 0.6) -> DataFrame:
    """cluster, space, person_id, fraction, labeled, mapped: the winner by (votes, space, person), mapped if supported."""
    top = counted.groupBy("cluster").agg(F.max(F.struct("n", "space", "person_id")).alias("top"), F.max("labeled").alias("labeled"))
    fraction = F.col("top.n") / F.col("labeled")
    return top.select("cluster", "top.space", "top.person_id", fraction.alias("fraction"), "labeled", ((F.col("labeled") >= min_labeled) & (fraction >= majority)).alias("mapped"))


def centroids(members: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    mean = members.join(vectors, "face_id").groupBy("cluster").agg(mean_vector(dim).alias("mean"))
    return mean.select("cluster", S.l2_normalize(F.col("mean")).alias("centroid"))


def assigns(members: DataFrame, labels: DataFrame, mapping: DataFrame, vectors: DataFrame, meta: DataFrame, tags: DataFrame, dim: int, assign_sim: float = 0.55) -> DataFrame:
    """face_id, space, person_id, photo_id, kind, confidence for unlabelled members of mapped clusters.

    Confidence: mean cosine to the cluster's labelled members. Photos already tagged with the person are left out.
    """
    known = members.join(labels.select("face_id"), "face_id").join(vectors, "face_id").groupBy("cluster").agg(mean_vector(dim).alias("mean"))
    open_ = members.join(labels.select("face_id"), "face_id", "left_anti").join(meta.select("face_id", F.col("space").alias("face_space"), "photo_id"), "face_id")
    mapped = mapping.filter("mapped").select("cluster", "space", "person_id")
    got = open_.join(mapped, "cluster").join(tags.select("space", "person_id", "photo_id").distinct(), ["space", "person_id", "photo_id"], "left_anti")
    got = got.join(known, "cluster").join(vectors, "face_id").withColumn("confidence", S.dot(S.doubles(F.col("vec")), F.col("mean")))
    return got.select("face_id", "face_space", "person_id", "photo_id", F.when(F.col("confidence") >= assign_sim, "assign").otherwise("low_confidence").alias("kind"), "confidence")


def reassigns(members: DataFrame, labels: DataFrame, mapping: DataFrame, vectors: DataFrame, meta: DataFrame, dim: int, min_labeled: int = 3, assign_sim: float = 0.55) -> DataFrame:
    """face_id, from_person_id, person_id, confidence, from_similarity: labelled faces that sit in another person's cluster.

    Support leaves the face itself out; from_similarity is its mean cosine to its own person's other faces, null without any.
    """
    x = mapping.filter(F.col("mapped") & (F.col("labeled") - 1 >= min_labeled)).select("cluster", F.col("space").alias("x_space"), F.col("person_id").alias("x"))
    known = members.join(labels, "face_id").join(vectors, "face_id")
    of_x = known.join(x, "cluster").filter((F.col("space") == F.col("x_space")) & (F.col("person_id") == F.col("x"))).groupBy("cluster").agg(mean_vector(dim).alias("x_mean"))
    own = labels.join(vectors, "face_id").groupBy("space", "person_id").agg(sum_vector(dim).alias("own_sum"), F.count("*").alias("own_n"))
    disputed = known.filter("syno_face_id IS NOT NULL").join(x, "cluster").filter((F.col("space") == F.col("x_space")) & (F.col("person_id") != F.col("x")))
    got = disputed.join(meta.select("face_id", F.col("space").alias("face_space")), "face_id").filter(F.col("face_space") == F.col("x_space")).join(of_x, "cluster").join(own, ["space", "person_id"])
    v = S.doubles(F.col("vec"))
    got = got.withColumns({"confidence": S.dot(v, F.col("x_mean")), "from_similarity": F.when(F.col("own_n") > 1, (S.dot(v, F.col("own_sum")) - S.dot(v, v)) / (F.col("own_n") - 1))})
    return got.filter(F.col("confidence") >= assign_sim).select("face_id", F.col("person_id").alias("from_person_id"), F.col("x").alias("person_id"), "confidence", "from_similarity")


def new_persons(members: DataFrame, labels: DataFrame, min_faces: int = 5, exemplars: int = 20) -> DataFrame:
    """cluster, size, rank, face_id: clusters without any label and their first exemplars by id."""
    sized = members.join(labels.select("face_id", F.lit(1).alias("known")), "face_id", "left").groupBy("cluster").agg(F.count("*").alias("size"), F.count("known").alias("known")).filter((F.col("known") == 0) & (F.col("size") >= min_faces))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("face_id")).cast("long")
    return members.join(sized.select("cluster", "size"), "cluster").withColumn("rank", rank).filter(F.col("rank") <= exemplars).select("cluster", "size", "rank", "face_id")


def merges_within(counted: DataFrame, fraction: float = 0.3) -> DataFrame:
    """a, b, cluster: persons who share a cluster, each with at least that part of its votes; a pair's first cluster."""
    strong = counted.filter(F.col("n") / F.col("labeled") >= fraction).select("cluster", F.struct("space", "person_id").alias("p"))
    a, b = strong.alias("a"), strong.alias("b")
    pairs = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.p") < F.col("b.p")))
    return pairs.groupBy(F.col("a.p.person_id").alias("a"), F.col("b.p.person_id").alias("b")).agg(F.min("a.cluster").alias("cluster"))


def close_clusters(mapped: DataFrame, centers: DataFrame, above: float = 0.6) -> DataFrame:
    """a, b (persons, a < b), ca, cb (clusters, ca < cb), similarity: mapped clusters of two persons whose centroids' cosine is more than `above`."""
    persons = mapped.select("cluster", "person_id")
    found = close_pairs(persons.join(centers, "cluster").select(F.col("cluster").alias("id"), F.col("centroid").alias("vec")), above)
    pairs = found.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "similarity")
    for s in "ab":
        pairs = pairs.join(persons.select(F.col("cluster").alias(f"c{s}"), F.col("person_id").alias(f"p{s}")), f"c{s}")
    return pairs.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), "ca", "cb", "similarity")


def merges_between(mapping: DataFrame, centers: DataFrame, within: DataFrame, above: float = 0.6) -> DataFrame:
    """a, b, similarity: persons of two mapped clusters with close centroids, unless one cluster already showed the pair; a pair's first clusters."""
    first = close_clusters(mapping.filter("mapped"), centers, above).groupBy("a", "b").agg(F.min(F.struct("ca", "cb", "similarity")).alias("f"))
    return first.join(within, ["a", "b"], "left_anti").select("a", "b", F.col("f.similarity").alias("similarity"))


# ---- truth labels --------------------------------------------------------------------------


def iou_pairs(faces: DataFrame, truth: DataFrame, photos: DataFrame, least: float = 0.3) -> DataFrame:
    """face_id, position, syno_face_id, person_id, iou of faces and truth boxes of one photo that overlap enough."""
    dims = photos.select("space", F.col("id").alias("photo_id"), "width", "height")
    box = S.normalized_box(*(F.col(c) for c in ("x", "y", "w", "h", "width", "height")))
    ours = faces.join(dims, ["space", "photo_id"]).select("space", "photo_id", "face_id", *(c.alias(f"f{i}") for i, c in enumerate(box))).filter("f0 IS NOT NULL")
    theirs = truth.filter("person_id IS NOT NULL").select("space", "photo_id", "syno_face_id", "person_id", F.col("line").alias("position"), "x1", "y1", "x2", "y2")
    both = ours.join(theirs, ["space", "photo_id"])
    overlap = S.iou(tuple(F.col(f"f{i}") for i in range(4)), tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    return both.withColumn("iou", overlap).filter(F.col("iou") >= least).select("space", "photo_id", "face_id", "position", "syno_face_id", "person_id", "iou")


def greedy_match(pairs: DataFrame) -> DataFrame:
    """One-to-one matches of each photo, best (iou, face_id, position) first: a fold over the photo's few pairs in that order."""
    one = F.struct("iou", "face_id", "position", "syno_face_id", "person_id")
    ranked = pairs.groupBy("space", "photo_id").agg(F.sort_array(F.collect_list(one), asc=False).alias("pairs"))
    clash = lambda acc, p: F.exists(acc, lambda k: (k["face_id"] == p["face_id"]) | (k["position"] == p["position"]))
    kept = F.aggregate("pairs", F.filter("pairs", lambda p: F.lit(False)), lambda acc, p: F.when(clash(acc, p), acc).otherwise(F.concat(acc, F.array(p))))
    return ranked.select("space", "photo_id", F.explode(kept).alias("m")).select("space", "photo_id", "m.*")


def label_faces(faces: DataFrame, truth: DataFrame, photos: DataFrame, tags: DataFrame) -> DataFrame:
    """face_id, space, person_id, syno_face_id: matched boxes; and in photos without any truth box, the one face of the one tag."""
    matched = greedy_match(iou_pairs(faces, truth, photos)).select("face_id", "space", "person_id", "syno_face_id")
    at = ["space", "photo_id"]
    known = faces.join(photos.select("space", F.col("id").alias("photo_id")), at)
    alone = known.groupBy(*at).agg(F.count("*").alias("n"), F.min("face_id").alias("face_id")).filter("n = 1")
    tag = tags.groupBy(*at).agg(F.count("*").alias("tags"), F.min("person_id").alias("person_id")).filter("tags = 1")
    rest = alone.join(truth.select(*at), at, "left_anti").join(tag, at)
    return matched.unionByName(rest.select("face_id", "space", "person_id", F.lit(None).cast("long").alias("syno_face_id")))


# ---- detections ----------------------------------------------------------------------------


def _overlap(a: Column, b: Column) -> Column:
    return S.iou(S.xyxy(*(a[c] for c in "xywh")), S.xyxy(*(b[c] for c in "xywh")))


def nms(boxes: DataFrame, group: list[str], threshold: float = 0.45) -> DataFrame:
    """Boxes (x, y, w, h, det_score, face_id) left after greedy suppression in each group: overlap above the threshold with a better one goes.

    A fold over the group's boxes, best first, equal scores by id: groups are photos, which hold few boxes.
    """
    one = F.struct((-F.col("det_score")).alias("order"), "face_id", "x", "y", "w", "h")
    ranked = boxes.groupBy(*group).agg(F.array_sort(F.collect_list(one)).alias("boxes"))
    kept = F.aggregate("boxes", F.filter("boxes", lambda b: F.lit(False)), lambda acc, b: F.when(F.exists(acc, lambda k: _overlap(k, b) > threshold), acc).otherwise(F.concat(acc, F.array(b))))
    return ranked.select(*group, F.explode(kept).alias("b")).select(*group, "b.face_id", "b.x", "b.y", "b.w", "b.h", (-F.col("b.order")).alias("det_score"))


def detect_union(boxes: DataFrame, group: list[str], cross_iou: float = 0.5, min_face_px: float = 20) -> DataFrame:
    """face_id, detector, det_score, det_score_secondary of both detectors' boxes fused in each group.

    Secondary boxes by falling score take the free primary they overlap most, if enough; that keeps its box and becomes
    merged. Others stay as they are. Boxes with a short side go last. A fold over a photo's secondary boxes.
    """
    one = F.struct((-F.col("det_score")).alias("order"), "face_id", "x", "y", "w", "h", "det_score")
    of = lambda d: F.array_sort(F.collect_list(F.when(F.col("detector") == d, one)))
    both = boxes.filter(F.col("detector").isin("scrfd", "yolo")).groupBy(*group).agg(of("scrfd").alias("first"), of("yolo").alias("second"))
    start = F.struct(F.array().cast("array<struct<p:bigint,score:double>>").alias("matched"), F.filter("second", lambda b: F.lit(False)).alias("alone"))

    def take(acc: Column, s: Column) -> Column:
        free = F.filter("first", lambda p: ~F.exists(acc["matched"], lambda m: m["p"] == p["face_id"]))
        best = F.array_max(F.transform(free, lambda p: F.struct(_overlap(p, s).alias("iou"), (-p["face_id"]).alias("p"))))
        hit = F.coalesce(best["iou"] >= cross_iou, F.lit(False))
        won = F.concat(acc["matched"], F.array(F.struct((-best["p"]).alias("p"), s["det_score"].alias("score"))))
        return F.struct(F.when(hit, won).otherwise(acc["matched"]).alias("matched"), F.when(hit, acc["alone"]).otherwise(F.concat(acc["alone"], F.array(s))).alias("alone"))

    got = both.withColumn("end", F.aggregate("second", start, take))

    def merged(p: Column) -> Column:
        score = F.get(F.transform(F.filter(F.col("end.matched"), lambda m: m["p"] == p["face_id"]), lambda m: m["score"]), F.lit(0))
        return F.struct(p["face_id"].alias("face_id"), F.when(score.isNull(), "scrfd").otherwise("merged").alias("detector"), p["det_score"].alias("det_score"), score.alias("det_score_secondary"), F.least(p["w"], p["h"]).alias("side"))

    plain = lambda s: F.struct(s["face_id"].alias("face_id"), F.lit("yolo").alias("detector"), s["det_score"].alias("det_score"), F.lit(None).cast("double").alias("det_score_secondary"), F.least(s["w"], s["h"]).alias("side"))
    out = got.select(*group, F.explode(F.concat(F.transform("first", merged), F.transform("end.alone", plain))).alias("d")).select(*group, "d.*")
    return out.filter(F.col("side") >= min_face_px).drop("side")


# ---- quality -------------------------------------------------------------------------------


def contingency(items: DataFrame) -> DataFrame:
    """n for each (cluster, person), with each one's total, from (cluster, person_id)."""
    n = items.groupBy("cluster", "person_id").agg(F.count("*").alias("n"))
    by = lambda c: n.groupBy(c).agg(F.sum("n").alias(f"n_{c}"))
    return n.join(by("cluster"), "cluster").join(by("person_id"), "person_id")


def cluster_metrics(items: DataFrame) -> DataFrame:
    """Pairwise and B-cubed precision, recall and F1 from the contingency counts; 1 where there is nothing to miss."""
    c = contingency(items)
    pairs = lambda x: F.coalesce(F.sum(x * (x - 1) / 2), F.lit(0.0))
    n = F.col("n")
    sides = [items.groupBy(k).agg(F.count("*").alias("m")).agg(pairs(F.col("m")).alias(name)) for k, name in (("cluster", "pc"), ("person_id", "pp"))]
    got = c.agg(pairs(n).alias("tp"), (F.sum(n * n / F.col("n_cluster")) / F.sum(n)).alias("bp"), (F.sum(n * n / F.col("n_person_id")) / F.sum(n)).alias("br")).crossJoin(sides[0]).crossJoin(sides[1])  # one row each
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    f1 = lambda p, r: F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    got = got.select(ratio(F.col("tp"), F.col("pc")).alias("pairwise_precision"), ratio(F.col("tp"), F.col("pp")).alias("pairwise_recall"), F.coalesce("bp", F.lit(1.0)).alias("bcubed_precision"), F.coalesce("br", F.lit(1.0)).alias("bcubed_recall"))
    return got.withColumns({"pairwise_f1": f1(F.col("pairwise_precision"), F.col("pairwise_recall")), "bcubed_f1": f1(F.col("bcubed_precision"), F.col("bcubed_recall"))})


def stratified_mask(labels: DataFrame, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Labels to hide: of each person with 3 faces or more min(round(fraction n), n - 1), half to even, by a hash order."""
    person = Window.partitionBy("space", "person_id")
    order = person.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("face_id").cast("string"))), "face_id")
    got = labels.withColumns({"n": F.count("*").over(person), "r": F.row_number().over(order)})
    return got.filter((F.col("n") >= 3) & (F.col("r") <= F.least(F.bround(fraction * F.col("n")), F.col("n") - 1))).select("face_id", "space", "person_id")
