"""Queries over vectors, graphs, clusters, boxes and the state machines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cron, pictures
from ..functions import scalar as S
from ..operators import cells, crossref, dedupe, density, graph, library, review, whispers
from ..operators.ids import consecutive
from .library import STATE
from .registry import query
from .standins import Tables

DIM, K, EDGE = 64, 10, 0.35


# ---- functions -----------------------------------------------------------------------------


@query("SELECT id, sha256(filename) AS digest, substr(sha256(concat(filename, cache_key)), 1, 12) AS version FROM photos")
def fn_sha256(t: Tables) -> DataFrame:
    return t.photos.select("id", S.token_hash(F.col("filename")).alias("digest"), S.version_hash(F.col("filename"), F.col("cache_key")).alias("version"))


def gray_pictures(t: Tables) -> DataFrame:
    """id, pixels: gray pictures of 32 x 32, whose pixels are made from the vectors' values."""
    value = lambda i: F.get("e", (i % 64).cast("int")) * 1_000_000.0 * (1 + F.floor(i / 64))
    pixels = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: (F.floor(F.abs(value(i))) % 256).cast("double"))
    return t.embeddings.select(F.col("vec_id").alias("id"), S.doubles(F.col("embedding")).alias("e")).select("id", pixels.alias("pixels"))


def hashes(t: Tables) -> DataFrame:
    return gray_pictures(t).select("id", pictures.picture_hash(F.col("pixels")).alias("hash"))


PIXELS = "x AS (SELECT vec_id AS id, unnest(range(0, 1024)) AS i, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), px AS (SELECT id, i // 32 AS row, i % 32 AS col, CAST(floor(abs(e[i % 64 + 1] * 1000000.0 * (1 + i // 64))) AS BIGINT) % 256 AS p FROM x)"
BITS = f"""{PIXELS},
d1 AS (SELECT id, u, col, sum(p * cos(pi() * u * (2 * row + 1) / 64)) AS s FROM px, range(0, 8) a(u) GROUP BY ALL), d2 AS (SELECT id, u, w, sum(s * cos(pi() * w * (2 * col + 1) / 64)) AS s FROM d1, range(0, 8) b(w) GROUP BY ALL),
s AS (SELECT id, list(s ORDER BY u, w) AS e, list(s ORDER BY s) AS o FROM d2 GROUP BY id), b AS (SELECT id, list_transform(e, lambda x: CASE WHEN x > (o[32] + o[33]) / 2 THEN 1 ELSE 0 END) AS v FROM s)"""
HEX = "h AS (SELECT id, array_to_string(list_transform(range(0, 16), lambda i: substr('0123456789abcdef', v[i * 4 + 1] * 8 + v[i * 4 + 2] * 4 + v[i * 4 + 3] * 2 + v[i * 4 + 4] + 1, 1)), '') AS hash, array_to_string(v, '') AS bits FROM b)"


@query(f"WITH {BITS}, {HEX} SELECT id, hash FROM h")
def fn_phash(t):
    return hashes(t)


@query(f"WITH {BITS}, {HEX} SELECT a.id AS a, b.id AS b, CAST(hamming(a.bits, b.bits) AS BIGINT) AS distance FROM h a JOIN h b ON b.id = a.id + 1")
def fn_hamming(t):
    a = hashes(t)
    b = a.select((F.col("id") - 1).alias("id"), F.col("id").alias("b"), F.col("hash").alias("other"))
    return a.join(b, "id").select(F.col("id").alias("a"), "b", S.hamming64(F.col("hash"), F.col("other")).alias("distance"))


def text_sql() -> str:
    """h (id, hash as a number of 64 bits) of the documents: the bits that more than half of the three-word shingles have."""
    bit = " + ".join(f"CASE WHEN 2 * sum((m // {1 << i}) % 2) > count(*) THEN {1 << i}::HUGEINT ELSE 0 END" for i in range(64))
    return f"""w AS (SELECT doc_id AS id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT id, array_to_string(list_slice(w, i, i + 2), ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
m AS (SELECT id, CAST('0x' || substr(md5(s), 1, 16) AS UBIGINT)::HUGEINT AS m FROM s), h AS (SELECT id, ({bit})::UBIGINT AS hash FROM m GROUP BY id)"""


FOLDED = f"{text_sql()}, f AS (SELECT min(id) AS id, hash FROM h GROUP BY hash), p AS (SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.hash, b.hash)) AS BIGINT) AS distance FROM f a JOIN f b ON a.id < b.id AND bit_count(xor(a.hash, b.hash)) <= 5)"


def text_hashes(t: Tables) -> DataFrame:
    return dedupe.text_hashes(t.documents.select(F.col("doc_id").alias("id"), "text"))


@query(f"WITH {FOLDED} SELECT a, b, distance FROM p")
def join_hamming(t):
    """Pairs of different hashes within 5 bits, each hash by its smallest id."""
    from .storage import written

    return dedupe.hamming_pairs(written(dedupe.fold_hashes(text_hashes(t)), "hashes"), 5)


@query(f"""WITH RECURSIVE {FOLDED}, e AS (SELECT a AS x, b AS y FROM p UNION ALL SELECT b, a FROM p),
r(x, y) AS (SELECT id, id FROM f UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), c AS (SELECT x, min(y) AS component, count(*) AS n FROM r GROUP BY x), k AS (SELECT f.hash, min(f.id) AS id, count(*) AS n FROM f JOIN h ON h.hash = f.hash GROUP BY 1)
SELECT h.id, c.component FROM h JOIN k ON k.hash = h.hash JOIN c ON c.x = k.id WHERE c.n > 1 OR k.n > 1""")
def op_dedupe_visual(t):
    return dedupe.visual_groups(text_hashes(t), 5)


@query("SELECT vec_id AS id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS d FROM embeddings")
def fn_dot(t):
    v = S.doubles(F.col("embedding"))
    return t.embeddings.select(F.col("vec_id").alias("id"), F.round(S.dot(v, v), 6).alias("d"))


@query("WITH d AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN vec_id % 50 = 0 THEN 0 ELSE x * 3 END) AS v FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM d) SELECT id, round(list_sum(list_transform(v, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END)), 6) AS total FROM n")
def fn_l2norm(t):
    v = F.transform(S.doubles(F.col("embedding")), lambda x: F.when(F.col("vec_id") % 50 == 0, 0.0).otherwise(x * 3))
    return t.embeddings.select(F.col("vec_id").alias("id"), F.round(F.aggregate(S.l2_normalize(v), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


COS = "SELECT a.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def neighbours(t: Tables) -> DataFrame:
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(b, "vec_id").select(F.col("vec_id").alias("id"), S.cosine(S.doubles(F.col("embedding")), S.doubles(F.col("other"))).alias("cosine"))


@query(COS)
def fn_cosine(t):
    return neighbours(t).select("id", F.round("cosine", 6).alias("cosine"))


@query(f"SELECT id, round(1 - cosine, 6) AS disagreement, 1 - cosine > 0.95 AS flagged FROM ({COS.replace('round(', '(').replace(', 6)', ')')})")
def fn_disagreement(t):
    d = 1 - F.col("cosine")
    return neighbours(t).select("id", F.round(d, 6).alias("disagreement"), (d > 0.95).alias("flagged"))


def models(t: Tables) -> DataFrame:
    """Two models' vectors: the halves of the given ones; every seventh face lacks the second."""
    e = t.embeddings
    a = e.select(F.col("vec_id").alias("face_id"), F.lit("a").alias("model"), F.slice("embedding", 1, 32).alias("vec"))
    return a.unionByName(e.filter("vec_id % 7 <> 0").select(F.col("vec_id").alias("face_id"), F.lit("b").alias("model"), F.slice("embedding", 33, 32).alias("vec")))


@query("SELECT vec_id AS face_id, m.model FROM embeddings, (VALUES ('a'), ('b')) m(model) WHERE vec_id % 7 <> 0")
def set_complete_models(t):
    return library.complete_models(models(t)).select("face_id", "model")


FUSED = """u AS (SELECT vec_id AS face_id, CAST(embedding[1:32] AS DOUBLE[]) AS a, CAST(embedding[33:64] AS DOUBLE[]) AS b FROM embeddings WHERE vec_id % 7 <> 0),
n AS (SELECT face_id, list_concat(list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))), list_transform(b, lambda x: 2 * x / sqrt(list_dot_product(b, b)))) AS v FROM u), f AS (SELECT face_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM n)"""


@query(f"WITH {FUSED} SELECT face_id, CAST(len(v) AS BIGINT) AS dim, round(v[1], 6) AS first, round(v[64], 6) AS last, round(list_sum(v), 5) AS total FROM f")
def op_load_fused(t):
    f = graph.fuse(library.complete_models(models(t)), {"b": 2.0})
    v = F.col("vec")
    return f.select("face_id", F.size(v).cast("long").alias("dim"), F.round(F.get(v, F.lit(0)), 6).alias("first"), F.round(F.get(v, F.lit(63)), 6).alias("last"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(f"WITH {FUSED} SELECT face_id, round(list_dot_product(v, v), 6) AS norm FROM f")
def fn_fuse(t):
    f = graph.fuse(library.complete_models(models(t)), {"b": 2.0})
    return f.select("face_id", F.round(S.dot(F.col("vec"), F.col("vec")), 6).alias("norm"))


def boxes(t: Tables) -> DataFrame:
    return t.faces.select("face_id", "x", "y", "w", "h")


@query("""WITH p AS (SELECT a.face_id, b.face_id AS other, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS i, a.w * a.h + b.w * b.h AS s FROM faces a JOIN faces b ON a.photo_id = b.photo_id AND a.face_id < b.face_id)
SELECT face_id, other, round(i / (s - i), 6) AS iou FROM p WHERE i > 0""")
def fn_iou(t):
    a = t.faces.select("photo_id", "face_id", *(F.col(c).alias(f"a{c}") for c in "xywh"))
    b = t.faces.select("photo_id", F.col("face_id").alias("other"), *(F.col(c).alias(f"b{c}") for c in "xywh"))
    over = S.iou(S.xyxy(*(F.col(f"a{c}") for c in "xywh")), S.xyxy(*(F.col(f"b{c}") for c in "xywh")))
    return a.join(b, "photo_id").filter("face_id < other").select("face_id", "other", F.round(over, 6).alias("iou")).filter("iou > 0")


@query("SELECT face_id, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM faces")
def fn_xyxy(t):
    return t.faces.select("face_id", *(c.alias(n) for c, n in zip(S.xyxy(*(F.col(c) for c in "xywh")), ("x1", "y1", "x2", "y2"), strict=True)))


@query("SELECT face_id, CAST(greatest(floor(x - w * 0.3), 0) AS BIGINT) AS x1, CAST(greatest(floor(y - h * 0.3), 0) AS BIGINT) AS y1, CAST(least(ceil(x + w * (1 + 0.3)), 1000) AS BIGINT) AS x2, CAST(least(ceil(y + h * (1 + 0.3)), 1000) AS BIGINT) AS y2 FROM (SELECT face_id, CAST(floor(x) AS BIGINT) * 10 / 10.0 AS x, y, floor(w / 10) * 10 AS w, floor(h / 10) * 10 AS h FROM faces)")
def fn_crop_rect(t):
    f = t.faces.withColumns({"w": F.floor(F.col("w") / 10).cast("double") * 10, "h": F.floor(F.col("h") / 10).cast("double") * 10})
    rect = S.crop_rect(*(F.col(c) for c in "xywh"), F.lit(1000), F.lit(1000), 0.3)
    return f.select("face_id", *(c.cast("long").alias(n) for c, n in zip(rect, ("x1", "y1", "x2", "y2"), strict=True)))


@query("SELECT id, round(least(640 / width, 640 / height), 6) AS ratio, (640 - round_even(width * least(640 / width, 640 / height), 0)) / 2 AS left_, (640 - round_even(height * least(640 / width, 640 / height), 0)) / 2 AS top_ FROM photos WHERE width > 0 AND height > 0")
def fn_letterbox(t):
    ratio, left, top = S.letterbox(F.col("width"), F.col("height"), 640)
    return t.photos.filter("width > 0 AND height > 0").select("id", F.round(ratio, 6).alias("ratio"), left.alias("left_"), top.alias("top_"))


@query("SELECT id, CASE WHEN a = b THEN a ELSE a || ',' || b END AS plan FROM (SELECT id, printf('%.4f', least(1.0, 450 / greatest(width, height))) AS a, printf('%.4f', least(2.0, 450 / greatest(width, height))) AS b FROM photos WHERE width > 0 AND height > 0)")
def fn_scale_plan(t):
    """Two scales of every known size: both free, one capped, and both capped to the same."""
    plan = S.scale_plan(F.col("width"), F.col("height"), F.array(F.lit(1.0), F.lit(2.0)), 450)
    return t.photos.filter((F.col("width") > 0) & (F.col("height") > 0)).select("id", F.array_join(F.transform(plan, lambda x: F.format_string("%.4f", x)), ",").alias("plan"))


@query("SELECT id, CAST(a.i * 8 + 4 - 3 AS DOUBLE) AS x1, CAST(a.i * 8 + 4 + 5 AS DOUBLE) AS x2 FROM photos, (SELECT unnest(range(0, 4)) AS i) a")
def fn_anchor_decode(t):
    at = t.photos.select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    centre = F.col("i") * 8.0 + 4
    return at.select("id", (centre - 3).alias("x1"), (centre + 5).alias("x2"))


@query("""SELECT id, CASE WHEN s < 60 THEN CAST(CAST(round_even(greatest(s, 0), 0) AS BIGINT) AS VARCHAR) || 's' WHEN s < 3600 THEN printf('%dm %02ds', w // 60, w % 60) ELSE printf('%dh %02dm', w // 3600, w // 60 % 60) END AS duration,
CASE WHEN s / 50 >= 1 THEN printf('%.1f/s', s / 50) WHEN s > 0 THEN printf('%.1f/min', s / 50 * 60) ELSE '0/s' END AS rate
FROM (SELECT *, CAST(floor(s) AS BIGINT) AS w FROM (SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN -3.0 WHEN doc_id % 9 < 5 THEN doc_id % 240 / 4 ELSE CAST(n_chars AS DOUBLE) END AS s FROM documents))""")
def fn_duration(t):
    s = F.expr("CASE WHEN doc_id % 9 = 0 THEN -3.0D WHEN doc_id % 9 < 5 THEN doc_id % 240 / 4 ELSE CAST(n_chars AS DOUBLE) END")
    return t.documents.select(F.col("doc_id").alias("id"), S.human_duration(s).alias("duration"), S.human_rate(s / 50).alias("rate"))


@query("SELECT doc_id AS id, CASE WHEN n_chars < 1024 THEN CAST(n_chars AS VARCHAR) || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', n_chars / 1024) ELSE printf('%.1f MB', n_chars / 1048576) END AS size FROM documents")
def fn_human_bytes(t):
    return t.documents.select(F.col("doc_id").alias("id"), S.human_bytes(F.col("n_chars")).alias("size"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'step ' || CAST(id AS VARCHAR) ELSE 'done' END AS line FROM (SELECT doc_id AS id FROM documents)")
def fn_console_line(t):
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("old\r\x1b[32mstep "), F.col("doc_id").cast("string"), F.lit("\x1b[0m  \r  "))).otherwise("x\rdone  ")
    return t.documents.select(F.col("doc_id").alias("id"), S.console_line(raw).alias("line"))


@query("SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'ValueError: bad ' || CAST(doc_id AS VARCHAR) WHEN 1 THEN 'SyntaxError: odd' WHEN 2 THEN 'at line ' || CAST(doc_id AS VARCHAR) ELSE 'exited with code 3 and no output' END AS reason FROM documents")
def fn_failure_reason(t):
    number, k = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("Traceback (most recent call last):\n  File x\nValueError: bad "), number, F.lit("\n    more\n"))).when(k == 1, "SyntaxError: odd  \n^^^^\n~~~ here\n")
        .when(k == 2, F.concat(F.lit("  in a\n  at line "), number, F.lit(" \n\n"))).otherwise(" \n\n")
    )
    return t.documents.select(F.col("doc_id").alias("id"), S.failure_reason(text, F.lit(3)).alias("reason"))


@query("SELECT id, lower(trim(name)) AS name, rtrim('http://x//', '/') AS base FROM persons WHERE name LIKE '%00%'")
def fn_str(t):
    return t.persons.filter(F.col("name").like("%00%")).select("id", F.lower(F.trim("name")).alias("name"), F.rtrim(F.lit("http://x//"), F.lit("/")).alias("base"))


@query("SELECT item_id, json_extract_string(CASE WHEN json_valid(payload_json) THEN payload_json END, '$.person_a.name') AS name, CAST(json_extract_string(CASE WHEN json_valid(payload_json) THEN payload_json END, '$.face_id') AS BIGINT) AS face_id FROM queue")
def fn_json_get(t):
    return t.queue.select("item_id", review.json_at("person_a.name").alias("name"), review.json_at("face_id", "bigint").alias("face_id"))


@query("""SELECT item_id, '{"face_ids":[' || CAST(item_id * 8 + 1 AS VARCHAR) || ',' || CAST(item_id * 8 + 2 AS VARCHAR) || '],"size":2,"suggested_name":"N' || CAST(item_id AS VARCHAR) || '"}' AS payload_json FROM queue WHERE kind = 'new_person'""")
def mut_name(t):
    names = t.queue.select("item_id", F.concat(F.lit("N"), F.col("item_id").cast("string")).alias("name"))
    return review.suggest_name(t.queue, names).filter("kind = 'new_person'").select("item_id", "payload_json")


@query("SELECT item_id, CAST(unnest([item_id * 8 + 1, item_id * 8 + 3, 4]) AS BIGINT) AS face_id FROM queue WHERE kind = 'merge'")
def fn_json_map(t):
    return review.referenced_faces(t.queue.filter("kind = 'merge'")).select("item_id", "face_id")


CRON = """g AS (SELECT id, to_timestamp(s) AT TIME ZONE 'UTC' AS t0 FROM (SELECT doc_id AS id, 1700000000 + doc_id * 4321 AS s FROM documents)),
c AS (SELECT id, t0, date_trunc('day', t0) + to_days(CAST(d AS INTEGER)) + to_minutes(CAST(m AS BIGINT)) AS t FROM g, range(0, 40) r(d), (VALUES (390), (1110)) v(m))"""


@query(f"WITH {CRON} SELECT id, CAST(epoch(min(t)) AS BIGINT) AS next_fire FROM c WHERE t > t0 AND (day(t) IN (1, 15) OR dayofweek(t) = 1) GROUP BY id")
def fn_cron_next(t):
    when = t.documents.select(F.col("doc_id").alias("id"), (F.lit(1_700_000_000) + F.col("doc_id") * 4321).alias("at"))
    return cron.next_fire(when, "at", "30 6,18 1,15 * mon", horizon=60).select("id", "next_fire")


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 24 * 3600 + p_partkey % 60 * 60 AS clock, 1704067200 + p_partkey * 997 AS start FROM part)
SELECT id, CAST(start // 86400 * 86400 + clock + (k + CASE WHEN start % 86400 // 60 * 60 >= clock THEN 1 ELSE 0 END) * 86400 AS BIGINT) AS fire FROM p, range(0, 3) r(k)""")
def cron_fires(t):
    """Each schedule's own expression, by a table function in a lateral join."""
    text = F.concat_ws(" ", (F.col("p_partkey") % 60).cast("string"), (F.col("p_partkey") % 24).cast("string"), F.lit("* * *"))
    plans = t.part.select(F.col("p_partkey").alias("id"), text.alias("expression"), F.lit("UTC").alias("zone"), (1704067200 + F.col("p_partkey") * 997).alias("start"))
    return cron.fires(plans, "expression", "zone", "start", 3).select("id", "fire")


@query("SELECT event_id AS id, (month(ts) = 1 AND (day(ts) IN (1, 15) OR dayofweek(ts) = 1)) AS fires FROM events")
def fn_cron_match(t):
    return t.events.select(F.col("event_id").alias("id"), cron.matches_day(F.to_date("ts"), cron.parse("30 6 1,15 jan mon")).alias("fires"))


# ---- graphs --------------------------------------------------------------------------------

KNN = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.id AS src, b.id AS dst, list_dot_product(a.e, b.e) AS similarity FROM v a JOIN v b ON a.id <> b.id),
k AS (SELECT src, dst, similarity, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS rank FROM p QUALIFY rank <= 10)"""
EDGES = "e AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(similarity) AS w FROM k WHERE similarity >= 0.35 GROUP BY 1, 2)"


def near(t: Tables) -> DataFrame:
    return cells.neighbours(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), K)


def edges(t: Tables) -> DataFrame:
    return graph.threshold_edges(near(t), EDGE)


def ids(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"))


@query(f"WITH {KNN} SELECT src, dst, rank, round(similarity, 6) AS similarity FROM k")
def op_knn(t):
    return near(t).select("src", "dst", "rank", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {KNN} SELECT src, dst, rank FROM k WHERE rank <= 3")
def win_top_k_knn(t):
    return near(t).filter("rank <= 3").select("src", "dst", "rank")


@query(f"WITH {KNN}, {EDGES} SELECT src, dst, round(w, 6) AS w FROM e")
def op_threshold_graph(t):
    return edges(t).select("src", "dst", F.round("w", 6).alias("w"))


@query(f"WITH {KNN} SELECT a.src, a.dst, round(greatest(1 - a.similarity, 1e-6), 6) AS distance FROM k a JOIN k b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def op_mutual_knn(t):
    return graph.mutual_edges(near(t)).select("src", "dst", F.round("distance", 6).alias("distance"))


@query(f"WITH RECURSIVE {KNN}, {EDGES}, u AS (SELECT src AS x, dst AS y FROM e UNION ALL SELECT dst, src FROM e), r(x, y) AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x) SELECT x AS id, least(min(y), x) AS component FROM r GROUP BY x")
def op_connected_components(t):
    return graph.components(edges(t))


SYNC = """u AS (SELECT src AS x, dst AS y, w FROM e UNION ALL SELECT dst, src, w FROM e), l0 AS (SELECT vec_id AS id, vec_id AS label FROM embeddings)"""


def _round(i: int) -> str:
    return f"""v{i} AS (SELECT x AS id, label, round(sum(w), 9) AS w FROM u JOIN l{i} ON y = id GROUP BY 1, 2), b{i} AS (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY w DESC, label) AS r FROM v{i}),
l{i + 1} AS (SELECT l{i}.id, coalesce(b{i}.label, l{i}.label) AS label FROM l{i} LEFT JOIN b{i} ON l{i}.id = b{i}.id AND r = 1)"""


@query(f"WITH {KNN}, {EDGES}, {SYNC}, {', '.join(map(_round, range(3)))} SELECT id, label FROM l3")
def op_cw_sync(t):
    return graph.spread_labels(ids(t), edges(t), 3)


# One visit after another, each a step of a recursion; it ends when two sweeps' worth of visits have changed nothing.
WHISPERS = f"""{KNN}, {EDGES}, u AS MATERIALIZED (SELECT src AS x, dst AS y, w FROM e UNION ALL SELECT dst, src, w FROM e), n AS (SELECT DISTINCT x AS id FROM u),
visit AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY sweep, md5('42:' || sweep || ':' || id), id) AS pos FROM n, range(0, 30) s(sweep)),
r(id, label, pos, changed) USING KEY (id) AS (SELECT id, id, 0::BIGINT, 0::BIGINT FROM n UNION
  (WITH s AS (SELECT max(pos) + 1 AS pos, max(changed) AS changed FROM r),
  b AS (SELECT v.id, l.label, s.pos, s.changed, sum(u.w) AS w FROM s JOIN visit v ON v.pos = s.pos JOIN u ON u.x = v.id JOIN recurring.r l ON l.id = u.y WHERE s.pos <= s.changed + 2 * (SELECT count(*) FROM n) GROUP BY ALL),
  c AS (SELECT id, min(label) AS label, pos, changed FROM (SELECT * FROM b QUALIFY w >= max(w) OVER () - 1e-12) GROUP BY ALL)
  SELECT c.id, c.label, c.pos, CASE WHEN c.label <> o.label THEN c.pos ELSE c.changed END FROM c JOIN recurring.r o ON o.id = c.id)),
l AS (SELECT vec_id AS id, coalesce(r.label, vec_id) AS label FROM embeddings LEFT JOIN r ON r.id = vec_id), f AS (SELECT label, row_number() OVER (ORDER BY min(id)) - 1 AS cluster FROM l GROUP BY label)"""


@query(f"WITH RECURSIVE {WHISPERS} SELECT id, cluster FROM l JOIN f USING (label)")
def op_chinese_whispers(t):
    return graph.relabel(whispers.chinese_whispers(ids(t), edges(t)))


@query()
def op_hdbscan(t):
    return density.hdbscan(ids(t), near(t))


@query("WITH l AS (SELECT vec_id AS id, CASE WHEN vec_id % 10 = 0 THEN 'n' || CAST(vec_id AS VARCHAR) ELSE CAST(vec_id * 7 % 23 AS VARCHAR) END AS g FROM embeddings), f AS (SELECT g, min(id) AS first FROM l GROUP BY g), r AS (SELECT g, row_number() OVER (ORDER BY first) - 1 AS cluster FROM f) SELECT id, cluster FROM l JOIN r USING (g)")
def op_relabel(t):
    return graph.relabel(t.embeddings.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 10 != 0, F.col("vec_id") * 7 % 23).alias("label")))


@query("WITH l AS (SELECT vec_id AS id, vec_id * 7 % 23 AS g FROM embeddings), f AS (SELECT g, min(id) AS first FROM l GROUP BY g) SELECT g, row_number() OVER (ORDER BY first) - 1 AS cluster FROM f")
def win_first_appearance(t):
    label = (F.col("vec_id") * 7 % 23).alias("label")
    got = graph.relabel(t.embeddings.select(F.col("vec_id").alias("id"), label))
    return got.join(t.embeddings.select(F.col("vec_id").alias("id"), label), "id").select(F.col("label").alias("g"), "cluster").distinct()


# ---- cross-reference -----------------------------------------------------------------------

LABELS = "k AS (SELECT face_id, space, person_id, syno_face_id FROM known WHERE labeled), t AS (SELECT space, person_id, photo_id FROM face_tags WHERE tagged)"
CORE = f"""{LABELS}, v AS (SELECT vec_id AS face_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT cluster, space, person_id, count(*) AS n FROM cluster_of JOIN k USING (face_id) GROUP BY 1, 2, 3), c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY cluster) AS BIGINT) AS labeled FROM n),
m AS (SELECT cluster, space, person_id, n / labeled AS fraction, labeled, labeled >= 3 AND n / labeled >= 0.6 AS mapped FROM c QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, space DESC, person_id DESC) = 1)"""


def truth(t: Tables) -> DataFrame:
    return t.known.filter("labeled").drop("labeled")


def tags(t: Tables) -> DataFrame:
    return t.face_tags.filter("tagged").drop("tagged")


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("face_id"), F.col("embedding").alias("vec"))


def mapping(t: Tables) -> DataFrame:
    return crossref.map_clusters(crossref.votes(t.cluster_of, truth(t)))


@query(f"WITH {CORE} SELECT cluster, space, person_id, round(fraction, 6) AS fraction, labeled, mapped FROM m")
def op_map_clusters(t):
    return mapping(t).withColumn("fraction", F.round("fraction", 6))


@query(f"WITH {CORE}, u AS (SELECT cluster, unnest(range(1, 65)) AS i, unnest(e) AS x FROM cluster_of JOIN v USING (face_id)), a AS (SELECT cluster, i, avg(x) AS x FROM u GROUP BY 1, 2), l AS (SELECT cluster, sqrt(sum(x * x)) AS n FROM a GROUP BY 1) SELECT cluster, round(max(CASE WHEN i = 1 THEN x / n END), 6) AS first, round(sum(x / n), 5) AS total FROM a JOIN l USING (cluster) GROUP BY 1")
def agg_centroid(t):
    c = crossref.centroids(t.cluster_of, vectors(t), DIM)
    return c.select("cluster", F.round(F.get("centroid", F.lit(0)), 6).alias("first"), F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


ASSIGN = f"""WITH {CORE}, q AS (SELECT o.face_id, f.space AS face_space, m.person_id, f.photo_id, o.cluster, v.e FROM cluster_of o JOIN m USING (cluster) JOIN face_meta f USING (face_id) JOIN v USING (face_id) WHERE m.mapped AND o.face_id NOT IN (SELECT face_id FROM k) AND NOT EXISTS (SELECT 1 FROM t WHERE t.space = m.space AND t.person_id = m.person_id AND t.photo_id = f.photo_id)),
s AS (SELECT q.face_id, q.face_space, q.person_id, q.photo_id, avg(list_dot_product(q.e, y.e)) AS conf FROM q JOIN cluster_of z ON z.cluster = q.cluster JOIN k ON k.face_id = z.face_id JOIN v y ON y.face_id = z.face_id GROUP BY 1, 2, 3, 4)
SELECT face_id, face_space, person_id, photo_id, CASE WHEN conf >= 0.01 THEN 'assign' ELSE 'low_confidence' END AS kind, round(conf, 6) AS confidence FROM s"""


@query(ASSIGN)
def op_assign(t):
    got = crossref.assigns(t.cluster_of, truth(t), mapping(t), vectors(t), t.face_meta, tags(t), DIM, 0.01)
    return got.withColumn("confidence", F.round("confidence", 6))


@query(ASSIGN.replace("SELECT face_id, face_space, person_id, photo_id, CASE WHEN conf >= 0.01 THEN 'assign' ELSE 'low_confidence' END AS kind, round(conf, 6) AS confidence FROM s", "SELECT face_id, round(conf, 6) AS mean_cosine FROM s"))
def agg_mean_cos(t):
    got = crossref.assigns(t.cluster_of, truth(t), mapping(t), vectors(t), t.face_meta, tags(t), DIM, 0.01)
    return got.select("face_id", F.round("confidence", 6).alias("mean_cosine"))


REASSIGN = f"""WITH {CORE}, d AS (SELECT k.face_id, k.person_id AS y, m.person_id AS x, o.cluster, v.e FROM k JOIN cluster_of o USING (face_id) JOIN m USING (cluster) JOIN v USING (face_id) JOIN face_meta f ON f.face_id = k.face_id WHERE m.mapped AND m.labeled - 1 >= 3 AND k.person_id <> m.person_id AND k.space = m.space AND f.space = m.space AND k.syno_face_id IS NOT NULL),
c2 AS (SELECT d.face_id, avg(list_dot_product(d.e, w.e)) AS conf FROM d JOIN cluster_of o ON o.cluster = d.cluster JOIN k ON k.face_id = o.face_id AND k.person_id = d.x JOIN v w ON w.face_id = o.face_id GROUP BY 1),
o2 AS (SELECT d.face_id, avg(list_dot_product(d.e, w.e)) AS fs FROM d JOIN k ON k.person_id = d.y AND k.face_id <> d.face_id JOIN v w ON w.face_id = k.face_id GROUP BY 1)
SELECT d.face_id, d.y AS from_person_id, d.x AS person_id, round(conf, 6) AS confidence, round(fs, 6) AS from_similarity FROM d JOIN c2 USING (face_id) LEFT JOIN o2 USING (face_id) WHERE conf >= -0.01"""


@query(REASSIGN)
def op_reassign(t):
    got = crossref.reassigns(t.cluster_of, truth(t), mapping(t), vectors(t), t.face_meta, DIM, 3, -0.01)
    return got.withColumns({c: F.round(c, 6) for c in ("confidence", "from_similarity")})


@query(REASSIGN.replace("SELECT d.face_id, d.y AS from_person_id, d.x AS person_id, round(conf, 6) AS confidence, round(fs, 6) AS from_similarity", "SELECT d.face_id, round(fs, 6) AS loo"))
def agg_loo_cos(t):
    got = crossref.reassigns(t.cluster_of, truth(t), mapping(t), vectors(t), t.face_meta, DIM, 3, -0.01)
    return got.select("face_id", F.round("from_similarity", 6).alias("loo"))


@query(f"WITH {LABELS}, s AS (SELECT cluster, count(*) AS size FROM cluster_of o LEFT JOIN k ON k.face_id = o.face_id GROUP BY 1 HAVING count(k.face_id) = 0 AND count(*) >= 5) SELECT cluster, size, row_number() OVER (PARTITION BY cluster ORDER BY face_id) AS rank, face_id FROM cluster_of JOIN s USING (cluster) QUALIFY rank <= 20")
def op_new_person(t):
    return crossref.new_persons(t.cluster_of, truth(t))


@query(f"WITH {CORE} SELECT a.person_id AS a, b.person_id AS b, min(a.cluster) AS cluster FROM c a JOIN c b ON a.cluster = b.cluster AND a.person_id < b.person_id WHERE a.n / a.labeled >= 0.15 AND b.n / b.labeled >= 0.15 GROUP BY 1, 2")
def op_merge_intra(t):
    return crossref.merges_within(crossref.votes(t.cluster_of, truth(t)), 0.15)


INTER = f"""WITH {CORE}, u AS (SELECT cluster, unnest(range(1, 65)) AS i, unnest(e) AS x FROM cluster_of JOIN v USING (face_id)), a AS (SELECT cluster, i, avg(x) AS x FROM u GROUP BY 1, 2), l AS (SELECT cluster, sqrt(sum(x * x)) AS n FROM a GROUP BY 1), g AS (SELECT cluster, i, x / n AS x FROM a JOIN l USING (cluster)),
s AS (SELECT p.cluster AS ca, q.cluster AS cb, p.person_id AS pa, q.person_id AS pb, sum(g1.x * g2.x) AS sim FROM m p JOIN m q ON p.cluster < q.cluster AND p.person_id <> q.person_id JOIN g g1 ON g1.cluster = p.cluster JOIN g g2 ON g2.cluster = q.cluster AND g1.i = g2.i WHERE p.mapped AND q.mapped GROUP BY 1, 2, 3, 4),
w AS (SELECT least(pa, pb) AS a, greatest(pa, pb) AS b, sim, ca, cb FROM s WHERE sim > 0.02) SELECT a, b, round(sim, 6) AS similarity FROM w QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY ca, cb) = 1"""


@query(INTER)
def op_merge_inter(t):
    none = t.spark.createDataFrame([], "a long, b long")
    got = crossref.merges_between(mapping(t), crossref.centroids(t.cluster_of, vectors(t), DIM), none, 0.02)
    return got.withColumn("similarity", F.round("similarity", 6))


@query(INTER.replace("SELECT a, b, round(sim, 6) AS similarity FROM w QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY ca, cb) = 1", "SELECT a, b, count(*) AS n FROM w GROUP BY 1, 2"))
def join_cluster_pairs(t):
    m, c = mapping(t).filter("mapped").select("cluster", "person_id"), crossref.centroids(t.cluster_of, vectors(t), DIM)
    return crossref.close_clusters(m, c, 0.02).groupBy("a", "b").agg(F.count("*").alias("n"))


IOU = """p AS (SELECT f.space, f.photo_id, f.face_id, s.syno_face_id, s.person_id, s.line AS position, f.x / d.width AS a1, f.y / d.height AS b1, (f.x + f.w) / d.width AS a2, (f.y + f.h) / d.height AS b2, s.x1, s.y1, s.x2, s.y2 FROM faces f JOIN frames d ON d.space = f.space AND d.id = f.photo_id AND d.width > 0 AND d.height > 0 JOIN syno_faces s ON s.space = f.space AND s.photo_id = f.photo_id),
i AS (SELECT *, greatest(least(a2, x2) - greatest(a1, x1), 0) * greatest(least(b2, y2) - greatest(b1, y1), 0) AS inter, (a2 - a1) * (b2 - b1) + (x2 - x1) * (y2 - y1) AS s FROM p), o AS (SELECT face_id, syno_face_id, inter / (s - inter) AS iou FROM i WHERE inter / (s - inter) >= 0.3)"""


@query(f"WITH {IOU} SELECT face_id, syno_face_id, round(iou, 6) AS iou FROM o")
def join_theta_iou(t):
    return crossref.iou_pairs(t.faces, t.syno_faces, t.frames).select("face_id", "syno_face_id", F.round("iou", 6).alias("iou"))


def fold(rows: str, key: str, order: str, item: str, clash: str) -> str:
    """SQL that walks each key's items in order and keeps those that clash with none kept before."""
    return f"""n AS (SELECT {key}, {item} AS b, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS r FROM {rows}),
g AS (SELECT {key}, r, [b] AS kept FROM n WHERE r = 1 UNION ALL SELECT n.{key}, n.r, CASE WHEN len(list_filter(g.kept, lambda k: {clash})) > 0 THEN g.kept ELSE list_append(g.kept, n.b) END FROM g JOIN n ON n.{key} = g.{key} AND n.r = g.r + 1),
e AS (SELECT {key}, unnest(kept) AS b FROM (SELECT {key}, max_by(kept, r) AS kept FROM g GROUP BY {key}))"""


GREEDY = IOU.replace("SELECT face_id, syno_face_id, inter / (s - inter) AS iou FROM i", "SELECT photo_id, face_id, position, syno_face_id, person_id, space, inter / (s - inter) AS iou FROM i") + ", " + fold("o", "photo_id", "iou DESC, face_id DESC, position DESC, syno_face_id DESC, person_id DESC", "struct_pack(f := face_id, p := position, s := syno_face_id, person := person_id, iou := iou, space := space)", "k.f = n.b.f OR k.p = n.b.p")


@query(f"WITH RECURSIVE {GREEDY} SELECT b.f AS face_id, b.s AS syno_face_id, round(b.iou, 6) AS iou FROM e")
def join_greedy_match(t):
    return crossref.greedy_match(crossref.iou_pairs(t.faces, t.syno_faces, t.frames)).select("face_id", "syno_face_id", F.round("iou", 6).alias("iou"))


@query(f"""WITH RECURSIVE {GREEDY.replace("JOIN syno_faces s ON", "JOIN (SELECT * FROM syno_faces WHERE photo_id % 3 <> 0) s ON")},
a AS (SELECT f.space, f.photo_id, min(f.face_id) AS face_id FROM faces f JOIN frames d ON d.space = f.space AND d.id = f.photo_id GROUP BY 1, 2 HAVING count(*) = 1), t AS (SELECT space, photo_id, min(person_id) AS person_id FROM person_photos GROUP BY 1, 2 HAVING count(*) = 1)
SELECT b.f AS face_id, b.space AS space, b.person AS person_id, b.s AS syno_face_id FROM e UNION ALL SELECT a.face_id, a.space, t.person_id, NULL FROM a JOIN t ON a.space = t.space AND a.photo_id = t.photo_id WHERE a.photo_id % 3 = 0 OR a.photo_id NOT IN (SELECT photo_id FROM syno_faces)""")
def op_label_faces(t):
    return crossref.label_faces(t.faces, t.syno_faces.filter("photo_id % 3 <> 0"), t.frames, t.person_photos)


NMS = fold("faces", "photo_id", "det_score DESC, face_id, x, y, w, h", "struct_pack(f := face_id, x := x, y := y, w := w, h := h, s := det_score)", "greatest(least(k.x + k.w, n.b.x + n.b.w) - greatest(k.x, n.b.x), 0) * greatest(least(k.y + k.h, n.b.y + n.b.h) - greatest(k.y, n.b.y), 0) / (k.w * k.h + n.b.w * n.b.h - greatest(least(k.x + k.w, n.b.x + n.b.w) - greatest(k.x, n.b.x), 0) * greatest(least(k.y + k.h, n.b.y + n.b.h) - greatest(k.y, n.b.y), 0)) > 0.45")


@query(f"WITH RECURSIVE {NMS} SELECT photo_id, b.f AS face_id, b.x AS x, b.y AS y, b.w AS w, b.h AS h, b.s AS det_score FROM e")
def op_nms(t):
    return crossref.nms(t.faces.select("photo_id", "face_id", "x", "y", "w", "h", "det_score"), ["photo_id"])


def union_sql(least: int) -> str:
    """d: fused detections. The secondary boxes of a photo are walked by falling score; each takes the first primary on its list that is free."""
    box = "x, y, w, h"
    inter = "greatest(least(p.x + p.w, n.x + n.w) - greatest(p.x, n.x), 0) * greatest(least(p.y + p.h, n.y + n.h) - greatest(p.y, n.y), 0)"
    return f"""n AS (SELECT space, photo_id, face_id, {box}, det_score, row_number() OVER (PARTITION BY space, photo_id ORDER BY det_score DESC, face_id, {box}) AS r FROM faces WHERE detector = 'yolo'),
o AS (SELECT n.space, n.photo_id, n.r, p.face_id AS p, max({inter} / (p.w * p.h + n.w * n.h - {inter})) AS iou FROM n JOIN faces p ON p.space = n.space AND p.photo_id = n.photo_id AND p.detector = 'scrfd' GROUP BY 1, 2, 3, 4),
c AS (SELECT space, photo_id, r, list(p ORDER BY iou DESC, p) AS c FROM o WHERE iou >= 0.5 GROUP BY 1, 2, 3), l AS (SELECT n.*, coalesce(c.c, []::BIGINT[]) AS c FROM n LEFT JOIN c ON c.space = n.space AND c.photo_id = n.photo_id AND c.r = n.r),
g AS (SELECT space, photo_id, 0::BIGINT AS r, []::BIGINT[] AS taken, NULL::BIGINT AS pick FROM n GROUP BY 1, 2 UNION ALL SELECT space, photo_id, r, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, pick
FROM (SELECT l.space, l.photo_id, l.r, g.taken, list_filter(l.c, lambda x: NOT list_contains(g.taken, x))[1] AS pick FROM g JOIN l ON l.space = g.space AND l.photo_id = g.photo_id AND l.r = g.r + 1)),
k AS (SELECT n.*, g.pick FROM n JOIN g ON g.space = n.space AND g.photo_id = n.photo_id AND g.r = n.r),
d AS (SELECT p.space, p.photo_id, p.face_id, CASE WHEN k.pick IS NULL THEN 'scrfd' ELSE 'merged' END AS detector, p.det_score, k.det_score AS det_score_secondary FROM faces p LEFT JOIN k ON k.space = p.space AND k.photo_id = p.photo_id AND k.pick = p.face_id WHERE p.detector = 'scrfd' AND least(p.w, p.h) >= {least}
UNION ALL SELECT space, photo_id, face_id, 'yolo', det_score, NULL FROM k WHERE pick IS NULL AND least(w, h) >= {least})"""


@query(f"WITH RECURSIVE {union_sql(100)} SELECT * FROM d")
def op_detect_union(t):
    return crossref.detect_union(t.faces.select("space", "photo_id", "face_id", "detector", "x", "y", "w", "h", "det_score"), ["space", "photo_id"], min_face_px=100)


@query(f"WITH RECURSIVE {union_sql(20)} SELECT * FROM d WHERE detector = 'merged'")
def join_union_detect(t):
    return crossref.detect_union(t.faces.select("space", "photo_id", "face_id", "detector", "x", "y", "w", "h", "det_score"), ["space", "photo_id"]).filter("detector = 'merged'")


def _body(sql: str, before: str) -> str:
    """The table expressions of sql up to that point, over the clusters found."""
    return sql[sql.index("WITH ") + 5 : sql.index(before)].replace("cluster_of", "found").replace("labeled >= 3 AND n / labeled >= 0.6", "labeled >= 2 AND n / labeled >= 0.3")


CROSSREF = f"""WITH found AS (WITH RECURSIVE {WHISPERS} SELECT id AS face_id, cluster FROM l JOIN f USING (label)), {_body(ASSIGN, chr(10) + "SELECT face_id, face_space")}, {_body("WITH " + REASSIGN[REASSIGN.index("d AS (SELECT k.face_id") :], chr(10) + "SELECT d.face_id").replace("m.labeled - 1 >= 3", "m.labeled - 1 >= 1")}
SELECT CASE WHEN conf >= 0.1 THEN 'assign' ELSE 'low_confidence' END AS kind, count(*) AS n FROM s GROUP BY 1
UNION ALL SELECT 'reassign', count(*) FROM d JOIN c2 USING (face_id) WHERE conf >= 0.1
UNION ALL SELECT 'new_person', count(*) FROM (SELECT cluster FROM found LEFT JOIN k ON k.face_id = found.face_id GROUP BY 1 HAVING count(k.face_id) = 0 AND count(*) >= 2)
UNION ALL SELECT 'merge', count(*) FROM (SELECT DISTINCT a.person_id, b.person_id FROM c a JOIN c b ON a.cluster = b.cluster AND a.person_id < b.person_id WHERE a.n / a.labeled >= 0.3 AND b.n / b.labeled >= 0.3)"""


@query(CROSSREF)
def op_cluster_crossref(t):
    """The whole chain: neighbours, graph, label propagation, votes, mapping, and the proposals of each kind."""
    from .storage import written

    members = written(graph.relabel(whispers.chinese_whispers(ids(t), edges(t))).select(F.col("id").alias("face_id"), "cluster"), "members")
    counted = written(crossref.votes(members, truth(t)), "votes")
    mapped = crossref.map_clusters(counted, 2, 0.3)
    parts = {
        "assign": crossref.assigns(members, truth(t), mapped, vectors(t), t.face_meta, tags(t), DIM, 0.1).groupBy("kind").agg(F.count("*").alias("n")),
        "reassign": crossref.reassigns(members, truth(t), mapped, vectors(t), t.face_meta, DIM, 1, 0.1).agg(F.lit("reassign").alias("kind"), F.count("*").alias("n")),
        "new_person": crossref.new_persons(members, truth(t), 2).agg(F.lit("new_person").alias("kind"), F.count_distinct("cluster").alias("n")),
        "merge": crossref.merges_within(counted).agg(F.lit("merge").alias("kind"), F.count("*").alias("n")),
    }
    out = parts["assign"]
    for k in ("reassign", "new_person", "merge"):
        out = out.unionByName(parts[k])
    return out


# ---- quality -------------------------------------------------------------------------------

ITEMS = "x AS (SELECT m.cluster_id AS cluster, v.person_id FROM members m JOIN votes v ON v.face_id = m.face_id)"


def items(t: Tables) -> DataFrame:
    return t.members.join(t.votes, "face_id").select(F.col("cluster_id").alias("cluster"), "person_id")


@query(f"""WITH {ITEMS}, n AS (SELECT cluster, person_id, count(*) AS n FROM x GROUP BY 1, 2), c AS (SELECT cluster, sum(n) AS n FROM n GROUP BY 1), p AS (SELECT person_id, sum(n) AS n FROM n GROUP BY 1),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS tp, (SELECT sum(n * (n - 1) / 2) FROM c) AS pc, (SELECT sum(n * (n - 1) / 2) FROM p) AS pp), r AS (SELECT tp / pc AS pr, tp / pp AS re FROM s)
SELECT round(pr, 6) AS pairwise_precision, round(re, 6) AS pairwise_recall, round(2 * pr * re / (pr + re), 6) AS pairwise_f1 FROM r""")
def agg_metric_pairs(t):
    m = crossref.cluster_metrics(items(t))
    return m.select(*(F.round(c, 6).alias(c) for c in ("pairwise_precision", "pairwise_recall", "pairwise_f1")))


@query(f"""WITH {ITEMS}, n AS (SELECT cluster, person_id, count(*) AS n FROM x GROUP BY 1, 2), w AS (SELECT n, sum(n) OVER (PARTITION BY cluster) AS c, sum(n) OVER (PARTITION BY person_id) AS p FROM n), r AS (SELECT sum(n * n / c) / sum(n) AS pr, sum(n * n / p) / sum(n) AS re FROM w)
SELECT round(pr, 6) AS bcubed_precision, round(re, 6) AS bcubed_recall, round(2 * pr * re / (pr + re), 6) AS bcubed_f1 FROM r""")
def agg_metric_bcubed(t):
    m = crossref.cluster_metrics(items(t))
    return m.select(*(F.round(c, 6).alias(c) for c in ("bcubed_precision", "bcubed_recall", "bcubed_f1")))


MASK = f"{LABELS}, z AS (SELECT face_id, space, person_id, count(*) OVER (PARTITION BY space, person_id) AS n, row_number() OVER (PARTITION BY space, person_id ORDER BY md5('42:' || CAST(face_id AS VARCHAR)), face_id) AS r FROM k), h AS (SELECT face_id, space, person_id FROM z WHERE n >= 3 AND r <= least(round_even(0.2 * n, 0), n - 1))"


@query(f"WITH {MASK} SELECT * FROM h")
def op_stratified_mask(t):
    return crossref.stratified_mask(truth(t))


@query(f"WITH {MASK} SELECT face_id, person_id FROM k WHERE face_id NOT IN (SELECT face_id FROM h)")
def set_mask_minus(t):
    return truth(t).join(crossref.stratified_mask(truth(t)).select("face_id"), "face_id", "left_anti").select("face_id", "person_id")


RECOVERY = f"""WITH {MASK}, n AS (SELECT cluster, person_id, count(*) AS n FROM cluster_of JOIN (SELECT * FROM k WHERE face_id NOT IN (SELECT face_id FROM h)) USING (face_id) GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY cluster) AS l FROM n), m AS (SELECT cluster, person_id FROM c QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, person_id DESC) = 1 AND l >= 3 AND n / l >= 0.6)
SELECT count(*) AS masked, count(m.person_id) AS predicted, CAST(coalesce(sum(CASE WHEN m.person_id = h.person_id THEN 1 ELSE 0 END), 0) AS BIGINT) AS correct FROM h JOIN cluster_of USING (face_id) LEFT JOIN m USING (cluster)"""


def holdout(t: Tables, min_labeled: int = 3, majority: float = 0.6) -> DataFrame:
    hidden = crossref.stratified_mask(truth(t))
    seen = truth(t).join(hidden.select("face_id"), "face_id", "left_anti")
    m = crossref.map_clusters(crossref.votes(t.cluster_of, seen), min_labeled, majority).filter("mapped").select("cluster", F.col("person_id").alias("found"))
    got = hidden.join(t.cluster_of, "face_id").join(m, "cluster", "left")
    return got.agg(F.count("*").alias("masked"), F.count("found").alias("predicted"), F.count_if(F.col("found") == F.col("person_id")).alias("correct"))


@query(RECOVERY)
def agg_metric_recovery(t):
    return holdout(t)


@query(RECOVERY.replace("SELECT count(*) AS masked", "SELECT 3 AS min_labeled, count(*) AS masked"))
def op_holdout(t):
    return holdout(t).withColumn("min_labeled", F.lit(3))


def grid_sql(edges: tuple[float, ...], majorities: tuple[float, ...]) -> str:
    """Counts of each setting: components by reach for each threshold, and the clusters whose winner has the majority."""
    body = ", ".join(f"""u{i} AS (SELECT src AS x, dst AS y FROM k WHERE similarity >= {edge} AND src <> dst UNION SELECT dst, src FROM k WHERE similarity >= {edge} AND src <> dst),
r{i}(x, y) AS (SELECT x, y FROM u{i} UNION SELECT r{i}.x, u{i}.y FROM r{i} JOIN u{i} ON r{i}.y = u{i}.x), c{i} AS (SELECT x AS face_id, least(min(y), x) AS cluster FROM r{i} GROUP BY x),
v{i} AS (SELECT cluster, max(n) AS top, sum(n) AS labeled FROM (SELECT cluster, space, person_id, count(*) AS n FROM c{i} JOIN (SELECT * FROM known WHERE labeled) USING (face_id) GROUP BY 1, 2, 3) GROUP BY 1)""" for i, edge in enumerate(edges))
    rows = " UNION ALL ".join(f"SELECT {edge}::DOUBLE AS edge, {m}::DOUBLE AS majority, count(*) FILTER (labeled >= 2 AND top / labeled >= {m}) AS mapped, count(*) AS voted FROM v{i}" for i, edge in enumerate(edges) for m in majorities)
    return f"WITH RECURSIVE {KNN}, {body} {rows}"


@query(grid_sql((0.3, 0.35), (0.3, 0.6)))
def op_grid(t):
    """Hold-out counts for each edge threshold and majority; neighbours are computed once."""
    from .storage import written

    shared = written(near(t), "knn")
    out = None
    for edge in (0.3, 0.35):
        parts = graph.components(graph.threshold_edges(shared, edge)).select(F.col("id").alias("face_id"), F.col("component").alias("cluster"))
        for majority in (0.3, 0.6):
            m = crossref.map_clusters(crossref.votes(parts, truth(t)), 2, majority)
            row = m.agg(F.lit(edge).alias("edge"), F.lit(majority).alias("majority"), F.count_if("mapped").alias("mapped"), F.count("*").alias("voted"))
            out = row if out is None else out.unionByName(row)
    return out


# ---- sets ----------------------------------------------------------------------------------


@query("SELECT item_id, status, CAST(unnest(CASE kind WHEN 'new_person' THEN [item_id * 8 + 1, item_id * 8 + 2] WHEN 'merge' THEN [item_id * 8 + 1, item_id * 8 + 3, 4] ELSE [item_id * 8 + 1] END) AS BIGINT) AS face_id FROM queue WHERE kind NOT IN ('merge_named', 'restore_disagreement')")
def set_payload_faces(t):
    return review.referenced_faces(t.queue)


ORPHAN = "r AS (SELECT item_id, status, CAST(unnest(CASE kind WHEN 'new_person' THEN [item_id * 8 + 1, item_id * 8 + 2] WHEN 'merge' THEN [item_id * 8 + 1, item_id * 8 + 3, 4] ELSE [item_id * 8 + 1] END) AS BIGINT) AS face_id FROM queue WHERE kind NOT IN ('merge_named', 'restore_disagreement')), g AS " + STATE.format(ids="(SELECT DISTINCT face_id FROM r)") + ", h AS (SELECT item_id, status FROM r JOIN g USING (face_id) GROUP BY 1, 2 HAVING bool_and(state = 'lost'))"


def orphaned(t: Tables) -> DataFrame:
    refs = review.referenced_faces(t.queue).select("face_id").distinct()
    return review.orphans(t.queue, library.face_state(refs, t.faces, t.frames))


@query(f"WITH {ORPHAN} SELECT * FROM h")
def set_orphans(t):
    return orphaned(t)


@query(f"WITH {ORPHAN} SELECT status, count(*) AS n, status IN ('pending', 'rejected') AS prunable FROM h GROUP BY 1")
def agg_orphan_counts(t):
    return review.counts(orphaned(t), "status").withColumn("prunable", F.col("status").isin("pending", "rejected"))


EXISTING = """q AS (SELECT *, CASE WHEN json_valid(payload_json) THEN payload_json END AS j FROM queue WHERE status IN ('pending', 'approved', 'applied', 'hidden')), y AS (
SELECT DISTINCT 'assign' AS shape, json_extract_string(j, '$.face_id') || ':' || unnest([json_extract_string(j, '$.person_id'), json_extract_string(j, '$.original_person_id')]) AS key FROM q WHERE kind IN ('assign', 'low_confidence')
UNION SELECT 'reassign', json_extract_string(j, '$.face_id') || ':' || json_extract_string(j, '$.person_id') FROM q WHERE kind = 'reassign'
UNION SELECT 'merge', s || ':' || CAST(least(a, b) AS VARCHAR) || ':' || s || ':' || CAST(greatest(a, b) AS VARCHAR) FROM (SELECT json_extract_string(j, '$.person_a.space') AS s, CAST(json_extract_string(j, '$.person_a.person_id') AS BIGINT) AS a, CAST(json_extract_string(j, '$.person_b.person_id') AS BIGINT) AS b FROM q WHERE kind IN ('merge', 'merge_named'))
UNION SELECT 'new_person', CAST(item_id * 8 + 1 AS VARCHAR) || ':' || CAST(item_id * 8 + 2 AS VARCHAR) FROM q WHERE kind = 'new_person'), z AS (SELECT * FROM y WHERE key IS NOT NULL)"""


@query(f"WITH {EXISTING} SELECT shape, key FROM z")
def set_existing_ids(t):
    return review.existing_identities(t.queue)


@query(f"WITH {EXISTING}, n AS (SELECT 'assign' AS shape, CAST(item_id * 8 + 1 AS VARCHAR) || ':' || CAST(run_id AS VARCHAR) AS key, item_id FROM queue UNION ALL SELECT 'assign', CAST(o_orderkey * 8 + 1 AS VARCHAR) || ':' || CAST(o_custkey AS VARCHAR), o_orderkey FROM orders), f AS (SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.shape = n.shape AND z.key = n.key)) SELECT shape, key, item_id FROM f QUALIFY row_number() OVER (PARTITION BY shape, key ORDER BY item_id) = 1")
def set_new_minus_seen(t):
    key = lambda a, b: F.concat_ws(":", F.col(a) * 8 + 1, b)
    new = t.queue.select(F.lit("assign").alias("shape"), key("item_id", "run_id").alias("key"), "item_id")
    new = new.unionByName(t.orders.select(F.lit("assign").alias("shape"), key("o_orderkey", "o_custkey").alias("key"), F.col("o_orderkey").alias("item_id")))
    return review.fresh(new, review.existing_identities(t.queue), "item_id").select("shape", "key", "item_id")


@query("SELECT q.item_id, m.face_id FROM queue q JOIN members m ON m.cluster_id = 'src' || CAST(q.item_id % 40 AS VARCHAR) WHERE q.kind = 'new_person' UNION ALL SELECT item_id, CAST(unnest([item_id * 8 + 1, item_id * 8 + 2]) AS BIGINT) FROM queue q WHERE kind = 'new_person' AND item_id % 40 >= 20")
def set_cluster_expand(t):
    q = t.queue.filter("kind = 'new_person'").select("item_id", "status", "payload_json", F.concat(F.lit("src"), (F.col("item_id") % 40).cast("string")).alias("cluster_id"))
    full = q.join(t.members.select("cluster_id", "face_id"), "cluster_id").select("item_id", "face_id")
    rest = review.referenced_faces(q.join(t.members.select("cluster_id"), "cluster_id", "left_anti")).select("item_id", "face_id")
    return full.unionByName(rest)


@query("SELECT item_id, coalesce(nullif(json_extract_string(payload_json, '$.person_a.name'), ''), json_extract_string(payload_json, '$.person_a.person_id')) AS a, coalesce(nullif(json_extract_string(payload_json, '$.person_b.name'), ''), json_extract_string(payload_json, '$.person_b.person_id')) AS b FROM queue WHERE kind = 'merge_named' AND status = 'pending'")
def named_merge_pairs(t):
    label = lambda s: F.coalesce(F.nullif(review.json_at(f"{s}.name"), F.lit("")), review.json_at(f"{s}.person_id"))
    return library.dynamic(t.queue, kind="merge_named", status="pending").select("item_id", label("person_a").alias("a"), label("person_b").alias("b"))


# ---- state machines ------------------------------------------------------------------------


@query("SELECT coalesce(p.space, i.space) AS space, coalesce(p.id, i.id) AS id, CASE WHEN i.id IS NULL THEN p.filename ELSE i.filename END AS filename, CASE WHEN i.id IS NULL THEN p.cache_key ELSE i.cache_key END AS cache_key, CASE WHEN i.id IS NULL THEN p.deleted ELSE CAST(0 AS BIGINT) END AS deleted, p.sha256, p.hash_cache_key FROM photos p FULL JOIN incoming i ON p.space = i.space AND p.id = i.id")
def mut_upsert_items(t):
    got = library.upsert(t.photos, t.incoming, ["space", "id"], ["filename", "filesize", "taken", "type", "cache_key", "width", "height"], deleted=F.lit(0).cast("long"))
    return got.select("space", "id", "filename", "cache_key", "deleted", "sha256", "hash_cache_key")


NEW_PERSONS = "n AS (SELECT space, id + 100 AS id, 'renamed' AS name, item_count, persons.show AS show FROM persons)"


@query(f"WITH {NEW_PERSONS} SELECT coalesce(p.space, n.space) AS space, coalesce(p.id, n.id) AS id, CASE WHEN n.id IS NULL THEN p.name ELSE n.name END AS name, CASE WHEN n.id IS NULL THEN p.show ELSE n.show END AS shown, CASE WHEN n.id IS NULL THEN p.deleted ELSE CAST(0 AS BIGINT) END AS deleted FROM persons p FULL JOIN n ON p.space = n.space AND p.id = n.id")
def mut_upsert_persons(t):
    new = t.persons.select("space", (F.col("id") + 100).alias("id"), F.lit("renamed").alias("name"), "item_count", "show")
    return library.upsert(t.persons, new, ["space", "id"], ["name", "item_count", "show"], deleted=F.lit(0).cast("long")).select("space", "id", "name", F.col("show").alias("shown"), "deleted")


TAGS = "n AS (SELECT space, person_id + 1 AS person_id, photo_id FROM person_photos WHERE photo_id % 3 = 0)"


@query(f"WITH {TAGS} SELECT space, person_id, photo_id FROM person_photos WHERE (space, photo_id) NOT IN (SELECT (space, photo_id) FROM n) UNION ALL SELECT DISTINCT * FROM n")
def mut_replace_tags(t):
    new = t.person_photos.filter("photo_id % 3 = 0").withColumn("person_id", F.col("person_id") + 1)
    return library.replace_groups(t.person_photos, new, ["space", "photo_id"])


@query("WITH n AS (SELECT space, syno_face_id + 5 AS syno_face_id, photo_id FROM syno_faces WHERE photo_id > 500 AND photo_id % 2 = 0) SELECT space, syno_face_id, photo_id FROM syno_faces WHERE NOT (photo_id > 500 AND photo_id % 2 = 0) UNION ALL SELECT DISTINCT * FROM n")
def mut_sync_faces(t):
    """Faces of the photos beyond the cursor are replaced; those before it wait for the next pass."""
    old = t.syno_faces.select("space", "syno_face_id", "photo_id")
    new = old.filter("photo_id > 500 AND photo_id % 2 = 0").withColumn("syno_face_id", F.col("syno_face_id") + 5)
    return library.replace_groups(old, new, ["space", "photo_id"])


@query("SELECT p.space, p.id, g.pick AS similar_top_pick FROM photos p LEFT JOIN (SELECT space, id AS pick, unnest([id, id + 20, id + 40]) AS member FROM photos WHERE id % 60 = 0) g ON g.space = p.space AND g.member = p.id")
def mut_similar(t):
    groups = t.photos.filter("id % 60 = 0").select("space", F.col("id").alias("top_pick"), F.array("id", F.col("id") + 20, F.col("id") + 40).alias("members"))
    return library.set_picks(t.photos, groups).select("space", "id", "similar_top_pick")


@query("SELECT p.space, p.id, CASE WHEN w.id IS NULL THEN sha256 ELSE 'new' END AS sha256, CASE WHEN w.id IS NULL THEN hash_cache_key ELSE cache_key END AS hash_cache_key FROM photos p LEFT JOIN (SELECT space, id FROM photos WHERE deleted = 0 AND type IN ('photo', 'live') AND (sha256 IS NULL OR hash_cache_key IS DISTINCT FROM cache_key)) w ON w.space = p.space AND w.id = p.id")
def mut_hash(t):
    new = library.hash_work(t.photos).select("space", "id", F.lit("new").alias("sha256"), F.col("cache_key").alias("hash_cache_key"))
    return library.upsert(t.photos, new, ["space", "id"], ["sha256", "hash_cache_key"]).select("space", "id", "sha256", "hash_cache_key")


@query("SELECT coalesce(l.space, p.space) AS space, coalesce(l.photo_id, p.id) AS photo_id, CASE WHEN p.id IS NULL THEN l.pipeline_version ELSE 'v3' END AS pipeline_version FROM (SELECT * FROM extract_log WHERE logged > 0) l FULL JOIN (SELECT space, id FROM photos WHERE id % 2 = 0) p ON l.space = p.space AND l.photo_id = p.id")
def mut_extract_log(t):
    log = t.extract_log.filter("logged > 0").select("space", "photo_id", "pipeline_version")
    new = t.photos.filter("id % 2 = 0").select("space", F.col("id").alias("photo_id"), F.lit("v3").alias("pipeline_version"))
    return library.upsert(log, new, ["space", "photo_id"], ["pipeline_version"])


@query("SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'hidden' ELSE status END AS status, CASE WHEN item_id % 4 < 3 THEN CAST(1800000000 AS BIGINT) ELSE decided_at END AS decided_at FROM queue")
def mut_decide(t):
    choices = t.queue.filter("item_id % 4 < 3").select("item_id", F.element_at(F.array(F.lit("approve"), F.lit("reject"), F.lit("hide")), (F.col("item_id") % 4 + 1).cast("int")).alias("choice"))
    return review.decide(t.queue, choices, 1_800_000_000).select("item_id", "status", "decided_at")


UNDO = "item_id % 2 = 0 AND (status IN ('approved', 'rejected') OR status = 'hidden' AND item_id % 4 <> 0)"


@query(f"SELECT item_id, CASE WHEN {UNDO} THEN 'pending' ELSE status END AS status, CASE WHEN {UNDO} THEN NULL ELSE decided_at END AS decided_at FROM queue")
def mut_undo(t):
    """Every fourth row says that its faces were given to a person."""
    moved = F.when(F.col("item_id") % 4 == 0, '{"size":2,"retargeted_to":{"person_id":7,"item_ids":[1]}}').otherwise(F.col("payload_json"))
    queue = t.queue.withColumn("payload_json", moved)
    return review.undo(queue, queue.filter("item_id % 2 = 0").select("item_id")).select("item_id", "status", "decided_at")


@query("SELECT item_id, CASE WHEN status = 'pending' AND kind = 'assign' AND confidence >= 0.3 THEN 'approved' ELSE status END AS status FROM queue")
def mut_bulk(t):
    return review.bulk_approve(t.queue, "assign", 0.3, 1_800_000_000).select("item_id", "status")


@query("""WITH q AS (SELECT * FROM queue WHERE item_id % 3 = 0 AND status NOT IN ('applied', 'hidden')), u AS (SELECT face_id, space, photo_id, min(x) AS x FROM faces GROUP BY 1, 2, 3), m AS (SELECT photo_id % 5 AS run_id, * FROM u),
s AS (SELECT DISTINCT q.item_id, m.photo_id FROM q JOIN m ON m.face_id = item_id * 8 + 1 AND m.run_id = q.run_id WHERE kind = 'new_person'), c AS (SELECT s.item_id, m.face_id FROM s JOIN m ON m.photo_id = s.photo_id UNION ALL SELECT item_id, unnest([item_id * 8 + 1, item_id * 8 + 2]) FROM q WHERE kind = 'new_person' AND item_id NOT IN (SELECT item_id FROM s)),
e AS (SELECT c.item_id AS source, f.face_id, round(f.x / d.width, 6) AS x1, (SELECT max(item_id) FROM queue) + row_number() OVER (ORDER BY c.item_id, f.face_id) AS item_id FROM c JOIN u f ON f.face_id = c.face_id JOIN frames d ON d.space = f.space AND d.id = f.photo_id WHERE f.space = 'personal' AND d.width > 0 AND d.height > 0)
SELECT item_id, kind, 'approved' AS status, item_id * 8 + 1 AS face_id, item_id % 50 AS person_id, CAST(json_extract_string(payload_json, '$.person_id') AS BIGINT) AS original_person_id, NULL AS source_item_id, NULL AS x1, NULL AS made, 'Name' AS person_name FROM q WHERE kind IN ('assign', 'low_confidence')
UNION ALL SELECT item_id, 'new_person', 'hidden', NULL, item_id % 50, NULL, NULL, NULL, (SELECT count(*) FROM e WHERE e.source = q.item_id), 'Name' FROM q WHERE kind = 'new_person' UNION ALL SELECT item_id, 'assign', 'approved', face_id, source % 50, NULL, source, x1, NULL, 'Name' FROM e""")
def mut_retarget(t):
    """Every third item goes to a person: face rows change, clusters of new persons become a row for each face."""
    targets = t.queue.filter("item_id % 3 = 0").select("item_id", F.lit("personal").alias("space"), (F.col("item_id") % 50).alias("person_id"), F.lit("Name").alias("name"))
    faces = t.faces.groupBy("face_id", "space", "photo_id").agg(*(F.min(c).alias(c) for c in "xywh"))  # the stand-in repeats ids
    members = faces.select((F.col("photo_id") % 5).alias("run_id"), F.col("photo_id").alias("cluster_id"), "face_id")
    got = review.retarget(t.queue, targets, members, faces, t.frames, 1_800_000_000)
    at = review.json_at
    person = F.coalesce(at("person_id", "long"), at("retargeted_to.person_id", "long")).alias("person_id")
    made = F.size(F.from_json(at("retargeted_to.item_ids"), "array<bigint>"))
    return got.select("item_id", "kind", "status", at("face_id", "long").alias("face_id"), person, at("original_person_id", "long").alias("original_person_id"), at("source_item_id", "long").alias("source_item_id"), F.round(at("bbox_normalized[0]", "double"), 6).alias("x1"), F.when(made >= 0, made).cast("long").alias("made"), F.coalesce(at("person_name"), at("retargeted_to.person_name")).alias("person_name"))


@query("SELECT id, CASE WHEN review_item_id % 2 = 0 THEN NULL ELSE review_item_id END AS review_item_id FROM audit_log")
def mut_delete_items(t):
    gone = t.audit_log.filter("review_item_id % 2 = 0").select(F.col("review_item_id").alias("item_id")).distinct()
    return review.delete_items(t.queue, t.audit_log, gone)[1].select("id", "review_item_id")


@query("SELECT item_id, status FROM queue WHERE status <> 'pending'")
def mut_clear_queue(t):
    return t.queue.filter("status <> 'pending'").select("item_id", "status")


@query("SELECT item_id, CASE WHEN status IN ('approved', 'failed') THEN 'pending' ELSE status END AS status FROM queue")
def mut_clear_applies(t):
    return t.queue.select("item_id", F.when(F.col("status").isin("approved", "failed"), "pending").otherwise(F.col("status")).alias("status"))


APPLY = """s AS (SELECT run_id, item_id, CASE WHEN kind = 'restore_disagreement' THEN 'skipped' WHEN item_id * 7919 % 10 < 6 THEN 'failed' ELSE 'applied' END AS outcome FROM queue), i AS (SELECT *, sum(CASE WHEN outcome = 'applied' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY item_id) AS island FROM s),
k AS (SELECT *, sum(CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, island ORDER BY item_id) AS streak FROM i), b AS (SELECT *, coalesce(bool_or(streak >= 5) OVER (PARTITION BY run_id ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS tripped FROM k)"""


def attempts(t: Tables) -> DataFrame:
    fails = F.col("item_id") * 7919 % 10 < 6
    return t.queue.select("run_id", "item_id", F.when(F.col("kind") == "restore_disagreement", "skipped").when(fails, "failed").otherwise("applied").alias("outcome"))


@query(f"WITH {APPLY} SELECT run_id, item_id, outcome FROM b WHERE NOT tripped")
def win_breaker(t):
    return review.breaker(attempts(t), ["run_id"], "item_id")


@query(f"WITH {APPLY} SELECT run_id, outcome, count(*) AS n FROM b WHERE NOT tripped GROUP BY 1, 2")
def mut_apply(t):
    return review.counts(review.breaker(attempts(t), ["run_id"], "item_id"), "run_id", "outcome")


PERSONPAIR = "p AS (SELECT a.id AS a, b.id AS b, trim(coalesce(a.name, '')) <> '' AS an, trim(coalesce(b.name, '')) <> '' AS bn, coalesce(a.item_count, 0) AS ac, coalesce(b.item_count, 0) AS bc FROM persons a JOIN persons b ON b.id = a.id + 1)"


@query(f"WITH {PERSONPAIR} SELECT a, b, CASE WHEN an > bn OR (an = bn AND ac >= bc) THEN a ELSE b END AS target, CASE WHEN an > bn OR (an = bn AND ac >= bc) THEN b ELSE a END AS source FROM p")
def fn_merge_order(t):
    side = lambda s, shift: t.persons.select((F.col("id") - shift).alias("k"), F.col("id").alias(s), F.col("name").alias(f"{s}_name"), F.col("item_count").alias(f"{s}_count"))
    return review.merge_direction(side("a", 0).join(side("b", 1), "k"))


@query("SELECT id, (row_number() OVER (ORDER BY id) - 1) // 100 AS batch FROM photos WHERE deleted = 0 AND id % 3 = 0")
def mut_dedupe_delete(t):
    """Batches of 100 for deletion, in order of the ids."""
    return consecutive(library.live(t.photos).filter("id % 3 = 0").select("id"), ["id"], "at").select("id", F.floor(F.col("at") / 100).cast("long").alias("batch"))


@query("SELECT item_id, CASE WHEN kind = 'merge' AND status = 'pending' AND trim(json_extract_string(payload_json, '$.person_b.name')) <> '' THEN 'merge_named' ELSE kind END AS kind FROM queue")
def mut_migrate_5(t):
    return review.split_named(t.queue).select("item_id", "kind")


@query("SELECT id, CASE WHEN deleted = 0 AND trim(coalesce(name, '')) = '' AND id % 2 = 0 THEN 'N' ELSE name END AS name, CASE WHEN id % 10 = 3 THEN CAST(0 AS BIGINT) ELSE persons.show END AS shown FROM persons")
def mut_quickmerge(t):
    free = (F.col("deleted") == 0) & S.blank(F.col("name")) & (F.col("id") % 2 == 0)
    return t.persons.select("id", F.when(free, "N").otherwise(F.col("name")).alias("name"), F.when(F.col("id") % 10 == 3, 0).otherwise(F.col("show")).cast("long").alias("shown"))


@query("SELECT space, id, deleted FROM photos WHERE space <> 'de'")
def mut_reset(t):
    return t.photos.filter("space <> 'de'").select("space", "id", "deleted")


@query("SELECT face_id, CASE WHEN crop_path IS NULL THEN 'redraw' WHEN quality IS NULL THEN 'backfill' ELSE 'skip' END AS plan FROM faces")
def op_regen_plan(t):
    return t.faces.select("face_id", F.when(F.col("crop_path").isNull(), "redraw").when(F.col("quality").isNull(), "backfill").otherwise("skip").alias("plan"))


@query("SELECT job, kind, dry_run, CASE WHEN dry_run THEN 'none' WHEN job IN ('reset', 'dedupe') THEN 'phrase' WHEN job = 'apply' AND kind = 'merge_named' THEN 'phrase' WHEN job = 'apply' AND kind IN ('merge', 'reassign') THEN 'flag' WHEN job = 'apply' THEN 'confirm' ELSE 'none' END AS gate FROM (SELECT CASE item_id % 4 WHEN 0 THEN 'apply' WHEN 1 THEN 'reset' WHEN 2 THEN 'dedupe' ELSE 'sync' END AS job, kind, item_id % 3 = 0 AS dry_run FROM queue)")
def consent_gate(t):
    job = F.element_at(F.array(*map(F.lit, ("apply", "reset", "dedupe", "sync"))), (F.col("item_id") % 4 + 1).cast("int"))
    return review.consent_gate(t.queue.select(job.alias("job"), "kind", (F.col("item_id") % 3 == 0).alias("dry_run")))
