"""Queries over sources, sinks, models and runs."""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import cells, crossref, detectors, extract, graph, review, runs
from ..sources import files, readers, sqlite
from .analytics import CORE, DIM, NMS, PIXELS, gray_pictures, mapping, models, near, tags, truth, vectors
from .registry import SQL, query
from .standins import Tables
from .storage import shared_dir


def folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/kithmark/{name}-{uuid4().hex}"


@query("SELECT doc_id AS id, sha256(concat('token', CAST(doc_id AS VARCHAR))) AS token_hash, substr(concat('key_', sha256(text)), 1, 8) AS prefix FROM documents")
def fn_token_hash(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), S.token_hash(F.concat(F.lit("token"), F.col("doc_id").cast("string"))).alias("token_hash"), F.substring(F.concat(F.lit("key_"), F.sha2("text", 256)), 1, 8).alias("prefix"))


@query("SELECT doc_id AS id, substr(sha256(concat(source, lang)), 1, 12) AS version FROM documents")
def fn_version_hash(t):
    return t.documents.select(F.col("doc_id").alias("id"), S.version_hash(F.col("source"), F.col("lang")).alias("version"))


@query("""SELECT event_id AS id, CASE WHEN v >= 1 THEN printf('%.1f/s', v) WHEN v > 0 THEN printf('%.1f/min', v * 60) ELSE '0/s' END AS rate
FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE event_id % 977 / 20 END AS v FROM events)""")
def fn_rate(t):
    per_second = F.expr("CASE WHEN event_id % 7 = 0 THEN 0.0D ELSE event_id % 977 / 20 END")
    return t.events.select(F.col("event_id").alias("id"), S.human_rate(per_second).alias("rate"))


@query("SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'not a readable image' WHEN 1 THEN 'original is missing' WHEN 2 THEN 'image file is truncated' ELSE 'ValueError: odd ' || event_type END AS reason FROM events")
def fn_skip_reason(t):
    k = F.col("event_id") % 4
    kind = F.when(k == 0, "UnidentifiedImageError").when(k == 1, "FileNotFoundError").when(k == 2, "OSError").otherwise("ValueError")
    text = F.when(k == 2, "image is truncated").otherwise(F.concat(F.lit("odd "), F.col("event_type")))
    return t.events.select(F.col("event_id").alias("id"), extract.skip_reason(kind, text).alias("reason"))


@query("""SELECT item_id, '{"face_id":' || (item_id * 8 + 1) || ',"photo_id":' || item_id || ',"space":"personal"' || CASE WHEN contains(payload_json, 'original_person_id') THEN ',"original_person_id":7' ELSE '' END
  || ',"person_id":' || (item_id % 50) || ',"manual_target":true}' AS payload FROM queue WHERE kind = 'assign'""")
def fn_json_set(t):
    """Keys of the queue's own payloads: one that is there is replaced, one that isn't is added."""
    values = {"person_id": (F.col("item_id") % 50).cast("string"), "manual_target": F.lit("true")}
    return t.queue.filter("kind = 'assign'").select("item_id", review.set_keys(F.col("payload_json"), values).alias("payload"))


SIGNATURE = """substr(sha1(count(*) || ':' || coalesce(sum(CAST('0x' || substr(md5(vec_id || ':' || array_to_string(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000000.0) AS BIGINT)), ',')), 1, 13) AS BIGINT)), 0) || ':{k}:[(''a'', 1.0)]'), 1, 16)"""


def embedded(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query(f"SELECT 'whole' AS part, {SIGNATURE.format(k=10)} AS signature FROM embeddings UNION ALL SELECT 'other k', {SIGNATURE.format(k=11)} FROM embeddings UNION ALL SELECT 'odd', {SIGNATURE.format(k=10)} FROM embeddings WHERE vec_id % 2 = 1")
def fn_graph_sig(t):
    """Signatures of the vectors, whatever their order, for two numbers of neighbours, and of a part of them."""
    x, w = embedded(t), {"a": 1.0}
    found = {"whole": readers.graph_signature(x.orderBy(F.desc("id")), 10, w), "other k": readers.graph_signature(x, 11, w), "odd": readers.graph_signature(x.filter("id % 2 = 1"), 10, w)}
    return t.spark.createDataFrame(list(found.items()), "part string, signature string")


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def src_paginate(t):
    """Customers by pages of 100 until one is short; ranges of pages are read side by side."""
    t.spark.dataSource.register(readers.PagedSource)
    options = {"fetch": "kithmark.sources.readers:table_page", "table": f"{t.sf_dir}/customer.parquet", "columns": "c_custkey,c_name", "total": 120, "page_size": 100, "pages": 1}
    x = F.from_json("value", "c_custkey bigint, c_name string")
    return t.spark.read.format("paged").options(**options).load().select(x.alias("x")).select(F.col("x.c_custkey").alias("id"), F.col("x.c_name").alias("name"))


@query("SELECT id, CASE WHEN params_json = 'broken' THEN CAST(id % 9 AS VARCHAR) ELSE CAST(json_extract_string(params_json, '$.a') AS VARCHAR) END AS a, 'x' || (id % 4) AS b, 'd' AS c FROM schedules")
def src_config_layers(t):
    """A schedule's own parameters before its environment's before the defaults; what isn't JSON has none."""
    text = "map<string,string>"
    own = F.from_json("params_json", text)
    env = F.create_map(F.lit("a"), (F.col("id") % 9).cast("string"), F.lit("b"), F.concat(F.lit("x"), (F.col("id") % 4).cast("string")))
    every = files.layered_maps(own, env, F.create_map(F.lit("b"), F.lit("d"), F.lit("c"), F.lit("d")))
    return t.schedules.select("id", *(F.try_element_at(every, F.lit(k)).alias(k) for k in "abc"))


OVERRIDE = "concat('s', CAST(doc_id % 3 AS STRING), '.k.', source, '=', CASE doc_id % 5 WHEN 0 THEN '5' WHEN 1 THEN 'true' WHEN 2 THEN 'two = \"words\"' WHEN 3 THEN '{\"x\":[1,2]}' ELSE '' END)"


@query(f"""SELECT doc_id AS id, split_part(split_part(t, '=', 1), '.', 1) AS section, split_part(split_part(t, '=', 1), '.', 3) AS key, CASE doc_id % 5 WHEN 0 THEN '5' WHEN 1 THEN 'true' WHEN 2 THEN '"two = \\"words\\""' WHEN 3 THEN '{{"x":[1,2]}}' ELSE '""' END AS value FROM (SELECT doc_id, {OVERRIDE.replace("AS STRING", "AS VARCHAR")} AS t FROM documents)""")
def prj_params_override(t):
    path, value = files.override(F.expr(OVERRIDE))
    return t.documents.select(F.col("doc_id").alias("id"), F.get(path, F.lit(0)).alias("section"), F.get(path, F.lit(2)).alias("key"), value.alias("value"))


@query("SELECT c_custkey AS id, c_name AS name, c_custkey % 3 = 0 AS hidden FROM customer")
def src_persons(t):
    lines = t.customer.select(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.struct((F.col("c_custkey") % 3 != 0).alias("show")).alias("additional"))).alias("value"))
    x = F.from_json("value", "id bigint, name string, additional struct<show:boolean>")
    return lines.select(x.alias("x")).select("x.id", "x.name", (~F.col("x.additional.show")).alias("hidden"))


@query("SELECT syno_face_id, photo_id, round(x1, 6) AS x1, round(y2, 6) AS y2 FROM syno_faces")
def src_faces(t):
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    lines = t.syno_faces.select(F.to_json(F.struct("syno_face_id", "photo_id", F.struct(point("x1", "y1").alias("top_left"), point("x2", "y2").alias("bottom_right")).alias("box"))).alias("value"))
    p = "struct<x:double,y:double>"
    x = F.from_json("value", f"syno_face_id bigint, photo_id bigint, box struct<top_left:{p},bottom_right:{p}>")
    return lines.select(x.alias("x")).select("x.syno_face_id", "x.photo_id", F.round("x.box.top_left.x", 6).alias("x1"), F.round("x.box.bottom_right.y", 6).alias("y2"))


GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n, true AS same FROM {n}" for n in GIVEN))
def src_table_copy(t):
    """All given tables copied: rows of each copy, and whether its contents are the table's."""
    to = folder(t, "copy")
    readers.copy_tables(t.spark, t.sf_dir, to, GIVEN)
    out = None
    for name in GIVEN:
        given, copy = getattr(t, name), t.spark.read.parquet(f"{to}/{name}.parquet")
        row = copy.agg(F.count("*").alias("n"), readers.table_digest(copy).alias("d")).join(given.agg(readers.table_digest(given).alias("e")), F.lit(True))
        row = row.select(F.lit(name).alias("name"), "n", (F.col("d") == F.col("e")).alias("same"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey > 40 AND c_nationkey IN (1, 2, 3) AND c_mktsegment IS NOT NULL")
def src_sql(t):
    """Customers by way of SQLite files, some columns, filtered where they are."""
    to = folder(t, "sqlite")
    sqlite.write_table(t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal")), to, "customer")
    got = sqlite.read_table(t.spark, to, "customer", "c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal"], 500)
    got = got.filter((F.col("c_custkey") > 40) & F.col("c_nationkey").isin(1, 2, 3) & F.col("c_mktsegment").isNotNull())
    return got.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


@query("SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1")
def snk_snapshot(t):
    to = folder(t, "snapshot")
    files.snapshot(t.customer, to)
    return t.spark.read.parquet(to).groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))


@query("SELECT event, phase, count(*) AS n FROM job_events GROUP BY 1, 2")
def snk_events(t):
    to = folder(t, "events")
    files.append_events(t.job_events.filter("line_no % 2 = 0").select("event", "phase"), to)
    files.append_events(t.job_events.filter("line_no % 2 = 1").select("event", "phase"), to)
    return t.spark.read.schema("event string, phase string").json(to).groupBy("event", "phase").agg(F.count("*").alias("n"))


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(count(*) AS VARCHAR) AS a, NULL AS b FROM events WHERE event_type = 'click' GROUP BY 1 UNION ALL SELECT CAST(user_id AS VARCHAR), NULL, CAST(count(*) AS VARCHAR) FROM events WHERE event_type = 'view' GROUP BY 1")
def snk_csv_grid(t):
    to, by = folder(t, "grid"), lambda kind, name: t.events.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias(name))
    files.write_grid([by("click", "a"), by("view", "b")], to)
    return t.spark.read.schema("user_id string, a string, b string").csv(to, header=True)


@query("SELECT vec_id % 10 AS g, count(*) * 5 AS n, count(*) * 3 AS changed FROM embeddings GROUP BY 1")
def snk_npz_cache(t):
    """Neighbours by way of the cache, asked for twice; the second time nothing is built. Where the vectors change the old neighbours aren't given."""
    to, x = folder(t, "cache"), embedded(t)
    files.cached_graph(x, to, 5, {}, lambda: cells.neighbours(x, 5))
    again = files.cached_graph(x, to, 5, {}, lambda: t.spark.createDataFrame([], "src long"))
    other = x.withColumn("vec", F.transform("vec", lambda v: -v))
    changed = files.cached_graph(other, to, 5, {}, lambda: cells.neighbours(other, 3))
    by = lambda df, name: df.groupBy((F.col("src") % 10).alias("g")).agg(F.count("*").alias(name))
    return by(again, "n").join(by(changed, "changed"), "g")


@query()
def agg_disk_usage(t):
    to = folder(t, "usage")
    files.snapshot(t.customer, to)
    return files.disk_usage(t.spark, to)


@query("SELECT DISTINCT p_brand AS name FROM part WHERE p_brand NOT IN (SELECT DISTINCT p_brand FROM part WHERE p_size = 1 AND p_partkey % 4 = 0)")
def set_missing_models(t):
    brand = F.col("p_brand").alias("name")
    return files.missing_models(t.part.select(brand).distinct(), t.part.filter("p_size = 1 AND p_partkey % 4 = 0").select(brand).distinct())


# A bright middle before a dark rim, in windows of 8 x 8; vectors are the sums of a face's four rows. Every hundredth picture is cut short.
RIM = np.full((8, 8), -1.0)
RIM[2:6, 2:6] = 3.0
SCORER, ROWS = detectors.Scorer(RIM / 1536, 0.0, 4, (4.0, 4.0, 4.0, 4.0)), np.kron(np.eye(4), np.ones((1, 4)))
LEAST = 1 / (1 + np.exp(-2160.5 / 1536))


def pictures(t: Tables) -> DataFrame:
    pixels = gray_pictures(t)
    cut = F.when(F.col("id") % 100 == 0, F.slice("pixels", 1, 1000)).otherwise(F.col("pixels"))
    return pixels.select(F.lit("personal").alias("space"), "id", F.lit(32).cast("long").alias("width"), F.lit(32).cast("long").alias("height"), cut.alias("pixels"))


SCAN = f"""{PIXELS}, sc AS (SELECT * FROM (VALUES (0, 32, 1.0::DOUBLE), (1, 48, 1.5::DOUBLE)) s(si, size, fx)), big AS (SELECT id, si, size, fx, r, c, p FROM sc, range(48) a(r), range(48) b(c), px WHERE r < size AND c < size AND row = CAST(floor((r + 0.5) * 32 / size) AS BIGINT) AND col = CAST(floor((c + 0.5) * 32 / size) AS BIGINT) AND id % 100 <> 0),
wn AS (SELECT id, si, any_value(fx) AS fx, iy, ix, sum(p * CASE WHEN r - iy * 4 BETWEEN 2 AND 5 AND c - ix * 4 BETWEEN 2 AND 5 THEN 3 ELSE -1 END) AS s FROM big, range(11) a(iy), range(11) b(ix) WHERE iy * 4 + 8 <= size AND ix * 4 + 8 <= size AND r BETWEEN iy * 4 AND iy * 4 + 7 AND c BETWEEN ix * 4 AND ix * 4 + 7 GROUP BY id, si, iy, ix),
dets AS (SELECT id AS photo_id, row_number() OVER (PARTITION BY id ORDER BY si, iy, ix) AS face_id, ix * 4 / fx AS x, iy * 4 / fx AS y, 8 / fx AS w, 8 / fx AS h, s AS det_score FROM wn WHERE s > 2160), {NMS.replace("FROM faces", "FROM dets")},
kept AS (SELECT photo_id, b.f AS n, b.x AS x, b.y AS y, b.w AS w, 1 / (1 + exp(-b.s / 1536)) AS det_score FROM e)"""


@query(f"WITH RECURSIVE {SCAN} SELECT count(DISTINCT photo_id) + (SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0) AS photos, count(*) AS faces, (SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0) AS skipped FROM kept")
def op_extract(t):
    """Photos with faces or failures, faces with vectors, and failures of one pass."""
    found, failed = detectors.extract(pictures(t), SCORER, ROWS, [1.0, 2.0], 48, LEAST)
    rows = found.filter("vec IS NOT NULL").select("space", "photo_id", "n", F.lit(None).cast("string").alias("error")).unionByName(failed, allowMissingColumns=True)
    return extract.extract_stats(rows)


@query(f"WITH RECURSIVE {SCAN} SELECT photo_id, n, round(x, 4) AS x, round(y, 4) AS y, round(w, 4) AS w, round(det_score, 6) AS det_score FROM kept")
def op_detect(t):
    found, _ = detectors.detect(pictures(t), SCORER, [1.0, 2.0], 48, LEAST)
    return found.select("photo_id", "n", *(F.round(c, d).alias(c) for c, d in (("x", 4), ("y", 4), ("w", 4), ("det_score", 6))))


@query(f"""WITH RECURSIVE {SCAN}, cr AS (SELECT *, greatest(0, CAST(floor(x) AS BIGINT)) AS x0, greatest(0, CAST(floor(y) AS BIGINT)) AS y0, least(32, CAST(ceil(x + w) AS BIGINT)) AS x1, least(32, CAST(ceil(y + w) AS BIGINT)) AS y1 FROM kept),
v AS (SELECT photo_id, n, i, sum(p) AS v FROM cr, range(4) a(i), range(4) b(j), px WHERE px.id = photo_id AND row = y0 + CAST(floor((i + 0.5) * (y1 - y0) / 4) AS BIGINT) AND col = x0 + CAST(floor((j + 0.5) * (x1 - x0) / 4) AS BIGINT) GROUP BY ALL)
SELECT photo_id, n, round(max(CASE WHEN i = 0 THEN v END) / sqrt(sum(v * v)), 6) AS first FROM v GROUP BY ALL""")
def op_embed(t):
    found, _ = detectors.extract(pictures(t), SCORER, ROWS, [1.0, 2.0], 48, LEAST)
    return found.select("photo_id", "n", F.round(F.get("vec", F.lit(0)), 6).alias("first"))


@query("WITH p AS (SELECT a.vec_id AS face_id, 1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT face_id, round(d, 6) AS disagreement FROM p WHERE d > 1.05")
def op_restore_pass(t):
    other = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), S.doubles(F.col("embedding")).alias("b"))
    pairs = t.embeddings.select("vec_id", S.doubles(F.col("embedding")).alias("a")).join(other, "vec_id").withColumnRenamed("vec_id", "face_id")
    return extract.disagreements(pairs, 1.05).withColumn("disagreement", F.round("disagreement", 6))


@query("SELECT vec_id AS face_id, CAST(2 + vec_id % 5 AS DOUBLE) AS scale, CAST(1 + vec_id % 3 AS DOUBLE) AS shift FROM embeddings")
def fn_align(t):
    """Landmarks that are the template moved and shrunk: the transform has to undo it."""
    goal = [(30.0, 50.0), (70.0, 50.0), (50.0, 70.0), (35.0, 90.0), (65.0, 90.0)]
    scale, shift = 2.0 + F.col("vec_id") % 5, 1.0 + F.col("vec_id") % 3
    marks = F.array(*((F.lit(v) - shift) / scale for p in goal for v in p))
    got = extract.align(t.embeddings.select(F.col("vec_id").alias("face_id"), marks.alias("landmarks")), goal)
    return got.select("face_id", F.round(F.get("matrix", F.lit(0)), 4).alias("scale"), F.round(F.get("matrix", F.lit(2)), 4).alias("shift"))


@query("SELECT vec_id AS face_id, CAST(len(embedding) AS BIGINT) AS dim FROM embeddings")
def fn_fromblob(t):
    """Vectors by way of little-endian bytes, decoded in the JVM; those that don't come back as they were have dim -1."""
    @F.pandas_udf("binary")
    def blob(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x, "<f4").tobytes())

    back = t.embeddings.withColumn("blob", blob("embedding")).withColumn("back", readers.floats(F.col("blob")))
    return back.select(F.col("vec_id").alias("face_id"), F.when(F.col("back") == F.col("embedding"), F.size("back")).otherwise(-1).cast("long").alias("dim"))


NAMED = "nm AS (SELECT id AS person_id, min(name) AS name FROM persons WHERE trim(name) <> '' GROUP BY 1)"


@query(f"""WITH {NAMED}, a AS (SELECT 1 AS part, face_id AS k1, person_id AS k2, kind, 'assign' AS family, face_id || ':' || person_id AS identity, confidence FROM ({SQL["op_assign"]}) UNION ALL
SELECT 2, face_id, person_id, 'reassign', 'reassign', face_id || ':' || person_id, confidence FROM ({SQL["op_reassign"]}) UNION ALL
SELECT 3, cluster, 0, 'new_person', 'new_person', string_agg(face_id, ',' ORDER BY face_id), NULL FROM ({SQL["op_new_person"]}) GROUP BY cluster UNION ALL
SELECT 4, a, b, CASE WHEN x.name IS NOT NULL AND y.name IS NOT NULL THEN 'merge_named' ELSE 'merge' END, 'merge', a || ':' || b, NULL FROM (SELECT a, b FROM ({SQL["op_merge_intra"]}) UNION SELECT a, b FROM ({SQL["op_merge_inter"]})) LEFT JOIN nm x ON x.person_id = a LEFT JOIN nm y ON y.person_id = b),
o AS (SELECT 'assign' AS family, face_id || ':' || person_id AS identity FROM known WHERE face_id % 7 = 0)
SELECT row_number() OVER (ORDER BY part, k1, k2) AS item_id, kind, identity, confidence FROM a WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.family = a.family AND o.identity = a.identity)""")
def op_persist_run(t):
    """Review items of a run with consecutive ids, without those that an earlier run proposed: assigns, reassigns, new persons, and merges by name."""
    m, v, mapped = t.cluster_of, vectors(t), mapping(t)
    a = crossref.assigns(m, truth(t), mapped, v, t.face_meta, tags(t), DIM, 0.01).withColumn("confidence", F.round("confidence", 6))
    r = crossref.reassigns(m, truth(t), mapped, v, t.face_meta, DIM, 3, -0.01).withColumn("confidence", F.round("confidence", 6))
    within = crossref.merges_within(crossref.votes(m, truth(t)), 0.15)
    between = crossref.merges_between(mapped, crossref.centroids(m, v, DIM), within.select("a", "b"), 0.02)
    names = t.persons.select(F.col("id").alias("person_id"), "name")
    before = t.known.filter("face_id % 7 = 0").select(F.lit("assign").alias("kind"), F.concat_ws(":", F.col("face_id").cast("string"), F.col("person_id").cast("string")).alias("identity"))
    found = runs.review_items(a, r, crossref.new_persons(m, truth(t)), runs.merges(within, between), names, before)
    return found.select("item_id", "kind", "identity", "confidence")


@query(f"WITH {CORE} SELECT o.cluster, o.size, CASE WHEN mapped THEN space END AS space, CASE WHEN mapped THEN person_id END AS person_id, round(coalesce(fraction, 0), 6) AS fraction, coalesce(labeled, 0) AS labeled FROM (SELECT cluster, count(*) AS size FROM cluster_of GROUP BY 1) o LEFT JOIN m USING (cluster)")
def run_clusters(t):
    return runs.stored_clusters(t.cluster_of, mapping(t)).withColumn("fraction", F.round("fraction", 6))


@query()
def op_benchmark(t):
    """Seconds of the stages of a run over the given vectors; warm-up first."""
    stages = {"fuse": lambda: graph.fuse(models(t)), "knn": lambda: near(t), "votes": lambda: crossref.votes(t.cluster_of, truth(t))}
    rows = [(i, *extract.timed(make(), name)) for i in range(2) for name, make in stages.items()]
    from ..operators.events import stage_benchmark

    return stage_benchmark(t.spark.createDataFrame(rows, "i int, stage string, seconds double"), 1)
