"""The library's tables bound to the given ones.

Each table is a list of SQL expressions over one given table, in words that Spark and other engines
share, so that a query and the SQL it is held against start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STANDINS: dict[str, tuple[str, str]] = {
    # mirrored items; space is the language, the digest is of the text
    "photos": ("documents", """lang AS space, doc_id AS id, concat('img_', CAST(doc_id AS STRING), '.jpg') AS filename,
        CASE WHEN doc_id % 29 = 0 THEN NULL ELSE n_chars END AS filesize, 1700000000 + doc_id * 60 AS taken,
        CASE doc_id % 10 WHEN 0 THEN 'video' WHEN 1 THEN 'live' WHEN 2 THEN NULL ELSE 'photo' END AS type, source AS cache_key,
        CASE WHEN doc_id % 31 = 0 THEN NULL ELSE 100 + (doc_id % 7) * 100 END AS width, CASE WHEN doc_id % 37 = 0 THEN 0 ELSE 100 + (doc_id % 5) * 100 END AS height,
        CAST(CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS BIGINT) AS deleted, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE md5(text) END AS sha256,
        CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN 'old' ELSE NULL END AS hash_cache_key, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE doc_id - doc_id % 4 END AS similar_top_pick"""),
    # a later pass over the source: some items are gone, some changed, some new
    "incoming": ("documents", """lang AS space, doc_id + 200 AS id, concat('new_', CAST(doc_id AS STRING), '.jpg') AS filename, n_chars + 1 AS filesize, 1700000000 + doc_id AS taken,
        'photo' AS type, concat(source, 'b') AS cache_key, doc_id % 9 * 100 AS width, doc_id % 8 * 100 AS height"""),
    "extract_log": ("documents", """lang AS space, doc_id AS photo_id, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE source END AS cache_key,
        CASE WHEN doc_id % 5 = 0 THEN 'v1' ELSE 'v2' END AS pipeline_version, doc_id % 6 AS face_count, 1700000000 + doc_id AS processed_at, doc_id % 3 AS logged"""),
    "persons": ("customer", """CASE WHEN c_custkey % 2 = 0 THEN 'personal' ELSE 'shared' END AS space, c_custkey AS id,
        CASE WHEN c_custkey % 5 = 0 THEN ' ' WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey * 37 % 101 END AS item_count,
        CAST(CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 1 END AS BIGINT) AS show, CAST(CASE WHEN c_custkey % 19 = 0 THEN 1 ELSE 0 END AS BIGINT) AS deleted"""),
    "person_photos": ("lineitem", "CASE WHEN l_orderkey % 2 = 0 THEN 'personal' ELSE 'shared' END AS space, l_suppkey AS person_id, l_orderkey AS photo_id"),
    # detections; an order is a photo of 1000 x 1000
    "faces": ("lineitem", """l_orderkey * 8 + l_linenumber AS face_id, CASE WHEN l_orderkey % 2 = 0 THEN 'personal' ELSE 'shared' END AS space, l_orderkey AS photo_id,
        CASE l_returnflag WHEN 'A' THEN 'scrfd' WHEN 'R' THEN 'yolo' ELSE 'merged' END AS detector, CAST(l_partkey % 40 * 20 AS DOUBLE) AS x, CAST(l_suppkey % 40 * 20 AS DOUBLE) AS y,
        CAST(15 + l_quantity AS DOUBLE) * 4 AS w, CAST(15 + l_quantity AS DOUBLE) * 4 AS h, l_discount * 10 AS det_score,
        CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_extendedprice / 100000 END AS quality, CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE concat('/crops/', CAST(l_orderkey AS STRING), '.jpg') END AS crop_path"""),
    # boxes that the source knows, in parts of the photo
    "syno_faces": ("lineitem", """CASE WHEN l_orderkey % 2 = 0 THEN 'personal' ELSE 'shared' END AS space, l_orderkey * 10 + l_linenumber AS syno_face_id, l_orderkey AS photo_id, l_suppkey AS person_id,
        CAST(l_partkey % 40 * 20 + l_linenumber * 3 AS DOUBLE) / 1000 AS x1, CAST(l_suppkey % 40 * 20 + 5 AS DOUBLE) / 1000 AS y1,
        CAST(l_partkey % 40 * 20 + l_linenumber * 3 + 100 AS DOUBLE) / 1000 AS x2, CAST(l_suppkey % 40 * 20 + 105 AS DOUBLE) / 1000 AS y2, l_linenumber AS line"""),
    "frames": ("orders", """CASE WHEN o_orderkey % 2 = 0 THEN 'personal' ELSE 'shared' END AS space, o_orderkey AS id, CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(1000 AS BIGINT) END AS width,
        CASE WHEN o_orderkey % 29 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(1000 AS BIGINT) END AS height, CAST(CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS BIGINT) AS deleted"""),
    "queue": ("orders", """o_orderkey AS item_id, o_custkey % 5 AS run_id,
        CASE o_orderkey % 7 WHEN 0 THEN 'assign' WHEN 1 THEN 'low_confidence' WHEN 2 THEN 'reassign' WHEN 3 THEN 'new_person' WHEN 4 THEN 'merge' WHEN 5 THEN 'merge_named' ELSE 'restore_disagreement' END AS kind,
        CASE o_custkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' WHEN 3 THEN 'hidden' WHEN 4 THEN 'applied' ELSE 'failed' END AS status,
        CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice / 600000 END AS confidence, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 1700000000 + o_orderkey END AS decided_at,
        CASE o_orderkey % 7 WHEN 3 THEN concat('{"face_ids":[', CAST(o_orderkey * 8 + 1 AS STRING), ',', CAST(o_orderkey * 8 + 2 AS STRING), '],"size":2}')
          WHEN 4 THEN concat('{"person_a":{"space":"personal","person_id":', CAST(o_custkey AS STRING), ',"name":"A"},"person_b":{"space":"personal","person_id":', CAST(o_custkey + 1 AS STRING), CASE WHEN o_custkey % 3 = 0 THEN ',"name":" "},' ELSE ',"name":"B"},' END, '"evidence":{"cluster_id":1,"exemplars":{"personal:1":[', CAST(o_orderkey * 8 + 1 AS STRING), '],"personal:2":[', CAST(o_orderkey * 8 + 3 AS STRING), ',4]}}}')
          WHEN 5 THEN concat('{"person_a":{"space":"shared","person_id":', CAST(o_custkey AS STRING), ',"name":"A"},"person_b":{"space":"shared","person_id":', CAST(o_custkey + 2 AS STRING), ',"name":"C"},"evidence":{}}')
          WHEN 6 THEN 'not json'
          WHEN 2 THEN concat('{"face_id":', CAST(o_orderkey * 8 + 1 AS STRING), ',"photo_id":', CAST(o_orderkey AS STRING), ',"space":"personal","from_person_id":', CAST(o_custkey + 5 AS STRING), ',"person_id":', CAST(o_custkey AS STRING), '}')
          ELSE concat('{"face_id":', CAST(o_orderkey * 8 + 1 AS STRING), ',"photo_id":', CAST(o_orderkey AS STRING), ',"space":"personal","person_id":', CAST(o_custkey AS STRING), CASE WHEN o_custkey % 4 = 0 THEN ',"original_person_id":7' ELSE '' END, '}') END AS payload_json"""),
    "audit_log": ("events", "event_id AS id, CAST(epoch_s AS BIGINT) AS ts, event_type AS action, CAST(CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1 END AS BIGINT) AS success, CASE WHEN event_id % 3 = 0 THEN event_id ELSE NULL END AS review_item_id"),
    "schedules": ("part", """p_partkey AS id, p_name AS name, p_type AS job, CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS enabled,
        CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 1704067200 + p_partkey * 100 END AS next_run_at, CASE WHEN p_partkey % 4 = 0 THEN 'broken' ELSE concat('{"a":', CAST(p_size AS STRING), '}') END AS params_json"""),
    "schedule_runs": ("events", "event_id AS id, user_id AS schedule_id, CAST(epoch_s AS BIGINT) AS fired_at, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 40 END AS job_id, event_type AS status"),
    # a job's events: the user is the job, the type its phase
    "job_events": ("events", "user_id AS job_id, event_id AS line_no, CAST(epoch_s AS BIGINT) AS ts, CASE event_id % 7 WHEN 0 THEN 'phase' WHEN 1 THEN 'log' WHEN 2 THEN 'result' WHEN 3 THEN 'error' ELSE 'progress' END AS event, event_type AS phase, CASE WHEN event_id % 2 = 0 THEN 'personal' ELSE 'shared' END AS space, event_id % 120 AS done, CAST(100 AS BIGINT) AS total"),
    # clusters and known persons of the vectors
    "cluster_of": ("embeddings", "vec_id AS face_id, vec_id % 12 AS cluster"),
    "known": ("embeddings", "vec_id AS face_id, 'personal' AS space, CASE WHEN vec_id % 5 = 0 THEN CAST(9 AS BIGINT) ELSE vec_id % 12 % 4 END AS person_id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE vec_id * 10 END AS syno_face_id, vec_id % 24 < 12 AND vec_id % 12 < 9 AS labeled"),
    "face_meta": ("embeddings", "vec_id AS face_id, CASE WHEN vec_id % 14 = 0 THEN 'shared' ELSE 'personal' END AS space, vec_id % 60 AS photo_id"),
    "face_tags": ("embeddings", "'personal' AS space, vec_id % 4 AS person_id, vec_id % 60 AS photo_id, vec_id % 11 = 0 AS tagged"),
    # clusters are sources, votes the quality label of the labelled documents
    "members": ("documents", "source AS cluster_id, doc_id AS face_id, lang AS space, doc_id % 50 AS photo_id"),
    "votes": ("labels", "doc_id AS face_id, CAST(quality AS BIGINT) AS person_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id END AS syno_face_id"),
}


class Tables:
    """Given tables and stand-ins of a folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in STANDINS:
            given, columns = STANDINS[name]
            df = getattr(self, given)
            if "epoch_s" in columns:
                df = df.withColumn("epoch_s", df["ts"].cast("timestamp").cast("long"))
            return df.selectExpr(*_split(columns))
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def _split(columns: str) -> list[str]:
    """The expressions between commas at depth 0."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(columns):
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


def with_standins(sql: str) -> str:
    """sql with the stand-ins that it names in front, as common table expressions."""
    import re

    used = [n for n in STANDINS if re.search(rf"\b{n}\b", sql)]
    parts = []
    for n in used:
        given, columns = STANDINS[n]
        source = f"(SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s FROM {given})" if "epoch_s" in columns else given
        parts.append(f"{n} AS (SELECT {columns} FROM {source})")
    if not parts:
        return sql
    body = sql.strip()
    head = "WITH RECURSIVE " if body.upper().startswith("WITH RECURSIVE ") else "WITH "
    rest = body[len(head) :] if body.upper().startswith("WITH ") else None
    return head + ",\n".join(parts) + (",\n" + rest if rest is not None else "\n" + body)
