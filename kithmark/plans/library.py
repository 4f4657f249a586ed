"""Queries over the mirrored library, the review queue and the statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import dedupe, library, review
from .registry import query
from .standins import Tables

ID2 = "space, id"


# ---- filters -------------------------------------------------------------------------------


@query("SELECT item_id, kind, status FROM queue WHERE kind = 'assign' AND status = 'pending'")
def flt_dynamic(t: Tables) -> DataFrame:
    return library.dynamic(t.queue, kind="assign", status="pending").select("item_id", "kind", "status")


@query("SELECT space, id, filename FROM photos WHERE deleted = 0")
def flt_live(t):
    return library.live(t.photos).select("space", "id", "filename")


@query("SELECT space, id FROM persons WHERE persons.show = 0 AND deleted = 0")
def flt_hidden_persons(t):
    return library.hidden_persons(t.persons).select("space", "id")


@query("SELECT space, id FROM photos WHERE deleted = 0 AND type IN ('photo', 'live') AND (sha256 IS NULL OR hash_cache_key IS DISTINCT FROM cache_key)")
def flt_hash_work(t):
    return library.hash_work(t.photos).select("space", "id")


WORK = """FROM photos p LEFT JOIN (SELECT * FROM extract_log WHERE logged > 0) l ON p.space = l.space AND p.id = l.photo_id
WHERE p.deleted = 0 AND p.type = 'photo' AND (l.pipeline_version IS NULL OR l.pipeline_version <> 'v2' OR l.cache_key IS DISTINCT FROM p.cache_key)"""


@query(f"SELECT p.space, p.id {WORK}")
def flt_extract_work(t):
    return library.extract_work(t.photos, t.extract_log.filter("logged > 0"), "v2").select("space", "id")


@query(f"SELECT p.space, p.id {WORK} ORDER BY 1, 2 LIMIT 25")
def ord_extract_limit(t):
    return library.extract_work(t.photos, t.extract_log.filter("logged > 0"), "v2", 25).select("space", "id")


@query("SELECT p.space, p.id, l.pipeline_version, l.face_count FROM photos p LEFT JOIN (SELECT * FROM extract_log WHERE logged > 0) l ON p.space = l.space AND p.id = l.photo_id WHERE p.deleted = 0")
def join_left_log(t):
    log = t.extract_log.filter("logged > 0").select("space", F.col("photo_id").alias("id"), "pipeline_version", "face_count")
    return library.live(t.photos).join(log, ["space", "id"], "left").select("space", "id", "pipeline_version", "face_count")


@query("SELECT space, id, type FROM photos WHERE deleted = 0 AND (type IS NULL OR type <> 'video')")
def flt_eligible(t):
    return library.eligible(t.photos).select("space", "id", "type")


@query("SELECT item_id FROM queue WHERE kind IN ('merge', 'merge_named') AND trim(coalesce(json_extract_string(CASE WHEN json_valid(payload_json) THEN payload_json END, '$.person_a.name'), '')) <> '' AND trim(coalesce(json_extract_string(CASE WHEN json_valid(payload_json) THEN payload_json END, '$.person_b.name'), '')) <> ''")
def flt_named_merge(t):
    return t.queue.filter(F.col("kind").isin("merge", "merge_named") & S.named_merge(F.col("payload_json"))).select("item_id")


@query("SELECT space, id FROM persons WHERE deleted = 0 AND trim(coalesce(name, '')) = ''")
def flt_unnamed(t):
    return library.unnamed(t.persons).select("space", "id")


@query("SELECT face_id FROM faces WHERE least(w, h) >= 100")
def flt_min_face(t):
    return t.faces.filter(F.least("w", "h") >= 100).select("face_id")


@query("""WITH p AS (SELECT space, photo_id, quantile_cont(quality, 0.15) AS lim FROM faces GROUP BY 1, 2)
SELECT face_id, coalesce(least(w, h) < 80, false) OR coalesce(quality < lim, false) AS restore FROM faces JOIN p USING (space, photo_id)""")
def flt_restore_gate(t):
    return library.restore_gate(t.faces, 80, 15)


@query("""WITH q AS (SELECT *, CASE WHEN json_valid(payload_json) THEN payload_json END AS j FROM queue), g AS (SELECT *, CAST(json_extract_string(j, '$.person_id') AS BIGINT) AS p, CAST(json_extract_string(j, '$.from_person_id') AS BIGINT) AS f,
CAST(json_extract_string(j, '$.person_a.person_id') AS BIGINT) AS a, CAST(json_extract_string(j, '$.person_b.person_id') AS BIGINT) AS b FROM q)
SELECT item_id, kind FROM g WHERE CASE WHEN kind IN ('assign', 'low_confidence') THEN p = 40 WHEN kind IN ('merge', 'merge_named') THEN a = 40 OR b = 40 WHEN kind = 'reassign' THEN f = 40 OR p = 40 END""")
def flt_person_scope(t):
    return review.in_scope(t.queue, 40).select("item_id", "kind")


@query("SELECT item_id, CASE WHEN kind IN ('merge_named', 'reassign') OR kind NOT IN ('assign', 'low_confidence', 'merge', 'merge_named', 'reassign') THEN 'skipped' ELSE 'apply' END AS outcome FROM queue WHERE status = 'approved'")
def flt_gate(t):
    return review.gate_outcome(t.queue, merge=True, merge_named=False, reassign=False).select("item_id", "outcome")


@query("SELECT id, fired_at + 3600 AS expires_at FROM schedule_runs WHERE fired_at + 3600 > 1705276800")
def flt_session_live(t):
    return t.schedule_runs.withColumn("expires_at", F.col("fired_at") + 3600).filter("expires_at > 1705276800").select("id", "expires_at")


# ---- projections ---------------------------------------------------------------------------


@query("""SELECT face_id, f.space, photo_id, CASE WHEN width > 0 AND height > 0 THEN round(x / width, 6) END AS x1, CASE WHEN width > 0 AND height > 0 THEN round(y / height, 6) END AS y1,
CASE WHEN width > 0 AND height > 0 THEN round((x + w) / width, 6) END AS x2, CASE WHEN width > 0 AND height > 0 THEN round((y + h) / height, 6) END AS y2 FROM faces f JOIN frames p ON f.space = p.space AND f.photo_id = p.id""")
def prj_norm_bbox(t):
    return library.face_boxes(t.faces, t.frames)


@query("SELECT f.face_id, f.space, f.photo_id, p.width FROM faces f JOIN frames p ON f.space = p.space AND f.photo_id = p.id WHERE p.deleted = 0")
def join_inner_equi(t):
    p = library.live(t.frames).select("space", F.col("id").alias("photo_id"), "width")
    return t.faces.join(p, ["space", "photo_id"]).select("face_id", "space", "photo_id", "width")


@query("SELECT space, id, 'https://nas.example/?launchApp=SYNO.Foto.AppInstance#/' || space || '_space/timeline/item/' || CAST(id AS VARCHAR) AS url FROM photos")
def prj_links(t):
    return t.photos.select("space", "id", S.item_url(F.lit("https://nas.example/"), F.col("space"), F.col("id")).alias("url"))


@query("SELECT face_id, CASE WHEN starts_with(crop_path, '/crops/') THEN '/crops/' || substr(crop_path, 8) END AS url FROM faces")
def prj_crop_url(t):
    return t.faces.select("face_id", S.crop_url(F.col("crop_path"), "/crops").alias("url"))


@query("SELECT face_id, printf('%02x', face_id % 256) || '/' || CAST(face_id AS VARCHAR) || '.jpg' AS path, printf('%02x', face_id % 256) || '/' || CAST(face_id AS VARCHAR) || '_ctx.jpg' AS context FROM faces")
def prj_crop_path(t):
    return t.faces.select("face_id", S.crop_path(F.col("face_id")).alias("path"), S.crop_path(F.col("face_id"), True).alias("context"))


@query("SELECT id, printf('%02x', id % 256) || '/' || CAST(id AS VARCHAR) AS path FROM photos")
def src_original_cache(t):
    from ..sources.readers import original_path

    return t.photos.select("id", original_path(F.col("id")).alias("path"))


@query("SELECT id, name, enabled = 1 AS enabled, CAST(CASE WHEN json_valid(params_json) THEN json_extract_string(params_json, '$.a') END AS BIGINT) AS a FROM schedules")
def prj_schedule_row(t):
    return t.schedules.select("id", "name", (F.col("enabled") == 1).alias("enabled"), review.json_at("a", "bigint", "params_json").alias("a"))


@query("""WITH q AS (SELECT *, CASE WHEN json_valid(payload_json) THEN payload_json END AS j FROM queue WHERE kind = 'assign'), l AS (SELECT item_id, status, round(confidence, 9) AS confidence, CAST(json_extract_string(j, '$.photo_id') AS BIGINT) AS photo_id, CAST(json_extract_string(j, '$.person_id') AS BIGINT) AS person_id FROM q)
SELECT l.*, p.name AS person_name, coalesce(p.show = 0, false) AS person_hidden, '/?launchApp=SYNO.Foto.AppInstance#/personal_space/timeline/item/' || CAST(l.photo_id AS VARCHAR) AS link FROM l LEFT JOIN persons p ON p.id = l.person_id""")
def prj_review_item(t):
    q = t.queue.filter("kind = 'assign'").select("item_id", "status", F.round("confidence", 9).alias("confidence"), review.json_at("photo_id", "bigint").alias("photo_id"), review.json_at("person_id", "bigint").alias("person_id"))
    p = t.persons.select(F.col("id").alias("person_id"), F.col("name").alias("person_name"), "show")
    got = q.join(p, "person_id", "left")
    link = S.item_url(F.lit("/"), F.lit("personal"), F.col("photo_id"))
    return got.select("item_id", "status", "confidence", "photo_id", "person_id", "person_name", F.coalesce(F.col("show") == 0, F.lit(False)).alias("person_hidden"), link.alias("link"))


# ---- joins ---------------------------------------------------------------------------------

STATE = """(SELECT r.face_id, CASE WHEN f.deleted IS NULL OR f.deleted <> 0 THEN 'lost' WHEN coalesce(f.width, 0) > 0 AND coalesce(f.height, 0) > 0 THEN 'ok' ELSE 'repairable' END AS state
FROM {ids} r LEFT JOIN (SELECT a.face_id, p.* FROM faces a LEFT JOIN frames p ON a.space = p.space AND a.photo_id = p.id) f ON f.face_id = r.face_id)"""


@query("SELECT * FROM " + STATE.format(ids="(SELECT o_orderkey * 8 + 1 AS face_id FROM orders)"))
def join_left_state(t):
    return library.face_state(t.orders.select((F.col("o_orderkey") * 8 + 1).alias("face_id")), t.faces, t.frames)


@query("SELECT DISTINCT p.space, p.id FROM frames p WHERE deleted = 0 AND EXISTS (SELECT 1 FROM person_photos t WHERE t.space = p.space AND t.photo_id = p.id)")
def join_distinct_semi(t):
    return library.tagged_live(t.frames, t.person_photos)


@query("SELECT space, id, width FROM frames p WHERE EXISTS (SELECT 1 FROM faces f WHERE f.space = p.space AND f.photo_id = p.id)")
def join_semi_exists(t):
    return library.with_faces(t.frames, t.faces).select("space", "id", "width")


@query("SELECT space, id FROM frames p WHERE deleted = 0 AND NOT EXISTS (SELECT 1 FROM faces f WHERE f.space = p.space AND f.photo_id = p.id)")
def join_anti_notin(t):
    return library.without_faces(t.frames, t.faces).select("space", "id")


@query("SELECT p.space, p.id, CASE WHEN i.id IS NULL AND p.deleted = 0 THEN CAST(1 AS BIGINT) ELSE p.deleted END AS deleted FROM photos p LEFT JOIN incoming i ON p.space = i.space AND p.id = i.id")
def join_anti_vanished(t):
    return library.vanish(t.photos, t.incoming, ["space", "id"]).select("space", "id", "deleted")


@query("SELECT space, id, coalesce(similar_top_pick, id) AS link_id FROM photos")
def join_lookup_map(t):
    return library.top_pick(t.photos)


@query("SELECT f.face_id, p.name FROM faces f LEFT JOIN persons p ON p.id = f.face_id % 97 + 1")
def join_map_lookups(t):
    names = t.persons.select(F.col("id").alias("person"), "name")
    return t.faces.withColumn("person", F.col("face_id") % 97 + 1).join(names, "person", "left").select("face_id", "name")


@query("SELECT face_id, space, l AS person_id, photo_id FROM (SELECT face_id, space, photo_id, face_id % 100 + 1 AS l FROM faces) f WHERE NOT EXISTS (SELECT 1 FROM person_photos t WHERE t.space = f.space AND t.person_id = f.l AND t.photo_id = f.photo_id)")
def join_set_exclude(t):
    want = t.faces.select("face_id", "space", (F.col("face_id") % 100 + 1).alias("person_id"), "photo_id")
    return want.join(t.person_photos, ["space", "person_id", "photo_id"], "left_anti").select("face_id", "space", "person_id", "photo_id")


@query("SELECT m.face_id, m.cluster_id FROM members m WHERE m.cluster_id = (SELECT cluster_id FROM members WHERE face_id = 100)")
def join_scalar_subq(t):
    of = t.members.filter("face_id = 100").select("cluster_id")
    return t.members.join(F.broadcast(of), "cluster_id", "left_semi").select("face_id", "cluster_id")


@query("SELECT r.id, r.schedule_id, r.job_id, j.n FROM schedule_runs r LEFT JOIN (SELECT job_id, count(*) AS n FROM job_events GROUP BY job_id) j ON r.job_id = j.job_id")
def join_schedule_jobs(t):
    jobs = t.job_events.groupBy("job_id").agg(F.count("*").alias("n"))
    return t.schedule_runs.join(jobs, "job_id", "left").select("id", "schedule_id", "job_id", "n")


@query("""WITH e AS (SELECT cluster_id, v.person_id, count(*) AS n FROM members m JOIN votes v ON v.face_id = m.face_id GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY cluster_id) AS tot FROM e)
SELECT a.person_id AS a, b.person_id AS b, min(a.cluster_id) AS cluster FROM s a JOIN s b ON a.cluster_id = b.cluster_id AND a.person_id < b.person_id WHERE a.n >= 0.2 * a.tot AND b.n >= 0.2 * b.tot GROUP BY 1, 2""")
def join_vote_pairs(t):
    from ..operators import crossref

    counted = crossref.votes(t.members.select("face_id", F.col("cluster_id").alias("cluster")), t.votes.withColumn("space", F.lit("x")))
    return crossref.merges_within(counted, 0.2)


# ---- aggregates ----------------------------------------------------------------------------


@query("SELECT count(*) AS n FROM queue WHERE status = 'pending'")
def agg_count(t):
    return library.dynamic(t.queue, status="pending").agg(F.count("*").alias("n"))


@query("SELECT status, kind, count(*) AS n FROM queue GROUP BY 1, 2")
def agg_queue_counts(t):
    return review.counts(t.queue, "status", "kind")


@query("SELECT status, count(*) AS n FROM queue WHERE status IN ('approved', 'failed') GROUP BY 1")
def agg_status_counts(t):
    return review.counts(t.queue.filter(F.col("status").isin("approved", "failed")), "status")


@query("SELECT kind, count(*) AS n FROM queue WHERE status = 'approved' AND kind IN ('assign', 'merge', 'reassign') GROUP BY 1")
def agg_kind_counts(t):
    return review.counts(t.queue.filter((F.col("status") == "approved") & F.col("kind").isin("assign", "merge", "reassign")), "kind")


@query("""SELECT s.space, count(p.id) AS total, CAST(coalesce(sum(CASE WHEN deleted = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS synced, CAST(coalesce(sum(CASE WHEN deleted = 0 AND sha256 IS NOT NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS hashed, CAST(coalesce(sum(deleted), 0) AS BIGINT) AS deleted
FROM (VALUES ('en'), ('de'), ('nowhere')) s(space) LEFT JOIN photos p ON p.space = s.space GROUP BY 1""")
def agg_cond_sum(t):
    spaces = t.spark.createDataFrame([("en",), ("de",), ("nowhere",)], "space string")
    got = F.broadcast(spaces).join(t.photos, "space", "left").groupBy("space")
    return got.agg(F.count("id").alias("total"), F.count_if(F.col("deleted") == 0).alias("synced"), F.count_if((F.col("deleted") == 0) & F.col("sha256").isNotNull()).alias("hashed"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted"))


@query("""WITH e AS (SELECT space, count(*) AS eligible FROM photos WHERE deleted = 0 AND (type IS NULL OR type <> 'video') GROUP BY 1), p AS (SELECT space, count(*) AS processed FROM extract_log WHERE logged > 0 AND pipeline_version = 'v2' GROUP BY 1)
SELECT e.space, eligible, coalesce(processed, 0) AS processed, round(CASE WHEN eligible > 0 THEN coalesce(processed, 0) / eligible END, 6) AS coverage FROM e LEFT JOIN p ON e.space = p.space""")
def agg_extract_coverage(t):
    e = library.eligible(t.photos).groupBy("space").agg(F.count("*").alias("eligible"))
    p = t.extract_log.filter("logged > 0 AND pipeline_version = 'v2'").groupBy("space").agg(F.count("*").alias("processed"))
    n = F.coalesce("processed", F.lit(0))
    return e.join(p, "space", "left").select("space", "eligible", n.alias("processed"), F.round(F.try_divide(n, "eligible"), 6).alias("coverage"))


@query("SELECT max(schedule_id) AS run_id, (SELECT count(DISTINCT job_id) FROM schedule_runs WHERE schedule_id = (SELECT max(schedule_id) FROM schedule_runs)) AS clusters FROM schedule_runs")
def agg_latest_run(t):
    by = t.schedule_runs.groupBy("schedule_id").agg(F.count_distinct("job_id").alias("clusters"))
    return by.agg(F.max("schedule_id").alias("run_id"), F.max_by("clusters", "schedule_id").alias("clusters"))


@query("""SELECT (SELECT count(*) FROM photos WHERE deleted = 0) AS photos, (SELECT count(*) FROM faces) AS faces, (SELECT count(*) FROM persons WHERE deleted = 0) AS persons,
(SELECT count(*) FROM queue WHERE status = 'pending') AS pending, (SELECT count(*) FROM embeddings) AS vectors""")
def agg_dashboard(t):
    n = lambda df, c: df.agg(F.count("*").alias(c))  # noqa: E731  one row each
    out = n(library.live(t.photos), "photos")
    for df, c in ((t.faces, "faces"), (library.live(t.persons), "persons"), (library.dynamic(t.queue, status="pending"), "pending"), (t.embeddings, "vectors")):
        out = out.crossJoin(n(df, c))
    return out


@query("SELECT run_id, count(*) AS items, count(DISTINCT kind) AS kinds, CAST(sum(CASE WHEN kind = 'assign' THEN 1 ELSE 0 END) AS BIGINT) AS assigns, CAST(sum(CASE WHEN kind IN ('merge', 'merge_named') THEN 1 ELSE 0 END) AS BIGINT) AS merges FROM queue GROUP BY 1")
def agg_report_summary(t):
    return t.queue.groupBy("run_id").agg(F.count("*").alias("items"), F.count_distinct("kind").alias("kinds"), F.count_if(F.col("kind") == "assign").alias("assigns"), F.count_if(F.col("kind").isin("merge", "merge_named")).alias("merges"))


@query("SELECT (SELECT count(*) FROM queue) AS n_queue, (SELECT max(item_id) FROM queue) AS max_item, (SELECT CAST(sum(decided_at) AS BIGINT) FROM queue) AS decided, (SELECT count(*) FROM persons) AS n_persons, (SELECT CAST(sum(item_count) AS BIGINT) FROM persons) AS item_count, (SELECT max(face_id) FROM faces) AS max_face")
def agg_fingerprint(t):
    q = t.queue.agg(F.count("*").alias("n_queue"), F.max("item_id").alias("max_item"), F.sum("decided_at").alias("decided"))
    return q.crossJoin(t.persons.agg(F.count("*").alias("n_persons"), F.sum("item_count").alias("item_count"))).crossJoin(t.faces.agg(F.max("face_id").alias("max_face")))


@query("SELECT string_agg(k, ',' ORDER BY k) AS fingerprint FROM (SELECT status || '/' || kind || '=' || CAST(count(*) AS VARCHAR) AS k FROM queue GROUP BY status, kind)")
def agg_orphan_fp(t):
    n = review.counts(t.queue, "status", "kind").select(F.concat("status", F.lit("/"), "kind", F.lit("="), F.col("n").cast("string")).alias("k"))
    return n.agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("fingerprint"))


@query("SELECT * FROM (SELECT 'photos' AS name, count(*) AS n FROM photos UNION ALL SELECT 'faces', count(*) FROM faces UNION ALL SELECT 'persons', count(*) FROM persons UNION ALL SELECT 'queue', count(*) FROM queue) WHERE n > 0")
def agg_table_counts(t):
    parts = [getattr(t, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("photos", "faces", "persons", "queue")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("n > 0")


@query("SELECT space, sha256, count(*) AS n FROM photos WHERE deleted = 0 AND sha256 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2")
def agg_exact_groups(t):
    return dedupe.exact_groups(t.photos).groupBy("space", "sha256").agg(F.count("*").alias("n"))


KEEP = """r AS (SELECT *, count(*) OVER (PARTITION BY space, sha256) AS n, row_number() OVER (PARTITION BY space, sha256 ORDER BY coalesce(width * height, 0) DESC, coalesce(filesize, 0) DESC, id) AS rank FROM photos WHERE deleted = 0 AND sha256 IS NOT NULL)"""


@query(f"WITH {KEEP} SELECT space, sha256, id, rank, rank = 1 AS keep FROM r WHERE n >= 2")
def op_dedupe_exact(t):
    return dedupe.exact_groups(t.photos).select("space", "sha256", "id", "rank", "keep")


@query("SELECT space, id, row_number() OVER (PARTITION BY space, cache_key ORDER BY coalesce(width * height, 0) DESC, coalesce(filesize, 0) DESC, id) AS rank FROM photos")
def win_keep_rule(t):
    return dedupe.keep_rule(t.photos, ["space", "cache_key"]).select("space", "id", "rank")


@query("SELECT id, coalesce(width * height, 0) AS pixels FROM photos")
def fn_sort_key(t):
    return t.photos.select("id", F.coalesce(F.col("width") * F.col("height"), F.lit(0)).alias("pixels"))


@query(f"WITH {KEEP}, d AS (SELECT DISTINCT id FROM r WHERE n >= 2 AND rank > 1) SELECT count(*) AS n_drop, CAST(coalesce(sum(coalesce(p.filesize, 0)), 0) AS BIGINT) AS bytes FROM d JOIN photos p USING (id)")
def agg_reclaimable(t):
    return dedupe.reclaimable(t.photos, dedupe.drop_ids(dedupe.exact_groups(t.photos)))


@query(f"WITH {KEEP}, k AS (SELECT id, row_number() OVER (PARTITION BY space, similar_top_pick ORDER BY coalesce(width * height, 0) DESC, coalesce(filesize, 0) DESC, id) AS rank FROM photos WHERE similar_top_pick IS NOT NULL) SELECT id FROM r WHERE n >= 2 AND rank > 1 UNION SELECT id FROM k WHERE rank > 1")
def set_drop_ids(t):
    stacks = dedupe.keep_rule(t.photos.filter("similar_top_pick IS NOT NULL"), ["space", "similar_top_pick"])
    return dedupe.drop_ids(dedupe.exact_groups(t.photos), stacks)


VOTES = "e AS (SELECT cluster_id, v.person_id, count(*) AS n FROM members m JOIN votes v ON v.face_id = m.face_id GROUP BY 1, 2), s AS (SELECT cluster_id, person_id, n, CAST(sum(n) OVER (PARTITION BY cluster_id) AS BIGINT) AS labeled FROM e)"


@query(f"WITH {VOTES} SELECT cluster_id AS cluster, person_id, n, labeled FROM s")
def agg_votes(t):
    from ..operators import crossref

    return crossref.votes(t.members.select("face_id", F.col("cluster_id").alias("cluster")), t.votes.withColumn("space", F.lit("x"))).select("cluster", "person_id", "n", "labeled")


@query(f"WITH {VOTES}, m AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, person_id DESC) AS r FROM s) SELECT cluster_id AS cluster, person_id, round(n / labeled, 6) AS fraction, labeled >= 3 AND n / labeled >= 0.6 AS mapped FROM m WHERE r = 1")
def agg_majority(t):
    from ..operators import crossref

    counted = crossref.votes(t.members.select("face_id", F.col("cluster_id").alias("cluster")), t.votes.withColumn("space", F.lit("x")))
    return crossref.map_clusters(counted).select("cluster", "person_id", F.round("fraction", 6).alias("fraction"), "mapped")


@query("SELECT person_id, row_number() OVER (PARTITION BY person_id ORDER BY coalesce(quality, 0) DESC, face_id) AS rank, face_id FROM (SELECT DISTINCT face_id, face_id % 50 AS person_id FROM faces) JOIN faces USING (face_id) QUALIFY rank <= 8")
def agg_person_faces(t):
    return library.person_faces(t.faces, t.faces.select("face_id", (F.col("face_id") % 50).alias("person_id")).distinct())


@query("SELECT detector, count(*) AS n FROM faces GROUP BY 1 ORDER BY n DESC")
def agg_by_detector(t):
    return t.faces.groupBy("detector").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("SELECT space, round(quantile_cont(quality, 0.15), 6) AS p15 FROM faces GROUP BY 1")
def agg_percentile(t):
    return t.faces.groupBy("space").agg(F.round(F.percentile("quality", 0.15), 6).alias("p15"))


@query("SELECT CAST(sum(CASE WHEN status = 'pending' THEN 1 ELSE 0 END) AS BIGINT) AS pending, CAST(sum(CASE WHEN status = 'approved' AND kind = 'assign' THEN 1 ELSE 0 END) AS BIGINT) AS approved_assign, CAST(sum(CASE WHEN status IN ('approved', 'failed') THEN 1 ELSE 0 END) AS BIGINT) AS to_apply, count(*) AS total FROM queue")
def agg_maintenance(t):
    s, k = F.col("status"), F.col("kind")
    return t.queue.agg(F.count_if(s == "pending").alias("pending"), F.count_if((s == "approved") & (k == "assign")).alias("approved_assign"), F.count_if(s.isin("approved", "failed")).alias("to_apply"), F.count("*").alias("total"))


@query("SELECT count(*) AS considered, CAST(sum(CASE WHEN outcome = 'apply' THEN 1 ELSE 0 END) AS BIGINT) AS applied, CAST(sum(CASE WHEN outcome = 'skipped' THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM (SELECT CASE WHEN kind IN ('merge_named', 'reassign') OR kind NOT IN ('assign', 'low_confidence', 'merge', 'merge_named', 'reassign') THEN 'skipped' ELSE 'apply' END AS outcome FROM queue WHERE status = 'approved')")
def agg_apply_stats(t):
    got = review.gate_outcome(t.queue, True, False, False)
    return got.agg(F.count("*").alias("considered"), F.count_if(F.col("outcome") == "apply").alias("applied"), F.count_if(F.col("outcome") == "skipped").alias("skipped"))


# ---- order, limits, windows ----------------------------------------------------------------


@query("SELECT item_id, kind, status FROM queue ORDER BY item_id LIMIT 100 OFFSET 200")
def ord_page(t):
    return library.page(t.queue, "item_id", 100, 200).select("item_id", "kind", "status")


@query("SELECT id, ts, action, success FROM audit_log ORDER BY id DESC LIMIT 50")
def ord_tail(t):
    return t.audit_log.orderBy(F.desc("id")).limit(50).select("id", "ts", "action", "success")


@query("SELECT space, id, name, item_count FROM persons WHERE deleted = 0 AND lower(name) LIKE '%customer%1%' ORDER BY item_count DESC NULLS LAST, name, id LIMIT 25")
def ord_search(t):
    return library.search_persons(t.persons, "Customer%1").select("space", "id", "name", "item_count")


@query("SELECT id, name FROM persons WHERE deleted = 0 AND starts_with(lower(name), 'customer#0000001') ORDER BY name, id LIMIT 10")
def src_suggest(t):
    return library.suggest_persons(t.persons, "Customer#0000001").select("id", "name")


@query("SELECT id, enabled, next_run_at, row_number() OVER (ORDER BY enabled DESC, next_run_at IS NULL, next_run_at, id) AS place FROM schedules ORDER BY place LIMIT 200")
def ord_schedules(t):
    order = [F.desc("enabled"), F.col("next_run_at").isNull(), F.col("next_run_at"), F.col("id")]
    top = t.schedules.orderBy(*order).limit(200)
    return top.select("id", "enabled", "next_run_at", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("SELECT p.id, coalesce(face_count, 0) AS faces FROM photos p LEFT JOIN extract_log l ON p.space = l.space AND p.id = l.photo_id WHERE p.deleted = 0 ORDER BY faces DESC, p.id LIMIT 25")
def ord_bench_sample(t):
    log = t.extract_log.select("space", F.col("photo_id").alias("id"), "face_count")
    return library.live(t.photos).join(log, ["space", "id"], "left").select("id", F.coalesce("face_count", F.lit(0)).alias("faces")).orderBy(F.desc("faces"), "id").limit(25)


@query("SELECT id, coalesce(ts, 0) AS created_at FROM audit_log ORDER BY created_at DESC, id LIMIT 50")
def ord_history(t):
    return t.audit_log.select("id", F.coalesce("ts", F.lit(0)).alias("created_at")).orderBy(F.desc("created_at"), "id").limit(50)


@query("WITH f AS (SELECT id, taken AS atime, coalesce(filesize, 0) AS bytes FROM photos), c AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY atime, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(bytes) OVER () AS total FROM f) SELECT id, bytes FROM c WHERE total - before > 1000000")
def ord_lru_evict(t):
    return library.evict(t.photos.select("id", F.col("taken").alias("atime"), F.coalesce("filesize", F.lit(0)).alias("bytes")), 1_000_000)


@query("SELECT EXISTS (SELECT 1 FROM persons WHERE persons.show = 0) AS found")
def ord_exists(t):
    return t.persons.filter("show = 0").limit(1).agg((F.count("*") > 0).alias("found"))


@query("SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY face_id) AS rank, face_id FROM members QUALIFY rank <= 20")
def win_first_n(t):
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("face_id")).cast("long")
    return t.members.withColumn("rank", rank).filter("rank <= 20").select("cluster_id", "rank", "face_id")


@query("SELECT photo_id, row_number() OVER (PARTITION BY photo_id ORDER BY coalesce(quality, 0) DESC, face_id) AS rank, face_id, crop_path FROM faces WHERE crop_path IS NOT NULL QUALIFY rank <= 3")
def win_best_n(t):
    return library.best_crops(t.faces, "photo_id")


SECTION = "r AS (SELECT item_id, CASE WHEN kind IN ('merge', 'merge_named') THEN 'merges' WHEN kind = 'assign' THEN 'assigns' WHEN kind = 'low_confidence' THEN 'low_confidence' WHEN kind = 'reassign' THEN 'reassigns' WHEN kind = 'new_person' THEN 'new_persons' ELSE 'other' END AS section FROM queue), n AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY item_id) AS rank, greatest(count(*) OVER (PARTITION BY section) - 500, 0) AS left_out FROM r)"


@query(f"WITH {SECTION} SELECT section, rank, item_id, left_out FROM n WHERE rank <= 500")
def snk_report_sections(t):
    return review.report_sections(t.queue)


@query(f"WITH {SECTION} SELECT section, count(*) AS shown, max(left_out) AS left_out FROM n WHERE rank <= 500 GROUP BY 1")
def win_section_cap(t):
    return review.report_sections(t.queue).groupBy("section").agg(F.count("*").alias("shown"), F.max("left_out").alias("left_out"))


@query("""SELECT '{"item_id":' || CAST(item_id AS VARCHAR) || ',"kind":"' || kind || '","status":"' || status || '"}' AS line FROM queue WHERE run_id = 2""")
def snk_report_jsonl(t):
    return t.queue.filter("run_id = 2").select(F.to_json(F.struct("item_id", "kind", "status")).alias("line"))


@query("SELECT id, action, '{\"n\":' || CAST(coalesce(review_item_id, 0) AS VARCHAR) || '}' AS params_json, CASE success WHEN 1 THEN true WHEN 0 THEN false END AS ok FROM audit_log")
def snk_audit(t):
    a = t.audit_log
    return a.select("id", "action", F.to_json(F.struct(F.coalesce("review_item_id", F.lit(0)).alias("n"))).alias("params_json"), (F.col("success") == 1).alias("ok"))


@query("SELECT id - id % 10 AS id, id AS member FROM (SELECT doc_id AS id FROM documents) WHERE id % 10 > 5")
def src_similar(t):
    from ..sources.readers import similar_groups

    lines = t.documents.filter("doc_id % 10 = 0").select(F.to_json(F.struct(F.col("doc_id").alias("id"), F.transform(F.array(*map(F.lit, (6, 7, 8, 9))), lambda k: F.col("doc_id") + k).alias("similar_items"))).alias("value"))
    plain = t.documents.filter("doc_id % 10 <> 0").select(F.to_json(F.struct(F.col("doc_id").alias("id"))).alias("value"))
    return similar_groups(lines.unionByName(plain)).join(t.documents.select(F.col("doc_id").alias("member")), "member", "left_semi").select("id", "member")


@query("SELECT doc_id AS id, lang AS space, source AS cache_key, n_chars AS width FROM documents")
def src_items(t):
    from ..sources.readers import items

    doc = F.struct(F.col("doc_id").alias("id"), F.struct(F.struct(F.col("source").alias("cache_key")).alias("thumbnail"), F.struct(F.col("n_chars").alias("width")).alias("resolution")).alias("additional"))
    lines = t.documents.select("lang", F.to_json(doc).alias("value"))
    return items(lines, "x").select("id", "cache_key", "width").join(t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("space")), "id").select("id", "space", "cache_key", "width")
