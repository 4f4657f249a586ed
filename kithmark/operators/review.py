"""The review queue as a table: pages, counts, orphans, the state machine, and the plan of an apply run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..plans.storage import written
from .ids import consecutive

SEEN = ("pending", "approved", "applied", "hidden")


def json_at(path: str, kind: str | None = None, payload: str = "payload_json") -> Column:
    got = F.get_json_object(payload, f"$.{path}")
    return got.try_cast(kind) if kind else got


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def existing_identities(queue: DataFrame) -> DataFrame:
    """shape, key: what earlier runs proposed and nobody rejected, by payload identity; a retargeted face counts for its old person too."""
    q = queue.filter(F.col("status").isin(*SEEN))
    pair = lambda face, person: F.concat_ws(":", face, person)
    face = q.filter(F.col("kind").isin("assign", "low_confidence"))
    frames = [face.select(F.lit("assign").alias("shape"), pair(json_at("face_id"), json_at(p)).alias("key"), json_at("face_id").alias("a"), json_at(p).alias("b")) for p in ("person_id", "original_person_id")]
    frames.append(q.filter("kind = 'reassign'").select(F.lit("reassign").alias("shape"), pair(json_at("face_id"), json_at("person_id")).alias("key"), json_at("face_id").alias("a"), json_at("person_id").alias("b")))
    side = lambda s: F.struct(json_at(f"{s}.space").alias("s"), json_at(f"{s}.person_id", "long").alias("p"))
    merge = q.filter(F.col("kind").isin("merge", "merge_named")).select(F.least(side("person_a"), side("person_b")).alias("x"), F.greatest(side("person_a"), side("person_b")).alias("y"))
    frames.append(merge.select(F.lit("merge").alias("shape"), F.concat_ws(":", "x.s", "x.p", "y.s", "y.p").alias("key"), F.col("x.s").alias("a"), F.col("y.s").alias("b")))
    ids = F.array_sort(F.from_json(json_at("face_ids"), "array<bigint>"))
    frames.append(q.filter("kind = 'new_person'").select(F.lit("new_person").alias("shape"), F.array_join(ids, ":").alias("key"), json_at("face_ids").alias("a"), json_at("face_ids").alias("b")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.filter("a IS NOT NULL AND b IS NOT NULL").select("shape", "key").distinct()


def fresh(proposals: DataFrame, seen: DataFrame, order: str) -> DataFrame:
    """Proposals (shape, key, order) that nobody saw, the first of those with one key."""
    first = F.row_number().over(Window.partitionBy("shape", "key").orderBy(order))
    return proposals.join(seen, ["shape", "key"], "left_anti").withColumn("r", first).filter("r = 1").drop("r")


def referenced_faces(queue: DataFrame) -> DataFrame:
    return queue.select("item_id", "status", F.explode(S.payload_faces(F.col("payload_json"))).alias("face_id"))


def orphans(queue: DataFrame, states: DataFrame) -> DataFrame:
    """Rows that refer to at least one face and only to lost ones. states: face_id, state; unknown faces are lost."""
    refs = referenced_faces(queue).join(states, "face_id", "left")
    lost = F.coalesce(F.col("state") == "lost", F.lit(True))
    return refs.groupBy("item_id", "status").agg(F.bool_and(lost).alias("lost")).filter("lost").select("item_id", "status")


def decide(queue: DataFrame, choices: DataFrame, now: int) -> DataFrame:
    """queue with the status that choices (item_id, choice) ask for; any status may be decided anew."""
    to = F.create_map(*(F.lit(x) for p in (("approve", "approved"), ("reject", "rejected"), ("hide", "hidden")) for x in p))
    got = queue.join(choices.withColumn("to", to[F.col("choice")]), "item_id", "left")
    return got.withColumns({"status": F.coalesce("to", "status"), "decided_at": F.when(F.col("to").isNotNull(), F.lit(now).cast("long")).otherwise(F.col("decided_at"))}).select(*queue.columns)


def undo(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """Approved, rejected or hidden rows go back to pending, but for those hidden because their faces were given to a person."""
    moved = F.coalesce(~json_at("retargeted_to").isin("", "{}", "[]", "0", "false"), F.lit(False))
    free = F.col("status").isin("approved", "rejected") | (F.col("status") == "hidden") & ~moved
    got = queue.join(ids.select("item_id", F.lit(True).alias("asked")), "item_id", "left").withColumn("back", F.col("asked").isNotNull() & free)
    return got.withColumns({"status": F.when(F.col("back"), "pending").otherwise(F.col("status")), "decided_at": F.when(~F.col("back"), F.col("decided_at"))}).select(*queue.columns)


def bulk_approve(queue: DataFrame, kind: str, least: float, now: int) -> DataFrame:
    hit = (F.col("status") == "pending") & (F.col("kind") == kind) & F.coalesce(F.col("confidence") >= least, F.lit(False))
    return queue.withColumns({"status": F.when(hit, "approved").otherwise(F.col("status")), "decided_at": F.when(hit, F.lit(now).cast("long")).otherwise(F.col("decided_at"))})


def json_text(c: Column) -> Column:
    """A value as JSON; null as null."""
    return F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("null"))


def set_keys(payload: Column, values: dict[str, Column]) -> Column:
    """A JSON object with plain values under these keys replaced or added at its end (JSON texts); the others stay as they are."""
    body = payload
    for key in values:
        old = rf'"{key}"\s*:\s*(?:"(?:[^"\\]|\\.)*"|[^,{{}}\[\]"\s]+)'
        body = F.regexp_replace(F.regexp_replace(body, rf"\s*,\s*{old}", ""), rf"{old}\s*,?\s*", "")
    body = F.regexp_replace(body, r"\s*\}\s*$", "")
    added = F.concat_ws(",", *(F.concat(F.lit(f'"{key}":'), F.when(v == "", "null").otherwise(v)) for key, v in values.items()))
    return F.concat(body, F.when(body.rlike(r"\{\s*$"), "").otherwise(","), added, F.lit("}"))


def retarget(queue: DataFrame, targets: DataFrame, members: DataFrame, faces: DataFrame, photos: DataFrame, now: int) -> DataFrame:
    """Rows of the queue that giving items to other persons changes or makes, with all its columns. targets: item_id, space, person_id, name.

    Face rows (assign, low_confidence) get the person, remember the one before, lose their confidence and are approved.
    A new_person row is hidden, and every face of its cluster becomes an approved assign row with the next free id. The
    cluster is that of the first exemplar in members (run_id, cluster_id, face_id); without one, the exemplars stand for it.
    Applied and hidden rows are refused, as are face rows of another space than the person's; faces of another space,
    of no known photo or of one without a size are left out. A face is once in faces, and in one cluster of a run.
    """
    name = F.when(F.col("name") != "", F.col("name"))
    asked = targets.select("item_id", F.col("space").alias("to_space"), F.col("person_id").alias("to_person"), name.alias("to_name"))
    open_ = queue.filter("status NOT IN ('applied', 'hidden')").join(asked, "item_id")
    at = F.lit(now).cast("long")
    new = {"decided_at": at, "confidence": F.lit(None).cast("double"), "status": F.lit("approved")}

    face = open_.filter(F.col("kind").isin("assign", "low_confidence")).filter(F.coalesce(json_at("space"), F.lit("")).isin("") | (json_at("space") == F.col("to_space")))
    moved = {"original_person_id": json_text(json_at("person_id", "long")), "person_id": json_text(F.col("to_person")), "person_name": json_text(F.col("to_name")), "manual_target": F.lit("true")}
    changed = face.withColumns({**new, "payload_json": set_keys(F.col("payload_json"), moved)})

    clusters = written(open_.filter("kind = 'new_person'").withColumn("exemplars", F.from_json(json_at("face_ids"), "array<bigint>")), "clusters")
    seed = clusters.select("item_id", "run_id", F.get("exemplars", F.lit(0)).alias("face_id")).join(members, ["run_id", "face_id"]).select("item_id", "run_id", "cluster_id").distinct()
    whole = seed.join(members, ["run_id", "cluster_id"]).select("item_id", "face_id").distinct()
    alone = clusters.join(seed, "item_id", "left_anti").select("item_id", F.explode("exemplars").alias("face_id"))
    size = photos.select("space", F.col("id").alias("photo_id"), "width", "height")
    box = S.normalized_box(*(F.col(c) for c in ("x", "y", "w", "h", "width", "height")))
    placed = faces.join(size, ["space", "photo_id"]).select("face_id", "space", "photo_id", F.array(*box).alias("bbox_normalized")).filter("bbox_normalized[0] IS NOT NULL")
    each = whole.unionByName(alone).join(placed, "face_id").join(clusters.select("item_id", "run_id", "to_space", "to_person", "to_name"), "item_id").filter("space = to_space")
    last = queue.agg(F.coalesce(F.max("item_id"), F.lit(0)).alias("last"))  # one row
    ranked = written(consecutive(each.withColumnRenamed("item_id", "source_item_id"), ["source_item_id", "face_id"], "n", 1).crossJoin(F.broadcast(last)).withColumn("item_id", F.col("n") + F.col("last")), "made")
    payload = F.struct("face_id", "photo_id", "space", F.col("to_person").alias("person_id"), F.col("to_name").alias("person_name"), "bbox_normalized", F.lit(None).cast("double").alias("confidence"), F.lit(True).alias("manual_target"), "source_item_id")
    made = ranked.withColumns({**new, "kind": F.lit("assign"), "payload_json": F.to_json(payload, {"ignoreNullFields": "false"})})

    span = ranked.groupBy(F.col("source_item_id").alias("item_id")).agg(F.min("item_id").alias("lo"), F.max("item_id").alias("hi"))
    became = F.struct(F.col("to_space").alias("space"), F.col("to_person").alias("person_id"), F.col("to_name").alias("person_name"), F.coalesce(F.sequence("lo", "hi"), F.array().cast("array<bigint>")).alias("item_ids"))
    note = {"retargeted_to": F.to_json(became, {"ignoreNullFields": "false"})}
    hidden = clusters.join(span, "item_id", "left").withColumns({"decided_at": at, "status": F.lit("hidden"), "payload_json": set_keys(F.col("payload_json"), note)})
    return changed.select(*queue.columns).unionByName(hidden.select(*queue.columns)).unionByName(_with_columns(made, queue).select(*queue.columns))


def _with_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """df with a null for every column of `like` that it lacks."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in like.schema.fields if f.name not in df.columns})


def suggest_name(queue: DataFrame, names: DataFrame) -> DataFrame:
    """queue with suggested_name set in the payloads of new persons; their other keys stay as they are."""
    got = queue.join(names, "item_id", "left")
    new = set_keys(F.col("payload_json"), {"suggested_name": json_text(F.col("name"))})
    return got.withColumn("payload_json", F.when((F.col("kind") == "new_person") & F.col("name").isNotNull(), new).otherwise(F.col("payload_json"))).select(*queue.columns)


def in_scope(queue: DataFrame, person: int) -> DataFrame:
    """Rows about a person: target of assigns, either side of merges and reassigns."""
    is_ = lambda path: json_at(path, "long") == person
    hit = F.when(F.col("kind").isin("assign", "low_confidence"), is_("person_id")).when(F.col("kind").isin("merge", "merge_named"), is_("person_a.person_id") | is_("person_b.person_id"))
    return queue.filter(F.coalesce(hit.when(F.col("kind") == "reassign", is_("from_person_id") | is_("person_id")), F.lit(False)))


def gate_outcome(queue: DataFrame, merge: bool, merge_named: bool, reassign: bool) -> DataFrame:
    """approved rows with outcome: skipped where the kind's flag is off or it can't be written, else apply."""
    off = [k for k, on in (("merge", merge), ("merge_named", merge_named), ("reassign", reassign)) if not on]
    known = F.col("kind").isin("assign", "low_confidence", "merge", "merge_named", "reassign")
    return queue.filter("status = 'approved'").withColumn("outcome", F.when(F.col("kind").isin(*off) | ~known, "skipped").otherwise("apply"))


def breaker(attempts: DataFrame, scope: list[str], order: str, most: int = 5) -> DataFrame:
    """attempts (outcome applied, already, failed or skipped) that run before the breaker trips: `most` failures in a row stop the rest.

    Successes start a new island; skips belong to none.
    """
    upto = Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    got = attempts.withColumn("island", F.sum(F.col("outcome").isin("applied", "already").cast("int")).over(upto))
    run = Window.partitionBy(*scope, "island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    got = got.withColumn("streak", F.sum((F.col("outcome") == "failed").cast("int")).over(run))
    tripped = F.coalesce(F.max(F.col("streak") >= most).over(before), F.lit(False))
    return got.withColumn("tripped", tripped).filter("NOT tripped").select(*attempts.columns)


def merge_direction(pairs: DataFrame) -> DataFrame:
    """target and source of merges: the named side, then the larger one, then a. pairs: a, b, a_name, b_name, a_count, b_count."""
    rank = lambda s: F.struct((~S.blank(F.col(f"{s}_name"))).alias("named"), F.coalesce(f"{s}_count", F.lit(0)).alias("n"))
    a_wins = rank("a") >= rank("b")
    return pairs.select("a", "b", F.when(a_wins, F.col("a")).otherwise(F.col("b")).alias("target"), F.when(a_wins, F.col("b")).otherwise(F.col("a")).alias("source"))


def report_sections(queue: DataFrame, cap: int = 500) -> DataFrame:
    """section, rank, item_id, left_out: rows by section, the first `cap` of each, and how many more there are."""
    section = F.when(F.col("kind").isin("merge", "merge_named"), "merges").when(F.col("kind") == "assign", "assigns").when(F.col("kind") == "low_confidence", "low_confidence").when(F.col("kind") == "reassign", "reassigns").when(F.col("kind") == "new_person", "new_persons").otherwise("other")
    rows = queue.withColumn("section", section)
    left = rows.groupBy("section").agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("left_out"))
    rank = F.row_number().over(Window.partitionBy("section").orderBy("item_id")).cast("long")
    return rows.withColumn("rank", rank).filter(F.col("rank") <= cap).join(F.broadcast(left), "section").select("section", "rank", "item_id", "left_out")


def delete_items(queue: DataFrame, audit: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """queue without the rows, audit without links to them."""
    gone = ids.select(F.col("item_id").alias("review_item_id"), F.lit(True).alias("gone"))
    cleared = audit.join(gone, "review_item_id", "left").withColumn("review_item_id", F.when(F.col("gone").isNull(), F.col("review_item_id")))
    return queue.join(ids, "item_id", "left_anti"), cleared.select(*audit.columns)


def split_named(queue: DataFrame) -> DataFrame:
    """Pending merges of two named persons become merge_named."""
    hit = (F.col("kind") == "merge") & (F.col("status") == "pending") & S.named_merge(F.col("payload_json"))
    return queue.withColumn("kind", F.when(hit, "merge_named").otherwise(F.col("kind")))


def consent_gate(jobs: DataFrame) -> DataFrame:
    """What a job needs before it runs, from (job, dry_run, kind)."""
    gate = F.when(F.col("dry_run"), "none").when(F.col("job") == "reset", "phrase").when(F.col("job") == "dedupe", "phrase").when((F.col("job") == "apply") & (F.col("kind") == "merge_named"), "phrase").when((F.col("job") == "apply") & F.col("kind").isin("merge", "reassign"), "flag").when(F.col("job") == "apply", "confirm").otherwise("none")
    return jobs.withColumn("gate", gate)
