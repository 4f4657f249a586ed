"""Predicates, joins and projections over the mirrored library: photos, persons, detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .ids import running_sum


def live(df: DataFrame) -> DataFrame:
    return df.filter("deleted = 0")


def hidden_persons(persons: DataFrame) -> DataFrame:
    """Explicitly hidden and live; an unknown flag is not hidden."""
    return persons.filter("show = 0 AND deleted = 0")


def hash_work(photos: DataFrame) -> DataFrame:
    """Photos and live photos without a digest, or whose digest is of another version of the content."""
    return live(photos).filter(F.col("type").isin("photo", "live") & (F.col("sha256").isNull() | ~F.col("hash_cache_key").eqNullSafe(F.col("cache_key"))))


def eligible(photos: DataFrame) -> DataFrame:
    return live(photos).filter("type IS NULL OR type <> 'video'")


def extract_work(photos: DataFrame, log: DataFrame, version: str, limit: int | None = None) -> DataFrame:
    """Live photos never processed, processed by another pipeline version, or from other content."""
    log = log.select("space", F.col("photo_id").alias("id"), F.col("pipeline_version"), F.col("cache_key").alias("log_key"))
    got = live(photos).filter("type = 'photo'").join(log, ["space", "id"], "left")
    got = got.filter(F.col("pipeline_version").isNull() | (F.col("pipeline_version") != version) | ~F.col("log_key").eqNullSafe(F.col("cache_key"))).select(*photos.columns)
    return got if limit is None else got.orderBy("space", "id").limit(limit)


def unnamed(persons: DataFrame) -> DataFrame:
    return live(persons).filter(S.blank(F.col("name")))


def dynamic(df: DataFrame, **wanted: str) -> DataFrame:
    """Rows that match every value given; an empty one asks for nothing."""
    for column, value in wanted.items():
        if value:
            df = df.filter(F.col(column) == value)
    return df


def with_faces(photos: DataFrame, faces: DataFrame) -> DataFrame:
    return photos.join(faces.select("space", F.col("photo_id").alias("id")), ["space", "id"], "left_semi")


def without_faces(photos: DataFrame, faces: DataFrame) -> DataFrame:
    return live(photos).join(faces.select("space", F.col("photo_id").alias("id")), ["space", "id"], "left_anti")


def tagged_live(photos: DataFrame, tags: DataFrame) -> DataFrame:
    """Distinct live photos with a tag."""
    return live(photos).join(tags.select("space", F.col("photo_id").alias("id")), ["space", "id"], "left_semi").select("space", "id").distinct()


def face_state(ids: DataFrame, faces: DataFrame, photos: DataFrame) -> DataFrame:
    """face_id with ok (its photo is live and has dims), repairable (live, no dims) or lost (no face, or no live photo)."""
    at = faces.select("face_id", "space", F.col("photo_id").alias("id")).join(photos.select("space", "id", "width", "height", "deleted"), ["space", "id"], "left")
    known = ids.join(at, "face_id", "left")
    gone = F.col("deleted").isNull() | (F.col("deleted") != 0)
    sized = (F.coalesce("width", F.lit(0)) > 0) & (F.coalesce("height", F.lit(0)) > 0)
    return known.select("face_id", F.when(gone, "lost").when(sized, "ok").otherwise("repairable").alias("state"))


def face_boxes(faces: DataFrame, photos: DataFrame) -> DataFrame:
    """face_id, space, photo_id and the box as parts of its photo, null where the photo's size is unknown."""
    dims = photos.select("space", F.col("id").alias("photo_id"), "width", "height")
    box = S.normalized_box(*(F.col(c) for c in ("x", "y", "w", "h", "width", "height")))
    return faces.join(dims, ["space", "photo_id"]).select("face_id", "space", "photo_id", *(F.round(c, 6).alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"), strict=True)))


def top_pick(photos: DataFrame) -> DataFrame:
    """space, id, link_id: the pick of the photo's stack, else itself."""
    return photos.select("space", "id", F.coalesce("similar_top_pick", "id").alias("link_id"))


def search_persons(persons: DataFrame, needle: str, limit: int = 25) -> DataFrame:
    """Live persons whose name contains the text, wildcards as they are; largest first."""
    named = live(persons).filter(F.lower("name").like(f"%{needle.lower()}%"))
    return named.orderBy(F.desc_nulls_last("item_count"), "name", "id").limit(max(1, min(25, limit)))


def suggest_persons(persons: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    return live(persons).filter(F.lower("name").startswith(prefix.lower())).orderBy("name", "id").limit(limit)


def page(df: DataFrame, key: str, limit: int, offset: int) -> DataFrame:
    return df.orderBy(key).offset(max(0, offset)).limit(max(1, min(500, limit)))


def complete_models(vectors: DataFrame) -> DataFrame:
    """Rows of faces that have every model there is in the table."""
    n = vectors.agg(F.count_distinct("model").alias("need"))
    have = vectors.groupBy("face_id").agg(F.count_distinct("model").alias("have"))
    return vectors.join(have.join(F.broadcast(n), F.col("have") == F.col("need"), "left_semi"), "face_id", "left_semi")


def person_faces(faces: DataFrame, labels: DataFrame, n: int = 8) -> DataFrame:
    """person, rank, face_id: a person's best faces, unknown quality as 0, smaller id first among equals."""
    order = Window.partitionBy("person_id").orderBy(F.coalesce("quality", F.lit(0.0)).desc(), "face_id")
    ranked = labels.join(faces, "face_id").withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.filter(F.col("rank") <= n).select("person_id", "rank", "face_id")


def best_crops(faces: DataFrame, group: str, n: int = 3) -> DataFrame:
    """The n best faces of a group that have a crop."""
    order = Window.partitionBy(group).orderBy(F.coalesce("quality", F.lit(0.0)).desc(), "face_id")
    return faces.filter("crop_path IS NOT NULL").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n).select(group, "rank", "face_id", "crop_path")


def evict(files: DataFrame, budget: int) -> DataFrame:
    """Files to delete, least recently used first, until the rest fits the budget."""
    total = files.agg(F.sum("bytes").alias("total"))  # one row
    got = running_sum(files, ["atime", "id"], "bytes").crossJoin(F.broadcast(total))
    return got.filter(F.col("total") - F.col("before") > budget).select("id", "bytes")


def restore_gate(faces: DataFrame, trigger_px: float, percentile: float) -> DataFrame:
    """Faces that are small, or below their photo's quality percentile; unknown quality never is."""
    limit = F.percentile("quality", percentile / 100).over(Window.partitionBy("space", "photo_id"))
    faces = faces.withColumn("limit", limit)
    small = F.coalesce(F.least("w", "h") < trigger_px, F.lit(False))
    return faces.select("face_id", (small | F.coalesce(F.col("quality") < F.col("limit"), F.lit(False))).alias("restore"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], **fixed: Column) -> DataFrame:
    """old with the rows of new: of matched and new rows `columns` come from new, even if null, and `fixed` are set; other columns stay."""
    a, b = old.alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    joined = a.join(b, keys, "full_outer")
    pick = lambda c: F.when(F.col("b._new"), fixed[c] if c in fixed else F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return joined.select(*[F.col(c) if c in keys else pick(c).alias(c) if c in columns or c in fixed else F.col(f"a.{c}") for c in old.columns])


def vanish(old: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """old with deleted = 1 on live rows that this pass didn't see."""
    got = old.join(seen.select(*keys).distinct().withColumn("_seen", F.lit(True)), keys, "left")
    return got.withColumn("deleted", F.when(F.col("_seen").isNull() & (F.col("deleted") == 0), 1).otherwise(F.col("deleted")).cast("long")).select(*old.columns)


def replace_groups(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose group isn't in new, and all distinct rows of new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.distinct())


def set_picks(photos: DataFrame, groups: DataFrame) -> DataFrame:
    """photos with similar_top_pick from groups (space, top_pick, members); all others null; unknown members are nothing."""
    picks = groups.filter("members IS NOT NULL").select("space", F.explode("members").alias("id"), F.col("top_pick").alias("pick")).groupBy("space", "id").agg(F.max("pick").alias("pick"))
    return photos.drop("similar_top_pick").join(picks, ["space", "id"], "left").withColumnRenamed("pick", "similar_top_pick").select(*photos.columns)
