"""What a clustering run stores: its clusters and their members, and the review items that no earlier run has proposed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ids import consecutive


def stored_clusters(members: DataFrame, mapping: DataFrame) -> DataFrame:
    """cluster, size, space, person_id, fraction, labeled of every cluster; the person only if the cluster is mapped."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    who = [F.when(F.col("mapped"), F.col(c)).alias(c) for c in ("space", "person_id")]
    return sizes.join(mapping.select("cluster", *who, "fraction", "labeled"), "cluster", "left").na.fill({"fraction": 0.0, "labeled": 0})


def merges(within: DataFrame, between: DataFrame) -> DataFrame:
    """a, b: each pair of persons once, from shared clusters (a, b, cluster) and from close ones (a, b, similarity)."""
    return within.select("a", "b").unionByName(between.select("a", "b")).distinct()


def review_items(assigns: DataFrame, reassigns: DataFrame, exemplars: DataFrame, pairs: DataFrame, names: DataFrame, existing: DataFrame, first: int = 1) -> DataFrame:
    """item_id (consecutive from `first`), kind, identity, payload_json, confidence: the run's new rows of the queue.

    assigns: face_id, person_id, kind, confidence; reassigns: face_id, from_person_id, person_id, confidence; exemplars: cluster, size, rank, face_id of new
    persons; pairs: a, b to merge; names: person_id, name; existing: kind (assign, reassign, new_person or merge), identity of what
    was proposed before. A merge of two persons with names is a kind of its own. By kind, then face, cluster or pair.
    """
    named = names.filter(F.trim("name") != "").groupBy("person_id").agg(F.min("name").alias("name"))

    def with_name(df: DataFrame, person: str, name: str) -> DataFrame:
        return df.join(named.select(F.col("person_id").alias(person), F.col("name").alias(name)), person, "left")

    pair = lambda a, b: F.concat_ws(":", F.col(a).cast("string"), F.col(b).cast("string"))
    none = F.lit(None).cast("double")
    a = with_name(assigns, "person_id", "person_name")
    a = a.select(F.lit(1).alias("part"), F.col("face_id").alias("k1"), F.col("person_id").alias("k2"), "kind", F.lit("assign").alias("family"), pair("face_id", "person_id").alias("identity"), F.to_json(F.struct("face_id", "person_id", "person_name")).alias("payload_json"), "confidence")
    r = with_name(with_name(reassigns, "person_id", "person_name"), "from_person_id", "from_person_name")
    r = r.select(F.lit(2).alias("part"), F.col("face_id").alias("k1"), F.col("person_id").alias("k2"), F.lit("reassign").alias("kind"), F.lit("reassign").alias("family"), pair("face_id", "person_id").alias("identity"), F.to_json(F.struct("face_id", "from_person_id", "from_person_name", "person_id", "person_name")).alias("payload_json"), "confidence")
    n = exemplars.groupBy("cluster", "size").agg(F.array_sort(F.collect_list("face_id")).alias("face_ids"))  # a few exemplars of each
    n = n.select(F.lit(3).alias("part"), F.col("cluster").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit("new_person").alias("kind"), F.lit("new_person").alias("family"), F.array_join(F.transform("face_ids", lambda x: x.cast("string")), ",").alias("identity"), F.to_json(F.struct("face_ids", "size")).alias("payload_json"), none.alias("confidence"))
    m = with_name(with_name(pairs, "a", "name_a"), "b", "name_b")
    kind = F.when(F.col("name_a").isNotNull() & F.col("name_b").isNotNull(), "merge_named").otherwise("merge")
    person = lambda c: F.struct(F.col(c).alias("person_id"), F.col(f"name_{c}").alias("name"))
    m = m.select(F.lit(4).alias("part"), F.col("a").alias("k1"), F.col("b").alias("k2"), kind.alias("kind"), F.lit("merge").alias("family"), pair("a", "b").alias("identity"), F.to_json(F.struct(person("a").alias("person_a"), person("b").alias("person_b"))).alias("payload_json"), none.alias("confidence"))
    new = a.unionByName(r).unionByName(n).unionByName(m).join(existing.select(F.col("kind").alias("family"), "identity").distinct(), ["family", "identity"], "left_anti")
    return consecutive(new, ["part", "k1", "k2"], "item_id", first).select("item_id", "kind", "identity", "payload_json", "confidence")
