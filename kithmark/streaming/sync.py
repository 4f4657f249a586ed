"""Faces of photos kept in step with a source: each batch replaces its photos' faces, once, whatever happens to it.

The table lies in buckets of photos. A batch writes the buckets that it touches into a folder of its own and then puts down one commit file, which names
the folder of every bucket, the batch and how far each space has come. Readers take the last commit; what a batch left without one is written over when it runs again.
"""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tail import located

FACE = "face_id:bigint,person_id:bigint,name:string,x1:double,y1:double,x2:double,y2:double"
#: What the source says of a photo: its faces, none at all, or that it can't be listed.
LISTED = f"space string, photo_id long, failed boolean, faces array<struct<{FACE}>>"
ROWS = "space string, photo_id long, face_id long, person_id long, name string, x1 double, y1 double, x2 double, y2 double, batch long"


class FaceStore:
    """The faces under a folder that driver and executors share, in `buckets` parts."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def last(self) -> dict:
        """The last commit: batch (-1 if there is none), parts (bucket -> its folder), cursor (space -> photo id)."""
        system, base = located(self.folder)
        found = [f for f in system.get_file_info(fs.FileSelector(f"{base}/commits", allow_not_found=True)) if f.extension == "json"]
        if not found:
            return {"batch": -1, "parts": {}, "cursor": {}}
        with system.open_input_stream(max(found, key=lambda f: f.base_name).path) as f:
            return json.loads(f.read())

    def _commit(self, batch: int, parts: dict[str, str], cursor: dict[str, int]) -> None:
        """One file, whole or not there."""
        system, base = located(self.folder)
        system.create_dir(f"{base}/commits", recursive=True)
        with system.open_output_stream(f"{base}/commits/.{batch:012d}") as f:
            f.write(json.dumps({"batch": batch, "parts": parts, "cursor": cursor}).encode())
        system.move(f"{base}/commits/.{batch:012d}", f"{base}/commits/{batch:012d}.json")

    def _read(self, parts: dict[str, str]) -> DataFrame:
        """Rows of those buckets: of a face that several photos have had the last batch's, as it has moved."""
        paths = sorted(f"{self.folder}/{path}" for path in parts.values())
        return self.spark.read.schema(ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], ROWS)

    def faces(self) -> DataFrame:
        newest = F.row_number().over(Window.partitionBy("space", "face_id").orderBy(F.desc("batch"), F.desc("photo_id")))
        return self._read(self.last()["parts"]).withColumn("r", newest).filter("r = 1").drop("r", "batch")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("space", "photo_id"), F.lit(self.buckets))

    def apply(self, listed: DataFrame, batch: int) -> None:
        """Take in a batch (LISTED). For foreachBatch: a batch that was committed before changes nothing.

        Photos that can't be listed keep the faces they had, and the cursor passes them. Of rows that repeat a photo one counts, and of those that repeat a face in a photo, too.
        """
        was = self.last()
        if batch <= was["batch"]:
            return
        rows = listed.filter("space IS NOT NULL AND photo_id IS NOT NULL").withColumn("bucket", self.bucket())
        # In the batch's folder first: what follows reads it several times.
        rows.write.mode("overwrite").parquet(f"{self.folder}/batches/{batch}/listed")
        rows = self.spark.read.schema(f"{LISTED}, bucket long").parquet(f"{self.folder}/batches/{batch}/listed")
        known = rows.filter("NOT failed").dropDuplicates(["space", "photo_id"])
        touched = [str(r.bucket) for r in known.select("bucket").distinct().collect()]  # no more than there are buckets
        new = known.select("space", "photo_id", F.explode("faces").alias("f")).select("space", "photo_id", "f.*").dropDuplicates(["space", "photo_id", "face_id"]).withColumn("batch", F.lit(batch).cast("long"))
        old = self._read({b: was["parts"][b] for b in touched if b in was["parts"]}).join(known.select("space", "photo_id"), ["space", "photo_id"], "left_anti")
        columns = [c.split()[0] for c in ROWS.split(", ")]
        whole = old.select(*columns).unionByName(new.select(*columns)).withColumn("bucket", self.bucket())
        whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/batches/{batch}/faces")
        system, base = located(self.folder)
        there = {f.base_name.removeprefix("bucket=") for f in system.get_file_info(fs.FileSelector(f"{base}/batches/{batch}/faces")) if f.base_name.startswith("bucket=")}
        parts = {b: p for b, p in was["parts"].items() if b not in touched} | {b: f"batches/{batch}/faces/bucket={b}" for b in touched if b in there}
        cursor = was["cursor"] | {r.space: max(r.top, was["cursor"].get(r.space, r.top)) for r in rows.groupBy("space").agg(F.max("photo_id").alias("top")).collect()}  # a row for each space
        self._commit(batch, parts, cursor)

    def waiting(self, photos: DataFrame) -> DataFrame:
        """photos (space, photo_id) beyond the cursor: what an interrupted pass has left."""
        at = self.last()["cursor"]
        reached = F.create_map(*(x for s, n in at.items() for x in (F.lit(s), F.lit(n)))) if at else F.lit(None).cast("map<string,bigint>")
        return photos.filter(F.coalesce(F.col("photo_id") > F.try_element_at(reached, F.col("space")), F.lit(True)))


def follow(listed: DataFrame, store: FaceStore, checkpoint: str):
    """A started query that takes in what there is of a stream of LISTED rows."""
    return listed.writeStream.foreachBatch(store.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
