"""Secret scans over an incremental ledger of content-addressed blobs.

A blob is a distinct text, addressed by its SHA-256. The ledger is two tables in the shared folder: one with a
row for each blob and rule version that was scanned, findings or not, and one with the history of every path: the blob that it
held in each scan in which that changed. A scan takes only the pairs of blob and rule version that the ledger lacks, appends them,
and joins all findings back to every path (row) whose content is that blob. Scanning a new version of the rules, or a
later state of the table, touches nothing that was scanned before under the same version.

Texts are scanned where they are read; only texts that several rows share are brought together first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exists, new_folder, small, written

# The kinds in their order, their patterns, and which part needs how many characters.
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, False),
    ("hex", r"[0-9a-f]+", 0, 32, False),
)
#: Where a run too short for its kind can't hide a longer match, the least length goes into the pattern.
FAST = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}


@dataclass(frozen=True)
class Rules:
    """kind, pattern, group, least characters, letters in either case; version is a digest of them."""

    rules: tuple = RULES
    fast: dict = field(default_factory=lambda: dict(FAST))

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.rules, sorted(self.fast.items()))).encode()).hexdigest()[:12]


def scanner(rules: Rules):
    """A function from a text to [(start, rank of the kind, kind, end)], by start, then kind as listed."""
    ready = [(k, kind, re.compile(rules.fast.get(kind, pattern), re.ASCII | (re.IGNORECASE if either else 0)), group, least) for k, (kind, pattern, group, least, either) in enumerate(rules.rules)]

    def scan(text: str) -> list[tuple[int, int, str, int]]:
        return sorted((m.start(), k, kind, m.end()) for k, kind, regex, group, least in ready for m in regex.finditer(text) if m.end(group) - m.start(group) >= least)

    return scan


FINDINGS = "blob string, rule_version string, n_found long, spans string"


def scan_blobs(blobs: DataFrame, rules: Rules) -> DataFrame:
    """blob, text -> one ledger row per blob; spans: kind:start:end, comma-joined (code points, end exclusive)."""
    version = rules.version

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for batch in batches:
            found = [scan(t) for t in batch.column("text").to_pylist()]
            spans = [",".join(f"{kind}:{a}:{b}" for a, _, kind, b in x) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array([version] * len(found), pa.string()), pa.array(map(len, found), pa.int64()), pa.array(spans, pa.string())], names=["blob", "rule_version", "n_found", "spans"])

    return blobs.select("blob", "text").mapInArrow(run, FINDINGS)


HISTORY = "path string, blob string, scan long"
#: Blobs that several rows share, up to which they are broadcast.
SHARED = 2_000_000


class Ledger:
    """The ledger's tables below a folder: `scanned` (FINDINGS) and `history` (HISTORY), to which each scan appends.

    A folder that has none yet starts an empty ledger; without a path it is a new folder. Scans that overlap may each append what both found; readers take it once.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path.rstrip("/") if path else new_folder(spark, "ledger")

    def _table(self, name: str, schema: str) -> DataFrame:
        there = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(there) if exists(self.spark, there) else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        return self._table("scanned", FINDINGS)

    def history(self) -> DataFrame:
        return self._table("history", HISTORY)

    def findings(self, rules: Rules) -> DataFrame:
        """path, scan, blob, spans: every version that any path ever had and that holds a finding under these rules."""
        found = self.rows().filter((F.col("rule_version") == rules.version) & (F.col("n_found") > 0)).select("blob", "spans").distinct()
        return self.history().join(found, "blob").select("path", "scan", "blob", "spans")

    def scan(self, docs: DataFrame, rules: Rules, keep_history: bool = True) -> tuple[DataFrame, DataFrame]:
        """Scans what the ledger lacks and appends it. Returns (row keys with blob, all findings under these rules)."""
        named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
        paths = written(named.select("doc_id", "blob"), "ledger-paths")
        blobs = paths.groupBy("blob").agg(F.count("*").alias("n"))
        before = self.rows().filter(F.col("rule_version") == rules.version).select("blob")
        if before.isEmpty():
            fresh = named
        else:
            unseen = written(blobs.join(before, "blob", "left_anti"), "ledger-unseen")
            fresh, blobs = named.join(small(unseen.select("blob"), SHARED), "blob", "left_semi"), unseen
        # What one row has is scanned in place; what several have comes together first, each once from a task.
        shared = small(written(blobs.filter("n > 1").select("blob"), "ledger-shared"), SHARED)
        alone = scan_blobs(fresh.join(shared, "blob", "left_anti"), rules)
        several = scan_blobs(fresh.join(shared, "blob", "left_semi").select("blob", "text").distinct(), rules)
        alone.unionByName(several).write.mode("append").parquet(f"{self.path}/scanned")
        if keep_history:
            self._record(paths)
        return paths, self.rows().filter(F.col("rule_version") == rules.version)

    def _record(self, paths: DataFrame) -> None:
        """Appends the blobs of paths that they did not have in the scan before."""
        old = self.history()
        scan = (old.agg(F.max("scan")).first()[0] or 0) + 1
        now = paths.select(F.col("doc_id").cast("string").alias("path"), "blob").filter("path IS NOT NULL").distinct()
        last = old.groupBy("path").agg(F.max_by("blob", "scan").alias("blob"))
        now.join(last, ["path", "blob"], "left_anti").withColumn("scan", F.lit(scan).cast("long")).select("path", "blob", "scan").write.mode("append").parquet(f"{self.path}/history")


def scan_secrets(docs: DataFrame, rules: Rules | None = None, ledger: Ledger | None = None) -> DataFrame:
    """One row per row of docs: doc_id, blob, rule_version and spans.

    Null text is the empty blob; a null doc_id and repeated rows each get their row (without an id, none in the
    ledger's history); no rows from an empty table. Whole texts are scanned, however long. Other columns of docs are ignored.
    """
    rules = rules or Rules()
    paths, findings = (ledger or Ledger(docs.sparkSession)).scan(docs, rules, keep_history=ledger is not None)
    hits = findings.filter("n_found > 0").select("blob", "spans").distinct()
    return paths.join(hits, "blob", "left").select("doc_id", "blob", F.lit(rules.version).alias("rule_version"), F.coalesce("spans", F.lit("")).alias("spans"))


#: Setting of the session that names a ledger's folder which calls of the query share; unset: each call scans everything.
SETTING = "spark.kithmark.ledger"


def op4(spark, sf_dir: str) -> DataFrame:
    kept = spark.conf.get(SETTING, None)
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), Rules(), Ledger(spark, kept) if kept else None)
    each = F.when(F.col("spans") == "", F.array().cast("array<string>")).otherwise(F.split("spans", ","))
    count = lambda kind: F.size(F.filter(each, lambda s: s.startswith(f"{kind}:"))).cast("long")
    return found.select("doc_id", *(count(kind).alias(f"n_{kind}") for kind, *_ in RULES), F.sha2("spans", 256).alias("base_sha256"), "spans")
