"""Sources and sinks of the library: paged services, item documents, SQL tables, event logs, caches."""

from __future__ import annotations

import bisect
import functools
import itertools
import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ITEM = "id bigint, filename string, filesize bigint, folder_id bigint, time bigint, indexed_time bigint, type string, additional struct<thumbnail:struct<cache_key:string,unit_id:bigint>,resolution:struct<width:bigint,height:bigint>,orientation:bigint,person:array<struct<id:bigint>>>"


class Page(InputPartition):
    def __init__(self, offset: int, limit: int):
        self.offset, self.limit = offset, limit


class PagedSource(DataSource):
    """A service that answers (offset, limit) with JSON rows; each partition reads one range of pages until one is short.

    Options: fetch (module:function of (offset, limit, options) -> list of dicts), total (about how many rows there are), page_size, pages (of a partition).
    If there are rows beyond `total`, pages at growing distances are asked for until one is empty, so that what lies between is read side by side, too. The last partition reads on until a page is short.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    #: Partitions of the rows beyond the total, about: a partition has as many pages more as there are more rows.
    BEYOND = 256

    def __init__(self, options: dict):
        self.options = options
        self.size = int(options.get("page_size", 500))

    def fetch(self) -> Callable[[int, int, dict], list[dict]]:
        import importlib

        module, _, name = self.options["fetch"].partition(":")
        return getattr(importlib.import_module(module), name)

    def partitions(self) -> list[Page]:
        span = self.size * int(self.options.get("pages", 20))
        total, fetch = max(1, int(self.options["total"])), self.fetch()
        known = len(range(0, total, span)) * span  # where the ranges end that the total asks for
        some = lambda pages: bool(fetch(known + pages * self.size, self.size, self.options))
        low, high = 0, 1  # pages after the known ones; the page at `low` was seen, the one at `high` is empty at last
        if not some(0):
            high = 0
        while high and some(high):
            low, high = high, 2 * high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if some(middle) else (low, middle)
        wide = span * max(1, -(-high * self.size // (span * self.BEYOND)))
        starts = [(at, span) for at in range(0, known, span)] + [(at, wide) for at in range(known, known + high * self.size, wide)]
        return [Page(at, n if i < len(starts) - 1 else 1 << 62) for i, (at, n) in enumerate(starts)]

    def read(self, partition: Page) -> Iterator[tuple[str]]:
        fetch, size = self.fetch(), self.size
        for at in range(partition.offset, partition.offset + partition.limit, size):
            rows = fetch(at, size, self.options)
            yield from ((json.dumps(r),) for r in rows)
            if len(rows) < size:
                return


@functools.lru_cache(maxsize=4)
def _groups(table: str, changed: str) -> tuple[list, list[int]]:
    """A Parquet table's groups of rows, in order, and where each ends."""
    from pyarrow import dataset

    groups = [g for f in dataset.dataset(table, format="parquet").get_fragments() for g in f.split_by_row_group()]
    return groups, list(itertools.accumulate(g.row_groups[0].num_rows for g in groups))


@functools.lru_cache(maxsize=2)
def _group(table: str, changed: str, i: int, columns: str):
    return _groups(table, changed)[0][i].to_table(columns=columns.split(","))


def _state(table: str) -> str:
    """Names, sizes and times of a table's files: what was read of it is kept as long as these are the same."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(table) if "://" in table else (fs.LocalFileSystem(), table)
    found = system.get_file_info(path)
    found = [found] if found.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
    return str([(f.path, f.size, f.mtime_ns) for f in found])


def table_page(offset: int, limit: int, options: dict) -> list[dict]:
    """Rows `offset` to `offset + limit` of a Parquet table (option `table`, columns in `columns`), as a service over it would answer.

    A page reads the groups of rows that it lies in, and pages side by side share them.
    """
    table, changed = options["table"], _state(options["table"])
    ends, out = _groups(table, changed)[1], []
    for i in range(bisect.bisect_right(ends, offset), len(ends)):
        start = ends[i - 1] if i else 0
        if start >= offset + limit:
            break
        at = max(offset - start, 0)
        out += _group(table, changed, i, options["columns"]).slice(at, offset + limit - start - at).to_pylist()
    return out


def items(lines: DataFrame, space: str) -> DataFrame:
    """Item documents (value: JSON) as flat rows of photos."""
    x = F.from_json("value", ITEM)
    return lines.select(F.lit(space).alias("space"), x.alias("x")).filter("x.id IS NOT NULL").select(
        "space", "x.id", "x.filename", "x.filesize", "x.folder_id", F.col("x.time").alias("taken"), "x.indexed_time", "x.type", "x.additional.thumbnail.cache_key", "x.additional.thumbnail.unit_id",
        "x.additional.resolution.width", "x.additional.resolution.height", "x.additional.orientation", F.transform("x.additional.person", lambda p: p["id"]).alias("person_ids"),
    )


def similar_groups(lines: DataFrame) -> DataFrame:
    """id, member of groups (value: JSON with similar_items on the top pick only)."""
    x = F.from_json("value", "id bigint, similar_items array<bigint>")
    return lines.select(x.alias("x")).filter("x.similar_items IS NOT NULL").select(F.col("x.id").alias("id"), F.explode("x.similar_items").alias("member"))


def floats(blob: Column) -> Column:
    """Little-endian float32 bytes as array<float>, without Python: sign, exponent and fraction from each four bytes."""
    word = lambda i: F.conv(F.concat(*(F.hex(F.substring(blob, i * 4 + k, 1)) for k in (4, 3, 2, 1))), 16, 10).cast("long")

    def value(w: Column) -> Column:
        sign = F.when(F.shiftright(w, 31) == 1, -1.0).otherwise(1.0)
        exponent, fraction = F.shiftright(w, 23).bitwiseAND(F.lit(255)), w.bitwiseAND(F.lit((1 << 23) - 1)).cast("double") / (1 << 23)
        return F.when(exponent == 0, sign * fraction * 2.0**-126).otherwise(sign * (1 + fraction) * F.pow(F.lit(2.0), exponent - 127)).cast("float")

    n = F.floor(F.octet_length(blob) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.array(word(i)), value)[0])).otherwise(F.array().cast("array<float>"))


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 32) -> DataFrame:
    """A table of a served database, one range of the key for each partition."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


def copy_tables(spark: SparkSession, source: str, target: str, names: list[str]) -> None:
    """Tables from folder to folder; a target that exists is an error."""
    for name in names:
        spark.read.parquet(f"{source}/{name}.parquet").write.mode("errorifexists").parquet(f"{target}/{name}.parquet")


def graph_signature(vectors: DataFrame, k: int, weights: dict[str, float]) -> str:
    """Name of a cached graph: digest of the sum of the vectors' digests (id, and the parts in millionths), of k and of the weights.

    The order doesn't matter, so nothing is gathered; another vector of an id gives another name.
    """
    parts = F.array_join(F.transform("vec", lambda x: F.floor(x.cast("double") * 1_000_000.0).cast("string")), ",")
    own = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), parts)), 1, 13), 16, 10).cast("decimal(38,0)")
    row = vectors.agg(F.count("*").cast("string").alias("n"), F.coalesce(F.sum(own), F.lit(0)).cast("string").alias("s"))
    return row.select(F.substring(F.sha1(F.concat_ws(":", "n", "s", F.lit(f"{k}:{sorted(weights.items())}"))), 1, 16)).first()[0]


def table_digest(df: DataFrame) -> Column:
    """An aggregate that tells a table's rows, in any order, repeats included, from others'."""
    row = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    return F.concat_ws(":", F.count("*").cast("string"), F.sum(row.cast("decimal(38,0)")).cast("string"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).cast("string"))


def original_path(item: Column) -> Column:
    return F.concat(F.lpad(F.lower(F.hex(F.pmod(item, F.lit(256)))), 2, "0"), F.lit("/"), item.cast("string"))
