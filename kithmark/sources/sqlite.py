"""Tables of SQLite files: ``spark.read.format("sqlite").option("table", name).option("key", column).load(folder)``.

A folder holds files with the same table, as many tasks have written. Each file is read in ranges of an integer key, and what the query filters is
filtered there by SQL (with ``spark.sql.python.filterPushdown.enabled``); ``columns`` reads some columns only. Written files appear under their names when the job commits.
"""

from __future__ import annotations

import sqlite3
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from uuid import uuid4

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from .tail import located

#: Spark's types of SQLite's declared ones.
TYPES = {"INTEGER": LongType(), "REAL": DoubleType(), "TEXT": StringType(), "BLOB": BinaryType()}
DECLARED = {"tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "boolean": "INTEGER", "float": "REAL", "double": "REAL", "string": "TEXT", "binary": "BLOB"}
COMPARED = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def files_of(path: str) -> list[str]:
    system, base = located(path)
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".db") and not f.base_name.startswith("."))


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


@dataclass
class Span(ds.InputPartition):
    """Rows of a file with key from `low` up to, but not including, `high`; those without a key are in the span without `low`."""

    path: str
    low: int | None
    high: int | None


class SqliteSource(ds.DataSource):
    """Options: path (a folder on a file system that all executors mount), table, key (an integer column), span (keys of a task), columns (names with commas between)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        files = files_of(self.options["path"])
        if not files:
            raise ValueError(f"no .db file in {self.options['path']}")
        with opened(files[0]) as c:
            known = {name: TYPES.get(kind.upper(), StringType()) for _, name, kind, *_ in c.execute(f"PRAGMA table_info({quoted(self.options['table'])})")}
        names = [x.strip() for x in self.options["columns"].split(",")] if "columns" in self.options else list(known)
        return StructType([StructField(n, known[n]) for n in names])

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return SqliteReader(self.options["path"], self.options["table"], self.options["key"], int(self.options.get("span", 1_000_000)), schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> ds.DataSourceWriter:
        return SqliteWriter(self.options["path"], self.options["table"], schema)


class SqliteReader(ds.DataSourceReader):
    def __init__(self, path: str, table: str, key: str, span: int, columns: list[str]):
        self.path, self.table, self.key, self.span, self.columns = path, table, key, span, columns
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Comparisons, IN, IS NULL and IS NOT NULL of plain columns go into the SQL; others stay with Spark."""
        for f in filters:
            column = quoted(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if column and type(f) in COMPARED and isinstance(f.value, int | float | str):
                self.where.append(f"{column} {COMPARED[type(f)]} ?")
                self.values.append(f.value)
            elif column and isinstance(f, ds.In) and f.value and all(isinstance(v, int | float | str) for v in f.value):
                self.where.append(f"{column} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif column and isinstance(f, ds.IsNotNull | ds.IsNull):
                self.where.append(f"{column} IS {'NOT ' if isinstance(f, ds.IsNotNull) else ''}NULL")
            else:
                yield f

    def partitions(self) -> list[Span]:
        out = []
        for path in files_of(self.path):
            with opened(path) as c:
                low, high = c.execute(f"SELECT min({quoted(self.key)}), max({quoted(self.key)}) FROM {quoted(self.table)}").fetchone()
            cuts = list(range(low + self.span, high + 1, self.span)) if low is not None else []
            out += [Span(path, a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        key, where, values = quoted(self.key), list(self.where), list(self.values)
        if partition.low is not None:
            where.append(f"{key} >= ?")
            values.append(partition.low)
        if partition.high is not None:
            where.append(f"({key} < ?{' OR ' + key + ' IS NULL' if partition.low is None else ''})")
            values.append(partition.high)
        said = f"SELECT {', '.join(map(quoted, self.columns))} FROM {quoted(self.table)}" + (" WHERE " + " AND ".join(where) if where else "")
        with opened(partition.path) as c:
            yield from c.execute(said, values)


@dataclass
class Written(ds.WriterCommitMessage):
    path: str


class SqliteWriter(ds.DataSourceWriter):
    """Each task makes a file of its own and puts it into the folder under a hidden name; commit gives it its name, so a task that runs twice leaves one file."""

    def __init__(self, path: str, table: str, schema: StructType):
        self.path, self.table = path, table
        self.columns = [(f.name, DECLARED.get(f.dataType.simpleString(), "TEXT")) for f in schema.fields]

    def write(self, rows: Iterator[Row]) -> Written:
        system, base = located(self.path)
        system.create_dir(base, recursive=True)
        target = f"{base}/.{uuid4().hex}.db"
        with tempfile.TemporaryDirectory() as own:  # SQLite needs a file that it can seek; a finished one is copied
            with sqlite3.connect(f"{own}/part.db") as c:
                c.execute(f"CREATE TABLE {quoted(self.table)} ({', '.join(f'{quoted(n)} {kind}' for n, kind in self.columns)})")
                c.executemany(f"INSERT INTO {quoted(self.table)} VALUES ({', '.join('?' * len(self.columns))})", (tuple(r) for r in rows))
            c.close()
            fs.copy_files(f"{own}/part.db", target, fs.LocalFileSystem(), system)
        return Written(target)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = located(self.path)
        for k, done in enumerate(m for m in messages if m):
            folder, _, name = done.path.rpartition("/")
            system.move(done.path, f"{folder}/part-{k:05d}-{name[1:]}")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = located(self.path)
        for done in messages:
            if done:
                system.delete_file(done.path)


def read_table(spark: SparkSession, folder: str, table: str, key: str, columns: list[str] | None = None, span: int = 1_000_000) -> DataFrame:
    """A table of a folder of SQLite files, by ranges of `span` keys; filters go to the files."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("sqlite").option("table", table).option("key", key).option("span", span)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(folder)


def write_table(df: DataFrame, folder: str, table: str) -> None:
    df.sparkSession.dataSource.register(SqliteSource)
    df.write.format("sqlite").mode("append").option("table", table).save(folder)
