"""Caches, copies and reports as files, and layered settings."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import graph_signature


def cached_graph(vectors: DataFrame, folder: str, k: int, weights: dict[str, float], build: Callable[[], DataFrame]) -> DataFrame:
    """Neighbours from the folder named by their signature, built and written there first if it has none. Changed vectors have another signature."""
    spark = vectors.sparkSession
    path = f"{folder}/graph_{graph_signature(vectors, k, weights)}"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_grid(frames: list[DataFrame], path: str) -> None:
    """Rows of unlike runs as CSV under the union of their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out.write.mode("overwrite").csv(path, header=True)


def snapshot(df: DataFrame, path: str, files: int | None = None) -> None:
    """A copy in a new folder, in as many files as df has partitions unless `files` says fewer; an existing folder is an error."""
    (df.coalesce(files) if files else df).write.mode("errorifexists").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    """One JSON object a line, added to what is there."""
    events.write.mode("append").json(path)


def disk_usage(spark: SparkSession, path: str) -> DataFrame:
    """n_files and bytes under a folder, without reading the files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return found.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def missing_models(required: DataFrame, present: DataFrame) -> DataFrame:
    return required.join(present, "name", "left_anti")


def layered(*layers: dict[str, Any]) -> dict[str, Any]:
    """Nested settings; the first layer that has a key decides."""
    out: dict[str, Any] = {}
    for layer in reversed(layers):
        for k, v in layer.items():
            out[k] = layered(v, out[k]) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def layered_maps(*layers: Column) -> Column:
    """Settings as maps of text, one row's layers each: the first layer that has a key decides. Null layers have no keys."""
    out = None
    for layer in layers:
        layer = F.coalesce(layer, F.create_map().cast("map<string,string>"))
        out = layer if out is None else F.map_zip_with(out, layer, lambda k, a, b: F.coalesce(a, b))
    return out


def override(text: Column) -> tuple[Column, Column]:
    """(path of keys, value as JSON) of section.key=value: the value is JSON if it is, else a string; null for both without a =."""
    value = F.regexp_extract(text, r"(?s)^[^=]*=(.*)$", 1)
    as_json = F.when(F.try_parse_json(value).isNotNull(), value).otherwise(F.to_json(F.struct(value.alias("v"))))
    as_json = F.when(F.try_parse_json(value).isNull(), F.regexp_replace(as_json, r'(?s)^\{"v":(.*)\}$', "$1")).otherwise(as_json)
    has = text.contains("=")
    return F.when(has, F.split(F.substring_index(text, "=", 1), r"\.")), F.when(has, as_json)


def from_env(env: dict[str, str], prefix: str) -> dict[str, Any]:
    """PREFIX_SECTION__KEY=value as nested settings."""
    out: dict[str, Any] = {}
    for k, v in env.items():
        if k.startswith(prefix):
            out = layered(nested(k.removeprefix(prefix).lower().split("__"), value_of(v)), out)
    return out


def overrides(pairs: list[str]) -> dict[str, Any]:
    """section.key=value as nested settings."""
    out: dict[str, Any] = {}
    for p in pairs:
        k, sep, v = p.partition("=")
        if not sep:
            raise ValueError(f"{p!r} has no value")
        out = layered(nested(k.split("."), value_of(v)), out)
    return out


def nested(keys: list[str], value: Any) -> dict[str, Any]:
    return {keys[0]: nested(keys[1:], value) if keys[1:] else value}


def value_of(text: str) -> Any:
    """JSON if it is, else the text."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def settings_file(path: str) -> dict[str, Any]:
    import tomllib

    return tomllib.loads(Path(path).read_text()) if Path(path).exists() else {}
