"""Vectors at rest: an index with its checks, and a cache keyed by what it was computed from."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import UNCATEGORIZED
from tidemark.sources.vtable import Files


class Unsound(ValueError):
    """An index that must not be served."""


def name_of(*parts: str) -> str:
    """The name of what is computed from these parts; another model or text gives another name."""
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:16]


def checked(index: DataFrame, paths: DataFrame, width: int) -> DataFrame:
    """The index (id, vector, label), after one pass that refuses vectors of another width or with values
    that are not finite, and labels that the taxonomy lacks."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bad = index.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vector").isNull() | (F.size("vector") != width)).alias("width"), F.count_if(~finite).alias("finite")).first()
    if not bad["n"] or bad["width"] or bad["finite"]:
        raise Unsound(f"{bad['n']} vectors, {bad['width']} not of width {width}, {bad['finite']} not finite")
    known = paths.select(F.col("path").alias("label"))
    if odd := index.filter(F.col("label") != UNCATEGORIZED).join(known, "label", "left_anti").first():
        raise Unsound(f"label {odd['label']!r} is not in the taxonomy")
    return index


def save(index: DataFrame, folder: str, name: str) -> str:
    """Writes the index under its name; a stale one has another name and is not found."""
    files = Files(index.sparkSession, folder)
    files.make(folder)
    hidden, path = f"{folder}/.{name}", f"{folder}/{name}"
    files.delete(hidden)
    index.select("id", "vector", "label").write.parquet(hidden)
    files.delete(path)
    files.fs.rename(files.path(hidden), files.path(path))
    return path


def load(spark: SparkSession, folder: str, name: str, paths: DataFrame, width: int) -> DataFrame:
    if not Files(spark, folder).exists(f"{folder}/{name}"):
        raise Unsound(f"no index {name}: fit one for this model and training set")
    return checked(spark.read.parquet(f"{folder}/{name}"), paths, width)


def cached(rows: DataFrame, folder: str, name: str, compute) -> DataFrame:
    """compute(rows), kept under its name."""
    files = Files(rows.sparkSession, folder)
    if not files.exists(f"{folder}/{name}/_SUCCESS"):
        compute(rows).write.mode("overwrite").parquet(f"{folder}/{name}")
    return rows.sparkSession.read.parquet(f"{folder}/{name}")
