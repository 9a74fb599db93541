"""Category trees as paths ``A > B > C``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.schemas import UNCATEGORIZED

DEPTH = 3
# Categories that a later release calls otherwise, as (old prefix, new prefix).
RENAMES = (
    ("Apparel & Accessories > Clothing > Baby & Toddler Clothing", "Apparel & Accessories > Clothing > Baby & Children's Clothing"),
    ("Apparel & Accessories > Clothing > Boys' Underwear", "Apparel & Accessories > Clothing > Baby & Children's Clothing > Baby & Children's Underwear > Boys' Underwear"),
    ("Apparel & Accessories > Clothing > Girls' Underwear", "Apparel & Accessories > Clothing > Baby & Children's Clothing > Baby & Children's Underwear > Girls' Underwear"),
    ("Apparel & Accessories > Clothing > Uniforms", "Apparel & Accessories > Clothing > Uniforms & Workwear"),
    ("Apparel & Accessories > Clothing Accessories > Baby & Toddler Clothing Accessories", "Apparel & Accessories > Clothing Accessories > Baby & Children's Clothing Accessories"),
    ("Apparel & Accessories > Shoes > Baby & Toddler Shoes", "Apparel & Accessories > Shoes > Baby & Children's Shoes"),
    ("Baby & Toddler > Nursing & Feeding > Baby Bottle Nipples & Liners", "Baby & Toddler > Nursing & Feeding > Feeding Essentials > Baby Bottle Nipples & Liners"),
    ("Baby & Toddler > Nursing & Feeding > Baby Bottles", "Baby & Toddler > Nursing & Feeding > Feeding Essentials > Baby Bottles"),
    ("Baby & Toddler > Nursing & Feeding > Bibs", "Baby & Toddler > Nursing & Feeding > Feeding Essentials > Bibs"),
    ("Baby & Toddler > Nursing & Feeding > Sippy Cups", "Baby & Toddler > Nursing & Feeding > Feeding Essentials > Sippy Cups"),
    ("Business & Industrial > Medical > Scrubs", "Apparel & Accessories > Clothing > Uniforms & Workwear > Scrubs"),
    ("Furniture > Cabinets & Storage > Closets > Closet Rods", "Furniture > Cabinets & Storage > Closet Parts & Accessories > Closet Rods"),
    ("Furniture > Cabinets & Storage > Closets > Closet Shelves", "Furniture > Cabinets & Storage > Closet Parts & Accessories > Closet Shelves"),
)
_HEADER = re.compile(r"^#.*Categories:\s*(\S+)")


def parse(lines: DataFrame) -> tuple[str, DataFrame]:
    """(version, paths) of a release's lines (number from 1, value): a header with the version, then
    ``gid : path``; blank and comment lines aside. Paths of at most DEPTH levels, in file order, as (number,
    path, depth). Raises on repeated paths, missing parents and empty names, with the line's number."""
    head = lines.filter(F.col("value").rlike("^#.*Categories:")).orderBy("number").select("value").first()
    if head is None or not (m := _HEADER.match(head["value"])):
        raise ValueError("no header with a version")
    rows = lines.filter(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    rows = rows.withColumn("at", F.instr("value", " : "))
    if bad := rows.filter("at = 0").orderBy("number").first():
        raise ValueError(f"line {bad['number']}: not gid : path")
    paths = rows.select("number", F.trim(F.expr("substring(value, at + 3)")).alias("path")).withColumn("depth", F.size(F.split("path", C.SEPARATOR)))
    if bad := paths.filter(F.exists(F.split("path", C.SEPARATOR), lambda x: F.trim(x) == "")).orderBy("number").first():
        raise ValueError(f"line {bad['number']}: empty name")
    kept = paths.filter(F.col("depth") <= DEPTH)
    again = kept.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("number"))).filter("nth > 1")
    if bad := again.orderBy("number").first():
        raise ValueError(f"line {bad['number']}: {bad['path']} is there twice")
    parents = kept.select(F.col("path").alias("parent"), F.col("number").alias("parent_number"))
    children = kept.filter("depth > 1").withColumn("parent", C.ancestor(F.col("path"), F.col("depth") - 1))
    orphans = children.join(parents, "parent", "left").filter("parent_number is null or parent_number > number")
    if bad := orphans.orderBy("number").first():
        raise ValueError(f"line {bad['number']}: {bad['path']} stands before its parent")
    return m[1], kept


def load(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """A release from a text file, gzipped or not. Line numbers come from the file as one value: a release
    is small and its lines' order counts."""
    text = spark.read.text(path, wholetext=True)
    return parse(text.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "value")).select((F.col("n") + 1).alias("number"), "value"))


def load_deeper(spark: SparkSession, path: str, version: str, paths: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(category, deeper) of a whole release, which must be of the version that paths come from and have no
    category that they lack."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "value"))
    lines = text.select((F.col("n") + 1).alias("number"), "value")
    head = lines.filter("number = 1").select("value").first()
    m = _HEADER.match(head["value"]) if head else None
    if m is None or m[1] != version:
        raise ValueError(f"{path}: release {m[1] if m else '?'} is not {version}")
    found = lines.filter(~F.startswith("value", F.lit("#")) & (F.instr("value", " : ") > 0))
    below = descendants(found.select(F.trim(F.expr("substring(value, instr(value, ' : ') + 3)")).alias("path")), depth)
    if odd := below.join(paths.select(F.col("path").alias("category")), "category", "left_anti").first():
        raise ValueError(f"{path}: {odd['category']!r} is not in {version}")
    return below


def trim(paths: DataFrame, depth: int) -> DataFrame:
    return paths.filter((F.size(F.split("path", C.SEPARATOR)) <= depth) & (F.col("path") != UNCATEGORIZED))


def descendants(paths: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(category, deeper): the paths below each category of that depth, in order."""
    below = paths.filter(F.size(F.split("path", C.SEPARATOR)) > depth)
    return below.groupBy(C.ancestor(F.col("path"), depth).alias("category")).agg(F.sort_array(F.collect_list("path")).alias("deeper"))


def texts(paths: DataFrame, recipe: str, deeper: DataFrame | None = None) -> DataFrame:
    """(category, text) that a category is known by: its path; its names joined; or, deeper, its path and
    all paths below."""
    if recipe == "path":
        return paths.select(F.col("path").alias("category"), F.col("path").alias("text"))
    if recipe == "joined":
        return paths.select(F.col("path").alias("category"), F.array_join(F.split("path", C.SEPARATOR), " ").alias("text"))
    below = deeper.select("category", F.explode("deeper").alias("text"))
    return texts(paths, "path").unionByName(below)


def renamed(items: DataFrame, renames: DataFrame, path: str = "path") -> DataFrame:
    """items with ``renamed``: the path with its longest renamed prefix replaced, else null. An equality join
    on every prefix of a path: no theta join however long the rename table."""
    each = items.select(F.col(path).alias("p")).distinct().withColumn("names", F.split("p", C.SEPARATOR))
    each = each.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("names")))).withColumn("old", F.array_join(F.expr("slice(names, 1, depth)"), C.SEPARATOR))
    best = each.join(renames.select("old", "new"), "old").groupBy("p").agg(F.max_by(F.struct("old", "new"), F.length("old")).alias("r"))
    best = best.select("p", F.concat(F.col("r.new"), F.expr("substring(p, length(r.old) + 1)")).alias("renamed"))
    return items.join(best, F.col(path) == F.col("p"), "left").drop("p")


def mapped(items: DataFrame, paths: DataFrame, renames: DataFrame, path: str = "path") -> DataFrame:
    """items with ``category``: the renamed path's ancestor if the taxonomy has it, else the path's own."""
    rows = renamed(items, renames, path).withColumn("c1", C.ancestor(F.col("renamed"), DEPTH)).withColumn("c2", C.ancestor(F.col(path), DEPTH))
    known = paths.select(F.col("path").alias("known")).distinct()
    rows = rows.join(known.withColumnRenamed("known", "k1"), F.col("c1") == F.col("k1"), "left").join(known.withColumnRenamed("known", "k2"), F.col("c2") == F.col("k2"), "left")
    return rows.withColumn("category", F.coalesce("k1", "k2")).drop("c1", "c2", "k1", "k2", "renamed")


def unknown(labels: DataFrame, paths: DataFrame, column: str = "category") -> DataFrame:
    """Labels that are not in the taxonomy."""
    known = paths.select(F.col("path").alias(column))
    return labels.filter(F.col(column) != UNCATEGORIZED).join(known, column, "left_anti")
