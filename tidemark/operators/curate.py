"""Datasets from raw rows: usable rows, first-seen copies, leak-free and held-out splits, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import taxonomy

REASONS = ["malformed", "non_english", "unmapped", "duplicates", "leaks"]


def shaped(rows: DataFrame, source: str) -> DataFrame:
    """rows (n: input order, title, description, category) as items with an id of the stored text; null id
    where a row cannot be a listing."""
    fine = F.col("title").isNotNull() & F.col("description").isNotNull() & (F.trim("title") != "")
    rows = rows.withColumn("fine", fine).withColumn("title", C.cut(F.trim("title"), 150)).withColumn("description", F.substring(F.trim("description"), 1, 5000))
    return rows.withColumn("id", F.when(F.col("fine"), C.shape_id(F.col("title"), F.col("description")))).withColumn("source", F.lit(source)).drop("fine")


def usable(rows: DataFrame, source: str, paths: DataFrame, renames: DataFrame) -> DataFrame:
    """Every row with the reason it is dropped for (null: kept), the first that applies: malformed,
    non_english, unmapped, duplicates (not the first of its id among rows that get so far)."""
    items = taxonomy.mapped(shaped(rows, source).withColumn("raw", F.col("category")).drop("category"), paths, renames, "raw")
    early = (
        F.when(F.col("id").isNull() | F.col("raw").isNull(), "malformed")
        .when(~C.english(F.concat_ws(" ", "title", "description")), "non_english")
        .when(F.col("category").isNull(), "unmapped")
    )
    items = items.withColumn("early", early)
    nth = F.row_number().over(Window.partitionBy("id", F.col("early").isNull()).orderBy("n"))
    return items.withColumn("reason", F.when(F.col("early").isNull() & (nth > 1), "duplicates").otherwise(F.col("early"))).drop("early")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return first.select(key, "r.*")


def leak_free(train: DataFrame, test: DataFrame) -> DataFrame:
    """train without what test has, by id or by title in any case."""
    rows = train.join(test.select("id").distinct(), "id", "left_anti")
    titles = test.select(F.lower("title").alias("low")).distinct()
    return rows.join(titles, F.lower(F.col("title")) == F.col("low"), "left_anti")


def seeded(seed: int | str, key: str) -> Column:
    """An order that any SQL engine can compute: a hash of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string")))


def sample(rows: DataFrame, n: int, seed: int | str, key: str, *by: str) -> DataFrame:
    """n rows (of each group): a draw that depends on the seed and the keys alone."""
    line = Window.partitionBy(*by).orderBy(seeded(seed, key), key) if by else None
    if line is None:
        return rows.orderBy(seeded(seed, key), key).limit(n)
    return rows.withColumn("nth_", F.row_number().over(line)).filter(F.col("nth_") <= n).drop("nth_")


def held_out(rows: DataFrame, seed: int | str, key: str, by: str, parts: int = 10) -> DataFrame:
    """rows with ``held``: a tenth of each source, by seeded order."""
    line = Window.partitionBy(by).orderBy(seeded(seed, key), key)
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    return rows.withColumn("held", F.row_number().over(line) <= F.floor(n / parts))


def drop_counts(rows: DataFrame) -> DataFrame:
    """How many rows were read, kept and dropped for each reason, in one pass."""
    each = [F.count_if(F.col("reason") == x).alias(x) for x in REASONS[:-1]]
    return rows.agg(F.count(F.lit(1)).alias("read"), F.count_if(F.col("reason").isNull()).alias("kept"), *each)


def most_common(rows: DataFrame, column: str, n: int = 20) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), column).limit(n)


def build(test: DataFrame, train: DataFrame, paths: DataFrame, renames: DataFrame, *, n: int, seed: int) -> tuple[DataFrame, DataFrame, dict]:
    """(evaluation draw, training rows that share neither id nor title with any usable test row, counts)."""
    test, train = usable(test, "test", paths, renames), usable(train, "train", paths, renames)
    good_test, good_train = (x.filter("reason is null") for x in (test, train))
    kept = leak_free(good_train, good_test)
    counts = drop_counts(test.unionByName(train)).first().asDict()
    counts["leaks"] = good_train.count() - kept.count()
    return sample(good_test, n, seed, "id"), kept, counts
