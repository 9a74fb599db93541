"""Changes for load tests: each a function of the seed and its number alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = ["red", "blue", "green", "small", "large", "cotton", "steel", "light"]
THINGS = ["shirt", "mug", "lamp", "chair", "bag", "watch"]


def changes(spark: SparkSession, n: int, seed: int, merchants: int = 10, unique_text: bool = False) -> DataFrame:
    """n upserts of n keys: nth, merchant_id, merchant_product_id, source_version, op, listing (JSON text)."""
    pick = lambda words, salt: F.get(F.array(*map(F.lit, words)), F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(len(words))).cast("int"))
    title = F.concat_ws(" ", F.initcap(pick(WORDS, 1)), pick(WORDS, 2), pick(THINGS, 3), *([F.col("id").cast("string")] if unique_text else []))
    listing = F.struct(title.alias("title"), F.lit("").alias("description"), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(10**9)) + 1).alias("price_micros"), F.lit("USD").alias("currency"), F.lit("in_stock").alias("availability"), F.create_map(F.lit("seed"), F.lit(str(seed))).alias("attributes"))
    return spark.range(n).select(F.col("id").cast("int").alias("nth"), F.concat(F.lit("m_"), F.col("id") % merchants).alias("merchant_id"), F.concat(F.lit("p"), "id").alias("merchant_product_id"), F.lit(1).cast("long").alias("source_version"), F.lit("upsert").alias("op"), F.to_json(listing).alias("listing"))


def requests(rows: DataFrame, size: int) -> DataFrame:
    """rows with the request that each belongs to."""
    return rows.withColumn("request", F.floor(F.col("nth") / size)).withColumn("change_index", F.col("nth") % size)
