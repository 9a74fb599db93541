import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.schemas import CONTENT


@pytest.mark.parametrize("merchant,product,want", [("m_1", "SKU-123", 21), ("m_1", "sku-123", 63), ("m_42", "T-shirt/red/M", 1), ("m_42", "漢字-é", 15), ("m_9", "", 5), ("a/b", "x", None)])
def test_partitions(spark, merchant, product, want):
    df = spark.createDataFrame([(merchant, product)], "m string, p string")
    assert df.select(C.partition_of("m", "p")).first()[0] == want


def test_blocks_are_the_owners(spark):
    for workers in (1, 3, 4, 7, 64):
        rows = spark.range(64).select(C.owner("id", workers).alias("w"), "id").groupBy("w").agg(F.min("id").alias("a"), F.max("id").alias("b"))
        first, after = C.owned(F.col("w"), F.lit(workers))
        assert rows.filter((first != F.col("a")) | (after != F.col("b") + 1)).isEmpty()


@pytest.mark.parametrize("attributes", [{}, {"b": "1", "a": "2"}, {"é": 'quote " back \\ slash /', "z": "line\nfeed\t\x01 😀"}])
def test_canonical_json(spark, attributes):
    content = {"title": "Reḋ shirt", "description": "", "price_micros": 1_000_000, "currency": "USD", "availability": "in_stock", "attributes": attributes}
    row = spark.createDataFrame([(tuple(content[f.name] for f in CONTENT),)], "c " + CONTENT.simpleString()).select(C.canonical(F.col("c")).alias("j"), C.content_hash(F.col("c")).alias("h"), C.attributes_text(F.col("c.attributes")).alias("a")).first()
    want = json.dumps(content, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert row["j"] == want and row["h"] == hashlib.sha256(want.encode()).hexdigest()
    assert row["a"] == json.dumps(attributes, sort_keys=True, ensure_ascii=False)


def test_tombstones_hash_null(spark):
    row = spark.createDataFrame([(None,)], "c " + CONTENT.simpleString()).select(C.content_hash(F.col("c"))).first()
    assert row[0] == hashlib.sha256(b"null").hexdigest()


def test_ids_hold_their_time(spark):
    row = spark.createDataFrame([(1_700_000_000_000, "x")], "ms long, s string").select(C.uuid7(F.col("ms"), F.col("s")).alias("id")).select("id", C.uuid_ms(F.concat(F.lit("backfill-"), "id")).alias("ms"), C.hour(C.uuid_ms(F.col("id"))).alias("h")).first()
    import uuid

    assert uuid.UUID(row["id"]).version == 7 and row["ms"] == 1_700_000_000_000 and row["h"] == "2023-11-14T22"


@pytest.mark.parametrize("text,n,want", [("short", 10, "short"), ("one two three", 8, "one two"), ("one two", 7, "one two"), ("unbroken", 4, "unbr"), ("ab  cd", 3, "ab"), (" x", 1, " ")])
def test_cut(spark, text, n, want):
    assert spark.createDataFrame([(text,)], "t string").select(C.cut(F.col("t"), n)).first()[0] == want


@pytest.mark.parametrize("text,want", [("the shirt with a pocket", True), ("Rotes Hemd mit der Tasche und für", False), ("camisa con los botones", False), ("赤いシャツ", False), ("SKU-123 4x4", True), ("", True), ("naïve café for the", False)])
def test_english(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(C.english(F.col("t"))).first()[0] is want


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>").select(C.unit(F.col("a")).alias("a"), C.unit(F.col("b")).alias("b"), C.dot(F.col("a"), F.col("a")).alias("d")).first()
    assert row["a"] == pytest.approx([0.6, 0.8]) and row["b"] == [0.0, 0.0] and row["d"] == 25
