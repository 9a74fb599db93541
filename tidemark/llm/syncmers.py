"""Document fingerprints from closed syncmers, in DataFrame operations only.

A text's k-mers are its runs of K words. A k-mer is an anchor if the least of its inner runs of S words
(by hash) is its first or its last: a rule that looks at the k-mer alone, so that equal passages have
equal anchors wherever they stand. A fingerprint has every anchor of the text with its position, in order:
none is dropped, whatever the text's length.

Likeness is matched by position: a link is two neighbouring anchors and the distance between them, which is
the same wherever the passage stands; likeness is the share of distinct links in common (Sørensen's index).
A text with one anchor has one link, the anchor itself.

The next document in doc_id order is found without one global sort: keys are cut into ranges at quantiles,
each range at quantiles of its own (at most RANGES of either, by row counts over all rows), and a bucket of
one hot doc_id by its texts' hashes, so that buckets hold about BUCKET_ROWS rows up to RANGES**2 times as
many. Each bucket is given the first document of the bucket after it.

Defined cases: null and empty texts, and those of white space, have no anchors and an empty fingerprint;
a text of fewer than K words is one k-mer and an anchor; two empty fingerprints are alike (1.0), an empty and
another not (0.0); rows of equal doc_id are ordered by their text's hash; a null doc_id counts as the least
long; a document alone is its own next; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import shared

K, S = 4, 2
#: Ranges of doc_ids, and parts of a range, at most; rows in a bucket, about.
RANGES, BUCKET_ROWS = 512, 128
#: The key of rows without a doc_id.
LEAST = -(1 << 63)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _from(x: Column, k: int) -> Column:
    """x from its k-th element on."""
    return F.slice(x, k, F.size(x))


def kmers(text: Column) -> Column:
    """Per k-mer its hash if it is an anchor, else null; K is 4 and S 2, so that its inner runs are
    three pairs of neighbouring words."""
    hashes = F.transform(F.regexp_extract_all(text, F.lit(shared.WORD), F.lit(0)), lambda w: F.xxhash64(w))

    def chosen(pairs: Column) -> Column:
        ends = F.zip_with(pairs, _from(pairs, 3), lambda a, c: F.struct(F.least(a, c).alias("least"), F.xxhash64(a, c).alias("whole")))
        marks = F.zip_with(ends, _from(pairs, 2), lambda e, b: F.when(e["least"] <= b, e["whole"]))
        return F.slice(marks, 1, F.size(pairs) - 2)

    def of_words(h: Column) -> Column:
        few = F.when(F.size(h) > 0, F.array(F.aggregate(h, F.lit(42).cast("bigint"), lambda a, x: F.xxhash64(a, x)))).otherwise(F.array().cast("array<bigint>"))
        pairs = F.slice(F.zip_with(h, _from(h, 2), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size(h) - 1, F.lit(0)))
        return F.when(F.size(h) < K, few).otherwise(_let(pairs, chosen))

    return _let(hashes, of_words)


def anchors(text: Column) -> Column:
    """(position in words from 0, hash) of each anchor, in order; never null."""
    marks = F.transform(kmers(text), lambda h, i: F.struct(i.alias("position"), h.alias("hash")))
    return F.coalesce(F.filter(marks, lambda a: a["hash"].isNotNull()), F.array().cast("array<struct<position:int,hash:bigint>>"))


def links(marks: Column) -> Column:
    """The distinct links of a text's anchors (as anchors() gives them), for matching by position."""
    pair = lambda a, b: F.xxhash64(a["hash"], b["hash"], b["position"] - a["position"])
    many = lambda m: F.zip_with(F.slice(m, 1, F.size(m) - 1), _from(m, 2), pair)
    both = F.when(F.size(marks) > 1, many(marks)).otherwise(F.transform(marks, lambda a: a["hash"]))
    return F.array_distinct(both)


def likeness(a: Column, b: Column) -> Column:
    """Sørensen's index of two texts' links."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / n)


def written(marks: Column) -> Column:
    """Each anchor as position:hash, in hexadecimal and in order of position."""
    one = lambda a: F.concat(F.lower(F.hex(a["position"])), F.lit(":"), F.lower(F.hex(a["hash"])))
    return F.array_join(F.transform(marks, one), " ")


def _cuts(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """The distinct upper edges of n parts of key with about as many rows each, per group; the last part is open."""
    steps = F.array(*(F.lit(i / n) for i in range(1, n)))
    at = F.percentile_approx("key", steps, 10_000) if n > 1 else F.array().cast("array<bigint>")
    return rows.groupBy(*by).agg(F.array_distinct(at).alias("cuts"))


def _part(cuts: Column, key: Column) -> Column:
    return F.size(F.filter(cuts, lambda x: x < key))


def bucketed(rows: DataFrame) -> DataFrame:
    """rows (key, h, ...) with (major, minor, sub), numbers of buckets that ascend with key and h and hold few
    rows each. The tables that are broadcast have at most RANGES**2 numbers."""
    ids = shared.settled(rows.select("key", "h"), "ids")
    n = ids.count()
    majors = max(1, min(RANGES, n // BUCKET_ROWS))
    minors = max(1, min(RANGES, -(-n // (BUCKET_ROWS * majors))))
    outer = F.lit(_cuts(ids, majors).first()[0] if n else []).cast("array<bigint>")
    ids = ids.withColumn("major", _part(outer, F.col("key")))
    inner = shared.settled(_cuts(ids, minors, "major"), "cuts")
    with_minor = lambda x: x.join(F.broadcast(inner), "major").withColumn("minor", _part(F.col("cuts"), F.col("key"))).drop("cuts")
    held = with_minor(ids).groupBy("major", "minor").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    parts = F.when(F.col("lo") == F.col("hi"), F.ceil(F.col("n") / BUCKET_ROWS)).otherwise(1)
    held = shared.settled(held.select("major", "minor", parts.cast("long").alias("parts")).filter("parts > 1"), "hot")
    rows = with_minor(rows.withColumn("major", _part(outer, F.col("key")))).join(F.broadcast(held), ["major", "minor"], "left")
    # ascending with h: the upper 31 bits, counted from the least
    sub = ((F.shiftright("h", 33) + (1 << 30)) * F.coalesce("parts", F.lit(1)) / (1 << 31)).cast("long")
    return rows.withColumn("sub", sub).drop("parts")


BUCKET = ["major", "minor", "sub"]


def followed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), marks (its anchors), and the next document's text and anchors, in ascending
    order of doc_id and around the end."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = bucketed(rows.withColumn("key", F.coalesce("doc_id", F.lit(LEAST))).withColumn("h", F.xxhash64("text")))
    firsts = shared.settled(rows.groupBy(*BUCKET).agg(F.min(F.struct("key", "h")).alias("first")), "firsts")
    # the first document after each bucket: of the next in its range, else of the next range, else of all
    heads = firsts.groupBy("major").agg(F.min("first").alias("head"))  # at most RANGES rows
    around = Window.partitionBy(F.lit(0)).orderBy("major")
    every = Window.partitionBy(F.lit(0))
    heads = heads.withColumn("after", F.coalesce(F.lead("head").over(around), F.min("head").over(every))).select("major", "after")
    inside = Window.partitionBy("major").orderBy("minor", "sub")
    after = firsts.withColumn("next", F.lead("first").over(inside)).join(heads, "major").withColumn("next", F.coalesce("next", "after"))
    after = shared.settled(after.select(*(F.col(x).alias(f"to_{x}") for x in BUCKET), F.col("next.key").alias("of"), F.col("next.h").alias("of_h")), "after")
    guards = rows.join(after, (F.col("key") == F.col("of")) & (F.col("h") == F.col("of_h")))
    guards = guards.groupBy(*(f"to_{x}" for x in BUCKET)).agg(F.any_value("text").alias("text"))
    guards = guards.select(*(F.col(f"to_{x}").alias(x) for x in BUCKET), "text", F.lit(True).alias("guard"))
    both = rows.withColumn("guard", F.lit(False)).unionByName(guards, allowMissingColumns=True)
    # texts travel alone; their anchors are found where they arrive
    both = both.repartition(*BUCKET).withColumn("marks", anchors(F.col("text")))
    line = Window.partitionBy(*BUCKET).orderBy("guard", "key", "h")
    both = both.withColumn("next_text", F.lead("text").over(line)).withColumn("next_marks", F.lead("marks").over(line))
    return both.filter(~F.col("guard")).select("doc_id", "text", "marks", "next_text", "next_marks")


def compared(docs: DataFrame) -> DataFrame:
    rows = followed(docs).withColumn("n_chars", F.length("text").cast("long")).withColumn("moved", F.expr("cast(n_chars div 4 as int)"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars as int) - moved)"), F.expr("substring(next_text, 1, moved)")))

    def row(x: Column) -> Column:
        own = F.struct(links(x["marks"]).alias("own"), links(x["edited"]).alias("edited"), links(x["next"]).alias("next"))
        near = lambda l: F.struct(likeness(l["own"], l["edited"]).alias("edited"), likeness(l["own"], l["next"]).alias("next"))
        return F.struct(written(x["marks"]).alias("fingerprint"), written(x["edited"]).alias("edited_fingerprint"), _let(own, near).alias("near"))

    every = F.struct("marks", anchors(F.col("edited")).alias("edited"), F.col("next_marks").alias("next"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), _let(every, row).alias("x"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "x.fingerprint", "x.edited_fingerprint", F.col("x.near.edited").alias("near_edited"), F.col("x.near.next").alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(shared.table(spark, sf_dir, "documents"))
