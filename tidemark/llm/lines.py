"""Line deduplication over overlapping windows of three lines, in DataFrame operations only.

Every three consecutive lines of a document are hashed. A window that also stands earlier (at a smaller
doc_id, or further up in the same document) is a repeat, and all lines under any repeat are removed: the
first occurrence of a passage stays whole, and lines that are merely frequent stay unless their
neighbours repeat with them. Windows of nothing but white space never count.

Equal texts are handled once: of them the smallest doc_id is judged window by window, and the others lose
every line that lies under a window. So a text with thousands of copies adds its windows once.

Defined cases: null texts stay null with no lines; an empty text is one empty line; with fewer than three
lines nothing is removed; rows of equal doc_id and text are one document listed twice and fare alike; rows
without a doc_id come before all others; extra columns are kept by deduplicated().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import shared

WINDOW = 3


def _let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def windows(text: Column) -> Column:
    """Hashes of all runs of three lines, null where these are blank."""

    def hashed(lines: Column) -> Column:
        n = F.size(lines)
        pairs = F.zip_with(lines, F.slice(lines, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        triples = F.zip_with(pairs, F.slice(lines, 3, n), lambda p, c: F.when(F.concat(p["a"], p["b"], c).rlike(r"\S"), F.xxhash64(p["a"], p["b"], c)))
        return F.when(n >= WINDOW, F.slice(triples, 1, F.greatest(n - (WINDOW - 1), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))

    return _let(F.split(text, "\n"), hashed)


def repeats(docs: DataFrame) -> DataFrame:
    """For each distinct text that loses lines: its hash, the smallest doc_id, the starts of all windows
    and of the repeated ones."""
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("h"), windows(F.col("text")).alias("ws"))
    texts = texts.groupBy("h").agg(F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("doc_id"))).alias("d"), F.count(F.lit(1)).alias("copies"), F.any_value("ws").alias("ws"))
    texts = shared.settled(texts.select("h", F.col("d.doc_id").alias("doc_id"), "copies", "ws").filter(F.size("ws") > 0), "texts")
    single = texts.select("h", "doc_id", F.posexplode("ws").alias("pos", "w")).filter(F.col("w").isNotNull())
    place = F.struct("doc_id", "h", "pos")
    first = single.groupBy("w").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("w", "first")
    later = single.join(shared.settled(first, "windows").hint("merge"), "w").filter(place > F.col("first"))
    starts = later.groupBy("h").agg(F.collect_set("pos").alias("starts"))
    every = F.filter(F.sequence(F.lit(0), F.size("ws") - 1), lambda i: F.get("ws", i).isNotNull())
    found = texts.join(starts.hint("merge"), "h", "left").filter("copies > 1 or starts is not null")
    return shared.settled(found.select("h", F.col("doc_id").alias("first_doc"), F.coalesce("starts", F.array().cast("array<int>")).alias("starts"), every.alias("every")), "repeats")


def marked(docs: DataFrame) -> DataFrame:
    """docs with ``__kept`` (the text that is left), ``__lines`` and ``__removed`` (how many there are and go)."""
    found = repeats(docs).withColumnsRenamed({"h": "__h", "first_doc": "__first", "starts": "__starts", "every": "__every"})
    rows = docs.join(found.hint("merge"), F.xxhash64(docs["text"]) == F.col("__h"), "left")
    is_first = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))) == F.col("__first")
    starts = F.when(F.col("text").isNull() | F.col("__h").isNull(), F.array().cast("array<int>")).when(is_first, F.col("__starts")).otherwise(F.col("__every"))

    def cut(both: Column) -> Column:
        lines = both["lines"]
        gone = F.flatten(F.transform(both["starts"], lambda p: F.array(p, p + 1, p + 2)))
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
        return F.struct(F.when(F.size(both["starts"]) > 0, kept).alias("kept"), F.size(lines).cast("long").alias("n"), (F.size(lines) - F.size(left)).cast("long").alias("removed"))

    rows = rows.withColumn("__cut", F.when(F.col("text").isNotNull(), _let(F.struct(F.split("text", "\n").alias("lines"), starts.alias("starts")), cut)))
    zero = F.lit(0).cast("long")
    return rows.select(*docs.columns, F.coalesce("__cut.kept", "text").alias("__kept"), F.coalesce("__cut.n", zero).alias("__lines"), F.coalesce("__cut.removed", zero).alias("__removed"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with the texts that are left; n_chars is counted anew where a text has changed."""
    rows = marked(docs).withColumn("text", F.col("__kept"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return marked(docs).select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.sha2(F.col("__kept"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, string_split(text, chr(10))[pos] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos) WHERE text IS NOT NULL
), trios AS (
  SELECT doc_id, pos, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), repeated AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth FROM trios
    WHERE c IS NOT NULL AND regexp_matches(a || b || c, '\S')
  ) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, pos + d AS pos FROM repeated, (VALUES (0), (1), (2)) AS t(d)
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS kept
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(kept) END AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
