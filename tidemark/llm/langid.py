"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, at each of SLOTS places, one bit per language. An n-gram's languages are
the bits left when the masks at its PROBES places are ANDed: one lookup answers for all languages. Per
text, each language's bits are counted over the text's n-grams; the count is corrected for the share of
false positives that the language's fill of the filter gives, and the largest corrected count decides.
score is the winner's part of all corrected counts; coverage is its corrected count per n-gram of the text,
which tells a text of no learned language from one that two learned languages share.

n-grams are runs of GRAM bytes of UTF-8, A-Z as a-z, anything but letters as one space, with no space
inside. An n-gram belongs to a language if it is at least RELATIVE times as frequent there as where it is
most frequent. Counts cover all training rows; the driver holds only the filter, whose size is fixed.

Defined cases: null texts and those without a letter are ``und`` with score 0; texts with letters but no
n-gram, or with none that a language holds, get the most frequent language with score and coverage 0, and
identified() drops them; rows without a language are predicted but not learned from; a null doc_id is not
held out; rows are independent, so repeated rows fare alike; without training rows all are ``und``; extra
columns are ignored by predicted() and kept by identified(). More than 65,535 languages are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import shared

GRAM, SLOTS, PROBES, RELATIVE = 4, 1 << 21, 3, 0.2
HELD_OUT = 5
UND = "und"
#: Least coverage of a document that identified() keeps. Held-out documents of the test tables that are in a
#: learned language and long enough for an n-gram have 0.71 and more.
LEAST_COVERAGE = 0.3

_CLEAN = np.full(256, 0x20, np.uint8)
_CLEAN[0x80:] = np.arange(0x80, 256)
for _a, _z in ((65, 90), (97, 122)):
    _CLEAN[_a : _z + 1] = np.arange(97, 123)


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of texts that lie end to end, each text between two spaces, as numbers below
    2**(8 * GRAM); and len(at) offsets into them."""
    n = len(at) - 1
    base, size = at[0], at[-1] - at[0]
    padded = np.full(size + 2 * n + GRAM, 0x20, np.uint8)
    starts = at - base + 2 * np.arange(n + 1)
    inside = np.ones(size + 2 * n, bool)
    inside[starts[:-1]] = inside[starts[1:] - 1] = False
    padded[: len(inside)][inside] = _CLEAN[data[base : at[-1]]]
    total = len(padded) - GRAM + 1
    space = padded == 0x20
    good = ~space[1 : 1 + total]
    for i in range(2, GRAM - 1):
        good &= ~space[i : i + total]
    keep = np.flatnonzero(good)
    packed = np.zeros(len(keep), np.uint64)
    for i in reversed(range(GRAM)):
        packed <<= np.uint64(8)
        packed |= padded[i : i + total][good]
    return packed, np.searchsorted(keep, starts)


def parts(data: np.ndarray, at: np.ndarray, limit: int = shared.SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, offsets) of slices of the texts. A long text is cut where it has no letter, which no n-gram crosses,
    so that its row comes with several slices."""
    for lo, hi in shared.slices(at, limit):
        if hi - lo > 1 or at[hi] - at[lo] <= 2 * limit:
            yield np.arange(lo, hi), at[lo : hi + 1]
        else:
            for x in shared.cuts(data, int(at[lo]), int(at[hi]), limit, _CLEAN == 0x20):
                yield np.array([lo]), np.array(x)


def places(found: np.ndarray, slots: int, probes: int) -> list[np.ndarray]:
    h = shared.mix(found + np.uint64(0x632BE59BD9B4E019))
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(i) * b) % np.uint64(slots)).astype(np.int64) for i in range(probes)]


class Filter:
    """masks: SLOTS rows of one 64-bit word per 64 languages."""

    def __init__(self, languages: list[str], masks: np.ndarray, probes: int, default: str):
        self.languages, self.masks, self.probes, self.default = languages, masks, probes, default
        fill = np.array([(masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(languages))])
        self.false = fill**probes

    def lookup(self, found: np.ndarray) -> np.ndarray:
        """Per n-gram the masks of all languages that contain it."""
        hit = None
        for at in places(found, len(self.masks), self.probes):
            hit = self.masks[at] if hit is None else hit & self.masks[at]
        return hit

    def shares(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the corrected count of its n-grams; and the number of its n-grams."""
        found, ends = grams(data, at)
        hit, n = self.lookup(found), np.diff(ends)
        out = np.zeros((len(n), len(self.languages)))
        for i in range(len(self.languages)):
            sums = np.concatenate([[0], np.cumsum(hit[:, i // 64] >> np.uint64(i % 64) & np.uint64(1), dtype=np.int64)])
            out[:, i] = np.maximum(0, sums[ends[1:]] - sums[ends[:-1]] - n * self.false[i]) / (1 - min(self.false[i], 0.999))
        return out, n


def counted(docs: DataFrame, languages: list[str]) -> DataFrame:
    """(gram, language's number, count) over all rows of known language."""
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.lean()
        for batch in batches:
            data, at = shared.text_bytes(batch.column("text"))
            lang = np.array([number.get(x, -1) for x in batch.column("lang").to_pylist()], np.int64)
            for rows, offsets in parts(data, at, 4 * shared.SLICE_BYTES):
                found, ends = grams(data, offsets)
                own = np.repeat(lang[rows], np.diff(ends))
                unique, n = np.unique((found << np.uint64(16) | own.astype(np.uint64))[own >= 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((unique >> np.uint64(16)).astype(np.int64)), pa.array((unique & np.uint64(0xFFFF)).astype(np.int32)), pa.array(n)], ["gram", "language", "n"])

    return docs.select("text", "lang").mapInArrow(count, "gram long, language int, n long").groupBy("gram", "language").agg(F.sum("n").alias("n"))


def learned(docs: DataFrame, slots: int = SLOTS, probes: int = PROBES, relative: float = RELATIVE) -> Filter:
    """The filter of all rows that have a text and a language."""
    docs = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # one row per language
    languages = [r["lang"] for r in rows]
    if len(languages) > 0xFFFF:
        raise ValueError(f"{len(languages)} languages; counted() numbers them in 16 bits")
    if not languages:
        return Filter([], np.zeros((slots, 1), np.uint64), probes, UND)
    counts = shared.settled(counted(docs, languages), "grams", shared.ARROW_SMALL)
    totals = {r["language"]: r["n"] for r in counts.groupBy("language").agg(F.sum("n").alias("n")).collect()}
    per = F.element_at(F.array(*(F.lit(1.0 / max(1, totals.get(i, 1))) for i in range(len(languages)))), F.col("language") + 1) * F.col("n")
    rated = counts.withColumn("rate", per)
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"))
    kept = rated.join(best, "gram").filter(F.col("rate") >= relative * F.col("best")).select("gram", "language")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language = batch.column("language").to_numpy()
            for at in places(batch.column("gram").to_numpy().astype(np.uint64), slots, probes):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array((language // 64).astype(np.int32)), pa.array(np.int64(1) << (language % 64).astype(np.int64))], ["slot", "word", "mask"])

    bits = kept.mapInArrow(placed, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    masks = np.zeros((slots, (len(languages) + 63) // 64), np.uint64)
    got = bits.toArrow()  # at most slots rows per 64 languages
    masks[got["slot"].to_numpy(), got["word"].to_numpy()] = got["mask"].to_numpy().astype(np.uint64)
    return Filter(languages, masks, probes, languages[0])


def scored(docs: DataFrame, model: Filter, *keep: str, names: tuple[str, str, str] = ("lang_pred", "score", "coverage")) -> DataFrame:
    """The kept columns with the winner, its part of all corrected counts and its coverage, under names."""
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.masks, model.probes, model.default))
    schema = docs.select(*keep, F.lit("").alias(names[0]), *(F.lit(0.0).alias(x) for x in names[1:])).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.lean()
        f = Filter(*sent.value)
        for batch in batches:
            column = batch.column("text")
            data, at = shared.text_bytes(column)
            pred, sure, cover = np.full(len(column), UND, object), np.zeros(len(column)), np.zeros(len(column))
            counts, n = np.zeros((len(column), len(f.languages))), np.zeros(len(column))
            for rows, offsets in parts(data, at) if f.languages else ():
                for i, a, z in zip(rows, offsets, offsets[1:], strict=False):
                    text = data[a:z].tobytes()
                    if text.upper() != text.lower() or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace")))):
                        pred[i] = f.default
                some, many = f.shares(data, offsets)
                counts[rows] += some
                n[rows] += many
            if f.languages and len(column):
                best, total = counts.argmax(1), counts.sum(1)
                known = (pred != UND) & (total > 0)
                pred[known] = np.array(f.languages, object)[best[known]]
                sure[known] = counts[known, best[known]] / total[known]
                cover[known] = counts[known, best[known]] / n[known]
            columns = [*(batch.column(x) for x in keep), pa.array(pred, pa.string()), pa.array(sure), pa.array(cover)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *names])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(score, schema)


def held_out(key: Column) -> Column:
    return F.coalesce(shared.remainder(key, HELD_OUT) == 0, F.lit(False))


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and coverage of every row; rows not held out are learned from."""
    model = learned(docs.filter(~held_out(F.col("doc_id"))))
    out = scored(docs, model, "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "coverage")


def identified(docs: DataFrame, wanted: tuple[str, ...] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """docs whose predicted language is wanted (None: any that is learned) and covers at least that part of
    their n-grams. A text without a letter goes, and so does one whose n-grams no language holds."""
    model = learned(docs.filter(~held_out(F.col("doc_id"))))
    out = scored(docs, model, *docs.columns, names=("__lang", "__score", "__coverage"))
    kept = (F.col("__lang") != UND) & (F.col("__coverage") >= max(least, 1e-9))
    if wanted is not None:
        kept &= F.col("__lang").isin(*wanted)
    return out.filter(kept).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(shared.table(spark, sf_dir, "documents"))
