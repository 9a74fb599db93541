"""Packing by shortest-pack-first over the length histogram (Krell et al. 2021).

Documents are cut into pieces of at most ``capacity`` ids. The driver sees only the histogram of
piece lengths (at most ``capacity`` numbers, whatever the size of the corpus) and turns it into
packing patterns with counts: lengths are placed longest first, each into the packs with the most
room left, and into new packs where none has room. A piece then finds its place from its length and
its rank among the pieces of that length.

Defined cases: null and empty texts are documents of the end id alone; repeated rows are documents
of their own; no rows give no pieces; a text of any length is cut as often as needed; null doc_ids are
packed like others; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import shared, tokens

CAPACITY, END_ID = 2048, 1
#: Ranks within a length are counted in at most so many buckets, of about so many rows each.
RANK_BUCKETS, BUCKET_ROWS = 1024, 512

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per run of at most capacity ids of a document, with the ids' checksum."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer, end_id)
        for batch in batches:
            data, at = shared.text_bytes(batch.column("text"))
            keys = batch.column("doc_id")
            for lo, hi in shared.slices(at, tokens.SLICE_BYTES):
                ids, ends = encoder.encode(data, at[lo : hi + 1])
                size = np.diff(ends)
                n = -(-size // capacity)
                row = np.repeat(np.arange(hi - lo), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(capacity, size[row] - start)
                raw, first = ids.astype("<u4"), ends[row] + start
                crc = [zlib.crc32(raw[a : a + k]) for a, k in zip(first.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(size[row])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE)


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Packing patterns ((length, times), ...) with the number of packs of each.

    Longest lengths first; each goes to the packs with the most room left, and a new pack is opened
    only when no pack has room, then filled with its own length before the next is opened."""
    done: list[tuple[tuple[tuple[int, int], ...], int]] = []
    open_: dict[tuple[int, tuple[tuple[int, int], ...]], int] = {}
    heap: list[tuple[int, tuple[tuple[int, int], ...]]] = []

    def put(room: int, pattern: tuple[tuple[int, int], ...], n: int) -> None:
        if n:
            if (room, pattern) not in open_:
                heapq.heappush(heap, (-room, pattern))
            open_[room, pattern] = open_.get((room, pattern), 0) + n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if heap and -heap[0][0] >= length:
                room, pattern = -heap[0][0], heapq.heappop(heap)[1]
                n = open_.pop((room, pattern))
                used = min(n, left)
                put(room, pattern, n - used)
                more = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))
                put(room - length, more, used)
                left -= used
            else:
                each = capacity // length
                put(capacity - each * length, ((length, each),), left // each)
                if left % each:
                    put(capacity - left % each * length, ((length, left % each),), 1)
                left = 0
    for (_, pattern), n in sorted(open_.items(), key=lambda x: (x[0][0], x[0][1])):
        done.append((pattern, n))
    return done


def places(found: list[tuple[tuple[tuple[int, int], ...], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset in it, times a sequence), by length and rank."""
    rows, rank, sequence = [], {}, 0
    for pattern, n in found:
        offset = 0
        for length, times in pattern:
            rows.append((length, rank.get(length, 0), sequence, offset, times))
            rank[length] = rank.get(length, 0) + n * times
            offset += length * times
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """rows with their rank (from 0) among those of equal length. One length may hold most rows: each
    is counted in buckets of its own, and a small table of bucket sizes adds what lies before."""
    buckets = max(1, min(RANK_BUCKETS, total // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    inner = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    sizes = rows.groupBy("length", "bucket").count()
    before = sizes.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    return rows.withColumn("inner", F.row_number().over(inner) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("inner") + F.col("before")).drop("bucket", "inner", "before")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its sequence and its offset there, gapless from 0."""
    rows = shared.settled(pieces(docs, tokenizer, capacity, end_id), "pieces", shared.ARROW_SMALL)
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most capacity rows
    at = places(patterns(histogram, capacity))
    key = at[:, 0] << 40 | at[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = at[np.searchsorted(key, length << 40 | rank, "right") - 1]
            sequence, nth = np.divmod(rank - row[:, 1], row[:, 4])
            kept = [batch.column(x.strip().split()[0]) for x in PIECE.split(",")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(row[:, 2] + sequence), pa.array(row[:, 3] + nth * length)], [*(x.split()[0] for x in PIECE.split(", ")), "sequence_id", "offset"])

    return ranked(rows, sum(histogram.values())).mapInArrow(place, f"{PIECE}, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(shared.table(spark, sf_dir, "documents"), tokens.vocabulary())
