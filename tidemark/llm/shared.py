"""What the training-data operators share: table readers, shared scratch folders, byte-level words."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts define it: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker handles at a time; one longer text is handled alone.
SLICE_BYTES = 1 << 20
#: Bytes in an Arrow batch on its way to a worker.
ARROW_BYTES = "16m"
#: The same for operators that go through a batch in slices anyway.
ARROW_SMALL = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str, arrow: str = ARROW_BYTES) -> str:
    """A fresh path in the folder that the driver and all executors share (spark.checkpoint.dir)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/tidemark-checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", arrow)  # what a worker holds of long texts
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str, arrow: str = ARROW_BYTES) -> DataFrame:
    """The rows of df, written to the shared folder and read again: a later stage that is run again
    reads these files and not the lineage before them. arrow: bytes in an Arrow batch on its way to a worker."""
    path = scratch(df.sparkSession, name, arrow)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What a worker keeps from one task to the next, by the operator that made it.
kept: dict[str, object] = {}


def lean(own: str = "") -> None:
    """Called in a worker as a task begins: lets go of what tasks of other operators than own kept there, and gives
    the memory that they freed back to the system."""
    for name in [x for x in kept if x != own]:
        del kept[name]
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, mod n; null keys have none and so count as not held out."""
    return F.crc32(key.cast("string")) % n


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without copying, and len + 1 offsets. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about limit bytes each; every row lies in one range."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number mod 2**64, and of its inverse."""
    if len(_powers["up"]) < n:
        size = max(n, 2 * len(_powers["up"]), SLICE_BYTES + 1)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for kind, base in (("up", _ODD), ("down", inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[kind] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums s with hash(data[a:b]) = (s[b] - s[a]) / base**a, so that any span is hashed in one step."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def cuts(data: np.ndarray, begin: int, stop: int, limit: int, gaps: np.ndarray = SPACE) -> Iterator[tuple[int, int]]:
    """(begin, end) of parts of about limit bytes that end before a gap (a byte that is true in gaps), or at stop."""
    while begin < stop:
        end = min(stop, begin + limit)
        while end < stop:
            found = np.flatnonzero(gaps[data[end : min(stop, end + (1 << 16))]])
            if len(found):
                end += int(found[0])
                break
            end = min(stop, end + (1 << 16))
        yield begin, end
        begin = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie end to end, A-Z as a-z, and the first word of each text
    (len(texts) + 1 numbers). One long text is read in parts."""
    if len(offsets) == 2 and offsets[1] - offsets[0] > 2 * SLICE_BYTES:
        own = list(cuts(data, int(offsets[0]), int(offsets[1]), SLICE_BYTES))
        if len(own) > 1:
            parts = [words(data, np.array(x))[0] for x in own]
            return np.concatenate(parts), np.array([0, sum(map(len, parts))])
    base, data = offsets[0], LOWER[data[offsets[0] : offsets[-1]]]
    at, n = offsets - base, len(data)
    gap = np.ones(n + 2, bool)
    gap[1:-1] = SPACE[data]
    begins, ends = ~gap[1:-1] & gap[:-2], ~gap[1:-1] & gap[2:]
    inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
    begins[inner] |= ~gap[1:-1][inner]
    ends[inner - 1] |= ~gap[1:-1][inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return span_hash(prefix_hash(data), start, end), np.searchsorted(start, at)
