"""Suffix-array deduplication: repeated byte strings by a common-prefix-aware distributed merge sort.

Which suffixes are sorted. Every LENGTH-byte string holds an anchor: the k-mer of KEY bytes with the least
hash among all its k-mers (the last of equal ones). The choice depends on the string alone, so equal strings
have their anchors at equal places. Only the suffixes that start at anchors are sorted, about one in
(LENGTH - KEY) / 2 positions: two equal strings lie around two equal anchors, so a string repeats if and only
if the bytes before and behind its anchor, up to its ends, are those of another anchor.

First sort: which anchors stand twice. Each task sorts its anchors' first KEY bytes into runs and writes them
front-coded: the length of the prefix shared with the key before, and the bytes after it. Runs travel in
chunks; the key space is cut at quantiles of the chunks' first keys (in two steps where there are more ranges
than SPLITTERS), and each range merges its runs by a loser tree that keeps, with every loser, the length of
the prefix it shares with the last winner: unequal lengths decide a match without looking at bytes, equal
ones compare only what follows.

Second sort: how far they agree. The suffixes of repeated anchors, up to the last string around the anchor,
are sorted, front-coded and merged in the same way; the merge gives the common prefix of every two
neighbours. What stands before the anchors, read backwards, is sorted within equal anchors and gives common
prefixes too. For each place o of an anchor in its string, runs of suffixes with common prefixes of at least
LENGTH - o bytes, and of backward ones of at least o, are classes; strings whose anchors share both classes
are equal, byte by byte. No hash decides there: hashes only choose anchors and spread equal anchors to tasks.

An anchor that stands more than HOT times is the exception, so that no task gathers it: its strings are
hashed to 64 bits, twice independently, and meet in buckets by the second hash. Equal surroundings within a
block of texts are one entry in both ways, so copies cost an entry per block.

Defined cases: null texts are empty; a text shorter than LENGTH keeps every byte; equal texts of at least
LENGTH bytes lose all, in each row, and so do rows listed twice; rows without a doc_id are handled like
others; a long text is handled in overlapping windows; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import shared

LENGTH, KEY = 400, 64
#: Suffixes in a run, in a chunk of a run, and in a range, about; keys that the driver sees, at most.
RUN, CHUNK, RANGE, SPLITTERS = 1 << 18, 1024, 1 << 16, 4096
#: Bytes of text in a section and in a block, and of texts with repeated anchors to a bucket, about.
SECTION, BLOCK_BYTES, BUCKET_BYTES = 1 << 20, 1 << 20, 1 << 20
#: Occurrences from which an anchor's strings meet by hash.
HOT = 20_000


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours, by running minima from both sides of blocks of that width."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchored(data: np.ndarray, at: np.ndarray, length: int = LENGTH, key: int = KEY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie end to end from 0: the starts of all strings of that length, the anchor of each,
    and the prefix sums that hash any span."""
    sums = shared.prefix_hash(data)
    lengths = np.diff(at)
    n = np.maximum(0, lengths - length + 1)
    starts = np.arange(n.sum()) + np.repeat(at[:-1] - (np.cumsum(n) - n), n)
    if not len(starts):
        return starts, starts, sums
    places = np.arange(len(data) - key + 1)
    # 33 bits of the hash whatever the section, so that the choice is the string's alone; then the later place
    bits = np.uint64(31)
    order = shared.span_hash(sums, places, places + key) >> bits << bits | (len(data) - places).astype(np.uint64)
    least = sliding_least(order, length - key + 1)[starts]
    return starts, len(data) - (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), sums


def sections(data: np.ndarray, at: np.ndarray, size: int = SECTION) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place of its first byte, bytes, offsets) of parts of texts that lie end to end. Short texts
    are taken together; a longer one is cut into windows of size bytes that overlap, so that each LENGTH-byte
    string begins in one window and lies in it."""
    for lo, hi in shared.slices(at, size):
        if hi - lo > 1 or at[hi] - at[lo] <= size:
            yield lo, int(at[lo]), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            continue
        for begin in range(int(at[lo]), int(at[hi]), size):
            own = data[begin : min(begin + size + LENGTH - 1, at[hi])]
            yield lo, begin, own, np.array([0, len(own)])


def front_coded(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted rows of bytes as shared prefix lengths (the first's is 0) and what follows them."""
    differ = keys[1:] != keys[:-1]
    prefix = np.zeros(len(keys), np.uint8)
    prefix[1:] = np.where(differ.any(1), differ.argmax(1), keys.shape[1])
    rest = keys[np.arange(keys.shape[1])[None, :] >= prefix[:, None]]
    return prefix.tobytes(), rest.tobytes()


class Run:
    """A run's keys within [low, high), decoded one by one from its chunks: (number, shared prefixes, lengths of
    keys, what follows the prefixes)."""

    def __init__(self, chunks: list[tuple], low: bytes | None = None, high: bytes | None = None):
        self.items = self._decoded(chunks, low, high)

    @staticmethod
    def _decoded(chunks, low, high) -> Iterator[tuple[int, bytes, int, int]]:
        last = None
        for number, prefix, lengths, rest in chunks:
            key, at = b"", 0
            for i, (shared_, length) in enumerate(zip(prefix, lengths, strict=True)):
                step = length - shared_
                key = key[:shared_] + rest[at : at + step]
                at += step
                if low is not None and key < low:
                    continue
                if high is not None and key >= high:
                    return
                yield 0 if last is None else shared_ if i else common(last, key, 0), key, number, i
                last = key


def common(a: bytes, b: bytes, known: int) -> int:
    """The length of the shared prefix of two keys that agree in the first known bytes."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def merged(runs: list[Run]) -> Iterator[tuple[int, int, int, int]]:
    """All runs' items in order, as (shared, run, chunk, entry); shared: the prefix in common with the item
    before. A loser tree: each inner node holds the loser of its match, and prefix[i] how much run i's item
    shares with the last winner; -1 when the run is at its end."""
    size = 1 << max(0, (len(runs) - 1).bit_length())
    items = [next(r.items, None) for r in runs] + [None] * (size - len(runs))
    prefix = [-1 if x is None else 0 for x in items]
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); what the loser shares with the winner becomes its prefix."""
        if prefix[a] != prefix[b]:
            return (a, b) if prefix[a] > prefix[b] else (b, a)
        if prefix[a] < 0:
            return a, b
        x, y = items[a][1], items[b][1]
        known = prefix[a]
        if x == y:
            if b < a:
                a, b = b, a
            prefix[b] = len(x)
            return a, b
        if y[known:] < x[known:]:
            a, b = b, a
        prefix[b] = common(x, y, known)
        return a, b

    def build(node: int) -> int:
        if node >= size:
            return node - size
        a, b = build(2 * node), build(2 * node + 1)
        winner, losers[node] = play(a, b)
        return winner

    winner = build(1) if size > 1 else 0
    while prefix[winner] >= 0:
        item = items[winner]
        yield prefix[winner], winner, item[2], item[3]
        items[winner] = item = next(runs[winner].items, None)
        prefix[winner] = -1 if item is None else item[0]
        node, now = (winner + size) >> 1, winner
        while node:
            other = losers[node]
            p, q = prefix[now], prefix[other]
            if q > p:
                losers[node], now = now, other
            elif p == q and p >= 0:
                now, losers[node] = play(now, other)
            node >>= 1
        winner = now


RUNS = "run string, chunk int, first binary, last binary, prefix binary, rest binary, counts binary, docs binary, texts binary, places binary"


def sorted_runs(docs: DataFrame) -> DataFrame:
    """Front-coded chunks of sorted runs, with where each suffix stands (docs: doc_id, texts: the text's
    hash, places: the anchor in it)."""
    names = [x.split()[0] for x in RUNS.split(", ")]
    kinds = [pa.string(), pa.int32(), *[pa.binary()] * 8]

    def run_of(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        keys, docs_, texts, places = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys.view(f"S{KEY}").reshape(-1), kind="stable")
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(1)
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(keys)))
        keys, name = keys[first], uuid.uuid4().hex
        for chunk, a in enumerate(range(0, len(keys), CHUNK)):
            b = min(a + CHUNK, len(keys))
            inside = order[first[a] : first[b - 1] + counts[b - 1]]
            row = [name, chunk, keys[a].tobytes(), keys[b - 1].tobytes(), *front_coded(keys[a:b])]
            row += [counts[a:b].astype(np.uint32).tobytes(), docs_[inside].tobytes(), texts[inside].tobytes(), places[inside].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            data, at = shared.text_bytes(batch.column("text"))
            docs_, texts = (batch.column(x).fill_null(0).to_numpy() for x in ("doc_id", "h"))
            before = None, np.zeros(0, np.int64)  # of a long text: its row, and the anchors of the window before
            for lo, base, own, ends in sections(data, at):
                anchors = np.unique(anchored(own, ends)[1])
                row = np.searchsorted(ends, anchors, "right") - 1
                if before[0] == lo:  # both windows may have chosen an anchor of the overlap
                    fresh = ~np.isin(anchors + base, before[1])
                    anchors, row = anchors[fresh], row[fresh]
                before = lo, np.concatenate([before[1][before[1] >= base] if before[0] == lo else before[1][:0], anchors + base])
                if not len(anchors):
                    continue
                parts.append((own[anchors[:, None] + np.arange(KEY)], docs_[lo + row], texts[lo + row], anchors + base - at[lo + row]))
                held += len(anchors)
                if held >= RUN:
                    yield from run_of(parts)
                    parts, held = [], 0
        if parts:
            yield from run_of(parts)

    return docs.select("doc_id", "text", "h").mapInArrow(sort, RUNS)


def ranged(runs: DataFrame, per_range: int, splitters: int) -> DataFrame:
    """Chunks in each range of the key space that they meet: (range, sub, low, high, run, chunk, prefix, rest,
    counts). Ranges are cut at quantiles of the chunks' first keys, of which the driver sees at most splitters;
    where more ranges are wanted, each is cut on at quantiles of the first keys that lie in it."""
    import bisect

    spark = runs.sparkSession
    wanted = max(1, runs.count() * CHUNK // per_range)
    drawn = runs.select("first").orderBy(F.xxhash64("run", "chunk")).limit(splitters).collect()
    keys = sorted({bytes(r["first"]) for r in drawn})
    outer = min(wanted, len(keys))
    sent = spark.sparkContext.broadcast(sorted({keys[i * len(keys) // outer] for i in range(1, outer)}) if keys else [])
    parts = -(-wanted // max(1, outer))
    carried = ("run", "chunk", "first", "last", "prefix", "rest", "counts")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = sent.value
        for batch in batches:
            low = [bisect.bisect_right(cuts, x) for x in batch.column("first").to_pylist()]
            high = [bisect.bisect_right(cuts, x) for x in batch.column("last").to_pylist()]
            of = np.repeat(np.arange(batch.num_rows), np.array(high, int) - np.array(low, int) + 1)
            number = [k for a, b in zip(low, high, strict=True) for k in range(a, b + 1)]
            bounds = [pa.array([cuts[k + d] if 0 <= k + d < len(cuts) else None for k in number], pa.binary()) for d in (-1, 0)]
            columns = [pa.array(number, pa.int32()), pa.array(np.zeros(len(of), np.int32)), *bounds, *(batch.column(x).take(pa.array(of)) for x in carried)]
            yield pa.RecordBatch.from_arrays(columns, ["range", "sub", "low", "high", *carried])

    schema = "range int, sub int, low binary, high binary, run string, chunk int, first binary, last binary, prefix binary, rest binary, counts binary"
    out = runs.select(*carried).mapInArrow(spread, schema)
    if parts == 1:
        return out.drop("first", "last")
    kinds = {"int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    arrow = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                keys = r.pop("keys") or []
                cuts = sorted({keys[i * len(keys) // parts] for i in range(1, parts)} - {r["low"]}) if keys else []
                a = bisect.bisect_right(cuts, max(r["first"], r["low"] or b""))
                b = bisect.bisect_right(cuts, r["last"])
                for k in range(a, b + 1):
                    rows.append(r | {"sub": k, "low": cuts[k - 1] if k else r["low"], "high": cuts[k] if k < len(cuts) else r["high"]})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    out = shared.settled(out, "ranges")
    inside = out.filter(F.col("low").isNull() | (F.col("first") >= F.col("low")))
    few = inside.filter(F.pmod(F.xxhash64("chunk", "run"), F.greatest(F.lit(1), F.lit(wanted // (outer * 64)))) == 0)  # some 64 a part
    keys = few.groupBy("range").agg(F.sort_array(F.collect_list("first")).alias("keys"))
    return out.join(keys.hint("merge"), "range", "left").mapInArrow(cut, schema).drop("first", "last")


def repeated_anchors(docs: DataFrame, per_range: int = RANGE, splitters: int = SPLITTERS, hot: int = HOT) -> DataFrame:
    """(doc_id, h, places, hots) of the anchors whose suffix key stands elsewhere too; hots: those of them that
    stand more than hot times."""
    runs = shared.settled(sorted_runs(docs), "runs")

    def merge(table: pa.Table) -> pa.Table:
        low, high = (table.column(x)[0].as_py() for x in ("low", "high"))
        rows = sorted(zip(*(table.column(x).to_pylist() for x in ("run", "chunk", "prefix", "rest", "counts")), strict=True), key=lambda r: r[:2])
        counts = {r[:2]: np.frombuffer(r[4], np.uint32).tolist() for r in rows}
        found = {k: np.zeros(len(x), np.uint8) for k, x in counts.items()}
        names = sorted({r[0] for r in rows})
        chunks: dict[str, list] = {x: [] for x in names}
        for run, chunk, prefix, rest, _ in rows:
            chunks[run].append((chunk, prefix, [KEY] * len(prefix), rest))
        group: list[tuple] = []

        def close() -> None:
            times = sum(counts[k][i] for k, i in group)
            if times > 1:
                for k, i in group:
                    found[k][i] = 1 + (times > hot)

        for prefix, run, chunk, entry in merged([Run(chunks[x], low, high) for x in names]):
            if prefix < KEY:
                close()
                group = []
            group.append(((names[run], chunk), entry))
        close()
        kept = [(r, c, np.packbits(x > 0).tobytes(), np.packbits(x > 1).tobytes()) for (r, c), x in found.items() if x.any()]
        columns = list(zip(*kept, strict=True)) or [[], [], [], []]
        return pa.table({"run": pa.array(columns[0], pa.string()), "chunk": pa.array(columns[1], pa.int32()), "found": pa.array(columns[2], pa.binary()), "hot": pa.array(columns[3], pa.binary())})

    found = ranged(runs, per_range, splitters).groupBy("range", "sub").applyInArrow(merge, "run string, chunk int, found binary, hot binary")
    found = found.groupBy("run", "chunk").agg(F.collect_list("found").alias("found"), F.collect_list("hot").alias("hot"))  # one per range that the chunk meets
    both = runs.select("run", "chunk", "counts", "docs", "texts", "places").join(shared.settled(found, "found").hint("merge"), ["run", "chunk"])

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        any_of = lambda masks, n: np.unpackbits(np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in masks]), count=n).astype(bool)
        for batch in batches:
            for counts, docs_, texts, places, masks, hots in zip(*(batch.column(x).to_pylist() for x in ("counts", "docs", "texts", "places", "found", "hot")), strict=True):
                counts = np.frombuffer(counts, np.uint32)
                keep = np.repeat(any_of(masks, len(counts)), counts)
                columns = [pa.array(np.frombuffer(x, np.int64)[keep]) for x in (docs_, texts, places)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.repeat(any_of(hots, len(counts)), counts)[keep])], ["doc_id", "h", "place", "hot"])

    places = both.mapInArrow(located, "doc_id long, h long, place long, hot boolean")
    return places.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("place")).alias("places"), F.sort_array(F.collect_set(F.when(F.col("hot"), F.col("place")))).alias("hots"))


BLOCKS = "block string, docs array<long>, hs array<long>, texts array<binary>, places array<array<long>>, hots array<array<long>>"


def blocked(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Texts with repeated anchors, gathered into blocks under names of their own."""
    of = found.select(F.col("doc_id").alias("of_"), F.col("h").alias("of_h"), "places", "hots")
    rows = docs.join(of.hint("merge"), (F.coalesce("doc_id", F.lit(0)) == F.col("of_")) & (F.col("h") == F.col("of_h")))
    rows = rows.select(F.col("of_").alias("doc_id"), "h", F.col("text").cast("binary").alias("text"), "places", "hots")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            name = pa.array([uuid.uuid4().hex])
            longs = pa.list_(pa.int64())
            kinds = (longs, longs, pa.list_(pa.binary()), pa.list_(longs), pa.list_(longs))
            columns = [pa.array([list(x)], k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([name, *columns], ["block", "docs", "hs", "texts", "places", "hots"])

        for batch in batches:
            for row in _rows(batch, "doc_id", "h", "text", "places", "hots"):
                held.append([x.as_py() for x in row])
                size += len(held[-1][2])
                if size >= BLOCK_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return shared.settled(rows.mapInArrow(gather, BLOCKS), "blocks")


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[list]:
    for i in range(batch.num_rows):
        yield [batch.column(x)[i] for x in names]


class Block:
    """A block's texts end to end, and the ranges of neighbouring strings around one repeated anchor: first and
    last start, the anchor, and whether it is hot. Ranges whose bytes and anchor's place are equal are one kind
    (kind: of each range; stands: the range that stands for it; many: whether it stands for more)."""

    def __init__(self, texts: pa.ListScalar, places: pa.ListScalar, hots: pa.ListScalar):
        data, at = shared.text_bytes(texts.values)
        self.data, self.at = data[at[0] : at[-1]], at - at[0]
        repeated, hot = self._marked(places), self._marked(hots)
        found: list[tuple[np.ndarray, ...]] = []
        self.strings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of hot ranges: starts and two hashes
        for _, base, own, ends in sections(self.data, self.at):
            starts, anchors, sums = anchored(own, ends)
            keep = repeated[anchors + base]
            starts, anchors = starts[keep], anchors[keep]
            new = np.ones(len(starts), bool)
            new[1:] = (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1)
            begin = np.flatnonzero(new)
            found.append((starts[begin] + base, starts[np.append(begin[1:], len(starts)) - 1] + base if len(begin) else begin, anchors[begin] + base))
            burning = starts[hot[anchors + base]]
            if len(burning):
                self.strings.append((burning + base, *_hashes(own, sums, burning)))
        self.first, self.last, self.anchor = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        cold = ~hot[self.anchor]
        self.first, self.last, self.anchor = self.first[cold], self.last[cold], self.anchor[cold]
        text, kinds = self.data.tobytes(), {}
        self.kind = np.zeros(len(self.first), np.int64)
        for i, (a, z, p) in enumerate(zip(self.first.tolist(), self.last.tolist(), self.anchor.tolist(), strict=True)):
            self.kind[i] = kinds.setdefault((p - a, text[a : z + LENGTH]), len(kinds))
        self.kinds = list(kinds)
        self.many = np.bincount(self.kind, minlength=len(kinds)) > 1

    def _marked(self, places: pa.ListScalar) -> np.ndarray:
        out, own = np.zeros(len(self.data) + 1, bool), places.values
        out[own.flatten().to_numpy() + np.repeat(self.at[:-1], pa.compute.list_value_length(own).to_numpy())] = True
        return out


def _hashes(data: np.ndarray, sums: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the strings that start there."""
    other = np.zeros(len(starts), np.uint64)
    for i in range(0, LENGTH, 25):
        other = other * np.uint64(0x100000001B3) + data[starts + i]
    return shared.span_hash(sums, starts, starts + LENGTH), shared.mix(other)


def _by_bucket(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), order[cuts[k] : cuts[k + 1]]


def equal_strings(prefix: np.ndarray, backward: list[bytes], low: np.ndarray, high: np.ndarray, times: np.ndarray) -> np.ndarray:
    """[entry, o]: whether the string with the anchor at place o stands elsewhere too. Entries are in the order
    of their suffixes; prefix: what each shares with the one before; backward: what stands before the anchor,
    read backwards; low, high: the places o of the entry's own strings; times: how many ranges it stands for."""
    n = len(prefix)
    group = np.cumsum(prefix < KEY)
    turned = sorted(range(n), key=lambda i: (group[i], backward[i]))
    behind = np.zeros(n, np.int64)  # in the backward order: what each shares with the one before; -1 across anchors
    for j in range(n):
        i, before = turned[j], turned[j - 1]
        behind[j] = common(backward[before], backward[i], 0) if j and group[i] == group[before] else -1
    turned_ = np.array(turned, np.int64)
    out, mine = np.zeros((n, LENGTH - KEY + 1), bool), np.empty(n, np.int64)
    for o in range(int(low.min(initial=LENGTH)), int(high.max(initial=-1)) + 1):
        mine[turned_] = np.cumsum(behind < o)
        own = np.flatnonzero((low <= o) & (o <= high))
        both = np.cumsum(prefix < LENGTH - o)[own] * (n + 1) + mine[own]
        order = np.argsort(both, kind="stable")
        new = np.ones(len(own), bool)
        new[1:] = both[order][1:] != both[order][:-1]
        of = np.cumsum(new) - 1
        out[own[order], o] = np.bincount(of, times[own[order]])[of] > 1
    return out


ENTRIES = "bucket long, block string, kinds binary, prefix binary, lengths binary, rest binary, turns binary, backward binary, spans binary, many binary"


def decided(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, decided): which strings of which kinds of ranges stand elsewhere too, by the merged suffixes."""
    names = [x.split()[0] for x in ENTRIES.split(", ")]
    coded = {"kinds": np.uint32, "prefix": np.uint16, "lengths": np.uint16, "turns": np.uint16, "spans": np.uint16, "many": np.uint8}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, texts, places, hots in _rows(batch, "block", "texts", "places", "hots"):
                own = Block(texts, places, hots)
                runs: dict[int, list] = {}
                for kind, (k, body) in enumerate(own.kinds):
                    runs.setdefault(zlib.crc32(body[k : k + KEY]) % buckets, []).append((body[k:], kind, k, body))
                for bucket, run in runs.items():
                    run.sort(key=lambda e: e[0])
                    suffixes = [e[0] for e in run]
                    shares = [0, *(common(a, b, 0) for a, b in zip(suffixes, suffixes[1:], strict=False))]
                    kinds = [e[1] for e in run]
                    spans_ = [x for _, _, k, body in run for x in (LENGTH + k - len(body), k)]
                    numbers = {"kinds": kinds, "prefix": shares, "lengths": list(map(len, suffixes)), "turns": [e[2] for e in run], "spans": spans_, "many": own.many[kinds]}
                    values = {x: np.array(v, coded[x]).tobytes() for x, v in numbers.items()}
                    values |= {"bucket": bucket, "block": name.as_py(), "rest": b"".join(x[p:] for x, p in zip(suffixes, shares, strict=True)), "backward": b"".join(e[3][: e[2]][::-1] for e in run)}
                    yield pa.RecordBatch.from_pylist([values], schema=pa.schema([("bucket", pa.int64()), ("block", pa.string()), *((x, pa.binary()) for x in names[2:])]))

    def meet(table: pa.Table) -> pa.Table:
        rows = table.sort_by("block").to_pylist()
        own = [{x: np.frombuffer(r[x], kind) for x, kind in coded.items()} for r in rows]
        runs = [Run([(0, x["prefix"].tolist(), x["lengths"].tolist(), r["rest"])]) for x, r in zip(own, rows, strict=True)]
        ends = [np.concatenate([[0], np.cumsum(x["turns"], dtype=np.int64)]).tolist() for x in own]
        order = [(prefix, run, entry) for prefix, run, _, entry in merged(runs)]
        prefix, run, entry = (np.array(x, np.int64) for x in zip(*order, strict=True))
        backward = [rows[r]["backward"][ends[r][i] : ends[r][i + 1]] for r, i in zip(run.tolist(), entry.tolist(), strict=True)]
        starts = np.cumsum([0, *(len(x["kinds"]) for x in own)])
        at = starts[run] + entry
        span = np.concatenate([x["spans"].reshape(-1, 2) for x in own]).astype(np.int64)[at]
        times = 1 + np.concatenate([x["many"] for x in own])[at].astype(np.int64)
        found = np.zeros((len(at), LENGTH - KEY + 1), bool)
        found[at] = equal_strings(prefix, backward, span[:, 0], span[:, 1], times)
        out = []
        for i, r in enumerate(rows):
            part = found[starts[i] : starts[i + 1]]
            hit = part.any(1)
            if hit.any():
                out.append((r["block"], own[i]["kinds"][hit].tobytes(), np.packbits(part[hit], axis=1).tobytes()))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"block": pa.array(columns[0], pa.string()), "kinds": pa.array(columns[1], pa.binary()), "places": pa.array(columns[2], pa.binary())})

    met = blocks.select("block", "texts", "places", "hots").mapInArrow(send, ENTRIES).groupBy("bucket").applyInArrow(meet, "block string, kinds binary, places binary")
    return met.groupBy("block").agg(F.collect_list(F.struct("kinds", "places")).alias("decided"))


def hot_hashes(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, hashes): of the strings around hot anchors those that stand twice or more."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, texts, places, hots in _rows(batch, "block", "texts", "places", "hots"):
                own = Block(texts, places, hots)
                if not own.strings:
                    continue
                value, other = (np.concatenate([x[i] for x in own.strings]) for i in (1, 2))
                unique, first, n = np.unique(value, return_index=True, return_counts=True)
                for k, at in _by_bucket((other[first] % np.uint64(buckets)).astype(np.int64), buckets):
                    columns = [pa.array([k], pa.int64()), pa.array([name.as_py()]), pa.array([unique[at].tobytes()], pa.binary()), pa.array([np.packbits(n[at] > 1).tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "hashes", "twice"])

    def meet(table: pa.Table) -> pa.Table:
        names = table.column("block").to_pylist()
        own = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(y)).astype(bool) for x, y in zip(table.column("twice").to_pylist(), own, strict=True)]
        every = np.sort(np.concatenate([*own, *(x[t] for x, t in zip(own, twice, strict=True))]))
        again = np.unique(every[1:][every[1:] == every[:-1]])
        kept = [(name, x[np.isin(x, again, assume_unique=True)].tobytes()) for name, x in zip(names, own, strict=True)]
        kept = [x for x in kept if x[1]]
        return pa.table({"block": pa.array([x[0] for x in kept], pa.string()), "hashes": pa.array([x[1] for x in kept], pa.binary())})

    burning = blocks.filter(F.exists("hots", lambda x: F.size(x) > 0)).select("block", "texts", "places", "hots")
    met = burning.mapInArrow(send, "bucket long, block string, hashes binary, twice binary").groupBy("bucket").applyInArrow(meet, "block string, hashes binary")
    return met.groupBy("block").agg(F.collect_list("hashes").alias("hashes"))


def spans(blocks: DataFrame) -> DataFrame:
    """(doc_id, h, n_removed, n_spans, kept_sha256) of each text of a block that loses bytes."""
    size = blocks.select(F.sum(F.expr("aggregate(texts, 0L, (n, x) -> n + length(x))"))).first()[0] or 0
    buckets = max(1, size // BUCKET_BYTES)
    both = blocks.join(shared.settled(decided(blocks, buckets), "decided").hint("merge"), "block", "left")
    both = both.join(shared.settled(hot_hashes(blocks, buckets), "hot").hint("merge"), "block", "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = LENGTH - KEY + 1
        for batch in batches:
            for docs_, hs, texts, places, hots, judged, hashes in _rows(batch, "docs", "hs", "texts", "places", "hots", "decided", "hashes"):
                own = Block(texts, places, hots)
                stands = np.zeros((len(own.kinds), width), bool)
                for x in judged.as_py() or []:
                    bits = np.unpackbits(np.frombuffer(x["places"], np.uint8).reshape(-1, -(-width // 8)), axis=1, count=width)
                    stands[np.frombuffer(x["kinds"], np.uint32)] = bits.astype(bool)
                steps = np.zeros(len(own.data) + 1, np.int64)
                hit = np.flatnonzero(stands.any(1)[own.kind]) if len(own.kinds) else np.zeros(0, np.int64)
                for a in range(0, len(hit), 4096):
                    part = hit[a : a + 4096]
                    i, o = np.nonzero(stands[own.kind[part]])
                    starts = own.anchor[part][i] - o
                    np.add.at(steps, starts, 1)
                    np.add.at(steps, starts + LENGTH, -1)
                found = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in hashes.as_py() or [])])
                for starts, value, _ in own.strings:
                    again = starts[np.isin(value, found)]
                    np.add.at(steps, again, 1)
                    np.add.at(steps, again + LENGTH, -1)
                gone, out = np.cumsum(steps[:-1]) > 0, []
                for i, (doc, h) in enumerate(zip(docs_.as_py(), hs.as_py(), strict=True)):
                    part = slice(own.at[i], own.at[i + 1])
                    lost = gone[part]
                    if lost.any():
                        n = int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum())
                        out.append((doc, h, int(lost.sum()), n, hashlib.sha256(own.data[part][~lost].tobytes()).hexdigest()))
                columns = list(zip(*out, strict=True)) or [[], [], [], [], []]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["doc_id", "h", "n_removed", "n_spans", "kept_sha256"])

    return both.mapInArrow(remove, "doc_id long, h long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, per_range: int = RANGE, splitters: int = SPLITTERS, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row. The parameters change the work's shape
    alone, not the result."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    found = shared.settled(repeated_anchors(docs, per_range, splitters, hot), "anchors")
    cut = shared.settled(spans(blocked(docs, found)).dropDuplicates(["doc_id", "h"]), "spans")
    cut = cut.select(F.col("doc_id").alias("of_"), F.col("h").alias("of_h"), "n_removed", "n_spans", F.col("kept_sha256").alias("kept"))
    rows = docs.select("doc_id", "h", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    rows = rows.join(cut.hint("merge"), (F.coalesce("doc_id", F.lit(0)) == F.col("of_")) & (F.col("h") == F.col("of_h")), "left")
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(shared.table(spark, sf_dir, "documents"))
