"""MinHash near-duplicate detection by min-max hashing.

A document's set is its distinct word shingles. Under each of PERMUTATIONS permutations both the least and
the greatest hash of the set are kept: half the hash evaluations for as many signature values, of lower
variance. Bands of ROWS values are hashed into buckets; documents that share a bucket are candidates, and
every link is confirmed on the full sets (64-bit shingle hashes).

Equal sets are one node, however many documents have them. Buckets do not yield all their pairs: first each
member is held against its buckets' hubs only, the members that meet the most others, and components are
found. Then the members of buckets that span components are joined on their rarest shingles: two sets of
different components can be linked only if they share one of these, early enough in both sets for what
follows to suffice (prefix and place filtering). So a group of thousands of near copies costs a few pairs
per member, and no possible link between components is skipped. At similarity 0.85 a pair shares no bucket
with probability 1e-8.

Defined cases: null texts and those without words have the empty set and are linked with nothing; with
fewer words than a shingle, the whole sequence is the only shingle; rows without a doc_id take part, and
a component's id is the least doc_id in it, null if there is none; repeated rows are equal sets; of rows
that share the kept doc_id all are kept by documents(), which keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import shared

PERMUTATIONS, ROWS = 48, 4

_SEEDS = shared.mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of texts that lie end to end, ascending within each, and offsets."""
    h, first = shared.words(data, at)
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(count)])
    where = np.arange(ends[-1]) + np.repeat(first[:-1] - ends[:-1], count)
    left = np.repeat(np.minimum(n, width), count)
    sums = np.zeros(len(where), np.uint64)
    for i in range(width):
        use = left > i
        sums[use] = shared.mix(sums[use] * np.uint64(3) + h[where[use] + i] + np.uint64(i + 1))
    row = np.repeat(np.arange(len(n)), count)
    order = np.lexsort((sums, row))
    sums = sums[order]
    new = np.ones(len(sums), bool)
    new[1:] = (sums[1:] != sums[:-1]) | (row[1:] != row[:-1])
    return sums[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def node_of(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for empty ones."""
    n = np.diff(ends)
    some, out = np.flatnonzero(n), np.zeros(len(n), np.uint64)
    if len(some):
        out[some] = shared.mix(np.add.reduceat(shared.mix(sets), ends[:-1][some]) + n[some].astype(np.uint64))
    return out


def min_max(sets: np.ndarray, at: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Per set the least and the greatest hash under each permutation; sets are not empty."""
    out = np.empty((len(at) - 1, 2 * permutations), np.uint64)
    for i, seed in enumerate(_SEEDS[:permutations]):
        v = sets * seed
        v ^= v >> np.uint64(32)
        out[:, 2 * i] = np.minimum.reduceat(v, at[:-1])
        out[:, 2 * i + 1] = np.maximum.reduceat(v, at[:-1])
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash for each run of rows values, different for each run."""
    parts = signature.reshape(len(signature), -1, rows)
    sums = np.zeros(parts.shape[:2], np.uint64) + np.arange(1, parts.shape[1] + 1, dtype=np.uint64)
    for i in range(rows):
        sums = shared.mix(sums * np.uint64(5) + parts[:, :, i])
    return sums


def _listed(values: np.ndarray) -> pa.Array:
    flat = pa.array(values.reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * (values.shape[1] if len(values) else 0)), flat)


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, node (a 64-bit hash of the set; null without words), n_shingles and band hashes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.lean()
        for batch in batches:
            data, at = shared.text_bytes(batch.column("text"))
            for lo, hi in shared.slices(at):
                sets, ends = shingle_sets(data, at[lo : hi + 1], width)
                n = np.diff(ends)
                some, node = np.flatnonzero(n), node_of(sets, ends)
                found = np.zeros((hi - lo, 2 * PERMUTATIONS // ROWS), np.uint64)
                if len(some):
                    starts = ends[:-1][some]
                    found[some] = bands(min_max(sets, np.append(starts, len(sets))))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(node.view(np.int64), mask=n == 0), pa.array(n), _listed(found)], ["doc_id", "node", "n_shingles", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, node long, n_shingles long, bands array<long>")


def candidate_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, set) for the given nodes, as bytes of ascending 64-bit hashes."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.lean()
        for batch in batches:
            data, at = shared.text_bytes(batch.column("text"))
            for lo, hi in shared.slices(at):
                sets, ends = shingle_sets(data, at[lo : hi + 1], width)
                own, spans = node_of(sets, ends), list(zip(ends[:-1], ends[1:], strict=True))
                for i in np.flatnonzero(own == batch.column("node").slice(lo, hi - lo).to_numpy().view(np.uint64)):
                    yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo + i, 1), pa.array([sets[slice(*spans[i])].tobytes()], pa.binary())], ["node", "set"])

    of = nodes.select(F.col("doc_id").alias("of_"), "node")
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(of.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of_")))
    return rows.select("node", "text").mapInArrow(collect, "node long, set binary").groupBy("node").agg(F.any_value("set").alias("set"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their sets."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    both = pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                short, long_ = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(long_, short)
                both_ = int((long_[np.minimum(at, len(long_) - 1)] == short).sum())
                keep.append(100 * both_ >= percent * (len(x) + len(y) - both_))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return both.mapInArrow(confirm, "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for all nodes with links; label is the least node reachable. Alternates the large-star
    and small-star steps, which end in stars around the least nodes."""

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))

    edges = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = shared.settled(edges, name), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lows = least(down)
        small = down.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lows.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = shared.settled(small, name)
        # stars around least nodes are a fixed point: then neither the number of links nor their sum changes
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """(node, shingle, n, place): of each set the shingles, rarest first, of which two sets that can be
    linked share one at least: all but percent of the set, and one. Those no other set has are left out."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, raw in zip(batch.column("node").to_pylist(), batch.column("set"), strict=True):
                own = np.frombuffer(raw.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), node)), pa.array(own), pa.array(np.full(len(own), len(own)))], ["node", "shingle", "n"])

    rows = sets.mapInArrow(spread, "node long, shingle long, n long")
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    rows = rows.join(often.hint("merge"), "shingle", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle"))
    rows = rows.withColumn("place", place).filter(f"place <= n - ({percent} * n + 99) div 100 + 1 and often > 1")
    return rows.select("node", "shingle", "n", "place")


def linked(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, labels): doc_id, node and n_shingles per document, and the label of each linked node."""
    rows = signed(docs, width)
    rows = shared.settled(rows, "signatures", shared.ARROW_SMALL)
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"))
    buckets = nodes.select("node", "doc_id", "n", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = shared.settled(buckets.join(sizes.hint("merge"), "bucket"), "buckets")
    sets = shared.settled(candidate_sets(docs, members.select("node", "doc_id").distinct(), width), "sets", shared.ARROW_SMALL)

    # a bucket's hub is the member that meets the most others, over all of its buckets
    met = members.groupBy("node").agg(F.sum("size").alias("met"))
    hubs = members.join(met.hint("merge"), "node").groupBy("bucket").agg(F.max(F.struct("met", "node", "n")).alias("hub"))
    hubs = hubs.select("bucket", F.col("hub.node").alias("a"), F.col("hub.n").alias("n_a"))
    near = f"100 * least(n_a, n) >= {percent} * greatest(n_a, n)"
    tried = members.join(hubs.hint("merge"), "bucket").filter("node <> a").filter(near)
    tried = shared.settled(tried.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct(), "pairs")
    found = shared.settled(confirmed(tried, sets, percent), "links", shared.ARROW_SMALL)
    labels = shared.settled(components(found), "labels")

    now = members.select("bucket", "node", "n").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    spread = now.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket")
    spanned = shared.settled(now.join(spread.hint("merge"), "bucket").select("node", "label").distinct(), "open")
    rare = rare_first(sets.join(spanned.hint("merge"), "node", "left_semi"), percent)
    rare = shared.settled(rare.join(spanned.hint("merge"), "node"), "rare")
    other = rare.select("shingle", *(F.col(x).alias(f"{x}_b") for x in ("node", "n", "place", "label")))
    # the first shingle that two sets share leaves so many, at most, for their intersection
    enough = f"label <> label_b and node < node_b and (100 + {percent}) * (1 + least(n - place, n_b - place_b)) >= {percent} * (n + n_b)"
    pairs = rare.join(other.hint("merge"), "shingle").filter(enough).select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()
    pairs = shared.settled(pairs.join(tried.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    more = shared.settled(confirmed(pairs, sets, percent), "links", shared.ARROW_SMALL)
    if not more.isEmpty():
        labels = shared.settled(components(found.unionByName(more)), "labels")
    return rows, labels


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and whether it is the one kept."""
    rows, labels = linked(docs, width, percent)
    named = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("low")).join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("low").alias("component_id"))
    named = shared.settled(named.select("node", "label").join(least.hint("merge"), "label").select("node", "component_id"), "named")
    out = rows.select("doc_id", "node", "n_shingles").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group; rows without a doc_id stay."""
    gone = deduplicated(docs, width, percent).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone.hint("merge"), F.col("doc_id") == F.col("__gone"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(shared.table(spark, sf_dir, "documents"), 3, 85)
