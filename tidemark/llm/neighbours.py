"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree is fitted on a bounded sample (SAMPLE distinct vectors, by seeded hash): a node's hyperplane stands
between two of its vectors, at the median, and a node of at most LEAF sampled vectors is a leaf. Where the
table is larger than the sample, every leaf is split on by as many random hyperplanes as its growth doubles,
through the median of its own sampled vectors: leaves hold about LEAF rows whatever the table's size. Every
vector is indexed. A query walks all trees at once from one priority queue: the branch whose squared margins
on the way down sum up to the least is followed next, until its leaves hold as many distinct vectors as wanted.

What travels. Only distinct vectors are indexed, each with its k + 1 smallest vec_ids: no other id of equal
vectors can be among k nearest, so a hot vector is k + 1 rows and nothing is lost. Likewise equal queries are
one. Trees carry ids and 16-bit codes of the vectors; a leaf's rows meet its visits as blocks. A block drops
the pairs that, by the codes' error bound, cannot reach the k + 1 nearest of the query's sampled candidates;
what is left of a query, mostly a few dozen pairs, is compared in double precision on the original vectors.

How much is compared. On isotropic vectors, the hard case, recall 0.9 takes about a share of N ** -0.2 of the
rows: budget() has the figures that the README lists.

Defined cases: vectors that are null, zero, or hold null or non-finite components, or are of another length
than most, take no part; a query with fewer candidates gets all; ties go to the smaller vec_id; rows of the
same vec_id are one candidate, the nearest of them; without rows there is no result; extra columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import shared

TREES, LEAF, SAMPLE, SEED = 16, 32, 16384, 17
#: Rows, or visits, of a leaf that meet as one block; queries that a task walks the trees for.
BLOCK_ROWS, WALKS = 4096, 64
QUERY_EVERY, K = 50, 5


def budget(rows: int) -> float:
    """Distinct vectors that a query's leaves should hold."""
    return 2.8 * max(1, rows) ** 0.8


class Forest:
    """Trees as arrays. Inner nodes: planes, offsets, children (a leaf is -(number + 1)); roots: one per tree.
    Leaves: tree_of, and the offsets of the random planes (deep: [tree, level]) that split them on. A code is
    a leaf's number and a bit per level. codes and members: the sampled vectors by the code they lie in."""

    FIELDS = ("planes", "offsets", "children", "roots", "tree_of", "deep", "leaf_offsets", "codes", "members")

    def __init__(self, *fields: np.ndarray):
        for name, value in zip(self.FIELDS, fields, strict=True):
            setattr(self, name, value)
        self.extra = self.leaf_offsets.shape[1]
        first = np.flatnonzero(np.diff(self.codes, prepend=-1))
        self.inside = dict(zip(self.codes[first].tolist(), np.split(self.members, first[1:]), strict=True)) if len(first) else {}

    def fields(self) -> tuple[np.ndarray, ...]:
        return tuple(getattr(self, x) for x in self.FIELDS)

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED, extra: int = 0) -> Forest:
        """sample: unit vectors; equal ones, but for rounding, are one."""
        sample = sample[np.sort(np.unique(np.round(sample, 9) + 0.0, axis=0, return_index=True)[1])]
        random, width = np.random.default_rng(seed), sample.shape[1]
        planes, offsets, children, roots, tree_of, leaves = [], [], [], [], [], []

        def split(rows: np.ndarray) -> tuple[np.ndarray, float, np.ndarray] | None:
            for _ in range(4):
                a, b = sample[random.choice(rows, 2, replace=False)]
                if (norm := np.linalg.norm(a - b)) < 1e-9:
                    continue
                plane = ((a - b) / norm).astype(np.float32)
                side = sample[rows] @ plane
                offset = float(np.median(side))
                right = side > offset
                if 0.05 * len(rows) < right.sum() < 0.95 * len(rows):
                    return plane, offset, right
            return None

        for t in range(trees):
            roots.append(0)
            todo = [(np.arange(len(sample)), roots, len(roots) - 1)]
            while todo:
                rows, of, at = todo.pop()
                found = split(rows) if len(rows) > leaf else None
                if found is None:
                    leaves.append(rows)
                    tree_of.append(t)
                    of[at] = -len(leaves)
                    continue
                of[at] = len(planes)
                planes.append(found[0])
                offsets.append(found[1])
                children.append([0, 0])
                todo += [(rows[~found[2]], children[-1], 0), (rows[found[2]], children[-1], 1)]
        deep = random.normal(size=(trees, extra, width))
        deep /= np.maximum(np.linalg.norm(deep, axis=2, keepdims=True), 1e-12)
        leaf_offsets = np.zeros((len(leaves), extra))
        for number, rows in enumerate(leaves):
            if extra and len(rows):
                leaf_offsets[number] = np.median(sample[rows] @ deep[tree_of[number]].T, axis=0)
        nodes = np.array(planes, np.float32).reshape(-1, width), np.array(offsets), np.array(children, np.int64).reshape(-1, 2)
        none = np.zeros(0, np.int64)
        empty = cls(*nodes, np.array(roots), np.array(tree_of), deep, leaf_offsets, none, none)
        # where a vector on a plane goes is route()'s to say, for the sample as for all rows
        codes = empty.route(sample).reshape(-1)
        order = np.argsort(codes, kind="stable")
        return cls(*empty.fields()[:-2], codes[order], order // max(1, trees))

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """Each vector's code in each tree."""
        out = np.empty((len(vectors), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(vectors), root)
            while len(rows := np.flatnonzero(at >= 0)):
                node = at[rows]
                right = np.einsum("ij,ij->i", vectors[rows], self.planes[node]) > self.offsets[node]
                at[rows] = self.children[node, right.astype(int)]
            number = -at - 1
            side = vectors @ self.deep[t].T > self.leaf_offsets[number]
            out[:, t] = (number << self.extra) + (side << np.arange(self.extra)).sum(1)
        return out

    def search(self, vector: np.ndarray, wanted: float) -> list[int]:
        """Codes to look into, best first, over all trees from one queue, until they hold as many distinct
        sampled vectors as wanted."""
        margins = (self.planes @ vector - self.offsets).tolist()
        deeper = self.deep @ vector
        children, extra = self.children.tolist(), self.extra
        queue = [(0.0, int(r), 0, 0) for r in self.roots]
        heapq.heapify(queue)
        found, held, met = [], 0, np.zeros(int(self.members.max(initial=-1)) + 1, bool)
        while queue and held < wanted:
            past, node, level, bits = heapq.heappop(queue)
            while node >= 0:
                margin = margins[node]
                right = margin > 0
                heapq.heappush(queue, (past + margin * margin, children[node][not right], 0, 0))
                node = children[node][right]
            number = -node - 1
            for level in range(level, extra):  # noqa: B020, PLW2901
                margin = float(deeper[self.tree_of[number], level] - self.leaf_offsets[number, level])
                right = int(margin > 0)
                heapq.heappush(queue, (past + margin * margin, node, level + 1, bits | (1 - right) << level))
                bits |= right << level
            found.append((number << extra) + bits)
            if (own := self.inside.get(found[-1])) is not None:
                held += len(own) - int(np.count_nonzero(met[own]))
                met[own] = True
        return found

    def seen(self, codes: list[int]) -> np.ndarray:
        """The sampled vectors in some codes."""
        own = [x for c in codes if (x := self.inside.get(c)) is not None]
        return np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)


def units(column: pa.Array, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows of a list column as doubles, and their numbers."""
    n = len(column)
    length = np.array([0 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()], np.int64) if n else np.zeros(0, np.int64)
    rows = np.flatnonzero(length == width) if width else np.zeros(0, np.int64)
    if not len(rows):
        return np.zeros((0, width or 0)), rows
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(len(rows), width)
    good = np.isfinite(values).all(1) & (values != 0).any(1)
    return values[good], rows[good]


def normed(values: np.ndarray) -> np.ndarray:
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def packed(unit: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """16-bit codes of unit vectors, and their steps."""
    step = np.abs(unit).max(axis=1, initial=1e-12) / 32767
    codes = np.round(unit / step[:, None]).astype(np.int16)
    return pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(step)


def _gathered(rows: DataFrame, key: str, *names: str) -> DataFrame:
    """Per leaf the rows in blocks of at most BLOCK_ROWS."""
    line = Window.partitionBy("code").orderBy(key)
    rows = rows.withColumn("nth", F.row_number().over(line)).withColumn("block", F.expr(f"(nth - 1) div {BLOCK_ROWS}"))
    return rows.groupBy("code", "block").agg(F.collect_list(F.struct(key, *names)).alias("of"))


def usable(embedding: Column, width: int) -> Column:
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(embedding) == width) & F.coalesce(fine, F.lit(False)) & F.exists(embedding, lambda x: x != 0)


def search(vectors: DataFrame, every: int = QUERY_EVERY, k: int = K, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, candidates: float | None = None) -> DataFrame:
    """The k nearest found of each row whose vec_id is divisible by every. candidates: distinct sampled vectors
    that a query's leaves hold; None: as budget() says."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").filter("vec_id is not null and embedding is not null")
    widths = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not widths or not widths[0]["width"]:
        return spark.createDataFrame([], schema)
    width = widths[0]["width"]
    rows = rows.filter(usable(F.col("embedding"), width))
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    held = rows.dropDuplicates(["embedding", "vec_id"]).withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    held = shared.settled(held, "vectors")
    n = held.filter("nth = 1").count()
    drawn = held.filter("nth = 1").select("embedding").orderBy(F.xxhash64(F.lit(SEED), "embedding")).limit(sample).toArrow()  # at most sample rows
    values, _ = units(drawn["embedding"].combine_chunks(), width)
    if not len(values):
        return spark.createDataFrame([], schema)
    points = normed(values)
    extra = max(0, int(np.ceil(np.log2(n / len(points)))))
    forest = Forest.fit(points, trees, leaf, extra=extra)
    points = points[np.sort(np.unique(np.round(points, 9) + 0.0, axis=0, return_index=True)[1])].astype(np.float32)
    wanted = budget(n) * len(points) / n if candidates is None else candidates
    sent = spark.sparkContext.broadcast((forest.fields(), points))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Forest(*sent.value[0])
        for batch in batches:
            x, at = units(batch.column("embedding"), width)
            if not len(x):
                continue
            codes, (tiny, step) = f.route(normed(x)), packed(normed(x))
            keys = batch.column("vec_id").take(pa.array(at))
            for t in range(codes.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(codes[:, t]), keys, tiny, step], ["code", "vec_id", "tiny", "step"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query's leaves, and what its k + 1 nearest must reach: as near as the sampled vectors in there."""
        f, points = Forest(*sent.value[0]), sent.value[1]
        for batch in batches:
            x, at = units(batch.column("embedding"), width)
            x = normed(x)
            tiny, step = packed(x)
            for i, key in enumerate(batch.column("q").to_numpy()[at]):
                codes = f.search(x[i], wanted)
                near = points[f.seen(codes)] @ x[i].astype(np.float32)
                floor = float(np.partition(near, len(near) - k - 1)[len(near) - k - 1]) - 1e-5 if len(near) > k else -2.0
                same = lambda v, m=len(codes): pa.array([v]).take(pa.array(np.zeros(m, np.int64)))
                columns = [pa.array(codes, pa.int64()), same(int(key)), *(x.slice(i, 1).take(pa.array(np.zeros(len(codes), np.int64))) for x in (tiny, step)), same(floor)]
                yield pa.RecordBatch.from_arrays(columns, ["code", "q", "tiny", "step", "floor"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bounds of the cosines of a leaf's rows and visits, of those that may reach the floor."""
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                own, asks = (batch.column(c)[i].values for c in ("of", "asked"))
                grid = lambda s: np.frombuffer(b"".join(s.field("tiny").to_pylist()), np.int16).reshape(len(s), width).astype(np.float64)
                step, ask = own.field("step").to_numpy(), asks.field("step").to_numpy()
                near = (grid(asks) @ grid(own).T) * (ask[:, None] * step[None, :])
                off = 0.505 * np.sqrt(width) * (ask[:, None] + step[None, :]) + 1e-9
                q, j = np.nonzero(near + off >= asks.field("floor").to_numpy()[:, None])
                out.append((asks.field("q").to_numpy()[q], own.field("vec_id").to_numpy()[j], (near - off)[q, j], (near + off)[q, j]))
            columns = [np.concatenate(x) for x in zip(*out, strict=True)]
            if columns and len(columns[0]):
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["q", "vec_id", "low", "high"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (units(batch.column(c), width)[0] for c in ("embedding", "asked"))
            score = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("vec_id"), pa.array(score)], ["q", "vec_id", "score"])

    questions = rows.filter(F.col("vec_id") % every == 0).select("embedding").distinct().withColumn("q", F.monotonically_increasing_id())
    questions = shared.settled(questions, "questions")  # the numbers stay
    members = _gathered(held.select("vec_id", "embedding").mapInArrow(route, "code long, vec_id long, tiny binary, step double"), "vec_id", "tiny", "step")
    walked = questions.repartition(max(1, -(-questions.count() // WALKS)), "q")
    visits = _gathered(walked.mapInArrow(visit, "code long, q long, tiny binary, step double, floor double"), "q", "tiny", "step", "floor")
    met = members.select("code", "of").join(visits.select("code", F.col("of").alias("asked")).hint("merge"), "code")
    pairs = met.mapInArrow(compare, "q long, vec_id long, low double, high double")
    pairs = shared.settled(pairs.groupBy("q", "vec_id").agg(F.max("low").alias("low"), F.max("high").alias("high")), "pairs")
    line = Window.partitionBy("q").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pairs = pairs.withColumn("least", F.nth_value("low", k + 1).over(line)).filter("least is null or high >= least").select("q", "vec_id")
    both = pairs.join(held.select("vec_id", "embedding").hint("merge"), "vec_id").join(questions.select("q", F.col("embedding").alias("asked")).hint("merge"), "q")
    best = both.mapInArrow(exact, "q long, vec_id long, score double").groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    best = best.withColumn("place", order).filter(F.col("place") <= k + 1)
    asked = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "embedding"])
    asked = asked.join(questions.hint("merge"), "embedding").select(F.col("vec_id").alias("query_id"), "q")
    out = asked.join(best.hint("merge"), "q").filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(shared.table(spark, sf_dir, "embeddings"))
