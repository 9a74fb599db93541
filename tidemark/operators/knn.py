"""Classification by vectors: nearest neighbours' votes, nearest texts, shortlists, cascades, thresholds.

A query set meets an index in blocks: the index is spread over the cluster, the queries are sent to each
part in bounded blocks, every part yields each query's k best, and a top-k over these follows. So neither
side needs to fit in a broadcast, and no pair but the best leaves a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.schemas import UNCATEGORIZED

#: Rows of a block of queries, and of a part of the index, about.
QUERY_BLOCK, INDEX_BLOCK = 1024, 16384


def _blocked(rows: DataFrame, block: int, name: str) -> tuple[DataFrame, int]:
    n = rows.count()
    blocks = max(1, -(-n // block))
    return rows.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), blocks


def _best_of_labels(sims: np.ndarray, own: np.ndarray, labels: pa.Array, k: int) -> np.ndarray:
    """Per query the columns of the k labels whose best row is most similar, that row of each; own: the
    columns' ids, ascending."""
    codes = labels.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    columns = np.argsort(codes, kind="stable")
    groups = np.split(columns, np.flatnonzero(np.diff(codes[columns])) + 1)
    best = np.stack([g[sims[:, g].argmax(axis=1)] for g in groups], axis=1)
    order = np.lexsort((own[best], -np.round(np.take_along_axis(sims, best, 1), 9)), axis=1)[:, :k]
    return np.take_along_axis(best, order, 1)


def _found(queries: DataFrame, index: DataFrame, k: int, of_labels: bool = False) -> DataFrame:
    """(query_id, id, label, sim): each part's k most similar rows of each query; or, of its labels, the
    most similar row each of the k best."""
    queries, n_q = _blocked(queries.select("id", "vector"), QUERY_BLOCK, "q")
    index, n_i = _blocked(index.select("id", "vector", "label"), INDEX_BLOCK, "i")
    asked = queries.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_i - 1)))).withColumn("label", F.lit(None).cast("string"))
    held = index.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    both = asked.withColumn("asks", F.lit(True)).unionByName(held.withColumn("asks", F.lit(False)).withColumn("label", F.col("label").cast("string")))

    def best(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        if not asks.any() or asks.all():
            return table.schema.empty_table().select([]).append_column("query_id", pa.array([], pa.int64())).append_column("id", pa.array([], pa.int64())).append_column("label", pa.array([], pa.string())).append_column("sim", pa.array([], pa.float64()))
        ids = table.column("id").to_numpy()
        vectors = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        vectors /= np.maximum(np.sqrt((vectors * vectors).sum(1, keepdims=True)), 1e-12)
        own, order = ids[~asks], np.argsort(ids[~asks], kind="stable")
        own, rows = own[order], vectors[~asks][order]
        labels = table.column("label").take(pa.array(np.flatnonzero(~asks)[order]))
        sims = vectors[asks] @ rows.T
        top = _best_of_labels(sims, own, labels.combine_chunks(), k) if of_labels else np.argsort(-sims, axis=1, kind="stable")[:, :k]
        n = top.shape[1]
        flat = top.reshape(-1)
        return pa.table({"query_id": pa.array(np.repeat(ids[asks], n)), "id": pa.array(own[flat]), "label": labels.take(pa.array(flat)).combine_chunks(), "sim": pa.array(np.take_along_axis(sims, top, 1).reshape(-1))})

    return both.select("q", "i", "id", "vector", "label", "asks").groupBy("q", "i").applyInArrow(best, "query_id long, id long, label string, sim double")


def nearest(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(query_id, id, label, sim, place): each query's k most similar rows by the dot product of unit
    vectors, ties to the smaller id. queries: id, vector; index: id, vector, label."""
    found = _found(queries, index, k)
    line = Window.partitionBy("query_id").orderBy(F.round("sim", 9).desc(), "id")
    return found.withColumn("place", F.row_number().over(line)).filter(F.col("place") <= k)


def vote(neighbours: DataFrame) -> DataFrame:
    """(query_id, label, confidence): the label with most similarity (negative counts as none), an equal vote
    to the nearest row's; its share of all votes, 0 without any."""
    votes = neighbours.groupBy("query_id", "label").agg(F.sum(F.greatest("sim", F.lit(0.0))).alias("votes"), F.max("sim").alias("nearest"))
    best = F.max_by(F.struct("label", "votes"), F.struct(F.round("votes", 9), F.round("nearest", 9), "label"))
    out = votes.groupBy("query_id").agg(best.alias("b"), F.sum("votes").alias("total"))
    return out.select("query_id", F.col("b.label").alias("label"), F.when(F.col("total") > 0, F.col("b.votes") / F.col("total")).otherwise(0.0).alias("confidence"))


def best_text(queries: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(query_id, category, confidence): the category of the most similar text, clipped to [0, 1];
    Uncategorized below the threshold. texts: id, vector, label; a category may have several."""
    top = nearest(queries, texts, 1).withColumn("confidence", C.clip(F.col("sim")))
    category = F.when(F.col("confidence") >= threshold, F.col("label")).otherwise(UNCATEGORIZED)
    return top.select("query_id", category.alias("category"), "confidence")


def shortlist(queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(query_id, paths): the k categories whose best text is most similar, best first."""
    best = _found(queries, texts, k, of_labels=True).groupBy("query_id", "label").agg(F.max("sim").alias("sim"), F.min_by("id", F.struct(-F.col("sim"), "id")).alias("first"))
    line = Window.partitionBy("query_id").orderBy(F.round("sim", 9).desc(), "first")
    kept = best.withColumn("place", F.row_number().over(line)).filter(F.col("place") <= k)
    return kept.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]).alias("paths"))


def centroids(index: DataFrame) -> DataFrame:
    """(id, vector, label): the mean of each label's unit vectors."""
    each = index.withColumn("vector", C.unit(F.col("vector"))).select("label", F.posexplode("vector").alias("i", "x"))
    mean = each.groupBy("label", "i").agg(F.avg("x").alias("x"))
    out = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("vector"))
    return out.select(F.xxhash64("label").alias("id"), "vector", "label")


def cascade(answers: DataFrame, fallback: DataFrame, tau: float) -> DataFrame:
    """(id, label, kept): the answer where it is sure enough, else the fallback's. Both by id."""
    both = answers.join(fallback.select("id", F.col("label").alias("other")), "id", "left").withColumn("kept", F.col("confidence") >= tau)
    return both.select("id", F.when(F.col("kept"), F.col("label")).otherwise(F.col("other")).alias("label"), "kept")


def grid(spark, taus: list[float]) -> DataFrame:
    return spark.createDataFrame([(float(t),) for t in taus], "tau double")


def pick_tau(scored: DataFrame, taus: list[float], target: float, min_kept: int) -> DataFrame:
    """The least threshold that keeps enough answers of which enough are right; null if there is none.
    scored: confidence, right."""
    steps = scored.withColumn("tau", F.explode(F.array(*(F.lit(float(t)) for t in taus))))
    kept = steps.filter(F.col("confidence") >= F.col("tau")).groupBy("tau").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.col("right").cast("int")).alias("hits"))
    good = (F.col("kept") >= max(1, min_kept)) & (F.col("hits") / F.col("kept") >= target)
    return kept.agg(F.min(F.when(good, F.col("tau"))).alias("tau"))


def bands(scored: DataFrame, taus: list[float]) -> DataFrame:
    """(tau, answers, right) of the answers from each threshold up to the next."""
    steps = F.array(*(F.lit(float(t)) for t in taus))
    at = F.size(F.filter(steps, lambda x: x <= F.col("confidence")))
    rows = scored.withColumn("tau", F.get(steps, at - 1)).filter("tau is not null").groupBy("tau").agg(F.count(F.lit(1)).alias("answers"), F.sum(F.col("right").cast("int")).alias("right"))
    zero = F.lit(0).cast("long")
    return grid(scored.sparkSession, taus).join(rows, "tau", "left").select("tau", F.coalesce("answers", zero).alias("answers"), F.coalesce("right", zero).alias("right"))


class Softmax:
    """Multinomial logistic regression on unit vectors: weights that minimise the mean cross-entropy plus half of
    l2 times the squared weights, found by Spark's own solver over all rows, wherever they lie."""

    def __init__(self, classes: list[str], model: LogisticRegressionModel | None):
        self.classes, self.model = classes, model

    @staticmethod
    def _features(rows: DataFrame) -> DataFrame:
        return rows.withColumn("features", array_to_vector(C.unit(F.col("vector"))))

    @classmethod
    def fit(cls, rows: DataFrame, *, l2: float = 1e-5, steps: int = 300) -> Softmax:
        """rows: vector, label. One class needs no weights; without rows there is nothing to fit."""
        classes = [r["label"] for r in rows.select("label").distinct().orderBy("label").collect()]  # one row per class
        if not classes:
            raise ValueError("no labelled rows to fit")
        if len(classes) == 1:
            return cls(classes, None)
        numbered = cls._features(rows).withColumn("number", (F.array_position(F.lit(classes), F.col("label")) - 1).cast("double"))
        solver = LogisticRegression(labelCol="number", family="multinomial", regParam=l2, maxIter=steps, standardization=False)
        return cls(classes, solver.fit(numbered.select("features", "number")))

    def shares(self, rows: DataFrame) -> DataFrame:
        """rows with ``shares``, each class' probability in the order of classes."""
        if self.model is None:
            return rows.withColumn("shares", F.array(F.lit(1.0)))
        out = self.model.transform(self._features(rows))
        return out.select(*rows.columns, vector_to_array("probability").alias("shares"))

    def predict(self, rows: DataFrame) -> DataFrame:
        """(id, label, confidence) of rows with id and vector; of equal shares the first class."""
        best = self.shares(rows.select("id", "vector")).withColumn("confidence", F.array_max("shares"))
        label = F.element_at(F.lit(self.classes), F.array_position("shares", F.col("confidence")).cast("int"))
        return best.select("id", label.alias("label"), "confidence")


def beats(alone: float, curve: list[tuple[float, float]], other_alone: float, point: tuple[float, float], margin: float) -> bool:
    """Whether a student beats another: alone by a margin, and on some point of its curve in one of kept rate
    and accuracy without losing in the other."""
    kept, exact = point
    better = any((e >= exact and k > kept) or (e > exact and k >= kept) for k, e in curve)
    return better and alone >= other_alone + margin
