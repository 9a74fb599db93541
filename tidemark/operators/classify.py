"""Classification of writes by pluggable classifiers, in bounded batches on the workers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import UNCATEGORIZED

ANSWER = [T.StructField("category", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("provisional", T.BooleanType())]
#: Rows in one call of a classifier, and the columns that it reads.
CALL_ROWS = 256
READS = ["title", "description", "attributes"]
#: (category, confidence), or None where there is none.
Answer = tuple[str, float] | None


class Fatal(RuntimeError):
    """A classifier that cannot go on: the job stops instead of writing provisional answers."""


class Classifier(Protocol):
    """Answers listings (title, description, attributes) with (category, confidence), or None for what it
    could not answer in time. Paid ones also have usd, spent so far, and error, why the last call left some
    listings without an answer."""

    taxonomy_version: str

    def classify(self, listings: list[dict]) -> list[Answer]: ...


class Fake:
    """The title's first letter; for tests, it can be told to fail."""

    def __init__(self, taxonomy_version: str = "fake-0", fail: bool = False):
        self.taxonomy_version, self.fail = taxonomy_version, fail

    def classify(self, listings: list[dict]) -> list[Answer]:
        if self.fail:
            raise RuntimeError("told to fail")
        return [(f"Fake > {x['title'][0]}", 0.9) for x in listings]


class Chooser:
    """Picks among a shortlist by a function of the listing and its paths (a language model, say); under the
    threshold Uncategorized. ask returns (path, confidence) or (path, confidence, usd) and may raise.

    Calls run in threads, the i-th not before i / rate seconds; none starts once budget seconds have passed
    or a call has failed. Listings without a call have no answer. error says why a call failed; if none
    answered, the failure is raised."""

    def __init__(self, taxonomy_version: str, shortlist: Callable[[dict], list[str]], ask: Callable[[dict, list[str]], tuple], threshold: float = 0.0, *, rate: float = float("inf"), budget: float = float("inf"), threads: int = 8, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.taxonomy_version, self.shortlist, self.ask, self.threshold = taxonomy_version, shortlist, ask, threshold
        self.rate, self.budget, self.threads, self.clock, self.sleep = rate, budget, threads, clock, sleep
        self.usd, self.error = 0.0, None

    def _started(self, listings: list[dict], pool: ThreadPoolExecutor) -> Iterator[tuple[Future, list[str]]]:
        """The calls that may start, each when it is due, with the paths asked about."""
        began, calls = self.clock(), []
        for i, x in enumerate(listings):
            due = began + i / self.rate
            self.sleep(max(0.0, due - self.clock()))
            if self.clock() - began >= self.budget or any(c.done() and c.exception() for c in calls):
                return
            paths = self.shortlist(x)
            calls.append(pool.submit(self.ask, x, paths))
            yield calls[-1], paths

    def classify(self, listings: list[dict]) -> list[Answer]:
        self.error = None
        with ThreadPoolExecutor(self.threads) as pool:
            calls = list(self._started(listings, pool))
        failures = [e for c, _ in calls if (e := c.exception())]
        if fatal := next((e for e in failures if isinstance(e, Fatal)), None):
            raise fatal
        said = [None if c.exception() else (*c.result(), 0.0)[:3] for c, _ in calls]
        self.usd += sum(x[2] for x in said if x)
        if failures and not any(said):
            raise failures[0]
        self.error = repr(failures[0]) if failures else None
        kept = lambda x, paths: x[0] if x[0] in paths and x[1] >= self.threshold else UNCATEGORIZED
        out = [x and (kept(x, paths), x[1]) for x, (_, paths) in zip(said, calls, strict=True)]
        return out + [None] * (len(listings) - len(out))


class Walker:
    """Walks a tree a level at a time, the whole batch together: where a node has children, choose says which
    and how sure; an answer's confidence is the product along its way."""

    def __init__(self, taxonomy_version: str, children: dict[str, list[str]], choose: Callable[[dict, list[str]], tuple[str, float]]):
        self.taxonomy_version, self.children, self.choose = taxonomy_version, children, choose

    def classify(self, listings: list[dict]) -> list[Answer]:
        level = [("", 1.0)] * len(listings)
        while open_ := [i for i, (node, _) in enumerate(level) if self.children.get(node)]:
            for i in open_:
                node, sure = level[i]
                child, p = self.choose(listings[i], self.children[node])
                level[i] = child, sure * p
        return list(level)


REGISTRY: dict[str, Callable[[], Classifier]] = {"fake": Fake}


def fault(answer: object) -> str | None:
    """What is wrong with an answer, if anything: it is a category that is not empty and a confidence from 0 to 1."""
    match answer:
        case (str(category), int() | float() as confidence):
            if not category:
                return "empty category"
            return None if 0 <= confidence <= 1 else "confidence beyond 0 to 1"
        case None:
            return "no answer"
    return "not a category and a confidence"


def checked(answers: list, n: int) -> list[Answer]:
    """A call's answers, None in place of unsound ones; another number than n is no set of answers at all."""
    if len(answers) != n:
        raise ValueError(f"a classifier was asked about {n} listings and gave {len(answers)} answers")
    return [None if fault(x) else (x[0], float(x[1])) for x in answers]


def answered(model: Classifier, listings: list[dict]) -> list[Answer]:
    """The answers to all listings. A call that fails is split in halves until what fails is alone: that listing
    has no answer. Fatal failures go on."""
    out: list[Answer] = [None] * len(listings)
    todo = [range(len(listings))]
    while todo:
        part = todo.pop()
        try:
            got = checked(model.classify([listings[i] for i in part]), len(part))
        except Fatal:
            raise
        except Exception:
            half = len(part) // 2
            todo += [part[half:], part[:half]] if half else []
        else:
            out[part.start : part.stop] = got
    return out


def classified(rows: DataFrame, make: Callable[[], Classifier]) -> DataFrame:
    """rows (title, description, attributes as text, ...) with category, confidence and provisional; null
    categories are provisional: the classifier gave no sound answer. One classifier per task; only what it
    reads travels to Python."""

    def answer(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = make()
        for columns in batches:
            part = pa.RecordBatch.from_arrays(list(columns), READS)
            found = [x for at in range(0, part.num_rows, CALL_ROWS) for x in answered(model, part.slice(at, CALL_ROWS).to_pylist())]
            category, confidence = pa.array([x and x[0] for x in found], pa.string()), pa.array([x and x[1] for x in found], pa.float64())
            yield pa.StructArray.from_arrays([category, confidence, pa.array([x is None for x in found], pa.bool_())], [f.name for f in ANSWER])

    # not deterministic: else it is computed once for each of the columns taken from it
    ask = F.arrow_udf(answer, T.StructType(ANSWER)).asNondeterministic()
    return rows.withColumn("__answer", ask(*READS)).select(*rows.columns, *(F.col(f"__answer.{f.name}").alias(f.name) for f in ANSWER))


def settled_answers(rows: DataFrame, version: str) -> DataFrame:
    """Classified rows to store columns: an answer; else the fallback, to be redone; else Uncategorized."""
    kept = F.col("fallback_primary_category")
    return rows.select(
        *(c for c in rows.columns if c not in ("category", "confidence", "provisional")),
        F.when(~F.col("provisional"), F.col("category")).otherwise(F.coalesce(kept, F.lit(UNCATEGORIZED))).alias("primary_category"),
        F.when(~F.col("provisional"), F.col("confidence")).otherwise(F.coalesce("fallback_classify_confidence", F.lit(0.0))).alias("classify_confidence"),
        F.when(~F.col("provisional") | kept.isNull(), F.lit(version)).otherwise(F.col("fallback_taxonomy_version")).alias("taxonomy_version"),
        F.col("provisional").alias("needs_reclassify"),
    )
