"""Measures over the event log: type, ts (ms) and fields that are null where a type lacks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.status import rank
from tidemark.schemas import RANKS, UNCATEGORIZED


def changes(events: DataFrame, since: int) -> DataFrame:
    """Accepted changes whose first outcome falls in the window: when accepted, first and best outcome."""
    key = ["submission_id", "change_index"]
    accepted = events.filter(F.col("type") == "accepted").groupBy(*key).agg(F.min("ts").alias("accepted"))
    found = events.filter(F.col("type").isin(RANKS)).groupBy(*key).agg(F.min("ts").alias("first"), F.min_by("type", rank(F.col("type"))).alias("best"))
    return found.join(accepted, key).filter(F.col("first") >= since)


def freshness(events: DataFrame, since: int) -> DataFrame:
    age = (F.col("first") - F.col("accepted")) / 1000
    return changes(events, since).agg(F.count(F.lit(1)).alias("changes"), F.percentile(age, F.lit(0.5)).alias("p50"), F.percentile(age, F.lit(0.99)).alias("p99"))


def outcome_rates(events: DataFrame, since: int) -> DataFrame:
    share = lambda x: F.avg((F.col("best") == x).cast("int")).alias(x)
    return changes(events, since).agg(F.count(F.lit(1)).alias("changes"), share("stale"), share("conflict"), share("failed"))


def classify_latency(events: DataFrame, since: int) -> DataFrame:
    rows = events.filter((F.col("type") == "classify") & (F.col("ts") >= since))
    return rows.agg(F.count(F.lit(1)).alias("calls"), F.sum("listings").alias("listings"), F.percentile("ms", F.lit(0.5)).alias("p50"), F.percentile("ms", F.lit(0.99)).alias("p99"))


def append_retries(events: DataFrame, since: int) -> DataFrame:
    rows = events.filter((F.col("type") == "append_retry") & (F.col("ts") >= since))
    return rows.agg(F.count(F.lit(1)).alias("count"), F.avg("ms").alias("mean_ms"))


def lag_commits(events: DataFrame) -> DataFrame:
    """Per partition how far its newest position is behind the newest head anyone has read. next: a map of
    partition to position [commit, seq]."""
    batches = events.filter(F.col("type") == "batch").select("ts", "head", F.explode("next").alias("partition", "position"))
    head = batches.agg((F.max("head") + 1).alias("head_"))
    latest = batches.groupBy("partition").agg(F.max_by(F.get("position", F.lit(0)), "ts").alias("at"))
    return latest.crossJoin(F.broadcast(head)).select(F.col("partition").cast("int").alias("partition"), (F.col("head_") - F.col("at")).alias("lag"))  # one row


def utilization(events: DataFrame, since: int, now: int) -> DataFrame:
    rows = events.filter((F.col("type") == "batch") & (F.col("ts") >= since))
    return rows.groupBy("worker").agg(F.round(F.sum("ms") / (now - since), 6).alias("utilization"))


def refused(events: DataFrame, since: int) -> DataFrame:
    rows = events.filter((F.col("type") == "refused") & (F.col("ts") >= since))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("refused"))


def uncategorized(store: DataFrame) -> DataFrame:
    share = F.avg((F.col("primary_category") == UNCATEGORIZED).cast("int"))
    return store.filter(~F.col("is_tombstone")).agg(F.count(F.lit(1)).alias("live"), share.alias("share"))


def backlog(store: DataFrame, taxonomy_version: str) -> DataFrame:
    """How many live rows wait for an answer: provisional ones and those of another taxonomy."""
    flagged = F.col("needs_reclassify")
    outdated = ~flagged & ~F.col("taxonomy_version").eqNullSafe(F.lit(taxonomy_version))
    return store.filter(~F.col("is_tombstone")).agg(F.count_if(flagged).alias("flagged"), F.count_if(outdated).alias("outdated"))


def load_summary(requests: DataFrame, *by: str) -> DataFrame:
    """Requests by status, and the nearest-rank percentiles of their latency."""
    disc = lambda p: F.expr(f"percentile_disc({p}) within group (order by ms)")
    return requests.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), disc(0.5).alias("p50_ms"), disc(0.99).alias("p99_ms"), F.max("ms").alias("max_ms"))


def ended_by(tallies: DataFrame, *by: str) -> DataFrame:
    """What ended a load, by the strongest of its processes' reasons: stopped by hand, out of time, refused its
    key, else all changes sent. tallies: stopped, timed_out, refused (booleans), sent, accepted."""
    reasons = (("stopped", "ctrl_c"), ("timed_out", "seconds"), ("refused", "401"))
    ended = F.coalesce(*(F.max(F.when(F.col(c), name)) for c, name in reasons), F.lit("changes"))
    return tallies.groupBy(*by).agg(F.count(F.lit(1)).alias("processes"), F.sum("sent").alias("sent"), F.sum("accepted").alias("accepted"), ended.alias("ended_by"))


def effects(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count(F.lit(1)).alias("events"))


def slowest_reader(offsets: DataFrame) -> DataFrame:
    """The reader that holds back retention: the one with the least position."""
    return offsets.agg(F.min_by("reader", F.struct("commit", "seq", "reader")).alias("reader"), F.min("commit").alias("commit"))
