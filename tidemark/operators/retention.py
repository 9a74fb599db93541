"""What is old enough to go, and what must stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def landing(rows: DataFrame, now: Column, slowest_commit: Column, days: int = 7) -> DataFrame:
    """rows with ``prune``: older than the retention and an hour, and read by every reader."""
    old = F.col("received_at") < now - F.expr(f"interval {days} days 1 hour")
    return rows.withColumn("prune", old & (F.col("_commit_version") < slowest_commit))


def hours(rows: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Event hours (as text) with ``prune``: wholly before the retention."""
    return rows.withColumn("prune", F.col("hour") < F.date_format(now - F.expr(f"interval {days} days"), "yyyy-MM-dd'T'HH"))


def snapshots(rows: DataFrame, keep: int) -> DataFrame:
    """Snapshots (by name, oldest first) with ``prune``: all but the newest keep; the newest always stays."""
    nth = F.row_number().over(Window.orderBy(F.desc("name")))  # a snapshot list is short
    return rows.withColumn("nth", nth).withColumn("prune", F.col("nth") > max(1, keep)).drop("nth")


def snapshot_due(newest: Column, now: Column, every_s: int) -> Column:
    return newest.isNull() | (F.unix_micros(now) - F.unix_micros(newest) >= every_s * 1_000_000)


def vacuum(files: DataFrame, now: Column, grace_s: int) -> DataFrame:
    """Removed files (removed_at, pinned) that no reader can need any more."""
    return files.filter(F.col("removed_at").isNotNull() & ~F.col("pinned") & (F.unix_micros(now) - F.unix_micros(F.col("removed_at")) > grace_s * 1_000_000))
