"""What became of a submission's changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import PENDING, RANKS


def rank(outcome: Column) -> Column:
    """An outcome's place, 0 the best; null for what is none."""
    found = F.lit(None).cast("int")
    for i, x in enumerate(RANKS):
        found = F.when(outcome == x, i).otherwise(found)
    return found


def folded(events: DataFrame) -> DataFrame:
    """Per change its best outcome, or pending while it has only been accepted. events: submission_id,
    change_index, merchant_id, type."""
    known = events.filter((F.col("type") == "accepted") | F.col("type").isin(RANKS))
    best = F.min_by("type", rank(F.col("type")))
    return known.groupBy("submission_id", "change_index").agg(F.first("merchant_id").alias("merchant_id"), F.coalesce(best, F.lit(PENDING)).alias("outcome"))


def counts(status: DataFrame) -> DataFrame:
    """Per submission the number of changes with each outcome, and whether none is pending."""
    each = [F.count_if(F.col("outcome") == x).alias(x) for x in (PENDING, *RANKS)]
    return status.groupBy("submission_id").agg(F.count(F.lit(1)).alias("changes"), *each).withColumn("done", F.col(PENDING) == 0)


def unanswered(landing: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Landed changes without any outcome."""
    return landing.join(outcomes, ["submission_id", "change_index"], "left_anti")


def submission(status: DataFrame, submission_id: str, merchant_id: str) -> DataFrame:
    """A merchant's own submission; nothing for another's."""
    return status.filter((F.col("submission_id") == submission_id) & (F.col("merchant_id") == merchant_id)).orderBy("change_index")
