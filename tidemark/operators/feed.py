"""Change feeds: what a conditional merge writes and how it is collapsed, exported, replayed and undone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schemas import KEYS

#: Feed rows of what was, which neither collapse nor replay reads.
BEFORE = "update_preimage"


def apply_if(source: str = "source", target: str = "target"):
    """A merge writes a newer version, or the same version with the same content (a replay)."""
    s, t = (lambda c: F.col(f"{source}.{c}")), (lambda c: F.col(f"{target}.{c}"))
    return (s("source_version") > t("source_version")) | ((s("source_version") == t("source_version")) & (s("content_hash") == t("content_hash")))


def merge(target: DataFrame, source: DataFrame, *, touched_only: bool = False) -> DataFrame:
    """The merged rows with ``_change`` (insert, update or null for kept rows) and the row before. One full
    outer join on the keys; source has at most one row per key."""
    columns = target.columns
    t = target.select(F.struct(*columns).alias("target"), *(F.col(k).alias(f"t_{k}") for k in KEYS))
    s = source.select(F.struct(*columns).alias("source"), *(F.col(k).alias(f"s_{k}") for k in KEYS))
    on = [F.col(f"t_{k}") == F.col(f"s_{k}") for k in KEYS]
    both = t.join(s, on, "full_outer")
    inserted, updated = F.col("target").isNull(), F.col("source").isNotNull() & F.coalesce(apply_if(), F.lit(False))
    kind = F.when(inserted, "insert").when(updated, "update")
    out = both.select(F.when(inserted | updated, F.col("source")).otherwise(F.col("target")).alias("row"), kind.alias("_change"), F.col("target").alias("_before"))
    out = out.select("row.*", "_change", "_before")
    return out.filter(F.col("_change").isNotNull()) if touched_only else out


def merged(target: DataFrame, source: DataFrame) -> DataFrame:
    return merge(target, source).drop("_change", "_before")


def feed_rows(changes: DataFrame, version: int) -> DataFrame:
    """The feed of one merge: inserts, and updates as a row before and a row after."""
    columns = [c for c in changes.columns if c not in ("_change", "_before")]
    after = changes.withColumn("_change_type", F.when(F.col("_change") == "insert", "insert").otherwise("update_postimage")).select(*columns, "_change_type")
    before = changes.filter(F.col("_change") == "update").select("_before.*").withColumn("_change_type", F.lit(BEFORE)).select(*columns, "_change_type")
    return after.unionByName(before).withColumn("_commit_version", F.lit(version).cast("long"))


def log_feed(decided: DataFrame, *state: str) -> DataFrame:
    """The feed of a whole log, one merge per commit: decided rows to one state per key and commit, with the
    state of the commit before as its row before."""
    per = decided.filter(F.col("outcome") == "written").groupBy(*KEYS, "_commit_version").agg(F.max_by(F.struct(*state), "pos").alias("now"))
    line = Window.partitionBy(*KEYS).orderBy("_commit_version")
    per = per.withColumn("was", F.lag("now").over(line))
    after = per.select(*KEYS, "now.*", F.when(F.col("was").isNull(), "insert").otherwise("update_postimage").alias("_change_type"), "_commit_version")
    before = per.filter(F.col("was").isNotNull()).select(*KEYS, "was.*", F.lit(BEFORE).alias("_change_type"), "_commit_version")
    return after.unionByName(before)


def collapse(feed: DataFrame, *by: str) -> DataFrame:
    """Per key (and ``by``) the last row, with op: delete for tombstones and removed rows, else upsert."""
    rest = [c for c in feed.columns if c not in (*KEYS, *by)]
    last = feed.filter(F.col("_change_type") != BEFORE).groupBy(*by, *KEYS).agg(F.max_by(F.struct(*rest), "_commit_version").alias("r"))
    gone = F.col("r.is_tombstone") | (F.col("r._change_type") == "delete")
    out = last.select(*by, *KEYS, *(f"r.{c}" for c in rest if c not in ("_change_type", "_commit_version")), F.when(gone, "delete").otherwise("upsert").alias("op"))
    return out


def replayed(exports: DataFrame, file: str = "file") -> DataFrame:
    """What a consumer holds after all export files in order: the last op per key, without deletes."""
    rest = [c for c in exports.columns if c not in (*KEYS, file)]
    last = exports.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), file).alias("r"))
    return last.select(*KEYS, *(f"r.{c}" for c in rest)).filter(F.col("op") != "delete").drop("op")


def whole(store: DataFrame) -> DataFrame:
    """The full state as an export: every row, tombstones as deletes."""
    return store.withColumn("op", F.when(F.col("is_tombstone"), "delete").otherwise("upsert"))


def rewound(head: DataFrame, feed: DataFrame, version: int) -> DataFrame:
    """The state at an earlier version: keys changed since get back what stood before their first change."""
    rest = [c for c in head.columns if c not in KEYS]
    later = feed.filter((F.col("_commit_version") > version) & (F.col("_change_type") != "update_postimage"))
    first = later.groupBy(*KEYS).agg(F.min_by(F.struct("_change_type", *rest), "_commit_version").alias("was"))
    both = head.join(first, KEYS, "full_outer").filter(F.coalesce(F.col("was._change_type") != "insert", F.lit(True)))
    return both.select(*KEYS, *(F.when(F.col("was").isNotNull(), F.col(f"was.{c}")).otherwise(F.col(c)).alias(c) for c in rest))


def difference(expected: DataFrame, actual: DataFrame, *compared: str) -> DataFrame:
    """Keys on which two states differ, with both sides; null-safe."""
    e = expected.select(*KEYS, F.struct(*compared).alias("expected"))
    a = actual.select(*KEYS, F.struct(*compared).alias("actual"))
    return e.join(a, KEYS, "full_outer").filter(~F.col("expected").eqNullSafe(F.col("actual")))
