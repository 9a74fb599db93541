"""The ingest job: landing log to listing store, as one Structured Streaming query.

A micro-batch pins the store's head, folds its changes (and some backfill picks) over the stored rows of
their keys, classifies the writes that need it, merges them and appends one outcome per change. A crash
between these steps replays the batch under the same id: what was merged is then already applied or stale,
and outcomes are appended once per query and batch.
"""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidemark.functions import columns as C
from tidemark.operators import classify, fold
from tidemark.schemas import CONTENT, KEYS, OUTCOMES, STORE
from tidemark.sources.vtable import Files, VTable
from tidemark.streaming.landing import LandingLog

BACKFILL = 1000
#: Characters of an error, and failed changes that a batch tells one by one.
ERROR_CHARS, TOLD = 500, 100
_CONTENT = ["title", "description", "price_micros", "currency", "availability", "attributes"]


class Refused(RuntimeError):
    """The job's tables and its checkpoint do not belong together."""


def view(title, description, attributes):
    """What a classifier reads of a listing; a price or stock change leaves it as it is."""
    return F.sha2(F.concat_ws("\u0000", title, F.coalesce(description, F.lit("")), attributes), 256)


def changes_of(landing: DataFrame) -> DataFrame:
    """Landing rows as changes of the fold, with ``storable``; content columns are null for tombstones."""
    rows = fold.landing_order(landing).withColumn("content", F.from_json("listing", CONTENT))
    content = F.struct(*(F.coalesce(F.col("content.description"), F.lit("")).alias(c) if c == "description" else F.coalesce(F.col("content.attributes"), F.create_map().cast("map<string,string>")).alias(c) if c == "attributes" else F.col(f"content.{c}").alias(c) for c in _CONTENT))
    is_upsert = F.col("op") == "upsert"
    whole = F.col("content").isNotNull() & F.greatest(*(F.col(f"content.{c}").isNull().cast("int") for c in ("title", "price_micros", "currency", "availability"))).eqNullSafe(0)
    missing = F.concat_ws(", ", *(F.when(F.col(f"content.{c}").isNull(), c) for c in ("title", "price_micros", "currency", "availability")))
    error = F.when(is_upsert & ~F.coalesce(whole, F.lit(False)), F.left(F.concat(F.lit("cannot be stored without "), missing), F.lit(ERROR_CHARS)))
    rows = rows.withColumns({"error": error, "storable": error.isNull()}).withColumn("content", F.when(is_upsert, content))
    flat = {c: F.col(f"content.{c}") for c in _CONTENT[:-1]} | {"attributes": C.attributes_text(F.col("content.attributes"))}
    rows = rows.withColumn("hash", C.content_hash(F.col("content"))).withColumns(flat)
    rows = rows.withColumn("view", F.when(is_upsert, view(F.col("title"), F.col("description"), F.col("attributes"))))
    return rows.withColumn("is_tombstone", F.col("op") == "delete").drop("content", "listing")


def stored_of(store: DataFrame) -> DataFrame:
    """Store rows as the fold's stored rows."""
    live = F.when(~F.col("is_tombstone"), view(F.col("title"), F.col("description"), F.col("attributes")))
    return store.withColumn("hash", F.col("content_hash")).withColumn("view", live).select(*KEYS, "source_version", "hash", "is_tombstone", "view", *_CONTENT, "primary_category", "classify_confidence", "taxonomy_version", "needs_reclassify")


class Ingest:
    def __init__(self, spark: SparkSession, root: str, make: Callable[[], classify.Classifier] = classify.Fake, *, clock: Callable[[], float] = time.time, backfill: int = BACKFILL, say: Callable[[dict], None] | None = None):
        self.spark, self.root, self.make, self.clock, self.backfill = spark, root.rstrip("/"), make, clock, backfill
        self.version = make().taxonomy_version
        self.say = say or (lambda line: print(json.dumps(line), file=sys.stderr))
        self.landing = LandingLog(spark, f"{self.root}/landing")
        self.store = VTable.create(spark, f"{self.root}/store", STORE, keyed=True)
        self.outcomes = VTable.create(spark, f"{self.root}/outcomes", OUTCOMES, keyed=False)
        live = ~F.col("is_tombstone")
        # what the log says of a file decides whether a batch reads it for backfill
        self.store.stats = {"flagged": F.count_if(live & F.col("needs_reclassify")), "versions": F.collect_set(F.when(live, F.coalesce("taxonomy_version", F.lit(""))))}
        self.checkpoint = f"{self.root}/checkpoint"
        #: Called with the name of each step that is done; tests raise here.
        self.after: Callable[[str], None] = lambda step: None

    @property
    def query_id(self) -> str:
        """The query that outcomes belong to: the checkpoint's own id once it has one, which restarts keep."""
        files, path = Files(self.spark, self.root), f"{self.checkpoint}/metadata"
        return f"ingest-{json.loads(files.read(path))['id'] if files.exists(path) else self.store.table_id}"

    def decide(self, batch: DataFrame, head: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(decided changes, writes with store columns, the persisted changes) of a batch over the store at
        head."""
        changes = changes_of(batch).withColumn("backfill", F.lit(False))
        waits = lambda x: x.get("flagged", 1) or set(x.get("versions", [""])) - {self.version}
        picked = fold.pending(self.store.read(head, waits), self.version, self.backfill)
        picks = fold.picks(picked).withColumns({"backfill": F.lit(True), "storable": F.lit(True)})
        changes = changes.unionByName(picks, allowMissingColumns=True).persist()
        good = changes.filter("storable")
        stored = stored_of(self.store.lookup(good, head))
        decided = fold.decided(good, stored).filter("not backfill").select("submission_id", "change_index", "outcome")
        failed = changes.filter("not storable").select("submission_id", "change_index", F.lit("failed").alias("outcome"))
        writes = fold.writes(good, stored, self.version, *_CONTENT).withColumnRenamed("hash", "content_hash")
        return decided.unionByName(failed), writes, changes

    def store_rows(self, writes: DataFrame) -> DataFrame:
        """Writes as store rows: those that need it classified, the others with their answer carried over."""
        new = classify.settled_answers(classify.classified(writes.filter("needs_classify"), self.make), self.version)
        old = writes.filter("not needs_classify").withColumns({c: F.col(f"fallback_{c}") for c in ("primary_category", "classify_confidence", "taxonomy_version")} | {"needs_reclassify": F.lit(False)})
        rows = new.unionByName(old, allowMissingColumns=True)
        rows = rows.withColumn("partition", C.partition_of(*KEYS)).withColumn("updated_at", F.timestamp_micros(F.lit(int(self.clock() * 1e6))))
        return rows.select(*(F.col(f.name).cast(f.dataType) for f in STORE))

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        began, head = time.monotonic(), self.store.head()
        decided, writes, changes = self.decide(batch, head)
        writes = writes.persist()
        try:
            failed = [r.asDict() for r in changes.filter("not storable").select("submission_id", "change_index", "error").limit(TOLD).collect()]
            planned = writes.count()
            self.after("planned")
            applied, version = self.store.merge(self.store_rows(writes)) if planned else (0, None)
            if applied < planned:
                raise RuntimeError(f"{applied} of {planned} writes applied: the store has moved on, and the batch runs again")
            self.after("merged")
            rows = decided.withColumn("hour", C.hour(C.uuid_ms(F.col("submission_id")))).select(*(F.col(f.name).cast(f.dataType) for f in OUTCOMES))
            self.outcomes.append(rows, (self.query_id, batch_id))
            self.after("appended")
            self.say({"type": "batch", "batch": batch_id, "writes": applied, "store_version": version, "ms": round((time.monotonic() - began) * 1000)} | ({"failed": failed} if failed else {}))
        finally:
            writes.unpersist()
            changes.unpersist()

    def guard(self, checkpoint: str) -> None:
        """A checkpoint goes with the tables it was made with, and a store with outcomes has one."""
        files, mark = Files(self.spark, self.root), f"{self.root}/tables.json"
        ids = {"landing": self.landing.table_id, "store": self.store.table_id, "outcomes": self.outcomes.table_id}
        begun = bool(files.list(f"{checkpoint}/offsets"))
        if files.exists(mark):
            if json.loads(files.read(mark)) != ids:
                raise Refused("the checkpoint is of other tables")
        elif begun:
            raise Refused("a checkpoint without its tables")
        else:
            files.publish(mark, json.dumps(ids))
        if not begun and self.outcomes.head() > 0:
            raise Refused("outcomes without a checkpoint: a new one would report every change again")

    def start(self, *, max_bytes: int | None = 8 << 20, max_files: int = 100_000, **trigger) -> StreamingQuery:
        """The running query; trigger: processingTime="60 seconds", or availableNow=True."""
        self.guard(self.checkpoint)
        stream = self.landing.stream(max_bytes, max_files)
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", self.checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def rebuild(self, batch_rows: int | None = None) -> int:
        """Applies the whole retained log again, in replay order: a store that lags catches up, and one that does
        not stays as it is. In steps of batch_rows rows of each partition; the steps that are done are on record,
        and a rebuild that was cut short goes on after them. Returns the number of steps taken."""
        files, mark = Files(self.spark, self.root), f"{self.root}/rebuild.json"
        rows = fold.replay_order(self.landing.read())
        plan = {"rows": batch_rows, "commits": max(self.landing.commits(), default=-1)}
        found = json.loads(files.read(mark)) if files.exists(mark) else {}
        first = found["done"] if {k: found.get(k) for k in plan} == plan else 0
        most = rows.agg(F.max("nth")).first()[0] or 0
        steps = -(-most // batch_rows) if batch_rows else min(1, most)
        for step in range(first, steps):
            part = rows.filter(F.col("nth").between(step * batch_rows + 1, (step + 1) * batch_rows)) if batch_rows else rows
            self.apply(part.drop("nth"), -1 - self.store.head())
            files.delete(mark)
            files.publish(mark, json.dumps(plan | {"done": step + 1}))
            self.after("rebuilt")
        files.delete(mark)
        return max(0, steps - first)


class Progress(StreamingQueryListener):
    """Each event of a query as one JSON line."""

    def __init__(self, say: Callable[[str], None]):
        self.say = say

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.say(json.dumps({"type": "started", "id": str(event.id)}))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.say(event.progress.json)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.say(json.dumps({"type": "idle", "id": str(event.id)}))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.say(json.dumps({"type": "ended", "id": str(event.id), "error": event.exception}))
