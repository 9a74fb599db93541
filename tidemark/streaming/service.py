"""What a front door does with requests: authenticate, check, land, record; and tell what became of them. A web
server would call submit() and status(); nothing here listens on a port."""

from __future__ import annotations

import re
import shutil
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import envelope, status
from tidemark.schemas import SUBMISSIONS
from tidemark.sources import files
from tidemark.sources.vtable import VTable
from tidemark.streaming.landing import LandingLog

MAX_BODY, MIN_FREE, EXPIRES_S = 20 << 20, 1 << 30, 7 * 24 * 3600
_UUID7 = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}")


class Refusal(Exception):
    """A request that is turned away, with the status a web server would give."""

    def __init__(self, code: int, reason: str):
        super().__init__(reason)
        self.code, self.reason = code, reason


def new_submission(now: float) -> str:
    """A version 7 UUID of this instant."""
    rest = uuid.uuid4().hex
    ms = f"{int(now * 1000):012x}"
    return f"{ms[:8]}-{ms[8:]}-7{rest[:3]}-{'89ab'[int(rest[3], 16) % 4]}{rest[4:7]}-{rest[7:19]}"


class Service:
    def __init__(self, spark: SparkSession, root: str, registry: files.Registry, *, clock: Callable[[], float] = time.time, free: Callable[[], int] | None = None):
        self.spark, self.root, self.registry, self.clock = spark, root.rstrip("/"), registry, clock
        self.landing = LandingLog(spark, f"{self.root}/landing")
        self.submissions = VTable.create(spark, f"{self.root}/submissions", SUBMISSIONS, keyed=False)
        self.free = free or (lambda: shutil.disk_usage("/").free)

    def _merchant(self, key: str | None) -> tuple[str, str]:
        found = self.registry.verify(key) if key else None
        if found is None:
            raise Refusal(401, "unknown key")
        return found

    def submit(self, body: bytes, key: str | None) -> dict:
        """Lands the accepted changes of a request as one commit and records all of them."""
        if self.free() < MIN_FREE:
            raise Refusal(503, "disk is nearly full")
        merchant_id, currency = self._merchant(key)
        if len(body) > MAX_BODY:
            raise Refusal(413, "body is too large")
        now = self.clock()
        try:
            rows = envelope.check_batch(self.spark, body, merchant_id=merchant_id, currency=currency, now_ms=int(now * 1000))
        except envelope.BadBatch as e:
            raise Refusal(400, str(e)) from e
        submission = new_submission(now)
        rows = rows.withColumns({"submission_id": F.lit(submission), "received_at": F.timestamp_micros(F.lit(int(now * 1e6)))}).persist()
        try:
            accepted, rejected = envelope.split(rows)
            listing = F.when(F.col("listing").isNotNull(), C.canonical(F.col("listing")))
            landed = accepted.withColumn("nth", F.row_number().over(_in_order()) - 1).withColumn("listing", listing)
            if not accepted.isEmpty():
                self.landing.append(landed)
            record = rows.withColumn("hour", C.hour(C.uuid_ms(F.col("submission_id")))).select(*(F.col(f.name).cast(f.dataType) for f in SUBMISSIONS))
            self.submissions.append(record)
            files.write_events(envelope.submission_events(rows, F.lit(submission)).withColumn("ts", F.lit(int(now * 1000)).cast("long")), f"{self.root}/events")
            bad = [{"change_index": r["change_index"], "errors": r["errors"]} for r in rejected.select("change_index", "errors").orderBy("change_index").collect()]  # at most a batch
            return {"submission_id": submission, "accepted": rows.count() - len(bad), "rejected": bad}
        finally:
            rows.unpersist()

    def status(self, submission_id: str, key: str | None, outcomes: DataFrame) -> DataFrame:
        """(change_index, outcome) of the merchant's own submission; pending until a change has an outcome."""
        merchant_id, _ = self._merchant(key)
        if not _UUID7.fullmatch(submission_id):
            raise Refusal(404, "no such submission")
        if self.clock() - int(submission_id.replace("-", "")[:12], 16) / 1000 > EXPIRES_S:
            raise Refusal(410, "expired")
        hour = time.strftime("%Y-%m-%dT%H", time.gmtime(int(submission_id.replace("-", "")[:12], 16) / 1000))
        own = self.submissions.read_hours(hour, hour).filter((F.col("submission_id") == submission_id) & (F.col("merchant_id") == merchant_id))
        if own.isEmpty():
            raise Refusal(404, "no such submission")
        first = own.select("submission_id", "change_index", "merchant_id", F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("type"))
        then = outcomes.filter(F.col("submission_id") == submission_id).select("submission_id", "change_index", F.lit(merchant_id).alias("merchant_id"), F.col("outcome").alias("type"))
        return status.folded(first.unionByName(then)).select("change_index", "outcome").orderBy("change_index")


def _in_order():
    from pyspark.sql import Window

    return Window.partitionBy("submission_id").orderBy("change_index")  # at most a request's changes
