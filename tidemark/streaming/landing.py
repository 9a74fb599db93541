"""The landing log: one Parquet file a commit, in an order that a file stream keeps."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import columns as C
from tidemark.schemas import LANDING
from tidemark.sources.vtable import Files

#: The log's columns and the commit that a row came with.
SCHEMA = T.StructType([*LANDING.fields, T.StructField("_commit_version", T.LongType())])
COLLECT_SECONDS, GROUP = 0.1, 10_000


class LandingLog:
    """Append-only. A commit's file is written hidden, stamped later than the one before it and then renamed:
    the file source admits files by that stamp, so batches see commits in order."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        if not self.files.exists(f"{self.root}/_meta/id.json"):
            self.files.make(f"{self.root}/_meta")
            self.files.publish(f"{self.root}/_meta/id.json", json.dumps({"table_id": uuid.uuid4().hex}))
        self.files.make(f"{self.root}/log")
        self.table_id = json.loads(self.files.read(f"{self.root}/_meta/id.json"))["table_id"]

    def commits(self) -> list[int]:
        return [int(x[:20]) for x in self.files.list(f"{self.root}/log") if x.endswith(".parquet") and not x.startswith((".", "_"))]

    def append(self, changes: DataFrame, attempts: int = 2) -> int:
        """changes: merchant_id, merchant_product_id, source_version, op, listing (JSON text or null),
        submission_id, change_index, received_at; ``nth`` gives their order in the commit. Who loses a race
        for a version tries the next one, attempts times in all."""
        for _ in range(attempts):
            version = max(self.commits(), default=-1) + 1
            if self._append_as(changes, version):
                return version
        raise RuntimeError(f"commit {version} is taken, after {attempts} attempts")

    def _append_as(self, changes: DataFrame, version: int) -> bool:
        rows = changes.orderBy("nth").coalesce(1) if "nth" in changes.columns else changes.coalesce(1)
        seq = (F.col("nth") if "nth" in changes.columns else F.monotonically_increasing_id()).cast("int")
        rows = rows.withColumns({"partition": C.partition_of("merchant_id", "merchant_product_id"), "seq": seq, "_commit_version": F.lit(version).cast("long")})
        hidden = f"{self.root}/_new/{uuid.uuid4().hex}"
        rows.select(*(F.col(f.name).cast(f.dataType) for f in SCHEMA)).write.parquet(hidden)
        part = next(x for x in self.files.list(hidden) if x.endswith(".parquet"))
        fs, path = self.files.fs, self.files.path
        before = path(self._file(version - 1))
        last = fs.getFileStatus(before).getModificationTime() if version and fs.exists(before) else 0
        fs.setTimes(path(f"{hidden}/{part}"), max(int(time.time() * 1000), last + 1000), -1)
        done = self.files.claim(f"{hidden}/{part}", self._file(version))
        self.files.delete(hidden)
        return done

    def _file(self, version: int) -> str:
        return f"{self.root}/log/{version:020d}.parquet"

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/log")

    def stream(self, max_bytes: int | None = 8 << 20, max_files: int = 100_000) -> DataFrame:
        """The log as a stream, capped by bytes or, without max_bytes, by files: Spark's file source refuses
        both caps together ("Only one of 'maxFilesPerTrigger' or 'maxBytesPerTrigger' can be specified")."""
        cap = {"maxBytesPerTrigger": max_bytes} if max_bytes else {"maxFilesPerTrigger": max_files}
        return self.spark.readStream.schema(SCHEMA).options(**cap).parquet(f"{self.root}/log")

    def retain(self, keep_from: int) -> list[int]:
        """Drops commits before keep_from, which callers take no later than the slowest reader's."""
        gone = [v for v in self.commits() if v < keep_from]
        for v in gone:
            self.files.delete(self._file(v))
        return gone


class Appender:
    """Requests that come close together share one commit. A request is never split, and a group holds at
    most GROUP changes unless one request alone is larger."""

    def __init__(self, commit: Callable[[list], int], window: float = COLLECT_SECONDS, group: int = GROUP):
        self.commit, self.window, self.group = commit, window, group
        self.lock, self.waiting = threading.Condition(), []

    def submit(self, entries: list) -> int:
        """The commit that holds the entries; returns once it is there."""
        slot: dict = {"entries": entries}
        with self.lock:
            lead = not self.waiting
            self.waiting.append(slot)
        if lead:
            time.sleep(self.window)
            with self.lock:
                todo, self.waiting = self.waiting, []
            while todo:
                some, n = [todo.pop(0)], 0
                n = len(some[0]["entries"])
                while todo and n + len(todo[0]["entries"]) <= self.group:
                    n += len(todo[0]["entries"])
                    some.append(todo.pop(0))
                try:
                    result: object = self.commit([x for s in some for x in s["entries"]])
                except Exception as e:  # noqa: BLE001  every waiter gets it
                    result = e
                with self.lock:
                    for s in some:
                        s["result"] = result
                    self.lock.notify_all()
        with self.lock:
            self.lock.wait_for(lambda: "result" in slot)
        if isinstance(slot["result"], Exception):
            raise slot["result"]
        return slot["result"]
