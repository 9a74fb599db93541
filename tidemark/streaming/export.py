"""Change exports: what the store's feed holds since the last one, collapsed to one row a key."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import feed as feeds
from tidemark.schemas import KEYS
from tidemark.sources.vtable import Files, VTable

MARK = "_watermark.json"


class Export:
    """A folder of ranges ``<first>-<last>``, each a Parquet folder that appears whole. The watermark is
    written after the range; a range that is there without it (a crash in between) is taken over."""

    def __init__(self, spark: SparkSession, store: VTable, folder: str, max_versions: int = 100):
        self.spark, self.store, self.folder, self.max_versions = spark, store, folder.rstrip("/"), max_versions
        self.files = Files(spark, folder)
        self.files.make(self.folder)

    def watermark(self) -> int:
        """The last version that is exported."""
        path = f"{self.folder}/{MARK}"
        found = json.loads(self.files.read(path)) if self.files.exists(path) else {"table_id": self.store.table_id, "version": 0}
        if found["table_id"] != self.store.table_id:
            raise RuntimeError("the exports are of another store")
        ranges = [x for x in self.files.list(self.folder) if len(x) == 41]
        return max([found["version"], *(int(x[21:]) for x in ranges)])

    def tick(self) -> tuple[int, int] | None:
        """Exports the next versions; None if there is nothing new. Versions without changes leave no file."""
        first, head = self.watermark() + 1, self.store.head()
        last = min(head, first + self.max_versions - 1)
        if last < first:
            return None
        if first > 1 and first not in self.store.versions():
            return self._publish(feeds.whole(self.store.read(head)), first, head)
        return self._publish(feeds.collapse(self.store.feed(first, last)), first, last)

    def _publish(self, rows: DataFrame, first: int, last: int) -> tuple[int, int] | None:
        name = f"{first:020d}-{last:020d}"
        hidden = f"{self.folder}/.{name}"
        self.files.delete(hidden)
        rows.orderBy(*KEYS).write.parquet(hidden)  # a range partitioning, sorted by key
        empty = self.spark.read.parquet(hidden).isEmpty()
        if empty:
            self.files.delete(hidden)
        else:
            self.files.fs.rename(self.files.path(hidden), self.files.path(f"{self.folder}/{name}"))
        self.files.delete(f"{self.folder}/{MARK}")
        self.files.publish(f"{self.folder}/{MARK}", json.dumps({"table_id": self.store.table_id, "version": last}))
        return None if empty else (first, last)
