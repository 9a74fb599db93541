"""Event logs, label and training files, exports, paged services, and the merchants' registry."""

from __future__ import annotations

import hashlib
import hmac
import json
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.schemas import UNCATEGORIZED
from tidemark.session import scratch
from tidemark.sources.vtable import Files

EVENT = "type string, ts long, submission_id string, change_index int, merchant_id string, worker int, changes int, ms long, head long, next map<string,array<long>>, listings long, rows long, status int, reason string"


def write_events(events: DataFrame, root: str) -> None:
    """Appends events (JSON lines) to folders by hour."""
    rows = events.withColumn("hour", F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd'T'HH"))
    rows.write.mode("append").partitionBy("hour").json(root)


def read_events(spark: SparkSession, root: str, since_ms: int | None = None, submission_id: str | None = None) -> DataFrame:
    """Events from an hour's folder on, oldest first. Lines that are not whole JSON are skipped; a submission's
    lines are found by their text before anything is parsed."""
    rows = spark.read.schema("value string, hour string").option("basePath", root).text(root)
    if since_ms is not None:
        rows = rows.filter(F.col("hour") >= F.date_format(F.timestamp_millis(F.lit(since_ms)), "yyyy-MM-dd'T'HH"))
    if submission_id is not None:
        rows = rows.filter(F.contains("value", F.lit(submission_id)))
    parsed = rows.select(F.from_json("value", EVENT, {"mode": "PERMISSIVE"}).alias("e"), F.col("value").alias("line"))
    parsed = parsed.filter(F.expr("try_parse_json(line) is not null") & F.col("e.type").isNotNull() & F.col("e.ts").isNotNull())
    out = parsed.select("e.*", "line")
    if submission_id is not None:
        out = out.filter(F.col("submission_id") == submission_id)
    return out.orderBy("ts", "line")


def read_labels(spark: SparkSession, path: str, paths: DataFrame) -> tuple[DataFrame, str]:
    """(id, title, description, category) of a label file, and the file's SHA-256. Refuses lines that are not
    whole, repeated ids and categories that the taxonomy lacks, with the line's number."""
    raw = spark.read.format("binaryFile").load(path)
    digest = raw.select(F.sha2("content", 256)).first()[0]
    text = raw.select(F.regexp_replace(F.decode("content", "UTF-8"), "^\\ufeff", "").alias("value"))
    lines = text.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).filter(F.trim("line") != "")
    rows = lines.select((F.col("n") + 1).alias("n"), F.from_json("line", "id string, title string, description string, category string").alias("r")).select("n", "r.*")
    known = paths.select(F.col("path").alias("known"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("n"))
    rows = rows.withColumn("nth", nth).join(known, F.col("category") == F.col("known"), "left")
    bad = F.when(F.col("id").isNull() | F.col("title").isNull() | F.col("category").isNull(), "not a whole label").when(F.col("nth") > 1, "repeated id").when(F.col("known").isNull() & (F.col("category") != UNCATEGORIZED), "category not in the taxonomy")
    if first := rows.withColumn("bad", bad).filter("bad is not null").orderBy("n").first():
        raise ValueError(f"{path} line {first['n']}: {first['bad']}")
    return rows.select("id", "title", F.coalesce("description", F.lit("")).alias("description"), "category"), digest


def read_training(spark: SparkSession, paths: list[str]) -> DataFrame:
    """JSON lines, gzipped or not, end to end."""
    return spark.read.schema("id string, title string, description string, category string, source string").json(paths)


def write_training(rows: DataFrame, path: str, parts: int = 1) -> None:
    """Gzipped JSON lines whose bytes depend on the rows alone: rows go to files by a hash of their id and lie
    there in order of all their columns; Spark's gzip streams carry no time."""
    rows.repartition(parts, "id").sortWithinPartitions("id", *(c for c in rows.columns if c != "id")).write.option("compression", "gzip").json(path)


def sampled(rows: DataFrame, per_category: int, seed: int, lines: int = 1000) -> DataFrame:
    """Of each category's first lines a seeded draw. rows: category, n (line), id."""
    head = rows.filter(F.col("n") <= lines)
    line = Window.partitionBy("category").orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    return head.withColumn("nth_", F.row_number().over(line)).filter(F.col("nth_") <= per_category).drop("nth_")


def exports(spark: SparkSession, folder: str) -> list[str]:
    """Export folders in order of their versions."""
    files = Files(spark, folder)
    return [f"{folder}/{x}" for x in files.list(folder) if not x.startswith((".", "_")) and "-" in x]


def read_exports(spark: SparkSession, folder: str) -> DataFrame | None:
    """All exported rows with ``file``, the range of versions they come from."""
    found = exports(spark, folder)
    if not found:
        return None
    rows = spark.read.parquet(*found)
    return rows.withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{20}-\d{20})/", 1))


class Unavailable(RuntimeError):
    """A page could not be had after all tries."""


def fetch(get: Callable[[int, int], dict], *, page: int = 100, tries: int = 6, wait: float = 15.0, sleep: Callable[[float], None] = time.sleep, start: int = 0, stop: int | None = None) -> Iterator[dict]:
    """The rows of a paged service from start to stop (None: to its total): get(offset, length) gives {"total",
    "rows"}. Errors that may pass are tried again with doubling waits; a page without rows before the end is
    an error."""
    offset, total = start, stop
    while total is None or offset < total:
        for attempt in range(tries):
            try:
                found = get(offset, page)
                break
            except (OSError, ValueError) as e:
                if getattr(e, "code", 500) != 429 and getattr(e, "code", 500) < 500:
                    raise
                if attempt + 1 == tries:
                    raise Unavailable(f"offset {offset}: {tries} tries") from e
                sleep(wait * 2**attempt)
        total, rows = min(x for x in (stop, found.get("total")) if x is not None), found["rows"]
        if not rows and offset < total:
            raise Unavailable(f"offset {offset}: no rows before {total}")
        yield from rows
        offset += len(rows)


#: Pages that a task fetches, one after another, at most; and tasks below which it takes one page alone.
PAGES, TASKS = 100, 64


def write_pages(rows: DataFrame, folder: str, order: list[str], page: int = 100) -> int:
    """All rows, in order of these and then of their other columns, as the pages that ``paged`` reads, without the
    columns of order; returns the number of rows. Tasks sort a range of the rows each and write pages; the driver
    sees a row a range."""
    spark, columns = rows.sparkSession, [c for c in rows.columns if c not in order]
    ranges = rows.repartitionByRange(*order, *columns).sortWithinPartitions(*order, *columns).select(F.monotonically_increasing_id().alias("at"), F.struct(*columns).alias("row"))
    ranges.write.parquet(path := scratch(spark, "ranges"))  # else a range's bounds could change from job to job
    ranges = spark.read.schema(ranges.schema).parquet(path).select(F.expr("at >> 33").alias("range"), F.expr("at & ((1l << 33) - 1)").alias("at"), "row")
    total, bases = 0, []
    for r in ranges.groupBy("range").count().orderBy("range").collect():
        bases.append((r["range"], total))
        total += r["count"]
    numbered = ranges.join(F.broadcast(spark.createDataFrame(bases, "range long, base long")), "range").select((F.col("at") + F.col("base")).alias("at"), "row")
    pages = numbered.groupBy((F.col("at") - F.col("at") % page).alias("offset")).agg(F.array_sort(F.collect_list(F.struct("at", "row"))).alias("rows"))
    pages = pages.select("offset", F.to_json(F.struct(F.lit(total).alias("total"), F.col("rows.row").alias("rows"))).alias("page"))

    def put(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for offset, text in zip(batch.column("offset").to_pylist(), batch.column("page"), strict=True):
                made = f"{top}/page-{offset}.json"
                with store.open_output_stream(f"{made}.{(own := uuid.uuid4().hex)}.tmp") as f:
                    f.write(text.as_buffer())
                try:
                    store.move(f"{made}.{own}.tmp", made)
                except OSError:  # some stores refuse a name that an earlier try of this task has given the same bytes
                    if store.get_file_info(made).type != fs.FileType.File:
                        raise
                    store.delete_file(f"{made}.{own}.tmp")
            yield pa.RecordBatch.from_pydict({"rows": pa.array([batch.num_rows], pa.int64())})

    Files(spark, folder).make(folder)
    pages.mapInArrow(put, "rows long").agg(F.sum("rows")).collect()
    return total


class PagedSource(DataSource):
    """``paged``: a service of JSON pages, each fetched with retries, a task a page or, of many, a run of them. The
    service is a folder (any that pyarrow opens by URI) of files ``page-<offset>.json``, in place of a remote one."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "title string, description string, category string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options["path"], int(self.options["total"]), int(self.options.get("page", 100)), float(self.options.get("wait", 15.0)))


class PagedReader(DataSourceReader):
    def __init__(self, path: str, total: int, page: int, wait: float):
        self.path, self.total, self.page, self.wait = path, total, page, wait

    def partitions(self) -> list[InputPartition]:
        step = self.page * max(1, min(PAGES, self.total // self.page // TASKS))
        return [InputPartition((at, min(self.total, at + step))) for at in range(0, max(1, self.total), step)]  # Spark reads none as one without a value

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(self.path)

        def get(offset: int, length: int) -> dict:
            with store.open_input_file(f"{folder}/page-{offset}.json") as f:
                return json.loads(f.readall())

        start, stop = partition.value
        for row in fetch(get, page=self.page, wait=self.wait, start=start, stop=stop):
            yield tuple(row.get(x) for x in ("title", "description", "category"))


class Registry:
    """Merchants: id, currency, the hash of their key and whether they are active, with an audit trail. One
    small JSON file per change, the last of a merchant counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder, Files(spark, folder)
        self.files.make(folder)

    def _rows(self) -> list[dict]:
        return [json.loads(self.files.read(f"{self.folder}/{x}")) for x in self.files.list(self.folder) if x.endswith(".json")]

    def _add(self, **row) -> None:
        self.files.publish(f"{self.folder}/{len(self._rows()):012d}-{uuid.uuid4().hex}.json", json.dumps(row))

    def _last(self) -> dict[str, dict]:
        return {r["merchant_id"]: r for r in self._rows()}

    def _key(self, merchant_id: str, currency: str, action: str) -> str:
        key = uuid.uuid4().hex
        self._add(merchant_id=merchant_id, currency=currency, key_hash=hashlib.sha256(key.encode()).hexdigest(), active=True, action=action)
        return key

    def create(self, merchant_id: str, currency: str) -> str:
        if "/" in merchant_id or not (len(currency) == 3 and currency.isascii() and currency.isupper()):
            raise ValueError("a merchant id has no slash and a currency is three capital letters")
        if merchant_id in self._last():
            raise ValueError(f"{merchant_id} exists")
        return self._key(merchant_id, currency, "create")

    def rotate(self, merchant_id: str) -> str:
        return self._key(merchant_id, self._last()[merchant_id]["currency"], "rotate")

    def revoke(self, merchant_id: str) -> None:
        self._add(**(self._last()[merchant_id] | {"active": False, "action": "revoke"}))

    def verify(self, key: str) -> tuple[str, str] | None:
        """(merchant_id, currency) of a valid key."""
        wanted = hashlib.sha256(key.encode()).hexdigest()
        for row in self._last().values():
            if hmac.compare_digest(row["key_hash"], wanted) and row["active"]:
                return row["merchant_id"], row["currency"]
        return None

    def audit(self) -> DataFrame:
        rows = [(i, r["merchant_id"], r["action"]) for i, r in enumerate(self._rows())]
        return self.spark.createDataFrame(rows, "n int, merchant_id string, action string")
