"""Token ids as Arrow files of fixed-size lists.

A file holds record batches of equal-length sequences: ``ids`` and ``mask``, both fixed-size lists,
in Arrow's file format (its stream format with a footer that gives each batch's place). A sequence or
mask is read by its number alone, without copying, from a memory map. A second Arrow file beside it
gives each document's place in the file's stream of ids. Documents lie end to end in ascending doc_id
order; only a file's last sequence is padded, where the mask is false.

Each task writes files under names of its own and reports them; only reported files are read, so a
task that runs twice or a lost executor leaves nothing but an unread file. The driver sees one row
per file, and writes them last, in order, as the folder's manifest (MANIFEST_NAME): with it alone the
folder is read in order, later and elsewhere. Tasks are ranges of (doc_id, the text's first PREFIX
characters), so that neither a hot id nor rows without one are a task's alone, unless their texts begin alike.

Defined cases: null and empty texts are the end id alone; repeated rows are written each; rows of
equal doc_id lie side by side in text order; null doc_ids come first; no rows give a
manifest without files; a text of any length may span sequences; extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import shared, tokens

LENGTH, END_ID = 2048, 1
#: Sequences in a record batch: 64 of 2,048 two-byte ids are 256 KB.
BATCH = 64
#: Characters of a text that ranges of documents are cut by.
PREFIX = 64

MADE = "path string, first_doc long, first_text string, n_docs long, n_tokens long"
MANIFEST_NAME = "_manifest.json"


def id_type(n_ids: int) -> pa.DataType:
    """The narrowest unsigned type that holds every id."""
    return pa.uint16() if n_ids <= 1 << 16 else pa.uint32()


def _opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, Hadoop's ``file:/...`` included, and the path there."""
    return pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


class Writer:
    """Appends documents' ids to one pair of files."""

    def __init__(self, path: str, length: int, kind: pa.DataType):
        self.fs, at = _opened(path)
        self.length, self.kind, self.at = length, kind, at
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.files = [self.fs.open_output_stream(f"{at}.ids.arrow"), self.fs.open_output_stream(f"{at}.docs.arrow")]
        self.index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = [pa.ipc.new_file(f, s) for f, s in zip(self.files, (self.schema, self.index), strict=True)]
        self.rest, self.n_tokens, self.n_docs = np.zeros(0, np.uint32), 0, 0

    def add(self, keys: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        size = np.diff(ends)
        self.out[1].write_batch(pa.RecordBatch.from_arrays([keys, pa.array(ends[:-1] - ends[0] + self.n_tokens), pa.array(size)], schema=self.index))
        self.n_tokens += len(ids)
        self.n_docs += len(size)
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // (self.length * BATCH) * self.length * BATCH
        self._write(self.rest[:whole])
        self.rest = self.rest[whole:].copy()

    def _write(self, ids: np.ndarray, real: int | None = None) -> None:
        step = self.length * BATCH
        for a in range(0, len(ids), step):
            part = ids[a : a + step]
            mask = np.ones(len(part), bool)
            if real is not None:
                mask[max(0, real - a) :] = False
            columns = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(part, self.kind), pa.array(mask))]
            self.out[0].write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        real = len(self.rest)
        self._write(np.concatenate([self.rest, np.zeros(-real % self.length, np.uint32)]), real)
        for x in (*self.out, *self.files):
            x.close()


class Reader:
    """Random access to a file pair's sequences and documents."""

    def __init__(self, path: str):
        fs, at = _opened(path)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        source = [pa.memory_map(f"{at}.{x}.arrow") if local else fs.open_input_file(f"{at}.{x}.arrow") for x in ("ids", "docs")]
        self.ids, self.docs = (pa.ipc.open_file(x) for x in source)
        self.length = self.ids.schema.field("ids").type.list_size

    def batch(self, k: int) -> np.ndarray:
        column = self.ids.get_batch(k).column("ids")
        return column.flatten().to_numpy()

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The i-th sequence's ids and mask."""
        batch = self.ids.get_batch(i // BATCH)
        one = [batch.column(x).slice(i % BATCH, 1).flatten() for x in ("ids", "mask")]
        return one[0].to_numpy(), one[1].to_numpy(zero_copy_only=False)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Each document's id, its start in this file and its ids, read batch by batch."""
        step, held = self.length * BATCH, (-1, np.zeros(0))
        for k in range(self.docs.num_record_batches):
            table = self.docs.get_batch(k)
            for key, start, n in zip(*(table.column(x).to_pylist() for x in ("doc_id", "start", "n_tokens")), strict=True):
                parts, at = [], start
                while at < start + n:
                    if held[0] != at // step:
                        held = (at // step, self.batch(at // step))
                    stop = min(start + n, (at // step + 1) * step)
                    parts.append(held[1][at - at // step * step : stop - at // step * step])
                    at = stop
                yield key, start, parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint32), *parts])


def write(docs: DataFrame, tokenizer: str, folder: str, length: int = LENGTH, end_id: int | None = END_ID) -> list[dict]:
    """Writes all documents' ids in ascending doc_id order, then the manifest; returns its files, in order: name,
    first_doc, n_docs, n_tokens and base, the ids before it."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, first, path = None, None, None, ""
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                encoder = tokens.encoder(tokenizer, end_id)
                path, first = f"{folder}/part-{uuid.uuid4().hex}", [batch.column(x)[0].as_py() for x in ("doc_id", "begin")]
                out = Writer(path, length, id_type(encoder.tokenizer.get_vocab_size()))
            data, at = shared.text_bytes(batch.column("text"))
            for lo, hi in shared.slices(at, tokens.SLICE_BYTES):
                out.add(batch.column("doc_id").slice(lo, hi - lo), *encoder.encode(data, at[lo : hi + 1]))
        if out is not None:
            out.close()
            columns = [pa.array([path]), pa.array(first[:1], pa.int64()), pa.array(first[1:], pa.string()), *(pa.array([x], pa.int64()) for x in (out.n_docs, out.n_tokens))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "first_doc", "first_text", "n_docs", "n_tokens"])

    fs, at = _opened(folder)
    fs.create_dir(at, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.left("text", F.lit(PREFIX)).alias("begin"))
    rows = rows.repartitionByRange("doc_id", "begin").sortWithinPartitions("doc_id", "text")
    made = rows.mapInArrow(put, MADE).collect()  # a row per file
    base, files = 0, []
    for r in sorted(made, key=lambda r: (r["first_doc"] is not None, r["first_doc"] or 0, r["first_text"] is not None, (r["first_text"] or "").encode())):
        files.append({"name": r["path"].rpartition("/")[2], "first_doc": r["first_doc"], "n_docs": r["n_docs"], "n_tokens": r["n_tokens"], "base": base})
        base += r["n_tokens"]
    with fs.open_output_stream(f"{at}/.{MANIFEST_NAME}") as f:
        f.write(json.dumps({"length": length, "end_id": end_id, "n_tokens": base, "files": files}).encode())
    fs.move(f"{at}/.{MANIFEST_NAME}", f"{at}/{MANIFEST_NAME}")
    return files


def manifest(folder: str) -> dict:
    """What a folder holds: length, end_id, n_tokens and its files in order."""
    fs, at = _opened(folder)
    with fs.open_input_file(f"{at}/{MANIFEST_NAME}") as f:
        return json.loads(f.readall())


def read(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """Documents of the files, each with the number of ids before its file, as read back from them."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(batch.column(x).to_pylist() for x in ("path", "base")), strict=True):
                rows = [(key, base + start, len(ids), zlib.crc32(ids.astype("<u4"))) for key, start, ids in Reader(path).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = spark.sparkContext.parallelize(files, max(1, len(files)))
    return spark.createDataFrame(spread, "path string, base long").mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode(docs: DataFrame, tokenizer: str, folder: str | None = None, length: int = LENGTH, end_id: int | None = END_ID) -> DataFrame:
    """Writes the files and returns each document's place and checksum as read back from them."""
    folder = folder or shared.scratch(docs.sparkSession, "ids")
    write(docs, tokenizer, folder, length, end_id)
    return documents(docs.sparkSession, folder)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's place and checksum, from a folder's manifest and files alone."""
    return read(spark, [(f"{folder}/{x['name']}", x["base"]) for x in manifest(folder)["files"]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(shared.table(spark, sf_dir, "documents"), tokens.vocabulary())
