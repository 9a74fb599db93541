"""The versioned table, the landing log, the ingest and export jobs, with crashes between their steps."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import feed, fold, status
from tidemark.operators.classify import Fake
from tidemark.schemas import KEYS, STORE
from tidemark.sources import generate
from tidemark.sources.vtable import Conflict, VTable
from tidemark.streaming import ingest, landing, liveness
from tidemark.streaming.export import Export
from tidemark.streaming.ingest import Ingest
from tidemark.streaming.landing import LandingLog

MS = 1_700_000_000_000


def store_rows(spark, *rows):
    """(product, version, hash, dead) as store rows."""
    data = [(p, v, h, d) for p, v, h, d in rows]
    df = spark.createDataFrame(data, "merchant_product_id string, source_version long, content_hash string, is_tombstone boolean")
    df = df.withColumn("merchant_id", F.lit("m_1")).withColumn("needs_reclassify", F.lit(False)).withColumn("updated_at", F.timestamp_seconds(F.lit(0))).withColumn("partition", F.lit(0))
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in STORE))


def state(df):
    return {r["merchant_product_id"]: (r["source_version"], r["content_hash"], r["is_tombstone"]) for r in df.collect()}


def test_merge_feed_rewind_compact_vacuum(spark, tmp_path):
    t = VTable.create(spark, f"file://{tmp_path}/t", STORE, keyed=True)
    assert VTable.create(spark, f"file://{tmp_path}/t", STORE, keyed=True).table_id == t.table_id
    assert t.merge(store_rows(spark)) == (0, None) and t.head() == 0
    assert t.merge(store_rows(spark, ("a", 1, "x", False), ("b", 1, "x", False))) == (2, 1)
    assert t.merge(store_rows(spark, ("a", 2, "y", False), ("b", 1, "z", False), ("c", 5, "n", True))) == (2, 2)
    assert t.merge(store_rows(spark, ("a", 2, "y", False), ("b", 0, "x", False)))[0] == 1
    assert state(t.read()) == {"a": (2, "y", False), "b": (1, "x", False), "c": (5, "n", True)}
    assert state(t.read(1)) == {"a": (1, "x", False), "b": (1, "x", False)}
    assert state(feed.rewound(t.read().select(*KEYS, "source_version", "content_hash", "is_tombstone"), t.feed(), 1)) == state(t.read(1))
    kinds = sorted((r["_commit_version"], r["merchant_product_id"], r["_change_type"]) for r in t.feed().collect())
    assert kinds == [(1, "a", "insert"), (1, "b", "insert"), (2, "a", "update_postimage"), (2, "a", "update_preimage"), (2, "c", "insert"), (3, "a", "update_postimage"), (3, "a", "update_preimage")]
    before = state(t.read())
    t.merge(store_rows(spark, ("d", 1, "x", False)))
    before = state(t.read())
    assert t.compact(small_files=2) and t.feed(5).isEmpty()
    assert state(t.read()) == before
    now = t._now() + 10_000
    assert t.vacuum(0, pins=(1,), now_ms=now) == [] and t.vacuum(60_000, now_ms=now) == []
    assert t.vacuum(0, now_ms=now) and state(t.read()) == before
    t.prune_log(t.head())
    assert state(VTable(spark, t.root).read()) == before and t.feed(1, 2).isEmpty()
    path = t.snapshot(f"{tmp_path}/snapshots", "20231114T221320Z")
    assert spark.read.parquet(f"{path}/data").count() == 4 and json.loads((tmp_path / "snapshots/20231114T221320Z/pinned.json").read_text())["version"] == t.head()


def test_only_touched_files_are_rewritten(spark, tmp_path):
    t = VTable.create(spark, f"file://{tmp_path}/t", STORE, keyed=True, rows_per_file="20")
    t.merge(store_rows(spark, *((f"p{i}", 1, "x", False) for i in range(200))))
    before = set(t._live())
    assert len(before) >= 10
    t.merge(store_rows(spark, ("p7", 2, "y", False)))
    assert len(before - set(t._live())) == 1
    keys = store_rows(spark, ("p7", 0, "", False), ("p8", 0, "", False), ("none", 0, "", False))
    assert len(t.holding(keys)) <= 3 and state(t.lookup(keys)) == {"p7": (2, "y", False), "p8": (1, "x", False)}
    t.compact(small_files=2)
    assert t.read().count() == 200


def test_a_long_log_is_read_from_its_last_list(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidemark.sources.vtable.CHECKPOINT", 3)
    t = VTable.create(spark, f"file://{tmp_path}/t", STORE, keyed=True)
    for v in range(1, 8):
        t.merge(store_rows(spark, ("a", v, "x", False), (f"k{v}", 1, "x", False)))
    read = []
    real = t._entry
    t._entry = lambda v: read.append(v) or real(v)
    assert state(t.read()) == {"a": (7, "x", False)} | {f"k{v}": (1, "x", False) for v in range(1, 8)} and min(read) == 6
    assert state(t.read(4)) == {"a": (4, "x", False)} | {f"k{v}": (1, "x", False) for v in range(1, 5)}


def test_one_writer_gets_a_version(spark, tmp_path):
    t = VTable.create(spark, f"file://{tmp_path}/t", STORE, keyed=True)
    t.merge(store_rows(spark, ("a", 1, "x", False)))
    with pytest.raises(Conflict):
        t._commit(1, op="append")
    heads = iter([0, t.head(), t.head()])
    real = t.head
    t.head = lambda: next(heads, real())
    assert t.merge(store_rows(spark, ("a", 2, "y", False))) == (1, 2)


def up(n, product, version, title="Red shirt", price=10**6, op="upsert"):
    listing = json.dumps({"title": title, "description": "", "price_micros": price, "currency": "USD", "availability": "in_stock", "attributes": {"size": "M"}}) if op == "upsert" else None
    return (n, "m_1", product, version, op, listing)


def land(spark, log, commit, *changes):
    rows = [(*c, f"{MS + commit:012x}"[:8] + "-" + f"{MS + commit:012x}"[8:] + f"-7000-8000-{commit:012x}", i) for i, c in enumerate(changes)]
    df = spark.createDataFrame(rows, "nth int, merchant_id string, merchant_product_id string, source_version long, op string, listing string, submission_id string, change_index int")
    return log.append(df.withColumn("received_at", F.timestamp_seconds(F.lit(MS // 1000 + commit))))


BACKLOG = [
    [up(0, "plain", 1), up(1, "tie", 1), up(2, "tie", 1, "Blue"), up(3, "newer", 1), up(4, "spoiled", 1, price="free"), up(5, "gone", 1)],
    [up(0, "newer", 3, "Green"), up(1, "newer", 2, "Old"), up(2, "again", 1), up(3, "again", 1), up(4, "gone", 2, op="delete")],
    [up(0, "plain", 1), up(1, "gone", 2), up(2, "unknown", 9, op="delete")],
]
WANT = [["written", "written", "conflict", "written", "failed", "written"], ["written", "stale", "written", "already_applied", "written"], ["already_applied", "conflict", "written"]]


def job(spark, root, **options):
    said = []
    return ingest.Ingest(spark, root, say=said.append, clock=lambda: 1_700_003_600.0, **options), said


def run(j, **options):
    q = j.start(**options)
    try:
        q.awaitTermination()
    finally:
        q.stop()


def reported(j):
    return {(int(r["submission_id"][-12:]), r["change_index"]): r["outcome"] for r in j.outcomes.read().collect()}


def backlog(spark, root):
    j, said = job(spark, root)
    for n, changes in enumerate(BACKLOG):
        land(spark, j.landing, n, *changes)
    return j, said


@pytest.mark.parametrize("files", [1, 100])
def test_backlog_whatever_the_batches(spark, tmp_path, files):
    j, said = backlog(spark, f"file://{tmp_path}/d")
    run(j, max_bytes=None, max_files=files)
    assert reported(j) == {(n, i): o for n, x in enumerate(WANT) for i, o in enumerate(x)}
    assert len(said) == (3 if files == 1 else 1)
    failed = [x for line in said for x in line.get("failed", [])]
    assert [(x["change_index"], x["error"]) for x in failed] == [(i, "cannot be stored without price_micros") for w in WANT for i, o in enumerate(w) if o == "failed"]
    got = {r["merchant_product_id"]: r for r in j.store.read().collect()}
    assert got["newer"]["title"] == "Green" and got["newer"]["primary_category"] == "Fake > G" and got["gone"]["is_tombstone"] and got["unknown"]["is_tombstone"]
    assert got["plain"]["attributes"] == '{"size": "M"}' and "spoiled" not in got
    log = ingest.changes_of(j.landing.read()).filter("storable")
    expected = fold.expected_store(log).withColumnRenamed("hash", "content_hash")
    assert feed.difference(expected, j.store.read(), "source_version", "content_hash", "is_tombstone").isEmpty()
    again, _ = job(spark, f"file://{tmp_path}/d")
    before = j.store.head(), j.outcomes.head()
    run(again)
    assert (again.store.head(), again.outcomes.head()) == before


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["planned", "merged", "appended"])
def test_a_crash_replays_the_batch(spark, tmp_path, step):
    j, _ = backlog(spark, f"file://{tmp_path}/d")

    def crash(at):
        if at == step:
            raise Crash(step)

    j.after = crash
    with pytest.raises(Exception, match=step):
        run(j)
    again, _ = job(spark, f"file://{tmp_path}/d")
    run(again)
    got = reported(again)
    assert set(got) == {(n, i) for n, x in enumerate(WANT) for i, _ in enumerate(x)}
    if step != "merged":
        assert got == {(n, i): o for n, x in enumerate(WANT) for i, o in enumerate(x)}
    else:
        assert set(got.values()) <= {"already_applied", "stale", "conflict", "failed"}
    log = ingest.changes_of(again.landing.read()).filter("storable")
    expected = fold.expected_store(log).withColumnRenamed("hash", "content_hash")
    assert feed.difference(expected, again.store.read(), "source_version", "content_hash", "is_tombstone").isEmpty()


def test_backfill_and_failing_classifier(spark, tmp_path):
    root = f"file://{tmp_path}/d"
    j, _ = job(spark, root, make=lambda: Fake("fake-0", fail=True))
    land(spark, j.landing, 0, up(0, "a", 1), up(1, "b", 1, "Blue"), up(2, "c", 1, "Cyan"))
    run(j)
    assert {r["primary_category"] for r in j.store.read().collect()} == {"Uncategorized"} and all(r["needs_reclassify"] for r in j.store.read().collect())
    k, _ = job(spark, root, make=lambda: Fake("fake-1"), backfill=2)
    land(spark, k.landing, 1, up(0, "d", 1))
    run(k)
    got = {r["merchant_product_id"]: (r["primary_category"], r["taxonomy_version"]) for r in k.store.read().collect()}
    assert got == {"a": ("Fake > R", "fake-1"), "b": ("Fake > B", "fake-1"), "c": ("Uncategorized", "fake-0"), "d": ("Fake > R", "fake-1")}
    assert set(reported(k)) == {(0, 0), (0, 1), (0, 2), (1, 0)}


def test_a_job_keeps_to_its_tables(spark, tmp_path):
    import shutil

    j, _ = backlog(spark, f"file://{tmp_path}/d")
    run(j)
    shutil.rmtree(tmp_path / "d/store")
    with pytest.raises(ingest.Refused):
        job(spark, f"file://{tmp_path}/d")[0].start()
    shutil.rmtree(tmp_path / "d/checkpoint")
    (tmp_path / "d/tables.json").unlink()
    with pytest.raises(ingest.Refused):
        job(spark, f"file://{tmp_path}/d")[0].start()


def test_exports_replay_to_the_store(spark, tmp_path):
    j, _ = backlog(spark, f"file://{tmp_path}/d")
    run(j, max_bytes=None, max_files=1)
    x = Export(spark, j.store, f"file://{tmp_path}/x", max_versions=2)
    assert x.tick() == (1, 2) and x.tick() == (3, 3) and x.tick() is None
    from tidemark.sources.files import read_exports

    held = feed.replayed(read_exports(spark, f"{tmp_path}/x").select(*KEYS, "source_version", "content_hash", "op", "file"))
    live = j.store.read().filter("not is_tombstone")
    assert feed.difference(live, held, "source_version", "content_hash").isEmpty()
    (tmp_path / "x/_watermark.json").unlink()
    assert Export(spark, j.store, f"file://{tmp_path}/x").watermark() == 3


def test_status_of_a_submission(spark, tmp_path):
    j, _ = backlog(spark, f"file://{tmp_path}/d")
    accepted = j.landing.read().select("submission_id", "change_index", "merchant_id", F.lit("accepted").alias("type"))
    assert {r["outcome"] for r in status.folded(accepted).collect()} == {"pending"}
    run(j)
    found = j.outcomes.read().select("submission_id", "change_index", F.lit("m_1").alias("merchant_id"), F.col("outcome").alias("type"))
    done = status.counts(status.folded(accepted.unionByName(found)))
    assert done.filter("done").count() == 3 and status.unanswered(j.landing.read(), found).isEmpty()


def test_requests_share_commits():
    import threading

    made = []

    def commit(entries):
        made.append(entries)
        return len(made)

    a = landing.Appender(commit, window=0.2, group=3)
    threads = [threading.Thread(target=a.submit, args=([i, i],)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(len(x) for x in made) == [2, 2, 2]
    assert a.submit([9]) == 4


def test_a_lost_race_takes_the_next_commit(spark, tmp_path):
    log = LandingLog(spark, f"file://{tmp_path}/landing")
    rows = generate_rows(spark, 3)
    assert log.append(rows) == 0
    seen, real = [], log.commits
    log.commits = lambda: (seen.append(1), real() if len(seen) > 1 else [])[1]  # the first look is before the other's commit
    assert log.append(rows) == 1 and len(seen) == 2
    assert {r["_commit_version"] for r in log.read().collect()} == {0, 1}
    log.commits = lambda: []
    with pytest.raises(RuntimeError, match="is taken"):
        log.append(rows)


def generate_rows(spark, n):
    return generate.changes(spark, n, seed=4).selectExpr("*", "'00000000-0000-7000-8000-000000000000' as submission_id", "nth as change_index", "timestamp '2024-01-01' as received_at")


def test_a_rebuild_goes_on_where_it_was_cut_short(spark, tmp_path):
    job = Ingest(spark, f"file://{tmp_path}/r", say=lambda line: None)
    job.landing.append(generate_rows(spark, 300))

    def fail(step):
        if step == "rebuilt":
            raise OSError("gone")

    job.after = fail
    with pytest.raises(OSError):
        job.rebuild(4)
    first = job.store.read().count()
    job.after = lambda step: None
    taken = job.rebuild(4)
    assert 0 < first < 300 and job.store.read().count() == 300 and taken >= 1
    assert job.rebuild(4) == taken + 1 and job.store.read().count() == 300


def test_batches_read_no_file_without_pending_rows(spark, tmp_path):
    job = Ingest(spark, f"file://{tmp_path}/b", say=lambda line: None)
    job.landing.append(generate_rows(spark, 50))
    job.start().awaitTermination()
    items = job.store._live().values()
    assert items and all(x["flagged"] == 0 and x["versions"] == ["fake-0"] for x in items)
    read, real = [], job.store._frame
    job.store._frame = lambda paths: (read.append(len(paths)), real(paths))[1]
    job.store.read(None, lambda x: x.get("flagged", 1) or set(x["versions"]) - {"fake-0"}).collect()
    assert read == [0]


def test_stalls():
    over, mark = liveness.stalled(True, 1, None, 0, 5)
    assert not over and liveness.stalled(True, 1, mark, 4, 5)[0] is False and liveness.stalled(True, 1, mark, 6, 5)[0]
    assert liveness.stalled(True, 2, mark, 6, 5) == (False, (2, 6)) and liveness.stalled(False, 1, mark, 99, 5) == (False, None)
