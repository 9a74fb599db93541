import json

import pytest

from tidemark.functions import report
from tidemark.operators import classify, evaluate
from tidemark.schemas import OUTCOMES
from tidemark.sources import files, generate, vectors
from tidemark.sources.vtable import Files, VTable, pinned, prune_snapshots, snapshots
from tidemark.streaming import ingest, loops, service
from tests.test_operators import item

NOW = 1_700_000_000.0


def test_from_request_to_outcome(spark, tmp_path):
    registry = files.Registry(spark, f"file://{tmp_path}/merchants")
    key, other = registry.create("m_1", "USD"), registry.create("m_2", "USD")
    s = service.Service(spark, f"file://{tmp_path}/d", registry, clock=lambda: NOW, free=lambda: 1 << 40)
    body = json.dumps({"changes": [item(), item(merchant_product_id="q"), item(source_version=0)]}).encode()
    got = s.submit(body, key)
    assert got["accepted"] == 2 and [r["change_index"] for r in got["rejected"]] == [2]
    none = spark.createDataFrame([], OUTCOMES)
    assert [tuple(r) for r in s.status(got["submission_id"], key, none).collect()] == [(0, "pending"), (1, "pending"), (2, "rejected")]
    j = ingest.Ingest(spark, f"file://{tmp_path}/d", say=lambda line: None, clock=lambda: NOW)
    j.start().awaitTermination()
    assert [tuple(r) for r in s.status(got["submission_id"], key, j.outcomes.read()).collect()] == [(0, "written"), (1, "written"), (2, "rejected")]
    assert files.read_events(spark, f"{tmp_path}/d/events", submission_id=got["submission_id"]).count() == 3
    for bad, code in ((lambda: s.submit(body, None), 401), (lambda: s.submit(b"{", key), 400), (lambda: s.submit(b" " * (service.MAX_BODY + 1), key), 413), (lambda: s.status("x", key, none), 404), (lambda: s.status(got["submission_id"], other, none), 404)):
        with pytest.raises(service.Refusal) as e:
            bad()
        assert e.value.code == code
    s.clock = lambda: NOW + service.EXPIRES_S + 1
    with pytest.raises(service.Refusal, match="expired"):
        s.status(got["submission_id"], key, none)
    s.free = lambda: 0
    with pytest.raises(service.Refusal, match="disk"):
        s.submit(body, key)


def test_index_checks(spark, tmp_path):
    paths = spark.createDataFrame([("A",)], "path string")
    good = spark.createDataFrame([(1, [1.0, 0.0], "A")], "id long, vector array<double>, label string")
    name = vectors.name_of("model", "texts")
    vectors.save(good, f"file://{tmp_path}/i", name)
    assert vectors.load(spark, f"file://{tmp_path}/i", name, paths, 2).count() == 1
    with pytest.raises(vectors.Unsound, match="no index"):
        vectors.load(spark, f"file://{tmp_path}/i", vectors.name_of("other"), paths, 2)
    for bad in ([(1, [1.0], "A")], [(1, [float("nan"), 0.0], "A")], [(1, [1.0, 0.0], "B")]):
        with pytest.raises(vectors.Unsound):
            vectors.checked(spark.createDataFrame(bad, good.schema), paths, 2)
    calls = []
    for _ in range(2):
        vectors.cached(good, f"file://{tmp_path}/c", name, lambda r: calls.append(1) or r).count()
    assert calls == [1]


def test_generated_changes_repeat(spark):
    a, b = (generate.changes(spark, 50, seed=1).collect() for _ in range(2))
    assert a == b and a != generate.changes(spark, 50, seed=2).collect()
    assert generate.requests(generate.changes(spark, 50, seed=1), 20).groupBy("request").count().count() == 3


def test_bench_of_a_classifier(spark):
    rows = spark.createDataFrame([(i, "Title", "", "{}", "Fake > T") for i in range(5)], "id int, title string, description string, attributes string, category string")
    answers, batches = evaluate.run(classify.Fake(), rows, spark.createDataFrame([("Fake > T",)], "path string"), batch=2)
    assert answers.filter("valid and category = label").count() == 5 and batches.count() == 3
    assert batches.filter("seconds >= 0 and usd = 0 and rss_mb > 1").count() == 3

    class Paid(classify.Fake):
        usd = 0.0

        def classify(self, listings):
            self.usd += 0.5 * len(listings)
            return super().classify(listings)

    answers, batches = evaluate.run(Paid, rows, spark.createDataFrame([("Other",)], "path string"), batch=2)
    assert answers.filter("valid").count() == 0 and [r["usd"] for r in batches.orderBy("batch").collect()] == [1.0, 1.0, 0.5]


def test_snapshots(spark, tmp_path):
    t = VTable.create(spark, f"file://{tmp_path}/t", OUTCOMES, keyed=False)
    t.append(spark.createDataFrame([("h", "s", 0, "written")], OUTCOMES))
    for name in ("1", "2", "3"):
        t.snapshot(f"{tmp_path}/s", name)
    assert pinned(spark, f"{tmp_path}/s", "2") == (t.table_id, 1)
    assert prune_snapshots(spark, f"{tmp_path}/s", 0) == ["1", "2"] and snapshots(spark, f"{tmp_path}/s") == ["3"]


def test_reports():
    assert report.duration("1.5h") == 5400 and report.duration("90") == 90
    for bad in ("0s", "x", "5w"):
        with pytest.raises(ValueError):
            report.duration(bad)
    assert report.sweep([{"threshold": 0.5, "accuracy": 0.25, "precision": None, "uncategorized": 1, "level1": 0, "level2": 0}]).splitlines()[2] == "| 0.50 | 25.0% | – | 100.0% | 0.0% | 0.0% |"
    assert report.restart([], 0) == 1 and report.restart([1, 2, 3], 4) == 4 and report.restart([1, 2, 3, 4, 5], 6) is None


def test_a_loop_ticks_until_it_is_stopped(spark, tmp_path):
    made, claim, now = Files(spark, f"file://{tmp_path}"), f"file://{tmp_path}/export.claim", [100.0]
    seen = []

    def tick():
        seen.append(len(seen))
        if len(seen) == 4:
            loop.stop.set()
        return len(seen) < 3

    loop = loops.Loop(made, claim, tick, interval=0.01, clock=lambda: now[0])
    assert loop.run() == 4 and not made.exists(claim)

    def other():
        with pytest.raises(loops.Taken):
            loops.Loop(made, claim, lambda: None, clock=lambda: now[0]).run()
        now[0] += 1000  # the holder has not renewed its claim for too long
        late = loops.Loop(made, claim, lambda: late.stop.set(), clock=lambda: now[0])
        assert late.run() == 1
        raise OSError("a tick that fails")

    with pytest.raises(OSError, match="fails"):
        loops.Loop(made, claim, other, clock=lambda: now[0]).run()
    assert not made.exists(claim)


def test_training_files_are_the_same_bytes(spark, tmp_path):
    rows = [(str(i % 40), f"t{i}", "", "A", "s") for i in range(200)]
    found = []
    for k, order in enumerate((rows, rows[::-1])):
        df = spark.createDataFrame(order, "id string, title string, description string, category string, source string").repartition(3 + k)
        files.write_training(df, f"file://{tmp_path}/{k}", parts=2)
        found.append(sorted(p.read_bytes() for p in (tmp_path / str(k)).glob("*.gz")))
    assert found[0] == found[1] and len(found[0]) == 2
