"""Envelope, taxonomy, curation, classification, vectors, evaluation, files."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import classify, curate, envelope, evaluate, knn, metrics, taxonomy
from tidemark.sources import files

NOW = 1_700_000_000_000
LISTING = {"title": "Red shirt", "description": "", "price_micros": 1, "currency": "USD", "availability": "in_stock", "attributes": {}}


def item(**changes):
    listing = LISTING | changes.pop("listing", {})
    return {"op": "upsert", "merchant_product_id": "p", "source_version": 1, "listing": listing} | changes


def check(spark, *items):
    rows = envelope.check_batch(spark, json.dumps({"changes": list(items)}), merchant_id="m_1", currency="USD", now_ms=NOW)
    return [(r["accepted"], r["errors"]) for r in rows.orderBy("change_index").collect()]


ACCEPTED = [
    item(), {"op": "delete", "merchant_product_id": "p", "source_version": 1}, item(merchant_product_id="x" * 128), item(source_version=NOW + envelope.FUTURE_SLACK_MS),
    item(listing={"title": "t" * 150, "description": "d" * 5000, "price_micros": envelope.INT64_MAX, "attributes": {"a" * 100: "v" * 1000}}), item(merchant_product_id="漢字 é"), item(merchant_product_id="a b"),
]
REJECTED = [
    (item(merchant_product_id=""), "merchant_product_id"), (item(merchant_product_id="x" * 129), "merchant_product_id"), (item(merchant_product_id=" p"), "merchant_product_id"), (item(merchant_product_id="p\t"), "merchant_product_id"),
    (item(merchant_product_id="a\u0000b"), "merchant_product_id"), (item(merchant_product_id="a b"), "merchant_product_id"), (item(source_version=0), "source_version"), (item(source_version="1"), "source_version"), (item(source_version=1.5), "source_version"),
    (item(source_version=NOW + envelope.FUTURE_SLACK_MS + 1), "source_version"), (item(op="reclassify"), "change"), (item(extra=1), "extra"), (item(listing={"title": ""}), "listing.title"), (item(listing={"title": "t" * 151}), "listing.title"),
    (item(listing={"description": "d" * 5001}), "listing.description"), (item(listing={"price_micros": 0}), "listing.price_micros"), (item(listing={"price_micros": True}), "listing.price_micros"), (item(listing={"currency": "usd"}), "listing.currency"),
    (item(listing={"currency": "EUR"}), "listing.currency"), (item(listing={"availability": "gone"}), "listing.availability"), (item(listing={"attributes": {"": "x"}}), "listing.attributes"), (item(listing={"attributes": {str(i): "" for i in range(101)}}), "listing.attributes"),
    (item(listing={"unknown": 1}), "listing.unknown"), ("text", "change"), ({"op": "delete", "source_version": 1}, "merchant_product_id"),
]


def test_changes_one_by_one(spark):
    got = check(spark, *ACCEPTED, *(x for x, _ in REJECTED))
    assert got[: len(ACCEPTED)] == [(True, [])] * len(ACCEPTED)
    for (accepted, errors), (x, path) in zip(got[len(ACCEPTED) :], REJECTED, strict=True):
        assert not accepted and any(e.startswith(f"{path}:") for e in errors), (x, errors)


def test_business_errors_come_together_and_after_structure(spark):
    late = NOW + 2 * envelope.FUTURE_SLACK_MS
    got = check(spark, item(source_version=late, listing={"currency": "EUR"}), item(source_version=late, listing={"title": ""}))
    assert [e.split(":")[0] for e in got[0][1]] == ["source_version", "listing.currency"] and [e.split(":")[0] for e in got[1][1]] == ["listing.title"]


@pytest.mark.parametrize("body", ["[]", "{}", '{"changes": []}', '{"changes": 1}', '{"changes": [1], "x": 2}', "{", json.dumps({"changes": [0] * 10_001})])
def test_bad_batches(spark, body):
    with pytest.raises(envelope.BadBatch):
        envelope.check_batch(spark, body, merchant_id="m", currency="USD", now_ms=NOW)


RELEASE = "# Taxonomy - Categories: 2026-08\ng1 : Apparel\ng2 : Apparel > Shirts\ng3 : Apparel > Shirts > Polo: short\ng4 : Apparel > Shirts > Polo: short > Kids\ng5 : Uncategorized\n"


def test_taxonomy(spark, tmp_path):
    (tmp_path / "t.txt").write_text(RELEASE)
    (tmp_path / "t.txt.gz").write_bytes(gzip.compress(RELEASE.encode()))
    for name in ("t.txt", "t.txt.gz"):
        version, paths = taxonomy.load(spark, f"{tmp_path}/{name}")
        assert version == "2026-08" and [r["path"] for r in paths.orderBy("number").collect()] == ["Apparel", "Apparel > Shirts", "Apparel > Shirts > Polo: short", "Uncategorized"]
    assert taxonomy.trim(paths, 2).count() == 2
    full = spark.createDataFrame([("Apparel > Shirts > Polo: short",), ("Apparel > Shirts > Polo: short > Kids",)], "path string")
    deeper = taxonomy.descendants(full)
    assert [(r["category"], r["deeper"]) for r in deeper.collect()] == [("Apparel > Shirts > Polo: short", ["Apparel > Shirts > Polo: short > Kids"])]
    assert taxonomy.texts(paths, "deeper", deeper).count() == 5


@pytest.mark.parametrize("bad,line", [("x : A\n", "version"), ("# Categories: 1\nx : A\nx : A\n", "line 3"), ("# Categories: 1\nx : A > B\nx : A\n", "line 2"), ("# Categories: 1\nx : A\nx : A >  > C\n", "line 3"), ("# Categories: 1\nnothing\n", "line 2")])
def test_bad_taxonomies(spark, tmp_path, bad, line):
    (tmp_path / "t.txt").write_text(bad)
    with pytest.raises(ValueError, match=line):
        taxonomy.load(spark, f"{tmp_path}/t.txt")


def test_curation(spark):
    paths = spark.createDataFrame([(p,) for p in ("A", "A > B", "A > B > C", "N > B > C", "N", "N > B")], "path string")
    renames = spark.createDataFrame([("Old", "N"), ("Old > X", "A > B")], "old string, new string")
    rows = [(1, "the shirt", "for you", "A > B > C"), (2, "the shirt", "for you", "A > B"), (3, None, "x", "A"), (4, "Das Hemd und der Rock", "nicht für dich", "A"), (5, "cap", "and hat", "Z"), (6, "cap", "", "Old > B > C > D"), (7, "mug", "", "Old > X > C"), (8, " ", "", "A"), (9, "mat", "", None)]
    train = spark.createDataFrame(rows, "n int, title string, description string, category string")
    got = {r["n"]: (r["reason"], r["category"]) for r in curate.usable(train, "s", paths, renames).collect()}
    assert got == {1: (None, "A > B > C"), 2: ("duplicates", "A > B"), 3: ("malformed", "A"), 4: ("non_english", "A"), 5: ("unmapped", None), 6: (None, "N > B > C"), 7: (None, "A > B > C"), 8: ("malformed", "A"), 9: ("malformed", None)}
    test = spark.createDataFrame([(1, "MUG", "else", "A"), (2, "box", "", "A")], "n int, title string, description string, category string")
    drawn, kept, counts = curate.build(test, train, paths, renames, n=1, seed=3)
    assert drawn.count() == 1 and {r["n"] for r in kept.collect()} == {1, 6} and counts["leaks"] == 1 and counts["duplicates"] == 1 and counts["read"] == 11
    assert drawn.collect() == curate.build(test, train, paths, renames, n=1, seed=3)[0].collect()


def test_classifiers(spark):
    rows = spark.createDataFrame([("Red", "", "{}"), ("", "", "{}"), ("Blue", "", "{}")], "title string, description string, attributes string")
    got = {r["title"]: (r["category"], r["provisional"]) for r in classify.classified(rows, classify.Fake).collect()}
    assert got == {"Red": ("Fake > R", False), "": (None, True), "Blue": ("Fake > B", False)}
    chooser = classify.Chooser("v", lambda x: ["A", "B"], lambda x, p: (p[0], 0.4), threshold=0.5)
    assert chooser.classify([{"title": "x"}]) == [("Uncategorized", 0.4)]
    walker = classify.Walker("v", {"": ["A"], "A": ["A > B"]}, lambda x, p: (p[0], 0.5))
    assert walker.classify([{"title": "x"}]) == [("A > B", 0.25)]

    class Broken(classify.Fake):
        def classify(self, listings):
            raise classify.Fatal("no model")

    with pytest.raises(Exception, match="no model"):
        classify.classified(rows, Broken).collect()


def test_a_failing_call_is_split_until_the_fault_is_alone():
    calls = []

    class Picky(classify.Fake):
        def classify(self, listings):
            calls.append(len(listings))
            if any(x["title"] == "bad" for x in listings):
                raise RuntimeError("bad")
            return [("A", 0.5), ("", 0.5), ("A", 2), ("A", float("nan")), ("A", 1), "A", None, ("A", 0.25)][: len(listings)]

    listings = [{"title": "bad" if i in (3, 9) else "x"} for i in range(12)]
    got = classify.answered(Picky(), listings)
    assert [i for i, x in enumerate(got) if x is None and i in (3, 9)] == [3, 9] and got[0] == ("A", 0.5)
    assert max(calls) == 12 and len(calls) <= 2 * 2 * 4 + 1
    assert classify.checked([("A", 0.5), ("", 0.5), ("A", 2), ("A", float("nan")), ("A", 1), "A", None], 7) == [("A", 0.5), None, None, None, ("A", 1.0), None, None]
    with pytest.raises(ValueError, match="3 listings"):
        classify.checked([None], 3)


def test_chooser_rate_budget_and_failures():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    make = lambda ask, **more: classify.Chooser("v", lambda x: ["A", "B"], ask, clock=lambda: now[0], sleep=sleep, **more)
    listings = [{"title": str(i)} for i in range(10)]
    c = make(lambda x, p: ("A", 0.9, 0.5), rate=2, budget=2)
    assert c.classify(listings) == [("A", 0.9)] * 4 + [None] * 6 and c.usd == 2.0 and c.error is None

    def ask(x, p):
        if x["title"] == "2":
            raise RuntimeError("busy")
        return "Z", 0.9

    c = make(ask, threads=1)
    got = c.classify(listings[:3])
    assert got == [("Uncategorized", 0.9)] * 2 + [None] and "busy" in c.error
    with pytest.raises(RuntimeError, match="busy"):
        make(ask).classify(listings[2:3])


def test_walker_goes_level_by_level():
    asked = []

    def choose(x, below):
        asked.append(below[0])
        return below[x["n"] % len(below)], 0.5

    w = classify.Walker("v", {"": ["A", "B"], "A": ["A > C"], "A > C": ["A > C > D"]}, choose)
    assert w.classify([{"n": 0}, {"n": 1}, {"n": 2}]) == [("A > C > D", 0.125), ("B", 0.5), ("A > C > D", 0.125)]
    assert asked == ["A", "A", "A", "A > C", "A > C", "A > C > D", "A > C > D"]
    assert w.classify([]) == []


def points(spark, seed, n):
    import numpy as np

    random = np.random.default_rng(seed)
    centres = np.array([[1, 0], [-0.5, 0.9], [-0.5, -0.9]])
    return spark.createDataFrame([(seed * 1000 + i, (centres[i % 3] + random.normal(0, 0.1, 2)).tolist(), f"C{i % 3}") for i in range(n)], "id long, vector array<double>, label string")


def test_vectors_by_class(spark):
    index, asked = points(spark, 1, 90), points(spark, 2, 30)
    truth = {r["id"]: r["label"] for r in asked.collect()}
    votes = knn.vote(knn.nearest(asked, index, 5)).collect()
    assert len(votes) == 30 and all(r["label"] == truth[r["query_id"]] and r["confidence"] > 0.99 for r in votes)
    assert all(r["category"] == truth[r["query_id"]] for r in knn.best_text(asked, knn.centroids(index), 0.5).collect())
    assert all(r["category"] == "Uncategorized" for r in knn.best_text(asked, knn.centroids(index), 1.1).collect())
    model = knn.Softmax.fit(index)
    assert all(r["label"] == truth[r["id"]] for r in model.predict(asked).collect())
    # the loss is convex: at its least, its slope is nothing
    import numpy as np

    rows = model.shares(index).collect()
    x = np.array([r["vector"] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    gap = np.array([r["shares"] for r in rows]) - np.eye(3)[[int(r["label"][1]) for r in rows]]
    w = model.model.coefficientMatrix.toArray()
    assert np.abs(gap.T @ x / len(x) + 1e-5 * w).max() < 1e-4 and np.abs(gap.mean(axis=0)).max() < 1e-4
    z = x @ w.T + model.model.interceptVector.toArray()
    assert np.allclose(np.exp(z) / np.exp(z).sum(1, keepdims=True), [r["shares"] for r in rows])
    alone = knn.Softmax.fit(index.filter("label = 'C1'"))
    assert {(r["label"], r["confidence"]) for r in alone.predict(asked).collect()} == {("C1", 1.0)}
    with pytest.raises(ValueError, match="no labelled rows"):
        knn.Softmax.fit(index.filter("false"))
    first = knn.shortlist(asked, knn.centroids(index), 2).first()
    assert len(first["paths"]) == 2 and first["paths"][0] == truth[first["query_id"]]


def test_shortlist_holds_k_categories_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(knn, "INDEX_BLOCK", 8)
    texts = [(i, [1.0, 0.001 * i], "a") for i in range(60)] + [(100 + i, [0.5, 1.0 + i], "b") for i in range(5)] + [(200, [-1.0, -0.1], "c")]
    index = spark.createDataFrame(texts, "id long, vector array<double>, label string")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    got = {r["query_id"]: r["paths"] for r in knn.shortlist(asked, index, 3).collect()}
    assert got == {1: ["a", "b", "c"], 2: ["b", "a", "c"]}


def test_votes_that_are_equal_go_to_the_nearest(spark):
    near = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.3, 2), (1, "b", 0.2, 3), (2, "a", -0.5, 1)], "query_id long, label string, sim double, place int")
    got = {r["query_id"]: (r["label"], r["confidence"]) for r in knn.vote(near).collect()}
    assert got == {1: ("a", 0.5), 2: ("a", 0.0)}


def test_thresholds_are_inclusive(spark):
    answers = spark.createDataFrame([("A > B", "A > B", 0.5), ("A > B", "A > C", 0.5), ("A", None, None), ("A", "Uncategorized", 0.9)], "label string, category string, confidence double")
    got = {r["threshold"]: r for r in evaluate.score(answers, [0.5, 0.6]).collect()}
    assert (got[0.5]["accuracy"], got[0.5]["precision"], got[0.5]["level1"], got[0.5]["uncategorized"]) == (0.25, 0.5, 0.5, 0.5)
    assert got[0.6]["precision"] is None and got[0.6]["uncategorized"] == 1
    scored = spark.createDataFrame([(0.3, True), (0.5, True), (0.5, False), (0.9, True)], "confidence double, right boolean")
    assert knn.pick_tau(scored, [0.3, 0.5, 0.9], 0.75, 1).first()[0] == 0.3 and knn.pick_tau(scored, [0.3, 0.5, 0.9], 0.9, 1).first()[0] == 0.9 and knn.pick_tau(scored, [0.3], 0.9, 1).first()[0] is None
    assert [(r["tau"], r["answers"], r["right"]) for r in knn.bands(scored, [0.3, 0.5, 0.9]).orderBy("tau").collect()] == [(0.3, 1, 1), (0.5, 2, 1), (0.9, 1, 1)]
    with pytest.raises(ValueError, match="no answer"):
        evaluate.misses(spark.createDataFrame([(1, "A", "B")], "id int, label string, category string"), spark.createDataFrame([(1, ["A"]), (2, ["A"])], "id int, paths array<string>"), 1)


def test_freshness_by_hand(spark):
    accepted = [(f"s{i}", 0, "accepted", 1000 * 100) for i in range(4)]
    done = [(f"s{i}", 0, "written", 1000 * (100 + a)) for i, a in enumerate((3, 10, 20, 30))]
    events = spark.createDataFrame(accepted + done + [("s0", 0, "stale", 1000 * 300)], "submission_id string, change_index int, type string, ts long")
    r = metrics.freshness(events, 0).first()
    assert (r["changes"], r["p50"], round(r["p99"], 6)) == (4, 15.0, 29.7)
    assert metrics.outcome_rates(events, 0).first()["stale"] == 0


def test_event_files(spark, tmp_path):
    root = f"{tmp_path}/events"
    rows = [("accepted", 1_700_000_000_000, "s1"), ("written", 1_700_000_000_500, "s1"), ("accepted", 1_700_007_200_000, "s2")]
    files.write_events(spark.createDataFrame(rows, "type string, ts long, submission_id string"), root)
    folder = next((tmp_path / "events").glob("hour=*"))
    (folder / "part-broken.txt").write_text('{"type": "accep')
    assert [r["ts"] for r in files.read_events(spark, root).collect()] == [r[1] for r in rows]
    assert [r["type"] for r in files.read_events(spark, root, submission_id="s1").collect()] == ["accepted", "written"]
    assert files.read_events(spark, root, since_ms=1_700_007_200_000).count() == 1


def test_label_files(spark, tmp_path):
    paths = spark.createDataFrame([("A",)], "path string")
    good = '﻿{"id": "1", "title": "t", "description": "d", "category": "A"}\n\n{"id": "2", "title": "t", "description": "", "category": "Uncategorized"}\n'
    (tmp_path / "l.jsonl").write_text(good, encoding="utf-8")
    rows, digest = files.read_labels(spark, f"{tmp_path}/l.jsonl", paths)
    assert rows.count() == 2 and len(digest) == 64
    for bad, why in (('{"id": "1", "title": "t", "category": "B"}', "line 1: category"), ('{"id": "1", "title": "t", "category": "A"}\n{"id": "1", "title": "t", "category": "A"}', "line 2: repeated"), ("{", "line 1: not")):
        (tmp_path / "bad.jsonl").write_text(bad)
        with pytest.raises(ValueError, match=why):
            files.read_labels(spark, f"{tmp_path}/bad.jsonl", paths)


def test_pages(spark, tmp_path):
    rows = [{"title": f"t{i}", "description": "d", "category": "c"} for i in range(250)]
    waits, fails = [], iter([OSError("reset"), None, None, ValueError("no JSON"), None])

    def get(offset, length):
        if (e := next(fails)) is not None:
            raise e
        return {"total": 250, "rows": rows[offset : offset + length]}

    assert list(files.fetch(get, sleep=waits.append)) == rows and waits == [15.0, 15.0]
    with pytest.raises(files.Unavailable):
        list(files.fetch(lambda o, n: {"total": 5, "rows": []}, sleep=waits.append))
    for at in range(0, 250, 100):
        (tmp_path / f"page-{at}.json").write_text(json.dumps({"rows": rows[at : at + 100]}))
    spark.dataSource.register(files.PagedSource)
    assert spark.read.format("paged").option("path", str(tmp_path)).option("total", 250).load().count() == 250


def test_many_pages(spark, tmp_path):
    def held(key):
        return {"title": None if key % 7 == 0 else f"t{key} \u00e9\U0001f600\"\n", "description": f"d{key}", "category": None if key % 11 == 0 else "c"}

    keys = [None, *(i // 3 for i in range(20_004))]  # equal keys, and one that is missing
    rows = [(key, *held(key or 0).values()) for key in keys]
    random.Random(1).shuffle(rows)
    rows = spark.createDataFrame(rows, "key long, title string, description string, category string").repartition(5)
    spark.dataSource.register(files.PagedSource)
    for part, total in ((rows, 20_005), (rows.limit(0), 0)):
        folder = tmp_path / str(total)
        for _ in range(2):  # a page that is there is written again
            assert files.write_pages(part, f"file://{folder}", ["key"], page=10) == total
        assert sorted(p.name for p in folder.iterdir() if p.name[0] != ".") == sorted(f"page-{at}.json" for at in range(0, total, 10))
        pages = [json.loads((folder / f"page-{at}.json").read_text()) for at in range(0, total, 10)]
        assert [row for p in pages for row in p["rows"]] == [{k: v for k, v in held(key or 0).items() if v is not None} for key in keys[:total]]
        assert {p["total"] for p in pages} <= {total} and all(len(p["rows"]) == 10 for p in pages[:-1])
        read = spark.read.format("paged").option("path", f"file://{folder}").option("total", total).option("page", 10).load()
        assert read.rdd.getNumPartitions() < 100
        assert sorted(map(repr, read.collect())) == sorted(map(repr, part.drop("key").collect()))


def test_runs_of_pages():
    for total, page in ((0, 100), (1, 100), (100, 100), (101, 100), (6_401, 100), (20_000, 100), (7_200_001, 100), (12_345, 1)):
        runs = [p.value for p in files.PagedReader("", total, page, 0.0).partitions()]
        assert runs[0][0] == 0 and runs[-1][1] == total and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
        assert all(start % page == 0 and stop - start <= 100 * page for start, stop in runs) and len(runs) <= max(128, total // page // 100 + 1)


def test_registry(spark, tmp_path):
    r = files.Registry(spark, f"file://{tmp_path}/r")
    key = r.create("m_1", "USD")
    assert r.verify(key) == ("m_1", "USD") and r.verify("x") is None
    again = r.rotate("m_1")
    assert r.verify(key) is None and r.verify(again) == ("m_1", "USD")
    r.revoke("m_1")
    assert r.verify(again) is None and r.audit().count() == 3
    for bad in (("m/1", "USD"), ("m_1", "USD"), ("m_2", "usd")):
        with pytest.raises(ValueError):
            r.create(*bad)
