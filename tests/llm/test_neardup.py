import numpy as np
import pytest

from tests.llm.conftest import frame
from tidemark.llm import neardup


def plain(rows, width, percent):
    """Components by comparing all sets."""
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * either:
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return [(r[0], len(s), (low.get(find(i)) if s else r[0])) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def same(spark, rows, width, percent):
    got = neardup.deduplicated(frame(spark, rows, extra=True), width, percent).collect()
    key = lambda x: tuple((v is not None, v or 0) for v in x[:3])
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(plain(rows, width, percent), key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_rows(spark, odd):
    same(spark, odd, 3, 85)


@pytest.mark.parametrize("seed", [0, 1])
def test_groups_of_near_copies(spark, seed):
    random = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, key = [], 0
    for group in (120, 5, 3, 2, 2, 1, 1):
        base = list(random.choice(vocabulary, 150))
        for _ in range(group):
            text = list(base)
            for at in random.integers(0, 150, random.integers(0, 8)):
                text[at] = random.choice(vocabulary)
            rows.append((key, " ".join(text)))
            key += 1
    same(spark, rows, 3, 85)


def test_one_document_of_each_group_stays(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(5, " ".join(base)), (3, " ".join(base)), (9, " ".join([*base[:-1], "x"])), (1, None), (2, ""), (None, "a b"), (7, "c d")]
    kept = neardup.documents(frame(spark, rows, extra=True))
    assert kept.columns == frame(spark, [], extra=True).columns
    assert {r["doc_id"] for r in kept.collect()} == {3, 1, 2, None, 7}


def test_nothing(spark):
    assert neardup.deduplicated(frame(spark, [])).collect() == []


def test_chains_have_one_label(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r["node"]: r["label"] for r in neardup.components(edges).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
