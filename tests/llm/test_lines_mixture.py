import hashlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tests.llm.conftest import frame
from tidemark.llm import lines, mixture


def plain_lines(rows):
    """Removes lines under any three-line window that stands earlier."""
    seen, out = {}, {}
    order = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    for key, text in order:
        parts, gone = text.split("\n"), set()
        for i in range(len(parts) - 2):
            w = tuple(parts[i : i + 3])
            if "".join(w).strip():
                if w in seen:
                    gone |= {i, i + 1, i + 2}
                seen.setdefault(w, (key, i))
        out[key, text] = "\n".join(p for i, p in enumerate(parts) if i not in gone)
    return out


def test_lines(spark, odd):
    passage = "p one\np two\np three\np four"
    rows = [*odd, (20, f"x\n{passage}\ny"), (21, f"{passage}\nz\n{passage}"), (22, "\n\n\n\n\n"), (23, "\n\n\n")]
    want = plain_lines(rows)
    got = lines.deduplicated(frame(spark, rows, extra=True))
    assert got.columns == frame(spark, [], extra=True).columns
    for r in got.collect():
        original = next(t for t in rows if t[0] == r["doc_id"] and (t[1] is None) == (r["text"] is None))
        if r["text"] is not None and r["doc_id"] is not None:
            assert r["text"] == want[r["doc_id"], original[1]]
            assert r["n_chars"] == len(r["text"])


def test_lines_digests(spark):
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc"), (3, "a\nb")]
    docs = frame(spark, rows)
    marked = lines.marked(docs).collect()
    assert {r["doc_id"]: (r["__lines"], r["__removed"], r["__kept"]) for r in marked} == {1: (3, 0, "a\nb\nc"), 2: (3, 3, ""), 3: (2, 0, "a\nb")}


def test_lines_nothing(spark):
    assert lines.deduplicated(frame(spark, [])).collect() == []


def test_mix_of_odd_rows(spark, odd):
    rows = mixture.mix(frame(spark, odd, extra=True)).collect()
    size = lambda t: len((t or "").split())
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((t[0], size(t[1])) for t in odd)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert sum({r["source_size"]: 0 for r in rows}) > 0


def test_mix_comes_near_its_targets(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 90)), "en", "abcdefg"[i % 7] if i % 3 else "a") for i in range(3000)]
    got = mixture.mix(frame(spark, rows))
    assert sorted(got.collect()) == sorted(got.collect())
    source = {r[0]: r[3] for r in rows}
    taken, target = defaultdict(int), {}
    for r in got.collect():
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 40 for s in target)
    assert abs(sum(target.values()) - sum(5 + i % 90 for i in range(3000))) < 1e-6 * 3000 * 50


def test_targets_stop_at_three_times(spark):
    rows = [(1, "w " * 10, "en", "a"), *((10 + i, "w " * 100, "en", "b") for i in range(50)), (99, "w " * 4, "en", None)]
    got = {r["source_size"]: r["target"] for r in mixture.mix(frame(spark, rows)).collect()}
    assert got[10] == 30.0 and got[4] == 12.0 and got[5000] == pytest.approx(5014 - 42)


def plain_sainte_lague(weights, seats):
    out = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * out[i] + 1), -i))
        out[best] += 1
    return out


@pytest.mark.parametrize("weights,seats", [([5, 3, 1], 7), ([1, 1, 1, 1], 2), ([100, 1, 1, 1, 1, 1], 9), ([0.5, 0, 7.25], 11), ([3], 0), ([1000, 999, 2, 2, 2, 1], 40)])
def test_highest_quotients(spark, weights, seats):
    rows = spark.createDataFrame([(0, i, float(w), seats) for i, w in enumerate(weights)], "g int, k int, w double, seats long")
    got = {r["k"]: r["quota"] for r in mixture.apportioned(rows, ["g"], "k", "w", "seats").collect()}
    assert [got[i] for i in range(len(weights))] == plain_sainte_lague(weights, seats)


def test_materialised_takes_what_the_mix_says(spark, odd):
    docs = frame(spark, odd, extra=True)
    rows = mixture.materialised(docs)
    assert rows.columns == docs.columns
    words = sum(len(r["text"].split()) for r in rows.collect())
    assert words == sum(r["taken"] for r in mixture.mix(docs).collect())


def plain_runs(docs):
    """Texts that the blocks of the mix give, by doc_id; each document is one shard's only part."""
    out = defaultdict(Counter)
    total = duckdb.sql(f"SELECT doc_id, taken FROM ({mixture.ORACLE})").fetchall()
    rows = {r[0]: r for r in docs.itertuples(index=False)}
    for s, source in enumerate(sorted({r[2] for r in rows.values()}, key=lambda x: (x is None, x or ""))):
        line = [(r[0], w) for r in sorted(rows.values()) if r[2] == source for w in r[1].split()]
        blocks = -(-len(line) // 32)
        drawn = lambda x: int(hashlib.md5(f"mix-1/{x}/{s}/0".encode()).hexdigest()[:8], 16)  # noqa: E731, B023
        step, shift = mixture.STEPS[drawn("step") % len(mixture.STEPS)], drawn("shift")
        edges = [b * len(line) // blocks for b in range(blocks + 1)]
        order = sorted(range(blocks), key=lambda b: (b * step + shift) % blocks)
        # the seats of the source's one shard, from the words that the SQL says are taken
        words = sum(n for key, n in total if rows[key][2] == source)
        wanted = next(n for n in range(3 * blocks + 1) if sum((n // blocks + (i < n % blocks)) * (edges[b + 1] - edges[b]) for i, b in enumerate(order)) == words)
        times = {b: wanted // blocks + (i < wanted % blocks) for i, b in enumerate(order)}
        of = [times[next(b for b in range(blocks) if edges[b] <= i < edges[b + 1])] for i in range(len(line))]
        at = 0
        while at < len(line):
            end = at
            while end < len(line) and line[end][0] == line[at][0]:
                end += 1
            low, text = min(of[at:end]), " ".join(w for _, w in line[at:end])
            assert max(of[at:end]) - low <= 1
            out[line[at][0]][text] += low
            run = []
            for i in range(at, end + 1):
                if i < end and of[i] > low:
                    run.append(line[i][1])
                elif run:
                    out[line[at][0]][" ".join(run)] += 1
                    run = []
            at = end
    return {k: +v for k, v in out.items() if +v}


def test_materialised_emits_the_chosen_blocks(spark):
    import pandas as pd

    rows = [(i, " ".join(f"d{i}w{j}" for j in range(20 + 97 * i % 400)), "en", "abc"[i % 3]) for i in range(60)]
    documents = pd.DataFrame([(r[0], r[1], r[3]) for r in rows], columns=["doc_id", "text", "source"])
    duckdb.register("documents", documents)
    try:
        want = plain_runs(documents)
    finally:
        duckdb.unregister("documents")
    got = defaultdict(Counter)
    for r in mixture.materialised(frame(spark, rows, extra=True)).collect():
        got[r["doc_id"]][r["text"]] += 1
        assert r["n_chars"] == len(r["text"])
    assert got == want
    assert any(not rows[k][1].startswith(t) for k, v in got.items() for t in v)


def test_mix_nothing(spark):
    assert mixture.mix(frame(spark, [])).collect() == []
    assert all(r["taken"] == 0 and r["target"] == 0 for r in mixture.mix(frame(spark, [(1, None), (2, "")])).collect())
