"""run() against a plain version of each stage."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd

import corpus_pipeline
from tests.llm.conftest import frame
from tests.llm.test_lines_mixture import plain_lines, plain_runs
from tests.llm.test_neardup import plain as plain_near
from tests.llm.test_packing import ids_of


def grams_of(text):
    """Runs of four bytes, at least two of a word and no white space inside, of the text's words between spaces."""
    clean = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in (text or "").encode())
    words = [b" " + w + b" " for w in clean.split()]
    return [w[i : i + 4] for w in words for i in range(len(w) - 3)]


def plain_languages(rows, wanted, least):
    """The rows that an exact set of each language's n-grams accepts."""
    learned = [r for r in rows if r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 5]
    by = {x: Counter(g for r in learned if r[2] == x for g in grams_of(r[1])) for x in {r[2] for r in learned}}
    rate = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in by.items()}
    best = {g: max(r.get(g, 0) for r in rate.values()) for g in set().union(*rate.values())}
    held = {x: {g for g, v in r.items() if v >= 0.2 * best[g]} for x, r in rate.items()}
    kept = []
    for r in rows:
        found = grams_of(r[1])
        counts = {x: sum(g in h for g in found) for x, h in held.items()}
        top = max(counts, key=counts.get, default=None)
        if found and any(c.isalpha() for c in r[1]) and top in wanted and counts[top] >= max(1, least * len(found)):
            kept.append(r)
    return kept


def plain_pipeline(rows):
    """Pieces (doc_id, start, length, crc32, doc_tokens) of the final documents."""
    rows = plain_languages(rows, corpus_pipeline.LANGUAGES, corpus_pipeline.LEAST_COVERAGE)
    kept = plain_lines(rows)
    rows = [(r[0], kept[r[0], r[1]], r[2], r[3]) for r in rows]
    low = plain_near(rows, 5, 80)
    rows = [r for r, (key, _, component) in zip(rows, low, strict=True) if key == component]
    documents = pd.DataFrame([(r[0], r[1], r[3]) for r in rows], columns=["doc_id", "text", "source"])
    duckdb.register("documents", documents)
    try:
        mixed = plain_runs(documents)
    finally:
        duckdb.unregister("documents")
    out = Counter()
    for key, texts in mixed.items():
        for text, times in texts.items():
            ids = ids_of([text])[0]
            for a in range(0, len(ids), 2048):
                out[key, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()), len(ids)] += times
    return out


def test_run(spark, tmp_path):
    random = np.random.default_rng(4)
    words = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi") for b in ("ra", "ten", "so", "ul", "x")]
    line = lambda: " ".join(random.choice(words, random.integers(3, 12)))
    passage = "\n".join(line() for _ in range(4))
    rows = []
    for i in range(80):
        text = "\n".join(line() for _ in range(random.integers(1, 30)))
        if i % 9 == 0:
            text += "\n" + passage
        if i % 7 == 0 and i:
            text = rows[i - 1][1]
        if i % 11 == 0 and i:
            text = rows[i - 1][1].replace("ba", "BA", 1) + " end"
        rows.append((i, text, "en", "abc"[i % 3]))
    other = [f"{a}{b}" for a in ("zu", "xy", "qo") for b in ("wv", "jj", "kx")]
    rows += [(90, None, "en", "a"), (91, " 12 ! ", "en", "b"), (92, "é", "en", None), (93, "word " * 3000, "en", "c")]
    rows += [(100 + i, " ".join(random.choice(other, 40)), "xx", "a") for i in range(20)]  # learned, but not wanted
    rows += [(130, "ghdf pvwm rrnn " * 9, None, "b"), (131, None, None, None), (132, "a", "en", "a")]  # none that is learned
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain_pipeline(rows)
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    assert {90, 91, *range(100, 120), 130, 131, 132}.isdisjoint(r["doc_id"] for r in got)
    assert any(zlib.crc32(str(k).encode()) % 5 == 0 for k in range(100, 120))  # held out


def test_stages_return_the_columns_of_documents(spark, odd):
    docs = frame(spark, odd, extra=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == frame(spark, [], extra=True).columns
    empty = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, "")
        assert empty_out.collect() == []
