import hashlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import frame
from tidemark.llm import suffixes


def plain(rows):
    """Counts every 400-byte string."""
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(hash(d[i : i + 400]) for d in data for i in range(len(d) - 399))
    out = []
    for r, d in zip(rows, data, strict=True):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 399):
            if seen[hash(d[i : i + 400])] > 1:
                gone[i : i + 400] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((r[0], len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def same(spark, rows, **shape):
    got = suffixes.deduplicated(frame(spark, rows, extra=True), **shape).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)


def test_odd_rows(spark, odd):
    same(spark, [r if r[1] is None or len(r[1]) < 60_000 else (r[0], r[1][:9000]) for r in odd])


#: Many small ranges, cut in one and in two steps; anchors that are hot from the second, third or tenth on.
SHAPES = [{}, {"hot": 1}, {"hot": 2, "per_range": 40}, {"per_range": 30, "splitters": 3}, {"hot": 9, "per_range": 5, "splitters": 1}]


@pytest.mark.parametrize("seed,shape", [(0, SHAPES[0]), (1, SHAPES[0]), *((2 + i, x) for i, x in enumerate(SHAPES[1:]))])
def test_passages(spark, seed, shape):
    random = np.random.default_rng(seed)
    text = lambda n: "".join(random.choice(list("abcde é\n"), n))
    passages = [text(n) for n in (399, 400, 401, 470, 900, 3000)]
    rows = []
    for i in range(40):
        body = text(random.integers(0, 1500))
        for p in random.choice(len(passages), random.integers(0, 3)):
            a, b = sorted(random.integers(0, len(passages[p]) + 1, 2)) if random.random() < 0.4 else (0, len(passages[p]))
            body += passages[p][a:b] + text(random.integers(0, 200))
        rows.append((i, body))
    same(spark, [*rows, (99, "ab" * 700), (100, rows[3][1]), (101, rows[3][1])], **shape)


def test_nothing(spark):
    assert suffixes.deduplicated(frame(spark, [])).collect() == []


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_long_texts(spark, hot):
    """Texts of several windows, with passages that lie across their edges."""
    random = np.random.default_rng(3)
    text = lambda n: bytes(random.integers(97, 110, n).astype(np.uint8)).decode()
    passage, edge = text(5000), suffixes.SECTION
    one = text(edge - 2500) + passage + text(edge - 3000) + passage[:700] + text(900) + passage[100:499]
    two = text(1000) + passage[2300:2900] + text(edge)
    same(spark, [(1, one), (2, two), (3, text(3000)), (4, passage[4000:] + text(50)), (5, "q" * (edge + 1000))], hot=hot)


@pytest.mark.parametrize("size", [401, 1000, 5000, 1 << 20])
def test_sections_hold_every_string_once_and_choose_alike(size):
    random = np.random.default_rng(size)
    texts = [bytes(random.integers(97, 101, n).astype(np.uint8)) for n in (0, 399, 400, 2000, 7000, 10, 401)]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    whole = dict(zip(*(x.tolist() for x in suffixes.anchored(data, at)[:2]), strict=True))
    got = {}
    for _, base, own, ends in suffixes.sections(data, at, size):
        for start, anchor in zip(*(x.tolist() for x in suffixes.anchored(own, ends)[:2]), strict=True):
            assert start + base not in got
            got[start + base] = anchor + base
    assert got == whole


def test_equal_strings_against_all_pairs():
    random = np.random.default_rng(11)
    length, key = suffixes.LENGTH, suffixes.KEY
    anchors = [bytes(random.integers(97, 99, key).astype(np.uint8)) for _ in range(2)]
    sides = [bytes(random.integers(97, 99, 400).astype(np.uint8)) for _ in range(3)]
    entries = []
    for _ in range(60):
        k, lo = sorted(random.integers(0, length - key + 1, 2))[::-1]
        left, right = sides[random.integers(3)][400 - k :], sides[random.integers(3)]
        left = left if random.random() < 0.5 else bytes([120]) * int(k // 2) + left[k // 2 :]
        body = left + (anchors[random.integers(2)] + right)[: length - lo]
        entries.append((body, int(k), int(lo), int(random.integers(1, 3))))
    entries.sort(key=lambda e: e[0][e[1] :])
    rights = [b[k:] for b, k, _, _ in entries]
    prefix = np.array([0, *(suffixes.common(a, b, 0) for a, b in zip(rights, rights[1:], strict=False))])
    low, high, times = (np.array([e[i] for e in entries]) for i in (2, 1, 3))
    got = suffixes.equal_strings(prefix, [b[:k][::-1] for b, k, _, _ in entries], low, high, times)
    own = lambda e, o: e[0][e[1] - o :][:length]
    for i, e in enumerate(entries):
        for o in range(length - key + 1):
            inside = e[2] <= o <= e[1]
            n = sum(x[3] for x in entries if x[2] <= o <= x[1] and own(x, o) == own(e, o)) if inside else 0
            assert got[i, o] == (n > 1)


def test_loser_tree_merges_and_knows_prefixes():
    random = np.random.default_rng(5)
    runs, every = [], []
    for r in range(7):
        keys = sorted({bytes(random.choice([65, 66], suffixes.KEY).astype(np.uint8)) if random.random() < 0.5 else b"A" * 60 + bytes(random.choice([65, 66], 4).astype(np.uint8)) for _ in range(random.integers(1, 40))})
        chunks = []
        for c in range(-(-len(keys) // 5)):
            prefix, rest = suffixes.front_coded(np.array([list(k) for k in keys[c * 5 : c * 5 + 5]], np.uint8))
            chunks.append((c, prefix, [suffixes.KEY] * len(prefix), rest))
        runs.append(suffixes.Run(chunks, None, None))
        every += [(k, r) for k in keys]
    last, want = None, sorted(every)
    for (shared, run, _, _), (key, r) in zip(suffixes.merged(runs), want, strict=True):
        assert run == r and shared == (suffixes.common(last, key, 0) if last else 0)
        last = key


def test_of_passages_of_over_fifty_words_those_of_400_bytes_go(spark):
    """The contract's strings have 400 bytes, however many words: a shorter passage stays, and so do texts without one."""
    random = np.random.default_rng(11)
    text = lambda n, size: " ".join(bytes(random.integers(97, 123, size).astype(np.uint8)).decode() for _ in range(n))
    rows, want = [], {}
    for size, n in ((5, 55), (6, 56), (6, 58), (8, 60)):
        passage = text(n, size)
        for _ in range(2):
            rows.append((len(rows), f"{text(40, 6)}A {passage} B{text(40, 6)}"))
        for k in (0, 1):  # the blanks beside it are shared, the letters A and B too
            want[len(rows) - 2 + k] = len(passage) + 4 if len(passage) + 4 >= 400 else 0
    for _ in range(4):
        rows.append((len(rows), text(120, 6)))
        want[len(rows) - 1] = 0
    got = {r["doc_id"]: r["n_removed"] for r in suffixes.deduplicated(frame(spark, rows)).collect()}
    assert all(got[k] == n if n == 0 else n <= got[k] <= n + 4 for k, n in want.items()), (got, want)
    assert sorted(want.values())[-1] > 400 and [want[k] > 0 for k in (0, 2, 4, 6)] == [False, False, True, True]
