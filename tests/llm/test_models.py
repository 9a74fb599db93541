import hashlib
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tests.llm.conftest import frame
from tidemark.llm import langid, neighbours, scoring, shared, syncmers, tokens

WORDS = {"en": "the of and that with house water under stone river".split(), "fr": "le la des une maison rivière sous pierre avec château".split(), "de": "der die das und haus wasser unter stein fluß mit".split()}


def corpus(n=240):
    random = np.random.default_rng(3)
    out = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        out.append((i, " ".join(random.choice(WORDS[lang], random.integers(3, 40))), lang))
    return out


def held(key, n, r):
    return key is not None and zlib.crc32(str(key).encode()) % n == r


def test_languages_of_held_out_texts(spark, odd):
    rows = corpus() + [(1000 + (r[0] or 0), *r[1:]) if r[0] is not None else r for r in odd]
    got = langid.predicted(frame(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in corpus()}
    mine = [r for r in got if r["doc_id"] in truth]
    assert all(r["lang_pred"] == truth[r["doc_id"]] and 0 <= r["score"] <= 1 and r["held_out"] == held(r["doc_id"], 5, 0) for r in mine)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [by[1000 + k] for k in (1, 2, 3, 9)] == ["und"] * 4 and by[1010] != "und"


def test_long_texts_are_read_in_parts(monkeypatch):
    """n-grams, words and ids of long texts, in parts, are those of the whole."""
    random = np.random.default_rng(1)
    text = " ".join(random.choice(["the", "Wörd", "a", "x1y", "日本語", "it's", "END.", "--"], 4000)) + "y" * 700
    data, at = shared.text_bytes(pa.array(["short one", text, "", "other"]))
    whole, ends = langid.grams(data, at)
    hashes, first = shared.words(data, at[1:3])
    ids, _ = tokens.Encoder(tokens.vocabulary(), 1).encode(data, at[1:3])
    monkeypatch.setattr(shared, "SLICE_BYTES", 256)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 256)
    got = [(int(r), x) for rows, offsets in langid.parts(data, at, 256) for r, x in zip(rows, zip(offsets, offsets[1:], strict=False), strict=True)]
    assert [r for r, _ in got] == sorted(r for r, _ in got) and len(got) > 20
    for row in range(4):
        found = [g for r, x in got if r == row for g in langid.grams(data, np.array(x))[0].tolist()]
        assert found == whole[ends[row] : ends[row + 1]].tolist()
    again, edges = shared.words(data, at[1:3])
    assert again.tolist() == hashes.tolist() and edges.tolist() == first.tolist()
    assert tokens.Encoder(tokens.vocabulary(), 1).encode(data, at[1:3])[0].tolist() == ids.tolist()


def test_languages_without_training(spark):
    assert [r["lang_pred"] for r in langid.predicted(frame(spark, [(1, "text", None)])).collect()] == ["und"]
    assert langid.predicted(frame(spark, [])).collect() == []


def test_rejected_documents_go(spark, odd):
    docs = frame(spark, corpus(60) + [(1000, None), (1001, " 12 !"), (1002, "the house")], extra=True)
    kept = langid.identified(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {*range(60), 1002}
    assert {r["doc_id"] for r in langid.identified(docs, ("en", "de")).collect()} == {*(i for i in range(60) if i % 3 != 1), 1002}
    strange = frame(spark, [*corpus(60), (1000, "xkcd qwrt zzyx", None), (1001, "the house xkcd qwrt zzyx bbnm", None)])
    assert {1000, 1001}.isdisjoint(r["doc_id"] for r in langid.identified(strange, least=0.6).collect())
    assert 1001 in {r["doc_id"] for r in langid.identified(strange, least=0.2).collect()}


def test_predictions_equal_exact_sets(spark, odd):
    from tests.llm.test_pipeline import grams_of

    rows = corpus() + [(1000 + (r[0] or 0), *r[1:]) if r[0] is not None else r for r in odd]
    learned = [r for r in rows if r[1] is not None and (r[2] if len(r) > 2 else "en") and not held(r[0], 5, 0)]
    lang = lambda r: r[2] if len(r) > 2 else "en"
    order = [x for x, _ in sorted(Counter(map(lang, learned)).items(), key=lambda t: (-t[1], t[0]))]
    by = {x: Counter(g for r in learned if lang(r) == x for g in grams_of(r[1])) for x in order}
    rate = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in by.items()}
    best = {g: max(r.get(g, 0) for r in rate.values()) for g in set().union(*rate.values())}
    sets = {x: {g for g, v in r.items() if v >= 0.2 * best[g]} for x, r in rate.items()}
    got = [(r["doc_id"] or -1, r["lang_pred"], r["score"], r["coverage"]) for r in langid.predicted(frame(spark, rows)).collect()]
    want = []
    for r in rows:
        found = grams_of(r[1])
        counts = {x: sum(g in s for g in found) for x, s in sets.items()}
        top, total = max(counts, key=counts.get), sum(counts.values())
        if not any(c.isalpha() for c in r[1] or ""):
            want.append((r[0] or -1, "und", 0.0, 0.0))
        else:
            want.append((r[0] or -1, top if total else order[0], counts[top] / total if total else 0, counts[top] / max(1, len(found))))
    assert len(got) == len(want)
    for mine, plain in zip(sorted(got), sorted(want), strict=True):
        assert mine[:2] == plain[:2] and mine[2:] == pytest.approx(plain[2:], abs=2e-3)


def test_filter_returns_all_languages_of_a_gram():
    masks = np.zeros((1 << 12, 2), np.uint64)
    gram = np.array([123456], np.uint64)
    for at in langid.places(gram, 1 << 12, 3):
        masks[at, 0] |= np.uint64(1 << 5)
        masks[at, 1] |= np.uint64(1 << 2)
    f = langid.Filter([f"l{i}" for i in range(70)], masks, 3, "l0")
    assert f.lookup(gram).tolist() == [[1 << 5, 1 << 2]]


def test_scores(spark, odd):
    rows = corpus() + [(1000 + (r[0] or 0), *r[1:]) if r[0] is not None else r for r in odd]
    got = scoring.scored(frame(spark, rows, extra=True)).collect()
    tokens = [(r[0], [w for w in (r[1] or "").encode().lower().split()] + [b""]) for r in rows]
    c = Counter(w for k, t in tokens if not held(k, 7, 2) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((k or -1, held(k, 7, 2), len(t), sum(w in c for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 5)) for k, t in tokens)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    mine = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1000 and r["held_out"]]
    assert sum(r["score"] for r in mine) > sum(r["base_score"] for r in mine)
    assert all(r["score"] < 0 for r in got)


def test_scores_of_nothing(spark):
    assert scoring.scored(frame(spark, [])).collect() == []


def pieces_of(*texts, limit=scoring.CHUNK):
    return [p for chunk in scoring.pieces(*shared.text_bytes(pa.array(texts)), limit) for p in chunk]


class PlainMixer:
    """The mixer one bit at a time, with contexts as texts and counts in a dictionary."""

    def __init__(self, training):
        self.counts = Counter()
        for _, steps in map(self.steps, training):
            self.counts.update(steps)
        self.weights = [[0.3] * 5 + [0.0] for _ in range(48)]
        self.map = [[-12 + 0.75 * j for j in range(33)] for _ in range(256)]
        self.gates, self.used = Counter(), Counter()

    @staticmethod
    def steps(text):
        """(bytes with their past, every (context, bits of the byte so far, bit) in them)."""
        body = b"\0" * 5 + b" ".join(text.encode().lower().split()) + b"\xff"
        out = []
        for i in range(5, len(body)):
            told = f"{body[i]:08b}"
            out += [(body[i - k : i], told[:p], told[p]) for k in range(1, 6) for p in range(8)]
        return body, out

    def inputs(self, past, told, left=None):
        x, seen = [], 0
        for k in range(1, 6):
            n = [self.counts[past[len(past) - k :], told, b] - (b == left) for b in "01"]
            x.append(math.log((max(0, n[1]) + 0.4) / (max(0, n[0]) + 0.4)))
            seen += x[-1] != 0
        return x, 6 * len(told) + seen

    @staticmethod
    def squash(v):
        return 1 / (1 + math.exp(-max(-30, min(30, v))))

    def final(self, logit, told):
        at = (max(-12, min(12 - 1e-6, logit)) + 12) / 0.75
        low = int(at)
        row = self.map[int("1" + told, 2)]
        refined = row[low] * (1 - at + low) + row[low + 1] * (at - low)
        return max(1e-5, min(1 - 1e-5, (self.squash(logit) + self.squash(refined)) / 2))

    def read(self, texts):
        bodies = sorted((self.steps(t)[0] for t in texts), key=len, reverse=True)
        for i in range(5, max(map(len, bodies))):
            live = [b for b in bodies if len(b) > i]
            for place in range(8):
                change, mass, grown, cells = {}, Counter(), Counter(), Counter()
                for b in live:
                    told, bit = f"{b[i]:08b}"[:place], f"{b[i]:08b}"[place]
                    x, gate = self.inputs(b[i - 5 : i], told, bit)
                    x = [*x, 0.3]
                    logit = sum(v * w for v, w in zip(x, self.weights[gate], strict=True))
                    row = change.setdefault(gate, [0.0] * 6)
                    for j in range(6):
                        row[j] += (int(bit) - self.squash(logit)) * x[j]
                    mass[gate] += 1
                    at = (max(-12, min(12 - 1e-6, logit)) + 12) / 0.75
                    cell = int("1" + told, 2), int(at) + (at - int(at) > 0.5)
                    grown[cell] += int(bit) - self.squash(self.map[cell[0]][cell[1]])
                    cells[cell] += 1
                for gate, row in change.items():
                    self.gates[gate] += 1
                    rate = scoring.RATE / math.sqrt(1 + self.gates[gate] / 8) / max(mass[gate], scoring.CROWD)
                    for j in range(6):
                        self.weights[gate][j] += rate * row[j]
                for cell, n in cells.items():
                    self.used[cell] += n
                    self.map[cell[0]][cell[1]] += 2 * grown[cell] / n / math.sqrt(1 + self.used[cell] / n)

    def log10(self, text):
        body, total = self.steps(text)[0], 0.0
        for i in range(5, len(body)):
            told = f"{body[i]:08b}"
            for place in range(8):
                x, gate = self.inputs(body[i - 5 : i], told[:place])
                x = [v and math.copysign(max(1, min(127, round(abs(v) * scoring.STEPS))), v) / scoring.STEPS for v in x]
                logit = sum(v * w for v, w in zip([*x, 0.3], self.weights[gate], strict=True))
                p = self.final(logit, told[:place])
                total += math.log10(p if told[place] == "1" else 1 - p)
        return total


def test_scores_are_those_of_one_mixer_over_all(spark):
    """The tables of the whole corpus, its texts read side by side, each text on its own."""
    rows = [(i, t) for i, t, _ in corpus(40)] + [(50, None), (51, ""), (52, "wörd  é\n日本"), (53, "a"), (54, "Zz zz zz qq")]
    each = [scoring.grams([p])[0] for p in pieces_of(*(t or "" for k, t in rows if not held(k, 7, 2)))]
    tables, mixer = scoring.Tables(), scoring.Mixer()
    found, times = np.unique(np.concatenate(each), return_counts=True)
    for i in range(5):
        tables.fill(i, found, times)
    mixer.read(tables, each)
    scorer = scoring.Scorer(tables.logits(), mixer)
    got = {r["doc_id"]: r for r in scoring.scored(frame(spark, rows)).collect()}
    for k, t in rows:
        body = b" ".join((t or "").encode().lower().split()) + b"\xff"
        want = scorer.log10(scoring.grams(pieces_of(t or ""))[0]).sum()
        assert got[k]["score"] == pytest.approx(want, rel=1e-6) and got[k]["n_bytes"] == len(body)
        assert got[k]["bits_per_byte"] == pytest.approx(-got[k]["score"] * math.log2(10) / len(body))


@pytest.mark.parametrize("groups", [1, 3])
def test_every_training_text_is_learned_from(spark, monkeypatch, groups):
    """More and longer texts than are read side by side at first, and copies, in one group and in some."""
    random = np.random.default_rng(5)
    texts = [" ".join(random.choice(WORDS["fr"], 3)) for _ in range(1300)] + ["the of and"] * 30 + [" ".join(random.choice(WORDS["en"], 800))]
    each = [scoring.grams([p])[0] for p in pieces_of(*texts)]
    tables = scoring.Tables()
    found, times = np.unique(np.concatenate(each), return_counts=True)
    for i in range(5):
        tables.fill(i, found, times)
    n_bytes = sum(map(len, each))
    monkeypatch.setattr(scoring, "GROUP", -(-n_bytes // groups))
    got = scoring.trained(spark, spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), n_bytes, tables)
    mixers = [scoring.Mixer() for _ in range(groups)]
    for g, mixer in enumerate(mixers):
        mixer.read(tables, [x for t, x in zip(texts, each, strict=True) if zlib.crc32(bytes(5) + t.encode() + b"\xff") % groups == g])
    assert sum(m.used.sum() for m in mixers) == sum(m.mass.sum() for m in mixers) == 8 * n_bytes
    for name, mass in (("weights", lambda m: np.repeat(m.mass[:, None], 6, 1)), ("refined", lambda m: m.used)):
        total = sum(map(mass, mixers))
        want = np.where(total > 0, sum(mass(m) * getattr(m, name) for m in mixers) / np.maximum(1, total), getattr(scoring.Mixer(), name))
        assert np.allclose(getattr(got, name), want, rtol=1e-9)


def test_what_a_worker_keeps_for_other_operators():
    """The encoder stays from task to task, and goes when another operator's task begins; n-grams take 24 bytes a byte at most."""
    own = tokens.encoder(tokens.vocabulary(), 1)
    assert tokens.encoder(tokens.vocabulary(), 1) is own and tokens.encoder(tokens.vocabulary(), None) is not own
    rows = pa.array(["the fox and a dog, das Haus; " * 4000] * 20)
    data, at = shared.text_bytes(rows)
    tracemalloc.start()
    found, ends = langid.grams(data, at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * len(data) and ends[-1] == len(found)
    shared.lean()
    assert not shared.kept


def test_what_a_worker_holds_while_it_learns(monkeypatch):
    """Beside the parts of a group, their lanes and one byte a byte to mark them; while it learns, not the parts."""
    monkeypatch.setattr(scoring, "STEP", 16)
    monkeypatch.setattr(scoring, "ALONE", 8)
    texts = [f"{i} {'the fox and a dog ' * 1800}" for i in range(300)]
    each = [scoring.grams([p])[0] for p in pieces_of(*texts)]
    n_bytes = sum(map(len, each))
    tracemalloc.start()
    scoring.Mixer().read(scoring.Tables(1 << 10), each)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n_bytes > 1 << 23 and peak < 2.6 * n_bytes


def test_known_grams_are_not_looked_up_again(monkeypatch):
    """Equal grams are looked up once for many steps, and once for many chunks, with the results of each alone."""
    monkeypatch.setattr(scoring, "ALONE", 8)
    texts = ["the fox and a dog " * n for n in range(2, 60)]
    each, tables = [scoring.grams([p])[0] for p in pieces_of(*texts)], scoring.Tables()
    found, times = np.unique(np.concatenate(each), return_counts=True)
    for i in range(5):
        tables.fill(i, found, times)
    sizes, spread = [], scoring.spread
    monkeypatch.setattr(scoring, "spread", lambda h, *rest: sizes.append(h.size) or spread(h, *rest))
    mixer = scoring.Mixer()
    mixer.read(tables, each)
    assert 0 < sum(sizes) < 3 * 40 * len(found)  # of more than 40 steps
    with monkeypatch.context() as m:
        m.setattr(scoring, "AHEAD", 1)
        alone = scoring.Mixer()
        alone.read(tables, each)
    assert np.allclose(mixer.weights, alone.weights, rtol=1e-6) and np.allclose(mixer.refined, alone.refined, rtol=1e-5)
    sizes.clear()
    scorer, chunk = scoring.Scorer(tables.logits(), mixer), pieces_of(*texts)
    first = scorer.scores(chunk)
    once = sum(sizes)
    assert scorer.scores(chunk).tolist() == first.tolist() and 0 < once == sum(sizes)
    monkeypatch.setattr(scoring, "KNOWN", 4)
    assert scoring.Scorer(tables.logits(), mixer).scores(chunk) == pytest.approx(first, rel=1e-6)


def test_mixer_bit_by_bit():
    texts = ["the fox the fox", "a dog", "", "the dog é"]
    plain, tables = PlainMixer(texts), scoring.Tables()
    plain.read(texts)
    each = [scoring.grams([p])[0] for p in pieces_of(*texts)]
    found, times = np.unique(np.concatenate(each), return_counts=True)
    for i in range(5):
        tables.fill(i, found, times)
    assert tables.counts.sum() == sum(plain.counts.values())  # every context has a slot of its own
    mixer = scoring.Mixer()
    mixer.read(tables, each)
    scorer = scoring.Scorer(tables.logits(), mixer)
    for t in [*texts, "the cat", "foxes of the é"]:
        chunk = pieces_of(t)
        assert scorer.scores(chunk)[0] == pytest.approx(plain.log10(t), rel=1e-5)
        assert scorer.scores(chunk)[0] == pytest.approx(scorer.log10(scoring.grams(chunk)[0]).sum(), rel=1e-9)


def test_bytes_are_a_distribution():
    random = np.random.default_rng(0)
    slots = 1 << 16
    logits = random.integers(0, 1 << 16, (len(scoring.PREDICTORS), slots)).astype(np.uint16)
    weights = random.normal(0.2, 0.1, scoring.Mixer().weights.shape)
    scorer = scoring.Scorer(logits, scoring.Mixer(weights))
    for g in scoring.grams(pieces_of("the end"))[0]:
        every = (g & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        assert (10 ** scorer.log10(every)).sum() == pytest.approx(1, abs=1e-5)  # of 32-bit numbers


def test_context_crosses_words_but_not_texts():
    found, of = scoring.grams(pieces_of("ab c", "ab c", "c"))
    unpacked = [tuple(int(g) >> 8 * i & 255 for i in range(5, -1, -1)) for g in found]
    assert unpacked[:5] == unpacked[5:10] and unpacked[10] == (0, 0, 0, 0, 0, ord("c")) and of.tolist() == [0] * 5 + [1] * 5 + [2] * 2
    assert unpacked[3] == (0, 0, *b"ab c")


@pytest.mark.parametrize("limit", [1, 7, 64, 300])
def test_long_texts_in_pieces_are_read_as_one(limit):
    texts = ["", "x" * 500 + "  y", *(t for _, t, _ in corpus(20)), " \n ", "  lead and trail \n" + " " * 70, "é " * 90]
    whole, cut = pieces_of(*texts), pieces_of(*texts, limit=limit)
    assert len(whole) == len(texts) and (len(cut) > len(whole)) == (limit < 300 or len(cut) > len(whole))
    for row in range(len(texts)):
        a, b = ([p for p in x if p.row == row] for x in (whole, cut))
        assert b"".join(p.body for p in a) == b"".join(p.body for p in b) and sum((p.words for p in b), []) == a[0].words
        assert np.concatenate([scoring.grams([p])[0] for p in b]).tolist() == scoring.grams(a)[0].tolist()
        assert sum(p.begins for p in b) == sum(p.ends for p in b) == 1


def test_of_two_contexts_in_a_slot_the_heavier_stays():
    tables = scoring.Tables(1 << 8)
    found = np.unique(scoring.grams(pieces_of("the quick brown fox jumps over the lazy dog again and again"))[0])
    times = np.arange(1, len(found) + 1)
    tables.fill(4, found, times)
    seen = Counter()
    for _, node, bit in scoring.bits(found):
        at, check = scoring.slot(scoring.contexts(found)[4], node, 1 << 8)
        for a, c, n in zip(at.tolist(), check.tolist(), times.tolist(), strict=True):
            seen[a, c] += n
    for a in range(1 << 8):
        here = [n for (at, _), n in seen.items() if at == a]
        assert tables.counts[4, a].sum() == max(here, default=0)


def vectors(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label int{extra}")


def test_neighbours(spark):
    random = np.random.default_rng(2)
    data = random.normal(size=(700, 16)).astype(np.float32)
    data[200:460] = data[200]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(data)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [1.0], 1), (None, data[0].tolist(), 1)]
    got = {}
    for r in neighbours.search(vectors(spark, rows)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = data.astype(np.float64)
    hits = 0
    for q in range(0, 700, 50):
        cos = (x * x[q]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[q] * x[q]).sum()))
        want = [i for i in np.lexsort((np.arange(700), -cos)) if i != q][:5]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(s == cos[v] for _, v, s in found)
        assert found == sorted(found, key=lambda t: (-t[2], t[1]))
        hits += len({v for _, v, _ in found} & set(want))
    assert len(got) == 14 and hits / 70 >= 0.9


def test_neighbours_beside_a_hot_vector(spark):
    random = np.random.default_rng(5)
    data = random.normal(size=(3000, 48)).astype(np.float32)
    data[1::3] = data[1]
    x = data.astype(np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    found = {}
    for r in neighbours.search(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(data)]), every=25, sample=1500, candidates=900).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = [q for q in range(0, 3000, 25) if q % 3 != 1]
    cos = x[asked] @ x.T
    cos[np.arange(len(asked)), asked] = -2
    hits = [len(found[q] & set(np.lexsort((np.arange(3000), -np.round(c, 9)))[:5].tolist())) for q, c in zip(asked, cos, strict=True)]
    assert sum(hits) / (5 * len(asked)) >= 0.9


def test_copies_count_once_in_the_budget():
    random = np.random.default_rng(6)
    sample = random.normal(size=(900, 16))
    sample[::3] = sample[0]
    sample /= np.sqrt((sample * sample).sum(1, keepdims=True))
    forest = neighbours.Forest.fit(sample, trees=4, leaf=16)
    for i in range(0, 900, 50):
        leaves = set(forest.search(sample[i], 400))
        routed = forest.route(sample)
        inside = np.array([not leaves.isdisjoint(r) for r in routed.tolist()])
        # a vector on a plane may be routed to the other side of it
        assert len(np.unique(sample[inside], axis=0)) >= 390


@pytest.mark.parametrize("n,share,sample", [(20_000, 0.42, 16384), (20_000, 0.42, 4096)])
def test_a_search_prunes(spark, n, share, sample):
    """Isotropic vectors: recall, and the share of rows in the leaves that queries visit."""
    random = np.random.default_rng(8)
    x = random.normal(size=(n, 64))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    asked = range(0, n, 500)
    forest = neighbours.Forest.fit(x[:sample], extra=int(np.ceil(np.log2(n / sample))))
    codes, seen, hits = forest.route(x), 0, 0
    for q in asked:
        visited = np.array(forest.search(x[q], neighbours.budget(n) * sample / n))
        inside = np.isin(codes, visited).any(1)
        seen += inside.sum()
        cos = x @ x[q]
        cos[q] = -2
        hits += inside[np.argsort(-cos)[:5]].sum()
    assert seen / (n * len(asked)) < share and hits / (5 * len(asked)) >= 0.9
    assert np.bincount(codes[:, 0]).max() <= 8 * neighbours.LEAF


def test_neighbours_equal_the_best_of_what_is_visited(spark):
    """Dropping pairs by the codes' bounds loses none of the k nearest of the visited rows."""
    random = np.random.default_rng(9)
    data = random.normal(size=(1500, 24)).astype(np.float32)
    data[300:900:2] = data[300]
    data[7] = 2 * data[4]
    x = data.astype(np.float64)
    # a budget above all rows: everything is visited
    rows = [(i, v.tolist(), 0) for i, v in enumerate(data)] + [(40, data[3].tolist(), 0), (50, data[9].tolist(), 0), (8, data[8].tolist(), 0)]
    got = {}
    for r in neighbours.search(vectors(spark, rows), every=10, candidates=10**6).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    norm = np.sqrt((x * x).sum(1))
    for q in (q for q in range(0, 1500, 10) if q not in (40, 50)):
        cos = (x * x[q]).sum(1) / (norm * norm[q])
        for extra, like in ((40, 3), (50, 9)):
            cos[extra] = max(cos[extra], (x[like] * x[q]).sum() / (norm[like] * norm[q]))
        cos[q] = -2
        order = np.lexsort((np.arange(1500), -cos))[:5]
        assert sorted(got[q]) == [(i + 1, v, cos[v]) for i, v in enumerate(order)]


@pytest.mark.parametrize("extra", [0, 2])
def test_sampled_vectors_lie_where_they_are_routed(extra):
    """Also those on a plane: medians of odd numbers are vectors' own."""
    random = np.random.default_rng(12)
    sample = random.normal(size=(1999, 24))
    sample /= np.sqrt((sample * sample).sum(1, keepdims=True))
    forest = neighbours.Forest.fit(sample, trees=9, leaf=5, extra=extra)
    inside = {c: set(m.tolist()) for c, m in forest.inside.items()}
    codes = np.concatenate([forest.route(sample[a : a + 7]) for a in range(0, 1999, 7)])
    assert all(i in inside[c] for i, row in enumerate(codes.tolist()) for c in row) and sum(map(len, inside.values())) == 9 * 1999
    for v in sample[:40]:
        seen = forest.seen(forest.search(v, 60))
        assert len(seen) >= 60 and np.isin(codes[seen], forest.search(v, 60)).any(1).all()


def test_every_query_has_k(spark):
    random = np.random.default_rng(13)
    data = random.normal(size=(3001, 12)).astype(np.float32)
    got = neighbours.search(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(data)]), every=10, leaf=5, candidates=60).groupBy("query_id").count().collect()
    assert len(got) == 301 and {r["count"] for r in got} == {5}


def test_neighbours_ignore_other_columns(spark):
    more = "code int, q int, tiny string, step int, nth int, block int, of int, place int, score string, rank int, asked int, low int, high int"
    names = [x.split()[0] for x in more.split(", ")]
    rows = [(i, [float(i % 7), 1.0, float(i % 3)], 0, *((0 if "int" in c else "x") for c in more.split(", "))) for i in range(120)]
    plain = neighbours.search(vectors(spark, [r[:3] for r in rows])).collect()
    got = neighbours.search(vectors(spark, rows, ", " + more)).collect()
    assert names and sorted(got) == sorted(plain) and len(got) == 15


def test_few_and_no_neighbours(spark):
    assert [(r["query_id"], r["vec_id"]) for r in neighbours.search(vectors(spark, [(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0)])).collect()] == [(0, 1)]
    assert neighbours.search(vectors(spark, [(0, [1.0], 0)])).collect() == []
    assert neighbours.search(vectors(spark, [])).collect() == []


def _xx(*values):
    """Spark's xxhash64 of texts and longs, one seed after the other."""
    seed = 42
    for v in values:
        data = v if isinstance(v, bytes) else int(v).to_bytes(v_bytes(v), "little", signed=True)
        seed = xxhash.xxh64(data, seed=seed % (1 << 64)).intdigest()
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def v_bytes(v):
    return 4 if isinstance(v, np.int32) else 8


def plain_anchors(text):
    h = [_xx(w) for w in (text or "").encode().split()]
    if len(h) < 4:
        seed = 42
        for x in h:
            seed = _xx(np.int64(seed), np.int64(x))
        return [(0, seed)] if h else []
    pair = [_xx(np.int64(a), np.int64(b)) for a, b in zip(h, h[1:], strict=False)]
    return [(i, _xx(np.int64(pair[i]), np.int64(pair[i + 2]))) for i in range(len(h) - 3) if min(pair[i], pair[i + 2]) <= pair[i + 1]]


def plain_links(found):
    if len(found) == 1:
        return {found[0][1]}
    return {_xx(np.int64(a[1]), np.int64(b[1]), np.int32(b[0] - a[0])) for a, b in zip(found, found[1:], strict=False)}


def plain_fingerprints(rows):
    """Every column from whole texts, in order of doc_id (null: the least) and the text's hash."""
    rows = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], _xx((r[1] or "").encode())))
    texts, out = [r[1] or "" for r in rows], []
    near = lambda a, b: 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))
    text_of = lambda f: " ".join(f"{p:x}:{h % (1 << 64):x}" for p, h in f)
    for i, r in enumerate(rows):
        a, b = texts[i], texts[(i + 1) % len(rows)]
        moved = len(a) // 4
        edited = a[: len(a) - moved] + b[:moved]
        f, e, n = plain_anchors(a), plain_anchors(edited), plain_anchors(b)
        out.append((r[0], len(a), hashlib.sha256(edited.encode()).hexdigest(), text_of(f), text_of(e), near(plain_links(f), plain_links(e)), near(plain_links(f), plain_links(n))))
    return out


def same_fingerprints(spark, rows):
    got = syncmers.compared(frame(spark, rows, extra=True)).collect()
    key = lambda x: (x[0] is not None, *x[1:])
    assert sorted(((r[0] or 0, *map(str, r[1:5]), round(r[5], 9), round(r[6], 9)) for r in got)) == sorted(((r[0] or 0, *map(str, r[1:5]), round(r[5], 9), round(r[6], 9)) for r in plain_fingerprints(rows)))
    return {r["doc_id"]: r for r in got}


def test_fingerprints(spark, odd):
    rows = [*odd, *((30 + i, t) for i, (_, t, _) in enumerate(corpus(40)))]
    got = same_fingerprints(spark, rows)
    assert got[4]["near_edited"] > 0.4


def test_fingerprints_of_hot_and_clustered_ids(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "BUCKET_ROWS", 8)
    random = np.random.default_rng(7)
    texts = [" ".join(f"w{j}" for j in random.integers(0, 50, random.integers(0, 30))) for _ in range(300)]
    ids = [None if i % 5 == 0 else 7 if i % 3 == 0 else 10**15 if i == 1 else 1000 + i for i in range(300)]
    same_fingerprints(spark, [(k, f"{t} n{i}") for i, (k, t) in enumerate(zip(ids, texts, strict=True))])
    buckets = syncmers.bucketed(spark.createDataFrame([(k if k is not None else syncmers.LEAST, hash(i * 10**9 + 1) * 2654435761 % (1 << 64) - (1 << 63)) for i, k in enumerate(ids)], "key long, h long"))
    sizes = [r["count"] for r in buckets.groupBy(*syncmers.BUCKET).count().collect()]
    assert max(sizes) <= 40 and sum(sizes) == 300


def test_syncmers_by_hand(spark):
    words = [f"w{i}" for i in range(60)]
    text = " ".join(words)
    df = spark.createDataFrame([(text, "x " + " ".join(words[10:40]))], "a string, b string")
    hash_ = {w: h for w, h in zip(words, df.selectExpr(*(f"xxhash64('{w}') as h{i}" for i, w in enumerate(words))).first(), strict=True)}
    pairs = spark.createDataFrame([(i, hash_[words[i]], hash_[words[i + 1]]) for i in range(59)], "i int, x long, y long").selectExpr("i", "xxhash64(x, y) as p").collect()
    p = {r["i"]: r["p"] for r in pairs}
    want = [i for i in range(57) if min(p[i], p[i + 2]) <= p[i + 1]]
    r = df.select(syncmers.anchors(df["a"]).alias("a"), syncmers.anchors(df["b"]).alias("b")).first()
    assert [x["position"] for x in r["a"]] == want
    assert [(x["position"] + 9, x["hash"]) for x in r["b"] if x["position"] >= 1] == [(x["position"], x["hash"]) for x in r["a"] if 10 <= x["position"] <= 36]


def test_one_document_is_its_own_next(spark):
    r = syncmers.compared(frame(spark, [(1, "a b c d e f g h i j")])).collect()
    assert len(r) == 1 and r[0]["near_next"] == 1.0
    assert syncmers.compared(frame(spark, [])).collect() == []
