import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import frame
from tidemark.llm import binary, packing, shared, tokens


def ids_of(texts):
    t = Tokenizer.from_file(tokens.vocabulary())
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_encoder_equals_whole_texts():
    random = np.random.default_rng(1)
    parts = ["a", "B", "é", "é", "J̌", " ", "\n", " ", " ", "'s", "'ll", ".", ",", "!", "\x01", "<|endoftext|>", "<|ENDOFTEXT|>", "3", "日本", "ß", "İ", "Σ", "\x1c", "\x85", "😀", "The", "É", "THE,", ".,", "a.", "it's", ";", "<", "|", "<|"]
    texts = ["", " ", "\x01", *("".join(random.choice(parts, random.integers(0, 40))) for _ in range(2500))]
    e = tokens.Encoder(tokens.vocabulary(), 1)
    for a in range(0, len(texts), 100):
        ids, ends = e.encode(*shared.text_bytes(pa.array(["zz", *texts[a : a + 100]]).slice(1)))
        for i, want in enumerate(ids_of(texts[a : a + 100])):
            assert ids[ends[i] : ends[i + 1]].tolist() == want


@pytest.mark.parametrize("seed", range(4))
def test_patterns_place_every_length_once(seed):
    random = np.random.default_rng(seed)
    lengths = Counter(random.choice([2048, 1500, 700, 300, 3, 1, *random.integers(1, 2049, 2000)], 9000).tolist())
    found, used = packing.patterns(lengths), Counter()
    for pattern, n in found:
        assert 0 < sum(length * times for length, times in pattern) <= 2048
        for length, times in pattern:
            used[length] += n * times
    assert used == lengths
    total, packs = sum(k * v for k, v in lengths.items()), sum(n for _, n in found)
    assert total / (packs * 2048) > 0.97


def check(rows, texts):
    want = Counter()
    for key, ids in zip([t[0] for t in texts], ids_of([t[1] for t in texts]), strict=True):
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            want[key, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_pack(spark, odd):
    check(packing.pack(frame(spark, odd, extra=True), tokens.vocabulary()).collect(), odd)


def test_pack_nothing(spark):
    assert packing.pack(frame(spark, []), tokens.vocabulary()).collect() == []


def test_files_round_trip(spark, odd, tmp_path):
    folder = f"file://{tmp_path}/ids"
    rows = sorted(binary.encode(frame(spark, odd, extra=True), tokens.vocabulary(), folder).collect(), key=lambda r: r["start"])
    order = sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, t, ids in zip(rows, order, ids_of([t[1] for t in order]), strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (t[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_a_folder_is_read_by_its_manifest(spark, tmp_path):
    folder = f"file://{tmp_path}/ids"
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i * 7919 % 400:03d} " + "wörd " * (i % 50)) for i in range(400)]
    docs = frame(spark, rows).repartition(7)
    made = binary.write(docs, tokens.vocabulary(), folder, length=64)
    said = binary.manifest(folder)
    assert said["files"] == made and said["length"] == 64 and said["n_tokens"] == sum(map(len, ids_of([t for _, t in rows])))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got, stream = sorted(binary.documents(spark, folder).collect(), key=lambda r: r["start"]), []
    assert [r["doc_id"] for r in got] == [r[0] for r in order] and [r["ids_crc32"] for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids_of([t for _, t in order])]
    for x in said["files"]:
        assert x["base"] == len(stream)
        for _, _, ids in binary.Reader(f"{folder}/{x['name']}").documents():
            stream += ids.tolist()
    assert stream == [i for x in ids_of([t for _, t in order]) for i in x]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    other = tokens.vocabulary("byte_bpe_50k.json")
    assert tokens.by_word(tokens.vocabulary()) and not tokens.by_word(other)
    spec = json.loads(open(tokens.vocabulary(), encoding="utf-8").read())
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L} ]+|[^\s]"
    path = f"{tmp_path}/joined.json"
    open(path, "w", encoding="utf-8").write(json.dumps(spec))
    assert not tokens.by_word(path)
    texts = ["a  b", "", "Two words. é", " lead", "x" * 3000]
    for vocabulary in (other, path):
        whole = Tokenizer.from_file(vocabulary)
        ids, ends = tokens.Encoder(vocabulary, 1).encode(*shared.text_bytes(pa.array(["zz", *texts]).slice(1)))
        for i, t in enumerate(texts):
            assert ids[ends[i] : ends[i + 1]].tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1]


def test_sequences_by_number(tmp_path):
    out = binary.Writer(f"{tmp_path}/x", 8, pa.uint16())
    ids = np.arange(2000, dtype=np.uint32)
    out.add(pa.array([5, 6], pa.int64()), ids, np.array([0, 1500, 2000]))
    out.close()
    r = binary.Reader(f"{tmp_path}/x")
    for i in (0, 7, 130, 249):
        got, mask = r.sequence(i)
        assert got.tolist() == list(range(8 * i, 8 * i + 8)) and mask.all()
    assert [(k, s, x.tolist()) for k, s, x in r.documents()] == [(5, 0, list(range(1500))), (6, 1500, list(range(1500, 2000)))]


def test_files_nothing(spark):
    assert binary.encode(frame(spark, []), tokens.vocabulary()).collect() == []
