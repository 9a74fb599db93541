"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker."""

from __future__ import annotations

import itertools
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import regex

from tidemark.llm import shared

#: Distinct words whose ids a worker remembers; beyond that it starts afresh.
MEMO_WORDS = 3 << 17
#: Bytes of text encoded at a time.
SLICE_BYTES = 1 << 22
#: Words in one call of the library, and the byte that keeps them apart.
JOINED, _APART = 128, b"\x01"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def pieces(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Parts of texts that lie end to end whose ids, one after the other, are the texts' ids: words, a mark
    that ends a word after a letter by itself, and words of ASCII in lower case. Also the first part of each
    text (len(at) numbers). A pre-token ends between a letter and a mark, and what has no letter beyond ASCII
    is neither composed nor lowered in another way; ``<`` might begin a special token, whose case counts."""
    data, at = data[at[0] : at[-1]], at - at[0]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    space = shared.SPACE[data]
    word = ~space
    begin, last = edge[:-1].copy(), edge[1:].copy()
    begin[1:] |= space[:-1]
    last[:-1] |= space[1:]
    mark = _MARK[data] & last
    mark[1:] &= _LETTER[data[:-1]]
    begin = (begin | mark) & word
    first = np.searchsorted(np.flatnonzero(begin), at)
    kept = data[word]
    offsets = np.append(np.flatnonzero(begin[word]), len(kept))
    if len(kept):
        odd = np.logical_or.reduceat((kept > 127) | (kept == 60), offsets[:-1])
        kept = np.where(np.repeat(odd, np.diff(offsets)), kept, shared.LOWER[kept])
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(kept)]), first


def by_word(path: str) -> bool:
    """Whether a text's ids are its words' ids, one after the other: the normaliser changes characters, or runs of
    white space to one, and no more; pre-tokens are the matches of a pattern that holds no white space and ends
    between a letter and a mark; nothing is added between them."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = lambda x, of: [] if x is None else x[of] if x["type"] == "Sequence" else [x]
    for x in steps(spec.get("normalizer"), "normalizers"):
        whitespace = x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " "
        if x["type"] not in ("NFC", "Lowercase") and not whitespace:
            return False
    split, *rest = steps(spec.get("pre_tokenizer"), "pretokenizers") or [{"type": "none"}]
    if split["type"] != "Split" or split["behavior"] != "Removed" or not split["invert"] or "Regex" not in split["pattern"]:
        return False
    if any(x["type"] != "ByteLevel" or x["add_prefix_space"] or x.get("use_regex", True) for x in rest):
        return False
    pattern = regex.compile(split["pattern"]["Regex"])
    spaces = "\t\n\x0b\x0c\r "
    probes = [a + s + b for a in ("a", "1", "'", ".", "é", "<|") for s in (*spaces, spaces) for b in ("b", "2", "s", "!", "ß", "|>")]
    if any(set(m) & set(spaces) for x in probes for m in pattern.findall(x)):
        return False
    return all(pattern.findall(f"ab{m}") == ["ab", m] for m in ".,;:!?") and pattern.findall("a b") == ["a", "b"]


class Encoder:
    """Ids of texts. Under a tokenizer whose normaliser and pre-tokenizer never join or look across ASCII white
    space (by_word()), each distinct word is encoded once and remembered; under any other, whole texts are."""

    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.by_word = Tokenizer.from_file(path), end_id, by_word(path)
        #: Taken away for text that it would not change but for white space, which no id depends on.
        self.normalizer = self.tokenizer.normalizer
        if self.by_word:
            self.apart = self.tokenizer.encode("\x01", add_special_tokens=False).ids[0]
            self._reset()

    def _reset(self) -> None:
        end = [] if self.end is None else [self.end]
        self.memo: dict[bytes, int] = {b"": 0}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), len(end)
        self.pool[: len(end)] = end
        self.start, self.length = np.zeros(1, np.int64), np.array([len(end)], np.int64)

    def _learn(self, fresh: list[bytes]) -> None:
        """Words are encoded some hundred at a time, apart from each other by a character whose id no
        other text has; words that hold this character are encoded alone."""
        odd = [w for w in fresh if _APART in w]
        plain = fresh if not odd else [w for w in fresh if _APART not in w]
        low = [w == w.lower() for w in plain]
        n_low = sum(low)
        plain = [*itertools.compress(plain, low), *itertools.compress(plain, (not x for x in low))] if n_low < len(plain) else plain
        texts = [b" \x01 ".join([*plain[i : i + JOINED], b""]).decode("utf-8", "replace") for i in range(0, len(plain), JOINED)]
        normal = [(i + 1) * JOINED <= n_low and x == x.lower() and unicodedata.is_normalized("NFC", x) for i, x in enumerate(texts)]
        coded: list[list[int]] = [[]] * len(texts)
        for kind in (True, False):
            self.tokenizer.normalizer = None if kind else self.normalizer
            own = [i for i, x in enumerate(normal) if x == kind]
            for i, x in zip(own, self.tokenizer.encode_batch_fast([texts[i] for i in own], add_special_tokens=False), strict=True):
                coded[i] = x.ids
        n_texts = len(coded)
        for x in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in odd], add_special_tokens=False):
            coded.append(x.ids)
        n_plain = sum(map(len, coded[:n_texts]))
        ids = np.fromiter(itertools.chain.from_iterable(coded), np.uint32)
        apart = np.flatnonzero(ids[:n_plain] == self.apart)
        ends = np.concatenate([apart, n_plain + np.cumsum([len(x) for x in coded[n_texts:]], dtype=np.int64)])
        begins = np.concatenate([[0], apart + 1, ends[len(plain) : -1]])[: len(fresh)].astype(np.int64)
        self._add(plain + odd, ids, begins, ends)

    def _add(self, words: list[bytes], ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.memo.update(zip(words, range(len(self.memo), len(self.memo) + len(words)), strict=True))
        self.start = np.concatenate([self.start, begins + self.used])
        self.length = np.concatenate([self.length, ends - begins])
        self.used += len(ids)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of remembered words end to end, and len(at) + 1 offsets."""
        length = self.length[at]
        ends = np.concatenate([[0], np.cumsum(length)])
        where = np.repeat(self.start[at] - ends[:-1], length)
        where += np.arange(len(where))
        return self.pool[where], ends

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie end to end: all ids, each text's followed by the end id, and len(at) offsets.
        Words are found and told apart without making a Python object of each."""
        if not self.by_word:
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]
            end = [] if self.end is None else [self.end]
            each = [x.ids + end for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.fromiter(itertools.chain.from_iterable(each), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])
        if len(at) == 2 and at[1] - at[0] > 2 * SLICE_BYTES:  # one long text, in parts that end before white space
            own = list(shared.cuts(data, int(at[0]), int(at[1]), SLICE_BYTES))
            if len(own) > 1:
                parts, n_end = [self.encode(data, np.array(x))[0] for x in own], 0 if self.end is None else 1
                ids = np.concatenate([x[: len(x) - n_end] for x in parts[:-1]] + parts[-1:])
                return ids, np.array([0, len(ids)])
        if len(self.memo) > MEMO_WORDS:
            self._reset()
        words, first = pieces(data, at)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if fresh := [w for w in distinct if w not in self.memo]:
            self._learn(fresh)
        known = np.fromiter(map(self.memo.__getitem__, distinct), np.int64, len(distinct))
        ids, ends = self._gather(np.insert(known[coded.indices.to_numpy()], first[1:], 0))
        return ids, ends[first + np.arange(len(first))]


def encoder(path: str, end_id: int | None) -> Encoder:
    """The worker's encoder, which remembers words from one task to the next, until another operator takes its turn."""
    shared.lean("encoder")
    own = shared.kept.get("encoder")
    if own is None or own[0] != (path, end_id):
        own = shared.kept["encoder"] = (path, end_id), Encoder(path, end_id)
    return own[1]
