"""Encoding of whole corpora with a byte-level BPE vocabulary.

Method: speculate and verify. Greedy longest match proposes the tokens of each new word; vectorised checks test every
adjacent pair of tokens for compatibility (that merging would keep them apart); only words that fail are merged
exactly. A sequence of tokens is what merging gives if and only if each adjacent pair is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Distinct pieces of text a worker keeps before it starts anew.
KEPT = 400_000
# Fixed value: the pre-tokenisation of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACES = re.compile(r" \s")
_CUT = re.compile(r" (?=\S)")


def default_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, by rule: printable Latin-1 bytes stand for
    themselves, the others for the letters from 256 on, in order."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens, merges and the pair test of a byte-level BPE file (tokenizers' JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = model["vocab"]
        of = lambda s: bytes([letters[c] for c in s])
        single = {s: i for s, i in ids.items() if len(s) == 1 and s in letters}
        self.ids = {of(s): i for s, i in single.items()}
        a = np.array([ids[x] for x, _ in merges], np.int64)
        b = np.array([ids[y] for _, y in merges], np.int64)
        c = np.array([ids[x + y] for x, y in merges], np.int64)
        self.ids.update((of(x + y), ids[x + y]) for x, y in merges)
        lengths: dict[bytes, set[int]] = {}
        for t in self.ids:
            if len(t) > 1:
                lengths.setdefault(t[:2], set()).add(len(t))
        #: Lengths of the tokens that open with two bytes, the longest first.
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}
        size = max(ids.values()) + 1
        # ranks order merges; a token's rank is that of the merge that makes it, single bytes come before all
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        order = np.arange(len(merges))
        self.rank[c], self.left[c], self.right[c] = order, a, b
        key = a << 20 | b
        s = np.argsort(key)
        self._key, self._made = key[s], order[s]
        self._merge = {(int(x), int(y)): (int(r), int(z)) for x, y, r, z in zip(a, b, order, c)}
        self.whole = self.compatible(a, b, order)  # by merge: whether the token is what merging its own bytes gives
        ok = np.ones(size, bool)
        for t in np.flatnonzero(~self.whole):
            ok[c[t]] = False
        if not ok.all():
            for z, x, y in zip(c, a, b):
                ok[z] &= ok[x] and ok[y]
        self.ok = ok

    def _made_by(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or a large number."""
        k = a << 20 | b
        i = np.minimum(np.searchsorted(self._key, k), len(self._key) - 1)
        return np.where(self._key[i] == k, self._made[i], 1 << 42)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens whether merging would keep them apart: undo merges on either side of the border, the
        latest first, and see that no merge across it would have come earlier."""
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        limit = np.full(len(a), 1 << 41) if limit is None else limit.astype(np.int64).copy()
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            bad = self._made_by(x, y) < limit[live]
            good[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            rx, ry = self.rank[x], self.rank[y]
            last = (rx < 0) & (ry < 0)
            live, x, y, rx, ry = live[~last], x[~last], y[~last], rx[~last], ry[~last]
            undo = rx > ry  # ties fall to the right: of equal merges the left one comes first
            limit[live] = np.where(undo, rx, ry + 1)
            a[live] = np.where(undo, self.right[x], x)
            b[live] = np.where(undo, y, self.left[y])
        return good

    def greedy(self, word: bytes) -> list[int]:
        out, i, n, ids, lengths = [], 0, len(word), self.ids, self.lengths
        while i < n:
            for k in lengths.get(word[i : i + 2], ()):
                if (t := ids.get(word[i : i + k])) is not None and i + k <= n:
                    break
            else:
                k, t = 1, ids[word[i : i + 1]]
            out.append(t)
            i += k
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the earliest merge first, from the left."""
        tok = [self.ids[word[i : i + 1]] for i in range(len(word))]
        n = len(tok)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r[0], i, tok[i], tok[i + 1], r[1]) for i in range(n - 1) if (r := self._merge.get((tok[i], tok[i + 1])))]
        heapify(heap)
        while heap:
            _, i, a, b, made = heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or tok[i] != a or tok[j] != b:
                continue
            tok[i] = made
            alive[j] = False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self._merge.get((tok[x], tok[y]))):
                    heappush(heap, (r[0], x, tok[x], tok[y], r[1]))
        return [t for t, ok in zip(tok, alive) if ok]


class Encoder:
    """Encodes batches of texts; keeps what it has learned of pieces and words between batches."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self._pattern = regex.compile(PATTERN)
        self._reset()

    def _reset(self) -> None:
        self.words: dict[str, tuple[int, ...]] = {}
        self.fresh: list[str] = []
        self._n = 0
        self.first, self.later = self._make()
        self.flat = np.empty(0, np.int32)
        self.at, self.len = np.empty(0, np.int64), np.empty(0, np.int64)

    def _make(self):
        fresh = self.fresh
        outer = self

        class Pieces(dict):
            def __init__(self, lead: str):
                super().__init__()
                self.lead = lead

            def __missing__(self, p: str) -> int:
                i = self[p] = outer._n + len(fresh)
                fresh.append(self.lead + p)
                return i

        return Pieces(""), Pieces(" ")

    def _learn(self) -> None:
        """Tokens of the fresh pieces: speculate on the new words at once, verify them at once, merge what fails."""
        if not self.fresh:
            return
        v, words = self.vocabulary, self.words
        split = [self._pattern.findall(p) for p in self.fresh]
        new = list({w: None for ws in split for w in ws if w not in words})
        raw = [w.encode("utf-8", "replace") for w in new]
        guess = [v.greedy(b) for b in raw]
        n = np.array([len(g) for g in guess], np.int64)
        if len(n):
            toks = np.array([t for g in guess for t in g], np.int64)
            word = np.repeat(np.arange(len(n)), n)
            bad = np.zeros(len(n), bool)
            bad[word[~v.ok[toks]]] = True
            inner = np.flatnonzero(word[:-1] == word[1:])
            key, back = np.unique(toks[inner] << 20 | toks[inner + 1], return_inverse=True)
            fit = v.compatible(key >> 20, key & 0xFFFFF)
            bad[word[inner[~fit[back]]]] = True
            for k in np.flatnonzero(bad):
                guess[k] = v.merge(raw[k])
            words.update(zip(new, map(tuple, guess)))
        ids = [[t for w in ws for t in words[w]] for ws in split]
        m = np.array([len(x) for x in ids], np.int64)
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(m) - m])
        self.len = np.concatenate([self.len, m])
        self.flat = np.concatenate([self.flat, np.array([t for x in ids for t in x], np.int32)])
        self._n += len(self.fresh)
        self.fresh.clear()

    def _index(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts, and the number of each text's."""
        first, later = self.first, self.later
        seq: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if not t:
                continue
            # a blank before a non-blank always begins a word, so texts may be cut there
            parts = _CUT.split(t) if _SPACES.search(t) else t.split(" ")
            counts[k] = len(parts)
            seq.append(first[parts[0]])
            seq += [later[p] for p in parts[1:]]
        self._learn()
        return np.array(seq, np.int64), counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts in one array, offsets): nothing for null and empty texts."""
        seq, counts = self._index(texts)
        n = self.len[seq]
        total = int(n.sum())
        ends = np.cumsum(n)
        values = self.flat[np.repeat(self.at[seq] - ends + n, n) + np.arange(total)]
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        self._trim()
        return values, offsets

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of each text."""
        seq, counts = self._index(texts)
        ends = np.concatenate([[0], np.cumsum(self.len[seq])])[np.concatenate([[0], np.cumsum(counts)])]
        self._trim()
        return np.diff(ends)

    def _trim(self) -> None:
        if self._n > KEPT or len(self.words) > KEPT or len(self.flat) > 20 * KEPT:
            self._reset()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): one row for each row of ``documents(doc_id, text)``, the tokens of its text without special tokens.

    Null and empty texts give an empty list, blank ones are encoded as they are; repeated rows give rows each. ``path``
    is the vocabulary's JSON file, the same on all executors.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            values, offsets = enc.encode(b.column(1).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``documents`` and n_tokens, the number of tokens of ``text`` (0 for null)."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = pa.array(enc.count(b.column(b.num_columns - 1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), n], [*keep, "n_tokens"])

    types = dict(documents.dtypes)
    return documents.select(*keep, "text").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_tokens long")
