"""Same or nearly same spoken words across splits.

Method: winnowing fingerprints. Each distinct sequence of words gives rolling hashes of some words, of which the least in
every window is kept; short texts keep all. Kept ones are joined across splits. Seeds that are frequent in the corpus are joined together with each of the rarest words of their text, of which
two texts that are near alike share one, so no pair is lost by it. Collinear seeds of a pair are chained, the chain is
extended by alignment of what lies between and around its seeds.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import furniture, speech
from lectern.llm.encoding import repair
from lectern.sources.tables import stage

LEAST, SHARE = 28, 0.85
#: (words of a seed, seeds of a window, shortest and longest text in words). Short texts keep every seed of five words: with
#: single words changed as often as SHARE allows, two of up to 31 words share one for sure. Longer ones keep one of
#: every three seeds of six words: sure for eight words in a row. Short ones
#: have these too, to meet longer ones.
SEEDS = ((5, 1, LEAST, 31), (6, 3, LEAST, 1 << 40))
#: Words of a seed of a chain.
WORDS = 5
#: Bytes of a word's hash in a sequence.
WIDTH = 3
#: A seed is frequent if it holds more than this share of a third of all words (there are about as many seeds): there
#: are at most about 1/HOT such seeds. A word with more than this share of all words isn't rare. Both are told from one
#: text in SAMPLED and decide on cost only, not on what is found.
HOT, SAMPLED = 1e-5, 32
#: A seed held by fewer texts isn't frequent, whatever its share.
FEW = 1000

_JOIN = re.compile(r"(?<=[a-z])[-\xad¬][ \t]*\n\s*|(?<=[a-z])[-\xad¬] +(?=[a-z])")
# Letters that scanning takes for one another fall together; other signs go.
_SAME = bytes.maketrans(b"0195ehij!", b"olgscblll")
_GONE = b"\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def plain_words(text: str | None, given: frozenset[str], learned: speech.Learned = speech.NOTHING) -> list[bytes]:
    """Spoken words of a line for comparison; [] where there can't be LEAST of them.

    Case, punctuation, markup and garbling don't count. Latin letters with accents are left out on both sides, as garbling
    loses them; letters of other scripts stay.
    """
    if not text or len(text) < 2 * LEAST - 1 or len(text.split()) + text.count("[") + text.count("(") + text.count("*") + text.count("<") < LEAST:
        return []
    end = speech.split_label(text, given)[3]
    s = text[end:]
    if "-" in s or "\xad" in s or "¬" in s:
        s = _JOIN.sub("", s)
    s = speech.spoken(s, 0, learned).lower().replace("†", "t")
    if s.isascii():
        b = s.encode()
    else:
        s = repair(s)[0] or ""
        b = "".join([c for c in s if c < "\x80" or c > "\u024f" and not "\u1e00" <= c <= "\u1eff" and c.isalpha() and not "\ufb00" <= c <= "\ufb06"]).encode()
    return b.translate(_SAME, _GONE).replace(b"rn", b"m").split()


class _Hashes(dict):
    def __missing__(self, w: bytes) -> bytes:
        h = self[w] = zlib.crc32(w).to_bytes(4, "little")[:WIDTH]
        return h


def _words(seq: bytes) -> np.ndarray:
    """Word hashes of one or more sequences."""
    b = np.frombuffer(seq, np.uint8).reshape(-1, WIDTH).astype(np.uint32)
    return b[:, 0] | b[:, 1] << np.uint32(8) | b[:, 2] << np.uint32(16)


def _classes(given: frozenset[str], learned: speech.Learned):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            ids, files, cids, seqs = [], [], [], []
            for i, f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                w = plain_words(t, given, learned)
                if len(w) >= LEAST:
                    seq = b"".join([hashes[x] for x in w])
                    ids.append(i)
                    files.append(f)
                    cids.append(xxhash.xxh3_64_intdigest(seq) - (1 << 63))
                    seqs.append(seq)
            if len(hashes) > 1_000_000:
                hashes.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(files, pa.string()), pa.array(cids, pa.int64()), pa.array(seqs, pa.binary())], ["rec_id", "file", "cid", "seq"])

    return run


_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _rolling(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on (0 places past the end)."""
    h = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        h = h * _M + w[j : len(w) - k + 1 + j]
    return _mix(h)


def _winnowed(w: np.ndarray, n: np.ndarray, first: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the kept seeds, without repeats in a row, of sequences of lengths ``n`` that lie one after another."""
    got = []
    for words, window, least, most in SEEDS:
        mine = (n >= least) & (n <= most)
        if not mine.any():
            continue
        x, at, r = w[mine[row]], (np.arange(len(w)) - first[row])[mine[row]], row[mine[row]]
        left = n[r] - at  # words from here on
        h = np.full(len(x) + window, np.iinfo(np.uint64).max, np.uint64)
        k = _rolling(x, words)
        h[: len(k)] = k * np.uint64(2 * words + 1)  # seeds of each kind are keys of their own
        if window == 1:
            kept = np.flatnonzero(left >= words)
        else:
            # the least short hash of every words + window - 1 words picks one of its window seeds, by its place modulo
            # window; that keeps fewer seeds than the least seed does, as sure for a run of that length
            short = np.full(len(x) + 2 * window, np.iinfo(np.uint64).max, np.uint64)
            k = _rolling(x, words - window)
            short[: len(k)] = k
            least = np.argmin(np.stack([short[j : j + len(x)] for j in range(2 * window)]), axis=0)
            kept = np.unique((least % window + np.arange(len(x)))[left >= words + window - 1])
        kept = kept[np.lexsort((h[kept], r[kept]))]
        kept = kept[np.append(True, (np.diff(h[kept]) != 0) | (np.diff(r[kept]) != 0))]
        got.append((r[kept], h[kept]))
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*got))


def _rarest(w: np.ndarray, n: np.ndarray, first: np.ndarray, row: np.ndarray, often: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, word) of the words that come first in each sequence when the frequent ones go last: one more than a text may
    have words that a near-alike one lacks. Two texts that share SHARE of the longer's words in order share one of them."""
    at = np.minimum(np.searchsorted(often["word"], w), max(len(often["word"]) - 1, 0))
    rank = np.where(often["word"][at] == w, often["n"][at], 0) if len(often["word"]) else np.zeros(len(w), np.int64)
    order = np.lexsort((w, rank, row))
    lead = np.arange(len(w)) - first[row] <= (n * (1 - SHARE) + 1e-6).astype(np.int64)[row]
    got = np.unique(np.stack([row[lead].astype(np.uint64), w[order][lead]]), axis=1)
    return got[0].astype(np.int64), got[1]


def _laid(b: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all sequences of a batch one after another; length, start and (per word) row of each."""
    seqs = b.column(column).to_pylist()
    n = np.array([len(x) // WIDTH for x in seqs])
    return _words(b"".join(seqs)).astype(np.uint64), n, np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """seq -> how many sequences of the batch hold each seed, and how often each word occurs (``seed`` false)."""
    for b in batches:
        if b.num_rows:
            w, *rest = _laid(b, 0)
            for seed, x in ((True, _winnowed(w, *rest)[1]), (False, w)):
                x, k = np.unique(x, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), seed)), pa.array(x.view(np.int64)), pa.array(k, pa.int64())], ["seed", "x", "k"])


#: Bits of a set of words.
_SET = 112


def _seeds(hot: np.ndarray, often: dict[str, np.ndarray]):
    """cid, seq -> the keys on which each sequence is joined, its set of words as 112 bits with its length in 16 more (0: over
    65,535): its kept seeds; for those in ``hot`` (sorted) the seed with each of its rarest words. Works on all sequences of
    a batch at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            w, n, first, row = _laid(b, 1)
            bit = (((w * _M) >> np.uint64(40)) * np.uint64(_SET)) >> np.uint64(24)
            bits = np.uint64(1) << np.where(bit < 64, bit, bit - np.uint64(64))
            sets = [np.bitwise_or.reduceat(np.where(half, bits, np.uint64(0)), first).view(np.int64) for half in (bit < 64, bit >= 64)]
            sets[1] |= np.where(n < 1 << 16, n, 0) << (_SET - 64)
            r, h = _winnowed(w, n, first, row)
            if len(hot):
                is_hot = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                rr, rare = _rarest(w, n, first, row, often)
                per = np.bincount(rr, minlength=len(n))
                start = np.cumsum(per) - per
                x, y = r[is_hot], h[is_hot]
                many = per[x]
                at = np.repeat(start[x] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                r = np.concatenate([r[~is_hot], np.repeat(x, many)])
                h = np.concatenate([h[~is_hot], _mix(np.repeat(y, many) * _M + rare[at])])
            cols = (h.view(np.int64), b.column(0).to_numpy()[r], sets[0][r], sets[1][r])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "cid", "words", "rest"])

    return run


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two sequences of words, bit-parallel."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b.tolist():
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def chained(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """The chain of collinear seeds (runs of WORDS equal words) of two sequences: (place in a, place in b, words), each run
    as long as it goes. The longest increasing set of matching places, a seed that repeats taken at its first place."""
    if len(a) < WORDS or len(b) < WORDS:
        return []
    where: dict[int, int] = {}
    for i, x in enumerate(_rolling(a.astype(np.uint64), WORDS).tolist()):
        where.setdefault(x, i)
    hits = [(where[y], j) for j, y in enumerate(_rolling(b.astype(np.uint64), WORDS).tolist()) if y in where]
    # longest increasing subsequence of the places in a, in order of the places in b
    tails: list[int] = []
    ends: list[int] = []
    came = [-1] * len(hits)
    for k, (i, _) in enumerate(hits):
        at = bisect_left(tails, i)
        came[k] = ends[at - 1] if at else -1
        tails[at : at + 1] = [i]
        ends[at : at + 1] = [k]
    path = []
    k = ends[-1] if ends else -1
    while k >= 0:
        path.append(hits[k])
        k = came[k]
    runs: list[tuple[int, int, int]] = []
    for i, j in reversed(path):
        if runs:
            p, q, n = runs[-1]
            if i - p == j - q and i <= p + n:
                runs[-1] = (p, q, i - p + WORDS)
                continue
            cut = max(p + n - i, q + n - j, 0)
            if cut >= WORDS:
                continue
            i, j = i + cut, j + cut
            runs.append((i, j, WORDS - cut))
        else:
            runs.append((i, j, WORDS))
    return runs


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> tuple[int, int]:
    """(words in common in the same order, words of them within the chain): the chain is extended by alignment of what lies
    before, between and after its runs; only where that falls short of ``least`` are the sequences aligned as a whole."""
    runs = chained(a, b)
    i = j = got = inside = 0
    for p, q, n in [*runs, (len(a), len(b), 0)]:
        if p > i and q > j:
            got += common(a[i:p], b[j:q])
        got += n
        inside += n
        i, j = p + n, q + n
    if got < least and runs:
        got = max(got, common(a, b))
    return got, inside


def _may_match(t: pa.RecordBatch) -> np.ndarray:
    """Which pairs of a batch (sequences in columns 2 and 3) lack few enough of each other's words by sets of 512 bits; a
    bit that only one side has is at least one word the other lacks."""
    out = []
    for at in range(0, t.num_rows, 4096):
        part = t.slice(at, 4096)
        has, size = [], []
        for c in (2, 3):
            w, n, _, row = _laid(part, c)
            has.append(np.zeros((len(n), 512), bool))
            has[-1][row, (w * _M) >> np.uint64(55)] = True
            size.append(n)
        least = SHARE * np.maximum(*size) - 1e-6
        out.append(((has[0] & ~has[1]).sum(1) <= size[0] - least) & ((has[1] & ~has[0]).sum(1) <= size[1] - least))
    return np.concatenate(out)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        a, b, common_, chain, longer = [], [], [], [], []
        t = t.filter(pa.array(_may_match(t))) if t.num_rows else t
        for x, y, p, q in zip(*(t.column(i).to_pylist() for i in range(4))):
            u, v = _words(p), _words(q)
            n = max(len(u), len(v))
            c, inside = aligned(u, v, SHARE * n)
            if c >= SHARE * n:
                a.append(x)
                b.append(y)
                common_.append(c)
                chain.append(inside)
                longer.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(common_, pa.int32()), pa.array(chain, pa.int32()), pa.array(longer, pa.int32())], ["cid_a", "cid_b", "common", "chain", "longer"])


def overlap_parts(records: DataFrame, splits: DataFrame, given: frozenset[str], learned: speech.Learned | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, links): members(cid, rec_id, file, train) has every record of LEAST words or more (repeated ones again) with the class of
    its words; links(cid_a, cid_b, common, chain, longer) has the class pairs, a class with itself included, of which
    one holds a train record and the other one of another split and that share SHARE of the longer's words in order.

    ``splits(file, split_name)``; records of files in no split, null texts and short ones take no part. Equal texts are
    one class, so copies cost one fingerprint set. Repeated records count once.
    """
    spark = records.sparkSession
    learned = furniture.learn(records) if learned is None else learned
    rows = records.select("rec_id", "file", "text").mapInArrow(_classes(given, learned), "rec_id long, file string, cid long, seq binary")
    rows = stage(rows, "words")
    side = splits.filter("file is not null").groupBy("file").agg(F.min("split_name").alias("split_name"))
    members = rows.select("rec_id", "file", "cid").join(side, "file").select("cid", "rec_id", "file", (F.col("split_name") == "train").alias("train"))
    members = stage(members, "members")
    use = members.groupBy("cid").agg(F.max("train").alias("train"), F.max(~F.col("train")).alias("other"))
    # texts, and with it every join on cid below, keeps the partitioning of this one aggregate
    texts = rows.groupBy("cid").agg(F.first("seq").alias("seq")).join(use, "cid").select("cid", "train", "other", "seq")
    sample = rows.filter(F.pmod("cid", F.lit(SAMPLED)) == 0).groupBy("cid").agg(F.first("seq").alias("seq"))
    held = sample.select("seq").mapInArrow(_sampled, "seed boolean, x long, k long").groupBy("seed", "x").agg(F.sum("k").alias("k"))
    total = rows.agg(F.sum(F.length("seq")) / WIDTH).first()[0] or 0.0
    # at least so often that few are frequent by chance
    frequent = held.filter(F.col("k") > F.when(F.col("seed"), max(float(FEW), total / 3 * HOT)).otherwise(max(50.0, total * HOT)) / SAMPLED).toArrow()
    seed, x, k = (frequent.column(c).to_numpy() for c in ("seed", "x", "k"))
    x, seed = x.astype(np.int64).view(np.uint64), seed.astype(bool)
    order = np.argsort(x[~seed])
    shared = spark.sparkContext.broadcast((np.sort(x[seed]), {"word": x[~seed][order], "n": k[~seed][order]}))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _seeds(*shared.value)(batches)

    def side_keys(which: str, end: str) -> DataFrame:
        got = texts.filter(which).select("cid", "seq").mapInArrow(keys, "key long, cid long, words long, rest long")
        return got.select("key", *(F.col(c).alias(c + end) for c in ("cid", "words", "rest")))

    a, b = side_keys("train", "_a"), side_keys("other", "_b")
    n = {x: F.shiftrightunsigned(f"rest_{x}", _SET - 64) for x in "ab"}
    most = F.greatest(n["a"], n["b"]) * SHARE - 1e-6
    near = F.least(n["a"], n["b"]) >= most
    for x, y in (("a", "b"), ("b", "a")):
        lacks = [F.bit_count(F.col(f"{c}_{x}").bitwiseAND(F.bitwise_not(f"{c}_{y}")).bitwiseAND(F.lit(mask))) for c, mask in (("words", -1), ("rest", (1 << (_SET - 64)) - 1))]
        near = near & (lacks[0] + lacks[1] <= n[x] - most)
    near = (F.col("cid_a") != F.col("cid_b")) & (near | (n["a"] == 0) | (n["b"] == 0))
    pairs = a.join(b, "key").filter(near).select("cid_a", "cid_b").distinct()
    t = texts.select("cid", "seq")
    full = pairs.join(t.select(F.col("cid").alias("cid_a"), F.col("seq").alias("seq_a")), "cid_a").join(t.select(F.col("cid").alias("cid_b"), F.col("seq").alias("seq_b")), "cid_b")
    found = full.select("cid_a", "cid_b", "seq_a", "seq_b").mapInArrow(_verify, "cid_a long, cid_b long, common int, chain int, longer int")
    size = (F.length("seq") / WIDTH).cast("int")
    same = texts.filter("train and other").select(F.col("cid").alias("cid_a"), F.col("cid").alias("cid_b"), size.alias("common"), size.alias("chain"), size.alias("longer"))
    return members, found.unionByName(same)


def overlap_pairs(records: DataFrame, splits: DataFrame, given: frozenset[str]) -> DataFrame:
    """(rec_id_a, rec_id_b), the smaller first: every pair of records across train and the other splits that overlaps."""
    members, links = overlap_parts(records, splits, given)
    tr = members.filter("train").select(F.col("cid").alias("cid_a"), F.col("rec_id").alias("x"))
    ot = members.filter("not train").select(F.col("cid").alias("cid_b"), F.col("rec_id").alias("y"))
    both = links.select("cid_a", "cid_b").join(tr, "cid_a").join(ot, "cid_b").filter("x <> y")
    return both.select(F.least("x", "y").alias("rec_id_a"), F.greatest("x", "y").alias("rec_id_b")).distinct()


def overlap_report(records: DataFrame, splits: DataFrame, given: frozenset[str]) -> DataFrame:
    """(split_name, file, records, overlapping, mean_coverage): per file, its records of LEAST words or more, how many overlap a record
    of the other side, and the mean share of the longer text's words that their best overlap covers."""
    members, links = overlap_parts(records, splits, given)
    part = links.select("cid_a", "cid_b", (F.col("common") / F.col("longer")).alias("c"))
    best = part.select(F.col("cid_a").alias("cid"), F.lit(True).alias("train"), "c").union(part.select("cid_b", F.lit(False), "c")).groupBy("cid", "train").agg(F.max("c").alias("c"))
    side = splits.filter("file is not null").groupBy("file").agg(F.min("split_name").alias("split_name"))
    per = members.distinct().join(best, ["cid", "train"], "left").groupBy("file").agg(F.count("*").alias("records"), F.count("c").alias("overlapping"), F.round(F.avg("c"), 6).alias("mean_coverage"))
    return side.join(per, "file").select("split_name", "file", "records", "overlapping", "mean_coverage")
