"""Speech transcripts into clean speaker turns.

Method: a hidden Markov model over the labelled stretches of a file (a labelled line with the lines that go on from it).
The hidden state is the participant who speaks, known by the forms of name seen around; a state emits the form of the
label by how well it names the participant, and the words by the participant's language profile where forms alone leave
it open. From stretch to stretch a participant goes on or another one begins, with probabilities learned from the labels;
after a heading anybody may speak. The most probable path (Viterbi) gives the turns. Stretches without a label after a
heading get their speakers from the same model, with profiles over all turns of the file (``infer``).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import log

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import furniture, names, speech
from lectern.llm.encoding import repair
from lectern.llm.entity_link import Resolver
from lectern.llm.speech import has_words, is_heading, spoken, split_label
from lectern.sources.tables import stage

#: Line numbers of a file that one task reads together; a file of any size is cut into such blocks, joined by their edges.
BLOCK = 2048
#: log-probabilities of a label's form, given the participant: the very form, another that fits; nothing else is possible.
SAME, FITS = 0.0, -0.5
#: Most that the words of a labelled stretch may speak for one participant over another.
WORDS = 6.0
#: A speaker is inferred for lines without a label only at this lead over the next best, in log-probability.
LEAD = 2.0
#: Pseudo-count of the background in a language profile.
SMOOTH = 20.0

_BITS = 1 << 14


def speaker_key(kind: str, label: str, given: frozenset[str], register: Resolver | None = None) -> str:
    """What a label names, the same for all forms of an office, group or numbered voice; names keep their pieces, with
    the member of the register they link to, if any."""
    low = " ".join(label.lower().replace(".", " ").split())
    if kind == "voice":
        return f"v:{int(speech._VOICE.fullmatch(label).group(1))}"
    if kind == "group":
        return "g:members"
    if kind == "office":
        head = "chair" if "chair" in low else "clerk" if "clerk" in low else "attorney-general" if "attorney" in low else "speaker"
        return "o:" + ("temporary " if "temp" in low or "acting" in low else "") + ("deputy " if "deputy" in low else "") + head
    n = names.parse(label, kind, given)
    if n is None:
        return "p:" + low.removeprefix("the ")
    member = register(n) if register else None
    return f"n:{' '.join(n.surnames)}|{' '.join(n.given)}|{n.title}|{n.seat}|{'' if member is None else member}"


def read_key(key: str) -> names.Name | None:
    if not key.startswith("n:"):
        return None
    s, g, t, seat, _ = key[2:].split("|")
    return names.Name(tuple(s.split()), tuple(g.split()), t, seat)


_NEUTRAL = ("", "hon", "honourable", "mhe", "mheshimiwa", "rt")


def same_speaker(a: str, b: str) -> bool:
    """Whether two keys can name one speaker."""
    if a == b:
        return True
    x, y = read_key(a), read_key(b)
    if x is None or y is None:
        return False
    m, n = a.rpartition("|")[2], b.rpartition("|")[2]
    if m and n:
        return m == n
    if x.title != y.title and x.title not in _NEUTRAL and y.title not in _NEUTRAL or x.seat and y.seat and x.seat != y.seat:
        return False
    return names.same_person(x, y)


def _rank(key: str) -> tuple[bool, int]:
    """How much a form tells: more with a member, then by length."""
    return key.startswith("n:") and not key.endswith("|"), len(key)


def _richer(a: str, b: str) -> str:
    return max(a, b, key=_rank)


class _Profiles:
    """Language profiles of the label forms of a block: counts of hashed words, with the block's own as background."""

    def __init__(self, stretches: list[tuple]):
        self.of: dict[str, Counter[int]] = {}
        self.all: Counter[int] = Counter()
        for _, key, words, _ in stretches:
            self.of.setdefault(key, Counter()).update(words)
            self.all.update(words)
        self.n = sum(self.all.values())
        self.size = len(self.all) + 1

    def score(self, keys: list[str], own: list[int], words: list[int]) -> float:
        """Log-likelihood ratio of words by the profile of some forms against the background; the stretch itself, whose
        words ``own`` are in the profile, doesn't count for it."""
        left = Counter(own)
        m = sum(sum(self.of[k].values()) for k in keys) - len(own)
        s = 0.0
        for w in words:
            q = (self.all[w] + 1) / (self.n + self.size)
            s += log((sum(self.of[k][w] for k in keys) - left[w] + SMOOTH * q) / (m + SMOOTH) / q)
        return max(-WORDS, min(WORDS, s))


class _Block:
    """The turns of one block of lines, by the model."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows  # (line, kind, key, said, words)
        self._fits: dict[tuple[str, str], bool] = {}

    def fits(self, a: str, b: str) -> bool:
        if a == b:
            return True
        k = (a, b) if a < b else (b, a)
        got = self._fits.get(k)
        if got is None:
            got = self._fits[k] = same_speaker(a, b)
        return got

    def stretches(self) -> list[tuple]:
        """[(row, key, words, fresh)] of the labelled lines in order; fresh: at the beginning or after a heading."""
        out: list[tuple] = []
        fresh = True
        for i, (_, kind, key, _, words) in enumerate(self.rows):
            if kind == "h":
                fresh = True
            elif key:
                out.append((i, key, list(words), fresh))
                fresh = False
            elif out and not fresh:
                out[-1][2].extend(words)
        return out

    def decode(self, stretches: list[tuple]) -> list[tuple[str, bool]]:
        """(participant, goes on) of each stretch on the most probable path. A participant is the fullest form of name known
        so far; going on, it may become a fuller one that fits. It emits forms that fit and tell no more than itself. A
        change is to one that can't be the participant before."""
        n = len(stretches)
        share = Counter(k for _, k, _, _ in stretches)
        pairs = [(a[1] == b[1]) for a, b in zip(stretches, stretches[1:]) if not b[3]]
        stay = log((sum(pairs) + 1) / (len(pairs) + 2))
        change = log((len(pairs) - sum(pairs) + 1) / (len(pairs) + 2))
        prior = {k: log(c / n) for k, c in share.items()}
        profiles: _Profiles | None = None
        back: list[dict[str, tuple[str, bool]]] = []
        before: dict[str, float] = {}
        for t, (_, key, words, fresh) in enumerate(stretches):
            near = [key] + [stretches[u][1] for u in (t + 1, t + 2) if u < n]
            states = [s for s in dict.fromkeys([*before, *near]) if s == key or self.fits(s, key) and _rank(s) >= _rank(key)]
            emit = {s: SAME if s == key else FITS for s in states}
            # forms that can't be one participant: the words decide as well
            if len(states) > 1 and any(not self.fits(a, b) for i, a in enumerate(states) for b in states[i + 1 :]):
                profiles = profiles or _Profiles(stretches)
                for s in states:
                    kin = [k for k in profiles.of if k == s or k != key and self.fits(k, s)]
                    emit[s] += profiles.score(kin, words if key in kin else [], words)
            top = max(before, key=lambda p: (before[p], p)) if before else ""
            now: dict[str, float] = {}
            come: dict[str, tuple[str, bool]] = {}
            for s in states:
                if fresh or not before:
                    now[s], come[s] = prior[s] + emit[s], (top, False)
                    continue
                best, how = float("-inf"), ("", False)
                for p, v in before.items():
                    if p == s or self.fits(p, s) and _rank(s) >= _rank(p):
                        got = (v + stay + (SAME if p == s else FITS), (p, True))
                    elif not self.fits(p, s):
                        got = (v + change + prior[s], (p, False))
                    else:
                        continue
                    if got > (best, how):
                        best, how = got
                if how[0]:
                    now[s], come[s] = best + emit[s], how
            if not now:
                now[key], come[key] = before[top] + change + prior[key] + emit[key], (top, False)
            back.append(come)
            before = now
        path: list[tuple[str, bool]] = []
        s = max(before, key=lambda p: (before[p], p)) if before else ""
        for come in reversed(back):
            path.append((s, come[s][1]))
            s = come[s][0]
        return path[::-1]

    def run(self) -> tuple[list[list], tuple]:
        """([[first, last, participant, inferred, labelled, last said]], (last line before all, first event, open))."""
        stretches = self.stretches()
        path = dict(zip((i for i, *_ in stretches), self.decode(stretches)))
        turns: list[list] = []
        now, gap = False, None
        prefix_last, first_event = None, ""
        for i, (line, kind, key, said, _) in enumerate(self.rows):
            if kind == "h":
                first_event = first_event or "heading"
                now, gap = False, None
            elif key:
                first_event = first_event or "label"
                who, on = path[i]
                if not on:
                    turns.append([line, line, _richer(who, key), False, True, line if said else None])
                else:
                    turns[-1][2] = _richer(turns[-1][2], _richer(who, key))
                    if said:
                        turns[-1][1] = turns[-1][5] = line
                now, gap = True, None
            elif said:
                if now:
                    turns[-1][1] = turns[-1][5] = line
                elif not first_event:
                    prefix_last = line
                else:
                    if gap is None:
                        gap = [line, line, None, True, False, line]
                        turns.append(gap)
                    gap[1] = gap[5] = line
        return turns, (prefix_last, first_event, now)


def _features(given: frozenset[str], headers: frozenset[str], learned: speech.Learned, with_text: bool, register: Resolver | None):
    """rec_id, file, line, text -> what the model reads of a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[str, int] = {}
        for b in batches:
            kinds, keys, said, words, texts = [], [], [], [], []
            for t in b.column(3).to_pylist():
                kind, label, _, end = split_label(t, given)
                heading = not kind and is_heading(t, headers)
                kinds.append("h" if heading else kind)
                keys.append(speaker_key(kind, label, given, register) if kind else "")
                s = not heading and has_words(t, end, learned)
                said.append(s)
                if with_text:
                    texts.append(spoken(repair(t[end:])[0], 0, learned) if s else "")
                bag = []
                if s:
                    for w in t[end:].lower().split():
                        h = hashes.get(w)
                        if h is None:
                            h = hashes[w] = zlib.crc32(w.encode()) % _BITS
                        bag.append(h)
                words.append(bag)
            if len(hashes) > 500_000:
                hashes.clear()
            cols = [b.column(1), b.column(2), b.column(0), pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(said, pa.bool_()), pa.array(words, pa.list_(pa.int16()))]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(texts, pa.string())] if with_text else []), ["file", "line", "rec_id", "kind", "key", "said", "words"] + (["text"] if with_text else []))

    return run


_PIECE = "file string, block long, kind string, first_line int, last_line int, speaker string, inferred boolean, is_first boolean, is_tail boolean, opens string, id long, said_last int, text string"


def _blocks(with_text: bool):
    """Lines sorted by (file, block, line) -> turns of each block and one row on the block itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: tuple | None = None
        rows: list[tuple] = []
        texts: list[str] = []
        out: list[tuple] = []

        def close() -> None:
            if state is None:
                return
            file, block = state
            m = _Block(rows)
            turns, (prefix_last, event, open_) = m.run()
            said_at = [(r[0], x) for r, x in zip(rows, texts) if r[3]] if with_text else []

            def text(a: int | None, b: int | None) -> str | None:
                return " ".join(x for n, x in said_at if a <= n <= b) if with_text else None

            labelled = [k for k, t in enumerate(turns) if t[4]]
            if prefix_last is not None:
                start = rows[0][0]
                out.append((file, block, "prefix", start, prefix_last, None, False, False, False, event, (block << 24) + 0xFFFFFF, prefix_last, text(start, prefix_last)))
            for k, t in enumerate(turns):
                first = bool(labelled) and k == labelled[0] and event == "label"
                out.append((file, block, "turn", t[0], t[1], t[2], t[3], first, open_ and bool(labelled) and k == labelled[-1], event, (block << 24) + k, t[5], text(t[0], t[1])))
            out.append((file, block, "block", rows[0][0], rows[-1][0], None, False, False, open_, event, None, None, None))
            rows.clear()
            texts.clear()

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[]] * 13
            types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.int32(), pa.string())
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["file", "block", "kind", "first_line", "last_line", "speaker", "inferred", "is_first", "is_tail", "opens", "id", "said_last", "text"])
            out.clear()
            return got

        last = None
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for row in zip(*cols):
                file, block, line, rec = row[0], row[1], row[2], row[3]
                if (file, block) != state:
                    close()
                    state, last = (file, block), None
                if (line, rec) == last:
                    continue  # delivered again
                last = (line, rec)
                rows.append((line, row[4], row[5], row[6], row[7]))
                if with_text:
                    texts.append(row[8])
            yield batch()
        close()
        yield batch()

    return run


def infer(found: DataFrame) -> DataFrame:
    """``found(file, first_line, last_line, speaker, inferred, text)`` with speakers given to turns without a label, where
    the model has one at LEAD over the next best.

    Profiles are of all labelled turns of a file with such a gap, its words weighed against the file's own; transitions
    are learned from neighbouring labelled turns of the file. The path through gaps that follow each other is decoded as a
    whole (Viterbi), in runs of at most 4,096 gaps. All but that last step are joins and aggregates.
    """
    gap = F.col("speaker").isNull() & F.col("inferred")
    words = F.explode(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != ""))
    holes = stage(found.filter(gap).select("file").distinct(), "holes")
    n = holes.count()
    if not n:
        return found
    # files with gaps: broadcast up to so many names, else joined
    mine = found.join(F.broadcast(holes) if n <= 100_000 else holes, "file", "left_semi")
    # each gap's words, and each participant's: counts, sizes
    said = mine.filter("speaker is not null").select("file", "speaker", words.alias("w")).groupBy("file", "speaker", "w").agg(F.count("*").alias("c"))
    size = said.groupBy("file", "speaker").agg(F.sum("c").alias("m"))
    back = said.groupBy("file", "w").agg(F.sum("c").alias("q"))
    whole = back.groupBy("file").agg((F.sum("q") + F.count("*") + 1).alias("all"))
    asked = mine.filter(gap).select("file", "first_line", words.alias("w")).groupBy("file", "first_line", "w").agg(F.count("*").alias("k"))
    asked = asked.join(back, ["file", "w"]).join(whole, "file").withColumn("p", (F.col("q") + 1) / F.col("all"))
    # a participant that never said a word has a score by its size alone, so these sums are over words it did say
    plain = F.log(F.lit(SMOOTH) / (F.col("m") + SMOOTH))
    extra = asked.join(said, ["file", "w"]).groupBy("file", "first_line", "speaker").agg(F.sum(F.col("k") * F.log1p(F.col("c") / (SMOOTH * F.col("p")))).alias("e"))
    long = asked.groupBy("file", "first_line").agg(F.sum("k").alias("k"))
    score = mine.filter(gap).select("file", "first_line").join(size, "file").join(long, ["file", "first_line"], "left").join(extra, ["file", "first_line", "speaker"], "left")
    score = score.select("file", "first_line", "speaker", (F.coalesce("k", F.lit(0)) * plain + F.coalesce("e", F.lit(0.0))).alias("s"))
    # only participants within reach of the best can be on the path
    w = Window.partitionBy("file", "first_line")
    score = score.withColumn("top", F.max("s").over(w)).filter(F.col("s") > F.col("top") - 30).drop("top")
    options = score.groupBy("file", "first_line").agg(F.collect_list(F.struct("speaker", "s")).alias("options"))
    # transitions of neighbouring labelled turns
    line = Window.partitionBy("file").orderBy("first_line")
    chain = mine.withColumn("prev", F.lag("speaker").over(line)).withColumn("next", F.lead("speaker").over(line))
    jumps = chain.filter("speaker is not null and prev is not null").groupBy("file", "prev", "speaker").agg(F.count("*").alias("j")).withColumnRenamed("speaker", "to")
    chain = chain.withColumn("_run", F.sum(F.when(F.col("speaker").isNotNull(), 1).otherwise(0)).over(line)).filter(gap)
    chain = chain.withColumn("_part", F.floor((F.row_number().over(Window.partitionBy("file", "_run").orderBy("first_line")) - 1) / 4096))
    step = chain.select("file", "_run", "_part", "first_line", "prev", "next").join(options, ["file", "first_line"])
    near = F.collect_set(F.struct("prev", "to", "j"))
    who = step.select("file", "_run", "_part", "first_line", F.explode("options.speaker").alias("to")).distinct()
    into = who.join(jumps, ["file", "to"]).groupBy("file", "_run", "_part").agg(near.alias("jumps"))
    ends = step.filter("next is not null").select("file", "_run", "_part", F.col("next").alias("to")).distinct().join(jumps, ["file", "to"]).groupBy("file", "_run", "_part").agg(near.alias("last"))
    runs = step.join(into, ["file", "_run", "_part"], "left").join(ends, ["file", "_run", "_part"], "left")
    got = runs.groupBy("file", "_run", "_part").applyInPandas(_decode_gaps, "file string, first_line int, who string")
    put = found.filter(gap).join(got, ["file", "first_line"], "left").select("file", "first_line", "last_line", F.col("who").alias("speaker"), "inferred", "text")
    return found.filter(~gap).unionByName(put)


def _decode_gaps(df: pd.DataFrame) -> pd.DataFrame:
    """The most probable speakers of gaps that follow each other, from their options and the transitions."""
    df = df.sort_values("first_line")
    jump: Counter[tuple[str, str]] = Counter()
    for col in ("jumps", "last"):
        for row in df[col]:
            for x in row if row is not None else ():
                jump[x["prev"], x["to"]] = x["j"]
    total = sum(jump.values()) + 1
    go = lambda a, b: log((jump[a, b] + 0.5) / total) if a and b else 0.0
    rows = list(df.itertuples(index=False))
    at: list[dict[str, tuple[float, str]]] = []
    for i, r in enumerate(rows):
        now = {}
        for o in r.options:
            s = o["speaker"]
            came = max(((v[0] + go(p, s), p) for p, v in at[-1].items()), default=(0.0, "")) if i else (go(r.prev, s), "")
            now[s] = (came[0] + o["s"], came[1])
        at.append(now)
    last = rows[-1].next
    final = sorted(((v[0] + go(s, last), s) for s, v in at[-1].items()), reverse=True)
    s = final[0][1]
    out = []
    for i in range(len(rows) - 1, -1, -1):
        own = sorted((o["s"] for o in rows[i].options), reverse=True)
        # the lead of the words, or, of the last one, of the whole path
        lead = own[0] - own[1] if len(own) > 1 else LEAD
        if i == len(rows) - 1 and len(final) > 1:
            lead = max(lead, final[0][0] - final[1][0])
        if lead >= LEAD:
            out.append((rows[i].file, rows[i].first_line, s))
        s = at[i][s][1]
    return pd.DataFrame(out, columns=["file", "first_line", "who"]).astype({"first_line": "int32"})


def turns(
    records: DataFrame, given: frozenset[str], headers: frozenset[str], with_text: bool = True, register: Resolver | DataFrame | None = None,
    learned: speech.Learned | None = None,
) -> DataFrame:
    """(file, first_line, last_line, speaker, inferred, text): the ordered turns of each file.

    ``records(rec_id, file, line, text)``; ``register`` the known people, if any: in memory, or as links(key, member_id) of
    label keys, which are joined; ``learned`` the page furniture, by default read from the records. Rows delivered again
    count once, rows without a file or line are left out, a null text is a line without words. A turn opens at a label and goes on to a label of another speaker or a heading;
    ``inferred`` marks turns without a label of their own, whose speaker the model gives where it can (else null).
    ``last_line`` is the last line with spoken words. ``text`` has label, annotations, fillers, timestamps and furniture
    taken out. ``with_text`` False leaves it null and unread, and speakers of turns without a label unknown.
    """
    learned = furniture.learn(records) if learned is None else learned
    lines = records.filter("file is not null and line is not null").select("rec_id", "file", "line", "text")
    cols = "file string, line int, rec_id long, kind string, key string, said boolean, words array<short>" + (", text string" if with_text else "")
    known = register if isinstance(register, Resolver) else None
    feats = lines.mapInArrow(_features(given, headers, learned, with_text, known), cols)
    if register is not None and known is None:
        links = register.select(F.concat(F.lit("n:"), "key", F.lit("|")).alias("key"), "member_id")
        feats = feats.join(links, "key", "left").withColumn("key", F.concat("key", F.coalesce(F.col("member_id").cast("string"), F.lit("")))).drop("member_id")
    feats = feats.withColumn("block", F.floor(F.col("line") / BLOCK))
    order = ["file", "block", "line", "rec_id"]
    sorted_ = feats.repartition("file", "block").sortWithinPartitions(*order).select("file", "block", "line", "rec_id", "kind", "key", "said", "words", *(["text"] if with_text else []))
    pieces = stage(sorted_.mapInArrow(_blocks(with_text), _PIECE), "turns")

    # Blocks are joined by their edges only: what is open at a block's end, and how the next one begins.
    @F.pandas_udf("boolean")
    def same(a, b):
        return a.combine(b, lambda x, y: bool(x) and bool(y) and same_speaker(x, y))

    w = Window.partitionBy("file").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    tail = pieces.filter("kind = 'turn' and is_tail").select("file", "block", F.col("id").alias("tail_id"), F.col("speaker").alias("tail"), F.col("is_first").alias("tail_first"))
    head = pieces.filter("kind = 'turn' and is_first").select("file", "block", F.col("speaker").alias("head"))
    edge = pieces.filter("kind = 'block'").select("file", "block", "opens").join(tail, ["file", "block"], "left").join(head, ["file", "block"], "left")
    edge = edge.withColumn("state", F.when(F.col("opens") != "", F.struct(F.col("tail"), F.col("tail_id"))))
    edge = edge.withColumn("carried", F.last("state", ignorenulls=True).over(before))
    edge = edge.withColumn("linked", (F.col("opens") == "label") & F.coalesce(same("carried.tail", "head"), F.lit(False)))
    edge = edge.withColumn("own_root", F.when(F.col("opens") != "", F.when(F.coalesce("tail_first", F.lit(False)) & F.col("linked"), F.lit(None)).otherwise(F.struct(F.col("tail_id").alias("id")))))
    edge = edge.withColumn("root", F.last("own_root", ignorenulls=True).over(before)["id"])
    edge = edge.select("file", "block", "root", "linked").filter("root is not null")
    put = pieces.filter("kind <> 'block'").join(edge, ["file", "block"], "left")
    # the part before the first label of a file belongs to no labelled turn
    put = put.withColumn("turn", F.when((F.col("kind") == "prefix") | F.col("is_first") & F.col("linked"), F.col("root")))
    put = put.withColumn("turn", F.coalesce("turn", "id"))
    got = put.groupBy("file", "turn").agg(
        F.min("first_line").alias("first_line"), F.max(F.when(F.col("is_first") & F.col("linked"), F.col("said_last")).otherwise(F.col("last_line"))).alias("last_line"), F.min_by("speaker", "first_line").alias("speaker"),
        F.min(F.when(F.col("kind") == "turn", F.col("inferred")).otherwise(F.lit(True))).alias("inferred"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("first_line", "text")))), lambda x: x["text"]), " ").alias("text"),
    )
    if with_text:
        return infer(stage(got.select("file", "first_line", "last_line", "speaker", "inferred", "text"), "found"))
    return got.select("file", "first_line", "last_line", "speaker", "inferred", F.lit(None).cast("string").alias("text"))
