"""Sentence boundaries in many languages and scripts.

Method: abbreviations, what follows them (collocations) and sentence starters are learned without labels, per
language, by log-likelihood ratios over counts of the whole corpus; each period is then classified with them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.sources.tables import stage

#: Bound of what the model may hold: only types that pass the tests reach the driver, whatever their share of the corpus;
#: more of them than this are an error, none is left out in silence.
MOST = 2_000_000
#: Times two words must meet at a period at least to be tested as a collocation.
EVIDENCE = 5
#: Log-likelihood ratio from which two events are taken as dependent (0.5 % level of chi square, one degree).
DEPENDENT = 7.88

PARAGRAPH = re.compile(r"(?:\r\n|\r|\n)[ \t 　]*(?:\r\n|\r|\n)\s*")
_SCRIPTS = re.compile("([ऀ-ॿ])|([ሀ-፿])|([؀-ۿ])|([฀-๿])|([぀-ヿ一-鿿])|([Ѐ-ӿ])")
_SCRIPT_NAMES = ("deva", "ethi", "arab", "thai", "hani", "cyrl")
# Frequent function words that tell the Latin-script languages apart.
FUNCTION_WORDS = {"en": (" the ", " of ", "The "), "fr": (" de ", " les ", " le ", "à "), "sw": (" ya ", " wa ", " na ", " kwa ", " la ")}

_TERM = re.compile("(?:[.!?…。！？｡؟።፧।॥۔]|፡፡)+")
_CLOSE = re.compile("(?:[\"”’»)\\]」』】〉》]|[ \\u00a0\\n\\r]+»)*")
_NEXT = re.compile("[\\s\\u3000]*([“\"«(\\[‘「『]*)\\s*([^\\s]?)")
_WORD = re.compile(r"[^\W\d_][\w'’]*")
_OPENERS, _CLOSERS = "“«「『", {"“": "”", "«": "»", "「": "」", "『": "』"}
_QUOTES = re.compile("[“”«»「」『』]")


_OTHER = re.compile("[\u0400-\u04ff\u0600-\u06ff\u0900-\u097f\u0e00-\u0e7f\u1200-\u137f\u3040-\u30ff\u4e00-\u9fff]")


def language(paragraph: str) -> str:
    """The language (Latin script) or script of a paragraph, by its letters and function words."""
    if not paragraph.isascii() and (m := _OTHER.search(paragraph)):
        n = Counter(x.lastindex for x in _SCRIPTS.finditer(paragraph))
        k, c = n.most_common(1)[0]
        if c * 4 >= len(paragraph):
            return _SCRIPT_NAMES[k - 1]
    n = paragraph.count
    en, fr, sw = (sum([n(w) for w in words]) for words in FUNCTION_WORDS.values())
    return "en" if en >= fr and en >= sw else "fr" if fr >= sw else "sw"


_AT_PERIOD = re.compile("\\.[)”\"’»\\]]*\\s+[“\"«(‘]*(\\S)([\\w'’]*)(\\.?)")


def _token(p: str, end: int) -> str:
    """The token that ends at ``end``, without opening marks."""
    return p[p.rfind(" ", 0, end) + 1 : end].rpartition("\n")[2].lstrip("(“«\"‘[\t\r\u00a0\u3000")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter[tuple[str, str, str]] = Counter()
    whole: dict[str, Counter[str]] = {}

    def out() -> pa.RecordBatch:
        for lang, c in whole.items():
            for tok, k in c.items():
                t = tok.strip("()[]“”«»\"',;:!?…")
                if t.endswith("."):
                    t = t[:-1]
                    if t:
                        n[lang, "period", t] += k
                elif t:
                    n[lang, "plain", t] += k
        cols = list(zip(*((*key, v) for key, v in n.items()))) if n else [[]] * 4
        b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "kind", "key", "n"])
        n.clear()
        whole.clear()
        return b

    for b in batches:
        for t in b.column(0).to_pylist():
            if not t:
                continue
            for p in PARAGRAPH.split(t):
                lang = language(p)
                whole.setdefault(lang, Counter()).update(p.split())
                for m in _AT_PERIOD.finditer(p):
                    tok = _token(p, m.start())
                    c, rest, dot = m.groups()
                    kind = "digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.islower() else "other"
                    n[lang, kind, tok] += 1
                    if kind == "upper" and len(tok) > 3 and tok.isalpha() and tok.islower():
                        n[lang, "start", c + rest] += 1
                    if dot and kind == "upper" and len(tok) <= 6:
                        n[lang, "pair", f"{tok} {c}{rest}"] += 1
        if len(n) + sum(map(len, whole.values())) > 400_000:
            yield out()
    yield out()


def likelihood_ratio(a: float, na: float, b: float, nb: float) -> float:
    """Dunning's log-likelihood ratio that the share a of na differs from the share b of nb."""

    def ll(k: float, n: float, p: float) -> float:
        p = min(max(p, 1e-12), 1 - 1e-12)
        return k * log(p) + (n - k) * log(1 - p)

    if na <= 0 or nb <= 0:
        return 0.0
    p = (a + b) / (na + nb)
    return 2 * (ll(a, na, a / na) + ll(b, nb, b / nb) - ll(a, na, p) - ll(b, nb, p))


def _ratio(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """``likelihood_ratio`` of columns."""

    def ll(k: Column, n: Column, p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(p) + (n - k) * F.log(1 - p)

    p = (a + b) / (na + nb)
    return F.when((na > 0) & (nb > 0), 2 * (ll(a, na, a / na) + ll(b, nb, b / nb) - ll(a, na, p) - ll(b, nb, p))).otherwise(0.0)


Model = dict[str, dict[str, dict[str, tuple[float, float]] | frozenset[str]]]


def learn(documents: DataFrame) -> Model:
    """Per language: abbreviations with (share followed by a number, share followed by a capital that starts no
    sentence), collocations and sentence starters. Counts cover all documents, and every type seen twice is tested, by
    the executors; those that pass are collected."""
    counts = documents.select("text").filter("text is not null").mapInArrow(_count, "lang string, kind string, key string, n long")
    counts = counts.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    kinds = ("period", "plain", "digit", "upper", "lower", "other", "start", "pair")
    by_key = stage(counts.groupBy("lang", "key").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in kinds)), "types")
    totals = by_key.groupBy("lang").agg(F.sum("period").alias("tp"), (F.sum("period") + F.sum("plain")).alias("tn"), F.sum("start").alias("ts"))  # a row per language
    c = F.col
    t = by_key.join(F.broadcast(totals), "lang")
    # starters: begin sentences more than they come up
    starter = (c("start") > 1) & (_ratio(c("start"), c("ts"), c("plain"), c("tn")) > DEPENDENT) & (c("start") / F.greatest("ts", F.lit(1)) > c("plain") / F.greatest("tn", F.lit(1)))
    # abbreviations: end in a period more than words do, the longer the less easily, less so if also without one; or what
    # follows goes on with the sentence
    seen, letters = c("period") + c("plain"), F.char_length(F.replace("key", F.lit("."), F.lit("")))
    dots = F.char_length("key") - letters
    score = _ratio(c("period"), seen, c("tp") - c("period"), c("tn") - seen) * F.exp(-letters) * (dots + 1) * F.pow(F.greatest(letters, F.lit(1)), -F.least(c("plain"), F.lit(60)))
    follow = c("digit") + c("upper") + c("lower") + c("other")
    goes_on = (follow > 0) & (letters <= 6) & ((c("digit") + c("lower")) / follow > F.when(c("period") > 3 * c("plain"), 0.5).otherwise(0.8))
    short = (c("period") > 1) & ~F.rlike("key", F.lit(r"^\d+$")) & (c("period") / seen >= c("tp") / F.greatest("tn", F.lit(1))) & ((score >= 0.3) | goes_on)
    t = t.select("lang", "key", starter.alias("starter"), short.alias("short"), (F.when(follow > 0, c("digit") / follow).otherwise(0.0)).alias("digit"), (F.when(follow > 0, c("upper") / follow).otherwise(0.0)).alias("upper"))
    # collocations: the second word follows the first one's period more than others do
    up = by_key.filter("upper > 0").select("lang", "key", "upper")
    pairs = by_key.filter(F.col("pair") >= EVIDENCE).select("lang", "pair", F.substring_index("key", " ", 1).alias("x"), F.substring_index("key", " ", -1).alias("y"))
    pairs = pairs.join(up.select("lang", F.col("key").alias("x"), F.col("upper").alias("ux")), ["lang", "x"], "left").join(up.select("lang", F.col("key").alias("y"), F.col("upper").alias("uy")), ["lang", "y"], "left")
    pairs = pairs.join(F.broadcast(totals), "lang").withColumn("ux", F.coalesce("ux", "pair"))
    pairs = pairs.filter((c("pair") >= 0.5 * c("ux")) & (_ratio(c("pair"), c("ux"), F.coalesce("uy", F.lit(0)), c("tp")) > DEPENDENT))
    found = t.filter("starter or short").limit(MOST + 1).collect()
    together = pairs.select("lang", "x", "y").limit(MOST + 1).collect()
    if max(len(found), len(together)) > MOST:
        raise ValueError(f"more than {MOST} abbreviations, starters or collocations")
    model: Model = {r.lang: {"abbreviations": {}, "starters": set(), "collocations": set()} for r in totals.collect()}
    for r in found:
        if r.short:
            model[r.lang]["abbreviations"][r.key] = (r.digit, r.upper)
        if r.starter:
            model[r.lang]["starters"].add(r.key)
    for r in together:
        model[r.lang]["collocations"].add((r.x, r.y))
    return model


def _quoted(p: str) -> list[tuple[int, int]]:
    """Spans (open, after close) of quotations that are closed in the paragraph."""
    out, stack = [], []
    for m in _QUOTES.finditer(p):
        c = m.group()
        if c in _OPENERS:
            stack.append((c, m.start()))
        elif stack and _CLOSERS[stack[-1][0]] == c:
            _, s = stack.pop()
            if not stack:
                out.append((s, m.end()))
    return out


def _thai(p: str, base: int, out: list[tuple[int, int]]) -> None:
    at, quotes = 0, _quoted(p)
    for m in re.finditer(r"\s+", p):
        s, e = m.span()
        if s and e < len(p) and (p[s - 1].isdigit() or p[e].isdigit()) or any(a < s < b for a, b in quotes):
            continue
        _add(p, at, s, base, out)
        at = e
    _add(p, at, len(p), base, out)


def _add(p: str, s: int, e: int, base: int, out: list[tuple[int, int]]) -> None:
    while s < e and p[s].isspace():
        s += 1
    while e > s and p[e - 1].isspace():
        e -= 1
    if e > s:
        out.append((base + s, base + e))


_NOTHING: dict = {"abbreviations": {}, "starters": frozenset(), "collocations": frozenset()}
# A possible end of a sentence in Latin script: a stop, white space, and no small letter.
_CANDIDATE = re.compile("(?<![.!?…])([.!?…]++)((?:[\"”’»)\\]]|[ \\u00a0\\n\\r]+»)*)\\s+([“\"«\\[‘(]*)\\s*([^\\sa-z])")


def _paragraph(p: str, base: int, model: Model, out: list[tuple[int, int]]) -> None:
    lang = language(p)
    if lang == "thai":
        return _thai(p, base, out)
    own = model.get(lang, _NOTHING)
    quotes = _quoted(p) if "“" in p or "«" in p or "「" in p or "『" in p else []
    ends = [b for _, b in quotes]
    at, n = 0, len(p)
    if lang in FUNCTION_WORDS and not _OTHER.search(p):
        for m in _CANDIDATE.finditer(p):
            s, e = m.span(1)
            stop = m.end(2)
            if quotes:
                k = bisect_right(ends, s)
                if k < len(quotes) and quotes[k][0] < s and stop < quotes[k][1]:
                    continue
            nxt = m.group(4)
            if e - s == 1 and p[s] == "." and stop == e and nxt.isupper() and not m.group(3):
                tok = _token(p, s)
                if len(tok) > 4 and tok.isalpha() and tok not in own["abbreviations"]:
                    _add(p, at, stop, base, out)
                    at = stop
                    continue
            if _ends(p, s, e, stop, own):
                _add(p, at, stop, base, out)
                at = stop
        return _add(p, at, n, base, out)
    m = _TERM.search(p)
    while m:
        s, e = m.span()
        stop = _CLOSE.match(p, e).end()
        if stop >= n:
            break
        inside = False
        if quotes:
            k = bisect_right(ends, s)
            inside = k < len(quotes) and quotes[k][0] < s and stop < quotes[k][1]
        if not inside and _ends(p, s, e, stop, own):
            _add(p, at, stop, base, out)
            at = stop
        m = _TERM.search(p, max(e, stop))
    _add(p, at, n, base, out)


def _ends(p: str, s: int, e: int, stop: int, own: dict) -> bool:
    """Whether the stop at p[s:e], with closing marks up to ``stop``, ends a sentence (something follows it)."""
    abbreviations, starters = own["abbreviations"], own["starters"]
    term = p[s:e]
    spaced = p[stop].isspace()
    m = _NEXT.match(p, stop)
    nxt, at = m.group(2), m.start(2)
    if not nxt:
        return True
    cased = nxt.isupper() or nxt.islower()
    closed = stop > e
    if term[-1] not in ".!?…":  # stops of scripts without capitals
        return not closed or cased and nxt.isupper() or bool(m.group(1))
    period = term == "."
    if not spaced:
        if cased or nxt.isdigit() or nxt in ",;:-–—/":
            return False
        if period and (p[s - 1 : s].isdigit() or not nxt.isalpha()):
            return False
        if not nxt.isalpha() and not m.group(1):
            return False
    if nxt.islower():
        # only a marked point that opens with a capital starts a sentence here
        if "(" in m.group(1):
            x = re.match(r"[a-z0-9]{1,3}\)\s+(\S)", p[at:at + 12])
            if not (x and x.group(1).isupper()):
                return False
        else:
            return False
    if nxt in ",;:-–—)":
        return False
    if not period:
        return cased or nxt.isdigit() or not closed or bool(m.group(1))
    # a period: what stands before it?
    tok = _token(p, s)
    if not cased and not nxt.isdigit() and "(" not in m.group(1) and not m.group(1):
        if closed and stop > e and p[e:stop].strip(")]"):
            return False
        return tok not in abbreviations and len(tok) > 1 and "." not in tok
    if closed and p[e:stop].strip(")]’ "):
        return True  # after a closed quotation, before a capital or number
    initial = len(tok) == 1 and tok.isupper() or bool(re.fullmatch(r"(?:[A-Z]\.)+[A-Z]", tok))
    digit, upper = abbreviations.get(tok) or tok.isupper() and (abbreviations.get(tok.capitalize()) or abbreviations.get(tok.lower())) or (-1.0, -1.0)
    known = digit >= 0
    if not known and not initial and "." not in tok:
        return True
    if tok.replace(".", "").isdigit():
        return True
    if nxt.isdigit():
        return not initial and (digit < 0.5 if known else False)
    w = _WORD.match(p, at)
    word = w.group() if w else nxt
    if m.group(1) or nxt == "(":
        return True
    if len(word) == 1 and p[at + 1 : at + 2] == "." and word.isupper():
        return False  # initials of a name
    if word in starters:
        return (tok, word) not in own["collocations"]
    return False


def sentences(text: str | None, model: Model) -> list[tuple[int, int]]:
    """(start, end) of each sentence, in code points; [] for null, empty and blank text."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    at = 0
    for m in PARAGRAPH.finditer(text):
        if m.start() > at:
            _paragraph(text[at : m.start()], at, model, out)
        at = m.end()
    if at < len(text):
        _paragraph(text[at:], at, model, out)
    return out


def split_sentences(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, start_char, end_char) of each sentence of ``documents(doc_id, text)``.

    Offsets count code points, the end exclusive, white space at the ends left out. Null, empty and blank texts give
    no row; repeated texts give rows each. Languages are read from the text; a lang column is not used.
    """
    model = learn(documents) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, ends = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = sentences(t, model)
                ids += [i] * len(got)
                starts += [s for s, _ in got]
                ends += [e for _, e in got]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "start_char", "end_char"])

    return documents.select("doc_id", "text").filter("text is not null").mapInArrow(run, "doc_id long, start_char int, end_char int")
