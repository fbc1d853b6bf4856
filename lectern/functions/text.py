"""Column functions on text. Null in, null out, unless said otherwise; all run inside whole-stage codegen."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import patterns as P


def strip(c: Column) -> Column:
    """Without white space and separators (0x1c-0x1f) at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"))


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to, longer): letters below U+2100 and ligatures whose compatibility decomposition has one ASCII
    character, and those with more; made from the Unicode tables by rule."""
    a, b, longer = [], [], []
    for cp in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2050), 0x2122, *range(0xFB00, 0xFB07)]:
        s = unicodedata.normalize("NFKD", chr(cp)).encode("ascii", "ignore").decode()
        if len(s) == 1:
            a.append(chr(cp))
            b.append(s)
        elif len(s) > 1:
            longer.append((chr(cp), s))
    return "".join(a), "".join(b), tuple(longer)


def ascii_fold(c: Column) -> Column:
    """Accents taken off, other non-ASCII characters dropped (compatibility decomposition; JVM-side)."""
    a, b, longer = fold_table()
    wide = F.translate(c, a, b)
    for x, y in longer:
        wide = F.replace(wide, F.lit(x), F.lit(y))
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.regexp_replace(wide, r"[^\x00-\x7F]", ""))


@F.pandas_udf(T.StringType())
def ascii_fold_exact(s: pd.Series) -> pd.Series:
    """As ``ascii_fold``, by the full Unicode tables, in Arrow batches."""
    return s.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def decode_bytes(c: Column) -> Column:
    """Bytes as text: UTF-8 where they are valid as that, else Windows-1252; a byte that one leaves undefined stays the
    control character of its number, so every input decodes."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    wrong, right = ("".join(x) for x in zip(*[p for p in pairs if p[1]]))
    text = c.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.translate(F.decode(c, "ISO-8859-1"), wrong, right))


def clean_text(c: Column) -> Column:
    """Ends stripped, blanks and tabs as one blank, leading ) and : dropped; a lone ( is nothing."""
    s = F.regexp_replace(F.regexp_replace(strip(c), r"[ \t]+", " "), r"^[):]+", "")
    return F.when(s == "(", "").otherwise(s)


def rm_punct(c: Column) -> Column:
    return F.regexp_replace(c, P.PUNCT, "")


def rm_wrapping_punct(c: Column) -> Column:
    """Without the signs of punctuation at both ends, if both ends have one; no line break may lie between."""
    return F.regexp_replace(c, rf"^{P.PUNCT}(.*){P.PUNCT}\z", "$1")


def clean_speaker_name(c: Column) -> Column:
    return rm_wrapping_punct(F.regexp_replace(c, r"\s+", " "))


def is_punct(c: Column, stripped: bool = False) -> Column:
    """Only signs of punctuation, or nothing."""
    return F.rlike(strip(c) if stripped else c, F.lit(rf"^{P.PUNCT}*\z"))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, P.TAGS, "")


def tags(c: Column) -> Column:
    """Sorted distinct names of the tags in a text."""
    names = F.transform(F.regexp_extract_all(c, F.lit(P.TAGS), F.lit(0)), lambda t: F.lower(F.regexp_replace(t, P.TAG_NOISE, "")))
    return F.array_sort(F.array_distinct(F.filter(names, lambda t: t != "")))


def tag_whitespace(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<"), F.lit(" <")), F.lit(">"), F.lit("> "))


def parenth_name(c: Column, at_begin: bool = True) -> Column:
    """(inside, outside) of a name in brackets before a colon, or at the end; both are the text where there is none."""
    p = r"(?s)^\s*(\(.+\))\s*:\s*(.*)" if at_begin else r"(?s)^\s*(.*)\s*\((.+)\)"
    i, o = (1, 2) if at_begin else (2, 1)
    hit = F.rlike(c, F.lit(p))
    inside = F.regexp_replace(F.regexp_extract(c, p, i), r"^[\s\x1c-\x1f]+", "")
    return F.struct(F.when(hit, inside).otherwise(c).alias("inside"), F.when(hit, strip(F.regexp_extract(c, p, o))).otherwise(c).alias("outside"))


def span2bio(length: Column, start: Column, end: Column) -> Column:
    """One letter for each character: B at ``start``, I up to ``end`` (exclusive), O elsewhere; all O without a span."""
    some = start.isNotNull() & end.isNotNull() & (end > start)
    o = lambda n: F.repeat(F.lit("O"), F.greatest(n.cast("int"), F.lit(0)))
    return F.when(some, F.concat(o(start), F.lit("B"), F.repeat(F.lit("I"), (end - start - 1).cast("int")), o(length - end))).otherwise(o(length))


def bio2span(c: Column) -> Column:
    """(start, end) of the first run of B and I; nulls if there is none."""
    lead = F.char_length(F.regexp_extract(c, "^([^BI]*)[BI]", 1))
    n = F.char_length(F.regexp_extract(c, "([BI]+)", 1))
    some = F.rlike(c, F.lit("[BI]"))
    return F.struct(F.when(some, lead).alias("start"), F.when(some, lead + n).alias("end"))


def spaced(c: Column) -> Column:
    """Characters set apart by blanks."""
    return F.array_join(F.filter(F.split(c, ""), lambda x: x != ""), " ")


def has_speaker(bio: Column) -> Column:
    return F.rlike(bio, F.lit("[BI]")).cast("int")


def bio_codes(c: Column) -> Column:
    """B, I and O as token ids 2, 3 and 4, ended by 1."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.when(x == "B", 2).when(x == "I", 3).otherwise(4))
    return F.concat(codes, F.array(F.lit(1)))


def bio_decode(codes: Column) -> Column:
    """The letters of ``bio_codes``, up to the end sign; other codes are left out."""
    upto = F.when(F.array_contains(codes, 1), F.slice(codes, F.lit(1), F.greatest(F.array_position(codes, 1).cast("int") - 1, F.lit(0)))).otherwise(codes)
    return F.array_join(F.filter(F.transform(upto, lambda x: F.when(x == 2, "B").when(x == 3, "I").when(x == 4, "O")), lambda x: x.isNotNull()), "")


def encode_chars(c: Column, context: Column | None = None) -> Column:
    """Character ids (code + 3) ended by 1; a context follows after the separator 2, which takes the place of that end."""
    ids = lambda x: F.transform(F.filter(F.split(x, ""), lambda y: y != ""), lambda y: F.ascii(y) + 3)
    if context is None:
        return F.concat(ids(c), F.array(F.lit(1)))
    return F.concat(ids(c), F.array(F.lit(2)), ids(context), F.array(F.lit(1)))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def base64_text(c: Column) -> Column:
    """Base64 of a text's UTF-8 bytes, without line ends."""
    return F.replace(F.base64(F.encode(c, "UTF-8")), F.lit("\r\n"), F.lit(""))


def disposition_filename(c: Column) -> Column:
    """File name in a Content-Disposition header; null without one."""
    return F.nullif(F.regexp_extract(c, r"(?i)filename\s*=\s*\"?([^\";]+)\"?", 1), F.lit(""))


def filetype(path: Column) -> Column:
    """What follows the last dot, in small letters; null unless txt or pdf."""
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    return F.when(ext.isin("txt", "pdf"), ext)


def truncate(text: Column, context: Column, limit: int = P.MAX_CHARS) -> Column:
    """(text, context) within ``limit`` characters: a longer text loses its context, else the context is cut."""
    n = F.char_length(text)
    return F.struct(F.substring(text, 1, limit).alias("text"), F.when(n > limit, "").otherwise(F.left(context, F.lit(limit) - n)).alias("context"))


# What a lone letter a before is always one word with; the apostrophe that scanning set apart.
_A_WORDS = ("mend", "id", "rid", "ward", "broad")
_APOSTROPHE = r"(.) ' ([A-z])([A-z]) ([A-z]+)"
_CLOSING = r"[!),.:;?\]}]"


def fix_header_words(c: Column, dictionary: frozenset[str] | set[str] | list[str] = frozenset()) -> Column:
    """The words of a heading in small letters put right, JVM-side: signs and single letters that scanning set apart go
    back to their words, blanks around hyphens and brackets are made even, one follows a closing sign.

    A single letter waits for the next word and goes before it; s after an apostrophe and lone signs go to the word before.
    The letter a goes forward only to one of a few words or to what is not in ``dictionary``, else back to a word that is
    not in it, else it stays. The dictionary becomes a literal: give it the words that headings use, not a whole language.
    Null gives null, blank text the empty one.
    """
    known = F.array(*(F.lit(w) for w in sorted(dictionary))) if dictionary else F.array().cast("array<string>")
    starts = F.array(*(F.lit(w) for w in _A_WORDS))
    nothing = F.lit(None).cast("string")

    def glue(done: Column, w: Column) -> Column:
        return F.concat(F.coalesce(done, F.lit("")), w)

    def follow(done: Column, w: Column) -> Column:
        return F.when(done.isNull(), w).otherwise(F.concat(done, F.lit(" "), w))

    def state(done: Column, waiting: Column = nothing) -> Column:
        return F.struct(done.alias("done"), waiting.alias("waiting"))

    def core(w: Column) -> Column:
        return F.regexp_replace(w, r"\W", "")

    def settle(done: Column, letter: Column) -> Column:
        """A waiting letter that no word takes."""
        back = (core(letter) == "a") & done.isNotNull() & ~F.array_contains(known, F.substring_index(done, " ", -1))
        return F.when(back, glue(done, letter)).otherwise(follow(done, letter))

    def read(done: Column, w: Column) -> Column:
        single = (F.char_length(core(w)) == 1) & ~F.rlike(w, F.lit(rf".{_CLOSING}$"))
        to_last = w.isin("'", "-") | single & (core(w) == "s") & done.endswith("'")
        return F.when(done.isNotNull() & to_last, state(glue(done, w))).when(single, state(done, w)).otherwise(state(follow(done, w)))

    def step(s: Column, w: Column) -> Column:
        done, letter = s["done"], s["waiting"]
        takes = (core(letter) != "a") | F.array_contains(starts, w) | ~F.array_contains(known, w)
        return F.when(letter.isNull(), read(done, w)).when(takes, state(follow(done, F.concat(letter, w)))).otherwise(read(settle(done, letter), w))

    words = F.split(F.regexp_replace(strip(F.lower(c)), _APOSTROPHE, r"$1'$2 $3$4"), r"\s+")
    text = F.aggregate(words, state(nothing), step, lambda s: F.when(s["waiting"].isNull(), s["done"]).otherwise(settle(s["done"], s["waiting"])))
    text = F.regexp_replace(text, rf"(?<=[-(\[{{]) | (?=-|{_CLOSING})", "")
    return F.regexp_replace(text, rf"(?<={_CLOSING})(?=\w)", " ")
