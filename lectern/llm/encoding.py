"""Text decoded with the wrong character encoding: find it and give the characters back.

Method: round trips. Runs of non-ASCII characters are encoded again under candidate legacy encodings and strictly
decoded as the intended one, again for nested layers; a step is accepted when a cost of garbling drops.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = re.compile(r"[^\x00-\x7f]+")
#: Decoders by which UTF-8 is commonly misread, in order of preference.
MISREAD_UTF8 = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "latin-1", "cp1250", "cp1253", "cp1254", "iso8859-15")
#: (wrong decoder, right one) pairs of one-byte encodings.
MISREAD_BYTE = (("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp437", "cp1252"))

#: The same for whole words in a script of its own: every letter is misread.
MISREAD_WORD = (("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1252", "koi8-r"), ("latin-1", "koi8-r"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1252", "cp1253"), ("latin-1", "iso8859-7"))
#: The shortest such word: shorter ones may be right as they are.
WORD_LETTERS = 4


def _table(enc: str) -> dict[str, int]:
    """Character to byte; a byte the encoding leaves undefined stands for the control character of its number, as
    tolerant decoders leave it."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(enc)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


_BACK = {e: _table(e) for e in MISREAD_UTF8}
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
# Signs that stand in well-typed text, by where they may stand.
_OPEN, _CLOSE, _ALONE = set("“‘«"), set("”’»"), set("–—½¼¾§©°€£…† ")


def _letter(c: str) -> bool:
    return bool(c) and c.isalpha()


def cost(run: str, before: str, after: str) -> float:
    """Garbling cost of a run of non-ASCII characters between its neighbours (two characters each side, '' at an end)."""
    s = before + run + after
    o, total = len(before), 0.0
    for i in range(len(run)):
        c = run[i]
        p, n = s[o + i - 1] if o + i else "", s[o + i + 1] if o + i + 1 < len(s) else ""
        cp = ord(c)
        if cp == 0xFFFD:
            total += 2  # the least that tells of a loss: better than the sequence that stands for it
        elif 0x80 <= cp < 0xA0:
            total += 8
        elif 0x2500 <= cp < 0x2600:
            total += 6
        elif c.isalpha():
            if cp < 0x250 or 0x1E00 <= cp < 0x1F00 or 0xFB00 <= cp < 0xFB07:
                if c in "ªº" or c == "ƒ":
                    total += 4
                elif cp >= 0x100 and cp < 0x250 and c not in "ŒœŠšŽžŸ":
                    total += 3
                elif c.isupper():
                    total += 5 if p.islower() or _letter(p) and n.islower() or n and not n.isalpha() and not n.isspace() and ord(n) > 127 else (4 if not _letter(p) and not _letter(n) else 1)
                elif not _letter(p) and not _letter(n):
                    total += 1 if c in "àéèôó" else 4
                elif c == "ì" and not _letter(p) or c == "î" and not _letter(n) or c == "í" and _letter(p) and (not _letter(n) or n == "s" and len(after) > 1 and not after[1].isalpha() or n == "s" and len(after) == 1):
                    total += 3
                elif c == "â" and not _letter(n) and p.islower():
                    total += 4
                elif c == "ß" and not p.islower():
                    total += 4
                else:
                    total += 1
            elif unicodedata.name(c, "").split(" ")[0] in ("CYRILLIC", "GREEK"):
                kin = unicodedata.name(c).split(" ")[0]
                near = [x for x in (p, n) if _letter(x)]
                total += 1 if near and all(unicodedata.name(x, "").startswith(kin) for x in near) else 5
            else:
                total += 1
        elif c in _OPEN:
            total += 1 if not _letter(p) else 4
        elif c in _CLOSE:
            total += 1 if p and not p.isspace() or not _letter(n) else 3
        elif c in "\xad¬":
            total += 1 if p.islower() and (not n or n.isspace() or n.isalpha()) else 4
        elif c == "°":
            total += 1 if p.isdigit() or not _letter(p) else 4
        elif c == "…":
            total += 4 if n.islower() and not _letter(p) and p != "." else 1
        elif c == "†":
            total += 1
        elif c in _ALONE:
            total += 1 if not (p.islower() and _letter(n)) else 4
        else:
            total += 4
    return total


# A closing quotation mark whose last byte, undefined in the misreading, was dropped.
_CUT = re.compile("â€(?![\x80-\xbf‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ])")


def _round_trips(run: str) -> Iterator[str]:
    if _CUT.search(run):
        yield _CUT.sub("”", run)
    for enc in MISREAD_UTF8:
        back = _BACK[enc]
        raw = bytes(back.get(c, 0) for c in run)
        out, at = [], 0
        for m in _UTF8.finditer(raw):
            try:
                got = m.group().decode("utf-8")
            except UnicodeDecodeError:
                continue
            out.append(run[at : m.start()] + got)
            at = m.end()
        if out:
            yield "".join(out) + run[at:]


def _whole_word(run: str) -> str | None:
    """What a run of misread letters of another script stands for, if one reading is the more natural: three letters with
    accents in a row, or capitals within words, tell of a misreading."""

    def strangeness(x: str) -> int:
        n = 0
        for i, c in enumerate(x):
            kin = _script(c)
            n += (3 if not c.isalpha() else 0) + (kin == "LATIN" and 0 < i < len(x) - 1 and x[i - 1].isalpha() and x[i + 1].isalpha())
            n += 2 * (i > 0 and c.isupper() and x[i - 1].islower()) + 2 * (i > 0 and kin != _script(x[i - 1])) + (c in "ґўѓќџљњћђєѕіїјё")
        return n

    own = strangeness(run)
    best = (own, len(MISREAD_WORD), run)
    for k, (wrong, right) in enumerate(MISREAD_WORD):
        try:
            got = run.encode(wrong).decode(right)
        except UnicodeError:
            continue
        if all(_script(c) in ("CYRILLIC", "GREEK") for c in got):
            best = min(best, (strangeness(got), k, got))
    return best[2] if best[0] * 2 < own else None


def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0]


def repair_run(run: str, before: str, after: str) -> tuple[str, int, bool]:
    """(repaired run, layers undone, garbled): garbled also where nothing can be given back (replacement marks, remains)."""
    if len(run) >= WORD_LETTERS and not _letter(before[-1:]) and not _letter(after[:1]) and (whole := _whole_word(run)):
        return whole, 1, True
    now, layers, c = run, 0, cost(run, before, after)
    while True:  # every layer costs less than the one before, so this ends
        tries = [(cost(x, before, after), k, x) for k, x in enumerate(_round_trips(now))]
        if not tries or min(tries)[0] >= c:
            break
        c, _, now = min(tries)
        layers += 1
    out = list(now)
    for i, ch in enumerate(out):
        p, n = (before + "".join(out[max(0, i - 2) : i]))[-2:], ("".join(out[i + 1 : i + 3]) + after)[:2]
        own = cost(ch, p, n)
        if own < 3 or ord(ch) == 0xFFFD:
            continue
        best = (own, len(MISREAD_BYTE), ch)
        for k, (wrong, right) in enumerate(MISREAD_BYTE):
            try:
                got = ch.encode(wrong).decode(right)
            except UnicodeError:
                continue
            if not got.isascii():
                best = min(best, (cost(got, p, n), k, got))
        if best[0] < own:
            out[i] = best[2]
            layers = max(layers, 1)
    now = "".join(out)
    c = cost(now, before, after)
    garbled = now != run or any(ord(x) == 0xFFFD or 0x80 <= ord(x) < 0xA0 for x in now) or c >= 4 * len(now) and not any(x in "\xad¬†" for x in now)
    return now, layers, garbled


_short_run = lru_cache(maxsize=1 << 16)(repair_run)


def repair(text: str | None) -> tuple[str | None, int, int]:
    """(repaired text, most layers undone, garbled runs). Null gives null; ASCII text comes back as it is."""
    if text is None or text.isascii():
        return text, 0, 0
    out, at, layers, bad = [], 0, 0, 0
    for m in RUN.finditer(text):
        s, e = m.span()
        new, k, garbled = (_short_run if e - s <= 32 else repair_run)(m.group(), text[max(0, s - 2) : s], text[e : e + 2])
        if garbled:
            bad += 1
            layers = max(layers, k)
            out += [text[at:s], new]
            at = e
    return ("".join(out) + text[at:] if out else text), layers, bad


def repaired(records: DataFrame) -> DataFrame:
    """(rec_id, text, fixed, layers, runs) of each record with garbled text; ``fixed`` is the repaired text.

    Characters lost for good stay as replacement marks. Null, empty and rightly written texts give no row; repeated
    records give one row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, t, *r) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (r := repair(t))[2]]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()))], ["rec_id", "text", "fixed", "layers", "runs"])

    wide = records.select("rec_id", "text").filter(F.octet_length("text") > F.char_length("text"))
    return wide.mapInArrow(run, "rec_id long, text string, fixed string, layers int, runs int")
