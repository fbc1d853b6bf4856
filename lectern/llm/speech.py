"""Reading one transcript line: markup, timestamps, speaker label, furniture, annotations, headings.

Plain Python over one string, for use inside Arrow batches. Nothing here looks at other lines, so
every function may run on any row on any executor. Null and empty text gives empty results.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Months, weekdays, titles and offices as they occur in the transcripts.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
TITLES = ("hon", "honourable", "mr", "mrs", "ms", "miss", "dr", "prof", "capt", "mhe", "mheshimiwa", "rev", "eng", "maj", "gen", "col", "sen", "bishop", "bw", "bi")
FILLERS = ("uhm -", "erm...", "you know,", "i mean,", "like,", "ah,", "mm,", "er,", "uh,", "um,")

_MONTH = "(?:" + "|".join(MONTHS) + ")"
_DATE = r"\d{1,2}\s?(?:st|nd|rd|th)\s+" + _MONTH + r",?\s+\d{4}"
_TIME = r"(?:\d{1,2}:\d\d:\d\d(?:,\d{3}\s?-->)?|\[\d{1,2}:\d\d(?::\d\d)?\]|\(\d{1,2}:\d\d:\d\d\)|\[\d+m\d+s\]|\(\d{1,2}[.:]\d\d\s?[ap]\.m\.\))"
_TAG = r"</?[A-Za-z][A-Za-z-]{0,14}>"

HEAD = re.compile(r"(?:\s|" + _TAG + "|" + _TIME + ")*")
TAG = re.compile(_TAG)
TIME = re.compile(_TIME)

_DEBATES = r"(?:PARLIAMENT\w*|P\s*A\s*R\s*L\s*I\s*A\s*M\s*E\s*N\s*T\s*A\s*R\s*Y)\s+DEBATES?"
_FURNITURE = (
    r"(?:Page\s+\d+\s+of\s+\d+|\[\d{1,4}\]|-\s\d{1,4}\s-|\d{1,4}\.?"
    r"|Vol\.\s+\d+\s+Official\s+Record,\s+col\.\s+\d+"
    r"|(?:\d{1,4}\s+)?" + _DEBATES + r"(?:\s+(?:\d{1,4}|" + _DATE + r"))?"
    r"|" + _DATE + r"\s+" + _DEBATES + r"\s+\d{1,4}"
    r"|\d{1,4}\s+HOUSE\s+REPORTS\s+" + _DATE + r"|" + _DATE + r"\s+(?:Oral\s+Replies|HOUSE\s+REPORTS)\s+\d{1,4}|\d{1,4}\s+Oral\s+Replies\s+" + _DATE +
    r"|\[" + _DATE + r"\])"
)
#: A whole line of page furniture of a known form, within a text or as all of it. Others are learned (``furniture``).
FURNITURE = re.compile(r"(?mi)(?:^|(?<=\n))[ \t]*" + _FURNITURE + r"(?=[ \t]*(?:</?\w+>\s*)?(?:\n|\Z))")

ANNOTATION = re.compile(
    r"\[[A-Za-z][^\[\]<>]{2,40}\]|\((?:[A-Z][a-z]+|clapping)(?:\s[a-zA-Z]+){0,7}\)|\*[a-z]+\*|<(?:laughs|coughs|sighs|applause)>"
)
FILLER = re.compile(r"\b(?:[UuEeAaMm](?:hm\s+-|rm\.\.\.|[hmr],)|[Yy]ou\s+know,|I\s+mean,|i\s+mean,|[Ll]ike,)(?=\s|\Z)\s*")

_T = r"(?:hon(?:ourable)?|mrs?|ms|miss|dr|prof|capt|mhe(?:shimiwa)?|rt|rev|eng|maj|gen|col|sen)"
SEPARATOR = re.compile(r"\s?:-|\s?[:;]|\s-(?=\s)|(?=\sasked\s+the\s+Minister)")
_OFFICE = re.compile(r"(?i)(?:(?:the|mr\.?|mrs\.?|madam|hon\.?|sir)\s+)*(?:(?:temporary|temp\.?|acting|deputy)\s+){0,3}(?:speaker|chair(?:-?\s?(?:person|man|woman|lady))?|clerk|attorney-general)")
_GROUP = re.compile(r"(?i)(?:(?:the|some|several|an?|other|many)\s+)*(?:hon(?:ourable|\.)?\s*)?members?")
_VOICE = re.compile(r"(?i)(?:speaker|spkr|spk|voice)[\s_-]*(\d{1,3})")
_PORT = re.compile(r"(?i)(the\s+(?:(?:assistant|deputy)\s+)?(?:minister|member)\s+for\s+[a-z ,&-]{3,50}?)\s*(?:\(([^()]{3,60})\))?")
_POST = re.compile(r"(?i)(.{3,60}?)\s*\(((?:assistant\s+)?(?:minister|member)\s+for\s+[a-z ,&-]{3,50})\)")
_TITLED = re.compile(r"(?i)" + _T + r"(?:\.\s*|\s+)(?=[a-z])")
_GLUED = re.compile(r"(?:Mrs?|Ms|Dr|Prof|Capt|Hon|Mhe)(?=[A-Z])|(?:MRS?|MS|DR|PROF|CAPT|HON|MHE)(?=[A-Z]{4,})")
_NAMELIKE = re.compile(r"[A-Za-z.'’]+(?:[ \n,]+[A-Za-z.'’]+){0,6}\s?")
_INITIALS = re.compile(r"(?:[A-Z]\.\s?){1,3}$")
_WORDS = re.compile(r"[A-Za-z][A-Za-z'’]*")
_NUMBER = re.compile(r"[0-9]+")
_LOWER = re.compile(r"[a-z]")
# Openings that end in a colon but name nobody.
NOT_NAMES = frozenset("the let note time clause question next order ask this that it a in on of no yes not sir madam first secondly further now again also here".split())
#: No form of a label is longer, its pieces set apart by single blanks.
_LONGEST = 200


#: A day and month within a shape, and what takes its place.
DAY, A_DAY = "0 ?(?:st|nd|rd|th) " + _MONTH, "0th @"


def shape(line: str) -> str:
    """A line with its numbers alike, and its days; in small letters, blanks evened, markup taken off."""
    return re.sub(DAY, A_DAY, " ".join(_NUMBER.sub("0", TAG.sub("", line).lower()).split()))


@lru_cache(maxsize=1 << 17)
def label_kind(body: str, given: frozenset[str] = frozenset()) -> str:
    """voice, office, group, port (an office with or without a name), name, or '' if ``body`` is no speaker label."""
    if len(body) < 3 or not body[0].isalpha():
        return ""
    if _VOICE.fullmatch(body):
        return "voice"
    if _OFFICE.fullmatch(body):
        return "office"
    if _GROUP.fullmatch(body):
        return "group"
    if body[:4].lower() == "the " and _PORT.fullmatch(body):
        return "port"
    if "(" in body:
        m = _POST.fullmatch(body)
        if not m:
            return ""
        body = m.group(1)
    return "name" if _NAMELIKE.fullmatch(body) and _is_name(body, given) else ""


def split_label(text: str | None, given: frozenset[str] = frozenset()) -> tuple[str, str, int, int]:
    """(kind, label, start, end) of the speaker label at the head of ``text``.

    kind is one of voice, office, group, port, name or '' (no label); ``end`` is the place after the
    separator. ``given`` are known given names in lower case: a name without a title and with a piece
    in lower case (a word broken by a space) counts only if it holds one of them. Null gives no label.
    """
    if not text:
        return "", "", 0, 0
    s = 0 if text[0].isalpha() and text[0] != "<" else HEAD.match(text).end()
    head = text[s : s + _LONGEST]
    if not (":" in head or ";" in head or " - " in head or " asked the M" in head):
        return "", "", s, s
    m = SEPARATOR.search(head)
    if not m:
        return "", "", s, s
    body = head[: m.start()]
    kind = label_kind(body, given)
    if not kind:
        return "", "", s, s
    return kind, body.strip(), s, s + m.end()


def _is_name(name: str, given: frozenset[str]) -> bool:
    words = _WORDS.findall(name)
    if not words:
        return False
    if _TITLED.match(name):
        return len(words) > 1 and words[-1].lower() not in ("uhm", "asked") and len(words) <= 7
    if _GLUED.match(name):
        return True
    if words[0].lower() in NOT_NAMES or len(words) < 2:
        return False
    lower = [w for w in words if w[0].islower()]
    return not lower or len(lower) == 1 and (any(w.lower() in given for w in words) or bool(_INITIALS.search(name)))


def is_heading(text: str | None, headers: frozenset[str] = frozenset()) -> bool:
    """A heading on a line of its own (the caller has ruled out a speaker label): marked up as one, a known
    heading, a question number, or capitals only.

    Null, blank, page furniture and annotations are no headings.
    """
    if not text:
        return False
    if text[0] in "< \t":
        if re.match(r"\s*<(?:header|sub-?header)>", text, re.I):
            return True
        text = TAG.sub("", text)
    bare = text.strip()
    if not bare:
        return False
    if _LOWER.search(bare):
        low = bare.lower()
        return low in headers or low.startswith("question no") and bool(re.fullmatch(r"question\s+no\.?\s*\d+", low))
    letters = re.sub(r"[^A-Za-z]", "", bare) if bare.upper() != bare else ""
    if letters:
        return len(letters) > 5 and not FURNITURE.fullmatch(bare)
    return sum(c.isalpha() for c in bare) > 3 and bare[0] not in "[(" and not FURNITURE.fullmatch(bare)


_FILLER_SIGNS = ("hm -", "rm...", "ou know,", "I mean,", "ike,", " ah,", " mm,", " er,", " uh,", " um,", "Ah,", "Mm,", "Er,", "Uh,", "Um,", " i mean,")


def strip_head(text: str, end: int) -> str:
    """Spoken part after a label that ends at ``end``, without markup."""
    return TAG.sub(" ", text[end:])


class Learned:
    """Page furniture with words of its own, by the shapes of its lines (``furniture.learn``); the words may be parted by
    any white space, as line ends move."""

    def __init__(self, shapes: frozenset[str] = frozenset()):
        self.shapes = shapes
        self.starts = frozenset(x.split()[0] for x in shapes if x[0] != "0")
        word = lambda w: r"[0-9]+\s?(?:st|nd|rd|th)" if w == "0th" else re.escape(w).replace("0", "[0-9]+").replace("@", _MONTH)
        one = lambda x: r"\s+".join(map(word, x.split()))
        any_ = "|".join(one(x) for x in sorted(shapes, key=lambda x: (-len(x), x)))
        #: Whole lines, and, for those of four words or more, places within a line.
        self.lines = re.compile(r"(?mi)(?:^|(?<=\n))[ \t]*(?:" + any_ + r")(?=[ \t]*(?:</?\w+>\s*)?(?:\n|\Z))") if shapes else None
        long = [x for x in sorted(shapes, key=lambda x: (-len(x), x)) if len(x.split()) > 3]
        self.inline = re.compile("(?i)(?:" + "|".join(map(one, long)) + ")") if long else None
        self.signs = frozenset(max((w for w in x.split() if w.isalpha()), key=len, default="") for x in long)

    def __reduce__(self):
        return Learned, (self.shapes,)

    def may_open(self, s: str) -> bool:
        """Whether a text may begin with one."""
        return s[0].isdigit() or s[:60].split(None, 1)[0].lower() in self.starts


NOTHING = Learned()


def without_furniture(s: str, learned: Learned = NOTHING) -> str:
    """A text without its lines of page furniture: those of a known form, and those that are ``learned``."""
    s = s.strip()
    if not s:
        return s
    if "\n" not in s:
        if s[0] in _FURNITURE_STARTS:
            m = FURNITURE.match(s)
            s = s[m.end() :] if m else s
        return learned.lines.sub("", s) if learned.lines and s and learned.may_open(s) else s
    return FURNITURE.sub("", learned.lines.sub("", s) if learned.lines else s)


_FURNITURE_STARTS = frozenset("pPvV[-0123456789 \t")


def spoken(text: str | None, end: int = 0, learned: Learned = NOTHING) -> str:
    """Words said in a line: no label (up to ``end``), markup, timestamps, furniture, annotations, fillers."""
    if not text:
        return ""
    s = text[end:]
    if "<" in s:
        s = TAG.sub("", ANNOTATION.sub(" ", s))
    if "[" in s or "(" in s or "*" in s or s[:1].isdigit():
        s = ANNOTATION.sub(" ", TIME.sub(" ", s))
    s = without_furniture(s, learned)
    for f in _FILLER_SIGNS:
        if f in s:
            s = FILLER.sub("", s)
            break
    return " ".join(s.split())


def has_words(text: str | None, end: int = 0, learned: Learned = NOTHING) -> bool:
    """``bool(spoken(...))``, told without reading on where the line has no sign of what ``spoken`` takes out but fillers
    (which all end in a comma, a hyphen or three dots) and ends in another sign."""
    if not text:
        return False
    s = text[end:].strip() if end else text.strip()
    if not s:
        return False
    if not _TAKEN.search(s) and s[0] not in _FURNITURE_STARTS and s[-1] not in ",-" and not s.endswith("...") and not (learned.lines and learned.may_open(s)):
        return True
    return bool(spoken(text, end, learned))


_TAKEN = re.compile(r"[<\[(*\n]")
