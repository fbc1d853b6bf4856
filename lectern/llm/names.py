"""Names as people type them: pieces of a label, rewritings of a name, and whether two forms fit together."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from lectern.llm import speech

# Short forms of given names.
NICKNAMES = {
    "alexander": ("alec", "alex", "sandy"), "benjamin": ("ben", "benny"), "charles": ("charlie", "chuck"), "daniel": ("dan", "danny"),
    "dorothy": ("dot", "dolly"), "edward": ("ted", "ed", "eddie", "ned"), "elizabeth": ("liz", "beth", "betty", "lizzie", "eliza"),
    "frederick": ("fred", "freddie"), "gabriel": ("gabe",), "henrietta": ("etta", "hetty"), "isaac": ("ike",), "james": ("jim", "jimmy", "jamie"),
    "joseph": ("joe", "joey"), "katherine": ("kate", "kathy", "katie", "kitty"), "leonard": ("len", "leo", "lenny"), "margaret": ("meg", "peggy", "maggie", "peg"),
    "matthew": ("matt",), "michael": ("mike", "mick", "micky"), "nicholas": ("nick", "nicky"), "oliver": ("ollie", "noll"), "patricia": ("pat", "patty", "trish"),
    "philip": ("phil", "pip"), "rebecca": ("becky", "becca"), "richard": ("dick", "rick", "rich"), "robert": ("bob", "rob", "bobby"), "samuel": ("sam", "sammy"),
    "stephen": ("steve", "steph"), "susan": ("sue", "susie"), "thomas": ("tom", "tommy"), "timothy": ("tim", "timmy"), "victoria": ("vicky", "tori"),
    "vincent": ("vince", "vinny"), "william": ("bill", "will", "billy", "willy"), "zachary": ("zack", "zach", "zak"),
}
FROM_NICK = {n: full for full, ns in NICKNAMES.items() for n in ns}

# Legal forms that may end an organisation's name.
LEGAL_FORMS = frozenset(("ltd", "limited", "plc", "inc", "incorporated", "llp", "llc", "gmbh", "corp", "corporation", "pty"))

_TITLES = re.compile(r"(?i)^(?:(hon(?:ourable)?|mrs?|ms|miss|dr|prof|capt|mhe(?:shimiwa)?|rt|rev|eng|maj|gen|col|sen)(?:\.\s*|\s+|$))")
_GLUED = re.compile(r"^(Mrs?|Ms|Dr|Prof|Capt|Hon|Mhe)(?=[A-Z])|^(MRS|MR|MS|DR|PROF|CAPT|HON|MHE)(?=[A-Z]{4,})")
_TOKEN = re.compile(r"[A-Za-z][A-Za-z'’]*\.?")


class Name(NamedTuple):
    """A typed name: the surname readings (more than one if blanks may have broken it), the given names in order
    as typed and lower-cased (one letter: an initial; a final dot: cut short), the title, and what it is member for."""

    surnames: tuple[str, ...]
    given: tuple[str, ...]
    title: str
    seat: str


def without_legal_form(tokens: list[str]) -> list[str]:
    """Pieces of a name without the legal forms at its end, two pieces at least."""
    n = len(tokens)
    while n > 2 and tokens[n - 1].rstrip(".").lower() in LEGAL_FORMS:
        n -= 1
    return tokens[:n]


def given_names(full_names: list[str]) -> frozenset[str]:
    """Lower-case given names of a register, with their short forms."""
    own = {w.lower() for n in full_names if n for w in n.split()[:-1]}
    return frozenset(own | {k for g in own for k in NICKNAMES.get(g, ())})


@lru_cache(maxsize=1 << 17)
def parse(label: str, kind: str, given: frozenset[str]) -> Name | None:
    """Pieces of the name in a label of kind port or name; None where it holds no name."""
    seat = ""
    if kind == "port":
        m = speech._PORT.fullmatch(label)
        if not m or not m.group(2):
            return None
        head = m.group(1).lower()
        seat = head.split(" for ", 1)[1].strip() if "member for" in head else ""
        label = m.group(2)
    elif kind == "name":
        m = speech._POST.fullmatch(label)
        if m:
            label = m.group(1)
    else:
        return None
    label = " ".join(label.split())
    title = ""
    while True:
        m = _TITLES.match(label) or _GLUED.match(label)
        if not m or m.end() >= len(label):
            break
        t = next(g for g in m.groups() if g).lower()
        title = t if t not in ("hon", "honourable", "mhe", "mheshimiwa", "rt") else title
        label = label[m.end() :].strip()
    if not label:
        return None
    if "," in label:
        last, _, rest = label.partition(",")
        return _name([last.replace(" ", "").lower()], [t.lower() for t in _split(rest)], title, seat)
    toks = raw = without_legal_form(_split(label))
    if not toks:
        return None
    # initials at the end: Surname A. B.
    k = len(toks)
    while k > 1 and len(toks[k - 1].rstrip(".")) == 1:
        k -= 1
    if k < len(toks) and len(toks[0].rstrip(".")) > 1:
        return _name(["".join(toks[:k]).lower(), toks[k - 1].lower()], [t.lower() for t in toks[k:]], title, seat)
    toks = [t.lower() for t in toks]
    surnames, gs = [toks[-1]], toks[:-1]
    if len(toks) > 1 and len(toks[-2].rstrip(".")) > 1 and not toks[-2].endswith("."):
        # a surname broken by a blank: its second piece in lower case, or a first piece that is no given name
        if raw[-1][0].islower() or not is_given(toks[-2], given):
            surnames, gs = [toks[-2] + toks[-1]], toks[:-2]
    return _name(surnames, gs, title, seat)


@lru_cache(maxsize=8)
def _by_rest(given: frozenset[str]) -> dict[str, list[str]]:
    """Given names by what is left of them without up to two letters (one of short names): a word within so many edits
    of a name shares one of these with it."""
    out: dict[str, list[str]] = {}
    for g in given:
        for d in deletions(g, 2 if len(g) > 8 else 1):
            out.setdefault(d, []).append(g)
    return out


@lru_cache(maxsize=1 << 16)
def is_given(word: str, given: frozenset[str]) -> bool:
    """Whether a typed word of two letters or more, not cut short, fits one of the given names."""
    if word in given or FROM_NICK.get(word) in given or any(n in given for n in NICKNAMES.get(word, ())):
        return True
    near = _by_rest(given)
    return any(fits(word, g) for g in {g for d in deletions(word, 2) for g in near.get(d, ())})


def _split(s: str) -> list[str]:
    return _TOKEN.findall(s.replace("’", "'"))


def _base(t: str) -> str:
    return t.rstrip(".").lower()


def _name(surnames: list[str], given: list[str], title: str, seat: str) -> Name | None:
    s = tuple(dict.fromkeys(x for x in surnames if len(x.rstrip(".")) > 1))
    return Name(s, tuple(given), title, seat) if s else None


def deletions(s: str, most: int = 1) -> set[str]:
    """``s`` and everything that is left of it without up to ``most`` letters: words within so many edits share one."""
    out = last = {s}
    for _ in range(most):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out = out | last
    return out


@lru_cache(maxsize=1 << 18)
def edits(a: str, b: str, most: int = 3) -> int:
    """Edits (insert, delete, replace, swap neighbours) between two short words, ``most`` at most."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) >= most:
        return most
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            c = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, prev2[j - 2] + 1)
            cur.append(c)
        prev2, prev = prev, cur
    return min(prev[-1], most)


@lru_cache(maxsize=1 << 18)
def fits(typed: str, full: str) -> float:
    """How well a typed given name fits a full one: 0 contradicts, 1 an initial, 2 cut short or a typo, 3 the name or its short form."""
    t = typed.rstrip(".")
    if not t or not full:
        return 0.0
    if len(t) == 1:
        return 1.0 if full[0] == t else 0.0
    if t == full or t in NICKNAMES.get(full, ()) or full in NICKNAMES.get(t, ()):
        return 3.0
    if len(t) >= 2 and typed.endswith(".") and (full.startswith(t) or len(t) >= 3 and edits(t, full[: len(t)]) <= 1):
        return 2.0
    if FROM_NICK.get(t) and FROM_NICK.get(t) == FROM_NICK.get(full):
        return 3.0
    if len(t) >= 4 and edits(t, full) <= 1 + (len(full) > 8):
        return 2.0
    if full in NICKNAMES and len(t) >= 4 and any(len(n) > 3 and edits(t, n) <= 1 for n in NICKNAMES[full]):
        return 2.0
    return 0.0


def given_fit(typed: tuple[str, ...], first: str, middle: str) -> float | None:
    """Evidence that typed given names are those of a person, in either order; None if they contradict."""
    if not typed:
        return 0.0
    if len(typed) == 1:
        f = fits(typed[0], first)
        return f if f else None
    best = None
    for a, b in ((first, middle), (middle, first)):
        x, y = fits(typed[0], a), fits(typed[1], b)
        if a is middle and len(typed[0].rstrip(".")) == 1:
            continue  # initials keep their order
        if x and y and (best is None or x + y > best):
            best = x + y
    if best is None and len(typed) > 2:  # a given name broken by a blank
        return given_fit((typed[0] + typed[1], *typed[2:]), first, middle) or given_fit((typed[0], typed[1] + typed[2]), first, middle)
    if best is None and len(typed) == 2 and len(typed[0]) > 1 and fits(typed[0] + typed[1], first):
        return 2.0
    return best


def same_person(a: Name, b: Name) -> bool:
    """Whether two typed names can be forms of one: surnames within a typo or cut short, given names not contradicting."""
    near = False
    for x in a.surnames:
        for y in b.surnames:
            p, q = x.rstrip("."), y.rstrip(".")
            k = min(len(p), len(q))
            if p == q or (x.endswith(".") or y.endswith(".")) and k >= 3 and edits(p[:k], q[:k]) <= (k >= 5):
                near = True
            elif min(len(p), len(q)) >= 5 and edits(p, q) <= (1 if min(len(p), len(q)) < 7 else 2):
                near = True
    if not near:
        return False
    g, h = (a.given, b.given) if len(a.given) >= len(b.given) else (b.given, a.given)
    if not h or not g:
        return True

    def one(x: str, y: str) -> bool:
        u, v = x.rstrip("."), y.rstrip(".")
        if len(u) == 1 or len(v) == 1:
            full = v if len(u) == 1 else u
            return u[0] == v[0] or FROM_NICK.get(full, full)[0] == (u if len(u) == 1 else v)[0]
        return bool(fits(x, FROM_NICK.get(v, v)) or fits(y, FROM_NICK.get(u, u))) or min(len(u), len(v)) >= 6 and edits(u, v) <= 2

    if len(h) == 1:
        return one(h[0], g[0]) or len(g) > 1 and len(g[0].rstrip(".")) > 1 and one(h[0], g[1])
    return one(h[0], g[0]) and one(h[1], g[1]) or one(h[0], g[1]) and one(h[1], g[0])
