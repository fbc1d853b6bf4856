"""Noise in text from scanned pages: broken and misread words, spaced-out words, page furniture.

Method: an averaged-perceptron character editor. For every character of a suspicious word it scores keep, replace,
delete and insert. A second one, with features of the place on the page, tells bare numbers that are furniture; a third
tells hyphens at line ends that go from those that stay, where the corpus's words leave it open. Running heads and notes
are known by their form or learned from their places (``furniture``). Corpus-wide word counts decide what is suspicious and
which edited word is accepted: a misreading is rare beside its word, and no more frequent than misreading can make it.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import furniture, speech
from lectern.llm.names import edits
from lectern.sources.tables import stage
from lectern.llm.encoding import repair

#: Words of this share of all (so at most 1/KNOWN) are held by the editor, and those of TRUSTED are what it finds right
#: words among; all others meet by a join (``train``). A misreading is RARER times rarer than its word, and has SLACK
#: places more at most than the rate of misreading, taken from words with digits in them, lets expect (four times that).
KNOWN, TRUSTED, RARER, SLACK = 5e-6, 1e-5, 20, 5
#: Up to so many misread words are held by the workers (about 100 MB); more are joined to their texts.
IN_MEMORY = 1_000_000
#: Bound of the sample of rare words and of the vocabulary from which the editor is trained.
SAMPLE, TRAINED = 20_000, 20_000
SEED = 7
#: The shortest word that may have a letter lost or added: shorter ones are that near to other words by chance.
LOST = 5

# Letters (left) and what scanning commonly makes of them.
CONFUSIONS = (
    ("e", "c"), ("o", "0"), ("l", "1"), ("i", "!"), ("t", "†"), ("g", "9"), ("h", "b"), ("m", "rn"), ("d", "cl"), ("w", "vv"), ("u", "ii"),
    ("fi", "ﬁ"), ("fl", "ﬂ"), ("ri", "n"), ("h", "li"), ("li", "h"), ("s", "5"), ("i", "l"), ("i", "1"), ("l", "i"), ("rn", "m"), ("a", "o"), ("c", "e"), ("n", "u"), ("u", "n"), ("b", "h"), ("cl", "d"), ("in", "m"), ("nn", "rm"),
)

WORD = re.compile(r"[A-Za-z0-9†ﬁﬂÀ-ɏ]+(?:[!|'’][A-Za-z0-9†ﬁﬂ]+)*")
_BREAK = re.compile(r"(?<![A-Za-z0-9†!ﬁﬂÀ-ɏ])([A-Za-z0-9†!ﬁﬂÀ-ɏ]+)([-\xad¬])([ \t]*(?:\n\s*|(?<=[ \t])))([a-z0-9†ﬁﬂà-ɏ][a-z0-9†!ﬁﬂà-ɏ]*)")
_SINGLE = re.compile(r"(?<![\w(.'’£/-])[A-Za-z](?![\w).'’:/-])")
# Furniture that can't be part of a sentence, also within a line; bare numbers count only on lines of their own.
_DAY = speech._DATE.replace(speech._MONTH, "(?i:" + "|".join(speech.MONTHS) + ")").replace("(?:st|nd|rd|th)", "(?i:st|nd|rd|th)")
_INLINE = re.compile(
    r"(?:Page\s+\d+\s+of\s+\d+|\[\d{1,4}\]|(?:(?<=\s)|^)-\s\d{1,4}\s-(?=\s|$)"
    r"|Vol\.\s+\d+\s+Official\s+Record,\s+col\.\s+\d+"
    rf"|{_DAY}\s+(?:PARLIAMENT\w*\s+DEBATES?|Oral\s+Replies|HOUSE\s+REPORTS)\s+\d{{1,4}}"
    rf"|(?:\d{{1,4}}\s+)?(?:PARLIAMENT\w*|P\s*A\s*R\s*L\s*I\s*A\s*M\s*E\s*N\s*T\s*A\s*R\s*Y)\s+DEBATES?(?:\s+(?:{_DAY}|\d{{1,4}}))?"
    rf"|\d{{1,4}}\s+(?:HOUSE\s+REPORTS|Oral\s+Replies)\s+{_DAY}|\[{_DAY}\]"
    r")"
)
_NUMBER_LINE = re.compile(r"(?m)^[ \t]*(\d{1,4})\.?[ \t]*(?:</?\w+>[ \t]*)?$")
_ASKED = re.compile(r"\s*asked\s+the\s+Minister\s+for\s+[A-Za-z -]+?(?::-|\s|:)(?=\s*\d)")
_POINT = re.compile(r"\s*(?:\([a-z0-9ivx]{1,4}\)|\d{1,2}[.)]|[-•*])\s")


class Perceptron:
    """Averaged perceptron over string features."""

    def __init__(self) -> None:
        self.w: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        self._sum: dict[tuple[str, str], float] = defaultdict(float)
        self._at: dict[tuple[str, str], int] = defaultdict(int)
        self._n = 0

    def scores(self, features: list[str]) -> dict[str, float]:
        s: dict[str, float] = {}
        for f in features:
            for op, w in self.w.get(f, {}).items():
                s[op] = s.get(op, 0.0) + w
        return s

    def learn(self, features: list[str], want: str) -> None:
        self._n += 1
        s = self.scores(features)
        got = max(s, key=lambda k: (s[k], k)) if s else ""
        if got != want:
            for f in features:
                for op, d in ((want, 1.0), (got, -1.0)):
                    if op:
                        k = (f, op)
                        self._sum[k] += (self._n - self._at[k]) * self.w[f][op]
                        self._at[k] = self._n
                        self.w[f][op] += d

    def freeze(self) -> dict[str, dict[str, float]]:
        for (f, op), s in list(self._sum.items()):
            self.w[f][op] = (s + (self._n - self._at[f, op]) * self.w[f][op]) / max(self._n, 1)
        self.w = {f: {k: v for k, v in ops.items() if v} for f, ops in self.w.items()}
        return self.w


def _features(w: str, i: int) -> list[str]:
    c = w[i]
    p, n = w[i - 1] if i else "^", w[i + 1] if i + 1 < len(w) else "$"
    nn = w[i + 2] if i + 2 < len(w) else "$"
    return [c, p + c, c + n + "+", p + c + n, c + n + nn + "+", "#" + str(c.isdigit()) + str(p.isdigit()) + str(n.isdigit())]


def _align(noisy: str, clean: str) -> list[str] | None:
    """Edit operations that turn ``noisy`` into ``clean``: K keep, R: replace by, D delete, I: keep and insert after. The
    words may differ in one short stretch; None otherwise."""
    i = 0
    while i < min(len(noisy), len(clean)) and noisy[i] == clean[i]:
        i += 1
    j = 0
    while j < min(len(noisy), len(clean)) - i and noisy[-1 - j] == clean[-1 - j]:
        j += 1
    wrong, right = noisy[i : len(noisy) - j], clean[i : len(clean) - j]
    if len(wrong) > 2 or len(right) > 2:
        return None
    ops = ["K"] * len(noisy)
    if wrong:
        ops[i : i + len(wrong)] = ["R:" + right if right else "D"] + ["D"] * (len(wrong) - 1)
    elif right and i:
        ops[i - 1] = "I:" + right
    return ops


class Editor:
    """The trained editor with the corpus's words."""

    def __init__(
        self, counts: dict[str, int], total: int, hyphenated: frozenset[str], rare: list[str], lines: list[tuple[list[str], str]],
        breaks: list[tuple[list[str], str]] = (), learned: speech.Learned = speech.NOTHING, rate: float = 1e-3,
    ):
        self.learned = learned
        self.rate = rate
        #: What the misread words of the corpus stand for; None: not resolved beforehand.
        self.rights: dict[str, str] | None = None
        self.total = max(total, 1)
        self.counts = counts
        self.hyphenated = hyphenated
        self.trusted = sorted(w for w, n in counts.items() if n >= TRUSTED * self.total)
        self._train(rare)
        page = Perceptron()
        for _ in range(3):
            for f, y in lines:
                page.learn(f, y)
        self.page = page.freeze()
        join = Perceptron()
        for _ in range(3):
            for f, y in breaks:
                join.learn(f, y)
        self.join = join.freeze()
        # what is known but a misreading of a much more frequent word is not known after all
        self.known = frozenset(counts)
        self.cache: dict[str, str | None] = {}
        strange = lambda w: any(not c.isalpha() or c in "†ﬁﬂ" for c in w)
        wrong = {w for w, n in counts.items() if n < 1e-3 * self.total and (len(w) > 3 or strange(w)) and (p := self._edit(w, False)) and counts[p] >= (1 if strange(w) else 3) * RARER * n and (strange(w) or self.plausible(n, counts[p]))}
        self.known = frozenset(counts.keys() - wrong)
        self.longest = max(map(len, self.known), default=0)
        self.cache = {}
        plain = [w.encode() for w in self.known if w.isascii() and not any(c.isdigit() for c in w) and (len(w) > 1 or w in "ai")]
        #: What clean text is made of; anything else is looked at word by word.
        self.plain = frozenset(plain) | {w + b"'" for w in plain} | {b"'"}

    def plausible(self, n: int, m: int) -> bool:
        """Whether a word seen ``n`` times can be a misreading of one seen ``m`` times."""
        return n <= SLACK + 4 * self.rate * m

    def _train(self, rare: list[str]) -> None:
        rng = random.Random(SEED)
        top = [w for w in sorted(self.counts, key=lambda w: (-self.counts[w], w)) if w.isalpha()][:TRAINED]
        pairs = [(w, w) for w in top]
        for w in top:
            for _ in range(4):
                fits = [(a, b) for a, b in CONFUSIONS if a in w]
                if fits and len(w) > 2:
                    a, b = rng.choice(fits)
                    at = rng.choice([i for i in range(len(w)) if w.startswith(a, i)])
                    pairs.append((w[:at] + b + w[at + len(a) :], w))
        near: dict[str, list[str]] = defaultdict(list)
        for w in top:
            if len(w) >= 5:
                for i in range(len(w)):
                    near[w[:i] + w[i + 1 :]].append(w)
                near[w].append(w)
        for r in rare:
            if len(r) >= 5:
                hits = {p for k in [r, *(r[:i] + r[i + 1 :] for i in range(len(r)))] for p in near.get(k, ()) if edits(r, p) <= 1 + (len(r) > 6)}
                if len(hits) == 1:
                    pairs.append((r, hits.pop()))
        rng.shuffle(pairs)
        chars = Perceptron()
        for _ in range(2):
            for noisy, clean in pairs:
                for i, op in enumerate(_align(noisy, clean) or ()):
                    chars.learn(_features(noisy, i), op)
        self.chars = chars.freeze()
        # what the operations learned from the corpus replace: single letters and pairs, by their first letter
        seen: Counter[tuple[str, str]] = Counter()
        for noisy, clean in pairs:
            ops = _align(noisy, clean) or []
            at = next((i for i, op in enumerate(ops) if op != "K"), None)
            if at is not None and ops[at][0] != "I":
                n = sum(op != "K" for op in ops)
                seen[noisy[at : at + n], ops[at][2:] if ops[at] != "D" else ""] += 1
        spans: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
        for (wrong, right), n in seen.items():
            if n >= 4 and right:
                spans[wrong[0]][wrong].append(right)
        for right, wrong in CONFUSIONS:
            if right not in spans[wrong[0]][wrong]:
                spans[wrong[0]][wrong].append(right)
        self.spans = {c: [(x, sorted(ys)) for x, ys in sorted(d.items())] for c, d in spans.items()}

    def _scores(self, w: str, i: int) -> dict[str, float]:
        s: dict[str, float] = {}
        get = self.chars.get
        for f in _features(w, i):
            for op, v in get(f, {}).items():
                s[op] = s.get(op, 0.0) + v
        return s

    def _lost(self, w: str, each: list[dict[str, float]]) -> str | None:
        """The trusted word that is ``w`` with one letter added or dropped, the best scored first. All places and letters
        are tried; at the ends of the word, where it may be inflected or cut, only what the editor scores over keep."""
        best: tuple[float, int, str] | None = None
        for i in range(len(w)):
            keep = each[i].get("K", 0.0)
            ops = [("D", w[:i] + w[i + 1 :])] + [("I:" + c, w[: i + 1] + c + w[i + 1 :]) for c in _LETTERS]
            for op, x in ops:
                n = self.counts.get(x, 0)
                # a letter dropped from a double at the end changes the end
                inner = 0 < i < len(w) - 1 and x[0] == w[0] and x[-1] == w[-1] and not w.startswith(x) and not w.endswith(x) and not x.startswith(w) and not x.endswith(w)
                if n >= TRUSTED * self.total and (inner or each[i].get(op, -1.0) > keep):
                    got = (max(keep - each[i].get(op, -1.0), -5.0), -n, x)
                    if best is None or got < best:
                        best = got
        return best[2] if best else None

    def _edit(self, w: str, lost: bool = True) -> str | None:
        """The trusted word the editor's best operations make of ``w``: up to three edits, the best total first. One lost
        or added letter (if ``lost``) comes before two replacements."""
        each = [self._scores(w, i) for i in range(len(w))]
        alts: list[list[tuple[float, int, str]]] = [[] for _ in w]  # at each place: cost, length, what it becomes
        for i in range(len(w)):
            for wrong, rights in self.spans.get(w[i], ()):
                if w.startswith(wrong, i):
                    for right in rights:
                        ops = ["R:" + right if right else "D"] + ["D"] * (len(wrong) - 1)
                        cost = sum(each[i + j].get("K", 0.0) - each[i + j].get(op, -1.0) for j, op in enumerate(ops))
                        alts[i].append((max(cost, -5.0), len(wrong), right))
        words = self.trusted
        for k in (1, 2, 3):
            best: tuple[float, int, str] | None = None
            # what is made of the word up to a place, with the edits left; only beginnings of trusted words go on
            todo = [(0, "", k, 0.0)]
            while todo:
                i, x, more, cost = todo.pop()
                if x:
                    at = bisect_left(words, x)
                    if at == len(words) or not words[at].startswith(x):
                        continue
                if i == len(w) or not more:
                    x += w[i:]
                    if not more and x != w and len(x) > 1:
                        at = bisect_left(words, x)
                        if at < len(words) and words[at] == x:
                            got = (cost, -self.counts[x], x)
                            if best is None or got < best:
                                best = got
                    continue
                todo.append((i + 1, x + w[i], more, cost))
                todo += [(i + n, x + right, more - 1, cost + c) for c, n, right in alts[i]]
            if best:
                return best[2]
            if k == 1 and lost and len(w) >= LOST and w.isalpha() and (x := self._lost(w, each)):
                return x
        return None

    def correct(self, w: str, n: int | None = None) -> str | None:
        """What a lower-case word not known, seen ``n`` times in the corpus, stands for, or None."""
        if w in self.cache:
            return self.cache[w]
        n = self.counts.get(w, 0) if n is None else n
        got = None
        strange = any(c.isdigit() or c in "†!|ﬁﬂ" for c in w)
        letters = sum(c.isalpha() for c in w)
        if letters and not any(ord(c) > 127 and c not in "†ﬁﬂ" for c in w) and not re.fullmatch(r"\d+(?:st|nd|rd|th|[a-z])?|(?:kshs|sh|k)\d+|[a-z]?\d+", w) and (len(w) > 3 or strange and len(w) > 1):
            plain = w.replace("†", "t").replace("ﬁ", "fi").replace("ﬂ", "fl") if strange else w
            got = plain if plain != w and plain in self.known else self._edit(w)
            if got and not strange and not self.plausible(n, self.counts.get(got, 0)):
                got = None
            if got is None and strange and letters >= 2 and ("†" in w or "ﬁ" in w or "ﬂ" in w or re.search(r"[a-z][0-9!|][a-z]", w)):
                got = plain.replace("0", "o").replace("1", "l").replace("9", "g").replace("!", "i").replace("5", "s")
        if len(self.cache) > 300_000:
            self.cache.clear()
        self.cache[w] = got
        return got

    def _joins(self, a: str, sign: str, gap: str, b: str) -> str | None:
        """Line-join operation for a hyphen before white space: the joined text, or None to keep the hyphen. The corpus's words
        decide; where it has neither form, the perceptron."""
        x, y = a.lower(), b.lower()
        if sign == "-" and x + y not in self.known:
            if f"{x}-{y}" in self.hyphenated:
                return None
            if self.join:
                s: dict[str, float] = {}
                for f in break_features(a, sign, gap, b):
                    for op, v in self.join.get(f, {}).items():
                        s[op] = s.get(op, 0.0) + v
                if s.get("keep", 0.0) > s.get("join", 0.0):
                    return None
        return a + b

    def fix(self, text: str, rights: dict[str, str] | None = None) -> tuple[str, int]:
        """(repaired text, noise found) of a text without its speaker label. ``rights``: what the text's own misread words
        stand for; by default the editor's, if it has any; else each unknown word is looked up."""
        found = 0
        before = text
        rights = self.rights if rights is None else rights
        if not text.isascii():
            text = repair(text)[0] or ""
        # page furniture
        asked = _ASKED.match(text)
        head, body = (text[: asked.end()], text[asked.end() :]) if asked else ("", text)
        if any([x in body for x in _SIGNS]) or _DASHED.search(body):
            body, k = _INLINE.subn(" ", body)
            found += k
        if self.learned.lines and (any([x in body.lower() for x in self.learned.signs]) if self.learned.signs else True):
            if self.learned.inline:
                body, k = self.learned.inline.subn(" ", body)
                found += k
            body, k = self.learned.lines.subn("", body)
            found += k
        if body and (body[0].isdigit() or "\n" in body):

            def number(m: re.Match[str]) -> str:
                nonlocal found
                s = {}
                for f in line_features(body, m.start(), m.end()):
                    for op, v in self.page.get(f, {}).items():
                        s[op] = s.get(op, 0.0) + v
                if s.get("furniture", 0.0) >= s.get("text", 0.0):
                    found += 1
                    return ""
                return m.group()

            body = _NUMBER_LINE.sub(number, body)
        text = head + body
        # words broken over line ends, or left so
        if _GAP.search(text):

            def join(m: re.Match[str]) -> str:
                nonlocal found
                got = self._joins(*m.groups())
                if got is None:
                    return m.group(1) + "-" + m.group(4)
                found += 1
                return got

            while True:
                new = _BREAK.sub(join, text)
                if new == text:
                    break
                text = new
        low = text.lower()
        if text.isascii() and self.plain.issuperset(low.encode().translate(_BLANK).split()):
            return text, found
        if not all([w in self.known for w in WORD.findall(low)]) or _SINGLE.search(text):
            # words that weren't in the text before haven't been resolved with the corpus
            new = frozenset(WORD.findall(low)) - frozenset(WORD.findall(before.lower())) if text != before else frozenset()
            text, k = self._words(text, rights, new)
            found += k
        return text, found

    def _words(self, text: str, rights: dict[str, str] | None, new: frozenset[str]) -> tuple[str, int]:
        toks = [(m.start(), m.end()) for m in WORD.finditer(text)]
        low = [text[a:b].lower() for a, b in toks]
        known = self.known
        edits_: list[tuple[int, int, str]] = []
        used = -1
        for i, w in enumerate(low):
            if i <= used or w.isdigit() or len(w) > 1 and w in known:
                continue
            a, b = toks[i]
            single = len(w) == 1
            if single and (w in "ai" or text[a - 1 : a] in "(.'’" or text[b : b + 1] in ").'’"):
                continue
            # a spaced-out word: the widest run of pieces around here that makes a known word
            best = None
            lo = i
            while lo > max(used + 1, 0) and toks[i][0] - toks[lo][0] < 2 * self.longest and text[toks[lo - 1][1] : toks[lo][0]].isspace() and (len(low[lo - 1]) <= 4 or lo == i):
                lo -= 1
            hi = i
            while hi + 1 < len(toks) and toks[hi][1] - toks[i][1] < 2 * self.longest and text[toks[hi][1] : toks[hi + 1][0]].isspace() and (len(low[hi + 1]) <= 4 or hi == i or len(low[hi]) == 1):
                hi += 1
            if hi > lo:
                for x in range(lo, i + 1):
                    s = "".join(low[x:i])
                    for y in range(i, hi + 1):
                        s += low[y]
                        if y > x and len(s) >= 3 and (s in known or "†" in s and s.replace("†", "t") in known) and any(len(q) == 1 or q not in known for q in low[x : y + 1]) and (y - x > 1 or single and len(s) > 3 or not single):
                            if best is None or y - x > best[1] - best[0]:
                                best = (x, y)
            if best:
                x, y = best
                s = "".join(text[toks[z][0] : toks[z][1]] for z in range(x, y + 1)).replace("†", "t")
                edits_.append((toks[x][0], toks[y][1], s))
                used = y
                continue
            if single:
                continue
            got = self.correct(w) if rights is None or w in new or w in self.counts else rights.get(w)
            if got:
                o = text[a:b]
                edits_.append((a, b, got.upper() if o.isupper() and len(o) > 1 else got.capitalize() if o[:1].isupper() else got))
                used = i
        if not edits_:
            return text, 0
        out, at = [], 0
        for a, b, s in edits_:
            if a >= at:
                out += [text[at:a], s]
                at = b
        return "".join(out) + text[at:], len(edits_)


def line_features(body: str, s: int, e: int) -> list[str]:
    """Features of a bare number on a line of its own by its place on the page: first, last or whole; what precedes and
    follows it."""
    before, after = body[:s].rstrip(), body[e:].lstrip()
    where = ("whole" if not after else "first") if not before else "last" if not after else "inner"
    n = body[s:e].strip().rstrip(".")
    p = before[-1:] if before else ""
    kind = "stop" if p in ".?!:;" and p else "comma" if p == "," else "word"
    prev = before.rpartition("\n")[2]
    word = before.split()[-1].lower() if before[-1:].strip() and prev else ""
    year = len(n) == 4 and n[:2] in ("19", "20")
    return [f"after:{word}/{year}", where, f"digits{len(n)}", f"{where}/{kind}", f"{where}/{'short' if len(prev) < 30 else 'long'}", f"{where}/{'lower' if after[:1].islower() else 'upper'}", "dot" if body[s:e].rstrip().endswith(".") else "bare"]


def paragraphs(text: str) -> str:
    """Continuous text: line breaks within a paragraph become blanks; those before the points of a list stay."""
    out: list[str] = []
    for line in text.split("\n"):
        s = " ".join(line.split())
        if not s:
            continue
        if out and _POINT.match(s + " ") and (_POINT.match(out[-1] + " ") or out[-1].endswith((":", ";"))):
            out.append(s)
        elif out and _POINT.match(s + " ") and s[0] == "(":
            out.append(s)
        elif out:
            out[-1] += " " + s
        else:
            out.append(s)
    return "\n".join(out)


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_BLANK = bytes.maketrans(bytes(range(33, 39)) + bytes(range(40, 65)) + bytes(range(91, 97)) + bytes(range(123, 127)), b" " * (6 + 25 + 6 + 4))
_SIGNS = ("[", "Page", "Vol.", "DEBATE", "Debate", "debates", "Replies", "REPLIES", "REPORTS")
_GAP = re.compile(r"[-\xad¬]\s")
_DASHED = re.compile(r"-\s\d")
_HYPHENATED = re.compile(r"[A-Za-zÀ-ɏ]+(?:-[A-Za-zÀ-ɏ]+)+")


#: A number; the word before it and the one after, on one line.
_NUMBER = re.compile(r"\d[\d,.]*")
_WORD_BEFORE = re.compile(r"([a-z£]+)\.? ?$")
_WORD_AFTER = re.compile(r" ([a-z]+)")


def _around_numbers(s: str) -> Iterator[str]:
    """What ``_count_words`` counts of the numbers of a text."""
    for m in _NUMBER.finditer(s):
        a, b = m.span()
        w = _WORD_BEFORE.search(s, max(0, a - 30), a) if a and s[a - 1] in ". £" or s[a - 1 : a].isalpha() else None
        if w:
            yield f"{w.group(1)} {_number_kind(m.group().rstrip('.,'))}"
        w = _WORD_AFTER.match(s, b)
        if w and s[b - 1].isdigit():
            yield "# " + w.group(1)


def _number_kind(n: str) -> str:
    return "#y" if len(n) == 4 and n[:2] in ("19", "20") else "#"


def _count_words(given: frozenset[str]):
    """text -> (word, n): words and hyphenated words; also "w #" (w before a number), "w #y" (a year), "# w" (after one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])
            n.clear()
            return b

        for b in batches:
            for t in b.column(0).to_pylist():
                s = t[speech.split_label(t, given)[3] :].lower()
                n.update(WORD.findall(s))
                if "-" in s:
                    n.update(_HYPHENATED.findall(s))
                n.update(_around_numbers(s))
            if len(n) > 300_000:
                yield out()
        yield out()

    return run


def train(records: DataFrame, given: frozenset[str], learned: speech.Learned | None = None) -> tuple[Editor, DataFrame]:
    """(editor, rights) for ``records(text)``: rights(word, fixed) has every misread word of the records with what it stands
    for.

    Words are counted over all rows. The editor holds the words of a share of KNOWN at least (so at most 1/KNOWN); which
    ones decides on where a word is looked up, not on what becomes of it: the others are resolved once each, against the
    editor's words and, by an equi-join on confusable forms and forms less a letter, against each other. Samples for the
    perceptrons are at most SAMPLE words, SAMPLE / 4 lines with bare numbers and as many line breaks (those of least hash).
    """
    learned = furniture.learn(records) if learned is None else learned
    texts = records.select("text").filter("text is not null")
    counts = stage(texts.mapInArrow(_count_words(given), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    plain = ~F.col("word").contains("-") & ~F.col("word").contains("#")
    total = counts.filter(plain).agg(F.sum("n")).first()[0] or 0
    known = {r.word: r.n for r in counts.filter((F.col("n") >= total * KNOWN) & (F.col("n") > 1)).collect()}
    numbers = {w: n for w, n in known.items() if "#" in w}
    words = {w: n for w, n in known.items() if "-" not in w and "#" not in w}
    others = counts.filter(plain & ((F.col("n") < total * KNOWN) | (F.col("n") <= 1)))
    rare = [r.word for r in others.filter(F.col("word").rlike("^[a-z0-9†!]{5,20}$")).orderBy(F.xxhash64("word"), "word").limit(SAMPLE).collect()]
    often = {k: (sum(n for w, n in numbers.items() if (w[0] == "#" if k == "before" else w.endswith(" " + k))) + 1) / max(total, 1) for k in ("#", "#y", "before")}
    lines = []
    for r in texts.filter(F.col("text").rlike(r"(?m)^[ \t]*\d{1,4}\.?[ \t]*$")).orderBy(F.xxhash64("text"), "text").limit(SAMPLE // 4).collect():
        body = r.text[speech.split_label(r.text, given)[3] :]
        for m in _NUMBER_LINE.finditer(body):
            lines.append((line_features(body, m.start(), m.end()), "text" if _wanted(body, m, words, numbers, often) else "furniture"))
    breaks = []
    hyphenated = frozenset(w for w in known if "-" in w)
    for r in texts.filter(F.col("text").rlike(r"[-­¬]\s")).orderBy(F.xxhash64("text"), "text").limit(SAMPLE // 4).collect():
        for a, sign, gap, b in _BREAK.findall(r.text[speech.split_label(r.text, given)[3] :]):
            joined, kept = (a + b).lower() in words, f"{a}-{b}".lower() in hyphenated
            if joined != kept:
                breaks.append((break_features(a, sign, gap, b), "join" if joined else "keep"))
    spark = records.sparkSession
    editor = Editor(words, total, hyphenated, rare, lines, breaks, learned)
    shared = spark.sparkContext.broadcast(editor)

    def misread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ed = shared.value
        for b in batches:
            n = sum(k for w, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if _STRANGE.search(w) and w.translate(_LOOKS_LIKE) in ed.counts)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    # words with digits in them are misread for sure: how often that happens bounds how often a misreading can come up
    base = sum(n for w, n in words.items() if len(w) > 3) or 1
    editor.rate = (others.filter(F.col("word").rlike("[0-9!†]")).mapInArrow(misread, "n long").agg(F.sum("n")).first()[0] or 0) / base
    shared = spark.sparkContext.broadcast(editor)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ed = shared.value
        for b in batches:
            w, n = b.column(0).to_pylist(), b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([ed.correct(x, k) for x, k in zip(w, n)], pa.string())], ["word", "n", "fixed"])

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    first = stage(others.repartition(tasks, "word").mapInArrow(resolve, "word string, n long, fixed string"), "rights")
    wrong = first.filter("fixed is null").mapInArrow(_forms(True), "key string, word string, n long")
    right = counts.filter(plain & (F.col("n") >= RARER) & (F.col("n") < max(total * TRUSTED, 1))).mapInArrow(_forms(False), "key string, fixed string, m long")
    near = wrong.join(right, "key").filter((F.col("word") != F.col("fixed")) & (F.col("m") >= RARER * F.col("n")) & (F.col("n") <= SLACK + 4 * editor.rate * F.col("m")))
    second = near.groupBy("word").agg(F.max_by("fixed", F.struct("m", "fixed")).alias("fixed"))
    return editor, first.filter("fixed is not null").select("word", "fixed").unionByName(second)


def _forms(wrong: bool):
    """word, n -> the keys by which a misread word meets the right one: what looks like it folded together, letter by letter and
    with pairs of letters; for words of
    LOST letters or more less a letter on one side (within the word; which side lost it is in the key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, words, ns = [], [], []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(w) <= 3 or not _EDITABLE.fullmatch(w):
                    continue
                own = {"=" + folded(w), "~" + w.translate(_FOLDS)}
                if len(w) >= LOST and w.isalpha():
                    less = {w[:i] + w[i + 1 :] for i in range(1, len(w) - 1)}
                    own |= {("+" if wrong else "-") + x for x in less} | {("-" if wrong else "+") + w}
                keys += own
                words += [w] * len(own)
                ns += [n] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(words, pa.string()), pa.array(ns, pa.int64())], ["key", "word" if wrong else "fixed", "n" if wrong else "m"])

    return run


_EDITABLE = re.compile("[a-z0-9†!ﬁﬂ]+")
_STRANGE = re.compile("[a-z][0-9!†]|[0-9!†][a-z]")
_LOOKS_LIKE = str.maketrans("01953!†", "olgssit")
_FOLDS = str.maketrans({"c": "e", "0": "a", "o": "a", "1": "l", "i": "l", "!": "l", "9": "g", "b": "h", "5": "s", "u": "n", "†": "t"})


def folded(w: str) -> str:
    """A word with letters that scanning confuses (CONFUSIONS) taken together."""
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("li", "h")):
        w = w.replace(a, b)
    return w.translate(_FOLDS)


def _wanted(body: str, m: re.Match[str], words: dict[str, int], numbers: dict[str, int], often: dict[str, float]) -> bool:
    """Whether the words around a bare number want one there more than they don't, by the corpus: how much more often than
    anywhere a number follows the word before, times how much more often than anywhere the word after follows a number.
    A missing neighbour says nothing; two numbers in a row are hardly ever meant."""
    kind = _number_kind(m.group(1))
    before = re.search(r"([a-z£]+)\.?\s*$", body[: m.start()].lower())
    after = re.match(r"\s*([a-z]+|\d)", body[m.end() :].lower())
    score = 1.0
    if before:
        w = before.group(1)
        score *= (numbers.get(f"{w} {kind}", 0) + 0.01) / (words.get(w, 0) + 1) / often[kind]
    if after:
        w = after.group(1)
        score *= 0.01 if w.isdigit() else (numbers.get("# " + w, 0) + 0.01) / (words.get(w, 0) + 1) / often["before"]
    return score > 1.0


def break_features(a: str, sign: str, gap: str, b: str) -> list[str]:
    """Features of a hyphen before white space, by what stands around it."""
    x, y = a.lower(), b.lower()
    return ["any", "sign:" + sign, "line" if "\n" in gap else "blank", "a:" + x[-3:], "b:" + y[:3], "ab:" + x[-2:] + y[:2], f"len{min(len(x), 6)}/{min(len(y), 6)}", "a=" + x, "cap" if a[:1].isupper() else "low"]


def repaired(records: DataFrame, given: frozenset[str], editor: Editor | None = None) -> DataFrame:
    """(rec_id, fixed, noise) of each record with scan noise outside its speaker label: the text as continuous paragraphs
    with the label kept, and the number of places put right.

    Null, empty and clean texts give no row; a text that is furniture only gives an empty ``fixed``. Repeated records
    give rows each. True hyphens, numbers within sentences and the line breaks of lists stay. Without an ``editor`` one is
    trained on the records.
    """
    rights = None
    if editor is None:
        editor, rights = train(records, given)
        rights = stage(rights, "misread")
        if rights.count() <= IN_MEMORY:
            editor.rights = {r.word: r.fixed for r in rights.collect()}
            rights = None
        else:
            editor.rights = {}
    shared = records.sparkSession.sparkContext.broadcast(editor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ed = shared.value
        for b in batches:
            ids, fixed, noise = [], [], []
            own = b.column(2).to_pylist() if b.num_columns > 2 else None
            for k, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                end = speech.split_label(t, given)[3]
                new, found = ed.fix(t[end:], None if own is None else dict(own[k] or ()))
                if found:
                    ids.append(i)
                    fixed.append((t[:end] + " " if end else "") + paragraphs(new) if new.strip() else t[:end])
                    noise.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fixed, pa.string()), pa.array(noise, pa.int32())], ["rec_id", "fixed", "noise"])

    rows = records.select("rec_id", "text").filter("text is not null")
    if rights is not None:
        # too many misread words for memory: each text gets its own, met by its words
        met = rows.select(F.xxhash64("text").alias("h"), "text").mapInArrow(_strange_words(given, shared), "h long, word string").distinct().join(rights, "word")
        met = met.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("word", "fixed"))).alias("own"))
        rows = rows.withColumn("h", F.xxhash64("text")).join(met, "h", "left").select("rec_id", "text", "own")
    return rows.mapInArrow(run, "rec_id long, fixed string, noise int")


def _strange_words(given: frozenset[str], shared):
    """hash, text -> (hash, word) of its words that the editor doesn't know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ed = shared.value
        for b in batches:
            hs, ws = [], []
            for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = {w for w in WORD.findall(t[speech.split_label(t, given)[3] :].lower()) if w not in ed.known}
                hs += [h] * len(own)
                ws += own
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ws, pa.string())], ["h", "word"])

    return run
