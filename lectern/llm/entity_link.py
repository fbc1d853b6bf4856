"""Linking typed names to a register.

Method: every canonical rewriting of each name is a string: given names in full with short forms put back to their names,
in either order and one alone; their initials; none; each with the surname as it is, cut short, or less one or two letters
(a typing slip); legal forms are taken off. Registers and labels are exploded into these forms and equi-joined. Candidates
are scored by the rarity of the rarest rewriting they share and the fit of the pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import names, speech
from lectern.sources.tables import stage

#: A register up to this size is held in memory (about 200 forms and 30 kB a row); a larger one is joined by shuffle.
BROADCAST_ROWS = 2_000
#: Bound of the vocabulary of given names.
MOST_GIVEN = 1_000_000


def _full(token: str) -> str:
    """A given name as typed with its short form put back."""
    t = token.rstrip(".")
    return names.FROM_NICK.get(t, t)


def _initial(token: str) -> str:
    return _full(token)[:1]


def _slips(word: str) -> set[str]:
    """What is left of a surname without the letters a typing slip may have changed (two of a long one), four at least:
    words within so many edits share a form."""
    return {w for w in names.deletions(word, _reach(word)) if len(w) >= 4} | {word}


def _reach(word: str) -> int:
    return 2 if len(word) >= 7 else 1


def label_keys(records: DataFrame, given: frozenset[str]) -> DataFrame:
    """(rec_id, key) of every record whose label holds a name; the key is the name's pieces as one string."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                kind, label, _, _ = speech.split_label(t, given)
                n = names.parse(label, kind, given) if kind in ("name", "port") else None
                if n:
                    ids.append(i)
                    out.append(f"{' '.join(n.surnames)}|{' '.join(n.given)}|{n.title}|{n.seat}")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["rec_id", "key"])

    return records.select("rec_id", "text").mapInArrow(keys, "rec_id long, key string")


def _read(key: str) -> tuple[list[str], list[str], str, str]:
    s, g, title, seat = key.split("|")
    return s.split(), g.split(), title, seat


def typed_forms(surnames: list[str] | tuple[str, ...], given: list[str] | tuple[str, ...]) -> set[str]:
    """The rewritings of a typed name."""
    initials = "".join(_initial(g) for g in given[:2])
    whole = " ".join(_full(g) for g in given[:2])
    out = set()
    for s in surnames:
        base = s.rstrip(".")
        if s.endswith("."):
            out.add(f"{base}*|{initials}")
        out |= {f"{x}|{initials}" for x in _slips(base)}
        if whole:
            out.add(f"{base}|{whole}")
    return out


def register_forms(full_name: str | None) -> tuple[str, str, str, set[str]]:
    """(first, middle, last, the rewritings) of a registered name; no forms for a name of one piece, or null."""
    parts = names.without_legal_form((full_name or "").lower().split())
    if len(parts) < 2:
        return "", "", "", set()
    first, last, middle = parts[0], parts[-1], parts[1] if len(parts) > 2 else ""
    initials = {"", first[:1]} | ({first[:1] + middle[:1], middle[:1] + first[:1]} if middle else set())
    wholes = {first} | ({middle, f"{first} {middle}", f"{middle} {first}"} if middle else set())
    cut = {f"{last[:n]}*" for n in range(3, len(last))}
    return first, middle, last, {f"{f}|{i}" for f in _slips(last) | cut for i in initials} | {f"{last}|{w}" for w in wholes}


def _label_forms(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in it:
        rows = [(key, f) for key in df["key"] for f in typed_forms(*_read(key)[:2])]
        yield pd.DataFrame(rows, columns=["key", "form"])


def _member_forms(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in it:
        rows = [(r.member_id, f) for r in df.itertuples() for f in register_forms(r.full_name)[3]]
        yield pd.DataFrame(rows, columns=["member_id", "form"]).astype({"member_id": "int32"})


_NEUTRAL = ("", "hon", "honourable", "mhe", "mheshimiwa", "rt")


def _pieces(full_name: str | None, honorific: str | None, seat: str | None) -> tuple[str, str, str, str, str]:
    return (*register_forms(full_name)[:3], (honorific or "").lower().rstrip("."), (seat or "").lower())


def _fit(surnames: tuple[str, ...] | list[str], given: tuple[str, ...] | list[str], title: str, seat: str, first: str, middle: str, last: str, honorific: str, own_seat: str) -> float | None:
    """How well the pieces of a typed name fit a member; None if they contradict."""
    if seat and seat != own_seat or title not in _NEUTRAL and honorific and title != honorific:
        return None
    fit = names.given_fit(tuple(given), first, middle)
    if fit is None:
        return None
    best = None
    for s in surnames:
        base = s.rstrip(".")
        if s.endswith(".") and len(base) >= 3 and last.startswith(base):
            slip = 0.0
        elif s.endswith(".") and len(base) >= 4 and names.edits(base, last[: len(base)]) <= 1:
            slip = 1.5
        else:
            slip = names.edits(base, last)
            if slip > _reach(last) or slip == 2 and min(len(base), len(last)) < 7:
                continue
        best = slip if best is None else min(best, slip)
    return None if best is None else fit - 2 * best + (2 if seat else 0)


def _score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in it:
        rows = []
        for r in df.itertuples():
            fit = _fit(*_read(r.key), *_pieces(r.full_name, r.honorific, r.constituency))
            if fit is not None:
                rows.append((r.key, r.member_id, r.rarity + fit))
        yield pd.DataFrame(rows, columns=["key", "member_id", "score"]).astype({"member_id": "int32", "score": "float64"})


class Resolver:
    """A small register in memory, for labels that are compared within a worker: the same forms, rarity and fit as the join."""

    def __init__(self, rows: tuple[tuple, ...]):
        self.rows = rows
        self._of: dict[str, set[int]] | None = None
        self._known: dict[names.Name, int | None] = {}

    def __reduce__(self):
        return Resolver, (self.rows,)

    def _forms(self) -> dict[str, set[int]]:
        if self._of is None:
            self._of, self._who = {}, {}
            for member, full_name, honorific, seat in self.rows:
                self._who.setdefault(member, []).append(_pieces(full_name, honorific, seat))
                for f in register_forms(full_name)[3]:
                    self._of.setdefault(f, set()).add(member)
        return self._of

    def __call__(self, n: names.Name) -> int | None:
        """The member a name links to, or None."""
        if n in self._known:
            return self._known[n]
        of, most = self._forms(), log(max(len(self.rows), 2))
        rarity: dict[int, float] = {}
        for f in typed_forms(n.surnames, n.given):
            hits = of.get(f, ())
            for m in hits:
                rarity[m] = max(rarity.get(m, -1.0), most - log(len(hits)))
        scores = {}
        for m, r in rarity.items():
            fits = [x for p in self._who[m] if (x := _fit(n.surnames, n.given, n.title, n.seat, *p)) is not None]
            if fits:
                scores[m] = r + max(fits)
        top = max(scores.values(), default=0.0)
        best = [m for m, v in scores.items() if v > top - 1e-9]
        if len(self._known) > 200_000:
            self._known.clear()
        self._known[n] = best[0] if len(best) == 1 else None
        return self._known[n]


def resolver(members: DataFrame, records: DataFrame, given: frozenset[str]) -> Resolver | DataFrame:
    """What settles which member a label names: in memory for a register of at most BROADCAST_ROWS rows; for a larger one
    links(key, member_id) of the distinct keys of ``records(rec_id, text)``, by the join of ``link_names``, with the same
    result."""
    rows = members.select("member_id", "full_name", "honorific", "constituency").limit(BROADCAST_ROWS + 1).collect()
    if len(rows) <= BROADCAST_ROWS:
        return Resolver(tuple(tuple(r) for r in rows))
    return link_keys(label_keys(records, given).select("key").distinct(), members)


def register_given(members: DataFrame) -> frozenset[str]:
    """The distinct given names of the register, with short forms. They are a vocabulary, not a list of people, and are
    held in memory; more than MOST_GIVEN of them are an error."""
    words = members.select(F.explode(F.slice(F.split(F.trim(F.lower("full_name")), r"\s+"), 1, 2)).alias("w")).distinct().limit(MOST_GIVEN + 1).collect()
    if len(words) > MOST_GIVEN:
        raise ValueError(f"more than {MOST_GIVEN} different given names")
    return names.given_names([f"{r.w} x" for r in words])


def link_keys(typed: DataFrame, members: DataFrame) -> DataFrame:
    """links(key, member_id) of distinct keys of typed names; a key that fits two members equally well links to neither.

    The register's forms are broadcast up to BROADCAST_ROWS members (about 8 kB each), else both sides are shuffled.
    """
    spark = typed.sparkSession
    n = members.count()
    hint = F.broadcast if n <= BROADCAST_ROWS else (lambda df: df)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # keys are few bytes that become many forms: the number of tasks goes by cores, not by bytes
    forms = typed.repartition(tasks, "key").mapInPandas(_label_forms, "key string, form string")
    people = members.select("member_id", "full_name", "honorific", "constituency")
    register = people.select("member_id", "full_name").mapInPandas(_member_forms, "member_id int, form string").distinct()
    of = register.groupBy("form").agg(F.count("*").alias("df"))
    register = register.join(of, "form").withColumn("rarity", F.lit(log(max(n, 2))) - F.log("df")).select("form", "member_id", "rarity")
    pairs = forms.join(hint(register), "form").groupBy("key", "member_id").agg(F.max("rarity").alias("rarity"))
    scored = pairs.join(hint(people), "member_id").mapInPandas(_score, "key string, member_id int, score double").groupBy("key", "member_id").agg(F.max("score").alias("score"))
    best = scored.groupBy("key").agg(F.max(F.struct("score", "member_id")).alias("b"), F.collect_list("score").alias("all"))
    return best.filter(F.size(F.filter("all", lambda x: x > F.col("b.score") - 1e-9)) == 1).select("key", F.col("b.member_id").alias("member_id"))


def link_names(records: DataFrame, members: DataFrame) -> DataFrame:
    """(rec_id, member_id) of each record of ``records(rec_id, text)`` whose label names a member.

    A label that fits two members equally well links to neither; null and empty texts, labels without a name and
    persons not in the register give no row; repeated records give one row. ``members(member_id, full_name,
    honorific, constituency)`` may hold nulls; other columns are ignored. An empty register links nothing.
    """
    keys = stage(label_keys(records, register_given(members)), "keys")
    links = link_keys(keys.groupBy("key").agg(F.count("*").alias("n")).select("key"), members)
    return keys.join(links, "key").select("rec_id", "member_id").distinct()
