"""Date and times of a sitting from the ends of its text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions.text import strip

_MONTH = {m.lower(): i for i, m in enumerate(P.MONTHS_LONG.split("|"), 1)} | {m.lower(): i for m, i in zip(P.MONTHS_SHORT.split("|"), (1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 11, 12))}


def _clean(c: Column) -> Column:
    """Line ends taken out, blanks evened."""
    return F.regexp_replace(strip(F.regexp_replace(c, P.LINE_BREAKS, "")), r"[^\S ]\s*| \s+", " ")


def _in_first_window(c: Column, at_end: bool, hit: str, read: Callable[[Column], Column], least: int = 1) -> Column:
    """``read`` of the first of the growing windows at one end of the text that holds ``hit``; null where none does.

    The widest window is cleaned and searched once. A window holds no more than what it cuts off the text, so at the
    beginning those that end before the first hit (of ``least`` characters) can are left out; the first two others are tried
    alone, as one of them nearly always has it.
    """
    most = P.WINDOW * P.WINDOWS
    take = F.right if at_end else F.left
    cut = take(c, F.lit(most))
    window = lambda k: F.array(_clean(take(cut, k * P.WINDOW)))
    got = lambda a: F.get(F.transform(F.filter(a, lambda w: F.rlike(w, F.lit(hit))), read), F.lit(0))

    def of(wide: Column) -> Column:
        first = F.lit(1) if at_end else F.ceil((F.regexp_instr(wide, F.lit(hit)) - 1 + least) / P.WINDOW).cast("int")
        one = lambda k: F.when(k <= P.WINDOWS, got(window(k)))
        rest = F.when(first + 2 <= P.WINDOWS, got(F.flatten(F.transform(F.sequence(first + 2, F.lit(P.WINDOWS)), window))))
        return F.coalesce(one(first), one(first + 1), rest)

    wide = F.filter(F.array(_clean(cut)), lambda w: F.rlike(w, F.lit(hit)))
    return F.get(F.transform(wide, of), F.lit(0))


def sitting_date(c: Column) -> Column:
    """The first date in the growing windows, weekday forms first; impossible dates count as none."""
    months = F.create_map(*(F.lit(x) for kv in _MONTH.items() for x in kv))

    def one(w: Column) -> Column:
        tries = []
        for p, (d, m, y) in P.SITTING_DATES:
            g = lambda i, p=p: F.regexp_extract(w, p, i)
            tries.append(F.when(F.rlike(w, F.lit(p)), F.concat_ws("-", g(y), F.lpad(months[F.lower(g(m))].cast("string"), 2, "0"), F.lpad(g(d), 2, "0"))))
        return F.coalesce(*tries)

    # every form holds one of the last two; the shortest has a digit, three letters and a year
    either = f"(?:{P.SITTING_DATES[2][0]})|(?:{P.SITTING_DATES[3][0]})"
    return F.try_to_date(_in_first_window(c, False, either, one, 8), "yyyy-MM-dd")


def sitting_time(c: Column, action: str, at_end: bool, fix_midnight: bool = False) -> Column:
    """Minutes after midnight at which the house met or rose; p.m. adds twelve hours but to 12, a.m. adds none."""
    p = P.HOUSE_TIME.format(action=action)

    def one(w: Column) -> Column:
        h, m = F.regexp_extract(w, p, 1).cast("int"), F.regexp_extract(w, p, 2).cast("int")
        half = F.regexp_extract(w, p, 3)
        h = F.when(half.startswith("p") & (h != 12), h + 12).otherwise(h)
        if fix_midnight:
            h = F.when(F.lower(half).startswith("a") & (h == 12), 0).otherwise(h)
        return h * 60 + m

    return _in_first_window(c, at_end, p, one, 16)


def sitting_meta(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, start_date, end_date): timestamps; the date alone where no time was found, no end without one."""
    d, a, z = sitting_date(F.col(text)), sitting_time(F.col(text), "met", False), sitting_time(F.col(text), "rose", True)
    m = documents.select(F.col(doc).alias("doc"), d.cast("timestamp_ntz").alias("d"), a.alias("a"), z.alias("z"))
    plus = lambda mins: F.col("d") + F.make_dt_interval(F.lit(0), F.lit(0), mins)
    return m.select("doc", plus(F.coalesce("a", F.lit(0))).alias("start_date"), F.when(F.col("z").isNotNull(), plus(F.col("z"))).alias("end_date"))
