"""Line predicates and the rule label. All are Columns; null text counts as empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions.text import is_punct, strip


def _like(c: Column, p: str) -> Column:
    return F.coalesce(F.rlike(c, F.lit(p)), F.lit(False))


def is_page_number(c: Column) -> Column:
    return _like(c, P.PAGE_NUMBER)


def is_page_heading(c: Column) -> Column:
    return _like(c, P.PAGE_HEADING)


def is_page_date(c: Column) -> Column:
    s = F.regexp_replace(strip(c), r"\s+", " ")
    return (F.coalesce(F.char_length(s), F.lit(0)) <= 70) & reduce(lambda a, b: a | b, [_like(s, p) for p in (P.LONG_DATE, *P.PAGE_DATES)])


def is_page_footer(c: Column) -> Column:
    return _like(strip(c), P.PAGE_FOOTER)


def is_transcript_heading(c: Column) -> Column:
    s = strip(c)
    return (F.coalesce(F.char_length(s), F.lit(0)) > 0) & _like(s, P.TRANSCRIPT_HEADING)


def is_garbage(c: Column) -> Column:
    """Empty, or a page number, heading, date or footer."""
    return c.isNull() | (c == "") | is_page_number(c) | is_page_heading(c) | is_page_date(c) | is_page_footer(c)


def is_header(c: Column, headers: list[str]) -> Column:
    """In the list of headings, whatever the case."""
    return F.coalesce(F.lower(strip(c)).isin(headers), F.lit(False)) if headers else F.lit(False)


def is_subheader(c: Column, headers: list[str], tag_names: Column | None = None) -> Column:
    s = strip(c)
    tagged = F.lit(False) if tag_names is None else F.coalesce(F.exists(tag_names, lambda t: t.contains("header")), F.lit(False))
    return ~is_header(c, headers) & (tagged | ((s == F.upper(s)) & ~s.endswith(".")) | _like(s, P.SUBHEADER))


def is_subsubheader(c: Column) -> Column:
    s = strip(c)
    return (F.char_length(s) < 200) & _like(s, P.SUBSUBHEADER)


def is_speech(c: Column, tag_names: Column | None = None) -> Column:
    s = strip(c)
    tagged = F.lit(False) if tag_names is None else F.coalesce(F.exists(tag_names, lambda t: t.contains("speech")), F.lit(False))
    return tagged | (s != F.upper(s))


def is_scene(c: Column, tag_names: Column | None = None) -> Column:
    s = strip(c)
    tagged = F.lit(False) if tag_names is None else F.coalesce(F.exists(tag_names, lambda t: t.contains("scene")), F.lit(False))
    return tagged | ((s != F.upper(s)) & _like(s, P.BRACKETED))


def rule_label(c: Column, headers: list[str], tag_names: Column | None = None) -> Column:
    """garbage, punct, header, subheader, subsubheader, scene or speech, the first that holds; null if none does
    (capitals that end in a full stop). ``tag_names`` makes tags count as evidence."""
    return (
        F.when(is_garbage(c), "garbage")
        .when(is_punct(c, True), "punct")
        .when(is_header(c, headers), "header")
        .when(is_subheader(c, headers, tag_names), "subheader")
        .when(is_subsubheader(c), "subsubheader")
        .when(is_scene(c, tag_names), "scene")
        .when(is_speech(c, tag_names), "speech")
    )


def refine_header(c: Column, headers: list[str]) -> Column:
    """Which heading a line predicted to be one is: header if listed, subsubheader if the subheader test holds, else subheader."""
    return F.when(is_header(c, headers), "header").when(is_subheader(c, headers), "subsubheader").otherwise("subheader")


def override_applies(c: Column) -> Column:
    """Whether a lone heading can't be one: under 4 characters, signs and digits only, or a short line with a weekday."""
    n = F.char_length(c)
    return (n < 4) | _like(c, P.OVERRIDE_SIGNS) | ((n < 20) & _like(c, f"(?i){P.WEEKDAYS}"))


def label_hits(c: Column, headers: list[str]) -> Column:
    """How many of the tests for header, subheader, subsubheader, scene and speech a line passes; 0 where it is garbage or
    punctuation, which are told first. More than one is a conflict that the order of the rules settles."""
    tests = (is_header(c, headers), is_subheader(c, headers), is_subsubheader(c), is_scene(c), is_speech(c))
    n = sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))
    return F.when(is_garbage(c) | is_punct(c, True), 0).otherwise(n)
