"""Speaker spans at the head of lines, and names in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions.text import clean_speaker_name, clean_text, parenth_name, rm_punct, span2bio, strip


def _w() -> WindowSpec:
    """A document's lines in order."""
    return Window.partitionBy("doc").orderBy("line_no")



def _move_segues(df: DataFrame, source: str, scan: str, rest: str) -> DataFrame:
    """Adds ``scan``: the line with the segue that opens the next line moved to its end, and ``rest``: the line without
    the segue it gave to the one before."""
    starts = F.coalesce(F.rlike(F.col(source), F.lit(P.SEGUE)), F.lit(False))
    df = df.withColumn("_own", F.when(starts, F.regexp_extract(F.col(source), f"({P.SEGUE_ANY})", 1)))
    df = df.withColumn("_first", F.row_number().over(_w()) == 1).withColumn("_next", F.lead("_own").over(_w()))
    df = df.withColumn(rest, F.when(F.col("_own").isNotNull() & ~F.col("_first"), F.regexp_replace(F.col(source), P.SEGUE_ANY, "")).otherwise(F.col(source)))
    return df.withColumn(scan, F.when(F.col("_next").isNotNull(), F.concat(F.col(rest), F.lit(" "), F.col("_next"))).otherwise(F.col(rest))).drop("_own", "_first", "_next")


def detect(scan: Column) -> Column:
    """(start, end) of the speaker name at the head of a text: after a known title it may be followed by a verb, else
    only by a colon; the title form wins. Nulls without a name."""
    titled, plain = F.rlike(scan, F.lit(P.SPAN_TITLED)), F.rlike(scan, F.lit(P.SPAN_PLAIN))
    span = lambda p: (F.char_length(F.regexp_extract(scan, p, 1)), F.char_length(F.regexp_extract(scan, p, 2)))
    (a, b), (c, d) = span(P.SPAN_TITLED), span(P.SPAN_PLAIN)
    return F.struct(F.when(titled, a).when(plain, c).alias("start"), F.when(titled, a + b).when(plain, c + d).alias("end"))


def label_spans(lines: DataFrame) -> DataFrame:
    """``lines`` with scan (the text the span is read from), rest (the line after its segue moved up), start, end, bio."""
    df = _move_segues(lines, "text", "scan", "rest")
    s = detect(F.col("scan"))
    df = df.withColumn("start", s["start"]).withColumn("end", s["end"])
    return df.withColumn("bio", span2bio(F.char_length("scan"), F.col("start"), F.col("end")))


def hybrid_spans(spans: DataFrame, flag: str = "has_speaker") -> DataFrame:
    """Spans kept only where ``flag`` is 1; there, a line without one that is short and has a letter is a name as a whole."""
    on = F.coalesce(F.col(flag) == 1, F.lit(False))
    none = F.col("start").isNull()
    whole = on & none & (F.char_length("scan") < 200) & F.rlike(F.col("scan"), F.lit("[A-Za-z]"))
    df = spans.withColumn("end", F.when(whole, F.char_length("scan")).when(on, F.col("end"))).withColumn("start", F.when(whole, 0).when(on, F.col("start")))
    return df.withColumn("bio", span2bio(F.char_length("scan"), F.col("start"), F.col("end")))


def extract_names(spans: DataFrame) -> DataFrame:
    """``spans`` with speaker and said: the name in the span and the remaining text without colons; final is the line as
    the moves of segues left it.

    Segues are moved once more before; names that go on in brackets take the office on the line before, which then says
    nothing; a line that ends in a colon before one that opens with a hyphen has no name.
    """
    df = _move_segues(spans, "rest", "scan2", "final")
    n = F.char_length("scan2")
    start, end = F.least("start", n), F.least("end", n)
    name = F.when(F.col("start").isNotNull(), F.substring(F.col("scan2"), start + 1, end - start))
    name = F.nullif(name, F.lit(""))
    rest = F.concat(F.left("scan2", start), F.substring(F.col("scan2"), end + 1, F.lit(1 << 30)))
    df = df.withColumn("speaker", name).withColumn("said", F.when(F.col("speaker").isNotNull(), F.regexp_replace(rest, P.COLONS, "")).otherwise(F.col("scan2")))
    veto = F.rlike(F.col("final"), F.lit(r":\s*\z")) & F.rlike(F.lead("final").over(_w()), F.lit(r"^\s*-"))
    df = df.withColumn("_veto", F.coalesce(veto, F.lit(False)))
    # offices on the line before
    before = F.lag("said").over(_w())
    office = F.rlike(F.col("speaker"), F.lit(r"^\s*\(")) & F.rlike(before, F.lit(P.GLUE_OFFICE))
    closing = F.rlike(F.col("speaker"), F.lit(r"^[^(]+\)\s*\z")) & F.rlike(before, F.lit(r"^\s*\([^)]+\z"))
    df = df.withColumn("_glue", F.coalesce(office | closing, F.lit(False))).withColumn("_before", before)
    df = df.withColumn("_taken", F.coalesce(F.lead("_glue").over(_w()), F.lit(False)))
    speaker = F.when(F.col("_taken") | F.col("_veto"), None).when(F.col("_glue"), F.concat("_before", F.lit(" "), "speaker")).otherwise(F.col("speaker"))
    said = F.when(F.col("_taken"), "").when(F.col("_veto"), F.col("final")).otherwise(F.col("said"))
    return df.withColumn("_s", speaker).withColumn("said", said).withColumn("speaker", F.col("_s")).drop("_s", "_veto", "_glue", "_before", "_taken", "scan2")


def speeches_only(named: DataFrame) -> DataFrame:
    """Names and spans only on speech lines; others say the whole line and have a bio of O."""
    speech = F.col("label").eqNullSafe("speech")
    return (
        named.withColumn("said", F.when(speech, F.col("said")).otherwise(F.col("final")))
        .withColumn("speaker", F.when(speech, F.col("speaker")))
        .withColumn("bio", F.when(speech, F.col("bio")).otherwise(F.repeat(F.lit("O"), F.char_length("final"))))
    )


def continued_names(named: DataFrame) -> DataFrame:
    """A name that fills its line to the end and goes on in the next one is put before the next, along whole chains.

    ``named(doc, line_no, bio, speaker)``; gives the same rows with speaker extended.
    """
    runs_on = F.col("bio").endswith("I") & F.coalesce(F.rlike(F.lead("bio").over(_w()), F.lit("^[BI]")), F.lit(False))
    df = named.withColumn("_on", F.coalesce(runs_on, F.lit(False)))
    df = df.withColumn("_new", F.when(F.coalesce(F.lag("_on").over(_w()), F.lit(False)), 0).otherwise(1)).withColumn("_chain", F.sum("_new").over(_w()))
    chain = Window.partitionBy("doc", "_chain").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("speaker", F.when(F.col("speaker").isNotNull(), F.array_join(F.collect_list("speaker").over(chain), " ")))
    return df.drop("_on", "_new", "_chain")


def parse_speaker(c: Column) -> Column:
    """(title, name, appointment) of a speaker; the first form that fits decides. A name with speaker, minister or
    members in it is the appointment. All null for null, and where no form fits."""
    s = strip(c)
    parts = []
    for p, groups in P.NAME_PARTS:
        g = lambda k, p=p, groups=groups: F.nullif(F.regexp_extract(s, p, groups[k]), F.lit("")) if k in groups else F.lit(None).cast("string")
        title = F.when(g("title2").isNotNull(), F.concat(F.coalesce(g("title"), F.lit("")), F.lit(" "), g("title2"))).otherwise(g("title"))
        parts.append((F.rlike(s, F.lit(p)), title, strip(g("name")), g("appt")))

    def first(k: int) -> Column:
        out = F.when(parts[0][0], parts[0][k])
        for p in parts[1:]:
            out = out.when(p[0], p[k])
        return out

    title, name, appt = first(1), first(2), first(3)
    office = F.coalesce(F.rlike(name, F.lit(P.OFFICE_WORDS)), F.lit(False))
    appt = F.when(office, F.when(appt.isNotNull(), F.concat(appt, F.lit(" ("), name, F.lit(")"))).otherwise(name)).otherwise(appt)
    name = F.when(~office, clean_speaker_name(name))
    return F.struct(strip(title).alias("title"), name.alias("name"), strip(appt).alias("appointment"))


# Titles of the older form, each followed by a blank but for three.
LEGACY_TITLES = (
    "mr ", "bw ", "ms ", "bi ", "hon ", "capt ", "mrs ", "dr ", "prof ", "gen ", "maj-gen ", "maj ", "major ", "an hon", "a hon", "eng ", "engineer ", "col ", "rtd ", "rev ",
    "sen ", "mheshimiwa",
)


def legacy_parse(c: Column) -> Column:
    """(name, title, appointment) the older way, in small letters and without signs of punctuation.

    What the last bracket to close holds is taken as the name and what stands before it as the appointment, so an office
    in brackets ends as the appointment and the name before it is lost. A name with speaker, minister or members in it is
    the appointment. Null gives nulls.
    """
    low = F.lower(clean_speaker_name(c))
    parts = parenth_name(low, at_begin=False)
    bracket = low.contains("(")
    name = rm_punct(F.when(bracket, parts["inside"]).otherwise(low))
    appt = rm_punct(F.when(bracket, parts["outside"]))
    titled = rf"(?s)^\s*({'|'.join(LEGACY_TITLES)})(.+)"
    has = F.rlike(name, F.lit(titled))
    title = F.when(has, strip(F.regexp_extract(name, titled, 1)))
    bare = F.when(has, strip(F.regexp_extract(name, titled, 2))).otherwise(name)
    office = F.rlike(bare, F.lit("speaker|minister|members"))
    return F.struct(clean_text(F.when(~office, bare)).alias("name"), clean_text(title).alias("title"), clean_text(F.when(office, bare).otherwise(appt)).alias("appointment"))
