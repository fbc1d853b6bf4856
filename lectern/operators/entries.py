"""Lines into entries: merging, carried-forward headings, pruning, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import clean_text, fix_header_words
from lectern.operators.spans import parse_speaker

ENTRY = ("appointment", "entry_type", "header", "page_number", "speaker", "speaker_cleaned", "subheader", "subsubheader", "text", "title")


def merge_entries(lines: DataFrame) -> DataFrame:
    """(doc, entry, entry_type, speaker, text) of ``lines(doc, line_no, label, speaker, said)``.

    Garbage goes. A line joins the entry before it if it is punctuation or of the same type and: a speech has the same
    speaker or none; a scene is not yet closed by a bracket; a subheading does not end in bill before a t. A speech after
    scenes that continues the speech before them joins that one. One exchange on doc, windows, one aggregate: no Python.
    """
    ordered = Window.partitionBy("doc").orderBy("line_no")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    t = F.coalesce("label", F.lit("~"))
    a = lines.filter(~F.col("label").eqNullSafe("garbage")).select("doc", "line_no", "label", "speaker", F.coalesce("said", F.lit("")).alias("x"), t.alias("t"))
    stops = ~F.col("t").isin("speech", "scene", "punct") | ((F.col("t") == "punct") & (F.row_number().over(ordered) == 1))
    a = a.withColumn("_stop", stops.cast("int")).withColumn("run", F.sum("_stop").over(ordered))
    in_run = Window.partitionBy("doc", "run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    speech = F.col("t") == "speech"
    a = a.withColumn("_ps", F.last(F.when(speech, F.col("speaker")), ignorenulls=True).over(in_run)).withColumn("_n", F.count(F.when(speech, 1)).over(in_run))
    a = a.withColumn("opens", speech & ((F.col("_n") == 0) | F.col("speaker").isNotNull() & ~F.col("speaker").eqNullSafe(F.col("_ps"))))
    a = a.withColumn("_o", F.last(F.when((F.col("t") == "scene") | F.col("opens") | ~F.col("t").isin("speech", "punct"), F.col("t")), ignorenulls=True).over(before))
    a = a.withColumn("hoist", F.coalesce(speech & ~F.col("opens") & (F.col("_o") == "scene"), F.lit(False)))
    h = Window.partitionBy("doc", "hoist").orderBy("line_no")
    a = a.withColumn("_x", F.lag("x").over(h)).withColumn("_t", F.last(F.when(F.col("t") != "punct", F.col("t")), ignorenulls=True).over(h.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_r", F.row_number().over(h))
    bill = F.rlike(F.regexp_replace("_x", r"\s+\z", ""), F.lit(r"(?i)(?:bill|b ill)\z")) & F.rlike("x", F.lit("(?i)^t"))
    flag = (
        F.when(F.col("_r") == 1, True)
        .when(F.col("t") == "punct", False)
        .when(speech, F.col("opens"))
        .when(~F.col("_t").eqNullSafe(F.col("t")), True)
        .when(F.col("t") == "scene", F.col("_x").endswith(")"))
        .when(F.col("t") == "subheader", bill)
        .otherwise(False)
    )
    a = a.withColumn("_f", flag.cast("int")).withColumn("_g", F.when(~F.col("hoist"), F.sum("_f").over(h)))
    a = a.withColumn("entry", F.coalesce("_g", F.last(F.when(F.col("opens"), F.col("_g")), ignorenulls=True).over(before)))
    return a.groupBy("doc", "entry").agg(
        F.min_by("label", "line_no").alias("entry_type"),
        F.min_by("speaker", "line_no").alias("speaker"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "x"))), lambda r: r["x"]), " ").alias("text"),
    )


def distribute_headers(entries: DataFrame, fix_words: bool = False, dictionary: frozenset[str] = frozenset()) -> DataFrame:
    """``entries`` cleaned, with header, subheader and subsubheader carried forward; heading rows lose their own text.

    A heading resets the levels below it. ``fix_words`` also repairs the words of headings.
    """
    head = F.col("entry_type").isin("header", "subheader")
    text = clean_text(F.col("text"))
    low = F.lower(text)
    if fix_words:
        low = fix_header_words(low, dictionary)
    low = F.regexp_replace(low, r"(?is)^prayers?\s+(.+)\z", "$1")
    e = entries.withColumn("text", F.when(head, low).otherwise(text))
    w = Window.partitionBy("doc").orderBy("entry")
    kind = F.col("entry_type")
    e = e.withColumn("_h", F.sum(F.when(kind == "header", 1).otherwise(0)).over(w)).withColumn("_s", F.sum(F.when(kind.isin("header", "subheader"), 1).otherwise(0)).over(w))
    last = lambda level, parts: F.last(F.when(kind == level, F.col("text")), ignorenulls=True).over(Window.partitionBy("doc", *parts).orderBy("entry"))
    e = e.withColumn("header", last("header", [])).withColumn("subheader", last("subheader", ["_h"])).withColumn("subsubheader", last("subsubheader", ["_s"]))
    return e.withColumn("text", F.when(kind.contains("header"), None).otherwise(F.col("text"))).drop("_h", "_s")


def prune(entries: DataFrame) -> DataFrame:
    """Without entries of no type, garbage, and other than headings without text."""
    kind = F.col("entry_type")
    return entries.filter(kind.isNotNull() & (kind != "garbage") & (kind.contains("header") | (F.coalesce(F.char_length("text"), F.lit(0)) > 0)))


def finish(merged: DataFrame, fix_words: bool = True, dictionary: frozenset[str] = frozenset()) -> DataFrame:
    """(doc, entry, ...ENTRY) of merged entries: headings carried, pruned, speakers parsed, columns in order of name."""
    e = prune(distribute_headers(merged, fix_words, dictionary))
    p = parse_speaker(F.col("speaker"))
    e = e.withColumn("_p", p).withColumn("title", F.col("_p.title")).withColumn("speaker_cleaned", F.col("_p.name")).withColumn("appointment", F.col("_p.appointment"))
    return e.withColumn("page_number", F.lit(None).cast("int")).select("doc", "entry", *ENTRY)


def results(documents: DataFrame, entries: DataFrame, meta: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, result): JSON with meta and the ordered entries; both null for a document without lines."""
    listed = entries.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("entry", F.struct(*ENTRY).alias("e")))).alias("es"))
    listed = listed.select("doc", F.transform("es", lambda x: x["e"]).alias("entries"))
    out = documents.select(F.col(doc).alias("doc")).distinct().join(listed, "doc", "left").join(meta, "doc", "left")
    m = F.when(F.col("entries").isNotNull(), F.struct("start_date", "end_date"))
    return out.select("doc", F.to_json(F.struct(m.alias("meta"), F.col("entries")), {"ignoreNullFields": "false"}).alias("result"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one of two tables of entries that the other doesn't have, by all columns, with nulls equal to nulls, each as
    often as it is too many; ``side`` is a or b. Equal tables give none."""
    cols = sorted(a.columns)
    x, y = a.select(*cols), b.select(*cols)
    return x.exceptAll(y).withColumn("side", F.lit("a")).unionByName(y.exceptAll(x).withColumn("side", F.lit("b")))
