"""Queries for the transcript operators, each with the same in SQL where SQL can say it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions import predicates, text
from lectern.operators import entries, labels, lines, models, sittings, spans, supervised, training
from lectern.sources import files
from lectern.sources.tables import table

TALK, TYPES = "speaker_name_hand_labels_w_text20", "hansard_txt_hand_labels_w_text"

# ---------------------------------------------------------------- inputs


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Each transcript line once; later deliveries of a record repeat file, line and text."""
    return table(spark, d, TALK).select("rec_id", "file", "line", "text").distinct()


def _headers(spark: SparkSession, d: str) -> list[str]:
    return sorted(r.header for r in table(spark, d, "headers").collect() if r.header)  # a fixed list


def _lines(spark: SparkSession, d: str) -> DataFrame:
    # one exchange on blocks of a file serves the removal of repeats and the numbering
    r = table(spark, d, TALK).select("rec_id", "file", "line", "text").withColumn("b", F.floor(F.col("line") / lines.BLOCK))
    r = r.repartition("file", "b").distinct()
    return lines.split_lines(r.withColumn("o", F.struct("line", "rec_id")), "file", "text", "o", "b")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return lines.in_blocks(labels.label_lines(_lines(spark, d), _headers(spark, d)), labels.override_headers)


def _named(spark: SparkSession, d: str) -> DataFrame:
    def run(l: DataFrame) -> DataFrame:
        return spans.speeches_only(spans.extract_names(spans.label_spans(labels.override_headers(l))))

    return lines.in_blocks(labels.label_lines(_lines(spark, d), _headers(spark, d)), run)


def _types(spark: SparkSession, d: str) -> DataFrame:
    """Line-type labels, exact duplicates once, the label in one spelling."""
    return table(spark, d, TYPES).distinct().withColumn("label", training.label_name(F.col("label")))


def _sitting_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents within the opening and closing lines of a sitting."""
    day = (F.col("doc_id") % 28 + 1).cast("string")
    head = F.concat(F.lit("OFFICIAL REPORT\n"), F.when(F.col("doc_id") % 3 == 0, F.lit("Tuesday, ")).otherwise(""), day, F.lit("th March, "), F.coalesce("year", F.lit(1970)).cast("string"), F.lit("\nThe House met at "), (F.col("doc_id") % 12 + 1).cast("string"), F.when(F.col("doc_id") % 2 == 0, ".").otherwise(":"), F.lit("30 p.m.\n"))
    tail = F.when(F.col("doc_id") % 5 != 0, "\nThe House rose at 6.15 p.m.").otherwise("")
    return table(spark, d, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit("")), tail).alias("text"))


# ---------------------------------------------------------------- queries


def ascii_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", text.ascii_fold(F.col("text")).alias("folded"))


def split_lines_renumber(spark, d):
    return lines.split_lines(table(spark, d, "documents")).select("doc", "line_no", "text")


def line_range_scan(spark, d):
    return lines.line_range(lines.split_lines(table(spark, d, "documents")), 2, 6).select("doc", "line_no", "text")


def clean_text_functions(spark, d):
    t = F.col("text")
    return _records(spark, d).select("rec_id", text.clean_text(t).alias("cleaned"), text.rm_punct(t).alias("bare"), text.rm_wrapping_punct(t).alias("unwrapped"), text.is_punct(t, True).alias("only_punct"), text.clean_speaker_name(t).alias("name_cleaned"))


def tag_extract(spark, d):
    t = F.col("text")
    return _records(spark, d).select("rec_id", text.strip_tags(t).alias("untagged"), F.array_join(text.tags(t), ",").alias("tag_names"), text.tag_whitespace(t).alias("spaced"))


def parenthesised_names(spark, d):
    a, b = text.parenth_name(F.col("text")), text.parenth_name(F.col("text"), False)
    return _records(spark, d).select("rec_id", a["inside"].alias("a_in"), a["outside"].alias("a_out"), b["inside"].alias("b_in"), b["outside"].alias("b_out"))


def page_predicates(spark, d):
    t = F.col("text")
    fs = (predicates.is_page_number, predicates.is_page_heading, predicates.is_page_date, predicates.is_page_footer, predicates.is_transcript_heading, predicates.is_garbage)
    return _lines(spark, d).select("doc", "line_no", *(f(t).alias(f.__name__[3:]) for f in fs))


def header_dictionary_semi(spark, d):
    h = table(spark, d, "headers").select(F.col("header").alias("_h"))
    l = _lines(spark, d).withColumn("_h", F.lower(text.strip(F.col("text"))))
    return l.join(h, "_h", "left_semi").select("doc", "line_no", "text")


def header_dictionary_anti(spark, d):
    h = table(spark, d, "headers").select(F.col("header").alias("_h"))
    l = _lines(spark, d).withColumn("_h", F.lower(text.strip(F.col("text"))))
    return l.join(h, "_h", "left_anti").groupBy("doc").agg(F.count("*").alias("n"))


def label_rule(spark, d):
    return labels.label_lines(_lines(spark, d), _headers(spark, d)).select("doc", "line_no", "label")


def label_rule_tags(spark, d):
    return labels.label_lines(_lines(spark, d), _headers(spark, d), use_tags=True).groupBy("doc", "label").agg(F.count("*").alias("n"))


def label_rule_documents(spark, d):
    docs = table(spark, d, "documents")
    l = labels.label_lines(lines.split_lines(docs), _headers(spark, d))
    return l.join(docs.select(F.col("doc_id").alias("doc"), "lang"), "doc").groupBy("lang", "label").agg(F.count("*").alias("n"))


def header_override(spark, d):
    return _labelled(spark, d).select("doc", "line_no", "label", "overridden")


def label_audit(spark, d):
    return labels.label_counts(_labelled(spark, d))


def header_refine(spark, d):
    l = labels.label_lines(_lines(spark, d), _headers(spark, d)).filter(F.col("label").contains("header"))
    return l.select("doc", "line_no", predicates.refine_header(F.col("text"), _headers(spark, d)).alias("refined"))


def span_detect(spark, d):
    return lines.in_blocks(_lines(spark, d), spans.label_spans).select("doc", "line_no", "scan", "rest", "start", "end", "bio")


def speaker_extract(spark, d):
    return _named(spark, d).select("doc", "line_no", "speaker", "said")


def hybrid_span(spark, d):
    l = lines.in_blocks(_lines(spark, d), spans.label_spans).withColumn("has_speaker", (F.col("line_no") % 3 == 0).cast("int"))
    return spans.hybrid_spans(l).select("doc", "line_no", "start", "end")


def continued_name(spark, d):
    l = spans.label_spans(_lines(spark, d)).withColumn("has_speaker", (F.col("line_no") % 5 < 3).cast("int"))
    h = spans.hybrid_spans(l)
    name = F.when(F.col("start").isNotNull(), F.substring(F.col("scan"), F.col("start") + 1, F.col("end") - F.col("start")))
    return spans.continued_names(h.withColumn("speaker", name)).select("doc", "line_no", "speaker")


def parse_speaker_name(spark, d):
    p = spans.parse_speaker(F.col("speaker"))
    return _named(spark, d).select("speaker").filter("speaker is not null").distinct().select("speaker", p["title"].alias("title"), p["name"].alias("name"), p["appointment"].alias("appointment"))


def legacy_parse_name(spark, d):
    p = spans.legacy_parse(F.col("speaker"))
    return _named(spark, d).select("speaker").filter("speaker is not null").distinct().select("speaker", p["name"].alias("name"), p["title"].alias("title"), p["appointment"].alias("appointment"))


def merge_entries(spark, d):
    return entries.merge_entries(_named(spark, d)).select("doc", "entry", "entry_type", "speaker", "text")


def distribute_headers(spark, d):
    return entries.distribute_headers(entries.merge_entries(_named(spark, d))).select("doc", "entry", "entry_type", "header", "subheader", "subsubheader", "text")


def entries_full(spark, d):
    return models.parse(_lines(spark, d), _headers(spark, d), fix_words=False, spread=True)


def _heading_words(spark: SparkSession, d: str) -> list[str]:
    """The words of the known headings, as the dictionary that tells words from pieces of words."""
    return sorted({w for h in _headers(spark, d) for w in re.findall("[a-z]{2,}", h)})


def entries_fixed(spark, d):
    return models.parse(_lines(spark, d), _headers(spark, d), dictionary=frozenset(_heading_words(spark, d)), spread=True)


def fix_header_words(spark, d):
    l = labels.label_lines(_lines(spark, d), _headers(spark, d)).filter(F.col("label").isin("header", "subheader"))
    return l.select("doc", "line_no", text.fix_header_words(F.col("text"), _heading_words(spark, d)).alias("fixed"))


def parse_diagnostics(spark, d):
    return models.diagnostics(models.parse(_lines(spark, d), _headers(spark, d), unmerged=True, spread=True))


def sitting_metadata(spark, d):
    m = sittings.sitting_meta(_sitting_texts(spark, d))
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return m.select("doc", f("start_date").alias("starts"), f("end_date").alias("ends"))


def result_json(spark, d):
    docs = _sitting_texts(spark, d)
    got = models.parse(lines.split_lines(docs), _headers(spark, d))
    return entries.results(docs, got, sittings.sitting_meta(docs))


def line_context_4(spark, d):
    return lines.in_blocks(_lines(spark, d), lines.line_context).select("doc", "line_no", "prev_context", "next_context")


def truncate_2048(spark, d):
    t = text.truncate(F.col("text"), F.col("context"))
    l = lines.line_context(lines.split_lines(table(spark, d, "documents")))
    return l.select("doc", "line_no", F.char_length(t["text"]).alias("text_chars"), F.md5(F.concat(t["text"], F.lit("|"), t["context"])).alias("cut"))


def _short(texts: list[str], contexts: list[str]) -> list[int]:
    return [int(len(t) < 60) for t in texts]


def speech_only_predict(spark, d):
    return models.predict(_labelled(spark, d), _short, "has_speaker", "int", models.BATCH["has_speaker"], "speech", 0).select("doc", "line_no", "has_speaker")


def _span_labels(spark: SparkSession, d: str) -> DataFrame:
    """A record's latest span labels."""
    t = table(spark, d, TALK)
    return t.groupBy("rec_id").agg(F.max_by(F.struct("year", "file", "line", "start", "end", "notes", "text"), F.struct("loaded_at", "coded_at", "start", "end", "year", "notes")).alias("r")).select("rec_id", "r.*")


def span2bio_bio2span(spark, d):
    s = training.with_bio(training.default_spans(table(spark, d, TALK).select("rec_id", "text", "start", "end").distinct()))
    back = text.bio2span(F.col("bio"))
    return s.select("rec_id", "start", "end", "bio", back["start"].alias("back_start"), back["end"].alias("back_end"), "has_speaker")


def span_quality(spark, d):
    return training.span_quality(training.default_spans(table(spark, d, TALK).select("rec_id", "text", "start", "end")))


def bio_tokens(spark, d):
    s = training.with_bio(training.default_spans(table(spark, d, TALK).select("rec_id", "text", "start", "end").distinct()))
    return s.select("rec_id", text.spaced(F.col("bio")).alias("spaced"), F.md5(F.array_join(text.bio_codes(F.col("bio")).cast("array<string>"), " ")).alias("codes"))


def encode_chars(spark, d):
    l = lines.in_blocks(_lines(spark, d), lines.line_context)
    return l.select("doc", "line_no", F.md5(F.array_join(text.encode_chars(F.col("text")).cast("array<string>"), " ")).alias("ids"), F.md5(F.array_join(text.encode_chars(F.col("text"), F.col("context")).cast("array<string>"), " ")).alias("with_context"))


def class_weights(spark, d):
    w = training.class_weights(training.usable(_types(spark, d)))
    return w.select("label", "n", F.round("share", 9).alias("share"), F.round(F.col("weight") * F.col("n"), 9).alias("class_mass"))


def label_quality(spark, d):
    return training.quality(_types(spark, d))


def label_codes(spark, d):
    c = training.label_code(F.col("label"))
    return _types(spark, d).groupBy("label").agg(F.count("*").alias("n")).select("label", c.alias("code"), training.code_label(c).alias("back"), "n")


def label_set_difference(spark, d):
    got = _types(spark, d).select("label").filter("label is not null").distinct()
    known = spark.createDataFrame([(k,) for k in P.LABEL_CODES], "label string")
    return got.exceptAll(known).withColumn("side", F.lit("unknown")).unionByName(known.exceptAll(got).withColumn("side", F.lit("missing")))


def split_by_sitting(spark, d):
    return training.split(_types(spark, d), ["file"]).groupBy("file", "split").agg(F.count("*").alias("n"))


def split_by_line(spark, d):
    return training.split(_records(spark, d), ["file", "line"]).select("rec_id", "split")


def split_lines_semi(spark, d):
    t = _types(spark, d)
    return training.lines_of(_records(spark, d), training.split(t.select("file").distinct(), ["file"]).filter("split = 'train'")).select("rec_id")


def augment_split_md5(spark, d):
    t = training.usable(_types(spark, d)).filter("text is not null").select("folder", "file", "line", "label", "text").distinct()
    return training.split_lines_randomly(t, ["folder", "file", "line", "label", "text"]).select("file", "line", "label", "text")


def duplicate_without_garbage(spark, d):
    return training.without_garbage(training.usable(_types(spark, d))).groupBy("file", "label").agg(F.count("*").alias("n"))


def upsample_weighted(spark, d):
    return training.upsample(training.usable(_types(spark, d)).select("file", "line", "label"))


def prep_training_lines(spark, d):
    t = training.usable(_types(spark, d)).filter("text is not null").select("folder", "file", "line", "label", "text").distinct()
    c = lines.line_context(t, group=["folder", "file"], order=["line", "label", "text"])
    return training.context_rows(c).select("folder", "file", "line", "label", "prev_context", "next_context")


def context_join(spark, d):
    t = training.usable(_types(spark, d)).filter("text is not null").groupBy("folder", "file", "line").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    c = lines.line_context(t, group=["folder", "file"], order=["line"]).select("folder", "file", "line", "next_context")
    return training.join_context(t, c, ["folder", "file", "line"])[0].select("folder", "file", "line", "label", "next_context")


def meta_files(spark, d):
    return files.file_list(table(spark, d, "hansard_meta").withColumn("sequence_id", F.col("sequence_id").cast("string")))


def label_ids_left_join(spark, d):
    ids = meta_files(spark, d)
    t = _types(spark, d).select(F.col("folder").cast("string").alias("folder"), "file", "line")
    return training.file_ids(t, ids).groupBy("file").agg(F.count("*").alias("n"), F.count("_id").alias("with_id"))


def missing_ids_anti(spark, d):
    t = _types(spark, d).select(F.col("folder").cast("string").alias("folder"), "file")
    return training.missing_ids(t, meta_files(spark, d))


def label_text_left_join(spark, d):
    ids = _types(spark, d).groupBy("file").agg(F.max("_id").alias("_id"))
    text_lines = _records(spark, d).join(ids, "file").groupBy("_id", "line").agg(F.min("text").alias("spoken"))
    return training.label_texts(_types(spark, d).select("_id", "line", "label").distinct(), text_lines).select("_id", "line", "label", "spoken")


def batch_ids(spark, d):
    return lines.batch_ids(_records(spark, d), 50, ["line", "rec_id"], ["file"]).select("rec_id", "batch")


def raw_line_lookup(spark, d):
    wanted = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), (F.col("doc_id") % 4 + 1).cast("int").alias("line"))
    return wanted.join(lines.raw_lines(table(spark, d, "documents")), ["doc", "line"], "left").select("doc", "line", "text")


def escapes(spark, d):
    t = F.col("text")
    return _records(spark, d).select("rec_id", text.html_escape(t).alias("html"), text.base64_text(t).alias("b64"), text.filetype(F.col("file")).alias("filetype"), text.disposition_filename(F.concat(F.lit('attachment; filename="'), "file", F.lit('"'))).alias("filename"))


def files_not_labelled(spark, d):
    return _records(spark, d).select("file").distinct().join(_types(spark, d).select("file"), "file", "left_anti")


def label_conflicts(spark, d):
    h = predicates.label_hits(F.col("text"), _headers(spark, d))
    return labels.label_lines(_lines(spark, d), _headers(spark, d)).groupBy("label", h.alias("hits")).agg(F.count("*").alias("n"))


def share_weights(spark, d):
    return training.share_weights(training.usable(_types(spark, d)), "label").select("label", "n", F.round("weight", 9).alias("weight"))


def total_sort(spark, d):
    return training.total_sort(table(spark, d, TALK).select("rec_id", "year", "file", "line"), ("year", "file", "line", "rec_id"))


def vocabulary_texts(spark, d):
    got = files.vocabulary_texts([(table(spark, d, TALK), "text"), (table(spark, d, TYPES), "text"), (table(spark, d, "headers"), "header")])
    return got.groupBy("text").agg(F.count("*").alias("n"))


def bio_decoded(spark, d):
    s = training.with_bio(training.default_spans(table(spark, d, TALK).select("rec_id", "text", "start", "end").distinct()))
    return s.select("rec_id", "start", "end", text.bio_decode(text.bio_codes(F.col("bio"))).alias("bio"))


def merge_turns(spark, d):
    l = labels.override_headers(labels.label_lines(lines.split_lines(table(spark, d, "documents")), _headers(spark, d)))
    return entries.merge_entries(spans.speeches_only(spans.extract_names(spans.label_spans(l)))).select("doc", "entry", "entry_type", "speaker", "text")


def appointment_glue(spark, d):
    return _named(spark, d).filter(F.rlike("speaker", F.lit("[()]"))).select("doc", "line_no", "speaker", "said")


def supervised_line_types(spark, d):
    t = training.usable(_types(spark, d)).filter("text is not null").select("folder", "file", "line", "label", "text").distinct()
    t = training.split(lines.line_context(t, group=["folder", "file"], order=["line", "label", "text"]), ["file"])
    model = supervised.fit_line_types(t.filter("split = 'train'"))
    got = supervised.predict_line_types(model, t.filter("split <> 'train'"), "predicted")
    return got.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def debug_head(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 1500).alias("head"))


# ---------------------------------------------------------------- the same in SQL


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rep(x: str, p: str, r: str = "") -> str:
    return f"regexp_replace({x}, {_q(p)}, {_q(r)}, 'g')"


def _like(x: str, p: str) -> str:
    return f"coalesce(regexp_matches({x}, {_q(p)}), false)"


def _ext(x: str, p: str, g: int) -> str:
    return f"regexp_extract({x}, {_q(p)}, {g})"


def _strip(x: str) -> str:
    return _rep(x, P.STRIP)


def _fold(x: str) -> str:
    a, b, longer = text.fold_table()
    wide = f"translate({x}, {_q(a)}, {_q(b)})"
    for u, v in longer:
        wide = f"replace({wide}, {_q(u)}, {_q(v)})"
    return f"CASE WHEN strlen({x}) = length({x}) THEN {x} ELSE {_rep(wide, '[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')} END"


def _clean(x: str) -> str:
    s = _rep(_rep(_strip(x), r"[ \t]+", " "), r"^[):]+")
    return f"CASE WHEN {s} = '(' THEN '' ELSE {s} END"


_UNWRAP = rf"^{P.PUNCT}(.*){P.PUNCT}\z"
_REC = f"rec AS (SELECT DISTINCT rec_id, file, line, text FROM {TALK})"


def _split_sql(source: str, doc: str, order: str) -> str:
    angled = "(contains(t, '<') OR contains(t, '>'))"
    names = f"list_transform(regexp_extract_all(t, {_q(P.TAGS)}), lambda x: lower({_rep('x', P.TAG_NOISE)}))"
    return f"""parts0 AS (SELECT {doc} AS doc, {order} AS o, string_split_regex({_fold('text')}, {_q(P.LINE_BREAKS)}) AS a FROM {source} WHERE text IS NOT NULL AND {doc} IS NOT NULL),
parts1 AS (SELECT doc, o, unnest(a) AS t0, unnest(range(len(a))) AS p FROM parts0),
parts2 AS (SELECT doc, o, p, {_strip('t0')} AS t FROM parts1),
parts3 AS (SELECT doc, o, p, CASE WHEN {angled} THEN {_rep('t', P.TAGS)} ELSE t END AS text, CASE WHEN {angled} THEN list_sort(list_distinct(list_filter({names}, lambda x: x <> ''))) ELSE [] END AS tags FROM parts2),
lines AS (SELECT doc, text, tags, row_number() OVER (PARTITION BY doc ORDER BY o, p) - 1 AS line_no FROM parts3 WHERE text <> '')"""


_LINES = f"{_REC}, {_split_sql('rec', 'file', 'struct_pack(a := line, b := rec_id)')}"
_DOC_LINES = _split_sql("documents", "doc_id", "0")


def _pred(name: str, x: str = "text") -> str:
    s = _strip(x)
    flat = _rep(s, r"\s+", " ")
    up = f"{s} <> upper({s})"
    head = f"coalesce(lower({s}) IN (SELECT header FROM headers WHERE header IS NOT NULL), false)"
    garbage = "({x} IS NULL OR {x} = '' OR {n} OR {h} OR {d} OR {f})"
    out = {
        "page_number": _like(x, P.PAGE_NUMBER),
        "page_heading": _like(x, P.PAGE_HEADING),
        "page_date": f"(coalesce(length({flat}), 0) <= 70 AND ({' OR '.join(_like(flat, p) for p in (P.LONG_DATE, *P.PAGE_DATES))}))",
        "page_footer": _like(s, P.PAGE_FOOTER),
        "transcript_heading": f"(coalesce(length({s}), 0) > 0 AND {_like(s, P.TRANSCRIPT_HEADING)})",
        "header": head,
        "subsubheader": f"(length({s}) < 200 AND {_like(s, P.SUBSUBHEADER)})",
        "scene": f"({up} AND {_like(s, P.BRACKETED)})",
        "speech": f"({up})",
        "punct": _like(s, rf"^{P.PUNCT}*\z"),
    }
    out["subheader"] = f"(NOT {head} AND (({s} = upper({s}) AND NOT ends_with({s}, '.')) OR {_like(s, P.SUBHEADER)}))"
    out["garbage"] = garbage.format(x=x, n=out["page_number"], h=out["page_heading"], d=out["page_date"], f=out["page_footer"])
    return out[name]


def _label_sql(tagged: bool = False) -> str:
    tag = lambda w: f"OR len(list_filter(tags, lambda x: contains(x, '{w}'))) > 0" if tagged else ""
    sub = _pred("subheader") if not tagged else f"(NOT {_pred('header')} AND ({_pred('subheader')} {tag('header')}))"
    rows = [("garbage", _pred("garbage")), ("punct", _pred("punct")), ("header", _pred("header")), ("subheader", sub), ("subsubheader", _pred("subsubheader")), ("scene", f"({_pred('scene')} {tag('scene')})"), ("speech", f"({_pred('speech')} {tag('speech')})")]
    return "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in rows) + " END"


_LABELLED0 = f"{_LINES}, labelled0 AS (SELECT *, {_label_sql()} AS label FROM lines)"
_HEAD = "coalesce(contains({}, 'header'), false)"
_LABELLED = f"""{_LABELLED0},
near AS (SELECT *, lag(label) OVER w AS pl, lead(label) OVER w AS nl, lag(text) OVER w AS pt, lead(text) OVER w AS nt FROM labelled0 WINDOW w AS (PARTITION BY doc ORDER BY line_no)),
judged AS (SELECT *, (pt IS NOT NULL AND nt IS NOT NULL AND {_HEAD.format('label')} AND NOT {_HEAD.format('pl')} AND NOT {_HEAD.format('nl')}
  AND (length(text) < 4 OR {_like('text', P.OVERRIDE_SIGNS)} OR (length(text) < 20 AND {_like('text', '(?i)' + P.WEEKDAYS)}))) AS overridden FROM near),
labelled AS (SELECT doc, line_no, text, tags, CASE WHEN overridden THEN pl ELSE label END AS label, overridden FROM judged)"""


def _segue_sql(src: str, col: str, scan: str, rest: str, out: str, own_any: str = P.SEGUE_ANY) -> str:
    return f"""{out}a AS (SELECT *, CASE WHEN {_like(col, P.SEGUE)} THEN {_ext(col, '(' + own_any + ')', 1)} END AS own_{out}, row_number() OVER (PARTITION BY doc ORDER BY line_no) = 1 AS first_{out} FROM {src}),
{out}b AS (SELECT *, lead(own_{out}) OVER (PARTITION BY doc ORDER BY line_no) AS next_{out}, CASE WHEN own_{out} IS NOT NULL AND NOT first_{out} THEN {_rep(col, own_any)} ELSE {col} END AS {rest} FROM {out}a),
{out} AS (SELECT *, CASE WHEN next_{out} IS NOT NULL THEN {rest} || ' ' || next_{out} ELSE {rest} END AS {scan} FROM {out}b)"""


def _spans_sql(src: str) -> str:
    t, p = P.SPAN_TITLED, P.SPAN_PLAIN
    return f"""{_segue_sql(src, 'text', 'scan', 'rest', 'moved')},
spans0 AS (SELECT *, {_like('scan', t)} AS titled, {_like('scan', p)} AS plain FROM moved),
spans AS (SELECT *, CASE WHEN titled THEN length({_ext('scan', t, 1)}) WHEN plain THEN length({_ext('scan', p, 1)}) END AS s,
  CASE WHEN titled THEN length({_ext('scan', t, 1)}) + length({_ext('scan', t, 2)}) WHEN plain THEN length({_ext('scan', p, 1)}) + length({_ext('scan', p, 2)}) END AS e FROM spans0)"""


_BIO = "CASE WHEN {s} IS NOT NULL AND {e} IS NOT NULL AND {e} > {s} THEN repeat('O', {s}) || 'B' || repeat('I', {e} - {s} - 1) || repeat('O', greatest(0, {n} - {e})) ELSE repeat('O', {n}) END"
_NAMED = f"""{_LABELLED}, {_spans_sql('labelled')}, {_segue_sql('spans', 'rest', 'scan2', 'final', 'again')},
cut AS (SELECT *, least(s, length(scan2)) AS s2, least(e, length(scan2)) AS e2 FROM again),
took AS (SELECT *, nullif(CASE WHEN s IS NOT NULL THEN substr(scan2, s2 + 1, e2 - s2) END, '') AS name0 FROM cut),
told AS (SELECT *, CASE WHEN name0 IS NOT NULL THEN {_rep("(left(scan2, s2) || substr(scan2, e2 + 1))", P.COLONS)} ELSE scan2 END AS said0 FROM took),
seen AS (SELECT *, lag(said0) OVER w AS before, coalesce(regexp_matches(final, {_q(chr(58) + chr(92) + 's*' + chr(92) + 'z')}) AND regexp_matches(lead(final) OVER w, {_q('^' + chr(92) + 's*-')}), false) AS veto FROM told WINDOW w AS (PARTITION BY doc ORDER BY line_no)),
glued AS (SELECT *, coalesce((regexp_matches(name0, {_q('^' + chr(92) + 's*' + chr(92) + '(')}) AND regexp_matches(before, {_q(P.GLUE_OFFICE)})) OR (regexp_matches(name0, {_q('^[^(]+' + chr(92) + ')' + chr(92) + 's*' + chr(92) + 'z')}) AND regexp_matches(before, {_q('^' + chr(92) + 's*' + chr(92) + '([^)]+' + chr(92) + 'z')})), false) AS glue FROM seen),
given AS (SELECT *, coalesce(lead(glue) OVER (PARTITION BY doc ORDER BY line_no), false) AS taken FROM glued),
named0 AS (SELECT *, CASE WHEN taken OR veto THEN NULL WHEN glue THEN before || ' ' || name0 ELSE name0 END AS speaker0, CASE WHEN taken THEN '' WHEN veto THEN final ELSE said0 END AS said1 FROM given),
named AS (SELECT doc, line_no, label, CASE WHEN label = 'speech' THEN speaker0 END AS speaker, CASE WHEN label = 'speech' THEN said1 ELSE final END AS said FROM named0)"""


def _parse_sql(src: str) -> str:
    cols = []
    for k in ("title", "name", "appt"):
        rows = []
        for p, g in P.NAME_PARTS:
            one = lambda x, p=p, g=g: f"nullif({_ext('sp', p, g[x])}, '')" if x in g else "NULL"
            v = one(k) if k != "title" else (f"CASE WHEN {one('title2')} IS NOT NULL THEN coalesce({one('title')}, '') || ' ' || {one('title2')} ELSE {one('title')} END" if "title2" in g else one("title"))
            rows.append(f"WHEN {_like('sp', p)} THEN {v}")
        cols.append(f"CASE {' '.join(rows)} END AS {k}0")
    return f"""np0 AS (SELECT *, {_strip('speaker')} AS sp FROM {src}), np1 AS (SELECT *, {', '.join(cols)} FROM np0),
np2 AS (SELECT *, {_strip('name0')} AS name1, coalesce(regexp_matches({_strip('name0')}, {_q(P.OFFICE_WORDS)}), false) AS office FROM np1),
np AS (SELECT * EXCLUDE (sp, title0, name0, appt0, name1, office), {_strip('title0')} AS title, CASE WHEN NOT office THEN {_rep(_rep('name1', chr(92) + 's+', ' '), _UNWRAP, chr(92) + '1')} END AS name,
  {_strip("CASE WHEN office THEN CASE WHEN appt0 IS NOT NULL THEN appt0 || ' (' || name1 || ')' ELSE name1 END ELSE appt0 END")} AS appointment FROM np2)"""


_MERGED = f"""{_NAMED},
m0 AS (SELECT doc, line_no, label, speaker, coalesce(said, '') AS x, coalesce(label, '~') AS t FROM named WHERE label IS DISTINCT FROM 'garbage'),
m1 AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line_no) AS rn FROM m0),
m2 AS (SELECT *, sum(CASE WHEN t NOT IN ('speech', 'scene', 'punct') OR (t = 'punct' AND rn = 1) THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS run FROM m1),
m3 AS (SELECT *, last_value(CASE WHEN t = 'speech' THEN speaker END IGNORE NULLS) OVER w AS ps, count(CASE WHEN t = 'speech' THEN 1 END) OVER w AS nsp FROM m2 WINDOW w AS (PARTITION BY doc, run ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m4 AS (SELECT *, (t = 'speech' AND (nsp = 0 OR (speaker IS NOT NULL AND speaker IS DISTINCT FROM ps))) AS opens FROM m3),
m5 AS (SELECT *, last_value(CASE WHEN t = 'scene' OR opens OR t NOT IN ('speech', 'punct') THEN t END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opener FROM m4),
m6 AS (SELECT *, coalesce(t = 'speech' AND NOT opens AND opener = 'scene', false) AS hoist FROM m5),
m7 AS (SELECT *, lag(x) OVER (PARTITION BY doc, hoist ORDER BY line_no) AS lx, last_value(CASE WHEN t <> 'punct' THEN t END IGNORE NULLS) OVER (PARTITION BY doc, hoist ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lt, row_number() OVER (PARTITION BY doc, hoist ORDER BY line_no) AS rn2 FROM m6),
m8 AS (SELECT *, CASE WHEN rn2 = 1 THEN 1 WHEN t = 'punct' THEN 0 WHEN t = 'speech' THEN opens::INT WHEN lt IS DISTINCT FROM t THEN 1 WHEN t = 'scene' THEN ends_with(lx, ')')::INT
  WHEN t = 'subheader' THEN (regexp_matches(regexp_replace(lx, {_q(chr(92) + 's+' + chr(92) + 'z')}, ''), {_q('(?i)(?:bill|b ill)' + chr(92) + 'z')}) AND regexp_matches(x, '(?i)^t'))::INT ELSE 0 END AS f FROM m7),
m9 AS (SELECT *, CASE WHEN NOT hoist THEN sum(f) OVER (PARTITION BY doc, hoist ORDER BY line_no) END AS g FROM m8),
m10 AS (SELECT *, coalesce(g, last_value(CASE WHEN opens THEN g END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS entry FROM m9),
merged AS (SELECT doc, entry::BIGINT AS entry, first(label ORDER BY line_no) AS entry_type, first(speaker ORDER BY line_no) AS speaker, string_agg(x, ' ' ORDER BY line_no) AS text FROM m10 GROUP BY doc, entry)"""
_HEADED = f"""{_MERGED},
h0 AS (SELECT doc, entry, entry_type, speaker, {_clean('text')} AS c FROM merged),
h1 AS (SELECT *, CASE WHEN entry_type IN ('header', 'subheader') THEN {_rep('lower(c)', '(?is)^prayers?' + chr(92) + 's+(.+)' + chr(92) + 'z', chr(92) + '1')} ELSE c END AS t FROM h0),
h2 AS (SELECT *, sum(CASE WHEN entry_type = 'header' THEN 1 ELSE 0 END) OVER w AS hg, sum(CASE WHEN entry_type IN ('header', 'subheader') THEN 1 ELSE 0 END) OVER w AS sg FROM h1 WINDOW w AS (PARTITION BY doc ORDER BY entry)),
headed AS (SELECT doc, entry, entry_type, speaker, last_value(CASE WHEN entry_type = 'header' THEN t END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY entry) AS header,
  last_value(CASE WHEN entry_type = 'subheader' THEN t END IGNORE NULLS) OVER (PARTITION BY doc, hg ORDER BY entry) AS subheader,
  last_value(CASE WHEN entry_type = 'subsubheader' THEN t END IGNORE NULLS) OVER (PARTITION BY doc, sg ORDER BY entry) AS subsubheader,
  CASE WHEN contains(entry_type, 'header') THEN NULL ELSE t END AS text FROM h2)"""
_FULL = f"WITH {_HEADED}, kept AS (SELECT * FROM headed WHERE entry_type IS NOT NULL AND entry_type <> 'garbage' AND (contains(entry_type, 'header') OR coalesce(length(text), 0) > 0)), {_parse_sql('kept')} SELECT doc, entry, appointment, entry_type, header, NULL::INT AS page_number, speaker, name AS speaker_cleaned, subheader, subsubheader, text, title FROM np"

_TYPED = f"typed AS (SELECT DISTINCT folder, file, line, nullif(lower(trim(label)), '') AS label, notes, coder, _id, text FROM {TYPES})"
_TYPED_RAW = f"typed AS (SELECT folder, file, line, nullif(lower(trim(label)), '') AS label, notes, coder, _id, text FROM (SELECT DISTINCT * FROM {TYPES}))"
_USABLE = f"{_TYPED_RAW}, usable AS (SELECT * FROM typed WHERE label IS NOT NULL AND label <> 'blank' AND notes IS NULL)"
_SPAN = f"""sp0 AS (SELECT DISTINCT rec_id, text, start, "end" FROM {TALK}),
sp1 AS (SELECT rec_id, text, (CASE WHEN start IS NULL AND "end" IS NOT NULL THEN 1 ELSE start END - 1)::INT AS s, (CASE WHEN "end" IS NULL AND start IS NOT NULL THEN length(text) ELSE "end" END)::INT AS e FROM sp0),
sp2 AS (SELECT *, (s >= 0 AND s < e AND e <= length(text)) AS ok FROM sp1),
sp AS (SELECT *, CASE WHEN ok THEN repeat('O', s) || 'B' || repeat('I', e - s - 1) || repeat('O', length(text) - e) ELSE repeat('O', length(text)) END AS bio FROM sp2)"""


def _share_sql(keys: list[str], seed: int = 0) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}, '{seed}')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0)"


def _split_case(keys: list[str]) -> str:
    x = _share_sql(keys)
    return f"CASE WHEN {x} < 0.6 THEN 'train' WHEN {x} < 0.8 THEN 'dev' ELSE 'test' END"


def _context_sql(src: str, part: str, order: str, n: int = 4) -> str:
    return f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY {part} ORDER BY {order}) > {n} THEN coalesce(string_agg(text, chr(10)) OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), '') ELSE '' END AS prev_context,
coalesce(string_agg(text, chr(10)) OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING), '') AS next_context FROM {src}"""


def _augment_sql() -> str:
    keys = ["folder", "file", "line", "label", "text"]
    parts = ["SELECT file, line, label, text FROM base"]
    for i in range(P.SPLIT_PASSES):
        cut = f"(floor({_share_sql([*keys, chr(39) + 'at' + chr(39)], i)} * (length(text) - 1))::INT + 1)"
        arr = f"CASE WHEN length(text) > 1 AND {_share_sql(keys, i)} < 0.5 THEN [left(text, {cut}), substr(text, {cut} + 1)] ELSE [text] END"
        parts.append(f"SELECT file || '_{i}' AS file, row_number() OVER (PARTITION BY file ORDER BY line, folder, label, whole, k)::INT AS line, label, text FROM (SELECT folder, file, line, label, text AS whole, unnest({arr}) AS text, unnest(range(len({arr}))) AS k FROM base)")
    return f"WITH {_USABLE}, base AS (SELECT DISTINCT folder, file, line, label, text FROM usable WHERE text IS NOT NULL) {' UNION ALL '.join(parts)}"


def _ids_sql() -> str:
    return f"ids AS (SELECT m.folder.name AS folder, {_rep('m.name', chr(92) + '.txt' + chr(92) + 'z')} AS file, TRY_CAST(id AS BIGINT) AS _id FROM (SELECT id, arg_max(struct_pack(name := name, folder := folder), CAST(sequence_id AS BIGINT)) AS m FROM hansard_meta WHERE type IS NULL OR type = 'file' GROUP BY id))"


def _sitting_sql() -> str:
    months = "map {" + ", ".join(f"'{k}': {v}" for k, v in sittings._MONTH.items()) + "}"
    win = lambda at_end: f"list_transform(range(100, 1401, 100), lambda n: {_rep(_strip(_rep('right(text, n)' if at_end else 'left(text, n)', P.LINE_BREAKS)), chr(92) + 's+', ' ')})"
    tries = []
    for p, (dd, mm, yy) in P.SITTING_DATES:
        tries.append(f"CASE WHEN {_like('w', p)} THEN {_ext('w', p, yy)} || '-' || lpad(CAST({months}[lower({_ext('w', p, mm)})] AS VARCHAR), 2, '0') || '-' || lpad({_ext('w', p, dd)}, 2, '0') END")
    time = lambda action: (lambda p: f"CASE WHEN {_like('w', p)} THEN (CASE WHEN starts_with({_ext('w', p, 3)}, 'p') AND {_ext('w', p, 1)}::INT <> 12 THEN {_ext('w', p, 1)}::INT + 12 ELSE {_ext('w', p, 1)}::INT END) * 60 + {_ext('w', p, 2)}::INT END")(P.HOUSE_TIME.format(action=action))
    return f"""WITH src AS (SELECT doc_id AS doc, 'OFFICIAL REPORT' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'Tuesday, ' ELSE '' END || (doc_id % 28 + 1) || 'th March, ' || CAST(coalesce(year, 1970) AS INT) || chr(10) || 'The House met at ' || (doc_id % 12 + 1) || CASE WHEN doc_id % 2 = 0 THEN '.' ELSE ':' END || '30 p.m.' || chr(10) || coalesce(text, '') || CASE WHEN doc_id % 5 <> 0 THEN chr(10) || 'The House rose at 6.15 p.m.' ELSE '' END AS text FROM documents),
got AS (SELECT doc, TRY_CAST(list_filter(list_transform({win(False)}, lambda w: coalesce({', '.join(tries)})), lambda x: x IS NOT NULL)[1] AS DATE) AS d, list_filter(list_transform({win(False)}, lambda w: {time('met')}), lambda x: x IS NOT NULL)[1] AS a, list_filter(list_transform({win(True)}, lambda w: {time('rose')}), lambda x: x IS NOT NULL)[1] AS z FROM src)
SELECT doc, strftime(d + to_minutes(coalesce(a, 0)), '%Y-%m-%d %H:%M') AS starts, CASE WHEN z IS NOT NULL THEN strftime(d + to_minutes(z), '%Y-%m-%d %H:%M') END AS ends FROM got"""


def _legacy_sql() -> str:
    # typed from the rules: wrapping signs, the bracket, punctuation, a title from the list, offices
    punct = r"[!-/:-@\[-`{-~]"
    titles = "mr |bw |ms |bi |hon |capt |mrs |dr |prof |gen |maj-gen |maj |major |an hon|a hon|eng |engineer |col |rtd |rev |sen |mheshimiwa"
    rest = _strip(f"regexp_extract(n1, '(?s)^{chr(92)}s*({titles})(.+)', 2)")
    return f"""WITH {_NAMED}, l0 AS (SELECT DISTINCT speaker, regexp_replace(speaker, '\\s+', ' ', 'g') AS even FROM named WHERE speaker IS NOT NULL),
l1 AS (SELECT speaker, lower(CASE WHEN regexp_matches(even, '^{punct}(.*){punct}$') THEN substr(even, 2, length(even) - 2) ELSE even END) AS low FROM l0),
l2 AS (SELECT *, contains(low, '(') AND regexp_matches(low, '(?s)[(].+[)]') AS hit FROM l1),
l3 AS (SELECT *, CASE WHEN hit THEN ltrim(regexp_extract(low, '(?s)^(.*)[(](.+)[)]', 2)) ELSE low END AS n0, CASE WHEN hit THEN trim(regexp_extract(low, '(?s)^(.*)[(](.+)[)]', 1)) WHEN contains(low, '(') THEN low END AS a0 FROM l2),
l4 AS (SELECT *, regexp_replace(n0, '{punct}', '', 'g') AS n1, regexp_replace(a0, '{punct}', '', 'g') AS a1 FROM l3),
l5 AS (SELECT *, CASE WHEN regexp_matches(n1, '(?s)^\\s*({titles}).') THEN regexp_extract(n1, '(?s)^\\s*({titles})(.+)', 1) END AS t1 FROM l4),
l6 AS (SELECT *, CASE WHEN t1 IS NULL THEN n1 ELSE {rest} END AS n2, {_strip('t1')} AS t2 FROM l5),
l7 AS (SELECT *, (contains(n2, 'speaker') OR contains(n2, 'minister') OR contains(n2, 'members')) AS office FROM l6)
SELECT speaker, CASE WHEN NOT office THEN {_clean('n2')} END AS name, {_clean('t2')} AS title, CASE WHEN office THEN {_clean('n2')} ELSE {_clean('a1')} END AS appointment FROM l7"""


def _words_sql(src: str, raw: str) -> str:
    """fixed(raw, fixed): the heading words of ``src`` put right, word by word with a look at the next one."""
    prev, nxt, x, b = "d[len(d)]", "w[i + 1]", "w[i]", chr(92)
    core = f"regexp_replace({x}, '[^A-Za-z0-9_]', '', 'g')"
    single = f"(length({core}) = 1 AND NOT regexp_matches({x}, '.+[!),.:;?{b}]}}]$'))"
    known = "(SELECT list(DISTINCT k) FROM (SELECT unnest(regexp_extract_all(header, '[a-z]{2,}')) AS k FROM headers))"
    quote = _q("'")
    last = f"(len(d) > 0 AND {x} IN ({quote}, '-') OR {single} AND len(d) > 0 AND {core} = 's' AND ends_with({prev}, {quote}))"
    on = f"({single} AND {nxt} IS NOT NULL AND ({core} <> 'a' OR {nxt} IN ('mend', 'id', 'rid', 'ward', 'broad') OR NOT list_contains(known, {nxt})))"
    back = f"({single} AND {core} = 'a' AND len(d) > 0 AND NOT list_contains(known, {prev}))"
    glue = f"list_append(d[1:len(d) - 1], {prev} || {x})"
    start = _rep(_strip("raw"), "(.) ' ([A-z])([A-z]) ([A-z]+)", f"{b}1'{b}2 {b}3{b}4")
    return f"""raws AS (SELECT DISTINCT {raw} AS raw FROM {src} WHERE {raw} IS NOT NULL),
walk AS (SELECT raw, string_split_regex({start}, '{b}s+') AS w, 1 AS i, []::VARCHAR[] AS d, {known} AS known FROM raws
  UNION ALL SELECT raw, w, CASE WHEN {last} THEN i + 1 WHEN {on} THEN i + 2 ELSE i + 1 END AS i, CASE WHEN {last} THEN {glue} WHEN {on} THEN list_append(d, {x} || {nxt}) WHEN {back} THEN {glue} ELSE list_append(d, {x}) END AS d, known FROM walk WHERE i <= len(w)),
joined AS (SELECT raw, replace(replace(array_to_string(d, ' '), ' -', '-'), '- ', '-') AS j FROM walk WHERE i > len(w)),
fixed AS (SELECT raw, regexp_replace(regexp_replace(regexp_replace(j, '([({b}[{{]) ', '{b}1', 'g'), ' ([!),.:;?{b}]}}])', '{b}1', 'g'), '([!),.:;?{b}]}}])([A-Za-z0-9_]+)', '{b}1 {b}2', 'g') AS fixed FROM joined)"""


def _fixed_entries_sql() -> str:
    plain = _rep("lower(c)", r"(?is)^prayers?\s+(.+)\z", r"\1")
    head, rest = _FULL.removeprefix("WITH ").split("h1 AS (SELECT *, ")
    rest = "h1 AS (SELECT h0.*, " + rest.replace(plain, plain.replace("lower(c)", "fixed.fixed"), 1).replace("FROM h0),", "FROM h0 LEFT JOIN fixed ON fixed.raw = lower(h0.c)),", 1)
    heads = "(SELECT lower(c) AS low FROM h0 WHERE entry_type IN ('header', 'subheader'))"
    return f"WITH RECURSIVE {head}{_words_sql(heads, 'low')}, {rest}"


_HYBRID = f"""hyb0 AS (SELECT *, (s IS NULL AND flag = 1 AND length(scan) < 200 AND regexp_matches(scan, '[A-Za-z]')) AS whole FROM flagged),
hyb AS (SELECT doc, line_no, scan, CASE WHEN whole THEN 0 WHEN flag = 1 THEN s END AS s, CASE WHEN whole THEN length(scan) WHEN flag = 1 THEN e END AS e FROM hyb0)"""
_PAREN_A, _PAREN_B = r"(?s)^\s*(\(.+\))\s*:\s*(.*)", r"(?s)^\s*(.*)\s*\((.+)\)"
_LEAD = r"^[\s\x1c-\x1f]+"

SQL: dict[str, str] = {
    "ascii_fold": f"SELECT doc_id, {_fold('text')} AS folded FROM documents",
    "split_lines_renumber": f"WITH {_DOC_LINES} SELECT doc, line_no, text FROM lines",
    "line_range_scan": f"WITH {_DOC_LINES} SELECT doc, line_no, text FROM lines WHERE line_no >= 2 AND line_no < 6",
    "clean_text_functions": f"WITH {_REC} SELECT rec_id, {_clean('text')} AS cleaned, {_rep('text', P.PUNCT)} AS bare, {_rep('text', _UNWRAP, chr(92) + '1')} AS unwrapped, {_pred('punct')} AS only_punct, {_rep(_rep('text', chr(92) + 's+', ' '), _UNWRAP, chr(92) + '1')} AS name_cleaned FROM rec",
    "tag_extract": f"WITH {_REC} SELECT rec_id, {_rep('text', P.TAGS)} AS untagged, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, {_q(P.TAGS)}), lambda x: lower({_rep('x', P.TAG_NOISE)})), lambda x: x <> ''))), ',') AS tag_names, replace(replace(text, '<', ' <'), '>', '> ') AS spaced FROM rec",
    "parenthesised_names": f"WITH {_REC} SELECT rec_id, CASE WHEN {_like('text', _PAREN_A)} THEN {_rep(_ext('text', _PAREN_A, 1), _LEAD)} ELSE text END AS a_in, CASE WHEN {_like('text', _PAREN_A)} THEN {_strip(_ext('text', _PAREN_A, 2))} ELSE text END AS a_out, CASE WHEN {_like('text', _PAREN_B)} THEN {_rep(_ext('text', _PAREN_B, 2), _LEAD)} ELSE text END AS b_in, CASE WHEN {_like('text', _PAREN_B)} THEN {_strip(_ext('text', _PAREN_B, 1))} ELSE text END AS b_out FROM rec",
    "page_predicates": f"WITH {_LINES} SELECT doc, line_no, {', '.join(_pred(k) + ' AS ' + k for k in ('page_number', 'page_heading', 'page_date', 'page_footer', 'transcript_heading', 'garbage'))} FROM lines",
    "header_dictionary_semi": f"WITH {_LINES} SELECT doc, line_no, text FROM lines WHERE lower({_strip('text')}) IN (SELECT header FROM headers)",
    "header_dictionary_anti": f"WITH {_LINES} SELECT doc, count(*) AS n FROM lines WHERE NOT EXISTS (SELECT 1 FROM headers h WHERE h.header = lower({_strip('text')})) GROUP BY doc",
    "label_rule": f"WITH {_LABELLED0} SELECT doc, line_no, label FROM labelled0",
    "label_rule_tags": f"WITH {_LINES}, x AS (SELECT doc, {_label_sql(True)} AS label FROM lines) SELECT doc, label, count(*) AS n FROM x GROUP BY doc, label",
    "label_rule_documents": f"WITH {_DOC_LINES}, x AS (SELECT doc, {_label_sql()} AS label FROM lines) SELECT lang, label, count(*) AS n FROM x JOIN documents ON doc = doc_id GROUP BY lang, label",
    "header_override": f"WITH {_LABELLED} SELECT doc, line_no, label, overridden FROM labelled",
    "label_audit": f"WITH {_LABELLED} SELECT label, count(*) AS lines, sum(overridden::INT)::BIGINT AS overridden FROM labelled GROUP BY label",
    "header_refine": f"WITH {_LABELLED0} SELECT doc, line_no, CASE WHEN {_pred('header')} THEN 'header' WHEN {_pred('subheader')} THEN 'subsubheader' ELSE 'subheader' END AS refined FROM labelled0 WHERE contains(label, 'header')",
    "span_detect": f"WITH {_LINES}, {_spans_sql('lines')} SELECT doc, line_no, scan, rest, s AS start, e AS \"end\", {_BIO.format(s='s', e='e', n='length(scan)')} AS bio FROM spans",
    "speaker_extract": f"WITH {_NAMED} SELECT doc, line_no, speaker, said FROM named",
    "hybrid_span": f"WITH {_LINES}, {_spans_sql('lines')}, flagged AS (SELECT *, (line_no % 3 = 0)::INT AS flag FROM spans), {_HYBRID} SELECT doc, line_no, s AS start, e AS \"end\" FROM hyb",
    "continued_name": f"""WITH {_LINES}, {_spans_sql('lines')}, flagged AS (SELECT *, (line_no % 5 < 3)::INT AS flag FROM spans), {_HYBRID},
c0 AS (SELECT doc, line_no, {_BIO.format(s='s', e='e', n='length(scan)')} AS bio, CASE WHEN s IS NOT NULL THEN substr(scan, s + 1, e - s) END AS speaker FROM hyb),
c1 AS (SELECT *, coalesce(ends_with(bio, 'I') AND regexp_matches(lead(bio) OVER (PARTITION BY doc ORDER BY line_no), '^[BI]'), false) AS runs FROM c0),
c2 AS (SELECT *, CASE WHEN coalesce(lag(runs) OVER (PARTITION BY doc ORDER BY line_no), false) THEN 0 ELSE 1 END AS fresh FROM c1),
c3 AS (SELECT *, sum(fresh) OVER (PARTITION BY doc ORDER BY line_no) AS chain FROM c2)
SELECT doc, line_no, CASE WHEN speaker IS NOT NULL THEN string_agg(speaker, ' ') OVER (PARTITION BY doc, chain ORDER BY line_no ROWS UNBOUNDED PRECEDING) END AS speaker FROM c3""",
    "parse_speaker_name": f"WITH {_NAMED}, sps AS (SELECT DISTINCT speaker FROM named WHERE speaker IS NOT NULL), {_parse_sql('sps')} SELECT speaker, title, name, appointment FROM np",
    "legacy_parse_name": _legacy_sql(),
    "merge_entries": f"WITH {_MERGED} SELECT doc, entry, entry_type, speaker, text FROM merged",
    "distribute_headers": f"WITH {_HEADED} SELECT doc, entry, entry_type, header, subheader, subsubheader, text FROM headed",
    "entries_full": _FULL,
    "label_conflicts": f"WITH {_LABELLED0}, x AS (SELECT label, CASE WHEN {_pred('garbage')} OR {_pred('punct')} THEN 0 ELSE {' + '.join(f'coalesce({_pred(k)}, false)::INT' for k in ('header', 'subheader', 'subsubheader', 'scene', 'speech'))} END AS hits FROM labelled0) SELECT label, hits, count(*) AS n FROM x GROUP BY label, hits",
    "share_weights": f"WITH {_USABLE} SELECT label, count(*) AS n, round((SELECT count(*) FROM usable) / count(*), 9) AS weight FROM usable GROUP BY label",
    "total_sort": f"SELECT rec_id, year, file, line FROM {TALK} ORDER BY year NULLS FIRST, file NULLS FIRST, line NULLS FIRST, rec_id",
    "vocabulary_texts": f"SELECT text, count(*) AS n FROM (SELECT text FROM {TALK} UNION ALL SELECT text FROM {TYPES} UNION ALL SELECT header FROM headers) WHERE text IS NOT NULL GROUP BY text",
    "bio_decoded": f"WITH {_SPAN} SELECT rec_id, s AS start, e AS \"end\", bio FROM sp",
    "merge_turns": f"WITH {_MERGED.replace(_LINES, _DOC_LINES)} SELECT doc, entry, entry_type, speaker, text FROM merged",
    "appointment_glue": f"WITH {_NAMED} SELECT doc, line_no, speaker, said FROM named WHERE regexp_matches(speaker, '[()]')",
    "entries_fixed": _fixed_entries_sql(),
    "fix_header_words": f"WITH RECURSIVE {_LABELLED0}, heads AS (SELECT doc, line_no, lower(text) AS low FROM labelled0 WHERE label IN ('header', 'subheader')), {_words_sql('heads', 'low')} SELECT doc, line_no, fixed FROM heads JOIN fixed ON raw = low",
    "speech_only_predict": f"WITH {_LABELLED} SELECT doc, line_no, CASE WHEN label = 'speech' AND length(text) < 60 THEN 1 ELSE 0 END AS has_speaker FROM labelled",
    "parse_diagnostics": f"WITH {_NAMED} SELECT doc, count(*) AS lines, count(CASE WHEN label IS NULL THEN 1 END) AS unlabeled, count(DISTINCT label) AS labels FROM named GROUP BY doc",
    "sitting_metadata": _sitting_sql(),
    "line_context_4": f"WITH {_LINES}, c AS ({_context_sql('lines', 'doc', 'line_no')}) SELECT doc, line_no, prev_context, next_context FROM c",
    "truncate_2048": f"WITH {_DOC_LINES}, c AS ({_context_sql('lines', 'doc', 'line_no')}), x AS (SELECT doc, line_no, text, prev_context || chr(10) || next_context AS context FROM c) SELECT doc, line_no, least(length(text), 2048) AS text_chars, md5(left(text, 2048) || '|' || CASE WHEN length(text) > 2048 THEN '' ELSE left(context, 2048 - length(text)) END) AS cut FROM x",
    "span2bio_bio2span": f"WITH {_SPAN} SELECT rec_id, s AS start, e AS \"end\", bio, CASE WHEN regexp_matches(bio, '[BI]') THEN length(regexp_extract(bio, '^([^BI]*)[BI]', 1)) END AS back_start, CASE WHEN regexp_matches(bio, '[BI]') THEN length(regexp_extract(bio, '^([^BI]*)[BI]', 1)) + length(regexp_extract(bio, '([BI]+)', 1)) END AS back_end, regexp_matches(bio, '[BI]')::INT AS has_speaker FROM sp",
    "span_quality": f"""WITH a AS (SELECT text, (CASE WHEN start IS NULL AND "end" IS NOT NULL THEN 1 ELSE start END - 1)::INT AS s, (CASE WHEN "end" IS NULL AND start IS NOT NULL THEN length(text) ELSE "end" END)::INT AS e FROM {TALK}) SELECT count(*) AS rows, count(CASE WHEN s > e THEN 1 END) AS reversed, count(CASE WHEN e > length(text) THEN 1 END) AS past_text, min(s) AS least_start, coalesce(bool_and(NOT (s > e OR e > length(text))), true) AS all_right FROM a""",
    "bio_tokens": f"WITH {_SPAN} SELECT rec_id, array_to_string(string_split(bio, ''), ' ') AS spaced, md5(CASE WHEN bio = '' THEN '1' ELSE array_to_string(list_transform(string_split(bio, ''), lambda x: CASE x WHEN 'B' THEN '2' WHEN 'I' THEN '3' ELSE '4' END), ' ') || ' 1' END) AS codes FROM sp",
    "encode_chars": f"WITH {_LINES}, c AS ({_context_sql('lines', 'doc', 'line_no')}), x AS (SELECT doc, line_no, array_to_string(list_transform(string_split(text, ''), lambda q: CAST(ascii(q) + 3 AS VARCHAR)), ' ') AS a, array_to_string(list_transform(string_split(prev_context || chr(10) || next_context, ''), lambda q: CAST(ascii(q) + 3 AS VARCHAR)), ' ') AS b FROM c) SELECT doc, line_no, md5(a || ' 1') AS ids, md5(a || ' 2 ' || b || ' 1') AS with_context FROM x",
    "class_weights": f"WITH {_USABLE}, g AS (SELECT label, count(*) AS n FROM usable GROUP BY label) SELECT label, n, round(n / (SELECT sum(n) FROM g), 9) AS share, round(1.0 / (SELECT count(*) FROM g), 9) AS class_mass FROM g",
    "label_quality": f"WITH {_TYPED_RAW} SELECT count(*) AS rows, count(CASE WHEN text IS NULL THEN 1 END) AS null_text, count(CASE WHEN length(text) = 0 THEN 1 END) AS empty_text, count(CASE WHEN label IS NULL THEN 1 END) AS null_label, count(CASE WHEN label NOT IN ('header', 'speech', 'scene', 'garbage') THEN 1 END) AS unknown_label, count(DISTINCT label) AS labels FROM typed",
    "label_codes": f"WITH {_TYPED_RAW} SELECT label, CASE label WHEN 'header' THEN 0 WHEN 'speech' THEN 1 WHEN 'scene' THEN 2 WHEN 'garbage' THEN 3 END AS code, CASE WHEN label IN ('header', 'speech', 'scene', 'garbage') THEN label END AS back, count(*) AS n FROM typed GROUP BY label",
    "label_set_difference": f"WITH {_TYPED_RAW}, known(label) AS (VALUES ('header'), ('speech'), ('scene'), ('garbage')), got AS (SELECT DISTINCT label FROM typed WHERE label IS NOT NULL) SELECT label, 'unknown' AS side FROM (SELECT label FROM got EXCEPT SELECT label FROM known) UNION ALL SELECT label, 'missing' FROM (SELECT label FROM known EXCEPT SELECT label FROM got)",
    "split_by_sitting": f"WITH {_TYPED_RAW} SELECT file, {_split_case(['file'])} AS split, count(*) AS n FROM typed GROUP BY ALL",
    "split_by_line": f"WITH {_REC} SELECT rec_id, {_split_case(['file', 'line'])} AS split FROM rec",
    "split_lines_semi": f"WITH {_REC}, {_TYPED_RAW} SELECT rec_id FROM rec WHERE file IN (SELECT file FROM typed WHERE {_split_case(['file'])} = 'train')",
    "augment_split_md5": _augment_sql(),
    "duplicate_without_garbage": f"WITH {_USABLE}, u AS (SELECT file, label FROM usable UNION ALL SELECT file || '_wo_garbage', label FROM usable WHERE label <> 'garbage') SELECT file, label, count(*) AS n FROM u GROUP BY file, label",
    "prep_training_lines": f"WITH {_USABLE}, base AS (SELECT DISTINCT folder, file, line, label, text FROM usable WHERE text IS NOT NULL), c AS ({_context_sql('base', 'folder, file', 'line, label, text')}) SELECT folder, file, line, label, prev_context, next_context FROM c WHERE NOT (prev_context = '' AND line > 4) AND NOT (next_context = '' AND NOT ends_with(text, '<EOD>'))",
    "context_join": f"WITH {_USABLE}, base AS (SELECT folder, file, line, min(text) AS text, min(label) AS label FROM usable WHERE text IS NOT NULL GROUP BY folder, file, line), c AS ({_context_sql('base', 'folder, file', 'line')}) SELECT b.folder, b.file, b.line, b.label, c.next_context FROM base b LEFT JOIN c ON b.folder = c.folder AND b.file = c.file AND b.line = c.line",
    "meta_files": f"WITH {_ids_sql()} SELECT folder, file, _id FROM ids",
    "label_ids_left_join": f"WITH {_TYPED_RAW}, {_ids_sql()}, one AS (SELECT folder, file, max(_id) AS _id FROM ids GROUP BY folder, file) SELECT t.file, count(*) AS n, count(one._id) AS with_id FROM typed t LEFT JOIN one ON one.folder = CAST(t.folder AS VARCHAR) AND one.file = t.file GROUP BY t.file",
    "missing_ids_anti": f"WITH {_TYPED_RAW}, {_ids_sql()} SELECT DISTINCT CAST(t.folder AS VARCHAR) AS folder, t.file FROM typed t WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.folder = CAST(t.folder AS VARCHAR) AND ids.file = t.file)",
    "label_text_left_join": f"WITH {_REC}, {_TYPED_RAW}, i AS (SELECT file, max(_id) AS _id FROM typed GROUP BY file), l AS (SELECT _id, line, min(text) AS spoken FROM rec JOIN i USING (file) GROUP BY _id, line), t AS (SELECT DISTINCT _id, line, label FROM typed) SELECT t._id, t.line, t.label, l.spoken FROM t LEFT JOIN l ON t._id = l._id AND t.line = l.line",
    "batch_ids": f"WITH {_REC} SELECT rec_id, ((row_number() OVER (PARTITION BY file ORDER BY line, rec_id) - 1) // 50)::BIGINT AS batch FROM rec",
    "raw_line_lookup": f"WITH a AS (SELECT doc_id AS doc, (doc_id % 4 + 1)::INT AS line, string_split_regex(text, {_q(P.RAW_BREAKS)}) AS ls FROM documents) SELECT doc, line, ls[line] AS text FROM a",
    "escapes": f"WITH {_REC} SELECT rec_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;') AS html, to_base64(encode(text)) AS b64, CASE WHEN lower(string_split(file, '.')[-1]) IN ('txt', 'pdf') THEN lower(string_split(file, '.')[-1]) END AS filetype, nullif(regexp_extract('attachment; filename=\"' || file || '\"', '(?i)filename\\s*=\\s*\"?([^\";]+)\"?', 1), '') AS filename FROM rec",
    "files_not_labelled": f"SELECT DISTINCT file FROM {TALK} t WHERE NOT EXISTS (SELECT 1 FROM {TYPES} h WHERE h.file = t.file)",
    "debug_head": "SELECT doc_id, left(text, 1500) AS head FROM documents",
}

QUERIES = {
    f.__name__: f
    for f in (
        entries_full, ascii_fold, split_lines_renumber, line_range_scan, clean_text_functions, tag_extract, parenthesised_names, page_predicates, header_dictionary_semi,
        header_dictionary_anti, label_rule, label_rule_tags, label_rule_documents, header_override, label_audit, header_refine, span_detect, speaker_extract, hybrid_span,
        label_conflicts, share_weights, total_sort, vocabulary_texts, bio_decoded, merge_turns, appointment_glue, supervised_line_types, continued_name, parse_speaker_name, legacy_parse_name, merge_entries, distribute_headers, entries_fixed, fix_header_words, parse_diagnostics, sitting_metadata, result_json,
        line_context_4, truncate_2048, speech_only_predict, span2bio_bio2span, span_quality, bio_tokens, encode_chars, class_weights, label_quality, label_codes,
        label_set_difference, split_by_sitting, split_by_line, split_lines_semi, augment_split_md5, duplicate_without_garbage, upsample_weighted, prep_training_lines, context_join,
        meta_files, label_ids_left_join, missing_ids_anti, label_text_left_join, batch_ids, raw_line_lookup, escapes, files_not_labelled, debug_head,
    )
}
