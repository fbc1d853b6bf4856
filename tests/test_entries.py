"""Merging and headings against an independent sequential fold over random documents; plans; whole parses."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import entries, labels, lines, models, spans

TYPES = ["speech", "speech", "speech", "scene", "header", "subheader", "subsubheader", "punct", "garbage", None]


def fold(doc):
    """Entry by entry: what each line joins, by looking at what has been built so far."""
    out, last = [], None
    for kind, who, said in doc:
        if kind == "garbage":
            continue

        def joins(e):
            if kind == "punct":
                return True
            if e["kind"] != kind:
                return False
            if kind == "speech":
                return who is None or e["who"] == who
            if kind == "scene":
                return not e["said"].endswith(")")
            if kind == "subheader":
                tail = e["said"].rstrip().lower()
                return not ((tail.endswith("bill") or tail.endswith("b ill")) and said.lower().startswith("t"))
            return True

        if last is not None and joins(last):
            last["said"] += " " + said
            continue
        if len(out) > 1 and kind == "speech" and last["kind"] == "scene":
            back = next((e for e in reversed(out) if e["kind"] != "scene"), out[-1])
            if joins(back):
                back["said"] += " " + said
                continue
        last = {"kind": kind, "who": who, "said": said}
        out.append(last)
    return [(e["kind"], e["who"], e["said"]) for e in out]


def test_merge_is_the_fold(spark):
    rng = random.Random(3)
    docs = []
    for _ in range(400):
        doc = []
        for _ in range(rng.randint(1, 14)):
            k = rng.choice(TYPES)
            doc.append((k, rng.choice([None, None, "a", "b"]) if k == "speech" else None, rng.choice(["x", "y)", "the bill", "t", "u"])))
        docs.append(doc)
    rows = [(d, i, k, w, s) for d, doc in enumerate(docs) for i, (k, w, s) in enumerate(doc)]
    df = spark.createDataFrame(rows, "doc int, line_no int, label string, speaker string, said string")
    got = {}
    for r in entries.merge_entries(df).orderBy("doc", "entry").collect():
        got.setdefault(r.doc, []).append((r.entry_type, r.speaker, r.text))
    bad = [d for d, doc in enumerate(docs) if got.get(d, []) != fold(doc)]
    assert not bad, (docs[bad[0]], got.get(bad[0]), fold(docs[bad[0]]))


def test_merge_needs_one_exchange(spark):
    df = spark.createDataFrame([(1, 0, "speech", None, "x")], "doc int, line_no int, label string, speaker string, said string").repartition(3)
    plan = entries.merge_entries(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(doc") == 1 and "Python" not in plan and "Arrow" not in plan


def test_whole_parse_needs_one_exchange(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string").repartition(3)
    plan = models.parse(lines.split_lines(docs), ["papers laid"], fix_words=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 1 and "Python" not in plan and "Arrow" not in plan


def test_headings(spark):
    e = [(1, 1, "header", "BILLS"), (1, 2, "speech", "a"), (1, 3, "subheader", "THE X"), (1, 4, "subsubheader", "Clause 1"), (1, 5, "speech", "b"), (1, 6, "subheader", "PRAYERS THE Y"), (1, 7, "speech", " "), (1, 8, "header", "PAPERS"), (1, 9, "scene", "(c)"), (2, 1, "speech", "d"), (2, 2, None, "E.")]
    df = spark.createDataFrame(e, "doc int, entry int, entry_type string, text string").withColumn("speaker", F.lit(None).cast("string"))
    got = {(r.doc, r.entry): r for r in entries.prune(entries.distribute_headers(df)).collect()}
    assert got[1, 5].header == "bills" and got[1, 5].subheader == "the x" and got[1, 5].subsubheader == "Clause 1"
    assert got[1, 6].subheader == "the y" and got[1, 6].subsubheader is None and got[1, 6].text is None
    assert (1, 7) not in got and (2, 2) not in got
    assert got[1, 9].header == "papers" and got[1, 9].subheader is None and got[2, 1].header is None


DOC = """<header>PAPERS LAID</header>
The Minister for Roads
(Mr. Odupoy): I lay the
: paper.
(Applause)
on the Table.
Mr. Bett
: said yes.
Tuesday, 12
Hon. A. B. Duale: No.
-
"""


def test_whole_parse(spark):
    docs = spark.createDataFrame([(1, DOC), (2, ""), (3, None), (4, "\n \n")], "doc_id long, text string")
    l = lines.split_lines(docs)
    assert [r.line_no for r in l.filter("doc = 1").orderBy("line_no").collect()] == list(range(11))
    assert l.filter("doc > 1").count() == 0
    got = models.parse(l, ["papers laid"]).orderBy("entry").collect()
    assert got[0].entry_type == "header" and got[0].header == "papers laid" and got[0].text is None
    talk = [r for r in got if r.entry_type == "speech"]
    assert talk[0].appointment == "The Minister for Roads" and talk[0].speaker_cleaned == "Odupoy"
    assert "on the Table." in talk[0].text
    assert any(r.speaker_cleaned == "A. B. Duale" for r in talk)
    assert all(r.entry_type for r in got) and all(r.text for r in got if "header" not in r.entry_type)
    assert got[0].page_number is None


def test_unknown_labeler(spark):
    import pytest

    with pytest.raises(ValueError):
        models.parse(lines.split_lines(spark.createDataFrame([(1, "x")], "doc_id long, text string")), [], line_labeler="other")


def test_predictors(spark):
    l = lines.split_lines(spark.createDataFrame([(1, "Mr. X: yes\nNO NO\n" + "z" * 3000)], "doc_id long, text string"))
    seen = models.predict(labels.label_lines(l, []), lambda t, c: [max(map(len, t))] * len(t), "n", "int", 10, "speech", -1)
    got = {r.line_no: r.n for r in seen.collect()}
    assert got[1] == -1 and got[2] == 2048
    failing = models.predict(labels.label_lines(l, []), lambda t, c: [1 / ("NO" not in t[0])], "n", "int", 1)
    assert {r.text[:5]: r.n for r in failing.collect()}["NO NO"] is None
    with pytest.raises(Exception, match="calls of the model failed"):
        models.predict(labels.label_lines(l, []), lambda t, c: 1 / 0, "n", "int", 10).collect()
    sup = models.LINE_LABELERS["supervised"](l, ["no no"], predictor=lambda t, c: [0] * len(t)).collect()
    assert {r.text[:5]: r.label for r in sup}["NO NO"] == "header"


def test_hybrid_and_continued(spark):
    rows = [(1, 0, "The Minister"), (1, 1, "for Roads:"), (1, 2, "and so on")]
    df = spark.createDataFrame(rows, "doc int, line_no int, text string")
    h = spans.hybrid_spans(spans.label_spans(df).withColumn("has_speaker", (F.col("line_no") < 2).cast("int")))
    h = h.withColumn("speaker", F.when(F.col("start").isNotNull(), F.substring(F.col("scan"), F.col("start") + 1, F.col("end") - F.col("start"))))
    got = {r.line_no: r.speaker for r in spans.continued_names(h).collect()}
    assert got == {0: "The Minister", 1: "The Minister for Roads", 2: None}


def test_override_of_lone_headings(spark):
    rows = [(1, 0, "header", "BILLS"), (1, 1, "speech", "x"), (1, 2, "subheader", "AB"), (1, 3, "speech", "y"), (1, 4, "subheader", "12"), (1, 5, "subheader", "CD"), (1, 6, None, "Z."), (1, 7, "subheader", "TUESDAY, 3"), (1, 8, "speech", "q"), (1, 9, "subheader", "EF")]
    df = spark.createDataFrame(rows, "doc int, line_no int, label string, text string")
    got = {r.line_no: (r.label, r.overridden) for r in labels.override_headers(df).collect()}
    assert got[2] == ("speech", True) and got[4] == ("subheader", False) and got[7] == (None, True) and got[9] == ("subheader", False) and got[0] == ("header", False)
