"""Large documents over many tasks: the same lines, labels, names and contexts as in one."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import labels, lines, spans

PIECES = ["Mr. Zelfanten: yes", "said the lamps are lit", ": and more", "PAPERS", "Tuesday", "12", "(Applause)", "The Minister for Lakes", "(Dr. Quillim): so", "- then", "Dr. Quillim:", "plain words here", "THE LAMPS BILL", "asked why", "-"]


def _named(df):
    return spans.speeches_only(spans.extract_names(spans.label_spans(labels.override_headers(df))))


@pytest.mark.parametrize("size", [16, 40])
def test_blocks_change_nothing(spark, size):
    rng = random.Random(size)
    rows = [(d, i, rng.choice(PIECES)) for d in ("a", "b", "c") for i in range(rng.choice([1, 35, 130]))]
    df = labels.label_lines(spark.createDataFrame(rows, "doc string, line_no int, text string").withColumn("tags", F.array().cast("array<string>")), ["papers"])
    for run in (labels.override_headers, _named, lines.line_context):
        want, got = run(df), lines.in_blocks(df, run, 16, size)
        assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count() == len(rows)
    assert lines.in_blocks(df.limit(0), _named).count() == 0


def test_numbers_by_blocks(spark):
    rng = random.Random(4)
    rows = [(f, n, rng.choice(["a\nb", "", "x", " \n ", None, "p\n\nq"])) for f in ("f", "g", None) for n in rng.sample(range(400), 120)]
    df = spark.createDataFrame(rows, "file string, line int, text string").withColumn("b", F.floor(F.col("line") / 13))
    want = lines.split_lines(df, "file", "text", "line")
    got = lines.split_lines(df, "file", "text", "line", "b")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_task_holds_a_document(spark):
    """Up to the names nothing is partitioned by the document alone."""
    df = spark.createDataFrame([("a", 0, "x", [])], "doc string, line_no int, text string, tags array<string>")
    plan = lines.in_blocks(labels.label_lines(df, []), _named)._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.split("\n") if "hashpartitioning" in x]
    assert len(exchanges) == 1 and "Python" not in plan
