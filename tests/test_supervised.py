"""Fitted labelers, their pipeline from files, and the small additions to sources, training and entries."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lectern import cli
from lectern.functions import predicates, text
from lectern.operators import entries, labels, lines, models, supervised, training
from lectern.sources import files

WORDS = "the council has heard that water meters and harbour lamps are at our office since then".split()
NAMES = ["Mr. Zelfanten", "Dr. Ada Quillim", "The Speaker", "Prof. Orrim", "Ms. Vuntamor"]


def _lines(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["speech"] * 6 + ["header", "scene", "garbage"])
        said = " ".join(rng.choices(WORDS, k=rng.randint(4, 12)))
        body = {"speech": said.capitalize() + ".", "header": said.upper(), "scene": f"({said.capitalize()})", "garbage": str(rng.randint(1, 900))}[kind]
        name = rng.choice(NAMES) if kind == "speech" and rng.random() < 0.5 else None
        out.append((i, kind, f"{name}: {body}" if name else body, len(name) if name else None))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    rows = spark.createDataFrame(_lines(500, 1), "line int, label string, text string, end int")
    spans = training.with_bio(rows.filter("label = 'speech'").withColumn("start", F.when(F.col("end").isNotNull(), 0)))
    return supervised.fit_line_types(rows), supervised.fit_spans(spans.select("text", "start", "end")), supervised.fit_has_speaker(spans.select("text", "has_speaker"))


def test_line_types_and_spans_on_held_out_lines(spark, fitted):
    df = spark.createDataFrame([*_lines(300, 2), (900, None, None, None), (901, None, "", None)], "line int, label string, text string, end int").withColumn("context", F.lit(None).cast("string"))
    got = supervised.predict_line_types(fitted[0], df, "predicted").filter("label is not null").collect()
    assert len(got) == 300 and sum(r.label == r.predicted for r in got) >= 285
    got = supervised.predict_spans(fitted[1], df.filter("label = 'speech'").select("line", "text", F.col("end").alias("want")), ["line"]).collect()
    right = sum(r.end == r.want for r in got)
    assert right >= 0.95 * len(got) > 100 and all(len(r.bio) == len(r.text) for r in got)
    got = supervised.predict_has_speaker(fitted[2], df.filter("label = 'speech'")).collect()
    assert sum(r.has_speaker == (r.end is not None) for r in got) >= 0.95 * len(got)
    assert supervised.predict_line_types(fitted[0], df.limit(0)).count() == 0


@pytest.mark.parametrize("how", ["supervised", "hybrid"])
def test_parse_with_models(spark, fitted, how):
    df = spark.createDataFrame([(1, "PAPERS AND LAMPS\nDr. Ada Quillim: The council has heard.\n(The water is at our office)\nMore lamps are at the harbour.")], "doc_id long, text string")
    got = models.parse(lines.split_lines(df), [], "supervised", how, fitted[0], fitted[1] if how == "supervised" else fitted[2], fix_words=False).orderBy("entry").collect()
    assert any(r.speaker == "Dr. Ada Quillim" for r in got) and any(r.entry_type == "scene" for r in got) and "header" in got[0].entry_type
    with pytest.raises(ValueError):
        models.parse(lines.split_lines(df), [], "supervised")


def test_models_that_fail(spark):
    df = spark.createDataFrame([("d", i, f"t{i}") for i in range(100)], "doc string, line_no int, text string")

    def every_third(texts, contexts):
        if int(texts[0][1:]) % 3 == 0:
            raise ValueError("no")
        return [1] * len(texts)

    got = models.predict(df.coalesce(1), every_third, "y", "int", 1, context=False)
    assert got.filter("y is null").count() == 34

    def broken(texts, contexts):
        raise ValueError("no")

    with pytest.raises(Exception, match="calls of the model failed"):
        models.predict(df, broken, "y", "int", 10, context=False).collect()


def test_command_lines(spark, tmp_path):
    d = str(tmp_path)
    rows = [(1978, "f", i, k, None, None, 1, t) for i, k, t, _ in _lines(200, 5)]
    schema = "folder int, file string, line int, label string, notes string, coder string, _id long, text string"
    spark.createDataFrame(rows, schema).write.option("header", True).csv(f"{d}/labels")
    cli.main(["train", "--kind", "line_type", "--filepath", f"{d}/labels", "--model", f"{d}/model"])
    os.makedirs(f"{d}/in")
    with open(f"{d}/in/x.jsonl", "w") as f:
        f.write('"The council has heard."\n{"inputs": "PAPERS LAID TODAY", "context": "x"}\n{"inputs": "(The water is here)"}\n7\n')
    cli.main(["predict", "--input", f"{d}/in", "--model", f"{d}/model", "--output", f"{d}/out"])
    got = {r.line: r.label for r in spark.read.json(f"{d}/out").collect()}
    assert got["The council has heard."] == "speech" and got["(The water is here)"] == "scene"
    cli.main(["split_lines", "--filepath", f"{d}/labels", "--outpath", f"{d}/cut"])
    assert spark.read.option("header", True).csv(f"{d}/cut").select("file").distinct().count() == 3
    cli.main(["split", "--filepath", f"{d}/labels", "--outpath", f"{d}/splits"])
    with open(f"{d}/h.txt", "w") as f:
        f.write("papers laid\n")
    os.makedirs(f"{d}/txt")
    with open(f"{d}/txt/a.txt", "w") as f:
        f.write("PAPERS LAID\nMr. Orrim: We heard that.\n")
    cli.main(["parse", "--input", f"{d}/txt", "--output", f"{d}/json", "--headers", f"{d}/h.txt", "--line-labeler", "supervised", "--line-model", f"{d}/model", "--unmerged", f"{d}/lines"])
    assert {"label", "bio"} <= set(spark.read.json(f"{d}/lines").columns)
    assert "Orrim" in json.dumps([r.value for r in spark.read.text(f"{d}/json").collect()])


def test_small_additions(spark, tmp_path):
    df = spark.range(2000).selectExpr("id", "cast(id % 7 as string) as label")
    files.write_training_shards(df, str(tmp_path / "sh"))
    train, held = (spark.read.parquet(str(tmp_path / "sh" / x)) for x in ("train", "eval"))
    assert train.count() + held.count() == 2000 and 100 < held.count() < 300
    assert sum(x.endswith(".parquet") for x in os.listdir(tmp_path / "sh" / "train")) == 9
    assert files.vocabulary_texts([(df, "label"), (df, "id")]).count() == 4000 and files.vocabulary_texts([(df, "label")], 5).count() == 5
    w = {r.label: r for r in training.share_weights(df, "label").collect()}
    assert abs(w["0"].weight * w["0"].n - 2000) < 1e-6
    codes = df.limit(1).select(text.bio_decode(text.bio_codes(F.lit("OOBIIO"))).alias("x"), text.bio_decode(F.array(F.lit(2), F.lit(9), F.lit(3))).alias("y")).first()
    assert codes == ("OOBIIO", "BI")
    hits = spark.createDataFrame([("Question No. 3",), ("PAPERS",), ("(Applause)",), ("12",), (None,), ("Clause 3",)], "t string").select(predicates.label_hits(F.col("t"), ["papers"]).alias("n")).collect()
    assert [r.n for r in hits] == [2, 1, 2, 0, 0, 2]
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "entry int, text string")
    assert entries.differences(a, a.select("text", "entry")).count() == 0
    assert sorted(entries.differences(a, a.limit(1).union(a.filter("entry = 2"))).collect()) == [(1, None, "a")] or entries.differences(a, a.filter("entry = 2")).count() == 2
    s = training.total_sort(spark.createDataFrame([(2, "b", 1), (None, "a", 1), (1, "z", 3), (1, "z", 2)], "year int, file string, line int")).collect()
    assert [tuple(r) for r in s] == [(None, "a", 1), (1, "z", 2), (1, "z", 3), (2, "b", 1)]
    assert labels.label_lines(a.withColumn("doc", F.lit(1)), []).count() == 3
