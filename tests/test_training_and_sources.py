"""Training sets, sources and sinks, streaming."""

import os

import pytest
from pyspark.sql import functions as F

from lectern.operators import entries, lines, models, sittings, training
from lectern.sources import files
from lectern.streaming.files import parse_stream


def test_context(spark):
    df = spark.createDataFrame([("d", i, f"l{i}") for i in range(1, 8)], "doc string, line_no int, text string")
    got = {r.line_no: r for r in lines.line_context(df, 2).collect()}
    assert got[1].prev_context == "" and got[2].prev_context == "" and got[3].prev_context == "l1\nl2" and got[7].next_context == "" and got[5].next_context == "l6\nl7"
    assert lines.batch_ids(df, 3, ["line_no"], ["doc"]).agg(F.max("batch")).first()[0] == 2
    with pytest.raises(ValueError):
        lines.batch_ids(df, 0, ["line_no"], ["doc"])
    assert lines.line_range(df, 2, 4).count() == 2 and lines.line_range(df, 5).count() == 3


def test_splits_keep_keys_together(spark):
    df = spark.createDataFrame([(f"f{i % 50}", i) for i in range(1000)], "file string, line int")
    s = training.split(df, ["file"])
    assert s.groupBy("file").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert {r.split for r in s.select("split").distinct().collect()} == {"train", "dev", "test"}
    assert {r.split for r in training.split(df, ["file"], 0.8, None, 0.2).select("split").distinct().collect()} == {"train", "test"}
    with pytest.raises(ValueError):
        training.split(df, ["file"], 0.5, 0.2, 0.2)


def test_augmentation_keeps_texts(spark):
    df = spark.createDataFrame([("f", i, "abcdefgh"[: i % 8 + 1]) for i in range(60)], "file string, line int, text string")
    got = training.split_lines_randomly(df, ["file", "line", "text"], passes=1).filter("file = 'f_0'").orderBy("line").collect()
    assert "".join(r.text for r in got) == "".join("abcdefgh"[: i % 8 + 1] for i in range(60)) and len(got) > 60
    assert [r.line for r in got] == list(range(1, len(got) + 1))


def test_upsampling_balances(spark):
    df = spark.createDataFrame([("a" if i % 10 else "b",) for i in range(2000)], "label string")
    n = {r.label: r["count"] for r in training.upsample(df, factor=10).groupBy("label").count().collect()}
    assert abs(n["a"] - 10000) < 500 and abs(n["b"] - 10000) < 500
    assert training.upsample(df.limit(0)).count() == 0


def test_spans_and_quality(spark):
    df = spark.createDataFrame([("abcdef", None, 3), ("abcdef", 2, None), ("abc", None, None), ("abc", 3, 1), ("abc", 1, 9)], "text string, start int, end int")
    s = training.with_bio(training.default_spans(df)).collect()
    assert [r.bio for r in s] == ["BIIOOO", "OBIIII", "OOO", "OOO", "OOO"] and [r.has_speaker for r in s] == [1, 1, 0, 0, 0]
    q = training.span_quality(training.default_spans(df)).first()
    assert (q.reversed, q.past_text, q.all_right) == (1, 1, False)
    e = training.span_quality(training.default_spans(df.limit(0))).first()
    assert e.rows == 0 and e.all_right


def test_joins(spark):
    a = spark.createDataFrame([("f", 1, "x"), ("f", 2, "y")], "file string, line int, label string")
    c = spark.createDataFrame([("f", 1, "p"), ("f", 1, "q")], "file string, line int, ctx string")
    joined, twice = training.join_context(a, c, ["file", "line"])
    assert joined.count() == 3 and twice.count() == 1
    w = {r.label: r for r in training.class_weights(a.unionByName(a.filter("label = 'x'"))).collect()}
    assert w["x"].n == 2 and abs(w["x"].weight * 2 - w["y"].weight) < 1e-12
    g = training.without_garbage(a.withColumn("label", F.lit("garbage")))
    assert g.count() == 2


def test_files(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.txt").write_bytes("Mürenbe\nx".encode())
    (d / "b.TXT").write_bytes("caf\xe9".encode("latin-1"))
    (d / "c.doc").write_bytes(b"no")
    got = {os.path.basename(r.path): r.text for r in files.read_transcripts(spark, str(d)).collect()}
    assert got == {"a.txt": "Mürenbe\nx", "b.TXT": "café"}
    (tmp_path / "l.csv").write_text('year,file,line,start,end,notes,text\n1978,f,1,NA,3,NA,"a\nb"\n', encoding="latin-1")
    r = files.read_labels(spark, str(tmp_path / "l.csv"), spans=True).first()
    assert r.start is None and r.end == 3 and r.text == "a\nb"
    (tmp_path / "m.json").write_text('{"type":"file","id":"7","sequence_id":"2","name":"x.txt","folder":{"name":"1978"}}')
    assert files.file_list(files.read_meta(spark, str(tmp_path / "m.json"))).first()[:] == ("1978", "x", 7)
    (tmp_path / "p.json").write_text('{"batch":0,"outputs":[[["a"]]]}\n{"batch":0,"error":"x"}\n{"batch":1,"outputs":[[["b"]]]}\n')
    assert sorted(r.prediction for r in files.read_predictions(spark, str(tmp_path / "p.json")).collect()) == ["a", "b"]
    files.write_splits(spark.createDataFrame([("train", 1), ("dev", 2)], "split string, x int"), str(tmp_path / "s"))
    assert sorted(x for x in os.listdir(tmp_path / "s") if x.startswith("split")) == ["split=dev", "split=train"]
    files.write_shards(spark.range(100).toDF("x"), str(tmp_path / "sh"), 3)
    assert sum(x.endswith(".parquet") for x in os.listdir(tmp_path / "sh")) == 3
    with pytest.raises(NotImplementedError):
        files.read_pdf(spark, str(d))


def test_results_and_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Mr. X: yes\nno"), (2, None)], "doc_id long, text string")
    parse = lambda d: models.parse(lines.split_lines(d), [], fix_words=False)
    res = {r.doc: r.result for r in entries.results(docs, parse(docs), sittings.sitting_meta(docs)).collect()}
    assert '"entries":[{' in res[1] and res[2] == '{"meta":null,"entries":null}'
    docs.write.parquet(str(tmp_path / "in"))
    q = parse_stream(spark, str(tmp_path / "in"), "doc_id long, text string", parse, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = parse(docs)
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()
