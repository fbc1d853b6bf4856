"""Command lines: parse transcripts, split labelled lines or files of them, train and use models, pdf to text."""

from __future__ import annotations

import argparse

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lectern.operators import entries, lines, models, sittings, supervised, training
from lectern.sources import files
from lectern.sources.tables import ship


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("parse", help="transcripts to entries")
    a.add_argument("--input", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--headers", required=True, help="text file with a heading on each line")
    a.add_argument("--start-line", type=int, default=0)
    a.add_argument("--end-line", type=int)
    a.add_argument("--line-labeler", choices=sorted(models.LINE_LABELERS), default="rule")
    a.add_argument("--span-labeler", choices=sorted(models.SPAN_LABELERS), default="rule")
    a.add_argument("--line-model", help="folder of a model of line types (supervised)")
    a.add_argument("--span-model", help="folder of a model of spans (supervised) or of lines with a speaker (hybrid)")
    a.add_argument("--unmerged", help="folder for the lines as labelled, before merging: label and span predictions")
    a = sub.add_parser("split", help="hand labels to train, dev and test")
    for o in ("--filepath", "--outpath"):
        a.add_argument(o, required=True)
    a.add_argument("--by_sitting", action="store_true")
    for o, d in (("--train_size", 0.6), ("--dev_size", 0.2), ("--test_size", 0.2)):
        a.add_argument(o, type=float, default=d)
    a.add_argument("--seed", type=int, default=0)
    a = sub.add_parser("split_lines", help="labelled lines cut at random places, added to themselves")
    for o in ("--filepath", "--outpath"):
        a.add_argument(o, required=True)
    a.add_argument("--passes", type=int, default=2)
    a.add_argument("--seed", type=int, default=0)
    a = sub.add_parser("train", help="a model from hand labels")
    a.add_argument("--kind", choices=("line_type", "has_speaker", "span"), required=True)
    for o in ("--filepath", "--model"):
        a.add_argument(o, required=True)
    a = sub.add_parser("predict", help="line types of JSON instances")
    for o in ("--input", "--model", "--output"):
        a.add_argument(o, required=True)
    a = sub.add_parser("pdf2txt", help="pdf files to one JSON line each (needs pypdf)")
    for o in ("--input", "--output"):
        a.add_argument(o, required=True)
    return p


def _train(spark: SparkSession, kind: str, path: str):
    if kind == "line_type":
        rows = training.usable(files.read_labels(spark, path).withColumn("label", training.label_name(F.col("label")))).filter("text is not null")
        rows = lines.line_context(rows.select("file", "line", "label", "text"), group=["file"], order=["line", "label", "text"])
        return supervised.fit_line_types(rows)
    rows = training.with_bio(training.default_spans(files.read_labels(spark, path, spans=True).filter("text is not null")))
    return supervised.fit_has_speaker(rows.select("text", "has_speaker")) if kind == "has_speaker" else supervised.fit_spans(rows.select("text", "start", "end"))


def main(argv: list[str] | None = None) -> None:
    x = _arguments().parse_args(argv)
    spark = SparkSession.builder.appName("lectern").getOrCreate()
    ship(spark)
    if x.what == "split":
        labels = files.read_labels(spark, x.filepath)
        files.write_splits(training.split(labels, ["file"] if x.by_sitting else ["file", "line"], x.train_size, x.dev_size, x.test_size, x.seed), x.outpath)
    elif x.what == "split_lines":
        labels = files.read_labels(spark, x.filepath).filter("text is not null")
        got = training.split_lines_randomly(labels, ["folder", "file", "line", "label", "text"], x.passes, x.seed)
        got.write.mode("overwrite").option("header", True).csv(x.outpath)
    elif x.what == "train":
        _train(spark, x.kind, x.filepath).write().overwrite().save(x.model)
    elif x.what == "predict":
        got = supervised.predict_line_types(PipelineModel.load(x.model), files.read_instances(spark, x.input), "label")
        got.select(F.col("text").alias("line"), "label").write.mode("overwrite").json(x.output)
    elif x.what == "pdf2txt":
        files.read_pdf(spark, x.input).write.mode("overwrite").json(x.output)
    else:
        docs = files.read_transcripts(spark, x.input)
        headers = [r.value.strip().lower() for r in spark.read.text(x.headers).collect()]
        rows = lines.line_range(lines.split_lines(docs, "path"), x.start_line, x.end_line)
        how = {
            "line_labeler": x.line_labeler, "span_labeler": x.span_labeler, "line_predictor": PipelineModel.load(x.line_model) if x.line_model else None,
            "span_predictor": PipelineModel.load(x.span_model) if x.span_model else None,
        }
        if x.unmerged:
            models.parse(rows, headers, unmerged=True, **how).write.mode("overwrite").json(x.unmerged)
        got = models.parse(rows, headers, **how)
        files.write_json(entries.results(docs, got, sittings.sitting_meta(docs, "path"), "path"), x.output)


if __name__ == "__main__":
    main()
