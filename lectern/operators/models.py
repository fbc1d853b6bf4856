"""Labelers by name, and the hooks for models that label lines in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions.predicates import refine_header
from lectern.functions.text import bio2span, span2bio, truncate
from lectern.operators import entries, labels, spans, supervised
from lectern.operators.lines import in_blocks, line_context
from lectern.operators.training import code_label


class Predictor(Protocol):
    """Predictions for a batch of texts with their contexts."""

    def __call__(self, texts: list[str], contexts: list[str]) -> list: ...


#: Share of a task's calls that may fail.
FAILED = 0.5
BATCH = {"line_type": 50, "span": 10, "has_speaker": 50}


def predict(lines: DataFrame, predictor: Predictor, column: str, kind: str, batch: int, only: str | None = None, default: str | int | None = None, context: bool = True) -> DataFrame:
    """``lines`` with ``column`` from a model that is called with ``batch`` texts at a time, in Arrow batches.

    Texts come with their context, cut to the model's length. With ``only`` a label, other lines are not sent to the
    model at all and get ``default``. A failed call leaves nulls for its texts; a task in which more than FAILED of the calls
    fail raises the last error.
    """
    df = line_context(lines) if context else lines.withColumn("context", F.lit("")).withColumn("prev_context", F.lit("")).withColumn("next_context", F.lit(""))
    df = df.withColumn("_in", truncate(F.col("text"), F.col("context")))

    @F.pandas_udf(kind)
    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, contexts in it:
            out: list = []
            calls, errors = 0, []
            for i in range(0, len(texts), batch):
                calls += 1
                t, c = list(texts[i : i + batch]), list(contexts[i : i + batch])
                try:
                    got = list(predictor(t, c))
                except Exception as e:  # the model's own errors cost only its batch
                    errors.append(e)
                    got = [None] * len(t)
                out += got
            if len(errors) > FAILED * calls:
                raise RuntimeError(f"{len(errors)} of {calls} calls of the model failed") from errors[-1]
            yield pd.Series(out, dtype=object if kind == "string" else None)

    drop = ("_in", "context", "prev_context", "next_context")
    got = lambda d: d.withColumn(column, run(F.col("_in.text"), F.col("_in.context"))).drop(*drop)
    if only is None:
        return got(df)
    mine = F.col("label").eqNullSafe(only)
    return got(df.filter(mine)).unionByName(df.filter(~mine).withColumn(column, F.lit(default).cast(kind)).drop(*drop))


def _rule_lines(lines: DataFrame, headers: list[str], **_) -> DataFrame:
    return labels.label_lines(lines, headers)


def _supervised_lines(lines: DataFrame, headers: list[str], predictor: Predictor | PipelineModel | None = None, **_) -> DataFrame:
    if predictor is None:
        raise ValueError("the supervised labeler needs a predictor or a model")
    if isinstance(predictor, PipelineModel):
        got = supervised.predict_line_types(predictor, line_context(lines), "_name").drop("context", "prev_context", "next_context")
        return got.withColumn("label", F.when(F.col("_name") == "header", refine_header(F.col("text"), headers)).otherwise(F.col("_name"))).drop("_name")
    df = predict(lines, predictor, "_code", "int", BATCH["line_type"])
    name = code_label(F.col("_code"))
    return df.withColumn("label", F.when(name == "header", refine_header(F.col("text"), headers)).otherwise(name)).drop("_code")


def _rule_spans(labelled: DataFrame, **_) -> DataFrame:
    return spans.label_spans(labelled)


def _hybrid_spans(labelled: DataFrame, predictor: Predictor | PipelineModel | None = None, **_) -> DataFrame:
    if predictor is None:
        raise ValueError("the hybrid labeler needs a predictor or a model")
    if isinstance(predictor, PipelineModel):
        speech = F.col("label").eqNullSafe("speech")
        flagged = supervised.predict_has_speaker(predictor, line_context(labelled)).drop("context", "prev_context", "next_context")
        return spans.hybrid_spans(spans.label_spans(flagged.withColumn("has_speaker", F.when(speech, F.col("has_speaker")).otherwise(0))))
    return spans.hybrid_spans(spans.label_spans(predict(labelled, predictor, "has_speaker", "int", BATCH["has_speaker"], "speech", 0)))


def _supervised_spans(labelled: DataFrame, predictor: Predictor | PipelineModel | None = None, **_) -> DataFrame:
    if predictor is None:
        raise ValueError("the supervised labeler needs a predictor or a model")
    if isinstance(predictor, PipelineModel):
        base = spans.label_spans(labelled).drop("start", "end", "bio")
        asked = base.filter(F.col("label").eqNullSafe("speech")).select("doc", "line_no", F.col("scan").alias("text"))
        got = supervised.predict_spans(predictor, asked, ["doc", "line_no"]).select("doc", "line_no", "start", "end")
        out = base.join(got, ["doc", "line_no"], "left")
        return out.withColumn("bio", span2bio(F.char_length("scan"), F.col("start"), F.col("end")))
    df = predict(spans.label_spans(labelled).drop("start", "end", "bio"), predictor, "_bio", "string", BATCH["span"], "speech", "")
    bio = F.substring_index(F.regexp_replace(F.col("_bio"), " ", ""), "<eos>", 1)
    s = bio2span(bio)
    return df.withColumn("start", s["start"]).withColumn("end", s["end"]).withColumn("bio", span2bio(F.char_length("scan"), F.col("start"), F.col("end"))).drop("_bio")


LINE_LABELERS: dict[str, Callable[..., DataFrame]] = {"rule": _rule_lines, "supervised": _supervised_lines}
SPAN_LABELERS: dict[str, Callable[..., DataFrame]] = {"rule": _rule_spans, "hybrid": _hybrid_spans, "supervised": _supervised_spans}


def parse(
    lines: DataFrame, headers: list[str], line_labeler: str = "rule", span_labeler: str = "rule", line_predictor: Predictor | PipelineModel | None = None,
    span_predictor: Predictor | PipelineModel | None = None, fix_words: bool = True, dictionary: frozenset[str] = frozenset(), unmerged: bool = False, spread: bool = False,
) -> DataFrame:
    """Entries of ``lines(doc, line_no, text, tags)``: label, override, spans, names, merge, headings, pruning.

    ``unmerged`` gives the lines as they are before merging (doc, line_no, label, speaker, said, bio) instead. ``spread`` is for
    documents of many rows, of which one may hold a large part of all: up to the names, where a line depends on near ones
    only, each is many tasks, for one more exchange.
    """
    if line_labeler not in LINE_LABELERS or span_labeler not in SPAN_LABELERS:
        raise ValueError(f"labelers: {sorted(LINE_LABELERS)}, {sorted(SPAN_LABELERS)}")
    def near(df: DataFrame) -> DataFrame:
        df = labels.override_headers(LINE_LABELERS[line_labeler](df, headers, predictor=line_predictor))
        return spans.speeches_only(spans.extract_names(SPAN_LABELERS[span_labeler](df, predictor=span_predictor)))

    df = in_blocks(lines, near) if spread else near(lines)
    if span_labeler != "rule":
        df = spans.continued_names(df)
    if unmerged:
        return df.select("doc", "line_no", "label", "speaker", "said", "bio")
    return entries.finish(entries.merge_entries(df), fix_words, dictionary)


def diagnostics(unmerged: DataFrame) -> DataFrame:
    """(doc, lines, unlabeled, labels): what a verbose run warns of."""
    return unmerged.groupBy("doc").agg(F.count("*").alias("lines"), F.count(F.when(F.col("label").isNull(), 1)).alias("unlabeled"), F.countDistinct("label").alias("labels"))


DEFAULT_LENGTH = P.MAX_CHARS
