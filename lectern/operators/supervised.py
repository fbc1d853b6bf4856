"""Linear models for the supervised labelers: line types, lines with a speaker, and where the speaker's name ends.

Text goes in as hashed pieces of one to three characters, its shape, and the words of its context; multinomial logistic
regression on top. All of it is a Spark ML pipeline, so fitting and predicting are distributed, and predictions stay in
the JVM.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import span2bio, truncate
from lectern.operators.training import code_label, label_code

#: Features of the text and of its context (powers of two).
TEXT, CONTEXT = 1 << 15, 1 << 11
#: Words at the head of a line among which a speaker's name may end.
HEAD_WORDS = 16


def _pieces(c: Column) -> Column:
    """Pieces of one to three characters of a text, with the ends marked, and its shape."""
    ends = F.concat(F.lit("^"), F.lower(c), F.lit("$"))
    grams = [F.regexp_extract_all(ends, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in (1, 2, 3)]
    letters = F.regexp_replace(c, "[^A-Za-z]", "")
    capitals = F.char_length(F.regexp_replace(c, "[^A-Z]", "")) / F.greatest(F.char_length(letters), F.lit(1))
    shape = F.array(
        F.concat(F.lit("chars:"), F.floor(F.log2(F.char_length(c) + 1)).cast("string")), F.concat(F.lit("capitals:"), F.floor(capitals * 4).cast("string")),
        F.concat(F.lit("ends:"), F.left(c, F.lit(1)), F.right(c, F.lit(1))),
    )
    return F.concat(*grams, shape)


def _featured(df: DataFrame) -> DataFrame:
    """``df(text, context)`` with what the pipelines take; nulls count as empty, long texts are cut as for any model."""
    t = truncate(F.coalesce("text", F.lit("")), F.coalesce("context", F.lit("")) if "context" in df.columns else F.lit(""))
    return df.withColumn("_t", t).withColumn("_pieces", _pieces(F.col("_t.text"))).withColumn("_words", F.split(F.lower(F.col("_t.context")), r"\s+")).drop("_t")


def _fit(df: DataFrame, label: str, weights: str | None = None) -> PipelineModel:
    steps = [
        HashingTF(inputCol="_pieces", outputCol="_a", numFeatures=TEXT, binary=True), HashingTF(inputCol="_words", outputCol="_b", numFeatures=CONTEXT, binary=True),
        VectorAssembler(inputCols=["_a", "_b"], outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol=label, predictionCol="_y", probabilityCol="_p", rawPredictionCol="_r", maxIter=25, regParam=1e-4, **({"weightCol": weights} if weights else {})),
    ]
    return Pipeline(stages=steps).fit(df)


def fit_line_types(labelled: DataFrame) -> PipelineModel:
    """A model of ``labelled(text, label[, context])``; rows of unknown or no label are left out."""
    rows = _featured(labelled.withColumn("_l", label_code(F.col("label")).cast("double")).filter("_l is not null"))
    return _fit(rows, "_l")


def predict_line_types(model: PipelineModel, lines: DataFrame, column: str = "label") -> DataFrame:
    """``lines(text[, context])`` with ``column``: header, speech, scene or garbage."""
    got = model.transform(_featured(lines))
    return got.withColumn(column, code_label(F.col("_y").cast("int"))).select(*[c for c in lines.columns if c != column], column)


def fit_has_speaker(spans: DataFrame) -> PipelineModel:
    """A model of ``spans(text, has_speaker[, context])``."""
    return _fit(_featured(spans.withColumn("_l", F.col("has_speaker").cast("double")).filter("_l is not null")), "_l")


def predict_has_speaker(model: PipelineModel, lines: DataFrame) -> DataFrame:
    """``lines(text[, context])`` with has_speaker, 0 or 1."""
    return model.transform(_featured(lines)).withColumn("has_speaker", F.col("_y").cast("int")).select(*[c for c in lines.columns if c != "has_speaker"], "has_speaker")


def _ends(df: DataFrame, text: str) -> DataFrame:
    """``df`` with a row for each place at its head where a name may end: _end, and in text and context what stands before
    and after."""
    c = F.coalesce(F.col(text), F.lit(""))
    # with the signs between them the words make up the text, so their lengths add up to places
    words = F.slice(F.regexp_extract_all(c, F.lit(r"([\s:;]*[^\s:;]+)"), F.lit(1)), 1, HEAD_WORDS)
    ends = F.aggregate(words, F.array(F.lit(0)), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + F.char_length(w))))
    out = df.withColumn("_end", F.explode(F.slice(ends, 2, HEAD_WORDS)))
    before, after = F.substring(c, F.lit(1), F.col("_end")), F.substring(c, F.col("_end") + 1, F.lit(12))
    return out.withColumn("_before", F.right(before, F.lit(40))).withColumn("_after", F.concat(F.lit("|"), after)).withColumn("context", F.concat_ws(" ", F.left(after, F.lit(1)), F.substring(after, 2, 8), F.concat(F.lit("n"), F.floor(F.col("_end") / 8).cast("string"))))


def fit_spans(spans: DataFrame) -> PipelineModel:
    """A model of where names end, from ``spans(text, start, end)``: half-open spans at the head of the text, nulls for none."""
    rows = _ends(spans, "text").withColumn("_l", F.coalesce((F.col("_end") == F.col("end")), F.lit(False)).cast("double"))
    return _fit(_featured(rows.withColumn("text", F.concat("_before", "_after"))), "_l")


def predict_spans(model: PipelineModel, lines: DataFrame, key: list[str]) -> DataFrame:
    """``lines(*key, text)`` with start, end and bio: the most probable end if it is more likely one than not, else none."""
    rows = _ends(lines.select(*key, "text"), "text").withColumn("_text", F.col("text")).withColumn("text", F.concat("_before", "_after"))
    best = model.transform(_featured(rows)).withColumn("_q", vector_to_array("_p")[1]).groupBy(*key).agg(F.max(F.struct("_q", "_end")).alias("b"))
    end = F.when(F.col("b._q") > 0.5, F.col("b._end"))
    out = lines.join(best, key, "left").withColumn("end", end).drop("b")
    lead = F.char_length(F.regexp_extract("text", r"^(\s*)", 1))
    out = out.withColumn("start", F.when(F.col("end").isNotNull(), lead))
    return out.withColumn("bio", span2bio(F.char_length("text"), F.col("start"), F.col("end")))
