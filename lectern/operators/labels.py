"""Line labels: rules, the override of lone headings, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.predicates import override_applies, rule_label


def label_lines(lines: DataFrame, headers: list[str], use_tags: bool = False) -> DataFrame:
    """``lines`` with label, by the rules; tags count as evidence only on request."""
    return lines.withColumn("label", rule_label(F.col("text"), headers, F.col("tags") if use_tags else None))


def override_headers(labelled: DataFrame) -> DataFrame:
    """``labelled`` with the label of lone headings that can't be one replaced by that of the line before, and
    overridden. First and last lines of a document and lines next to another heading stay; a null label is no heading.
    One look at both neighbours is exact: a replaced line's neighbours are no headings, so replacements never chain.
    """
    w = Window.partitionBy("doc").orderBy("line_no")
    head = lambda c: F.coalesce(c.contains("header"), F.lit(False))
    out = labelled.withColumn("_p", F.lag("label").over(w)).withColumn("_n", F.lead("label").over(w))
    out = out.withColumn("_inner", F.lag("text").over(w).isNotNull() & F.lead("text").over(w).isNotNull())
    out = out.withColumn("overridden", F.col("_inner") & head(F.col("label")) & ~head(F.col("_p")) & ~head(F.col("_n")) & override_applies(F.col("text")))
    return out.withColumn("label", F.when(F.col("overridden"), F.col("_p")).otherwise(F.col("label"))).drop("_p", "_n", "_inner")


def label_counts(labelled: DataFrame) -> DataFrame:
    """(label, lines, overridden)."""
    return labelled.groupBy("label").agg(F.count("*").alias("lines"), F.sum(F.col("overridden").cast("long")).alias("overridden"))
