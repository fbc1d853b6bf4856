"""Documents into ordered lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions.text import ascii_fold, strip, strip_tags, tags


#: Lines of a document that one task reads together, where an operator looks at near ones only; it then sees REACH lines
#: more at either end.
BLOCK, REACH = 4096, 16


def in_blocks(lines: DataFrame, run: Callable[[DataFrame], DataFrame], reach: int = REACH, size: int = BLOCK) -> DataFrame:
    """``run(lines)``, a document of any size spread over many tasks.

    For operators whose rows depend on at most ``reach`` lines before and after, in windows over doc: each block of ``size``
    line numbers becomes a document of its own with the lines next to it, whose own results are dropped again. ``lines(doc,
    line_no, ...)`` are numbered from 0 without gaps; ``run`` keeps doc and line_no.
    """
    own = F.floor(F.col("line_no") / size)
    at = F.col("line_no") % size
    near = F.array_compact(F.array(own, F.when((at < reach) & (own > 0), own - 1), F.when(at >= size - reach, own + 1)))
    wide = lines.withColumn("_block", F.explode(near)).withColumn("doc", F.struct(F.col("doc").alias("doc"), F.col("_block").alias("block"))).drop("_block")
    return run(wide).filter(F.col("doc.block") == own).withColumn("doc", F.col("doc.doc"))


def split_lines(documents: DataFrame, doc: str = "doc_id", text: str = "text", order: str | None = None, block: str | None = None) -> DataFrame:
    """(doc, line_no, text, tags): the lines of each document, numbered from 0 after empty ones are gone.

    Texts are folded to ASCII and cut at runs of line ends; lines are stripped, then lose their tags, so a line may
    keep blanks inside its former tags. ``order`` names a column by which several rows of one document follow each
    other; ``block`` a number that grows with it, by whose values a large document is spread: lines are numbered within each
    and the blocks' sizes added up. Null and empty texts and null documents give no line.
    """
    parts = documents.filter(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("doc"), (F.col(order) if order else F.lit(0)).alias("_o"), (F.col(block) if block else F.lit(0)).alias("_b"), F.posexplode(F.split(ascii_fold(F.col(text)), P.LINE_BREAKS)).alias("_p", "_t"))
    lines = parts.select("doc", "_o", "_b", "_p", strip(F.col("_t")).alias("_t"))
    # tags are rare: the long pattern runs only over lines with a bracket
    angled = F.col("_t").contains("<") | F.col("_t").contains(">")
    lines = lines.select("doc", "_o", "_b", "_p", F.when(angled, strip_tags(F.col("_t"))).otherwise(F.col("_t")).alias("text"), F.when(angled, tags(F.col("_t"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    lines = lines.filter(F.col("text") != "")
    if block is None:
        w = Window.partitionBy("doc").orderBy("_o", "_p")
        return lines.withColumn("line_no", F.row_number().over(w) - 1).select("doc", "line_no", "text", "tags")
    before = Window.partitionBy("doc").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    start = lines.groupBy("doc", "_b").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("doc", "_b", "_start")
    w = Window.partitionBy("doc", "_b").orderBy("_o", "_p")
    lines = lines.withColumn("_i", F.row_number().over(w) - 1).join(start, ["doc", "_b"])
    return lines.select("doc", (F.col("_start") + F.col("_i")).cast("int").alias("line_no"), "text", "tags")


def raw_lines(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line, text): lines numbered from 1 with blank ones kept, so that numbers of hand labels hold."""
    return documents.filter(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.posexplode(F.split(F.col(text), P.RAW_BREAKS)).alias("_p", "text")).select("doc", (F.col("_p") + 1).alias("line"), "text")


def line_range(lines: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Lines with start <= line_no < end."""
    out = lines.filter(F.col("line_no") >= start)
    return out if end is None else out.filter(F.col("line_no") < end)


def batch_ids(df: DataFrame, n: int, order: list[str], group: list[str]) -> DataFrame:
    """``df`` with batch: consecutive rows of each group in batches of n, from 0."""
    if n < 1:
        raise ValueError("batches need a positive size")
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) / n))


def line_context(lines: DataFrame, n: int = P.CONTEXT_LINES, group: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """``lines`` with prev_context, next_context (up to n lines each, joined by line ends) and context, both joined.

    The first n lines of a group of at least n rows have an empty prev_context.
    """
    group, order = group or ["doc"], order or ["line_no"]
    w = Window.partitionBy(*group).orderBy(*order)
    before = F.array_join(F.collect_list("text").over(w.rowsBetween(-n, -1)), "\n")
    after = F.array_join(F.collect_list("text").over(w.rowsBetween(1, n)), "\n")
    prev = F.when(F.row_number().over(w) > n, before).otherwise("")
    out = lines.withColumn("prev_context", prev).withColumn("next_context", after)
    return out.withColumn("context", F.concat("prev_context", F.lit("\n"), "next_context"))
