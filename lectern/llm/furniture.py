"""Page furniture with words of its own (running titles, notes at the foot), learned from where its lines stand.

A line that a page break puts into the middle of a text has nothing to do with the lines around it and stands alone as
well: its shape (numbers alike) recurs between other lines after many different ones, and as the whole of a record. Lines
of speech, list points, headings and stage annotations do one of these at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import speech
from lectern.sources.tables import stage

#: A shape is furniture if it follows at least so many different lines within texts, these are at least this share of its
#: places there, and it is the whole of a record at least once.
CONTEXTS, DIVERSE = 2, 0.5
#: Layouts are few; more shapes than this are an error, none is left out in silence.
MOST = 20_000


def _shape(line: Column) -> Column:
    """As ``speech.shape``."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(line, speech.TAG.pattern, "")), "[0-9]+", "0")
    bare = F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))
    return F.when(F.rlike(bare, F.lit("0 ?[snrt]")), F.regexp_replace(bare, speech.DAY, speech.A_DAY)).otherwise(bare)


def candidates(records: DataFrame) -> DataFrame:
    """(shape) of lines with words that stand between others after different ones, over all texts of ``records(text)``."""
    at = records.filter(F.col("text").contains("\n")).select(F.split("text", "\n").alias("t")).filter(F.size("t") > 2)
    inner = at.select(F.explode(F.transform(F.sequence(F.lit(2), F.size("t") - 1), lambda i: F.struct(F.element_at("t", i).alias("line"), F.element_at("t", i - 1).alias("before")))).alias("x"))
    inner = inner.select(_shape(F.col("x.line")).alias("shape"), F.xxhash64(_shape(F.col("x.before"))).alias("before")).filter(F.rlike("shape", F.lit("[a-z]{3}")))
    per = inner.groupBy("shape", "before").agg(F.count("*").alias("n")).groupBy("shape").agg(F.count("*").alias("contexts"), F.sum("n").alias("n"))
    return per.filter((F.col("contexts") >= CONTEXTS) & (F.col("contexts") >= DIVERSE * F.col("n"))).select("shape")


def learn(records: DataFrame) -> speech.Learned:
    """The furniture of ``records(text)``. Null and empty texts count for nothing; an empty table gives none; records
    delivered again change nothing, as only different lines before a line count."""
    could = stage(candidates(records).withColumn("h", F.xxhash64("shape")), "shapes")
    # signs but digits and blanks: a shape has those of its line, with a month as one; lines with many more need no look
    size = lambda c: F.char_length(F.translate(c, "0123456789 \t\r\u00a0", ""))
    longest = could.agg(F.max(size(F.col("shape")))).first()[0]
    if longest is None:
        return speech.NOTHING
    alone = records.filter(F.col("text").isNotNull() & ~F.col("text").contains("\n") & (F.col("text").contains("<") | (size(F.col("text")) <= longest + 10)))
    alone = alone.select(F.xxhash64(_shape(F.col("text"))).alias("h"))
    found = alone.join(could, "h").select("shape").distinct().limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} shapes recur between other lines")
    return speech.Learned(frozenset(r.shape for r in found)) if found else speech.NOTHING
