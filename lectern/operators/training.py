"""Training sets from hand labels: filters, checks, spans, joins, weights, splits, augmentation, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions.text import has_speaker, span2bio


def label_name(c: Column) -> Column:
    """Label in small letters without blanks around; null and empty are null."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def label_code(c: Column) -> Column:
    """header 0, speech 1, scene 2, garbage 3; others null."""
    out = F.lit(None).cast("int")
    for k, v in P.LABEL_CODES.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def code_label(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in P.LABEL_CODES.items():
        out = F.when(c == v, k).otherwise(out)
    return out


def usable(labels: DataFrame) -> DataFrame:
    """Rows with a label other than blank and without notes."""
    return labels.filter(F.col("label").isNotNull() & (F.col("label") != "blank") & F.col("notes").isNull())


def default_spans(labels: DataFrame) -> DataFrame:
    """start and end as 0-based half-open span: a missing start before a given end is the first character, a missing end
    after a given start the last one."""
    start = F.when(F.col("start").isNull() & F.col("end").isNotNull(), 1).otherwise(F.col("start"))
    end = F.when(F.col("end").isNull() & F.col("start").isNotNull(), F.char_length("text")).otherwise(F.col("end"))
    return labels.withColumn("_s", (start - 1).cast("int")).withColumn("end", end.cast("int")).withColumn("start", F.col("_s")).drop("_s")


def with_bio(spans: DataFrame) -> DataFrame:
    """bio and has_speaker of a span; one that does not lie within the text counts as none."""
    ok = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.char_length("text"))
    bio = span2bio(F.char_length("text"), F.when(ok, F.col("start")), F.when(ok, F.col("end")))
    return spans.withColumn("bio", bio).withColumn("has_speaker", has_speaker(F.col("bio")))


def quality(labels: DataFrame, allowed: tuple[str, ...] = tuple(P.LABEL_CODES)) -> DataFrame:
    """One row of counts: rows, and those that break each rule."""
    bad = {
        "null_text": F.col("text").isNull(), "empty_text": F.char_length("text") == 0, "null_label": F.col("label").isNull(),
        "unknown_label": F.col("label").isNotNull() & ~F.col("label").isin(*allowed),
    }
    return labels.agg(F.count("*").alias("rows"), *(F.count(F.when(c, 1)).alias(k) for k, c in bad.items()), F.countDistinct("label").alias("labels"))


def span_quality(spans: DataFrame) -> DataFrame:
    """One row of counts over 0-based spans: reversed ones, ones past the text, and whether all are in order."""
    rev, past = F.col("start") > F.col("end"), F.col("end") > F.char_length("text")
    return spans.agg(F.count("*").alias("rows"), F.count(F.when(rev, 1)).alias("reversed"), F.count(F.when(past, 1)).alias("past_text"), F.min("start").alias("least_start"), F.coalesce(F.bool_and(~(rev | past)), F.lit(True)).alias("all_right"))


def context_rows(lines: DataFrame, n: int = P.CONTEXT_LINES) -> DataFrame:
    """Rows kept for training by their contexts: no row with an empty one before it although past line n, none with an
    empty one after it unless its text ends the document by its mark."""
    return lines.filter(~((F.col("prev_context") == "") & (F.col("line") > n)) & ~((F.col("next_context") == "") & ~F.coalesce(F.col("text").endswith("<EOD>"), F.lit(False))))


def join_context(labels: DataFrame, context: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(labels with the columns of context, keys that occur more than once on either side)."""
    many = labels.groupBy(*keys).count().filter("count > 1").unionByName(context.groupBy(*keys).count().filter("count > 1"))
    return labels.join(context, keys, "left"), many


def file_ids(labels: DataFrame, ids: DataFrame) -> DataFrame:
    """``labels(folder, file, ...)`` with _id of ``ids(folder, file, _id)``, null where missing; an id is taken once."""
    one = ids.groupBy("folder", "file").agg(F.max("_id").alias("_id"))
    return labels.join(one, ["folder", "file"], "left")


def missing_ids(labels: DataFrame, ids: DataFrame) -> DataFrame:
    """(folder, file) of labels without an id."""
    return labels.select("folder", "file").distinct().join(ids.select("folder", "file"), ["folder", "file"], "left_anti")


def label_texts(labels: DataFrame, lines: DataFrame) -> DataFrame:
    """``labels(_id, line, ...)`` with the text of ``lines(_id, line, text)``."""
    return labels.join(lines, ["_id", "line"], "left")


def lines_of(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Lines of the listed files."""
    return lines.join(files.select("file").distinct(), "file", "left_semi")


def without_garbage(labels: DataFrame) -> DataFrame:
    """``labels`` and, as files named _wo_garbage, its rows that are no garbage."""
    return labels.unionByName(labels.filter(F.col("label") != "garbage").withColumn("file", F.concat("file", F.lit("_wo_garbage"))), allowMissingColumns=True)


def class_weights(labels: DataFrame, column: str = "label") -> DataFrame:
    """(column, n, share, weight): share of all rows, and 1/share of a row of the class, scaled so that the weights of
    all rows sum to 1. Aggregated first: the window runs over classes, not rows."""
    n = labels.groupBy(column).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1))
    return n.select(column, "n", (F.col("n") / F.sum("n").over(w)).alias("share"), (1 / (F.col("n") * F.count("*").over(w))).alias("weight"))


def share_weights(df: DataFrame, column: str) -> DataFrame:
    """(column, n, weight): 1/share of each value among all rows, so that rare ones weigh more; nulls are a value."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.select(column, "n", (F.sum("n").over(Window.partitionBy(F.lit(1))) / F.col("n")).alias("weight"))


def total_sort(df: DataFrame, keys: tuple[str, ...] = ("year", "file", "line")) -> DataFrame:
    """Rows in one order over all partitions: a range-partitioned sort on the keys, so a file of any size is many tasks."""
    return df.orderBy(*keys)


def hash_share(*keys: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the keys, the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(k.cast("string") for k in keys), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / 4294967296.0


def split(df: DataFrame, keys: list[str], train: float = 0.6, dev: float | None = 0.2, test: float = 0.2, seed: int = 0) -> DataFrame:
    """``df`` with split: train, dev or test by a hash of the keys, so all rows of equal keys go together. The sizes must
    sum to 1; without dev, only train and test are given."""
    if abs(train + (dev or 0.0) + test - 1) > 1e-9:
        raise ValueError("sizes must sum to 1")
    x = hash_share(*(F.col(k) for k in keys), seed=seed)
    out = F.when(x < train, "train")
    if dev:
        out = out.when(x < train + dev, "dev")
    return df.withColumn("split", out.otherwise("test"))


def split_lines_randomly(lines: DataFrame, keys: list[str], passes: int = P.SPLIT_PASSES, seed: int = 0) -> DataFrame:
    """``lines(file, line, text, ...)`` and, for each pass i, its rows as files named _i where each text longer than one
    character is cut in two with chance one half, at a place spread evenly; lines are numbered anew. The choice comes from
    a hash of the keys, so it is the same again."""
    outs = [lines]
    for i in range(passes):
        k = [F.col(c) for c in keys]
        n = F.char_length("text")
        cut = F.floor(hash_share(*k, F.lit("at"), seed=seed + i) * (n - 1)).cast("int") + 1
        do = (n > 1) & (hash_share(*k, seed=seed + i) < 0.5)
        parts = F.when(do, F.array(F.left("text", cut), F.substring(F.col("text"), cut + 1, n))).otherwise(F.array("text"))
        own = F.struct("line", *(c for c in keys if c not in ("file", "line"))).alias("_own")
        part = lines.select(*(c for c in lines.columns if c != "text"), own, F.posexplode(parts).alias("_part", "text"))
        w = Window.partitionBy("file").orderBy("_own", "_part")
        part = part.withColumn("line", F.row_number().over(w)).withColumn("file", F.concat("file", F.lit(f"_{i}"))).drop("_part")
        outs.append(part.select(*lines.columns))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def upsample(labels: DataFrame, column: str = "label", factor: int = P.UPSAMPLE, seed: int = P.UPSAMPLE_SEED) -> DataFrame:
    """A weighted sample with replacement of ``factor`` times the rows, each class as likely as another.

    Every row is repeated a Poisson number of times with mean factor x weight x rows, drawn from a seeded stream on the
    executors: no global order, no join, and counts that agree with drawing one by one up to chance.
    """
    n = labels.groupBy(column).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(F.lit(1))
    mean = n.select(F.col(column).alias("_c"), (factor * F.sum("_n").over(w) / (F.count("*").over(w) * F.col("_n"))).alias("_mean"))
    joined = labels.join(mean, F.col(column).eqNullSafe(F.col("_c")))  # small sides are broadcast by their measured size
    # inverse of the Poisson distribution by a bounded running sum, exact to double precision
    u = F.rand(seed)
    k = F.sequence(F.lit(0), (F.col("_mean") + 12 * F.sqrt("_mean") + 25).cast("int"))
    acc = F.aggregate(
        k, F.struct(F.exp(-F.col("_mean")).alias("p"), F.lit(0.0).alias("c"), F.lit(0).alias("r")),
        lambda s, i: F.struct((s["p"] * F.col("_mean") / (i + 1)).alias("p"), (s["c"] + s["p"]).alias("c"), (s["r"] + F.when(F.col("_u") >= s["c"] + s["p"], 1).otherwise(0)).alias("r")),
        lambda s: s["r"],
    )
    return joined.withColumn("_u", u).withColumn("_k", acc).withColumn("_i", F.explode(F.array_repeat(F.lit(1), F.col("_k")))).select(*labels.columns)
