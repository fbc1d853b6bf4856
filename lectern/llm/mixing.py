"""Mixing sources to target weights.

Method: capped water-filling. Sources that can't reach their share within their most repeats are held at that, the
excess goes to the others in proportion, until all fit; records then get whole repeats and, in seeded order, one more
until the fraction of the source is filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.tokens import count_tokens
from lectern.sources.tables import stage

#: Hash buckets of a source: the fraction is filled bucket by bucket, the last bucket again by buckets of its own, and only
#: the last of those (a millionth of the source) record by record.
BUCKETS = 1024


def source_name(c: Column) -> Column:
    """One spelling of a source: small letters, no blanks around, underscores within; null and blank give null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_"), F.lit(""))


def water_fill(sizes: dict[str, int], weights: dict[str, float], repeats: dict[str, int], total: float) -> dict[str, float]:
    """Tokens to take from each source: weights of ``total``, capped at repeats x size, what is cut off spread over the
    uncapped sources by weight, until nothing is over. If all are capped, less than ``total`` is taken."""
    cap = {s: repeats.get(s, 1) * sizes.get(s, 0) for s in weights}
    fixed: dict[str, float] = {s: 0.0 for s in weights if not cap[s] or weights[s] <= 0}
    while True:
        free = [s for s in weights if s not in fixed]
        w = sum(weights[s] for s in free)
        rest = total - sum(fixed.values())
        want = {s: rest * weights[s] / w for s in free} if w > 0 else {}
        over = [s for s in free if want[s] > cap[s]]
        if not over:
            return fixed | want
        fixed |= {s: float(cap[s]) for s in over}


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 1, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, shares) of a mixture of ``documents(doc_id, source, text)`` by ``targets(source, target_share, max_repeats)``.

    records(doc_id, source, n_tokens, copies) has each record used, copies times; shares(source, target_share,
    max_repeats, available_tokens, tokens, epochs, capped, actual_share) the outcome, one row per target. ``total`` is
    the size to reach in tokens, by default that of all records of the sources. Records of no listed source, of null
    source or without tokens are not used. Spellings of one source are one; of targets given twice the shares add up.
    """
    spark = documents.sparkSession
    sized = count_tokens(documents.withColumn("source", source_name(F.col("source"))), ["doc_id", "source"], path)
    sized = sized.filter("n_tokens > 0 and source is not null").withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    sized = stage(sized, "sizes")
    wanted = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).filter("source is not null").collect()
    names = [r.source for r in wanted]
    mine = sized.filter(F.col("source").isin(names)) if names else sized.limit(0)
    per = {r.source: r.n for r in mine.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    take = water_fill(per, {r.source: r.target_share or 0.0 for r in wanted}, {r.source: r.max_repeats or 0 for r in wanted}, float(sum(per.values()) if total is None else total))
    plan = []
    for s in names:
        n = per.get(s, 0)
        e = take[s] / n if n else 0.0
        whole = int(e + 1e-9)
        plan.append((s, whole, max(0.0, take[s] - whole * n)))
    plan_df = F.broadcast(spark.createDataFrame(plan, "source string, whole int, extra double"))  # a row per target
    rows = mine.join(plan_df, "source").withColumn("base", F.lit(0))
    done = []
    for level in (0, 1):
        rows = rows.withColumn("bucket", F.pmod(F.shiftright("h", 10 * level), F.lit(BUCKETS)).cast("int"))
        fill = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"), F.min("base").alias("start"))
        fill = fill.withColumn("upto", F.col("start") + F.sum("n").over(Window.partitionBy("source").orderBy("bucket")))
        fill = fill.select("source", "bucket", (F.col("upto") - F.col("n")).alias("before"), "upto")
        if len(names) <= 100:
            fill = F.broadcast(fill)  # BUCKETS rows for each of at most 100 sources
        placed = rows.join(fill, ["source", "bucket"])
        at_edge = (F.col("before") < F.col("extra")) & (F.col("upto") > F.col("extra"))
        done.append(placed.filter(~at_edge).withColumn("more", (F.col("upto") <= F.col("extra")).cast("int")).select("doc_id", "source", "n_tokens", "whole", "more"))
        rows = placed.filter(at_edge).withColumn("base", F.col("before")).drop("bucket", "before", "upto")
    w = Window.partitionBy("source").orderBy("h", "doc_id")
    last = rows.withColumn("more", (F.col("base") + F.sum("n_tokens").over(w) - F.col("n_tokens") / 2 <= F.col("extra")).cast("int")).select("doc_id", "source", "n_tokens", "whole", "more")
    records = done[0].unionByName(done[1]).unionByName(last).select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("more")).alias("copies")).filter("copies > 0")
    used = records.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    goal = spark.createDataFrame([(r.source, r.target_share, r.max_repeats, per.get(r.source, 0), take[r.source] + 1e-6 >= (r.max_repeats or 0) * per.get(r.source, 0)) for r in wanted], "source string, target_share double, max_repeats int, available_tokens long, capped boolean")
    shares = goal.join(used, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    all_ = Window.partitionBy(F.lit(1))
    shares = shares.select(
        "source", "target_share", "max_repeats", "available_tokens", "tokens",
        F.round(F.col("tokens") / F.nullif("available_tokens", F.lit(0)), 6).alias("epochs"), "capped",
        F.round(F.col("tokens") / F.nullif(F.sum("tokens").over(all_), F.lit(0)), 6).alias("actual_share"),
    )
    return records, shares
