"""Splits that keep records of one sitting together.

Method: an incremental table of components. Every file value is linked to the keys read from its name; components come
from pointer jumping over these links; components that already have a split keep it, new ones fill the deficits of the
shares, and components that would join two splits are put in quarantine. ``update_splits`` keeps the table in a folder
from batch to batch.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.names import edits
from lectern.llm.speech import MONTHS
from lectern.sources.tables import stage

SHARES = {"train": 0.6, "dev": 0.2, "test": 0.2}
#: Components of at least this share of all records are placed one by one (there are at most 1/share of them);
#: the others are placed by hash bucket.
LARGE, BUCKETS = 1 / 5000, 8192


@lru_cache(maxsize=1 << 12)
def _month(word: str) -> int:
    w = word.lower()
    for i, m in enumerate(MONTHS, 1):
        if w == m or w == m[:3] or w == "sept" and i == 9:
            return i
    near = [(edits(w, m), i) for i, m in enumerate(MONTHS, 1)]
    d, i = min(near)
    return i if d <= (1 if len(w) < 5 else 2) else 0


def sitting_key(file: str | None, year: float | None) -> str | None:
    """The sitting a file value names: volume and number with the year of its records, or date and page.

    ``year`` is the year most records of the file give; it supplies the year of a volume and the century of a
    two-digit year. A name in no known form is its own sitting, but for case, blanks and a final .txt. Null: null.
    """
    if file is None:
        return None
    s = re.sub(r"\.txt\s*$", "", file.strip(), flags=re.I).lower()
    y = None if year is None or year != year else int(year)
    m = re.fullmatch(r"vol(?:ume|\.)?[\s_]*(\d+)[\s,_-]*(?:num(?:be?r)?|no)\.?[\s_]*(\d+)", s) or re.fullmatch(r"(\d+)\s*vol(?:ume)?\.?[\s_-]*(?:numbe?r|num|no)\.?\s*(\d+)", s)
    if m:
        return f"v{int(m.group(1))}/{int(m.group(2))}/{y or ''}"
    for pat, order in (
        (r"(\d{1,2})\s*(?:st|nd|rd|th)\s+([a-z]+),?\s*(\d{4})\s*_?\s*p[_\s]*(\d+)", "dmyp"),
        (r"(\d{4})-(\d{1,2})-(\d{1,2})_p(\d+)", "ymdp"),
        (r"(\d{1,2})-([a-z]+)-(\d{4})\s+page\s+(\d+)", "dmyp"),
        (r"([a-z]+)\s+(\d{1,2})\s*(?:st|nd|rd|th)\s+(\d{2}|\d{4})\s*-\s*pg\s*(\d+)", "mdyp"),
    ):
        m = re.fullmatch(pat, s)
        if m:
            g = dict(zip(order, m.groups()))
            month = int(g["m"]) if g["m"].isdigit() else _month(g["m"])
            if month:
                yy = int(g["y"])
                if yy < 100:
                    yy = y if y and y % 100 == yy else (1900 + yy if yy >= 30 else 2000 + yy)
                return f"d{yy:04d}-{month:02d}-{int(g['d']):02d}/{int(g['p'])}"
    return "n" + re.sub(r"[\s_]+", " ", s)


def year_counts(records: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(file, year, n): records of each file value that is not null and year, with those ``state`` has counted before (if
    it has ``year`` and ``n``); one partial aggregate before the shuffle, so a hot file costs no more than another."""
    per = records.filter(F.col("file").isNotNull()).groupBy("file", "year").agg(F.count("*").alias("n"))
    if state is not None and "n" in state.columns:
        old = state.select("file", F.col("year").cast(records.schema["year"].dataType).alias("year"), "n")
        per = per.unionByName(old.filter(F.col("file").isNotNull())).groupBy("file", "year").agg(F.sum("n").alias("n"))
    return per


def file_years(counts: DataFrame) -> DataFrame:
    """(file, n, year) of ``year_counts``: records of each file value and the year most of them give (the smaller of equals)."""
    best = F.max(F.when(F.col("year").isNotNull(), F.struct("n", (-F.col("year")).alias("y"))))
    return counts.groupBy("file").agg(F.sum("n").alias("n"), best.alias("b")).select("file", "n", (-F.col("b.y")).cast("double").alias("year"))


def sitting_links(records: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(file, n, key): one row per file value that is not null, of ``records`` and of a ``state`` with counts."""

    @F.pandas_udf("string")
    def key(file: pd.Series, year: pd.Series) -> pd.Series:
        return pd.Series([sitting_key(f, y) for f, y in zip(file, year)], dtype=object)

    return file_years(year_counts(records, state)).select("file", "n", key("file", "year").alias("key"))


def components(links: DataFrame, node: str = "file", key: str = "key", what: str = "components") -> DataFrame:
    """(node, component) over links node-key: the least node of each connected component, by pointer jumping.

    Each round every node takes the least label seen at its keys and then jumps to that label's own label, so chains
    halve; rounds are written to the shared folder. Nulls link nothing; repeated links and an empty table are fine.
    """
    e = links.select(F.col(node).alias("node"), F.col(key).alias("key")).dropna().distinct()
    lab = stage(e.groupBy("node").agg(F.min("node").alias("label")), what)
    while True:
        at = e.join(lab, "node").groupBy("key").agg(F.min("label").alias("m"))
        low = e.join(at, "key").groupBy("node").agg(F.min("m").alias("m"))
        jump = lab.select(F.col("node").alias("m"), F.col("label").alias("up"))
        new = low.join(jump, "m", "left").select("node", F.least("m", F.coalesce("up", "m")).alias("label"))
        new = stage(new, what)
        changed = new.join(lab.withColumnRenamed("label", "old"), "node").filter(F.col("label") != F.col("old")).limit(1).count()
        lab = new
        if not changed:
            return lab.select(F.col("node").alias(node), F.col("label").alias("component"))


def _bucket(c: Column | str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def assign_splits(records: DataFrame, state: DataFrame | None = None, shares: dict[str, float] | None = None) -> DataFrame:
    """(file, n, component, split) for every file value of ``records(file, year)`` and of a ``state`` with counts.

    All files of a component get one split; split sizes in records come as near ``shares`` as whole components allow
    (components of under 1/5000 of all records to within 1/8192 of them). ``state(file, component, split)`` is an
    earlier result: its components keep their split and name, a component that holds files of two splits gets the
    split 'quarantine'. With ``year`` and ``n`` too (see ``split_table``) it stands for the earlier records: ``records`` are
    then new ones only, keys and sizes are of both. Without, ``records`` must hold the earlier ones again. Null files get no row. An empty table gives an empty result.
    """
    shares = shares or SHARES
    links = sitting_links(records, state)
    edges = links.select("file", "key")
    if state is not None:
        edges = edges.union(state.filter("split <> 'quarantine'").select("file", F.concat(F.lit("s"), "component")))
    comp = components(edges, what="sittings")
    sized = links.select("file", "n").join(comp, "file")
    per = sized.groupBy("component").agg(F.sum("n").alias("n"))
    if state is not None:
        kept = comp.join(state.select("file", "split", F.col("component").alias("was")), "file").groupBy("component").agg(F.min("split").alias("a"), F.max("split").alias("b"), F.min("was").alias("was"))
        per = per.join(kept, "component", "left").withColumn("kept", F.when(F.col("a") != F.col("b"), "quarantine").otherwise(F.col("a"))).drop("a", "b")
        per = per.withColumn("was", F.when(F.col("kept") != "quarantine", F.col("was")))
    else:
        per = per.withColumn("kept", F.lit(None).cast("string")).withColumn("was", F.lit(None).cast("string"))
    per = stage(per, "sizes")
    spark = records.sparkSession
    total = per.agg(F.sum("n")).first()[0] or 0
    have = {s: 0 for s in shares} | {r.kept: r.n for r in per.filter("kept is not null and kept <> 'quarantine'").groupBy("kept").agg(F.sum("n").alias("n")).collect()}
    new = per.filter("kept is null")
    large = sorted(((r.n, r.component) for r in new.filter(F.col("n") >= max(total, 1) * LARGE).collect()), key=lambda x: (-x[0], x[1]))
    small = new.filter(F.col("n") < max(total, 1) * LARGE)
    mass = sorted(((r.n, r.b) for r in small.groupBy(_bucket("component").alias("b")).agg(F.sum("n").alias("n")).collect()), key=lambda x: (-x[0], x[1]))

    def fill(items: list[tuple[int, object]]) -> list[tuple[object, str]]:
        out = []
        for n, x in items:
            s = max(shares, key=lambda k: (shares[k] * total - have[k], shares[k]))
            have[s] += n
            out.append((x, s))
        return out

    one = spark.createDataFrame(fill(large), "component string, by_name string")
    many = spark.createDataFrame(fill(mass), "b int, by_bucket string")
    placed = per.join(F.broadcast(one), "component", "left").withColumn("b", F.when(F.col("by_name").isNull(), _bucket("component"))).join(F.broadcast(many), "b", "left")
    placed = placed.select("component", F.coalesce("kept", "by_name", "by_bucket").alias("split"), F.coalesce("was", "component").alias("name"))
    return sized.join(placed, "component").select("file", "n", F.col("name").alias("component"), "split")


def split_table(records: DataFrame, state: DataFrame | None = None, shares: dict[str, float] | None = None) -> DataFrame:
    """(file, year, n, component, split): what ``assign_splits`` needs as ``state`` for the next batch. The years are kept
    with their counts, as the key of a file goes by the year most of all its records give."""
    got = assign_splits(records, state, shares).select("file", "component", "split")
    return year_counts(records, state).join(got, "file").select("file", "year", "n", "component", "split")


def update_splits(records: DataFrame, path: str, shares: dict[str, float] | None = None) -> DataFrame:
    """(file, n, component, split) of all files so far, after ``records``, a batch of new records, is added to the table kept
    in the folder ``path``. Each batch writes a version of its own, which counts once it is whole; a batch given twice is
    counted twice. One batch at a time."""
    spark = records.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [p.getPath().getName() for p in (fs.listStatus(at) if fs.exists(at) else ())]
    done = sorted(v for v in done if re.fullmatch(r"v\d{9}", v) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{v}/_SUCCESS")))
    table = split_table(records, spark.read.parquet(f"{path}/{done[-1]}") if done else None, shares)
    new = f"{path}/v{int(done[-1][1:]) + 1 if done else 1:09d}"
    table.write.mode("overwrite").parquet(new)
    return spark.read.schema(table.schema).parquet(new).groupBy("file", "component", "split").agg(F.sum("n").alias("n")).select("file", "n", "component", "split")


def sitting_pairs(records: DataFrame) -> DataFrame:
    """(file_a, file_b) of different file values of one sitting, by the components of ``assign_splits``."""
    comp = components(sitting_links(records).select("file", "key"), what="sittings")
    a, b = comp.select("component", F.col("file").alias("file_a")), comp.select("component", F.col("file").alias("file_b"))
    return a.join(b, "component").filter("file_a < file_b").select("file_a", "file_b")
