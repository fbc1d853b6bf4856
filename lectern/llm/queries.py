"""The pN_ queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import encoding, entity_link, mixing, overlap, scans, sentences, splits, tokens, turns
from lectern.llm.entity_link import register_given, resolver
from lectern.sources.tables import stage, table

LABELS = "speaker_name_hand_labels_w_text20"


def _turns(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    members = table(spark, sf_dir, "members")
    given = register_given(members)
    headers = frozenset(r.header for r in table(spark, sf_dir, "headers").filter("header is not null").collect())  # a fixed list
    records = table(spark, sf_dir, LABELS)
    return turns.turns(records, given, headers, with_text, resolver(members, records, given))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir, False).filter("not inferred").select("file", "first_line", "last_line")


def p1_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir, True)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.repaired(table(spark, sf_dir, LABELS)).select("rec_id").distinct()


def p2_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.repaired(table(spark, sf_dir, LABELS)).select("rec_id", "fixed", "layers", "runs").distinct()


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = register_given(table(spark, sf_dir, "members"))
    return scans.repaired(table(spark, sf_dir, LABELS), given)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).select("rec_id").distinct()


def p3_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sitting_pairs(table(spark, sf_dir, LABELS).select("file", "year"))


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(table(spark, sf_dir, LABELS).select("file", "year"))


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = p4_splits(spark, sf_dir).groupBy("split").agg(F.sum("n").alias("records"), F.countDistinct("component").alias("sittings"))
    return got.withColumn("share", F.round(F.col("records") / F.sum("records").over(Window.partitionBy()), 6))


def _batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all records, first batch, second batch): half of the file values each, so sittings come in both."""
    rows = table(spark, sf_dir, LABELS).select("file", "year")
    late = F.pmod(F.crc32(F.encode("file", "UTF-8")), F.lit(2)) == 1
    return rows, rows.filter(~late), rows.filter(late)


def p4_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split table over two batches: how many files and records it has in the end, how many of the first batch's
    files changed their split or name, and how many sittings are in more than one split."""
    rows, first, second = _batches(spark, sf_dir)
    state = stage(splits.split_table(first), "state")
    got = stage(splits.assign_splits(second, state), "splits")
    old = state.select("file", F.col("component").alias("was"), F.col("split").alias("had")).distinct()
    changed = F.coalesce((F.col("split") != F.col("had")) | (F.col("component") != F.col("was")), F.lit(False)).cast("int")
    per = got.join(old, "file", "left").groupBy("component").agg(F.count("*").alias("files"), F.sum("n").alias("records"), F.sum(changed).alias("changed"), F.countDistinct("split").alias("k"))
    return per.agg(F.sum("files").alias("files"), F.sum("records").alias("records"), F.sum("changed").alias("changed"), F.count(F.when(F.col("k") > 1, 1)).alias("torn"))


def p4_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files are set aside where the state has all files as one sitting, but in more than one split; two made-up
    sittings, each in one split, are left alone."""
    made = spark.createDataFrame([("Vol 901 No. 1", 2001, 5, "a", "train"), ("1st May, 2001P_1", 2001, 7, "a2", "test")], "file string, year int, n long, component string, split string")
    state = stage(splits.split_table(table(spark, sf_dir, LABELS).select("file", "year")), "state").withColumn("year", F.col("year").cast("int"))
    link = state.select("file", "year", "n", F.when(F.col("split") == "train", "train").otherwise("test").alias("split"), F.lit("one").alias("component"))
    torn = made.unionByName(link.select(*made.columns))
    got = splits.assign_splits(spark.createDataFrame([], "file string, year int"), torn)
    return got.filter("split = 'quarantine'").agg(F.count("*").alias("files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_link.link_names(table(spark, sf_dir, LABELS), table(spark, sf_dir, "members"))


def _overlap_input(spark: SparkSession, sf_dir: str):
    given = register_given(table(spark, sf_dir, "members"))
    return table(spark, sf_dir, LABELS), table(spark, sf_dir, "file_splits"), given


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_pairs(*_overlap_input(spark, sf_dir))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(*_overlap_input(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split_sentences(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_turns, p2_found, p2_repair, p3_found, p3_repair, p4_found, p4_splits, p4_shares, p4_incremental, p4_quarantine, p5_found, p6_found, p6_report, p7_ids, p8_mix, p8_shares, p9_found)
}
#: Of the split tables SQL can tell what must hold: nothing is lost, moved or torn; of sittings that are torn all is set aside.
SQL: dict[str, str] = {
    "p4_incremental": f"SELECT count(DISTINCT file) AS files, count(file) AS records, 0 AS changed, 0 AS torn FROM {LABELS}",
    "p4_quarantine": f"SELECT count(DISTINCT file) AS files FROM {LABELS}",
}
