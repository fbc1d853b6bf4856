"""Transcripts, labels, metadata and predictions from files, and results to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import base64_text, decode_bytes, filetype

LINE_LABELS = "folder int, file string, line int, label string, notes string, coder string, _id long, text string"
SPAN_LABELS = "year int, file string, line int, start int, end int, notes string, text string"
FILE_META = "type string, id string, file_version struct<type:string,id:string,sha1:string>, sequence_id string, etag string, sha1 string, name string, folder struct<type:string,id:string,sequence_id:string,etag:string,name:string>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, filetype, text) of whole txt files, UTF-8 or else Windows-1252; other types are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", filetype(F.col("path")).alias("filetype"), decode_bytes(F.col("content")).alias("text")).filter("filetype = 'txt'")


def read_pdf(spark: SparkSession, path: str, page_sep: str = "\n\n") -> DataFrame:
    """(path, text) of pdf files: page texts stripped and joined. Needs the optional library pypdf on the executors."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise NotImplementedError("reading pdf files needs pypdf") from e

    def run(it):
        import io

        import pypdf

        for b in it:
            b["text"] = [page_sep.join((p.extract_text() or "").strip() for p in pypdf.PdfReader(io.BytesIO(c)).pages) for c in b["content"]]
            yield b[["path", "text"]]

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", "content").mapInPandas(run, "path string, text string")


def read_labels(spark: SparkSession, path: str, spans: bool = False) -> DataFrame:
    """Hand labels from CSV: of line types (UTF-8), or of speaker spans (Latin-1, NA for null, quoted line ends)."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return r.option("encoding", "ISO-8859-1").option("nullValue", "NA").schema(SPAN_LABELS).csv(path) if spans else r.schema(LINE_LABELS).csv(path)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_META).option("multiLine", True).json(path)


def file_list(meta: DataFrame, folders: list[str] | None = None) -> DataFrame:
    """(folder, file, _id) of file metadata: the latest version of each object, the name without .txt."""
    m = meta.filter("type is null or type = 'file'")
    if folders is not None:
        m = m.filter(F.col("folder.name").isin(folders))
    latest = m.groupBy("id").agg(F.max_by(F.struct("name", "folder"), F.col("sequence_id").cast("long")).alias("m"))
    return latest.select(F.col("m.folder.name").alias("folder"), F.regexp_replace("m.name", r"\.txt\z", "").alias("file"), F.expr("try_cast(id as long)").alias("_id"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(file, batch, prediction) of line-delimited JSON: of several results of a batch, the last without an error."""
    raw = spark.read.schema("batch int, error string, outputs array<array<array<string>>>").json(path).withColumn("file", F.input_file_name()).withColumn("_i", F.monotonically_increasing_id())
    ok = raw.filter("error is null")
    return ok.groupBy("file", "batch").agg(F.max_by(F.col("outputs")[0][0][0], "_i").alias("prediction"))


def instance_base64(text, context):
    """An instance as base64 of its JSON."""
    return base64_text(F.to_json(F.struct(text.alias("inputs"), context.alias("context"))))


def write_splits(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """One folder for each value of split."""
    df.write.mode("overwrite").option("header", True).partitionBy("split").format(fmt).save(path)


def write_shards(df: DataFrame, path: str, shards: int) -> None:
    """Parquet in so many files."""
    df.repartition(shards).write.mode("overwrite").parquet(path)


def write_training_shards(df: DataFrame, path: str, train: int = 9, evaluation: int = 1, keys: list[str] | None = None, seed: int = 0) -> None:
    """Parquet under train/ and eval/ of ``path``: a hash of ``keys`` (by default of the whole row) gives each
    folder its part of the rows, in as many files."""
    n = train + evaluation
    rows = df.withColumn("_shard", F.pmod(F.xxhash64(*(keys or df.columns), F.lit(seed)), F.lit(n)).cast("int"))
    rows.filter(F.col("_shard") < train).drop("_shard").repartition(train).write.mode("overwrite").parquet(f"{path}/train")
    rows.filter(F.col("_shard") >= train).drop("_shard").repartition(evaluation).write.mode("overwrite").parquet(f"{path}/eval")


def vocabulary_texts(columns: list[tuple[DataFrame, str]], limit: int | None = None) -> DataFrame:
    """(text) of all columns of texts one after another, for building a vocabulary; ``limit`` caps their number if given.
    Nulls are left out."""
    out = None
    for df, c in columns:
        part = df.select(F.col(c).cast("string").alias("text")).filter("text is not null")
        out = part if out is None else out.unionAll(part)
    return out if limit is None else out.limit(limit)


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """(text, context) of line-delimited JSON instances: each a string, or an object with inputs and context; a missing
    context is empty, anything else gives nulls."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    plain = F.from_json(F.concat(F.lit('{"x":'), "value", F.lit("}")), "x string")["x"]
    both = F.from_json("value", "inputs string, context string")
    quoted = F.ltrim(F.col("value")).startswith('"')
    return raw.select(F.when(quoted, plain).otherwise(both["inputs"]).alias("text"), F.when(quoted, "").otherwise(F.coalesce(both["context"], F.when(both["inputs"].isNotNull(), F.lit("")))).alias("context"))


def write_json(results: DataFrame, path: str) -> None:
    """A line of JSON for each document."""
    results.select(F.col("result").alias("value")).write.mode("overwrite").text(path)
