"""Reading the test tables and the folder for intermediate results."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, unless they find it on their path as the driver does."""
    app = spark.sparkContext.applicationId
    paths = [os.path.abspath(p) for p in (os.environ.get("PYTHONPATH") or "").split(os.pathsep) if p]
    here = spark.sparkContext.master.startswith("local[") and os.getcwd() == _ROOT  # workers then start in the same folder
    if app in _shipped or _ROOT in paths or here:
        return
    d = tempfile.mkdtemp()  # the driver's copy, which Spark itself hands to the executors
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(d, "lectern"), "zip", _ROOT, "lectern"))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``; columns are pruned by what is selected from it."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Where that is unset: a folder of this machine if the
    session runs on it alone, else an error, as executors would write to disks of their own."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not got:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        got = "file://" + os.path.join(tempfile.gettempdir(), f"lectern-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", got)
    return got


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives lost executors. The files go when
    the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{what}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
