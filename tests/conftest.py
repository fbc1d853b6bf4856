import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def members(spark):
    rows = [
        (1, "Oliver Sintor Wernochum", "Mr.", "Bamchaza", 1991), (2, "Dorothy Jumbar Nenalre", "Dr.", "Sakolbo", 1970), (3, "Daniel Fumbel Kimdeshur", "Mr.", "Pufukum", 1980),
        (4, "Vincent Mumbor Kimdeshur", "Capt.", "Nogolyir", 1985), (5, "Katherine Mumbor Mwewebul", "Dr.", "Girnulol", 1988), (6, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "member_id int, full_name string, honorific string, constituency string, first_year int")
