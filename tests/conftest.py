import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        configured = s.sparkContext.getConf().get("spark.checkpoint.dir", None)
        s.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="basketry-test-"))
    yield s


LINE_SCHEMA = ("order_id long, user_id long, order_number int, product_id long, "
               "days_since_prior_order double, reordered int, add_to_cart_order int, order_dow int")


@pytest.fixture
def lines(spark):
    """Build a tiny line table from (user, order_number, product) triples."""
    def make(rows):
        data = []
        for i, (u, n, p) in enumerate(rows):
            data.append((u * 1000 + n, u, n, p, 0.0 if n == 1 else 7.0, 0, 1, n % 7))
        return spark.createDataFrame(data, LINE_SCHEMA)
    return make
