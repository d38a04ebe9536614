from __future__ import annotations

import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from holdfast.functions import order  # noqa: E402
from holdfast.session import build_session, release  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def _free():
    yield
    release()


@pytest.fixture(params=["one bucket", "many buckets"])
def both_ways(request, monkeypatch):
    """Run a test with all rows in one bucket of the order and with many buckets."""
    if request.param == "many buckets":
        monkeypatch.setattr(order, "BUCKET_ROWS", 40)
        monkeypatch.setattr(order, "BROADCAST_ROWS", 0)
    yield request.param


def frame(spark, rows, schema):
    return spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(",")]), schema)


@pytest.fixture(scope="session")
def seeded_tx(spark):
    """240 users over 300 days: even ids pay often up to the last day, odd ids rarely and not in the last 80."""
    users = spark.range(240).select(
        (F.col("id") + 1).alias("u"), F.when(F.col("id") % 2 == 1, F.lit(24)).otherwise(F.lit(5)).alias("most")
    )
    rows = users.select("u", "most", F.explode(F.sequence(F.lit(1), F.col("most"))).alias("k"))

    def turn(salt: int, size):
        return F.pmod(F.xxhash64("u", "k", F.lit(salt)), size)

    day = F.when(F.col("most") > 5, turn(1, F.lit(300))).otherwise(turn(1, F.lit(220)))
    kinds = F.array(*[F.lit(k) for k in ("groceries", "rent", "fuel", "books", "travel")])
    return rows.select(
        F.col("u").cast("string").alias("user_id"),
        F.timestamp_add("DAY", day.cast("int"), F.lit("2024-02-01").cast("timestamp")).alias("timestamp"),
        (F.lit(8.0) + turn(2, F.lit(300_000)) / 100).alias("amount"),
        kinds[turn(3, F.lit(5)).cast("int")].alias("description"),
    ).cache()
