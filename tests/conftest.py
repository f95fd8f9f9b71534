from __future__ import annotations

import glob
import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows_of(frame) -> list[tuple]:
    """Rows as sorted texts by column name; numbers to six digits."""

    def plain(x):
        if x is None or x is pd.NA or x != x:
            return "null"
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x)).lower()
        if isinstance(x, (int, float)) or hasattr(x, "dtype"):
            return f"{float(x) + 0.0:.6f}"
        return str(x)

    columns = sorted(frame.columns)
    return sorted(tuple(plain(x) for x in row) for row in frame[columns].itertuples(index=False))
