import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("LODEVEC_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").appName("lodevec-tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(shared)).config("spark.sql.warehouse.dir", str(shared / "warehouse")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    return f"{DATA}/sf0.001"


def compared(frame):
    """Rows of a pandas frame as sorted tuples of strings, columns by name."""
    import pandas as pd

    def shown(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, float):
            return str(int(x)) if x == int(x) else repr(round(x, 6))
        return str(x)

    return sorted(tuple(shown(x) for x in row) for row in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same_as_sql(spark, tiny):
    """Checks a query on the smallest tables against its SQL."""
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(tiny)):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{tiny}/{name}'")

    def check(query, sql):
        got, want = query(spark, tiny).toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert compared(got) == compared(want)

    return check
