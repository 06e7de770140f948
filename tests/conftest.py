import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(Path(data).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


@pytest.fixture(scope="session")
def same_rows():
    """Rows of a table as a sorted list, columns by name, whole numbers and nulls alike whatever holds them."""

    def plain(x):
        if x is None:
            return None
        if hasattr(x, "isoformat"):
            return x.isoformat()
        if isinstance(x, bool) or isinstance(x, (str, bytes)):
            return x
        if isinstance(x, float):
            return None if x != x else round(x, 9) + 0.0
        return float(x) if isinstance(x, int) else str(x)

    def rows(names, table):
        order = sorted(range(len(names)), key=lambda k: names[k])
        return [sorted(names)] + sorted(([plain(r[k]) for k in order] for r in table), key=repr)

    return rows
