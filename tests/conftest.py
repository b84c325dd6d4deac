"""A local session, and comparison of a query with its SQL."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(REPO))
os.environ["PYTHONPATH"] = f"{REPO}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"  # for Python workers

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _cell(v) -> str:
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v.tolist() if hasattr(v, "tolist") else v)


def rows_of(frame) -> list[tuple[str, ...]]:
    """Rows of a pandas frame as sorted text, columns by name."""
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(_cell(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def same(spark, duck, data):
    """Check a query against its SQL."""

    def check(query, sql: str) -> None:
        got, want = query(spark, data).toPandas(), duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)

    return check
