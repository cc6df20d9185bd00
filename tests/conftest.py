"""One session for all tests, and the repository on the path of driver and workers."""

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(base / "checkpoints"))
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def same_rows(spark_df, sql, sf_dir):
    """Compare a query's rows with those of its DuckDB SQL over the same tables."""
    import duckdb

    con = duckdb.connect()
    for file in Path(sf_dir).iterdir():
        where = f"{file}/*.parquet" if file.is_dir() else str(file)
        con.execute(f"create view {file.name.split('.')[0]} as select * from '{where}'")
    names = sorted(spark_df.columns)
    key = lambda row: tuple("" if v is None else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row)
    mine = sorted(key([r[n] for n in names]) for r in spark_df.collect())
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    other = sorted(key([r[columns.index(n)] for n in names]) for r in result.fetchall())
    assert mine == other
