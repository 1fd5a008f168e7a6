import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """Runs SQL in DuckDB over the tables of DATA."""
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(DATA).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows_of(frame):
    """Rows as sorted text, columns by name; pandas' whole floats count as integers."""
    names = sorted(frame.columns)

    def cell(x):
        if x is None or str(x) in ("NaT", "<NA>", "nan"):
            return "null"
        return str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)

    return names, sorted(tuple(map(cell, r)) for r in frame[names].astype(object).itertuples(index=False))
