import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.checkpoint.dir", str(folder / "checkpoint"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(f"{TESTDATA}/sf0.001"):
        pytest.skip("no test tables")
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def rows_of(frame):
    """Rows of a pandas frame, columns in order of name, comparable and in order."""
    import math

    def plain(value):
        if value is None or value != value:
            return None
        value = value.item() if hasattr(value, "item") else value
        if isinstance(value, float):
            return int(value) if math.isfinite(value) and value == int(value) else round(value, 6)
        return value if isinstance(value, (int, str, bool)) else str(value)

    return sorted((tuple(plain(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)
