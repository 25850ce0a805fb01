import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").config("spark.log.level", "ERROR").getOrCreate()
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def comparable(df):
    """Rows as sorted tuples of plain values, by column name."""

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return round(float(v), 9)
        return str(v)

    columns = sorted(df.columns)
    return columns, sorted((tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False)), key=repr)
