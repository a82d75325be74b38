"""One local session for all tests, and the comparison with an independent SQL engine."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

DATA = Path(os.environ.get("SETPHRASE_TESTDATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    made = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


def plain(x):
    """A value as something that can be compared and hashed."""
    if isinstance(x, float):
        return None if x != x else round(x, 6) + 0.0
    if isinstance(x, decimal.Decimal):
        return plain(float(x))
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return bytes(x) if isinstance(x, bytearray) else x


def rows_of(names, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def sql_rows(sql: str, folder: Path = DATA) -> tuple[list[str], Counter]:
    import duckdb

    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        at = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"create view {path.name.removesuffix('.parquet')} as select * from read_parquet('{at}')")
    found = con.execute(sql)
    return rows_of([c[0] for c in found.description], found.fetchall())


def assert_same(df, sql: str, folder: Path = DATA) -> None:
    own = rows_of(df.columns, [tuple(r) for r in df.collect()])
    names, rows = sql_rows(sql, folder)
    assert own[0] == names
    gone, more = rows - own[1], own[1] - rows
    assert not gone and not more, f"{sum(gone.values())} rows missing, {sum(more.values())} too many; {list(gone)[:3]} / {list(more)[:3]}"


@pytest.fixture(scope="session")
def data() -> Path:
    if not DATA.exists():
        pytest.skip("no test tables")
    return DATA
