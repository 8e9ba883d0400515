"""Every query of the catalogue against its SQL at the smallest size."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quillspan.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def shown(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(shown, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLE_SQL:
        want = duck.sql(catalogue.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    out = catalogue.flagship(spark, SF)
    assert out.columns == ["s_suppkey", "decision", "answer_text", "fact_id", "evidence_sha256"]
    assert {r.decision for r in out.collect()} == {"answered"}


def test_absence_of_many_event_types(spark, tmp_path):
    """More than a hundred event types: each user is asked about each."""
    events = pd.DataFrame({"event_id": range(260), "ts": pd.Timestamp("2024-01-01"), "user_id": [k % 3 + 1 for k in range(260)], "event_type": [f"kind{k % 130:03}" for k in range(260)], "value": 60.0, "props": "{}"})
    events["ts"] = events["ts"].astype("datetime64[us]")
    events.to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(catalogue.ORACLE_SQL["absence_not_negative"]).df()
    got = catalogue.QUERIES["absence_not_negative"](spark, str(tmp_path)).toPandas()
    assert len(want) == 3 * 130 - 260 and rows(got) == rows(want)
