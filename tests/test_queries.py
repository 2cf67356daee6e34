"""Every query with SQL against DuckDB on the smallest tables; the others must give rows."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxweave import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def canon(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NA or v != v:
            return None
        if hasattr(v, "dtype") and v.dtype.kind == "f" or isinstance(v, float):
            return round(float(v), 5)
        return int(v) if hasattr(v, "__index__") else str(v)

    return sorted(repr([one(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_gives_rows(spark, name):
    """Values of these are held against plain loops in the other test modules."""
    found = queries.QUERIES[name](spark, SF).toPandas()
    assert len(found.columns) and (len(found) or name in MAY_BE_EMPTY)


@pytest.fixture
def against_sql(spark, tmp_path):
    """Holds a query against its SQL on events (event_id, ts in seconds, user_id, event_type)."""

    def run(name, rows):
        table = pd.DataFrame([(i, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s), u, t, float(i % 7), "{}") for i, s, u, t in rows], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
        table.astype({"event_id": "Int64", "ts": "datetime64[us]", "user_id": "Int64"}).to_parquet(tmp_path / "events.parquet")
        con = duckdb.connect()
        con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
        got, want = queries.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(queries.ORACLES[name]).df()
        assert canon(got.convert_dtypes()) == canon(want.convert_dtypes()) and len(want)
        return got

    return run


def test_mua_to_peak_has_no_row_for_units_without_an_interval(against_sql):
    """All intervals of 'b' are shorter than the histogram's first bin, as in dense tables; 'c' has one event; null is a unit."""
    rows = [(k, 100 * k, 1, "a") for k in range(20)] + [(100 + k, 2 * k, 1, "b") for k in range(20)] + [(200, 7, 1, "c")] + [(300 + k, 400 * k, 1, None) for k in range(5)]
    assert set(against_sql("fraction_mua_to_peak", rows)["unit"].fillna("-")) == {"a", "-"}


def test_unit_chains_over_many_segments(against_sql):
    """300 segments: a user in all of them, one with gaps, events without a user."""
    rows = [(1000 * k, k, 1, "a") for k in range(300)] + [(1000 * k + 1, k, 2, "a") for k in range(300) if k % 7] + [(1000 * k + 2, k, None, "a") for k in range(3)]
    assert len(against_sql("unit_chains", rows)) == 300 + 257 + 3


MAY_BE_EMPTY = {"redundant_units", "overlap_links", "useful_noise_templates"}


def test_redundant_units_judges_users_of_every_id(spark, tmp_path):
    """The ids are names: with all of them moved (by a multiple of 11, which keeps who has no mua) the same users go."""
    found = []
    for k, move in enumerate((0, 99)):
        rows = [(i, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i // 4 % 30), i % 4 + 1 + move, "view", float(i * 7 % 50), "{}") for i in range(200)]
        pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / f"events{k}.parquet")
        (tmp_path / str(k)).mkdir()
        (tmp_path / f"events{k}.parquet").rename(tmp_path / str(k) / "events.parquet")
        found.append(sorted(r["unit"] - move for r in queries.QUERIES["redundant_units"](spark, str(tmp_path / str(k))).collect()))
    assert found[0] and found[0] == found[1]


def test_redundant_units_needs_no_table_of_pairs(spark, tmp_path, monkeypatch):
    """Pairs beyond chance grow with the square of the users, 324 million at 90,000; each that is settled takes a user."""
    from fluxweave.operators import postprocess, units

    rng = np.random.default_rng(6)
    rows = [(i, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=int(rng.integers(0, 20_000))), int(rng.integers(0, 80)), "view", float(rng.integers(0, 50)), "{}") for i in range(3_000)]
    pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    e = queries.views.train(spark, str(tmp_path), "user_id").select(F.lit(0).alias("seg"), F.col("unit").cast("int").alias("channel"), "unit", F.col("idx").alias("sample"))
    quality = queries._units(spark, str(tmp_path)).select(F.lit(0).alias("seg"), F.col("unit").cast("int").alias("channel"), "unit", "mua", "snr", "n")
    want = sorted(r.unit for r in postprocess.redundant_by_segment(e, quality, postprocess.coincidences(e, 3600, limit=0.5), 0.5).collect())

    def refuse(*_, **__):
        raise AssertionError("a table of pairs")

    monkeypatch.setattr(postprocess, "coincidences", refuse)
    monkeypatch.setattr(units, "drop_redundant", refuse)
    assert want and sorted(r.unit for r in queries.QUERIES["redundant_units"](spark, str(tmp_path)).collect()) == want
