"""Every registered query runs; those with SQL give the rows that DuckDB gives."""

import datetime
import decimal
import math

import duckdb
import pytest

import surveil.plans  # noqa: F401
from surveil.plans import registry

from conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal | int | float):
        return "nan" if math.isnan(float(v)) else f"{float(v):.8g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in registry.SQL:
        r = duck.execute(registry.SQL[name])
        named = [x[0] for x in r.description]
        assert sorted(named) == cols
        want = sorted(tuple(plain(x[named.index(c)]) for c in cols) for x in r.fetchall())
        assert got == want
    else:
        assert got or name == "cluster_density"  # the small tables hold no dense cluster


@pytest.mark.parametrize("name", ["win_roll_z", "win_shift_z"])
def test_small_negative_values_keep_their_sign(spark, tmp_path, name):
    """A z-score just below zero is -0.0 after rounding, as in SQL."""
    values = [1000.0, 3000.0, 1999.999]
    rows = [(k, datetime.datetime(2024, 1, 1 + k), 7, "click", v, None) for k, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = {str(d): z for d, z in con.execute(f"select d, z from ({registry.SQL[name]})").fetchall()}
    got = {str(r.d): r.z for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert {d: repr(z) for d, z in got.items()} == {d: repr(z) for d, z in want.items()}
    assert repr(got["2024-01-03"]) == "-0.0"


def test_redaction_folds_letters_as_its_sql(spark, tmp_path):
    """The long s and the Kelvin sign are letters of either case, a dotted or dotless i is none of i; word bounds are those of ASCII."""
    texts = ["ACCORDING TO \u0131rma Olsen", "According to Mary Olsen\u0130", "according to Anna Jo\u017ft1", "12 Oa\u212a \u017ft.", "4 \u017feptember 5, 2024", "a\u017fep 5, 2024"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("redact_pii", "redact_stats"):
        df = registry.QUERIES[name](spark, str(tmp_path))
        want = sorted(con.execute(f"select {', '.join(df.columns)} from ({registry.SQL[name]})").fetchall())
        assert sorted(tuple(r) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["win_roll_z", "win_shift_z"])
def test_days_of_equal_values_have_no_spread(spark, tmp_path, name):
    """Three days of the same values, whose rows lie in another order each: sums are those of the order of events, so that z is null while days are equal."""
    values = [0.1, 0.2, 0.3]
    rows = [(3 * k + i, datetime.datetime(2024, 1, 1 + k, i), 7, "click", v, None) for k in range(3) for i, v in enumerate(values)] + [(9, datetime.datetime(2024, 1, 4), 7, "click", 0.7, None)]
    rows = [rows[i] for i in (0, 1, 2, 5, 4, 3, 8, 6, 7, 9)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"create table events as select * from '{tmp_path}/events.parquet/*.parquet' order by event_id")
    want = {str(d): z for d, z in con.execute(f"select d, z from ({registry.SQL[name]})").fetchall()}
    got = {str(r.d): r.z for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == want
    assert got["2024-01-02"] is None and got["2024-01-03"] is None


def test_hybrid_ranking_takes_every_item(spark):
    """Each item of the benchmark is a query, whatever its id."""
    items = {r.item_id for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    assert {r["query"] for r in registry.QUERIES["rank_hybrid"](spark, DATA).collect()} == items
