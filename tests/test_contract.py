"""The driver contract: every query runs on the smallest tables and every twin has its columns."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SLOW = {"m05_holdout_report", "m06_importances", "m08_scored_batch", "m09_hold_risk", "m15_feature_effects"}


def test_every_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["g05_tracks", "g21_irregularities", "a01_congestion", "f08_backtest", "h01_psi", "j05_prediction_errors",
                                  "m13_gate", "p01_silver", "s07_thinned", "t05_grounding", "t12_endpoint_summary", "r08_stateful_tracks"])
def test_twins_agree_on_the_smallest_tables(spark, sf_dir, name):
    from tools.check import rows_of
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    df = entry.queries()[name](spark, sf_dir)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())
