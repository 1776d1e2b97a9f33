"""Tables that are kept up to date: passages, sketches, folds; and the views as SQL functions."""

import random

import numpy as np
import pytest
from helpers import collected
from pyspark.sql import functions as F

from glidepath.operators import learn, passages, sketches
from glidepath.plans import sqlfunctions, views
from glidepath.session import fresh_path
from glidepath.sources.catalog import Catalog

WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen"


def docs(spark, rows):
    return spark.createDataFrame(rows, "name string, text string")


def test_passages_follow_their_documents(spark):
    cat = Catalog(spark, fresh_path(spark, "index"))
    first = [("a", WORDS + " a"), ("b", WORDS + " b"), ("c", WORDS + " c"), ("n", None)]
    assert collected(passages.update_index(cat, docs(spark, first), 1), "name", "action") == [(n, "insert") for n in "abcn"]
    second = [("a", WORDS + " a"), ("b", WORDS + " changed"), ("d", WORDS + " d"), ("n", "")]
    got = collected(passages.update_index(cat, docs(spark, second), 2), "name", "action", "load")
    assert got == [("a", "keep", 1), ("b", "replace", 1), ("c", "delete", 1), ("d", "insert", None), ("n", "keep", 1)]
    want = [("a", 1, WORDS + " a"), ("b", 2, WORDS + " changed"), ("d", 2, WORDS + " d")]
    assert collected(passages.current_passages(cat), "name", "load", "text") == want
    assert collected(passages.embed_inputs(cat, 2), "name", "input") == [("b", f"b\n{WORDS} changed"), ("d", f"d\n{WORDS} d")]
    passages.update_index(cat, docs(spark, second), 2)  # the same load again
    assert collected(passages.current_passages(cat), "name", "load", "text") == want
    passages.update_index(cat, docs(spark, []), 3)
    assert passages.current_passages(cat).count() == 0


def test_sketches_merge_over_days(spark):
    rng = np.random.default_rng(5)
    rows = [(d, float(v) if v > -20 else None, float("nan") if i % 50 == 0 else float(i % 7), f"k{i % (300 + d)}")
            for d in range(4) for i, v in enumerate(rng.normal(d, 10, 5000))]
    df = spark.createDataFrame(rows, "d int, v double, w double, k string").withColumn("ts", F.timestamp_seconds(F.col("d") * 86400))
    cat = Catalog(spark, fresh_path(spark, "sketches"))
    sketches.keep_sketches(cat, "s", df.where("d < 3"), "ts", ["v", "w"], ["k"])
    sketches.keep_sketches(cat, "s", df.where("d >= 2"), "ts", ["v", "w"], ["k"])  # a day twice
    table = spark.read.parquet(cat.path("s"))
    assert table.count() == 4 * 3
    merged = sketches.over_days(table, "1970-01-02", "1970-01-04")
    got = {r["field_name"]: r for r in sketches.coverage(merged).collect()}
    for name, at in (("v", 1), ("w", 2)):
        exact = np.array([r[at] for r in rows if r[0] >= 1 and r[at] is not None and r[at] == r[at]])
        r = got[name]
        assert (r["non_null_count"], r["min_val"], r["max_val"]) == (len(exact), exact.min(), exact.max())
        below, upto = (exact < r["median_val"]).mean(), (exact <= r["median_val"]).mean()
        assert below - sketches.RANK_ERROR <= 0.5 <= upto + sketches.RANK_ERROR
    assert got["k"]["non_null_count"] == 15000 and abs(got["k"]["distinct_values"] - 303) <= 303 * sketches.DISTINCT_ERROR + 1


def test_drift_by_sketches(spark):
    rng = np.random.default_rng(6)
    rows = [(0, float(v), 3.0) for v in rng.normal(0, 1, 8000)] + [(1, float(v), 3.0) for v in rng.normal(0.5, 1, 8000)]
    df = spark.createDataFrame(rows, "d int, v double, c double").withColumn("ts", F.timestamp_seconds(F.col("d") * 86400))
    table = sketches.day_sketches(df, "ts", ["v", "c"], [])
    got = {r["feature"]: r for r in sketches.drift(sketches.over_days(table, "1970-01-01", "1970-01-01"), sketches.over_days(table, "1970-01-02", "1970-01-02")).collect()}
    from glidepath.operators.health import psi
    exact = {r["feature"]: r["psi"] for r in psi(df.where("d = 0"), df.where("d = 1"), ["v", "c"]).collect()}
    assert abs(got["v"]["psi"] - exact["v"]) < 0.02 and got["v"]["severity"] in ("moderate", "significant")
    assert got["c"]["psi"] == pytest.approx(exact["c"]) == 0


@pytest.mark.parametrize("bucket", [50_000, 20])
def test_folds_hold_whole_groups_and_share_classes(spark, bucket):
    rng = random.Random(2)
    rows = [(f"s{g}", int(g % 9 == 0 and i == 0)) for g in range(203) for i in range(rng.randrange(1, 30))]
    df = spark.createDataFrame(rows, "seg_id string, is_held int")
    got = learn.balanced_folds(df, 5, bucket=bucket).collect()
    assert len(got) == 203 == len({r["seg_id"] for r in got})
    for positive in (0, 1):
        sizes = [sum(r["fold"] == f and r["positive"] == positive for r in got) for f in range(5)]
        assert max(sizes) - min(sizes) <= (1 if bucket > 203 else 11), sizes
    if bucket > 203:
        held = [sum(r["n"] for r in got if r["fold"] == f) for f in range(5)]
        assert max(held) - min(held) < 0.1 * len(rows)


def test_views_are_sql_functions(spark):
    preds = spark.createDataFrame([("D1 ", "a1", 5.0, 0, 1), ("", "b2", 4.0, 60, 1), ("OLD", "c3", 1.0, 0, 0)],
                                  "callsign string, icao string, predicted_eta_min double, s int, run int").select(
        "*", F.lit("B738").alias("ac_type"), F.timestamp_seconds("run").alias("scored_at"), F.timestamp_seconds("s").alias("predicted_touchdown_ts"),
        F.lit(3.06).alias("dist_to_apt_nm"), F.lit(1).alias("model_version"), F.lit(900).alias("alt_ft"), F.lit(120.5).alias("gs_kt"), F.lit(-7.5).alias("vrate_fpm"), F.lit("descent").alias("phase"))
    names = sqlfunctions.register(spark, {"predictions": preds}, "t")
    assert names == ["t_arrival_picture", "t_next_arrivals", "t_aircraft"]
    for text, want in (("t_arrival_picture()", views.arrival_picture(preds)), ("t_next_arrivals(1)", views.next_arrivals(preds, 1)), ("t_next_arrivals(-5)", views.next_arrivals(preds, -5)),
                       ("t_next_arrivals(99)", views.next_arrivals(preds, 99)), ("t_next_arrivals()", views.next_arrivals(preds, 10)), ("t_aircraft('B2')", views.aircraft(preds, "B2")),
                       ("t_aircraft(' d1')", views.aircraft(preds, " d1")), ("t_aircraft('nobody')", views.aircraft(preds, "nobody"))):
        got = spark.sql(f"SELECT * FROM {text}")
        assert got.columns == want.columns and [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()], text
    assert spark.sql("SELECT * FROM t_next_arrivals(2) n JOIN t_aircraft('a1') a ON a.callsign = n.callsign").count() == 1
    sqlfunctions.register(spark, {"predictions": preds.where("run > 9")}, "t")
    assert spark.sql("SELECT * FROM t_arrival_picture()").count() == 0
    with pytest.raises(ValueError):
        sqlfunctions.register(spark, {"other": preds})
