import random
from datetime import datetime, timezone

import pytest
from helpers import EPOCH, collected, silver
from pyspark.sql import functions as F

from glidepath import testdata
from glidepath.operators import slices
from glidepath.operators.tracks import carried_on, enrich_tracks, incremental_tracks, open_segments, point_features, segment
from glidepath.session import fresh_path
from glidepath.sources.catalog import Catalog


@pytest.mark.parametrize("gap,breaks", [(0.5, True), (1, False), (180, False), (180.9, False), (181, True)])
def test_segment_breaks_by_whole_seconds(spark, gap, breaks):
    df = segment(silver(spark, [{"t": 100}, {"t": 100 + gap}]).select("icao", "snapshot_ts"))
    flags = collected(df, "seg_break", order=["snapshot_ts"])
    assert flags == [(1,), (1 if breaks else 0,)]


def test_segment_id_from_key_and_start(spark):
    df = segment(silver(spark, [{"t": 0}, {"t": 60}, {"t": 500}]).select("icao", "snapshot_ts"))
    ids = [r[0] for r in collected(df, "seg_id", order=["snapshot_ts"])]
    assert ids == [f"a1-{EPOCH * 1000}"] * 2 + [f"a1-{(EPOCH + 500) * 1000}"]


def plain_segments(times, max_gap=180):
    """Segments by a plain loop: {time: (start, count, end)}."""
    groups = []
    for t in sorted(times):
        if groups and 1 <= t - groups[-1][-1] <= max_gap:
            groups[-1].append(t)
        else:
            groups.append([t])
    return {t: (g[0], len(g), g[-1]) for g in groups for t in g}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_segments_across_slices_match_a_loop(spark, seed):
    rng = random.Random(seed)
    times, t = {"a": [], "b": [], "c": list(range(0, 9000, 150))}, 0
    for key in "ab":
        t = 0
        for _ in range(120):
            t += rng.choice([15, 60, 179, 180, 181, 400, 700, 2500])
            times[key].append(t)
    df = spark.createDataFrame([(k, EPOCH + s) for k, v in times.items() for s in v], "icao string, s bigint").select(
        "icao", F.timestamp_seconds("s").alias("snapshot_ts"))
    want = {(k, t): v for k, ts in times.items() for t, v in plain_segments(ts).items()}
    for slice_s in (540, 600, 3600, 21600):
        got = segment(df, slice_s=slice_s).select(
            "icao", (F.unix_seconds("snapshot_ts") - EPOCH).alias("t"), (F.unix_seconds("seg_start_ts") - EPOCH).alias("a"),
            "seg_n_reports", (F.unix_seconds("seg_end_ts") - EPOCH).alias("b")).collect()
        assert len(got) == len(want)
        assert {(r.icao, r.t): (r.a, r.seg_n_reports, r.b) for r in got} == want


def moved(df):
    """The columns of each shuffle of the plan that runs."""
    import re
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [set(re.findall(r"(\w+)#", block)) for block in re.findall(r"Exchange hashpartitioning[^\n]*\n[^\n]*?Project \[([^\n]*)\]", plan)]


def test_point_features_are_made_behind_the_shuffle(spark, sf_dir):
    """The same tracks, of reports with a null time and a null key as well, without moving what each report tells by itself."""
    reports = testdata.reports(spark, sf_dir + testdata.DENSE)
    odd = reports.limit(1)
    reports = reports.unionByName(odd.withColumn("snapshot_ts", F.lit(None).cast("timestamp"))).unionByName(odd.withColumn("icao", F.lit(None).cast("string")))
    before = enrich_tracks(point_features(reports))
    for made in (enrich_tracks(reports, features=point_features), enrich_tracks(reports, features=point_features, by_day=True).drop("dt")):
        assert collected(made, *before.columns) == collected(before, *before.columns)
        full = [c for c in moved(made) if "lat" in c]
        assert full and not any({"dist_to_apt_nm", "bearing_to_apt", "heading_err_deg", "phase"} & c for c in full)


def test_tracks_by_day_are_written_where_they_are(spark, sf_dir):
    """Day folders with the rows of a rebuild, sorted in each file by aircraft and time, without dealing or sorting the rows once more."""
    cat = Catalog(spark, fresh_path(spark, "by-day"))
    rows = testdata.tracks_by_day(spark, sf_dir + testdata.DENSE)
    cat.replace("dealt", rows, dealt=True, time_col="snapshot_ts")
    cat.replace("again", testdata.tracks(spark, sf_dir + testdata.DENSE), "snapshot_ts", ["icao", "snapshot_ts"])
    assert cat.days("dealt") == cat.days("again") and cat.read("dealt").schema == cat.read("again").schema
    both = [cat._days(t).groupBy("dt").agg(F.count(F.lit(1)), F.sum(F.xxhash64(*cat.read(t).columns).cast("decimal(38,0)"))).collect() for t in ("dealt", "again")]
    assert sorted(both[0]) == sorted(both[1]) and len(both[0]) == 3
    for file in cat._days("dealt").inputFiles():
        at = [tuple(r) for r in spark.read.parquet(file).select("icao", "snapshot_ts").coalesce(1).collect()]
        assert at == sorted(at)
    sorted_by_day = rows.sortWithinPartitions("dt")
    assert sorted_by_day._jdf.queryExecution().executedPlan().toString().count("Sort [dt#") == 0


def test_tracks_do_not_depend_on_the_slice(spark, sf_dir):
    reports = testdata.positions(spark, sf_dir)
    columns = ["icao", "snapshot_ts", "seg_id", "dt_s", "closure_kt", "turn_deg", "vrate_fpm", "inbound_flag", "seg_n_reports", "seg_end_ts"]
    wide = collected(enrich_tracks(reports, slice_s=86400), *columns)
    assert collected(enrich_tracks(reports.repartition(7), slice_s=600), *columns) == wide


def test_incremental_equals_full(spark, sf_dir):
    reports = testdata.positions(spark, sf_dir)
    cutoff = "2024-01-01 01:30:00"
    full = enrich_tracks(reports).where(F.col("snapshot_ts") >= F.lit(cutoff).cast("timestamp"))
    register = open_segments(reports, cutoff)
    part = incremental_tracks(reports, cutoff, register)
    assert collected(part, *full.columns) == collected(full, *full.columns)
    # one report is all that is left of a long segment, and slices are short
    assert collected(incremental_tracks(reports, cutoff, register, slice_s=1200), *full.columns) == collected(full, *full.columns)


def test_loads_carry_segments_on(spark):
    rng = random.Random(3)
    rows, times = [], {}
    for key in "abcdef":
        t = 0
        for _ in range(60):
            t += rng.choice([10, 40, 100, 179, 180, 181, 400, 700])
            rows.append({"icao": key, "t": t, "dist_to_apt_nm": float(rng.randrange(5, 40)), "track_deg": float(rng.randrange(360)),
                         "alt_ft": rng.choice([None, 3000, 3500]), "vertical_rate_fpm": None, "vertical_rate_src": None})
            times[key] = t
    reports = silver(spark, rows).cache()
    columns = ["icao", "snapshot_ts", "seg_id", "dt_s", "closure_kt", "turn_deg", "vrate_fpm", "inbound_flag"]
    last = max(times.values()) + 1
    cuts = [0, 50, 300, 301, 900, 2000, 2100, 5000, last]
    at = [datetime.fromtimestamp(EPOCH + c, timezone.utc).strftime("%Y-%m-%d %H:%M:%S") for c in cuts]
    register = open_segments(reports, at[0])
    got = []
    for cutoff, end in zip(at, at[1:]):
        tracks = incremental_tracks(reports.where(F.col("snapshot_ts") < F.lit(end).cast("timestamp")), cutoff, register)
        got += collected(tracks, *columns)
        assert collected(carried_on(register, tracks, end), "icao", "last_ts", "seg_start_ts", "seg_n_reports") == collected(
            open_segments(reports, end), "icao", "last_ts", "seg_start_ts", "seg_n_reports")
        register = spark.createDataFrame(carried_on(register, tracks, end).collect(), register.schema)
    assert sorted(got, key=repr) == sorted(collected(enrich_tracks(reports), *columns), key=repr)


def test_closure_turn_and_derived_rate(spark):
    rows = [{"t": 0, "dist_to_apt_nm": 10.0, "track_deg": 359.0, "alt_ft": 3000, "vertical_rate_fpm": None, "vertical_rate_src": None},
            {"t": 60, "dist_to_apt_nm": 7.0, "track_deg": 1.0, "alt_ft": 2500, "vertical_rate_fpm": None, "vertical_rate_src": None},
            {"t": 400, "dist_to_apt_nm": 5.0, "track_deg": 1.0, "alt_ft": 2000, "vertical_rate_fpm": None, "vertical_rate_src": None}]
    got = collected(enrich_tracks(silver(spark, rows)), "closure_kt", "turn_deg", "vrate_fpm", "vrate_src", "dt_s", order=["snapshot_ts"])
    assert got[0] == (None, None, None, None, None)
    assert got[1] == (pytest.approx(180.0), 2.0, pytest.approx(-500.0), "delta", 60)
    # past 180 s the segment breaks, but the vertical rate is still derived up to 600 s
    assert got[2] == (None, None, pytest.approx(-500 / 340 * 60), "delta", None)


def test_implausible_closure_is_null(spark):
    rows = [{"t": 0, "dist_to_apt_nm": 50.0}, {"t": 15, "dist_to_apt_nm": 10.0}]
    assert collected(enrich_tracks(silver(spark, rows)), "closure_kt", order=["snapshot_ts"]) == [(None,), (None,)]


def test_inbound_needs_two_closing_steps_of_three(spark):
    rows = [{"t": 60 * i, "dist_to_apt_nm": d} for i, d in enumerate([20.0, 18.0, 19.0, 17.0, 15.0])]
    got = [r[0] for r in collected(enrich_tracks(silver(spark, rows)), "inbound_flag", order=["snapshot_ts"])]
    assert got == [False, False, False, True, True]


def test_interval_join_finds_each_pair_once(spark):
    rng = random.Random(5)
    points = [(rng.choice("ab"), EPOCH + rng.randrange(100_000), i) for i in range(200)]
    spans = [(rng.choice("ab"), EPOCH + lo, EPOCH + lo + rng.randrange(40_000), i) for i in range(40) for lo in [rng.randrange(90_000)]]
    p = spark.createDataFrame(points, "k string, s bigint, p int").select("k", "p", F.timestamp_seconds("s").alias("ts"))
    s = spark.createDataFrame(spans, "k string, a bigint, b bigint, i int").select(
        "k", "i", F.timestamp_seconds("a").alias("lo"), F.timestamp_seconds("b").alias("hi"))
    got = collected(slices.interval_join(p, s, ["k"], "ts", "lo", "hi", slice_s=3600), "p", "i")
    want = sorted(((pi, si) for k, t, pi in points for k2, a, b, si in spans if k == k2 and a <= t <= b), key=repr)
    assert got == want


def test_asof_join_matches_a_loop(spark):
    rng = random.Random(9)
    left = [(rng.choice("abc"), EPOCH + rng.randrange(200_000), i) for i in range(150)]
    right = [(k, EPOCH + t, t) for k in "ab" for t in sorted(rng.sample(range(200_000), 30))]
    ldf = spark.createDataFrame(left, "k string, s bigint, i int").select("k", "i", F.timestamp_seconds("s").alias("ts"))
    rdf = spark.createDataFrame(right, "k string, s bigint, v bigint").select("k", "v", F.timestamp_seconds("s").alias("rts"))
    for ahead in (0, 500):
        got = collected(slices.asof_join(ldf, rdf, ["k"], "ts", "rts", ahead, slice_s=5000), "i", "v")
        want = sorted(((i, max((v for k2, r, v in right if k2 == k and r <= s + ahead), default=None)) for k, s, i in left), key=repr)
        assert got == want


def test_salted_left_join_equals_plain(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").cast("string").alias("icao"))
    lookup = spark.createDataFrame([(0, "x"), (1, "y")], "k bigint, v string")
    assert collected(slices.salted_left_join(rows, lookup, ["k"], "icao"), "icao", "v") == collected(
        rows.join(lookup, "k", "left"), "icao", "v")
