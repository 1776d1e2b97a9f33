import json
from datetime import datetime

import pytest
from helpers import collected, silver
from pyspark.sql import Observation
from pyspark.sql import functions as F

from glidepath import testdata
from glidepath.operators import learn
from glidepath.operators.tracks import enrich_tracks
from glidepath.plans import refresh, retrain, views
from glidepath.session import fresh_path
from glidepath.sources import catalog, envelopes, history
from glidepath.sources.catalog import Catalog
from glidepath.streaming import medallion

T0 = 1704067200000
CAPTURE = {"apt_icao": "KATL", "apt_lat": 33.6407, "apt_lon": -84.4277, "radius_nm": 250, "source": "live"}


def report(**kw):
    return {"hex": "a1", "flight": " DAL1 ", "lat": 34.0, "lon": -84.4, "alt_baro": 3000, "gs": 180.0, "track": 180.0, "baro_rate": -700} | kw


def land(root, minute, reports, **kw):
    folder = root / f"dt=2024-01-01/hh={minute // 60:02d}"
    folder.mkdir(parents=True, exist_ok=True)
    now = T0 + minute * 60000
    (folder / f"{now}.json").write_text(json.dumps({"now": now, "total": len(reports), "ac": reports, "capture": CAPTURE} | kw, indent=1))


@pytest.fixture
def landing(tmp_path):
    root = tmp_path / "landing"
    for m in range(12):
        land(root, m, [report(alt_baro=3000 - 100 * m), report(hex="b2", alt_baro="ground", gs=20.0, baro_rate=None, geom_rate=64)])
    land(root, 12, [])
    land(root, 13, [report(hex=None), report(hex="c3", lat=None, lon=None, squawk="7700"), report(hex="d4", alt_baro="junk", gs=900.0, odd=1)])
    (root / "state.txt").write_text("not an envelope")
    return root


def test_silver_from_files(spark, landing):
    bronze = envelopes.to_bronze(envelopes.read_envelopes(spark, str(landing)))
    assert bronze.count() == 27 and bronze.where("_ingest_file IS NULL").count() == 0
    counts = Observation("silver")
    out = envelopes.to_silver(bronze, observe=counts)
    rows = {(r.icao, r.snapshot_ts): r for r in out.collect()}
    assert len(rows) == 26
    assert counts.get == {"rows": 27, "has_icao": 1, "plausible_altitude": 0, "plausible_groundspeed": 1}
    ground = out.where("icao = 'b2'").first()
    assert (ground.alt_ft, ground.is_grounded, ground.phase, ground.vertical_rate_src) == (0, True, "ground", "geom")
    blind = out.where("icao = 'c3'").first()
    assert (blind.has_position, blind.dist_to_apt_nm, blind.squawk, blind.emergency) == (False, None, "7700", "none")
    assert out.where("icao = 'd4'").first().alt_ft is None
    assert out.where("icao = 'a1'").first().callsign == "DAL1"
    assert collected(envelopes.new_fields(bronze), "field", "reports") == [("odd", 1)]


@pytest.mark.parametrize("max_files", [None, 3])
def test_stream_equals_batch_and_reruns_add_nothing(spark, landing, tmp_path, max_files):
    columns = ["icao", "snapshot_ts", "alt_ft", "dist_to_apt_nm", "phase"]
    want = collected(envelopes.to_silver(envelopes.to_bronze(envelopes.read_envelopes(spark, str(landing)))), *columns)
    root = str(tmp_path / "out")
    _, out = medallion.run_medallion(spark, str(landing), root, max_files)
    assert collected(out, *columns) == want
    _, out = medallion.run_medallion(spark, str(landing), root, max_files)
    assert collected(out, *columns) == want
    land(landing, 14, [report(), report()])
    _, out = medallion.run_medallion(spark, str(landing), root, max_files)
    assert out.count() == len(want) + 1


def test_backfill_goes_beside_the_stream(spark, landing):
    bronze = envelopes.to_bronze(envelopes.read_envelopes(spark, str(landing)))
    live, old = medallion.split_by_age(bronze, T0 // 1000 + 13 * 60, 300)
    assert live.count() + old.count() == 27 and old.count() == 16
    merged = medallion.merge_backfill(envelopes.to_silver(live), old.unionByName(live))
    assert merged.count() == 26


@pytest.mark.parametrize("low,high,hours", [(10, 12, {10, 11, 12}), (22, 1, {22, 23, 0, 1}), (0, 0, {0})])
def test_hour_range_wraps(spark, low, high, hours):
    df = spark.range(24).where(history.hour_in_range(F.col("id"), low, high))
    assert {r.id for r in df.collect()} == hours


def test_targets_and_worklist(spark):
    assert [str(r.date) for r in history.month_firsts(spark, "2024-02-15", 3).collect()] == ["2023-12-01", "2024-01-01", "2024-02-01"]
    day = spark.createDataFrame([("2024-01-01",)], "d string").select(F.col("d").cast("date").alias("date"))
    wanted = history.targets(day, 90, (23, 0))
    tags = {h * 3600 + m * 60 for s in range(0, 86400, 90) for h, m in [(s // 3600, s % 3600 // 60)] if h in (23, 0)}
    assert {r.target_s - T0 // 1000 for r in wanted.collect()} == tags
    done = wanted.where("target_tag >= '20240101_2300'")
    todo = history.worklist(wanted, done, cap=5)
    assert [r.target_tag for r in todo.collect()] == [f"20240101_00{m:02d}" for m in (0, 1, 3, 4, 6)]


def test_thinning_takes_the_first_snapshot_near_the_target(spark):
    times = [3, 20, 26, 70, 86, 119, 121, 180]
    df = spark.createDataFrame([(t,) for t in times], "t int").select("t", F.timestamp_seconds(F.lit(T0 // 1000) + F.col("t")).alias("snapshot_ts"))
    got = sorted(r.t for r in history.thin_snapshots(df, interval_s=60).collect())
    assert got == [3, 70, 121, 180]


def test_history_is_conformed(spark, tmp_path):
    root = tmp_path / "h"
    root.mkdir()
    far, blind = report(hex="f1", lat=40.0), report(hex="n1", lat=None)
    for i, (s, key) in enumerate([(5, "aircraft"), (10, "ac"), (65, "ac")]):
        (root / f"{i}.json").write_text(json.dumps({"now": T0 / 1000 + s, key: [report(), far, blind]}))
    out = history.conform_history(envelopes.read_envelopes(spark, str(root)), 33.6407, -84.4277, "KATL")
    assert collected(out, "report.hex", "target_tag", "source", "apt_icao", "src_date") == [
        ("a1", "20240101_0000", "backfill", "KATL", "2024-01-01"), ("a1", "20240101_0001", "backfill", "KATL", "2024-01-01")]
    assert envelopes.to_silver(out).count() == 2


def test_tables_of_plain_files(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "c"))
    rows = spark.range(10).select("id", F.timestamp_seconds(F.col("id") * (86400 // 4)).alias("ts"))  # ids 0-3, 4-7 and 8-9 by day
    assert not cat.exists("t")
    with pytest.raises(FileNotFoundError):
        cat.replace_window("t", rows, "ts", "1970-01-01 12:00:00")
    cat.replace("t", rows.unionByName(spark.sql("SELECT -1L AS id, CAST(NULL AS timestamp) AS ts")), "ts")
    fresh = rows.where("id BETWEEN 2 AND 3 OR id >= 8").select((F.col("id") + 100).alias("id"), "ts")
    cat.replace_window("t", fresh, "ts", "1970-01-01 12:00:00")
    # the cutoff's day keeps its earlier rows, the second day is left without rows, a row without a time stays
    assert collected(cat.read("t"), "id") == [(-1,), (0,), (1,), (102,), (103,), (108,), (109,)]
    assert collected(cat.since("t", "ts", datetime(1970, 1, 1, 18)), "id") == [(103,), (108,), (109,)]
    assert collected(cat.newest_day("t"), "id") == [(108,), (109,)]
    cat.append("t", rows.withColumn("extra", F.lit("x")), "ts")
    assert cat.read("t", widened=True).where("extra IS NULL").count() == 7
    with pytest.raises(RuntimeError):
        cat.reset(["t"], ["absent"])
    assert cat.read("t").count() == 17
    cat.replace("h", rows.where("id < 0"), "ts")  # no rows, but columns
    assert cat.read("h").columns == ["id", "ts"] and cat.read("h").count() == 0
    cat.reset(["t", "none"], ["h"])
    assert cat.read("t").columns == ["id", "ts", "extra"] and cat.read("t").count() == 0
    cat.append("t", rows.withColumn("extra", F.lit("x")), "ts")
    assert cat.read("t").count() == 10
    cat.append_load("l", rows, 1)
    cat.append_load("l", rows.where("id < 4"), 2)
    cat.append_load("l", rows.where("id < 3"), 2)
    assert [cat.read_load("l", n).count() for n in (1, 2)] == [10, 3]
    assert cat.pointed("champion", "m") is None
    cat.point("champion", "m", 1)
    cat.point("champion", "m", 2)
    assert cat.pointed("champion", "m") == 2


def test_schema_drift():
    drift = catalog.schema_drift(["a", "b", "c"], ["c", "a", "x"])
    assert drift == {"missing": ["b"], "extra": ["x"], "ordered": False}
    with pytest.raises(ValueError):
        learn.check_inputs(["a", "b"], ["b", "a"])


def test_views_on_empty_and_blank(spark):
    rows = spark.createDataFrame([("", "a1", 5.0, 0), ("DAL2", "b2", 4.0, 60)], "callsign string, icao string, predicted_eta_min double, s int").select(
        "*", F.lit("B738").alias("ac_type"), F.timestamp_seconds(F.lit(0)).alias("scored_at"), F.timestamp_seconds("s").alias("predicted_touchdown_ts"),
        F.lit(3.0).alias("dist_to_apt_nm"), F.lit(1).alias("model_version"))
    assert views.arrival_picture(rows.where("s < 0")).count() == 0
    assert collected(views.next_arrivals(rows, 0), "rank", "callsign") == [(1, "a1")]
    assert collected(views.next_arrivals(rows, 99), "rank", "callsign") == [(1, "a1"), (2, "DAL2")]


def test_refresh_and_retrain(spark, sf_dir):
    root = fresh_path(spark, "flow")
    cat = Catalog(spark, root)
    reports = testdata.positions(spark, "/root/testdata/sf0.01")
    reports.write.parquet(f"{root}/silver")
    stored = spark.read.parquet(f"{root}/silver")
    refresh.build_gold(cat, stored.where("snapshot_ts < '2024-01-01 02:00:00'"), end="2024-01-01 02:00:00")
    refresh.update_gold(cat, stored, "2024-01-01 02:00:00", "2024-01-01 02:30:00")
    refresh.update_gold(cat, stored, "2024-01-01 02:00:00", "2024-01-01 02:30:00")
    refresh.update_gold(cat, stored, "2024-01-01 02:30:00")
    full = Catalog(spark, fresh_path(spark, "flow"))
    refresh.build_gold(full, stored)
    for name, columns in {"tracks": ["icao", "snapshot_ts", "seg_id", "inbound_flag"], "touchdowns": ["seg_id", "touchdown_ts", "touchdown_confidence"],
                          "holding": ["seg_id", "n_reports"], "irregularities": ["seg_id", "kind", "event_ts"],
                          "congestion": ["minute_ts", "ring", "n_aircraft", "n_inbound"]}.items():
        assert collected(cat.read(name), *columns) == collected(full.read(name), *columns), name
    retrain.build_training(cat)
    rows = cat.read("training").withColumn("obs_day", F.hour("snapshot_ts"))
    cat.replace("training", catalog.stored(rows, "training"))
    first = retrain.retrain(cat, "obs_day", 2, True, "2024-01-01 03:00:00", n_params=1, max_trees=5).first()
    assert (first["gate_verdict"], first["applied"]) == ("PASS", True) and cat.pointed("champion", retrain.ETA_MODEL) == 1
    model = retrain.load(cat, retrain.ETA_MODEL, 1)
    now = "2024-01-01 03:00:00"
    refresh.score(cat, model, 1, now, testdata.demand.profile(testdata.demand_frame(spark, "/root/testdata/sf0.01")), "KATL")
    assert cat.read("predictions").count() > 0 and cat.read("demand_forecast").count() == 12
    assert cat.read("predictions").where("predicted_eta_min < 0").count() == 0
    refresh.brief(cat, now, "KATL")
    assert "Inbound aircraft at KATL" in cat.read("ops_briefings").first()["briefing"]
    docs = spark.createDataFrame([('{"run_id": 1, "tasks": []}',)], "doc string")
    verdict = refresh.check(cat, docs, 1, now, "KATL", 8.0).first()
    assert verdict["status"] == "READY", verdict


def test_model_beats_the_baseline_it_is_given(spark, sf_dir):
    rows = [{"t": 60 * i, "icao": f"a{k}", "dist_to_apt_nm": 60.0 - 2 * i, "gs_kt": 240.0, "alt_ft": 1500 + 300 * (29 - i), "vertical_rate_fpm": -700.0}
            for k in range(30) for i in range(30)]
    tracks = enrich_tracks(silver(spark, rows))
    rows = tracks.withColumns({"minutes_to_touchdown": F.col("dist_to_apt_nm") / 4 + 3, "airport_inbound_count": F.lit(1).cast("bigint")})
    from glidepath.operators import features
    ready = features.eta_features(rows).withColumns({"baseline_pred": features.naive_eta(), "d": F.pmod(F.xxhash64("icao"), F.lit(3)).cast("int")})
    parts = learn.split_by_day(ready, "d", 0)
    assert {r[0] for r in parts.select("part").distinct().collect()} == {"train", "val", "test"}
    model, info = learn.train_eta(parts, n_params=2, max_trees=20)
    overall = learn.holdout_report(model, parts.where("part = 'test'"))[1].first()
    assert overall["mae"] < overall["baseline_mae"] / 3 and info["final_trees"] >= 5
    best = learn.feature_effects(model, parts.where("part = 'test'"), ["seg_id", "snapshot_ts"], top=2)
    assert best.groupBy("seg_id", "snapshot_ts").count().where("count != 2").count() == 0


def test_live_reads_take_the_last_day(spark):
    cat = Catalog(spark, fresh_path(spark, "days"))
    rows = spark.range(300).select("id", F.timestamp_seconds(F.col("id") * 1000 + 1704067200).alias("ts"))
    cat.replace("t", rows, "ts")
    assert cat.days("t") == ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"]
    assert collected(cat.latest_run("t", "ts"), "id") == [(299,)] and cat.newest("t", "ts") == datetime(2024, 1, 4, 11, 3, 20)
    assert collected(cat.recent("t", "ts", 1440), "id") == sorted(((i,) for i in range(213, 300)), key=repr)
    plan = cat.recent("t", "ts", 30)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    # an emptied last day is passed over, an empty table gives no rows
    cat.replace_window("t", rows.where("id < 200"), "ts", "2024-01-02 00:00:00")
    assert cat.newest("t", "ts") == datetime(2024, 1, 3, 7, 16, 40)
    cat.replace("e", rows.where("false"), "ts")
    assert cat.newest("e", "ts") is None and cat.latest_run("e", "ts").count() == cat.recent("e", "ts", 5).count() == 0
