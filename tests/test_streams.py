"""Late rows, replays, chained windows and batched state, each against a batch over the same rows."""

import random

import pytest
from helpers import EPOCH, collected, silver
from pyspark.sql import functions as F

from glidepath.operators.traffic import congestion
from glidepath.operators.tracks import enrich_tracks
from glidepath.session import fresh_path
from glidepath.sources import envelopes
from glidepath.streaming import dealing, medallion, stateful


def bronze_rows(spark, rows):
    """Bronze from (icao, seconds, callsign)."""
    text = [f'{{"now": {(EPOCH + t) * 1000}, "ac": [{{"hex": "{icao}", "flight": "{name}", "lat": 33.0, "lon": -84.0, "gs": 100.0}}]}}' for icao, t, name in rows]
    df = spark.createDataFrame([(x,) for x in text], "value string").withColumns({"_ingest_file": F.lit("f"), "_ingest_ts": F.lit(0).cast("timestamp")})
    return medallion.with_day(envelopes.to_bronze(df.withColumn("e", F.from_json("value", envelopes.ENVELOPE_SCHEMA)).select("e.*", "_ingest_file", "_ingest_ts")))


LOADS = [[("a", 0, "x"), ("b", 10, "x"), ("a", 0, "x")],
         [("a", 2000, "x"), ("b", 10, "again"), ("a", 1500, "x")],   # b is known already, 10 is late
         [("c", 20, "late"), ("c", 20, "late"), ("a", 2000, "again"), ("d", 1100, "edge"), ("d", 1099, "late")],  # mark is 1100
         [("e", 99_999, "x")], [("e", 5, "late"), ("a", 0, "again"), ("c", 20, "again")]]


def silver_after(spark, root, loads, **kw):
    schema = None
    for n, rows in enumerate(loads):
        df = bronze_rows(spark, rows)
        schema = df.schema
        df.coalesce(1).write.mode("append").parquet(f"{root}/bronze")
    dealing.run_dealt(spark, root, schema, max_files=1, **kw)
    return schema


def rows_of(spark, root, schema):
    wanted = envelopes.to_silver(spark.createDataFrame([], schema).drop("dt")).schema
    return collected(dealing.silver_of(spark, root, wanted).withColumn("t", F.unix_seconds("snapshot_ts") - EPOCH), "icao", "t", "callsign", "late")


WANT = sorted([("a", 0, "x", False), ("b", 10, "x", False), ("a", 2000, "x", False), ("a", 1500, "x", False), ("c", 20, "late", True), ("d", 1100, "edge", False),
               ("d", 1099, "late", True), ("e", 99_999, "x", False), ("e", 5, "late", True)], key=repr)


def test_late_rows_arrive_once(spark):
    root = fresh_path(spark, "dealt")
    schema = silver_after(spark, root, LOADS)
    assert rows_of(spark, root, schema) == WANT
    assert collected(dealing.ledger(spark, root), "batch", "on_time", "late_rows") == [(0, 2, 0), (1, 2, 0), (2, 1, 2), (3, 1, 0), (4, 0, 1)]
    # the same rows by one batch
    one = fresh_path(spark, "dealt")
    schema = silver_after(spark, one, [[r for load in LOADS for r in load]])
    assert {(r[0], r[1]) for r in rows_of(spark, one, schema)} == {(r[0], r[1]) for r in WANT}


@pytest.mark.parametrize("stops", [[0], [0, 1, 4]])
def test_replay_after_a_stop(spark, stops):
    root, left = fresh_path(spark, "dealt"), list(stops)
    schema = bronze_rows(spark, LOADS[0]).schema
    for rows in LOADS:
        bronze_rows(spark, rows).coalesce(1).write.mode("append").parquet(f"{root}/bronze")

    def stop(batch):
        if left and batch == left[0]:
            left.pop(0)
            raise RuntimeError("stopped on purpose")

    for batch in stops:
        with pytest.raises(Exception, match="stopped on purpose"):
            dealing.run_dealt(spark, root, schema, max_files=1, before_commit=stop)
        assert dealing.ledger(spark, root).count() == batch  # readers do not see what was written but not committed
    dealing.run_dealt(spark, root, schema, max_files=1)
    assert rows_of(spark, root, schema) == WANT


def test_a_committed_batch_is_left_alone(spark):
    root = fresh_path(spark, "dealt")
    schema = silver_after(spark, root, LOADS[:2])
    before = rows_of(spark, root, schema)
    dealing.deal(bronze_rows(spark, [("z", 1, "no")]).drop("dt"), 1, root)
    assert rows_of(spark, root, schema) == before


def flights(seed, keys, n):
    rng, rows = random.Random(seed), []
    for key in keys:
        t = 0
        for _ in range(n):
            t += rng.choice([1, 20, 60, 120, 180, 181, 300, 601])
            rows.append({"icao": key, "t": t, "dist_to_apt_nm": rng.choice([None, float(rng.randrange(5, 130))]), "track_deg": rng.choice([None, float(rng.randrange(360))]),
                         "alt_ft": rng.choice([None, 400, 3000, 3500]), "vertical_rate_fpm": rng.choice([None, -300.0]), "vertical_rate_src": None,
                         "heading_err_deg": rng.choice([None, 10.0, 90.0]), "is_grounded": rng.random() < 0.1, "gs_kt": rng.choice([50.0, 200.0])})
    rows.append({"icao": "zz", "t": 10_000_000})  # moves the watermark past the others
    return rows


def drained(spark, df, files, make, name):
    """`make` of a stream over `df` in time order, `files` files, one batch each."""
    root = fresh_path(spark, name)
    ordered = df.repartitionByRange(files, "snapshot_ts").sortWithinPartitions("snapshot_ts")
    ordered.write.parquet(f"{root}/in")
    stream = make(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in"))
    medallion.write_available(stream, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def test_state_in_buckets_equals_batch(spark):
    reports = silver(spark, flights(4, "abc", 120))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    try:
        got = drained(spark, reports, 5, lambda s: stateful.stateful_tracks(s, bucket_s=90), "state")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    columns = ["icao", "snapshot_ts", "seg_start_ts", "dt_s", "dist_to_apt_nm", "closure_kt", "turn_deg", "vrate_fpm", "inbound_flag"]
    want = [r for r in collected(enrich_tracks(reports), *columns) if r[0] != "zz"]
    near = lambda rows: [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows]
    assert near(r for r in collected(got, *columns) if r[0] != "zz") == near(want)


def test_chained_windows_equal_batch(spark):
    rows = [{**r, "dist_to_apt_nm": r.get("dist_to_apt_nm") or 20.0} for r in flights(8, "abcdef", 80)]
    tracks = enrich_tracks(silver(spark, rows)).cache()
    columns = ["minute_ts", "ring", "n_aircraft", "n_inbound", "mean_alt_ft", "mean_gs_kt", "mean_eta_min"]
    want = collected(congestion(tracks.where("icao <> 'zz'")), *columns)
    assert collected(medallion.windowed_measures(tracks.where("icao <> 'zz'")), *columns) == want
    got = drained(spark, tracks, 4, medallion.windowed_measures, "measures")
    assert collected(got.where(F.unix_seconds("minute_ts") < EPOCH + 9_000_000), *columns) == want


def test_a_release_steps_over_many_buckets_at_once(spark, monkeypatch):
    import numpy as np

    class Map(dict):
        def getValue(self, k): return super().get(k)  # noqa: E704, N802
        def updateValue(self, k, v): self[k] = v  # noqa: E704, N802
        def removeKey(self, k): del self[k]  # noqa: E704, N802

    def released(step):
        monkeypatch.setattr(stateful, "STEP", step)
        state, stepped, timers = stateful.TrackState(bucket_s=60), [], []
        state.waiting = Map()
        state.handle = type("H", (), {"registerTimer": staticmethod(timers.append)})
        state._step = lambda key, w: stepped.append(w["us"].tolist()) or len(w)
        for n in range(50):
            w = np.zeros(2, dtype=stateful.WAITING)
            w["us"] = [n * 60_000_000 + 30_000_000, n * 60_000_000]
            state.waiting[(n,)] = (w.tobytes(),)
        list(state._release(("a",), 40 * 60_000 + 1000, state._waiting()))
        assert sorted(k[0] for k in state.waiting) == list(range(40, 50)) and timers == [40 * 60_000 + 30_000 + 1]
        return stepped

    once, often = released(1 << 16), released(3)
    assert len(once) == 1 and len(once[0]) == 81 and max(map(len, often)) <= 4
    assert once[0] == sorted(once[0]) == [x for part in often for x in part]


def test_a_day_is_written_by_several_tasks(spark):
    root = fresh_path(spark, "dealt")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        schema = silver_after(spark, root, [[(f"a{i}", i * 3600, "x") for i in range(24)]])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(rows_of(spark, root, schema)) == 24
    parts = spark.read.parquet(f"{root}/silver_dealt").where("batch = 0").select(
        F.floor(F.unix_seconds("snapshot_ts") / dealing.PART_S).alias("part"), F.input_file_name().alias("file")).distinct().collect()
    assert len({r["part"] for r in parts}) == 8 and len({r["file"] for r in parts}) > 1


def test_a_load_of_many_files_is_one_batch(spark, sf_dir, monkeypatch):
    from glidepath.workbench import ingest
    seen, deal, stored = [], dealing.deal, ingest.catalog.stored
    monkeypatch.setattr(dealing, "deal", lambda batch, n, *a, **k: seen.append((n, batch.rdd.getNumPartitions())) or deal(batch, n, *a, **k))
    monkeypatch.setattr(ingest.catalog, "stored", lambda df, name: stored(df.repartition(6), name))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128MB")  # a task for each file
    try:
        ingest.dealt(spark, sf_dir)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert [n for n, _ in seen] == [0, 1, 2] and min(parts for _, parts in seen) > 1
