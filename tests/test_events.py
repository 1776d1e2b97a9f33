import pytest
from helpers import collected, silver
from pyspark.sql import functions as F

from glidepath.operators import events
from glidepath.operators.tracks import enrich_tracks


def detect(spark, rows):
    tracks = enrich_tracks(silver(spark, rows))
    return tracks, events.segment_summary(tracks)


def final(dists, alts, step=30, **kw):
    return [{"t": step * i, "dist_to_apt_nm": d, "alt_ft": a, "vertical_rate_fpm": -700.0, "gs_kt": 140.0} | kw
            for i, (d, a) in enumerate(zip(dists, alts))]


@pytest.mark.parametrize("nearest,confidence", [(2.99, "confirmed"), (3.0, "inferred"), (5.99, "inferred"), (5.995, None)])
def test_touchdown_distance_gates(spark, nearest, confidence):
    _, summary = detect(spark, final([7.5, nearest], [2500, 1200]))
    got = collected(events.touchdowns(summary), "touchdown_confidence")
    assert got == ([(confidence,)] if confidence else [])


@pytest.mark.parametrize("alt,confidence", [(1526, "confirmed"), (1527, "inferred"), (3026, "inferred"), (3027, None)])
def test_touchdown_altitude_gates(spark, alt, confidence):
    _, summary = detect(spark, final([4.0, 2.0], [alt + 500, alt]))
    got = collected(events.touchdowns(summary), "touchdown_confidence")
    assert got == ([(confidence,)] if confidence else [])


def test_touchdown_prefers_the_first_ground_report(spark):
    rows = final([5.0, 2.0, 0.5, 0.4], [2000, 1300, 0, 0])
    for r in rows[2:]:
        r |= {"is_grounded": True, "gs_kt": 40.0}
    _, summary = detect(spark, rows)
    assert collected(events.touchdowns(summary).select((F.unix_seconds("touchdown_ts") % 1000).alias("s")), "s") == [(260,)]


def test_touchdown_needs_a_descent(spark):
    _, summary = detect(spark, final([5.0, 2.0], [2000, 1300], vertical_rate_fpm=-200.0))
    assert events.touchdowns(summary).count() == 0


def circle(n, alt=9000, dist=30.0, sweep=360):
    return [{"t": 60 * i, "track_deg": float(i * sweep / n % 360), "alt_ft": alt, "dist_to_apt_nm": dist, "lat": 33.7, "lon": -84.4,
             "vertical_rate_fpm": 0.0} for i in range(n)]


@pytest.mark.parametrize("n,held,flagged", [(7, 0, 0), (8, 1, 0), (9, 1, 0), (10, 1, 1)])
def test_holding_counts(spark, n, held, flagged):
    tracks, summary = detect(spark, circle(n))
    assert events.holding(summary).count() == held
    assert events.irregularities(tracks, summary).where("kind = 'holding'").count() == flagged


def test_straight_flight_is_no_holding(spark):
    _, summary = detect(spark, circle(12, sweep=20))
    assert events.holding(summary).count() == 0


def go_around(landing_after_s):
    low = {"dist_to_apt_nm": 3.0, "alt_ft": 2000, "vertical_rate_fpm": -700.0, "heading_err_deg": 10.0}
    up = {"dist_to_apt_nm": 9.0, "alt_ft": 5000, "vertical_rate_fpm": 1500.0, "heading_err_deg": 150.0}
    rows = [low | {"t": 0}, up | {"t": 120}]
    if landing_after_s is not None:
        steps = list(range(120 + 60, 120 + landing_after_s, 60))
        rows += [{"t": s, "dist_to_apt_nm": 20.0, "alt_ft": 6000, "vertical_rate_fpm": 0.0} for s in steps]
        rows.append({"t": 120 + landing_after_s, "dist_to_apt_nm": 0.5, "alt_ft": 0, "gs_kt": 40.0, "is_grounded": True})
    return rows


@pytest.mark.parametrize("after,found", [(None, 1), (240, 0), (241, 1)])
def test_go_around_and_a_later_landing(spark, after, found):
    rows = go_around(after)
    if after is None:
        # without a landing the low report must not pass as one: keep it above the gate
        rows[0]["alt_ft"] = 3100
    tracks, summary = detect(spark, rows)
    assert events.irregularities(tracks, summary).where("kind = 'go_around'").count() == found


def test_emergency_text_and_landing_mark(spark):
    rows = final([5.0, 2.0], [2000, 1300], squawk="7700", emergency="minfuel")
    tracks, summary = detect(spark, rows)
    got = collected(events.irregularities(tracks, summary), "kind", "detail", "landed", "confidence")
    assert got == [("emergency", "squawk=7700 emergency=minfuel", 1, 1.0)]


def test_live_flags_print_any_squawk(spark):
    rows = [{"t": 0}, {"t": 60, "emergency": "lifeguard"}]
    got = collected(events.live_flags(enrich_tracks(silver(spark, rows)), "KATL"), "kind", "severity", "detail")
    assert got == [("emergency", 3, "squawk=1200 emergency=lifeguard")]


def test_live_flags_skip_aircraft_out_of_sight(spark):
    rows = [{"t": 0, "squawk": "7700"}, {"t": 1300, "icao": "b2"}]
    assert events.live_flags(enrich_tracks(silver(spark, rows)), "KATL").count() == 0
    rows[1]["t"] = 1200
    assert events.live_flags(enrich_tracks(silver(spark, rows)), "KATL").count() == 1


def test_genuine_holds(spark):
    rows = circle(10) + [r | {"icao": "b2", "t": r["t"]} for r in circle(10)]
    tracks, summary = detect(spark, rows)
    irr = events.irregularities(tracks, summary)
    ends = tracks.groupBy("icao").agg(F.max("snapshot_ts").alias("e"))
    td = ends.select("icao", F.timestamp_seconds(F.unix_seconds("e") + F.when(F.col("icao") == "a1", 5399).otherwise(5400)).alias("touchdown_ts"))
    got = events.genuine_holds(irr, tracks, td).collect()
    assert [r.seg_id.split("-")[0] for r in got] == ["a1"]


def test_circling_over_compass_edge(spark):
    rows = [{"t": 60 * i, "track_deg": float(t), "alt_ft": 9000, "vertical_rate_fpm": 0.0} for i, t in enumerate([350, 355, 0, 5, 10, 350, 355, 0, 5, 10])]
    _, summary = detect(spark, rows)
    assert events.holding(summary, min_spread=0.0).first()["heading_spread"] < 0.05
