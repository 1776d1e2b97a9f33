"""Reports of dense events, against plain Python."""

from datetime import datetime, timedelta

from glidepath import testdata as td

START = datetime(2024, 1, 1)


def events_of(spark, folder, rows):
    """rows: (event id, user, compressed second of the first morning or None, event type, value)."""
    at = [(e, None if s is None else START + timedelta(seconds=80 * s), u, k, v) for e, u, s, k, v in rows]
    spark.createDataFrame(at, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return f"{folder}{td.DENSE}"


def brute_force(rows):
    """Per (user, second) the lowest event id and its alarm; an id of None only where there is no other."""
    best = {}
    for e, u, s, k, v in rows:
        alarm = int(k == "error" and v is not None and v > 150)
        for j in range(td.REPORTS):
            at = (u, None if s is None else 16200 + s + td.STEP_S * j)
            mine = (e is None, e or 0, e, None if e is None else alarm)
            best[at] = min(best.get(at, mine), mine)
    return sorted(((u, t, e, a) for (u, t), (_, _, e, a) in best.items()), key=repr)


def test_meeting_reports_are_settled_before_they_are_repeated(spark, tmp_path):
    rows = [(5, 1, 100, "view", 1.0), (3, 1, 130, "error", 200.0), (9, 1, 430, "view", 1.0), (2, 1, 460, "view", 1.0), (1, 1, 101, "error", 200.0),
            (7, 1, 100, "error", 900.0), (4, 2, 100, "error", None), (4, 2, 100, "error", None), (None, 2, 160, "error", 900.0), (None, 2, 190, "view", 1.0),
            (None, 2, 2000, "view", 1.0), (6, 2, None, "view", 1.0), (8, 2, None, "view", 1.0), (10, None, 50, "view", 1.0), (11, None, 80, "view", 1.0),
            (12, 3, 0, "view", 1.0)]
    rows += [(100 + i, 4, 30 * ((7 * i) % 40), "error", 100.0 + 10 * i) for i in range(40)]
    made = td._instants(spark, events_of(spark, tmp_path, rows))
    got = sorted((tuple(r) for r in made.select("user_id", "t", "event_id", "alarm").collect()), key=repr)
    assert got == brute_force(rows)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate")  # aggregated below the repetition, so over events and not over reports


def test_sketches_are_made_of_the_columns_they_need(spark, tmp_path):
    from glidepath.workbench import dense

    sf = events_of(spark, tmp_path, [(i, i % 3, 90 * i, "view", 1.0) for i in range(30)]).removesuffix(td.DENSE)
    rows, table = dense.sketched(spark, sf)
    assert rows.columns == ["snapshot_ts", *dense._FIELDS, *dense._IDS]
    assert {r["field"] for r in table.select("field").distinct().collect()} == {*dense._FIELDS, *dense._IDS}
