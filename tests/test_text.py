import random
import re

import numpy as np
import pytest
from helpers import collected
from pyspark.sql import functions as F

from glidepath.operators import passages, runs, text, vectors
from glidepath.plans import situation


def check(spark, body, cells, max_words=50):
    texts = spark.createDataFrame([(1, body)], "id int, text string")
    ev = spark.createDataFrame([(1, c) for c in cells], "id int, cell string")
    row = text.check_grounded(texts, text.harvest(ev, "id", "cell"), "id", "text", max_words).first()
    return row["passed"], row["reasons"]


@pytest.mark.parametrize("body,cells,reasons", [
    ("Three flights, 12 in all.", ["12"], []),
    ("12.04 or 12.06", ["12"], ["number 12.06 not in facts"]),
    ("about 4 now", ["3.6"], []),
    ("lands at 9:05 or 09:05", ["2026-10-18T09:05:00Z"], []),
    ("lands at 09:06", ["09:05"], ["time 09:06 not in facts"]),
    ("as of 2026-10-18T15:51:28Z", ["2026-10-18 15:51"], []),
    ("as of 2026-10-18T15:52:28Z", ["2026-10-18 15:51"], ["time 2026-10-18T15:52:28Z not in facts"]),
    ("DAL123 then SWA9", ["DAL123"], ["callsign SWA9 not in facts"]),
    ("the within_10_min value", [], ["key name within_10_min in text", ]),
    ("1,204 reports", ["1204"], []),
    ("squawk 7700", ["squawk=7700 emergency=general"], []),
    ("", ["1"], ["empty text"]),
    ("7 and 7", ["1"], ["number 7 not in facts", "number 7 not in facts"]),
])
def test_grounding(spark, body, cells, reasons):
    cells = cells or [""]
    passed, got = check(spark, body, cells)
    if "key name" in str(reasons):
        got = got[:1]
    assert got == reasons and passed is (not reasons)


def test_word_limit_comes_first(spark):
    assert check(spark, "a b 9", ["1"], 2) == (False, ["3 words > 2", "number 9 not in facts"])


def preds(spark, etas):
    return spark.createDataFrame([(f"DAL{i}", f"a{i}", float(e), 0) for i, e in enumerate(etas)], "callsign string, icao string, predicted_eta_min double, s int").select(
        "callsign", "icao", "predicted_eta_min", F.timestamp_seconds("s").alias("scored_at"))


def forecast(spark, means):
    return spark.createDataFrame([(i, float(m)) for i, m in enumerate(means)], "horizon_step int, predicted_mean double").select(
        "horizon_step", "predicted_mean", (F.col("predicted_mean") * 1.3).alias("predicted_q90"), F.lit(640.0).alias("arrivals_so_far"),
        F.timestamp_seconds(F.col("horizon_step") * 900).alias("bin_start_ts"), F.timestamp_seconds(F.lit(0)).alias("scored_at"))


def flags(spark, rows, s=0):
    return spark.createDataFrame([(*r, s) for r in rows], "kind string, severity int, callsign string, icao string, dist_to_apt_nm double, s int").withColumn(
        "scored_at", F.timestamp_seconds("s"))


CASES = {
    "surge": ([2.1, 3.4, 12.0, 28.0], [26.4, 25.1, 23.0, 21.7] * 3, []),
    "quiet": ([12.4], [1.2, 0.8, 0.4, 0.6] * 3, []),
    "near": ([2.0], [21.9, 20.4] * 6, [("holding", 2, "DAL2207", "c2", 22.9)]),
    "emergency": ([5.0], [14.0] * 12, [("emergency", 3, "AAL1923", "c1", 41.6), ("holding", 2, "DAL2207", "c2", 22.9)]),
}


@pytest.mark.parametrize("case", CASES)
def test_template_text_passes_its_own_check(spark, case):
    etas, means, fl = CASES[case]
    now = spark.range(1).select(F.timestamp_seconds(F.lit(60)).alias("now"))
    fl = flags(spark, fl or [("holding", 2, "X1", "x", 1.0)], 0 if fl else -10_000)
    facts = situation.situation_facts(preds(spark, etas), forecast(spark, means), fl, "KATL", now)
    row = situation.facts_text(facts).withColumn("id", F.lit(1))
    body = row.first()["text"]
    assert body.count("aircraft") >= 1 and "  " not in body
    cells = row.select("id", F.explode(F.split(F.regexp_replace(F.to_json(F.struct("inbound", "demand", "flags", "cap_per_hour", "cap_per_15min")),
                                                                r'[\[\]{}"]', ""), "[,]")).alias("c")).select(
        "id", F.regexp_replace("c", r"^[a-z_0-9]+:(?=.)", "").alias("cell"))
    cells = cells.unionByName(spark.createDataFrame([(1, v) for v in ("10", "30", "15")], "id int, cell string"))
    got = text.check_grounded(row, text.harvest(cells, "id", "cell"), "id", "text", 120).first()
    assert got["passed"], (body, got["reasons"])


def test_old_flags_count_as_none(spark):
    now = spark.range(1).select(F.timestamp_seconds(F.lit(960)).alias("now"))
    p = preds(spark, [5.0]).withColumn("scored_at", F.timestamp_seconds(F.lit(960)))
    for age, held in ((900, 1), (901, None)):
        f = flags(spark, [("holding", 2, "A1", "a", 9.0)], 960 - age)
        row = situation.situation_facts(p, None, f, "KATL", now).first()
        assert (row["flags"]["holding"] if row["flags"] else None) == held
    assert row["stale"] is False and row["demand_age_min"] is None


def test_missing_sources_are_unavailable(spark):
    now = spark.range(1).select(F.timestamp_seconds(F.lit(0)).alias("now"))
    body = situation.facts_text(situation.situation_facts(None, None, None, "KATL", now)).first()["text"]
    assert body == ("Inbound: no data. Demand: no data. Flags: no data.")


def test_citations(spark):
    answers = spark.createDataFrame([(1, "see (A.md §One)"), (2, "see B.md"), (3, "nothing"), (4, "nothing")], "id int, answer string")
    sources = spark.createDataFrame([(i, "docs/A.md §One") for i in (1, 2, 3)], "id int, source string")
    got = collected(text.citation_problems(answers, sources, "id"), "id", "problem")
    assert got == [(2, "cited B.md, which was not returned"), (3, "cites no returned passage")]


def test_quotes(spark):
    df = spark.createDataFrame([('it says "file  not found here"', "x\x1b[31m file not\nfound here"), ('it says "file was lost today"', "file not found"),
                                ('"short"', "short")], "a string, e string")
    assert [r[0] for r in df.select(text.quote_is_grounded(F.col("a"), F.col("e"))).collect()] == [True, False, False]


def test_meaning_rule(spark):
    df = spark.createDataFrame([("640 landed today",), ("we have seen 640 landed today",), ("640 landed. Today is fine",)], "t string")
    assert [r[0] for r in df.select(text.misses_meaning(F.col("t"))).collect()] == [True, False, False]


def test_fingerprint_ignores_order_only(spark):
    rows = [(i, f"text {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "id int, text string")
    mark = lambda d: text.fingerprint(d, "id", "text").first()["fingerprint"]
    assert mark(df) == mark(df.orderBy(F.desc("id")).repartition(3))
    assert mark(df) != mark(df.where("id < 49")) and mark(df) != mark(df.withColumn("text", F.upper("text")))


DOC = "intro words " * 10 + "\n\n# First *part*\n" + "alpha beta " * 20 + "\n\n```\n# not a heading\n" + "code " * 20 + "\n```\n\n## Empty\n\n## Last\n" + "\n".join(
    "row " * 30 for _ in range(30))


def test_passages_keep_every_word(spark):
    docs = spark.createDataFrame([("d.md", DOC), ("long.md", "x" * 4000 + " " + "word " * 20), ("none.md", None)], "name string, text string")
    rows = passages.chunk_docs(docs, max_words=50, max_chars=400).orderBy("name", "pos").collect()
    mine = [r for r in rows if r.name == "d.md"]
    assert {r.source for r in mine} == {"d.md", "d.md §First part", "d.md §Last"}
    assert all(len(r.text.split()) <= 50 and len(r.text) <= 400 for r in rows)
    assert sum(r.text.count("row") for r in mine) == 900 and "# not a heading" in " ".join(r.text for r in mine)


def test_cosine_topk_matches_numpy(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 8))
    m[200:] = m[0]  # a third of the vectors are copies
    q = rng.normal(size=(1100, 8))
    vecs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id bigint, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "key bigint, vec array<double>")
    got = {}
    for r in vectors.cosine_topk(asked, vecs, 3).collect():
        got.setdefault(r.query, {})[r.rank] = r.vec_id
    scores = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T, 9)
    for i in range(len(q)):
        assert [got[i][k] for k in (1, 2, 3)] == sorted(range(300), key=lambda j: (-scores[i, j], j))[:3]


RUN = ('{"run_id": 7, "start_time": 1000, "state": {"result_state": "FAILED"}, "tasks": ['
       '{"task_key": "poll", "attempt_number": 0, "start_time": 1000, "end_time": 5000, "state": {"result_state": "FAILED"}},'
       '{"task_key": "poll", "attempt_number": 1, "start_time": 6000, "end_time": 9000, "setup_duration": 61500, "execution_duration": 2000,'
       ' "state": {"result_state": "SUCCESS"}},'
       '{"task_key": "gold", "start_time": 9500, "state": {"life_cycle_state": "RUNNING"}},'
       '{"task_key": "brief", "state": {"result_state": "UPSTREAM_FAILED"}}]}')


def test_run_steps_and_spans(spark):
    parsed = runs.parsed_runs(spark.createDataFrame([(RUN,)], "doc string"))
    steps = runs.step_timings(parsed)
    assert collected(steps, "task", "state", "setup_s", "exec_s", "total_s") == [
        ("brief", "UPSTREAM_FAILED", 0, 0, None), ("gold", "RUNNING", 0, 0, None), ("poll", "SUCCESS", 62, 2, 3)]
    assert runs.failed_tasks(steps).count() == 0
    spans = collected(runs.run_spans(parsed), "span", "parent", "start_ms", "end_ms")
    assert ("run", None, 1000, 9000) in spans and ("run/poll/execution", "run/poll", 67500, 69500) in spans
    assert len(spans) == 5


@pytest.mark.parametrize("age,elapsed,source,status", [
    (15.0, 9.0, "llm", "READY"), (15.0, 10.5, "template", "READY_SLOW"), (15.4, 9.0, "llm", "NOT_READY"), (None, 9.0, "llm", "NOT_READY")])
def test_readiness(spark, age, elapsed, source, status):
    steps = spark.createDataFrame([(1, "check", "FAILED", 0), (1, "poll", "SUCCESS", 61)], "run_id bigint, task string, state string, setup_s bigint")
    state = spark.createDataFrame([(1, age, 1.0, 1.0, source, 3, elapsed)], "run_id bigint, gold_age_min double, forecast_age_min double,"
                                  " briefing_age_min double, briefing_source string, n_inbound bigint, elapsed_min double")
    row = runs.readiness(steps, state).first()
    assert row["status"] == status and "started late: poll setup 61 s" in row["warnings"]
    assert ("10.5 min, over the budget of 10" in row["warnings"]) is (status == "READY_SLOW")


@pytest.mark.parametrize("body,kind", [("HTTP 403 in a Traceback", "auth"), ("Error: 503 retry", "transient"), ("KeyError: x", "code"),
                                       ("NOT READY: demand", "data"), ("odd", "unknown"), (None, "unknown")])
def test_failure_classes(spark, body, kind):
    assert spark.createDataFrame([(body,)], "t string").select(runs.classify_failure("t").alias("k")).first()["k"] == kind


def test_number_match_against_brute_force(spark):
    rng = random.Random(4)
    body = " ".join(f"{rng.uniform(0, 30):.2f}" for _ in range(300))
    cells = [f"{rng.uniform(0, 30):.2f}" for _ in range(60)]
    allowed = {abs(float(c)) for c in cells} | {float(round(float(c))) for c in cells}
    want = [n for n in re.findall(r"[\d.]+", body) if not any(abs(float(n) - a) < 0.051 for a in allowed)]
    assert check(spark, body, cells, 1000)[1] == [f"number {n} not in facts" for n in want]


def test_passages_are_handed_on_in_small_batches(spark, monkeypatch):
    body = "\n\n".join(f"# Part {i}\n\n" + " ".join(f"w{i}x{j}" for j in range(40)) for i in range(30))
    rows = [(f"doc{n}", body) for n in range(20)] + [("none", None), (None, body)]
    docs = spark.createDataFrame(rows, "name string, text string").coalesce(1)
    want = sorted(((n, s, i, p) for n, t in rows for i, (s, p) in enumerate(passages.passages_of(n, t or "", 250, 1500, 12))), key=repr)
    assert sorted(map(tuple, passages.chunk_docs(docs).collect()), key=repr) == want and len(want) == 21 * 30
    sizes = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: [sizes.append(b.num_rows) or b for b in run(iter(self.toArrow().to_batches()))])
    passages.chunk_docs(docs, held_chars=2000)
    assert sum(sizes) == len(want) and max(sizes) <= 2000 // 200
