"""What is read several times is computed once."""

from helpers import collected

from glidepath.operators import health, runs

DOCS = [('{"run_id": 1, "tasks": [{"task_key": "a", "attempt_number": 0, "start_time": 10, "end_time": 20, "setup_duration": 4, "execution_duration": 6}]}',),
        ('{"run_id": 1, "start_time": 5, "tasks": [{"task_key": "a", "attempt_number": 1, "start_time": 30}, {"task_key": "b", "start_time": 0}]}',),
        ('{"tasks": [{"task_key": "c", "start_time": 7, "end_time": 8}]}',), ('{"run_id": 2, "tasks": []}',)]


def test_spans_parse_each_document_once(spark):
    spans = runs.run_spans(runs.parsed_runs(spark.createDataFrame(DOCS, "doc string")))
    assert "from_json" not in spans._jdf.queryExecution().optimizedPlan().toString()
    assert collected(spans, "run_id", "span", "start_ms", "end_ms") == [
        (1, "run", 5, 5), (1, "run/a", 30, 5), (2, "run", 0, 0), (None, "run", 0, 0)]


def test_drift_sketches_its_brackets_once(spark):
    rows = spark.range(400).selectExpr("double(id) AS a", "double(id % 7) AS b")
    found = health.psi(rows, rows.where("a >= 100"), ["a", "b"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in plan  # written before, and read by both passes over the values
    assert plan.count("AS _bin#") == 1
    assert collected(found, "feature", "ref_rows", "comp_rows") == [("a", 400, 300), ("b", 400, 300)]
