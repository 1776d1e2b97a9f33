"""Queries over texts, vectors and run documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from glidepath import testdata as td
from glidepath.constants import FAILURE_TEXTS
from glidepath.operators import passages, runs, text, vectors
from glidepath.session import fresh_path
from glidepath.sources.catalog import Catalog
from glidepath.workbench.registry import flat, query
from glidepath.workbench.sqlparts import part, with_parts

_FAIL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(body),'{w}')" for w in words) + f" THEN '{kind}'" for kind, words in FAILURE_TEXTS) + " ELSE 'unknown' END"


@query("h11_failure_classes", f"""
SELECT kind, id, {_FAIL} AS failure FROM (SELECT 'doc' AS kind, doc_id AS id, text AS body FROM documents UNION ALL SELECT 'page', page_id, html FROM pages) q""")
def failures(spark, sf):
    docs = td.table(spark, sf, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    pages = td.table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body"))
    return docs.unionByName(pages).select("kind", "id", runs.classify_failure("body").alias("failure"))


# Orders as job runs and line items as their tasks: a first failed attempt and a second one.
part("task", """
SELECT DISTINCT l_orderkey AS run_id, 'task'||l_linenumber AS task, 946684800000+l_partkey*60000+l_suppkey*7 AS s0, l_returnflag AS f,
 CAST(l_quantity*1700 AS BIGINT) AS setup, CAST(l_quantity*1234 AS BIGINT) AS work FROM lineitem
""")
part("step_rank", """
SELECT *, row_number() OVER (PARTITION BY run_id, task ORDER BY s0 DESC, setup DESC, work DESC, CASE WHEN f<>'N' THEN s0+90000+setup+work END DESC NULLS LAST,
 CASE f WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END DESC) AS rn FROM task
""")
part("step", """
SELECT run_id, task, CASE f WHEN 'A' THEN 'SUCCESS' WHEN 'R' THEN 'FAILED' ELSE 'RUNNING' END AS state, s0+90000 AS s, setup, work,
 CASE WHEN f<>'N' THEN s0+90000+setup+work END AS e FROM step_rank WHERE rn=1
""")


def run_docs(spark, sf):
    first = F.lit(946684800000) + F.col("l_partkey") * 60000 + F.col("l_suppkey") * 7
    setup, work = (F.col("l_quantity") * 1700).cast("bigint"), (F.col("l_quantity") * 1234).cast("bigint")
    ok, done = F.col("l_returnflag") == "A", F.col("l_returnflag") != "N"

    def attempt(n, start, end, state):
        return F.struct(
            F.concat(F.lit("task"), F.col("l_linenumber").cast("string")).alias("task_key"), F.lit(n).alias("attempt_number"), start.alias("start_time"),
            end.alias("end_time"), setup.alias("setup_duration"), work.alias("execution_duration"), state.alias("state"))
    none = F.lit(None).cast("string")
    lost = F.struct(F.lit("FAILED").alias("result_state"), none.alias("life_cycle_state"))
    last = F.struct(F.when(ok, "SUCCESS").when(done, "FAILED").alias("result_state"),
                    F.when(~done, "RUNNING").alias("life_cycle_state"))
    again = first + 90000
    tasks = F.array(attempt(0, first, first + 60000, lost), attempt(1, again, F.when(done, again + setup + work), last))
    return td.table(spark, sf, "lineitem").select(F.to_json(F.struct(F.col("l_orderkey").alias("run_id"), tasks.alias("tasks"))).alias("doc"))


def steps(spark, sf):
    return runs.step_timings(runs.parsed_runs(run_docs(spark, sf)))


@query("h08_step_timings", with_parts("""
SELECT run_id, task, state, CAST(round_even(setup/1000,0) AS BIGINT) AS setup_s, CAST(round_even(work/1000,0) AS BIGINT) AS exec_s,
 CAST(round_even((e-s)/1000,0) AS BIGINT) AS total_s, s AS start_time FROM step"""))
def timings(spark, sf):
    return flat(steps(spark, sf))


@query("w11_latest_attempts", with_parts("SELECT run_id, task, CAST(1 AS BIGINT) AS attempt, s AS start_time, state FROM step"))
def attempts(spark, sf):
    return flat(runs.latest_attempts(runs.parsed_runs(run_docs(spark, sf))).select("run_id", "task", "attempt", "start_time", "state"))


part("run_head", "SELECT run_id, min(s) AS s, coalesce(max(e), min(s)) AS e FROM step GROUP BY 1")


@query("h09_run_spans", with_parts("""
SELECT run_id, 'run' AS span, NULL AS parent, 'refresh run '||run_id AS name, 'CHAIN' AS kind, s AS start_ms, e AS end_ms FROM run_head
UNION ALL SELECT t.run_id, 'run/'||task, 'run', 'task '||task, 'CHAIN', t.s, coalesce(t.e, h.e) FROM step t JOIN run_head h ON h.run_id=t.run_id
UNION ALL SELECT run_id, 'run/'||task||'/setup', 'run/'||task, 'setup', 'UNKNOWN', s, s+setup FROM step WHERE setup>0
UNION ALL SELECT run_id, 'run/'||task||'/execution', 'run/'||task, 'execution', 'UNKNOWN', s+setup, s+setup+work FROM step WHERE work>0"""))
def spans(spark, sf):
    return flat(runs.run_spans(runs.parsed_runs(run_docs(spark, sf))))


@query("h12_failed_tasks", with_parts("SELECT run_id, task FROM step WHERE state='FAILED' AND task<>'task1'"))
def failed(spark, sf):
    return flat(runs.failed_tasks(steps(spark, sf), "task1").select("run_id", "task"))


part("ready", """
SELECT o.o_orderkey AS run_id, concat_ws(' | ', CASE WHEN t.bad IS NOT NULL THEN 'not finished: '||t.bad END,
 CASE WHEN o_orderkey%17=0 THEN 'tracks: no rows' WHEN o_orderkey%20>15 THEN 'tracks: '||(o_orderkey%20)||' min old (> 15)' END,
 CASE WHEN o_custkey%18>15 THEN 'demand forecast: '||(o_custkey%18)||' min old (> 15)' END) AS reasons, (o_orderkey%320)/16e0+0.01e0 AS el,
 concat_ws(' | ', CASE WHEN o_orderpriority='5-LOW' THEN 'text comes from the template' END,
 CASE WHEN o_custkey%9=0 THEN 'newest snapshot has no inbound aircraft' END, CASE WHEN t.slow IS NOT NULL THEN 'started late: '||t.slow END) AS rest
FROM orders o LEFT JOIN (SELECT run_id, string_agg(DISTINCT task, ', ' ORDER BY task) FILTER (state<>'SUCCESS' AND task<>'task1') AS bad,
 string_agg(DISTINCT task||' setup '||CAST(round_even(setup/1000,0) AS BIGINT)||' s', ', ' ORDER BY task||' setup '||CAST(round_even(setup/1000,0) AS BIGINT)||' s') FILTER (round_even(setup/1000,0)>60) AS slow
 FROM step GROUP BY 1) t ON t.run_id=o.o_orderkey
""")


@query("h10_readiness", with_parts("""
SELECT run_id, CASE WHEN reasons<>'' THEN 'NOT_READY' WHEN el>10 THEN 'READY_SLOW' ELSE 'READY' END AS status, reasons,
 concat_ws(' | ', CASE WHEN reasons='' AND el>10 THEN printf('%.1f min, over the budget of 10', el) END, nullif(rest,'')) AS warnings FROM ready"""))
def ready(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    status = td.table(spark, sf, "orders").select(
        key.alias("run_id"), F.when(key % 17 != 0, (key % 20).cast("double")).alias("gold_age_min"),
        (cust % 18).cast("double").alias("forecast_age_min"), F.lit(3.0).alias("briefing_age_min"),
        F.when(F.col("o_orderpriority") == "5-LOW", "template").otherwise("llm").alias("briefing_source"), (cust % 9).alias("n_inbound"),
        ((key % 320) / 16.0 + 0.01).alias("elapsed_min"))
    return flat(runs.readiness(steps(spark, sf), status, self_task="task1"))


# Numbers, times and callsigns in the documents. The twin's patterns have no look-behind.
_NUM = r"(?:^|[^\p{L}\p{N}_.])(\d+(?:,\d{3})*(?:\.\d+)?)"


@query("t04_harvest", r"""
SELECT doc_id, count(DISTINCT v) FILTER (k='number') AS numbers, count(DISTINCT v) FILTER (k='time') AS times, count(DISTINCT v) FILTER (k='callsign') AS callsigns FROM (
 SELECT doc_id, k, unnest(vs) AS v FROM (
  SELECT doc_id, 'number' AS k, list_distinct(flatten(list_transform(regexp_extract_all(b,'""" + _NUM + r"""',1), lambda x: [CAST(replace(x,',','') AS DOUBLE), round_even(CAST(replace(x,',','') AS DOUBLE),0)]))::VARCHAR[]) AS vs FROM (
    SELECT doc_id, regexp_replace(a,'\b\d{1,2}:\d{2}\b',' ','g') AS b FROM (SELECT doc_id, regexp_replace(trim(text),'\b[A-Z]{2,4}\d{1,4}[A-Z]{0,2}\b',' ','g') AS a FROM documents))
  UNION ALL SELECT doc_id, 'callsign', list_distinct(regexp_extract_all(text,'\b[A-Z]{2,4}\d{1,4}[A-Z]{0,2}\b')) FROM documents
  UNION ALL SELECT doc_id, 'time', list_distinct(list_transform(regexp_extract_all(regexp_replace(text,'\b[A-Z]{2,4}\d{1,4}[A-Z]{0,2}\b',' ','g'),'\b\d{1,2}:\d{2}\b'), lambda x: lpad(x,5,'0'))) FROM documents) q) z GROUP BY 1""")
def harvested(spark, sf):
    found = text.harvest(td.table(spark, sf, "documents"), "doc_id", "text")

    def kinds(k):
        return F.count_if(F.col("kind") == k)
    return flat(found.groupBy("doc_id").agg(kinds("number").alias("numbers"), kinds("time").alias("times"), kinds("callsign").alias("callsigns")))


@query("t04_nested_evidence", """
SELECT DISTINCT o_orderkey, kind, round(number,6) AS number, token FROM (
 SELECT o_orderkey, 'number' AS kind, unnest([CAST(o_totalprice AS DOUBLE), round_even(CAST(o_totalprice AS DOUBLE),0), CAST(o_custkey AS DOUBLE)]) AS number, NULL::VARCHAR AS token FROM orders
 UNION ALL SELECT o_orderkey, 'time', NULL, lpad(CAST(o_orderkey%24 AS VARCHAR),2,'0')||':'||lpad(CAST(o_custkey%60 AS VARCHAR),2,'0') FROM orders
 UNION ALL SELECT o_orderkey, 'callsign', NULL, 'DAL'||(o_orderkey%1000) FROM orders) q""")
def nested_evidence(spark, sf):
    clock = F.concat_ws(":", F.col("o_orderkey") % 24, F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0"))
    facts = F.struct(F.col("o_totalprice").alias("price"), F.array(F.struct(F.col("o_custkey").alias("who"), F.lit(None).cast("string").alias("gone"))).alias("of"))
    rows = td.table(spark, sf, "orders").select(
        "o_orderkey", facts.alias("facts"), F.create_map(F.lit("at"), F.array(clock)).alias("times"),
        F.concat(F.lit("DAL"), (F.col("o_orderkey") % 1000).cast("string")).alias("flight"))
    return flat(text.harvest_nested(rows, "o_orderkey"))


# Each document is checked against its own row: identifier, size and language.
@query("t05_grounding", r"""
SELECT d.doc_id, CASE WHEN words=0 THEN 1 ELSE CAST(words>200 AS INT)+len(list_distinct(regexp_extract_all(text,'\b[a-z]+(?:_[a-z0-9]+)+\b')))+coalesce(bad,0) END AS reasons FROM (
 SELECT doc_id, text, len(list_filter(regexp_split_to_array(text,'\s+'), lambda w: w<>'')) AS words FROM documents) d
LEFT JOIN (SELECT doc_id, count(*) AS bad FROM (
  SELECT doc_id, n_chars, unnest(regexp_extract_all(text,'""" + _NUM + r"""',1)) AS raw FROM documents) n
  WHERE abs(CAST(replace(raw,',','') AS DOUBLE)-doc_id)>=0.051 AND abs(CAST(replace(raw,',','') AS DOUBLE)-n_chars)>=0.051 GROUP BY 1) b ON b.doc_id=d.doc_id""")
def grounded(spark, sf):
    docs = td.table(spark, sf, "documents")
    cells = docs.select("doc_id", F.explode(F.array(F.col("doc_id").cast("string"), F.col("n_chars").cast("string"), "lang")).alias("cell"))
    checked = text.check_grounded(docs, text.harvest(cells, "doc_id", "cell"), "doc_id", "text", 200)
    return flat(checked.select("doc_id", F.size("reasons").alias("reasons")))


# Answers that cite their source, another file, or nothing.
@query("t06_citations", """
SELECT doc_id, CASE doc_id%3 WHEN 1 THEN 'cited other.md, which was not returned' ELSE 'cites no returned passage' END AS problem FROM documents WHERE doc_id%3>0""")
def citations(spark, sf):
    docs = td.table(spark, sf, "documents")
    ref = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" See "), F.col("source"), F.lit(".md §Intro"))).when(
        F.col("doc_id") % 3 == 1, " See other.md §Intro").otherwise("")
    answers = docs.select("doc_id", F.concat("text", ref).alias("answer"))
    sources = docs.select("doc_id", F.concat(F.lit("docs/"), F.col("source"), F.lit(".md §Intro")).alias("source"))
    return flat(text.citation_problems(answers, sources, "doc_id"))


@query("t09_quotes", r"""
SELECT doc_id, CAST(list_has_any([true], list_transform(regexp_extract_all(a,'"([^"\n]{12,})"',1), lambda q: contains(e, trim(regexp_replace(q,'\s+',' ','g'))))) AS INT) AS grounded FROM (
 SELECT doc_id, trim(regexp_replace(text,'\s+',' ','g')) AS e, 'It says "'||regexp_extract(regexp_replace(text,'["`]',' ','g'),'[^\n]{40,60}')||CASE WHEN doc_id%2=0 THEN ' zzz' ELSE '' END||'" here' AS a FROM documents) q""")
def quotes(spark, sf):
    docs = td.table(spark, sf, "documents")
    line = F.regexp_extract(F.regexp_replace("text", '["`]', " "), r"[^\n]{40,60}", 0)
    answer = F.concat(F.lit('It says "'), line, F.when(F.col("doc_id") % 2 == 0, " zzz").otherwise(""), F.lit('" here'))
    return flat(docs.select("doc_id", text.quote_is_grounded(answer, F.col("text")).alias("grounded")))


# The twin spells out the word borders, which its engine knows for ASCII only.
_EDGE, _EDGE_DOT = r"[^\p{L}\p{N}_]", r"[^\p{L}\p{N}_.]"


@query("t10_meaning", f"""
SELECT conv_id, turn, CAST(regexp_matches(text,'(?:^|{_EDGE})(?:the|die|le){_EDGE_DOT}(?:[^.]*{_EDGE_DOT})?(?:and|und|et)(?:{_EDGE}|$)')
 AND NOT regexp_matches(text,'(?:^|{_EDGE})(?:with|mit|dans)(?:{_EDGE}|$)') AS INT) AS misses FROM conversations""")
def meaning(spark, sf):
    return flat(td.table(spark, sf, "conversations").select("conv_id", "turn", text.misses_meaning(
        F.col("text"), r"(?U)\b(the|die|le)\b[^.]*\b(and|und|et)\b", r"(?U)\b(with|mit|dans)\b").alias("misses")))


_HASH = "sha256(CAST(doc_id AS VARCHAR)||chr(0)||text||chr(0))"


@query("t02_fingerprint", "SELECT n, substr(sha256(concat_ws(':',n,p0,p1,p2,p3)),1,16) AS fingerprint FROM (SELECT count(*) AS n, " + ", ".join(
    f"sum(('0x'||substr({_HASH},{1 + 16 * i},15))::BIGINT::HUGEINT) AS p{i}" for i in range(4)) + " FROM documents) q")
def fingerprint(spark, sf):
    return text.fingerprint(td.table(spark, sf, "documents"), "doc_id", "text")


# Conversations as a golden set: the tools of a conversation are taken from its turns.
part("gd_call", "SELECT conv_id AS id, 'tool_'||(turn%5) AS tool, role='system' AS pre FROM conversations")
part("gd_item", """
SELECT conv_id AS id, arg_max(text,turn) AS answer, max(turn) AS turns, conv_id%11=0 AS app_only, conv_id%7=0 AS strict,
 CASE WHEN conv_id%5=0 THEN 'der' END AS mention, CASE WHEN conv_id%2=0 THEN ['the','die'] END AS must FROM conversations GROUP BY conv_id
""")
part("gd_score", """
SELECT i.id, (NOT strict AND list_has_any(own_all,['tool_1','tool_9']) AND NOT list_has_any(own_all,['tool_4'])) OR (strict AND len(own)=0 AND list_has_any(own,['tool_1','tool_9'])) AS tools_ok,
 CASE WHEN NOT app_only THEN i.id%3<>0 END AS grounded, CASE WHEN i.id%13=0 THEN false END AS refusal_ok,
 CASE WHEN mention IS NOT NULL THEN contains(lower(answer),mention) END AS mentions_ok,
 CASE WHEN must IS NOT NULL THEN contains(lower(answer),'the') OR contains(lower(answer),'die') END AS contain_ok
FROM gd_item i JOIN (SELECT id, list(DISTINCT tool) AS own_all, coalesce(list(DISTINCT tool) FILTER (NOT pre),[]) AS own FROM gd_call GROUP BY id) c ON c.id=i.id
""")
_PASS = "tools_ok AND coalesce(grounded,true) AND coalesce(refusal_ok,true) AND coalesce(mentions_ok,true) AND coalesce(contain_ok,true)"


def golden(spark, sf):
    conv = td.table(spark, sf, "conversations")
    none = F.lit(None).cast("string")
    cid = F.col("conv_id")
    answers = conv.groupBy(cid.alias("id")).agg(F.max_by("text", "turn").alias("answer")).withColumns({
        "source": F.when(F.col("id") % 3 != 0, "llm").otherwise("fallback"), "app_only": F.col("id") % 11 == 0})
    items = conv.select(cid.alias("id")).distinct().withColumns({
        "expect_tools": F.array(F.lit("tool_1|tool_9")),
        "forbid_tools": F.when(F.col("id") % 7 == 0, F.array(F.lit("*"))).otherwise(F.array(F.lit("tool_4"))),
        "refusal": F.col("id") % 13 == 0, "mention": F.when(F.col("id") % 5 == 0, F.lit("der")).otherwise(none),
        "must_contain_any": F.when(F.col("id") % 2 == 0, F.array(F.lit("the"), F.lit("die")))})
    calls = conv.select(cid.alias("id"), F.concat(F.lit("tool_"), (F.col("turn") % 5).cast("string")).alias("tool"),
                        (F.col("role") == "system").alias("prefetched"))
    return text.score_golden(items, calls, answers)


@query("t11_golden_scores", with_parts(f"""
SELECT id, CAST(tools_ok AS INT) AS tools_ok, CAST(grounded AS INT) AS grounded, CAST(refusal_ok AS INT) AS refusal_ok, CAST(mentions_ok AS INT) AS mentions_ok,
 CAST(contain_ok AS INT) AS contain_ok, CAST({_PASS} AS INT) AS pass FROM gd_score"""))
def golden_scores(spark, sf):
    return flat(golden(spark, sf))


@query("t11_pass_rates", with_parts(" UNION ALL ".join(
    f"SELECT '{c}' AS \"check\", count(*) FILTER ({e}) AS passed, count({e}) AS items FROM gd_score" for c, e in
    [("pass", _PASS)] + [(c, c) for c in ("tools_ok", "grounded", "refusal_ok", "mentions_ok", "contain_ok")])))
def rates(spark, sf):
    return flat(text.pass_rates(golden(spark, sf)))


@query("t12_endpoint_summary", """
SELECT l_returnflag AS endpoint, count(*) FILTER (l_linestatus='F') AS passed, count(*) AS calls, count(*) FILTER (l_discount<=0.01) AS errors,
 round(median(l_extendedprice/1000) FILTER (l_discount>0.01),6) AS latency_p50,
 round(list_sort(list(l_extendedprice/1000) FILTER (l_discount>0.01))[1+least(count(*) FILTER (l_discount>0.01)-1, CAST(floor(0.95*count(*) FILTER (l_discount>0.01)) AS BIGINT))],6) AS latency_p95,
 round(median(l_quantity) FILTER (l_quantity>0),6) AS tokens_p50 FROM lineitem GROUP BY 1""")
def endpoints(spark, sf):
    results = td.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("endpoint"), (F.col("l_linestatus") == "F").alias("passed"), (F.col("l_discount") > 0.01).alias("ok"),
        (F.col("l_extendedprice") / 1000).alias("latency_s"), F.col("l_quantity").alias("tokens"))
    return flat(text.endpoint_summary(results))


# The centre of each label as a query over all vectors.
@query("t03_cosine_topk", """
WITH c AS (SELECT label AS q, list(m ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS m FROM (
  SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding,1) AS pos FROM embeddings) u GROUP BY 1,2) g GROUP BY 1)
SELECT CAST(q AS BIGINT) AS query, CAST(rk AS BIGINT) AS rank, vec_id, round(s,6) AS score FROM (
 SELECT q, vec_id, s, row_number() OVER (PARTITION BY q ORDER BY round(s,9) DESC, vec_id) AS rk FROM (
  SELECT c.q, e.vec_id, list_cosine_similarity(c.v, e.embedding::DOUBLE[]) AS s FROM c CROSS JOIN embeddings e) a) b WHERE rk<=3""")
def topk(spark, sf):
    vecs = td.table(spark, sf, "embeddings")
    return flat(vectors.cosine_topk(vectors.centroids(vecs, "label", "embedding"), vecs))


@query("t01_passages")
def chunked(spark, sf):
    return flat(passages.chunk_docs(td.table(spark, sf, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), "text"))
                .groupBy("name").agg(F.count(F.lit(1)).alias("passages"), F.sum(F.length("text")).alias("chars")))


# Two loads of documents: the second one lacks some, changes some and brings some.
_IN_FIRST, _IN_SECOND = "doc_id % 17 <> 0", "doc_id % 13 <> 0"
part("t02_doc", """
SELECT 'doc'||doc_id AS name, doc_id%17<>0 AS one, doc_id%13<>0 AS two, doc_id%10=0 AS changed FROM documents
""")


def indexed(spark, sf):
    """The catalog after both loads and the second one's change set."""
    cat = Catalog(spark, fresh_path(spark, "index"))
    docs = td.table(spark, sf, "documents").withColumn("name", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    passages.update_index(cat, docs.where(_IN_FIRST).select("name", "text"), 1)
    edited = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("\n\nOne more paragraph of twelve words or more, so that it is a passage."))).otherwise(F.col("text"))
    return cat, passages.update_index(cat, docs.where(_IN_SECOND).select("name", edited.alias("text")), 2), docs.select("name", edited.alias("text"))


@query("t02_change_set", with_parts("""
SELECT name, CASE WHEN NOT one THEN 'insert' WHEN NOT two THEN 'delete' WHEN changed THEN 'replace' ELSE 'keep' END AS action FROM t02_doc WHERE one OR two"""))
def change_set(spark, sf):
    return indexed(spark, sf)[1].select("name", "action")


@query("t02_live_loads", with_parts("""
SELECT name, CAST(CASE WHEN NOT one OR changed THEN 2 ELSE 1 END AS BIGINT) AS load FROM t02_doc WHERE two"""))
def live_loads(spark, sf):
    cat, _, _ = indexed(spark, sf)
    docs = cat.read("passage_docs")
    return flat(docs.where("at_load = 2 AND name IS NOT NULL").select("name", "load"))


@query("t02_index_equals_rebuild", with_parts("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS rewritten_unchanged"))
def index_equals_rebuild(spark, sf):
    """Passages of the index against those cut from all documents of the second load at once, and what load 2 wrote for unchanged documents."""
    cat, changes, docs = indexed(spark, sf)
    key = F.xxhash64("name", "source", "pos", "text").alias("k")
    whole = passages.chunk_docs(docs.where("CAST(substr(name, 4) AS BIGINT) % 13 <> 0")).select(key)
    live = passages.current_passages(cat).select(key)
    kept = changes.where("action = 'keep'").select("name")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return flat(n(whole.exceptAll(live), "missing").crossJoin(n(live.exceptAll(whole), "extra")).crossJoin(
        n(cat.read_load("passages", 2).join(kept, "name", "left_semi"), "rewritten_unchanged")))
