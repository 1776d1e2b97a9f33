"""Evidence and text checks over tables of texts: values, citations, quotes, golden sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glidepath.operators.quantiles import exact_quantiles

# Patterns of the values a text may state. (?U) makes the classes Unicode-aware.
CALLSIGN = r"(?U)\b[A-Z]{2,4}\d{1,4}[A-Z]{0,2}\b"
TIME = r"(?U)\b\d{1,2}:\d{2}\b"
KEY_NAME = r"(?U)\b[a-z]+(?:_[a-z0-9]+)+\b"
NUMBER = r"(?U)(?<![\w.])\d+(?:,\d{3})*(?:\.\d+)?"
ISO_STAMP = r"(?U)(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2})"
WHOLE_NUMBER = r"^-?\d+(?:\.\d+)?$"
WHOLE_TIME = r"^\d{1,2}:\d{2}$"
FULL_STAMP = r"(?U)(?:(?<date>\d{4}-\d{2}-\d{2})[T ])?(?<![\d:])(?<h>\d{1,2}):(?<m>\d{2}):\d{2}(?:\.\d+)?Z?"
HOUR_MINUTE = r"\d{1,2}:\d{2}"
CITATION = r"([A-Za-z0-9_]+\.md)(?:\s*§\s*([^)\];,\n]+))?"
QUOTE = "\"([^\"\\n]{12,})\"|`([^`\\n]{12,})`"
COLOR_CODE = r"\x1b\[[0-9;]*m|\[[0-9;]*m"

# Words that mark a declined answer.
REFUSAL = ["can't", "cannot", "can not", "unable", "not able", "only help", "can only", "i can answer", "outside", "not something i",
           "i'm sorry", "i am sorry", "i can help with", "don't have the ability", "can't share", "cannot share", "not able to share"]

# A sentence about landings today must say that it counts what was seen.
TODAY_TRIGGER = r"(?iU)\b(landed|landings|arrivals?|arrived)\b[^.]*\btoday\b|\btoday\b[^.]*\b(landed|landings|arrived)\b"
TODAY_QUALIFIER = r"(?iU)\b(seen|observed|saw)\b"

NUMBER_TOLERANCE = 0.051


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _number(token: Column) -> Column:
    return F.replace(token, F.lit(","), F.lit("")).try_cast("double")


def _clock(token: Column) -> Column:
    """`H:MM` with two digits for the hour."""
    return F.lpad(token, 5, "0")


def _values(kind: str, tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token")))


def _staged(rows: DataFrame, source: str, stamps: bool) -> DataFrame:
    """Adds `_t0`..`_t3`: the text, then without stamps, callsigns and times. Each stage is its own
    column, so a text is rewritten once per stage; a text without any digit is left alone."""
    def without(column: str, pattern: str, by: str = " ") -> Column:
        return F.when(F.col("_digit"), F.regexp_replace(column, pattern, by)).otherwise(F.lit(""))
    t = rows.withColumn("_t0", F.coalesce(F.col(source).cast("string"), F.lit("")))
    t = t.withColumn("_digit", F.col("_t0").rlike(r"(?U)\d"))
    t = t.withColumn("_t1", without("_t0", FULL_STAMP, r" ${date} ") if stamps else F.when(F.col("_digit"), F.col("_t0")).otherwise(""))
    return t.withColumn("_t2", without("_t1", CALLSIGN)).withColumn("_t3", without("_t2", TIME))


def prose_values() -> Column:
    """Array of `kind, token` stated in free text: callsigns, then times, then numbers."""
    return F.concat(_values("callsign", _all(F.col("_t1"), CALLSIGN)),
                    _values("time", F.transform(_all(F.col("_t2"), TIME), _clock)), _values("number", _all(F.col("_t3"), NUMBER)))


def harvest(evidence: DataFrame, key: str, cell: str) -> DataFrame:
    """Allowed values `key, kind, number, token` from one text cell per row.

    A cell that is a number or a time is that value; an ISO stamp gives its time and date parts;
    any other cell is read as prose. A number also allows its rounding.
    """
    rows = _staged(evidence.select(key, F.trim(F.col(cell).cast("string")).alias("_cell")), "_cell", stamps=False)
    s = F.col("_t1")
    rows = rows.withColumn("_iso", _all(s, ISO_STAMP))
    stamps = F.col("_iso")
    parts = F.flatten(F.transform(stamps, lambda x: F.array(F.substr(x, F.lit(1), F.lit(4)), F.substr(x, F.lit(6), F.lit(2)),
                                                           F.substr(x, F.lit(9), F.lit(2)))))
    clocks = F.transform(stamps, lambda x: F.substr(x, F.lit(12), F.lit(5)))
    found = (F.when(s.rlike(WHOLE_NUMBER), _values("number", F.array(s)))
             .when(s.rlike(WHOLE_TIME), _values("time", F.array(_clock(s))))
             .when(F.size(stamps) > 0, F.concat(_values("time", clocks), _values("number", parts)))
             .otherwise(prose_values()))
    rows = rows.where("_digit").select(F.col(key), F.explode(F.array_distinct(F.concat(found, _values("callsign", _all(s, CALLSIGN))))).alias("v"))
    plain = rows.select(key, "v.kind", "v.token", F.when(F.col("v.kind") == "number", F.abs(_number(F.col("v.token")))).alias("number"))
    both = F.when(F.col("kind") == "number", F.array("number", F.rint("number"))).otherwise(F.array(F.lit(None).cast("double")))
    return plain.select(key, "kind", F.explode(both).alias("number"), F.when(F.col("kind") != "number", F.col("token")).alias("token")).distinct()


def cells(value: Column, kind: T.DataType) -> Column:
    """All scalars inside a value as an array of texts, however structs, arrays and maps nest; nulls give none."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StructType):
        found = F.concat(none, *[cells(value.getField(f.name), f.dataType) for f in kind.fields])
    elif isinstance(kind, T.ArrayType):
        found = F.flatten(F.transform(value, lambda x: cells(x, kind.elementType)))
    elif isinstance(kind, T.MapType):
        found = F.flatten(F.transform(F.map_values(value), lambda x: cells(x, kind.valueType)))
    else:
        found = F.array_compact(F.array(value.cast("string")))
    return F.coalesce(found, none)


def harvest_nested(evidence: DataFrame, key: str) -> DataFrame:
    """Allowed values, as `harvest`, from all columns but `key`, of any nesting."""
    every = F.concat(*[cells(F.col(f"`{f.name}`"), f.dataType) for f in evidence.schema.fields if f.name != key])
    return harvest(evidence.select(key, F.explode(every).alias("_nested")), key, "_nested")


def stated_values(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Values a text states: `key, stage, pos, kind, shown, token, number`, in the order of the check."""
    rows = _staged(texts.select(key, F.col(text).alias("_text")), "_text", stamps=True).where("_digit")

    def stage(n: int, kind: str, tokens: Column, token) -> Column:
        return F.transform(tokens, lambda x, i: F.struct(F.lit(n).alias("stage"), i.alias("pos"), F.lit(kind).alias("kind"),
                                                         x.alias("shown"), token(x).alias("token")))
    every = F.concat(
        stage(1, "time", _all(F.col("_t0"), FULL_STAMP), lambda x: _clock(_all(x, HOUR_MINUTE)[0])),
        stage(2, "callsign", _all(F.col("_t1"), CALLSIGN), lambda x: x),
        stage(3, "time", _all(F.col("_t2"), TIME), _clock),
        stage(4, "number", _all(F.col("_t3"), NUMBER), lambda x: x))
    found = rows.select(F.col(key), F.explode(every).alias("v")).select(key, "v.*")
    return found.withColumn("number", F.when(F.col("kind") == "number", _number(F.col("token"))))


def _bucket(x: Column) -> Column:
    return F.floor(x * 10).cast("bigint")


def ungrounded(stated: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Stated values that no allowed value of the same key backs.

    Numbers match within a tolerance below a tenth: allowed numbers are repeated in the
    neighbouring tenths, so the comparison is an equi-join.
    """
    words = stated.where(F.col("kind") != "number").join(
        allowed.where(F.col("kind") != "number").select(key, "kind", "token"), [key, "kind", "token"], "left_anti")
    near = (allowed.where(F.col("kind") == "number").select(key, F.col("number").alias("_n"))
            .withColumn("_b", F.explode(F.sequence(_bucket(F.col("_n")) - 1, _bucket(F.col("_n")) + 1))))
    s = stated.where(F.col("kind") == "number").withColumn("_b", _bucket(F.col("number"))).alias("s")
    close = (F.col(f"s.{key}") == F.col(f"a.{key}")) & (F.col("s._b") == F.col("a._b")) & (
        F.abs(F.col("s.number") - F.col("a._n")) < NUMBER_TOLERANCE)
    numbers = s.join(near.alias("a"), close, "left_anti").drop("_b")
    return words.select(stated.columns).unionByName(numbers.select(stated.columns))


def check_grounded(texts: DataFrame, allowed: DataFrame, key: str, text: str, max_words: int, source: str = "facts") -> DataFrame:
    """One row per text: `passed` and the reasons, in a fixed order."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
    keys = F.array_sort(F.array_distinct(_all(t, KEY_NAME)))
    blank = words == 0
    first = F.when(blank, F.array(F.lit("empty text"))).otherwise(F.concat(
        F.when(words > max_words, F.array(F.concat(words.cast("string"), F.lit(f" words > {max_words}")))).otherwise(F.array()),
        F.transform(keys, lambda k: F.concat(F.lit("key name "), k, F.lit(" in text")))))
    bad = ungrounded(stated_values(texts, key, text), allowed, key)
    reason = F.struct("stage", "pos", F.concat_ws(" ", "kind", "shown", F.lit(f"not in {source}")).alias("r"))
    later = bad.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(reason)), lambda x: x["r"]).alias("_later"))
    both = texts.select(key, first.alias("_first")).join(later, key, "left")
    reasons = F.concat("_first", F.coalesce("_later", F.array().cast("array<string>")))
    return both.select(key, (F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"))


def citation_problems(answers: DataFrame, sources: DataFrame, key: str, answer: str = "answer") -> DataFrame:
    """Answers with returned passages (`key, source`) that cite none of them, or cite another file."""
    files = sources.select(key, F.element_at(F.split(F.element_at(F.split("source", " §"), 1), "/"), -1).alias("file")).distinct()
    with_results = answers.join(files.select(key).distinct(), key, "left_semi")
    cited = with_results.select(key, F.array_distinct(_all(F.col(answer), CITATION, 1)).alias("_c"))
    none = cited.where(F.size("_c") == 0).select(key, F.lit("cites no returned passage").alias("problem"))
    wrong = (cited.select(key, F.explode("_c").alias("file")).join(files, [key, "file"], "left_anti")
             .select(key, F.concat(F.lit("cited "), F.col("file"), F.lit(", which was not returned")).alias("problem")))
    return none.unionByName(wrong)


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def plain(text) -> Column:
    """Text without terminal colour codes."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), COLOR_CODE, "")


def quote_is_grounded(answer: Column, evidence: Column) -> Column:
    """Whether a quote of at least 12 characters in the answer occurs in the evidence."""
    quotes = _all(F.coalesce(answer, F.lit("")), QUOTE)
    inner = F.transform(quotes, lambda q: _one_line(F.substr(q, F.lit(2), F.length(q) - 2)))
    where = _one_line(plain(evidence))
    return F.exists(inner, lambda q: F.contains(where, q))


def misses_meaning(text: Column, trigger: str = TODAY_TRIGGER, required: str = TODAY_QUALIFIER) -> Column:
    """Whether a text has a trigger sentence but not the wording it requires."""
    return text.rlike(trigger) & ~text.rlike(required)


def fingerprint(df: DataFrame, name: str, text: str) -> DataFrame:
    """One row: a hash of all (name, text) pairs that does not depend on their order.

    Each pair is hashed on its own and the parts of the hashes are summed exactly, so nothing is
    collected and the sums combine before the shuffle.
    """
    h = F.sha2(F.concat(F.col(name).cast("string"), F.lit("\x00"), F.coalesce(F.col(text), F.lit("")), F.lit("\x00")), 256)
    parts = df.select(*[F.conv(F.substr(h, F.lit(1 + 16 * i), F.lit(15)), 16, 10).cast("decimal(20,0)").alias(f"p{i}") for i in range(4)])
    one = parts.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"p{i}").cast("decimal(38,0)").alias(f"p{i}") for i in range(4)])
    return one.select("n", F.substr(F.sha2(F.concat_ws(":", "n", *[F.col(f"p{i}").cast("string") for i in range(4)]), 256),
                                    F.lit(1), F.lit(16)).alias("fingerprint"))


def score_golden(items: DataFrame, calls: DataFrame, answers: DataFrame, refusal_words=tuple(REFUSAL)) -> DataFrame:
    """Scores answers against expectations.

    `items`: `id, expect_tools, forbid_tools` (arrays; `a|b` means either, `*` means any tool),
    `refusal`, `must_contain_any` (array or null), `mention` (value or null). `calls`: `id, tool,
    prefetched`. `answers`: `id, answer, source, app_only`.
    """
    tools = calls.groupBy("id").agg(F.collect_set("tool").alias("_all"), F.collect_set(F.when(~F.col("prefetched"), F.col("tool"))).alias("_own"))
    none = F.array().cast("array<string>")
    rows = (items.join(answers, "id").join(tools, "id", "left")
            .withColumns({"_all": F.coalesce("_all", none), "_own": F.coalesce("_own", none),
                          "expect_tools": F.coalesce("expect_tools", none), "forbid_tools": F.coalesce("forbid_tools", none)}))
    strict = F.array_contains("forbid_tools", "*")
    called = F.when(strict, F.col("_own")).otherwise(F.col("_all"))
    wanted = F.forall("expect_tools", lambda w: F.arrays_overlap(F.split(w, r"\|"), F.col("_called")))
    allowed = F.when(strict, F.size("_called") == 0).otherwise(~F.arrays_overlap("_called", "forbid_tools"))
    said = F.lower("answer")
    refused = F.exists(F.array(*[F.lit(r) for r in refusal_words]), lambda r: F.contains(said, r))
    contains = F.exists("must_contain_any", lambda m: F.contains(said, F.lower(m)))
    scored = rows.withColumn("_called", called).select(
        "id", (wanted & allowed).alias("tools_ok"), F.when(~F.col("app_only"), F.col("source") == "llm").alias("grounded"),
        F.when(F.col("refusal"), refused).alias("refusal_ok"),
        F.when(F.col("mention").isNotNull(), F.contains(said, F.lower("mention"))).alias("mentions_ok"),
        F.when(F.size("must_contain_any") > 0, contains).alias("contain_ok"))
    checks = ["tools_ok", "grounded", "refusal_ok", "mentions_ok", "contain_ok"]
    return scored.withColumn("pass", F.forall(F.array(*checks), lambda v: F.coalesce(v, F.lit(True))))


def pass_rates(scored: DataFrame) -> DataFrame:
    """Passed and applicable items of each check."""
    checks = ["pass", "tools_ok", "grounded", "refusal_ok", "mentions_ok", "contain_ok"]
    one = scored.agg(*[F.count_if(F.col(c)).alias(f"{c}_p") for c in checks], *[F.count(c).alias(f"{c}_n") for c in checks])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"{c}_p").alias("passed"), F.col(f"{c}_n").alias("items"))
                                         for c in checks])))


def endpoint_summary(results: DataFrame) -> DataFrame:
    """Per endpoint: passes, calls, errors, median and p95 latency of good calls, median tokens.

    The p95 is the element at index int(0.95 n) of the sorted latencies.
    """
    good = results.where("ok")
    mid = exact_quantiles(good, ["endpoint"], "latency_s", [0.5]).select("endpoint", F.col("q")[0].alias("latency_p50"))
    high = exact_quantiles(good, ["endpoint"], "latency_s", [0.95], at_index=True).select("endpoint", F.col("q")[0].alias("latency_p95"))
    tokens = exact_quantiles(results.where(F.col("tokens") > 0), ["endpoint"], "tokens", [0.5]).select(
        "endpoint", F.col("q")[0].alias("tokens_p50"))
    counts = results.groupBy("endpoint").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("calls"),
                                             F.count_if(~F.col("ok")).alias("errors"))
    return counts.join(mid, "endpoint", "left").join(high, "endpoint", "left").join(tokens, "endpoint", "left")
