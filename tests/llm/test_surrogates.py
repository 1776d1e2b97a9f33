import re

import pytest
from pyspark.sql import functions as F

from glidepath.llm.surrogates import mapping, pseudonymised

TEXTS = [
    (1, "Write to anna.berg42@mail8.example.com or ANNA.BERG42@mail8.example.com, ip 42.144.35.254."),
    (2, "Card 4111 1111 1111 1111 and 4111-1111-1111-1111; other 4041894974608795. anna.berg42@mail8.example.com"),
    (3, "Call +1 (277) 555-9423 or (277) 555-9423 or 277-555-9423, SSN 123-45-6789"),
    (4, "Mr. John Smith met Mrs Jane Doe. Mr John Smith left. Г-н Иван Петров; MR nothing. Frau SCHMIDT"),
    (5, "Nothing personal: 3.14, 1999, 12:30, version 1.2.3, 50 %, a@b, John Smith"),
    (6, None), (7, ""), (None, "lone x.y@z.org"), (1, "Write to anna.berg42@mail8.example.com or ANNA.BERG42@mail8.example.com, ip 42.144.35.254."),
    (8, "anna.berg42@mail8.example.com" * 1 + " " + "word " * 50_000 + "10.0.0.1"),
]


@pytest.fixture(scope="module")
def out(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n_entities", "kind", "_k1", "found", "entity", "new")})
    got = pseudonymised(df, "k")
    assert set(got.columns) == set(df.columns)
    return {r.doc_id: r for r in got.collect()}, got.collect()


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_forms(out):
    rows, every = out
    assert len(every) == len(TEXTS)
    m = re.fullmatch(r"Write to ([a-z]{4}\.[a-z]{4}\d\d@[a-z]{4}\d\.[a-z]{7}\.com) or (\S+), ip (\d\d\.\d{3}\.\d\d\.\d{3})\.", rows[1].text)
    assert m and m[2] == m[1].split("@")[0].upper() + "@" + m[1].split("@")[1] and "berg" not in m[1]
    assert rows[1].n_entities == 3 and m[1] in rows[2].text and rows[8].text.startswith(m[1] + " word ")
    assert all(int(o) < 256 for o in m[3].split("."))
    c = re.fullmatch(r"Card (\d{4} \d{4} \d{4} \d{4}) and (\d{4}-\d{4}-\d{4}-\d{4}); other (\d{16})\. \S+", rows[2].text)
    assert c and c[1].replace(" ", "") == c[2].replace("-", "") != "4" + "1" * 15
    assert luhn(c[2].replace("-", "")) == luhn("4111111111111111") and luhn(c[3]) == luhn("4041894974608795")
    p = re.fullmatch(r"Call (\+\d \(\d{3}\) \d{3}-\d{4}) or (\(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4}), SSN (\d{3}-\d\d-\d{4})", rows[3].text)
    assert p and re.sub(r"\D", "", p[2]) == re.sub(r"\D", "", p[3]) and "555-9423" not in rows[3].text and p[4] != "123-45-6789"


def test_names(out):
    text = out[0][4].text
    m = re.fullmatch(r"Mr\. (\w+ [\w-]+) met Mrs (\w+ [\w-]+)\. Mr (\w+ [\w-]+) left\. Г-н ([А-я]+ [А-я-]+); MR nothing\. Frau ([A-Z-]+)", text)
    assert m and m[1] == m[3] != m[2]
    from glidepath.llm.surrogates import FIRST, LAST
    assert m[1].split()[0] in FIRST["m", "latin"] and m[2].split()[0] in FIRST["f", "latin"] and m[4].split()[0] in FIRST["m", "cyrillic"]
    assert m[4].split()[1] in LAST["m", "cyrillic"]


def test_clean_rows_stay(out):
    rows, every = out
    assert rows[5].text == TEXTS[4][1] and rows[5].n_entities == 0
    assert rows[6].text is None and rows[7].text == "" and rows[6].n_entities == 0
    assert "x.y@z.org" not in rows[None].text and "10.0.0.1" not in rows[8].text and rows[8].text.count("word ") == 50_000
    assert len({r.text for r in every if r.doc_id == 1}) == 1


def test_no_two_entities_share_a_surrogate(spark):
    small = spark.range(90).select(F.lit("ip").alias("kind"), F.format_string("%d.%d.1.2", F.col("id") % 10, (F.col("id") / 10).cast("int")).alias("canon"))
    names = spark.range(300).select(F.lit("family").alias("kind"), F.format_string("l:a%d", F.col("id")).alias("canon"))
    rows = mapping(small.unionByName(names), "k").collect()
    assert len(rows) == 390 and len({(r.kind, r.stand_in) for r in rows}) == 390
    assert not {r.stand_in for r in rows} & {r.canon for r in rows}


def test_documents(spark, docs):
    got = {r.doc_id: r for r in pseudonymised(docs, "k").collect()}
    again = {r.doc_id: r.text for r in pseudonymised(docs.repartition(5), "k").collect()}
    other = {r.doc_id: r.text for r in pseudonymised(docs, "other").collect()}
    assert {d: r.text for d, r in got.items()} == again != other
    pattern = r"[\w.]+@[\w.]+\.com|(?<![\d.])\d+\.\d+\.\d+\.\d+|\b\d{16}\b|\+1 \(\d{3}\) \d{3}-\d{4}"
    hits, maps = 0, {}
    for r in docs.collect():
        old, new = re.findall(pattern, r.text), re.findall(pattern, got[r.doc_id].text)
        assert len(old) == len(new) == got[r.doc_id].n_entities
        assert re.sub(pattern, "#", r.text) == re.sub(pattern, "#", got[r.doc_id].text)
        hits += len(old)
        for a, b in zip(old, new):
            assert maps.setdefault(a, b) == b != a
    assert hits and len(set(maps.values())) == len(maps)


def test_empty(empty):
    assert pseudonymised(empty, "k").count() == 0


def test_main_path_is_native(docs):
    plan = pseudonymised(docs, "k")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_full_classes_find_free_surrogates(spark):
    phones = spark.range(10_000).select(F.lit("phone").alias("kind"), F.format_string("+1%04d", "id").alias("canon"))
    digit = lambda k: (F.col("id") / 10**k).cast("long") % 10
    ips = spark.range(10_000).select(F.lit("ip").alias("kind"), F.format_string("%d.%d.%d.%d", *map(digit, range(4))).alias("canon"))
    letter = lambda c: F.char(97 + c)
    mails = spark.range(676).select(F.lit("email").alias("kind"), F.concat(letter(F.col("id") % 26), F.lit("@"), letter((F.col("id") / 26).cast("long")), F.lit(".com")).alias("canon"))
    rows = mapping(phones.unionByName(ips).unionByName(mails), "k").collect()
    assert len(rows) == 20_676 == len({(r.kind, r.stand_in) for r in rows})
    assert not {(r.kind, r.stand_in) for r in rows} & {(r.kind, r.canon) for r in rows}
    for r in rows:
        form = {"phone": r"\+1\d{5,}", "ip": r"\d{1,3}(\.\d{1,3}){3}", "email": r"[a-z]{2,}@[a-z]\.com"}[r.kind]
        assert re.fullmatch(form, r.stand_in), r
        assert r.kind != "ip" or all(int(o) < 256 for o in r.stand_in.split("."))


def test_longer_numbers_are_written_whole(spark):
    from glidepath.llm.surrogates import _shaped
    row = spark.sql("SELECT 'phone' AS k, '+1 23-45' AS e, '+1987654' AS s").select(_shaped(F.col("k"), F.col("e"), F.col("s"))).first()
    assert row[0] == "+1 98-7654"


def replaced(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pseudonymised(rows, "k").orderBy("doc_id").collect()]


def test_long_addresses_pass(spark):
    hostile = ["x@" + "a." * 3000 + "com", "x@" + "ab." * 40_000 + "com", "y@" + "a" * 50_000 + ".com", "b" * 20_000 + "@example.com", "c." * 20_000 + "c@example.com",
               "z@" + "-" * 20_000 + "a.com", "@" * 5000 + "a@b", "Mr " + "Abc-" * 5000 + "D", "+1" + " 23" * 5000, "1." * 20_000]
    out = replaced(spark, *["start " + t + " end" for t in hostile])
    for old, new in zip(hostile, out):
        assert new.startswith("start ") and new.endswith(" end")
    for n in range(5):
        assert out[n] != "start " + hostile[n] + " end" and len(out[n]) == len(hostile[n]) + 10
    assert "a.a.a.a.a." not in out[0] and "bbbbbbbb" not in out[3]


def test_every_letter_is_replaced(spark):
    texts = ["μαρία@example.com", "łukasz@ex.pl", "ßeta@ex.de", "用户名字@example.com", "דוד@example.com", "ÞÓRA@ex.is", "иван.петров@example.com"]
    for old, new in zip(texts, replaced(spark, *texts)):
        local, other = old.split("@")[0], new.split("@")[0]
        assert len(local) == len(other) and new.endswith(old[old.rindex("."):])
        kept = sum(a == b for a, b in zip(local, other))
        assert kept <= 1, (old, new)  # a letter may draw itself
    assert re.fullmatch("[\u4e00-\u9fff]{4}@.*", replaced(spark, "用户名字@example.com")[0])
    assert replaced(spark, "ÞÓRA@ex.is")[0].split("@")[0].isupper()


def test_short_and_full_names_agree(spark):
    text, other = replaced(spark, "Mr John Smith met Mr Smith, Mrs Jones, Ms Jones and Mr. Smith; Mrs Jane Jones too. Г-н Петров, Г-жа Петрова", "Mr John Baker and Mr Smith")
    m = re.fullmatch(r"Mr (\w+) ([\w-]+) met Mr ([\w-]+), Mrs ([\w-]+), Ms ([\w-]+) and Mr\. ([\w-]+); Mrs (\w+) ([\w-]+) too\. Г-н ([\w-]+), Г-жа ([\w-]+)", text)
    assert m and m[2] == m[3] == m[6] != m[4] == m[5] == m[8] and m[1] != m[7] and m[9] != m[10]
    again = re.fullmatch(r"Mr (\w+) ([\w-]+) and Mr ([\w-]+)", other)
    assert again[1] == m[1] and again[3] == m[3] and again[2] not in (m[2], m[4])
    assert not {"John", "Smith", "Jones", "Jane", "Петров", "Петрова"} & set(re.findall(r"\w+", text))


def test_edge_rows(edge, crowded):
    out = pseudonymised(crowded, "k")
    assert set(out.columns) == set(crowded.columns) and out.count() == edge.count()
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, pseudonymised(edge, "k").select("doc_id", "text").collect()))
