"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Kinds: e-mail and IPv4 addresses, card, phone and social-security numbers, and names after a title that tells the gender.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glidepath.llm.common import stored

# Titles by gender, and names to choose from by gender and script.
MALE_TITLES = ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Г-н", "Господин"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Г-жа", "Госпожа"]
FIRST = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Noah", "Oscar", "Paul"],
    ("f", "latin"): ["Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Karen", "Laura", "Maria", "Nora", "Olivia", "Paula"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Степан"],
    ("f", "cyrillic"): ["Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса"],
}
LAST = {
    "latin": ["Abel", "Baker", "Carver", "Dalton", "Eaton", "Fisher", "Garner", "Hatcher", "Irving", "Jansen", "Keller", "Lambert", "Mercer", "Norton", "Osborn", "Parker"],
    ("m", "cyrillic"): ["Белов", "Волков", "Громов", "Жуков", "Зимин", "Ильин", "Козлов", "Лапин", "Минин", "Носов", "Орлов", "Панов", "Рыбин", "Сомов", "Титов", "Фомин"],
    ("f", "cyrillic"): ["Белова", "Волкова", "Громова", "Жукова", "Зимина", "Ильина", "Козлова", "Лапина", "Минина", "Носова", "Орлова", "Панова", "Рыбина", "Сомова", "Титова", "Фомина"],
}
_TITLE = "(?:" + "|".join(sorted(MALE_TITLES + FEMALE_TITLES, key=len, reverse=True)) + r")\.?"
_NAME = r"\p{Lu}[\p{L}'’-]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    # Labels up to the number that names may have, or the whole of a longer run: loops of either kind take no stack per round.
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-]++(?:\.[\p{L}\p{N}_%+-]++)*+@(?:(?:[A-Za-z0-9-]++\.(?=[A-Za-z0-9])){127,}+[A-Za-z0-9-]*+"
             r"|(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.){1,126}[A-Za-z]{2,})",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)"
             r"|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])",
    "card": r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_TITLE}\x20{_NAME}(?:\x20{_NAME})?",
}
KINDS = list(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text must hold for any pattern to match; cheap, and most texts hold none.
TRIGGER = rf"@|\d|{_TITLE}\x20\p{{Lu}}"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
ACCENTED = "àáâäçèéêëìíîïñòóôöùúûü"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
#: First and number of the characters that stand for one of a script without capitals or without an alphabet here.
IDEOGRAPHS = (0x4E00, 20_000)
#: After so many attempts a stand-in takes a longer or wider form, as its own may have no free one left.
WIDER = 8


def kind_of(entity: Column) -> Column:
    return F.coalesce(*[F.when(entity.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)) for k in KINDS])


def canonical(kind: Column, entity: Column) -> Column:
    """What all writings of one entity share: digits of numbers, lower case of addresses and names, without the title's full stop."""
    digits = F.regexp_replace(entity, r"\D", "")
    number = F.concat(F.when(entity.startswith("+"), "+").otherwise(""), digits)
    return F.when(kind.isin("phone", "card", "ssn"), number).when(kind == "name", F.regexp_replace(F.lower(entity), r"^(\S+?)\.? ", "$1 ")).otherwise(F.lower(entity))


def name_parts(canon: Column) -> tuple[Column, Column]:
    """What a canonical name goes by: its family name, and its first name if it has one; each with gender and script where they decide its form.

    Short and full forms share the family part, whatever the title, so `Mr John Smith`, `Mr. Smith` and `Mrs Smith` agree in it.
    """
    female = F.regexp_extract(canon, r"^\S+", 0).isin([t.lower() for t in FEMALE_TITLES])
    gender = F.when(female, "f").otherwise("m")
    words = F.split(canon, " ")
    of = lambda word: F.when(word.rlike(r"\p{IsCyrillic}"), F.concat(F.lit("c"), gender, F.lit(":"), word))
    family, first = F.element_at(words, -1), F.get(words, 1)
    return of(family).otherwise(F.concat(F.lit("l:"), family)), F.when(F.size(words) > 2, of(first).otherwise(F.concat(F.lit("l"), gender, F.lit(":"), first)))


def _seed(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """A keyed digest of an entity and an attempt: all that stand-ins are made from, so that a long entity is hashed once."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string")), 256)


def _number(seed: Column, place) -> Column:
    """A number below 2**24 for a place in an entity."""
    place = F.lit(place) if isinstance(place, int) else place
    at = (place % 10 * 6 + 1).cast("int")
    return F.conv(F.substr(F.sha2(F.concat_ws("\x1f", seed, F.floor(place / 10).cast("string")), 256), at, F.lit(6)), 16, 10).cast("long")


def _pick(values: str | list[str], number: Column) -> Column:
    if isinstance(values, str):
        return F.substr(F.lit(values), (number % len(values) + 1).cast("int"), F.lit(1))
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _letters(seed: Column, canon: Column) -> Column:
    """Each letter or digit becomes one of its own alphabet (a letter of a script that is not listed: an ideograph, if the script has no
    capitals, else a Latin letter); the top-level domain and signs stay."""
    last = F.length(canon) - F.length(F.regexp_extract(canon, r"\.[a-z]+$", 0))

    def one(c, i, fixed):
        n = _number(seed, i)
        swapped = F.when(c.rlike("^[0-9]$"), _pick("0123456789", n))
        for alphabet in (LOWER, CYRILLIC, ACCENTED, GREEK):
            swapped = swapped.when(F.instr(F.lit(alphabet), c) > 0, _pick(alphabet, n))
        point = F.lpad(F.hex(n % IDEOGRAPHS[1] + IDEOGRAPHS[0]), 4, "0")
        swapped = swapped.when(c.rlike(r"^\p{Lo}$"), F.decode(F.unhex(point), "UTF-16BE")).when(c.rlike(r"^\p{L}$"), _pick(LOWER, n))
        swapped = swapped.when(c.rlike(r"^\p{N}$"), _pick("0123456789", n))
        return F.when(i >= fixed, c).otherwise(swapped.otherwise(c))

    # The place where the domain's last part begins is worked out once, not for every character.
    return F.array_join(F.get(F.transform(F.array(last), lambda fixed: F.transform(F.split(canon, ""), lambda c, i: one(c, i, fixed))), 0), "")


def _digits(seed: Column, canon: Column, keep_first: Column) -> Column:
    size = F.length(canon)
    return F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(i < keep_first, F.substr(canon, (i + 1).cast("int"), F.lit(1)))
                                    .otherwise((_number(seed, i) % 10).cast("string"))), "")


def _extra(seed: Column, attempt: Column, values: str) -> Column:
    """One more character for every WIDER attempts, none before."""
    more = F.sequence(F.lit(1).cast("long"), F.floor(attempt / WIDER))
    return F.when(attempt < WIDER, "").otherwise(F.array_join(F.transform(more, lambda i: _pick(values, _number(seed, i + 1000))), ""))


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled, modulo 10."""
    places = F.split(F.reverse(digits), "")

    def value(c, i):
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, b: a + b) % 10


def surrogate(seed: Column, kind: Column, canon: Column, attempt: Column) -> Column:
    """A stand-in for a canonical entity, by its `_seed`, of its kind and, for the first WIDER attempts, its length; another one for every `attempt`.

    Card numbers pass or fail the Luhn check as before; octets keep their number of digits; phone
    numbers with a plus sign keep their first digit, the country or its zone; parts of names (see `name_parts`) keep gender and script, and
    get one more word for every eight attempts, so that names never run out. For the same reason the local part of
    addresses, phone and social-security numbers get one more character for every WIDER attempts, and octets take any value after them.
    """
    plus = canon.startswith("+").cast("int")
    card = _digits(seed, canon, F.lit(1))
    body = F.substr(card, F.lit(1), F.length(card) - 1)
    check = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    last = F.when(_luhn(canon) == 0, check).otherwise((check + 1 + F.substr(card, F.length(card), F.lit(1)).cast("int") % 9) % 10)
    octets = F.transform(F.split(canon, r"\."), lambda o, i: F.when(attempt >= WIDER, _number(seed, i) % 256)
                         .when(F.length(o) == 1, _number(seed, i) % 10)
                         .when(F.length(o) == 2, 10 + _number(seed, i) % 90)
                         .otherwise(100 + _number(seed, i) % 156).cast("string"))
    letters, longer = _letters(seed, canon), _extra(seed, attempt, "0123456789")
    email = F.concat(F.substring_index(letters, "@", 1), _extra(seed, attempt, LOWER), F.lit("@"), F.substring_index(letters, "@", -1))
    # Parts of names: script, gender where it matters, a colon, the word.
    female, cyrillic = canon.rlike("^.?f:"), canon.startswith("c")
    n = lambda i: _number(seed, i)
    by = lambda table, i: F.when(female & cyrillic, _pick(table("f", "cyrillic"), n(i))).when(cyrillic, _pick(table("m", "cyrillic"), n(i))) \
        .when(female, _pick(table("f", "latin"), n(i))).otherwise(_pick(table("m", "latin"), n(i)))
    joined = lambda table: F.array_join(F.transform(F.sequence(F.lit(0), F.floor(attempt / 8).cast("int")), lambda i: by(table, i)), "-")
    first, family = joined(lambda g, s: FIRST[g, s]), joined(lambda g, s: LAST.get((g, s)) or LAST[s])
    return (F.when(kind == "email", email).when(kind == "ip", F.array_join(octets, "."))
            .when(kind == "card", F.concat(body, last.cast("string")))
            .when(kind == "phone", F.concat(_digits(seed, canon, plus * 2), longer))
            .when(kind == "ssn", F.concat(_digits(seed, canon, F.lit(0)), longer))
            .otherwise(F.concat(F.regexp_extract(canon, "^[^:]*:", 0), F.lower(F.when(kind == "first", first).otherwise(family)))))


def mapping(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, stand_in: a surrogate for each entity, no two alike and none that is itself an entity of the table.

    Entities that clash try again with their next surrogate, all others keep theirs; of a clash the one with the fewest attempts stays,
    then the smallest. Rounds go on until none clashes: forms widen with the attempts, so free ones never run out. Only distinct entities are compared, by a window over equal surrogates, which are few by construction.
    """
    open_ = stored(entities.distinct().withColumn("attempt", F.lit(0)), "entities")
    while True:
        made = open_.withColumn("seed", _seed(key, F.col("kind"), F.col("canon"), F.col("attempt")))
        made = made.withColumn("stand_in", surrogate(F.col("seed"), F.col("kind"), F.col("canon"), F.col("attempt")))
        own = open_.select("kind", F.col("canon").alias("stand_in"), F.lit(-1).alias("attempt"), "canon")
        ranked = made.select("kind", "stand_in", "attempt", "canon").unionByName(own)
        turn = F.row_number().over(Window.partitionBy("kind", "stand_in").orderBy("attempt", "canon"))
        settled = stored(ranked.withColumn("clash", (turn > 1) & (F.col("attempt") >= 0)).filter("attempt >= 0"), "surrogates")
        if settled.filter("clash").isEmpty():
            return settled.select("kind", "canon", "stand_in")
        open_ = settled.select("kind", "canon", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))


def _shaped(kind: Column, entity: Column, stand_in: Column) -> Column:
    """The stand-in in the writing of the entity it replaces: separators of numbers, capitals of letters."""
    chars = F.split(entity, "")
    before = lambda i: F.length(F.regexp_replace(F.substr(entity, F.lit(1), i.cast("int")), r"\D", ""))
    digits = F.regexp_replace(stand_in, r"\D", "")
    numbers = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("^[0-9]$"), F.substr(digits, (before(i) + 1).cast("int"), F.lit(1))).otherwise(c)), "")
    numbers = F.concat(numbers, F.substr(digits, F.length(F.regexp_replace(entity, r"\D", "")) + 1))
    cased = F.array_join(F.zip_with(F.split(stand_in, ""), chars, lambda c, e: F.when(e.rlike(r"^\p{Lu}$"), F.upper(c)).otherwise(F.coalesce(c, F.lit("")))), "")
    title = F.regexp_extract(entity, r"^\S+ ", 0)
    rest = F.initcap(F.regexp_replace(stand_in, "-", " - "))
    rest = F.regexp_replace(rest, " - ", "-")
    named = F.concat(title, F.when(F.regexp_replace(entity, r"^\S+ ", "").rlike(r"^[\p{Lu}\P{L}]+$"), F.upper(rest)).otherwise(rest))
    return F.when(kind.isin("phone", "card", "ssn"), numbers).when(kind == "email", cased).when(kind == "name", named).otherwise(stand_in)


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with personal data in `text` replaced, and n_entities, how many places were.

    One entity has one surrogate in all documents and writings (same case-folded address, same digits), and two entities never share
    one. Texts that can't hold an entity pass by without a shuffle; of the others, equal texts are worked on once: their entities are
    taken out, made distinct over the corpus before anything is assigned, and joined back by entity and then by text. `key` must be
    kept secret; the same key and table give the same result.

    Null texts stay null with 0 entities; repeated rows come out alike; an empty table gives no rows; all columns stay, but for an
    n_entities of the input, which is replaced.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "n_entities"]).alias("row"), F.col("text").cast("string").alias("text"),
                       F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2"))
    may = F.coalesce(F.col("text").rlike(TRIGGER), F.lit(False))
    quiet = rows.filter(~may).select("row.*", F.lit(0).cast("long").alias("n_entities"))
    loud = rows.filter(may)
    hits = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    found = stored(loud.select("k1", "k2", hits.alias("found")).filter(F.size("found") > 0).dropDuplicates(["k1", "k2"]), "found")
    each = found.select("k1", "k2", F.explode(F.array_distinct("found")).alias("entity")).withColumn("kind", kind_of(F.col("entity")))
    each = each.withColumn("canon", canonical(F.col("kind"), F.col("entity")))
    family, first = name_parts(F.col("canon"))
    is_name = F.col("kind") == "name"
    each = each.withColumns({"part": F.when(is_name, "family").otherwise(F.col("kind")), "part_canon": F.when(is_name, family).otherwise(F.col("canon")),
                             "first_canon": F.when(is_name, first)})
    parts = each.select(F.col("part").alias("kind"), F.col("part_canon").alias("canon")).unionByName(
        each.filter(F.col("first_canon").isNotNull()).select(F.lit("first").alias("kind"), F.col("first_canon").alias("canon")))
    names = mapping(parts, key)
    word = F.regexp_replace("stand_in", "^[a-z]*:", "")
    main = names.filter("kind <> 'first'").select(F.col("kind").alias("part"), F.col("canon").alias("part_canon"), F.when(F.col("kind") == "family", word).otherwise(
        F.col("stand_in")).alias("stand_in"))
    given = names.filter("kind = 'first'").select(F.col("canon").alias("first_canon"), word.alias("given"))
    paired = each.join(main, ["part", "part_canon"]).join(given, "first_canon", "left").withColumn("stand_in", F.concat_ws(" ", "given", "stand_in"))
    paired = paired.withColumn("new", _shaped(F.col("kind"), F.col("entity"), F.col("stand_in")))
    swaps = paired.groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list(F.struct("entity", "new"))).alias("swap"))
    done = loud.join(swaps, ["k1", "k2"], "left").withColumn("hits", F.when(F.col("swap").isNotNull(), hits))
    done = done.withColumn("new", F.transform("hits", lambda e: F.col("swap")[e]))
    text = F.array_join(F.transform(F.split("text", ANY, -1), lambda p, i: F.concat(p, F.coalesce(F.get("new", i), F.lit("")))), "")
    row = F.col("row").withField("text", F.when(F.col("swap").isNotNull(), text).otherwise(F.col("text")))
    done = done.select(row.alias("row"), F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n")).select("row.*", F.greatest("n", F.lit(0)).alias("n_entities"))
    return quiet.unionByName(done)
