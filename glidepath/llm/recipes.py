"""Exact duplicates by content-defined chunks: a text becomes the ordered list of its chunks' verified identifiers.

DataFrame functions only. Chunk texts move once, to be told apart; after that only identifiers do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glidepath.llm.common import partitions, stored

#: A word with the white space after it, in pieces of at most 64 characters each; the pieces of a text put together are the text.
PIECE = r"(?s)\S{1,64}\s{0,64}|\s{1,64}"
#: Groups with over 1/SHARE of all rows are dealt over salts; there are fewer than SHARE of them.
SHARE = 1000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def chunks(text: Column, every: int = 128, most: int = 1024) -> Column:
    """The chunks of a text, in order: a chunk ends after a piece whose hash is a multiple of `every`, after `most` pieces at the latest.

    Where a chunk ends depends on its own last piece only, so an edit changes the chunks it touches. Null and empty texts have none.
    """
    def cut(pieces: Column) -> Column:
        size = F.size(pieces)
        last = F.filter(F.sequence(F.lit(1), size), lambda i: (F.xxhash64(F.get(pieces, i - 1)) % every == 0) | (i == size))

        def between(ends: Column) -> Column:
            return F.flatten(F.transform(ends, lambda end, i: _let(
                F.coalesce(F.get(ends, i - 1), F.lit(0)), lambda start: F.transform(
                    F.sequence(start, end - 1, F.lit(most)), lambda at: F.array_join(F.slice(pieces, at + 1, F.least(F.lit(most), end - at)), "")))))

        return F.when(size > 0, _let(last, between)).otherwise(F.array().cast("array<string>"))

    return _let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0)), cut)


def _hash(chunk: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits)


def _with_recipes(rows: DataFrame, bits: int) -> DataFrame:
    """`rows` (text and others) with `recipe` in place of the text: equal exactly for equal texts.

    The hash of a chunk is its identifier once the table of different chunks shows that no other chunk has it. Where two chunks share
    one, the identifier is the hash with the chunk itself.
    """
    listed = rows.withColumn("_chunks", chunks(F.col("text")))
    different = listed.select(F.explode("_chunks").alias("chunk")).select(_hash(F.col("chunk"), bits).alias("hash"), "chunk").distinct()
    shared = stored(different.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"), "recipes-shared")
    if shared.isEmpty():
        return listed.withColumn("recipe", F.transform("_chunks", lambda c: _hash(c, bits))).drop("text", "_chunks")
    # Two chunks in 64 bits: some hundreds of cases in 10^11 chunks. Only then do chunks go to rows of their own.
    rest = [c for c in rows.columns if c != "text"]
    single = listed.select(*rest, F.posexplode_outer("_chunks").alias("_pos", "_chunk")).withColumn("hash", _hash(F.col("_chunk"), bits))
    named = single.join(shared.withColumn("_shared", F.lit(True)), "hash", "left").select(
        *rest, F.struct("_pos", "hash", F.when(F.col("_shared"), F.col("_chunk")).alias("chunk")).alias("_part"))
    lists = F.filter(F.array_sort(F.collect_list("_part")), lambda p: p["_pos"].isNotNull())
    return named.groupBy(*rest).agg(F.transform(lists, lambda p: F.struct(p["hash"], p["chunk"])).alias("recipe"))


def exact_duplicates(docs: DataFrame, normalise: Callable[[Column], Column] | None = None, bits: int = 64) -> DataFrame:
    """doc_id, keep_id (of the row that stays: the largest of equal texts), group_size, kept, text_sha256 and n_chunks for each row of `docs`.

    Texts are equal if identical after `normalise` (none: as they are). `bits` of the chunk hash; fewer make clashes, which the
    identifiers resolve, so results do not depend on it. Null texts count as empty; empty texts are equal to each other. Null
    doc_ids are smaller than all others, keep_id is null only if all of a group are. Exactly one row of a group is kept, also among
    repeated rows with one doc_id. An empty table gives none. Other columns are ignored.

    A long document moves as the chunks that no other row of its partition has, once. Equal recipes are counted within each partition
    first; rows find their group by a join in which groups with over 1/1,000 of all rows (known by at most 1,000 hashes, which are
    broadcast) are dealt over as many salts as there are partitions.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (normalise(text) if normalise else text).alias("text")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumn("text_sha256", F.sha2("text", 256))
    narrow = stored(_with_recipes(rows, bits).withColumn("_rh", F.xxhash64("recipe")), "recipes")
    groups = stored(narrow.groupBy("_rh", "recipe").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "_row")).alias("_keep"))
                    .filter("group_size > 1"), "recipe-groups")
    total = narrow.count()
    salts = partitions(docs.sparkSession)
    hot = F.broadcast(groups.filter(F.col("group_size") * SHARE > total).select("_rh").distinct().withColumn("_hot", F.lit(True)))
    # All groups with a hot hash stand at each salt, also a small one that shares it.
    at = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted = groups.join(hot, "_rh", "left").withColumn("_salt", F.explode(at)).drop("_hot")
    dealt = narrow.join(hot, "_rh", "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    out = dealt.join(salted, ["_rh", "recipe", "_salt"], "left")
    alone = F.col("_keep").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("_keep.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
                      (alone | (F.col("_keep._row") == F.col("_row"))).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"))
