"""Merkle manifest of a table: one tree per group of rows, and one over the groups' roots.

Nodes lie in a table (tree, idx, digest). Each level is joined with itself on computed sibling indices, so that every node has its
siblings beside it, and the rows in slot zero emit the parents. Going down again, each node hands its path to the nodes below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glidepath.llm.common import partitions, stored

PATH = "array<struct<before:binary,after:binary>>"
#: Range partitions number their rows in the low bits of monotonically_increasing_id().
_ROW_BITS = 33


def digest(content: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(content, 256))


def text_of(raw: Column) -> Column:
    """Digests as lowercase hex text, in which form they are hashed and shown."""
    return F.lower(F.hex(raw))


def leaf(values: list[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and its text, or `-` for null, so no two rows read alike."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return digest(F.concat(*parts))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf (32 bytes) and its path lead to, as hex text."""
    return F.aggregate(path, text_of(start), lambda at, step: F.sha2(F.concat(text_of(step["before"]), at, text_of(step["after"])), 256))


def proof_digest(path: Column) -> Column:
    """Digest, as hex text, of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(text_of(step["before"]), text_of(step["after"]))), ""), 256)


def _placed(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """`df` sorted and written, with `_part` and `_inner` (range partition and row in it), and a row per partition: `_before` it."""
    dealt = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), name)
    dealt = dealt.withColumn("_part", F.shiftright("_at", _ROW_BITS)).withColumn("_inner", F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)).drop("_at")
    # One row per range partition: their number is a setting, not a property of the data.
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    return dealt, counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """`nodes` with the digests of the other nodes of their run, left and right of them (`before`, `after`, concatenated)."""
    slot = F.col("idx") % arity
    rows = nodes
    for k in range(1, arity):
        other = nodes.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("digest").alias(f"_d{k}"))
        sibling = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + (slot + k) % arity
        rows = rows.withColumn("_sibling", sibling)
        rows = rows.join(other, (F.col("tree") == F.col("_tree")) & (F.col("_sibling") == F.col("_idx")), "left").drop("_tree", "_idx", "_sibling")
    none = F.lit(bytearray())

    def side(wraps: bool) -> Column:
        return F.concat(*[F.when((slot + k >= arity) == F.lit(wraps), F.coalesce(f"_d{k}", none)).otherwise(none) for k in range(1, arity)])

    return rows.withColumns({"before": side(True), "after": side(False)}).drop(*[f"_d{k}" for k in range(1, arity)])


def _levels(nodes: DataFrame, arity: int, name: str) -> list[DataFrame]:
    """Written levels from `nodes` (tree, idx, n nodes in this level of the tree, digest) up to the last root.

    A tree's root is its row with n = 1 in some level; lower trees end in earlier levels.
    """
    most = nodes.agg(F.max("n")).first()[0] or 1
    out = []
    while True:
        out.append(stored(_with_siblings(nodes, arity), f"{name}-{len(out)}"))
        if most <= 1:
            return out
        nodes = out[-1].filter((F.col("n") > 1) & (F.col("idx") % arity == 0)).select(
            "tree", F.floor(F.col("idx") / arity).alias("idx"), F.ceil(F.col("n") / arity).alias("n"),
            digest(F.concat(text_of(F.col("digest")), text_of(F.col("after")))).alias("digest"))
        most = -(-most // arity)


def _paths(levels: list[DataFrame], arity: int, above: DataFrame | None) -> DataFrame:
    """The rows of levels[0] with `path` (leaf to root) and `subroot`; `above`: tree, path above the tree's root."""
    below = None
    for level in reversed(levels):
        if above is None:
            rows = level.filter("n = 1").withColumn("path", F.array().cast(PATH))
        else:
            rows = level.filter("n = 1").join(above, "tree")
        rows = rows.withColumn("subroot", F.col("digest"))
        if below is not None:
            parents = below.select("tree", F.col("idx").alias("_run"), "path", "subroot")
            under = level.filter("n > 1").withColumn("_run", F.floor(F.col("idx") / arity)).join(parents, ["tree", "_run"]).drop("_run")
            step = F.array(F.struct("before", "after")).cast(PATH)
            rows = under.withColumn("path", F.concat(step, "path")).unionByName(rows)
        below = rows
    return below


def manifest(docs: DataFrame, columns: list[str], group: str, order: str, arity: int = 3, carry: dict[str, Column] | None = None) -> DataFrame:
    """A leaf per row of `docs`, with its path to the root of the whole table.

    Leaves hash `columns` (see `leaf`). Within each value of `group` they ascend by `order`; every `arity` consecutive nodes become one
    until one is left, the group's subroot. Subroots, ordered by group, likewise lead to the root. A run that is cut short hashes what it
    has, a single node too. Returns `group` and `order` under their names, `position` in the group, `leaf`, `subroot` and `root` (32
    bytes each), `path` (the siblings left and right, level by level) and the columns of `carry`, computed on the rows of `docs`.

    Null groups are a group of their own, the first one; null orders come first in it. Ties go by the leaf, so equal rows are
    interchangeable and the root does not depend on partitions. An empty table gives no rows. Other columns are ignored.

    Texts are read once, by the leaves. The rows are dealt by range, and a group finds its start by one row per (range partition,
    group), so a group with a third of all rows is spread like any other; all joins are on unique keys.
    """
    if arity < 2:
        raise ValueError("arity is two at least")
    rows = stored(docs.select(F.col(group).alias("_group"), F.col(order).alias("_order"), leaf([F.col(c) for c in columns]).alias("digest"),
                              *[c.alias(f"_c_{n}") for n, c in (carry or {}).items()]), "merkle-leaves")
    placed, before = _placed(rows, ["_group", "_order", "digest"], "merkle-order")
    here = placed.groupBy("_part", "_group").agg(F.count(F.lit(1)).alias("n"), F.min("_inner").alias("_first")).join(F.broadcast(before), "_part")
    # A tree goes by the place of its first leaf, which ascends with the group.
    trees = here.groupBy(F.col("_group").alias("_g")).agg(F.min(F.col("_before") + F.col("_first")).alias("tree"), F.sum("n").alias("n"))
    spread = here.select(F.col("_part").alias("_p"), "_group", "_before").join(trees, F.col("_group").eqNullSafe(F.col("_g"))).drop("_group")
    leaves = placed.join(spread, (F.col("_part") == F.col("_p")) & F.col("_group").eqNullSafe(F.col("_g"))).withColumn(
        "idx", F.col("_before") + F.col("_inner") - F.col("tree")).drop("_part", "_p", "_g", "_before", "_inner")
    levels = _levels(leaves, arity, "merkle")

    ends = None
    for level in levels:
        roots = level.filter("n = 1").select("tree", "digest")
        ends = roots if ends is None else ends.unionByName(roots)
    ends, before = _placed(ends, ["tree"], "merkle-subroots")
    n = ends.count()
    tops = ends.join(F.broadcast(before), "_part").select(
        F.lit(0).cast("long").alias("tree"), (F.col("_before") + F.col("_inner")).alias("idx"), F.lit(n).cast("long").alias("n"), "digest",
        F.col("tree").alias("_of"))
    top = _levels(tops, arity, "merkle-top")
    root = top[-1].filter("n = 1").select("digest").first()  # one row, or none in an empty table
    above = stored(_paths(top, arity, None).select(F.col("_of").alias("tree"), "path"), "merkle-above")
    done = _paths(levels, arity, above)
    return done.select(F.col("_group").alias(group), F.col("_order").alias(order), F.col("idx").alias("position"), F.col("digest").alias("leaf"), "subroot",
                       F.lit(bytearray(root["digest"]) if root else None).cast("binary").alias("root"), "path",
                       *[F.col(f"_c_{n}").alias(n) for n in carry or {}])


def audited(docs: DataFrame, columns: list[str], group: str, order: str, altered: dict[str, Column], arity: int = 3) -> DataFrame:
    """`manifest`, and a check of altered rows against it: each leaf is computed anew with the columns of `altered` in place of the
    table's, folded with the siblings of the manifest (`folded_root`, hex text) and compared with the root (`verified`)."""
    again = leaf([altered.get(c, F.col(c)) for c in columns])
    rows = manifest(docs, columns, group, order, arity, {"altered_leaf": again})
    rows = rows.withColumn("folded_root", folded(F.col("altered_leaf"), F.col("path")))
    return rows.withColumn("verified", F.col("folded_root") == text_of(F.col("root")))
