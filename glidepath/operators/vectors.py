"""Cosine nearest neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of queries, and of one of vectors; a task holds one of each.
QUERY_BLOCK, VECTOR_BLOCK = 512, 4096


def centroids(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """Mean vector per key. Each position is summed on its own, so a hot key combines early."""
    cells = vectors.select(F.col(key).alias("key"), F.posexplode(vec).alias("pos", "v"))
    means = cells.groupBy("key", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    # at most one row per position is left for a key
    ordered = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return means.groupBy("key").agg(F.transform(ordered, lambda s: s["v"]).alias("vec"))


def _blocks(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """Rows packed into arrays of `size` or less, dealt by position within their partition, so no count is needed."""
    ids, vecs = f"{prefix}_ids", f"{prefix}_vecs"

    def run(batches):
        held = []
        for pdf in batches:
            held.append(pdf[pdf[prefix + "_vec"].notna()])
            while sum(map(len, held)) >= size:
                whole = pd.concat(held)
                yield _block(whole[:size], ids, vecs, prefix)
                held = [whole[size:]]
        if sum(map(len, held)):
            yield _block(pd.concat(held), ids, vecs, prefix)

    kind = dict(rows.dtypes)[f"{prefix}_id"]
    return rows.mapInPandas(run, f"{ids} array<{kind}>, {vecs} binary, {prefix}_dim int")


def _block(rows: pd.DataFrame, ids: str, vecs: str, prefix: str) -> pd.DataFrame:
    m = np.stack(rows[prefix + "_vec"].to_numpy()).astype(np.float64)
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    return pd.DataFrame({ids: [rows[prefix + "_id"].to_numpy()], vecs: [m.tobytes()], f"{prefix}_dim": [m.shape[1]]})


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int = 3, query_id: str = "key", query_vec: str = "vec",
                vector_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The `k` most similar vectors of each query: `query, rank, vec_id, score`; ties by id.

    Queries and vectors are packed into blocks of fixed size on the cluster. Every block of queries
    meets every block of vectors in one matrix product, which passes on its best `k` per query, so
    rows are never paired one by one and the plan is the same for any number of queries. The
    blocks of queries are repeated for each of the tasks that vectors are dealt to, not for each vector.
    Rows without a vector are left out.
    """
    spark = queries.sparkSession
    deal = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = _blocks(queries.select(F.col(query_id).alias("q_id"), F.col(query_vec).cast("array<double>").alias("q_vec")), QUERY_BLOCK, "q")
    held = _blocks(vectors.select(F.col(vector_id).alias("v_id"), F.col(vector).cast("array<double>").alias("v_vec")), VECTOR_BLOCK, "v")
    at_all = asked.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
    dealt = held.withColumn("deal", F.pmod(F.xxhash64("v_ids", "v_vecs"), F.lit(deal)).cast("int"))
    tiles = dealt.join(at_all.hint("shuffle_merge"), "deal")

    def nearest(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                q = np.frombuffer(row.q_vecs).reshape(-1, row.q_dim)
                v = np.frombuffer(row.v_vecs).reshape(-1, row.v_dim)
                scores, names = q @ v.T, np.asarray(row.v_ids)
                keep = min(k, len(names))
                cut = np.partition(scores, -keep, axis=1)[:, -keep]
                qi, vi = [], []
                for i in range(len(q)):
                    near = np.nonzero(scores[i] >= cut[i] - 1e-9)[0]
                    near = near[np.lexsort((names[near], -np.round(scores[i, near], 9)))][:keep]
                    qi.extend([i] * len(near))
                    vi.extend(near)
                yield pd.DataFrame({"query": np.asarray(row.q_ids)[qi], vector_id: names[vi], "score": scores[qi, vi]})

    kinds = dict(asked.dtypes)["q_ids"][6:-1], dict(held.dtypes)["v_ids"][6:-1]
    best = tiles.select("q_ids", "q_vecs", "q_dim", "v_ids", "v_vecs", "v_dim").mapInPandas(
        nearest, f"query {kinds[0]}, {vector_id} {kinds[1]}, score double")
    order = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), vector_id)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", vector_id, "score")
