"""Nearest vectors of a stated set of queries, exactly, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.catalog import written

BLOCK = 2000


def _matrix(column) -> np.ndarray:
    rows = [np.asarray(x, np.float64) for x in column.to_pylist()]
    m = np.vstack(rows) if rows else np.zeros((0, 1))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def nearest(vectors: DataFrame, key: str, vector: str, k: int, every: int) -> DataFrame:
    """``(query_id, vec_id, similarity)``: by cosine, the ``k`` best of all others for each vector whose key is
    divisible by ``every``; the smaller key among equals.

    The queries are written once and sent out in blocks of at most ``BLOCK`` (a bounded broadcast
    each); every batch of vectors keeps its ``k`` best per query. Null vectors are left out.
    """
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    queries = written(rows.filter(F.col("id") % every == 0), "queries")
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    found = None
    for b in range(blocks):
        part = [(r["id"], r["v"]) for r in queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "v").collect()]  # one block
        if not part:
            continue
        ids = np.array([p[0] for p in part])
        m = np.array([p[1] for p in part], np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        shared = rows.sparkSession.sparkContext.broadcast((ids, m))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, qm = shared.value
            for x in batches:
                mine = np.array(x.column("id").to_pylist(), np.int64)
                if not len(mine):
                    continue
                s = np.round(qm @ _matrix(x.column("v")).T, 6)
                s[q[:, None] == mine[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(mine, s.shape), -s), axis=1)[:, :k]
                who = np.repeat(q, order.shape[1])
                sims = np.take_along_axis(s, order, axis=1).ravel()
                good = np.isfinite(sims)
                yield pa.RecordBatch.from_arrays([pa.array(who[good]), pa.array(mine[order].ravel()[good]), pa.array(sims[good])], ["query_id", "vec_id", "similarity"])

        got = rows.mapInArrow(run, "query_id bigint, vec_id bigint, similarity double")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return rows.limit(0).select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0.0).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")
