"""Exact cosine search of a stated query set, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_path

#: Vectors of a batch and products of a tile at a time.
ROWS, TILE = 2048, 1 << 19


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 4096, digits: int = 6) -> DataFrame:
    """q, id, sim: the k most similar vectors of each query but itself; ties go to the smaller id.

    Queries come to the driver a block at a time and are broadcast as one matrix; each task keeps the best k of each query
    over its batches of vectors, which meet the matrix in tiles of at most TILE products. A block's candidates are written before the next block is read, so one broadcast lives at a
    time and the plan doesn't grow with the queries. Vectors that are null, hold nulls, or have another length than the
    first query are left out, and a vanishing norm has similarity 0.
    """
    spark = vectors.sparkSession
    plain = lambda df: df.where(F.col(vector_col).isNotNull() & ~F.exists(F.col(vector_col), lambda x: x.isNull())).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("e"))
    data, schema = plain(vectors), "q long, id long, sim double"
    asked = plain(queries)
    first = asked.select(F.size("e").alias("n"), "id").orderBy("id").first()
    if first is None:
        return data.limit(0).select(F.col("id").alias("q"), "id", F.lit(0.0).alias("sim"))
    width, path = first.n, new_path(spark, "nearest")
    data, rest = data.where(F.size("e") == width), asked.where(F.size("e") == width).toLocalIterator()

    def scaled(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.where(n < 1e-12, 0.0, x / np.maximum(n, 1e-12))

    while rows := list(islice(rest, block)):
        shared = spark.sparkContext.broadcast((np.array([r.id for r in rows]), scaled(np.array([r.e for r in rows], float))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, qm = shared.value
            top_ids, top_sims = np.zeros((len(qid), k), np.int64), np.full((len(qid), k), -2.0)
            for batch in batches:
                every = batch.column(0).to_numpy()
                flat = batch.column(1).flatten().to_numpy().reshape(len(every), -1) if len(every) else None
                for at in range(0, len(every), ROWS):
                    ids, e = every[at : at + ROWS], scaled(flat[at : at + ROWS])
                    step = max(1, TILE // len(ids))
                    for q in range(0, len(qid), step):
                        part = slice(q, q + step)
                        sims = np.round(qm[part] @ e.T, digits)
                        sims[qid[part, None] == ids] = -2
                        both = np.concatenate([top_sims[part], sims], axis=1)
                        names = np.concatenate([top_ids[part], np.broadcast_to(ids, sims.shape)], axis=1)
                        best = np.lexsort((names, -both), axis=1)[:, :k]
                        top_sims[part], top_ids[part] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
            keep = top_sims.ravel() > -2
            if keep.any():
                q = np.repeat(qid, k)[keep]
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(top_ids.ravel()[keep]), pa.array(top_sims.ravel()[keep])], ["q", "id", "sim"])

        data.mapInArrow(run, schema).write.mode("append").parquet(path)
        shared.unpersist()
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id"))
    return spark.read.schema(schema).parquet(path).withColumn("_k", rank).where(F.col("_k") <= k).drop("_k")
