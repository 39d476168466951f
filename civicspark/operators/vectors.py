"""Nearest vectors of a stated query set against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and rows of a block; queries of a round, which are broadcast together; similarities that a task holds at a time.
QUERIES, ROWS, ROUND, CELLS = 256, 4096, 16_384, 1 << 19


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.full_like(x, np.nan), where=norm > 0)


def packed_blocks(df: DataFrame, by: list[str], ident: str, vector: str, name: str) -> DataFrame:
    """by, name_ids, name_xs: the rows of each block as two arrays. The caller's blocks bound what one gathers."""
    packed = df.groupBy(*by).agg(F.collect_list(F.struct(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("x"))).alias("r"))
    return packed.select(*by, F.transform("r", lambda r: r["id"]).alias(f"{name}_ids"), F.transform("r", lambda r: r["x"]).alias(f"{name}_xs"))


def top(k: int, ids: np.ndarray, xs: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """similarity, id (a row for each query, k columns, -inf where there is none) of the nearest rows of unit vectors, which come
    block by block. A piece of CELLS similarities is held at a time; only what reaches a query's k-th best so far is sorted."""
    best = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
    for all_own, all_x in blocks:
        for at in range(0, len(all_own), CELLS // QUERIES):
            own, x = all_own[at : at + CELLS // QUERIES], all_x[at : at + CELLS // QUERIES]
            for lo in range(0, len(ids), QUERIES):
                here = slice(lo, lo + QUERIES)
                s = np.floor(xs[here] @ x.T * 10_000 + 0.5) / 10_000
                s[(ids[here, None] == own[None, :]) | np.isnan(s)] = -np.inf
                least = best[0][here, -1]
                if len(own) > k:
                    least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k])
                q, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                if len(q):
                    of = np.concatenate((np.repeat(np.arange(len(s)), k), q))
                    found = np.concatenate((best[0][here].ravel(), s[q, c])), np.concatenate((best[1][here].ravel(), own[c]))
                    order = np.lexsort((found[1], -found[0], of))
                    first = order[np.searchsorted(of[order], np.arange(len(s)))[:, None] + np.arange(k)]
                    best[0][here], best[1][here] = found[0][first], found[1][first]
    return best


def _found(k: int, ids: np.ndarray, best: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    keep = best[0] > -np.inf
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, keep.sum(axis=1))), pa.array(best[1][keep]), pa.array(best[0][keep])], names=["query", "vec_id", "similarity"])


def score_blocks(k: int):
    """Of blocks of queries beside blocks of rows, the k nearest rows of each query."""
    def unit(xs: pa.ListScalar) -> np.ndarray:
        return _unit(xs.values.flatten().to_numpy(zero_copy_only=False).reshape(len(xs.values), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q, rows = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("qb_ids", "rb_ids"))
                yield _found(k, q, top(k, q, unit(b.column("qb_xs")[i]), iter([(rows, unit(b.column("rb_xs")[i]))])))

    return run


def _in_place(k: int, sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs = sent.value
        blocks = ((b.column(0).to_numpy(), _unit(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))) for b in batches if b.num_rows)
        yield _found(k, ids, top(k, ids, xs, blocks))

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 8, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query, vec_id, similarity (cosine, four decimals), rank: the k nearest rows of each query but itself, by similarity and id.

    Every row meets every query where it lies: queries are broadcast in rounds of at most ROUND, so no row is shuffled;
    each task leaves k rows a query, which a second step ranks. Vectors of one length; those without a direction are
    near nothing. For many queries on many rows, vector_index searches less.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(ident).cast("long"), F.col(vector).cast("array<double>").alias("x")).where(F.exists("x", lambda v: v != 0))
    own = queries.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).where(F.exists("x", lambda v: v != 0))
    rounds = max(1, -(-own.count() // ROUND))
    found = None
    for i in range(rounds):
        part = own.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == i).collect()
        ids, xs = np.array([r.id for r in part], np.int64), _unit(np.array([r.x for r in part], float)) if part else np.zeros((0, 0))
        if len(ids):
            one = rows.mapInArrow(_in_place(k, spark.sparkContext.broadcast((ids, xs))), "query long, vec_id long, similarity double")
            found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "query long, vec_id long, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
