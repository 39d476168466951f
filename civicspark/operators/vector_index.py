"""An inverted file of vectors: rows lie in lists around centroids, and a query looks into the lists nearest to it.

Centroids are fitted on a bounded sample; every row is assigned. A list's rows are cut into blocks of about ROWS by
the hash of their id, so a list that holds a third of all rows is searched by many tasks. Queries travel to the
blocks of their lists, rows move once. An exact search goes on, where the lists looked into don't settle a
query, to all lists that could hold something nearer: a list's rows are within an angle of its centroid, so
nothing in it is nearer to a query than the difference of the two angles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import QUERIES, ROWS, packed_blocks, score_blocks

#: Rows that centroids are fitted on, lists at most, rounds of fitting.
SAMPLE, LISTS, FITTING = 16_384, 4096, 10
#: Widens a list's angle for what floating point loses, and similarities for their rounding to four decimals.
SLACK, ROUNDING = 1e-6, 1e-4


@dataclass(frozen=True)
class Index:
    """centroids: unit vectors, at most LISTS; rows: list, sub, id, x of every row with a direction; lists: list, subs, angle."""

    centroids: np.ndarray
    rows: DataFrame
    lists: DataFrame


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def centroids(sample: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Spherical k-means of the sample's directions; a list that loses all its rows stays where it was."""
    x = unit(sample)
    x = np.unique(x[np.abs(x).sum(axis=1) > 0], axis=0)
    c = x[np.random.default_rng(seed).permutation(len(x))[:lists]]
    for _ in range(FITTING):
        at = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        moved = unit(sums)
        c = np.where(np.abs(moved).sum(axis=1, keepdims=True) > 0, moved, c)
    return c


def fit(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", lists: int | None = None, sample: int = SAMPLE) -> Index:
    """The index of all rows. lists: by default the root of the number of rows, at most LISTS. At most `sample` rows come to the driver."""
    rows = vectors.select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.where(F.exists("x", lambda v: v != 0))
    lists = min(LISTS, lists or max(1, round(rows.count() ** 0.5)))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("x").collect()
    c = centroids(np.array([r.x for r in drawn], float), lists) if drawn else np.zeros((0, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                near = unit(_matrix(b.column(1))) @ c.T
                at = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(at)), at], -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column(0), b.column(1), pa.array(angle)], names=["list", "id", "x", "angle"])

    assigned = rows.mapInArrow(assign, "list int, id long, x array<double>, angle double")
    of_list = assigned.groupBy("list").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("subs"), F.max("angle").alias("angle"))  # at most LISTS rows
    cut = assigned.drop("angle").join(F.broadcast(of_list.drop("angle")), "list").withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int"))
    return Index(c, cut.select("list", "sub", "id", "x"), of_list)


def _probes(index: Index, queries: DataFrame, choose) -> DataFrame:
    """query, x, list: the lists that choose(similarities to the centroids, other columns of a batch) says for each query, as a mask."""
    c = index.centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                at, found = np.nonzero(choose(unit(_matrix(part.column(1))) @ c.T, part))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(found, pa.int32())], names=["query", "x", "list"])

    return queries.mapInArrow(run, "query long, x array<double>, list int")


def _search(index: Index, probes: DataFrame, k: int) -> DataFrame:
    """query, vec_id, similarity: of each block that a query is sent to, its k nearest rows."""
    sent = probes.join(F.broadcast(index.lists.drop("angle")), "list").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("subs")
    sizes = sent.groupBy("list", "sub").agg(F.ceil(F.count("*") / QUERIES).alias("parts"))
    sent = sent.join(sizes, ["list", "sub"]).withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")))
    q = packed_blocks(sent, ["list", "sub", "part"], "query", "x", "qb")
    rows = packed_blocks(index.rows, ["list", "sub"], "id", "x", "rb")
    return rows.join(q, ["list", "sub"]).select("qb_ids", "qb_xs", "rb_ids", "rb_xs").mapInArrow(score_blocks(k), "query long, vec_id long, similarity double")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 8, probes: int = 8, exact: bool = False, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query, vec_id, similarity (cosine, four decimals), rank: the k nearest rows of each query but itself.

    Looks into the `probes` nearest lists; exact: and then into every other list that could hold a nearer row, so that
    nothing is missed. Queries without a direction, and empty tables, find nothing.
    """
    q = queries.select(F.col(ident).alias("query"), F.col(vector).cast("array<double>").alias("x")).where(F.exists("x", lambda v: v != 0))
    n = min(probes, len(index.centroids))
    if not n:
        return queries.sparkSession.createDataFrame([], "query long, vec_id long, similarity double, rank int")
    rank = lambda near: np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1, kind="stable")
    first = _search(index, _probes(index, q, lambda near, _: rank(near) < n), k)
    if not exact:
        return _best(first, k)
    kth = _best(first, k).groupBy("query").agg(F.count("*").alias("n"), F.min("similarity").alias("least"))
    open_ = q.join(kth, "query", "left").select("query", "x", F.when(F.col("n") >= k, F.col("least")).otherwise(-2.0).alias("least"))
    angles = np.zeros(len(index.centroids))
    for r in index.lists.collect():  # at most LISTS rows
        angles[r.list] = r.angle

    def could_be_nearer(near: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
        most = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - angles[None, :] - SLACK))
        return (rank(near) >= n) & (most + ROUNDING >= part.column(2).to_numpy()[:, None])

    return _best(first.unionByName(_search(index, _probes(index, open_, could_be_nearer), k)), k)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of the true neighbours (query, vec_id) that were found."""
    pairs = truth.select("query", "vec_id").join(found.select("query", "vec_id", F.lit(1).alias("hit")), ["query", "vec_id"], "left")
    return pairs.agg(F.count("hit") / F.greatest(F.lit(1), F.count("*"))).first()[0]
