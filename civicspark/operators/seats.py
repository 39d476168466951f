"""Chambers, budgets and packs: what is dealt out in order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_sizes(seats: int, rows: int) -> list[int]:
    """Seats of each row of a chamber: outer rows longer, at least one each, what rounding leaves in the last."""
    weights = [1 + i / max(rows - 1, 1) for i in range(rows)]
    sizes = [max(1, round(seats * w / sum(weights))) for w in weights[:-1]]
    return [*sizes, max(1, seats - sum(sizes))]


def chamber_plan(seats: int, rows: int = 4) -> list[tuple[int, int, float, float]]:
    """seat, row, x, y of a half circle, from left to right."""
    places = []
    for row, n in enumerate(row_sizes(seats, rows)):
        radius = 0.4 + 0.6 * row / max(rows - 1, 1)
        for i in range(n):
            angle = math.pi * (1 - (i + 0.5) / n)
            places.append((angle, row, round(radius * math.cos(angle), 2), round(radius * math.sin(angle), 2)))
    places.sort(key=lambda p: (-p[0], p[1]))
    return [(i + 1, row, x, y) for i, (_, row, x, y) in enumerate(places[:seats])]


def filled_by_counts(votes: DataFrame, seats: int, order: list[str]) -> DataFrame:
    """vote_id, seat, option of every seat: as many seats as each option has votes, in that order; what is left is absent."""
    pairs = F.array(*[F.struct(F.lit(o).alias("option"), F.col(o).cast("int").alias("n")) for o in order])
    options = F.flatten(F.transform(pairs, lambda p: F.array_repeat(p["option"], p["n"])))
    filled = F.slice(F.concat(options, F.array_repeat(F.lit("absent"), seats)), 1, seats)
    return votes.select("vote_id", F.posexplode(filled).alias("at", "option")).select("vote_id", (F.col("at") + 1).alias("seat"), "option")


def seated(members: DataFrame, plan: DataFrame, group: str, order: list) -> DataFrame:
    """The i-th member of a chamber in the i-th seat of its plan."""
    return members.withColumn("seat", F.row_number().over(Window.partitionBy(group).orderBy(*order))).join(plan, "seat")


def token_batches(df: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """df with batch: rows of a group in order, a new batch where the next row would overflow the budget. Each batch begins where
    the one before ended, so a group passes through one task in order, which holds two numbers."""
    ordered = df.repartition(group).sortWithinPartitions(group, order)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, batch, used = None, 0, 0
        for b in batches:
            out = []
            for k, n in zip(b[group], b[size], strict=True):
                if k != key:
                    key, batch, used = k, 0, 0
                elif used + n > budget:
                    batch, used = batch + 1, 0
                used += n
                out.append(batch)
            yield b.assign(batch=out)

    return ordered.mapInPandas(pack, ", ".join(f"`{c}` {t}" for c, t in [*df.dtypes, ("batch", "bigint")]))
