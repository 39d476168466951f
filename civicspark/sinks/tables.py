"""Upserts as joins of the stored rows with the incoming ones: each gives the rows of the next version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_all(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows replace stored ones of their key. Keys are unique on each side."""
    return incoming.unionByName(stored.join(incoming.select(*key), key, "left_anti"))


def insert_missing(stored: DataFrame, incoming: DataFrame, key: list[str], order: list) -> DataFrame:
    """Stored rows, and the first incoming row of each key that they don't have."""
    first = incoming.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")
    return stored.unionByName(first.join(stored.select(*key), key, "left_anti"))


def upsert_columns(stored: DataFrame, incoming: DataFrame, key: list[str], rules: dict[str, object]) -> DataFrame:
    """Stored and incoming rows of a key as one, each column by its rule from its old and new value; a side that isn't there has nulls."""
    names = [c for c in stored.columns if c not in key]
    old = stored.select(*key, *[F.col(c).alias(f"__old_{c}") for c in names])
    new = incoming.select(*key, *[F.col(c).alias(f"__new_{c}") for c in names])
    both = old.join(new, key, "full_outer")
    return both.select(*key, *[rules[c](F.col(f"__old_{c}"), F.col(f"__new_{c}")).alias(c) for c in names])


def keep(old: Column, new: Column) -> Column:
    """The new value unless it is null."""
    return F.coalesce(new, old)


def prefer(value: str):
    """That value wherever it stands, else the new one."""
    return lambda old, new: F.when((old == value) | (new == value), value).otherwise(F.coalesce(new, old))


def numbered(stored: DataFrame, incoming: DataFrame, key: list[str], ident: str) -> DataFrame:
    """Upserted rows with their ids: known keys keep theirs, new ones get the next, in the order of their keys."""
    known = incoming.join(stored.select(*key, ident), key, "left")
    fresh = known.where(F.col(ident).isNull()).drop(ident)
    top = stored.agg(F.coalesce(F.max(ident), F.lit(0)).alias("__top"))  # one row
    new = fresh.withColumn("__n", F.row_number().over(Window.orderBy(*key))).crossJoin(F.broadcast(top)).withColumn(ident, F.col("__top") + F.col("__n")).drop("__top", "__n")
    return known.where(F.col(ident).isNotNull()).unionByName(new).unionByName(stored.join(incoming.select(*key), key, "left_anti"))


def without_prefix(stored: DataFrame, key: str, prefix: str) -> DataFrame:
    return stored.where(~F.col(key).startswith(prefix))


def newest_versions(stored: DataFrame, of: list[str], order: list) -> DataFrame:
    """The newest version of each record; older ones go."""
    return stored.withColumn("__r", F.row_number().over(Window.partitionBy(*of).orderBy(*order))).where("__r = 1").drop("__r")


def merge_children(store: DataFrame, children: DataFrame, incoming: DataFrame, incoming_children: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Store and children with the incoming records whose key the store doesn't have, and the children of these alone."""
    fresh = incoming.join(store, key, "left_anti")
    return store.unionByName(fresh), children.unionByName(incoming_children.join(fresh, key, "left_semi"))


def slim(rows: DataFrame, columns: list[str], needed: list[str]) -> DataFrame:
    """The columns that a cache holds, of rows that have the needed ones."""
    return rows.select(*columns).dropna(subset=needed)


def append_log(rows: DataFrame, path: str) -> None:
    """Adds the rows to a folder of JSON lines."""
    rows.write.mode("append").json(path)


def export_certified(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Writes the certified rows alone, in folders by a column where one is named."""
    certified = rows.where("status = 'certified'")
    (certified.write.partitionBy(by) if by else certified.write).mode("overwrite").parquet(path)


def sections(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """value: a JSON line for each row, with the section's name, as a page is sent part by part."""
    return rows.select(F.to_json(F.struct(F.lit(name).alias("section"), F.struct(*columns).alias("data"))).alias("value"))
