"""Nested JSON of unknown shape: what is worth keeping of it, and its records with what they inherit from around them.

Depth has no bound, so a document is walked with a stack in Python, Arrow batch by Arrow batch; rows that come out
are flat. A document that isn't JSON gives nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys whose plain values are kept, and the entries of a list that are looked at.
KEYS, MOST = r"(?i)name|date|time|body|categ|title|locat|type|status", 40


def _read(text: str | None):
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def leaves(text: str | None, keys: str = KEYS, most: int = MOST) -> Iterator[tuple[str, str]]:
    """Path and value of each plain value that is kept: under a key that fits, or a list's own that isn't empty, zero or false."""
    fits = re.compile(keys)
    stack = [("$", None, _read(text))]
    while stack:
        path, key, x = stack.pop()
        if isinstance(x, dict):
            stack += [(f"{path}.{k}", k, v) for k, v in reversed(x.items())]
        elif isinstance(x, list):
            stack += [(f"{path}[{i}]", None, v) for i, v in reversed(list(enumerate(x[:most])))]
        elif x is not None and (fits.search(key) if key is not None else x):
            yield path, x if isinstance(x, str) else json.dumps(x)


def slim(x, fits: re.Pattern, most: int):
    """x without plain values under keys that don't fit, nulls, and containers in which nothing is left."""
    if isinstance(x, list):
        return [s for s in (slim(v, fits, most) for v in x[:most]) if s]
    if not isinstance(x, dict):
        return x
    held = {k: slim(v, fits, most) if isinstance(v, (dict, list)) else v if fits.search(k) else None for k, v in x.items()}
    return {k: v for k, v in held.items() if v is not None and (v or not isinstance(v, (dict, list)))}


def slim_json(text: Column, keys: str = KEYS, most: int = MOST, longest: int = 9000) -> Column:
    """The JSON text of what is kept, at most that long; null of what isn't JSON."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        fits = re.compile(keys)
        held = [_read(t) for t in texts]
        return pd.Series([None if x is None else json.dumps(slim(x, fits, most))[:longest] for x in held], dtype=object)

    return run(text)


def kept_leaves(documents: DataFrame, key: str, text: str, keys: str = KEYS, most: int = MOST) -> DataFrame:
    """key, path, value: a row for each plain value that is kept."""
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                rows = [(i, *leaf) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for leaf in leaves(t, keys, most)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], part.schema.field(0).type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=[key, "path", "value"])

    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, path string, value string")


def records(text: str | None, ident: str, inherited: dict[str, list[str]]) -> Iterator[tuple]:
    """Each different node with that key, in the order in which they stand, the first of each id: its id, and for each
    field the first value of its keys in the node, else in the nearest node around it that has one. Keys are read in any case."""
    seen: set[str] = set()
    stack: list[tuple[object, tuple[dict, ...]]] = [(_read(text), ())]
    while stack:
        x, around = stack.pop()
        if isinstance(x, list):
            stack += [(v, around) for v in reversed(x)]
        elif isinstance(x, dict):
            own = {k.lower(): v for k, v in reversed(x.items())}
            around = (own, *around)
            found = own.get(ident)
            if found is not None and str(found) not in seen:
                seen.add(str(found))
                fields = [next((v for node in around for k in keys if (v := node.get(k)) and not isinstance(v, (dict, list))), None) for keys in inherited.values()]
                yield str(found), *(None if v is None else str(v) for v in fields)
            stack += [(v, around) for v in reversed(x.values())]


def nested_records(documents: DataFrame, key: str, text: str, ident: str, inherited: dict[str, list[str]]) -> DataFrame:
    """key, place (1, 2 ... down the document), record (its id), and a column for each field of every record of every document."""
    kind = dict(documents.dtypes)[key]
    names = [key, "place", "record", *inherited]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                rows = [(i, n, *r) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for n, r in enumerate(records(t, ident, inherited), 1)]
                types = [part.schema.field(0).type, pa.int32(), *[pa.string()] * (len(names) - 2)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(types)], names=names)

    fields = ", ".join(f"{c} string" for c in names[2:])
    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, place int, {fields}")
