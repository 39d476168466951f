"""Trades in the lines of a periodic disclosure.

A trade's kind, its two dates and its amount always stand together on one line; the asset's name and its ticker
may go on to the next. A line is read with the one after it, inside the document's row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.trades import amount_label

# The columns that never wrap, a ticker, who owns the asset, what stands behind a name, and the words for kinds and owners.
ANCHOR = r"\b([PSE])(\s*\(partial\))?\s+(\d{2}/\d{2}/\d{4})\s+\d{2}/\d{2}/\d{4}\s+\$([\d,]+)"
TICKER, OWNER, TAIL = r"\(([A-Z][A-Z.]{0,5})\)", r"^(SP|JT|DC)\b\s*", r"\s*\([A-Z0-9.]+\)\s*(?:\[[A-Z]{2}\])?\s*$"
KINDS, OWNERS = {"P": "buy", "S": "sell", "E": "exchange"}, {"SP": "spouse", "JT": "joint", "DC": "dependent"}
LONGEST = 80


def disclosed_trades(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), ticker (or null), asset (at most 80 characters), kind, date, amount, amount_low, owner (or empty) of every trade.

    A line holds one trade, its first. An amount without digits is none. A null document has no lines.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\r\n|[\n\r\f]")
    rows = documents.select(key, lines.alias("lines"))
    pairs = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"), F.trim(F.coalesce(F.get("lines", i + 1), F.lit(""))).alias("next")))
    # The outer form keeps Spark from deriving a filter that would split the document again.
    rows = rows.select(key, F.explode_outer(F.filter(pairs, lambda p: p["text"].rlike(ANCHOR))).alias("p")).where("p is not null").select(key, "p.*")
    part = lambda i: F.regexp_extract("text", "^(.*?)" + ANCHOR, i)
    ticker = lambda c: F.nullif(F.regexp_extract(c, TICKER, 1), F.lit(""))
    rows = rows.select(key, "line", "next", F.trim(part(1)).alias("head"), part(2).alias("kind"), part(3).alias("partial"), part(4).alias("date"), F.regexp_replace(part(5), ",", "").try_cast("long").alias("low")).where("low is not null")
    here, there = ticker("head"), ticker("next")
    wrapped = F.trim(F.concat("head", F.lit(" "), F.substring_index("next", ")", 1), F.lit(")")))
    rows = rows.select(key, "line", "kind", "partial", "date", "low", F.coalesce(here, there).alias("ticker"), F.when(here.isNull() & there.isNotNull(), wrapped).otherwise(F.col("head")).alias("asset"))
    word = lambda c, words: F.coalesce(*[F.when(c == k, v) for k, v in words.items()])
    owner = F.coalesce(word(F.regexp_extract("asset", OWNER, 1), OWNERS), F.lit(""))
    asset = F.left(F.trim(F.regexp_replace(F.trim(F.regexp_replace("asset", OWNER, "")), TAIL, "")), F.lit(LONGEST))
    kind = F.concat(word(F.col("kind"), KINDS), F.when(F.col("partial") != "", " (partial)").otherwise(""))
    return rows.select(key, "line", "ticker", asset.alias("asset"), kind.alias("kind"), "date", amount_label(F.col("low")).alias("amount"), F.col("low").alias("amount_low"), owner.alias("owner"))
