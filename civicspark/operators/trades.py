"""Disclosed trades and what prices did after them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import range_join

OFFSETS = (7, 30, 90)
#: Days before and after a trade within which an event is near.
NEAR_BEFORE, NEAR_AFTER = 30, 75


def tenth(x: Column) -> Column:
    """Half up to one decimal, the same in every engine."""
    return F.floor(x * 10 + 0.5) / 10


def windows_after(trades: DataFrame, prices: DataFrame, offsets: tuple[int, ...] = OFFSETS) -> DataFrame:
    """Each distinct trade with copies, base (the first close on or after it) and pct_N for each offset.

    A trade without a base above zero goes; a window without a later close is null.
    """
    one = trades.groupBy("ticker", "member", "trade_date", "kind", "amount_low").agg(F.count("*").alias("copies"))
    # Each day of a ticker asks for its windows; days and closes lie in one ordered list by ticker, in which a day's
    # windows find the newest close behind them and stay beside each other.
    days = trades.select("ticker", "trade_date").where("trade_date is not null").distinct()
    asks = days.select("ticker", "trade_date", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.date_add("trade_date", n).alias("at")) for n in (0, *offsets)])).alias("w"))
    asks = asks.select("ticker", "w.at", "trade_date", "w.n", F.lit(None).cast("double").alias("close"))
    points = prices.select("ticker", F.col("price_date").alias("at"), F.lit(None).cast("date").alias("trade_date"), F.lit(None).cast("int").alias("n"), F.col("close").cast("double").alias("close"))
    frame = Window.partitionBy("ticker").orderBy(F.desc("at"), F.col("n").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = asks.unionByName(points.where("close is not null")).withColumn("hit", F.last("close", ignorenulls=True).over(frame)).where("n is not null")
    wide = hits.groupBy("ticker", "trade_date").agg(*[F.max(F.when(F.col("n") == n, F.col("hit"))).alias(f"__{n}") for n in (0, *offsets)])
    priced = one.join(wide, ["ticker", "trade_date"]).where(F.col("__0") > 0)
    pct = [tenth((F.col(f"__{n}") / F.col("__0") - 1) * 100).alias(f"pct_{n}") for n in offsets]
    return priced.select("ticker", "member", "trade_date", "kind", "amount_low", "copies", F.col("__0").alias("base"), *pct)


def favorable(moves: DataFrame, offsets: tuple[int, ...] = OFFSETS) -> DataFrame:
    """With the best window in the trade's own direction: up after a purchase, down after a sale."""
    sign = F.when(F.col("kind") == "buy", 1.0).when(F.col("kind") == "sell", -1.0)
    best = F.greatest(*[sign * F.col(f"pct_{n}") for n in offsets])
    return moves.withColumn("favorable", best)


def notable(scored: DataFrame, today: DataFrame, least: float = 12.0, age: int = 30, top: int = 60, cells: int = 64) -> DataFrame:
    """The most favorable trades that are old enough on the day in the one row of today; found counts all that qualify, before the cut.

    Rows are ranked and counted in cells first, so that one pass gives both: what is left has at most cells * top rows.
    """
    day = today.toDF("__today")
    good = scored.join(F.broadcast(day), (F.col("favorable") >= least) & (F.datediff("__today", "trade_date") >= age)).drop("__today")
    order = [F.desc("favorable"), "ticker", "member", "trade_date", "amount_low"]
    cell = Window.partitionBy("__cell")
    ranked = good.withColumn("__cell", F.pmod(F.xxhash64("ticker", "member", "trade_date"), F.lit(cells)))
    ranked = ranked.withColumn("__rank", F.row_number().over(cell.orderBy(*order))).withColumn("__n", F.count("*").over(cell)).where(F.col("__rank") <= top)
    counted = ranked.withColumn("found", F.sum(F.when(F.col("__rank") == 1, F.col("__n"))).over(Window.partitionBy()))
    return counted.orderBy(*order).limit(top).drop("__cell", "__rank", "__n")


def near_events(trades: DataFrame, events: DataFrame) -> DataFrame:
    """Trades with an event of their ticker from 30 days before to 75 days after them, and the gap in days."""
    return range_join(trades, events, "ticker", "trade_date", "event_date", NEAR_BEFORE, NEAR_AFTER)


def linkage(trades: DataFrame, events: DataFrame, prices: DataFrame, sectors: DataFrame, wanted: list[str], top: int = 25) -> DataFrame:
    """Tickers of the wanted sectors that members traded: near trades, largest move, traders; the first by those."""
    of_sector = sectors.where(F.col("sector").isin(wanted))
    trades, events, prices = (df.join(of_sector.select("ticker"), "ticker", "left_semi") for df in (trades, events, prices))
    near = near_events(trades, events).groupBy("ticker").agg(F.count("*").alias("near_count"))
    largest = windows_after(trades, prices).groupBy("ticker").agg(F.max(F.greatest(*[F.abs(f"pct_{n}") for n in OFFSETS])).alias("largest_move"))
    traders = trades.groupBy("ticker").agg(F.countDistinct("member").alias("traders"), F.count("*").alias("n_trades"), F.max("trade_date").alias("last_trade"))
    rows = of_sector.join(traders, "ticker").join(near, "ticker", "left").join(largest, "ticker", "left").na.fill({"near_count": 0})
    return rows.orderBy(F.desc("near_count"), F.desc_nulls_last("largest_move"), F.desc("traders"), "ticker").limit(top)


def traded_tickers(trades: DataFrame, sectors: DataFrame, without: str) -> DataFrame:
    """Tickers with at least one trader, by number of traders, but those of one sector."""
    counts = trades.groupBy("ticker").agg(F.countDistinct("member").alias("traders"))
    return counts.join(sectors.where(F.col("sector") != without), "ticker").select("ticker", "company", "sector", "traders")


def timeline(trades: DataFrame, events: DataFrame, prices: DataFrame, lead: int = 45) -> DataFrame:
    """Marks of each ticker with an event, from lead days before it: trades by kind, the event, closes."""
    marks = [
        trades.groupBy("ticker", F.col("trade_date").alias("day"), F.col("kind").alias("mark")).agg(F.count("*").cast("double").alias("value")),
        events.select("ticker", F.col("event_date").alias("day"), F.lit("law").alias("mark"), F.lit(1.0).alias("value")),
        prices.select("ticker", F.col("price_date").alias("day"), F.lit("close").alias("mark"), F.col("close").alias("value")),
    ]
    since = events.select("ticker", F.date_sub("event_date", lead).alias("since"))
    return reduce(DataFrame.unionByName, marks).join(since, "ticker").where("day >= since").drop("since")


def member_summary(trades: DataFrame, tickers: int = 8) -> DataFrame:
    """By member: trades, buys, sells, and the tickers traded most."""
    by_ticker = trades.groupBy("member", "ticker").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "buy").alias("buys"), F.count_if(F.col("kind") == "sell").alias("sells"))
    ranked = by_ticker.withColumn("rank", F.row_number().over(Window.partitionBy("member").orderBy(F.desc("n"), "ticker")))
    top = F.array_sort(F.collect_list(F.when(F.col("rank") <= tickers, F.struct("rank", "ticker"))))
    rows = ranked.groupBy("member").agg(F.sum("n").alias("n_trades"), F.sum("buys").alias("buys"), F.sum("sells").alias("sells"), top.alias("t"))
    return rows.select("member", "n_trades", "buys", "sells", F.array_join(F.transform("t", lambda x: x["ticker"].cast("string")), ",").alias("top_tickers"))


def page(df: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """One page of the ordered rows (page from 0, size from 10 to 100) with the count of all rows."""
    size, number = min(100, max(10, size)), max(0, number)
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(number * size).limit(size).crossJoin(F.broadcast(total))


#: The lower bounds of the disclosure ranges and their labels.
AMOUNT_RANGES = [
    (50_000_001, "$50M+"), (25_000_001, "$25M–$50M"), (5_000_001, "$5M–$25M"), (1_000_001, "$1M–$5M"), (500_001, "$500K–$1M"), (250_001, "$250K–$500K"),
    (100_001, "$100K–$250K"), (50_001, "$50K–$100K"), (15_001, "$15K–$50K"), (1_001, "$1K–$15K"), (1, "$1–$1K"),
]


def amount_label(low: Column) -> Column:
    """The disclosure range of an amount; the lowest one also below one dollar."""
    return F.coalesce(*[F.when(low >= bound, F.lit(label)) for bound, label in AMOUNT_RANGES], F.when(low.isNotNull(), AMOUNT_RANGES[-1][1]))
