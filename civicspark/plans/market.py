"""Trades, prices and lobbying queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as a
from ..adapters import sql
from ..io import spread, tasks
from ..operators import money, trades
from ..registry import query

_MOVES = """, one AS (SELECT ticker, member, trade_date, kind, amount_low, count(*) AS copies FROM trades GROUP BY ALL),
    b AS (SELECT one.*, p."close" AS base FROM one ASOF JOIN prices p ON one.ticker = p.ticker AND p.price_date >= one.trade_date),
    b7 AS (SELECT b.*, p."close" AS c7 FROM (SELECT *, trade_date + 7 AS d FROM b) b ASOF LEFT JOIN prices p ON b.ticker = p.ticker AND p.price_date >= b.d),
    b30 AS (SELECT b.*, p."close" AS c30 FROM (SELECT * REPLACE (trade_date + 30 AS d) FROM b7) b ASOF LEFT JOIN prices p ON b.ticker = p.ticker AND p.price_date >= b.d),
    b90 AS (SELECT b.*, p."close" AS c90 FROM (SELECT * REPLACE (trade_date + 90 AS d) FROM b30) b ASOF LEFT JOIN prices p ON b.ticker = p.ticker AND p.price_date >= b.d),
    moves AS (SELECT ticker, member, trade_date, kind, amount_low, copies, base, floor((c7 / base - 1) * 100 * 10 + 0.5) / 10 AS pct_7,
        floor((c30 / base - 1) * 100 * 10 + 0.5) / 10 AS pct_30, floor((c90 / base - 1) * 100 * 10 + 0.5) / 10 AS pct_90 FROM b90 WHERE base > 0),
    scored AS (SELECT *, CASE kind WHEN 'buy' THEN greatest(pct_7, pct_30, pct_90) WHEN 'sell' THEN greatest(-pct_7, -pct_30, -pct_90) END AS favorable FROM moves)
"""


def _moves(spark, d):
    return trades.windows_after(a.trades(spark, d), a.prices(spark, d))


@query("trades_windows_after", sql(_MOVES + "SELECT * FROM scored", "trades", "prices"))
def trades_windows_after(spark, d):
    return trades.favorable(_moves(spark, d))


@query("trades_notable_top60", sql(_MOVES + """, good AS (SELECT * FROM scored WHERE favorable >= 12 AND (SELECT max(trade_date) FROM trades) - trade_date >= 30)
    SELECT *, (SELECT count(*) FROM good) AS found FROM good ORDER BY favorable DESC, ticker, member, trade_date, amount_low LIMIT 60""", "trades", "prices"))  # fmt: skip
def trades_notable_top60(spark, d):
    return trades.notable(trades.favorable(_moves(spark, d)), a.trades(spark, d).agg(F.max("trade_date")))


_NEAR = "FROM trades t JOIN law_dates e ON t.ticker = e.ticker WHERE e.event_date - t.trade_date BETWEEN -30 AND 75"


@query("trades_near_event", sql(f"SELECT t.*, e.event_date, CAST(e.event_date - t.trade_date AS INTEGER) AS gap {_NEAR}", "trades", "law_dates"))
def trades_near_event(spark, d):
    return trades.near_events(a.trades(spark, d), a.law_dates(spark, d))


@query("market_linkage_top25", sql(_MOVES + f""", near AS (SELECT t.ticker, count(*) AS near_count {_NEAR} GROUP BY 1),
    big AS (SELECT ticker, max(greatest(abs(pct_7), abs(pct_30), abs(pct_90))) AS largest_move FROM moves GROUP BY 1),
    who AS (SELECT ticker, count(DISTINCT member) AS traders, count(*) AS n_trades, max(trade_date) AS last_trade FROM trades GROUP BY 1)
    SELECT s.ticker, s.sector, s.company, traders, n_trades, last_trade, coalesce(near_count, 0) AS near_count, largest_move
    FROM sectors s JOIN who USING (ticker) LEFT JOIN near USING (ticker) LEFT JOIN big USING (ticker) WHERE s.sector IN ('PROMO', 'STANDARD')
    ORDER BY near_count DESC, largest_move DESC NULLS LAST, traders DESC, s.ticker LIMIT 25""", "trades", "prices", "law_dates", "sectors"))  # fmt: skip
def market_linkage_top25(spark, d):
    return trades.linkage(a.trades(spark, d), a.law_dates(spark, d), a.prices(spark, d), a.sectors(spark, d), ["PROMO", "STANDARD"])


@query("market_traded_tickers", sql("SELECT ticker, any_value(company) AS company, any_value(sector) AS sector, count(DISTINCT member) AS traders FROM trades JOIN sectors USING (ticker) WHERE sector <> 'ECONOMY' GROUP BY ticker", "trades", "sectors"))
def market_traded_tickers(spark, d):
    return trades.traded_tickers(a.trades(spark, d), a.sectors(spark, d), "ECONOMY")


@query("market_timeline_marks", sql(""", m AS (SELECT ticker, trade_date AS "day", kind AS mark, CAST(count(*) AS DOUBLE) AS "value" FROM trades GROUP BY ALL
    UNION ALL SELECT ticker, event_date, 'law', 1.0 FROM law_dates UNION ALL SELECT ticker, price_date, 'close', "close" FROM prices)
    SELECT m.* FROM m JOIN law_dates l ON m.ticker = l.ticker WHERE m."day" >= l.event_date - 45""", "trades", "prices", "law_dates"))  # fmt: skip
def market_timeline_marks(spark, d):
    return trades.timeline(a.trades(spark, d), a.law_dates(spark, d), a.prices(spark, d))


@query("member_trade_summary", sql(""", n AS (SELECT member, ticker, count(*) AS n, count(*) FILTER (kind = 'buy') AS b, count(*) FILTER (kind = 'sell') AS s FROM trades GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY n DESC, ticker) AS rank FROM n)
    SELECT member, CAST(sum(n) AS BIGINT) AS n_trades, CAST(sum(b) AS BIGINT) AS buys, CAST(sum(s) AS BIGINT) AS sells,
        string_agg(CAST(ticker AS VARCHAR), ',' ORDER BY rank) FILTER (rank <= 8) AS top_tickers FROM r GROUP BY member""", "trades"))  # fmt: skip
def member_trade_summary(spark, d):
    return trades.member_summary(a.trades(spark, d))


@query("trades_page_search", sql("SELECT *, (SELECT count(*) FROM trades WHERE contains(CAST(ticker AS VARCHAR), '12')) AS total FROM trades WHERE contains(CAST(ticker AS VARCHAR), '12') ORDER BY trade_date DESC, ticker, member, kind, amount_low LIMIT 50 OFFSET 100", "trades"))
def trades_page_search(spark, d):
    hits = a.trades(spark, d).where(F.col("ticker").cast("string").contains("12"))
    return trades.page(hits, [F.desc("trade_date"), "ticker", "member", "kind", "amount_low"], 2, 50)


_LABELS = "CASE " + " ".join(f"WHEN amount_low >= {low} THEN '{label}'" for low, label in trades.AMOUNT_RANGES) + f" WHEN amount_low IS NOT NULL THEN '{trades.AMOUNT_RANGES[-1][1]}' END"


@query("amount_range_label", sql(f"SELECT {_LABELS} AS label, kind, count(*) AS n, min(amount_low) AS least, max(amount_low) AS most FROM trades GROUP BY ALL", "trades"))
def amount_range_label(spark, d):
    t = a.trades(spark, d)
    return t.groupBy(trades.amount_label(F.col("amount_low")).alias("label"), "kind").agg(F.count("*").alias("n"), F.min("amount_low").alias("least"), F.max("amount_low").alias("most"))


@query("lobby_profile_quarters", sql("SELECT registrant, year(filed) || ' Q' || quarter(filed) AS quarter, CAST(sum(cents) AS BIGINT) / 100.0::DOUBLE AS spend, count(*) AS filings FROM filings GROUP BY 1, 2", "filings"))
def lobby_profile_quarters(spark, d):
    return money.profile_quarters(a.filings(spark, d))


@query("lobby_profile_counterparties", sql(""", s AS (SELECT registrant, client, CAST(sum(cents) AS BIGINT) AS c FROM filings GROUP BY ALL)
    SELECT registrant, client, c / 100.0::DOUBLE AS spend, CAST(row_number() OVER (PARTITION BY registrant ORDER BY c DESC, client) AS INTEGER) AS rank FROM s QUALIFY rank <= 12""", "filings"))  # fmt: skip
def lobby_profile_counterparties(spark, d):
    return money.profile_counterparties(a.filings(spark, d))


@query("lobby_profile_issues", sql(""", s AS (SELECT registrant, issue, count(*) AS n FROM filings GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (PARTITION BY registrant ORDER BY n DESC, issue) AS INTEGER) AS rank FROM s QUALIFY rank <= 12""", "filings"))  # fmt: skip
def lobby_profile_issues(spark, d):
    return money.profile_issues(a.filings(spark, d))


@query("lobby_profile_bills", sql(""", n AS (SELECT filing, bill, count(*) AS m FROM activities GROUP BY ALL),
    s AS (SELECT registrant, bill, CAST(sum(m) AS BIGINT) AS mentions, CAST(sum(cents) AS BIGINT) AS c FROM n JOIN filings USING (filing) GROUP BY ALL)
    SELECT registrant, bill, mentions, c / 100.0::DOUBLE AS bill_spend,
        CAST(row_number() OVER (PARTITION BY registrant ORDER BY mentions DESC, c DESC, bill) AS INTEGER) AS rank FROM s QUALIFY rank <= 24""", "filings", "activities"))  # fmt: skip
def lobby_profile_bills(spark, d):
    return money.profile_bills(a.filings(spark, d), a.activities(spark, d))


@query("lobby_bill_merge_ci", sql(""", m AS (SELECT bill, CASE WHEN filing % 2 = 0 THEN upper(client) ELSE client END AS entity, issue AS kind, count(*) AS mentions, max(cents) AS entity_cents
    FROM activities JOIN filings USING (filing) GROUP BY ALL)
    SELECT bill, arg_max(entity, (mentions, entity, kind)) AS entity, arg_max(kind, (mentions, entity, kind)) AS kind,
        CAST(sum(mentions) AS BIGINT) AS mentions, max(entity_cents) AS entity_cents FROM m GROUP BY bill, upper(entity)""", "filings", "activities"))  # fmt: skip
def lobby_bill_merge_ci(spark, d):
    activities, filings = a.activities(spark, d), a.filings(spark, d).select("filing", "client", "issue", "cents")
    n = tasks(activities)
    named = spread(activities, n, "filing").join(spread(filings, n, "filing"), "filing").withColumn("entity", F.when(F.col("filing") % 2 == 0, F.upper("client")).otherwise(F.col("client")))
    named = spread(named.withColumn("key", F.upper("entity")), n, "bill", "key")
    return money.merge_names(named.groupBy("bill", "key", "entity", F.col("issue").alias("kind")).agg(F.count("*").alias("mentions"), F.max("cents").alias("entity_cents")))


@query("lobby_entity_rank", "SELECT c_name, starts_with(lower(c_name), 'customer#0000001') AS starts, CAST(length(c_name) AS INTEGER) AS length FROM customer WHERE contains(lower(c_name), 'customer#0000001') ORDER BY 2 DESC, 3, 1 LIMIT 10")
def lobby_entity_rank(spark, d):
    return money.search_rank(a.table(spark, d, "customer"), "c_name", "Customer#0000001")


@query("pac_totals_two_cycle", sql("SELECT candidate, pac, CAST(sum(cents) AS BIGINT) / 100.0::DOUBLE AS total, count(*) AS gifts FROM contributions WHERE cycle IN (1998, 1996) GROUP BY 1, 2", "contributions"))
def pac_totals_two_cycle(spark, d):
    return money.pac_totals(a.contributions(spark, d), 1998)


@query("pac_interest_share", sql(""", p AS (SELECT candidate, interest, pac, CAST(sum(cents) AS BIGINT) AS c FROM contributions GROUP BY ALL),
    q AS (SELECT *, row_number() OVER (PARTITION BY candidate, interest ORDER BY c DESC, pac) AS r FROM p),
    s AS (SELECT candidate, interest, CAST(sum(c) AS BIGINT) AS c, string_agg(pac, '; ' ORDER BY r) FILTER (r <= 4) AS top_pacs FROM q GROUP BY ALL)
    SELECT candidate, interest, c / 100.0::DOUBLE AS total, floor(CAST(c AS DOUBLE) / CAST(sum(c) OVER (PARTITION BY candidate) AS DOUBLE) * 1000 + 0.5) / 1000 AS share, top_pacs,
        CAST(row_number() OVER (PARTITION BY candidate ORDER BY c DESC, interest) AS INTEGER) AS rank FROM s QUALIFY rank <= 12""", "contributions"))  # fmt: skip
def pac_interest_share(spark, d):
    return money.interest_shares(a.contributions(spark, d))


@query("industry_pick_cycle", sql(""", b AS (SELECT * FROM contributions WHERE cycle IN (1998, 1996)),
    k AS (SELECT candidate, cycle, coalesce(sum(cents) FILTER (interest <> 'MACHINERY'), 0) AS known FROM b GROUP BY ALL),
    best AS (SELECT candidate, arg_max(cycle, (known, cycle)) AS cycle FROM k GROUP BY 1),
    s AS (SELECT candidate, cycle, interest, CAST(sum(cents) AS BIGINT) AS c FROM b JOIN best USING (candidate, cycle) GROUP BY ALL)
    SELECT candidate, cycle, interest, c / 100.0::DOUBLE AS total, CAST(row_number() OVER (PARTITION BY candidate ORDER BY c DESC, interest) AS INTEGER) AS rank
    FROM s WHERE interest <> 'MACHINERY' QUALIFY rank <= 10
    UNION ALL SELECT candidate, cycle, 'Unclassified employers', c / 100.0::DOUBLE, 11 FROM s WHERE interest = 'MACHINERY'""", "contributions"))  # fmt: skip
def industry_pick_cycle(spark, d):
    return money.pick_cycle(a.contributions(spark, d), "MACHINERY", 1998)


@query("finance_latest_cycle", sql("SELECT candidate, cycle, CAST(sum(cents) AS BIGINT) / 100.0::DOUBLE AS receipts FROM contributions GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY cycle DESC) = 1", "contributions"))
def finance_latest_cycle(spark, d):
    return money.latest_cycle(a.contributions(spark, d))


@query("finance_composition_unpivot", sql(""", t AS (SELECT candidate, CAST(sum(cents) AS BIGINT) AS "all" FROM contributions GROUP BY 1),
    s AS (SELECT candidate, CASE WHEN interest IN ('BUILDING', 'AUTOMOBILE', 'FURNITURE') THEN interest ELSE 'Other' END AS segment, CAST(sum(cents) AS BIGINT) AS c FROM contributions GROUP BY ALL)
    SELECT candidate, segment, c / 100.0::DOUBLE AS amount, floor(CAST(c AS DOUBLE) / CAST("all" AS DOUBLE) * 1000 + 0.5) / 1000 AS share
    FROM s JOIN t USING (candidate) WHERE segment <> 'Other' OR c > 0.02 * "all" """, "contributions"))  # fmt: skip
def finance_composition_unpivot(spark, d):
    return money.composition(a.contributions(spark, d), ["BUILDING", "AUTOMOBILE", "FURNITURE"])
