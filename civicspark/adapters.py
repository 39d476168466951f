"""The shapes of the domain over the given tables, as DataFrames and as SQL of the same rows.

Money is held in whole cents so that sums don't depend on the order of their terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import spread, table, tasks

#: The SQL twin of each adapter below.
SQL = {
    "trades": """SELECT l_partkey AS ticker, l_suppkey AS member, CAST(l_shipdate AS DATE) AS trade_date,
        CASE l_returnflag WHEN 'A' THEN 'buy' WHEN 'R' THEN 'sell' ELSE 'exchange' END AS kind,
        CAST(floor(l_extendedprice) AS BIGINT) AS amount_low FROM lineitem""",
    "prices": """SELECT l_partkey AS ticker, CAST(l_shipdate AS DATE) AS price_date, max(l_extendedprice / l_quantity) AS "close"
        FROM lineitem GROUP BY 1, 2""",
    "sectors": "SELECT p_partkey AS ticker, p_type AS sector, p_name AS company FROM part",
    "law_dates": """SELECT l_partkey AS ticker, min(CAST(o_orderdate AS DATE)) AS event_date
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
    "filings": """SELECT o_orderkey AS filing, c_name AS client, n_name AS registrant, c_mktsegment AS issue,
        CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents, CAST(o_orderdate AS DATE) AS filed
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "activities": "SELECT l_orderkey AS filing, l_partkey AS bill FROM lineitem",
    "contributions": """SELECT c_nationkey AS candidate, c_mktsegment || '/' || o_orderpriority AS pac, c_mktsegment AS interest,
        CAST(year(o_orderdate) + year(o_orderdate) % 2 AS INTEGER) AS cycle, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "positions": """SELECT l_orderkey AS vote_id, l_suppkey AS member,
        CASE l_returnflag WHEN 'A' THEN 'aye' WHEN 'N' THEN 'no' ELSE 'abstain' END AS position FROM lineitem""",
    "votes": """SELECT l_orderkey AS vote_id, count(*) FILTER (l_returnflag = 'A') AS aye, count(*) FILTER (l_returnflag = 'N') AS "no",
        count(*) FILTER (l_returnflag = 'R') AS abstain FROM lineitem GROUP BY 1""",
    "meetings": """SELECT o_orderkey AS meeting_id, o_orderpriority AS body, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS status FROM orders""",
    "log": """SELECT event_id, user_id, event_type AS query_type, ts, "value", CAST(json_extract_string(props, '$.k') AS BIGINT) AS results FROM events""",
    "actions": """SELECT event_id, user_id AS bill, ts, event_type AS state,
        CASE event_type WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS priority FROM events""",
}


def sql(body: str, *names: str) -> str:
    """body after the named adapters as common table expressions; a body that has its own starts with a comma."""
    head = "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"{head}{body}" if body.lstrip().startswith(",") else f"{head} {body}"


def cents(amount: str) -> Column:
    return F.floor(F.col(amount) * 100 + 0.5).cast("long")


def trades(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "buy").when(F.col("l_returnflag") == "R", "sell").otherwise("exchange")
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("ticker"), F.col("l_suppkey").alias("member"), F.col("l_shipdate").cast("date").alias("trade_date"),
        kind.alias("kind"), F.floor("l_extendedprice").cast("long").alias("amount_low"),
    )


def prices(spark: SparkSession, d: str) -> DataFrame:
    close = F.max(F.col("l_extendedprice") / F.col("l_quantity"))
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("price_date")).agg(close.alias("close"))


def sectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("ticker"), F.col("p_type").alias("sector"), F.col("p_name").alias("company"))


def law_dates(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    n = tasks(lines)
    joined = spread(lines, n, "l_orderkey").join(spread(orders, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("l_partkey").alias("ticker")).agg(F.min(F.col("o_orderdate").cast("date")).alias("event_date"))


def filings(spark: SparkSession, d: str) -> DataFrame:
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    n = tasks(orders, customer)
    joined = spread(orders, n, "o_custkey").join(spread(customer, n, "c_custkey"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("o_orderkey").alias("filing"), F.col("c_name").alias("client"), F.col("n_name").alias("registrant"),
        F.col("c_mktsegment").alias("issue"), cents("o_totalprice").alias("cents"), F.col("o_orderdate").cast("date").alias("filed"),
    )


def activities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("filing"), F.col("l_partkey").alias("bill"))


def contributions(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    year = F.year("o_orderdate")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("c_nationkey").alias("candidate"), F.concat_ws("/", "c_mktsegment", "o_orderpriority").alias("pac"),
        F.col("c_mktsegment").alias("interest"), (year + year % 2).alias("cycle"), cents("o_totalprice").alias("cents"),
    )


def positions(spark: SparkSession, d: str) -> DataFrame:
    position = F.when(F.col("l_returnflag") == "A", "aye").when(F.col("l_returnflag") == "N", "no").otherwise("abstain")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("vote_id"), F.col("l_suppkey").alias("member"), position.alias("position"))


def votes(spark: SparkSession, d: str) -> DataFrame:
    of = lambda p: F.count_if(F.col("position") == p).alias(p)
    return positions(spark, d).groupBy("vote_id").agg(of("aye"), of("no"), of("abstain"))


def meetings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("meeting_id"), F.col("o_orderpriority").alias("body"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderstatus").alias("status"))


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("query_type"), "ts", "value", F.get_json_object("props", "$.k").cast("long").alias("results"))


#: How far along each state of an item is.
PRIORITY = {"purchase": 4, "signup": 3, "click": 2, "view": 1}


def actions(spark: SparkSession, d: str) -> DataFrame:
    rank = F.coalesce(*[F.when(F.col("event_type") == s, p) for s, p in PRIORITY.items()], F.lit(0))
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("bill"), "ts", F.col("event_type").alias("state"), rank.alias("priority"))


def phrase(key: str, values: list[str], **parts: str) -> str:
    """An expression, the same in both dialects, that picks one of the texts by a whole-number column and fills {name}
    with that part; {nl} is a line's end. Texts hold no quotes or backslashes."""
    text = f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
    for name, expression in {**parts, "nl": "chr(10)"}.items():
        text = f"replace({text}, '{{{name}}}', CAST({expression} AS STRING))"
    return text
