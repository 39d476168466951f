"""Rollups, ranked lists, filters and windows over records, each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as a
from ..adapters import phrase, sql
from ..functions import people as p
from ..io import spread, table, tasks
from ..operators import records, seats
from ..registry import query


def _rank(name: str, *by, order) -> F.Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias(name)


@query("member_first_trades", sql(""", r AS (SELECT member, ticker, trade_date, amount_low, kind, row_number() OVER (PARTITION BY member ORDER BY trade_date DESC NULLS LAST, ticker, amount_low, kind) AS i FROM trades)
    SELECT member, CAST(i AS INTEGER) AS i, ticker, trade_date, amount_low FROM r WHERE i <= 40""", "trades"))  # fmt: skip
def member_first_trades(spark, d):
    """A member's forty newest trades, undated ones last."""
    rows = a.trades(spark, d).select("*", _rank("i", "member", order=[F.desc_nulls_last("trade_date"), "ticker", "amount_low", "kind"]))
    return rows.where("i <= 40").select("member", "i", "ticker", "trade_date", "amount_low")


@query("holdings_index", sql("""SELECT ticker, member, count(*) AS trades, min(trade_date) AS first, max(trade_date) AS last, any_value(company) AS company FROM trades JOIN sectors USING (ticker) GROUP BY 1, 2""", "trades", "sectors"))
def holdings_index(spark, d):
    n = a.trades(spark, d).groupBy("ticker", "member").agg(F.count("*").alias("trades"), F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))
    return n.join(a.sectors(spark, d).select("ticker", "company"), "ticker")


@query("traders_near", sql(""", n AS (SELECT ticker, member, count(*) AS trades, count(*) FILTER (event_date - trade_date BETWEEN -30 AND 75) AS near FROM trades JOIN law_dates USING (ticker) GROUP BY 1, 2)
    SELECT ticker, member, near, trades, CAST(row_number() OVER (PARTITION BY ticker ORDER BY near DESC, trades DESC, member) AS INTEGER) AS place FROM n""", "trades", "law_dates"))  # fmt: skip
def traders_near(spark, d):
    """A ticker's traders by how often they traded near its event, then by how often at all."""
    gap = F.datediff("event_date", "trade_date")
    trades = a.trades(spark, d)
    parts = tasks(trades)
    n = spread(trades, parts, "ticker").join(spread(a.law_dates(spark, d), parts, "ticker"), "ticker").groupBy("ticker", "member").agg(F.count("*").alias("trades"), F.count_if(gap.between(-30, 75)).alias("near"))
    return n.select("ticker", "member", "near", "trades", _rank("place", "ticker", order=[F.desc("near"), F.desc("trades"), "member"]))


@query("earliest_trades", sql("SELECT ticker, min(trade_date) AS first, DATE '1999-01-01' - min(trade_date) >= 365 AS old FROM trades GROUP BY 1", "trades"))
def earliest_trades(spark, d):
    first = a.trades(spark, d).groupBy("ticker").agg(F.min("trade_date").alias("first"))
    return first.withColumn("old", F.datediff(F.lit("1999-01-01").cast("date"), "first") >= 365)


@query("trade_search", sql("SELECT ticker, member, trade_date, kind FROM trades WHERE contains(CAST(ticker AS STRING), '7') OR contains(lower('Member ' || member), 'r 7')", "trades"))
def trade_search(spark, d):
    """Trades whose ticker or member holds what is looked for."""
    hit = F.col("ticker").cast("string").contains("7") | F.lower(F.concat(F.lit("Member "), F.col("member").cast("string"))).contains("r 7")
    return a.trades(spark, d).where(hit).select("ticker", "member", "trade_date", "kind")


@query("project_rollup", """SELECT p_type AS function, CAST(sum(p_size) AS BIGINT) AS five_year, count(*) AS projects, count(DISTINCT p_brand) AS districts FROM part GROUP BY 1""")
def project_rollup(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("function")).agg(F.sum(F.col("p_size").cast("long")).alias("five_year"), F.count("*").alias("projects"), F.countDistinct("p_brand").alias("districts"))


@query("project_filter", """SELECT p_partkey FROM part WHERE p_type = (SELECT min(p_type) FROM part) AND list_contains(string_split(p_brand, '#'), 'Brand') AND contains(lower(p_name || ' ' || p_type), 'a')""")
def project_filter(spark, d):
    """Projects of a function, in a district, with a word in their texts."""
    part = table(spark, d, "part")
    least = part.agg(F.min("p_type").alias("p_type"))  # one row
    chosen = part.join(F.broadcast(least), "p_type")
    return chosen.where(F.array_contains(F.split("p_brand", "#"), "Brand") & F.lower(F.concat_ws(" ", "p_name", "p_type")).contains("a")).select("p_partkey")


@query("policy_areas", """WITH q AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'None' ELSE o_orderpriority END AS area FROM orders) SELECT coalesce(area, 'Other') AS area, count(*) AS n FROM q WHERE area IS DISTINCT FROM 'None' GROUP BY 1""")
def policy_areas(spark, d):
    area = F.when(F.col("o_orderkey") % 5 == 0, None).when(F.col("o_orderkey") % 5 == 1, "None").otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select(F.coalesce(area, F.lit("Other")).alias("area")).where("area <> 'None'").groupBy("area").agg(F.count("*").alias("n"))


@query("years_served", """WITH t AS (SELECT o_custkey AS member, CAST(year(o_orderdate) AS INTEGER) AS start, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(year(o_orderdate) + 2 AS INTEGER) END AS "end", o_orderstatus AS chamber FROM orders)
    SELECT member, CAST(sum(coalesce("end", 2026) - start) AS BIGINT) AS years, count(DISTINCT chamber) AS chambers FROM t GROUP BY 1""")  # fmt: skip
def years_served(spark, d):
    start = F.year("o_orderdate")
    end = F.when(F.col("o_orderkey") % 4 != 0, start + 2)
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("member")).agg(F.sum((F.coalesce(end, F.lit(2026)) - start).cast("long")).alias("years"), F.countDistinct("o_orderstatus").alias("chambers"))


@query("member_attendance", sql("SELECT member, count(DISTINCT vote_id) FILTER (position <> 'abstain') AS present, count(DISTINCT vote_id) AS meetings FROM positions GROUP BY 1", "positions"))
def member_attendance(spark, d):
    seen = a.positions(spark, d).groupBy("member", "vote_id").agg(F.bool_or(F.col("position") != "abstain").alias("here"))
    return seen.groupBy("member").agg(F.count_if("here").alias("present"), F.count("*").alias("meetings"))


@query("absent_throughout", sql("SELECT vote_id % 100 AS meeting, member FROM positions GROUP BY ALL HAVING bool_and(position = 'abstain')", "positions"))
def absent_throughout(spark, d):
    """Members who were absent from all votes of a meeting."""
    p_ = a.positions(spark, d).groupBy((F.col("vote_id") % 100).alias("meeting"), "member").agg(F.bool_and(F.col("position") == "abstain").alias("away"))
    return p_.where("away").drop("away")


@query("topic_counts", sql("SELECT issue AS topic, count(*) AS n FROM filings GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10", "filings"))
def topic_counts(spark, d):
    return a.filings(spark, d).groupBy(F.col("issue").alias("topic")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(10)


@query("coverage_by_state", "SELECT substr(lpad(CAST(o_custkey AS STRING), 5, '0'), 1, 2) AS st, count(DISTINCT lpad(CAST(o_custkey AS STRING), 5, '0')) AS places FROM orders GROUP BY 1")
def coverage_by_state(spark, d):
    places = table(spark, d, "orders").select(F.lpad(F.col("o_custkey").cast("string"), 5, "0").alias("fips")).distinct()
    return places.groupBy(F.substring("fips", 1, 2).alias("st")).agg(F.count("*").alias("places"))


@query("tracked_bodies", """WITH n AS (SELECT o_custkey AS source, o_orderpriority AS body, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY ALL) SELECT source, body FROM n QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, first) = 1""")
def tracked_bodies(spark, d):
    """The most frequent body of a source, the first of several."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("body")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
    return n.groupBy("source").agg(F.max_by("body", F.struct("n", -F.col("first"))).alias("body"))


@query("experiment_metrics", """SELECT l_returnflag AS kind, count(*) AS planted, count(*) FILTER (l_linenumber % 5 <> 0) AS caught, count(*) FILTER (l_linenumber % 3 = 0) AS by_layer, floor(count(*) FILTER (l_linenumber % 5 <> 0) / count(*) * 1000 + 0.5) / 1000 AS recall FROM lineitem GROUP BY ROLLUP (1)""")
def experiment_metrics(spark, d):
    """Planted faults that were caught, by kind and over all."""
    caught = F.count_if(F.col("l_linenumber") % 5 != 0)
    m = table(spark, d, "lineitem").rollup(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("planted"), caught.alias("caught"), F.count_if(F.col("l_linenumber") % 3 == 0).alias("by_layer"))
    return m.withColumn("recall", F.floor(F.col("caught") / F.col("planted") * 1000 + 0.5) / 1000)


@query("subscribed_bills", "SELECT DISTINCT user_id AS bill FROM events WHERE event_type = 'signup'")
def subscribed_bills(spark, d):
    return table(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("bill")).distinct()


@query("sector_distribution", sql("SELECT sector, count(*) AS n, floor(count(*) / max(count(*)) OVER () * 1000 + 0.5) / 1000 AS bar FROM sectors GROUP BY 1", "sectors"))
def sector_distribution(spark, d):
    """Tickers of each sector and their share of the largest: the groups are as few as the sectors."""
    n = a.sectors(spark, d).groupBy("sector").agg(F.count("*").alias("n"))
    most = n.agg(F.max("n").alias("most"))  # one row
    return n.crossJoin(F.broadcast(most)).select("sector", "n", (F.floor(F.col("n") / F.col("most") * 1000 + 0.5) / 1000).alias("bar"))


@query("current_sessions", """WITH s AS (SELECT o_custkey AS st, o_orderkey AS session, year(o_orderdate) AS ends, o_orderstatus = 'P' AS special FROM orders) SELECT st, arg_max(session, (NOT special, ends, session)) AS session FROM s GROUP BY 1""")
def current_sessions(spark, d):
    """A state's newest session, a regular one before a special one."""
    order = F.struct(F.col("o_orderstatus") != "P", F.year("o_orderdate"), "o_orderkey")
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("st")).agg(F.max_by("o_orderkey", order).alias("session"))


@query("asserted_items", sql("""SELECT vote_id, position, string_agg(CAST(member AS STRING), ',' ORDER BY member) AS members, CASE WHEN count(*) FILTER (position = 'aye') OVER (PARTITION BY vote_id) > 0 THEN 1 END AS x FROM (SELECT DISTINCT vote_id, position, member FROM positions) z GROUP BY vote_id, position""", "positions").replace(", CASE WHEN count(*) FILTER (position = 'aye') OVER (PARTITION BY vote_id) > 0 THEN 1 END AS x", ""))
def asserted_items(spark, d):
    """The members of each position on a vote, a list by position; a chamber's members are few."""
    p_ = a.positions(spark, d).distinct().groupBy("vote_id", "position").agg(F.array_sort(F.collect_set("member")).alias("m"))
    return p_.select("vote_id", "position", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"))


@query("filed_states", sql("""SELECT c_custkey AS member, CASE WHEN t.n > 0 THEN 'trades' WHEN f.n > 0 THEN 'unreadable' ELSE 'never' END AS filed FROM customer LEFT JOIN (SELECT member, count(*) AS n FROM trades GROUP BY 1) t ON t.member = c_custkey LEFT JOIN (SELECT o_custkey AS member, count(*) AS n FROM orders GROUP BY 1) f ON f.member = c_custkey""", "trades"))
def filed_states(spark, d):
    """Whether a member's trades could be read, were filed but can't be read, or were never filed."""
    t_ = a.trades(spark, d).select("member").distinct().withColumn("t", F.lit(True))
    f_ = table(spark, d, "orders").select(F.col("o_custkey").alias("member")).distinct().withColumn("f", F.lit(True))
    both = table(spark, d, "customer").select(F.col("c_custkey").alias("member")).join(t_, "member", "left").join(f_, "member", "left")
    return both.select("member", F.when(F.col("t"), "trades").when(F.col("f"), "unreadable").otherwise("never").alias("filed"))


@query("upcoming_lists", sql(""", u AS (SELECT body, meeting_id, "day", regexp_replace(CASE meeting_id % 3 WHEN 0 THEN '17:00:00Z' WHEN 1 THEN '9:30' ELSE 'noon' END, '^(\\d{1,2}:\\d{2})(:\\d{2})?Z?$', '\\1') AS time FROM meetings WHERE "day" > DATE '1998-01-01')
    SELECT body, meeting_id, "day", time, CAST(row_number() OVER (PARTITION BY body ORDER BY "day", meeting_id) AS INTEGER) AS i FROM u QUALIFY i <= 5""", "meetings"))  # fmt: skip
def upcoming_lists(spark, d):
    """A body's five next meetings after today, their times as hours and minutes."""
    time = F.when(F.col("meeting_id") % 3 == 0, "17:00:00Z").when(F.col("meeting_id") % 3 == 1, "9:30").otherwise("noon")
    u = a.meetings(spark, d).where("day > DATE '1998-01-01'").select("body", "meeting_id", "day", F.regexp_replace(time, r"^(\d{1,2}:\d{2})(:\d{2})?Z?$", "$1").alias("time"))
    return u.select("*", _rank("i", "body", order=["day", "meeting_id"])).where("i <= 5")


@query("next_meetings", sql("SELECT body, min(\"day\") AS next FROM meetings WHERE \"day\" >= DATE '1998-01-01' GROUP BY 1", "meetings"))
def next_meetings(spark, d):
    return a.meetings(spark, d).where("day >= DATE '1998-01-01'").groupBy("body").agg(F.min("day").alias("next"))


@query("latest_contests", "SELECT o_custkey AS place, o_orderkey AS contest FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, month(o_orderdate) DESC, o_orderkey) = 1")
def latest_contests(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("place"), F.col("o_orderkey").alias("contest"), "o_orderdate")
    return records.first_by(o, ["place"], [F.desc(F.year("o_orderdate")), F.desc(F.month("o_orderdate")), "contest"]).drop("o_orderdate")


@query("repeated_ids", "WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS i FROM lineitem) SELECT CASE WHEN i > 1 THEN l_orderkey || '-' || l_linenumber || '#' || i ELSE l_orderkey || '-' || l_linenumber END AS id, l_partkey FROM r")
def repeated_ids(spark, d):
    """Ids made unique: the second of a name gets #2, and so on."""
    rows = table(spark, d, "lineitem").select("*", _rank("i", "l_orderkey", "l_linenumber", order=["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]))
    name = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return rows.select(F.when(F.col("i") > 1, F.concat_ws("#", name, "i")).otherwise(name).alias("id"), "l_partkey")


@query("token_batches", """WITH RECURSIVE s AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    b AS (SELECT conv_id, turn, i, n AS used, CAST(0 AS BIGINT) AS batch FROM s WHERE i = 1 UNION ALL SELECT s.conv_id, s.turn, s.i, CASE WHEN used + n > 400 THEN n ELSE used + n END, CASE WHEN used + n > 400 THEN batch + 1 ELSE batch END FROM b JOIN s ON s.conv_id = b.conv_id AND s.i = b.i + 1)
    SELECT conv_id, turn, batch FROM b""")  # fmt: skip
def token_batches(spark, d):
    sized = table(spark, d, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return seats.token_batches(sized, "conv_id", "turn", "n", 400).select("conv_id", "turn", "batch")


@query("seats_by_counts", sql(""", v AS (SELECT vote_id, aye, "no", abstain FROM votes), s AS (SELECT *, unnest(range(1, 11)) AS seat FROM v)
    SELECT vote_id, CAST(seat AS INTEGER) AS seat, CASE WHEN seat <= aye THEN 'aye' WHEN seat <= aye + abstain THEN 'abstain' WHEN seat <= aye + abstain + "no" THEN 'no' ELSE 'absent' END AS option FROM s""", "votes"))  # fmt: skip
def seats_by_counts(spark, d):
    """Ten seats of each vote filled from its counts, in the order in which a plan shows them."""
    return seats.filled_by_counts(a.votes(spark, d), 10, ["aye", "abstain", "no"])


@query("seated_members", """WITH m AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3, s_suppkey) AS seat FROM supplier), p(seat, x, y) AS (VALUES (1, -0.87, 0.5), (2, -0.28, 0.28), (3, 0.0, 1.0), (4, 0.28, 0.28), (5, 0.87, 0.5))
    SELECT s_suppkey, CAST(seat AS INTEGER) AS seat, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM m JOIN p USING (seat)""")  # fmt: skip
def seated_members(spark, d):
    """Members in the seats of a plan of five in two rows; the plan is a list of its seats."""
    plan = spark.createDataFrame([(s, x, y) for s, _, x, y in seats.chamber_plan(5, 2)], "seat int, x double, y double")
    members = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return seats.seated(members, F.broadcast(plan), "s_nationkey", [F.col("s_suppkey") % 3, "s_suppkey"]).select("s_suppkey", "seat", "x", "y")


@query("carried_headings", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, CASE WHEN l_linenumber = 4 THEN 'reset' WHEN l_returnflag = 'A' THEN 'type ' || l_partkey % 5 END AS heading, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS i FROM lineitem)
    SELECT l_orderkey, i, nullif(last_value(heading IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY i ROWS UNBOUNDED PRECEDING), 'reset') AS heading FROM r QUALIFY l_returnflag <> 'A' AND l_linenumber <> 4""")  # fmt: skip
def carried_headings(spark, d):
    """Entries with the heading above them; a table's end clears it."""
    heading = F.when(F.col("l_linenumber") == 4, "reset").when(F.col("l_returnflag") == "A", F.concat(F.lit("type "), (F.col("l_partkey") % 5).cast("string")))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    rows = table(spark, d, "lineitem").select("*", _rank("i", "l_orderkey", order=order), heading.alias("h"))
    w = Window.partitionBy("l_orderkey").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = rows.withColumn("heading", F.nullif(F.last("h", ignorenulls=True).over(w), F.lit("reset")))
    return carried.where("l_returnflag <> 'A' AND l_linenumber <> 4").select("l_orderkey", F.col("i").cast("long").alias("i"), "heading")


@query("wrapped_lists", """WITH l AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations), g AS (SELECT *, sum(CASE WHEN role <> 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS block FROM l)
    SELECT conv_id, CAST(block AS BIGINT) AS block, string_agg(t, ' ' ORDER BY turn) AS line FROM g GROUP BY conv_id, block""")  # fmt: skip
def wrapped_lists(spark, d):
    """Lines that go on with the block above them, as one line each."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = table(spark, d, "conversations").withColumn("block", F.sum((F.col("role") != "assistant").cast("int")).over(w))
    joined = lines.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))).alias("l"))
    return joined.select("conv_id", "block", F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("line"))


_ACTION = phrase("l_linenumber", ["On passage of the bill: Passed by voice", "Passed Senate by unanimous consent", "Referred", "On motion to agree: Agreed to in House", "Received", "passed/agreed to in senate"])


@query("first_by_chamber", f"""WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, {_ACTION} AS t FROM lineitem), m AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN regexp_matches(t, '(?i)on passage|on motion to|passed house') THEN 'House' WHEN regexp_matches(t, '(?i)passed(/agreed to in)? senate') THEN 'Senate' END AS chamber FROM q)
    SELECT l_orderkey, chamber, min(l_linenumber) AS line FROM m WHERE chamber IS NOT NULL GROUP BY 1, 2""")  # fmt: skip
def first_by_chamber(spark, d):
    """The first action of each chamber that records a vote."""
    t_ = F.expr(_ACTION)
    chamber = F.when(t_.rlike("(?i)on passage|on motion to|passed house"), "House").when(t_.rlike("(?i)passed(/agreed to in)? senate"), "Senate")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", chamber.alias("chamber")).where("chamber is not null").groupBy("l_orderkey", "chamber").agg(F.min("l_linenumber").alias("line"))


_DESC = phrase("o_orderkey", ["Third reading", "Subcommittee report", "House Committee vote", "Final passage", "Motion to table", "Floor amendment", "Concurrence"])


@query("floor_votes", sql(f""", v AS (SELECT o_custkey AS bill, o_orderkey AS vote_id, {_DESC} AS t, coalesce(aye + "no" + abstain, 0) AS n, CAST(o_orderdate AS DATE) AS "day" FROM orders LEFT JOIN votes ON vote_id = o_orderkey),
    f AS (SELECT *, regexp_matches(t, '(?i)floor|third reading|final passage|final reading|passage') AS marker FROM v WHERE NOT contains(lower(t), 'committee'))
    SELECT bill, vote_id, marker, n FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY bill ORDER BY marker DESC, n DESC, "day" DESC, vote_id) = 1) z WHERE marker OR n * 2 >= 12""", "votes"))  # fmt: skip
def floor_votes(spark, d):
    """The vote of a bill that decided: committees' votes aside, in a chamber of twelve."""
    v = table(spark, d, "orders").join(a.votes(spark, d), F.col("o_orderkey") == F.col("vote_id"), "left")
    v = v.select(F.col("o_custkey").alias("bill"), F.col("o_orderkey").alias("vote_id"), F.expr(_DESC).alias("desc"), F.coalesce(F.col("aye") + F.col("no") + F.col("abstain"), F.lit(0)).alias("participation"), F.col("o_orderdate").cast("date").alias("day"))
    return records.floor_vote(v, "bill", 12).select("bill", "vote_id", "marker", F.col("participation").alias("n"))


@query("attention_list", sql("""SELECT vote_id, CAST(CASE WHEN aye <= "no" THEN 0 WHEN "no" > 0 THEN 1 WHEN abstain > 0 THEN 2 END AS INTEGER) AS why FROM votes JOIN meetings ON meeting_id = vote_id WHERE aye <= "no" OR abstain > 0 OR "no" > 0 ORDER BY why, "day" DESC, vote_id LIMIT 6""", "votes", "meetings"))
def attention_list(spark, d):
    """Six votes to look at: failed, then with noes, then with abstentions, newest first."""
    why = F.when(F.col("aye") <= F.col("no"), 0).when(F.col("no") > 0, 1).when(F.col("abstain") > 0, 2)
    v = a.votes(spark, d).join(a.meetings(spark, d), F.col("meeting_id") == F.col("vote_id")).withColumn("why", why).where("why is not null")
    return v.orderBy("why", F.desc("day"), "vote_id").limit(6).select("vote_id", "why")


@query("related_bills", """WITH r AS (SELECT o_custkey AS bill, o_orderkey AS other, CASE o_orderstatus WHEN 'F' THEN 'identical' WHEN 'O' THEN 'related' ELSE 'superseded' END AS kind, o_orderdate FROM orders)
    SELECT bill, other, kind FROM r QUALIFY row_number() OVER (PARTITION BY bill, kind ORDER BY o_orderdate DESC, other) <= CASE kind WHEN 'related' THEN 5 ELSE 1 END""")  # fmt: skip
def related_bills(spark, d):
    """Of a bill's identical ones the newest, of related ones five, of those it replaces one."""
    kind = F.when(F.col("o_orderstatus") == "F", "identical").when(F.col("o_orderstatus") == "O", "related").otherwise("superseded")
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("bill"), F.col("o_orderkey").alias("other"), kind.alias("kind"), "o_orderdate")
    ranked = r.select("*", _rank("i", "bill", "kind", order=[F.desc("o_orderdate"), "other"]))
    return ranked.where(F.col("i") <= F.when(F.col("kind") == "related", 5).otherwise(1)).select("bill", "other", "kind")


@query("race_roster", sql("""SELECT candidate, pac, sum(cents) AS cents FROM contributions WHERE cycle = 1996 GROUP BY 1, 2 HAVING sum(cents) > 0 QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY sum(cents) DESC, pac) <= 5""", "contributions").replace("sum(cents) AS cents", "CAST(sum(cents) AS BIGINT) AS cents"))
def race_roster(spark, d):
    """A race's five best-funded, those without money left out."""
    n = a.contributions(spark, d).where("cycle = 1996").groupBy("candidate", "pac").agg(F.sum(F.coalesce("cents", F.lit(0))).alias("cents")).where("cents > 0")
    return n.select("*", _rank("i", "candidate", order=[F.desc("cents"), "pac"])).where("i <= 5").drop("i")


# What stands for no employer.
NO_EMPLOYER = [
    "NOT EMPLOYED", "RETIRED", "SELF", "SELF EMPLOYED", "SELF-EMPLOYED", "NONE", "N/A", "NA", "NULL", "HOMEMAKER", "UNEMPLOYED", "NOT APPLICABLE",
    "INFORMATION REQUESTED", "REQUESTED", "NOT PROVIDED", "", "NONE LISTED",
]
_EMPLOYERS = phrase("c_custkey", ["{n}", " Retired ", "self employed", "Not Provided", "", "none listed", "Self", "{n} Self", "n/a", "Information Requested", "Na", "unemployed"], n="c_name")


@query("employer_stop_list", f"""WITH q AS (SELECT c_custkey, upper(trim({_EMPLOYERS})) AS employer, c_acctbal FROM customer) SELECT c_custkey, employer FROM q WHERE employer NOT IN ({", ".join(f"'{x}'" for x in NO_EMPLOYER)}) AND c_acctbal > 0""")
def employer_stop_list(spark, d):
    """Employers that are some, with a total above zero."""
    rows = table(spark, d, "customer").select("c_custkey", F.upper(F.trim(F.expr(_EMPLOYERS))).alias("employer"), "c_acctbal")
    return rows.where(~F.col("employer").isin(NO_EMPLOYER) & (F.col("c_acctbal") > 0)).select("c_custkey", "employer")


@query("recent_feed", """WITH f AS (SELECT o_custkey AS rep, o_orderkey AS bill, o_orderdate FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-08-02' - 900) SELECT rep, bill, CAST(row_number() OVER (PARTITION BY rep ORDER BY o_orderdate DESC, bill) AS INTEGER) AS i FROM f QUALIFY i <= 3""")
def recent_feed(spark, d):
    """A representative's three newest bills since the cutoff."""
    f = table(spark, d, "orders").where(F.col("o_orderdate").cast("date") >= F.date_sub(F.lit("1998-08-02").cast("date"), 900))
    return f.select(F.col("o_custkey").alias("rep"), F.col("o_orderkey").alias("bill"), "o_orderdate").select("rep", "bill", _rank("i", "rep", order=[F.desc("o_orderdate"), "bill"])).where("i <= 3")


@query("feed_lede", """WITH r AS (SELECT o_custkey AS feed, o_orderkey AS bill, CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'O' THEN 3 ELSE 0 END AS rank, o_orderkey % 7 = 0 AS money FROM orders),
    o AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY money, rank DESC, bill) AS i FROM r) SELECT feed, bill, CASE WHEN i = 1 AND NOT money THEN 'lede' WHEN i <= 4 THEN 'top' ELSE 'rest' END AS place FROM o""")  # fmt: skip
def feed_lede(spark, d):
    """A feed's headline, three below it, and the rest: by status, money bills kept out of the headline."""
    rank = F.when(F.col("o_orderstatus") == "F", 5).when(F.col("o_orderstatus") == "O", 3).otherwise(0)
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("feed"), F.col("o_orderkey").alias("bill"), rank.alias("rank"), (F.col("o_orderkey") % 7 == 0).alias("money"))
    o = r.select("*", _rank("i", "feed", order=["money", F.desc("rank"), "bill"]))
    return o.select("feed", "bill", F.when((F.col("i") == 1) & ~F.col("money"), "lede").when(F.col("i") <= 4, "top").otherwise("rest").alias("place"))


@query("place_names", r"""WITH q AS (SELECT p_partkey, p_name || ' ' || CASE p_partkey % 4 WHEN 0 THEN 'Fire Station' WHEN 1 THEN 'Road Program' WHEN 2 THEN 'Library' ELSE 'Fund' END AS t FROM part) SELECT p_partkey FROM q WHERE regexp_matches(t, '(?i)station|library|park|school|road') AND NOT regexp_matches(t, '(?i)program|fund|study')""")
def place_names(spark, d):
    """Titles that name a place and no programme."""
    t_ = F.concat("p_name", F.lit(" "), F.expr("CASE p_partkey % 4 WHEN 0 THEN 'Fire Station' WHEN 1 THEN 'Road Program' WHEN 2 THEN 'Library' ELSE 'Fund' END"))
    return table(spark, d, "part").where(t_.rlike("(?i)station|library|park|school|road") & ~t_.rlike("(?i)program|fund|study")).select("p_partkey")


@query("office_labels", r"""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'House of Delegates (' || s_suppkey || ')' WHEN 1 THEN 'Senate' WHEN 2 THEN 'School Board (' || s_suppkey || ')' END AS office FROM supplier""")
def office_labels(spark, d):
    """The first office that a contest's name fits, with its district in brackets."""
    t_ = F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'Member House of Delegates (' || s_suppkey || 'th District)' WHEN 1 THEN 'State Senate' WHEN 2 THEN 'Member School Board (district ' || s_suppkey || ')' ELSE 'Other' END")
    named = [(r"(?i)house of delegates", "House of Delegates"), (r"(?i)senate", "Senate"), (r"(?i)school board", "School Board")]
    label = F.coalesce(*[F.when(t_.rlike(k), v) for k, v in named])
    district = F.nullif(F.regexp_extract(t_, r"\((?:district )?(\d+)", 1), F.lit(""))
    return table(spark, d, "supplier").select("s_suppkey", F.concat(label, F.coalesce(F.concat(F.lit(" ("), district, F.lit(")")), F.lit(""))).alias("office"))


@query("log_filter", sql("SELECT query_type, event_id FROM log WHERE query_type IN ('click', 'view') AND user_id % 2 = 0", "log"))
def log_filter(spark, d):
    return a.log(spark, d).where(F.col("query_type").isin("click", "view") & (F.col("user_id") % 2 == 0)).select("query_type", "event_id")


@query("named_amendments", """SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0""")
def named_amendments(spark, d):
    """Amendments whose title is more than their number."""
    title = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'S.Amdt. ' || o_orderkey WHEN 1 THEN 'To strike section 2' ELSE 'S.Amdt. 5 on roads' END")
    return table(spark, d, "orders").where(~title.rlike(r"(?i)^\s*[hs]\.?\s?amdt\.?\s*\d+\.?\s*$")).select("o_orderkey")


@query("cacheable_requests", sql("SELECT event_id, results > 0 AND query_type <> 'purchase' AND user_id % 10 <> 0 AS eligible FROM log", "log"))
def cacheable_requests(spark, d):
    """Requests that a cache may answer: not fresh, not over all history, not told to pass it by."""
    return a.log(spark, d).select("event_id", ((F.col("results") > 0) & (F.col("query_type") != "purchase") & (F.col("user_id") % 10 != 0)).alias("eligible"))


@query("newest_reports", "SELECT o_custkey AS bill, o_orderkey AS report, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END DESC NULLS LAST, o_orderkey) AS INTEGER) AS i FROM orders")
def newest_reports(spark, d):
    """Reports newest first, those without a date last."""
    day = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("bill"), F.col("o_orderkey").alias("report"), _rank("i", "o_custkey", order=[day.desc_nulls_last(), "o_orderkey"]))


@query("finance_segments", sql("SELECT candidate, cycle, CAST(sum(CASE WHEN interest LIKE 'A%' THEN cents ELSE 0 END) AS BIGINT) AS pac, CAST(sum(CASE WHEN interest NOT LIKE 'A%' THEN cents ELSE 0 END) AS BIGINT) AS individual FROM contributions GROUP BY 1, 2", "contributions"))
def finance_segments(spark, d):
    of = lambda c, name: F.sum(F.when(c, F.col("cents")).otherwise(0)).alias(name)
    pac = F.col("interest").startswith("A")
    return a.contributions(spark, d).groupBy("candidate", "cycle").agg(of(pac, "pac"), of(~pac, "individual"))


@query("golden_rows", sql("SELECT vote_id, string_agg(member || ':' || position, ',' ORDER BY member, position) AS positions FROM (SELECT DISTINCT vote_id, member, position FROM positions) z GROUP BY 1", "positions"))
def golden_rows(spark, d):
    """Votes as a golden file holds them: positions in order."""
    g = a.positions(spark, d).distinct().groupBy("vote_id").agg(F.array_sort(F.collect_list(F.struct("member", "position"))).alias("p"))
    return g.select("vote_id", F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["member"].cast("string"), x["position"])), ",").alias("positions"))


@query("zero_results", sql("SELECT lower(query_type) AS query_type, count(*) AS n FROM log WHERE results = 0 GROUP BY 1", "log"))
def zero_results(spark, d):
    """Searches that found nothing."""
    return a.log(spark, d).where("results = 0").groupBy(F.lower("query_type").alias("query_type")).agg(F.count("*").alias("n"))


@query("sliding_usage", sql("""SELECT d."day", count(*) AS n FROM (SELECT DISTINCT CAST(ts AS DATE) AS "day" FROM log) d JOIN log ON CAST(ts AS DATE) BETWEEN d."day" - 6 AND d."day" GROUP BY 1""", "log"))
def sliding_usage(spark, d):
    """Searches of the last seven days, day by day: days are summed first, so the window has a row a day."""
    daily = a.log(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    w = Window.orderBy(F.unix_date("day")).rangeBetween(-6, 0)
    return daily.select("day", F.sum("n").over(w).alias("n"))


@query("party_seats", """SELECT s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END, s_suppkey) AS INTEGER) AS seat, s_suppkey FROM supplier""")
def party_seats(spark, d):
    party = F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'D' WHEN 1 THEN 'I' WHEN 2 THEN 'L' ELSE 'R' END")
    return table(spark, d, "supplier").select("s_nationkey", _rank("seat", "s_nationkey", order=[p.party_rank(party), "s_suppkey"]), "s_suppkey")
