"""Votes, record quality, events and windows, each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as a
from ..adapters import sql
from ..io import table
from ..operators import money, records, temporal
from ..registry import query


@query("vote_tally_pivot", sql("SELECT vote_id, aye, \"no\", abstain, CASE WHEN aye > \"no\" THEN 'pass' ELSE 'fail' END AS result FROM votes", "votes"))
def vote_tally_pivot(spark, d):
    return a.votes(spark, d).withColumn("result", records.result_of())


@query("vote_counts_map", sql("""SELECT vote_id, string_agg(position || '=' || n, ',' ORDER BY position) AS counts
    FROM (SELECT vote_id, position, count(*) AS n FROM positions GROUP BY ALL) z GROUP BY 1""", "positions"))  # fmt: skip
def vote_counts_map(spark, d):
    n = a.positions(spark, d).groupBy("vote_id", "position").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.concat_ws("=", "position", "n")))
    return n.groupBy("vote_id").agg(F.array_join(pairs, ",").alias("counts"))


@query("votes_orphans", sql("SELECT meeting_id, body, \"day\", status FROM meetings WHERE meeting_id NOT IN (SELECT l_orderkey FROM lineitem)", "meetings"))
def votes_orphans(spark, d):
    return records.orphans(a.meetings(spark, d), table(spark, d, "lineitem"), "meeting_id", "l_orderkey")


@query("votes_unknown_voter", sql("SELECT DISTINCT member FROM positions WHERE member NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)", "positions"))
def votes_unknown_voter(spark, d):
    roster = table(spark, d, "supplier").where("s_nationkey < 20")
    return records.orphans(a.positions(spark, d).select("member").distinct(), roster, "member", "s_suppkey")


@query("votes_dup", sql("SELECT vote_id, member, count(*) AS n FROM positions GROUP BY ALL HAVING count(*) > 1", "positions"))
def votes_dup(spark, d):
    return a.positions(spark, d).groupBy("vote_id", "member").agg(F.count("*").alias("n")).where("n > 1")


#: A copy of the votes with planted faults: tallies raised by one, results turned round.
_PLANTED = """, planted AS (SELECT vote_id, CASE WHEN vote_id % 97 = 0 THEN aye + 1 ELSE aye END AS aye, "no",
    CASE WHEN (aye > "no") <> (vote_id % 89 = 0) THEN 'pass' ELSE 'fail' END AS result FROM votes)"""


def _planted(spark, d):
    flip = (F.col("aye") > F.col("no")) != (F.col("vote_id") % 89 == 0)
    raised = F.when(F.col("vote_id") % 97 == 0, F.col("aye") + 1).otherwise(F.col("aye"))
    return a.votes(spark, d).select("vote_id", raised.alias("aye"), "no", F.when(flip, "pass").otherwise("fail").alias("result"))


@query("findings_all", sql(_PLANTED + """, known AS (SELECT * FROM meetings WHERE meeting_id % 11 <> 0)
    SELECT 'consistency' AS layer, 'orphan_vote' AS "check", CAST(vote_id AS VARCHAR) AS ref, 'no such meeting' AS message FROM planted WHERE vote_id NOT IN (SELECT meeting_id FROM known)
    UNION ALL SELECT 'consistency', 'count_mismatch', CAST(p.vote_id AS VARCHAR), concat_ws('-', p.aye, p."no", v.aye, v."no") FROM planted p JOIN votes v USING (vote_id) WHERE p.aye <> v.aye
    UNION ALL SELECT 'consistency', 'result_vs_tally', CAST(vote_id AS VARCHAR), concat_ws(' ', result, aye, "no") FROM planted WHERE result <> CASE WHEN aye > "no" THEN 'pass' ELSE 'fail' END""", "votes", "meetings"))  # fmt: skip
def findings_all(spark, d):
    return records.consistency(_planted(spark, d), a.positions(spark, d), a.meetings(spark, d).where("meeting_id % 11 <> 0"))


@query("reconcile_multiset", sql(""", b AS (SELECT vote_id, CASE WHEN member % 50 = 7 THEN 'absent' ELSE position END AS position FROM positions WHERE vote_id % 13 <> 0),
    c AS (SELECT vote_id, position, sum(x) AS a, sum(y) AS b FROM (SELECT vote_id, position, 1 AS x, 0 AS y FROM positions WHERE vote_id % 17 <> 0 UNION ALL SELECT vote_id, position, 0, 1 FROM b) u GROUP BY ALL),
    k AS (SELECT vote_id, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b, CAST(sum(abs(a - b)) AS BIGINT) AS apart FROM c GROUP BY 1)
    SELECT vote_id, CASE WHEN b = 0 THEN 'missing_in_second' WHEN a = 0 THEN 'missing_in_first' WHEN a <> b THEN 'multiplicity' ELSE 'mismatch' END AS "check", a, b, apart FROM k WHERE apart > 0""", "positions"))  # fmt: skip
def reconcile_multiset(spark, d):
    p = a.positions(spark, d)
    other = p.where("vote_id % 13 <> 0").withColumn("position", F.when(F.col("member") % 50 == 7, "absent").otherwise(F.col("position")))
    return records.reconcile(p.where("vote_id % 17 <> 0"), other, "vote_id", "position")


@query("certify_status", sql("""SELECT meeting_id, body, "day", m.status AS order_status, CASE WHEN meeting_id % 7 = 0 THEN 'disputed' WHEN meeting_id IN (SELECT l_orderkey FROM lineitem) THEN 'certified' ELSE 'unverified' END AS status FROM meetings m""", "meetings"))
def certify_status(spark, d):
    m = a.meetings(spark, d).withColumnRenamed("status", "order_status")
    return records.certify(m, m.where("meeting_id % 7 = 0"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("meeting_id")), "meeting_id")


@query("coverage_rollup", "SELECT source, count(*) AS docs, count(*) FILTER (quality = 1) AS certified, count(*) FILTER (toxic = 1) AS disputed FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source)")
def coverage_rollup(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return rows.rollup("source").agg(F.count("*").alias("docs"), F.count_if(F.col("quality") == 1).alias("certified"), F.count_if(F.col("toxic") == 1).alias("disputed"))


@query("floor_vote_pick", sql(""", v AS (SELECT vote_id, aye + "no" + abstain AS participation, aye > 2 * "no" AS marker, m.body AS chamber, m."day" FROM votes JOIN meetings m ON vote_id = meeting_id)
    SELECT * FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY chamber, "day" ORDER BY marker DESC, participation DESC, vote_id) = 1) z WHERE marker OR participation * 2 >= 8""", "votes", "meetings"))  # fmt: skip
def floor_vote_pick(spark, d):
    v = a.votes(spark, d).join(a.meetings(spark, d), F.col("vote_id") == F.col("meeting_id"))
    v = v.select("vote_id", (F.col("aye") + F.col("no") + F.col("abstain")).alias("participation"), (F.col("aye") > 2 * F.col("no")).alias("marker"), F.col("body").alias("chamber"), "day")
    best = records.first_by(v, ["chamber", "day"], [F.desc("marker"), F.desc("participation"), "vote_id"])
    return best.where(F.col("marker") | (F.col("participation") * 2 >= 8))


@query("golden_diff", """SELECT k AS o_orderkey, CASE WHEN f IS NULL THEN 'missing' WHEN g IS NULL THEN 'extra' ELSE 'changed' END AS difference FROM (
    SELECT coalesce(g.o_orderkey, f.o_orderkey) AS k, g.o_orderstatus AS g, f.s AS f FROM (SELECT * FROM orders WHERE o_orderkey % 19 <> 0) g
    FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 23 <> 0) f USING (o_orderkey)) z WHERE g IS DISTINCT FROM f""")  # fmt: skip
def golden_diff(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    found = o.where("o_orderkey % 23 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 31 == 0, "X").otherwise(F.col("o_orderstatus")))
    return records.golden_diff(o.where("o_orderkey % 19 <> 0"), found, "o_orderkey", "o_orderstatus")


@query("merge_upsert_latest", "SELECT o_custkey, arg_max(o_orderkey, (o_orderkey % 2, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def merge_upsert_latest(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return records.merge_latest(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey", "o_orderkey")


@query("merge_new_only", "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def merge_new_only(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return records.merge_new(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey")


@query("doc_duplicates_md5", "SELECT md5(coalesce(text, '')) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def doc_duplicates_md5(spark, d):
    return records.duplicates(table(spark, d, "documents"), F.coalesce("text", F.lit("")), "doc_id")


@query("duplicate_documents", """SELECT md5(text) AS digest, count(DISTINCT doc_id) AS meetings, count(DISTINCT 'https://' || source || '/' || lang) AS urls, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) > 1 AND count(DISTINCT 'https://' || source || '/' || lang) > 1""")
def duplicate_documents(spark, d):
    """Bytes that several meetings are backed by from several addresses; one address may serve many meetings."""
    docs = table(spark, d, "documents").where("text is not null").select(F.md5("text").alias("digest"), "doc_id", F.concat(F.lit("https://"), "source", F.lit("/"), "lang").alias("url"))
    n = docs.groupBy("digest").agg(F.countDistinct("doc_id").alias("meetings"), F.countDistinct("url").alias("urls"), F.min("doc_id").alias("first_id"))
    return n.where("meetings > 1 AND urls > 1")


@query("duplicate_quotes", r"""WITH q AS (SELECT conv_id % 3 AS meeting, conv_id * 100 + turn AS vote, trim(regexp_replace(coalesce(text, ''), '[ \t\n\f\r]+', ' ', 'g')) AS quote FROM conversations)
    SELECT meeting, min(vote) OVER w AS first_vote, vote FROM q WHERE quote <> '' WINDOW w AS (PARTITION BY meeting, quote) QUALIFY row_number() OVER (PARTITION BY meeting, quote ORDER BY vote) > 1""")
def duplicate_quotes(spark, d):
    """Votes of a meeting that cite the same words, white space aside, as an earlier one."""
    quote = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\f\r]+", " "))
    rows = table(spark, d, "conversations").select((F.col("conv_id") % 3).alias("meeting"), (F.col("conv_id") * 100 + F.col("turn")).alias("vote"), quote.alias("quote")).where("quote <> ''")
    first = rows.groupBy("meeting", "quote").agg(F.min("vote").alias("first_vote"))
    return rows.join(first, ["meeting", "quote"]).where("vote > first_vote").select("meeting", "first_vote", "vote")


@query("dedup_first", "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedup_first(spark, d):
    return records.first_by(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("priority_coalesce", sql("SELECT bill, state, priority, event_id FROM actions QUALIFY row_number() OVER (PARTITION BY bill ORDER BY priority DESC, event_id) = 1", "actions"))
def priority_coalesce(spark, d):
    return records.first_by(a.actions(spark, d).drop("ts"), ["bill"], [F.desc("priority"), "event_id"])


@query("state_transitions", sql(""", b AS (SELECT *, coalesce(lag(priority) OVER (PARTITION BY bill ORDER BY ts, event_id), 0) AS "before" FROM actions)
    SELECT event_id, bill, state, priority, "before", priority > "before" AND state IN ('purchase', 'signup') AS notify FROM b""", "actions"))  # fmt: skip
def state_transitions(spark, d):
    return records.transitions(a.actions(spark, d), ["purchase", "signup"]).drop("ts")


@query("rate_limit_daily", sql("SELECT user_id, query_type, CAST(ts AS DATE) AS \"day\", count(*) AS n, count(*) > 5 AS \"limited\" FROM log GROUP BY 1, 2, 3", "log"))
def rate_limit_daily(spark, d):
    n = a.log(spark, d).groupBy("user_id", "query_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return n.withColumn("limited", F.col("n") > 5)


@query("ttl_valid_rows", sql("SELECT event_id, results FROM log WHERE date_diff('second', ts, (SELECT max(ts) FROM log)) < CASE WHEN results = 0 THEN 7200 ELSE 172800 END", "log"))
def ttl_valid_rows(spark, d):
    rows = a.log(spark, d)
    now = rows.agg(F.max("ts").alias("now"))
    seconds = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000)
    ttl = F.when(F.col("results") == 0, 7200).otherwise(172800)
    return rows.crossJoin(F.broadcast(now)).where(seconds("now") - seconds("ts") < ttl).select("event_id", "results")


@query("usage_top_queries", sql("SELECT lower(query_type) AS query_type, count(*) AS n, count(*) FILTER (results < 10) AS few FROM log GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10", "log"))
def usage_top_queries(spark, d):
    n = a.log(spark, d).groupBy(F.lower("query_type").alias("query_type")).agg(F.count("*").alias("n"), F.count_if(F.col("results") < 10).alias("few"))
    return n.orderBy(F.desc("n"), "query_type").limit(10)


@query("usage_daily", sql("SELECT CAST(ts AS DATE) AS \"day\", count(*) AS n, count(DISTINCT user_id) AS users FROM log GROUP BY 1", "log"))
def usage_daily(spark, d):
    return a.log(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("ledger_by_kind_rollup", """SELECT event_type AS kind, strftime(ts, '%Y-%m-%d') AS "day", CAST(sum(CAST(floor("value" * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ROLLUP (1, 2)""")
def ledger_by_kind_rollup(spark, d):
    return table(spark, d, "events").rollup(F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum(a.cents("value")).alias("cents"))


@query("interval_merge_islands", """WITH i AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + 1 AS e, count(*) AS n FROM lineitem GROUP BY ALL),
    r AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r)
    SELECT k, min(s) AS s, max(e) AS e, CAST(sum(n) AS BIGINT) AS parts FROM g GROUP BY k, island""")
def interval_merge_islands(spark, d):
    day = F.col("l_shipdate").cast("date")
    return temporal.merge_intervals(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), day.alias("s"), F.date_add(day, 1).alias("e")), "k", "s", "e")


@query("running_budget_prefix", "WITH r AS (SELECT conv_id, turn, CAST(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM conversations) SELECT * FROM r WHERE running <= 1000")
def running_budget_prefix(spark, d):
    sized = table(spark, d, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    return records.budget_prefix(sized, "conv_id", "turn", "size", 1000).select("conv_id", "turn", "running")


@query("grouping_sets_extra", """SELECT l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag) + 0 AS INTEGER) AS g, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def grouping_sets_extra(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("int").alias("g"), F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("analytic_functions_extra", """SELECT o_orderkey, CAST(ntile(4) OVER w AS INTEGER) AS quartile, lag(o_orderkey) OVER w AS "before", lead(o_orderkey) OVER w AS "after", CAST(rank() OVER w AS INTEGER) AS "rank"
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")  # fmt: skip
def analytic_functions_extra(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.ntile(4).over(w).alias("quartile"), F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"), F.rank().over(w).alias("rank"))


@query("set_operations_extra", "(SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R') EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal < 0")
def set_operations_extra(spark, d):
    lines = table(spark, d, "lineitem")
    of = lambda flag: lines.where(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("k"))
    return of("A").intersect(of("R")).exceptAll(table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("k")).distinct())
