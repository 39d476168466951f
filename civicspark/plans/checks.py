"""Checks, floors, gates and matching of records, each query beside its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import adapters as a
from ..adapters import phrase, sql
from ..functions import text as t
from ..io import spread, table, tasks
from ..operators import checks as c
from ..operators import records
from ..registry import query

FILE_NUMBERS = phrase("o_orderkey", ["118-2024", "12-34", "", "2024-0012-S1", "x", "1-2024"])
RESULTS = phrase("o_orderkey", ["pass", "fail", "", "tie", "pass"])
DATES = phrase("o_orderkey", ["2024-01-{n}", "1/2/2024", "", "2024-02-03"], n="10 + o_orderkey % 20")
QUOTES = phrase("o_orderkey", ["Affirmative: {n}, Negative - 2", "Yeas: ({n}) and Nays (1)", "carried", "abstentions: {n}", "Yea ({m}); nay: {n}"], n="o_orderkey % 4", m="o_custkey % 3")
TITLES = phrase("o_orderkey", ["Approve Res 0529-2026", "A local law on bridges and roads", "Fiscal Impact Statement, exhibit b", "Item 5: motion", "Amend the county parks plan", "Adopted ord. 12"])


@query("structural_findings", f"""WITH q AS (SELECT o_orderkey, {FILE_NUMBERS} AS f, {RESULTS} AS r, {DATES} AS d FROM orders),
    m AS (SELECT 'meeting:' || o_orderkey AS ref, CASE WHEN d = '' THEN ['missing date'] WHEN NOT regexp_matches(d, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN ['date'] ELSE [] END AS why FROM q),
    v AS (SELECT 'vote_event:' || o_orderkey AS ref, CASE WHEN r = '' THEN ['missing result'] ELSE list_concat(CASE WHEN f <> '' AND NOT regexp_matches(f, '^\\d{{2,4}}-\\d{{4}}(-S\\d+)?$') THEN ['file_number'] ELSE [] END, CASE WHEN r NOT IN ('pass', 'fail') THEN ['result'] ELSE [] END) END AS why FROM q)
    SELECT 'structural' AS layer, 'schema' AS "check", ref, unnest(why) AS message FROM m UNION ALL SELECT 'structural', 'schema', ref, unnest(why) FROM v
    UNION ALL SELECT 'structural', 'schema', 'capital_project:' || p_partkey, 'total' FROM part WHERE p_size % 7 = 0
    UNION ALL SELECT 'structural', 'schema', 'contest:' || s_suppkey, 'votes' FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'structural', 'schema', 'contest:' || s_suppkey, 'year' FROM supplier WHERE s_suppkey % 5 = 0""")  # fmt: skip
def structural_findings(spark, d):
    q = table(spark, d, "orders").select("o_orderkey", F.nullif(F.expr(FILE_NUMBERS), F.lit("")).alias("file_number"), F.expr(RESULTS).alias("result"), F.expr(DATES).alias("date"))
    projects = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.when(F.col("p_size") % 7 == 0, -1).otherwise(F.col("p_size")).alias("total"))
    contests = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 == 0, "20x4").otherwise("2024").alias("year"), F.floor("s_acctbal").alias("votes"))
    return reduce(DataFrame.unionByName, [
        c.structural(q, "meeting", "o_orderkey", ["date"], date=~F.col("date").rlike(c.DATE)),
        c.structural(q, "vote_event", "o_orderkey", ["result"], file_number=~F.col("file_number").rlike(c.FILE_NUMBER), result=~F.col("result").isin("pass", "fail")),
        c.structural(projects, "capital_project", "p_partkey", ["title", "total"], total=F.col("total") < 0),
        c.structural(contests, "contest", "s_suppkey", ["year"], year=~F.col("year").rlike(r"^\d{4}$"), votes=F.col("votes") < 0),
    ])


@query("consistency_more", sql(f""", i AS (SELECT o_orderkey, {FILE_NUMBERS} AS f, CASE WHEN o_orderkey % 29 = 0 THEN 'other' ELSE {FILE_NUMBERS} END AS g FROM orders)
    SELECT 'consistency' AS layer, 'file_number_mismatch' AS "check", CAST(o_orderkey AS STRING) AS ref, f || ' against ' || g AS message FROM i WHERE f <> g
    UNION ALL SELECT DISTINCT 'consistency', 'unknown_voter', CAST(vote_id AS STRING), CAST(member AS STRING) FROM positions WHERE member NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 22)
    UNION ALL SELECT 'consistency', 'row_count_delta', 'votes', (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) || ' rows against ' || (SELECT count(*) FROM orders)""", "positions"))  # fmt: skip
def consistency_more(spark, d):
    o = table(spark, d, "orders")
    i = o.select("o_orderkey", F.expr(FILE_NUMBERS).alias("f")).withColumn("g", F.when(F.col("o_orderkey") % 29 == 0, "other").otherwise(F.col("f")))
    unknown = records.orphans(a.positions(spark, d).select("vote_id", "member").distinct(), table(spark, d, "supplier").where("s_nationkey < 22"), "member", "s_suppkey")
    count = lambda df, k: df.agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
    now, before = count(o.where("o_orderkey % 3 = 0"), "votes").unionByName(count(o, "meetings")), count(o, "votes").unionByName(count(o, "meetings"))
    return reduce(DataFrame.unionByName, [
        i.where("f <> g").select(*records.finding("consistency", "file_number_mismatch", "o_orderkey", F.concat_ws(" against ", "f", "g"))),
        unknown.select(*records.finding("consistency", "unknown_voter", "vote_id", F.col("member").cast("string"))),
        c.row_count_delta(now, before),
    ])


@query("reconcile_meetings", sql(""", s AS (SELECT meeting_id, CASE WHEN meeting_id % 31 = 0 THEN "day" + 1 ELSE "day" END AS "day" FROM meetings WHERE meeting_id % 17 <> 0),
    f AS (SELECT vote_id AS m, member, position = 'abstain' AS away FROM positions), w AS (SELECT m, member, CASE WHEN (m + member) % 23 = 0 THEN NOT away ELSE away END AS away FROM f)
    SELECT 'no_second_source' AS "check", meeting_id AS meeting, 0 AS n FROM meetings WHERE meeting_id % 17 = 0 UNION ALL SELECT 'date_mismatch', m.meeting_id, 0 FROM meetings m JOIN s USING (meeting_id) WHERE m."day" <> s."day"
    UNION ALL SELECT 'attendance_mismatch', m, CAST(count(*) AS INTEGER) FROM (SELECT m, member FROM (SELECT DISTINCT m, member, away FROM f) x JOIN (SELECT DISTINCT m, member, away FROM w) y USING (m, member) WHERE x.away <> y.away GROUP BY ALL) z GROUP BY m""", "meetings", "positions"))  # fmt: skip
def reconcile_meetings(spark, d):
    """Meetings without a second source, with another date there, or with members present in one and absent in the other."""
    m = a.meetings(spark, d).select("meeting_id", "day")
    m = spread(m, tasks(m), "meeting_id")
    s = m.where("meeting_id % 17 <> 0").select("meeting_id", F.when(F.col("meeting_id") % 31 == 0, F.date_add("day", 1)).otherwise(F.col("day")).alias("said"))
    seen = a.positions(spark, d).select(F.col("vote_id").alias("m"), "member", (F.col("position") == "abstain").alias("away"))
    other = seen.select("m", "member", F.when((F.col("m") + F.col("member")) % 23 == 0, ~F.col("away")).otherwise(F.col("away")).alias("away"))
    sides = seen.withColumnsRenamed({"away": "a"}).unionByName(other.withColumnsRenamed({"away": "b"}), True).where("m IS NOT NULL AND member IS NOT NULL")
    sides = spread(sides, tasks(seen, other), "m", "member").groupBy("m", "member")  # grouped once, not joined
    both = sides.agg(*[F.bool_or(x).alias(f"{c}_{w}") for c in ("a", "b") for w, x in (("away", F.col(c)), ("here", ~F.col(c)))]).where("(a_away AND b_here) OR (a_here AND b_away)")
    line = lambda df, check, meeting, n: df.select(F.lit(check).alias("check"), F.col(meeting).alias("meeting"), n.cast("int").alias("n"))
    return reduce(DataFrame.unionByName, [
        line(records.orphans(m, s, "meeting_id", "meeting_id"), "no_second_source", "meeting_id", F.lit(0)),
        line(m.join(s, "meeting_id").where("day <> said"), "date_mismatch", "meeting_id", F.lit(0)),
        line(both.groupBy("m").agg(F.count("*").alias("n")), "attendance_mismatch", "m", F.col("n")),
    ])


@query("quoted_tallies", f"""WITH q AS (SELECT o_orderkey, {QUOTES} AS t, CAST(o_custkey % 3 AS INTEGER) AS aye, 1 AS "no" FROM orders),
    s AS (SELECT *, TRY_CAST(regexp_extract(t, 'affirmative\\s*[:\\-–]\\s*(\\d+)', 1, 'i') AS INTEGER) AS a1, TRY_CAST(regexp_extract(t, 'negative\\s*[:\\-–]\\s*(\\d+)', 1, 'i') AS INTEGER) AS n1, TRY_CAST(regexp_extract(t, '\\byeas?\\s*[:(]+\\s*(\\d+)', 1, 'i') AS INTEGER) AS a2,
        TRY_CAST(regexp_extract(t, '\\bnays?\\s*[:(]+\\s*(\\d+)', 1, 'i') AS INTEGER) AS n2, TRY_CAST(regexp_extract(t, 'abstentions?\\s*[:\\-–(]+\\s*(\\d+)', 1, 'i') AS INTEGER) AS b FROM q)
    SELECT 'gate' AS layer, 'quote_tally_mismatch' AS "check", CAST(o_orderkey AS STRING) AS ref, message FROM (SELECT *, CASE WHEN a1 <> aye THEN 'aye=' || a1 || ' but ' || aye WHEN n1 <> "no" THEN 'no=' || n1 || ' but ' || "no" WHEN a2 <> aye THEN 'aye=' || a2 || ' but ' || aye
        WHEN n2 <> "no" THEN 'no=' || n2 || ' but ' || "no" WHEN b <> 0 THEN 'abstain=' || b || ' but 0' END AS message FROM s) z WHERE message IS NOT NULL""")  # fmt: skip
def quoted_tallies(spark, d):
    counts = F.create_map(F.lit("aye"), (F.col("o_custkey") % 3).cast("int"), F.lit("no"), F.lit(1))
    return c.quoted_tally(table(spark, d, "orders").select(F.col("o_orderkey").alias("vote_id"), F.expr(QUOTES).alias("quote"), counts.alias("counts")))


@query("vague_titles", f"""WITH q AS (SELECT o_custkey AS run, {TITLES} AS t FROM orders),
    w AS (SELECT run, regexp_matches(t, '(?i)fiscal impact statement|exhibit [a-z]\\b') OR len(list_filter(regexp_split_to_array(regexp_replace(t, '(?i)\\b(approve[ds]?|adopt(ed)?|accept(ed)?|amend(ed)?|defer(red)?|motion|res(olution)?|int(roduction)?|ord(inance)?|no|m|lu|slr|item)\\b|[\\d\\-–/.,:;()#]+', ' ', 'g'), '\\s+'), lambda x: length(x) > 2)) < 2 AS vague FROM q)
    SELECT run, count(*) FILTER (vague) AS vague, count(*) AS items FROM w GROUP BY run HAVING count(*) >= 5 AND 3 * count(*) FILTER (vague) >= count(*)""")  # fmt: skip
def vague_titles(spark, d):
    """Runs of five items or more of which a third or more have vague titles."""
    q = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), c.vague(F.expr(TITLES)).alias("vague"))
    runs = q.groupBy("run").agg(F.count_if("vague").alias("vague"), F.count("*").alias("items"))
    return runs.where((F.col("items") >= 5) & (3 * F.col("vague") >= F.col("items")))


@query("run_floors", sql(""", p AS (SELECT vote_id, count(*) AS n, count(*) FILTER (position = 'aye') AS ayes FROM positions GROUP BY 1),
    r AS (SELECT m.body, strftime(m."day", '%Y-%m') AS month, max(m."day") AS newest, count(*) AS meetings, count(p.vote_id) AS votes, CAST(coalesce(sum(p.n), 0) AS BIGINT) AS positions, CAST(coalesce(sum(p.ayes), 0) AS BIGINT) AS ayes, count(*) FILTER (p.vote_id IS NULL) AS bare FROM meetings m LEFT JOIN p ON vote_id = meeting_id GROUP BY 1, 2)
    SELECT body, month, unnest(list_filter([CASE WHEN DATE '1998-08-02' - newest > 120 THEN 'stale_meetings' END, CASE WHEN meetings < 2 THEN 'too_few_meetings' END, CASE WHEN votes < 8 THEN 'too_few_votes' END, CASE WHEN votes >= 20 AND positions > 0 AND ayes = positions THEN 'uniform_votes' END, CASE WHEN bare > 0 THEN 'no_attendance' END], lambda x: x IS NOT NULL)) AS "check" FROM r""", "meetings", "positions"))  # fmt: skip
def run_floors(spark, d):
    """What a run (a body's month) falls short of."""
    p = a.positions(spark, d).groupBy("vote_id").agg(F.count("*").alias("n"), F.count_if(F.col("position") == "aye").alias("ayes"))
    m = a.meetings(spark, d).join(p, F.col("meeting_id") == F.col("vote_id"), "left")
    runs = m.groupBy("body", F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.max("day").alias("newest"), F.count("*").alias("meetings"), F.count("vote_id").alias("votes"), F.sum("n").alias("positions"), F.sum("ayes").alias("ayes"), F.count_if(F.col("vote_id").isNull()).alias("bare"),
    )
    rules = {
        "stale_meetings": F.datediff(F.lit("1998-08-02").cast("date"), "newest") > 120, "too_few_meetings": F.col("meetings") < 2, "too_few_votes": F.col("votes") < 8,
        "uniform_votes": (F.col("votes") >= 20) & (F.col("ayes") == F.col("positions")), "no_attendance": F.col("bare") > 0,
    }
    return runs.select("body", "month", F.explode(c.violations([], **rules)).alias("check"))


@query("second_source_floors", f"""WITH q AS (SELECT o_orderkey, {RESULTS} AS r, {QUOTES} AS t, o_orderkey % 6 = 0 AS silent FROM orders)
    SELECT CAST(o_orderkey AS STRING) AS ref, CASE WHEN r NOT IN ('pass', 'fail') THEN 'bad_entry' WHEN silent THEN 'no_evidence' ELSE 'no_outcome_language' END AS "check" FROM q
    WHERE r NOT IN ('pass', 'fail') OR silent OR NOT regexp_matches(t, '(?i)approv|denie|deny|carrie|passe?d|fail|adopt|defer|motion|moved|second|aye|nay|unanimous|vote')
    UNION ALL SELECT 'run', 'oracle_coverage' WHERE (SELECT count(DISTINCT o_orderdate) FROM orders WHERE o_orderkey % 2 = 0) < (SELECT count(DISTINCT o_orderdate) FROM orders)""")  # fmt: skip
def second_source_floors(spark, d):
    """Entries of the second source that say nothing, and meetings' days that it leaves out."""
    o = table(spark, d, "orders")
    q = o.select("o_orderkey", F.expr(RESULTS).alias("r"), F.when(F.col("o_orderkey") % 6 != 0, F.expr(QUOTES)).alias("quote"))
    check = F.when(~F.col("r").isin("pass", "fail"), "bad_entry").when(F.col("quote").isNull(), "no_evidence").when(~F.col("quote").rlike(c.OUTCOME), "no_outcome_language")
    entries = q.withColumn("check", check).where("check is not null").select(F.col("o_orderkey").cast("string").alias("ref"), "check")
    days = o.agg(F.countDistinct("o_orderdate").alias("all"), F.countDistinct(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate"))).alias("covered"))
    return entries.unionByName(days.where("covered < all").select(F.lit("run").alias("ref"), F.lit("oracle_coverage").alias("check")))


@query("certified_votes", sql(""", d AS (SELECT meeting_id || '/' || member AS ref, CASE WHEN member % 4 = 0 THEN 'settled' END AS note FROM (SELECT DISTINCT vote_id AS meeting_id, member FROM positions WHERE (vote_id + member) % 13 = 0) z UNION ALL SELECT CAST(meeting_id AS STRING), NULL FROM meetings WHERE meeting_id % 19 = 0),
    v AS (SELECT DISTINCT vote_id AS meeting_id, member FROM positions)
    SELECT meeting_id || '/' || member AS vote_id, CASE WHEN meeting_id % 3 <> 0 AND (meeting_id || '/' || member) NOT IN (SELECT ref FROM d) AND CAST(meeting_id AS STRING) NOT IN (SELECT ref FROM d) THEN 'certified' ELSE 'quarantined' END AS status, (SELECT max(note) FROM d WHERE ref = meeting_id || '/' || member) AS note FROM v""", "positions", "meetings"))  # fmt: skip
def certified_votes(spark, d):
    votes = a.positions(spark, d).select(F.col("vote_id").alias("meeting_id"), "member").distinct().withColumn("ref", F.concat_ws("/", "meeting_id", "member")).withColumn("vote_id", F.col("ref"))
    m = a.meetings(spark, d)
    of_votes = votes.where("(meeting_id + member) % 13 = 0").select("ref", F.when(F.col("member") % 4 == 0, "settled").alias("note"))
    disputed = of_votes.unionByName(m.where("meeting_id % 19 = 0").select(F.col("meeting_id").cast("string").alias("ref"), F.lit(None).cast("string").alias("note")))
    return c.certify_votes(votes, disputed, m.where("meeting_id % 3 <> 0"))


@query("certified_export", """SELECT o_orderstatus, count(*) AS certified, floor(count(*) / (SELECT count(*) FROM orders) * 1000 + 0.5) / 1000 AS share, count(*) * 10 >= 6 * (SELECT count(*) FROM orders) AS agreed FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1""")
def certified_export(spark, d):
    """Certified records by kind, their share of all, and whether it reaches the six tenths that a source needs."""
    o = table(spark, d, "orders")
    n = o.groupBy("o_orderstatus").agg(F.count_if(F.col("o_orderkey") % 3 != 0).alias("certified"))
    both = n.crossJoin(F.broadcast(o.agg(F.count("*").alias("all")))).where("certified > 0")  # one row
    return both.select("o_orderstatus", "certified", (F.floor(F.col("certified") / F.col("all") * 1000 + 0.5) / 1000).alias("share"), (F.col("certified") * 10 >= F.col("all") * 6).alias("agreed"))


@query("whitelisted_findings", sql("SELECT vote_id, member, n > 2 AS many FROM (SELECT vote_id, member, count(*) AS n FROM positions GROUP BY ALL HAVING count(*) > 1) z WHERE (vote_id, member) NOT IN (SELECT o_orderkey, o_custkey % 100 FROM orders)", "positions"))
def whitelisted_findings(spark, d):
    """New findings: those of this run but for settled ones."""
    found = a.positions(spark, d).groupBy("vote_id", "member").agg(F.count("*").alias("n")).where("n > 1")
    settled = table(spark, d, "orders").select(F.col("o_orderkey").alias("vote_id"), (F.col("o_custkey") % 100).alias("member"))
    return found.join(settled, ["vote_id", "member"], "left_anti").select("vote_id", "member", (F.col("n") > 2).alias("many"))


@query("due_sources", sql(""", n AS (SELECT body, max("day") FILTER (status <> 'P') AS newest FROM meetings GROUP BY 1)
    SELECT body, newest, (SELECT count(*) FROM meetings m WHERE m.body = n.body AND m."day" > newest AND m."day" < DATE '1998-09-01') > 0 OR DATE '1998-09-01' - newest > 21 AS due FROM n""", "meetings"))  # fmt: skip
def due_sources(spark, d):
    """Sources with a meeting on their calendar since their newest record, or with no record for three weeks."""
    m, today = a.meetings(spark, d), F.lit("1998-09-01").cast("date")
    newest = m.where("status <> 'P'").groupBy("body").agg(F.max("day").alias("newest"))
    ahead = m.join(newest, "body").groupBy("body", "newest").agg(F.count_if((F.col("day") > F.col("newest")) & (F.col("day") < today)).alias("n"))
    return ahead.select("body", "newest", ((F.col("n") > 0) | (F.datediff(today, "newest") > 21)).alias("due"))


@query("spend_gate", """SELECT event_type AS kind, CAST(ts AS DATE) AS "day", CAST(sum(CAST(floor("value" * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents, sum(CAST(floor("value" * 100 + 0.5) AS BIGINT)) >= 500000 AS refused FROM events WHERE strftime(ts, '%Y-%m') = '2024-01' GROUP BY 1, 2""")
def spend_gate(spark, d):
    """A month's ledger by kind and day, and whether the day's sum has reached the cap."""
    e = table(spark, d, "events").where(F.date_format("ts", "yyyy-MM") == "2024-01")
    s = e.groupBy(F.col("event_type").alias("kind"), F.to_date("ts").alias("day")).agg(F.sum(a.cents("value")).alias("cents"))
    return s.withColumn("refused", F.col("cents") >= 500_000)


_MATCH = """WITH RECURSIVE o AS (SELECT *, CAST(o_orderkey AS STRING) AS id FROM orders WHERE o_orderkey % 2 = 0),
    v AS (SELECT o_custkey AS meeting, CAST(o_orderkey % 5 AS STRING) AS k, id AS vote_id, list_distinct(regexp_extract_all(lower(o_orderpriority || ' order ' || o_orderstatus || 'xx roads'), '[a-z0-9]{3,}')) AS w, o_orderkey % 3 = 0 AS r FROM o),
    e AS (SELECT meeting, CASE WHEN CAST(vote_id AS BIGINT) % 7 = 0 THEN k || '.a' WHEN CAST(vote_id AS BIGINT) % 11 = 0 THEN 'x' ELSE k END AS k, vote_id || 'e' AS entry_id, w, r FROM v WHERE CAST(vote_id AS BIGINT) % 13 <> 0),
    ok AS (SELECT e.meeting, e.k AS ek, v.k AS vk, entry_id, vote_id, len(list_intersect(e.w, v.w)) AS n, least(len(e.w), len(v.w)) AS m, e.r AS er, v.r AS vr FROM e JOIN v ON e.meeting = v.meeting),
    t1 AS (SELECT entry_id, vote_id FROM ok WHERE ek = vk AND n >= 2 AND n >= 0.3 * m),
    t2 AS (SELECT entry_id, vote_id FROM ok WHERE regexp_extract(ek, '^(\\d+)[.\\-]?[a-z0-9]+$', 1) = vk AND n >= 2 AND n >= 0.3 * m AND entry_id NOT IN (SELECT entry_id FROM t1)),
    p AS (SELECT meeting, entry_id, vote_id, row_number() OVER (PARTITION BY meeting ORDER BY n / m DESC, entry_id, vote_id) AS i FROM ok WHERE er = vr AND n >= 2 AND n >= 0.3 * m AND entry_id NOT IN (SELECT entry_id FROM t1 UNION ALL SELECT entry_id FROM t2) AND vote_id NOT IN (SELECT vote_id FROM t1 UNION ALL SELECT vote_id FROM t2)),
    g AS (SELECT meeting, CAST(0 AS BIGINT) AS i, CAST([] AS STRING[]) AS es, CAST([] AS STRING[]) AS vs FROM p GROUP BY 1 UNION ALL
        SELECT g.meeting, p.i, CASE WHEN list_contains(es, entry_id) OR list_contains(vs, vote_id) THEN es ELSE list_append(es, entry_id) END, CASE WHEN list_contains(es, entry_id) OR list_contains(vs, vote_id) THEN vs ELSE list_append(vs, vote_id) END FROM g JOIN p ON p.meeting = g.meeting AND p.i = g.i + 1),
    f AS (SELECT meeting, arg_max(es, i) AS es, arg_max(vs, i) AS vs FROM g GROUP BY 1)
    SELECT entry_id, vote_id, 1 AS tier FROM t1 UNION ALL SELECT entry_id, vote_id, 2 FROM t2 UNION ALL SELECT unnest(es), unnest(vs), 3 FROM f"""


@query("tiered_match", _MATCH)
def tiered_match(spark, d):
    """Two sources of one body's votes, by number, by the number of the whole, and by words."""
    key = F.col("o_orderkey")
    votes = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(
        F.col("o_custkey").alias("meeting"), (key % 5).cast("string").alias("key"), key.cast("string").alias("vote_id"),
        t.tokens(F.concat("o_orderpriority", F.lit(" order "), "o_orderstatus", F.lit("xx roads"))).alias("words"), (key % 3 == 0).alias("result"), "o_orderkey",
    )
    k = F.when(key % 7 == 0, F.concat("key", F.lit(".a"))).when(key % 11 == 0, "x").otherwise(F.col("key"))
    entries = votes.where("o_orderkey % 13 <> 0").select("meeting", k.alias("key"), F.concat("vote_id", F.lit("e")).alias("entry_id"), "words", "result")
    return c.tiered_match(entries, votes)


@query("facility_names", """WITH n AS (SELECT DISTINCT p_type AS name, string_split(lower(p_type), ' ') AS w FROM part), q AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lower(p_type) WHEN 1 THEN array_to_string(string_split(lower(p_type), ' ')[1:2], ' ') ELSE split_part(lower(p_type), ' ', 1) END AS t FROM part),
    m AS (SELECT p_partkey, name, CASE WHEN t = array_to_string(w, ' ') THEN 0 ELSE length(name) END AS size FROM q JOIN n ON array_to_string(w, ' ') = t OR starts_with(array_to_string(w, ' '), t || ' ')),
    b AS (SELECT *, min(size) OVER (PARTITION BY p_partkey) AS least FROM m) SELECT p_partkey, min(name) AS name FROM b WHERE size = least GROUP BY p_partkey, least HAVING count(*) = 1 OR least = 0""")  # fmt: skip
def facility_names(spark, d):
    """Short titles and the full names that they begin."""
    part, split = table(spark, d, "part"), F.split(F.lower("p_type"), " ")
    title = F.when(F.col("p_partkey") % 3 == 0, split).when(F.col("p_partkey") % 3 == 1, F.slice(split, 1, 2)).otherwise(F.slice(split, 1, 1))
    return c.prefix_names(part.select("p_partkey", title.alias("words")), part.select(F.col("p_type").alias("name"), split.alias("words")).distinct(), "p_partkey")


@query("contest_share_gate", """WITH s AS (SELECT l_orderkey AS contest, count(*) AS candidates, count(*) FILTER (l_linenumber <> 3) AS known, sum(CASE WHEN l_linenumber <> 3 THEN CAST(l_quantity AS BIGINT) END) AS votes, sum(CASE WHEN l_linenumber <> 3 THEN CAST(floor(l_discount * 1000 + 0.5) AS BIGINT) * 5 END) AS share FROM lineitem GROUP BY 1)
    SELECT contest, CASE WHEN known = candidates THEN CAST(votes AS BIGINT) END AS total_votes, known = candidates AS checkable, known = candidates AND share BETWEEN 950 AND 1050 AS reconciled FROM s""")  # fmt: skip
def contest_share_gate(spark, d):
    """A contest's votes if every candidate has some, whether all shares are known, and whether they add up to one, nearly."""
    known = F.col("l_linenumber") != 3
    share = F.floor(F.col("l_discount") * 1000 + 0.5) * 5  # thousandths
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("contest")).agg(
        F.bool_and(known).alias("checkable"), F.sum(F.col("l_quantity").cast("long")).alias("votes"), F.sum(share).alias("share"),
    )
    return s.select("contest", F.when(F.col("checkable"), F.col("votes")).alias("total_votes"), "checkable", (F.col("checkable") & F.col("share").between(950, 1050)).alias("reconciled"))


@query("subtotal_gate", """SELECT l_orderkey AS project, CAST(max(l_linenumber) * 30 AS BIGINT) AS printed, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS parsed FROM lineitem GROUP BY 1 HAVING max(l_linenumber) * 30 <> sum(CAST(l_quantity AS BIGINT))""")
def subtotal_gate(spark, d):
    """Projects whose printed subtotal isn't the sum of their years."""
    years = F.sum(F.col("l_quantity").cast("long"))
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("project")).agg((F.max("l_linenumber") * 30).cast("long").alias("printed"), years.alias("parsed"))
    return p.where("printed <> parsed")


_COOLDOWN = """WITH RECURSIVE l AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
    s AS (SELECT user_id, event_type, i, ts AS sent, event_id, FALSE AS blocked FROM l WHERE i = 1 UNION ALL
        SELECT l.user_id, l.event_type, l.i, CASE WHEN l.ts <= s.sent + INTERVAL {days} DAY THEN s.sent ELSE l.ts END, l.event_id, l.ts <= s.sent + INTERVAL {days} DAY FROM s JOIN l ON l.user_id = s.user_id AND l.event_type = s.event_type AND l.i = s.i + 1)
    SELECT event_id, blocked FROM s"""


@query("cooldown_30d", _COOLDOWN.format(days=30))
def cooldown_30d(spark, d):
    return c.sent_only(table(spark, d, "events"), ["user_id", "event_type"], "ts", 30 * 86400)


@query("cooldown_3d", _COOLDOWN.format(days=3))
def cooldown_3d(spark, d):
    return c.sent_only(table(spark, d, "events"), ["user_id", "event_type"], "ts", 3 * 86400)


_RUNS = phrase("event_id", [
    '<"meetings":[1],"agenda_items":[],"vote_events":[<"id":{n}>],"members":["a"]>', '[1, 2]', '<"meetings":<>,"agenda_items":[],"vote_events":null,"members":[]>', 'null', '<"members":"x">', 'oops', '<"meetings":[],"agenda_items":[],"vote_events":[],"members":[],"more":1>', '"text"',
], n="user_id")


@query("malformed_roots", f"""WITH q AS (SELECT event_id, translate({_RUNS}, '<>', chr(123) || chr(125)) AS j FROM events), v AS (SELECT event_id, CASE WHEN json_valid(j) THEN CAST(j AS JSON) END AS j FROM q),
    k AS (SELECT event_id, unnest(CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN ['records'] ELSE list_filter(['meetings', 'agenda_items', 'vote_events', 'members'], lambda x: coalesce(json_type(j -> x), '') <> 'ARRAY') END) AS key FROM v)
    SELECT 'structural' AS layer, 'malformed_root' AS "check", event_id || ':' || key AS ref, CASE key WHEN 'records' THEN 'not an object' ELSE 'missing or not an array' END AS message FROM k""")
def malformed_roots(spark, d):
    """Runs whose records don't have the shape that the other checks read."""
    runs = table(spark, d, "events").select("event_id", F.translate(F.expr(_RUNS), "<>", "{}").alias("j"))
    return c.malformed_roots(runs, "event_id", "j")


@query("letters_by_time", """SELECT user_id, event_id, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS nth FROM events WHERE event_type IN ('signup', 'purchase')""")
def letters_by_time(spark, d):
    """A user's letters, newest first, as a keyed lookup lists them: numbered within the user, so that the order is part of the rows."""
    rows = table(spark, d, "events").where(F.col("event_type").isin("signup", "purchase")).select("user_id", "event_id", "ts")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))


@query("known_dates_by_key", """SELECT n_name AS place, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_name = upper('nation_7') GROUP BY 1, 2""")
def known_dates_by_key(spark, d):
    """The dates of one place, by a key given in any case; sorted by date."""
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = joined.where(F.col("n_name") == F.upper(F.lit("nation_7"))).groupBy(F.col("n_name").alias("place"), F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return rows.orderBy("day")
