"""People, parties, offices and elections, each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..adapters import phrase
from ..functions import bills as b
from ..functions import people as p
from ..io import table
from ..registry import query

NAMES = phrase("c_custkey", [
    "Rep. Arlington, Jody C. [R-TX-{n}]", "SMITH, ROBERT F JR", "Sen. María Gómez-Peña", "dr. Ana de la Cruz III", "O.B. Price Jr.", "VAN DYKE, MR. C.L. II", "Lee", "Hon. Zoë Müller, Sr.", "", "JONES,  ANN",
    "Committee report {n}", "Attachment A", "{nl}Two lines", "Commissioner Łukasz Šimek",
], n="c_custkey % 40")
PACS = phrase("c_custkey", ["ACME WORKERS PAC", "ActBlue", "WINRED, INC", "FRIENDS OF SMITH JFC", "", "north  river llc", "united pc fund"])
PARTY = phrase("c_custkey", ["Democrat", "GOP", " ind ", "Green", "Whig", "", "REPUBLICAN", "Libertarian Party", "D", "R", "L", "I"])
ELECTIONS = phrase("o_orderkey", [
    "Texas General Election", "Florida Republican Primary", "Presidential Election", "Special Election for U.S. Senate", "VIP Test Election", "Governor General Election", "Runoff for Mayor", "Democratic Primary and Senate race",
    "City Council Primary", "General Election",
])


def _sql(expression: str, select: str, key: str = "c_custkey", source: str = "customer", more: str = "") -> str:
    return f"WITH q AS (SELECT {key}, {expression} AS t{more} FROM {source}) {select}"


def _texts(spark, d, expression, key="c_custkey", source="customer", *more):
    return table(spark, d, source).select(key, F.expr(expression).alias("t"), *more)


@query("member_keys", _sql(NAMES, r"""SELECT c_custkey, coalesce(list_filter(regexp_split_to_array(replace(upper(strip_accents(replace(t, 'Ł', 'Ł'))), '.', ''), '\s+'), lambda x: x <> '' AND x NOT IN ('JR', 'SR', 'II', 'III', 'IV'))[-1], '') AS member_key FROM q"""))
def member_keys(spark, d):
    return _texts(spark, d, NAMES).select("c_custkey", p.member_key(F.col("t")).alias("member_key"))


_VOTERS = phrase("l_suppkey", ["Supplier É{n}", "SUPPLIER é{n} Jr.", "supplier É{n}", "Ŝupplier ĉ{n}", "​Supplier É{n} III", "Supplier ế{n}"], n="l_suppkey")
_ROSTER = phrase("s_suppkey", ["Supplier E{n}", "Supplier É{n}, Sr", "Supplier É{n}", "S. C{n}", "SUPPLIER E{n}", "Supplier Ê{n} II"], n="s_suppkey")
_KEY = r"coalesce(list_filter(regexp_split_to_array(replace(upper(strip_accents(replace({t}, '​', ''))), '.', ''), '\s+'), lambda x: x <> '' AND x NOT IN ('JR', 'SR', 'II', 'III', 'IV'))[-1], '')"


@query("unknown_voters_by_key", f"""WITH v AS (SELECT l_orderkey AS vote, {_VOTERS} AS name FROM lineitem), r AS (SELECT DISTINCT {_KEY.format(t=_ROSTER)} AS member_key FROM supplier WHERE s_nationkey < 20),
    k AS (SELECT vote, name, {_KEY.format(t='name')} AS member_key FROM v) SELECT member_key, count(*) AS votes, min(vote) AS first_vote FROM k WHERE member_key NOT IN (SELECT member_key FROM r) GROUP BY 1""")
def unknown_voters_by_key(spark, d):
    """Voters whom no member of the roster is the same person as, however either writes the name."""
    voters = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("vote"), F.expr(_VOTERS).alias("name"))
    # Names are few beside votes: each different one gets its key once.
    keys = voters.select("name").distinct().select("name", p.member_key(F.col("name")).alias("member_key"))
    roster = table(spark, d, "supplier").where("s_nationkey < 20").select(p.member_key(F.expr(_ROSTER)).alias("member_key")).distinct()
    unknown = keys.join(roster, "member_key", "left_anti")
    return voters.join(unknown, "name").groupBy("member_key").agg(F.count("*").alias("votes"), F.min("vote").alias("first_vote"))


@query("clean_names", _sql(NAMES, r"""SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(CASE WHEN contains(n, ',') THEN trim(n[strpos(n, ',') + 1:]) || ' ' || trim(n[:strpos(n, ',') - 1]) ELSE n END, '\b[A-Za-z]\.', ' ', 'g'), '\b(jr|sr|ii|iii|iv)\b\.?', '', 'gi'), '\s+', ' ', 'g')) AS name,
    lower(CASE WHEN contains(trim(t), ',') THEN trim(split_part(trim(t), ',', 1)) ELSE coalesce(list_filter(regexp_split_to_array(regexp_replace(trim(t), '\b(jr|sr|ii|iii|iv)\b\.?', '', 'gi'), '\s+'), lambda x: x <> '')[-1], '') END) AS last
    FROM (SELECT *, trim(regexp_replace(regexp_replace(trim(t), '\[[^\]]*\]', '', 'g'), '^(rep|sen|del|res|hon|senator|representative|commissioner|dr|mr|mrs|ms)\.?\s+', '', 'i'), ' ,') AS n FROM q) z"""))  # fmt: skip
def clean_names(spark, d):
    return _texts(spark, d, NAMES).select("c_custkey", p.clean_name(F.col("t")).alias("name"), p.last_name(F.col("t")).alias("last"))


@query("display_names", """WITH q AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'SMITH, ROBERT F JR' WHEN 1 THEN 'DE LA CRUZ, MS. ANA' WHEN 2 THEN 'JONES, C.L. iii' WHEN 3 THEN 'ann lee' ELSE 'KIM, DR' END AS t FROM customer)
    SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Robert F Smith Jr.' WHEN 1 THEN 'Ana De la cruz' WHEN 2 THEN 'C.L. Jones III' WHEN 3 THEN 'Ann Lee' ELSE 'Kim' END AS name FROM q""")  # fmt: skip
def display_names(spark, d):
    """The SQL states the names that the rule must give."""
    t = F.expr("CASE c_custkey % 5 WHEN 0 THEN 'SMITH, ROBERT F JR' WHEN 1 THEN 'DE LA CRUZ, MS. ANA' WHEN 2 THEN 'JONES, C.L. iii' WHEN 3 THEN 'ann lee' ELSE 'KIM, DR' END")
    return table(spark, d, "customer").select("c_custkey", p.display_name(t).alias("name"))


@query("pac_exclusions", _sql(PACS, r"""SELECT c_custkey, array_to_string(list_transform(regexp_split_to_array(lower(trim(regexp_replace(t, '\s+', ' ', 'g'))), ' '), lambda w: CASE WHEN w IN ('pac', 'jfc', 'llc', 'inc', 'pc') THEN upper(w) ELSE upper(w[:1]) || w[2:] END), ' ') AS title
    FROM q WHERE t <> '' AND NOT regexp_matches(upper(t), 'ACTBLUE|WINRED') AND NOT contains(upper(t), 'SMITH') AND c_acctbal > 0""", more=", c_acctbal"))  # fmt: skip
def pac_exclusions(spark, d):
    """Committees that give to a candidate called Smith: no conduits, no committee of the candidate's own, no refunds."""
    t = _texts(spark, d, PACS, "c_custkey", "customer", "c_acctbal")
    tokens = F.filter(F.split(F.upper(p.clean_name(F.lit("Rep. Smith, Jo"))), " "), lambda w: F.length(w) > 2)
    own = F.exists(tokens, lambda w: F.upper("t").contains(w))
    return t.where((F.col("t") != "") & ~b.any_of(F.upper("t"), p.CONDUITS) & ~own & (F.col("c_acctbal") > 0)).select("c_custkey", p.committee_title(F.col("t")).alias("title"))


@query("party_forms", _sql(PARTY, """SELECT c_custkey, CASE lower(trim(t)) WHEN '' THEN NULL WHEN 'democrat' THEN 'Democratic' WHEN 'gop' THEN 'Republican' WHEN 'republican' THEN 'Republican' WHEN 'ind' THEN 'Independent' WHEN 'green' THEN 'Green' ELSE trim(t) END AS party,
    CASE WHEN t ILIKE '%democrat%' THEN 'dem' WHEN t ILIKE '%republican%' OR t ILIKE '%gop%' THEN 'rep' WHEN t ILIKE '%libertarian%' THEN 'lib' WHEN t ILIKE '%green%' THEN 'grn' ELSE 'ind' END AS "class" FROM q"""))  # fmt: skip
def party_forms(spark, d):
    return _texts(spark, d, PARTY).select("c_custkey", p.party(F.col("t")).alias("party"), p.party_class(F.col("t")).alias("class"))


@query("seat_order", """SELECT s_suppkey, CAST(row_number() OVER (ORDER BY list_position(['D', 'I', 'L', 'R'], CASE s_suppkey % 5 WHEN 0 THEN 'D' WHEN 1 THEN 'R' WHEN 2 THEN 'L' ELSE 'I' END), s_nationkey, s_suppkey) AS INTEGER) AS seat FROM supplier""")
def seat_order(spark, d):
    """Members by party and state. A chamber has few members, so one window over it is bounded."""
    party = F.expr("CASE s_suppkey % 5 WHEN 0 THEN 'D' WHEN 1 THEN 'R' WHEN 2 THEN 'L' WHEN 3 THEN 'ID' ELSE 'X' END")
    return table(spark, d, "supplier").select("s_suppkey", F.row_number().over(Window.orderBy(p.party_rank(party), "s_nationkey", "s_suppkey")).alias("seat"))


@query("malformed_names", _sql(NAMES, r"""SELECT t AS member, min(c_custkey) AS ref FROM q WHERE length(t) > 60 OR regexp_matches(t, '[\n\t]|\d|(?i:attachment|exhibit|committee report|resolution|ordinance|a motion|meeting|agenda)') GROUP BY 1 ORDER BY ref LIMIT 8"""))
def malformed_names(spark, d):
    """The first eight distinct names that are no person's: a report, so the limit belongs to it."""
    return _texts(spark, d, NAMES).where(p.no_person(F.col("t"))).groupBy(F.col("t").alias("member")).agg(F.min("c_custkey").alias("ref")).orderBy("ref").limit(8)


_ELECTION_SQL = ", CAST(o_orderdate AS DATE) AS \"day\", CASE o_custkey % 3 WHEN 0 THEN 'TX' WHEN 1 THEN 'FL' END AS st"


def _elections(spark, d):
    st = F.expr("CASE o_custkey % 3 WHEN 0 THEN 'TX' WHEN 1 THEN 'FL' END")
    return _texts(spark, d, ELECTIONS, "o_orderkey", "orders", F.col("o_orderdate").cast("date").alias("day"), st.alias("st"))


@query("election_stages", _sql(ELECTIONS, """SELECT o_orderkey, CASE WHEN t ILIKE '%runoff%' THEN 'runoff' WHEN t ILIKE '%special%' THEN 'special' WHEN t ILIKE '%primary%' THEN 'primary' ELSE 'general' END AS stage,
    CASE WHEN t ILIKE '%primary%' AND t ILIKE '%republican%' THEN 'republican' WHEN t ILIKE '%primary%' AND t ILIKE '%democrat%' THEN 'democratic' END AS party FROM q""", "o_orderkey", "orders"))  # fmt: skip
def election_stages(spark, d):
    return _elections(spark, d).select("o_orderkey", p.stage(F.col("t")).alias("stage"), p.primary_party(F.col("t")).alias("party"))


@query("federal_races", _sql(ELECTIONS, """, y AS (SELECT *, CAST(year("day") AS INTEGER) AS y, CAST(year("day") + year("day") % 2 AS INTEGER) AS cycle, t ILIKE '%president%' AS pr, t ILIKE '%senat%' AND st IS NOT NULL AS se FROM q),
    g AS (SELECT *, NOT pr AND NOT se AND st IS NOT NULL AND y % 2 = 0 AND (t ILIKE '%general%' OR t ILIKE '%primary%') AND NOT regexp_matches(t, '(?i)govern|mayor|council|city') AS generic FROM y)
    SELECT o_orderkey, 'P' AS office, NULL AS st, cycle FROM g WHERE pr OR (generic AND cycle % 4 = 0) UNION ALL SELECT o_orderkey, 'S', st, cycle FROM g WHERE se OR generic""", "o_orderkey", "orders", _ELECTION_SQL))  # fmt: skip
def federal_races(spark, d):
    t = _elections(spark, d).select("o_orderkey", F.explode(p.federal_races(F.col("t"), F.col("st"), F.col("day"))).alias("r"))
    return t.select("o_orderkey", "r.office", F.col("r.state").alias("st"), "r.cycle")


@query("contest_offices", _sql(ELECTIONS, """SELECT o_orderkey, CASE WHEN t ILIKE '%president%' THEN 'P' WHEN (t ILIKE '%u.s.%' OR o_orderkey % 2 = 0) AND t ILIKE '%senate%' THEN 'S' END AS office, CASE o_orderkey % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'S' END AS by_bill FROM q""", "o_orderkey", "orders"))
def contest_offices(spark, d):
    level = F.when(F.col("o_orderkey") % 2 == 0, "country").otherwise("administrativeArea1")
    kind = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'hr' WHEN 1 THEN 'sjres' ELSE 'x' END")
    by_bill = F.when(kind.startswith("h"), "H").when(kind.startswith("s"), "S")
    return _elections(spark, d).select("o_orderkey", p.contest_office(F.col("t"), level).alias("office"), by_bill.alias("by_bill"))


@query("election_calendar", _sql(ELECTIONS, """, n AS (SELECT *, DATE '1998-01-15' AS today FROM q WHERE NOT t ILIKE '%test%'),
    w AS (SELECT *, CAST("day" - today AS INTEGER) AS days, (t ILIKE '%president%' OR (t ILIKE '%texas%' AND st = 'TX')) IS TRUE AS affects FROM n WHERE "day" BETWEEN today - 60 AND today + 548)
    SELECT o_orderkey, days, affects, CASE WHEN days = 0 THEN 'today' WHEN days = 1 THEN 'in 1 day' WHEN days > 0 THEN 'in ' || days || ' days' WHEN days = -1 THEN '1 day ago' ELSE -days || ' days ago' END AS countdown,
    CAST(row_number() OVER (PARTITION BY st ORDER BY affects DESC, days, o_orderkey) AS INTEGER) AS place FROM w QUALIFY place <= 20""", "o_orderkey", "orders", _ELECTION_SQL))  # fmt: skip
def election_calendar(spark, d):
    """The first twenty elections of a state from 60 days back to 548 ahead, those that affect it first."""
    today = F.lit("1998-01-15").cast("date")
    t = _elections(spark, d).where(~F.lower("t").contains("test") & F.col("day").between(F.date_sub(today, 60), F.date_add(today, 548)))
    affects = F.coalesce(F.lower("t").contains("president") | (F.lower("t").contains("texas") & (F.col("st") == "TX")), F.lit(False))
    t = t.select("o_orderkey", "st", F.datediff("day", today).alias("days"), affects.alias("affects"), p.countdown(F.col("day"), today).alias("countdown"))
    w = Window.partitionBy("st").orderBy(F.desc("affects"), "days", "o_orderkey")
    return t.withColumn("place", F.row_number().over(w)).where("place <= 20").drop("st")


@query("general_election_days", """SELECT y AS "year", CAST(m + CAST((8 - isodow(m)) % 7 AS INTEGER) + 1 AS DATE) AS "day" FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y, make_date(year(o_orderdate), 11, 1) AS m FROM orders) z""")
def general_election_days(spark, d):
    return table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct().withColumn("day", p.election_day(F.col("year")))


@query("zip_delegation", """WITH s AS (SELECT substr(lpad(CAST(c_custkey AS STRING), 5, '0'), 1, 3) AS zip3, c_nationkey AS st FROM customer), z AS (SELECT zip3, min(st) AS st FROM s GROUP BY 1),
    m AS (SELECT s_suppkey, s_nationkey AS st, CASE WHEN s_suppkey % 3 = 0 THEN 'rep' ELSE 'sen' END AS kind FROM supplier WHERE s_acctbal >= 0), r AS (SELECT *, row_number() OVER (PARTITION BY st, kind ORDER BY s_suppkey) AS n FROM m)
    SELECT zip3, s_suppkey, kind FROM z JOIN r USING (st) WHERE n <= CASE kind WHEN 'sen' THEN 2 ELSE 1 END""")  # fmt: skip
def zip_delegation(spark, d):
    """A zip code's first three digits, its state, and of the members now in office the first two senators and the first representative."""
    zips = table(spark, d, "customer").groupBy(F.substring(F.lpad(F.col("c_custkey").cast("string"), 5, "0"), 1, 3).alias("zip3")).agg(F.min("c_nationkey").alias("st"))
    kind = F.when(F.col("s_suppkey") % 3 == 0, "rep").otherwise("sen")
    members = table(spark, d, "supplier").where("s_acctbal >= 0").select("s_suppkey", F.col("s_nationkey").alias("st"), kind.alias("kind"))
    ranked = members.withColumn("n", F.row_number().over(Window.partitionBy("st", "kind").orderBy("s_suppkey")))
    return zips.join(ranked.where(F.col("n") <= F.when(F.col("kind") == "sen", 2).otherwise(1)), "st").select("zip3", "s_suppkey", "kind")
