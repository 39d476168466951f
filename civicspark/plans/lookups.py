"""Joins of records with rosters, places and calendars, and set operations on keys, each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as a
from ..adapters import phrase, sql
from ..functions import bills as b
from ..functions import text as t
from ..io import table
from ..operators import name_search, records
from ..registry import query


@query("member_lookup", """WITH r AS (SELECT upper(regexp_extract(s_name, '^[A-Za-z]+')) AS last, s_nationkey AS st, s_suppkey % 3 AS dist, max(s_suppkey) AS bioguide FROM supplier GROUP BY 1, 2, 3),
    q AS (SELECT c_custkey, 'SUPPLIER' AS last, c_nationkey AS st, CASE c_custkey % 4 WHEN 0 THEN 'AL' WHEN 1 THEN '00' WHEN 2 THEN '2' END AS dist FROM customer)
    SELECT c_custkey, bioguide FROM q LEFT JOIN r ON r.last = q.last AND r.st = q.st AND r.dist = CASE WHEN q.dist = '2' THEN 2 ELSE 0 END""")  # fmt: skip
def member_lookup(spark, d):
    """Members by last name, state and district; "AL", "00" and no district are 0; of two members of one key the last counts."""
    roster = table(spark, d, "supplier").groupBy(F.upper(F.regexp_extract("s_name", "^[A-Za-z]+", 0)).alias("last"), F.col("s_nationkey").alias("st"), (F.col("s_suppkey") % 3).alias("dist")).agg(F.max("s_suppkey").alias("bioguide"))
    code = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'AL' WHEN 1 THEN '00' WHEN 2 THEN '2' END")
    asked = table(spark, d, "customer").select("c_custkey", F.lit("SUPPLIER").alias("last"), F.col("c_nationkey").alias("st"), F.coalesce(F.try_to_number(code, F.lit("99")).cast("long"), F.lit(0)).alias("dist"))
    return asked.join(roster, ["last", "st", "dist"], "left").select("c_custkey", "bioguide")


@query("contest_places", """SELECT o_orderkey, lpad(CAST(o_custkey AS STRING), 5, '0') AS fips, c.c_name AS place FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey AND c.c_nationkey < 15""")
def contest_places(spark, d):
    """Contests with the place of their key and their state, where there is one. Codes of five digits cut longer keys, so they join nothing."""
    places = table(spark, d, "customer").where("c_nationkey < 15").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("place"))
    return table(spark, d, "orders").join(places, "o_custkey", "left").select("o_orderkey", F.lpad(F.col("o_custkey").cast("string"), 5, "0").alias("fips"), "place")


@query("vote_labels", """SELECT l_orderkey, l_linenumber, l_partkey, coalesce(CASE WHEN p_size > 45 THEN p_type END, CASE WHEN p_partkey % 5 <> 0 THEN p_name END, o_orderpriority, CAST(l_orderkey AS STRING)) AS label
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0) o ON o_orderkey = l_orderkey""")  # fmt: skip
def vote_labels(spark, d):
    """A vote's label: its item's summary, else its title, else the motion, else its id."""
    votes, items = table(spark, d, "lineitem"), table(spark, d, "part")
    motions = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    joined = votes.join(items, F.col("p_partkey") == F.col("l_partkey"), "left").join(motions, F.col("k") == F.col("l_orderkey"), "left")
    label = F.coalesce(F.when(F.col("p_size") > 45, F.col("p_type")), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")), "o_orderpriority", F.col("l_orderkey").cast("string"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", label.alias("label"))


_WHO = phrase("c_custkey", ["Ann Lee", "Lee", "Robert Ann Lee", "Bo Diaz", "Diaz", "Cy Young Diaz", "Kim", "ann lee"])
_ROSTER = phrase("s_suppkey", ["Ann Lee", "Bo Diaz", "Robert Lee", "Cy Diaz", "Jo Kim"])


@query("name_scores", f"""WITH q AS (SELECT c_custkey, lower({_WHO}) AS n FROM customer), r AS (SELECT s_suppkey, lower({_ROSTER}) AS m FROM supplier),
    s AS (SELECT c_custkey, s_suppkey, CASE WHEN n = m THEN 3 WHEN len(list_intersect(string_split(n, ' '), string_split(m, ' '))) = len(list_distinct(string_split(n, ' '))) THEN 2 WHEN list_contains(string_split(m, ' '), string_split(n, ' ')[-1]) THEN 1 ELSE 0 END AS score FROM q CROSS JOIN r)
    SELECT c_custkey, arg_min(s_suppkey, (-score, s_suppkey)) AS member, max(score) AS score FROM s WHERE score > 0 GROUP BY 1""")  # fmt: skip
def name_scores(spark, d):
    """The member that a name means: the same name 3, all its words 2, its last word 1. Every match has the last word, so names meet on words."""
    asked = table(spark, d, "customer").select("c_custkey", F.lower(F.expr(_WHO)).alias("name"))
    roster = table(spark, d, "supplier").select("s_suppkey", F.lower(F.expr(_ROSTER)).alias("m"))
    # A score depends on the two texts alone: each text is compared once, for the first member of that name.
    texts = asked.select("name").distinct().withColumn("n", F.split("name", " ")).withColumn("w", F.element_at("n", -1))
    names = roster.groupBy("m").agg(F.min("s_suppkey").alias("s_suppkey")).withColumn("m", F.split("m", " ")).withColumn("w", F.explode(F.array_distinct("m")))
    every = F.size(F.array_except("n", "m")) == 0
    scored = texts.join(names, "w").select("name", "s_suppkey", F.when(F.col("n") == F.col("m"), 3).when(every, 2).otherwise(1).alias("score"))
    best = lambda df, key, member: df.groupBy(key).agg(F.min_by(member, F.when(F.col(member).isNotNull(), F.struct(-F.col("score"), member))).alias("member"), F.max("score").alias("score"))
    return best(asked.join(best(scored, "name", "s_suppkey"), "name"), "c_custkey", "member")


_CALLED = phrase("c_custkey", ["Ted Lee", "bill DIAZ", "Senator Liz Kim", "jo", "Al Bert", "Robert Bob", "nobody {n}", "ed ed", "Kim,", "Betty Cruz"], n="c_custkey")
_MEMBERS = phrase("s_suppkey", ["Lee, Edward A.", "Diaz, William", "Kim, Elizabeth", "Jones, Jo", "Bert, Albert", "Roberts, Robert", "Cruz, Elizabeth Betty", "Edwards, Ann", "Lee, Bo", "Kimball, Sue {n}"], n="s_suppkey")
_NICK = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in name_search.NICKNAMES.items()) + "}"


@query("member_by_nickname", f"""WITH q AS (SELECT c_custkey, string_split(lower({_CALLED}), ' ') AS w FROM customer), p AS (SELECT c_custkey, unnest(list_concat(w, list_filter(list_transform(w, lambda x: {_NICK}[x]), lambda x: x IS NOT NULL))) AS part FROM q),
    r AS (SELECT s_suppkey, lower({_MEMBERS}) AS name FROM supplier),
    s AS (SELECT c_custkey, s_suppkey, sum(CASE WHEN part = string_split(replace(name, ',', ''), ' ')[1] THEN 3 ELSE 1 END) AS score FROM p JOIN r ON contains(name, part) GROUP BY 1, 2)
    SELECT c_custkey, arg_min(s_suppkey, (-score, s_suppkey)) AS member, CAST(max(score) AS INTEGER) AS score FROM s GROUP BY 1""")
def member_by_nickname(spark, d):
    """The member whose name has most of what a question calls them, nicknames read as names."""
    asked = table(spark, d, "customer").select("c_custkey", F.expr(_CALLED).alias("q"))
    return name_search.best_members(asked, "c_custkey", "q", table(spark, d, "supplier").select("s_suppkey", F.expr(_MEMBERS).alias("name")), "s_suppkey", "name")


@query("candidate_pick", """SELECT o_custkey, arg_max(o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, year(o_orderdate), -o_orderkey)) AS candidate FROM orders GROUP BY 1""")
def candidate_pick(spark, d):
    """Of the candidates of a name, one for the office asked for, then the one of the latest election, then the first."""
    order = F.struct((F.col("o_orderstatus") == "F").cast("int"), F.year("o_orderdate"), -F.col("o_orderkey"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", order).alias("candidate"))


@query("district_members", """WITH m AS (SELECT s_suppkey, s_nationkey AS st, lpad(CAST(s_suppkey % 7 AS STRING), 2, '0') AS dist FROM supplier), q AS (SELECT c_custkey, c_nationkey AS st, c_custkey % 7 AS dist FROM customer)
    SELECT c_custkey, lpad(CAST(q.st AS STRING), 2, '0') || lpad(CAST(q.dist AS STRING), 2, '0') AS geoid, min(s_suppkey) AS member FROM q JOIN m ON m.st = q.st AND CAST(m.dist AS BIGINT) = q.dist GROUP BY 1, 2""")  # fmt: skip
def district_members(spark, d):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    members = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("st"), two(F.col("s_suppkey") % 7).cast("long").alias("dist"))
    asked = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("st"), (F.col("c_custkey") % 7).alias("dist"))
    first = members.groupBy("st", "dist").agg(F.min("s_suppkey").alias("s_suppkey"))  # before the join, which would pair all members of a district with all who ask
    return asked.join(first, ["st", "dist"]).groupBy("c_custkey", F.concat(two(F.col("st")), two(F.col("dist"))).alias("geoid")).agg(F.min("s_suppkey").alias("member"))


@query("contest_matches", """WITH p AS (SELECT p_partkey AS place, p_brand AS city, p_size AS st, p_type AS county FROM part), c AS (SELECT ps.p_partkey AS contest, p_brand AS city, p_size AS st, p_type AS county FROM part ps WHERE p_partkey % 2 = 0)
    SELECT DISTINCT place, contest FROM p JOIN c ON (p.city = c.city AND contest % 5 = 0) OR (p.st = c.st AND p.county = c.county)""")  # fmt: skip
def contest_matches(spark, d):
    """Places and contests of the same listed city, or of the same state and county."""
    part = table(spark, d, "part")
    of = lambda df, key: df.select(F.col("p_partkey").alias(key), F.col("p_brand").alias("city"), F.col("p_size").alias("st"), F.col("p_type").alias("county"))
    return records.either_equal(of(part, "place"), of(part.where("p_partkey % 2 = 0"), "contest"), "place", "contest", ["city"], ["st", "county"], lambda key: key % 5 == 0)


@query("not_yet_shown", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def not_yet_shown(spark, d):
    shown = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(shown, "o_orderkey", "left_anti")


@query("calendar_merge", """WITH p AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS "day" FROM orders WHERE o_orderkey % 3 <> 0), c AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS "day" FROM orders WHERE o_orderkey % 3 = 0)
    SELECT "day", 'first' AS source FROM p UNION ALL SELECT "day", 'curated' FROM c WHERE "day" NOT IN (SELECT "day" FROM p)""")  # fmt: skip
def calendar_merge(spark, d):
    """Days of the first source, and of the curated one where the first has none."""
    days = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    first, curated = (days.where(w).select("day").distinct() for w in ("o_orderkey % 3 <> 0", "o_orderkey % 3 = 0"))
    return first.withColumn("source", F.lit("first")).unionByName(curated.join(first, "day", "left_anti").withColumn("source", F.lit("curated")))


_CONSENT = phrase("o_orderkey", ["items on consent: 1, 2 and 3.", "Items on consent 4a, 5", "no list"])


@query("consent_expansion", f"""WITH m AS (SELECT o_orderkey, unnest(CASE o_orderkey % 3 WHEN 0 THEN [1, 2, 3] WHEN 1 THEN [4, 5] ELSE [] END) AS item FROM orders) SELECT o_orderkey, item, l_partkey FROM m JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = item""")
def consent_expansion(spark, d):
    """The facts of each item that a consent motion lists."""
    m = table(spark, d, "orders").select("o_orderkey", F.explode(b.consent_items(F.expr(_CONSENT)).cast("array<int>")).alias("item"))
    facts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("int").alias("item"), "l_partkey")
    return m.join(facts, ["o_orderkey", "item"])


@query("sector_laws", """WITH l AS (SELECT o_orderkey AS law, list_distinct(list(p_type)) AS sectors FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1)
    SELECT law, CAST(len(sectors) AS INTEGER) AS sectors FROM l WHERE list_contains(sectors, (SELECT min(p_type) FROM part))""")  # fmt: skip
def sector_laws(spark, d):
    """Laws that the sector is among the sectors of."""
    part = table(spark, d, "part")
    lines = table(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    laws = lines.groupBy(F.col("o_orderkey").alias("law")).agg(F.collect_set("p_type").alias("s"))
    wanted = part.agg(F.min("p_type").alias("wanted"))  # one row
    return laws.join(F.broadcast(wanted), F.array_contains("s", F.col("wanted"))).select("law", F.size("s").alias("sectors"))


@query("ticker_timeline", sql(""", w AS (SELECT ticker FROM sectors WHERE sector = (SELECT min(sector) FROM sectors)), l AS (SELECT ticker, event_date FROM law_dates WHERE ticker IN (SELECT ticker FROM w) AND ticker % 2 = 0),
    s AS (SELECT ticker, coalesce(min(event_date) - 45, DATE '1998-12-31' - 730) AS since FROM w LEFT JOIN l USING (ticker) GROUP BY 1)
    SELECT ticker, price_date AS "day", 'price' AS mark, count(*) AS n FROM prices JOIN s USING (ticker) WHERE price_date BETWEEN since AND DATE '1998-12-31' GROUP BY ALL
    UNION ALL SELECT ticker, trade_date, 'trade', count(*) FROM trades JOIN w USING (ticker) GROUP BY ALL UNION ALL SELECT ticker, event_date, 'law', count(*) FROM l GROUP BY ALL""", "sectors", "law_dates", "prices", "trades"))  # fmt: skip
def ticker_timeline(spark, d):
    """A sector's laws, trades and prices on one line, prices from 45 days before the first law, or for two years."""
    s, end = a.sectors(spark, d), F.lit("1998-12-31").cast("date")
    wanted = s.join(F.broadcast(s.agg(F.min("sector").alias("sector"))), "sector").select("ticker")
    laws = a.law_dates(spark, d).where("ticker % 2 = 0").join(wanted, "ticker", "left_semi")
    since = wanted.join(laws, "ticker", "left").groupBy("ticker").agg(F.coalesce(F.date_sub(F.min("event_date"), 45), F.date_sub(end, 730)).alias("since"))
    prices = a.prices(spark, d).join(since, "ticker").where(F.col("price_date").between(F.col("since"), end))
    marks = lambda df, day, mark: df.groupBy("ticker", F.col(day).alias("day")).agg(F.count("*").alias("n")).withColumn("mark", F.lit(mark))
    return marks(prices, "price_date", "price").unionByName(marks(a.trades(spark, d).join(wanted, "ticker", "left_semi"), "trade_date", "trade")).unionByName(marks(laws, "event_date", "law"))


@query("roster_fill", sql(""", m AS (SELECT vote_id, member, min(position) AS position FROM positions WHERE member % 2 = 0 GROUP BY ALL), r AS (SELECT s_suppkey AS member FROM supplier WHERE s_suppkey BETWEEN 1 AND 10), v AS (SELECT DISTINCT vote_id FROM positions)
    SELECT v.vote_id, r.member, coalesce(m.position, 'aye') AS position FROM v CROSS JOIN r LEFT JOIN m ON m.vote_id = v.vote_id AND m.member = r.member""", "positions"))  # fmt: skip
def roster_fill(spark, d):
    """Every member of a body's roster votes aye on each of its votes, but where the minutes name another position. The roster is a list of ten seats."""
    p = a.positions(spark, d)
    named = p.where("member % 2 = 0").groupBy("vote_id", "member").agg(F.min("position").alias("position"))
    votes = p.select("vote_id").distinct()
    seats = votes.select("vote_id", F.explode(F.sequence(F.lit(1), F.lit(10)).cast("array<bigint>")).alias("member"))
    roster = table(spark, d, "supplier").select(F.col("s_suppkey").alias("member"))
    return seats.join(roster, "member", "left_semi").join(named, ["vote_id", "member"], "left").select("vote_id", "member", F.coalesce("position", F.lit("aye")).alias("position"))


@query("place_groups", """WITH c AS (SELECT c_nationkey AS place, count(*) AS stores FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS place, count(*) AS projects FROM supplier GROUP BY 1) SELECT place, coalesce(stores, 0) AS stores, coalesce(projects, 0) AS projects FROM c FULL JOIN s USING (place)""")
def place_groups(spark, d):
    count = lambda name, c, out: table(spark, d, name).groupBy(F.col(c).alias("place")).agg(F.count("*").alias(out))
    return count("customer", "c_nationkey", "stores").join(count("supplier", "s_nationkey", "projects"), "place", "full_outer").na.fill(0)


@query("attendance_conflicts", sql(""", f AS (SELECT vote_id, list(DISTINCT member) FILTER (position <> 'abstain') AS here, list(DISTINCT member) FILTER (position = 'abstain') AS away FROM positions GROUP BY 1)
    SELECT vote_id, CAST(len(list_intersect(coalesce(here, []), coalesce(away, []))) AS INTEGER) AS conflicts FROM f WHERE len(list_intersect(coalesce(here, []), coalesce(away, []))) > 0""", "positions"))  # fmt: skip
def attendance_conflicts(spark, d):
    """Members both present and absent."""
    p = a.positions(spark, d)
    sets = p.groupBy("vote_id").agg(F.collect_set(F.when(F.col("position") != "abstain", F.col("member"))).alias("here"), F.collect_set(F.when(F.col("position") == "abstain", F.col("member"))).alias("away"))
    return sets.select("vote_id", F.size(F.array_intersect("here", "away")).alias("conflicts")).where("conflicts > 0")


@query("new_findings", """SELECT l_orderkey AS ref, l_returnflag AS "check" FROM lineitem WHERE l_orderkey % 5 = 0 EXCEPT SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber <= 2""")
def new_findings(spark, d):
    """Findings of the changed records that the unchanged ones don't have."""
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ref"), F.col("l_returnflag").alias("check"), "l_linenumber")
    return f.where("ref % 5 = 0").select("ref", "check").distinct().join(f.where("l_linenumber <= 2"), ["ref", "check"], "left_anti")


@query("days_without_record", """SELECT DISTINCT CAST(o_orderdate AS DATE) AS "day" FROM orders EXCEPT SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 7 = 0""")
def days_without_record(spark, d):
    """Days of the store that are neither covered nor declared missing."""
    days = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return days.select("day").distinct().join(days.where("o_orderkey % 2 = 0"), "day", "left_anti").join(days.where("o_orderkey % 7 = 0"), "day", "left_anti")


@query("still_to_embed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def still_to_embed(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left_anti")


@query("sources_union", """WITH u AS (SELECT c_nationkey AS k, 'customer' AS source, min(c_custkey) AS id, 0 AS r FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, 'supplier', min(s_suppkey), 1 FROM supplier GROUP BY 1) SELECT k, source, id FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY r) = 1""")
def sources_union(spark, d):
    """One record for each key, from the first source that has it."""
    least = lambda name, key, ident, rank: table(spark, d, name).groupBy(F.col(key).alias("k")).agg(F.min(ident).alias("id")).select("k", F.lit(name).alias("source"), "id", F.lit(rank).alias("r"))
    both = least("customer", "c_nationkey", "c_custkey", 0).unionByName(least("supplier", "s_nationkey", "s_suppkey", 1))
    return records.first_by(both, ["k"], ["r"]).drop("r")


@query("phase_fallback", """WITH p AS (SELECT o_custkey AS k, o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 2 ELSE 3 END AS phase FROM orders) SELECT k, id, phase FROM p QUALIFY phase = min(phase) OVER (PARTITION BY k)""")
def phase_fallback(spark, d):
    """The hits of the first phase of a search that has any."""
    phase = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    hits = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), phase.alias("phase"))
    return hits.withColumn("least", F.min("phase").over(Window.partitionBy("k"))).where("phase = least").drop("least")


@query("state_in_title", r"""WITH n AS (SELECT lower(n_name) AS name FROM nation), q AS (SELECT o_orderkey, lower(CASE o_orderkey % 3 WHEN 0 THEN 'Primary in ' || n_name ELSE 'General vote' END) AS t FROM orders JOIN nation ON n_nationkey = o_custkey % 25)
    SELECT o_orderkey, max_by(name, length(name)) AS state FROM q JOIN n ON contains(t, name) GROUP BY 1""")  # fmt: skip
def state_in_title(spark, d):
    """The longest state's name in a title. The names are a fixed list of 25, as one pattern, the longest first."""
    names = table(spark, d, "nation")
    listed = names.agg(F.array_sort(F.collect_list(F.struct((-F.length("n_name")).alias("size"), F.lower("n_name").alias("name")))).alias("names"))  # one row
    title = F.lower(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Primary in "), "n_name")).otherwise("General vote"))
    q = table(spark, d, "orders").join(F.broadcast(names), F.col("n_nationkey") == F.col("o_custkey") % 25).select("o_orderkey", title.alias("t"))
    hit = F.get(F.filter(F.transform("names", lambda n: n["name"]), lambda n: F.col("t").contains(n)), 0)
    return q.crossJoin(F.broadcast(listed)).select("o_orderkey", hit.alias("state")).where("state is not null")


@query("label_lines", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Energy' ELSE 'Tech' END AS sector FROM part WHERE p_size % 3 <> 0""")
def label_lines(spark, d):
    """Labels of the form id=sector, a line each, as a model answers them: known sectors in any case stay, others go."""
    answer = F.concat(F.lit("Here are they:\n"), F.col("p_partkey").cast("string"), F.lit(" = "), F.when(F.col("p_size") % 3 == 0, "unheard of").when(F.col("p_size") % 2 == 0, "ENERGY").otherwise("tech"), F.lit("\n\n"))
    lines = table(spark, d, "part").select(F.explode(F.split(answer, "\n")).alias("line")).where(F.col("line").contains("="))
    pair = lines.select(F.trim(F.split_part("line", F.lit("="), F.lit(1))).cast("long").alias("p_partkey"), F.initcap(F.trim(F.split_part("line", F.lit("="), F.lit(2)))).alias("sector"))
    return pair.where(F.col("sector").isin("Energy", "Tech"))


_ANSWERS = phrase("o_orderkey", [
    '```json{nl}<"k": {n}, "note": "line one{nl}two">{nl}```', 'Sure: <"k": {n}, "note": "line one{nl}two"> done', '<{nl}  "k": {n},{nl}  "note": "a  b"{nl}>', "no object", '<"k": {n}, "note": <1>>', '<"k": {n}',
], n="o_custkey")


@query("json_repair", f"""WITH q AS (SELECT o_orderkey, translate({_ANSWERS}, '<>', chr(123) || chr(125)) AS t FROM orders),
    o AS (SELECT o_orderkey, regexp_extract(t, '(?s)(\\{{.*\\}})', 1) AS body FROM q),
    p AS (SELECT o_orderkey, string_agg(CASE WHEN i % 2 = 0 THEN replace(part, chr(10), '\\n') ELSE part END, '"' ORDER BY i) AS fixed FROM (SELECT o_orderkey, unnest(string_split(body, '"')) AS part, generate_subscripts(string_split(body, '"'), 1) AS i FROM o) z GROUP BY 1)
    SELECT o_orderkey, CAST(json_extract_string(fixed, '$.k') AS BIGINT) AS k, json_extract_string(fixed, '$.note') AS note FROM p WHERE json_valid(fixed)""")
def json_repair(spark, d):
    """The outermost object of an answer with a fence and talk around it; line ends may stand inside its strings as between its parts. Others give nothing."""
    answer = F.translate(F.expr(_ANSWERS), "<>", "{}")
    parsed = F.from_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), "k long, note string, bad string", {"allowUnquotedControlChars": "true", "columnNameOfCorruptRecord": "bad"})
    return table(spark, d, "orders").select("o_orderkey", parsed.alias("j")).where("j.k is not null AND j.bad is null").select("o_orderkey", "j.k", "j.note")


@query("known_acts", f"""WITH q AS (SELECT o_orderkey, lower({phrase('o_orderkey', ['show me the Clean Air Act', 'repeal the Clean Air Act', 'Voting Rights Act', 'what the civil rights act means for my small town business', 'roads'])}) AS t FROM orders)
    SELECT o_orderkey, CASE WHEN contains(t, 'clean air') THEN 'clean air act' ELSE 'voting rights act' END AS act FROM q WHERE t IN ('show me the clean air act', 'voting rights act')""")
def known_acts(spark, d):
    """Questions that are a well-known act's name with at most twenty signs around it, and don't turn against it."""
    acts, against = ["clean air act", "voting rights act", "civil rights act"], ["repeal", "amend", "replace", "against", "oppose", "not", "reform"]
    q = F.lower(F.expr(phrase("o_orderkey", ["show me the Clean Air Act", "repeal the Clean Air Act", "Voting Rights Act", "what the civil rights act means for my small town business", "roads"])))
    rest = lambda n: F.regexp_replace(F.regexp_replace(F.trim(F.replace(q, F.lit(n), F.lit(""))), r"^(show me|find|what is|tell me about|give me|search for|the|a|an)\s+", ""), r"\s*(act|law|bill|legislation)$", "")
    act = F.coalesce(*[F.when(q.contains(n) & ~b.any_of(q, against) & (F.length(rest(n)) <= 20), n) for n in acts])
    return table(spark, d, "orders").select("o_orderkey", act.alias("act")).where("act is not null")


@query("search_strings", """SELECT p_partkey, CASE WHEN contains(p_name, ' ') THEN '"' || p_name || '"' ELSE p_name END || ' OR ' || p_brand || ' AND collection:(' || p_type || ')' AS q FROM part""")
def search_strings(spark, d):
    """A search of terms joined by OR, those of several words in quotes, six at most, within a collection."""
    quoted = F.transform(F.slice(F.array_distinct(F.array("p_name", "p_brand")), 1, 6), lambda x: F.when(x.contains(" "), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x))
    return table(spark, d, "part").select("p_partkey", F.concat(F.array_join(quoted, " OR "), F.lit(" AND collection:("), "p_type", F.lit(")")).alias("q"))


@query("slug_candidates", """WITH q AS (SELECT n_nationkey, regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') AS a, regexp_replace(lower(n_name), '[^a-z0-9]+', '', 'g') AS b FROM nation)
    SELECT n_nationkey, a AS first, CAST(CASE WHEN a = b THEN 2 ELSE 3 END AS INTEGER) AS n FROM q""")  # fmt: skip
def slug_candidates(spark, d):
    slug = t.alnum(F.col("n_name"), "-")
    tries = F.array_distinct(F.array(slug, t.alnum(F.col("n_name"), ""), F.concat(slug, F.lit("-county"))))
    return table(spark, d, "nation").select("n_nationkey", F.element_at(tries, 1).alias("first"), F.size(tries).alias("n"))
