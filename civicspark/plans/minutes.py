"""Minutes, tables and places read out of text, each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import phrase
from ..io import table
from ..registry import query

_BLOCKS = phrase("o_orderkey", [
    "Yea: (3) Lee, Kim, Diaz Nay: (1) Cruz Absent: (0)", "Yea: (2) Ann Lee, Bo Kim", "Nay: (1) Lee Yea: (2) Cruz, Kim Abstain: (1) Diaz", "Motion withdrawn", "Yea: (0) Nay: (0)",
])
_COUNTED = phrase("o_orderkey", ["2 - Lee, Kim, Notes follow here", "1 - Diaz", "0 - none", "no count", "3 - Lee, Kim"])
_NARRATIVE = phrase("o_orderkey", ["All voting aye except Lee, who was absent.", "Carried, Kim voting NAY, Diaz abstaining.", "Carried unanimously.", "Kim and Lee voting NAY."])
_PLACES = phrase("p_partkey", ["Main Street Library (Renovation)", "Phase II - Oak Park, Phase 2", "Fire Station #{n} Replacement", "Countywide: roads", "Elm School - Addition FY2027"], n="p_size")
_VERSIONS = phrase("o_orderkey", ["Enrolled Bill", "Introduced in House", "Engrossed in Senate", "Reported in House", "Placed on Calendar"])


def _orders(spark, d, expression):
    return table(spark, d, "orders").select("o_orderkey", F.expr(expression).alias("t"))


def _sql(expression: str, select: str, key: str = "o_orderkey", source: str = "orders") -> str:
    return f"WITH q AS (SELECT {key}, {expression} AS t FROM {source}) {select}"


@query("tally_blocks", _sql(_BLOCKS, r"""SELECT o_orderkey, lower(k) AS position, CAST(n AS INTEGER) AS n, nullif(trim(names), '') AS names FROM (SELECT o_orderkey, unnest(regexp_extract_all(t, '(Yea|Nay|Abstain|Absent): \((\d+)\)', 1)) AS k,
    unnest(regexp_extract_all(t, '(Yea|Nay|Abstain|Absent): \((\d+)\)', 2)) AS n, unnest(regexp_split_to_array(t, '(?:Yea|Nay|Abstain|Absent): \(\d+\)')[2:]) AS names FROM q) z WHERE k IS NOT NULL"""))  # fmt: skip
def tally_blocks(spark, d):
    """Blocks such as "Yea: (3) names": position, count and names."""
    head = r"(Yea|Nay|Abstain|Absent): \((\d+)\)"
    parts = F.arrays_zip(F.regexp_extract_all("t", F.lit(head), F.lit(1)).alias("k"), F.regexp_extract_all("t", F.lit(head), F.lit(2)).alias("n"), F.slice(F.split("t", head), F.lit(2), F.size(F.split("t", head)) - 1).alias("names"))
    rows = _orders(spark, d, _BLOCKS).where(F.col("t").rlike(head)).select("o_orderkey", F.explode(parts).alias("b"))
    return rows.select("o_orderkey", F.lower("b.k").alias("position"), F.col("b.n").cast("int").alias("n"), F.nullif(F.trim("b.names"), F.lit("")).alias("names"))


@query("counted_names", _sql(_COUNTED, r"""SELECT o_orderkey, array_to_string(list_transform(string_split(regexp_extract(t, '^(\d+) - (.*)$', 2), ',')[1:CAST(regexp_extract(t, '^(\d+) - (.*)$', 1) AS INTEGER)], lambda x: trim(x)), '|') AS names FROM q WHERE regexp_matches(t, '^[1-9]\d* - ')"""))
def counted_names(spark, d):
    """Lists such as "2 - names": no more names than the count says."""
    n, rest = (F.regexp_extract("t", r"^(\d+) - (.*)$", g) for g in (1, 2))
    names = F.transform(F.slice(F.split(rest, ","), F.lit(1), n.cast("int")), lambda x: F.trim(x))
    return _orders(spark, d, _COUNTED).where(F.col("t").rlike(r"^[1-9]\d* - ")).select("o_orderkey", F.array_join(names, "|").alias("names"))


@query("default_aye", _sql(_NARRATIVE, r"""SELECT o_orderkey, m AS member, CASE WHEN regexp_matches(t, m || '( and \w+)? voting NAY') OR (m = 'Kim' AND contains(t, 'Kim and Lee voting NAY')) THEN 'no' WHEN contains(t, m || ', who was absent') THEN 'absent' WHEN contains(t, m || ' abstaining') THEN 'abstain' ELSE 'aye' END AS position
    FROM (SELECT o_orderkey, t, unnest(['Lee', 'Kim', 'Diaz', 'Cruz']) AS m FROM q) z"""))  # fmt: skip
def default_aye(spark, d):
    """Members of a roster vote aye unless the motion's sentence names them otherwise; the first such naming counts."""
    rows = _orders(spark, d, _NARRATIVE).select("o_orderkey", "t", F.explode(F.array(*map(F.lit, ["Lee", "Kim", "Diaz", "Cruz"]))).alias("member"))
    said = lambda tail: F.regexp_like("t", F.concat(F.col("member"), F.lit(tail)))
    position = F.when(said(r"(?: and \w+)? voting NAY"), "no").when(said(", who was absent"), "absent").when(said(" abstaining"), "abstain").otherwise("aye")
    return rows.select("o_orderkey", "member", position.alias("position"))


@query("present_blocks", _sql(_BLOCKS, r"SELECT o_orderkey FROM q WHERE regexp_matches(t, '\([1-9]\d*\)')"))
def present_blocks(spark, d):
    """Vote blocks that aren't all zero."""
    counts = F.regexp_extract_all("t", F.lit(r"\((\d+)\)"), F.lit(1))
    return _orders(spark, d, _BLOCKS).where(F.exists(counts, lambda n: n.cast("int") > 0)).select("o_orderkey")


@query("column_amounts", """WITH q AS (SELECT o_orderkey, CAST(10 * (1 + o_orderkey % 3) + o_orderkey % 7 - 3 AS INTEGER) AS pos FROM orders), h AS (SELECT * FROM (VALUES (10, 'FY2027'), (20, 'FY2028'), (30, 'FY2029')) v(x, name)),
    r AS (SELECT o_orderkey, pos, name, abs(pos - x) AS gap, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(pos - x), x) AS i FROM q CROSS JOIN h)
    SELECT o_orderkey, CASE WHEN pos > 32 THEN 'total' ELSE name END AS "column" FROM r WHERE i = 1 AND gap <= 9""")  # fmt: skip
def column_amounts(spark, d):
    """The heading that an amount stands nearest to; right of the last one are totals. The headings are a page's few columns."""
    at = (10 * (1 + F.col("o_orderkey") % 3) + F.col("o_orderkey") % 7 - 3).cast("int")
    line = F.concat(F.rpad(F.lit(""), at, " "), F.lit("$1,234"))
    heads = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(name).alias("name")) for x, name in ((10, "FY2027"), (20, "FY2028"), (30, "FY2029"))])
    rows = table(spark, d, "orders").select("o_orderkey", (F.instr(line, "$") - 1).alias("at"))
    near = F.array_min(F.transform(heads, lambda h: F.struct(F.abs(F.col("at") - h["x"]).alias("gap"), h["x"].alias("x"), h["name"].alias("name"))))
    rows = rows.withColumn("h", near).where("h.gap <= 9")
    return rows.select("o_orderkey", F.when(F.col("at") > 32, "total").otherwise(F.col("h.name")).alias("column"))


@query("version_pick", _sql(_VERSIONS, """SELECT c AS bill, arg_min(t, (CASE t WHEN 'Enrolled Bill' THEN 1 WHEN 'Engrossed in Senate' THEN 2 WHEN 'Reported in House' THEN 3 WHEN 'Introduced in House' THEN 4 ELSE 9 END, o_orderkey)) AS version FROM (SELECT q.*, o_custkey AS c FROM q JOIN orders USING (o_orderkey)) z GROUP BY 1"""))
def version_pick(spark, d):
    """A bill's text version of the highest standing."""
    rank = {"Enrolled Bill": 1, "Engrossed in Senate": 2, "Reported in House": 3, "Introduced in House": 4}
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.expr(_VERSIONS).alias("t"))
    standing = F.coalesce(*[F.when(F.col("t") == k, v) for k, v in rank.items()], F.lit(9))
    return rows.groupBy(F.col("o_custkey").alias("bill")).agg(F.min_by("t", F.struct(standing, "o_orderkey")).alias("version"))


@query("geocode_queries", _sql(_PLACES, r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(t, '\([^)]*\)|\bFY\d{4}\b|#\d+|\bphase\s+(?:[ivx]+|\d+)\b', ' ', 'gi'), '\b(renovation|replacement|addition)\b', ' ', 'gi'), '[\s,:\-]+', ' ', 'g')) AS place FROM q""", "p_partkey", "part"))
def geocode_queries(spark, d):
    """A project's title as an address search takes it: no brackets, years, numbers, phases or kinds of work."""
    t = F.regexp_replace(F.regexp_replace(F.expr(_PLACES), r"(?i)\([^)]*\)|\bFY\d{4}\b|#\d+|\bphase\s+(?:[ivx]+|\d+)\b", " "), r"(?i)\b(renovation|replacement|addition)\b", " ")
    return table(spark, d, "part").select("p_partkey", F.trim(F.regexp_replace(t, r"[\s,:\-]+", " ")).alias("place"))


@query("bounded_places", """SELECT s_suppkey, CASE WHEN s_suppkey * 7 % 90 BETWEEN 38 AND 40 AND -(s_suppkey * 13 % 180) BETWEEN -78 AND -76 THEN 'inside' ELSE 'outside' END AS place, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence FROM supplier""")
def bounded_places(spark, d):
    """Whether a point lies in a county's box, and how sure its kind of address makes it."""
    lat, lon = F.col("s_suppkey") * 7 % 90, -(F.col("s_suppkey") * 13 % 180)
    inside = lat.between(38, 40) & lon.between(-78, -76)
    return table(spark, d, "supplier").select("s_suppkey", F.when(inside, "inside").otherwise("outside").alias("place"), F.when(F.col("s_suppkey") % 2 == 0, 0.9).otherwise(0.5).alias("confidence"))


@query("confidence_merge", """SELECT o_custkey, count(DISTINCT year(o_orderdate)) AS congresses, CASE WHEN count(DISTINCT year(o_orderdate)) >= 3 THEN least(CAST(max(o_orderkey % 10) AS DOUBLE) / 10, 0.55) ELSE CAST(max(o_orderkey % 10) AS DOUBLE) / 10 END AS confidence FROM orders GROUP BY 1""")
def confidence_merge(spark, d):
    """An answer's own confidence, held lower where it spreads over three Congresses or more."""
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct(F.year("o_orderdate")).alias("congresses"), (F.max(F.col("o_orderkey") % 10).cast("double") / 10).alias("own"))
    return n.select("o_custkey", "congresses", F.when(F.col("congresses") >= 3, F.least("own", F.lit(0.55))).otherwise(F.col("own")).alias("confidence"))


@query("contest_levels", """SELECT o_custkey, string_agg(DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 'federal' WHEN 1 THEN 'state' WHEN 2 THEN 'local' ELSE 'other' END, ',' ORDER BY CASE o_orderkey % 4 WHEN 0 THEN 'federal' WHEN 1 THEN 'state' WHEN 2 THEN 'local' ELSE 'other' END) AS levels FROM orders GROUP BY 1""")
def contest_levels(spark, d):
    """The levels of an election's contests, each once."""
    office = F.expr(phrase("o_orderkey", ["U.S. Senate", "State Delegate", "Mayor of the City", "Measure A"]))
    level = F.when(office.rlike("(?i)u\\.s\\.|president|congress"), "federal").when(office.rlike("(?i)state|governor|delegate"), "state").when(office.rlike("(?i)mayor|city|county|school"), "local").otherwise("other")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set(level)), ",").alias("levels"))


@query("compact_amounts", """SELECT o_orderkey, CASE WHEN v >= 1000000 THEN '$' || CAST(v // 1000000 AS STRING) || 'M' WHEN v >= 1000 THEN '$' || CAST(v // 1000 AS STRING) || 'K' ELSE '$' || CAST(v AS STRING) END AS amount, (o_orderkey % 9) || '–' || (o_orderkey % 4) AS tally FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 40) AS v FROM orders) z""")
def compact_amounts(spark, d):
    v = F.floor("o_totalprice") * (F.col("o_orderkey") % 40)
    short = lambda unit, sign: F.concat(F.lit("$"), F.floor(v / unit).cast("string"), F.lit(sign))
    amount = F.when(v >= 1_000_000, short(1_000_000, "M")).when(v >= 1000, short(1000, "K")).otherwise(short(1, ""))
    return table(spark, d, "orders").select("o_orderkey", amount.alias("amount"), F.concat_ws("–", F.col("o_orderkey") % 9, F.col("o_orderkey") % 4).alias("tally"))


@query("missing_presence", """SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def missing_presence(spark, d):
    """Records that one source has and the other, which should have all, hasn't."""
    return table(spark, d, "orders").where("o_orderkey % 2 = 0").select("o_orderkey").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("decision_excerpts", """WITH r AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') AS t FROM conversations) SELECT conv_id, turn, trim(t[greatest(1, strpos(t, ' the ') - 20):strpos(t, ' the ') + 39]) AS excerpt FROM r WHERE strpos(t, ' the ') > 0""")
def decision_excerpts(spark, d):
    """What stands around the first sign of a decision in a text; " the " stands for the signs of minutes."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    rows = table(spark, d, "conversations").select("conv_id", "turn", t.alias("t")).withColumn("at", F.instr("t", " the ")).where("at > 0")
    start = F.greatest(F.lit(1), F.col("at") - 20)
    return rows.select("conv_id", "turn", F.trim(F.substring("t", start, F.col("at") + 39 - start + 1)).alias("excerpt"))


@query("quote_contexts", """WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '[ \\t\\n\\f\\r]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, array_to_string(w, ' ') AS t, array_to_string(w[31:42], ' ') AS quote FROM w WHERE len(w) > 60)
    SELECT doc_id, md5(t[greatest(1, strpos(t, quote) - 90):strpos(t, quote) + length(quote) - 1 + 20]) AS context FROM q""")  # fmt: skip
def quote_contexts(spark, d):
    """What stands before and behind a quote's first twelve words in its document, white space aside."""
    flat = F.trim(F.regexp_replace("text", r"[ \t\n\f\r]+", " "))
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", flat.alias("t")).withColumn("w", F.split("t", " ")).where("size(w) > 60")
    rows = rows.withColumn("quote", F.array_join(F.slice("w", 31, 12), " ")).withColumn("at", F.expr("instr(t, quote)"))
    start = F.greatest(F.lit(1), F.col("at") - 90)
    return rows.select("doc_id", F.md5(F.substring("t", start, F.col("at") + F.length("quote") - 1 + 20 - start + 1)).alias("context"))


@query("committee_scores", r"""WITH c AS (SELECT n_nationkey, lower('Committee on ' || n_name || ' Affairs') AS name FROM nation), q AS (SELECT o_orderkey, lower('Affairs of nation_' || o_custkey % 25 || ' bill') AS t FROM orders),
    w AS (SELECT o_orderkey, unnest(list_distinct(list_filter(regexp_split_to_array(t, '[^a-z0-9_]+'), lambda x: length(x) > 4 AND x NOT IN ('committee')))) AS w FROM q), s AS (SELECT o_orderkey, n_nationkey, sum(length(w)) AS score FROM w JOIN c ON list_contains(regexp_split_to_array(name, '[^a-z0-9_]+'), w) GROUP BY 1, 2)
    SELECT o_orderkey, arg_max(n_nationkey, (score, -n_nationkey)) AS committee, CAST(max(score) AS BIGINT) AS score FROM s GROUP BY 1""")  # fmt: skip
def committee_scores(spark, d):
    """The committee whose name has the most of a text's distinctive words, by their length; the first of several."""
    words = lambda text: F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda x: (F.length(x) > 4) & (x != "committee")))
    c = table(spark, d, "nation").select("n_nationkey", F.explode(words(F.concat(F.lit("Committee on "), "n_name", F.lit(" Affairs")))).alias("w"))
    q = table(spark, d, "orders").select("o_orderkey", F.explode(words(F.concat(F.lit("Affairs of nation_"), F.col("o_custkey") % 25, F.lit(" bill")))).alias("w"))
    s = q.join(c, "w").groupBy("o_orderkey", "n_nationkey").agg(F.sum(F.length("w")).alias("score"))
    return s.groupBy("o_orderkey").agg(F.max_by("n_nationkey", F.struct("score", -F.col("n_nationkey"))).alias("committee"), F.max("score").alias("score"))


@query("offset_headings", """WITH h AS (SELECT l_orderkey AS doc, l_linenumber * 100 AS at, min(l_partkey) AS heading FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), m AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber * 100 + 50 AS at FROM lineitem WHERE l_returnflag <> 'A')
    SELECT m.doc, m.at, h.heading FROM m ASOF LEFT JOIN h ON m.doc = h.doc AND m.at >= h.at""")  # fmt: skip
def offset_headings(spark, d):
    """The heading before each motion, by where both stand in the text."""
    from ..operators.temporal import asof

    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_linenumber", "l_partkey", "l_returnflag")
    heads = lines.where("l_returnflag = 'A'").groupBy("doc", (F.col("l_linenumber") * 100).alias("at")).agg(F.min("l_partkey").alias("heading"))
    motions = lines.where("l_returnflag <> 'A'").select("doc", (F.col("l_linenumber") * 100 + 50).alias("t"))
    return asof(motions, heads, "doc", "t", "at", "heading", forward=False).select("doc", F.col("t").alias("at"), F.col("hit").alias("heading"))
