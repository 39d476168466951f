"""Bill ids, mentions, actions, tallies and titles in text, each query beside its SQL.

The texts are made of the rows of orders, so that every form a rule knows comes up many times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import phrase
from ..functions import bills as b
from ..io import table
from ..registry import query

QUESTIONS = phrase("o_orderkey", [
    "Show me H.R. {n}", "s. {n}", "find HJRES {n}", "tell me about H. Con. Res. {n}.", "what did anyone do about S. {n}", "hr {n} and more", "S.Res.{n}", "bring up the h res {n}", "HR 0", "",
    "H.R. 123456", "open  SJRES {n} ", "HB {n}", "sb {n} from 2019", "the AB {n} in the 88th legislature", "show me l.d. {n}, 12th session", "A. {n} session of 2021", "HF {n} 2020", "SR {n}", "LB {n} of 1999",
    "laws Biden signed", "how to trump a veto", "bills under Trump and Obama", "the Bush years",
], n="o_custkey")
ACTIVITY = phrase("o_orderkey", [
    "Support for H.R. {n} and S. {m}; also H.R. {n}", "monitor H.J.Res. {m}, S Con Res {n}", "no bills here, room 5", "HR{n}/S.Res {m} & SJRes{m}", "tax policy (H. Res. {n}), chapters 4", "S {n}, s. {n} and US {m}",
], n="o_custkey", m="o_orderkey % 997")
ACTIONS = phrase("o_orderkey", [
    "Became Public Law No: 118-{n}.", "Passed House by recorded vote: {n} - {m} (Roll no. 7).", "On passage Passed by the Yeas and Nays: {n} - {m}.", "Referred to the Committee on Rules.", "Introduced in Senate",
    "Passed (125-{m})", "Third Reading Passed; ({n}-{m})", "Signed by Governor", "Vetoed by Governor", "Read first time", "Motion agreed to: {m} - 3 Record 12", "Ordered to be Reported", "Conference held", "Chaptered by State",
    "Presented to President.", "Vote scheduled for Monday", "Referred", "Placed on calendar", "Filed", "Approved by governor, chapter {n}",
], n="o_custkey", m="o_orderkey % 97")
TITLES = phrase("o_orderkey", [
    "To amend the Clean Water Act of 1972, and for other purposes.", "A bill to reauthorize the Farm Program {n} of 1990 to improve it.", "An Act to amend title {n}, for other purposes", "Recognizing the service of post {n}",
    "To amend it, and more", "a bill to require a strategy for item {n} and to provide for the fair and timely review of every open request that was filed with the department in the years before this one began; and for other purposes.",
    "Honoring the team of {n}", "Study of road {n} .,;", "under Title IIX of the code", "see title XIV and Title IIII",
], n="o_custkey")
MINUTES = phrase("o_orderkey", [
    "The motion passed 7-0-1-{m}.", "Motion carried, 5 - 2", "failed: {m}-4", "deferred to the next meeting", "approve items on consent: 1a, 1b, 2, {n} and 5.", "Items on Consent {m}c and xx (all)", "item on consent: none.", "Approved 0-0",
], n="o_custkey", m="o_orderkey % 9")


def _texts(spark, d: str, expression: str, name: str = "t") -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.expr(expression).alias(name))


def _sql(expression: str, select: str) -> str:
    return f"WITH q AS (SELECT o_orderkey, {expression} AS t FROM orders) {select}"


_INTRO = r"^\s*(?:show me |find |tell me about |what is |what''s |open |bring up )?(?:the )?"
_FEDERAL = _INTRO + rf"({'|'.join(b.FEDERAL_TYPES)})\s*\.?\s*(\d{{1,5}})\s*\.?\s*$"


@query("bill_id_fast_path", _sql(QUESTIONS, rf"""SELECT o_orderkey, lower(regexp_replace(m.kind, '[^A-Za-z]', '', 'g')) AS "type", CAST(m.num AS INTEGER) AS number
    FROM (SELECT o_orderkey, regexp_extract(t, '{_FEDERAL}', ['kind', 'num'], 'i') AS m FROM q) z WHERE m.kind <> '' AND CAST(m.num AS INTEGER) BETWEEN 1 AND 99999"""))  # fmt: skip
def bill_id_fast_path(spark, d):
    return _texts(spark, d, QUESTIONS).withColumn("bill", b.federal_bill(F.col("t"))).where("bill is not null").select("o_orderkey", "bill.type", "bill.number")


_STATE = _INTRO + rf"({'|'.join(b.STATE_TYPES)})\s*\.?\s*(\d{{1,5}})\s*\.?\s*(?:(?:\s+from\s+|\s+in\s+|\s*,\s*)?(?:the\s+)?(?:(?:19|20)\d{{2}}|\d{{1,3}}(?:st|nd|rd|th)\s+(?:session|legislature|general\s+assembly)|session\s+of\s+(?:19|20)\d{{2}}))?\s*$"


@query("state_bill_fast_path", _sql(QUESTIONS, rf"""SELECT o_orderkey, upper(regexp_replace(m.kind, '[^A-Za-z]', '', 'g')) AS "type", CAST(m.num AS INTEGER) AS number, coalesce(nullif(y, ''), nullif(o, '')) AS requested FROM (
    SELECT o_orderkey, regexp_extract(t, '{_STATE}', ['kind', 'num'], 'i') AS m, regexp_extract(t, '\b(19\d\d|20\d\d)\b', 1) AS y, regexp_extract(t, '\b(\d{{1,3}})(?:st|nd|rd|th)\s+(?:session|legislature|general\s+assembly)\b', 1, 'i') AS o FROM q) z
    WHERE m.kind <> '' AND CAST(m.num AS INTEGER) BETWEEN 1 AND 99999"""))  # fmt: skip
def state_bill_fast_path(spark, d):
    t = _texts(spark, d, QUESTIONS).withColumn("bill", b.state_bill(F.col("t"))).where("bill is not null")
    return t.select("o_orderkey", "bill.type", "bill.number", b.state_session(F.col("t")).alias("requested"))


@query("president_congresses", _sql(QUESTIONS, r"""SELECT o_orderkey, CASE WHEN contains(lower(t), 'biden') THEN '117,118' WHEN regexp_matches(lower(t), 'trump') AND NOT regexp_matches(lower(t), 'to\s+trump') THEN '119,115,116'
    WHEN contains(lower(t), 'obama') THEN '111,112,113,114' WHEN contains(lower(t), 'bush') THEN '107,108,109,110' END AS congresses FROM q WHERE regexp_matches(t, '(?i)biden|trump|obama|bush|clinton|reagan')"""))  # fmt: skip
def president_congresses(spark, d):
    t = _texts(spark, d, QUESTIONS).where(b.any_of(F.lower("t"), list(b.PRESIDENTS)))
    return t.select("o_orderkey", F.array_join(b.president_congresses(F.col("t")).cast("array<string>"), ",").alias("congresses"))


@query("congress_ranges", """WITH q AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderkey % 2 = 0 AS everything, CASE o_orderkey % 5 WHEN 0 THEN 'last 2 years' WHEN 1 THEN 'Last 10 Years' WHEN 2 THEN 'year:' || CAST(1700 + o_orderkey % 300 AS STRING) WHEN 3 THEN '' END AS scope FROM orders),
    r AS (SELECT *, (y - 1789) // 2 + 1 AS c, TRY_CAST(nullif(regexp_extract(scope, '^year:(\\d{4})', 1), '') AS INTEGER) AS named, CASE WHEN lower(scope) = 'last 2 years' THEN 2 WHEN lower(scope) = 'last 10 years' THEN 10 ELSE 3 END AS back FROM q)
    SELECT o_orderkey, CAST(CASE WHEN named < 1789 THEN c WHEN named IS NOT NULL THEN (named - 1789) // 2 + 1 ELSE c END AS INTEGER) AS newest,
        CAST(CASE WHEN named < 1789 THEN c WHEN named IS NOT NULL THEN CASE WHEN everything THEN 1 ELSE (named - 1789) // 2 + 1 END WHEN everything THEN 1 ELSE (y - back - 1789) // 2 + 1 END AS INTEGER) AS oldest FROM r""")  # fmt: skip
def congress_ranges(spark, d):
    scope = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'last 2 years' WHEN 1 THEN 'Last 10 Years' WHEN 2 THEN 'year:' || CAST(1700 + o_orderkey % 300 AS STRING) WHEN 3 THEN '' END")
    span = b.congresses(F.col("scope"), F.year("o_orderdate"), F.col("o_orderkey") % 2 == 0)
    t = table(spark, d, "orders").withColumn("scope", scope).select("o_orderkey", span.alias("c"))
    return t.select("o_orderkey", F.element_at("c", 1).alias("newest"), F.element_at("c", -1).alias("oldest"))


@query("bill_mentions", _sql(ACTIVITY, rf"""SELECT DISTINCT o_orderkey, lower(regexp_replace(regexp_replace(hit, '\d+$', ''), '[^A-Za-z]', '', 'g')) AS "type", CAST(regexp_extract(hit, '(\d+)$', 1) AS INTEGER) AS number
    FROM (SELECT o_orderkey, unnest(regexp_extract_all(t, '\b(?:{'|'.join(b.MENTIONED_TYPES)})\s*\d{{1,5}}\b', 0, 'i')) AS hit FROM q) z"""))  # fmt: skip
def bill_mentions(spark, d):
    return _texts(spark, d, ACTIVITY).select("o_orderkey", F.explode(b.bill_mentions(F.col("t"))).alias("bill")).select("o_orderkey", "bill.*")


PACKAGES = phrase("o_orderkey", ["BILLS-118hr{n}ih", "BILLS-119s{n}is", "BILLS-117hjres{n}enr", "PLAW-118publ{n}", "BILLS-118", "118hres{n}eh"], n="o_custkey")


@query("package_ids", _sql(PACKAGES, r"""SELECT o_orderkey, CAST(nullif(coalesce(nullif(b.c, ''), p.c), '') AS INTEGER) AS congress, nullif(b.k, '') AS "type", CAST(nullif(b.n, '') AS INTEGER) AS number, CAST(nullif(p.n, '') AS INTEGER) AS law,
    v IN ('ih', 'is') AS introduced FROM (SELECT o_orderkey, regexp_extract(replace(t, 'BILLS-', ''), '^(\d+)([a-z]+)(\d+)', ['c', 'k', 'n']) AS b, regexp_extract(t, '^PLAW-(\d+)publ(\d+)', ['c', 'n']) AS p, regexp_extract(t, '[a-z]+$') AS v FROM q) z"""))  # fmt: skip
def package_ids(spark, d):
    t = _texts(spark, d, PACKAGES).select("o_orderkey", b.package(F.col("t")).alias("bill"), b.law_package(F.col("t")).alias("law"), b.package_version(F.col("t")).isin("ih", "is").alias("introduced"))
    return t.select("o_orderkey", F.coalesce("bill.congress", "law.congress").alias("congress"), "bill.type", "bill.number", F.col("law.number").alias("law"), "introduced")


@query("action_events", _sql(ACTIONS, r"""SELECT o_orderkey, CASE WHEN regexp_matches(l, 'became public law|(signed by|presented to) president') THEN 'signed' WHEN regexp_matches(l, 'passed (house|senate)|agreed to in') THEN 'passed' WHEN regexp_matches(l, 'committee|reported by') THEN 'committee'
        WHEN contains(l, 'introduced') THEN 'introduced' WHEN contains(l, 'referred') THEN 'referred' WHEN contains(l, 'conference') THEN 'conference' WHEN contains(l, 'vetoed') THEN 'vetoed' ELSE 'action' END AS federal,
    CASE WHEN contains(l, 'veto') THEN 'vetoed' WHEN regexp_matches(l, '(signed|approved) by governor|enacted|chaptered|became law|signed into law') THEN 'signed' WHEN regexp_matches(l, 'final passage|passed') THEN 'passed' WHEN regexp_matches(l, 'committee|favorable report|reported') THEN 'committee'
        WHEN regexp_matches(l, 'referred|first reading') THEN 'referred' WHEN regexp_matches(l, 'introduced|filed|read first time') THEN 'introduced' ELSE 'action' END AS state FROM (SELECT o_orderkey, lower(t) AS l FROM q) z"""))  # fmt: skip
def action_events(spark, d):
    t = _texts(spark, d, ACTIONS)
    return t.select("o_orderkey", b.first_class(F.col("t"), b.FEDERAL_EVENTS, "action").alias("federal"), b.first_class(F.col("t"), b.STATE_EVENTS, "action").alias("state"))


@query("inline_votes", _sql(ACTIONS, r"""SELECT o_orderkey, CAST(coalesce(nullif(a.y, ''), nullif(b.y, ''), nullif(c.y, '')) AS INTEGER) AS yea, CAST(coalesce(nullif(a.n, ''), nullif(b.n, ''), nullif(c.n, '')) AS INTEGER) AS nay FROM (
    SELECT o_orderkey, regexp_extract(t, '(?:yeas? and nays?|yea-nay vote|recorded vote)[^\d]*(\d+)\s*[-–]\s*(\d+)', ['y', 'n'], 'i') AS a, regexp_extract(t, ':\s*(\d{1,3})\s*[-–]\s*(\d{1,3})(?:\s*\(Roll|\s*Record)', ['y', 'n'], 'i') AS b,
    regexp_extract(t, '\((\d+)\s*-\s*(\d+)\)', ['y', 'n']) AS c FROM q) z WHERE a.y <> '' OR b.y <> '' OR c.y <> ''"""))  # fmt: skip
def inline_votes(spark, d):
    """Votes of federal actions, and of state actions, which have them in brackets."""
    state = [F.nullif(F.regexp_extract("t", r"\((\d+)\s*-\s*(\d+)\)", g), F.lit("")).cast("int") for g in (1, 2)]
    t = _texts(spark, d, ACTIONS).withColumn("v", F.coalesce(b.inline_vote(F.col("t")), F.when(state[0].isNotNull(), F.struct(state[0].alias("yea"), state[1].alias("nay")))))
    return t.where("v is not null").select("o_orderkey", "v.yea", "v.nay")


@query("status_labels", _sql(ACTIONS, r"""SELECT *, CAST(CASE WHEN regexp_matches(label, '^(Public Law|Signed)') THEN 5 WHEN label LIKE 'Passed%' THEN 3 WHEN label IN ('Reported', 'Vote Scheduled') THEN 2 WHEN label IN ('In Committee', 'Referred') THEN 1 ELSE 0 END AS INTEGER) AS rank FROM (
    SELECT o_orderkey, CASE WHEN regexp_matches(l, 'became public law|enacted|became law') THEN 'Public Law' WHEN regexp_matches(l, 'signed by president|signed into law') THEN 'Signed into Law' WHEN regexp_matches(l, 'signed by governor|chaptered') THEN 'Signed'
        WHEN regexp_matches(l, '(passed|agreed to in) house') THEN 'Passed House' WHEN regexp_matches(l, '(passed|agreed to in) senate') THEN 'Passed Senate' WHEN regexp_matches(l, 'passed|agreed to|concurred in') THEN 'Passed'
        WHEN regexp_matches(l, 'vote scheduled|scheduled for') THEN 'Vote Scheduled' WHEN regexp_matches(l, 'reported by|ordered to be reported') THEN 'Reported' WHEN contains(l, 'committee') THEN 'In Committee' WHEN contains(l, 'referred') THEN 'Referred'
        WHEN contains(l, 'introduced') THEN 'Introduced' ELSE 'Active' END AS label FROM (SELECT o_orderkey, lower(t) AS l FROM q) z) z"""))  # fmt: skip
def status_labels(spark, d):
    return _texts(spark, d, ACTIONS).select("o_orderkey", b.status(F.col("t")).alias("label")).withColumn("rank", b.status_rank(F.col("label")))


@query("amended_laws", _sql(TITLES, r"""SELECT o_orderkey, CASE WHEN a.act IS NOT NULL THEN 'Amends' ELSE 'Reauthorizes' END AS label, coalesce(a.act, r.act) AS act FROM (SELECT o_orderkey,
    CASE WHEN length(a) BETWEEN 5 AND 120 THEN {'act': a} END AS a, CASE WHEN length(r) BETWEEN 5 AND 120 THEN {'act': r} END AS r FROM (SELECT o_orderkey,
    rtrim(trim(regexp_extract(t, 'to\s+amend\s+(?:the\s+)?(.+?)\s*(?:of\s+\d{4})?(?:,|\.|\sto\b)', 1, 'i')), ',.') AS a, rtrim(trim(regexp_extract(t, 'to\s+reauthorize\s+(?:the\s+)?(.+?)\s*(?:of\s+\d{4})?(?:,|\.|\sto\b)', 1, 'i')), ',.') AS r FROM q) z) z WHERE a IS NOT NULL OR r IS NOT NULL"""))  # fmt: skip
def amended_laws(spark, d):
    t = _texts(spark, d, TITLES).withColumn("law", b.amends(F.col("t"), F.lit(None).cast("string")))
    return t.where("law is not null").select("o_orderkey", "law.label", "law.act")


@query("compact_titles", _sql(TITLES, r"""SELECT o_orderkey, CASE WHEN length(u) <= 140 THEN u ELSE rtrim(CASE WHEN length(regexp_extract(u[:140], '^(.*) ', 1)) > 110 THEN regexp_extract(u[:140], '^(.*) ', 1) ELSE u[:140] END, ' .,;:') || '…' END AS title FROM (
    SELECT o_orderkey, upper(s[:1]) || s[2:] AS u FROM (SELECT o_orderkey, trim(rtrim(regexp_replace(regexp_replace(trim(t), '^(a bill to|an act to|to)\s+', '', 'i'), '[,;]?\s*(and\s+)?for\s+other\s+purposes\.?\s*$', '', 'i'), ' .,;:')) AS s FROM q) z) z"""))  # fmt: skip
def compact_titles(spark, d):
    return _texts(spark, d, TITLES).select("o_orderkey", b.compact_title(F.col("t")).alias("title"))


@query("title_flags", _sql(TITLES, r"""SELECT o_orderkey, regexp_matches(t, '(?i)expressing support|(recognizing|honoring) the|congratulating|acknowledging|commemorating|proclaiming|celebrating|designating') AS ceremonial,
    CASE WHEN n NOT IN ('', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII', 'XIII', 'XIV', 'XV', 'XVI', 'XVII', 'XVIII', 'XIX', 'XX') THEN n END AS bad_number FROM (SELECT *, upper(regexp_extract(t, '\btitle\s+([ivx]+)\b', 1, 'i')) AS n FROM q) z"""))  # fmt: skip
def title_flags(spark, d):
    return _texts(spark, d, TITLES).select("o_orderkey", b.any_of(F.lower("t"), b.CEREMONIAL).alias("ceremonial"), b.bad_title_number(F.col("t")).alias("bad_number"))


@query("enacted_only", _sql(ACTIONS, "SELECT o_orderkey FROM q WHERE regexp_matches(t, '(?i)(signed|approved) by governor|enacted|chaptered|became law|signed into law')"))
def enacted_only(spark, d):
    return _texts(spark, d, ACTIONS).where(b.any_of(F.lower("t"), b.ENACTED)).select("o_orderkey")


@query("minutes_tallies", _sql(MINUTES, r"""SELECT o_orderkey, k AS position, CAST(v AS INTEGER) AS n FROM (SELECT o_orderkey, unnest(['aye', 'no', 'absent', 'abstain']) AS k, unnest([m.a, m.b, m.c, m.d]) AS v FROM (
    SELECT o_orderkey, regexp_extract(t, '(?:passed|carried|failed|approved)\s*[,:]?\s*(\d+)\s*-\s*(\d+)(?:\s*-\s*(\d+))?(?:\s*-\s*(\d+))?', ['a', 'b', 'c', 'd'], 'i') AS m FROM q) z) z WHERE v <> '' AND CAST(v AS INTEGER) > 0"""))  # fmt: skip
def minutes_tallies(spark, d):
    return _texts(spark, d, MINUTES).select("o_orderkey", F.explode(b.tally(F.col("t"))).alias("position", "n"))


@query("consent_items", _sql(MINUTES, r"""SELECT DISTINCT o_orderkey, regexp_extract(tok, '^\s*(\d+)[a-z]?\s*$', 1, 'i') AS item FROM (SELECT o_orderkey, unnest(regexp_split_to_array(regexp_extract(t, 'items? on consent:?\s*([0-9a-zA-Z ,\-and]+?)(?:\.|\(|$)', 1, 'i'), ',|\band\b')) AS tok FROM q) z WHERE regexp_matches(tok, '^\s*\d+[a-zA-Z]?\s*$')"""))
def consent_items(spark, d):
    return _texts(spark, d, MINUTES).select("o_orderkey", F.explode(b.consent_items(F.col("t"))).alias("item"))


CODES = phrase("o_orderkey", ["H. Rept. 118-{n}", "S. Rept 117 - {n}", "Ex. Rept. 116-{n}", "GA{n}", "HB{n}", "$1,{n}", "C", "119-{n}", "Nay", " YES ", "nv", "Excused", "SB 5", "AK0", "H.Rept. {n}"], n="100 + o_custkey % 900")


@query("report_citations", _sql(CODES, r"""SELECT o_orderkey, CAST(m.c AS INTEGER) AS congress, CASE lower(m.k) WHEN 'h.' THEN 'HRPT' WHEN 's.' THEN 'SRPT' ELSE 'ERPT' END AS "type", CAST(m.n AS INTEGER) AS number,
    'https://www.congress.gov/' || m.c || '/crpt/' || k || CAST(CAST(m.n AS INTEGER) AS STRING) || '/generated/CRPT-' || m.c || k || CAST(CAST(m.n AS INTEGER) AS STRING) || '.htm' AS url FROM (
    SELECT *, CASE lower(m.k) WHEN 'h.' THEN 'hrpt' WHEN 's.' THEN 'srpt' ELSE 'erpt' END AS k FROM (SELECT o_orderkey, regexp_extract(t, '^\s*(H\.|S\.|Ex\.)\s*Rept\.?\s*(\d+)\s*-\s*(\d+)', ['k', 'c', 'n'], 'i') AS m FROM q) z) z WHERE m.k <> ''"""))  # fmt: skip
def report_citations(spark, d):
    t = _texts(spark, d, CODES).withColumn("r", b.report(F.col("t"), F.lit(None).cast("string"))).where("r is not null")
    return t.select("o_orderkey", "r.*", b.report_url(F.col("r")).alias("url"))


@query("coded_values", _sql(CODES, r"""SELECT o_orderkey, CASE WHEN lower(trim(t)) IN ('yea', 'aye', 'yes', 'y') THEN 'Yea' WHEN lower(trim(t)) IN ('nay', 'no', 'n') THEN 'Nay' WHEN lower(trim(t)) IN ('present', 'p') THEN 'Present' ELSE 'Not Voting' END AS vote,
    CASE lower(trim(t)) WHEN 'yes' THEN 'yes' WHEN 'nay' THEN 'no' WHEN 'nv' THEN 'not voting' WHEN 'excused' THEN 'excused' ELSE 'other' END AS state_vote, CASE WHEN t = 'C' THEN 0 WHEN t LIKE '$%' THEN CAST(replace(replace(t, '$', ''), ',', '') AS BIGINT) END AS amount,
    CASE WHEN t LIKE 'H%' OR t LIKE 'A%' THEN 'lower' WHEN t LIKE 'S%' THEN 'upper' ELSE '' END AS chamber, CASE WHEN regexp_matches(t, '^[A-Z]{2}\d+$') THEN t[:2] END AS state, CASE WHEN regexp_matches(t, '^[A-Z]{2}\d+$') THEN CAST(t[3:] AS INTEGER) END AS district,
    regexp_extract(t, '([^-]*)$', 1) AS law FROM q"""))  # fmt: skip
def coded_values(spark, d):
    c = F.col("t")
    t = _texts(spark, d, CODES).withColumn("o", b.office_district(c))
    amount = F.when((c == "C") | c.startswith("$"), b.money(F.when((c == "C") | c.startswith("$"), c)))
    return t.select("o_orderkey", b.vote_word(c).alias("vote"), b.state_vote_word(c).alias("state_vote"), amount.alias("amount"), b.chamber_of(c).alias("chamber"), "o.state", "o.district", b.law_number(c).alias("law"))


_FLAGGED = phrase("o_orderkey", [
    "Recognizing the work of {n}", "To designate the post office of {n}", "Commending the team of {n}", "Roads and Bridges Act {n}", "National Day of Records {n}", "Celebrating the life of {n}",
    "Naming a bridge", "Expressing the sense of the House", "acknowledging {n}", "To authorize the President to award a medal",
], n="o_custkey")


def _any(phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(t), '{p}')" for p in phrases) + ")"


@query("ceremonial_titles", _sql(_FLAGGED, f"SELECT o_orderkey, {_any(b.CEREMONIAL)} AS search, {_any(b.FEED_CEREMONIAL)} AS feed, {_any(b.STATE_CEREMONIAL)} AS state FROM q"))
def ceremonial_titles(spark, d):
    """Whether a title has no substance, for searches, for the feed, and for searches in a state."""
    t = F.lower("t")
    return _texts(spark, d, _FLAGGED).select("o_orderkey", b.any_of(t, b.CEREMONIAL).alias("search"), b.any_of(t, b.FEED_CEREMONIAL).alias("feed"), b.any_of(t, b.STATE_CEREMONIAL).alias("state"))


_STAGED = phrase("o_orderkey", [
    "Introduced in House", "Referred to the Committee on {n}", "Ordered to be Reported by {n}", "Placed on Senate Calendar No. {n}", "Passed House by voice vote", "On passage in the Senate: passed",
    "Failed of passage in Senate", "Presented to President.", "Became Public Law No: {n}", "Pocket veto by President", "Held at the desk", "Rejected by the House {n}", "Passed Senate; passed House", "Introduced in Senate; referred to subcommittee",
], n="o_custkey")
_STAGE_CASES = ", ".join(f"CASE WHEN regexp_matches(t, '{w}', 'i') THEN {{'rank': {b.STAGES[s]}, 'tried': {-i}, 'stage': '{s}'}} END" for i, (s, w) in enumerate(b.STAGE_WORDS))


@query("bill_stages", f"""WITH q AS (SELECT o_custkey, o_orderkey, {_STAGED} AS t FROM orders WHERE o_orderkey % 3 > 0 OR o_custkey % 2 = 0),
    s AS (SELECT o_custkey, o_orderkey, list_sort(list_filter([{_STAGE_CASES}], lambda x: x IS NOT NULL), 'DESC')[1] AS s FROM q)
    SELECT o_custkey AS bill, coalesce(arg_max(s.stage, {{'rank': s.rank, 'early': -o_orderkey}}) FILTER (s IS NOT NULL), 'introduced') AS stage FROM s GROUP BY 1""")
def bill_stages(spark, d):
    """The most advanced stage that a bill's actions name, the first of several as far; a bill whose actions name none is introduced."""
    actions = table(spark, d, "orders").where("o_orderkey % 3 > 0 OR o_custkey % 2 = 0").select("o_custkey", "o_orderkey", F.expr(_STAGED).alias("t"))
    staged = actions.select("o_custkey", "o_orderkey", b.stage_of_action(F.col("t")).alias("s"))
    best = F.max_by("s.stage", F.when(F.col("s").isNotNull(), F.struct("s.rank", -F.col("o_orderkey"))))
    return staged.groupBy(F.col("o_custkey").alias("bill")).agg(F.coalesce(best, F.lit("introduced")).alias("stage"))


@query("congress_years", "SELECT DISTINCT CAST(o_custkey % 130 AS INTEGER) AS congress, CAST((o_custkey % 130 - 1) * 2 + 1789 AS INTEGER) AS start, CAST((o_custkey % 130 - 1) * 2 + 1790 AS INTEGER) AS \"end\" FROM orders WHERE o_custkey % 130 > 0")
def congress_years(spark, d):
    c = (F.col("o_custkey") % 130).cast("int")
    return table(spark, d, "orders").where(c > 0).select(c.alias("congress")).distinct().select("congress", b.congress_years(F.col("congress")).alias("y")).select("congress", "y.*")
