"""Texts of bills and pages: cleaning, sections, evidence, similarity of titles, each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..adapters import phrase
from ..functions import text as t
from ..io import table
from ..registry import query

TERMS = phrase("o_orderkey", [
    "The  Clean Air Act of 1970.", "Defense Production Act (DPA)", " the GI Bill; ", "Title {n}, part B", "", "Act of (1990) now", "THE END: ", "a/b - C_d {n}",
], n="o_custkey")
BILLS = phrase("o_orderkey", [
    "[Congressional Bills]{nl}{nl}[From the printer]{nl}A BILL{nl}To do a thing in road {n}.{nl}{nl}{nl}{nl}Be it enacted   by all.", "RESOLUTION {n} stands first", "Preamble words.{nl}RESOLUTION of the house. Resolved, that  it is so.",
    "In front. SECTION 1. SHORT TITLE{nl}This Act may be cited as the Act on Roads and Bridges number {n}, as it stands.{nl}SEC. 2. FINDINGS{nl}The house finds that roads are long, and that bridges number {n} at the least.{nl}SEC. 3. NONE{nl}Too short.",
    "Rules.{nl}§ 12 of the code is changed so that each county counts its own roads and bridges in each year.{nl}sec 7. of the code stays as it was written in the year before this one, in all its parts.", "No marker at all, only prose about {n}.",
], n="o_custkey")
WRAPPED = phrase("o_orderkey", [
    "AN ACT{nl}relating to roads {n}{nl}and bridges.{nl}(2){nl}  each county shall{nl}count them;{nl}SECTION 1. It is{nl}enacted.", "Sec.{nl}240.912.{nl}The fee is{nl}{n} dollars{nl}{nl}(a) for cars{nl}(b) for carts.", "ALL CAPS HEADER:{nl}prose that{nl}goes on!{nl}By: no one",
    "one line {n}",
], n="o_custkey")


def _texts(spark, d, expression):
    return table(spark, d, "orders").select("o_orderkey", F.expr(expression).alias("t"))


def _sql(expression: str, select: str) -> str:
    return f"WITH q AS (SELECT o_orderkey, {expression} AS t FROM orders) {select}"


@query("normalized_terms", _sql(TERMS, r"""SELECT o_orderkey, trim(rtrim(regexp_replace(regexp_replace(regexp_replace(lower(trim(t)), '\s*\([^)]*\)\s*$', ''), '^the\s+', ''), '\s+', ' ', 'g'), '.,;: ')) AS term,
    trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) AS words, trim(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(upper(t), '[^A-Z0-9]', '', 'g') AS ident FROM q"""))  # fmt: skip
def normalized_terms(spark, d):
    c = F.col("t")
    return _texts(spark, d, TERMS).select("o_orderkey", t.normalized_term(c).alias("term"), t.alnum(c).alias("words"), t.alnum(c, "-").alias("slug"), t.identifier(c).alias("ident"))


@query("boilerplate_cut", _sql(BILLS, r"""SELECT o_orderkey, trim(regexp_replace(regexp_replace(CASE WHEN strpos(t, 'Be it enacted') > 1 THEN t[strpos(t, 'Be it enacted'):] WHEN strpos(t, 'Resolved,') > 1 THEN t[strpos(t, 'Resolved,'):]
    WHEN strpos(t, 'RESOLUTION') > 1 THEN t[strpos(t, 'RESOLUTION'):] WHEN strpos(t, 'A BILL') > 1 THEN t[strpos(t, 'A BILL'):] ELSE t END, '\n{3,}', E'\n\n', 'g'), ' {2,}', ' ', 'g')) AS body FROM q"""))  # fmt: skip
def boilerplate_cut(spark, d):
    return _texts(spark, d, BILLS).select("o_orderkey", t.cut_boilerplate(F.col("t")).alias("body"))


@query("bill_text_clean", _sql(BILLS, r"""SELECT o_orderkey, trim(regexp_replace(regexp_replace(t, '^(?:[ \t]*(?:\[[^\n]*)?\n)+', ''), '\n{3,}', E'\n\n', 'g'), E' \n\t\r') AS body FROM q"""))
def bill_text_clean(spark, d):
    page = F.concat(F.lit("<html><h1>Head</h1><pre class='x'>"), F.col("t"), F.lit("</pre><p>Foot</p></html>"))
    return _texts(spark, d, BILLS).select("o_orderkey", t.bill_text(page).alias("body"))


@query("bill_sections", _sql(BILLS, r"""SELECT o_orderkey, CAST(i AS INTEGER) AS "index", regexp_extract(body, '^(SEC(?:TION)?\.?\s+\d+)[.\s]+([^\n]{0,100})', 1, 'i') AS number, trim(regexp_extract(body, '^(SEC(?:TION)?\.?\s+\d+)[.\s]+([^\n]{0,100})', 2, 'i')) AS title, md5(body) AS digest
    FROM (SELECT o_orderkey, unnest(range(0, len(parts))) AS i, trim(unnest(parts), E' \n\t') AS body FROM (SELECT o_orderkey, string_split(regexp_replace(t, '((?:SEC(?:TION)?\.?\s+\d+|§\s*\d+)[.\s])', E'\x01\\1', 'gi'), E'\x01') AS parts FROM q) z) z WHERE length(body) >= 50"""))  # fmt: skip
def bill_sections(spark, d):
    s = _texts(spark, d, BILLS).select("o_orderkey", F.explode(t.sections(F.col("t"))).alias("s"))
    return s.select("o_orderkey", "s.index", "s.number", "s.title", F.md5("s.body").alias("digest"))


@query("rejoined_lines", _sql(WRAPPED, r"""SELECT o_orderkey, CASE o_orderkey % 4
    WHEN 0 THEN 'AN ACT relating to roads ' || n || E' and bridges.\n(2)  each county shall count them;\n\nSECTION 1. It is enacted.'
    WHEN 1 THEN 'Sec.  240.912.' || E'\nThe fee is ' || n || E' dollars\n(a) for cars\n(b) for carts.' WHEN 2 THEN E'ALL CAPS HEADER:\nprose that goes on!\nBy: no one' ELSE 'one line ' || n END AS body FROM (SELECT o_orderkey, CAST(o_custkey AS STRING) AS n FROM orders) z"""))  # fmt: skip
def rejoined_lines(spark, d):
    """The SQL states the lines that the rule must give for each text."""
    return _texts(spark, d, WRAPPED).select("o_orderkey", t.rejoined(F.col("t")).alias("body"))


@query("html_strip", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM pages""")  # fmt: skip
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", t.strip_html(F.coalesce("html", F.lit(""))).alias("text"))


_EVIDENCE = r"""WITH RECURSIVE b AS (SELECT doc_id, text[501:] AS rest FROM documents WHERE length(text) > 2000),
    g AS (SELECT doc_id, length(rest) AS n, list_transform(regexp_split_to_array(rest, '(?i)\bth[a-z]+'), lambda x: length(x)) AS gaps, list_transform(regexp_extract_all(rest, '(?i)\bth[a-z]+'), lambda x: length(x)) AS hits FROM b),
    s AS (SELECT doc_id, n, list_transform(range(1, len(hits) + 1), lambda i: coalesce(list_sum(gaps[1:i]), 0) + coalesce(list_sum(hits[1:i - 1]), 0)) AS starts FROM g),
    k AS (SELECT doc_id, n, unnest(CASE WHEN len(starts) > 15 THEN list_transform(range(0, 15), lambda i: starts[CAST(floor(i * len(starts) / 15.0) AS BIGINT) + 1]) ELSE starts END) AS p FROM s),
    w AS (SELECT DISTINCT doc_id, greatest(0, p - 50) AS s, least(n, p + 50) AS e FROM k),
    r AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM w),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r),
    m AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM i GROUP BY doc_id, island), u AS (SELECT *, sum(e - s + 20) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) + 500 AS used FROM m)
    SELECT doc_id, CAST(s AS INTEGER) AS s, CAST(e AS INTEGER) AS e FROM u WHERE used <= 2000"""


@query("evidence_spans", _EVIDENCE)
def evidence_spans(spark, d):
    """Spans around words that begin with "th", which stand for the cues of bills: an even sample, merged, within a budget."""
    docs = table(spark, d, "documents").where(F.length("text") > 2000)
    spans = t.evidence_spans(docs, "text", head=500, budget=2000, reach=50, cues=r"\bth[a-z]+")
    # The outer form keeps Spark from deriving a filter that works the spans out again.
    return spans.select("doc_id", F.explode_outer("spans").alias("w")).where("w.s is not null").select("doc_id", "w.s", "w.e")


@query("title_overlap", """WITH q AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]{3,}')) AS a, list_distinct(regexp_extract_all(lower(p_brand || ' ' || p_type), '[a-z0-9]{3,}')) AS b FROM part)
    SELECT p_partkey, CAST(len(list_intersect(a, b)) AS INTEGER) AS shared, floor(len(list_intersect(a, b)) / least(len(a), len(b)) * 1000 + 0.5) / 1000 AS overlap, 2 * len(list_intersect(a, b)) >= len(a) AS half FROM q""")  # fmt: skip
def title_overlap(spark, d):
    a, b = (t.tokens(F.concat_ws(" ", x, "p_type")) for x in ("p_name", "p_brand"))
    rows = table(spark, d, "part").select("p_partkey", a.alias("a"), b.alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return rows.select("p_partkey", shared.alias("shared"), (F.floor(t.overlap(F.col("a"), F.col("b")) * 1000 + 0.5) / 1000).alias("overlap"), (2 * shared >= F.size("a")).alias("half"))


@query("fresh_questions", _sql(phrase("o_orderkey", ["latest bills", "what passed this week", "road law {n}", "RECENT votes", "todays list"], n="o_custkey"), "SELECT o_orderkey, regexp_matches(t, '(?i)today|this week|latest|breaking|just now|right now|recent') AS fresh FROM q"))
def fresh_questions(spark, d):
    q = phrase("o_orderkey", ["latest bills", "what passed this week", "road law {n}", "RECENT votes", "todays list"], n="o_custkey")
    return _texts(spark, d, q).select("o_orderkey", F.lower("t").rlike(t.FRESH).alias("fresh"))


@query("keyword_filters", r"""WITH q AS (SELECT p_partkey, lower(p_name) AS t, list_filter(regexp_split_to_array(lower(p_type), '\s+'), lambda w: length(w) > 3) AS k FROM part)
    SELECT p_partkey, len(k) >= 2 AND len(list_filter(k, lambda w: contains(t, w))) = len(k) AS every, len(list_filter(k, lambda w: w NOT IN ('standard', 'brushed') AND contains(t, w))) > 0 AS some FROM q""")  # fmt: skip
def keyword_filters(spark, d):
    """All distinctive words of a type in the name, two at least; any of them but the generic ones."""
    k = F.filter(F.split(F.lower("p_type"), r"\s+"), lambda w: F.length(w) > 3)
    rows = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("t"), k.alias("k"))
    every = (F.size("k") >= 2) & F.forall("k", lambda w: F.col("t").contains(w))
    return rows.select("p_partkey", every.alias("every"), F.exists("k", lambda w: ~w.isin("standard", "brushed") & F.col("t").contains(w)).alias("some"))


@query("distinct_links", r"""WITH u AS (SELECT conv_id, turn, unnest(range(0, 3)) AS i FROM conversations), l AS (SELECT conv_id, 'https://x.org/' || CAST((turn * 7 + i) % 5 AS STRING) AS url, turn * 3 + i AS n FROM u),
    f AS (SELECT conv_id, url, min(n) AS n FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS k FROM f) SELECT conv_id, string_agg(url, ' ' ORDER BY k) AS urls FROM r WHERE k <= 6 GROUP BY 1""")  # fmt: skip
def distinct_links(spark, d):
    """The first six different links of a conversation, in order, trailing signs removed."""
    link = lambda i: F.concat(F.lit("https://x.org/"), ((F.col("turn") * 7 + i) % 5).cast("string"), F.lit("/.,"))
    texts = table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(" see ", *[link(i) for i in range(3)]).alias("t"))
    urls = F.transform(F.regexp_extract_all("t", F.lit(r"https?://\S+"), F.lit(0)), lambda u: F.rtrim(F.rtrim(u, F.lit(".,)")), F.lit("/")))
    rows = texts.select("conv_id", "turn", F.posexplode(urls).alias("i", "url")).groupBy("conv_id", "url").agg(F.min(F.struct("turn", "i")).alias("n"))
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("n"))).where("k <= 6")
    return ranked.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "url"))), lambda x: x["url"]), " ").alias("urls"))
