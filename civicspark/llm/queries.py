"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, html_text, importance, lm_ctw, media_avi, ngram_join, packing, quality_cnn, sharding, token_files, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("op1_quality_cnn")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_cnn.score_documents(docs, quality_cnn.fit(docs, _table(spark, sf_dir, "labels")))


@query("op2_media_avi")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_avi.media_features(media_avi.store_media(_table(spark, sf_dir, "documents")))


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


@query(
    "op4_ngram_join",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
    s AS (
        SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
               ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS grams FROM w),
    g AS (SELECT DISTINCT list_sort(grams) AS grams, hash(list_sort(grams)) AS k FROM s WHERE len(grams) > 0),
    f AS (SELECT k, len(grams) AS n, unnest(grams) AS gram FROM g),
    p AS (SELECT a.k AS x, b.k AS y, count(*) AS shared, any_value(a.n) AS nx, any_value(b.n) AS ny
          FROM f a JOIN f b ON a.gram = b.gram AND a.k < b.k AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
    d AS (SELECT doc_id, len(grams) AS n, CASE WHEN len(grams) > 0 THEN hash(list_sort(grams)) END AS k FROM s),
    e AS (SELECT x, y FROM p WHERE 100 * shared >= 90 * (nx + ny - shared) UNION ALL SELECT y, x FROM p WHERE 100 * shared >= 90 * (nx + ny - shared)),
    r(k, root) AS (SELECT k, k FROM g UNION SELECT r.k, e.y FROM r JOIN e ON e.x = r.root),
    c AS (SELECT r.k, min(d.doc_id) AS component_id FROM r JOIN d ON d.k = r.root GROUP BY r.k)
    SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id FROM d LEFT JOIN c ON c.k = d.k
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(_table(spark, sf_dir, "documents"))


@query("op5_decontaminate")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("op6_html_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


@query("op7_sharding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=24)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_lm_ctw")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_ctw.score_documents(_table(spark, sf_dir, "documents"))


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), vocabulary=49_408, end_id=2)


_BASE32 = """array_to_string(list_transform(range(0, 32), lambda c:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(sha1, (c // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (c % 4))) & 31) + 1 AS BIGINT), 1)), '')"""


@query(
    "op10_warc",
    f"""
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS sha1, sha256(payload) AS digest FROM p),
    o AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS owner FROM d)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
           CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN owner <> page_id THEN owner END AS refers_to
    FROM o
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


@query(
    "op11_importance_resampling",
    r"""
    WITH t AS (
        SELECT list(v ORDER BY i) AS tbl FROM (
            SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
    w AS (
        SELECT 'd' AS side, row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
        UNION ALL
        SELECT 'b', 0, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
    f AS (
        SELECT side, doc, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) || list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS feature FROM w),
    n AS (SELECT side, doc, feature, count(*) AS n FROM f GROUP BY ALL),
    b AS (
        SELECT feature, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(feature)), '..'), lambda x: CAST('0x' || x AS BIGINT)),
               lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT feature FROM n), t),
    c AS (SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM n JOIN b USING (feature) GROUP BY bucket),
    g AS (
        SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (sum(coalesce(s, 0)) OVER () + 10000.0::DOUBLE)
               / ((coalesce(s, 0) + 1.0::DOUBLE) * (sum(coalesce(t, 0)) OVER () + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM c),
    u AS (SELECT doc, sum(n * gain) AS weight FROM n JOIN b USING (feature) JOIN g USING (bucket) WHERE side = 'd' GROUP BY doc),
    h AS (
        SELECT doc, doc_id, len(ws) AS words, len(ws) + greatest(len(ws) - 1, 0) + greatest(len(ws) - 2, 0) AS n_features,
               CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) AS h FROM w WHERE side = 'd'),
    z AS (
        SELECT doc_id, words, CAST(n_features AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
               CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM h LEFT JOIN u USING (doc)),
    r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (words >= 20) OVER () AS n FROM z)
    SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM r
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query(
    "op12_source_divergence",
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    o AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
    l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
    q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)::HUGEINT) // (total + 5 * v)::HUGEINT AS q FROM kept JOIN l USING (lang)),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
    w AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    s AS (SELECT lang, source, sum(n) AS total, count(*) AS v FROM w GROUP BY lang, source),
    p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)::HUGEINT) // (total + 5 * v)::HUGEINT AS p FROM w JOIN s USING (lang, source)),
    pairs AS (
        SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) f
        ON f.lang = a.lang AND f.source = a.source AND f.other = b.source),
    more AS (SELECT p.lang, p.source, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
    every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM more),
    r AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
    SELECT * FROM r WHERE part = 'pair' OR rank <= 50
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def _distinct_hits(terms: tuple[str, ...]) -> str:
    return f"len(list_filter({list(terms)}, lambda t: regexp_matches(u, '(^|[^a-z0-9])' || t || '($|[^a-z0-9])')))"


@query(
    "op13_url_filter",
    rf"""
    WITH p AS (
        SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
               CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (
        SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
    r AS (
        SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
               CAST({_distinct_hits(url_filter.STRICT)} AS INTEGER) AS strict_hits, CAST({_distinct_hits(url_filter.SOFT)} AS INTEGER) AS soft_hits FROM h)
    SELECT page_id, host, path, rule, strict_hits, soft_hits,
           CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                WHEN strict_hits >= 1 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END AS verdict
    FROM r
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))
