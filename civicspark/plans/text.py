"""Text and retrieval queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..io import table
from ..operators import vector_index, vectors
from ..registry import query


@query("congress_from_year", "SELECT o_orderkey, CAST((year(o_orderdate) - 1789) // 2 + 1 AS INTEGER) AS congress, CAST(CASE WHEN year(o_orderdate) % 2 = 1 THEN 1 ELSE 2 END AS INTEGER) AS session FROM orders")
def congress_from_year(spark, d):
    year = F.year("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", t.congress_of(year).alias("congress"), F.when(year % 2 == 1, 1).otherwise(2).alias("session"))


@query("fingerprint_key", "SELECT o_orderkey, left(sha1(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority), 12) AS fingerprint FROM orders")
def fingerprint_key(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.left(F.sha1(F.concat_ws("|", "o_orderkey", "o_orderstatus", "o_orderpriority")), F.lit(12)).alias("fingerprint"))


@query("chunk_words_500_50", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
    c AS (SELECT doc_id, words, unnest(range(0, len(words), 450)) AS start FROM w)
    SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(least(500, len(words) - start) AS INTEGER) AS n_words, md5(array_to_string(words[start + 1 : start + 500], ' ')) AS digest FROM c""")
def chunk_words_500_50(spark, d):
    split = table(spark, d, "documents").select("doc_id", t.words(F.coalesce("text", F.lit(""))).alias("words")).withColumn("n", F.size("words"))
    cut = F.transform(t.chunk_starts(F.col("n"), 500, 50), lambda s: F.struct(s.alias("start"), F.slice("words", s + 1, F.lit(500)).alias("w")))
    chunks = split.select("doc_id", F.explode_outer(cut).alias("c")).where("c is not null")
    return chunks.select("doc_id", "c.start", F.size("c.w").alias("n_words"), F.md5(F.array_join("c.w", " ")).alias("digest"))


@query("transcript_segments", """WITH s AS (SELECT *, sum(CASE WHEN role IN ('user', 'system') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS seg FROM conversations)
    SELECT conv_id, CAST(seg AS BIGINT) AS seg, min(turn) AS first_turn, count(*) AS turns, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM s WHERE role NOT IN ('user', 'system') GROUP BY conv_id, seg""")
def transcript_segments(spark, d):
    """Rows below each marker row; markers aren't of their segment, and segments without rows aren't there."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = table(spark, d, "conversations").withColumn("seg", F.sum(F.col("role").isin("user", "system").cast("int")).over(w))
    return marked.where(~F.col("role").isin("user", "system")).groupBy("conv_id", "seg").agg(F.min("turn").alias("first_turn"), F.count("*").alias("turns"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


_TOPK = """WITH q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT query, e.vec_id, floor(list_cosine_similarity(x, CAST(e.embedding AS DOUBLE[])) * 10000 + 0.5) / 10000 AS similarity FROM q JOIN embeddings e ON e.vec_id <> query)
    SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 8"""


@query("vector_topk", _TOPK)
def vector_topk(spark, d):
    """The eight nearest vectors of each query: a stated query set against all rows."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(e, e.where("vec_id % 20 = 0"))


@query("vector_index_topk", _TOPK)
def vector_index_topk(spark, d):
    """The same out of an inverted file: the nearest lists first, then the others that could hold a nearer row."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return vector_index.search(vector_index.fit(e), e.where("vec_id % 20 = 0"), exact=True)


@query("vector_topk_filtered", """WITH q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT query, e.vec_id, floor(list_cosine_similarity(x, CAST(e.embedding AS DOUBLE[])) * 10000 + 0.5) / 10000 AS similarity FROM q JOIN embeddings e ON e.vec_id <> query AND e.label IN (1, 2, 3))
    SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def vector_topk_filtered(spark, d):
    """The five nearest vectors of some labels: the filter comes before the search."""
    e = table(spark, d, "embeddings")
    return vectors.nearest(e.where(F.col("label").isin(1, 2, 3)).select("vec_id", "embedding"), e.where("vec_id % 20 = 0").select("vec_id", "embedding"), k=5)


@query("quote_evidence_missing", "SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(b.text, '\\s+', ' ', 'g'))))")
def quote_evidence_missing(spark, d):
    """Quotes that stand in no document, white space aside."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"[ \t\n\f\r]+", " "))
    docs = table(spark, d, "documents").select(flat("text").alias("doc")).where("doc is not null")
    quotes = table(spark, d, "benchmark").select("item_id", flat("text").alias("quote"))
    parts = quotes.where("quote is not null").select("quote").distinct().withColumn("words", F.split("quote", " "))
    # What stands inside a quote stands as whole words in a document that has it: of these words, the rarest leads
    # to the candidates, found without carrying their text. Hashes only name rows; the texts themselves are compared.
    inner = parts.where("size(words) > 2").select("quote", F.explode(F.array_distinct(F.expr("slice(words, 2, size(words) - 2)"))).alias("word"))
    heads = docs.select(F.xxhash64("doc").alias("at"), F.explode(F.array_distinct(F.split("doc", " "))).alias("word")).join(inner.select("word").distinct(), "word", "left_semi")
    common = heads.groupBy("word").agg(F.count("*").alias("docs"))
    keys = inner.join(common, "word", "left").groupBy("quote").agg(F.min_by("word", F.struct(F.coalesce("docs", F.lit(0)), "word")).alias("word"))
    pairs = heads.join(keys.select("word", F.xxhash64("quote").alias("of")), "word").select("at", "of").distinct()
    long = pairs.join(keys.select(F.xxhash64("quote").alias("of"), "quote"), "of").join(docs.withColumn("at", F.xxhash64("doc")), "at").where(F.col("doc").contains(F.col("quote")))
    # One or two words may lie inside other words, and no words lie in every text: these few meet every document.
    short = docs.join(F.broadcast(parts.where("size(words) <= 2").select("quote")), F.col("doc").contains(F.col("quote")))
    found = long.select("quote").unionByName(short.select("quote")).distinct()
    return quotes.join(found, "quote", "left_anti").select("item_id")
