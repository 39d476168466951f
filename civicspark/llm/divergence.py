"""Audit of how the sources of a language differ in their words.

Each source has a smoothed share of every kept term of its language. How far two sources lie apart is
summed over all kept terms, but only terms that they have are ever looked at: a source's histogram of
counts prices its terms as if the other source had none of them, a join of the sparse postings on the
term corrects what both have, and terms that neither has cost a constant each.

    sum |p - q| = A(p, q0) + A(q, p0) + (V - |P| - |Q|) |p0 - q0|
                  + sum over both of |p - q| - |p - q0| - |p0 - q| + |p0 - q0|

with A(p, q0) the sum of |p - q0| over the terms of P, and p0, q0 the shares of a term that isn't there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, stored, text_bytes, word_pieces

#: Documents in which a term is kept; what is added to each count; the whole of a share; terms that a report lists.
LEAST_DOCS, SMOOTHING, WHOLE, TOP = 30, 5, 1_000_000_000, 50
#: Terms that a task counts before it sends them on.
GATHER = 1 << 20

#: Bytes of terms as they count (a-z, all beyond ASCII; A-Z lowered); others part terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_COUNTS_DDL = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each group's terms, and a row without a term for each group, as far as a task has gathered them."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in seen.items():
            terms = [None, *n]
            data = {"lang": pa.array([lang] * len(terms)), "source": pa.array([source] * len(terms)), "term": pa.array([t and t.decode() for t in terms], pa.string())}
            whole = batch(data | {"n": [0, *n.values()], "docs": [0, *map(docs.__getitem__, n)]}, _COUNTS)
            for lo in range(0, len(terms), 1 << 16):
                yield whole.slice(lo, 1 << 16)

    for b in batches:
        for lo in range(0, b.num_rows, 512):
            for lang, source, text in zip(*(c.to_pylist() for c in b.slice(lo, 512).columns), strict=True):
                size += (lang, source) not in seen
                n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
                found, before = Counter(), len(n)
                for piece in word_pieces(text, _TERM_BYTES):
                    found.update(piece)
                n.update(found)
                docs.update(found.keys())
                size += len(n) - before
                if size >= GATHER:
                    yield from out()
                    seen, size = {}, 0
    yield from out()


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 and the whole part of WHOLE times the smoothed share of a count; null without kept terms. Decimals, since WHOLE times a count can pass 64 bits."""
    decimal = lambda c: c.cast("decimal(20,0)")
    parts = F.lit(WHOLE).cast("decimal(10,0)") * (decimal(n) + SMOOTHING)
    whole = F.call_function("div", parts, F.nullif(decimal(total) + SMOOTHING * decimal(terms), F.lit(0).cast("decimal(20,0)")))
    return F.when(terms > 0, whole.cast("long") + 1)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: how far each source lies from the others of its language (part pair)
    and which terms it has more of than its language (part term).

    Nulls in lang, source and text are empty; every row counts as a document, repeated ones too; a source
    without terms is compared like others; a language without kept terms has pairs of value 0; a language of
    one source has no pairs. An empty table gives no rows. Other columns are ignored.
    """
    named = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = docs.select(named(lang, "lang"), named(source, "source"), text_bytes(text).alias("text"))
    counts = rows.mapInArrow(_count, _COUNTS_DDL).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = stored(counts, "divergence-counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= least_docs).drop("docs")
    kept = stored(kept, "divergence-terms")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("total"))
    postings = counts.drop("docs").where("term is not null").join(kept, ["lang", "term"])

    # A row for each group, with the share of a term that it lacks.
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count("*").alias("held"))
    groups = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["own", "held", "terms", "total"])
    groups = stored(groups.withColumn("none", F.coalesce(share(F.lit(0), F.col("own"), F.col("terms")), F.lit(0))), "divergence-groups")
    postings = postings.join(groups, ["lang", "source"])
    postings = postings.select("lang", "source", "term", "n", share(F.col("n"), F.col("own"), F.col("terms")).alias("p"), share(F.col("all"), F.col("total"), F.col("terms")).alias("q"), "none")
    postings = stored(postings, "divergence-postings")

    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top)
    pairs = pair_values(groups, postings).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value").withColumn("rank", F.row_number().over(ordered))
    return pairs.unionByName(terms)


def pair_values(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, source, other, value for every two sources of a language. groups: lang, source, held, terms, none; postings: lang, source, term, n, p, none."""
    apart = lambda a, b: F.abs(F.col(a) - F.col(b))
    second = groups.select("lang", F.col("source").alias("other"), F.col("held").alias("held2"), F.col("none").alias("none2"))
    pairs = groups.select("lang", "source", "held", "terms", "none").join(second, "lang").where("source <> other")

    # Each source's own terms against the share that the other gives a term it lacks.
    bars = postings.groupBy("lang", "source", "n").agg(F.first("p").alias("p"), F.count("*").alias("times"))
    one_sided = pairs.select("lang", "source", "other", "none2").join(bars, ["lang", "source"]).groupBy("lang", "source", "other").agg(F.sum(F.col("times") * apart("p", "none2")).alias("cost"))

    # Terms that both have.
    a = postings.select("lang", "term", "source", "p", "none")
    b = postings.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("p2"), F.col("none").alias("none2"))
    over = apart("p", "p2") - apart("p", "none2") - apart("none", "p2") + apart("none", "none2")
    both = a.join(b, ["lang", "term"]).where("source < other").groupBy("lang", "source", "other").agg(F.sum(over).alias("cost"))
    both = both.unionByName(both.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "cost"))

    neither = (F.col("terms") - F.col("held") - F.col("held2")) * apart("none", "none2")
    parts = [pairs.select("lang", "source", "other", neither.alias("cost")), one_sided, one_sided.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "cost"), both]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("lang", "source", "other").agg(F.sum("cost").cast("long").alias("value"))
