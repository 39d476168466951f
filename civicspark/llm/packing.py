"""Packing into optimal length buckets.

Dynamic programming over the global length histogram finds the bucket boundaries that minimise
padding; inside a bucket every document is padded to the boundary and batches are filled up to the
token budget. The histogram has a row for each distinct length: lengths are positive, so there are
at most sqrt(2 * all tokens) of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, gapless_rank, stored


def word_tokens(text: str = "text") -> Column:
    """Words of a text and one end; null counts as empty."""
    return (F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)) + 1).cast("long")


def optimal_boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most that many buckets with the least padding over (length, count) rows.

    cost(i, j) = length_j * (rows in i..j) - (tokens in i..j) makes each layer a lower envelope of
    lines, found with a monotone hull in one pass.
    """
    hist = sorted((n, c) for n, c in histogram if c)
    if not hist:
        return []
    lengths, rows, tokens = [n for n, _ in hist], [0], [0]
    for n, c in hist:
        rows.append(rows[-1] + c)
        tokens.append(tokens[-1] + n * c)
    best = [None, *(lengths[j - 1] * rows[j] - tokens[j] for j in range(1, len(hist) + 1))]
    cuts: list[list[int]] = [[0] * (len(hist) + 1)]
    for _ in range(1, min(buckets, len(hist))):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, index
        layer, cut, at = [None], [0], 0
        for j in range(1, len(hist) + 1):
            i = j - 1
            if i and best[i] is not None:
                line = (-rows[i], best[i] + tokens[i], i)
                while len(hull) >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
            if not hull:
                layer.append(None)
                cut.append(0)
                continue
            x = lengths[j - 1]
            at = min(at, len(hull) - 1)
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            layer.append(hull[at][0] * x + hull[at][1] + x * rows[j] - tokens[j])
            cut.append(hull[at][2])
        best = layer
        cuts.append(cut)
    bounds, j = [], len(hist)
    for cut in reversed(cuts):
        bounds.append(lengths[j - 1])
        j = cut[j]
    return bounds[::-1]


def pack_documents(docs: DataFrame, length: Column | None = None, buckets: int = 16, token_budget: int = 65_536, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens, batch (in its bucket), place (in its batch), padding.

    A batch holds max(1, token_budget // bucket_tokens) documents, so only one longer than the budget
    exceeds it, alone. Null or empty texts count one token; repeated rows are packed each; an empty
    table gives no rows. Other columns are ignored.
    """
    n = word_tokens() if length is None else length
    sized = stored(docs.select(F.col(doc_id).alias("doc_id"), n.alias("n_tokens")), "packing-lengths")
    histogram = [tuple(r) for r in sized.groupBy("n_tokens").count().collect()]  # at most sqrt(2 * all tokens) rows
    rows, bounds = sum(c for _, c in histogram), optimal_boundaries(histogram, buckets)
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(0).cast("long"))
    bucket = F.size(F.filter(edges, lambda b: b < F.col("n_tokens")))
    bucketed = sized.withColumn("bucket", bucket).withColumn("bucket_tokens", F.element_at(edges, F.col("bucket") + 1))
    ranked = gapless_rank(bucketed, "bucket", ["doc_id", "n_tokens"], "rank", rows)
    capacity = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.col("bucket_tokens")))
    return ranked.select(
        "doc_id", "n_tokens", "bucket", "bucket_tokens",
        F.floor(F.col("rank") / capacity).cast("long").alias("batch"),
        (F.col("rank") % capacity).cast("long").alias("place"),
        (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
    )
