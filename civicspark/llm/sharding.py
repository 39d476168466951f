"""Sharding by longest-processing-time scheduling.

Groups of equal texts stay together. Each goes, largest first, to the least-loaded shard, found
with a heap. The heap holds a bounded number of items at any input size: groups above a share of
the total are items of their own (their number is bounded by the inverse of that share), smaller
ones are put whole into bundles by the hash of their text. Bundles shrink geometrically, so the
last items that the heap places are about as small as one document and level the loads.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, stored, text_bytes

#: A group is an item of its own from total / (shards * GROUPS_PER_SHARD) bytes.
GROUPS_PER_SHARD = 256
#: Bundles of each level; a level takes half of the hash space that is left, the last takes the rest.
BUNDLES, LEVELS = 512, 12


def lpt(sizes: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Longest first to the least-loaded shard; ties go by key and by shard number."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for key, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def _bundle():
    """Level and bundle from the digest: level l holds 2^-(l+1) of the hash space."""
    h = F.xxhash64("digest")
    top = F.shiftrightunsigned(h, 64 - (LEVELS - 1))
    level = F.lit(LEVELS - 1) - F.length(F.regexp_replace(F.bin(top), "^0$", ""))
    return F.concat_ws("-", level, F.pmod(h, F.lit(BUNDLES)))


def shard_documents(docs: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 8), text_crc32, shard, slot (gapless from 0 in its shard).

    A null text is an empty one and groups with it. Copies, repeated rows and rows with a null id
    all get a slot of their own; an empty table gives no rows. Other columns are ignored.
    """
    raw = text_bytes(text)
    base = stored(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("digest")), "shard-base")
    rows, total = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    own = max(1, total // (shards * GROUPS_PER_SHARD))
    groups = base.groupBy("digest").agg(F.sum("size").alias("bytes"))
    large = groups.where(F.col("bytes") >= own).select(F.hex("digest").alias("key"), "bytes")
    bundles = groups.where(F.col("bytes") < own).groupBy(_bundle().alias("key")).agg(F.sum("bytes").alias("bytes"))
    placed = lpt([(r.key, r.bytes) for r in large.unionByName(bundles).collect()], shards)
    spark = docs.sparkSession
    where = spark.createDataFrame(list(placed.items()) or [("", 0)], "key string, place int")  # bounded: see above
    one = F.broadcast(where.select(F.unhex("key").alias("digest"), "place").where(F.length("key") == 64))
    many = F.broadcast(where.select(F.col("key").alias("bundle"), F.col("place").alias("bundle_place")).where(F.length("key") < 64))
    sharded = (
        base.join(one, "digest", "left")
        .withColumn("bundle", _bundle())
        .join(many, "bundle", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("place", "bundle_place").alias("shard"))
    )
    return gapless_rank(sharded, "shard", ["doc_id", "text_crc32", "size"], "slot", rows)
