"""Benchmark decontamination with DataFrame functions alone.

Documents are looked at through windows as long as a benchmark item. A window can be similar to an
item only if it holds one of the items' shingles, so windows are laid where such a shingle would
stand in its item; no window that could be similar is left out. Each window's 64-bit SimHash meets
those of the items of its length by multi-index hashing: fingerprints within RADIUS bits agree in one
of RADIUS + 1 blocks at least. Pairs within the radius are verified by exact weighted Jaccard
similarity of their shingles, a shingle weighing its count times its rarity among the items.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

NGRAM, SIMILARITY, RADIUS = 5, 0.8, 15
#: Distinct shingles of the items up to which they are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 2_000_000


def _word_hashes(text: Column) -> Column:
    """Hashes of the lower-case runs of letters and digits."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _shingles(hashes: Column, n: int) -> Column:
    at = F.sequence(F.lit(0), F.size(hashes) - n)
    grams = F.transform(at, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(n))))
    return F.when(F.size(hashes) >= n, grams).otherwise(F.array().cast("array<long>"))


def _weighted(df: DataFrame, key: list[str], rarity: DataFrame, most: float, small: bool) -> DataFrame:
    """key, features (array of h, w): each distinct shingle with its count times its rarity."""
    rows = df.select(*key, F.explode("grams").alias("h")).groupBy(*key, "h").agg(F.count("*").alias("tf"))
    rows = rows.join(F.broadcast(rarity) if small else rarity, "h", "left")
    rows = rows.select(*key, F.struct("h", (F.col("tf") * F.coalesce("rare", F.lit(most))).alias("w")).alias("f"))
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list("f")).alias("features"))


def _simhash(features: Column) -> Column:
    def side(b: Column) -> Column:
        return F.aggregate(features, F.lit(0.0), lambda a, f: a + F.when(_bit(f["h"], b), f["w"]).otherwise(-f["w"]))

    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(side(b) > 0, _power(b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _power(b: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), b)


def _bit(h: Column, b: Column) -> Column:
    return h.bitwiseAND(_power(b)) != 0


def _blocks(fingerprint: Column, radius: int) -> Column:
    """The fingerprint cut into radius + 1 blocks, each with its number."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    cut = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (z - a)) - 1).cast("long")).alias("bits")) for i, (a, z) in enumerate(zip(edges, edges[1:], strict=False))]
    return F.array(*cut)


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, ngram: int = NGRAM, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, start (word of the best window), distance (bits): a row for each
    document and item with a window at least that similar.

    Words are lower-case runs of letters and digits; items of fewer than ngram words have their whole
    sequence as one shingle, items without words are in no document. Null texts have no words; rows
    with a null id are left out; repeated rows count once; a document shorter than an item is looked
    at whole. Empty tables give no rows. Other columns are ignored.
    """
    item = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), _word_hashes(F.col(item_text)).alias("hashes"))
    item = stored(item.select("item_id", "hashes", F.size("hashes").alias("m")).where("m > 0").distinct(), "items")
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sizes = sorted(r[0] for r in item.select(F.least("m", F.lit(ngram))).distinct().collect())  # at most ngram rows
    if not sizes:
        out = docs.limit(0).select(F.col(doc_id).alias("doc_id")).join(items.limit(0).select(F.col(item_id).alias("item_id")), F.lit(False), "inner")
        return out.select("doc_id", "item_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("start"), F.lit(0).alias("distance"))
    found = [_contaminated(rows, item.where(F.least("m", F.lit(ngram)) == n), n, similarity, radius) for n in sizes]
    return reduce(DataFrame.unionByName, found)


def _contaminated(rows: DataFrame, item: DataFrame, n: int, similarity: float, radius: int) -> DataFrame:
    item = item.select("item_id", "m", _shingles(F.col("hashes"), n).alias("grams"))
    places = stored(item.select("item_id", "m", F.posexplode("grams").alias("offset", "h")), "item-shingles")
    n_items = max(1, item.count())
    most = math.log1p(n_items)
    rarity = places.groupBy("h").agg(F.log1p(n_items / F.countDistinct("item_id")).alias("rare"))
    small = rarity.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)

    # Where the items' shingles stand in the documents.
    seen = rows.select("doc_id", F.xxhash64("text").alias("copy"), _word_hashes(F.col("text")).alias("hashes"))
    seen = seen.select("doc_id", "copy", _shingles(F.col("hashes"), n).alias("grams")).withColumn("length", F.size("grams"))
    # The array itself isn't carried on. The outer form keeps Spark from deriving a filter that shingles again for each word.
    seeds = seen.select("doc_id", "copy", "length", F.posexplode_outer("grams").alias("at", "h"))
    seeds = stored(seeds.join(hint(places.select("h").distinct()), "h", "left_semi"), "seeds")

    # Windows of the items' lengths there, inside their document.
    spots = places.select("h", (F.col("m") - n + 1).alias("grams_in_item"), "m", "offset").distinct()
    start = F.greatest(F.lit(0), F.least(F.col("at") - F.col("offset"), F.col("length") - F.col("grams_in_item")))
    windows = seeds.join(hint(spots), "h").select("doc_id", "copy", "m", "grams_in_item", start.alias("start")).distinct()
    by_doc = windows.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("m", "grams_in_item", "start")).alias("windows"))
    held = rows.select("doc_id", "text", F.xxhash64("text").alias("copy")).join(by_doc, ["doc_id", "copy"])
    held = held.select("doc_id", "windows", _word_hashes(F.col("text")).alias("hashes"))
    held = held.select("doc_id", "windows", _shingles(F.col("hashes"), n).alias("all"))
    cut_out = F.transform("windows", lambda w: F.struct(w["m"].alias("m"), w["start"].alias("start"), F.slice("all", w["start"] + 1, w["grams_in_item"]).alias("grams")))
    held = held.select("doc_id", F.explode_outer(cut_out).alias("w")).select("doc_id", "w.*")
    held = held.withColumn("content", F.sha2(F.array_join(F.transform("grams", lambda h: h.cast("string")), ","), 256))
    held = stored(held, "windows")

    # Equal windows are compared once.
    distinct = held.groupBy("m", "content").agg(F.first("grams").alias("grams"))
    window = _weighted(distinct, ["m", "content"], rarity, most, small).withColumn("print", _simhash(F.col("features")))
    window = stored(window, "window-prints")
    target = _weighted(item, ["m", "item_id"], rarity, most, small).withColumn("print", _simhash(F.col("features")))
    target = stored(target.select("m", "item_id", F.col("features").alias("item_features"), F.col("print").alias("item_print")), "item-prints")
    cut = window.select("m", "content", "print", F.explode(_blocks(F.col("print"), radius)).alias("b")).select("m", "content", "print", "b.*")
    item_cut = target.select("m", "item_id", "item_print", F.explode(_blocks(F.col("item_print"), radius)).alias("b")).select("m", "item_id", "item_print", "b.*")
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    close = cut.join(item_cut, ["m", "block", "bits"]).where(distance <= radius).select("m", "content", "item_id", distance.alias("distance")).distinct()

    # Exact similarity of what lies within the radius.
    weights = F.map_from_entries("item_features")
    held_by_item = lambda f: F.coalesce(F.try_element_at(F.col("weights"), f["h"]), F.lit(0.0))
    shared = F.aggregate("features", F.lit(0.0), lambda a, f: a + F.least(f["w"], held_by_item(f)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, f: a + f["w"])
    both = close.join(window.drop("print"), ["m", "content"]).join(target.drop("item_print"), ["m", "item_id"]).withColumn("weights", weights)
    both = both.select("m", "content", "item_id", "distance", shared.alias("shared"), (total("features") + total("item_features")).alias("sum"))
    alike = both.select("m", "content", "item_id", "distance", (F.col("shared") / (F.col("sum") - F.col("shared"))).alias("similarity")).where(F.col("similarity") >= similarity)
    hits = held.select("doc_id", "m", "start", "content").join(alike, ["m", "content"])
    best = F.max_by(F.struct("similarity", "start", "distance"), F.struct("similarity", -F.col("start")))
    return hits.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.similarity", "b.start", "b.distance")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, with all their columns, that no benchmark item is in.

    Rows with a null id or text stay; of rows that repeat an id all go if an item is in one of their texts; repeated rows
    stay or go together; an empty table gives no rows.
    """
    bad = stored(contaminated(docs, items).select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    return docs.join(bad, F.col("doc_id") == F.col("__bad"), "left_anti")
