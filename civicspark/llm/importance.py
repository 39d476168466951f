"""Importance resampling towards a target distribution of hashed word n-grams.

A partition's text passes in blocks through a word trie: the path of a node is a run of one to NGRAM
words, and the node holds the run's count and the CRC-32 state after its bytes, from which the states
of its children go on, so that a run's bytes are never put together. Levels of the trie are arrays: a
node is a number, and its parent and last word are its key. Counts fall into hash buckets by the
states, bucket totals of all partitions are merged, and the log ratio of target and corpus gives each
bucket its gain. In a second pass the nodes of each block's trie carry gains, and a document's weight
is the sum along the paths of its words. Gumbel noise of the document's id on top of the weight makes
the highest scores a draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, stored, text_bytes, word_pieces

#: Longest runs, hash buckets, and what is added to each bucket's count.
NGRAM, BUCKETS = 3, 10_000
#: Shortest documents that are drawn from, in words; the share that is drawn, in hundredths; the noise's seed.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Bytes of text in one trie, and words whose numbers a task remembers.
BLOCK, VOCABULARY = 1 << 20, 1 << 17
#: Longest word, with the space before it, by whose length states move on all at once.
LONGEST = 64

#: Bytes of words as they count (0-9, a-z, all beyond ASCII; A-Z lowered); others part words.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class _Numbers(dict):
    """Words numbered in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _moves(longest: int) -> np.ndarray:
    """What each byte of a CRC-32 state becomes when so many zero bytes follow. States are linear in this sense: the state
    after two texts is the first one's, moved on by the second one's length, xor the second one's."""
    one = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.int64)
    out = [np.arange(256, dtype=np.int64) << 8 * np.arange(4)[:, None]]
    for _ in range(longest):
        out.append(one[out[-1] & 255] ^ (out[-1] >> 8))
    return np.array(out)


@dataclass
class Trie:
    """Nodes of each level, and for each word of the block the node of each level whose run it ends (-1: none that is counted)."""

    states: list[np.ndarray]
    ends: list[np.ndarray]

    def counts(self) -> list[np.ndarray]:
        return [np.bincount(at[at >= 0], minlength=len(s)) for s, at in zip(self.states, self.ends, strict=True)]


class TrieBuilder:
    """Tries of one block after another; the words' numbers and states go on between blocks, up to VOCABULARY words."""

    def __init__(self):
        self.moves = _moves(LONGEST)
        self._forget()

    def _forget(self) -> None:
        self.words, self.names = _Numbers(), []
        self.alone = self.after = self.lengths = np.zeros(0, np.int64)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > VOCABULARY:
            self._forget()
        ids = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if len(self.words) > len(self.names):
            new = list(self.words)[len(self.names) :]
            spaced = [b" " + w for w in new]
            self.names += spaced
            grown = lambda old, values: np.concatenate((old, np.fromiter(values, np.int64, len(new))))
            # A word's state at a run's beginning, and as the end of a longer one.
            self.alone, self.after, self.lengths = grown(self.alone, map(zlib.crc32, new)), grown(self.after, map(zlib.crc32, spaced)), grown(self.lengths, map(len, spaced))
        return ids

    def _go_on(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The states after a space and a word."""
        length = self.lengths[words]
        many = np.minimum(length, LONGEST)
        out = self.after[words]
        for k in range(4):
            out ^= self.moves[many, k, (states >> 8 * k) & 255]
        for i in np.flatnonzero(length > LONGEST).tolist():
            out[i] = zlib.crc32(self.names[words[i]], int(states[i]))
        return out

    def build(self, words: list[bytes], owner: np.ndarray, fresh: np.ndarray) -> Trie:
        """owner: the text of each word; fresh: False for words that only lead to others, their own runs being counted before."""
        ids = self._numbers(words)
        level, nodes = pd.factorize(ids)
        level = level.astype(np.int64)
        states = self.alone[nodes]
        found = Trie([states], [np.where(fresh, level, -1)])
        here = np.ones(len(ids), bool)
        for _ in range(2, NGRAM + 1):
            # The parent ends at the word before, in the same text.
            before, parent = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)
            before[1:] = here[:-1] & (owner[1:] == owner[:-1])
            parent[1:] = level[:-1]
            at = np.flatnonzero(before)
            number, keys = pd.factorize((parent[at] << 32) | ids[at])
            states = self._go_on(states[keys >> 32], keys & 0xFFFFFFFF)
            level = np.full(len(ids), -1, np.int64)
            level[at] = number
            here = before
            found.states.append(states)
            found.ends.append(np.where(fresh, level, -1))
        return found


def _segments(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text in pieces of about BLOCK bytes, and how many words at a piece's beginning only lead to others."""
    lead: list[bytes] = []
    for piece in word_pieces(text, _WORD_BYTES, BLOCK):
        yield lead + piece, len(lead)
        lead = (lead + piece)[-(NGRAM - 1) :]


@dataclass
class _Held:
    """Pieces of texts that wait for their trie."""

    words: list[bytes]
    sizes: list[int]
    leads: list[int]
    texts: list[int]
    size: int = 0

    def trie(self, builder: TrieBuilder) -> tuple[Trie, np.ndarray]:
        sizes = np.array(self.sizes, np.int64)
        piece = np.repeat(np.arange(len(sizes)), sizes)
        begin = np.cumsum(sizes) - sizes
        fresh = np.arange(len(piece)) - begin[piece] >= np.array(self.leads, np.int64)[piece]
        return builder.build(self.words, piece, fresh), np.array(self.texts, np.int64)[piece]


def _blocks(texts: Iterator[bytes]) -> Iterator[tuple[_Held, int]]:
    """Pieces of about BLOCK bytes together, in order, and how many texts have ended by then."""
    held, n = _Held([], [], [], []), 0
    for n, text in enumerate(texts, 1):
        for words, lead in _segments(text):
            held.words += words
            held.sizes.append(len(words))
            held.leads.append(lead)
            held.texts.append(n - 1)
            held.size += len(text) if len(text) <= BLOCK else BLOCK
            if held.size >= BLOCK:
                yield held, n - 1
                held = _Held([], [], [], [])
    yield held, n


_COUNTS = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket that the partition met."""
    total, builder = np.zeros(BUCKETS, np.int64), TrieBuilder()
    for held, _ in _blocks(t for b in batches for lo in range(0, b.num_rows, 512) for t in b.slice(lo, 512).column(0).to_pylist()):
        trie, _ = held.trie(builder)
        for states, counts in zip(trie.states, trie.counts(), strict=True):
            np.add.at(total, states % BUCKETS, counts)
    found = np.flatnonzero(total)
    yield batch({"bucket": found.astype(np.int32), "n": total[found]}, _COUNTS)


def bucket_counts(table: DataFrame, text: str = "text") -> np.ndarray:
    """How many runs of words of all rows fall into each bucket. What comes to the driver is a row for each bucket."""
    counts = table.select(text_bytes(text).alias("text")).mapInArrow(_bucket_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in counts.collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of the target's smoothed share of each bucket to the corpus's, rounded down."""
    big, small = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * big / ((float(s) + 1) * small))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


_WEIGHTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
_WEIGHTS_DDL = "doc_id long, n_words long, n_features long, weight long"


def _weigher(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder, ids = TrieBuilder(), []
        sums = np.zeros((3, 0), np.int64)  # words, features and weight of the texts from `first` on
        first = 0

        def texts() -> Iterator[bytes]:
            for b in batches:
                for lo in range(0, b.num_rows, 512):
                    part = b.slice(lo, 512)
                    some = part.column(0).to_pylist()
                    for doc_id, text in zip(some, part.column(1).to_pylist(), strict=True):
                        ids.append(doc_id)
                        yield text

        for held, ended in _blocks(texts()):
            trie, owner = held.trie(builder)
            count = len(ids)
            sums = np.pad(sums, ((0, 0), (0, count - sums.shape[1])))
            for level, (states, at) in enumerate(zip(trie.states, trie.ends, strict=True)):
                on = at >= 0
                text, value = owner[on] - first, gain[states % BUCKETS][at[on]]
                runs = np.bincount(text, minlength=count)
                sums[0] += runs if not level else 0
                sums[1] += runs
                np.add.at(sums[2], text, value)
            done = ended - first
            if done:
                yield batch({"doc_id": pa.array(ids[:done], pa.int64()), "n_words": sums[0, :done], "n_features": sums[1, :done], "weight": sums[2, :done]}, _WEIGHTS)
                # The numbers of texts in `held` go on counting from the partition's beginning.
                del ids[:done]
                sums, first = sums[:, done:], ended
        assert not ids

    return run


def weigh(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    return rows.mapInArrow(_weigher(gain), _WEIGHTS_DDL)


def noise(doc_id: str | Column = "doc_id", seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the SHA-256 of seed and id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """scored with rank (1, 2, 3 ... by falling score, ties by doc_id, nulls last) of the highest percent hundredths of the eligible rows; else null.

    The rows are sorted over many tasks, each of which numbers its own; a row for each task gives it its first number.
    """
    spark = scored.sparkSession
    rows = scored.withColumn("__in", eligible)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.where("__in").repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    task, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = sorted(dealt.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    firsts, n = [], 0
    for r in counts:
        firsts.append((r.task, n))
        n += r.n
    before = F.broadcast(spark.createDataFrame(firsts, "__task long, __first long"))
    rank = F.col("__first") + place + 1
    numbered = dealt.join(before, task == F.col("__task")).withColumn("rank", F.when(rank <= percent * n // 100, rank))
    names = [*scored.columns, "rank"]
    return numbered.select(names).unionByName(rows.where("not __in").withColumn("rank", F.lit(None).cast("long")).select(names))


def resample(docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs.

    A null or empty text has no words, no features and the weight 0. Repeated rows count and are drawn
    each; a row with a null id has the noise of the id `null` and comes after others of its score. Without
    rows in docs there are none; without target texts every bucket's gain is what the corpus alone gives.
    Other columns are ignored.
    """
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    scored = weigh(docs, gain, doc_id, text).withColumn("score", F.col("weight") + noise(seed=seed))
    scored = stored(scored, "importance")
    return ranked(scored, F.col("n_words") >= least_words, percent)
