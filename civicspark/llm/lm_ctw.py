"""Language-model scoring by context-tree weighting.

The model is a tree of byte contexts up to DEPTH bytes. Each byte is eight binary decisions; at every
context and decision a Krichevsky-Trofimov estimate is kept, and a context mixes its own estimate
with that of its longer contexts by their weighted probabilities of the training text. A decision
that a longer context never met is left to the shorter one.

What is scored is the text as its tokens: words with A-Z lowered, joined by one space, and an end.
For comparison the smoothed unigram score of the same tokens stands beside it.

Documents are gathered in blocks of at most BLOCK bytes. A block sends its distinct words (by 64-bit
hash) and byte strings of DEPTH + 1 on with their training counts, and gets back the global count of
each word that other blocks learned from too, and the model's log probability of each string; so what
moves grows with distinct strings, not with positions, and no task holds more of the model than one
block or one range of contexts needs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, forget, held_out, stored, text_bytes

DEPTH = 5
#: Bytes of a block, and of the part of it whose positions are looked up at once.
BLOCK, CHUNK = 32 << 20, 1 << 20
#: A byte that UTF-8 never has: stands before each text and ends it. And what no word is.
EDGE, END = b"\xff", b"\xff"
_CODEC = "zstd"

_PACKS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("text", pa.binary())])
_PACKS_DDL = "block long, doc_ids array<long>, held array<boolean>, sizes array<long>, text binary"


def normalised(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
    ids, held, texts, size, n = [], [], [], 0, 0

    def out() -> pa.RecordBatch:
        text = pa.compress(b"".join(texts), _CODEC, asbytes=True)
        return batch({"block": [first + n], "doc_ids": [ids], "held": [held], "sizes": [[len(t) for t in texts]], "text": [text]}, _PACKS)

    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            for doc_id, h, t in zip(*(c.to_pylist() for c in part.columns), strict=True):
                t = normalised(t)
                ids.append(doc_id)
                held.append(h)
                texts.append(t)
                size += len(t)
                if size >= BLOCK:
                    yield out()
                    ids, held, texts, size, n = [], [], [], 0, n + 1
    if texts:
        yield out()


def _texts(row: dict) -> list[bytes]:
    sizes = row["sizes"]
    data = pa.decompress(row["text"], sum(sizes), _CODEC, asbytes=True) if sizes else b""
    ends = np.cumsum(sizes).tolist()
    return [data[e - s : e] for s, e in zip(sizes, ends, strict=True)]


def _strings(texts: list[bytes]) -> np.ndarray:
    """The string of DEPTH + 1 bytes of every position, a text's bytes and then its end. Nearest context byte highest, the byte itself lowest."""
    buffer = np.frombuffer(b"".join([EDGE * DEPTH + t + EDGE for t in texts]), np.uint8)
    n = len(buffer) - DEPTH
    keys = buffer[DEPTH - 1 : DEPTH - 1 + n].astype(np.int64)
    for i in (*range(DEPTH - 2, -1, -1), DEPTH):
        keys <<= 8
        keys |= buffer[i : i + n]
    between = np.cumsum([len(t) + DEPTH + 1 for t in texts])[:-1, None] + np.arange(-DEPTH, 0)  # what stands before the next text
    own = np.ones(n, bool)
    own[between.ravel()] = False
    return keys[own]


def _chunks(texts: list[bytes]) -> Iterator[slice]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t) + DEPTH + 1
        if size >= CHUNK:
            yield slice(lo, i + 1)
            lo, size = i + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))


_KEYS = pa.schema([("block", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])


def _pieces(block: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(keys), 1 << 16):
        part = keys[lo : lo + (1 << 16)]
        yield batch({"block": np.full(len(part), block), "key": part, "n": n[lo : lo + (1 << 16)]}, _KEYS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return [distinct], [np.bincount(inverse, np.concatenate(counts), len(distinct))]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct strings of a block and how often those that are learned from have each."""
    for row in _rows(batches):
        texts, held = _texts(row), row["held"]
        keys, counts = [], []
        for c in _chunks(texts):
            marked = _strings(texts[c])
            marked <<= 1
            marked |= np.repeat(np.logical_not(held[c]), [len(t) + 1 for t in texts[c]])
            marked.sort()
            string = marked >> 1
            first = np.flatnonzero(np.concatenate(([True], string[1:] != string[:-1])))
            keys.append(string[first])
            marked &= 1
            counts.append(np.add.reduceat(marked, first))
            del marked, string, first
            if len(keys) > 4:  # what a block holds grows with its distinct strings, not with its chunks
                keys, counts = _summed(keys, counts)
        if keys:
            (keys,), (counts,) = _summed(keys, counts)
            yield from _pieces(row["block"], keys, counts.astype(np.int64))


#: For a byte at a place of a word, the product of these; a word's hash is their sum modulo 2^64. Longer words have their xxHash.
_LONGEST = 256
_OF_BYTE, _OF_PLACE = (np.random.default_rng(i).integers(0, 1 << 64, n, np.uint64) | np.uint64(1) for i, n in ((8, 256), (9, _LONGEST + 1)))
_OF_BYTE[32] = 0  # the space that ends a word


def _word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a text whose words end in one space each."""
    buffer = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(buffer == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(buffer), dtype=np.int32)
    place -= np.repeat(starts.astype(np.int32), ends - starts + 1)
    np.minimum(place, _LONGEST, out=place)
    parts = _OF_PLACE[place]
    del place
    parts *= _OF_BYTE[buffer]
    hashes = np.add.reduceat(parts, starts)
    for i in np.flatnonzero(ends - starts > _LONGEST).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(text[starts[i] : ends[i]])
    return hashes.view(np.int64)


def _learned(texts: list[bytes], held: list[bool]) -> dict[bytes, int]:
    """The distinct tokens of a block and how often those that are learned from have each."""
    counts = Counter()  # the only dictionary of a block: a second one of its words would cost as much as its text
    for t, h in zip(texts, held, strict=True):
        if h:
            for word in (*t.split(), END):
                counts.setdefault(word, 0)
        else:
            counts.update(t.split())
            counts[END] += 1
    return counts


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        texts, held = _texts(row), row["held"]
        keys, counts = [], []
        for c in _chunks(texts):
            words = _learned(texts[c], held[c])
            keys.append(_word_hashes(b" ".join(words) + b" "))
            counts.append(np.fromiter(words.values(), np.int64, len(words)))
            if len(keys) > 4:
                keys, counts = _summed(keys, counts)
        if keys:
            (keys,), (counts,) = _summed(keys, counts)
            yield from _pieces(row["block"], keys, counts.astype(np.int64))


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """The hash of every token of the texts, and how many each text has."""
    return _word_hashes(b"".join([b" ".join((*((t,) if t else ()), END, b"")) for t in texts])), [t.count(b" ") + 1 + bool(t) for t in texts]


def _own_counts(texts: list[bytes], held: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """As _learned, by hash: the hashes in order and their counts."""
    keys, counts = [], []
    for c in _chunks(texts):
        tokens, n = _tokens(texts[c])
        distinct, inverse = np.unique(tokens, return_inverse=True)
        keys.append(distinct)
        counts.append(np.bincount(inverse[np.repeat(np.logical_not(held[c]), n)], minlength=len(distinct)))
        if len(keys) > 4:
            keys, counts = _summed(keys, counts)
    (keys,), (counts,) = _summed(keys, counts)
    return keys, counts


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after steps up to 8."""
    x, shift = x.copy(), np.zeros(len(x))
    while (low := x < 8).any():
        shift[low] -= np.log(x[low])
        x[low] += 1
    r = 1 / (x * x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r / 1260)) / x


def _kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - np.log(np.pi) - _log_gamma(n0 + n1 + 1.0)


def _weigh(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of a context, and the share of its own estimate in it."""
    weighted = np.logaddexp(own, children) - np.log(2)
    return weighted, np.exp(own - np.log(2) - weighted)


def _bits(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight decisions: the bits decided before (with a leading one), the bit."""
    x = keys & 255
    for j in range(8):
        yield (1 << j) | (x >> (8 - j)), (x >> (7 - j)) & 1


def _climb(keys: np.ndarray, counts: np.ndarray, node: np.ndarray, bit: np.ndarray) -> tuple:
    """From the longest contexts to those of two bytes: for each string the mixed probability of its
    bit and whether the context of two bytes met the decision; the contexts of two bytes."""
    context, below = keys >> 8, None
    p = seen = None
    for d in range(DEPTH, 1, -1):
        at, inverse = np.unique(((context >> (8 * (DEPTH - d))) << 8) | node, return_inverse=True)
        n1 = np.bincount(inverse, counts * bit, len(at))
        n0 = np.bincount(inverse, counts, len(at)) - n1
        own = _kt(n0, n1)
        mine = (np.where(bit == 1, n1[inverse], n0[inverse]) + 0.5) / ((n0 + n1)[inverse] + 1)
        if below is None:
            weighted, p = own, mine
        else:
            parent = np.zeros(len(below[1]), np.int64)
            parent[below[0]] = inverse
            weighted, share = _weigh(own, np.bincount(parent, below[1], len(at)))
            p = np.where(seen, share[inverse] * mine + (1 - share[inverse]) * p, mine)
        seen = (n0 + n1)[inverse] > 0
        below = inverse, weighted
    return p, seen, at, n0, n1, weighted


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray] | None:
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    return tuple(np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1))


_TOPS = pa.schema([("c1", pa.int32()), ("node", pa.int32()), ("n0", pa.float64()), ("n1", pa.float64()), ("children", pa.float64())])


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range of contexts, what contexts of one byte add up."""
    got = _whole(batches)
    if got is None:
        return
    for node, bit in _bits(got[0]):
        _, _, at, n0, n1, weighted = _climb(*got, node, bit)
        key, inverse = np.unique(((at >> 16) << 8) | (at & 255), return_inverse=True)
        sums = (np.bincount(inverse, x, len(key)) for x in (n0, n1, weighted))
        yield batch(dict(zip(_TOPS.names, [(key >> 8).astype(np.int32), (key & 255).astype(np.int32), *sums], strict=True)), _TOPS)


class _Top:
    """The contexts of one byte and of none: 256 * 255 decisions at most."""

    def __init__(self, rows: list):
        n = np.zeros((2, 256, 256))
        children = np.zeros((256, 256))
        for r in rows:
            n[0, r.c1, r.node], n[1, r.c1, r.node], children[r.c1, r.node] = r.n0, r.n1, r.children
        one, share1 = _weigh(_kt(n[0].ravel(), n[1].ravel()), children.ravel())
        none = n.sum(axis=1)
        _, self.share0 = _weigh(_kt(none[0], none[1]), one.reshape(256, 256).sum(axis=0))
        self.share1 = share1.reshape(256, 256)
        self.p1, self.seen1 = (n + 0.5) / (n.sum(axis=0) + 1), n.sum(axis=0) > 0
        self.p0 = (none + 0.5) / (none.sum(axis=0) + 1)

    def mix(self, c1: np.ndarray, node: np.ndarray, bit: np.ndarray, p: np.ndarray, seen: np.ndarray) -> np.ndarray:
        share, own = self.share1[c1, node], self.p1[bit, c1, node]
        p = np.where(seen, share * own + (1 - share) * p, own)
        share, own = self.share0[node], self.p0[bit, node]
        return np.where(self.seen1[c1, node], share * own + (1 - share) * p, own)


_LOGS = pa.schema([("key", pa.int64()), ("logp", pa.float64())])


def _log_probabilities(top: _Top):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _whole(batches)
        if got is None:
            return
        keys = got[0]
        logp, c1 = np.zeros(len(keys)), keys >> (8 * DEPTH)
        for node, bit in _bits(keys):
            p, seen, *_ = _climb(*got, node, bit)
            logp += np.log10(top.mix(c1, node, bit, p, seen))
        for lo in range(0, len(keys), 1 << 16):
            yield batch({"key": keys[lo : lo + (1 << 16)], "logp": logp[lo : lo + (1 << 16)]}, _LOGS)

    return run


_SCORES = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
    ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("bits_per_byte", pa.float64()),
])
_SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def _places(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key stands in the sorted known ones, which hold them all; in order, a search stays near the one before."""
    order = np.argsort(keys)
    at = np.empty(len(keys), np.int32)
    at[order] = np.searchsorted(known, keys[order])
    return at


def _scorer(tokens: int, distinct: int):
    total = np.log10(tokens + 0.1 * (distinct + 1))

    def score(packs: pa.Table, model: pa.Table) -> pa.Table:
        out = []
        kind, keys, values = (model.column(c).to_numpy() for c in ("kind", "key", "value"))
        strings, shared, counts = keys[kind == 1], keys[kind == 0], values[kind == 0]
        order = np.argsort(strings)
        strings, logs = strings[order], values[kind == 1][order]
        del kind, keys, values, model, order
        for row in _rows(packs.to_batches()):
            texts, held = _texts(row), row["held"]
            if not texts:
                continue
            words, c = _own_counts(texts, held)
            c[np.searchsorted(words, shared)] = counts
            known, c = c > 0, np.log10(c + 0.1)
            for part in _chunks(texts):
                logp = logs[_places(strings, _strings(texts[part]))]
                tokens_in, n_tokens = _tokens(texts[part])
                at = _places(words, tokens_in)
                s = k = 0
                for doc_id, h, t, m in zip(row["doc_ids"][part], held[part], texts[part], n_tokens, strict=True):
                    n, mine = len(t) + 1, at[k : k + m]
                    code = float(logp[s : s + n].sum())
                    out.append((doc_id, h, m, int(known[mine].sum()), tokens, float(c[mine].sum() - m * total), code, n, -code / np.log10(2) / n))
                    s, k = s + n, k + m
                del logp, tokens_in, at
        return pa.Table.from_batches([batch(dict(zip(_SCORES.names, zip(*out, strict=True) if out else [[]] * len(_SCORES), strict=True)), _SCORES)])

    return score


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Learned from the rows that aren't held out; every row is scored whole. A null text is an empty
    one and has its end alone; repeated rows count and are scored each; a row with a null id is
    learned from; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id, modulus, 0).alias("held"), text_bytes(text).alias("text"))
    packs = stored(rows.mapInArrow(_pack, _PACKS_DDL), "ctw-packs")
    by_word = Window.partitionBy("key")
    texts = packs.select("block", "held", "sizes", "text")
    words = texts.mapInArrow(_word_counts, "block long, key long, n long")
    words = words.withColumn("c", F.sum("n").over(by_word)).withColumn("first", F.row_number().over(by_word.orderBy("block")) == 1)
    words = stored(words.where(F.col("first") | (F.col("c") != F.col("n"))), "ctw-words")
    once = F.when(F.col("first"), F.col("c"))
    tokens, distinct = words.agg(F.coalesce(F.sum(once), F.lit(0)), F.count(F.when(once > 0, True))).first()
    grams = texts.mapInArrow(_grams, "block long, key long, n long")
    counts = stored(grams.groupBy("key").agg(F.sum("n").alias("n")), "ctw-counts")
    ranged = counts.repartition(F.shiftright("key", 8 * (DEPTH - 1)))  # by the two nearest context bytes
    tops = ranged.mapInArrow(_tops, "c1 int, node int, n0 double, n1 double, children double").groupBy("c1", "node").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "children")))
    top = _Top(tops.collect())  # 256 * 255 rows at most
    logs = stored(ranged.mapInArrow(_log_probabilities(top), "key long, logp double"), "ctw-logs")
    forget(counts)
    back = words.where(F.col("c") != F.col("n")).select("block", F.lit(0).alias("kind"), "key", F.col("c").cast("double").alias("value"))
    back = back.unionByName(grams.select("block", "key").join(logs, "key").select("block", F.lit(1).alias("kind"), "key", F.col("logp").alias("value")))
    return packs.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_scorer(tokens, distinct), _SCORES_DDL)
