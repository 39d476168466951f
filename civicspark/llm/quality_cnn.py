"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over the whole document, and their responses are
max-pooled over overlapping chunks of CHUNK bytes. The strongest and the mean response of each
filter over the chunks, combined by a logistic layer, give one probability.

It is trained on the driver on a bounded sample of labelled documents (MAX_DOCS of at most
MAX_DOC_BYTES each); every document is scored whole, in tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, held_out, text_bytes

#: The bound of the training sample: documents, and bytes of each.
MAX_DOCS, MAX_DOC_BYTES = 3000, 1 << 15
EMBED, FILTER, STRIDE, FILTERS = 6, 8, 2, 24
#: A chunk is two successive halves, so each byte stands in two chunks.
HALF = 256
CHUNK = 2 * HALF
EPOCHS, BATCH, RATE, DECAY = 12, 16, 0.01, 1e-5
#: Places of a half from which a filter reaches beyond it; in a text's last half these would see the next text.
OVER = (HALF - FILTER) // STRIDE + 1
#: Bytes that one pass of the scorer takes.
PASS = 1 << 20


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # FILTER * EMBED x FILTERS
    bias: np.ndarray
    weights: np.ndarray  # 2 * FILTERS
    offset: np.ndarray  # 1

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.weights, self.offset]


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer, each text followed by zeros up to whole halves; halves of each text."""
    halves = np.array([-(-(len(t) + FILTER) // HALF) for t in texts])
    return np.frombuffer(b"".join(t.ljust(n * HALF, b"\0") for t, n in zip(texts, halves, strict=True)) + bytes(FILTER), np.uint8), halves


def _windows(net: Network, buffer: np.ndarray) -> np.ndarray:
    """The embedded bytes under the filter at each of its places (a view)."""
    e = net.embed[buffer]
    places = (len(buffer) - FILTER) // STRIDE
    return np.lib.stride_tricks.as_strided(e, (places, FILTER * EMBED), (STRIDE * EMBED * e.itemsize, e.itemsize))


def _pooled(half: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk responses (the larger of two successive halves), the chunks' first halves, chunks of each text."""
    ends = np.cumsum(halves)
    last = np.zeros(len(half), bool)
    last[ends - 1] = True
    second = np.minimum(np.arange(len(half)) + 1, len(half) - 1)
    alone = halves == 1
    first = np.flatnonzero(~last | np.repeat(alone, halves))
    second = np.where(last[first], first, second[first])
    return np.maximum(half[first], half[second]), np.stack([first, second]), np.maximum(1, halves - 1)


def _probability(net: Network, top: np.ndarray, mean: np.ndarray) -> np.ndarray:
    z = np.concatenate([top, mean], axis=1) @ net.weights + net.offset
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(net: Network, texts: list[bytes]) -> np.ndarray:
    """The probability of each text, whole."""
    if not texts:
        return np.zeros(0)
    out, lo = [], 0
    while lo < len(texts):
        hi, held = lo, 0
        while hi < len(texts) and (held == 0 or held + len(texts[hi]) <= PASS):
            held += len(texts[hi]) + HALF
            hi += 1
        buffer, halves = _padded(texts[lo:hi])
        total, per = int(halves.sum()), HALF // STRIDE
        last = np.zeros(total, bool)
        last[np.cumsum(halves) - 1] = True
        half = np.empty((total, FILTERS), np.float32)
        step = 64
        for a in range(0, total, step):
            z = min(total, a + step)
            windows = _windows(net, buffer[a * HALF : z * HALF + FILTER])
            found = (windows @ net.filters).reshape(z - a, per, FILTERS)
            found[last[a:z], OVER:] = -np.inf
            half[a:z] = found.max(axis=1)
        half = np.maximum(half + net.bias, 0)
        chunks, _, counts = _pooled(half, halves)
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        out.append(_probability(net, np.maximum.reduceat(chunks, starts), np.add.reduceat(chunks, starts) / counts[:, None]))
        lo = hi
    return np.concatenate(out)


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    buffer, halves = _padded(texts)
    windows = _windows(net, buffer)
    total, per = int(halves.sum()), HALF // STRIDE
    response = (windows @ net.filters).reshape(total, per, FILTERS)
    response[np.cumsum(halves) - 1, OVER:] = -np.inf
    place = response.argmax(axis=1)
    raw = np.take_along_axis(response, place[:, None], 1)[:, 0] + net.bias
    half = np.maximum(raw, 0)
    chunks, sides, counts = _pooled(half, halves)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    owner = np.repeat(np.arange(len(texts)), counts)
    top, mean = np.maximum.reduceat(chunks, starts), np.add.reduceat(chunks, starts) / counts[:, None]
    p = _probability(net, top, mean)
    d = ((p - labels) / len(texts)).astype(np.float32)
    features = np.concatenate([top, mean], axis=1)
    d_weights, d_offset = features.T @ d, d.sum(keepdims=True)
    d_top, d_mean = d[:, None] * net.weights[:FILTERS], d[:, None] * net.weights[FILTERS:]
    is_top = chunks == top[owner]
    ties = np.add.reduceat(is_top, starts).astype(np.float32)
    d_chunk = is_top * (d_top / ties)[owner] + (d_mean / counts[:, None])[owner]
    d_half = np.zeros_like(half)
    pick = np.where(half[sides[0]] >= half[sides[1]], sides[0][:, None], sides[1][:, None])
    columns = np.broadcast_to(np.arange(FILTERS), pick.shape)
    np.add.at(d_half, (pick, columns), d_chunk)
    d_half *= raw > 0
    at = place + (np.arange(total) * per)[:, None]
    d_filters, d_embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
    for f in range(FILTERS):
        live = np.flatnonzero(d_half[:, f])
        where, g = at[live, f], d_half[live, f]
        d_filters[:, f] = g @ windows[where]
        through = (g[:, None] * net.filters[:, f]).reshape(-1, EMBED)
        np.add.at(d_embed, buffer[(where[:, None] * STRIDE + np.arange(FILTER)).ravel()], through)
    return [d_embed, d_filters, d_half.sum(axis=0), d_weights, d_offset]


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Network:
    """Adam on the logistic loss. Without rows of both classes the prior alone is learned."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    net = Network(rng.normal(0, 0.5, (256, EMBED)).astype(f32), rng.normal(0, (FILTER * EMBED) ** -0.5, (FILTER * EMBED, FILTERS)).astype(f32), np.zeros(FILTERS, f32), np.zeros(2 * FILTERS, f32), np.zeros(1, f32))
    prior = (labels.sum() + 1) / (len(labels) + 2)
    net.offset[:] = np.log(prior / (1 - prior))
    if len(set(labels.tolist())) < 2:
        return net
    net.weights[:] = rng.normal(0, 0.1, 2 * FILTERS)
    params = net.parameters()
    m, v, t = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params], 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            t += 1
            for x, g, a, b in zip(params, _gradients(net, [texts[i] for i in some], labels[some]), m, v, strict=True):
                g = g + DECAY * x
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                x -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(f32)
    return net


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_DOC_BYTES, label: str = "quality") -> Network:
    """Trains on at most max_docs labelled documents of at most max_bytes: those of the folds that are
    learned from with the smallest hashes of their id. A document with two labels counts with the lower."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id", 3, 1))
        .groupBy("doc_id").agg(F.min(label).alias("__label"))
        .join(docs.where(F.octet_length("text") <= max_bytes).select("doc_id"), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    )
    rows = docs.where(F.octet_length("text") <= max_bytes).select("doc_id", text_bytes().alias("text")).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").limit(max_docs).collect()
    return train([bytes(r.text) for r in rows], np.array([float(r["__label"]) for r in rows]))


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def _scorer(net: Network) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                p = score(net, part.column(2).to_pylist()).astype(np.float64)
                yield batch({"doc_id": part.column(0), "held_out": part.column(1), "score": p, "predicted": (p >= 0.5).astype(np.int32)}, _SCORES)

    return run


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    A null text is an empty one, and an empty one has a score; repeated rows have equal scores; a
    null id is kept and not held out; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 3, 1).alias("held_out"), text_bytes().alias("text"))
    return rows.mapInArrow(_scorer(net), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, net: Network, least: float = 0.5) -> DataFrame:
    """The rows whose score is at least that, with all their columns.

    A null text is an empty one, and an empty one has a score; repeated rows and rows with a null id are judged each; an
    empty table gives no rows; other columns stay, whatever their names.
    """
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                texts = [(t or "").encode() for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(score(net, texts) >= least))

    return docs.mapInArrow(keep, docs.schema)
