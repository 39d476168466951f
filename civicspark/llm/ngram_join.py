"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its distinct word shingles. Sets are banded by size so that linked sets
lie in one band or in neighbours; for each band the sets' Hamming distance is at most k. The
feature domain is cut into n1 parts of which, by the pigeonhole, one holds at most one difference,
and each part into SUB cells, of which then all but one agree: each choice of SUB - 1 cells of a
part is a signature, and linked sets share one at least. Sets that share a signature are candidates.

A cell without elements says nothing, and all sets of a band would meet in it. Each set of a band
therefore gets a few parts more than the pigeonhole needs; a set with no more empty signatures than
that leaves them out, since one of its other parts still has to agree.

Equal texts go to one task and are signed once. Sets that share a signature are first compared with
the smallest node among them; what that leaves in different components is compared across
components, so that no link between components is lost and a group of n copies costs n comparisons.
A signature that many sets of one task share is dealt with in that task, and of signatures that the same
sets share one is looked at.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, forget, stored, text_bytes
from .components import components

#: Cells of a part; one may differ.
SUB = 3
#: Shingles that a task gathers before it signs their sets; sets that share one to call it hot.
GATHER, HOT = 1 << 19, 64
#: Empty signatures expected of a set below which it gets no further parts.
RARE = 0.02
#: Words whose hashes a Python worker remembers.
CACHE_WORDS = 1 << 18

_words: dict[bytes, int] = {}


@dataclass(frozen=True)
class Similarity:
    """Words in a shingle; links need den * intersection >= num * union."""

    ngram: int = 3
    num: int = 90
    den: int = 100

    def bands(self, most: int) -> np.ndarray:
        """The largest size of each band, up to one that holds most and the next."""
        out, low = [], 1
        while len(out) < 2 or out[-2] < most:
            out.append(low * self.den // self.num)
            low = out[-1] + 1
        return np.array(out, np.int64)

    def distance(self, size: np.ndarray) -> np.ndarray:
        """The largest Hamming distance of linked sets of at most that size."""
        return 2 * size * (self.den - self.num) // (self.den + self.num)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(words: list[bytes]) -> list[int]:
    found = list(map(_words.get, words))
    if None in found:
        new = dict.fromkeys(w for w, h in zip(words, found, strict=True) if h is None)
        if len(_words) + len(new) > CACHE_WORDS:
            _words.clear()
        _words.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        found = [xxhash.xxh3_64_intdigest(w) if h is None else h for w, h in zip(words, found, strict=True)]
    return found


def shingle_sets(texts: list[bytes], ngram: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ngram make one shingle."""
    out = []
    for text in texts:
        words = text.lower().split()  # of bytes: only A-Z change, only ASCII white space parts
        if not words:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.array(_hash_words(words), np.uint64)
        n = min(ngram, len(words))
        s = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
        out.append(np.unique(s))
    return out


def signatures(sets: list[np.ndarray], how: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets (none empty) and the place of the set that each is of.

    Linked sets differ in at most k elements, so at least parts - k // 2 parts hold at most one difference,
    and in each of these both sets have the signature that leaves out the cell of the difference. With `more`
    parts beyond the k // 2 + 1 that are needed, more + 1 parts agree so. A set with empty signatures in at most
    `more` parts has one among these without; it is found there, whether its partner keeps its empty ones or not.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    if not len(sizes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    most = how.bands(int(sizes.max()))
    band = np.searchsorted(most, sizes)
    sigs, owners = [], []
    for tag in (band, band + 1):
        k = how.distance(most[tag])
        base = k // 2 + 1
        least = np.where(tag > 1, most[np.maximum(tag - 2, 0)], 0) + 1  # the smallest set that comes with this tag
        empties = np.where(k > 0, SUB * base * np.exp(-(SUB - 1) / SUB * least / base), 0.0)
        more = np.where(empties < RARE, 0, np.ceil(empties + 2 * np.sqrt(empties))).astype(np.int64)
        parts = base + more
        first = np.concatenate(([0], np.cumsum(parts)[:-1]))
        salt = _mix(tag.astype(np.uint64) + np.uint64(1))
        spread = _mix(flat ^ salt[owner])
        cell = first[owner] * SUB + ((spread >> np.uint64(32)) * (parts * SUB).astype(np.uint64)[owner] >> np.uint64(32)).astype(np.int64)
        total = int(parts.sum())
        value = _mix(spread)
        low = np.bincount(cell, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), total * SUB).astype(np.uint64)
        high = np.bincount(cell, (value >> np.uint64(32)).astype(np.float64), total * SUB).astype(np.uint64)
        cells = (low + (high << np.uint64(32))).reshape(total, SUB)
        held = np.bincount(cell, minlength=total * SUB).reshape(total, SUB)
        whole = cells.sum(axis=1, dtype=np.uint64)[:, None]
        doc = np.repeat(np.arange(len(sets)), parts)
        part = np.arange(total) - first[doc]
        exact = (k == 0)[doc]
        left = np.where(exact[:, None], whole, whole - cells)
        name = _mix(salt[doc] + part.astype(np.uint64))[:, None] + np.arange(SUB, dtype=np.uint64)
        found = _mix(left + _mix(name))
        keep = ~exact[:, None] | (np.arange(SUB) == 0)
        empty = (held.sum(axis=1)[:, None] == held) & ~exact[:, None]
        few = np.bincount(doc, empty.any(axis=1), len(sets)) <= more
        keep &= ~(empty & few[doc][:, None])
        sigs.append(found[keep])
        owners.append(np.broadcast_to(doc[:, None], found.shape)[keep])
    return np.concatenate(sigs), np.concatenate(owners)


#: Bits of a signature as it travels. Sets whose signatures meet by chance are ruled out like other candidates.
SIGNATURE_BITS = 48
#: Bytes of text for each partition of the signatures, and the cells that a partition holds one after another.
BYTES_PER_PARTITION, CELLS = 1 << 25, 4
#: Words of 64 bits in a set's parity map, and elements from which a set has a finer one beside it.
PARITY, FINE = 8, 512
#: Sets compared with their leader by one task at a time.
CHUNK = 512


def _planes(x: np.ndarray) -> bytes:
    """The values above their least one, byte plane by byte plane, as many planes as they need."""
    least = x.min() if len(x) else np.uint64(0)
    rest = (x - least).astype("<u8")
    width = max(1, (int(rest.max()).bit_length() + 7) // 8) if len(x) else 1
    return struct.pack("<QB", int(least), width) + rest.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _values(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    least, width = struct.unpack_from("<QB", data, at)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 9).reshape(width, n).T
    return out.view("<u8")[:, 0] + np.uint64(least), at + 9 + n * width


def pack(h: np.ndarray, *columns: np.ndarray) -> bytes:
    """Rows sorted by their signature h as bytes: h as differences, the other columns as offsets."""
    return struct.pack("<QI", int(h[0]), len(h)) + _planes(np.diff(h)) + b"".join(_planes(c.astype(np.int64).view(np.uint64)) for c in columns)


def unpack(data: bytes, columns: int) -> list[np.ndarray]:
    first, n = struct.unpack_from("<QI", data)
    steps, at = _values(data, 12, n - 1)
    out = [np.concatenate(([np.uint64(first)], np.uint64(first) + np.cumsum(steps, dtype=np.uint64))).view(np.int64)]
    for _ in range(columns):
        x, at = _values(data, at, n)
        out.append(x.view(np.int64))
    return out


def parity(sets: list[np.ndarray], cells: int = 64 * PARITY) -> np.ndarray:
    """A bit for each of that many cells of the domain, as 64-bit words: whether the set has an odd number of elements there.

    Two maps differ in at most as many bits as the sets differ in elements.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cell = (np.concatenate(sets) >> np.uint64(17)) % np.uint64(cells) if len(sets) else np.zeros(0, np.uint64)
    counts = np.bincount(owner * cells + cell.astype(np.int64), minlength=len(sets) * cells)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64).reshape(len(sets), cells // 64)


def fine_parity(s: np.ndarray) -> np.ndarray | None:
    """The parity map of a large set over the power of two of cells that is at least its size."""
    return parity([s], 1 << int(len(s) - 1).bit_length())[0] if len(s) > FINE else None


#: What travels. A document: its node, its id, the smallest node among equal sets of its task, its set's size and maps (for
#: one of equal sets). Signatures of a cell (sigs: h, node), and of sets of one task that many of them share (groups: h, node, lead).
_SENT = pa.schema([("cell", pa.int32()), ("id", pa.int64()), ("doc_id", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("parity", pa.list_(pa.int64())), ("fine", pa.list_(pa.int64())), ("sigs", pa.binary()), ("groups", pa.binary())])
_SENT_DDL = "cell int, id long, doc_id long, rep long, n long, parity array<long>, fine array<long>, sigs binary, groups binary"
#: Documents as above (h null), and members of signatures that several sets share: lead is the smallest.
_LIVE = pa.schema([*(_SENT.field(c) for c in ("id", "doc_id", "rep", "n", "parity", "fine")), ("h", pa.int64()), ("lead", pa.int64())])
_LIVE_DDL = "id long, doc_id long, rep long, n long, parity array<long>, fine array<long>, h long, lead long"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Texts go to Python this many rows at a time while a join runs, so that long texts don't fill what Arrow holds outside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "1024")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _rows(schema: pa.Schema, count: int, /, **columns: object) -> pa.RecordBatch:
    """A batch of so many rows with nulls in the columns that aren't given."""
    return batch({f.name: columns.get(f.name, pa.nulls(count, f.type)) for f in schema}, schema)


def _signer(how: Similarity, cells: int):
    def flush(docs: list[tuple[int | None, int | None, np.ndarray]], at: int, signed: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        reps: dict[bytes, tuple[int, np.ndarray]] = {}
        keys = []
        for node, _, s in docs:
            key = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if node is not None and len(s) else None
            keys.append(key)
            if key is not None and key not in signed and (key not in reps or node < reps[key][0]):
                reps[key] = node, s
        signed.update((k, node) for k, (node, _) in reps.items())
        owner = [d[0] if k is None else signed[k] for d, k in zip(docs, keys, strict=True)]
        for lo in range(0, len(docs), 1024):
            part, own = docs[lo : lo + 1024], owner[lo : lo + 1024]
            mapped = [d[0] is not None and d[0] == o and len(d[2]) > 0 for d, o in zip(part, own, strict=True)]
            coarse = iter(parity([d[2] for d, m in zip(part, mapped, strict=True) if m]))
            yield _rows(
                _SENT, len(part), cell=pa.array([at % cells] * len(part), pa.int32()), id=[d[0] for d in part], doc_id=[d[1] for d in part], rep=own, n=[len(d[2]) for d in part],
                parity=[next(coarse) if m else None for m in mapped], fine=[fine_parity(d[2]) if m else None for d, m in zip(part, mapped, strict=True)],
            )
        unique = sorted(reps.values(), key=lambda x: x[0])
        if not unique:
            return
        ids = np.array([i for i, _ in unique], np.int64)
        sig, place = signatures([s for _, s in unique], how)
        sig = sig >> np.uint64(64 - SIGNATURE_BITS)
        order = np.lexsort((place, sig))  # places follow ids
        sig, node = sig[order], ids[place[order]]
        start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        count = np.diff(np.append(start, len(sig)))
        hot = np.repeat(count >= HOT, count)
        if hot.any():
            groups = sig[hot], node[hot], np.repeat(node[start], count)[hot]
            for lo in range(0, len(groups[0]), 1 << 16):
                yield _rows(_SENT, 1, cell=[at % cells], groups=[pack(*(g[lo : lo + (1 << 16)] for g in groups))])
        alone = ~hot
        alone[start] = True  # of a hot signature only the smallest node goes on
        sig, node = sig[alone], node[alone]
        cell = (sig * np.uint64(cells) >> np.uint64(SIGNATURE_BITS)).astype(np.int32)
        edge = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            yield _rows(_SENT, 1, cell=cell[lo : lo + 1], sigs=[pack(sig[lo:hi], node[lo:hi])])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple[int | None, int | None, np.ndarray]] = []
        signed: dict[bytes, int] = {}  # a node for each set that this task has signed
        size, at = 0, 7919 * TaskContext.get().partitionId() if TaskContext.get() else 0
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                nodes, ids, texts = (c.to_pylist() for c in b.slice(lo, 512).columns)
                sets = shingle_sets(texts, how.ngram)
                held += zip(nodes, ids, sets, strict=True)
                size += sum(map(len, sets))
                if size >= GATHER:
                    at += 1
                    yield from flush(held, at, signed)
                    held, size = [], 0
        if held:
            yield from flush(held, at + 1, signed)
        _words.clear()  # the worker may live on without this step

    return sign


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell: signatures with one set go, members of the others learn the smallest."""
    cell, held = None, []

    def shared(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        h, i = (np.concatenate(x) for x in zip(*(unpack(data, 1) for data in held), strict=True))
        order = np.lexsort((i, h))
        h, i = h[order], i[order]
        one = np.append(True, (h[1:] != h[:-1]) | (i[1:] != i[:-1]))
        h, i = h[one], i[one]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        count = np.diff(np.append(start, len(h)))
        live, lead = np.repeat(count > 1, count), np.repeat(i[start], count)
        h, i, lead = h[live], i[live], lead[live]
        for lo in range(0, len(h), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            yield _rows(_LIVE, len(h[part]), id=i[part], h=h[part], lead=lead[part])

    for b in batches:
        docs = b.filter(pc.is_valid(b["n"]))
        if docs.num_rows:
            yield _rows(_LIVE, docs.num_rows, **{c: docs[c] for c in ("id", "doc_id", "rep", "n", "parity", "fine")})
        for data in b["groups"].drop_null().to_pylist():
            h, i, lead = unpack(data, 2)
            yield _rows(_LIVE, len(h), id=i, h=h, lead=lead)
        sent = b.filter(pc.is_valid(b["sigs"]))
        for c, data in zip(sent["cell"].to_pylist(), sent["sigs"].to_pylist(), strict=True):
            if c != cell and held:
                yield from shared(held)
                held = []
            cell = c
            held.append(data)
    if held:
        yield from shared(held)


_PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _bits_apart(a: Column, b: Column) -> Column:
    """Differing bits of two finer maps; where one has twice the cells, its halves are put together first. 0 where one isn't there."""
    xor = lambda x, y: x.bitwiseXOR(y)
    folded = lambda m: F.zip_with(F.slice(m, F.lit(1), (F.size(m) / 2).cast("int")), F.slice(m, (F.size(m) / 2).cast("int") + 1, (F.size(m) / 2).cast("int")), xor)
    apart = lambda x, y: F.aggregate(F.zip_with(x, y, xor), F.lit(0), lambda n, w: n + F.bit_count(w))
    same = F.when(F.size(a) == F.size(b), apart(a, b)).when(F.size(a) == 2 * F.size(b), apart(folded(a), b)).when(F.size(b) == 2 * F.size(a), apart(a, folded(b)))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(same, F.lit(0))).otherwise(0)


def _may_link(how: Similarity, a: str, b: str) -> Column:
    """False only if the sizes or parity maps (columns n, p, f with these endings) show that the sets differ in too many elements."""
    na, nb, pa_, pb, fa, fb = (F.col(x + y) for x in "npf" for y in (a, b))
    apart = sum((F.bit_count(F.get(pa_, i).bitwiseXOR(F.get(pb, i))) for i in range(PARITY)), F.lit(0))
    most = (na + nb) * (how.den - how.num)
    return (F.least(na, nb) * how.den >= F.greatest(na, nb) * how.num) & (apart * (how.den + how.num) <= most) & (_bits_apart(fa, fb) * (how.den + how.num) <= most)


def _mapped(maps: DataFrame, key: str, end: str) -> DataFrame:
    return maps.select(F.col("id").alias(key), F.col("n").alias("n" + end), F.col("parity").alias("p" + end), F.col("fine").alias("f" + end))


def _verifier(how: Similarity):
    """Rows of a chunk of a star, its leader first: the pairs of leader and member that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = last = None
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out = []
                for u, v, s in zip(part["u"].to_pylist(), part["id"].to_pylist(), shingle_sets(part["text"].to_pylist(), how.ngram), strict=True):
                    if u == v:
                        lead = s
                    elif (u, v) != last:
                        both = len(np.intersect1d(lead, s, assume_unique=True))
                        if how.den * both >= how.num * (len(lead) + len(s) - both):
                            out.append((u, v))
                    last = u, v
                if out:
                    yield batch({"u": [x for x, _ in out], "v": [x for _, x in out]}, _PAIRS)

    return run


def _linked(pairs: DataFrame, maps: DataFrame, rows: DataFrame, how: Similarity, partitions: int) -> DataFrame:
    """Of the pairs (u, v) those whose sets are similar enough. Sizes and parity maps come first, so that few texts
    move; what is left is cut into stars around u, and these into chunks, each with its leader's text."""
    near = pairs.join(_mapped(maps, "v", "b"), "v").join(_mapped(maps, "u", "a"), "u")
    near = stored(near.where(_may_link(how, "a", "b")).select("u", "v"), "near-pairs")
    chunks = near.groupBy("u").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    cut = near.join(chunks, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("chunks")).alias("chunk"))
    need = cut.select(F.col("v").alias("id"), "u", "chunk").unionByName(cut.select(F.col("u").alias("id"), "u", "chunk").distinct())
    stars = rows.select("id", "text").join(need, "id").repartition(partitions, "u", "chunk").sortWithinPartitions("u", "chunk", F.col("id") != F.col("u"), "id")
    return stars.select("u", "id", "text").mapInArrow(_verifier(how), "u long, v long")


def _grouped(docs: DataFrame, node: str, partitions: int, how: Similarity, doc_id: str, text: str) -> DataFrame:
    """doc_id, node, n_shingles, root of every row of docs that has its node: root is the smallest node reachable by links."""
    rows = docs.select(F.col(node).alias("id"), F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    dealt = _by_text(rows, partitions)
    sent = dealt.select("id", "doc_id", "text").mapInArrow(_signer(how, CELLS * partitions), _SENT_DDL)
    met = stored(sent.repartition(partitions, "cell").sortWithinPartitions("cell").mapInArrow(_meet, _LIVE_DDL), "signatures")
    members = met.where("h is null").select("rep", "id", "doc_id", "n")
    maps = met.where("h is null and parity is not null").select("id", "n", "parity", "fine").dropDuplicates(["id"])
    live = met.where("h is not null").select("h", "id", "lead")
    # Each set first meets one leader; what its other signatures add is left to the turns below.
    tested = stored(live.where("id <> lead").groupBy(F.col("id").alias("v")).agg(F.min("lead").alias("u")).select("u", "v"), "pairs")
    links = stored(_linked(tested, maps, rows, how, partitions), "links")
    equal = members.where("id <> rep").select(F.col("rep").alias("u"), F.col("id").alias("v"))
    found = components(links.unionByName(equal))
    for last in (False, True):
        # What is left: signatures whose members lie in several components.
        named = stored(live.join(found, F.col("id") == F.col("node"), "left").select("h", "id", F.coalesce("root", "id").alias("comp")).distinct(), "named")
        # Signatures of the same members say the same: of these one stays. Members are known by two hashes of their set.
        by_comp = named.groupBy("h", "comp").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("id")).alias("s"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("t"))
        of_sig = by_comp.groupBy("h").agg(F.max_by("comp", F.struct("c", "comp")).alias("big"), F.count("*").alias("comps"), F.sum("c").alias("n"), F.bit_xor("s").alias("s"), F.bit_xor("t").alias("t")).where("comps > 1")
        split = stored(of_sig.groupBy("s", "t", "n").agg(F.min("h").alias("h"), F.min("big").alias("big")).select("h", "big"), "split")
        open_rows = stored(named.join(split, "h").select("h", "id", "comp", "big"), "open")
        forget(named, split)
        if not open_rows.take(1):
            break
        if last:  # all pairs across components, but those that sizes and maps rule out
            mapped = stored(open_rows.join(_mapped(maps, "id", "b"), "id"), "mapped")
            few = mapped.where("comp <> big").select("h", F.col("id").alias("x"), F.col("comp").alias("cx"), *[F.col(c + "b").alias(c + "a") for c in "npf"])
            new = few.join(mapped, "h").where((F.col("comp") != F.col("cx")) & _may_link(how, "a", "b"))
            new = new.select(F.least("x", "id").alias("u"), F.greatest("x", "id").alias("v"))
        else:  # another star, around another member
            stars = open_rows.groupBy("h").agg(F.min_by(F.struct("id", "comp"), F.xxhash64("id")).alias("s"))
            new = open_rows.join(stars, "h").where(F.col("comp") != F.col("s.comp"))
            new = new.select(F.least("s.id", "id").alias("u"), F.greatest("s.id", "id").alias("v"))
        new = stored(new.distinct().join(tested, ["u", "v"], "left_anti"), "pairs")
        more = stored(_linked(new, maps, rows, how, partitions), "links")
        tested = tested.unionByName(new)
        if more.take(1):
            found = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    return members.join(found, F.col("id") == F.col("node"), "left").select("doc_id", F.col("id").alias("node"), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("root"))


def similar_components(docs: DataFrame, how: Similarity = Similarity(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) of every row.

    A null or empty text, or one without words, has no shingles and links with nothing. Rows with a
    null id link with nothing either and have a null component. Repeated rows share a component;
    different texts beside one id are compared each, and each row gets its own text's component. An
    empty table gives no rows; other columns are ignored.
    """
    noded, node, partitions, apart = _nodes(docs, doc_id, text)
    with _small_batches(docs.sparkSession):
        named = _grouped(noded, node, partitions, how, doc_id, text)
    if apart:  # nodes aren't ids: a component's name is its smallest id
        least = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
        named = named.join(least, "root", "left").drop("root").withColumnRenamed("component_id", "root")
    return named.select("doc_id", "n_shingles", F.col("root").alias("component_id"))


def _by_text(rows: DataFrame, partitions: int) -> DataFrame:
    """The rows dealt by their text, so that a task has all copies of a text; those of a text that would fill a partition of
    its own are spread over all. Such texts are fewer than twice the partitions."""
    key = F.xxhash64("text")
    counts = rows.groupBy(key.alias("__text")).agg(F.count("*").alias("n"))
    hot = counts.where(F.col("n") > rows.count() // (2 * partitions)).select("__text", F.lit(True).alias("__hot"))
    marked = rows.withColumn("__text", key).join(F.broadcast(hot), "__text", "left")
    return marked.repartition(partitions, "__text", F.when(F.col("__hot"), F.pmod(F.xxhash64("id"), F.lit(partitions))))


def _nodes(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str, int, bool]:
    """The rows with a node for each different text, that column's name, partitions for their signatures, and whether nodes aren't ids.

    A node is the row's id. Only ids that stand beside different texts get a node for each, a hash of id and text.
    """
    name = "__node"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    several = f"{name}several"
    spark, raw, ident = docs.sparkSession, text_bytes(text), F.col(doc_id).cast("long")
    seen = docs.groupBy(ident.alias(several)).agg(F.min(F.xxhash64(raw)).alias("least"), F.max(F.xxhash64(raw)).alias("most"), F.sum(F.octet_length(raw)).alias("bytes"))
    apart, size = seen.agg(F.count_if(F.col(several).isNotNull() & (F.col("least") != F.col("most"))), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BYTES_PER_PARTITION))
    if not apart:
        return docs.withColumn(name, ident), name, partitions, False
    noded = docs.join(seen.where(F.col(several).isNotNull() & (F.col("least") != F.col("most"))).select(several), ident == F.col(several), "left")
    return noded.withColumn(name, F.when(F.col(several).isNotNull(), F.xxhash64(ident, raw)).otherwise(ident)).drop(several), name, partitions, True


def keep_one(docs: DataFrame, how: Similarity = Similarity(ngram=5, num=80), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of linked documents, one with the smallest id, with all its columns.

    Equal rows of the same id count as one, and one of them stays; different texts beside one id stay
    both unless they are linked. Rows with a null id and rows without words are in no group with
    others and stay; of rows without words that repeat an id and a text, one stays.
    """
    noded, node, partitions, _ = _nodes(docs, doc_id, text)
    with _small_batches(docs.sparkSession):
        grouped = _grouped(noded, node, partitions, how, doc_id, text).where("root is not null")
    first = grouped.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("one")).select(F.col("one.node").alias(f"{node}first"))
    kept = noded.join(stored(first, "representatives"), F.col(node) == F.col(f"{node}first"), "left_semi").dropDuplicates([node])
    return kept.unionByName(noded.where(F.col(node).isNull())).drop(node)
