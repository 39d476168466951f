"""Token ids as flat unsigned integer files with 64-bit document offsets.

ids/   little-endian unsigned integers, two bytes where every id of the vocabulary and the end id
       fit, else four; documents follow each other in ascending doc_id order, each with its end id.
index/ one record of 16 bytes a document: doc_id (signed 64 bits) and its first id's place in the
       file (unsigned 64 bits), little-endian.

Part n of both folders comes from one task and holds one range of doc_id. The number of ids before
a part, its base, is the prefix sum of the file lengths; the place of a document in the whole
corpus is base + offset. Files are written with Spark's text sink, so that any Hadoop file system
serves: it ends each row with one zero byte, which is the top byte of the end id and of the offset
(so the end id must be below 256 or, at four bytes, 2^24, and a part shorter than 2^56 ids).
Readers memory-map the files.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, shared_dir, text_bytes

#: Text bytes that a part holds about.
PART_BYTES = 32 << 20
#: Parts that there are at most, so that their bounds stay a short list; beyond, parts grow.
MOST_PARTS = 10_000
#: Words, and as many of their stems and tails, whose ids a Python worker remembers.
CACHE_WORDS = 1 << 19

#: Latin letters that one composed code point stands for, with a tail of punctuation.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-@\[-`{-~]*)")
#: What byte-level vocabularies write for each byte: itself where it prints, else the next free code point from 256.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: chr(b) for b in _PRINTS} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_PRINTS))}

_coders: dict[tuple[str, str], _Coder] = {}


class _Coder:
    """Encodes texts with a tokenizer of the tokenizers library and remembers words.

    Where the vocabulary drops white space, no token crosses it, so each distinct word is encoded
    once; ASCII white space parts words here, any other stays inside one, for the library to treat.
    Where it also lowers case and parts letters from punctuation, which a few probes tell, the stem
    of a plain word goes to the library's model without its slower preparation of text.
    """

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        self.words: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}
        probe = ["Stem", "stem,", "ÉTÉ...", "Œuvre!?", "größe", "a"]
        self.by_word = self._library([" \n", " ".join(probe)]) == [b"", b"".join(self._library(probe))]
        self.by_stem = self.by_word and all(self._plain(w) == x for w, x in zip(probe, self._library(probe), strict=True))
        self.words.clear()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _known(self, part: str, ids: Callable[[str], bytes]) -> bytes:
        """The ids of a stem or of a tail. Any call may clear what is remembered, so they are returned, not looked up after."""
        found = self.stems.get(part)
        if found is None:
            found = ids(part)
            if len(self.stems) >= CACHE_WORDS:
                self.stems.clear()
            self.stems[part] = found
        return found

    def _stem(self, stem: str) -> bytes:
        spelled = stem if stem.isascii() else "".join([_BYTE[b] for b in stem.encode()])
        return np.array([t.id for t in self.tokenizer.model.tokenize(spelled)], self.dtype).tobytes()

    def _plain(self, word: str) -> bytes | None:
        m = _PLAIN.fullmatch(word)
        if m is None:
            return None
        stem, tail = m.groups()
        ids = self._known(stem.lower(), self._stem)
        return ids + self._known(tail, lambda t: self._library([t])[0]) if tail else ids  # no stem holds punctuation

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return self._library([t.decode() for t in texts])
        out = []
        for text in texts:
            words = text.split()
            ids = list(map(self.words.get, words))
            if None in ids:
                self._learn(dict.fromkeys(w for w, x in zip(words, ids, strict=True) if x is None))
                ids = [self.words[w] if x is None else x for w, x in zip(words, ids, strict=True)]
            out.append(b"".join(ids))
        return out

    def _learn(self, new: dict[bytes, None]) -> None:
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
        rest = []
        for w in new:
            x = self._plain(w.decode()) if self.by_stem else None
            if x is None:
                rest.append(w)
            else:
                self.words[w] = x
        if rest:
            self.words.update(zip(rest, self._library([w.decode() for w in rest]), strict=True))


def coder(path: str, dtype: str) -> _Coder:
    if (path, dtype) not in _coders:
        _coders[path, dtype] = _Coder(path, dtype)
    return _coders[path, dtype]


_ENCODED = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())])


def _encoder(path: str, dtype: str, end: bytes, bounds: list[int]):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(bounds, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                docs = part.column(0)
                ids = [x + end for x in coder(path, dtype).encode(part.column(1).to_pylist())]
                places = np.searchsorted(edges, docs.to_numpy(zero_copy_only=False), "left").astype(np.int32)
                yield batch({"part": places, "doc_id": docs, "crc": [zlib.crc32(x) for x in ids], "ids": ids}, _ENCODED)

    return encode


_FILED = pa.schema([("kind", pa.string()), ("seq", pa.int64()), ("value", pa.binary())])


def _filer(width: int):
    """Rows of a part in doc_id order to the rows of its two files."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = offset = 0
        for b in batches:
            ids = b.column(1).to_pylist()
            index = []
            for doc_id, x in zip(b.column(0).to_pylist(), ids, strict=True):
                index.append(doc_id.to_bytes(8, "little", signed=True) + offset.to_bytes(8, "little")[:7])
                offset += len(x) // width
            numbers = np.arange(seq, seq + len(ids))
            seq += len(ids)
            yield batch({"kind": ["ids"] * len(ids), "seq": numbers, "value": [x[:-1] for x in ids]}, _FILED)
            yield batch({"kind": ["index"] * len(ids), "seq": numbers, "value": index}, _FILED)

    return file


def write_tokens(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> str:
    """Writes ids and index below path; returns the ids' dtype.

    Null and empty texts have the end id alone. Rows without doc_id have no place in the order and
    are left out; rows that repeat a doc_id follow each other, by the crc32 of their ids. An empty
    table gives no files. Other columns are ignored.
    """
    dtype = "<u2" if max(vocabulary - 1, end_id) < 1 << 16 else "<u4"
    end = np.array([end_id], dtype).tobytes()
    if end[-1]:
        raise ValueError(f"the end id {end_id} leaves no zero byte for the sink")
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MOST_PARTS, max(1, -(-total // PART_BYTES)))
    cuts = [i / parts for i in range(1, parts)]
    bounds = rows.agg(F.percentile_approx("doc_id", cuts, 100 * parts)).first()[0] if cuts else []
    encoded = rows.mapInArrow(_encoder(tokenizer, dtype, end, bounds), "part int, doc_id long, crc long, ids binary")
    ranged = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions("doc_id", "crc")
    filed = ranged.select("doc_id", "ids").mapInArrow(_filer(len(end)), "kind string, seq long, value binary")
    ordered = filed.sortWithinPartitions("kind", "seq").select(F.col("value").cast("string").alias("value"), "kind")
    ordered.write.partitionBy("kind").option("lineSep", "\u0000").text(path)
    return dtype


def open_array(path: str, dtype: np.dtype | str) -> np.ndarray:
    """A file as an array: memory-mapped where the path is local, else through pyarrow's file systems."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return np.memmap(unquote(url.path), dtype, "r")
    fs, at = pa.fs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as f:
        return np.frombuffer(f.read(), dtype)


INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8")])


def parts(spark: SparkSession, path: str, dtype: str) -> DataFrame:
    """part, base, ids_path, index_path: a row for each pair of files; base is the ids before it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    files = files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("part"), F.regexp_extract("path", r"kind=(\w+)/", 1).alias("kind"), "path", "length")
    pairs = files.groupBy("part").agg(
        F.max(F.when(F.col("kind") == "ids", F.col("path"))).alias("ids_path"),
        F.max(F.when(F.col("kind") == "index", F.col("path"))).alias("index_path"),
        (F.max(F.when(F.col("kind") == "ids", F.col("length"))) / np.dtype(dtype).itemsize).cast("long").alias("n"),
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over files, not documents
    return pairs.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "ids_path", "index_path")


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _reader(dtype: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, index = open_array(r["ids_path"], dtype), open_array(r["index_path"], INDEX)
                starts = index["offset"].astype(np.int64)
                ends = np.append(starts[1:], len(ids))
                for lo in range(0, len(index), 10_000):
                    s, e = starts[lo : lo + 10_000], ends[lo : lo + 10_000]
                    crcs = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(s, e, strict=True)]
                    yield batch({"doc_id": index["doc_id"][lo : lo + 10_000], "start": s + r["base"], "n_tokens": e - s, "ids_crc32": crcs}, _READ)

    return read


def read_tokens(spark: SparkSession, path: str, dtype: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    found = parts(spark, path, dtype)
    n = max(1, found.count())  # files, not documents: a task for each, which adaptive execution must not put together
    return found.repartitionById(n, F.col("part") % n).mapInArrow(_reader(dtype), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int, path: str | None = None) -> DataFrame:
    """Writes the files below path (a new shared folder if none is given) and reads them back."""
    spark = docs.sparkSession
    path = path or shared_dir(spark, "tokens")
    dtype = write_tokens(docs, path, tokenizer, vocabulary, end_id)
    return read_tokens(spark, path, dtype)
