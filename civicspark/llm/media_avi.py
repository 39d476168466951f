"""Media columns: AVI files of motion-JPEG frames.

Reading: RIFF chunks and the idx1 index are parsed, baseline JPEG frames are decoded (any sampling,
restart intervals, 8 bits; every frame stands alone), and shots are cut where the difference of two
successive luma histograms exceeds what the differences before it lead to expect.

Storing bytes: a payload is a picture WIDTH samples wide. Each sample is a flat block of 8x8 pixels
whose one coefficient is quantised by 8, so baseline JPEG keeps it exactly. Each row of samples is a
restart interval; intervals are decoded side by side, one symbol of each at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, text_bytes

#: Samples in a row, rows in a frame, frames a second of stored payloads.
WIDTH, ROWS, RATE = 192, 8, 25
#: Code lengths of the categories 0 to 8 of a coefficient's difference: short for those of prose.
DC_LENGTHS = [5, 4, 4, 3, 2, 4, 4, 2, 5]
#: Samples that one pass of the coder takes.
PASS = 1 << 21
BINS = 16
#: A shot begins where the difference exceeds this and, by SPREAD deviations, the mean of the LOOK_BACK before.
LEAST, SPREAD, LOOK_BACK = 0.2, 3.0, 8

#: The order in which a JPEG block's coefficients are stored.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length), codes in order of length and then of the dict."""
    code, last, out = 0, 0, {}
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - last
        out[symbol], last = (code, n), n
        code += 1
    return out


def _dht(place: int, lengths: dict[int, int]) -> bytes:
    symbols = [s for s, _ in sorted(lengths.items(), key=lambda x: x[1])]
    counts = [sum(n == i for n in lengths.values()) for i in range(1, 17)]
    return struct.pack(">HHB16B", 0xFFC4, 19 + len(symbols), place, *counts) + bytes(symbols)


_DC, _AC = dict(enumerate(DC_LENGTHS)), {0: 1}


def _scan_header(rows: int) -> bytes:
    return (
        b"\xff\xd8" + struct.pack(">HHB", 0xFFDB, 67, 0) + bytes([8] * 64)
        + struct.pack(">HHBHHBBBB", 0xFFC0, 11, 8, rows * 8, WIDTH * 8, 1, 1, 0x11, 0)
        + _dht(0x00, _DC) + _dht(0x10, _AC)
        + struct.pack(">HHH", 0xFFDD, 4, WIDTH) + struct.pack(">HHBBBBBB", 0xFFDA, 8, 1, 1, 0x00, 0, 63, 0)
    )


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference -255 to 255: category, its bits, end of block."""
    codes, values, lengths = canonical(_DC), [], []
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        code, n = codes[cat]
        extra = d if d >= 0 else d + (1 << cat) - 1
        values.append((((code << cat) | extra) << 1))
        lengths.append(n + cat + 1)
    return np.array(values, np.int64), np.array(lengths, np.int64)


_VALUES, _LENGTHS = _difference_codes()


def encode_rows(rows: np.ndarray, frame_rows: list[int]) -> list[bytes]:
    """Rows of WIDTH samples to JPEG frames of the given numbers of rows."""
    diff = np.diff(rows.astype(np.int16), axis=1, prepend=np.int16(128)) + 255
    lengths = _LENGTHS[diff]
    ends = np.cumsum(lengths, axis=1)
    bits = ends[:, -1]
    held = (bits + 7) >> 3
    first = np.concatenate(([0], np.cumsum(held)))
    at = (first[:-1, None] << 3) + ends - lengths
    window = _VALUES[diff] << (24 - (at & 7) - lengths)
    byte, total = (at >> 3).ravel(), int(first[-1])
    window = window.ravel()
    out = sum(np.bincount(byte + k, (window >> (16 - 8 * k)) & 255, total + 2)[:total] for k in range(3)).astype(np.uint8)
    out[first[1:] - 1] |= ((1 << (held * 8 - bits)) - 1).astype(np.uint8)
    # A zero follows each 255, a restart marker each interval but a frame's last.
    last = np.cumsum(frame_rows) - 1
    counts = 1 + (out == 255).astype(np.int64)
    marked = np.ones(len(rows), np.int64)
    marked[last] = 0
    stuffed = counts.copy()
    counts[first[1:] - 1] += 2 * marked
    place = np.concatenate(([0], np.cumsum(counts)))
    scan = np.zeros(int(place[-1]), np.uint8)
    scan[place[:-1]] = out
    starts = np.concatenate(([0], last[:-1] + 1))
    number = np.arange(len(rows)) - np.repeat(starts, frame_rows)
    tail = (place[:-1] + stuffed)[first[1:] - 1][marked == 1]
    scan[tail] = 255
    scan[tail + 1] = 0xD0 + (number[marked == 1] & 7)
    edges = place[first[np.concatenate(([0], last + 1))]]
    heads = {n: _scan_header(n) for n in set(frame_rows)}
    return [heads[n] + scan[a:b].tobytes() + b"\xff\xd9" for n, a, b in zip(frame_rows, edges[:-1], edges[1:], strict=True)]


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def avi(frames: list[bytes], width: int, height: int, rate: int = RATE) -> bytes:
    """A RIFF AVI file with one MJPG stream and an idx1 index."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIiI4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), most, -1, 0, 0, 0, width & 0xFFFF, height & 0xFFFF)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    index, at = [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + (len(f) & 1)
    body = head + _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", b"AVI " + body)


def riff_frames(data: bytes) -> tuple[list[bytes], float]:
    """The frames of the first video stream, by idx1 or else by walking movi; the frame rate."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, movi, index, walk = float(RATE), None, None, []

    def chunks(lo: int, hi: int) -> None:
        nonlocal rate, movi, index
        while lo + 8 <= hi:
            name, size = data[lo : lo + 4], struct.unpack_from("<I", data, lo + 4)[0]
            kind = data[lo + 8 : lo + 12]
            if name == b"LIST" and kind == b"movi":
                movi = lo + 8
            if name == b"LIST" and (kind != b"movi" or b"idx1" not in data[lo + 8 + size : lo + 16 + size]):
                chunks(lo + 12, min(hi, lo + 8 + size))
            elif name == b"strh" and kind == b"vids":
                scale, per = struct.unpack_from("<II", data, lo + 28)
                rate = per / scale if scale and per else rate
            elif name == b"idx1":
                index = (lo + 8, size // 16)
            elif name[2:4] in (b"dc", b"db"):
                walk.append(data[lo + 8 : lo + 8 + size])
            lo += 8 + size + (size & 1)

    chunks(12, len(data))
    if index is None or movi is None:
        return walk, rate
    entries = [struct.unpack_from("<4sIII", data, index[0] + 16 * i) for i in range(index[1])]
    entries = [e for e in entries if e[0][2:4] in (b"dc", b"db")]
    # Offsets count from movi in most files, from the start of the file in others.
    base = movi if not entries or data[movi + entries[0][2] : movi + entries[0][2] + 4] == entries[0][0] else 0
    return [data[base + at + 8 : base + at + 8 + n] for _, _, at, n in entries], rate


class _Header:
    """What stands before a frame's scan: size, components, tables."""

    def __init__(self, head: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.huff: dict[int, dict[int, int]] = {}
        self.restart, at = 0, 2
        while at < len(head):
            marker, size = struct.unpack_from(">HH", head, at)
            part, at = head[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xFFDB:
                while part:
                    wide = part[0] >> 4
                    table = np.frombuffer(part, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                    self.quant[part[0] & 15] = table
                    part = part[1 + 64 * (1 + wide) :]
            elif marker == 0xFFC4:
                while part:
                    counts = part[1:17]
                    symbols = part[17 : 17 + sum(counts)]
                    lengths = [i + 1 for i, c in enumerate(counts) for _ in range(c)]
                    self.huff[part[0]] = dict(zip(symbols, lengths, strict=True))
                    part = part[17 + len(symbols) :]
            elif marker in (0xFFC0, 0xFFC1):
                bits, self.height, self.width, n = struct.unpack_from(">BHHB", part)
                if bits != 8:
                    raise ValueError("only 8-bit frames are decoded")
                self.parts = {part[6 + 3 * i]: [part[7 + 3 * i] >> 4, part[7 + 3 * i] & 15, part[8 + 3 * i], 0, 0] for i in range(n)}
            elif 0xFFC2 <= marker <= 0xFFCF and marker != 0xFFC8:
                raise ValueError("only baseline frames are decoded")
            elif marker == 0xFFDD:
                self.restart = struct.unpack(">H", part)[0]
            elif marker == 0xFFDA:
                for i in range(part[0]):
                    self.parts[part[1 + 2 * i]][3:] = part[2 + 2 * i] >> 4, part[2 + 2 * i] & 15
        comps = list(self.parts.values())
        if len(comps) == 1:
            comps[0][:2] = 1, 1
        self.h, self.v = max(c[0] for c in comps), max(c[1] for c in comps)
        self.mcus_x, self.mcus_y = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        self.mcus = self.mcus_x * self.mcus_y
        self.interval = self.restart or self.mcus
        #: Component of each block of a unit.
        self.blocks = [i for i, c in enumerate(comps) for _ in range(c[0] * c[1])]
        self.comps = comps

    def flat(self) -> bool:
        """One component whose blocks end after the first coefficient, in at most 16 bits."""
        c = self.comps[0]
        return len(self.comps) == 1 and list(self.huff[16 | c[4]]) == [0] and max(s + n for s, n in self.huff[c[3]].items()) + self.huff[16 | c[4]][0] <= 16

    def table(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and code length by the next 16 bits."""
        symbols, lengths = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        for s, (code, n) in canonical(self.huff[place]).items():
            lo = code << (16 - n)
            symbols[lo : lo + (1 << (16 - n))], lengths[lo : lo + (1 << (16 - n))] = s, n
        return symbols, lengths

    def flat_table(self) -> tuple[np.ndarray, np.ndarray]:
        """Difference and bits of a whole block by the next 16 bits."""
        symbols, lengths = self.table(self.comps[0][3])
        word = np.arange(1 << 16)
        raw = (word >> np.maximum(0, 16 - lengths - symbols)) & ((1 << symbols) - 1)
        diff = np.where(raw >= (1 << symbols) >> 1, raw, raw - (1 << symbols) + 1)
        return np.where(symbols > 0, diff, 0).astype(np.int16), (lengths + symbols + self.huff[16 | self.comps[0][4]][0]).astype(np.int64)


_headers: dict[bytes, _Header] = {}


def _split(frame: bytes) -> tuple[_Header, bytes]:
    at = 2
    while True:
        marker, size = struct.unpack_from(">HH", frame, at)
        at += 2 + size
        if marker == 0xFFDA:
            break
    head = bytes(frame[:at])
    if head not in _headers:
        if len(_headers) > 4096:
            _headers.clear()
        _headers[head] = _Header(head)
    end = len(frame)
    while end > at and frame[end - 1] == 0:
        end -= 1
    return _headers[head], frame[at : end - 2]


def _words(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32 bits from each byte of the scans without stuffing and markers; first byte of each restart
    interval; intervals of each scan."""
    raw = np.frombuffer(b"".join(scans), np.uint8)
    after = np.append(raw[1:], 0)
    full = raw == 255
    restart = full & (after >= 0xD0) & (after <= 0xD7)
    stuffing = np.append(False, (full & (after == 0))[:-1])
    keep = ~(restart | np.append(False, restart[:-1]) | stuffing)
    edges = np.concatenate(([0], np.cumsum([len(s) for s in scans])))
    kept = np.concatenate(([0], np.cumsum(keep)))
    marks = np.flatnonzero(restart)
    starts = np.sort(np.concatenate((edges[:-1], marks + 2)), kind="stable")
    per = np.diff(np.searchsorted(marks, edges)) + 1
    data = np.concatenate((raw[keep], np.zeros(8, np.uint8))).astype(np.uint32)
    words = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    return words, kept[starts], per


def _decode_flat(h: _Header, scans: list[bytes]) -> list[np.ndarray]:
    """One sample for each block, where nothing but first coefficients is stored."""
    words, first, _ = _words(scans)
    diff, bits = h.flat_table()
    blocks = min(h.interval, h.mcus)
    if len(first) != len(scans) * -(-h.mcus // blocks):
        raise ValueError("restart intervals are missing")
    at = first.astype(np.int64) << 3
    out = np.empty((blocks, len(first)), np.int16)
    top = len(words) - 1
    for i in range(blocks):
        peek = ((words[np.minimum(at >> 3, top)] << (at & 7).astype(np.uint32)) >> np.uint32(16)).astype(np.int64)
        out[i] = diff[peek]
        at += bits[peek]
    level = np.cumsum(out, axis=0, dtype=np.int64).T.reshape(len(scans), -1)[:, : h.mcus] * int(h.quant[h.comps[0][2]][0])
    pixels = np.clip(np.floor_divide(level + 4, 8) + 128, 0, 255).astype(np.uint8)
    return list(pixels.reshape(len(scans), h.mcus_y, h.mcus_x))


def _decode_full(h: _Header, scans: list[bytes]) -> list[list[np.ndarray]]:
    """The planes of each frame: all intervals side by side, a symbol of each at a time."""
    words, first, per = _words(scans)
    owner = np.repeat(np.arange(len(scans)), per)
    number = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(per)[:-1])), per)
    unit, n_blocks = number * h.interval, len(h.blocks)
    left = np.minimum(h.interval, h.mcus - unit) * n_blocks
    places = {p: i for i, p in enumerate(h.huff)}
    symbols, lengths = (np.concatenate(x) for x in zip(*(h.table(p) for p in places), strict=True))
    dc = np.array([places[h.comps[c][3]] for c in h.blocks]) << 16
    ac = np.array([places[16 | h.comps[c][4]] for c in h.blocks]) << 16
    comp = np.array(h.blocks)
    coef = np.zeros((len(scans) * h.mcus * n_blocks, 64), np.int32)
    at, k, block = first.astype(np.int64) << 3, np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
    base = (owner * h.mcus + unit) * n_blocks
    pred = np.zeros((len(owner), len(h.comps)), np.int64)
    live, top = np.flatnonzero(left > 0), len(words) - 1
    while len(live):
        p, kk, b = at[live], k[live], block[live]
        inside = b % n_blocks
        peek = (words[np.minimum(p >> 3, top)] << (p & 7).astype(np.uint32)) >> np.uint32(16)
        e = np.where(kk == 0, dc[inside], ac[inside]) + peek
        sym, n = symbols[e], lengths[e]
        if not n.all():
            raise ValueError("a code isn't in the tables")
        size = sym & 15
        q = p + n
        extra = (words[np.minimum(q >> 3, top)] << (q & 7).astype(np.uint32)).astype(np.int64) >> (32 - np.maximum(size, 1))
        value = np.where(size == 0, 0, np.where(extra >= (1 << size) >> 1, extra, extra - (1 << size) + 1))
        at[live] = q + size
        is_dc = kk == 0
        spot = np.where(is_dc, 0, kk + (sym >> 4))
        end = ~is_dc & (sym == 0)
        c = comp[inside]
        level = pred[live, c] + np.where(is_dc, value, 0)
        pred[live, c] = level
        put = is_dc | (size > 0)
        coef[(base[live] + b)[put], ZIGZAG[np.minimum(spot, 63)][put]] = np.where(is_dc, level, value)[put]
        kk = np.where(end, 64, np.where(is_dc, 1, spot + 1))
        over = kk >= 64
        k[live], block[live] = np.where(over, 0, kk), b + over
        live = live[block[live] < left[live]]
    quant = np.stack([h.quant[h.comps[c][2]] for c in h.blocks])
    natural = np.zeros_like(quant)
    natural[:, ZIGZAG] = quant
    grid = (coef.reshape(-1, n_blocks, 64) * natural).reshape(-1, 8, 8).astype(np.float64)
    pixels = np.clip(np.rint(_COS @ grid @ _COS.T) + 128, 0, 255).astype(np.uint8).reshape(len(scans), h.mcus_y, h.mcus_x, n_blocks, 8, 8)
    out = []
    for frame in pixels:
        planes, lo = [], 0
        for hs, vs, *_ in h.comps:
            part = frame[:, :, lo : lo + hs * vs].reshape(h.mcus_y, h.mcus_x, vs, hs, 8, 8)
            plane = part.transpose(0, 2, 4, 1, 3, 5).reshape(h.mcus_y * vs * 8, h.mcus_x * hs * 8)
            planes.append(plane[: -(-h.height * vs // h.v), : -(-h.width * hs // h.h)])
            lo += hs * vs
        out.append(planes)
    return out


def decode_samples(frames: list[bytes]) -> list[np.ndarray]:
    """Each frame's luma: one sample a block where blocks are flat, else one a pixel."""
    by: dict[int, tuple[_Header, list[int], list[bytes]]] = {}
    for i, frame in enumerate(frames):
        h, scan = _split(frame)
        _, places, scans = by.setdefault(id(h), (h, [], []))
        places.append(i)
        scans.append(scan)
    out: list = [None] * len(frames)
    for h, places, scans in by.values():
        for i, x in zip(places, _decode_flat(h, scans) if h.flat() else [p[0] for p in _decode_full(h, scans)], strict=True):
            out[i] = x
    return out


def shots(histograms: np.ndarray) -> list[int]:
    """First frames of the shots, by adaptive differences of successive histograms."""
    diff = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    starts = [0] if len(histograms) else []
    for i, d in enumerate(diff):
        before = diff[max(0, i - LOOK_BACK, starts[-1]) : i]
        if d > LEAST and (not len(before) or d > before.mean() + SPREAD * before.std()):
            starts.append(i + 1)
    return starts


def histogram(luma: np.ndarray) -> np.ndarray:
    return np.bincount(luma.ravel() >> (8 - BINS.bit_length() + 1), minlength=BINS) / max(1, luma.size)


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % WIDTH if text else WIDTH)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload (whole rows), several coded in one pass."""
    plan = []  # rows of each frame, frames of each payload
    for p in payloads:
        n = len(p) // WIDTH
        plan.append([ROWS] * (n // ROWS) + [n % ROWS] * (n % ROWS > 0))
    frame_rows = [r for x in plan for r in x]
    data, frames, row, lo = b"".join(payloads), [], 0, 0
    step = PASS // (WIDTH * ROWS)
    while lo < len(frame_rows):
        some = frame_rows[lo : lo + step]
        n = sum(some)
        frames += encode_rows(np.frombuffer(data, np.uint8, n * WIDTH, row * WIDTH).reshape(n, WIDTH), some)
        row, lo = row + n, lo + step
    out, at = [], 0
    for x in plan:
        out.append(avi(frames[at : at + len(x)], WIDTH * 8, ROWS * 8))
        at += len(x)
    return out


def _slices(sizes: list[int]) -> Iterator[slice]:
    """Runs of rows of about PASS bytes."""
    lo = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= PASS:
            yield slice(lo, i + 1)
            lo, held = i + 1, 0
    if lo < len(sizes):
        yield slice(lo, len(sizes))


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = (c.to_pylist() for c in b.columns)
        for s in _slices([len(t) for t in texts]):
            yield batch({"doc_id": ids[s], "n_bytes": [len(t) for t in texts[s]], "media": encode_payloads([payload_of(t) for t in texts[s]])}, _STORED)


def store_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every text's bytes as an AVI file. Null counts as empty (one row of
    spaces); repeated rows and null ids are kept; other columns are ignored."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    return rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _decoded(media: list[bytes]) -> Iterator[tuple[float, list[np.ndarray]]]:
    """Rate and frames of each file, many files' frames in one pass."""
    files = [riff_frames(m) for m in media]
    flat = [f for frames, _ in files for f in frames]
    luma: list[np.ndarray] = []
    for s in _slices([len(f) for f in flat]):
        luma += decode_samples(flat[s])
    at = 0
    for frames, rate in files:
        yield rate, luma[at : at + len(frames)]
        at += len(frames)


_CLIPS = pa.schema([("doc_id", pa.int64()), ("clip", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, media = (c.to_pylist() for c in b.columns)
        for s in _slices([len(m) for m in media]):
            rows = []
            for doc_id, (rate, luma) in zip(ids[s], _decoded(media[s]), strict=True):
                starts = shots(np.array([histogram(x) for x in luma]))
                for i, (a, z) in enumerate(zip(starts, [*starts[1:], len(luma)], strict=True)):
                    rows.append((doc_id, i, a, z - a, a / rate, z / rate))
            yield batch(dict(zip(_CLIPS.names, zip(*rows, strict=True) if rows else [[]] * 6, strict=True)), _CLIPS)


def clips(media: DataFrame, doc_id: str = "doc_id", column: str = "media") -> DataFrame:
    """doc_id, clip, first_frame, frames, start_s, end_s: the timed shots of every AVI file (null: none)."""
    rows = media.where(F.col(column).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(column).alias("media"))
    return rows.mapInArrow(_clips, "doc_id long, clip int, first_frame int, frames int, start_s double, end_s double")


_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, sizes, media = (c.to_pylist() for c in b.columns)
        for s in _slices([len(m) for m in media]):
            rows = []
            for doc_id, n, m, (rate, luma) in zip(ids[s], sizes[s], media[s], _decoded(media[s]), strict=True):
                payload = b"".join(x.tobytes() for x in luma)
                starts = shots(np.array([histogram(x) for x in luma]))
                mean = np.frombuffer(payload, np.uint8).mean() if payload else 0
                feature = f"frames={len(luma)};mean={mean:.3f};cuts={','.join(f'{a / rate:.2f}' for a in starts[1:])}"
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            yield batch(dict(zip(_FEATURES.names, zip(*rows, strict=True) if rows else [[]] * 8, strict=True)), _FEATURES)


def media_features(media: DataFrame) -> DataFrame:
    """Reads every stored file back: sizes and digests of what it holds, and its shots."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
