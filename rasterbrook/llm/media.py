"""Bytes kept in AVI motion-JPEG, read back through the RIFF index, and shots found in the decoded frames.

Storing: a payload is cut into blocks of 64 bytes. Byte b becomes the
quantised DCT coefficient b - 128, 64 to a block in zigzag order, and blocks
fill grey frames GRID blocks wide and at most FRAME_ROWS high, coded as baseline
JPEG with a restart marker after each row of blocks. Coefficients are entropy-coded
without loss, so the payload comes back byte for byte. What is left of the
last frames is filled with zero coefficients; the payload's length stands in
the file's INFO list.

Reading: chunks are found by the idx1 index; frames give their tables; restart
segments of all frames of a slice are decoded in step, one symbol of each at a
time, by table look-up in arrays. Dequantised blocks go through the inverse
DCT to pixels. A shot ends where the difference of neighbouring frames'
histograms exceeds the mean of the shot's recent differences by DEVIATIONS
standard deviations, and STEP at least.

Frames are coded and decoded BAND at a time, so what a long text needs beyond
its own bytes and its file is bounded.

Defined results: a null text counts as empty and is stored as 64 zero bytes.
Equal texts give equal files and features. Rows are independent of each other.
A file that is cut short or has an undefined code raises ValueError.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterbrook.functions import tables
from rasterbrook.llm.common import chunks, map_batches, table
from rasterbrook.operators import huffman
from rasterbrook.sources import jpeg

BLOCK = 64
#: Blocks of a frame's row, which is a restart interval, and its most rows: an ordinary text has several frames.
GRID = 8
FRAME_ROWS = 2
FRAME_BLOCKS = FRAME_ROWS * GRID
#: Frames that are coded or decoded at once.
BAND = 512
RATE = 25
BINS = 16
#: Differences that a shot's threshold looks back on.
RECENT = 8
DEVIATIONS = 3.0
STEP = 0.1


@cache
def zigzag() -> np.ndarray:
    """Natural position of each coefficient's zigzag place."""
    return np.array(tables.ZIGZAG)


@cache
def basis() -> np.ndarray:
    """64x64: row k holds the pixels of zigzag coefficient k of the orthonormal 8x8 DCT."""
    return np.array([[tables.dct_weight(k, p) for p in range(64)] for k in tables.ZIGZAG], np.float32)


def _table(weights: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """Huffman table of some weights: counts by length 1..16, symbols in order of their codes, and symbol -> (code, length)."""
    counts = huffman.limited(huffman.merged_sizes(weights))
    symbols = sorted(weights, key=lambda s: (-weights[s], s))
    return counts, symbols, tables.codes(counts, symbols)


@cache
def dc_table() -> tuple:
    return _table({s: 1 << 20 - abs(s - 5) for s in range(12)})


@cache
def ac_table() -> tuple:
    """Weights by rule: sizes near five are likely, long runs are not. Three codes of sixteen zeros, another code and its bits must fit in 64 bits."""
    weights = {run << 4 | size: 1 << max(0, 24 - 2 * run - abs(size - 5)) for run in range(16) for size in range(1, 11)}
    return _table(weights | {0x00: 1 << 18, 0xF0: 1 << 18})


def _size_of(v: np.ndarray) -> np.ndarray:
    """Magnitude category: the bits of |v|."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def _coded(v: np.ndarray, run: np.ndarray | int, codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Code of (run, size) and magnitude bits of each value, and how many bits they are; sixteen zeros have a symbol of their own before."""
    code, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for symbol, (c, n) in codes.items():
        code[symbol], length[symbol] = c, n
    s = _size_of(v)
    run = np.broadcast_to(run, v.shape).copy()
    symbol = (run % 16) << 4 | s
    word = code[symbol] << s.astype(np.uint64) | np.where(v > 0, v, v - 1 + (1 << s)).astype(np.uint64)
    size = length[symbol] + s
    for _ in range(3):
        far = run >= 16
        word[far] |= code[0xF0] << size[far].astype(np.uint64)
        size[far] += length[0xF0]
        run[far] -= 16
    return word, size


@cache
def _plain() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bits and lengths of DC differences from -512, and of AC values from -512 that follow no zero."""
    v = np.arange(-512, 513)
    dc, ac = _coded(v, 0, dc_table()[2]), _coded(v, 0, ac_table()[2])
    return dc[0], dc[1].astype(np.uint8), ac[0], ac[1].astype(np.uint8)


def entropy_code(blocks: np.ndarray, interval: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Stuffed entropy bytes of (n, 64) coefficients of at most 8 bits, predictors reset each interval blocks, and each interval's length in bytes."""
    n = len(blocks)
    v = blocks.astype(np.int64) + 512
    codes, lengths = np.zeros((n, 66), np.uint64), np.zeros((n, 66), np.uint8)
    delta = v[:, 0].copy()
    inner = np.arange(n) % interval != 0
    delta[inner] -= v[np.flatnonzero(inner) - 1, 0] - 512
    dc_word, dc_size, ac_word, ac_size = _plain()
    codes[:, 0], lengths[:, 0] = dc_word[delta], dc_size[delta]
    codes[:, 1:64], lengths[:, 1:64] = ac_word[v[:, 1:]], ac_size[v[:, 1:]]

    gaps = np.flatnonzero((blocks[:, 1:] == 0).any(axis=1))
    if len(gaps):
        lengths[gaps, 1:64] = 0
        some = blocks[gaps]
        b, k = np.nonzero(some[:, 1:])
        k = k + 1
        same = np.r_[False, b[1:] == b[:-1]] if len(b) else np.zeros(0, bool)
        run = k - np.where(same, np.r_[0, k[:-1]] if len(k) else k, 0) - 1
        codes[gaps[b], k], lengths[gaps[b], k] = _coded(some[b, k].astype(np.int64), run, ac_table()[2])
        open_ = gaps[some[:, 63] == 0]
        codes[open_, 64], lengths[open_, 64] = ac_table()[2][0]

    first = np.arange(0, n, interval)
    bits = np.add.reduceat(lengths.sum(axis=1, dtype=np.int64), first)
    fill = -bits % 8
    last = np.r_[first[1:], n] - 1
    lengths[last, 65] = fill
    codes[last, 65] = (1 << fill).astype(np.uint64) - np.uint64(1)

    used = lengths.ravel() > 0
    codes, size = codes.ravel()[used], lengths.ravel()[used].astype(np.int64)
    ends = np.cumsum(size)
    words = np.zeros((int(ends[-1]) + 63) // 64 + 1, np.uint64)
    at = ends - size
    slot = at >> 6
    room = 64 - (at & 63) - size
    head = codes << np.maximum(room, 0).astype(np.uint64)
    over = np.flatnonzero(room < 0)
    head[over] = codes[over] >> (-room[over]).astype(np.uint64)
    start = np.flatnonzero(np.diff(slot, prepend=-1))
    words[slot[start]] = np.bitwise_or.reduceat(head, start)
    words[slot[over] + 1] |= codes[over] << (64 + room[over]).astype(np.uint64)
    size = (bits + fill) // 8
    raw = words.astype(">u8").view(np.uint8)[: size.sum()]
    ff = np.flatnonzero(raw == 0xFF)
    size = size + np.diff(np.r_[0, np.searchsorted(ff, np.cumsum(size))])
    return (np.insert(raw, ff + 1, 0) if len(ff) else raw), size


@cache
def frame_header(rows: int) -> bytes:
    """SOI, DQT of ones, SOF0, both DHT, DRI and SOS of a frame of so many rows of blocks."""

    coding = b"".join(bytes([kind, *t[0], *t[1]]) for kind, t in ((0x00, dc_table()), (0x10, ac_table())))
    parts = (
        (jpeg.DQT, b"\x00" + b"\x01" * 64),
        (jpeg.SOF0, struct.pack(">BHHB", 8, 8 * rows, 8 * GRID, 1) + b"\x01\x11\x00"),
        (jpeg.DHT, coding),
        (jpeg.DRI, struct.pack(">H", GRID)),
        (jpeg.SOS, b"\x01\x01\x00\x00\x3f\x00"),
    )
    return b"\xff\xd8" + b"".join(struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body for marker, body in parts)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(frames: list[bytes], n_payload: int, rows: int) -> bytes:
    """A RIFF file of motion-JPEG frames with its index; the payload's length is the INFO comment."""
    wide, high, largest = 8 * GRID, 8 * rows, max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, len(frames), 0, 1, largest, wide, high, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, RATE, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, wide, high)
    strf = struct.pack("<IiiHH4sIiiII", 40, wide, high, 1, 24, b"MJPG", wide * high * 3, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", str(n_payload).encode() + b"\0"))
    body, index, at = [], [], 4
    for f in frames:
        body.append(_chunk(b"00dc", f))
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + header + info + _chunk(b"LIST", b"movi" + b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def pad(text: bytes | None) -> bytes:
    """The payload: bytes 0 up to a positive multiple of BLOCK."""
    text = text or b""
    return text.ljust(max(1, -(-len(text) // BLOCK)) * BLOCK, b"\0")


def _frames(parts: list[bytes], rows: np.ndarray) -> list[bytes]:
    """A JPEG file for each frame's bytes; rows: of blocks, in each."""
    stream, size = entropy_code((np.frombuffer(b"".join(parts), np.uint8).astype(np.int16) - 128).reshape(-1, BLOCK))
    ends = np.cumsum(size)
    first = np.cumsum(rows) - rows
    row = np.arange(rows.sum()) - np.repeat(first, rows)
    last = row == np.repeat(rows, rows) - 1
    marks = np.repeat(ends[~last], 2)  # a marker after each interval that doesn't end its frame
    values = np.full(len(marks), 0xFF, np.uint8)
    values[1::2] = 0xD0 + row[~last] % 8
    data = np.insert(stream, marks, values).tobytes()
    cuts = [0, *(ends + 2 * np.cumsum(~last))[last].tolist()]
    return [frame_header(r) + data[a:b] + b"\xff\xd9" for r, a, b in zip(rows.tolist(), cuts, cuts[1:], strict=False)]


def store(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload; sizes are positive multiples of BLOCK."""
    shapes = []  # frames and rows of blocks a frame: as many frames as needed, each as low as may be
    for p in payloads:
        blocks = len(p) // BLOCK
        n = -(-blocks // FRAME_BLOCKS)
        shapes.append((n, -(-blocks // (n * GRID))))
    out: list[bytes] = []
    done: list[bytes] = []
    parts: list[bytes] = []
    rows: list[int] = []

    def code() -> None:
        if parts:
            done.extend(_frames(parts, np.array(rows)))
            parts.clear(), rows.clear()
        while len(out) < len(payloads) and len(done) >= shapes[len(out)][0]:  # whole files
            n, high = shapes[len(out)]
            out.append(avi(done[:n], len(payloads[len(out)]), high))
            del done[:n]

    for p, (n, high) in zip(payloads, shapes, strict=True):
        size = high * GRID * BLOCK
        for i in range(n):
            parts.append(p[i * size : (i + 1) * size].ljust(size, b"\x80"))
            rows.append(high)
            if len(parts) == BAND:
                code()
    code()
    return out


def riff_index(media: bytes) -> tuple[list[bytes], int, float]:
    """Frames by the idx1 index, the payload's length and seconds a frame."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    movi, index, length, tick = None, b"", -1, 1 / RATE
    stack = [(12, 8 + struct.unpack_from("<I", media, 4)[0])]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            kind = media[at + 8 : at + 12]
            if name == b"LIST" and kind == b"movi":
                movi = at + 8
            elif name == b"LIST":
                stack.append((at + 12, at + 8 + size))
            elif name == b"idx1":
                index = media[at + 8 : at + 8 + size]
            elif name == b"ICMT":
                length = int(media[at + 8 : at + 8 + size].split(b"\0")[0])
            elif name == b"avih":
                tick = struct.unpack_from("<I", media, at + 8)[0] / 1e6
            at += 8 + size + size % 2
    if movi is None or length < 0:
        raise ValueError("no frames or no length")
    frames = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", index):
        start = movi + offset
        if name[2:] == b"dc":
            if media[start : start + 4] != name or start + 8 + size > len(media):
                raise ValueError("the index points elsewhere")
            frames.append(media[start + 8 : start + 8 + size])
    return frames, length, tick


@cache
def _frame_head(head: bytes) -> tuple[np.ndarray, int, int, np.ndarray, np.ndarray]:
    """Of all before the entropy bytes: quantiser by zigzag place, blocks, restart interval, DC and AC look-up by 16 bits."""
    quant, blocks, interval, codes = {}, 0, 0, {}
    for _, marker, body in jpeg.segments(head + b"\xff\xd9"):  # an empty scan stands for the frame's
        if marker == jpeg.DQT:
            quant |= {dest: steps[zigzag()].astype(np.float32) for dest, steps in jpeg.quant_tables(body)}
        elif marker == jpeg.SOF0:
            precision, high, wide, n = struct.unpack_from(">BHHB", body)
            if precision != 8 or n != 1:
                raise ValueError("only grey baseline frames are read")
            blocks, selector = -(-high // 8) * -(-wide // 8), body[8]
        elif 0xC1 <= marker <= 0xCF and marker not in (jpeg.DHT, 0xC8, 0xCC):
            raise ValueError("only grey baseline frames are read")
        elif marker == jpeg.DHT:
            codes |= {(kind, dest): jpeg.lookup(counts, symbols) for kind, dest, counts, symbols in jpeg.huffman_tables(body)}
        elif marker == jpeg.DRI:
            interval = struct.unpack(">H", body)[0]
        elif marker == jpeg.SOS:
            dc, ac = body[2] >> 4, body[2] & 15
    return quant[selector], blocks, interval or blocks, codes[0, dc], codes[1, ac]


def decode_frames(frames: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(coefficients, quantiser) of each frame: (blocks, 64) in zigzag order; the restart segments of frames with like heads go in step."""
    groups: dict[bytes, list[int]] = {}
    entropy = []
    for i, f in enumerate(frames):
        at = 2
        while f[at + 1] != jpeg.SOS:
            at += 2 + int.from_bytes(f[at + 2 : at + 4], "big")
        at += 2 + int.from_bytes(f[at + 2 : at + 4], "big")
        if f[-2:] != b"\xff\xd9":
            raise ValueError("a frame has no end")
        groups.setdefault(f[:at], []).append(i)
        entropy.append(f[at:-2])
    out: list = [None] * len(frames)
    for head, own in groups.items():
        quant, blocks, interval, dc, ac = _frame_head(head)
        sizes = [min(interval, blocks - a) for a in range(0, blocks, interval)]
        parts = [jpeg.restart_parts(entropy[i]) for i in own]
        if any(len(p) != len(sizes) for p in parts):
            raise ValueError("restart markers are missing")
        n = len(own) * len(sizes)
        found = jpeg.decode_segments([x for p in parts for x in p], sizes * len(own), [0], [[dc] * 3] * n, [[ac] * 3] * n)
        coefficients = np.concatenate(found).reshape(len(own), blocks, BLOCK).astype(np.int16)
        for j, i in enumerate(own):
            out[i] = coefficients[j], quant
    return out


def pixels(coefficients: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """(blocks, 64) grey samples."""
    return np.clip(np.rint((coefficients * quantiser) @ basis()) + 128, 0, 255).astype(np.uint8)


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """(first, behind the last) frame of each shot."""
    cuts, recent = [0], []
    steps = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / (2 * histograms[0].sum()) if len(histograms) > 1 else []
    for i, d in enumerate(map(float, steps), 1):
        mean = sum(recent) / len(recent) if recent else 0.0
        spread = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if d > max(STEP, mean + DEVIATIONS * spread):
            cuts.append(i)
            recent = []
        else:
            recent = [*recent[1 - RECENT :], d]
    return list(zip(cuts, [*cuts[1:], len(histograms)], strict=True))


def load(media: list[bytes]) -> list[tuple[bytes, list[dict]]]:
    """Payload and timed clips of each AVI file."""
    parsed = [riff_index(m) for m in media]
    frames = [f for own, _, _ in parsed for f in own]
    stored: list[bytes] = []
    counted = []
    for at in range(0, len(frames), BAND):
        decoded = decode_frames(frames[at : at + BAND])
        stored += [(c + 128).astype(np.uint8).tobytes() for c, _ in decoded]
        sizes = np.array([len(c) for c, _ in decoded])
        same = all(q is decoded[0][1] for _, q in decoded)
        grey = pixels(np.concatenate([c for c, _ in decoded]), decoded[0][1]) if same else np.concatenate([pixels(c, q) for c, q in decoded])
        frame = np.repeat(np.arange(len(decoded)), sizes)[:, None]
        counted.append(np.bincount((frame * BINS + grey // (256 // BINS)).ravel(), minlength=len(decoded) * BINS).reshape(-1, BINS))
    histograms = np.concatenate(counted) if counted else np.zeros((0, BINS), np.int64)
    out, at = [], 0
    for own, length, tick in parsed:
        end = at + len(own)
        payload = b"".join(stored[at:end])[:length]
        out.append((payload, [{"clip": i, "start_s": round(a * tick, 6), "end_s": round(b * tick, 6), "n_frames": b - a} for i, (a, b) in enumerate(shots(histograms[at:end]))]))
        at = end
    return out


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's bytes as an AVI file."""
    source = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, limit=1 << 20):
            files = store([pad(t) for t in texts])
            yield pa.record_batch([part.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(files, pa.binary())], names=[id_col, "n_bytes", "media"])

    return map_batches(source, run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, n_bytes long, media binary")


CLIPS = "array<struct<clip:int,start_s:double,end_s:double,n_frames:int>>"
_CLIPS = pa.list_(pa.struct([("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("n_frames", pa.int32())]))


def read_media(files: DataFrame, media_col: str = "media") -> DataFrame:
    """files with payload and clips read back from media_col."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, media in chunks(batches, media_col, 2 << 20):
            found = load(media)
            yield pa.record_batch([*part.columns, pa.array([p for p, _ in found], pa.binary()), pa.array([c for _, c in found], _CLIPS)], names=[*part.schema.names, "payload", "clips"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return map_batches(files, run, f"{fields}, payload binary, clips {CLIPS}")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """read_media(store_texts(docs)) in one pass: the stored bytes go to the reader as they are."""
    source = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, limit=1 << 20):
            files = store([pad(t) for t in texts])
            found = load(files)
            columns = [pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(files, pa.binary()), pa.array([p for p, _ in found], pa.binary()), pa.array([c for _, c in found], _CLIPS)]
            yield pa.record_batch([part.column(0), *columns], names=[id_col, "n_bytes", "media", "payload", "clips"])

    return map_batches(source, run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, n_bytes long, media binary, payload binary, clips {CLIPS}")


def clip_rows(read: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row per timed clip."""
    return read.select(id_col, F.explode("clips").alias("c")).select(id_col, "c.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = round_trip(table(spark, sf_dir, "documents"))
    clips = F.transform("clips", lambda c: F.format_string("%.3f-%.3f", c["start_s"], c["end_s"]))
    size = F.octet_length("payload")
    return read.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.array_join(clips, ";").alias("feature"),
    )
