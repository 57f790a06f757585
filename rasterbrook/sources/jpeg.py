"""Baseline JPEG files: marker parsing, entropy decoding of restart segments in step, colour, and encoding.

Three components, eight bits, one scan, at most the first component sampled
more finely. Whatever else is met raises ValueError, which the DataFrame
functions turn into an error column.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

from rasterbrook.functions import tables
from rasterbrook.operators import huffman
from rasterbrook.sources import entropy

SOI, EOI, SOS, DQT, DHT, DRI, DNL, COM, SOF0 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xDC, 0xFE, 0xC0
_ZIGZAG = np.array(tables.ZIGZAG)
_BASIS = np.array([[tables.dct_weight(k, p) for p in range(64)] for k in range(64)])


def segments(data: bytes) -> list[tuple[int, int, bytes]]:
    """(offset, marker, payload) in order; a scan's entropy bytes follow its header in the payload."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG signature")
    out, at = [(0, SOI, b"")], 2
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError(f"a marker is missing at {at}")
        start = at
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            break
        marker = data[at]
        at += 1
        if marker == EOI:
            out.append((start, EOI, b""))
            if at != len(data):
                raise ValueError("bytes after the end of the image")
            return out
        if at + 2 > len(data):
            break
        size = struct.unpack_from(">H", data, at)[0]
        if size < 2 or at + size > len(data):
            raise ValueError(f"segment {marker:02X} is cut short")
        end = at + size
        if marker == SOS:
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise ValueError("the scan has no end")
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                elif data[end + 1] == 0xFF:
                    end += 1
                else:
                    break
        out.append((start, marker, data[at + 2 : end]))
        at = end
    raise ValueError("no end of the image")


def quant_tables(payload: bytes) -> list[tuple[int, np.ndarray]]:
    """(destination, 64 steps in natural order) of a DQT segment."""
    out = []
    while payload:
        wide, dest = payload[0] >> 4, payload[0] & 15
        size = 64 * (1 + wide)
        if wide > 1 or dest > 3 or len(payload) < 1 + size:
            raise ValueError("bad quantisation table")
        steps = np.zeros(64)
        steps[_ZIGZAG] = np.frombuffer(payload[1 : 1 + size], ">u2" if wide else np.uint8)
        out.append((dest, steps))
        payload = payload[1 + size :]
    return out


def huffman_tables(payload: bytes) -> list[tuple[int, int, tuple[int, ...], tuple[int, ...]]]:
    """(class, destination, counts by length, symbols) of a DHT segment."""
    out = []
    while payload:
        kind, dest = payload[0] >> 4, payload[0] & 15
        counts = tuple(payload[1:17])
        n = sum(counts)
        if kind > 1 or dest > 3 or len(counts) < 16 or len(payload) < 17 + n:
            raise ValueError("bad Huffman table")
        out.append((kind, dest, counts, tuple(payload[17 : 17 + n])))
        payload = payload[17 + n :]
    return out


def frame(payload: bytes) -> dict:
    if len(payload) < 6:
        raise ValueError("the frame header is cut short")
    precision, height, width, n = struct.unpack_from(">BHHB", payload)
    if precision != 8:
        raise ValueError("only eight-bit samples are read")
    if not 1 <= n <= 4 or len(payload) != 6 + 3 * n:
        raise ValueError("bad frame header")
    parts = [(payload[6 + 3 * i], payload[7 + 3 * i] >> 4, payload[7 + 3 * i] & 15, payload[8 + 3 * i]) for i in range(n)]
    if any(not (1 <= h <= 4 and 1 <= v <= 4 and q <= 3) for _, h, v, q in parts):
        raise ValueError("bad frame component")
    if n != 3:
        raise ValueError("three components are needed")
    fine = [i for i, (_, h, v, _) in enumerate(parts) if h * v > 1]
    if len(fine) > 1:
        raise ValueError("more than one component is subsampled")
    if fine and fine[0]:
        raise ValueError("the subsampled component is not the first")
    return {"width": width, "height": height, "components": parts}


def restart_parts(entropy: bytes) -> list[bytes]:
    """Entropy bytes cut at restart markers, which must count up modulo eight, without stuffing."""
    data = np.frombuffer(entropy, np.uint8)
    ff = np.flatnonzero(data[:-1] == 0xFF) if len(data) > 1 else np.zeros(0, np.int64)
    rst = ff[(data[ff + 1] >= 0xD0) & (data[ff + 1] <= 0xD7)]
    if (data[rst + 1] != 0xD0 + np.arange(len(rst)) % 8).any():
        raise ValueError("restart markers out of order")
    cuts = np.concatenate(([0], rst + 2))
    ends = np.concatenate((rst, [len(data)]))
    return [entropy[a:b].replace(b"\xff\x00", b"\xff") for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]


def _short(payload: bytes, what: str) -> int:
    """The number of a segment that has two bytes."""
    if len(payload) != 2:
        raise ValueError(f"bad {what}")
    return struct.unpack(">H", payload)[0]


def parse(data: bytes) -> dict:
    """All that decoding needs, with the newest tables before the scan, and comments."""
    quant: dict[int, np.ndarray] = {}
    coding: dict[tuple[int, int], tuple] = {}
    found: dict = {"comments": [], "scan": None, "frame": None}
    interval = 0
    for _, marker, payload in segments(data):
        if marker == DQT:
            quant.update(quant_tables(payload))
        elif marker == DHT:
            coding.update({(kind, dest): (counts, symbols) for kind, dest, counts, symbols in huffman_tables(payload)})
        elif marker == SOF0:
            if found["frame"]:
                raise ValueError("more than one frame")
            found["frame"] = frame(payload)
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only baseline frames are read")
        elif marker == DRI:
            interval = _short(payload, "restart interval")
        elif marker == COM:
            found["comments"].append(payload.decode("latin-1"))
        elif marker == DNL and found["frame"]:
            found["frame"]["height"] = _short(payload, "number of lines")
        elif marker == SOS:
            if not found["frame"]:
                raise ValueError("a scan before the frame")
            if found["scan"]:
                raise ValueError("more than one scan")
            n = payload[0] if payload else 0
            if n != 3 or len(payload) < 4 + 2 * n:
                raise ValueError("bad scan header")
            own = {c[0]: i for i, c in enumerate(found["frame"]["components"])}
            parts = []
            for i in range(n):
                name, sel = payload[1 + 2 * i], payload[2 + 2 * i]
                if name not in own:
                    raise ValueError("the scan names no component of the frame")
                part = found["frame"]["components"][own[name]]
                try:
                    parts.append((own[name], coding[0, sel >> 4], coding[1, sel & 15], quant[part[3]]))
                except KeyError:
                    raise ValueError("the scan needs a table that is not defined") from None
            found["scan"] = {"parts": parts, "interval": interval, "segments": restart_parts(payload[4 + 2 * n :])}
    if not found["frame"] or not found["scan"]:
        raise ValueError("no frame or no scan")
    if not found["frame"]["width"] or not found["frame"]["height"]:
        raise ValueError("no size")
    return found


@lru_cache(maxsize=256)
def lookup(counts: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """Length and symbol (length << 8 | symbol) of each 16-bit word; 0 where there is no code."""
    out = np.zeros(1 << 16, np.uint16)
    for symbol, (code, size) in tables.codes(list(counts), list(symbols)).items():
        out[code << 16 - size : code + 1 << 16 - size] = size << 8 | symbol
    return out


def decode_tasks(tasks: list[tuple]) -> list[np.ndarray | ValueError]:
    """(mcus, blocks of an MCU, 64) zigzag coefficients of each segment, or what is wrong with it; all go in step, long ones in chunks.

    A task is (segment, its MCUs, the component of each block of an MCU, look-ups by component of DC and AC).
    """
    if not tasks:
        return []
    parts, n_mcus, patterns, dc, ac = zip(*tasks, strict=True)
    return entropy.decode(entropy.Streams(parts, patterns, dc, ac), np.array(n_mcus, np.int64))


def decode_segments(parts: list[bytes], n_mcus: list[int], pattern: list[int], dc: list[list[np.ndarray]], ac: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The same for segments of one pattern; raises what is wrong with the first that is broken."""
    found = decode_tasks([(p, n, tuple(pattern), d, a) for p, n, d, a in zip(parts, n_mcus, dc, ac, strict=True)])
    for x in found:
        if isinstance(x, ValueError):
            raise x
    return found


huffman_zrl = 0xF0


def layout(found: dict) -> tuple[list[int], int, int, int, int]:
    """Components of an MCU's blocks in scan order, luma's h and v, MCUs in a row and rows of them."""
    _, h, v, _ = found["frame"]["components"][0]
    pattern = [c for c, *_ in found["scan"]["parts"] for _ in range(h * v if c == 0 else 1)]
    wide, high = found["frame"]["width"], found["frame"]["height"]
    return pattern, h, v, -(-wide // (8 * h)), -(-high // (8 * v))


def _tasks(found: dict) -> list[tuple]:
    """(segment, its MCUs, pattern, look-ups by component of DC and AC) as decode_tasks takes them."""
    pattern, _, _, across, down = layout(found)
    scan = found["scan"]
    total = across * down
    each = scan["interval"] or total
    if -(-total // each) != len(scan["segments"]):
        raise ValueError("the number of restart segments is wrong")
    if any(min(each, total - i * each) * len(pattern) * 2 > 8 * len(p) for i, p in enumerate(scan["segments"])):
        raise ValueError("a segment is cut short")  # a block takes two bits at least
    if found["frame"]["width"] * found["frame"]["height"] * 3 > MOST_BYTES:
        raise ValueError("the image is too large")
    tables_of = {c: (lookup(*d), lookup(*a)) for c, d, a, _ in scan["parts"]}
    dc, ac = ([tables_of[c][kind] for c in range(3)] for kind in (0, 1))
    return [(p, min(each, total - i * each), tuple(pattern), dc, ac) for i, p in enumerate(scan["segments"])]


def coefficients(found: dict) -> np.ndarray:
    """(mcus, blocks, 64) in zigzag order."""
    parts = decode_tasks(_tasks(found))
    for x in parts:
        if isinstance(x, ValueError):
            raise x
    return np.concatenate(parts)


#: Bytes of a decoded image, as a row can hold them.
MOST_BYTES = (1 << 31) - 1
#: Blocks that are transformed at once; blocks and look-ups of files that are decoded together.
BAND, GROUP, MOST_TABLES = 1 << 14, 1 << 17, 256


def to_rgb(found: dict, coded: list[np.ndarray]) -> bytes:
    """Interleaved RGB of zigzag coefficients, given in stretches of MCUs: steps, inverse DCT, nearest chroma, colour, crop, truncation; some rows of MCUs at a time."""
    pattern, h, v, across, down = layout(found)
    steps = {c: q for c, _, _, q in found["scan"]["parts"]}
    scale = np.stack([steps[c] for c in pattern])
    wide, high = found["frame"]["width"], found["frame"]["height"]
    whole = coded[0] if len(coded) == 1 else np.concatenate(coded)
    out = np.empty((high, wide, 3), np.uint8)
    rows = max(1, BAND // (across * len(pattern)))
    for top in range(0, down, rows):
        own = whole[top * across : (top + rows) * across]
        n = len(own) // across
        natural = np.zeros(own.shape)
        natural[:, :, _ZIGZAG] = own
        natural *= scale
        samples = natural @ _BASIS
        blocks = {c: samples[:, [i for i, p in enumerate(pattern) if p == c]] for c in range(3)}

        def plane(x: np.ndarray, ph: int, pv: int, n: int = n) -> np.ndarray:
            return x.reshape(n, across, pv, ph, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(n * pv * 8, across * ph * 8)

        luma = plane(blocks[0], h, v) + 128
        cb, cr = (plane(blocks[c], 1, 1).repeat(v, 0).repeat(h, 1) for c in (1, 2))
        rgb = np.stack((luma + 1.402 * cr, luma - 0.344 * cb - 0.714 * cr, luma + 1.772 * cb), axis=2)
        # sums that miss a whole number by less than half a millionth are that number, as in the queries' SQL
        rgb = np.floor(np.round(np.clip(rgb, 0, 255), 6)).astype(np.uint8)
        at = top * v * 8
        out[at : at + n * v * 8] = rgb[: high - at, :wide]
    return out.tobytes()


def decode(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and interleaved RGB."""
    found = decode_many([data])[0]
    if isinstance(found, Exception):
        raise found
    return found


def decode_many(files: list[bytes]) -> list[tuple[int, int, bytes] | Exception]:
    """decode of each file, or what it raises; the segments of some files go in step."""
    out: list = [None] * len(files)
    held: list[tuple[int, dict, list[tuple]]] = []

    def flush() -> None:
        parts = decode_tasks([t for _, _, own in held for t in own])
        at = 0
        for i, found, own in held:
            mine = parts[at : at + len(own)]
            at += len(own)
            wrong = next((p for p in mine if isinstance(p, ValueError)), None)
            out[i] = wrong or (found["frame"]["width"], found["frame"]["height"], to_rgb(found, mine))
        held.clear()

    blocks, own_tables = 0, set()
    for i, data in enumerate(files):
        try:
            found = parse(data)
            own = _tasks(found)
        except ValueError as e:
            out[i] = e
            continue
        blocks += sum(n * len(pattern) for _, n, pattern, _, _ in own)
        own_tables |= {id(t) for _, _, _, *kinds in own for row in kinds for t in row}
        if held and (blocks > GROUP or len(own_tables) > MOST_TABLES):
            flush()
            blocks, own_tables = 0, set()
        held.append((i, found, own))
    flush()
    return out


# Encoding


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def scaled(base: list[int], quality: int) -> np.ndarray:
    """A base table at a quality of 1 to 100."""
    quality = min(100, max(1, quality))
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.floor(np.clip(np.array(base) * scale / 100, 1, 255) + 0.5)


def blocks_of(width: int, height: int, rgb: bytes) -> np.ndarray:
    """(mcus, 3, 64) samples less 128 of Y, Cb and Cr; the last column and row are repeated to whole blocks."""
    x = np.frombuffer(rgb, np.uint8).reshape(height, width, 3).astype(np.float64)
    x = np.pad(x, ((0, -height % 8), (0, -width % 8), (0, 0)), mode="edge")
    r, g, b = x[:, :, 0], x[:, :, 1], x[:, :, 2]
    planes = np.stack((0.299 * r + 0.587 * g + 0.114 * b - 128, -0.168736 * r - 0.331264 * g + 0.5 * b, 0.5 * r - 0.418688 * g - 0.081312 * b))
    down, across = x.shape[0] // 8, x.shape[1] // 8
    return planes.reshape(3, down, 8, across, 8).transpose(1, 3, 0, 2, 4).reshape(down * across, 3, 64)


def symbols_of(coded: np.ndarray, interval: int, pattern: list[int]) -> tuple[np.ndarray, ...]:
    """(block, symbol, value, is_dc) of (mcus, blocks, 64) zigzag coefficients, in order; pattern: each block's component."""
    mcus = len(coded)
    flat = coded.reshape(-1, 64)
    component = np.tile(pattern, mcus)
    run = np.repeat(np.arange(mcus) // (interval or mcus), len(pattern))
    delta = flat[:, 0].copy()
    for c in set(pattern):
        own = np.flatnonzero(component == c)
        same = run[own[1:]] == run[own[:-1]]
        delta[own[1:][same]] -= flat[own[:-1][same], 0]
    block, k = np.nonzero(flat[:, 1:])
    k = k + 1
    value = flat[block, k]
    same = np.r_[False, block[1:] == block[:-1]] if len(block) else np.zeros(0, bool)
    gap = k - np.where(same, np.r_[0, k[:-1]] if len(k) else 0, 0) - 1
    size = np.frexp(np.abs(value).astype(float))[1]
    zeros = gap // 16
    rows = [(np.arange(len(flat)), np.zeros(len(flat), int), np.frexp(np.abs(delta).astype(float))[1], delta, np.ones(len(flat), bool))]
    rows.append((block, 4 * k + 3, gap % 16 << 4 | size, value, np.zeros(len(block), bool)))
    far = np.repeat(np.arange(len(block)), zeros)
    turn = np.arange(len(far)) - np.repeat(np.cumsum(zeros) - zeros, zeros)
    rows.append((block[far], 4 * k[far] + turn, np.full(len(far), huffman_zrl), np.zeros(len(far), int), np.zeros(len(far), bool)))
    open_ = np.flatnonzero(flat[:, 63] == 0)
    rows.append((open_, np.full(len(open_), 999), np.zeros(len(open_), int), np.zeros(len(open_), int), np.zeros(len(open_), bool)))
    block, place, symbol, value, is_dc = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((place, block))
    return block[order], symbol[order], value[order], is_dc[order]


def encode(width: int, height: int, rgb: bytes, quality: int = 90, chroma_quality: int | None = None, optimise: bool = False, interval: int = 0) -> bytes:
    """A 4:4:4 baseline file; with optimise, Huffman tables are made for the image, and tables are always written."""
    if len(rgb) != width * height * 3 or not (0 < width < 65536 and 0 < height < 65536):
        raise ValueError("size and pixels differ")
    steps = [scaled(tables.LUMA_QUANT, quality), scaled(tables.CHROMA_QUANT, chroma_quality or quality)]
    c = blocks_of(width, height, rgb) @ _BASIS.T / np.stack((steps[0], steps[1], steps[1]))
    c = np.round(c, 6)
    coded = (np.sign(c) * np.floor(np.abs(c) + 0.5)).astype(np.int64)[:, :, _ZIGZAG]
    return pack(width, height, coded, steps, (1, 1), optimise, interval)


def pack(width: int, height: int, coded: np.ndarray, steps: list[np.ndarray], sampling: tuple[int, int], optimise: bool = False, interval: int = 0) -> bytes:
    """A file of (mcus, blocks, 64) zigzag coefficients: sampling's h x v blocks of Y, then Cb and Cr; steps of luma and chroma."""
    h, v = sampling
    pattern = [0] * (h * v) + [1, 2]
    if coded.shape[1:] != (len(pattern), 64) or len(coded) != -(-width // (8 * h)) * -(-height // (8 * v)):
        raise ValueError("size and blocks differ")
    if not (0 < width < 65536 and 0 < height < 65536):
        raise ValueError("a side is 1 to 65,535 pixels")
    block, symbol, value, is_dc = symbols_of(coded, interval, pattern)
    kind = np.where(np.array(pattern)[block % len(pattern)] == 0, 0, 2) + ~is_dc  # luma DC, luma AC, chroma DC, chroma AC
    chosen = []
    for i, name in enumerate(("luma_dc", "luma_ac", "chroma_dc", "chroma_ac")):
        _, counts, symbols = tables.HUFFMAN[name]
        if optimise:
            n = np.bincount(symbol[kind == i], minlength=256)
            frequency = {s: int(x) for s, x in enumerate(n) if x}
            counts = huffman.limited(huffman.merged_sizes(frequency))
            symbols = sorted(frequency, key=lambda s, f=frequency: (-f[s], s))
        chosen.append((counts, symbols))
    code, size = np.zeros((4, 256), np.int64), np.zeros((4, 256), np.int64)
    for i, t in enumerate(chosen):
        for s, (x, n) in tables.codes(*map(list, t)).items():
            code[i, s], size[i, s] = x, n
    s = symbol & 15
    word = code[kind, symbol] << s | np.where(value > 0, value, value - 1 + (1 << s))
    length = size[kind, symbol] + s
    each = (interval or len(coded)) * len(pattern)
    scan = []
    cuts = np.searchsorted(block, np.arange(0, len(coded) * len(pattern), each)).tolist() + [len(block)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        n = length[a:b]
        turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        bits = np.repeat(word[a:b], n) >> (np.repeat(n, n) - 1 - turn) & 1
        bits = np.concatenate((bits, np.ones(-len(bits) % 8, np.int64))).astype(np.uint8)
        scan.append((b"" if not i else bytes([0xFF, 0xD0 + (i - 1) % 8])) + np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00"))
    quant = b"".join(_segment(DQT, bytes([i]) + q[_ZIGZAG].astype(np.uint8).tobytes()) for i, q in enumerate(steps))
    coding = b"".join(_segment(DHT, bytes([(i & 1) << 4 | i >> 1, *counts, *symbols])) for i, (counts, symbols) in enumerate(chosen))
    head = struct.pack(">BHHB", 8, height, width, 3) + bytes([1, h << 4 | v, 0, 2, 0x11, 1, 3, 0x11, 1])
    restart = _segment(DRI, struct.pack(">H", interval)) if interval else b""
    return b"\xff\xd8" + quant + coding + _segment(SOF0, head) + restart + _segment(SOS, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + b"".join(scan) + b"\xff\xd9"
