"""Tables of image files: scanning, decoding to rows of pixels, staged JPEG tables, and encoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterbrook.functions import bits, tables
from rasterbrook.sources import bmp, jpeg


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, format, length, content) of the files below a folder; unless content is selected it isn't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", bits.file_signature(F.col("content")).alias("format"), "length", "content")


#: Bytes of values that are gathered before they are sent on, and of files that are decoded together.
HELD_BYTES = 8 << 20


def _map(df: DataFrame, columns: list[str], fields: dict[str, tuple[str, pa.DataType]], each: Callable[..., list[tuple]]) -> DataFrame:
    """df's other columns and the fields, a row for each tuple that each(*columns' values) returns."""
    rest = [c for c in df.columns if c not in columns and c not in fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema), *(f"{n} {t}" for n, (t, _) in fields.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.schema.get_field_index(c) for c in columns]
            kept = batch.select(rest)
            origin: list[int] = []
            values: list[list] = [[] for _ in fields]
            held = 0

            def flush(kept=kept) -> pa.RecordBatch:
                at = pa.array(origin, pa.int64())
                return pa.record_batch([*(c.take(at) for c in kept.columns), *(pa.array(v, t) for v, (_, t) in zip(values, fields.values(), strict=True))], names=[*rest, *fields])

            for i in range(batch.num_rows):  # a row at a time: an image may be large
                for row in each(*(batch.column(c)[i].as_py() for c in own)):
                    origin.append(i)
                    for column, value in zip(values, row, strict=True):
                        column.append(value)
                        held += len(value) if isinstance(value, bytes) else 8
                if held > HELD_BYTES:
                    yield flush()
                    origin, values, held = [], [[] for _ in fields], 0
            if origin:
                yield flush()

    return df.select(*rest, *columns).mapInArrow(run, schema)


IMAGE = {"width": ("int", pa.int32()), "height": ("int", pa.int32()), "data": ("binary", pa.binary()), "error": ("string", pa.string())}


def _decoded(contents: list[bytes | None]) -> list[tuple]:
    """IMAGE rows of some files; the JPEG files among them are decoded together."""
    out: list = [None] * len(contents)
    jpegs = []
    for i, content in enumerate(contents):
        content = content or b""
        if content[:3] == b"\xff\xd8\xff":
            jpegs.append(i)
            continue
        try:
            if content[:2] != b"BM":
                raise ValueError("unknown format")
            out[i] = (*bmp.decode(content), None)
        except (ValueError, IndexError) as e:
            out[i] = (None, None, None, str(e) or type(e).__name__)
    for i, found in zip(jpegs, jpeg.decode_many([contents[i] for i in jpegs]), strict=True):
        out[i] = (None, None, None, str(found) or type(found).__name__) if isinstance(found, Exception) else (*found, None)
    return out


def decode(df: DataFrame, content: str = "content") -> DataFrame:
    """df with width, height, data (interleaved RGB) and error in place of content; format by signature, no exchange."""
    rest = [c for c in df.columns if c != content and c not in IMAGE]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema), *(f"{n} {t}" for n, (t, _) in IMAGE.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(content))
            sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
            start = 0
            while start < batch.num_rows:
                end, held = start + 1, sizes[start]
                while end < batch.num_rows and held + sizes[end] <= HELD_BYTES // 8 and end - start < 1024:
                    held += sizes[end]
                    end += 1
                rows = _decoded(column.slice(start, end - start).to_pylist())
                part = batch.select(rest).slice(start, end - start)
                yield pa.record_batch([*part.columns, *(pa.array(v, t) for v, (_, t) in zip(zip(*rows, strict=True), IMAGE.values(), strict=True))], names=[*rest, *IMAGE])
                start = end

    return df.select(*rest, content).mapInArrow(run, schema)


CONTENT = {"content": ("binary", pa.binary()), "error": ("string", pa.string())}


def _encoded(encode: Callable[..., bytes]) -> Callable[..., list[tuple]]:
    """encode's file, or what is wrong with its input; a null input is an image that is missing."""

    def each(*values) -> list[tuple]:
        if any(v is None for v in values):
            return [(None, "no image")]
        try:
            return [(encode(*values), None)]
        except (ValueError, OverflowError, IndexError) as e:
            return [(None, str(e) or type(e).__name__)]

    return each


def encode_bmp(images: DataFrame) -> DataFrame:
    """images (.., width, height, data) with content, a BMP file, or error."""
    return _map(images, ["width", "height", "data"], CONTENT, _encoded(bmp.encode))


def encode_jpeg(images: DataFrame, quality: int = 90, chroma_quality: int | None = None, optimise: bool = False, interval: int = 0) -> DataFrame:
    """images (.., width, height, data) with content, a JPEG file, or error."""
    return _map(images, ["width", "height", "data"], CONTENT, _encoded(lambda w, h, d: jpeg.encode(w, h, d, quality, chroma_quality, optimise, interval)))


def pack_jpeg(images: DataFrame, h: int, v: int, quality: int = 100, interval: int = 0) -> DataFrame:
    """images (.., width, height, coef) with content, a JPEG file, or error; coef: the zigzag coefficients of all blocks in order, h x v luma blocks in an MCU."""
    steps = [jpeg.scaled(t, quality) for t in (tables.LUMA_QUANT, tables.CHROMA_QUANT)]

    def packed(width: int, height: int, coef: list[int]) -> bytes:
        return jpeg.pack(width, height, np.array(coef, np.int64).reshape(-1, h * v + 2, 64), steps, (h, v), False, interval)

    return _map(images, ["width", "height", "coef"], CONTENT, _encoded(packed))


def pixels(images: DataFrame) -> DataFrame:
    """(.., width, height, y, x, r, g, b) of decoded images, a batch of pixels at a time."""
    rest = [c for c in images.columns if c not in ("data", "error")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*rest).schema), "y int, x int, r short, g short, b short"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.select(rest)

            def rows(parts: list[tuple[int, int, np.ndarray, int]], kept=kept) -> pa.RecordBatch:
                """parts: (row, first pixel, pixels, width)."""
                size = [len(p) for _, _, p, _ in parts]
                origin = pa.array(np.repeat([i for i, *_ in parts], size))
                at = np.concatenate([np.arange(a, a + len(p)) for _, a, p, _ in parts])
                width = np.repeat([w for *_, w in parts], size)
                rgb = np.concatenate([p for _, _, p, _ in parts])
                place = [pa.array((at // width).astype(np.int32)), pa.array((at % width).astype(np.int32))]
                return pa.record_batch([*(c.take(origin) for c in kept.columns), *place, *(pa.array(rgb[:, c]) for c in range(3))], names=[*rest, "y", "x", "r", "g", "b"])

            parts, held = [], 0
            for i in range(batch.num_rows):
                data = batch.column("data")[i].as_py()
                if data is None:
                    continue
                rgb = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int16)
                for a in range(0, len(rgb), 1 << 16):
                    parts.append((i, a, rgb[a : a + (1 << 16)], batch.column("width")[i].as_py()))
                    held += len(parts[-1][2])
                    if held >= 1 << 16:
                        yield rows(parts)
                        parts, held = [], 0
            if parts:
                yield rows(parts)

    return images.select(*rest, "data").mapInArrow(run, schema)


# Staged JPEG tables, for images whose restart segments are worth spreading over tasks


def jpeg_segments(df: DataFrame, content: str = "content") -> DataFrame:
    """A row per marker segment: seq, offset, marker, payload, error (a row alone)."""
    fields = {"seq": ("int", pa.int32()), "offset": ("long", pa.int64()), "marker": ("int", pa.int32()), "payload": ("binary", pa.binary()), "error": ("string", pa.string())}

    def each(data: bytes | None) -> list[tuple]:
        try:
            return [(i, *s, None) for i, s in enumerate(jpeg.segments(data or b""))]
        except (ValueError, IndexError) as e:
            return [(None, None, None, None, str(e))]

    return _map(df, [content], fields, each)


def jpeg_quant_tables(segments: DataFrame) -> DataFrame:
    """(.., dest, k, q) of DQT segments, k in natural order; each segment's offset is its version."""
    fields = {"dest": ("int", pa.int32()), "k": ("int", pa.int32()), "q": ("int", pa.int32())}
    return _map(segments.filter(F.col("marker") == jpeg.DQT).drop("error", "seq", "marker"), ["payload"], fields, lambda p: [(d, k, int(q)) for d, t in jpeg.quant_tables(p) for k, q in enumerate(t)])


def jpeg_huffman_tables(segments: DataFrame) -> DataFrame:
    """(.., class, dest, ord, len, symbol) of DHT segments."""
    fields = {n: ("int", pa.int32()) for n in ("class", "dest", "ord", "len", "symbol")}

    def each(payload: bytes) -> list[tuple]:
        out = []
        for kind, dest, counts, symbols in jpeg.huffman_tables(payload):
            sizes = [n for n, c in enumerate(counts, 1) for _ in range(c)]
            out += [(kind, dest, i, n, s) for i, (n, s) in enumerate(zip(sizes, symbols, strict=True))]
        return out

    return _map(segments.filter(F.col("marker") == jpeg.DHT).drop("error", "seq", "marker"), ["payload"], fields, each)


def restart_segments(df: DataFrame, content: str = "content") -> DataFrame:
    """A row per restart segment: seg, mcu_start, mcu_count, bytes, tables (its scan's header segments), error.

    Each row decodes alone, so they may be repartitioned by (image, seg).
    """
    fields = {"seg": ("int", pa.int32()), "mcu_start": ("int", pa.int32()), "mcu_count": ("int", pa.int32()), "bytes": ("binary", pa.binary()), "head": ("binary", pa.binary()), "error": ("string", pa.string())}

    def each(data: bytes | None) -> list[tuple]:
        try:
            found = jpeg.parse(data or b"")
            _, _, _, across, down = jpeg.layout(found)
            total = across * down
            step = found["scan"]["interval"] or total
            starts = range(0, total, step)
            if len(starts) != len(found["scan"]["segments"]):
                raise ValueError("the number of restart segments is wrong")
            scan = next(o for o, m, _ in jpeg.segments(data) if m == jpeg.SOS)
            size = int.from_bytes(data[scan + 2 : scan + 4], "big")
            head = data[: scan + 2 + size]
            return [(i, a, min(step, total - a), b, head, None) for i, (a, b) in enumerate(zip(starts, found["scan"]["segments"], strict=True))]
        except (ValueError, IndexError) as e:
            return [(None, None, None, None, None, str(e))]

    return _map(df, [content], fields, each)


@lru_cache(maxsize=64)
def _scan_of(head: bytes) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """Components of an MCU's blocks, and DC and AC look-ups by component, of a file's bytes up to its scan."""
    found = jpeg.parse(head + b"\xff\xd9")  # an empty scan stands for the file's
    own = {c: (jpeg.lookup(*d), jpeg.lookup(*a)) for c, d, a, _ in found["scan"]["parts"]}
    return jpeg.layout(found)[0], [own[c][0] for c in range(3)], [own[c][1] for c in range(3)]


def _decoded_segments(parts: list[bytes | None], counts: list[int], heads: list[bytes]) -> list[np.ndarray | str]:
    """(mcus, blocks, 64) of each segment, or what is wrong with it; all segments go in step."""
    out: list = [None] * len(parts)
    tasks, places = [], []
    for i, (part, head) in enumerate(zip(parts, heads, strict=True)):
        try:
            pattern, dc, ac = _scan_of(head)
            tasks.append((part or b"", counts[i], tuple(pattern), dc, ac))
            places.append(i)
        except (ValueError, TypeError) as e:
            out[i] = str(e) or type(e).__name__
    for i, found in zip(places, jpeg.decode_tasks(tasks), strict=True):
        out[i] = str(found) if isinstance(found, ValueError) else found
    return out


def decode_restart_segments(segments: DataFrame) -> DataFrame:
    """A row per block: mcu, comp (0 Y, 1 Cb, 2 Cr), block, coef (zigzag order); a broken segment is a row with its first mcu and error. All segments of a batch go in step."""
    own = ["mcu_start", "mcu_count", "bytes", "head"]
    source = segments.filter("error IS NULL").drop("error")
    rest = [c for c in source.columns if c not in own]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*rest).schema), "mcu int, comp int, block int, coef array<int>, error string"])

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        start, count, data, head = (part.column(c).to_pylist() for c in own)
        origin, place, comp, turn, flat, errors = [], [], [], [], [], []
        sizes = []
        for i, mcus in enumerate(_decoded_segments(data, count, head)):
            if isinstance(mcus, str):
                n, coef = 1, np.zeros(0, np.int16)
                place.append([start[i]])
                comp.append([-1])
                turn.append([-1])
                errors += [mcus]
            else:
                pattern = _scan_of(head[i])[0]
                n, coef = len(mcus) * len(pattern), mcus.ravel()
                place.append(np.repeat(np.arange(start[i], start[i] + len(mcus)), len(pattern)))
                comp.append(np.tile(pattern, len(mcus)))
                turn.append(np.tile([pattern[:b].count(c) for b, c in enumerate(pattern)], len(mcus)))
                errors += [None] * n
            origin.append(np.full(n, i))
            sizes.append(np.full(n, len(coef) // n))
            flat.append(coef)
        at, place, comp, turn, sizes = (np.concatenate(x).astype(np.int32) for x in (origin, place, comp, turn, sizes))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.concatenate(flat).astype(np.int32)), mask=pa.array(sizes == 0))
        gone = comp < 0
        return pa.record_batch([*(part.column(c).take(pa.array(at)) for c in rest), pa.array(place), pa.array(comp, mask=gone), pa.array(turn, mask=gone), lists, pa.array(errors, pa.string())], names=[*rest, "mcu", "comp", "block", "coef", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mcus = np.cumsum(batch.column("mcu_count").to_numpy(zero_copy_only=False))
            a = 0
            while a < batch.num_rows:  # about HELD_BYTES of coefficients at a time
                b = max(a + 1, int(np.searchsorted(mcus, (mcus[a - 1] if a else 0) + HELD_BYTES // 1024)))
                yield rows(batch.slice(a, b - a))
                a = b

    return source.select(*rest, *own).mapInArrow(run, schema)
