"""BMP files. Headers are read by Column expressions; rasters by array code, a file at a time."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterbrook.functions import bits, codec

UNSUPPORTED = ("rgb16", "rle4", "rle8")


def header(content: Column) -> Column:
    """Struct of both headers' fields. A core header has 12 bytes and 16-bit sizes, an info header 40 and 32-bit ones."""
    core = bits.le_uint(content, 14, 4) == 12

    def either(at_core: Column, at_info: Column) -> Column:
        return F.when(core, at_core).otherwise(at_info)

    return F.struct(
        bits.le_uint(content, 2, 4).alias("file_size"),
        bits.le_uint(content, 10, 4).alias("data_offset"),
        bits.le_uint(content, 14, 4).alias("header_size"),
        either(bits.le_uint(content, 18, 2), bits.le_int32(content, 18)).cast("int").alias("width"),
        either(bits.le_uint(content, 20, 2), bits.le_int32(content, 22)).cast("int").alias("height"),
        either(bits.le_uint(content, 24, 2), bits.le_uint(content, 28, 2)).cast("int").alias("bit_count"),
        either(F.lit(0).cast("long"), bits.le_uint(content, 30, 4)).alias("compression"),
        either(F.lit(0).cast("long"), bits.le_uint(content, 46, 4)).alias("colors_used"),
    )


def with_header(files: DataFrame, content: str = "content") -> DataFrame:
    """files with header, encoding and error; nothing but the header's bytes is looked at."""
    h = F.col("header")
    # exploded, so that its fields are read once and not wherever one of them is named
    staged = files.select(*(c for c in files.columns if c != "header"), F.explode(F.array(header(F.col(content)))).alias("header"))
    staged = staged.withColumn("encoding", codec.raster_encoding(h["bit_count"], h["compression"]))
    error = (
        F.when(~bits.matches(F.col(content), "424D"), "no BMP signature")
        .when(h["header_size"].isNull() | ~h["header_size"].isin(12, 40), "unknown header size")
        .when(h["width"].isNull() | h["height"].isNull() | (h["width"] <= 0) | (h["height"] == 0), "no size")
        .when(F.col("encoding").isin(*UNSUPPORTED), F.concat(F.lit("raster encoding is not supported: "), "encoding"))
        .when(F.col("encoding") == "none", "unknown raster encoding")
    )
    return staged.withColumn("error", error)


def palette(files: DataFrame, id_col: str, content: str = "content") -> DataFrame:
    """(id, idx, r, g, b) of files with a header that have a colour table; entries are 3 bytes behind a core header, else 4."""
    h = F.col("header")
    colors = codec.num_colors(h["bit_count"])
    n = F.when((h["header_size"] == 40) & (h["colors_used"] > 0), F.least(h["colors_used"], colors)).otherwise(colors).cast("int")
    size = F.when(h["header_size"] == 12, 3).otherwise(4)
    rows = files.filter((F.col("error").isNull()) & (colors > 0)).select(id_col, content, size.alias("size"), (14 + h["header_size"]).alias("start"), F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"))
    at = (F.col("start") + F.col("idx") * F.col("size")).cast("int")
    return rows.select(id_col, "idx", *(bits.byte_at(F.col(content), at + i).cast("int").alias(c) for c, i in (("r", 2), ("g", 1), ("b", 0))))


def decode(content: bytes) -> tuple[int, int, bytes]:
    """Width, height and interleaved RGB of a file, top row first; ValueError says what is wrong."""
    if content[:2] != b"BM":
        raise ValueError("no BMP signature")
    if len(content) < 26:
        raise ValueError("the header is cut short")
    offset, size = struct.unpack_from("<II", content, 10)
    if size == 12:
        width, height, _, depth = struct.unpack_from("<HHHH", content, 18)
        compression = used = 0
    elif size == 40 and len(content) >= 54:
        width, height, _, depth, compression = struct.unpack_from("<iiHHI", content, 18)
        used = struct.unpack_from("<I", content, 46)[0]
    else:
        raise ValueError("unknown header size")
    top_down, height = height < 0, abs(height)
    if width <= 0 or height == 0:
        raise ValueError("no size")
    if (depth, compression) in ((16, 0), (4, 2), (8, 1)):
        raise ValueError("raster encoding is not supported")
    if depth not in (1, 4, 8, 24) or compression:
        raise ValueError("unknown raster encoding")
    stride = (depth * width + 31) // 32 * 4
    if len(content) < offset + stride * (height - 1) + (depth * width + 7) // 8:
        raise ValueError("the raster is cut short")
    raster = np.frombuffer(content[offset : offset + stride * height].ljust(stride * height, b"\0"), np.uint8).reshape(height, stride)
    if depth == 24:
        rgb = raster[:, : 3 * width].reshape(height, width, 3)[:, :, ::-1]
    else:
        colors = min(used, 1 << depth) if used else 1 << depth
        entry = 3 if size == 12 else 4
        table = np.frombuffer(content[14 + size : 14 + size + colors * entry], np.uint8)
        if len(table) < colors * entry:
            raise ValueError("the colour table is cut short")
        table = table.reshape(-1, entry)[:, 2::-1]
        if depth < 8:
            per = 8 // depth
            shifts = np.arange(per - 1, -1, -1) * depth
            raster = (raster[:, :, None] >> shifts & (1 << depth) - 1).reshape(height, -1)
        index = raster[:, :width]
        if index.max() >= len(table):
            raise ValueError("a colour index beyond the table")
        rgb = table[index]
    return width, height, np.ascontiguousarray(rgb if top_down else rgb[::-1]).tobytes()


def encode(width: int, height: int, rgb: bytes) -> bytes:
    """A 24-bit file of interleaved RGB, bottom row first, rows filled to four bytes; a core header if sizes fit in 16 bits."""
    if len(rgb) != width * height * 3 or width < 1 or height < 1:
        raise ValueError("size and pixels differ")
    rows = np.frombuffer(rgb, np.uint8).reshape(height, width, 3)[::-1, :, ::-1].reshape(height, -1)
    raster = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4))).tobytes()
    if max(width, height) < 1 << 16:
        info = struct.pack("<IHHHH", 12, width, height, 1, 24)
    else:
        info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(raster), 0, 0, 0, 0)
    offset = 14 + len(info)
    return b"BM" + struct.pack("<III", offset + len(raster), 0, offset) + info + raster
