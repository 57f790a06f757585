"""Codec arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _shl(a: Column, n: Column) -> Column:
    return F.call_function("shiftleft", a, n.cast("int"))


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Luma is shifted by -128."""
    return {
        "y": 0.299 * r + 0.587 * g + 0.114 * b - 128,
        "cb": -0.168736 * r - 0.331264 * g + 0.5 * b,
        "cr": 0.5 * r - 0.418688 * g - 0.081312 * b,
    }


def clamp(v: Column, low: float = 0.0, high: float = 255.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> dict[str, Column]:
    """Clamped to 0..255; fractions are kept."""
    y = y + 128
    return {"r": clamp(y + 1.402 * cr), "g": clamp(y - 0.344 * cb - 0.714 * cr), "b": clamp(y + 1.772 * cb)}


def to_byte(v: Column) -> Column:
    """Truncated, as samples are stored."""
    return F.floor(v).cast("int")


def quant_step(base: Column, quality: Column) -> Column:
    """A base quantiser's step at a quality, which is brought into 1..100."""
    q = F.greatest(F.lit(1), F.least(F.lit(100), quality)).cast("int")
    scale = F.when(q < 50, F.floor(5000 / q)).otherwise(200 - 2 * q)
    return F.round(clamp(base * scale / 100.0, 1.0, 255.0)).cast("int")


def quantise(coefficient: Column, step: Column) -> Column:
    """Rounded half away from zero; sums are first rounded to six places, so their order doesn't matter."""
    return F.round(F.round(coefficient, 6) / step).cast("int")


def ssss(v: Column) -> Column:
    """Magnitude category; 0 for zero."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v)))).cast("int")


def ssss_encode(size: Column, v: Column) -> Column:
    """The bits that stand for v in its category, as a number."""
    return F.when(v > 0, v).otherwise(v - 1 + _shl(F.lit(1), size)).cast("int")


def ssss_decode(size: Column, bits: Column) -> Column:
    """The value that a category's bits stand for; category 0 is zero."""
    half = _shl(F.lit(1), F.greatest(size - 1, F.lit(0)))
    return F.when(size == 0, 0).when(bits < half, bits - _shl(F.lit(1), size) + 1).otherwise(bits).cast("int")


def is_eob(run: Column, size: Column) -> Column:
    return (run == 0) & (size == 0)


def is_zrl(run: Column, size: Column) -> Column:
    return (run == 15) & (size == 0)


def row_size(bits: Column, width: Column) -> Column:
    """Bytes of a BMP row, filled to four."""
    return (F.floor((bits * width + 31) / 32) * 4).cast("long")


def num_colors(bits: Column) -> Column:
    return F.when(bits == 1, 2).when(bits == 4, 16).when(bits == 8, 256).otherwise(-1)


def raster_encoding(bits: Column, compression: Column) -> Column:
    """Name of a BMP raster's encoding, or none."""
    plain = compression == 0
    return (
        F.when(plain & (bits == 1), "monochrome")
        .when(plain & (bits == 4), "indexed4")
        .when(plain & (bits == 8), "indexed8")
        .when(plain & (bits == 16), "rgb16")
        .when(plain & (bits == 24), "rgb24")
        .when((compression == 2) & (bits == 4), "rle4")
        .when((compression == 1) & (bits == 8), "rle8")
        .otherwise("none")
    )


def chroma_index(block: Column, pixel: Column, h: Column, v: Column) -> Column:
    """Sample of the chroma block that a pixel of a luma block takes; nearest, rounded down."""
    row = F.floor(block / h) * 8 + F.floor(pixel / 8)
    col = (block % h) * 8 + pixel % 8
    return (F.floor(row / v) * 8 + F.floor(col / h)).cast("int")


def next_restart(marker: Column) -> Column:
    return (marker - 0xD0 + 1) % 8 + 0xD0


def ndc(v: Column, span: Column) -> Column:
    """A pixel place in normalised device coordinates."""
    return v / span * 2 - 1
