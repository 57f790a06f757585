"""Constants of the JPEG and BMP formats, as Python values and as small DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

# Base quantisers of the JPEG standard's annex K, natural order.
LUMA_QUANT = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA_QUANT = [
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
]

# Annex K's Huffman tables. Codes of each length 1..16, and the symbols in order of their codes.
LUMA_DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
CHROMA_DC_COUNTS = [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]
LUMA_AC_COUNTS = [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]
LUMA_AC_SYMBOLS = [
    0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71,
    0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72,
    0x82, 0x09, 0x0A, 0x16, 0x17, 0x18, 0x19, 0x1A, 0x25, 0x26, 0x27, 0x28, 0x29, 0x2A, 0x34, 0x35, 0x36, 0x37,
    0x38, 0x39, 0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49, 0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59,
    0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69, 0x6A, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7A, 0x83,
    0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0xA2, 0xA3,
    0xA4, 0xA5, 0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xC2, 0xC3,
    0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA, 0xE1, 0xE2,
    0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF1, 0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8, 0xF9, 0xFA,
]
CHROMA_AC_COUNTS = [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]
CHROMA_AC_SYMBOLS = [
    0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22,
    0x32, 0x81, 0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1,
    0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1, 0x17, 0x18, 0x19, 0x1A, 0x26, 0x27, 0x28, 0x29, 0x2A, 0x35, 0x36,
    0x37, 0x38, 0x39, 0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49, 0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58,
    0x59, 0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69, 0x6A, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7A,
    0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A,
    0xA2, 0xA3, 0xA4, 0xA5, 0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA,
    0xC2, 0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA,
    0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8, 0xF9, 0xFA,
]

#: name -> (class, counts by length, symbols in order of their codes)
HUFFMAN = {
    "luma_dc": (0, LUMA_DC_COUNTS, list(range(12))),
    "luma_ac": (1, LUMA_AC_COUNTS, LUMA_AC_SYMBOLS),
    "chroma_dc": (0, CHROMA_DC_COUNTS, list(range(12))),
    "chroma_ac": (1, CHROMA_AC_COUNTS, CHROMA_AC_SYMBOLS),
}

#: Natural position of each zigzag place: anti-diagonals of the block, walked in turn up and down.
ZIGZAG = [8 * y + x for _, _, y, x in sorted((x + y, x if (x + y) % 2 == 0 else y, y, x) for y in range(8) for x in range(8))]


def dct_weight(k: int, pos: int) -> float:
    """Weight of sample pos in coefficient k of the orthonormal 8x8 DCT, both row-major."""

    def c(u: int) -> float:
        return math.sqrt(0.125) if u == 0 else 0.5

    u, v, x, y = k // 8, k % 8, pos // 8, pos % 8
    return c(u) * c(v) * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16)


def lengths(counts: list[int]) -> list[int]:
    return [n for n, c in enumerate(counts, 1) for _ in range(c)]


def codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a canonical table; counts and symbols must agree."""
    if sum(counts) != len(symbols):
        raise ValueError("counts and symbols differ")
    out: dict[int, tuple[int, int]] = {}
    code = 0
    for n, (length, symbol) in enumerate(zip(lengths(counts), symbols, strict=True)):
        if n:
            code = code + 1 << length - last
        last = length
        out.setdefault(symbol, (code, length))
    return out


def markers() -> list[tuple[int, str, str]]:
    """(code, name, class) of the JPEG marker bytes."""
    sof = [(0xC0 + i, f"SOF{i}", "frame") for i in range(16) if i not in (4, 8, 12)]
    ranges = [(0xD0, "RST", "restart", 8), (0xE0, "APP", "application", 16), (0xF0, "JPG", "extension", 14)]
    many = [(base + i, f"{name}{i}", kind) for base, name, kind, n in ranges for i in range(n)]
    single = {
        0x00: ("STUFF", "stuffing"), 0x01: ("TEM", "special"), 0xC4: ("DHT", "table"), 0xC8: ("JPG", "extension"), 0xCC: ("DAC", "table"),
        0xD8: ("SOI", "special"), 0xD9: ("EOI", "special"), 0xDA: ("SOS", "scan"), 0xDB: ("DQT", "table"), 0xDC: ("DNL", "special"),
        0xDD: ("DRI", "special"), 0xDE: ("DHP", "special"), 0xDF: ("EXP", "special"), 0xFE: ("COM", "comment"),
    }
    return sorted(sof + many + [(c, n, k) for c, (n, k) in single.items()])


def markers_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(markers(), "code int, name string, class string")


def zigzag_df(spark: SparkSession) -> DataFrame:
    """(z, k): zigzag place and natural position."""
    return spark.createDataFrame(list(enumerate(ZIGZAG)), "z int, k int")


def basis_df(spark: SparkSession) -> DataFrame:
    """(k, pos, w): weights of the 8x8 DCT."""
    return spark.createDataFrame([(k, p, dct_weight(k, p)) for k in range(64) for p in range(64)], "k int, pos int, w double")


def quant_df(spark: SparkSession) -> DataFrame:
    """(name, k, base): the base quantisers."""
    return spark.createDataFrame([(n, k, q) for n, t in (("luma", LUMA_QUANT), ("chroma", CHROMA_QUANT)) for k, q in enumerate(t)], "name string, k int, base int")


def huffman_lengths_df(spark: SparkSession) -> DataFrame:
    """(name, class, ord, len, symbol) of the default tables."""
    rows = [(n, c, i, size, s) for n, (c, counts, symbols) in HUFFMAN.items() for i, (size, s) in enumerate(zip(lengths(counts), symbols, strict=True))]
    return spark.createDataFrame(rows, "name string, class int, ord int, len int, symbol int")
