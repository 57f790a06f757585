"""Images as rows of pixels: a BINARY for each row, cut into bands and joined to image bytes, read, flipped and swapped without a row per pixel.

A table of rows has (by, y, width, height, row); a pixel is size bytes. Nothing
holds more than a row at a time but bands (BAND rows) and whole images, which
are a value each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterbrook.functions import bits

#: Rows of a band.
BAND = 64


def rows_of_blocks(placed: DataFrame, by: list[str], samples: str = "samples") -> DataFrame:
    """(by, y, width, height, row) of 8x8 blocks (by, block_row, block_col, width, height, samples), a byte a sample, cropped to the image.

    A block sends eight pieces of a row. A block that is missing within a row is an error: its row is null.
    """
    line = lambda i: F.array_join(F.transform(F.slice(samples, 8 * i + 1, 8), lambda s: bits.hex_be(s, 1)), "")
    pieces = F.array(*(F.struct((F.col("block_row") * 8 + i).alias("y"), line(i).alias("piece")) for i in range(8)))
    long = placed.select(*by, "width", "height", "block_col", F.inline(pieces)).filter((F.col("y") < F.col("height")) & (F.col("block_col") * 8 < F.col("width")))
    joined = long.groupBy(*by, "y", "width", "height").agg(F.array_sort(F.collect_list(F.struct("block_col", "piece"))).alias("p"))
    whole = F.unhex(F.substring(F.array_join(F.col("p.piece"), ""), F.lit(1), F.col("width") * 2))
    return joined.select(*by, "y", "width", "height", F.when(F.octet_length(whole) == F.col("width"), whole).alias("row"))


def bands(rows: DataFrame, by: list[str], band: int = BAND) -> DataFrame:
    """(by, band, n_rows, data): rows joined top to bottom, so many a band; data is null where one of them is missing or null."""
    grouped = rows.groupBy(*by, F.expr(f"y div {band}").alias("band")).agg(F.array_sort(F.collect_list(F.struct("y", F.hex("row").alias("h")))).alias("p"), F.max("height").alias("_height"))
    here = F.least(F.lit(band), F.col("_height") - F.col("band") * band)
    missing = F.exists("p", lambda x: x["h"].isNull()) | (F.size("p") != here)
    return grouped.select(*by, "band", F.size("p").alias("n_rows"), F.when(~missing, F.unhex(F.array_join(F.col("p.h"), ""))).alias("data"))


def image_bytes(banded: DataFrame, by: list[str]) -> DataFrame:
    """(by, data): an image's bands joined, a value of the image's size; null where a band is null or missing."""
    grouped = banded.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("band", F.hex("data").alias("h")))).alias("p"))
    missing = F.exists("p", lambda x: x["h"].isNull()) | (F.get("p", F.size("p") - 1)["band"] != F.size("p") - 1)
    return grouped.select(*by, F.when(~missing, F.unhex(F.array_join(F.col("p.h"), ""))).alias("data"))


def pixel(row: Column, x: Column | int, size: int = 1) -> Column:
    """The bytes of a pixel; null outside of the row."""
    return bits.take(row, (F.lit(x) if isinstance(x, int) else x) * size, size)


def flip_vertical(rows: DataFrame) -> DataFrame:
    return rows.withColumn("y", F.col("height") - 1 - F.col("y"))


def flip_horizontal(rows: DataFrame, size: int = 1) -> DataFrame:
    pixels = F.regexp_extract_all(F.hex("row"), F.lit("." * (2 * size)), F.lit(0))
    return rows.withColumn("row", F.unhex(F.array_join(F.reverse(pixels), "")))


def swap_pixels(rows: DataFrame, by: list[str], a: tuple[int, int], b: tuple[int, int], size: int = 1) -> DataFrame:
    """rows with the pixels at a and b, (x, y) each, exchanged in every image; an image that lacks one of them stays. by holds no null."""
    value = lambda p: F.max(F.when(F.col("y") == p[1], pixel(F.col("row"), p[0], size)))
    held = rows.filter(F.col("y").isin(a[1], b[1])).groupBy(*by).agg(value(a).alias("_a"), value(b).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    joined = rows.join(held.filter(both), by, "left")

    def put(row: Column, at: tuple[int, int], new: str) -> Column:
        return F.when((F.col("y") == at[1]) & F.col(new).isNotNull(), F.overlay(row, F.col(new), at[0] * size + 1, size)).otherwise(row)

    return joined.withColumn("row", put(put(F.col("row"), a, "_b"), b, "_a")).select(*rows.columns)
