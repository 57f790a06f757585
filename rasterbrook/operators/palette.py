"""Colour-table look-up of packed indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpack(counts: DataFrame, by: list[str], depth: int) -> DataFrame:
    """(by, idx, n) of a byte histogram (by, symbol, n): a byte holds 8 / depth indexes, the first in its high bits."""
    shifts = F.sequence(F.lit(8 - depth), F.lit(0), F.lit(-depth)) if depth < 8 else F.array(F.lit(0))
    each = counts.select(*by, "symbol", "n", F.explode(shifts).alias("shift"))
    idx = F.expr("shiftright(symbol, shift)").bitwiseAND((1 << depth) - 1)
    return each.select(*by, idx.alias("idx"), "n").groupBy(*by, "idx").agg(F.sum("n").alias("n"))


def lookup(indexes: DataFrame, palette: DataFrame, on: list[str]) -> DataFrame:
    """indexes with r, g, b; a palette has at most 256 rows for each file, and is broadcast only when it is one palette."""
    side = F.broadcast(palette) if on == ["idx"] else palette
    return indexes.join(side, on)


def pixel_rows(files: DataFrame, id_col: str, content: str = "content") -> DataFrame:
    """(id, y, x, idx) of indexed BMP files with a header: rows are cut by their stride, and bytes into indexes."""
    h = F.col("header")
    depth = h["bit_count"]
    stride = (F.floor((depth * h["width"] + 31) / 32) * 4).cast("int")
    rows = files.filter(F.col("error").isNull() & depth.isin(1, 4, 8)).select(id_col, content, "header", stride.alias("stride"), F.explode(F.sequence(F.lit(0), F.abs(h["height"]) - 1)).alias("line"))
    at = (h["data_offset"] + F.col("line") * F.col("stride")).cast("int")
    y = F.when(h["height"] > 0, h["height"] - 1 - F.col("line")).otherwise(F.col("line"))
    lines = rows.select(id_col, y.alias("y"), depth.alias("depth"), F.substring(F.col(content), at + 1, F.col("stride")).alias("row"), F.explode(F.sequence(F.lit(0), h["width"] - 1)).alias("x"))
    byte = F.conv(F.hex(F.substring("row", (F.floor(F.col("x") * F.col("depth") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    shift = (8 - F.col("depth") - F.col("x") * F.col("depth") % 8).cast("int")
    staged = lines.select(id_col, "y", "x", byte.alias("byte"), shift.alias("shift"), (F.call_function("shiftleft", F.lit(1), F.col("depth")) - 1).alias("mask"))
    return staged.select(id_col, "y", "x", F.expr("shiftright(byte, shift) & mask").alias("idx"))
