"""Reading bit fields one after the other, where a field's width may depend on those before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterbrook.functions import bits


def wide_bits_at(data: Column, at: Column | int, n: Column | int) -> Column:
    """n bits (0 to 64) from a bit offset as a long, the 64th as its sign; beyond the end bits are zero."""
    at, n = (F.lit(x) if isinstance(x, int) else x for x in (at, n))
    above = F.greatest(n - 32, F.lit(0))
    high, low = bits.bits_at(data, at, above), bits.bits_at(data, at + above, F.least(n, F.lit(32)))
    return F.call_function("shiftleft", high, F.lit(32)).bitwiseOR(low)


def read_fields(df: DataFrame, data: str, at: Column | int, fields: list[tuple[str, Column | int]]) -> DataFrame:
    """df with a long for each field (name, width in bits), cursor behind the last one read, and ended.

    A width is a number or a Column over df and earlier fields. A field that
    doesn't fit in what is left is null, as are all after it, and the cursor
    stays; so does a width that is null, negative or above 64. ended says that
    no bit is left. Null data have null fields.
    """
    df = df.withColumn("cursor", (F.lit(at) if isinstance(at, int) else at).cast("long")).withColumn("_open", F.lit(True))
    size = F.octet_length(data) * 8
    for name, width in fields:
        width = F.lit(width) if isinstance(width, int) else width
        df = df.withColumn("_width", width.cast("long"))
        fits = F.col("_width").between(0, 64) & (F.col("cursor") + F.col("_width") <= size)
        df = df.withColumn("_open", F.col("_open") & F.coalesce(fits, F.lit(False)))
        df = df.withColumn(name, F.when(F.col("_open"), wide_bits_at(F.col(data), F.col("cursor"), F.col("_width"))))
        df = df.withColumn("cursor", F.col("cursor") + F.when(F.col("_open"), F.col("_width")).otherwise(0))
    return df.withColumn("ended", F.col("cursor") >= size).drop("_width", "_open")
