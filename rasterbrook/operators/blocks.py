"""Stages on 8x8 blocks. A block is an ARRAY of 64 in natural (row-major) order; the long form has a row per place."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterbrook.functions import codec, tables
from rasterbrook.operators import scan

#: Symbol of sixteen zeros, and of a block's end.
ZRL, EOB = 0xF0, 0x00


@cache
def _basis() -> np.ndarray:
    return np.array([[tables.dct_weight(k, p) for p in range(64)] for k in range(64)])


def _transform(df: DataFrame, column: str, inverse: bool) -> DataFrame:
    """A constant matrix product over Arrow batches; one pass, no shuffle. A block that is null, or not 64 long, becomes null."""
    place = df.columns.index(column)
    schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == column else f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = _basis() if inverse else _basis().T
        for batch in batches:
            values = batch.column(place)
            valid = pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(values), 64), False).to_numpy(zero_copy_only=False)
            flat = np.asarray(values.filter(pa.array(valid)).flatten().to_numpy(zero_copy_only=False), np.float64)
            out = (flat.reshape(-1, 64) @ matrix).ravel()
            offsets = np.concatenate(([0], np.cumsum(valid * 64))).astype(np.int32)
            array = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out), mask=pa.array(~valid))
            yield pa.record_batch([array if i == place else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(run, schema)


def forward_dct(df: DataFrame, column: str = "block") -> DataFrame:
    """Samples to orthonormal DCT coefficients, in place of the column."""
    return _transform(df, column, False)


def inverse_dct(df: DataFrame, column: str = "block") -> DataFrame:
    return _transform(df, column, True)


def forward_dct_rows(samples: DataFrame, by: list[str], value: str = "s") -> DataFrame:
    """The same as a join with the 64x64 basis and a sum: (by, k, c) from (by, pos, value)."""
    basis = F.broadcast(tables.basis_df(samples.sparkSession))
    return samples.join(basis, "pos").groupBy(*by, "k").agg(F.sum(F.col(value) * F.col("w")).alias("c"))


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _sums(x: list[Column], weights: list[list[float]]) -> list[Column]:
    return [reduce(add, (v * w for v, w in zip(x, row, strict=True))) for row in weights]


def _turns(n: int, ks: Iterable[int]) -> list[list[float]]:
    return [[math.cos((2 * i + 1) * k * math.pi / (2 * n)) for i in range(n // 2)] for k in ks]


def _eight(x: Column) -> Column:
    """The orthonormal DCT of an array of eight: folded twice, odd places from differences."""
    get = lambda a, i: F.get(a, F.lit(i))
    folded = lambda a, n: F.array(*(get(a, i) + get(a, n - 1 - i) for i in range(n // 2)), *(get(a, i) - get(a, n - 1 - i) for i in range(n // 2)))

    def outer(y: Column) -> Column:
        odd = _sums([get(y, 4 + i) for i in range(4)], _turns(8, (1, 3, 5, 7)))

        def inner(z: Column) -> Column:
            two, six = _sums([get(z, 2), get(z, 3)], _turns(4, (1, 3)))
            sums = [get(z, 0) + get(z, 1), odd[0], two, odd[1], (get(z, 0) - get(z, 1)) * math.cos(math.pi / 4), odd[2], six, odd[3]]
            return F.array(sums[0] * math.sqrt(0.125), *(v * 0.5 for v in sums[1:]))

        return _with(folded(y, 4), inner)

    return _with(folded(x, 8), outer)


def _eight_back(c: Column) -> Column:
    """Its inverse, the same way backwards."""
    get = lambda i: F.get(c, F.lit(i)) * (math.sqrt(0.125) if i == 0 else 0.5)
    flipped = lambda rows: [list(r) for r in zip(*rows, strict=True)]
    quarter = get(4) * math.cos(math.pi / 4)
    parts = F.array(get(0) + quarter, get(0) - quarter, *_sums([get(2), get(6)], flipped(_turns(4, (1, 3)))), *_sums([get(k) for k in (1, 3, 5, 7)], flipped(_turns(8, (1, 3, 5, 7)))))

    def joined(y: Column) -> Column:
        at = lambda i: F.get(y, F.lit(i))
        even = [at(0) + at(2), at(1) + at(3), at(1) - at(3), at(0) - at(2)]
        return F.array(*(even[i] + at(4 + i) for i in range(4)), *(even[i] - at(4 + i) for i in reversed(range(4))))

    return _with(parts, joined)


def _separable(df: DataFrame, column: str, eight: Callable[[Column], Column]) -> DataFrame:
    """Rows, then columns, as expressions: no Python worker. A block that is null, or not 64 long, becomes null."""
    each, places = F.sequence(F.lit(0), F.lit(7)), F.sequence(F.lit(0), F.lit(63))
    rows = lambda block: F.transform(each, lambda r: _with(F.slice(block, r * 8 + 1, F.lit(8)), eight))
    columns = lambda t: F.transform(each, lambda c: _with(F.transform(t, lambda row: F.get(row, c)), eight))
    laid = lambda t: F.transform(places, lambda p: F.get(F.get(t, p % 8), F.floor(p / 8).cast("int")))
    # each step is bound to a name: a column would be put in place of it wherever it is used
    done = _with(F.col(column).cast("array<double>"), lambda b: _with(rows(b), lambda t: _with(columns(t), laid)))
    return df.withColumn(column, F.when(F.size(column) == 64, done))


def forward_dct_separable(df: DataFrame, column: str = "block") -> DataFrame:
    """forward_dct as expressions."""
    return _separable(df, column, _eight)


def inverse_dct_separable(df: DataFrame, column: str = "block") -> DataFrame:
    return _separable(df, column, _eight_back)


def explode(df: DataFrame, column: str = "block", place: str = "k", value: str = "v") -> DataFrame:
    """Long form: a row per place of the block."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(column).alias(place, value))


def zip_steps(block: Column, steps: list[int], f) -> Column:
    """f(value, step) place by place."""
    return F.zip_with(block, F.array(*map(F.lit, steps)), f)


def quantise(block: Column, steps: list[int]) -> Column:
    return zip_steps(block, steps, codec.quantise)


def dequantise(block: Column, steps: list[int]) -> Column:
    return zip_steps(block, steps, lambda c, q: c * q)


def zigzag(block: Column) -> Column:
    """Natural to zigzag order."""
    return F.array(*(F.get(block, F.lit(k)) for k in tables.ZIGZAG))


def dezigzag(block: Column) -> Column:
    back = sorted(range(64), key=tables.ZIGZAG.__getitem__)
    return F.array(*(F.get(block, F.lit(z)) for z in back))


def dc_encode(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """df with diff: the difference to the value before, within by; the first stands alone. order is a whole number; no task holds a group."""
    return scan.previous(df, by, order, value, "_before").withColumn("diff", F.col(value) - F.coalesce("_before", F.lit(0))).drop("_before")


def dc_decode(df: DataFrame, by: list[str], order: str, diff: str = "diff") -> DataFrame:
    """df with value: the running sum of differences within by. order is a whole number; no task holds a group."""
    return scan.running_sum(df, by, order, {"value": diff})


def ac_encode(df: DataFrame, block: str = "block") -> DataFrame:
    """Rows (rest, seq, symbol, value): run-length symbols of zigzag-ordered blocks, in order.

    All inside the row: non-zero places are filtered, gaps taken between neighbours, so nothing is exchanged.
    """
    rest = [c for c in df.columns if c != block]
    places = F.filter(F.transform(F.col(block), lambda v, k: F.struct(k.alias("k"), v.cast("int").alias("v"))), lambda x: (x["k"] > 0) & (x["v"] != 0))
    staged = df.select(*rest, places.alias("nz"))

    def symbols(x: Column, i: Column) -> Column:
        before = F.when(i == 0, 0).otherwise(F.get("nz", i - 1)["k"])
        gap = x["k"] - before - 1
        one = F.struct((F.shiftleft(gap % 16, 4).bitwiseOR(codec.ssss(x["v"]))).cast("int").alias("symbol"), x["v"].alias("value"))
        zeros = F.array_repeat(F.struct(F.lit(ZRL).alias("symbol"), F.lit(0).alias("value")), F.floor(gap / 16).cast("int"))
        return F.concat(zeros, F.array(one))

    runs = F.flatten(F.transform("nz", symbols))
    end = F.when(F.coalesce(F.get("nz", F.size("nz") - 1)["k"], F.lit(0)) < 63, F.array(F.struct(F.lit(EOB).alias("symbol"), F.lit(0).alias("value"))))
    whole = F.concat(runs, F.coalesce(end, F.array().cast("array<struct<symbol:int,value:int>>")))
    return staged.select(*rest, F.posexplode(whole).alias("seq", "s")).select(*rest, "seq", "s.symbol", "s.value")


def ac_decode(symbols: DataFrame, by: list[str]) -> DataFrame:
    """(by, k, v): non-zero zigzag places from run-length symbols (by, seq, symbol, value)."""
    w = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    step = F.shiftright("symbol", 4) + 1
    placed = symbols.withColumn("k", F.sum(step).over(w).cast("int"))
    return placed.filter((F.col("symbol") != EOB) & (F.col("symbol") != ZRL)).select(*by, "k", F.col("value").alias("v"))


def last_nonzero(block: Column) -> Column:
    """Greatest place that isn't zero, or -1."""
    return F.coalesce(F.array_max(F.transform(block, lambda v, k: F.when(v != 0, k).otherwise(-1))), F.lit(-1))


# Layout


def mcu_to_raster(blocks: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Luma blocks (mcu, block, h, v, width, height) with their place (block_row, block_col) in the image; those outside are dropped."""
    blocks_wide, blocks_high = F.ceil(F.col(width) / 8), F.ceil(F.col(height) / 8)
    mcus_wide = F.ceil(blocks_wide / F.col("h"))
    row = F.floor(F.col("mcu") / mcus_wide) * F.col("v") + F.floor(F.col("block") / F.col("h"))
    col = (F.col("mcu") % mcus_wide) * F.col("h") + F.col("block") % F.col("h")
    return blocks.withColumns({"block_row": row.cast("int"), "block_col": col.cast("int")}).filter((F.col("block_row") < blocks_high) & (F.col("block_col") < blocks_wide))


def block_pixels(blocks: DataFrame, value: str = "block") -> DataFrame:
    """(rest, y, x, value) of placed blocks, cropped to width and height."""
    rest = [c for c in blocks.columns if c not in (value, "block_row", "block_col")]
    long = blocks.select(*rest, "block_row", "block_col", F.posexplode(value).alias("p", "value"))
    placed = long.withColumns({"y": (F.col("block_row") * 8 + F.floor(F.col("p") / 8)).cast("int"), "x": (F.col("block_col") * 8 + F.col("p") % 8).cast("int")})
    return placed.filter("x < width AND y < height").select(*rest, "y", "x", "value")


def flip_vertical(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("y", F.col("height") - 1 - F.col("y"))


def flip_horizontal(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("x", F.col("width") - 1 - F.col("x"))


def swap_pixels(pixels: DataFrame, a: tuple[int, int], b: tuple[int, int]) -> DataFrame:
    """pixels with two places (x, y) exchanged."""

    def moved(c: str, i: int) -> Column:
        at = lambda p: (F.col("x") == p[0]) & (F.col("y") == p[1])
        return F.when(at(a), b[i]).when(at(b), a[i]).otherwise(F.col(c)).cast("int")

    return pixels.withColumns({"x": moved("x", 0), "y": moved("y", 1)})


def pixel(data: Column, width: Column, x: Column, y: Column, channel: Column) -> Column:
    """A channel of a pixel of interleaved RGB bytes."""
    at = (y * width * 3 + x * 3 + channel).cast("int")
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("int")
