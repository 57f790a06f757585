"""Huffman stages: histograms, code lengths, canonical codes, sizes and packed bits of coded symbols."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterbrook.functions import bits, codec

#: A symbol that no data has; it takes the code of all ones, which is then dropped.
RESERVED = 256
MOST_BITS = 16


def histogram(symbols: DataFrame, by: list[str], symbol: str = "symbol") -> DataFrame:
    """(by, symbol, n). Partial counts are made before the exchange, so a hot symbol is one row a task."""
    return symbols.groupBy(*by, symbol).agg(F.count("*").alias("n"))


def by_frequency(counts: DataFrame, by: list[str], symbol: str = "symbol") -> DataFrame:
    """counts with rank: most frequent first, then the smaller symbol; symbols that don't occur are dropped."""
    w = Window.partitionBy(*by).orderBy(F.desc("n"), symbol)
    return counts.filter("n > 0").withColumn("rank", F.row_number().over(w))


def canonical(lengths: DataFrame, by: list[str]) -> DataFrame:
    """(by, ord, len, symbol) with code: a running sum of the code space that shorter codes take."""
    w = Window.partitionBy(*by).orderBy("len", "ord").rowsBetween(Window.unboundedPreceding, -1)
    free = F.lit(MOST_BITS) - F.col("len")
    space = F.call_function("shiftleft", F.lit(1), free)
    return lengths.withColumn("code", F.call_function("shiftright", F.coalesce(F.sum(space).over(w), F.lit(0)), free))


def length_histogram(lengths: DataFrame, by: list[str]) -> DataFrame:
    """(by, len, n), lengths of over 32 counted as 32."""
    return lengths.groupBy(*by, F.least("len", F.lit(32)).alias("len")).agg(F.count("*").alias("n"))


def prefix_table(codes: DataFrame, by: list[str]) -> DataFrame:
    """(by, prefix, len, symbol): each 16-bit word's code, for decoding by equi-join."""
    free = F.lit(MOST_BITS) - F.col("len")
    first = F.call_function("shiftleft", F.col("code"), free)
    span = F.call_function("shiftleft", F.lit(1), free) - 1
    return codes.select(*by, F.explode(F.sequence(first, first + span)).alias("prefix"), "len", "symbol")


def merged_sizes(frequency: dict[int, int]) -> dict[int, int]:
    """Code length of each symbol and of the reserved one: the two rarest groups, led by a symbol each, merge until one is left.

    Of equally rare groups the first choice is the one led by the greatest
    symbol; the second choice is, of those led by smaller symbols than the
    first, the greatest, and else the smallest of the others.
    """
    groups = {s: (n, [s]) for s, n in frequency.items() if n > 0} | {RESERVED: (1, [RESERVED])}
    size = dict.fromkeys(groups, 0)
    while len(groups) > 1:
        first = min(groups, key=lambda s: (groups[s][0], -s))
        second = min(groups.keys() - {first}, key=lambda s: (groups[s][0], s > first, s if s > first else -s))
        members = groups[first][1] + groups[second][1]
        groups[first] = groups[first][0] + groups[second][0], members
        del groups[second]
        for s in members:
            size[s] += 1
    return size


def limited(size: dict[int, int]) -> list[int]:
    """How many codes have each length 1..16: longer ones are shortened pair by pair, and the reserved code goes."""
    counts = [0] * 34
    for n in size.values():
        counts[min(n, 32)] += 1
    for n in range(32, MOST_BITS, -1):
        while counts[n] > 0:
            shorter = n - 2
            while shorter > 0 and counts[shorter] == 0:
                shorter -= 1
            if shorter <= 0:
                raise ValueError("code lengths can't be limited")
            counts[n] -= 2
            counts[n - 1] += 1
            counts[shorter + 1] += 2
            counts[shorter] -= 1
    longest = max(n for n in range(1, MOST_BITS + 1) if counts[n])
    counts[longest] -= 1
    return counts[1 : MOST_BITS + 1]


def optimal_lengths(counts: DataFrame, by: list[str], symbol: str = "symbol") -> DataFrame:
    """(by, ord, len, symbol) of a table for the histogram (by, symbol, n): at most 256 rows of a group meet in a task."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.select(*by).schema) + ", ord int, len int, symbol int"

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["n"] > 0]
        frequency = dict(zip(rows[symbol].astype(int), rows["n"].astype(int), strict=True))
        sizes = [n for n, c in enumerate(limited(merged_sizes(frequency)), 1) for _ in range(c)]
        order = sorted(frequency, key=lambda s: (-frequency[s], s))
        out = pd.DataFrame({"ord": range(len(order)), "len": sizes, "symbol": order})
        for c in reversed(by):
            out.insert(0, c, rows[c].iloc[0])
        return out

    return counts.select(*by, symbol, "n").groupBy(*by).applyInPandas(one, schema)


def _side(codes: DataFrame, on: list[str]) -> DataFrame:
    """codes, broadcast only when they are one table; tables of many images are joined as they are."""
    return codes if on else F.broadcast(codes)


def coded(symbols: DataFrame, codes: DataFrame, on: list[str]) -> DataFrame:
    """symbols (.., symbol, value) with bits: the code, then the value's bits; codes by on, or one table."""
    size = F.col("symbol").bitwiseAND(15)
    text = F.concat(F.lpad(F.bin("code"), F.col("len"), "0"), F.when(size > 0, F.lpad(F.bin(codec.ssss_encode(size, F.col("value"))), size, "0")).otherwise(""))
    return symbols.join(_side(codes.select(*on, "symbol", "code", "len"), on), [*on, "symbol"]).withColumn("bits", text)


def coded_size(symbols: DataFrame, codes: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """(by, n_bits)."""
    joined = symbols.join(_side(codes.select(*on, "symbol", "len"), on), [*on, "symbol"])
    return joined.groupBy(*by).agg(F.sum(F.col("len") + F.col("symbol").bitwiseAND(15)).alias("n_bits"))


def packed(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, hex): the bits of rows in order, the last byte filled with ones, 00 after each FF."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct(*order, "bits"))), lambda x: x["bits"])
    return rows.groupBy(*by).agg(F.array_join(pieces, "").alias("all")).select(*by, bits.stuffed(bits.bits_to_hex(F.col("all"))).alias("hex"))


def byte_histogram(df: DataFrame, by: list[str], data: str) -> DataFrame:
    """(by, symbol, n) of all bytes of a BINARY column; a task sends one row per group and byte value."""
    import numpy as np
    import pyarrow as pa

    source = df.select(F.struct(*by).alias("g"), F.col(data).cast("binary").alias("data"))
    kind = source.schema["g"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0).to_pylist()
            total: dict[tuple, np.ndarray] = {}
            for g, x in zip(groups, batch.column(1).to_pylist(), strict=True):
                if x:
                    counts = np.bincount(np.frombuffer(x, np.uint8), minlength=256)
                    key = tuple(g.values())
                    total[key] = total[key] + counts if key in total else counts
            g, symbol, n = [], [], []
            for key, counts in total.items():
                for s in np.flatnonzero(counts).tolist():
                    g.append(dict(zip(by, key, strict=True)))
                    symbol.append(s)
                    n.append(int(counts[s]))
            yield pa.record_batch([pa.array(g, batch.schema.field(0).type), pa.array(symbol, pa.int32()), pa.array(n, pa.int64())], names=["g", "symbol", "n"])

    return source.mapInArrow(run, f"g {kind}, symbol int, n long").select("g.*", "symbol", "n").groupBy(*by, "symbol").agg(F.sum("n").alias("n"))
