"""JPEG marker segments as SQL table functions, for lateral joins: segments in, rows out, a broken one as a row with its error.

    table_functions.register(spark)
    SELECT f.path, t.dest, t.k, t.q FROM files f, LATERAL rb_jpeg_segments(f.content) s, LATERAL rb_jpeg_quant_tables(s.payload) t WHERE s.marker = 219
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from rasterbrook.operators import segments
from rasterbrook.sources import jpeg


class Segments:
    """(seq, offset, marker, payload, error) of a file."""

    schema = "seq int, offset long, marker int, payload binary, error string"

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            for i, (offset, marker, payload) in enumerate(jpeg.segments(bytes(content or b""))):
                yield i, offset, marker, payload, None
        except ValueError as e:
            yield None, None, None, None, str(e)


class QuantTables:
    """(dest, k, q, error) of a DQT segment, k in natural order."""

    schema = "dest int, k int, q int, error string"

    def eval(self, payload: bytes) -> Iterator[tuple]:
        try:
            for dest, steps in jpeg.quant_tables(bytes(payload or b"")):
                for k, q in enumerate(steps):
                    yield dest, k, int(q), None
        except ValueError as e:
            yield None, None, None, str(e)


class HuffmanTables:
    """(class, dest, ord, len, symbol, error) of a DHT segment."""

    schema = "class int, dest int, ord int, len int, symbol int, error string"

    def eval(self, payload: bytes) -> Iterator[tuple]:
        try:
            for kind, dest, counts, symbols in jpeg.huffman_tables(bytes(payload or b"")):
                sizes = [n for n, c in enumerate(counts, 1) for _ in range(c)]
                for i, (n, s) in enumerate(zip(sizes, symbols, strict=True)):
                    yield kind, dest, i, n, s, None
        except ValueError as e:
            yield None, None, None, None, None, str(e)


class FrameComponents:
    """(ord, comp_id, h, v, quant, width, height, error) of a frame header."""

    schema = "ord int, comp_id int, h int, v int, quant int, width int, height int, error string"

    def eval(self, payload: bytes) -> Iterator[tuple]:
        try:
            found = jpeg.frame(bytes(payload or b""))
            for i, (comp, h, v, q) in enumerate(found["components"]):
                yield i, comp, h, v, q, found["width"], found["height"], None
        except ValueError as e:
            yield None, None, None, None, None, None, None, str(e)


class ScanComponents:
    """(ord, comp_id, dc, ac, error) of a scan header."""

    schema = "ord int, comp_id int, dc int, ac int, error string"

    def eval(self, payload: bytes) -> Iterator[tuple]:
        payload = bytes(payload or b"")
        n = payload[0] if payload else 0
        if not 1 <= n <= 4 or len(payload) < 4 + 2 * n:
            yield None, None, None, None, "bad scan header"
            return
        for i in range(n):
            yield i, payload[1 + 2 * i], payload[2 + 2 * i] >> 4, payload[2 + 2 * i] & 15, None


class RestartSegments:
    """(seg, bytes, error) of a scan's payload: its entropy bytes cut at restart markers, without stuffing."""

    schema = "seg int, bytes binary, error string"

    def eval(self, payload: bytes) -> Iterator[tuple]:
        payload = bytes(payload or b"")
        head = 4 + 2 * payload[0] if payload else 1
        try:
            if len(payload) < head:
                raise ValueError("bad scan header")
            for i, part in enumerate(jpeg.restart_parts(payload[head:])):
                yield i, part, None
        except ValueError as e:
            yield None, None, str(e)


FUNCTIONS = {
    "rb_jpeg_segments": Segments,
    "rb_jpeg_quant_tables": QuantTables,
    "rb_jpeg_huffman_tables": HuffmanTables,
    "rb_jpeg_frame": FrameComponents,
    "rb_jpeg_scan": ScanComponents,
    "rb_jpeg_restart_segments": RestartSegments,
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session."""
    for name, made in FUNCTIONS.items():
        spark.udtf.register(name, udtf(made, returnType=made.schema, useArrow=True))


def resolve(spark: SparkSession, parsed: DataFrame, by: list[str]) -> DataFrame:
    """segments.resolved for parsed files (by, offset, marker, payload): the tables that hold for each component of each scan, with an error where a component or table is missing, or a segment is broken."""
    register(spark)
    keys = ", ".join(f"s.`{c}`" for c in by)
    # the entropy bytes behind a scan's header stay where they are
    heads = parsed.filter("error IS NULL").select(*by, "offset", "marker", F.when(F.col("marker") == jpeg.SOS, F.substring("payload", 1, 12)).otherwise(F.col("payload")).alias("payload"))

    def rows(function: str, marker: int, columns: str) -> DataFrame:
        return spark.sql(f"SELECT {keys}, s.offset, {columns} FROM {{heads}} s, LATERAL {function}(s.payload) t WHERE s.marker = {marker} AND t.error IS NULL", heads=heads)

    quant = rows("rb_jpeg_quant_tables", jpeg.DQT, "concat('q', t.dest) AS slot, s.offset AS value").distinct()
    coding = rows("rb_jpeg_huffman_tables", jpeg.DHT, "concat(IF(t.class = 0, 'd', 'a'), t.dest) AS slot, s.offset AS value").distinct()
    interval = heads.filter((F.col("marker") == jpeg.DRI) & (F.octet_length("payload") == 2)).select(*by, "offset", F.lit("r").alias("slot"), F.conv(F.hex("payload"), 16, 10).cast("long").alias("value"))
    scans = rows("rb_jpeg_scan", jpeg.SOS, "t.ord, t.comp_id, t.dc, t.ac")
    frames = rows("rb_jpeg_frame", jpeg.SOF0, "t.comp_id, t.quant").drop("offset")
    return segments.resolved(quant.unionByName(coding).unionByName(interval), scans, frames, by)
