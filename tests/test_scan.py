import random

import pytest
from pyspark.sql import functions as F

from rasterbrook.functions import tables
from rasterbrook.operators import blocks, scan, segments
from rasterbrook.sources import images, jpeg, table_functions

ROWS = [(g, o, v) for g in ("a", "b", None) for o, v in zip(random.Random(3).sample(range(-50, 500), 120), range(120), strict=True)] + [("one", 7, None)]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(g, o, None if v is not None and v % 11 == 0 else v) for g, o, v in ROWS], "g string, o long, v long")


def groups(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: r.o):
        out.setdefault(r.g, []).append((r.o, r.v))
    return out


@pytest.mark.parametrize("stretch", [1, 7, 1000])
def test_running_sum_and_previous(rows, stretch):
    for inclusive in (True, False):
        found = {(r.g, r.o): r.s for r in scan.running_sum(rows, ["g"], "o", {"s": "v"}, inclusive, stretch).collect()}
        want = {}
        for g, own in groups(rows).items():
            for i, (o, _) in enumerate(own):
                want[g, o] = sum(v or 0 for _, v in own[: i + inclusive])
        assert found == want
    found = {(r.g, r.o): r.p for r in scan.previous(rows, ["g"], "o", "v", "p", stretch).collect()}
    assert found == {(g, o): own[i - 1][1] if i else None for g, own in groups(rows).items() for i, (o, _) in enumerate(own)}


def test_no_task_holds_a_group(spark):
    df = spark.range(20_000).select(F.lit(1).alias("image"), F.col("id").alias("o"), (F.col("id") % 7).alias("diff"))
    done = blocks.dc_decode(df, ["image"], "o")
    assert "_stretch" in done._jdf.queryExecution().executedPlan().toString().split("Window")[1]
    assert done.agg(F.max("value")).first()[0] == sum(i % 7 for i in range(20_000))
    back = blocks.dc_encode(done.select("image", "o", "value"), ["image"], "o", "value")
    assert back.join(df.withColumnRenamed("diff", "d"), ["image", "o"]).filter("diff <> d").count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], "g string, o long, v long")
    assert scan.running_sum(none, ["g"], "o", {"s": "v"}).count() == scan.previous(none, ["g"], "o", "v").count() == 0


def test_separable_dct_equals_the_matrix(spark):
    rng = random.Random(5)
    data = [(i, [rng.uniform(-500, 500) for _ in range(64)]) for i in range(50)] + [(98, None), (99, [1.0] * 63)]
    df = spark.createDataFrame(data, "i int, block array<double>")
    for fast, slow in ((blocks.forward_dct_separable, blocks.forward_dct), (blocks.inverse_dct_separable, blocks.inverse_dct)):
        assert "Python" not in fast(df)._jdf.queryExecution().executedPlan().toString()
        a, b = ({r.i: r.block for r in f(df).collect()} for f in (fast, slow))
        assert a[98] is None and a[99] is None and b[98] is None
        assert all(abs(x - y) < 1e-6 for i in range(50) for x, y in zip(a[i], b[i], strict=True))
    assert len(tables.ZIGZAG) == 64


def test_codes_of_many_images_are_not_broadcast(spark):
    from rasterbrook.operators import huffman

    codes = spark.createDataFrame([(i, 1, i, 3) for i in range(4)], "image int, symbol int, code int, len int")
    symbols = spark.createDataFrame([(i, 1, 1) for i in range(4)], "image int, symbol int, value int")
    assert "broadcast" not in huffman.coded(symbols, codes, ["image"])._jdf.queryExecution().analyzed().toString().lower()
    assert {r.image: r.bits for r in huffman.coded(symbols, codes, ["image"]).collect()} == {0: "0001", 1: "0011", 2: "0101", 3: "0111"}


def test_table_functions_keep_broken_segments(spark):
    table_functions.register(spark)
    calls = {
        "rb_jpeg_segments": (b"\xff\xd8\xff\xdb\x00\x09", "segment DB is cut short"),
        "rb_jpeg_quant_tables": (b"\x00abc", "bad quantisation table"),
        "rb_jpeg_huffman_tables": (b"\x30" + b"\1" * 20, "bad Huffman table"),
        "rb_jpeg_frame": (b"\x08\x00", "the frame header is cut short"),
        "rb_jpeg_scan": (b"\x03\x01", "bad scan header"),
        "rb_jpeg_restart_segments": (b"\x01\x01\x00\x00\x3f\x00ab\xff\xd3cd", "restart markers out of order"),
    }
    for name, (payload, error) in calls.items():
        for data, wrong in ((payload, error), (None, None)):
            df = spark.createDataFrame([(1, data if data is None else bytearray(data))], "k int, p binary")
            rows = spark.sql(f"SELECT t.* FROM {{df}} s, LATERAL {name}(p) t", df=df).collect()
            assert all(r.error for r in rows if wrong) and (not wrong or rows[0].error == wrong)


def test_tables_of_scans(spark):
    """Tables redefined, missing, and a restart interval given twice."""
    data = jpeg.encode(16, 8, bytes(range(128)) * 3, interval=1)
    scan_at, dri = data.index(b"\xff\xda"), data.index(b"\xff\xdd")
    quant = data[2:71]
    twice = data[:scan_at] + quant + b"\xff\xdd\x00\x04\x00\x05" + data[scan_at:]
    files = {"plain": data, "twice": twice, "none": data[:2] + data[71:], "late": data[:2] + data[71:-2] + quant + b"\xff\xd9"}
    parsed = images.jpeg_segments(spark.createDataFrame([(n, bytearray(d)) for n, d in files.items()], "name string, content binary"))
    found = {(r.name, r.ord): r for r in table_functions.resolve(spark, parsed, ["name"]).collect()}
    assert len(found) == 12
    assert [found["plain", 0][c] for c in ("quant", "interval", "error")] == [2, 1, None]
    assert [found["twice", 0][c] for c in ("quant", "interval", "error")] == [scan_at, 5, None]
    assert found["none", 0].error == found["late", 0].error == "the scan needs a table that is not defined"
    assert found["none", 1].error is None and found["none", 1].quant == 2 and dri > 0


def test_restart_order_over_stretches(spark):
    marks = [(0xD0 + i % 8, i << 19) for i in range(40)]
    df = spark.createDataFrame([(1, o, m if o != 5 << 19 else 0xD7) for m, o in marks], "f int, offset long, marker int")
    rows = segments.restart_check(df, ["f"]).collect()
    assert len(rows) == 40 and [r.offset >> 19 for r in rows if not r.ok] == [5]
