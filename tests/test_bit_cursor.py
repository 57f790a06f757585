from pyspark.sql import functions as F

from rasterbrook.operators.bit_cursor import read_fields


def plain(data, at, widths):
    text = "".join(f"{b:08b}" for b in data)
    out, alive = [], True
    for w in widths:
        w = w(out) if callable(w) else w
        alive = alive and w is not None and 0 <= w <= 64 and at + w <= len(text)
        v = int(text[at : at + w] or "0", 2) if alive else None
        out.append(v - (1 << 64) if v is not None and v >= 1 << 63 else v)
        at += w if alive else 0
    return [*out, at, at >= len(text)]


def test_fields_against_plain_reading(spark):
    data = [bytes((7 * i * i + 31 * j + 200) % 256 for j in range(i)) for i in range(24)] + [b"\xff" * 20]
    df = spark.createDataFrame([(i, bytearray(d), i % 11) for i, d in enumerate(data)], "i int, data binary, at int")
    got = read_fields(df, "data", F.col("at"), [("size", 4), ("value", F.col("size")), ("long", 64), ("odd", F.col("size") * 5), ("last", 1)])
    for r in got.collect():
        want = plain(data[r.i], r.i % 11, [4, lambda o: o[0], 64, lambda o: None if o[0] is None else o[0] * 5, 1])
        assert [r.size, r.value, r.long, r.odd, r.last, r.cursor, r.ended] == want, r


def test_null_data_and_empty(spark):
    df = spark.createDataFrame([(None,), (bytearray(),)], "data binary")
    assert [(r.a, r.cursor, r.ended) for r in read_fields(df, "data", 0, [("a", 1)]).collect()] == [(None, 0, None), (None, 0, True)]
