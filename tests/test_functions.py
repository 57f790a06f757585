import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterbrook.functions import bits, codec, tables
from rasterbrook.operators import blocks, huffman, palette, segments
from rasterbrook.sources import bmp


def one(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def raw(hexadecimal):
    return F.unhex(F.lit(hexadecimal))


def test_integers_and_bounds(spark):
    d = raw("FF800102")
    assert one(spark, bits.byte_at(d, 0), bits.be_uint(d, 0, 2), bits.le_uint(d, 0, 4), bits.le_int32(raw("FFFFFFFF"), 0), bits.be_uint(d, 3, 2), bits.take(d, -1, 1)) == [255, 0xFF80, 0x020180FF, -1, None, None]
    v = F.lit(0x1234)
    assert one(spark, F.hex(bits.put_le(v, 4)), F.hex(bits.put_be(v, 2)), bits.swap_bytes(v), bits.hex_be(F.lit(-1), 2)) == ["34120000", "1234", 0x3412, "FFFF"]


def test_bits_and_nibbles(spark):
    b = F.lit(0xA5)
    assert one(spark, bits.nibble(b, 0), bits.nibble(b, 1), bits.bit_from_left(b, 0, 8), bits.bit_from_right(b, 1)) == [10, 5, 1, 0]
    assert one(spark, *(bits.magnitude_bits(F.lit(v)) for v in (0, 1, -3, 255))) == [1, 1, 2, 8]
    assert one(spark, bits.ceil_div(F.lit(17), 8), bits.nearly_equal(F.lit(1.0), F.lit(1.05), 0.1), bits.nearly_equal(F.lit(1.0), F.lit(1.2), 0.1)) == [3, True, False]
    with pytest.raises(Exception, match="nibbles"):
        one(spark, bits.nibble(b, 2))


def test_signatures_words_and_errors(spark):
    assert one(spark, *(bits.file_signature(raw(h)) for h in ("424D", "FFD8FF", "FFD8", "89504E47", ""))) == ["bmp", "jpeg", "none", "none", "none"]
    assert one(spark, *(bits.format_name(F.lit(n)) for n in ("JPG", "bmp", "png")), bits.words(F.lit("  a  bc ")), bits.error_in("reading", F.lit("bad"))) == ["jpeg", "bmp", "none", ["a", "bc"], "reading: bad"]


def test_stuffing_is_undone(spark):
    for h in ("", "FF", "FF00", "00FFFF00", "FFD9"):
        assert one(spark, segments.destuffed(bits.stuffed(F.lit(h)))) == [h]
    assert one(spark, bits.bits_to_hex(F.lit("1")), bits.bits_to_hex(F.lit("0" * 8)), bits.stuffed(F.lit("FF01FF"))) == ["FF", "00", "FF0001FF00"]


@settings(max_examples=60, deadline=None)
@given(st.integers(-2047, 2047))
def test_category_bits_by_definition(v):
    size = abs(v).bit_length()
    code = v if v > 0 else v - 1 + (1 << size)
    assert 0 <= code < max(1, 1 << size)
    back = 0 if not size else code - (1 << size) + 1 if code < 1 << size - 1 else code
    assert back == v


def test_category_columns(spark):
    df = spark.range(-300, 301).select(F.col("id").cast("int").alias("v"))
    size = codec.ssss(F.col("v"))
    wrong = df.withColumn("s", size).withColumn("c", codec.ssss_encode(F.col("s"), F.col("v"))).filter(codec.ssss_decode(F.col("s"), F.col("c")) != F.col("v"))
    assert wrong.isEmpty()


def test_quality_ends(spark):
    q = [one(spark, codec.quant_step(F.lit(b), F.lit(x)))[0] for x in (50, 100, 0, 101) for b in (16, 99)]
    assert q == [16, 99, 1, 1, 255, 255, 1, 1]


def test_colour_truncates_and_saturates(spark):
    rgb = codec.ycbcr_to_rgb(F.lit(127.9), F.lit(127.0), F.lit(127.0))
    assert one(spark, *(codec.to_byte(c) for c in rgb.values())) == [255, 121, 255]


def test_bmp_facts(spark):
    assert one(spark, *(codec.num_colors(F.lit(b)) for b in (1, 4, 8, 24)), *(codec.raster_encoding(F.lit(b), F.lit(c)) for b, c in ((1, 0), (24, 0), (4, 2), (8, 1), (32, 0)))) == [2, 16, 256, -1, "monochrome", "rgb24", "rle4", "rle8", "none"]
    assert one(spark, codec.next_restart(F.lit(0xD7)), codec.ndc(F.lit(5.0), F.lit(10.0)), codec.is_eob(F.lit(0), F.lit(0)), codec.is_zrl(F.lit(15), F.lit(0))) == [0xD0, 0.0, True, True]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 255), st.integers(1, 10**6), min_size=1, max_size=256))
def test_code_lengths_are_a_limited_prefix_code(frequency):
    counts = huffman.limited(huffman.merged_sizes(frequency))
    assert sum(counts) == len(frequency)
    assert sum(c / 2 ** (i + 1) for i, c in enumerate(counts)) < 1  # the code of all ones stays free


def test_long_codes_are_shortened():
    doubling = {i: 2**i for i in range(21)}
    sizes = huffman.merged_sizes(doubling)
    assert max(sizes.values()) == 21 and sizes[20] == 1
    counts = huffman.limited(sizes)
    assert sum(counts) == 21 and len(counts) == 16 and counts[0] == 1


def test_rle_of_long_runs(spark):
    def block(*places):
        b = [0] * 64
        for k, v in places:
            b[k] = v
        return b

    cases = [block(), block((63, 1)), block((16, 2), (17, -1)), block((17, 1)), block((33, 5)), block((62, -3)), [1] * 64, block((0, 9))]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, block array<int>")
    out = {}
    for r in blocks.ac_encode(df).orderBy("id", "seq").collect():
        out.setdefault(r.id, []).append((r.symbol, r.value))
    for i, b in enumerate(cases):
        want, run = [], 0
        last = max([k for k in range(1, 64) if b[k]], default=0)
        for k in range(1, last + 1):
            if b[k] == 0:
                run += 1
                continue
            want += [(0xF0, 0)] * (run // 16) + [(run % 16 << 4 | abs(b[k]).bit_length(), b[k])]
            run = 0
        assert out[i] == want + ([(0, 0)] if last < 63 else [])
    back = blocks.ac_decode(blocks.ac_encode(df), ["id"]).collect()
    assert {(r.id, r.k, r.v) for r in back} == {(i, k, v) for i, b in enumerate(cases) for k, v in enumerate(b) if k and v}


def test_transform_round_trip_and_nulls(spark):
    df = spark.createDataFrame([(1, [float(i * 7 % 50) for i in range(64)]), (2, None)], "id int, block array<double>")
    rows = {r.id: r.block for r in blocks.inverse_dct(blocks.forward_dct(df)).collect()}
    assert rows[2] is None and max(abs(a - i * 7 % 50) for i, a in enumerate(rows[1])) < 1e-9


def test_zigzag_is_undone(spark):
    (got,) = one(spark, blocks.dezigzag(blocks.zigzag(F.array(*map(F.lit, range(64))))))
    assert got == list(range(64)) and tables.ZIGZAG[:6] == [0, 1, 8, 16, 9, 2]


def test_restart_order_versions_and_lookup(spark):
    marks = spark.createDataFrame([(1, i, 0xD0 + i % 8) for i in range(10)] + [(2, 0, 0xD1)], "image_id int, offset int, marker int")
    assert [r.image_id for r in segments.restart_check(marks, ["image_id"]).filter("NOT ok").collect()] == [2]
    scans = spark.createDataFrame([(1, 0, 5, "a"), (1, 0, 15, "b"), (1, 1, 5, "c")], "image_id int, slot int, offset int, name string")
    made = spark.createDataFrame([(1, 0, 2), (1, 0, 5), (1, 0, 9), (1, 1, 7)], "image_id int, slot int, offset int")
    got = {r.name: r.version for r in segments.table_version(scans, made, ["image_id"], "slot").collect()}
    assert got == {"a": 2, "b": 9, "c": None}


def test_palette_pixels_of_files(spark):
    from test_sources import indexed

    files = [(d, *indexed(d, 5, 3)) for d in (1, 4, 8)]
    df = bmp.with_header(spark.createDataFrame([(d, c) for d, c, _ in files], "id int, content binary"))
    px = palette.lookup(palette.pixel_rows(df, "id"), bmp.palette(df, "id"), ["id", "idx"]).orderBy("id", "y", "x").collect()
    for d, _, rgb in files:
        assert bytes(v for r in px if r.id == d for v in (r.r, r.g, r.b)) == rgb


def test_prefix_table_decodes_every_default_code(spark):
    table = huffman.canonical(tables.huffman_lengths_df(spark), ["name"])
    rows = huffman.prefix_table(table, ["name"]).groupBy("name", "prefix").count().filter("count > 1")
    assert rows.isEmpty()
    want = {(n, s): c for n, (_, counts, symbols) in tables.HUFFMAN.items() for s, c in tables.codes(counts, symbols).items()}
    assert {(r.name, r.symbol): (r.code, r.len) for r in table.collect()} == want
