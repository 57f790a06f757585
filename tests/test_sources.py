import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterbrook import streaming
from rasterbrook.functions import tables
from rasterbrook.sources import bmp, datasource, images, jpeg

rng = np.random.default_rng(5)


def noise(w, h):
    return rng.integers(0, 256, (h, w, 3), dtype=np.uint8).tobytes()


def smooth(w, h):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack((x * 255 // max(1, w - 1), y * 255 // max(1, h - 1), (x + y) * 255 // max(1, w + h - 2)), axis=2).astype(np.uint8).tobytes()


def psnr(a, b):
    d = np.frombuffer(a, np.uint8).astype(float) - np.frombuffer(b, np.uint8)
    return 10 * np.log10(255**2 / max(1e-9, (d * d).mean()))


def indexed(depth, width, height, size=40, top_down=False):
    """A file with a colour table, and the RGB it stands for."""
    colors = 1 << depth
    palette = rng.integers(0, 256, (colors, 3), dtype=np.uint8)
    index = rng.integers(0, colors, (height, width))
    rows = []
    for row in index if top_down else index[::-1]:
        bits = "".join(f"{v:0{depth}b}" for v in row)
        bits += "0" * (-len(bits) % 32)
        rows.append(int(bits, 2).to_bytes(len(bits) // 8, "big"))
    entries = b"".join(bytes(c[::-1]) + (b"" if size == 12 else b"\0") for c in palette)
    offset = 14 + size + len(entries)
    info = struct.pack("<IHHHH", 12, width, height, 1, depth) if size == 12 else struct.pack("<IiiHHIIiiII", 40, width, -height if top_down else height, 1, depth, 0, 0, 0, 0, 0, 0)
    raster = b"".join(rows)
    return b"BM" + struct.pack("<III", offset + len(raster), 0, offset) + info + entries + raster, palette[index].tobytes()


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 9), st.integers(1, 5))
def test_bmp_round_trip_is_exact(w, h):
    data = noise(w, h)
    assert bmp.decode(bmp.encode(w, h, data)) == (w, h, data)


@pytest.mark.parametrize("depth", [1, 4, 8])
@pytest.mark.parametrize("size", [12, 40])
@pytest.mark.parametrize("width", [1, 5, 9, 32])
def test_indexed_bmp(depth, size, width):
    content, rgb = indexed(depth, width, 3, size)
    assert bmp.decode(content) == (width, 3, rgb)
    if size == 40:
        content, rgb = indexed(depth, width, 3, size, True)
        assert bmp.decode(content) == (width, 3, rgb)


def test_bmp_errors_are_rows(spark):
    good = bmp.encode(2, 2, noise(2, 2))
    bad = [b"", b"BM", b"XX" + good[2:], good[:-3], good[:14] + struct.pack("<I", 13) + good[18:], good[:24] + struct.pack("<H", 16) + good[26:], good[:24] + struct.pack("<H", 7) + good[26:], None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate([good, *bad])], "id int, content binary")
    rows = images.decode(df).collect()
    assert [r.id for r in rows if r.error is None] == [0] and len(rows) == 9
    heads = bmp.with_header(df).select("id", "error", "header.width").collect()
    assert [r.id for r in heads if r.error is None] == [0, 4] and heads[0].width == 2


def test_header_and_palette_expressions(spark):
    content, rgb = indexed(4, 5, 3)
    core, _ = indexed(8, 5, 3, 12)
    df = bmp.with_header(spark.createDataFrame([(1, content), (2, core)], "id int, content binary"))
    assert [(r.header.width, r.header.height, r.header.bit_count, r.encoding) for r in df.orderBy("id").collect()] == [(5, 3, 4, "indexed4"), (5, 3, 8, "indexed8")]
    table = {(r.id, r.idx): bytes((r.r, r.g, r.b)) for r in bmp.palette(df, "id").collect()}
    assert len(table) == 16 + 256 and {rgb[i : i + 3] for i in range(0, 45, 3)} <= {v for (i, _), v in table.items() if i == 1}


@pytest.mark.parametrize("w,h", [(8, 8), (17, 9), (1, 1), (40, 33)])
@pytest.mark.parametrize("options", [{}, {"optimise": True}, {"interval": 2}, {"optimise": True, "interval": 3}])
def test_jpeg_round_trip(w, h, options):
    data = smooth(w, h)
    got = jpeg.decode(jpeg.encode(w, h, data, 95, **options))
    assert got[:2] == (w, h) and psnr(got[2], data) > 30


def test_jpeg_keeps_quantised_coefficients_of_noise():
    data = noise(24, 16)
    for options in ({}, {"optimise": True, "interval": 1}):
        found = jpeg.parse(jpeg.encode(24, 16, data, 100, **options))
        c = jpeg.blocks_of(24, 16, data) @ jpeg._BASIS.T
        want = (np.sign(c) * np.floor(np.abs(np.round(c, 6)) + 0.5))[:, :, tables.ZIGZAG]
        assert (jpeg.coefficients(found) == want).all()


def subsampled(h, v, w=21, high=19):
    """Recodes a file's blocks with luma factors h and v, and the planes that must come out."""
    from rasterbrook.functions.tables import HUFFMAN, codes

    across, down = -(-w // (8 * h)), -(-high // (8 * v))
    blocks = rng.integers(-40, 40, (across * down, h * v + 2, 64))
    blocks[:, :, 8:] = 0
    t = {k: codes(c, s) for k, (_, c, s) in HUFFMAN.items()}
    bits, last = "", [0, 0, 0]
    for mcu in blocks:
        for i, b in enumerate(mcu):
            c = max(0, i - h * v + 1)
            name = "luma" if c == 0 else "chroma"

            def value(x):
                s = int(abs(x)).bit_length()
                return s, f"{x if x > 0 else x - 1 + (1 << s):0{s}b}" if s else ""

            s, text = value(int(b[0]) - last[c])
            last[c] = int(b[0])
            code, n = t[f"{name}_dc"][s]
            bits += f"{code:0{n}b}" + text
            run = 0
            for x in b[1:]:
                if x == 0:
                    run += 1
                    continue
                s, text = value(int(x))
                code, n = t[f"{name}_ac"][run << 4 | s]
                bits += f"{code:0{n}b}" + text
                run = 0
            code, n = t[f"{name}_ac"][0]
            bits += f"{code:0{n}b}"
    bits += "1" * (-len(bits) % 8)
    entropy = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    file = jpeg.encode(w, high, noise(w, high), 100)
    at = file.index(b"\xff\xda")
    head = bytearray(file[: at + 14])
    sof = head.index(b"\xff\xc0")
    head[sof + 11] = h << 4 | v
    return bytes(head) + entropy + b"\xff\xd9", blocks


@pytest.mark.parametrize("h,v", [(2, 1), (1, 2), (2, 2), (4, 2)])
def test_subsampled_luma(h, v):
    file, blocks = subsampled(h, v)
    found = jpeg.parse(file)
    assert (jpeg.coefficients(found) == blocks).all()
    w, high, rgb = jpeg.decode(file)
    got = np.frombuffer(rgb, np.uint8).reshape(high, w, 3)
    natural = np.zeros(blocks.shape)
    natural[:, :, tables.ZIGZAG] = blocks
    samples = natural @ jpeg._BASIS
    across = -(-w // (8 * h))
    for y, x in ((0, 0), (7, 9), (18, 20), (10, 3)):
        mcu = y // (8 * v) * across + x // (8 * h)
        by, bx = y % (8 * v), x % (8 * h)
        luma = samples[mcu, by // 8 * h + bx // 8, by % 8 * 8 + bx % 8] + 128
        cb, cr = (samples[mcu, h * v + i, by // v * 8 + bx // h] for i in (0, 1))
        want = np.floor(np.clip([luma + 1.402 * cr, luma - 0.344 * cb - 0.714 * cr, luma + 1.772 * cb], 0, 255))
        assert np.abs(got[y, x] - want).max() <= 1


def test_jpeg_errors_are_rows(spark):
    good = jpeg.encode(16, 16, smooth(16, 16), interval=1)
    sof, dht, sos = good.index(b"\xff\xc0"), good.index(b"\xff\xc4"), good.index(b"\xff\xda")
    bad = {
        "trailing": good + b"x",
        "cut": good[:-40],
        "no frame": good[:sof] + good[sof + 19 :],
        "progressive": good.replace(b"\xff\xc0", b"\xff\xc2"),
        "two frames": good[:sof] + good[sof : sof + 19] + good[sof:],
        "no table": good[:dht] + good[good.index(b"\xff\xc0") :],
        "restart order": good.replace(b"\xff\xd1", b"\xff\xd5"),
        "twelve bits": good[: sof + 4] + b"\x0c" + good[sof + 5 :],
        "grey": good[:sof] + b"\xff\xc0\x00\x0b\x08\x00\x10\x00\x10\x01\x01\x11\x00" + good[sof + 19 :],
        "entropy": good[: sos + 14] + b"\xfe\xfe" * 30 + b"\xff\xd9",
        "unknown component": good[: sos + 5] + b"\x09" + good[sos + 6 :],
    }
    app = good[:2] + b"\xff\xe1\x00\x08\xff\xd8\xff\xc0\x00\x00" + b"\xff\xfe\x00\x05abc" + good[2:]
    df = spark.createDataFrame([("good", good), ("app", app), *bad.items()], "name string, content binary")
    rows = {r.name: r for r in images.decode(df).collect()}
    assert {n for n, r in rows.items() if r.error is None} == {"good", "app"} and len(rows) == len(bad) + 2
    assert jpeg.parse(app)["comments"] == ["abc"]


def test_staged_tables(spark):
    file = jpeg.encode(40, 24, smooth(40, 24), 80, interval=4)
    df = spark.createDataFrame([(1, file), (2, b"no")], "image_id int, content binary")
    seg = images.jpeg_segments(df)
    assert seg.filter("image_id = 2").first().error and seg.filter("image_id = 1 AND marker = 219").count() == 2
    assert images.jpeg_quant_tables(seg).groupBy("dest").count().count() == 2
    codes = images.jpeg_huffman_tables(seg).groupBy("class", "dest").count().collect()
    assert sorted(r["count"] for r in codes) == [12, 12, 162, 162]
    parts = images.restart_segments(df)
    assert parts.filter("image_id = 1").count() == 4 and parts.filter("error IS NOT NULL").count() == 1
    blocks = images.decode_restart_segments(parts.repartition(3)).orderBy("mcu", "comp").collect()
    want = jpeg.coefficients(jpeg.parse(file))
    assert [b.coef for b in blocks] == want.reshape(-1, 64).tolist()


def test_files_pixels_and_sinks(spark, tmp_path):
    datasource.register(spark)
    data = {f"i{i}": noise(3 + i, 2) for i in range(3)}
    df = spark.createDataFrame([(n, 3 + i, 2, d) for i, (n, d) in enumerate(data.items())], "name string, width int, height int, data binary")
    for kind in ("bmp", "jpeg"):
        df.write.format(kind).option("quality", 100).mode("append").save(str(tmp_path / kind))
        back = spark.read.format(kind).load(str(tmp_path / kind)).collect()
        assert len(back) == 3 and all(r.error is None for r in back)
    assert {bytes(r.data) for r in spark.read.format("bmp").load(str(tmp_path / "bmp")).collect()} == set(data.values())
    (tmp_path / "bmp" / "x.txt").write_text("no image")
    found = images.files(spark, str(tmp_path))
    assert {(r.format, r.n) for r in found.groupBy("format").agg(F.count("*").alias("n")).collect()} == {("bmp", 3), ("jpeg", 3), ("none", 1)}
    px = images.pixels(images.decode(found.filter("format = 'bmp'")))
    assert px.count() == 2 * (3 + 4 + 5)
    one = px.filter("width = 3").orderBy("y", "x").collect()
    assert bytes(v for r in one for v in (r.r, r.g, r.b)) == data["i0"]


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    data = noise(4, 3)
    (tmp_path / "in" / "a.bmp").write_bytes(bmp.encode(4, 3, data))
    (tmp_path / "in" / "b.bmp").write_bytes(b"broken")
    q = streaming.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), "jpeg")
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    good = [r for r in rows if r.error is None]
    assert len(rows) == 2 and len(good) == 1 and jpeg.decode(bytes(good[0].content))[:2] == (4, 3)
    q = streaming.counts(streaming.new_files(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.format, r.files) for r in spark.sql("SELECT format, files FROM seen").collect()} == {("bmp", 1), ("none", 1)}


IMAGES = "name string, width int, height int, data binary"


def test_sink_modes_folders_and_clashes(spark, tmp_path):
    datasource.register(spark)
    out = tmp_path / "out"

    def save(rows, mode, **options):
        spark.createDataFrame(rows, IMAGES).repartition(3).write.format("bmp").options(**options).mode(mode).save(str(out))

    a, b = noise(2, 2), noise(3, 1)
    save([("a", 2, 2, a), ("x/a", 3, 1, b), ("a", 2, 2, a)], "append")  # equal rows are one file
    assert sorted(str(p.relative_to(out)) for p in out.rglob("*.*")) == ["a.bmp", "x/a.bmp"]
    save([("a", 3, 1, b)], "append")
    assert bmp.decode((out / "a.bmp").read_bytes())[2] == b and (out / "x" / "a.bmp").exists()
    (out / "note.txt").write_text("stays")
    for rows in ([("c", 2, 2, a), ("c", 3, 1, b)], [("c", 2, 2, None)], [("c", 2, 2, b)], [("../c", 2, 2, a)], [(None, 2, 2, a)]):
        with pytest.raises(Exception):
            save(rows, "overwrite")
        assert sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()) == ["a.bmp", "note.txt", "x/a.bmp"]  # as it was
    save([("c", 2, 2, a), ("d", 2, 2, None), ("e", 2, 2, b)], "overwrite", skipInvalid="true")
    assert sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()) == ["c.bmp", "note.txt"]


def test_missing_images_are_error_rows(spark):
    df = spark.createDataFrame([("good", 2, 2, noise(2, 2)), ("null", 2, 2, None), ("size", 3, 3, noise(2, 2)), ("none", None, 2, noise(2, 2))], IMAGES)
    for encode in (images.encode_bmp, images.encode_jpeg):
        rows = {r.name: r for r in encode(df).collect()}
        assert {n for n, r in rows.items() if r.error} == {"null", "size", "none"} == {n for n, r in rows.items() if r.content is None}


def test_convert_keeps_folders(spark, tmp_path, monkeypatch):
    from rasterbrook.__main__ import main

    (tmp_path / "in" / "b.d").mkdir(parents=True)
    for name in ("x.bmp", "b.d/x.bmp"):
        (tmp_path / "in" / name).write_bytes(bmp.encode(2, 2, noise(2, 2)))
    monkeypatch.setattr("sys.argv", ["rasterbrook", "convert", str(tmp_path / "in"), str(tmp_path / "out"), "--to", "jpeg"])
    assert main() == 0
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.*") if p.is_file()) == ["b.d/x.jpeg", "x.jpeg"]


def test_broken_segments_are_error_rows(spark):
    file = jpeg.encode(40, 24, smooth(40, 24), 80, interval=4)
    parts = images.restart_segments(spark.createDataFrame([(1, file)], "image_id int, content binary"))
    broken = parts.withColumn("bytes", F.when(F.col("seg") == 1, F.unhex(F.lit("FEFEFE"))).otherwise(F.col("bytes")))
    rows = images.decode_restart_segments(broken.coalesce(1)).collect()
    bad = [r for r in rows if r.error]
    assert len(bad) == 1 and (bad[0].mcu, bad[0].comp, bad[0].coef) == (4, None, None)
    assert len(rows) == 1 + 3 * (15 - 4)


@pytest.mark.parametrize("h,v,interval", [(2, 2, 0), (2, 1, 1), (4, 2, 2)])
def test_packed_coefficients_come_back(h, v, interval):
    w, high = 37, 41
    coded = rng.integers(-60, 60, (-(-w // (8 * h)) * -(-high // (8 * v)), h * v + 2, 64))
    file = jpeg.pack(w, high, coded, [jpeg.scaled(t, 60) for t in (tables.LUMA_QUANT, tables.CHROMA_QUANT)], (h, v), True, interval)
    assert (jpeg.coefficients(jpeg.parse(file)) == coded).all()


def test_blocks_of_other_lengths_are_null(spark):
    from rasterbrook.operators import blocks

    df = spark.createDataFrame([(1, [1.0] * 64), (2, [1.0] * 10), (3, None), (4, [])], "id int, block array<double>").coalesce(1)
    assert {r.id: r.block is None for r in blocks.forward_dct(df).collect()} == {1: False, 2: True, 3: True, 4: True}


@pytest.mark.parametrize("short,want", [(0, 133), (2e-7, 133), (2e-6, 132)])
def test_samples_are_rounded_to_six_places_as_in_sql(short, want):
    steps = [np.full(64, 8 * (5 - short)), np.ones(64), np.ones(64)]
    found = {"frame": {"width": 8, "height": 8, "components": [(1, 1, 1, 0), (2, 1, 1, 1), (3, 1, 1, 1)]}, "scan": {"parts": [(c, None, None, steps[c]) for c in range(3)]}}
    coded = np.zeros((1, 3, 64), np.int64)
    coded[0, 0, 0] = 1
    assert set(jpeg.to_rgb(found, [coded])) == {want}


def test_a_side_that_a_frame_cannot_hold_is_an_error(spark):
    coef = np.zeros((8193, 3, 64), np.int64)
    steps = [np.ones(64), np.ones(64)]
    for width, height in ((8, 65544), (65544, 8)):
        with pytest.raises(ValueError):
            jpeg.pack(width, height, coef, steps, (1, 1))
    made = images.pack_jpeg(spark.createDataFrame([(8, 65544, coef.ravel().tolist())], "width int, height int, coef array<int>"), 1, 1)
    assert [(r.content, bool(r.error)) for r in made.collect()] == [(None, True)]
