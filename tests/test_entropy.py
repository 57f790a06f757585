import resource

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterbrook.sources import chunked, datasource, entropy, images, jpeg


def picture(width, height, noise=20, seed=1):
    y, x = np.mgrid[0:height, 0:width]
    base = np.stack([(np.sin(x / 17) + np.cos(y / 23)) * 60 + 128, np.sin(x / 7 + y / 11) * 60 + 128, (x + y) % 256], 2)
    return np.clip(base + np.random.default_rng(seed).normal(0, noise, (height, width, 3)), 0, 255).astype(np.uint8).tobytes()


def streams(data):
    tasks = jpeg._tasks(jpeg.parse(data))
    parts, n, patterns, dc, ac = zip(*tasks, strict=True)
    return entropy.Streams(parts, patterns, dc, ac), np.array(n)


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 120), st.integers(1, 120), st.integers(5, 100), st.integers(0, 60), st.booleans(), st.sampled_from([0, 3, 40]))
def test_chunks_equal_one_decoder(width, height, quality, noise, optimise, interval):
    data = jpeg.encode(width, height, picture(width, height, noise), quality, optimise=optimise, interval=interval)
    for chunk in (entropy.LONGEST_BLOCK + 1, entropy.CHUNK):
        for a, b in zip(entropy.decode(*streams(data), chunk), entropy.decode(*streams(data), 1 << 40), strict=True):
            assert np.array_equal(a, b)


def test_chunks_of_one_table_for_all_blocks():
    """Where bits alone can't tell luma from chroma, block kinds count modulo one."""
    data = jpeg.encode(160, 120, picture(160, 120))
    found = jpeg.parse(data)
    luma = found["scan"]["parts"][0]
    coded = jpeg.coefficients(found).astype(int)
    block, symbol, value, is_dc = jpeg.symbols_of(coded, 0, [0, 1, 2])
    codes = [jpeg.tables.codes(*map(list, t)) for t in luma[1:3]]
    bits = "".join(f"{c:0{n}b}" + (f"{v if v > 0 else v - 1 + (1 << (s & 15)):0{s & 15}b}" if s & 15 else "") for s, v, d in zip(symbol.tolist(), value.tolist(), is_dc, strict=True) for c, n in [codes[0 if d else 1][s]])
    bits += "1" * (-len(bits) % 8)
    part = int(bits, 2).to_bytes(len(bits) // 8, "big")
    dc, ac = [jpeg.lookup(*luma[1])] * 3, [jpeg.lookup(*luma[2])] * 3
    own = entropy.Streams([part], [(0, 1, 2)], [dc], [ac])
    assert own.period.tolist() == [1]
    assert np.array_equal(entropy.decode(own, np.array([len(coded)]))[0], coded)


def test_long_segments_are_fast_and_in_step():
    data = jpeg.encode(256, 256, picture(256, 256, 0), 90)
    rounds = []
    own, n = streams(data)
    before = entropy.measure
    try:
        entropy.measure = lambda s, lanes, which, passed: rounds.append(len(which)) or before(s, lanes, which, passed)
        entropy.decode(own, n)
    finally:
        entropy.measure = before
    assert len(rounds) <= 6 and rounds[0] > 20


def test_broken_segments_beside_whole_ones():
    good = jpeg.encode(64, 64, picture(64, 64), 80)
    at = good.index(b"\xff\xda") + 14
    cut, wrong, rest = good[: at + 40] + b"\xff\xd9", good[:at] + b"\xfe" * 300 + good[at + 300 :], good[:-2] + b"\x12" * 50 + b"\xff\xd9"
    found = jpeg.decode_many([good, cut, wrong, rest, good])
    assert found[0] == found[4] == jpeg.decode(good)
    assert all(isinstance(x, ValueError) for x in found[1:4])


def vast(interval=None, width=65_000, height=65_000):
    """A small file that says it is large."""
    data = jpeg.encode(16, 16, picture(16, 16), interval=1 if interval else 0)
    at = data.index(b"\xff\xc0")
    data = data[: at + 5] + height.to_bytes(2, "big") + width.to_bytes(2, "big") + data[at + 9 :]
    return data


def short_interval():
    data = jpeg.encode(16, 16, picture(16, 16), interval=1)
    at = data.index(b"\xff\xdd")
    return data[:at] + b"\xff\xdd\x00\x03\x01" + data[at + 6 :]


@pytest.mark.parametrize("data", [vast(), vast(True), vast(None, 20_000, 8_000), short_interval()])
def test_small_files_that_say_too_much_are_error_rows(spark, tmp_path, data):
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    with pytest.raises(ValueError):
        jpeg.decode(data)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
    (tmp_path / "a.jpeg").write_bytes(data)
    (tmp_path / "b.jpeg").write_bytes(jpeg.encode(8, 8, picture(8, 8)))
    datasource.register(spark)
    rows = {r.path[-6]: r for r in spark.read.format("jpeg").load(str(tmp_path)).collect()}
    assert rows["a"].error and rows["a"].data is None and rows["b"].error is None
    files = images.files(spark, str(tmp_path)).select("path", "content")
    assert sorted(r.error is None for r in images.decode(files).collect()) == [False, True]
    segments = images.restart_segments(files)
    for done in (images.decode_restart_segments(segments), chunked.decode_chunks(segments, ["path"])):
        rows = done.collect()
        assert sum(r.error is None for r in rows) == 3
    assert any(r.error for r in segments.collect()) or any(r.error for r in rows)


def test_one_file_over_many_tasks(spark):
    data = [jpeg.encode(w, h, picture(w, h, n, i), q, interval=v) for i, (w, h, q, n, v) in enumerate([(300, 200, 85, 10, 0), (64, 64, 50, 5, 0), (300, 200, 85, 10, 400), (8, 8, 90, 0, 0)])]
    files = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "file int, content binary")
    segments = images.restart_segments(files)
    rows = chunked.decode_chunks(segments, ["file"], 512)
    assert chunked.chunks(segments, ["file"], 512).filter("file = 0").count() > 30
    got = {(r.file, r.mcu, r.comp, r.block): r.coef for r in rows.collect()}
    want = {(i, m, c, 0): blocks[c].tolist() for i, d in enumerate(data) for m, blocks in enumerate(jpeg.coefficients(jpeg.parse(d)))for c in range(3)}
    assert got == want


def test_subsampled_blocks_are_numbered(spark):
    coef = np.zeros((40, 6, 64), int)
    coef[:, :, 0] = np.arange(240).reshape(40, 6) % 50
    coef[:, :, 5:40] = np.random.default_rng(2).integers(-20, 20, (40, 6, 35))
    steps = [np.ones(64)] * 2
    data = jpeg.pack(80, 128, coef, steps, (2, 2))
    files = spark.createDataFrame([(bytearray(data), "x")], "content binary, name string")
    got = {(r.mcu, r.comp, r.block): r.coef for r in chunked.decode_chunks(images.restart_segments(files), ["name"], 256).collect()}
    assert got == {(m, 0 if b < 4 else b - 3, b if b < 4 else 0): coef[m, b].tolist() for m in range(40) for b in range(6)}


def test_broken_long_segment_is_one_row(spark):
    good = jpeg.encode(200, 200, picture(200, 200), 90)
    at = good.index(b"\xff\xda") + 14
    wrong = good[: at + 5000] + b"\xfe" * 900 + good[at + 5900 :]
    files = spark.createDataFrame([("good", bytearray(good)), ("cut", bytearray(good[: at + 9000] + b"\xff\xd9")), ("wrong", bytearray(wrong))], "name string, content binary")
    rows = chunked.decode_chunks(images.restart_segments(files), ["name"], 1024).groupBy("name", "error").count().collect()
    found = {r.name: (r.error, r["count"]) for r in rows}
    assert found["good"] == (None, 625 * 3)
    assert all(found[n][0] and found[n][1] == 1 for n in ("cut", "wrong")) and len(rows) == 3
