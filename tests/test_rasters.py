from pyspark.sql import functions as F

from rasterbrook.operators import rasters

SCHEMA = "g int, y int, width int, height int, row binary"


def rows(spark, size=1):
    made = [(g, y, 3, 5, bytearray((g * 100 + y * 3 * size + i) % 256 for i in range(3 * size))) for g in (1, 2) for y in range(5)]
    return spark.createDataFrame([*made, (3, 0, 3, 1, None), (4, 1, 3, 2, bytearray(3 * size))], SCHEMA)


def by_row(df):
    return {(r.g, r.y): None if r.row is None else bytes(r.row) for r in df.collect()}


def test_flips_and_pixels(spark):
    for size in (1, 3):
        df = rows(spark, size)
        plain = by_row(df)
        cut = lambda row: [row[i : i + size] for i in range(0, len(row), size)]
        assert by_row(rasters.flip_horizontal(df, size)) == {k: None if v is None else b"".join(reversed(cut(v))) for k, v in plain.items()}
        assert by_row(rasters.flip_vertical(df.filter("g < 3"))) == {(g, 4 - y): v for (g, y), v in plain.items() if g < 3}
        got = {(r.g, r.y): r for r in df.select("g", "y", rasters.pixel(F.col("row"), 2, size).alias("last"), rasters.pixel(F.col("row"), 3, size).alias("out")).collect()}
        assert all(r.out is None and (plain[k] is None or bytes(r.last) == cut(plain[k])[2]) for k, r in got.items())


def test_swap(spark):
    for a, b in (((0, 0), (2, 4)), ((0, 1), (2, 1)), ((1, 1), (1, 1))):
        want = {k: None if v is None else bytearray(v) for k, v in by_row(rows(spark)).items()}
        for g in (1, 2):
            want[g, a[1]][a[0]], want[g, b[1]][b[0]] = want[g, b[1]][b[0]], want[g, a[1]][a[0]]
        if a[1] == b[1] == 1:
            row = want[4, 1]
            row[a[0]], row[b[0]] = row[b[0]], row[a[0]]
        assert by_row(rasters.swap_pixels(rows(spark), ["g"], a, b)) == {k: None if v is None else bytes(v) for k, v in want.items()}
    assert by_row(rasters.swap_pixels(rows(spark), ["g"], (0, 0), (9, 9))) == by_row(rows(spark))


def test_bands_and_images(spark):
    df = rows(spark)
    cut = {(r.g, r.band): (r.n_rows, None if r.data is None else bytes(r.data)) for r in rasters.bands(df, ["g"], 2).collect()}
    plain = by_row(df)
    assert cut[1, 0] == (2, plain[1, 0] + plain[1, 1]) and cut[2, 2] == (1, plain[2, 4])
    assert cut[3, 0] == (1, None) and cut[4, 0] == (1, None)
    whole = {r.g: None if r.data is None else bytes(r.data) for r in rasters.image_bytes(rasters.bands(df, ["g"], 2), ["g"]).collect()}
    assert whole == {1: b"".join(plain[1, y] for y in range(5)), 2: b"".join(plain[2, y] for y in range(5)), 3: None, 4: None}
    assert rasters.image_bytes(rasters.bands(df.limit(0), ["g"]), ["g"]).count() == 0


def test_blocks_to_rows(spark):
    block = lambda col: [(8 * (p // 8) + p % 8 + 64 * col) % 256 for p in range(64)]
    made = [(1, 0, c, 12, 5, block(c)) for c in (1, 0)] + [(2, 0, 0, 12, 5, block(0))]
    placed = spark.createDataFrame(made, "g int, block_row int, block_col int, width int, height int, samples array<int>")
    got = by_row(rasters.rows_of_blocks(placed, ["g"]))
    assert got[1, 4] == bytes(block(0)[32:40] + block(1)[32:36]) and len(got) == 10
    assert all(got[2, y] is None for y in range(5))
