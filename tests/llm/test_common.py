import pyarrow as pa
from pyspark.sql import functions as F

from rasterbrook.llm import common


def batches():
    yield pa.record_batch([pa.array([1, 2, 3]), pa.array(["aaaa", None, "b" * 100])], names=["id", "text"])
    yield pa.record_batch([pa.array([4, 5]), pa.array(["c", "d"])], names=["id", "text"])
    yield pa.record_batch([pa.array([], pa.int64()), pa.array([], pa.string())], names=["id", "text"])


def test_slices_keep_every_row_in_order():
    for limit in (1, 5, 1000):
        found = [(b.column(0).to_pylist(), texts) for b, texts in common.chunks(batches(), limit=limit)]
        assert [i for ids, _ in found for i in ids] == [1, 2, 3, 4, 5]
        assert [t for _, texts in found for t in texts] == ["aaaa", None, "b" * 100, "c", "d"]
        assert all(len(ids) == len(texts) for ids, texts in found)


def test_batches_are_bounded(spark):
    def run(parts):
        for b in parts:
            yield pa.record_batch([pa.array([b.nbytes])], names=["n"])

    rows = spark.range(300).coalesce(1).select(F.repeat(F.lit("x"), 100_000).alias("t"))
    sizes = [r.n for r in common.map_batches(rows, run, "n long").collect()]
    assert sum(sizes) > 30_000_000 and max(sizes) <= common.BATCH_BYTES + 200_000
    assert [common._bytes(x) for x in ("5", "64m", "67108864b", "2KB", "1g")] == [5, 64 << 20, 64 << 20, 2048, 1 << 30]


def test_folds_and_lower_case(spark):
    import zlib

    rows = spark.range(50).select("id", common.fold(5, "id").alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)
    assert spark.range(1).select(common.ascii_lower(F.lit("AbÀÉZ"))).first()[0] == "abÀÉz"
