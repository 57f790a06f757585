import hashlib
import zlib
from collections import Counter, namedtuple

from helpers import check_sql, empty, odd

from rasterbrook.llm import sharding


def check(rows, docs, shards=16):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=repr) == sorted(((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs), key=repr)
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))


def test_whole_table(spark, sf_dir):
    rows = sharding.query(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()
    check(rows, docs)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    source = {d.doc_id: d.source for d in docs}
    whole = Counter(source.values())
    for s in range(16):
        mix = Counter(source[r.doc_id] for r in rows if r.shard == s)
        assert all(abs(mix[k] - n / 16) <= 1 for k, n in whole.items())


def test_against_sql(spark, tiny_dir):
    check_sql(spark, sharding.query, sharding.ORACLE_SQL, tiny_dir, ["documents"])


def naive(docs, shards, seed):
    """Ranks inside each source, fractions and cuts, in plain Python."""
    Row = namedtuple("Row", "doc_id s k")
    key = lambda r: int(hashlib.md5(f"{seed}:{r.doc_id}:{zlib.crc32((r.text or '').encode())}".encode()).hexdigest()[:15], 16)
    rows = [Row(r.doc_id, "" if r.source is None else "=" + r.source, key(r)) for r in docs.collect()]
    whole = Counter(r.s for r in rows)
    rank, order = Counter(), []
    for r in sorted(rows, key=lambda r: (r.k, r.doc_id)):
        rank[r.s] += 1
        order.append(((2 * rank[r.s] - 1) / whole[r.s], r.s, r.k, r.doc_id))
    order.sort()
    out, slots = [], Counter()
    for p, x in enumerate(order):
        shard = p * shards // len(order)
        out.append((x[3], shard, slots[shard]))
        slots[shard] += 1
    return sorted(out)


def test_against_plain_ranks_with_a_hot_source(spark, tiny_dir, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 10)
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet").selectExpr("doc_id", "text", "CASE WHEN doc_id % 3 = 0 THEN 'hot' ELSE source END AS source")
    got = sorted((r.doc_id, r.shard, r.slot) for r in sharding.interleave(docs, 7, 5).collect())
    assert got == naive(docs, 7, 5)


def test_odd_rows_and_empty(spark, tmp_path):
    docs = odd(spark)
    check(sharding.interleave(docs).collect(), docs.collect())
    assert sharding.interleave(empty(spark)).collect() == []
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and set(docs.columns) <= set(back.columns)
