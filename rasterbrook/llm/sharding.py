"""Proportional stratified interleaving of documents into equal shards, in DataFrame functions only.

Rows are shuffled inside each source by a seeded hash and ranked; row r of a
source of n rows gets the fraction (r - 1/2) / n; all rows are ordered by
fraction, and the order is cut into runs of equal length. Any run holds of
each source its share, to within a row. Law `rows`: shard counts are at most
one apart.

No rank is taken in one task: rows go to hash-prefix buckets (of a source, and
then of the fraction), a bucket's first rank is the running sum of the counts
before it, and only rows of one bucket are sorted together. A hot source is
spread over its buckets like any other; their number grows with the table.
Running sums are taken in two steps, over groups of buckets and within each, so
that a task reads about the square root of the number of buckets.

Defined results: null text counts as empty; a null source is a stratum of its
own; a null doc_id is dealt like any value; equal rows take adjacent places,
so the result is the same set of rows on every run. An empty table gives none.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterbrook.llm.common import cut, table

SHARDS = 16
SEED = 20_240_601
#: Rows that a bucket holds about; rows that are equal all through share one.
BUCKET_ROWS = 256
#: Bits of the seeded hash.
KEY_BITS = 60


def _starts(counts: DataFrame, by: list[str], bucket: str, bits: int) -> DataFrame:
    """counts (by, bucket, n) with first: the rows of smaller buckets with the same `by`."""
    low = bits // 2

    def running(over: Window, order: str) -> Column:
        return F.coalesce(F.sum("n").over(over.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    counts = counts.withColumn("top", F.shiftright(bucket, low))
    groups = counts.groupBy(*by, "top").agg(F.sum("n").alias("n"))
    groups = groups.select(*by, "top", running(Window.partitionBy(*(by or [F.lit(0)])), "top").alias("base"))
    inner = counts.withColumn("first", running(Window.partitionBy(*by, "top"), bucket))
    return inner.join(groups, [*by, "top"]).withColumn("first", F.col("first") + F.col("base")).drop("top", "base")


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, size, text_crc32, stratum, shard, slot) and a struct `carried` of further columns, if any are named."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("stratum"),
        *([F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []),
    )
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("text_crc32").cast("string")).cast("binary"))
    base = base.withColumn("key", F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long"))
    base = cut(base)
    total = base.count()
    bits = max(0, ceil(log2(max(1, total) / BUCKET_ROWS)))
    base = base.withColumn("bucket", F.shiftright("key", KEY_BITS - bits).cast("int") if bits else F.lit(0))
    ties = ["key", "id", "size", "text_crc32"]

    counts = base.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    sizes = base.groupBy("stratum").agg(F.count("*").alias("of"))
    starts = _starts(counts, ["stratum"], "bucket", bits).join(sizes, "stratum").select("stratum", "bucket", "first", "of")
    rank = F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy(*ties)) + F.col("first")
    ranked = base.join(starts, ["stratum", "bucket"]).withColumn("twice", 2 * rank - 1).drop("bucket", "first")
    # the fraction's bucket in whole numbers: (2r - 1) / 2n of 2^bits
    ranked = cut(ranked.withColumn("bin", F.expr(f"(twice * {1 << bits}L) div (2 * of)")))

    bins = _starts(ranked.groupBy("bin").agg(F.count("*").alias("n")), [], "bin", bits).select("bin", "first")
    place = F.row_number().over(Window.partitionBy("bin").orderBy(F.col("twice") / F.col("of"), "stratum", *ties)) - 1 + F.col("first")
    placed = ranked.join(bins, "bin").withColumn("place", place.cast("long"))
    shard = F.expr(f"(place * {shards}L) div {max(1, total)}L")
    return placed.withColumn("shard", shard.cast("int")).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        "stratum",
        "shard",
        F.expr(f"place - (shard * {total}L + {shards - 1}L) div {shards}L").alias("slot"),
        *(["carried"] if carry else []),
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The rows of docs as Parquet, a folder per shard, each in the order of its slots; columns _shard and _slot are added, under longer names where docs has them."""

    def free(name: str) -> str:
        while name in docs.columns:
            name = f"_{name}"
        return name

    shard, slot = free("_shard"), free("_slot")
    dealt = interleave(docs, carry=tuple(docs.columns), **options)
    dealt.repartition("shard").sortWithinPartitions("shard", "slot").select("carried.*", F.col("shard").alias(shard), F.col("slot").alias(slot)).write.partitionBy(shard).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = interleave(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_TABLE_SQL = "SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b : CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n))"

ORACLE_SQL = f"""
WITH tab AS ({_TABLE_SQL}),
hx AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, source, length(h) // 2 + 1 AS size, list_transform(regexp_extract_all(h, '..'), lambda x : CAST(('0x' || x) AS BIGINT)) AS l FROM hx),
c AS (SELECT doc_id, source, size, xor(list_reduce(list_prepend(4294967295, l), lambda a, x : xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS crc FROM b, tab),
k AS (SELECT *, coalesce('=' || source, '') AS stratum, CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(crc AS VARCHAR)), 1, {KEY_BITS // 4})) AS BIGINT) AS key FROM c),
r AS (SELECT *, 2 * row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id, size, crc) - 1 AS twice, count(*) OVER (PARTITION BY stratum) AS n FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY CAST(twice AS DOUBLE) / n, stratum, key, doc_id, size, crc) - 1 AS place, count(*) OVER () AS total FROM r),
s AS (SELECT *, place * {SHARDS} // total AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(place - (shard * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
