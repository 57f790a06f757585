"""Queries over the driver's tables by way of the operators, and the SQL that each is held against.

`blk`: each embedding is an 8x8 block of samples 0..255; an image is all blocks
of a label. Sums are rounded to six places before they are quantised, so the
order in which an engine adds does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterbrook.functions import bits, codec, tables
from rasterbrook.operators import bit_cursor, blocks, huffman, palette, rasters, scan, segments
from rasterbrook.sources import bmp, chunked, images, table_functions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SQL_TYPES = {"l": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN"}
SPARK_TYPES = {"l": "long", "d": "double", "s": "string", "b": "boolean"}


def query(columns: str, sql: str | None = None):
    """Registers a query under its function's name; columns: name:type with l, d, s or b; d is rounded to four places."""
    spec = [c.split(":") for c in columns.split()]

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*((F.round(F.col(n).cast("double"), 4) + 0.0 if t == "d" else F.col(n).cast(SPARK_TYPES[t])).alias(n) for n, t in spec))

        QUERIES[f.__name__] = run
        if sql is not None:
            head, _, body = sql.rpartition("FINALLY")
            chosen = ", ".join(f"round(CAST({n} AS DOUBLE), 4) + 0.0 AS {n}" if t == "d" else f"CAST({n} AS {SQL_TYPES[t]}) AS {n}" for n, t in spec)
            ORACLES[f.__name__] = f"{head}SELECT {chosen} FROM ({body})"
        return f

    return register


def _list(values) -> str:
    return "[" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in values) + "]"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\nFINALLY "


# Common table expressions of the oracles

BLK = "blk AS (SELECT vec_id, label, pos, CAST(greatest(0, least(255, floor((CAST(embedding[pos + 1] AS DOUBLE) + 1) * 127.5))) AS BIGINT) AS s FROM embeddings, range(64) r(pos))"
NUMBERED = "numbered AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings)"
BASIS = """basis AS (SELECT k, pos, (CASE WHEN k // 8 = 0 THEN sqrt(0.125) ELSE 0.5 END) * (CASE WHEN k % 8 = 0 THEN sqrt(0.125) ELSE 0.5 END)
  * cos((2 * (pos // 8) + 1) * (k // 8) * pi() / 16) * cos((2 * (pos % 8) + 1) * (k % 8) * pi() / 16) AS w FROM range(64) a(k), range(64) b(pos))"""
COEF = "coef AS (SELECT vec_id, label, k, sum((s - 128) * w) AS c FROM blk JOIN basis USING (pos) GROUP BY vec_id, label, k)"
LUMA = f"luma AS (SELECT generate_subscripts(l, 1) - 1 AS k, unnest(l) AS q FROM (SELECT {_list(tables.LUMA_QUANT)} AS l))"
QUANT = "quant AS (SELECT vec_id, label, k, CAST(round(round(c, 6) / q) AS BIGINT) AS v FROM coef JOIN luma USING (k))"
ZZ = "zz AS (SELECT k, row_number() OVER (ORDER BY k // 8 + k % 8, CASE WHEN (k // 8 + k % 8) % 2 = 0 THEN k % 8 ELSE k // 8 END) - 1 AS z FROM range(64) r(k))"
SYMBOLS = """zq AS (SELECT vec_id, label, z, v FROM quant JOIN zz USING (k)),
nz AS (SELECT vec_id, label, z, v, z - coalesce(lag(z) OVER (PARTITION BY vec_id ORDER BY z), 0) - 1 AS gap FROM zq WHERE z > 0 AND v <> 0),
parts AS (SELECT vec_id, label, z, 9 AS j, (gap % 16) * 16 + length(bin(abs(v))) AS symbol, v AS value FROM nz
  UNION ALL SELECT vec_id, label, z, unnest(range(gap // 16)), 240, 0 FROM nz WHERE gap >= 16
  UNION ALL SELECT vec_id, any_value(label), 64, 0, 0, 0 FROM zq GROUP BY vec_id HAVING coalesce(max(z) FILTER (WHERE v <> 0 AND z > 0), 0) < 63),
symbols AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY z, j) - 1 AS seq, symbol, value FROM parts)"""


def _default_lengths_sql() -> str:
    rows = [(n, c, i, size, s) for n, (c, counts, symbols) in tables.HUFFMAN.items() for i, (size, s) in enumerate(zip(tables.lengths(counts), symbols, strict=True))]
    return "lens AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {c}, {i}, {z}, {s})" for n, c, i, z, s in rows) + ") t(name, class, ord, len, symbol))"


LENS = _default_lengths_sql()
CODES = "codes AS (SELECT *, CAST(coalesce(sum(1 << (16 - len)) OVER (PARTITION BY name ORDER BY len, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) >> (16 - len) AS code FROM lens)"
QUANTISED = (BLK, BASIS, COEF, LUMA, QUANT)


# Inputs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blk(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """(vec_id, label, block): samples less shift."""
    sample = lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 1) * 127.5))) - shift
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", sample).alias("block"))


def coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.forward_dct(blk(spark, sf_dir, 128).withColumn("block", F.col("block").cast("array<double>")))


def quantised(spark: SparkSession, sf_dir: str, zigzag: bool = False) -> DataFrame:
    done = coefficients(spark, sf_dir).withColumn("block", blocks.quantise(F.col("block"), tables.LUMA_QUANT))
    return done.withColumn("block", blocks.zigzag(F.col("block"))) if zigzag else done


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.ac_encode(quantised(spark, sf_dir, True))


def default_codes(spark: SparkSession) -> DataFrame:
    return huffman.canonical(tables.huffman_lengths_df(spark), ["name"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward DCT, quantisation and a count per coefficient and value."""
    return huffman.histogram(blocks.explode(quantised(spark, sf_dir)), ["k"], "v")


@query("k:l v:l n:l", _with(*QUANTISED) + "SELECT k, v, count(*) AS n FROM quant GROUP BY k, v")
def coefficient_histogram(spark, sf_dir):
    return flagship(spark, sf_dir)


# Colour

RGB = """rgb AS (SELECT a.vec_id AS g, a.pos, a.s AS r, b.s AS gr, c.s AS b FROM blk a JOIN blk b ON b.vec_id = a.vec_id AND b.pos = (a.pos + 21) % 64
  JOIN blk c ON c.vec_id = a.vec_id AND c.pos = (a.pos + 42) % 64)"""


def _triples(spark, sf_dir):
    """(g, pos, r, gr, b): a vector and its rotations by 21 and 42 places as the planes of a block."""
    turned = lambda n: F.concat(F.slice("block", n + 1, 64 - n), F.slice("block", 1, n))
    zipped = F.arrays_zip(F.col("block").alias("r"), turned(21).alias("gr"), turned(42).alias("b"))
    return blk(spark, sf_dir).select(F.col("vec_id").alias("g"), F.posexplode(zipped).alias("pos", "x")).select("g", "pos", "x.*")


@query("g:l pos:l y:d cb:d cr:d", _with(BLK, RGB) + "SELECT g, pos, 0.299 * r + 0.587 * gr + 0.114 * b - 128 AS y, -0.168736 * r - 0.331264 * gr + 0.5 * b AS cb, 0.5 * r - 0.418688 * gr - 0.081312 * b AS cr FROM rgb")
def rgb_to_ycbcr(spark, sf_dir):
    df = _triples(spark, sf_dir)
    return df.withColumns(codec.rgb_to_ycbcr(F.col("r").cast("double"), F.col("gr").cast("double"), F.col("b").cast("double"))).select("g", "pos", "y", "cb", "cr")


@query(
    "g:l pos:l r:l gr:l b:l",
    _with(BLK, RGB, "c AS (SELECT g, pos, CAST(r AS DOUBLE) AS y, CAST(gr AS DOUBLE) - 128 AS cb, CAST(b AS DOUBLE) - 128 AS cr FROM rgb)")
    + "SELECT g, pos, floor(round(greatest(0, least(255, y + 1.402 * cr)), 6)) AS r, floor(round(greatest(0, least(255, y - 0.344 * cb - 0.714 * cr)), 6)) AS gr, floor(round(greatest(0, least(255, y + 1.772 * cb)), 6)) AS b FROM c",
)
def ycbcr_to_rgb(spark, sf_dir):
    d = lambda c: F.col(c).cast("double") - 128
    rgb = codec.ycbcr_to_rgb(d("r"), d("gr"), d("b"))
    return _triples(spark, sf_dir).select("g", "pos", *(codec.to_byte(F.round(rgb[a], 6)).alias(b) for a, b in (("r", "r"), ("g", "gr"), ("b", "b"))))


# Transform and quantisation


@query("vec_id:l k:l c:d", _with(BLK, BASIS, COEF) + "SELECT vec_id, k, c FROM coef")
def fdct_8x8(spark, sf_dir):
    return blocks.explode(coefficients(spark, sf_dir), value="c")


@query("vec_id:l k:l c:d", _with(BLK, BASIS, COEF) + "SELECT vec_id, k, c FROM coef")
def fdct_8x8_join(spark, sf_dir):
    long = blocks.explode(blk(spark, sf_dir, 128), place="pos", value="s")
    return blocks.forward_dct_rows(long, ["vec_id", "label"])


@query("vec_id:l pos:l s:d", _with(BLK, BASIS) + "SELECT vec_id, b.pos, sum((s - 128) * w) AS s FROM blk JOIN basis b ON blk.pos = b.k GROUP BY vec_id, b.pos")
def idct_8x8(spark, sf_dir):
    df = blocks.inverse_dct(blk(spark, sf_dir, 128).withColumn("block", F.col("block").cast("array<double>")))
    return blocks.explode(df, place="pos", value="s")


@query("vec_id:l k:l c:d", _with(BLK, BASIS, COEF) + "SELECT vec_id, k, c FROM coef")
def fdct_separable(spark, sf_dir):
    return blocks.explode(blocks.forward_dct_separable(blk(spark, sf_dir, 128)), value="c")


@query("vec_id:l pos:l s:d", _with(BLK, BASIS) + "SELECT vec_id, b.pos, sum((s - 128) * w) AS s FROM blk JOIN basis b ON blk.pos = b.k GROUP BY vec_id, b.pos")
def idct_separable(spark, sf_dir):
    return blocks.explode(blocks.inverse_dct_separable(blk(spark, sf_dir, 128)), place="pos", value="s")


QTABLE = f"""base AS (SELECT 'luma' AS name, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS base FROM (SELECT {_list(tables.LUMA_QUANT)} AS l)
  UNION ALL SELECT 'chroma', generate_subscripts(l, 1) - 1, unnest(l) FROM (SELECT {_list(tables.CHROMA_QUANT)} AS l))"""


@query(
    "name:s quality:l k:l q:l parts:l",
    _with(QTABLE, "asked AS (SELECT p_partkey % 103 AS quality, greatest(1, least(100, p_partkey % 103)) AS c FROM part)")
    + "SELECT name, quality, k, round(greatest(1, least(255, base * CAST(CASE WHEN c < 50 THEN 5000 // c ELSE 200 - 2 * c END AS DOUBLE) / 100.0))) AS q, count(*) AS parts FROM base, asked GROUP BY ALL",
)
def qtable_scale(spark, sf_dir):
    """The steps at each part's quality, beyond 1 and 100 too, and how many parts ask for them."""
    asked = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 103).alias("quality")).agg(F.count("*").alias("parts"))
    bases = F.array(*(F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, t)).alias("steps")) for n, t in (("luma", tables.LUMA_QUANT), ("chroma", tables.CHROMA_QUANT))))
    rows = asked.select("*", F.inline(bases)).select("*", F.posexplode("steps").alias("k", "base"))
    return rows.select("name", "quality", "k", codec.quant_step(F.col("base"), F.col("quality")).alias("q"), "parts")


@query("vec_id:l k:l v:l", _with(*QUANTISED) + "SELECT vec_id, k, v FROM quant")
def quantize(spark, sf_dir):
    return blocks.explode(quantised(spark, sf_dir))


@query("vec_id:l k:l v:l", _with(*QUANTISED) + "SELECT vec_id, k, v * q AS v FROM quant JOIN luma USING (k)")
def dequantize(spark, sf_dir):
    return blocks.explode(quantised(spark, sf_dir).withColumn("block", blocks.dequantise(F.col("block"), tables.LUMA_QUANT)))


@query("vec_id:l z:l s:l", _with(BLK, ZZ) + "SELECT vec_id, z, s FROM blk JOIN zz ON pos = k")
def zigzag(spark, sf_dir):
    return blocks.explode(blk(spark, sf_dir).withColumn("block", blocks.zigzag(F.col("block"))), place="z", value="s")


@query("vec_id:l k:l s:l", _with(BLK, ZZ) + "SELECT vec_id, k, s FROM blk JOIN zz ON pos = z")
def dezigzag(spark, sf_dir):
    return blocks.explode(blk(spark, sf_dir).withColumn("block", blocks.dezigzag(F.col("block"))), place="k", value="s")


# Prediction and run length

DC = "dc AS (SELECT vec_id, label, v FROM quant WHERE k = 0)"


def _dc(spark, sf_dir):
    return quantised(spark, sf_dir).select("vec_id", "label", F.get("block", F.lit(0)).alias("v"))


@query("label:l vec_id:l diff:l", _with(*QUANTISED, DC) + "SELECT label, vec_id, v - lag(v, 1, 0) OVER (PARTITION BY label ORDER BY vec_id) AS diff FROM dc")
def dc_delta_encode(spark, sf_dir):
    return blocks.dc_encode(_dc(spark, sf_dir), ["label"], "vec_id", "v")


@query("label:l vec_id:l value:l", _with(*QUANTISED, DC) + "SELECT label, vec_id, sum(v) OVER (PARTITION BY label ORDER BY vec_id) AS value FROM dc")
def dc_delta_decode(spark, sf_dir):
    return blocks.dc_decode(_dc(spark, sf_dir), ["label"], "vec_id", "v")


@query("vec_id:l seq:l symbol:l value:l", _with(*QUANTISED, ZZ, SYMBOLS) + "SELECT vec_id, seq, symbol, value FROM symbols")
def ac_rle_encode(spark, sf_dir):
    return symbols(spark, sf_dir)


@query("vec_id:l k:l v:l", _with(*QUANTISED, ZZ) + "SELECT vec_id, z AS k, v FROM quant JOIN zz USING (k) WHERE z > 0 AND v <> 0")
def ac_rle_decode(spark, sf_dir):
    return blocks.ac_decode(symbols(spark, sf_dir), ["vec_id"])


@query("vec_id:l last:l", _with(*QUANTISED, ZZ) + "SELECT vec_id, coalesce(max(z) FILTER (WHERE v <> 0), -1) AS last FROM quant JOIN zz USING (k) GROUP BY vec_id")
def last_nonzero(spark, sf_dir):
    return quantised(spark, sf_dir, True).select("vec_id", blocks.last_nonzero(F.col("block")).alias("last"))


def _values(spark, sf_dir):
    return blocks.explode(quantised(spark, sf_dir))


@query("vec_id:l k:l n:l", _with(*QUANTISED) + "SELECT vec_id, k, CASE WHEN v = 0 THEN 1 ELSE length(bin(abs(v))) END AS n FROM quant")
def magnitude_category(spark, sf_dir):
    return _values(spark, sf_dir).withColumn("n", bits.magnitude_bits(F.col("v")))


SIZED = "sized AS (SELECT vec_id, k, v, CASE WHEN v = 0 THEN 0 ELSE length(bin(abs(v))) END AS size FROM quant)"


@query("vec_id:l k:l size:l code:l", _with(*QUANTISED, SIZED) + "SELECT vec_id, k, size, CASE WHEN v > 0 THEN v ELSE v - 1 + (1 << size) END AS code FROM sized")
def ssss_encode(spark, sf_dir):
    df = _values(spark, sf_dir).withColumn("size", codec.ssss(F.col("v")))
    return df.withColumn("code", codec.ssss_encode(F.col("size"), F.col("v")))


@query("vec_id:l k:l v:l", _with(*QUANTISED) + "SELECT vec_id, k, v FROM quant")
def ssss_decode(spark, sf_dir):
    df = _values(spark, sf_dir).withColumn("size", codec.ssss(F.col("v")))
    df = df.withColumn("code", codec.ssss_encode(F.col("size"), F.col("v")))
    return df.withColumn("v", codec.ssss_decode(F.col("size"), F.col("code")))


# Huffman


@query("label:l symbol:l n:l", _with(*QUANTISED, ZZ, SYMBOLS) + "SELECT label, symbol, count(*) AS n FROM symbols GROUP BY label, symbol")
def symbol_histogram(spark, sf_dir):
    return huffman.histogram(symbols(spark, sf_dir), ["label"])


@query(
    "label:l symbol:l n:l rank:l",
    _with(*QUANTISED, ZZ, SYMBOLS) + "SELECT label, symbol, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, symbol) AS rank FROM (SELECT label, symbol, count(*) AS n FROM symbols GROUP BY label, symbol)",
)
def symbols_by_frequency(spark, sf_dir):
    return huffman.by_frequency(huffman.histogram(symbols(spark, sf_dir), ["label"]), ["label"])


BYTES = "hx AS (SELECT row_number() OVER () AS rid, source, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL), byt AS (SELECT source, CAST(('0x' || x) AS BIGINT) AS symbol FROM (SELECT source, unnest(regexp_extract_all(h, '..')) AS x FROM hx))"


def _byte_counts(spark, sf_dir):
    return huffman.byte_histogram(table(spark, sf_dir, "documents"), ["source"], "text")


@query("source:s symbol:l n:l", _with(BYTES) + "SELECT source, symbol, count(*) AS n FROM byt GROUP BY source, symbol")
def byte_histogram(spark, sf_dir):
    return _byte_counts(spark, sf_dir)


MERGES = """cnt AS (SELECT source, symbol, count(*) AS n FROM byt GROUP BY ALL),
m AS (SELECT 0 AS step, source, symbol AS sym, symbol AS leader, CAST(n AS BIGINT) AS f, 0 AS size FROM cnt
  UNION ALL SELECT 0, source, 256, 256, 1, 0 FROM (SELECT DISTINCT source FROM cnt)
  UNION ALL SELECT step + 1, source, sym, CASE WHEN leader = v2 THEN v1 ELSE leader END, CASE WHEN leader IN (v1, v2) THEN f1 + f2 ELSE f END, size + CAST(leader IN (v1, v2) AS INT) FROM (
    SELECT *, k2 // 2000 AS f2, CASE WHEN k2 % 2000 >= 1000 THEN k2 % 2000 - 1000 ELSE 999 - k2 % 2000 END AS v2 FROM (
      SELECT *, min(CASE WHEN leader <> v1 THEN f * 2000 + CASE WHEN leader > v1 THEN 1000 + leader ELSE 999 - leader END END) OVER (PARTITION BY source) AS k2 FROM (
        SELECT *, 999 - k1 % 1000 AS v1, k1 // 1000 AS f1 FROM (SELECT *, min(f * 1000 + 999 - leader) OVER (PARTITION BY source) AS k1 FROM m)))) WHERE k2 IS NOT NULL),
sizes AS (SELECT source, sym, max(size) AS size FROM m GROUP BY ALL),
per AS (SELECT source, k, coalesce(n, 0) AS n FROM (SELECT DISTINCT source FROM sizes) CROSS JOIN range(33) r(k) LEFT JOIN (SELECT source, size AS k, count(*) AS n FROM sizes GROUP BY ALL) USING (source, k)),
shape AS (SELECT source, list(n ORDER BY k) AS c FROM per GROUP BY source),
lim AS (SELECT 0 AS step, source, c, 32 AS i FROM shape
  UNION ALL SELECT step + 1, source,
    CASE WHEN c[i + 1] > 0 THEN list_transform(range(33), lambda k : c[k + 1] - CASE WHEN k = i THEN 2 ELSE 0 END + CASE WHEN k = i - 1 THEN 1 ELSE 0 END + CASE WHEN k = j + 1 THEN 2 ELSE 0 END - CASE WHEN k = j THEN 1 ELSE 0 END) ELSE c END,
    CASE WHEN c[i + 1] > 0 THEN i ELSE i - 1 END FROM (SELECT *, coalesce(list_max(list_filter(range(1, i - 1), lambda k : c[k + 1] > 0)), 0) AS j FROM lim WHERE i > 16)),
short AS (SELECT source, c, list_max(list_filter(range(1, 17), lambda k : c[k + 1] > 0)) AS last FROM lim WHERE i = 16),
lens AS (SELECT source, k AS len, c[k + 1] - CAST(k = last AS INT) AS n FROM short, range(1, 17) r(k)),
ends AS (SELECT source, len, n, sum(n) OVER (PARTITION BY source ORDER BY len) AS hi FROM lens),
ordered AS (SELECT source, symbol, row_number() OVER (PARTITION BY source ORDER BY n DESC, symbol) - 1 AS ord FROM cnt)"""


@query("source:s ord:l len:l symbol:l", "WITH RECURSIVE " + BYTES + ",\n" + MERGES + "\nFINALLY SELECT o.source, ord, len, symbol FROM ordered o JOIN ends e ON e.source = o.source AND ord < hi AND ord >= hi - n")
def huffman_code_sizes(spark, sf_dir):
    return huffman.optimal_lengths(_byte_counts(spark, sf_dir), ["source"])


@query("source:s len:l n:l", "WITH RECURSIVE " + BYTES + ",\n" + MERGES + "\nFINALLY SELECT source, len, n FROM lens WHERE n > 0")
def code_length_histogram(spark, sf_dir):
    return huffman.length_histogram(huffman.optimal_lengths(_byte_counts(spark, sf_dir), ["source"]), ["source"])


OWN_CODES = """own AS (SELECT o.source, ord, len, symbol FROM ordered o JOIN ends e ON e.source = o.source AND ord < hi AND ord >= hi - n),
coded AS (SELECT *, CAST(coalesce(sum(1 << (16 - len)) OVER (PARTITION BY source ORDER BY len, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) >> (16 - len) AS code FROM own)"""


def _own_codes(spark, sf_dir):
    """(source, ord, len, symbol, code): the table made for the bytes of each source."""
    return huffman.canonical(huffman.optimal_lengths(_byte_counts(spark, sf_dir), ["source"]), ["source"])


@query("source:s ord:l len:l symbol:l code:l", "WITH RECURSIVE " + BYTES + ",\n" + MERGES + ",\n" + OWN_CODES + "\nFINALLY SELECT source, ord, len, symbol, code FROM coded")
def canonical_codes(spark, sf_dir):
    return _own_codes(spark, sf_dir)


@query(
    "source:s symbol:l len:l docs:l",
    "WITH RECURSIVE " + BYTES + ",\n" + MERGES + ",\n" + OWN_CODES + ",\nword AS (SELECT source, CAST('0x' || substr(h, 1, 4) AS BIGINT) AS word FROM hx WHERE length(h) >= 4)\n"
    "FINALLY SELECT w.source, symbol, len, count(*) AS docs FROM word w JOIN coded c ON c.source = w.source AND word >> (16 - len) = code GROUP BY ALL",
)
def prefix_lookup(spark, sf_dir):
    """The first code in each document's first 16 bits, read with the table of its source by equi-join; a word that begins no code has no row."""
    docs = table(spark, sf_dir, "documents").select("source", F.col("text").cast("binary").alias("data")).filter(F.octet_length("data") >= 2)
    words = docs.groupBy("source", bits.be_uint(F.col("data"), 0, 2).alias("prefix")).agg(F.count("*").alias("docs"))
    found = words.join(huffman.prefix_table(_own_codes(spark, sf_dir), ["source"]), ["source", "prefix"])
    return found.groupBy("source", "symbol", "len").agg(F.sum("docs").alias("docs"))


DC_SIZES = "dcs AS (SELECT label, length(ltrim(bin(abs(v - lag(v, 1, 0) OVER (PARTITION BY label ORDER BY vec_id))), '0')) AS size FROM quant WHERE k = 0)"
USED = "used AS (SELECT label, 1 AS class, symbol, count(*) AS n FROM symbols GROUP BY ALL UNION ALL SELECT label, 0, size, count(*) FROM dcs GROUP BY ALL)"


@query(
    "label:l name:s class:l symbol:l bits:s n:l",
    _with(*QUANTISED, ZZ, SYMBOLS, LENS, CODES, DC_SIZES, USED)
    + "SELECT label, name, class, symbol, lpad(bin(code), CAST(len AS INT), '0') AS bits, n FROM used JOIN codes USING (class, symbol)",
)
def default_huffman_tables(spark, sf_dir):
    """Codes of the four default tables for the symbols that the data have, with their counts."""
    ac = huffman.histogram(symbols(spark, sf_dir), ["label"]).withColumn("class", F.lit(1))
    size = blocks.dc_encode(_dc(spark, sf_dir), ["label"], "vec_id", "v").select("label", codec.ssss(F.col("diff")).alias("symbol"))
    used = ac.unionByName(huffman.histogram(size, ["label"]).withColumn("class", F.lit(0)))
    return used.join(F.broadcast(default_codes(spark)), ["class", "symbol"]).withColumn("bits", F.lpad(F.bin("code"), F.col("len"), "0"))


LUMA_AC = "ac AS (SELECT symbol, code, len FROM codes WHERE name = 'luma_ac')"


def _luma_ac(spark):
    return default_codes(spark).filter("name = 'luma_ac'")


@query("label:l n_bits:l", _with(*QUANTISED, ZZ, SYMBOLS, LENS, CODES, LUMA_AC) + "SELECT label, sum(len + symbol % 16) AS n_bits FROM symbols JOIN ac USING (symbol) GROUP BY label")
def encoded_bit_size(spark, sf_dir):
    return huffman.coded_size(symbols(spark, sf_dir), _luma_ac(spark), [], ["label"])


PACKED = """coded AS (SELECT vec_id, seq, lpad(bin(code), CAST(len AS INT), '0') || CASE WHEN symbol % 16 = 0 THEN '' ELSE lpad(bin(CASE WHEN value > 0 THEN value ELSE value - 1 + (1 << (symbol % 16)) END), CAST(symbol % 16 AS INT), '0') END AS bits FROM symbols JOIN ac USING (symbol)),
joined AS (SELECT vec_id, string_agg(bits, '' ORDER BY seq) AS b FROM coded GROUP BY vec_id),
filled AS (SELECT vec_id, rpad(b, CAST((length(b) + 7) // 8 * 8 AS INT), '1') AS b FROM joined),
cut AS (SELECT vec_id, i, substr(b, 8 * i + 1, 8) AS o FROM (SELECT vec_id, b, unnest(range(length(b) // 8)) AS i FROM filled)),
num AS (SELECT vec_id, i, list_sum([CAST(substr(o, 8 - j, 1) AS BIGINT) << j FOR j IN range(8)]) AS n FROM cut),
hexed AS (SELECT vec_id, i, printf('%02X', CAST(n AS BIGINT)) AS x FROM num)"""


@query("vec_id:l hex:s", _with(*QUANTISED, ZZ, SYMBOLS, LENS, CODES, LUMA_AC, PACKED) + "SELECT vec_id, string_agg(CASE WHEN x = 'FF' THEN 'FF00' ELSE x END, '' ORDER BY i) AS hex FROM hexed GROUP BY vec_id")
def bit_pack_stuffed(spark, sf_dir):
    return huffman.packed(huffman.coded(symbols(spark, sf_dir), _luma_ac(spark), []), ["vec_id"], ["seq"])


# Bytes


@query("source:s upper:l lower:l n:l", _with(BYTES) + "SELECT source, symbol >> 4 AS upper, symbol & 15 AS lower, count(*) AS n FROM byt GROUP BY ALL")
def nibbles(spark, sf_dir):
    s = F.col("symbol")
    return _byte_counts(spark, sf_dir).select("source", bits.nibble(s, 0).alias("upper"), bits.nibble(s, 1).alias("lower"), "n")


@query("source:s place:l from_right:l from_left:l", _with(BYTES) + "SELECT source, place, sum(symbol >> place & 1) AS from_right, sum(symbol >> (7 - place) & 1) AS from_left FROM byt, range(8) r(place) GROUP BY source, place")
def bit_places(spark, sf_dir):
    df = _byte_counts(spark, sf_dir).select("source", "n", "symbol", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("place"))
    s, p = F.col("symbol"), F.col("place")
    return df.groupBy("source", "place").agg(F.sum(bits.bit_from_right(s, p) * F.col("n")).alias("from_right"), F.sum(bits.bit_from_left(s, p, 8) * F.col("n")).alias("from_left"))


@query(
    "doc_id:l n_words:l be_sum:l le_sum:l be16_sum:l swapped_sum:l",
    "WITH hx AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL), w AS (SELECT rid, doc_id, unnest(regexp_extract_all(h, '.{8}')) AS x FROM hx) "
    "FINALLY SELECT doc_id, count(*) AS n_words, sum(CAST(('0x' || x) AS BIGINT)) AS be_sum, sum(CAST(('0x' || substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2)) AS BIGINT)) AS le_sum, "
    "sum(CAST(('0x' || substr(x, 1, 4)) AS BIGINT)) AS be16_sum, sum(CAST(('0x' || substr(x, 3, 2) || substr(x, 1, 2)) AS BIGINT)) AS swapped_sum FROM w GROUP BY rid, doc_id",
)
def le_be_integers(spark, sf_dir):
    """All whole 32-bit words of each text; they are cut out in place, so no word becomes a row."""
    data = F.col("text").cast("binary")
    rows = table(spark, sf_dir, "documents").filter(F.octet_length(data) >= 4).select("doc_id", bits.hex_words(data, 4).alias("w"))
    total = lambda f: F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + bits.hex_uint(f(x)))
    return rows.select(
        "doc_id",
        F.size("w").alias("n_words"),
        total(lambda x: x).alias("be_sum"),
        total(bits.reversed_hex).alias("le_sum"),
        total(lambda x: F.substring(x, 1, 4)).alias("be16_sum"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + bits.swap_bytes(bits.hex_uint(F.substring(x, 1, 4)))).alias("swapped_sum"),
    )


PALETTE = "pal AS (SELECT idx, idx * 7 % 256 AS r, (idx * 13 + 5) % 256 AS g, 255 - idx AS b FROM range(256) t(idx))"


def _palette(spark):
    i = F.col("id")
    return spark.range(256).select(i.cast("int").alias("idx"), (i * 7 % 256).alias("r"), ((i * 13 + 5) % 256).alias("g"), (255 - i).alias("b"))


@query(
    "source:s depth:l r:l g:l b:l n:l",
    _with(BYTES, PALETTE, "ix AS (SELECT source, depth, symbol >> (8 - depth * (j + 1)) & ((1 << depth) - 1) AS idx FROM byt, (SELECT depth, unnest(range(8 // depth)) AS j FROM (VALUES (1), (4), (8)) t(depth)))")
    + "SELECT source, depth, r, g, b, count(*) AS n FROM ix JOIN pal USING (idx) GROUP BY ALL",
)
def palette_lookup_1_4_8(spark, sf_dir):
    counts = _byte_counts(spark, sf_dir)
    parts = [palette.lookup(palette.unpack(counts, ["source"], d), _palette(spark), ["idx"]).withColumn("depth", F.lit(d)) for d in (1, 4, 8)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SIGNED = [("424D0000", "bmp"), ("FFD8FFE0", "jpeg"), ("FFD8", "none"), ("89504E470D0A1A0A", "none"), ("", "none"), ("42", "none")]


@query(
    "id:l format:s",
    "WITH f AS (SELECT page_id AS id, hex(encode(html)) AS h FROM pages UNION ALL SELECT -i, h FROM (VALUES " + ", ".join(f"({i + 1}, '{h}')" for i, (h, _) in enumerate(SIGNED)) + ") t(i, h)) "
    "FINALLY SELECT id, CASE WHEN h LIKE '424D%' THEN 'bmp' WHEN h LIKE 'FFD8FF%' THEN 'jpeg' ELSE 'none' END AS format FROM f",
)
def file_signature(spark, sf_dir):
    made = spark.createDataFrame([(-i - 1, bytes.fromhex(h)) for i, (h, _) in enumerate(SIGNED)], "id long, content binary")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").cast("binary").alias("content")).union(made)
    return rows.select("id", bits.file_signature(F.col("content")).alias("format"))


# Markers; vectors stand for entropy bytes: samples of 240 and more are read as FF, of 16 and less as 00

ENTROPY = "ent AS (SELECT vec_id, string_agg(CASE WHEN s >= 150 THEN 'FF' WHEN s <= 100 THEN '00' ELSE printf('%02X', CAST(s AS BIGINT) + 70) END, '' ORDER BY pos) AS h FROM blk GROUP BY vec_id)"
PAIRS = "pairs AS (SELECT vec_id, i, substr(h, 2 * i + 1, 2) AS x, CASE WHEN i > 0 THEN substr(h, 2 * i - 1, 2) ELSE '' END AS before, substr(h, 2 * i + 3, 2) AS after FROM ent, range(64) r(i))"


def _entropy(spark, sf_dir):
    byte = lambda s: F.when(s >= 150, "FF").when(s <= 100, "00").otherwise(bits.hex_be(s + 70, 1))
    return blk(spark, sf_dir).select("vec_id", F.array_join(F.transform("block", byte), "").alias("h"))


@query("vec_id:l hex:s", _with(BLK, ENTROPY, PAIRS) + "SELECT vec_id, coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE NOT (x = '00' AND before = 'FF')), '') AS hex FROM pairs GROUP BY vec_id")
def destuff_bytes(spark, sf_dir):
    return _entropy(spark, sf_dir).select("vec_id", segments.destuffed(F.col("h")).alias("hex"))


@query("vec_id:l hex:s", _with(BLK, ENTROPY) + "SELECT vec_id, replace(replace(regexp_replace(h, '(..)', '\\1-', 'g'), 'FF-', 'FF-00-'), '-', '') AS hex FROM ent")
def stuff_bytes(spark, sf_dir):
    return _entropy(spark, sf_dir).select("vec_id", bits.stuffed(F.col("h")).alias("hex"))


NAMES = "named AS (SELECT * FROM (VALUES " + ", ".join(f"({c}, '{n}', '{k}')" for c, n, k in tables.markers()) + ") t(code, name, class))"


@query(
    "vec_id:l place:l marker:l name:s",
    _with(BLK, ENTROPY, PAIRS, NAMES) + "SELECT vec_id, i AS place, CAST(('0x' || after) AS BIGINT) AS marker, name FROM pairs LEFT JOIN named ON code = CAST(('0x' || after) AS BIGINT) WHERE x = 'FF' AND after NOT IN ('', '00', 'FF')",
)
def marker_scan(spark, sf_dir):
    found = segments.markers_in(_entropy(spark, sf_dir), ["vec_id"], "h").withColumnRenamed("offset", "place")
    return found.join(F.broadcast(tables.markers_df(spark).withColumnRenamed("code", "marker")), "marker", "left")


@query("label:l vec_id:l marker:l expected:l ok:b", "WITH m AS (SELECT label, vec_id, 208 + vec_id % 9 AS marker FROM embeddings) FINALLY SELECT label, vec_id, marker, 208 + (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 8 AS expected, marker = 208 + (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 8 AS ok FROM m WHERE marker BETWEEN 208 AND 215")
def rst_order_check(spark, sf_dir):
    marks = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("offset"), (F.col("vec_id") % 9 + 0xD0).cast("int").alias("marker"))
    return segments.restart_check(marks, ["label"]).withColumnRenamed("offset", "vec_id")


# Layout


@query(
    "doc_id:l bits:l width:l row_size:l",
    "FINALLY SELECT doc_id, bits, width, (bits * width + 31) // 32 * 4 AS row_size FROM (SELECT doc_id, n_chars AS width FROM documents WHERE n_chars > 0), (VALUES (1), (4), (8), (24)) t(bits)",
)
def bmp_row_size(spark, sf_dir):
    """Rows as wide as each document has characters."""
    sizes = table(spark, sf_dir, "documents").filter("n_chars > 0").select("doc_id", F.col("n_chars").alias("width"), F.explode(F.array(*map(F.lit, (1, 4, 8, 24)))).alias("bits"))
    return sizes.withColumn("row_size", codec.row_size(F.col("bits"), F.col("width")))


@query("width:l height:l h:l v:l across:l down:l", "FINALLY SELECT width, height, h, v, (width + 8 * h - 1) // (8 * h) AS across, (height + 8 * v - 1) // (8 * v) AS down FROM (SELECT p_size AS width, p_size * 3 + 1 AS height FROM part GROUP BY p_size), range(1, 5) a(h), range(1, 5) b(v)")
def mcu_grid(spark, sf_dir):
    factors = F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.lit(v).alias("v")) for h in range(1, 5) for v in range(1, 5)))).alias("f")
    df = table(spark, sf_dir, "part").select(F.col("p_size").alias("width")).distinct().select("width", (F.col("width") * 3 + 1).alias("height"), factors).select("width", "height", "f.*")
    across, down = segments.mcu_grid(F.col("width"), F.col("height"), F.col("h"), F.col("v"))
    return df.select("*", across.alias("across"), down.alias("down"))


CHROMA = "up AS (SELECT h, v, block, pixel, ((block // h) * 8 + pixel // 8) // v * 8 + ((block % h) * 8 + pixel % 8) // h AS idx FROM range(1, 5) a(h), range(1, 5) b(v), range(16) c(block), range(64) d(pixel) WHERE block < h * v)"


@query("vec_id:l h:l v:l total:l weighted:l", _with(BLK, CHROMA) + "SELECT vec_id, h, v, sum(s) AS total, sum(s * (block * 64 + pixel)) AS weighted FROM up JOIN blk ON idx = pos GROUP BY vec_id, h, v")
def chroma_upsample(spark, sf_dir):
    factors = [(h, v) for h in range(1, 5) for v in range(1, 5)]
    grid = spark.createDataFrame([(h, v, b) for h, v in factors for b in range(h * v)], "h int, v int, block int").select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pixel"))
    at = F.broadcast(grid.withColumn("pos", codec.chroma_index(F.col("block"), F.col("pixel"), F.col("h"), F.col("v"))).groupBy("h", "v", "pos").agg(F.count("*").alias("n"), F.sum(F.col("block") * 64 + F.col("pixel")).alias("w")))
    long = blocks.explode(blk(spark, sf_dir), place="pos", value="s")
    return long.join(at, "pos").groupBy("vec_id", "h", "v").agg(F.sum(F.col("s") * F.col("n")).alias("total"), F.sum(F.col("s") * F.col("w")).alias("weighted"))


PLACED = """placed AS (SELECT vec_id, label, i // 4 AS mcu, i % 4 AS block, 2 AS h, 2 AS v, 60 AS width, (((SELECT max(i) FROM numbered) // 4 + 4) // 4) * 16 AS height FROM numbered),
raster AS (SELECT *, mcu // 4 * 2 + block // 2 AS block_row, mcu % 4 * 2 + block % 2 AS block_col FROM placed)"""


def _placed(spark, sf_dir):
    """Blocks of a label as an image 60 pixels wide, in 2x2 MCUs, tall enough for the largest label's."""
    df = scan.running_sum(blk(spark, sf_dir), ["label"], "vec_id", {"i": F.lit(1)}, inclusive=False)
    counts = table(spark, sf_dir, "embeddings").groupBy("label").count().agg(F.max("count").alias("n"))
    height = counts.select(F.lit(1).alias("one"), (F.expr("((n - 1) div 4 + 4) div 4") * 16).cast("int").alias("height"))
    df = df.withColumn("one", F.lit(1)).join(height, "one").drop("one")
    df = df.withColumns({"mcu": F.expr("i div 4"), "block_": F.col("i") % 4, "h": F.lit(2), "v": F.lit(2), "width": F.lit(60)})
    df = df.withColumnRenamed("block", "samples").withColumnRenamed("block_", "block").drop("i")
    return blocks.mcu_to_raster(df)


@query("label:l vec_id:l block_row:l block_col:l", _with(NUMBERED, PLACED) + "SELECT label, vec_id, block_row, block_col FROM raster WHERE block_row < height // 8 AND block_col < 8")
def mcu_to_raster(spark, sf_dir):
    return _placed(spark, sf_dir)


PIXELS = "px AS (SELECT label, width, height, block_row * 8 + pos // 8 AS y, block_col * 8 + pos % 8 AS x, s FROM raster JOIN blk USING (vec_id, label) WHERE block_col * 8 + pos % 8 < width AND block_row * 8 + pos // 8 < height)"


def _pixels(spark, sf_dir):
    return blocks.block_pixels(_placed(spark, sf_dir).drop("block"), "samples")


@query("label:l y:l x:l value:l", _with(BLK, NUMBERED, PLACED, PIXELS) + "SELECT label, y, x, s AS value FROM px")
def crop_pixels(spark, sf_dir):
    return _pixels(spark, sf_dir)


@query("label:l y:l x:l value:l", _with(BLK, NUMBERED, PLACED, PIXELS) + "SELECT label, height - 1 - y AS y, x, s AS value FROM px")
def flip_vertical(spark, sf_dir):
    return blocks.flip_vertical(_pixels(spark, sf_dir))


@query("label:l y:l x:l value:l", _with(BLK, NUMBERED, PLACED, PIXELS) + "SELECT label, y, width - 1 - x AS x, s AS value FROM px")
def flip_horizontal(spark, sf_dir):
    return blocks.flip_horizontal(_pixels(spark, sf_dir))


@query(
    "label:l y:l x:l value:l",
    _with(BLK, NUMBERED, PLACED, PIXELS) + "SELECT label, CASE WHEN x = 0 AND y = 0 THEN 7 WHEN x = 9 AND y = 7 THEN 0 ELSE y END AS y, CASE WHEN x = 0 AND y = 0 THEN 9 WHEN x = 9 AND y = 7 THEN 0 ELSE x END AS x, s AS value FROM px",
)
def swap_pixels(spark, sf_dir):
    return blocks.swap_pixels(_pixels(spark, sf_dir), (0, 0), (9, 7))


# The same on rows of pixels

#: A label that has too few blocks for the tall image lacks rows, and its last one may lack blocks.
FULL = "lines AS (SELECT label, y, height, string_agg(printf('%02X', s), '' ORDER BY x) AS hex FROM px GROUP BY ALL HAVING count(*) = 60)"


def _lines(spark, sf_dir):
    return rasters.rows_of_blocks(_placed(spark, sf_dir).drop("block"), ["label"]).filter("row IS NOT NULL")


def _hexed(rows):
    return rows.withColumn("hex", F.hex("row"))


@query("label:l y:l hex:s", _with(BLK, NUMBERED, PLACED, PIXELS, FULL) + "SELECT label, y, hex FROM lines")
def raster_rows(spark, sf_dir):
    return _hexed(_lines(spark, sf_dir))


@query(
    "label:l y:l hex:s",
    _with(BLK, NUMBERED, PLACED, PIXELS, FULL, "turned AS (SELECT label, height - 1 - y AS y, string_agg(printf('%02X', s), '' ORDER BY x DESC) AS hex FROM px GROUP BY ALL HAVING count(*) = 60)") + "SELECT label, y, hex FROM turned",
)
def raster_rows_flipped(spark, sf_dir):
    """Turned by both flips."""
    return _hexed(rasters.flip_horizontal(rasters.flip_vertical(_lines(spark, sf_dir))))


@query(
    "label:l y:l hex:s",
    _with(BLK, NUMBERED, PLACED, PIXELS, FULL, "ends AS (SELECT label, max(CASE WHEN y = 0 THEN substr(hex, 1, 2) END) AS a, max(CASE WHEN y = 7 THEN substr(hex, 19, 2) END) AS b FROM lines WHERE y IN (0, 7) GROUP BY label)")
    + "SELECT label, y, CASE WHEN a IS NULL OR b IS NULL THEN hex WHEN y = 0 THEN b || substr(hex, 3) WHEN y = 7 THEN substr(hex, 1, 18) || a || substr(hex, 21) ELSE hex END AS hex FROM lines LEFT JOIN ends USING (label)",
)
def raster_rows_swapped(spark, sf_dir):
    return _hexed(rasters.swap_pixels(_lines(spark, sf_dir), ["label"], (0, 0), (9, 7)))


@query(
    "label:l band:l n_rows:l md5:s",
    _with(BLK, NUMBERED, PLACED, PIXELS, FULL) + "SELECT label, y // 16 AS band, count(*) AS n_rows, CASE WHEN count(*) = least(16, max(height) - y // 16 * 16) THEN md5(string_agg(hex, '' ORDER BY y)) END AS md5 FROM lines GROUP BY label, y // 16, height",
)
def raster_bands(spark, sf_dir):
    return rasters.bands(_lines(spark, sf_dir), ["label"], 16).withColumn("md5", F.md5(F.hex("data")))


# Tables and references; a user's events are a file: purchases are scans, all others define tables


@query(
    "user_id:l event_id:l version:l",
    "WITH t AS (SELECT user_id, event_id, event_type, ts FROM events), types AS (SELECT DISTINCT event_type FROM t), scan AS (SELECT min(event_type) AS kind FROM types) "
    "FINALLY SELECT user_id, event_id, version FROM (SELECT user_id, event_id, event_type, max(CASE WHEN event_type <> (SELECT kind FROM scan) THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS version FROM t) WHERE event_type = (SELECT kind FROM scan)",
)
def table_version_asof(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.lit(1).alias("image"), F.col("user_id").alias("slot"), F.col("event_id").alias("offset"), "event_type")
    is_scan = F.col("event_type") == F.lit(events.agg(F.min("event_type")).first()[0])
    found = segments.table_version(events.filter(is_scan).select("image", "slot", "offset"), events.filter(~is_scan).select("image", "slot", "offset"), ["image"], "slot")
    return found.select(F.col("slot").alias("user_id"), F.col("offset").alias("event_id"), "version")


@query("o_orderkey:l o_custkey:l", "FINALLY SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal >= 0)")
def scan_reference_check(spark, sf_dir):
    """Orders as references, customers with a balance of at least zero as what is defined."""
    defined = table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    return segments.unresolved(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), defined, ["o_custkey"])


@query(
    "o_orderkey:l o_custkey:l nation:l error:s",
    "FINALLY SELECT o_orderkey, o_custkey, c_nationkey AS nation, CASE WHEN c_custkey IS NULL THEN 'no such component' END AS error FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 20) ON c_custkey = o_custkey",
)
def component_lookup(spark, sf_dir):
    parts = table(spark, sf_dir, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    return segments.component_lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), parts, ["o_custkey"])


@query(
    "image_id:l ord:l role:s error:s",
    "WITH c AS (SELECT l_orderkey AS image_id, l_linenumber - 1 AS ord, 1 + l_suppkey % 7 // 6 AS h, 1 + l_partkey % 5 // 4 AS v FROM lineitem WHERE l_linenumber < 5), "
    "g AS (SELECT image_id, count(*) AS n, sum(CAST(h * v > 1 AS INT)) AS fine, min(ord) AS lowest, min(ord) FILTER (WHERE h * v > 1) AS first FROM c GROUP BY image_id), "
    "e AS (SELECT image_id, CASE WHEN n <> 3 THEN 'three components are needed' WHEN fine > 1 THEN 'more than one component is subsampled' WHEN coalesce(first, lowest) <> lowest THEN 'the subsampled component is not the first' END AS error FROM g) "
    "FINALLY SELECT image_id, ord, CASE WHEN error IS NULL THEN ['Y', 'Cb', 'Cr'][row_number() OVER (PARTITION BY image_id ORDER BY ord)] END AS role, error FROM c JOIN e USING (image_id)",
)
def component_roles(spark, sf_dir):
    """An order is an image and a line of it a component, whose keys give the sampling."""
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber < 5")
    factor = lambda c, n: F.when(F.col(c) % n == n - 1, 2).otherwise(1)
    line = F.col("l_linenumber")
    return segments.component_roles(lines.select(F.col("l_orderkey").alias("image_id"), (line - 1).alias("ord"), line.alias("comp_id"), factor("l_suppkey", 7).alias("h"), factor("l_partkey", 5).alias("v")))


# Whole files: each vector as a picture of 8x8


def _pictures(spark, sf_dir, grey: bool):
    inverse = (lambda s: s) if grey else (lambda s: 255 - s)
    rgb = F.array_join(F.transform("block", lambda s: F.concat(bits.hex_be(s, 1), bits.hex_be(inverse(s), 1), bits.hex_be(s, 1))), "")
    return blk(spark, sf_dir).select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(rgb).alias("data"))


@query("vec_id:l bit_count:l length:l r:l g:l weighted:l", _with(BLK) + "SELECT vec_id, 24 AS bit_count, 218 AS length, sum(s) AS r, sum(255 - s) AS g, sum(s * pos) AS weighted FROM blk GROUP BY vec_id")
def bmp_round_trip(spark, sf_dir):
    made = bmp.with_header(images.encode_bmp(_pictures(spark, sf_dir, False)))
    read = images.decode(made.select("vec_id", F.col("header.bit_count").alias("bit_count"), F.octet_length("content").alias("length"), "content"))
    px = images.pixels(read)
    return px.groupBy("vec_id", "bit_count", "length").agg(F.sum("r").alias("r"), F.sum("g").alias("g"), F.sum(F.col("b") * (F.col("y") * 8 + F.col("x"))).alias("weighted"))


@query("vec_id:l width:l height:l close:b", "FINALLY SELECT vec_id, 8 AS width, 8 AS height, true AS close FROM embeddings")
def jpeg_round_trip(spark, sf_dir):
    """Whether no sample is off by more than three at quality 100."""
    pictures = _pictures(spark, sf_dir, True)
    files = images.encode_jpeg(pictures.select("vec_id", F.col("data").alias("before"), "width", "height", "data"), 100)
    read = images.decode(files)
    far = F.exists(F.sequence(F.lit(1), F.lit(192)), lambda i: F.abs(bits.byte_at(F.col("data"), i - 1) - bits.byte_at(F.col("before"), i - 1)) > 3)
    return read.select("vec_id", "width", "height", (~far & F.col("error").isNull()).alias("close"))


@query("vec_id:l k:l v:l", _with(BLK, BASIS, COEF) + "SELECT vec_id, k, CAST(round(round(c, 6)) AS BIGINT) AS v FROM coef WHERE round(round(c, 6)) <> 0")
def jpeg_coefficients(spark, sf_dir):
    """Luma coefficients read back from JPEG files at quality 100 by way of their restart segments."""
    files = images.encode_jpeg(_pictures(spark, sf_dir, True), 100, optimise=True, interval=1)
    rows = images.decode_restart_segments(images.restart_segments(files)).filter("comp = 0")
    return blocks.explode(rows.select("vec_id", blocks.dezigzag(F.col("coef")).alias("block"))).filter("v <> 0")


@query("vec_id:l marker:l n:l", "FINALLY SELECT vec_id, marker, n FROM embeddings, (VALUES (216, 1), (219, 2), (196, 4), (192, 1), (218, 1), (217, 1)) t(marker, n)")
def jpeg_segments(spark, sf_dir):
    parts = images.jpeg_segments(images.encode_jpeg(_pictures(spark, sf_dir, True), 90))
    return parts.groupBy("vec_id", "marker").agg(F.count("*").alias("n"))


# Scalars and readers that the stages above don't reach


@query(
    "n_nationkey:l name:s format:s",
    "WITH n AS (SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'JPEG' WHEN 1 THEN 'jPg' WHEN 2 THEN 'BMP' WHEN 3 THEN 'png' ELSE n_name END AS name FROM nation) "
    "FINALLY SELECT n_nationkey, name, CASE WHEN lower(name) IN ('jpeg', 'jpg') THEN 'jpeg' WHEN lower(name) = 'bmp' THEN 'bmp' ELSE 'none' END AS format FROM n",
)
def format_names(spark, sf_dir):
    made = F.element_at(F.array(*map(F.lit, ("JPEG", "jPg", "BMP", "png")), F.col("n_name")), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select("n_nationkey", made.alias("name")).withColumn("format", bits.format_name(F.col("name")))


@query(
    "doc_id:l be24:l le16:l le32:l words:l five:s chars:l first:l error:s",
    "WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), x AS (SELECT *, length(h) // 2 AS n FROM h) "
    "FINALLY SELECT doc_id, CASE WHEN n >= 4 THEN CAST('0x' || substr(h, 3, 6) AS BIGINT) END AS be24, CASE WHEN n >= 4 THEN CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) AS BIGINT) END AS le16, "
    "CASE WHEN n >= 7 THEN CAST('0x' || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) AS BIGINT) END AS le32, "
    "CASE WHEN n >= 9 THEN CAST('0x' || substr(h, 3, 4) AS BIGINT) + CAST('0x' || substr(h, 7, 4) AS BIGINT) + CAST('0x' || substr(h, 11, 4) AS BIGINT) + CAST('0x' || substr(h, 15, 4) AS BIGINT) END AS words, "
    "CASE WHEN n >= 7 THEN substr(h, 5, 10) END AS five, CASE WHEN n >= 6 THEN 6 END AS chars, CASE WHEN n >= 6 THEN CAST('0x' || substr(h, 1, 2) AS BIGINT) END AS first, CASE WHEN n < 40 THEN 'header: too short' END AS error FROM x",
)
def byte_fields(spark, sf_dir):
    """Fields of the first bytes of each text; those that aren't all there are null."""
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    words = F.aggregate(bits.be_words(data, 1, 4, 2), F.lit(0).cast("long"), lambda a, w: a + w)
    read = bits.string_at(data, 0, 6)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        bits.be_uint(data, 1, 3).alias("be24"),
        bits.le_uint(data, 2, 2).alias("le16"),
        bits.le_uint(data, 3, 4).alias("le32"),
        words.alias("words"),
        F.hex(bits.take(data, 2, 5)).alias("five"),
        F.length(read).alias("chars"),
        F.ascii(read).alias("first"),
        bits.error_in("header", F.when(F.octet_length(data) < 40, "too short")).alias("error"),
    )


@query(
    "doc_id:l five:l eleven:l wide:l beyond:l aligned:l ended:b",
    "WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) || '00000000000000' AS h, 8 * octet_length(encode(coalesce(text, ''))) AS n, doc_id % 13 AS a FROM documents), "
    "w AS (SELECT *, CAST('0x' || rpad(substr(h, 2 * CAST(a // 8 AS INT) + 1, 14), 14, '0') AS BIGINT) AS v, CAST('0x' || rpad(substr(h, 2 * CAST(greatest(0, n - 3) // 8 AS INT) + 1, 14), 14, '0') AS BIGINT) AS e FROM h) "
    "FINALLY SELECT doc_id, (v >> CAST(56 - a % 8 - 5 AS INT)) & 31 AS five, (v >> CAST(56 - a % 8 - 11 AS INT)) & 2047 AS eleven, (v >> CAST(56 - a % 8 - 40 AS INT)) & 1099511627775 AS wide, "
    "(e >> CAST(56 - greatest(0, n - 3) % 8 - 16 AS INT)) & 65535 AS beyond, (a + 7) // 8 * 8 AS aligned, a >= n AS ended FROM w",
)
def bit_reads(spark, sf_dir):
    """Bits of any width at any bit of each text; those beyond the end are zero."""
    data, at = F.coalesce(F.col("text").cast("binary"), F.lit(b"")), F.col("doc_id") % 13
    last = F.greatest(F.lit(0), F.octet_length(data) * 8 - 3)
    return table(spark, sf_dir, "documents").select(
        "doc_id", *(bits.bits_at(data, at, n).alias(c) for c, n in (("five", 5), ("eleven", 11), ("wide", 40))), bits.bits_at(data, last, 16).alias("beyond"), bits.align(at).alias("aligned"), bits.at_end(data, at).alias("ended")
    )


@query(
    "doc_id:l size:l value:l wide:l cursor:l ended:b",
    "WITH h AS (SELECT doc_id, octet_length(encode(text)) * 8 AS n, rpad(hex(encode(text)), 22, '0') AS h FROM documents WHERE text IS NOT NULL), "
    "v AS (SELECT doc_id, n, CAST(CAST('0x' || substr(h, 1, 10) AS BIGINT) AS HUGEINT) * 17592186044416 + CAST('0x' || substr(h, 11, 11) AS BIGINT) AS v, CAST('0x' || substr(h, 1, 1) AS BIGINT) AS s FROM h), "
    "w AS (SELECT *, (v // CAST(pow(2, 80 - s) AS HUGEINT)) % CAST(pow(2, s) AS HUGEINT) AS x, (v // CAST(pow(2, 16 - s) AS HUGEINT)) % CAST(18446744073709551616 AS HUGEINT) AS y FROM v) "
    "FINALLY SELECT doc_id, CASE WHEN n >= 4 THEN s END AS size, CASE WHEN n >= 4 + s THEN x END AS value, CASE WHEN n >= 68 + s THEN CASE WHEN y >= 9223372036854775808 THEN y - 18446744073709551616 ELSE y END END AS wide, "
    "CASE WHEN n >= 68 + s THEN 68 + s WHEN n >= 4 + s AND n >= 4 THEN 4 + s WHEN n >= 4 THEN 4 ELSE 0 END AS cursor, CASE WHEN n >= 68 + s THEN 68 + s WHEN n >= 4 + s AND n >= 4 THEN 4 + s WHEN n >= 4 THEN 4 ELSE 0 END >= n AS ended FROM w",
)
def bit_fields(spark, sf_dir):
    """Of each text a size, a value of so many bits, and 64 bits wherever those end."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("data"))
    return bit_cursor.read_fields(docs, "data", 0, [("size", 4), ("value", F.col("size")), ("wide", 64)])


@query(
    "o_orderkey:l le4:s le2:s be3:s",
    "WITH h AS (SELECT o_orderkey, printf('%08X', o_orderkey) AS h FROM orders) FINALLY SELECT o_orderkey, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS le4, substr(h, 7, 2) || substr(h, 5, 2) AS le2, substr(h, 3, 6) AS be3 FROM h",
)
def put_bytes(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.hex(bits.put_le(key, 4)).alias("le4"), F.hex(bits.put_le(key, 2)).alias("le2"), F.hex(bits.put_be(key, 3)).alias("be3"))


@query(
    "p_partkey:l near:b blocks:l place:d",
    "FINALLY SELECT p_partkey, abs(CAST(p_retailprice AS DOUBLE) - 1000) < 250.5 AS near, (p_size + 7) // 8 AS blocks, CAST(p_size AS DOUBLE) / 51 * 2 - 1 AS place FROM part",
)
def scalar_helpers(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", bits.nearly_equal(F.col("p_retailprice").cast("double"), F.lit(1000.0), 250.5).alias("near"), bits.ceil_div(size, 8).alias("blocks"), codec.ndc(size, F.lit(51)).alias("place"))


@query("doc_id:l n_words:l longest:l", "WITH w AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), ' '), lambda x : x <> '') AS w FROM documents) FINALLY SELECT doc_id, len(w) AS n_words, coalesce(list_max(list_transform(w, lambda x : length(x))), 0) AS longest FROM w")
def split_words(spark, sf_dir):
    w = bits.words(F.coalesce(F.col("text"), F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).alias("n_words"), F.coalesce(F.array_max(F.transform(w, F.char_length)), F.lit(0)).alias("longest"))


@query(
    "p_partkey:l bits:l compression:l colors:l encoding:s",
    "WITH c AS (SELECT p_partkey, [1, 4, 8, 16, 24, 32][CAST(p_size % 6 AS INT) + 1] AS bits, p_partkey % 3 AS compression FROM part) "
    "FINALLY SELECT p_partkey, bits, compression, CASE bits WHEN 1 THEN 2 WHEN 4 THEN 16 WHEN 8 THEN 256 ELSE -1 END AS colors, "
    "coalesce(CASE WHEN compression = 0 THEN CASE bits WHEN 1 THEN 'monochrome' WHEN 4 THEN 'indexed4' WHEN 8 THEN 'indexed8' WHEN 16 THEN 'rgb16' WHEN 24 THEN 'rgb24' END WHEN compression = 2 AND bits = 4 THEN 'rle4' WHEN compression = 1 AND bits = 8 THEN 'rle8' END, 'none') AS encoding FROM c",
)
def bmp_encodings(spark, sf_dir):
    """A part's size chooses the depth and its key the compression."""
    depth = F.get(F.array(*map(F.lit, (1, 4, 8, 16, 24, 32))), (F.col("p_size") % 6).cast("int"))
    df = table(spark, sf_dir, "part").select("p_partkey", depth.alias("bits"), (F.col("p_partkey") % 3).alias("compression"))
    return df.withColumn("colors", codec.num_colors(F.col("bits"))).withColumn("encoding", codec.raster_encoding(F.col("bits"), F.col("compression")))


# Indexed and padded BMP files: each vector as a picture of 13x5 in one of four depths; its last pixel has index 0

WIDE, HIGH = 13, 5
RASTER = """px AS (SELECT vec_id, depth, p, p // 13 AS y, p % 13 AS x, CASE WHEN p < 64 THEN s % CAST(CASE WHEN depth = 24 THEN 256 ELSE 1 << depth END AS BIGINT) ELSE 0 END AS idx
  FROM (SELECT vec_id, [1, 4, 8, 24][CAST(vec_id % 4 AS INT) + 1] AS depth FROM embeddings) d CROSS JOIN range(65) r(p) LEFT JOIN blk USING (vec_id) WHERE blk.pos = least(p, 63))"""


def _bmp_files(spark, sf_dir):
    """(vec_id, depth, content): files with an info header and a colour table but at depth 24, bottom row first, rows filled to four bytes."""
    depth = F.element_at(F.array(*map(F.lit, (1, 4, 8, 24))), (F.col("vec_id") % 4 + 1).cast("int"))
    df = blk(spark, sf_dir).select("vec_id", depth.alias("depth"), F.concat("block", F.array(F.lit(0).cast("long"))).alias("s"))
    depth = F.col("depth")
    colors = F.when(depth == 24, 256).otherwise(F.call_function("shiftleft", F.lit(1), depth))
    df = df.withColumn("idx", F.transform("s", lambda v: v % colors))

    def triple(i):
        return F.concat(bits.hex_be(255 - i, 1), bits.hex_be((i * 13 + 5) % 256, 1), bits.hex_be(i * 7 % 256, 1))

    def line(y):
        part = F.slice("idx", y * WIDE + 1, WIDE)
        packed = F.array_join(F.transform(part, lambda v: F.when(depth == 24, triple(v)).otherwise(F.lpad(F.bin(v), depth, "0"))), "")
        stride = codec.row_size(depth, F.lit(WIDE)).cast("int")
        return F.when(depth == 24, F.rpad(packed, stride * 2, "0")).otherwise(bits.bits_to_hex(F.rpad(packed, stride * 8, "0")))

    raster = F.concat(*(line(y) for y in reversed(range(HIGH))))
    entries = F.when(depth == 24, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), colors - 1), lambda i: F.concat(triple(i), F.lit("00"))), ""))
    offset = F.lit(54) + F.length(entries) / 2
    le = lambda v, n: F.hex(bits.put_le(v if not isinstance(v, int) else F.lit(v), n))
    info = F.concat(le(40, 4), le(WIDE, 4), le(HIGH, 4), le(1, 2), le(depth, 2), *(le(0, 4) for _ in range(6)))
    whole = F.concat(F.lit("424D"), le(offset + F.length(raster) / 2, 4), le(0, 4), le(offset, 4), info, entries, raster)
    # exploded, so that readers of the content don't each take over the whole expression
    return df.select("vec_id", "depth", F.explode(F.array(F.unhex(whole))).alias("content"))


BMP_SUMS = "SELECT vec_id, depth, sum(r * (p + 1)) AS r, sum(g * (p + 1)) AS g, sum(b * (p + 1)) AS b, count(*) AS n FROM px JOIN pal USING (idx)"


@query("vec_id:l depth:l r:l g:l b:l n:l", _with(BLK, PALETTE, RASTER) + BMP_SUMS + " GROUP BY vec_id, depth")
def bmp_rasters(spark, sf_dir):
    px = images.pixels(images.decode(_bmp_files(spark, sf_dir)))
    at = F.col("y") * WIDE + F.col("x") + 1
    return px.groupBy("vec_id", "depth").agg(*(F.sum(F.col(c).cast("long") * at).alias(c) for c in "rgb"), F.count("*").alias("n"))


@query("vec_id:l depth:l r:l g:l b:l n:l", _with(BLK, PALETTE, RASTER) + BMP_SUMS + " WHERE depth < 24 GROUP BY vec_id, depth")
def bmp_palette_join(spark, sf_dir):
    """The same of the indexed files by expressions and a join: indexes cut out of the raster, colour tables as rows."""
    files = bmp.with_header(_bmp_files(spark, sf_dir).filter("depth < 24"))
    px = palette.lookup(palette.pixel_rows(files, "vec_id"), bmp.palette(files, "vec_id"), ["vec_id", "idx"])
    at = F.col("y") * WIDE + F.col("x") + 1
    depth = F.element_at(F.array(*map(F.lit, (1, 4, 8, 24))), (F.col("vec_id") % 4 + 1).cast("int"))
    return px.groupBy("vec_id").agg(*(F.sum(F.col(c).cast("long") * at).alias(c) for c in "rgb"), F.count("*").alias("n")).withColumn("depth", depth)


@query(
    "vec_id:l error:s width:l",
    "WITH c AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 218 ELSE vec_id % 218 END AS n FROM embeddings) FINALLY SELECT vec_id, CASE WHEN n < 2 THEN 'unknown format' WHEN n < 26 THEN 'the header is cut short' WHEN n < 218 THEN 'the raster is cut short' END AS error, CASE WHEN n = 218 THEN 8 END AS width FROM c",
)
def file_errors(spark, sf_dir):
    """Files that are cut short are rows with an error."""
    n = F.when(F.col("vec_id") % 5 == 0, 218).otherwise(F.col("vec_id") % 218).cast("int")
    files = images.encode_bmp(_pictures(spark, sf_dir, False)).select("vec_id", F.substring(F.col("content"), F.lit(1), n).alias("content"))
    return images.decode(files).select("vec_id", "error", "width")


# JPEG files with comments, a late height, settings, and colour planes of different size


@query("vec_id:l height:l comment:s error:s", "FINALLY SELECT vec_id, 8 AS height, 'vector ' || vec_id AS comment, CAST(NULL AS VARCHAR) AS error FROM embeddings")
def jpeg_comment_and_late_height(spark, sf_dir):
    """A comment behind the signature; the frame's height is zero and follows the scan."""
    files = images.encode_jpeg(_pictures(spark, sf_dir, True), 90).select("vec_id", F.hex("content").alias("h"))
    text = F.concat(F.lit("vector "), F.col("vec_id").cast("string"))
    frame = F.locate("FFC000110800080008", F.col("h"))
    comment = F.concat(F.lit("FFFE"), bits.hex_be(F.length(text) + 2, 2), F.hex(text))
    body = F.concat(F.substr("h", F.lit(5), frame - 5), F.lit("FFC000110800000008"), F.substr("h", frame + 18, F.length("h") - frame - 21))
    made = files.select("vec_id", F.unhex(F.concat(F.lit("FFD8"), comment, body, F.lit("FFDC00040008FFD9"))).alias("content"))
    said = images.jpeg_segments(made).filter("marker = 254").select("vec_id", F.decode("payload", "ISO-8859-1").alias("comment"))
    return images.decode(made).select("vec_id", "height", "error").join(said, "vec_id", "left")


@query(
    "setting:s dest:l k:l q:l files:l",
    _with(QTABLE, "st AS (SELECT * FROM (VALUES ('coarse', 30, 30), ('fine', 95, 60)) t(setting, luma, chroma))")
    + "SELECT setting, CAST(name = 'chroma' AS INT) AS dest, k, round(greatest(1, least(255, base * CAST(CASE WHEN c < 50 THEN 5000 // c ELSE 200 - 2 * c END AS DOUBLE) / 100.0))) AS q, (SELECT count(*) FROM embeddings) AS files FROM (SELECT *, CASE WHEN name = 'luma' THEN luma ELSE chroma END AS c FROM st, base)",
)
def jpeg_settings(spark, sf_dir):
    """Quantisers read back from files of two settings, one with tables of its own and restart intervals."""
    pictures = _pictures(spark, sf_dir, True)
    made = images.encode_jpeg(pictures, 30).withColumn("setting", F.lit("coarse")).union(images.encode_jpeg(pictures, 95, 60, True, 1).withColumn("setting", F.lit("fine")))
    return images.jpeg_quant_tables(images.jpeg_segments(made.drop("error"))).groupBy("setting", "dest", "k").agg(F.max("q").alias("q"), F.count("*").alias("files"))


@query(
    "label:l eob:l zrl:l",
    _with(*QUANTISED, ZZ, SYMBOLS) + "SELECT label, count(*) FILTER (WHERE symbol = 0) AS eob, count(*) FILTER (WHERE symbol = 240) AS zrl FROM symbols GROUP BY label",
)
def run_ends(spark, sf_dir):
    df = symbols(spark, sf_dir)
    run, size = bits.upper_nibble(F.col("symbol")), bits.lower_nibble(F.col("symbol"))
    return df.groupBy("label").agg(F.count_if(codec.is_eob(run, size)).alias("eob"), F.count_if(codec.is_zrl(run, size)).alias("zrl"))


COLOUR = """cz AS (SELECT vec_id, z, v FROM quant JOIN zz USING (k)),
cb AS (SELECT c.vec_id, m, b, zz.k, c.v * CASE WHEN b < 4 THEN 1 ELSE 2 END AS v FROM range(2) mm(m) CROSS JOIN range(6) bb(b) CROSS JOIN zz JOIN cz c ON c.z = (zz.z + 7 * b + 3 * m) % 64 WHERE c.v <> 0),
sp AS (SELECT vec_id, m, b, pos, sum(v * w) AS s FROM cb JOIN basis USING (k) GROUP BY ALL),
pl AS (SELECT vec_id, y, x, y // 8 * 2 + x % 16 // 8 AS yb, y % 8 * 8 + x % 8 AS yp, y // 2 * 8 + x % 16 // 2 AS cp, x // 16 AS m FROM (SELECT DISTINCT vec_id FROM quant) CROSS JOIN range(13) a(y) CROSS JOIN range(29) b(x)),
yc AS (SELECT pl.*, coalesce(l.s, 0) + 128 AS yy, coalesce(u.s, 0) AS cb, coalesce(w.s, 0) AS cr FROM pl LEFT JOIN sp l ON l.vec_id = pl.vec_id AND l.m = pl.m AND l.b = yb AND l.pos = yp
  LEFT JOIN sp u ON u.vec_id = pl.vec_id AND u.m = pl.m AND u.b = 4 AND u.pos = cp LEFT JOIN sp w ON w.vec_id = pl.vec_id AND w.m = pl.m AND w.b = 5 AND w.pos = cp),
out AS (SELECT vec_id, y, x, floor(round(greatest(0, least(255, yy + 1.402 * cr)), 6)) AS r, floor(round(greatest(0, least(255, yy - 0.344 * cb - 0.714 * cr)), 6)) AS g, floor(round(greatest(0, least(255, yy + 1.772 * cb)), 6)) AS b FROM yc)"""


@query(
    "vec_id:l r:l g:l b:l one:l",
    _with(*QUANTISED, ZZ, COLOUR) + "SELECT vec_id, sum(r * (y * 29 + x + 1)) AS r, sum(g * (y * 29 + x + 1)) AS g, sum(b * (y * 29 + x + 1)) AS b, max(g) FILTER (WHERE x = 17 AND y = 10) AS one FROM out GROUP BY vec_id",
)
def jpeg_colour_420(spark, sf_dir):
    """Files of two MCUs of 2x2 luma blocks and one of either chroma, cropped to 29x13; blocks are rotations of a vector's zigzag coefficients, chroma doubled by its steps."""
    turn = lambda n: F.concat(F.slice("block", n + 1, 64 - n), F.slice("block", 1, n)) if n else F.col("block")
    times = lambda block, f: F.transform(block, lambda v: v * f)
    coef = F.concat(*(times(turn((7 * b + 3 * m) % 64), 1 if b < 4 else 2) for m in range(2) for b in range(6)))
    files = images.pack_jpeg(quantised(spark, sf_dir, True).select("vec_id", F.lit(29).alias("width"), F.lit(13).alias("height"), coef.alias("coef")), 2, 2, interval=1)
    read = images.decode(files.drop("error")).filter("error IS NULL")
    one = read.select("vec_id", blocks.pixel(F.col("data"), F.col("width"), F.lit(17), F.lit(10), F.lit(1)).alias("one"))
    at = F.col("y") * 29 + F.col("x") + 1
    sums = images.pixels(read).groupBy("vec_id").agg(*(F.sum(F.col(c).cast("long") * at).alias(c) for c in "rgb"))
    return sums.join(one, "vec_id")


# Files without restart markers: a label's vectors in order are the MCUs of images, chroma blocks are rotations

#: MCUs of an image: a frame's height is 65,535 at most, and a task holds an image.
IMAGE_MCUS = 1 << 10


def _unmarked(spark, sf_dir, most):
    """(label, part, content): a label's vectors as images of at most `most` MCUs each."""
    turn = lambda n: F.concat(F.slice("block", n + 1, 64 - n), F.slice("block", 1, n))
    samples = blk(spark, sf_dir, 128).withColumn("block", F.col("block").cast("array<double>"))
    numbered = scan.running_sum(samples, ["label"], "vec_id", {"i": F.lit(1)}, inclusive=False)
    coded = blocks.forward_dct(numbered).withColumn("block", blocks.zigzag(blocks.quantise(F.col("block"), tables.LUMA_QUANT)))
    mcu = coded.select("label", F.floor(F.col("i") / most).alias("part"), "i", F.concat("block", turn(7), turn(14)).alias("mcu"))
    whole = mcu.groupBy("label", "part").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "mcu"))), lambda x: x["mcu"])).alias("coef"))
    return images.pack_jpeg(whole.select("label", "part", F.lit(8).alias("width"), (F.size("coef") / 24).cast("int").alias("height"), "coef"), 1, 1).drop("error")


@query(
    "label:l mcu:l comp:l z:l v:l error:s",
    _with(*QUANTISED, ZZ)
    + "SELECT label, mcu, comp, (z + 64 - 7 * comp) % 64 AS z, v, CAST(NULL AS VARCHAR) AS error FROM (SELECT label, vec_id, z, v, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS mcu FROM quant JOIN zz USING (k)) CROSS JOIN range(3) c(comp) WHERE v <> 0",
)
def jpeg_unmarked(spark, sf_dir, most=IMAGE_MCUS):
    """Coefficients of files without restart markers, whose entropy bytes are cut into chunks that many tasks bring into step."""
    found = chunked.decode_chunks(images.restart_segments(_unmarked(spark, sf_dir, most)), ["label", "part"], 512)
    mcu = F.col("part") * most + F.col("mcu")
    return blocks.explode(found.select("label", mcu.alias("mcu"), "comp", "error", "coef"), "coef", "z").filter("v <> 0")


# Marker segments by table functions in SQL

_PLACES = """named AS (SELECT name, class, CAST(name LIKE 'chroma%' AS INT) AS dest, row_number() OVER (ORDER BY name LIKE 'chroma%', class) AS turn, count(*) AS n FROM lens GROUP BY name, class),
placed AS (SELECT *, 140 + coalesce(sum(21 + n) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM named),
kinds AS (SELECT vec_id, vec_id % 4 AS kind FROM embeddings)"""


def _variants(spark, sf_dir):
    """(vec_id, content): files of 8x8; of four, one is plain, one has its first quantiser again before the scan, one lacks it, and one's scan names a component that isn't there."""
    h = F.hex("content")
    first = F.substr(h, F.lit(5), F.lit(138))
    scan_at = F.locate("FFDA000C03010002110311003F00", h)
    rest = F.substr(h, F.lit(143), F.length(h))
    again = F.concat(F.substr(h, F.lit(1), scan_at - 1), first, F.substr(h, scan_at, F.length(h)))
    other = F.concat(F.substr(h, F.lit(1), scan_at + 9), F.lit("07"), F.substr(h, scan_at + 12, F.length(h)))
    kind = F.col("vec_id") % 4
    made = F.when(kind == 1, again).when(kind == 2, F.concat(F.lit("FFD8"), rest)).when(kind == 3, other).otherwise(h)
    return images.encode_jpeg(_pictures(spark, sf_dir, True), 90).select("vec_id", F.unhex(made).alias("content"))


@query(
    "vec_id:l seq:l place:l marker:l size:l error:s",
    _with(LENS, _PLACES)
    + """SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY place) - 1 AS seq, place, marker, size, CAST(NULL AS VARCHAR) AS error FROM (
  SELECT vec_id, place - CASE WHEN kind = 2 AND place > 2 THEN 69 ELSE 0 END + CASE WHEN kind = 1 AND marker = 218 THEN 69 ELSE 0 END AS place, marker, size FROM kinds CROSS JOIN (
    SELECT 0 AS place, 216 AS marker, 0 AS size UNION ALL SELECT 2, 219, 65 UNION ALL SELECT 71, 219, 65 UNION ALL SELECT place, 196, 17 + n FROM placed
    UNION ALL SELECT max(place + 21 + n), 192, 15 FROM placed UNION ALL SELECT max(place + 40 + n), 218, 10 FROM placed) m WHERE NOT (kind = 2 AND place = 2)
  UNION ALL SELECT vec_id, (SELECT max(place + 40 + n) FROM placed), 219, 65 FROM kinds WHERE kind = 1)""",
)
def jpeg_segments_sql(spark, sf_dir):
    """Marker segments up to the scan's header, by a lateral join."""
    table_functions.register(spark)
    return spark.sql(
        "SELECT f.vec_id, s.seq, s.offset AS place, s.marker, IF(s.marker = 218, least(10, length(s.payload)), length(s.payload)) AS size, s.error FROM {files} f, LATERAL rb_jpeg_segments(f.content) s WHERE s.marker <> 217 OR s.error IS NOT NULL",
        files=_variants(spark, sf_dir),
    )


@query(
    "vec_id:l name:s n:l longest:l symbols:l weighted:l",
    _with(LENS, _PLACES) + "SELECT vec_id, name, n, longest, symbols, weighted FROM embeddings CROSS JOIN (SELECT name, count(*) AS n, max(len) AS longest, sum(symbol) AS symbols, sum(symbol * (ord + 1) * len) AS weighted FROM lens GROUP BY name)",
)
def jpeg_huffman_tables_sql(spark, sf_dir):
    """Huffman tables read back from files, two lateral joins behind each other."""
    table_functions.register(spark)
    return spark.sql(
        "SELECT f.vec_id, concat(IF(t.dest = 0, 'luma', 'chroma'), IF(t.class = 0, '_dc', '_ac')) AS name, count(*) AS n, max(t.len) AS longest, sum(t.symbol) AS symbols, sum(t.symbol * (t.ord + 1) * t.len) AS weighted "
        "FROM {files} f, LATERAL rb_jpeg_segments(f.content) s, LATERAL rb_jpeg_huffman_tables(s.payload) t WHERE s.marker = 196 AND t.error IS NULL GROUP BY ALL",
        files=_variants(spark, sf_dir),
    )


@query(
    "vec_id:l comp_id:l quant:l dc:l ac:l error:s",
    _with(LENS, _PLACES)
    + """SELECT vec_id, comp_id, quant, dc, ac, CASE WHEN comp_id = 7 THEN 'the scan names no component of the frame' WHEN quant IS NULL THEN 'the scan needs a table that is not defined' END AS error FROM (
  SELECT vec_id, CASE WHEN kind = 3 AND ord = 0 THEN 7 ELSE ord + 1 END AS comp_id, CASE WHEN kind IN (2, 3) AND ord = 0 THEN NULL WHEN ord = 0 AND kind = 1 THEN (SELECT max(place + 40 + n) FROM placed) WHEN ord = 0 THEN 2 WHEN kind = 2 THEN 2 ELSE 71 END AS quant,
    (SELECT place FROM placed WHERE class = 0 AND dest = least(ord, 1)) - CASE WHEN kind = 2 THEN 69 ELSE 0 END AS dc, (SELECT place FROM placed WHERE class = 1 AND dest = least(ord, 1)) - CASE WHEN kind = 2 THEN 69 ELSE 0 END AS ac FROM kinds CROSS JOIN range(3) r(ord))""",
)
def jpeg_table_versions(spark, sf_dir):
    """The tables that hold for each scan component of parsed files, redefined and missing ones among them."""
    parsed = images.jpeg_segments(_variants(spark, sf_dir))
    return table_functions.resolve(spark, parsed, ["vec_id"])
