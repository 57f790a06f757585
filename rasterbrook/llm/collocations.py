"""Phrases whose words keep together, mined level by level with hashed bucket counts.

The texts are interned once: blocks of one language with a dictionary of their
words and the ids of all word places, a zero wherever a piece ends. That pass
counts words, and counts two-word sequences into hash buckets. Each later pass
reads blocks only. It takes the sequences of k words whose bucket reached the
least count and whose two parts of k - 1 words may be frequent (Apriori, by a
bitmap of the frequent ones), counts these exactly, and counts sequences of
k + 1 words whose two parts were taken into the next buckets. Bitmaps have no
false negatives: a false positive is counted exactly and dropped then.

A block sends what it counted in a row for each part of the sequences' places,
of which there are 64, and more beyond 16 GB of text: rows grow as blocks do.
A part of a language is summed at a time, so a frequent language spreads over all
parts.

What is broadcast are bitmaps of at most 2 ** MOST_BITS places (128 MB), however
large the input; their size follows the texts' bytes up to that. Bucket counts
stop at the least count, which is all that is asked of them, so a byte holds one.

A candidate's parts are looked up in the table of frequent sequences: a part is
at least as frequent as the whole. Leading rows per language are chosen in two
steps, among 512 parts and then among their leaders.

Defined results: a null text is empty, a null language `und`; words are bytes
and need not be valid UTF-8. Repeated rows count each time. A table without
frequent phrases gives no rows. Columns of other names are not looked at, so
none can clash. Long texts are read in pieces; a block that ends within a text
hands its last words on, so nothing is lost at its end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterbrook.llm.common import LOWER, UPPER, map_batches, remove, shared_dir, table

LONGEST = 4
LEAST = 30
COVERED = 80
TOP = 2000
#: Places of a bitmap: at least and at most.
FEWEST_BITS, MOST_BITS = 16, 30
#: Parts of a bitmap, as a power of two: a block sends a row for each at most, however large the bitmap is.
PARTS = 8
#: Partitions that the driver reads a bitmap in, one after the other.
READERS = 8
#: Words of a block, and bytes of a text that are split at once.
BLOCK_WORDS, SLICE = 1 << 20, 1 << 20
#: Words of a language that a task holds back for a full block; beyond, its largest block goes.
HELD_WORDS = 3 << 20
_BREAK = b"."
_FOLD = bytes.maketrans((UPPER + ",;:!?\n\v\f\r\t").encode(), (LOWER + "." * 9 + " ").encode())
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_BUCKETS = "array<struct<region:int,low:binary,n:binary>>"
_GRAMS = "array<struct<region:int,phrases:binary,n:binary>>"
_GRAM_KIND = pa.list_(pa.struct([("region", pa.int32()), ("phrases", pa.binary()), ("n", pa.binary())]))
#: Parts that sequences are counted in, as a power of two and at least; the bytes of text beyond which there are more; rows that a part's counts are handed on in.
COUNT_PARTS, PART_TEXT, GIVEN = 6, 256 << 20, 1 << 16


def word_lists(text: bytes | None) -> Iterator[list[bytes]]:
    """A text's words in order with `.` where a piece ends, in lists of about SLICE bytes."""
    data = (text or b"").translate(_FOLD)
    at = 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            cuts = [x for x in (data.find(b" ", end), data.find(_BREAK, end)) if x >= 0]
            end = min(cuts, default=len(data))
        yield data[at:end].replace(_BREAK, b" . ").split()
        at = end


class _Ids(dict):
    """Words to numbers in the order of their coming; the break is 0."""

    def __init__(self) -> None:
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Open:
    """A block that is being filled."""

    def __init__(self) -> None:
        self.ids, self.parts, self.size, self.lead = _Ids(), [], 0, 0

    def add(self, words: list[bytes]) -> None:
        if words:
            self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
            self.size += len(words)

    def close(self) -> tuple[list[bytes], np.ndarray, int]:
        """Dictionary, ids, and how many ids at its start only lend context; what follows begins anew with the last of them."""
        words = list(self.ids)
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        found = words, ids, self.lead
        tail = ids[-(LONGEST - 1) :]
        tail = tail[np.flatnonzero(tail == 0)[-1] + 1 :] if (tail == 0).any() else tail
        self.__init__()
        self.add([words[i] for i in tail.tolist()])
        self.lead = self.size
        return found


def _sequences(ids: np.ndarray, k: int, lead: int) -> np.ndarray:
    """Whether k words without a break stand at each place, and end behind the lent ones."""
    if len(ids) < k:
        return np.zeros(0, bool)
    whole = np.concatenate(([0], np.cumsum(ids == 0)))
    found = whole[k:] == whole[:-k]
    found[: max(0, lead - k + 1)] = False
    return found


def _places(hashes: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The bitmap place of the k words at each place, from their hashes."""
    n = len(hashes) - k + 1
    mixed = np.full(n, k * int(_ODD[3]) % (1 << 64), np.uint64)
    for j in range(k):
        mixed = (mixed ^ hashes[j : j + n]) * _ODD[j]
        mixed ^= mixed >> np.uint64(29)
    return (mixed * _ODD[0]) >> np.uint64(64 - bits)


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _pack(places: np.ndarray) -> bytes:
    """Ascending places as differences, byte plane by byte plane."""
    gaps = np.diff(places.astype("<u4"), prepend=np.uint32(0))
    return zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _regions(places: np.ndarray, bits: int, most: int) -> list[dict]:
    """Counts, no higher than most, of places, by part of the bitmap."""
    place, n = np.unique(places, return_counts=True)
    size = np.uint64(bits - PARTS)
    region = (place >> size).astype(np.int64)
    low, n = place & (np.uint64(1) << size) - np.uint64(1), np.minimum(n, most).astype(np.uint8)
    cuts = np.flatnonzero(np.r_[True, region[1:] != region[:-1]]) if len(place) else np.zeros(0, int)
    ends = np.r_[cuts[1:], len(place)]
    return [{"region": int(region[a]), "low": _pack(low[a:b]), "n": n[a:b].tobytes()} for a, b in zip(cuts.tolist(), ends.tolist(), strict=False)]


def _packed(phrases: list[bytes], n: np.ndarray, places: np.ndarray, shift: int) -> list[dict]:
    """Phrases and their counts by part, that is by the first bits of their places: a row for each part, however many phrases there are."""
    region = (places >> np.uint64(shift)).astype(np.int64)
    order = np.argsort(region, kind="stable")
    cuts = np.flatnonzero(np.diff(region[order], prepend=-1)).tolist()
    press = zstandard.ZstdCompressor(level=1).compress
    rows = []
    for a, b in zip(cuts, [*cuts, len(order)][1:], strict=True):
        own = order[a:b]
        # no word has a line's end
        rows.append({"region": int(region[own[0]]), "phrases": press(b"\n".join([phrases[i] for i in own.tolist()])), "n": n[own].astype("<i8").tobytes()})
    return rows


def _set(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which places are marked."""
    return bitmap[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1 == 1


def _distinct(ids: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place, how many) of each distinct sequence of k ids among those at some places."""
    code = ids[at].astype(np.int64)
    for j in range(1, k):
        if j > 1:
            code = np.unique(code, return_inverse=True)[1]
        code = code << 31 | ids[at + j]
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return at[first], n


def intern(docs: DataFrame, bits: int, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", parts: int = COUNT_PARTS) -> DataFrame:
    """Blocks (lang, words, grams, n, ids, lead, buckets): counts by word, packed by part, and of all words, and buckets of the sequences of two words."""
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    names = ["lang", "words", "grams", "n", "ids", "lead", "buckets"]
    kinds = [pa.string(), pa.list_(pa.binary()), _GRAM_KIND, pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.struct([("region", pa.int32()), ("low", pa.binary()), ("n", pa.binary())]))]

    def block(lang: str, held: _Open) -> pa.RecordBatch:
        words, ids, lead = held.close()
        counts = np.bincount(ids[lead:], minlength=len(words))
        counts[0] = 0
        hashes = _word_hashes(lang, words)
        buckets = _regions(_places(hashes[ids], 2, bits)[_sequences(ids, 2, lead)], bits, min(least, 255)) if len(ids) > 1 else []
        held_words = np.flatnonzero(counts)
        grams = _packed([words[i] for i in held_words.tolist()], counts[held_words], _places(hashes[held_words], 1, bits), bits - parts)
        return pa.record_batch([pa.array([x], t) for x, t in zip((lang, words, grams, int(counts.sum()), ids.astype("<i4").tobytes(), lead, buckets), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Open] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                own = held.setdefault(lang := lang.as_py(), _Open())
                for words in word_lists(text.as_py()):
                    own.add(words)
                    if own.size >= BLOCK_WORDS:
                        yield block(lang, own)
                own.add([_BREAK])
            if sum(x.size for x in held.values()) > HELD_WORDS:
                largest = max(held, key=lambda x: held[x].size)
                yield block(largest, held.pop(largest))
        for lang, own in held.items():
            if own.size:
                yield block(lang, own)

    return map_batches(source, run, f"lang string, words array<binary>, grams {_GRAMS}, n long, ids binary, lead int, buckets {_BUCKETS}")


def _summed(batches: Iterator[pa.RecordBatch], bits: int, most: int) -> dict[int, np.ndarray]:
    """Counts, no higher than most, by part."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for region, low, n in zip(*batch.columns, strict=True):
            own = total.setdefault(region.as_py(), np.zeros(1 << bits - PARTS, np.uint8))
            at = _unpack(low.as_py())
            own[at] = np.minimum(own[at].astype(np.int16) + np.frombuffer(n.as_py(), np.uint8), most)
    return total


def bitmap(buckets: DataFrame, bits: int, least: int = LEAST) -> Broadcast:
    """(region, low, n) summed by place; the places that reach least, as a broadcast bitmap of 2 ** bits places."""
    session = buckets.sparkSession
    most = min(least, 255)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region, own in _summed(batches, bits, most).items():
            at = np.flatnonzero(own)
            yield pa.record_batch([pa.array([region], pa.int32()), pa.array([_pack(at)]), pa.array([own[at].tobytes()])], names=["region", "low", "n"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region, own in _summed(batches, bits, most).items():
            yield pa.record_batch([pa.array([region], pa.int32()), pa.array([np.packbits(own >= most, bitorder="little").tobytes()])], names=["region", "marks"])

    n = max(1, min(1 << PARTS, int(session.conf.get("spark.sql.shuffle.partitions"))))
    # in two steps, so that no task reads a row of each block of the input
    parts = map_batches(buckets.repartition(n, "region", F.pmod(F.xxhash64("low"), F.lit(16))), summed, "region int, low binary, n binary")
    path = f"{shared_dir(session)}/bitmap-{uuid.uuid4().hex}"
    map_batches(parts.repartition(n, "region"), marked, "region int, marks binary").write.parquet(path)
    marks = np.zeros(1 << bits - 3, np.uint8)
    # a job for each partition is run by the iterator: few, of 16 MB at most
    for r in session.read.parquet(path).coalesce(READERS).toLocalIterator():
        marks[r.region * len(r.marks) : (r.region + 1) * len(r.marks)] = np.frombuffer(r.marks, np.uint8)
    remove(session, path)
    return session.sparkContext.broadcast(marks)


def frequent_bitmap(grams: DataFrame, k: int, bits: int, least: int = LEAST) -> Broadcast:
    """A bitmap of phrases (lang, phrase) of k words."""
    most = min(least, 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).extend(phrase.split(b" "))
            places = [_places(_word_hashes(lang, words), k, bits)[::k] for lang, words in by_lang.items()]
            rows = _regions(np.repeat(np.concatenate(places), most), bits, most) if places else []
            yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in (("region", pa.int32()), ("low", pa.binary()), ("n", pa.binary()))], names=["region", "low", "n"])

    return bitmap(map_batches(grams.select("lang", "phrase"), run, "region int, low binary, n binary"), bits, least)


def count_level(blocks: DataFrame, k: int, bits: int, buckets: Broadcast, lower: Broadcast, least: int = LEAST, longest: int = LONGEST, parts: int = COUNT_PARTS) -> DataFrame:
    """(lang, grams, buckets) of each block: its sequences of k words that may be frequent with their counts, packed by part, and buckets of those of k + 1."""
    names = ["lang", "grams", "buckets"]
    kinds = [pa.string(), _GRAM_KIND, pa.list_(pa.struct([("region", pa.int32()), ("low", pa.binary()), ("n", pa.binary())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, below = buckets.value, lower.value
        for batch in batches:
            for lang, words, ids, lead in zip(*(batch.column(c) for c in ("lang", "words", "ids", "lead")), strict=True):
                lang, words, lead = lang.as_py(), words.as_py(), lead.as_py()
                ids = np.frombuffer(ids.as_py(), "<i4")
                if len(ids) < k:
                    continue
                hashes = _word_hashes(lang, words)[ids]
                part = _set(below, _places(hashes, k - 1, bits))
                # lent words count for context here, so lead holds only for what is counted
                taken = _sequences(ids, k, 0) & part[:-1] & part[1:]
                at = np.flatnonzero(taken)
                places = _places(hashes, k, bits)
                at = at[_set(own, places[at])]
                ends = at[at + k > lead]
                first, n = _distinct(ids, ends, k)
                grams = _packed([b" ".join([words[w] for w in ids[a : a + k].tolist()]) for a in first.tolist()], n, places[first], bits - parts)
                further: list[dict] = []
                if k < longest and len(ids) > k:
                    taken = np.zeros(len(ids) - k + 1, bool)
                    taken[at] = True
                    longer = taken[:-1] & taken[1:] & _sequences(ids, k + 1, lead)
                    further = _regions(_places(hashes, k + 1, bits)[longer], bits, min(least, 255))
                yield pa.record_batch([pa.array([x], t) for x, t in zip((lang, grams, further), kinds, strict=True)], names=names)

    return map_batches(blocks.select("lang", "words", "ids", "lead"), run, f"lang string, grams {_GRAMS}, buckets {_BUCKETS}")


def _frequent(rows: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, f) of the phrases in packed grams that occur least times or more. A part of a language is summed at a time; its rows follow each other."""

    def given(lang: str, own: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        found = [(p, c) for p, c in own.items() if c >= least]
        for i in range(0, len(found), GIVEN):
            some = found[i : i + GIVEN]
            yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array([p for p, _ in some], pa.binary()), pa.array([c for _, c in some], pa.int64())], names=["lang", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, unpress = None, {}, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for lang, region, phrases, n in zip(*(batch.column(c) for c in ("lang", "region", "phrases", "n")), strict=True):
                key = lang.as_py(), region.as_py()
                if key != held:
                    if held:
                        yield from given(held[0], own)
                    held, own = key, {}
                counts = np.frombuffer(n.as_py(), "<i8").tolist()
                for p, c in zip(unpress(phrases.as_py()).split(b"\n"), counts, strict=True):
                    own[p] = own.get(p, 0) + c
        if held:
            yield from given(held[0], own)

    packed = rows.select("lang", F.explode("grams").alias("g")).select("lang", "g.*").repartition("lang", "region").sortWithinPartitions("lang", "region")
    return map_batches(packed, run, "lang string, phrase binary, f long")


def frequent(docs: DataFrame, folder: str, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, n_words, phrase, f) of all phrases of 1 to longest words that occur least times or more, and (lang, n) of all words; folder takes what is written between passes."""
    session = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("binary")).cast("long"))).first()[0] or 0
    if bits is None:
        bits = min(MOST_BITS, max(FEWEST_BITS, (size // 6).bit_length()))
    parts = min(bits, max(COUNT_PARTS, (size // PART_TEXT).bit_length()))

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return session.read.parquet(f"{folder}/{name}")

    blocks = kept(intern(docs, bits, least, text_col, lang_col, parts), "blocks")
    levels = [kept(_frequent(blocks, least), "level-1")]
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    rows = blocks
    for k in range(2, longest + 1):
        above = bitmap(rows.select(F.explode("buckets").alias("b")).select("b.*"), bits, least)
        below = frequent_bitmap(levels[-1], k - 1, bits, least)
        rows = kept(count_level(blocks, k, bits, above, below, least, longest, parts), f"counts-{k}")
        levels.append(kept(_frequent(rows, least), f"level-{k}"))
        above.destroy()
        below.destroy()
    found = [x.select("lang", F.lit(k).alias("n_words"), "phrase", "f") for k, x in enumerate(levels, 1)]
    whole = found[0]
    for x in found[1:]:
        whole = whole.unionByName(x)
    return whole, totals


def scored(phrases: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, n_words, phrase, a, l, r, score) of the phrases of two words or more: parts and score of their lowest-scoring cut."""
    long = phrases.filter("n_words > 1").select("lang", "n_words", "phrase", F.col("f").alias("a"))
    cuts = long.select("*", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    words = F.split(F.decode(F.col("phrase"), "ISO-8859-1"), " ")
    part = lambda a, n: F.encode(F.array_join(F.slice(words, a, n), " "), "ISO-8859-1")
    cuts = cuts.withColumns({"first": part(F.lit(1), F.col("k")), "rest": part(F.col("k") + 1, F.col("n_words") - F.col("k"))})
    parts = phrases.filter(F.col("n_words") < longest)
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("CAST((CAST(a AS DECIMAL(38,0)) * 2000000) DIV (CAST(l AS DECIMAL(20,0)) + r) AS LONG)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x")
    return cuts.groupBy("lang", "n_words", "phrase", "a").agg(lowest).select("lang", "n_words", "phrase", "a", "x.l", "x.r", "x.score")


def uncovered(phrases: DataFrame, scores: DataFrame, covered: int = COVERED) -> DataFrame:
    """scores without the phrases that lie within a longer one which occurs covered percent as often."""
    words = F.split(F.decode(F.col("phrase"), "ISO-8859-1"), " ")
    spans = F.expr("flatten(transform(sequence(2, n_words - 1), m -> transform(sequence(1, n_words - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    longer = phrases.filter("n_words > 2").withColumn("w", words).select("lang", "f", F.explode(F.array_distinct(spans)).alias("s"))
    most = longer.groupBy("lang", F.encode("s", "ISO-8859-1").alias("phrase")).agg(F.max("f").alias("most"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    return scores.join(most, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (exact("most") * 100 < exact("a") * covered)).drop("most")


def leaders(scores: DataFrame, top: int = TOP) -> DataFrame:
    """The first rows of each language with their rank: by score, count and phrase."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    some = scores.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(512)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= top).drop("_part")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def mine(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP, text_col: str = "text", lang_col: str = "lang", bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's leading phrases of 2 to LONGEST words."""
    session = docs.sparkSession
    folder = f"{shared_dir(session)}/collocations-{uuid.uuid4().hex}"
    remove(session, folder, at_exit=True)
    phrases, totals = frequent(docs, folder, least, LONGEST, text_col, lang_col, bits)
    best = leaders(uncovered(phrases, scored(phrases), covered), top)
    counted = best.join(totals, "lang")
    number = lambda c: F.col(c).cast("long").alias(c)
    return counted.select("lang", number("rank"), F.col("phrase").cast("string").alias("phrase"), *map(number, ("a", "l", "r", "n", "score")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {LONGEST + 1}) r(k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
total AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT *, array_to_string(w[1:c], ' ') AS first, array_to_string(w[c + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)),
halves AS (SELECT x.lang, x.phrase, x.a, x.c, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * x.a // (l.f + r.f) AS BIGINT) AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = x.first JOIN f r ON r.lang = x.lang AND r.phrase = x.rest),
low AS (SELECT * FROM halves QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
within AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM cand, range(2, {LONGEST}) r(m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN within USING (lang, phrase) WHERE most IS NULL OR 100 * most < {COVERED} * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
