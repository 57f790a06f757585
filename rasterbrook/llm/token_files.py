"""Token ids of documents in binary shard files, with a minimal perfect hash index from document keys to their places.

Documents are dealt by ranges of their key, so shard files follow each other in
ascending key order (nulls last; rows of one key by a hash of their text). A
shard file holds the raw ids, little-endian, of two bytes where the vocabulary
allows it and else of four, then the end of each record and a footer. The index
has a file for each part of the keys' hashes: bit levels that send each key to
a place of its own without gaps (a key goes to the first level where no other
key shares its bit; its rank among the set bits is its place), and by place a
fingerprint, the shard, the record, and how many records of the key follow
each other there. A key of many rows has an entry for each shard that holds
some, so an entry never stands for more than a shard. Looking up a key reads
one part of the index and one record, however many there are.

Files are written under another name and put in place whole, so a task that
runs twice leaves the same files. The folder must be mounted by all executors,
as spark.checkpoint.dir is; another scheme raises ValueError.

Defined results: a null text is empty and has only the end id; a null key is a
key like any other; invalid UTF-8 is read as U+FFFD. Repeated rows are all
stored, and found together by their key. Keys that aren't stored give no row
(one in 2 ** 32 is taken for another's). An empty table makes no files. Only
the key and the text column are read, so other columns can't clash. Long texts
are encoded in pieces cut at white space.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import cache, lru_cache
from math import ceil

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterbrook.llm.common import chunks, map_batches, remove, shared_dir, table, utf8
from rasterbrook.llm.lm import mounted
from rasterbrook.llm.pretokens import _class

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END = 1
#: Bytes of text for a shard, and keys for a part of the index, about.
SHARD_BYTES, PART_KEYS = 32 << 20, 1 << 18
#: Records that a reading task takes up at once.
RUN = 4096
#: Pieces whose ids a worker keeps, and characters of a text that are encoded at once.
CACHED, SLICE = 300_000, 1 << 20
#: Bits of a level for each key that is left, and the most levels.
SPARSE, LEVELS = 2, 48
_FOOTER = np.dtype([("magic", "S8"), ("width", "<u8"), ("records", "<u8"), ("ids", "<u8")])
_MAGIC = b"ids+ends"
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)]


# Encoding


class Encoder:
    """Texts to ids of a lower-casing word-end tokenizer file, by the library, each piece of text once.

    The file's own steps are composition, white space to blanks, lower case and
    a split by pattern; no step looks across white space. Words of Latin
    characters, which no composition changes, are lower-cased and split here and
    their pieces given to the library's model; all others go to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        plain = [b for b in range(256) if b in range(0x21, 0x7F) or b in range(0xA1, 0xAD) or b in range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in plain]
        self.signs = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        letter, number, space = _class("L"), _class("N"), r"\t-\r \x85\xa0"
        self.pieces = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{letter}]+|[{number}]|[^{space}{letter}{number}]+").findall
        self.foreign = re.compile(r"[^\x00-\u012f\u0131-\u017f]|<\|").search
        self.words = re.compile(r"[^ \t\n\r]+").findall

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def _learn(self, pieces: set[str], own: bool) -> None:
        """Makes self.known know pieces: own ones through the model, others whole."""
        if len(self.known) > CACHED:  # pieces that the last ones didn't use are forgotten
            self.older, self.known = self.known, {}
        for x in pieces.difference(self.known):
            found = self.older.get(x)
            if found is None and own:
                found = self._packed([t.id for t in self.library.model.tokenize(x.encode().decode("latin-1").translate(self.signs))])
            elif found is None:
                found = self._packed(self.library.encode(x, add_special_tokens=False).ids)
            self.known[x] = found

    def _joined(self, pieces: list[str], own: bool) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            self._learn(set(pieces), own)
            return b"".join(map(self.known.__getitem__, pieces))

    def _slice(self, text: str) -> bytes:
        if not self.foreign(text):
            return self._joined(self.pieces(text.lower()), True)
        return b"".join(self._joined([w], False) if self.foreign(w) else self._joined(self.pieces(w.lower()), True) for w in self.words(text))

    def encode(self, text: str) -> bytes:
        if len(text) <= SLICE:
            return self._slice(text)
        out, at = [], 0
        space = re.compile(r"[ \n]")
        while at < len(text):
            found = space.search(text, at + SLICE)
            end = found.start() if found else len(text)
            out.append(self._slice(text[at:end]))
            at = end
        return b"".join(out)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


# Keys and their minimal perfect hash


def key_of(id_col: Column) -> Column:
    """An id as bytes: its text behind 01, and 00 for a null."""
    return F.when(id_col.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), id_col.cast("string").cast("binary")))


def _key(value) -> bytes:
    """The same for a value that prints as Spark casts it."""
    return b"\x00" if value is None else b"\x01" + (value if isinstance(value, bytes) else str(value).encode())


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.concat(key, F.unhex(F.lit("02")))).alias("h2")]


def _mixed(h1: np.ndarray, h2: np.ndarray, turn: np.ndarray) -> np.ndarray:
    x = h1 ^ (h2 * _MIX[2]) ^ (turn.astype(np.uint64) * _MIX[0])
    x = (x ^ x >> np.uint64(30)) * _MIX[0]
    return x ^ x >> np.uint64(27)


def _bit(x: np.ndarray, level: int, bits: int) -> np.ndarray:
    y = (x + np.uint64(level * int(_MIX[2]) % (1 << 64))) * _MIX[1]
    y = (y ^ y >> np.uint64(31)) * _MIX[0]
    return (y ^ y >> np.uint64(29)) % np.uint64(bits)


class PerfectHash:
    """Distinct 64-bit numbers to 0 .. n - 1, without gaps."""

    def __init__(self, sizes: list[int], words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks

    @classmethod
    def build(cls, x: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(x):
            if len(sizes) == LEVELS:
                raise ValueError("keys share a hash")
            bits = -(-SPARSE * len(x) // 64) * 64
            at = _bit(x, len(sizes), bits)
            alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(bits)
            x = x[~alone[at]]
        flat = np.concatenate(words) if words else np.zeros(0, "<u8")
        return cls(sizes, flat, np.concatenate(([0], np.cumsum(np.bitwise_count(flat)))).astype("<u4"))

    def place(self, x: np.ndarray) -> np.ndarray:
        """The place of each; -1 for some that were not there."""
        out = np.full(len(x), -1, np.int64)
        left, base = np.arange(len(x)), 0
        for level, bits in enumerate(self.sizes):
            if not len(left):
                break
            at = _bit(x[left], level, bits)
            word = base + (at >> np.uint64(6)).astype(np.int64)
            value, shift = self.words[word], at & np.uint64(63)
            here = (value >> shift & np.uint64(1)).astype(bool)
            below = np.bitwise_count(value & ((np.uint64(1) << shift) - np.uint64(1)))
            out[left[here]] = (self.ranks[word] + below)[here]
            left = left[~here]
            base += bits // 64
        return out


_COLUMNS = ("mark", "shard", "record", "count", "spans")


def _put(path: str, parts: list[bytes]) -> None:
    """A file that appears whole."""
    own = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.writelines(parts)
    os.replace(own, path)


def _write_part(path: str, h1: np.ndarray, h2: np.ndarray, shard: np.ndarray, record: np.ndarray, count: np.ndarray) -> int:
    """The index file of some runs; runs of one key are numbered by shard. Returns its bytes."""
    order = np.lexsort((shard, h2, h1))
    h1, h2, shard, record, count = (x[order] for x in (h1, h2, shard, record, count))
    fresh = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])] if len(h1) else np.zeros(0, bool)
    first = np.flatnonzero(fresh)
    spans = np.diff(np.r_[first, len(h1)])
    turn = np.arange(len(h1)) - np.repeat(first, spans)
    x = _mixed(h1, h2, turn)
    own = PerfectHash.build(x)
    place = own.place(x)
    columns = {c: np.zeros(len(x), "<u4") for c in _COLUMNS}
    for c, values in zip(_COLUMNS, (h2 & np.uint64(0xFFFFFFFF), shard, record, count, np.repeat(spans, spans)), strict=True):
        columns[c][place] = values
    head = json.dumps({"keys": len(x), "sizes": own.sizes, "words": len(own.words)}).encode()
    head = len(head).to_bytes(8, "little") + head
    parts = [head + b" " * (-len(head) % 8), own.words.tobytes(), own.ranks.tobytes(), *(columns[c].tobytes() for c in _COLUMNS)]
    _put(path, parts)
    return sum(map(len, parts))


class IndexPart:
    """A memory-mapped part of the index."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view("<u8")[0])
        head = json.loads(raw[8 : 8 + n].tobytes())
        at = 8 + n + -(8 + n) % 8

        def array(size: int, kind: str) -> np.ndarray:
            nonlocal at
            bytes_ = size * int(kind[-1])
            at += bytes_
            return raw[at - bytes_ : at].view(kind)

        words, ranks = array(head["words"], "<u8"), array(head["words"] + 1, "<u4")
        self.hash = PerfectHash(head["sizes"], words, ranks)
        self.keys = head["keys"]
        self.columns = {c: array(self.keys, "<u4") for c in _COLUMNS}

    def find(self, h1: np.ndarray, h2: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Which are there, and the columns of those."""
        place = self.hash.place(_mixed(h1, h2, turn)) if self.keys else np.full(len(h1), -1)
        there = place >= 0
        there[there] = self.columns["mark"][place[there]] == (h2[there] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return there, {c: self.columns[c][place[there]].astype(np.int64) for c in _COLUMNS[1:]}


@lru_cache(maxsize=16)
def index_part(path: str) -> IndexPart:
    return IndexPart(path)


class Shard:
    """A memory-mapped shard file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        foot = raw[-_FOOTER.itemsize :].view(_FOOTER)[0]
        if foot["magic"] != _MAGIC:
            raise ValueError(f"not a shard of ids: {path}")
        width, records, ids = (int(foot[c]) for c in ("width", "records", "ids"))
        self.ids = raw[: width * ids].view(f"<u{width}")
        at = width * ids + -(width * ids) % 8
        self.ends = raw[at : at + 8 * records].view("<u8")

    def span(self, record: int) -> tuple[int, int]:
        return int(self.ends[record - 1]) if record else 0, int(self.ends[record])


@lru_cache(maxsize=16)
def open_shard(path: str) -> Shard:
    return Shard(path)


def _shard_path(folder: str, shard: int) -> str:
    return f"{folder}/ids-{shard:08d}.bin"


def _part_path(folder: str, part: int) -> str:
    return f"{folder}/index-{part:08d}.mph"


# Writing


class _Writer:
    """A shard file that is being written, and the runs of its keys."""

    def __init__(self, folder: str, shard: int, width: int):
        self.path, self.shard, self.width = _shard_path(folder, shard), shard, width
        self.own = f"{folder}/.ids-{shard:08d}.{uuid.uuid4().hex}"
        self.file = open(self.own, "wb")  # noqa: SIM115
        self.ends: list[int] = []
        self.size, self.run = 0, None

    def add(self, row: tuple, data: bytes) -> tuple | None:
        """row: a key's columns. Returns the run that it ends."""
        self.file.write(data)
        self.size += len(data) // self.width
        self.ends.append(self.size)
        if self.run and self.run[0] == row:
            self.run[2] += 1
            return None
        done, self.run = self.run, [row, len(self.ends) - 1, 1]
        return done

    def close(self) -> None:
        self.file.write(b"\0" * (-self.size * self.width % 8))
        self.file.write(np.array(self.ends, "<u8").tobytes())
        self.file.write(np.array([(_MAGIC, self.width, len(self.ends), self.size)], _FOOTER).tobytes())
        self.file.close()
        os.replace(self.own, self.path)


def _write_shards(docs: DataFrame, folder: str, tokenizer: str, end: int, n: int, id_col: str, text_col: str) -> DataFrame:
    """Shard files of docs; (h1, h2, shard, record, count, ids) of each run of a key, ids the size of its shard in its last run."""
    # rows alike in key and text may be many: their places in the input deal them out
    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).withColumn("place", F.monotonically_increasing_id())
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text"), F.col("place")]
    sorted_ = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*_hashes(key_of(F.col("id"))), "text")
    names = ["h1", "h2", "shard", "record", "count", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, writer = encoder(tokenizer), None
        last = np.array([end], f"<u{own.width}").tobytes()

        def sent(runs: list[tuple], size: int = 0) -> pa.RecordBatch:
            columns = list(zip(*((*key, writer.shard, record, count, 0) for key, record, count in runs), strict=True))
            columns[-1] = [0] * (len(runs) - 1) + [size]
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)

        for part, texts in chunks(batches):
            if writer is None:
                writer = _Writer(folder, TaskContext.get().partitionId(), own.width)
            keys = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
            runs = [done for key, text in zip(keys, texts, strict=True) if (done := writer.add(key, own.encode(text or "") + last))]
            if runs:
                yield sent(runs)
        if writer:
            writer.close()
            yield sent([writer.run], writer.size)

    return map_batches(sorted_, run, ", ".join(f"{c} long" for c in names))


def _write_index(runs: DataFrame, folder: str, parts: int) -> DataFrame:
    """Index files of the runs; (part, keys, bytes)."""
    dealt = runs.select(F.pmod("h1", F.lit(parts)).alias("part"), "h1", "h2", "shard", "record", "count")

    def build(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        h1, h2 = (rows.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        size = _write_part(_part_path(folder, part), h1, h2, *(rows.column(c).to_numpy() for c in ("shard", "record", "count")))
        return pa.table({"part": [part], "keys": [rows.num_rows], "bytes": [size]})

    return dealt.groupBy("part").applyInArrow(build, "part long, keys long, bytes long")


def _running(sizes: DataFrame) -> DataFrame:
    """(shard, records, ids) with start, the ids of all shards before, by sums in two steps."""
    group = F.floor(F.col("shard") / 1024)
    sized = sizes.withColumn("g", group)
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = sized.groupBy("g").agg(F.sum("ids").alias("total")).select("g", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("inner", F.coalesce(F.sum("ids").over(own), F.lit(0))).join(groups, "g").select("shard", "records", "ids", (F.col("base") + F.col("inner")).alias("start"))


class TokenFiles:
    """Shards and index in a folder: get() for a key here, read() for a table of keys."""

    def __init__(self, folder: str):
        self.folder = folder
        with open(f"{folder}/about.json") as f:
            self.about = json.load(f)

    def get(self, key) -> list[np.ndarray]:
        """The ids of each record of a key, in order; a few pages are read."""
        raw = _key(key)
        h = [np.array([xxhash.xxh64_intdigest(x, 42)], np.uint64) for x in (raw, raw + b"\x02")]
        part = _part_path(self.folder, int(h[0].view(np.int64)[0] % self.about["parts"])) if self.about["parts"] else ""
        out, turn, spans = [], 0, 1
        while turn < spans and os.path.exists(part):
            there, found = index_part(part).find(*h, np.array([turn]))
            if not there[0]:
                break
            own = open_shard(_shard_path(self.folder, int(found["shard"][0])))
            first = int(found["record"][0])
            out += [own.ids[slice(*own.span(r))] for r in range(first, first + int(found["count"][0]))]
            turn, spans = turn + 1, int(found["spans"][0])
        return out

    def find(self, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """(id, shard, record, count) of the keys in a table: its places by the index, at most RUN records a row. Each key is asked for once a row."""
        folder, parts = self.folder, self.about["parts"]
        kind = keys.select(id_col).schema[0].dataType.simpleString()
        asked = keys.select(F.col(id_col).alias("id"), *_hashes(key_of(F.col(id_col))))
        asked = asked.withColumn("part", F.pmod("h1", F.lit(max(1, parts))))
        n = max(1, min(parts, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        dealt = asked.repartition(n, "part").sortWithinPartitions("part")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part = batch.column(3).to_numpy()
                cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
                    path = _part_path(folder, int(part[a]))
                    if not os.path.exists(path):
                        continue
                    h1, h2 = (batch.column(c).slice(a, b - a).to_numpy().view(np.uint64) for c in (1, 2))
                    at, turn = np.arange(a, b), np.zeros(b - a, np.int64)
                    while len(at):
                        there, found = index_part(path).find(h1, h2, turn)
                        at, h1, h2, turn = at[there], h1[there], h2[there], turn[there]
                        yield pa.record_batch([batch.column(0).take(pa.array(at)), *(pa.array(found[c]) for c in ("shard", "record", "count"))], names=["id", "shard", "record", "count"])
                        more = turn + 1 < found["spans"]
                        at, h1, h2, turn = at[more], h1[more], h2[more], turn[more] + 1

        found = map_batches(dealt, run, f"id {kind}, shard long, record long, count long")
        starts = F.explode(F.sequence(F.lit(0), F.col("count") - 1, F.lit(RUN)))
        cut = found.select("id", "shard", "record", "count", starts.alias("s"))
        return cut.select("id", "shard", (F.col("record") + F.col("s")).alias("record"), F.least(F.col("count") - F.col("s"), F.lit(RUN)).alias("count"))

    def read(self, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """(id, shard, record, start, ids) of all records of the keys: ids of all records before, and its ids as little-endian unsigned 32-bit integers."""
        folder, session = self.folder, keys.sparkSession
        found = self.find(keys, id_col)
        kind = found.schema["id"].dataType.simpleString()
        dealt = found.repartition(F.col("shard"), F.floor(F.col("record") / RUN)).sortWithinPartitions("shard", "record")
        fields = [("shard", pa.int64()), ("record", pa.int64()), ("inner", pa.int64()), ("ids", pa.binary())]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[list] = [[], [], [], []]
                origin, held = [], 0

                def sent(batch=batch) -> pa.RecordBatch:
                    return pa.record_batch([batch.column(0).take(pa.array(origin, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True))], names=["id", *(n for n, _ in fields)])

                for i, (shard, record, count) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                    own = open_shard(_shard_path(folder, shard))
                    for r in range(record, record + count):
                        a, b = own.span(r)
                        for column, value in zip(out, (shard, r, a, own.ids[a:b].astype("<u4").tobytes()), strict=True):
                            column.append(value)
                        origin.append(i)
                        held += 4 * (b - a) + 40
                        if held > 4 << 20:
                            yield sent()
                            out, origin, held = [[], [], [], []], [], 0
                if origin:
                    yield sent()

        rows = map_batches(dealt, run, f"id {kind}, shard long, record long, inner long, ids binary")
        if not self.about["parts"]:
            return rows.select(F.col("id").alias(id_col), "shard", "record", F.col("inner").alias("start"), "ids")
        starts = session.read.parquet(f"{self.about['url']}/starts").select("shard", "start")
        return rows.join(starts, "shard").select(F.col("id").alias(id_col), "shard", "record", (F.col("start") + F.col("inner")).alias("start"), "ids")


def write(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end: int = END, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, part_keys: int = PART_KEYS) -> TokenFiles:
    """Encodes docs into a new folder of the shared store, with the index of their keys."""
    session, local = docs.sparkSession, mounted(folder)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("binary"))), F.count("*")).first()
    os.makedirs(local)
    n = max(1, ceil((size[0] or 0) / shard_bytes))
    _write_shards(docs, local, tokenizer, end, n, id_col, text_col).write.parquet(f"{folder}/runs")
    runs = session.read.parquet(f"{folder}/runs")
    parts = ceil(runs.count() / part_keys)
    if parts:
        sizes = runs.groupBy("shard").agg(F.sum("count").alias("records"), F.sum("ids").alias("ids"))
        _running(sizes).write.parquet(f"{folder}/starts")
        _write_index(runs, local, parts).write.parquet(f"{folder}/parts")
    remove(session, f"{folder}/runs")
    _put(f"{local}/about.json", [json.dumps({"parts": parts, "url": folder, "tokenizer": os.path.basename(tokenizer), "end": end}).encode()])
    return TokenFiles(local)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    remove(spark, folder, at_exit=True)
    # each key once: a key's entry leads to all of its records
    rows = write(docs, folder).read(docs.select("doc_id").distinct())
    return rows.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").cast("long").alias("ids_crc32"))
