"""Links between the tokens of two tokenizers, through a dictionary of token groups.

A text is tokenized by A (byte-level BPE) and B (piece BPE with byte fallback).
The byte offsets where tokens of both end cut it into groups. Groups repeat, so
they are interned: blocks of documents hold a dictionary of their distinct
groups, and for each document the numbers of its distinct groups with their
frequencies. The links of a group (pairs of an A and a B token that overlap)
are expanded once per distinct group. How many documents hold a pair is counted
in blocks and summed; sums over a group's links are joined back to the blocks
by the group, and multiplied by its frequency in each document. A group's links
are fewer than its tokens, since no end within it is shared.

Texts are cut into chunks at white space, and chunks into pieces, where neither
tokenizer looks across: A's pattern ends there, and no piece of B's vocabulary
holds the two characters beside each other, so no merge can join them. Groups of
new pieces are found for many pieces at once, where the running sums of the byte
lengths of A's and B's tokens agree.

Defined results: a null or empty text has no tokens; neither has one whose
bytes A or B doesn't give back (as where it holds U+2581, which B reads as a
blank). Invalid UTF-8 is read as U+FFFD. Strings of special tokens are plain
text. Repeated rows are documents of their own and count each. Ids may repeat
or be null. An empty table stays so. Only the id and text columns are read, so
no other column can clash. Long texts are tokenized in pieces.
"""

from __future__ import annotations

import gc
import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain, count, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterbrook.llm.common import chunks, map_batches, remove, shared_dir, table, utf8
from rasterbrook.llm.pretokens import splitter

A_FILE = public_tokenizers.path("byte_bpe_50k.json")
B_FILE = public_tokenizers.path("piece_bpe_32k.model")
#: Bytes of text, and documents, of a block.
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 1 << 16
#: Characters of text whose chunks are learnt at once, pieces whose groups are found at once, and groups of a text that are hashed at once.
LOT_CHARS, LOT_PIECES, LOT_GROUPS = 1 << 20, 1 << 14, 1 << 16
#: Pieces that a worker keeps, twice: those of late, and those before. Groups, and characters of them, from which the next block begins anew.
CACHED_PIECES, MOST_GROUPS, MOST_GROUP_CHARS = 200_000, 1 << 18, 1 << 24
#: Characters of a text from which its chunks aren't listed at once.
LONG = 1 << 20
_BLANK = "\u2581"
_WHITE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Of these, all but a blank and a line's end.
_WHITE_REST = r"\t\x0b-\r" + _WHITE[6:]


class _Recent:
    """What was found of late; what hasn't been asked for since is forgotten."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get_all(self, keys: list[str]) -> list:
        found, old = list(map(self.new.get, keys)), self.old.get
        for i, x in enumerate(found):
            if x is None and (x := old(keys[i])) is not None:
                found[i] = x
                self.put(keys[i], x)
        return found

    def put(self, key: str, value: object) -> None:
        if len(self.new) >= self.most:
            self.new, self.old = {}, self.new
        self.new[key] = value


class _Numbers(dict):
    """Texts to numbers in the order of their coming."""

    def __init__(self) -> None:
        super().__init__()
        self.order: list[str] = []
        self.chars = 0

    def __missing__(self, x: str) -> int:
        self[x] = n = len(self.order)
        self.order.append(x)
        self.chars += len(x)
        return n


class _Groups(dict):
    """Numbers of groups by their text, those of one A and one B token by a * n_b + b too, and the pieces known by them."""

    def __init__(self, n_b: int):
        super().__init__()
        self.n_b, self.names, self.known = n_b, _Numbers(), _Recent(CACHED_PIECES)

    def __missing__(self, key: int) -> int:
        self[key] = n = self.names[f"{key // self.n_b}|{key % self.n_b}"]
        return n


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and how often each is there (a sort, faster here than numpy's hashing)."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))
    return x[first], np.diff(first, append=len(x))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Pair:
    """Two tokenizers over pieces of text."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        with open(b_file, "rb") as f:
            # a later normalizer_spec is merged into the first: add_dummy_prefix is false
            self.b = sentencepiece.SentencePieceProcessor(model_proto=f.read() + b"\x1a\x02\x18\x00")
        plain = [x for x in range(256) if x in range(0x21, 0x7F) or x in range(0xA1, 0xAD) or x in range(0xAE, 0x100)]
        others = [x for x in range(256) if x not in plain]
        self.signs = {x: chr(x) for x in plain} | {x: chr(256 + i) for i, x in enumerate(others)}
        byte_of = {s: x for x, s in self.signs.items()}
        self.a_bytes = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.b_bytes, beside = {}, set()
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes[i] = bytes([int(piece[3:5], 16)])
            elif self.b.is_control(i) or self.b.is_unknown(i):
                self.b_bytes[i] = b""
            else:
                piece = piece.replace(_BLANK, " ")
                self.b_bytes[i] = piece.encode()
                beside.update(zip(piece, piece[1:], strict=False))
        self.a_text, self.b_text = ({i: str(i) for i in x} for x in (self.a_bytes, self.b_bytes))
        self.a_sizes, self.b_sizes = (np.array([len(x.get(i, b"")) for i in range(max(x, default=0) + 1)]) for x in (self.a_bytes, self.b_bytes))
        self.beside = beside
        # where chunks end is safe for B too: a blank or a line's end begins no chunk that B would join
        self.cut = not any(y in " \n" and x not in " \n" for x, y in beside)
        self.chunks = re.compile(f"(?:[{_WHITE}]++(?:[^{_WHITE}]++|[{_WHITE_REST}][{_WHITE}]*+)*+|(?:[^{_WHITE}]++|[{_WHITE_REST}][{_WHITE}]*+)++)")
        self.late = _Groups(len(self.b_sizes))

    def groups(self) -> _Groups:
        """The numbers of groups that a new block is to use."""
        if len(self.late.names) >= MOST_GROUPS or self.late.names.chars >= MOST_GROUP_CHARS:
            self.late = _Groups(len(self.b_sizes))
        return self.late

    def pieces(self, chunk: str, several: set[str]) -> list[str]:
        """A's pre-tokens, joined where B might join them; those joined are put into several."""
        words = splitter()(chunk)
        if len(words) == 1 or (len(words) == 2 and (words[0][-1], words[1][0]) not in self.beside) or not any((x[-1], y[0]) in self.beside for x, y in zip(words, words[1:], strict=False)):
            return words
        out = words[:1]
        for word in words[1:]:
            if (out[-1][-1], word[0]) in self.beside:
                out[-1] += word
                several.add(out[-1])
            else:
                out.append(word)
        return out

    def _a_ids(self, pieces: list[str], several: set[str]) -> list[list[int]]:
        mark, tokenize, split = "\ud800", self.a.model.tokenize, splitter()  # no text holds half a surrogate pair
        spell = lambda x: x.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.signs)
        spelled = spell(mark.join(pieces)).split(spell(mark))
        if several:
            return [[t.id for w in (map(spell, split(p)) if p in several else (s,)) for t in tokenize(w)] for p, s in zip(pieces, spelled, strict=True)]
        return [[t.id for t in tokenize(s)] for s in spelled]

    def _groups(self, pieces: list[str], several: set[str], of: _Groups) -> list[bytes]:
        """The numbers of each piece's groups; none where A or B doesn't give its bytes back."""
        if not pieces:
            return []
        raw, ids_a, ids_b = [p.encode() for p in pieces], self._a_ids(pieces, several), self.b.encode(pieces, num_threads=1)
        flat_a, flat_b = (list(chain.from_iterable(x)) for x in (ids_a, ids_b))
        a, b = np.array(flat_a, np.int64), np.array(flat_b, np.int64)
        ends, ends_a, ends_b = np.cumsum([len(x) for x in raw]), np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])

        def given_back(ids: list[list[int]], flat: list[int], token_ends: np.ndarray, parts: dict[int, bytes]) -> bool:
            own = np.concatenate(([0], token_ends))[np.cumsum([len(x) for x in ids])]
            return np.array_equal(own, ends) and b"".join(map(parts.__getitem__, flat)) == b"".join(raw)

        if not (given_back(ids_a, flat_a, ends_a, self.a_bytes) and given_back(ids_b, flat_b, ends_b, self.b_bytes)):
            good = [r == b"".join([self.a_bytes[i] for i in x]) == b"".join([self.b_bytes[i] for i in y]) for r, x, y in zip(raw, ids_a, ids_b, strict=True)]
            found = iter(self._groups([p for p, g in zip(pieces, good, strict=True) if g], several, of))
            return [next(found) if g else b"" for g in good]
        marks = np.zeros(ends[-1] + 1, np.uint8)
        marks[ends_a] = 1
        marks[ends_b] |= 2
        before = np.cumsum(marks == 3)
        n = int(before[-1])
        n_a, n_b = (np.bincount(before[x - 1], minlength=n) for x in (ends_a, ends_b))
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        numbers, single = np.zeros(n, np.int32), (n_a == 1) & (n_b == 1)
        keys = a[first_a[single]] * of.n_b + b[first_b[single]]
        numbers[single] = np.fromiter(map(of.__getitem__, keys.tolist()), np.int32, len(keys))
        rest, text_a, text_b, names = np.flatnonzero(~single), self.a_text, self.b_text, of.names
        places = zip(*(x[rest].tolist() for x in (first_a, first_a + n_a, first_b, first_b + n_b)), strict=True)
        numbers[rest] = [names[f"{','.join([text_a[x] for x in flat_a[i:j]])}|{','.join([text_b[x] for x in flat_b[k:m]])}"] for i, j, k, m in places]
        data, cuts = numbers.tobytes(), (4 * before[ends]).tolist()
        return [data[i:j] for i, j in zip([0, *cuts], cuts, strict=False)]

    def learn(self, chunks: list[str], of: _Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each chunk whether both give its bytes back, and how many groups it has; the groups' numbers, one chunk after the other."""
        several: set[str] = set()
        split = [self.pieces(c, several) for c in chunks]
        pieces = list(chain.from_iterable(split))
        found = of.known.get_all(pieces)
        missing = [i for i, x in enumerate(found) if x is None]
        own, new = {}, list(dict.fromkeys([pieces[i] for i in missing]))
        for i in range(0, len(new), LOT_PIECES):
            lot = new[i : i + LOT_PIECES]
            own.update(zip(lot, self._groups(lot, several.intersection(lot), of), strict=True))
        for p, x in own.items():
            of.known.put(p, x)
        for i in missing:
            found[i] = own[pieces[i]]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in split], dtype=np.int64)))
        sizes = np.array([len(x) for x in found], np.int64) // 4
        total, none = (np.concatenate(([0], np.cumsum(x))) for x in (sizes, sizes == 0))
        return np.diff(none[ends]) == 0, np.diff(total[ends]), np.frombuffer(b"".join(found), np.int32)

    def links(self, group: str) -> list[tuple[int, int]]:
        """The pairs of a group's tokens whose bytes overlap."""
        a, b = (list(map(int, x.split(","))) for x in group.split("|"))
        ends_a, ends_b = (list(accumulate(len(of[i]) for i in x)) for x, of in ((a, self.a_bytes), (b, self.b_bytes)))
        out, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            out.append((a[i], b[j]))
            here = min(ends_a[i], ends_b[j])
            i, j = i + (ends_a[i] == here), j + (ends_b[j] == here)
        return out


@cache
def pair(a_file: str, b_file: str) -> Pair:
    return Pair(a_file, b_file)


class _Block:
    """Documents with their distinct groups and how often each has them; chunks have numbers and are learnt by lots of documents."""

    def __init__(self, own: Pair):
        self.own, self.of = own, own.groups()
        self.chunks: dict[str, int] = defaultdict(count().__next__)
        self.good, self.starts, self.sizes, self.flat = np.zeros(0, bool), *[np.zeros(0, np.int64)] * 2, np.zeros(0, np.int32)
        self.ids: list = []
        self.sha: list[str] = []
        self.lot: list[np.ndarray] = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bytes = self.waiting = 0

    def add(self, doc_id, text: str) -> None:
        self.ids.append(doc_id)
        self.bytes += len(text) + 64
        whole = " " + text
        if not text:
            parts = ()
        elif not self.own.cut:
            parts = (whole,)
        else:
            parts = self.own.chunks.findall(whole) if len(text) < LONG else map(re.Match.group, self.own.chunks.finditer(whole))
        self.lot.append(np.fromiter(map(self.chunks.__getitem__, parts), np.int32))
        self.waiting += len(text) + 64
        if self.waiting >= LOT_CHARS:
            self.learn()

    def learn(self) -> None:
        """The groups of the lot's documents."""
        good, sizes, flat = self.own.learn(list(islice(self.chunks, len(self.sizes), None)), self.of)
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.good, self.sizes, self.flat = (np.concatenate(x) for x in ((self.good, good), (self.sizes, sizes), (self.flat, flat)))
        lot, self.lot, self.waiting = self.lot, [], 0
        lot = [x if self.good[x].all() else x[:0] for x in lot]
        chunk = np.concatenate(lot) if lot else np.zeros(0, np.int32)
        n = self.sizes[chunk]
        group = self.flat[_spread(self.starts[chunk], n)]
        ends = np.concatenate(([0], np.cumsum(n)))[np.cumsum([len(x) for x in lot], dtype=np.int64)]
        name = self.of.names.order.__getitem__
        for start, end in zip([0, *ends.tolist()], ends.tolist(), strict=False):
            sha = hashlib.sha256()
            for i in range(start, end, LOT_GROUPS):
                sha.update(((";" if i > start else "") + ";".join(map(name, group[i : min(end, i + LOT_GROUPS)].tolist()))).encode())
            self.sha.append(sha.hexdigest() if end > start else "")
        doc = np.repeat(np.arange(len(self.sha) - len(lot), len(self.sha)), np.diff(ends, prepend=0))
        held, times = _distinct(doc << 32 | group)
        self.found.append((held >> 32, held & 0xFFFFFFFF, times))

    def row(self) -> dict:
        """The block's documents, dictionary and pair counts."""
        self.learn()
        owner, group, times = (np.concatenate(x) for x in zip(*self.found, strict=True))
        held = np.zeros(len(self.of.names), bool)
        held[group] = True
        names = [self.of.names.order[g] for g in np.flatnonzero(held).tolist()]
        group = (np.cumsum(held) - 1)[group]
        n_a, n_b = (np.array([x.split("|")[i].count(",") + 1 for x in names], np.int64) for i in (0, 1))
        links = [self.own.links(g) for g in names]
        pairs: dict[tuple[int, int], int] = {}
        pair_ids = [sorted({pairs.setdefault(p, len(pairs)) for p in x}) for x in links]
        n_links = np.array([len(x) for x in links], np.int64)

        def sums(values: np.ndarray) -> np.ndarray:
            return np.bincount(owner, values[group] * times if len(group) else None, len(self.ids)).astype(np.int64)

        n = np.array([len(x) for x in pair_ids], np.int64)
        place = _spread((np.cumsum(n) - n)[group], n[group])
        pair = np.array([i for x in pair_ids for i in x], np.int64)[place]
        in_docs = np.bincount(_distinct(np.repeat(owner, n[group]) << 32 | pair)[0] & 0xFFFFFFFF, minlength=len(pairs))
        return {
            "block": uuid.uuid4().hex,
            "ids": self.ids,
            "n_a": sums(n_a).tolist(),
            "n_b": sums(n_b).tolist(),
            "n_groups": sums(np.ones(len(names), np.int64)).tolist(),
            "n_links": sums(n_links).tolist(),
            "sha": self.sha,
            "groups": names,
            "sizes": np.bincount(owner, minlength=len(self.ids)).astype("<i4").tobytes(),
            "members": group.astype("<i4").tobytes(),
            "times": times.astype("<i4").tobytes(),
            "pairs": [{"a": a, "b": b, "n": n} for ((a, b), n) in zip(pairs, in_docs.tolist(), strict=True)],
        }


_LONGS = ("n_a", "n_b", "n_groups", "n_links")


def _schema(kind: str) -> str:
    return f"block string, ids array<{kind}>, {', '.join(f'{c} array<long>' for c in _LONGS)}, sha array<string>, groups array<string>, sizes binary, members binary, times binary, pairs array<struct<a:int,b:int,n:long>>"


def intern(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per block of documents: their ids and figures, the distinct groups, each document's groups with frequencies, and how many documents hold each pair."""
    source = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, id_type, block = pair(a_file, b_file), None, None

        def sent(block: _Block) -> pa.RecordBatch:
            row = block.row()
            types = [pa.string(), pa.list_(id_type), *[pa.list_(pa.int64())] * 4, *[pa.list_(pa.string())] * 2, *[pa.binary()] * 3, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        gc.disable()  # hundreds of thousands of small lists, none in a cycle
        try:
            for part, texts in chunks(batches):
                id_type = part.schema.field(0).type
                for doc_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    block = block or _Block(own)
                    block.add(doc_id, text or "")
                    if block.bytes >= BLOCK_BYTES or len(block.ids) >= BLOCK_DOCS:
                        yield sent(block)
                        block = None
            if block:
                yield sent(block)
        finally:
            gc.enable()

    return map_batches(source, run, _schema(kind))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, n, best): how many documents hold each pair linked, and whether no pair of its A id is held by more."""
    counts = blocks.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("n"))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def group_links(groups: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(g, a, b, times) of each link of distinct groups g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(a_file, b_file)
        for batch in batches:
            names = batch.column(0).to_pylist()
            links = [own.links(g) for g in names]
            at = np.repeat(np.arange(len(names)), [len(x) for x in links])
            yield pa.record_batch([batch.column(0).take(pa.array(at)), *(pa.array([p[i] for x in links for p in x], pa.int32()) for i in (0, 1))], names=["g", "a", "b"])

    expanded = map_batches(groups.select("g"), run, "g string, a int, b int")
    return expanded.groupBy("g", "a", "b").agg(F.count("*").alias("times"))


def _joined(blocks: DataFrame, values: DataFrame, kind: str, id_col: str) -> DataFrame:
    """A row per document: sums over its groups of the groups' values, by frequency."""
    rows = blocks.select("block", "ids", *_LONGS, "sha", "sizes", "members", "times").join(values, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                sizes, members, times = (np.frombuffer(row[c].as_py(), "<i4").astype(np.int64) for c in ("sizes", "members", "times"))
                doc = np.repeat(np.arange(len(sizes)), sizes)
                sums = []
                known = row["at"].values.to_numpy() if row["at"].is_valid else np.zeros(0, np.int64)
                for c in ("best", "total"):
                    of = np.zeros(len(known), np.int64)
                    of[known] = row[c].values.to_numpy() if row[c].is_valid else 0
                    total = np.zeros(len(sizes), np.int64)
                    np.add.at(total, doc, of[members] * times)
                    sums.append(pa.array(total))
                yield pa.record_batch([row["ids"].values, *(row[c].values for c in _LONGS), *sums, row["sha"].values], names=[id_col, *_LONGS, "n_best", "count_sum", "groups_sha256"])

    return map_batches(rows, run, f"`{id_col}` {kind}, {', '.join(f'{c} long' for c in _LONGS)}, n_best long, count_sum long, groups_sha256 string")


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), pairs (a, b, n, best) and groups (g, best, total); what is between lies in the shared folder until the driver ends."""
    session = docs.sparkSession
    folder = f"{shared_dir(session)}/alignment-{uuid.uuid4().hex}"
    remove(session, folder, at_exit=True)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return session.read.parquet(f"{folder}/{name}")

    blocks = kept(intern(docs, a_file, b_file, id_col, text_col), "blocks")
    pairs = kept(pair_counts(blocks), "pairs")
    placed = blocks.select("block", F.posexplode("groups").alias("at", "g"))
    links = group_links(placed.select("g").distinct(), a_file, b_file)
    groups = kept(links.join(pairs, ["a", "b"]).groupBy("g").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("n") * F.col("times")).alias("total")), "groups")
    listed = placed.join(groups, "g").groupBy("block").agg(F.collect_list(F.struct("at", "best", "total")).alias("v"))
    values = listed.select("block", F.col("v.at").alias("at"), F.col("v.best").alias("best"), F.col("v.total").alias("total"))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return _joined(blocks, values, kind, id_col), pairs, groups


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))[0]
