"""Language-model scores from an Elias-Fano n-gram trie.

Counting. One pass over the texts writes each slice once as word codes and the
words' hashes, in the shared folder. Later passes read those files: the first
counts words, the next puts the words' ids in place of the hashes, and n-grams
are counted order by order. A slice is reduced to its distinct
n-grams before anything is exchanged, and goes out as one packed block per
shard that it touches. A shard merges its blocks as they come, a bounded run at
a time, so a frequent n-gram that every slice brings stays one row.
The texts form one stream in which an end token parts them; it is also the
context of a text's first word.

Trie. Words have ids in order of their hash. A level holds the n-grams of one
order sorted by context node, then by successor; its pointers (where each
context's successors begin), its successors (made monotone by adding each
list's start value) and its running counts (of which backoff weights follow)
are Elias-Fano sequences, and its probabilities are quantised to STEP_LOG. Above
order two a successor is kept as its rank among the successors of the shorter
context, so a question walks down by context-relative search. Levels are cut
into shards of about shard_tokens occurrences, as many as that makes, by a
monotone function of context and successor, so that a frequent context is
spread over shards; shard files lie in the shared folder (which must be
mounted, as spark.checkpoint.dir of a cluster of this kind is) and are
memory-mapped, so a task pages in what its questions touch. A slice asks each
distinct n-gram once, in the order in which the level is sorted.

Smoothing: p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m), h' the shorter
context, down to unigrams (c(w) + 1/2) / (N + (V + 1) / 2); a distribution
over the V known tokens and one unknown. m is MASS[order].

Defined results: null texts count as empty: one end token. Rows whose id is
null are not held out, and train. Repeated rows count as often as they stand.
With no training rows N = V = 0 and every token has probability 1. An empty
table gives no rows. Words are told apart by a 64-bit hash; ids and n-grams
are counted in 64 bits. A text is held whole, in about fifteen times its bytes.
"""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterbrook.llm import fano
from rasterbrook.llm.common import chunks, cut, fold, map_batches, shared_dir, table

ORDER = 3
#: Weight of the shorter context, by order.
MASS = {2: 1000.0, 3: 10.0, 4: 5.0, 5: 5.0}
#: Occurrences of a shard; a task holds about 60 bytes for each n-gram of one.
SHARD_TOKENS = 2 << 20
#: Bytes of text that are counted or scored together.
SLICE = 6 << 20
#: N-grams that are looked up together.
QUESTIONS = 1 << 17
#: N-grams that a shard gathers before it merges them.
MERGE = 1 << 20
STEP_LOG = 1 / 2048
FOLDS = 5
#: The end token; no word has a line break.
END = xxhash.xxh64_intdigest(b"\n")


def mounted(path: str) -> str:
    """A shared folder as a local path."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"levels are memory-mapped, so the shared folder must be mounted: {path}")
    return unquote(url.path)


def _pack(numbers: np.ndarray) -> bytes:
    """Ascending whole numbers as differences, byte plane by byte plane."""
    gaps = np.diff(numbers.astype("<u8"), prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _pack_pairs(context: np.ndarray, successor: np.ndarray) -> bytes:
    """Ascending pairs of whole numbers: as one number each where both fit, else side by side."""
    if not len(context) or (int(context[-1]) < 1 << 32 and int(successor.max()) < 1 << 32):
        return b"\0" + _pack(context.astype(np.uint64) << np.uint64(32) | successor.astype(np.uint64))
    first = _pack(context)
    return b"\1" + len(first).to_bytes(8, "little") + first + zstandard.compress(np.ascontiguousarray(successor.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if data[0] == 0:
        keys = _unpack(data[1:])
        return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    n = int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(zstandard.decompress(data[9 + n :]), np.uint8).reshape(8, -1)
    return _unpack(data[9 : 9 + n]).astype(np.int64), np.ascontiguousarray(planes.T).view("<i8").ravel()


def _pack_small(numbers: np.ndarray) -> bytes:
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack_small(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def quantised(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-logs / STEP_LOG), 0, 65535).astype(np.uint16)


def _logs(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) * -STEP_LOG


@lru_cache(maxsize=4096)
def _vocabulary(path: str) -> dict:
    return fano.read(path)[0]


@lru_cache(maxsize=4096)
def _level(path: str) -> tuple:
    arrays, facts = fano.read(path)
    sums = fano.Sequence(arrays, facts, "sums") if "sums.n" in facts else None
    return facts["first"], facts["contexts"], fano.Sequence(arrays, facts, "pointers"), fano.Sequence(arrays, facts, "successors"), sums, arrays["logp"]


class Trie:
    """Where the levels lie and how they are cut; the files are opened where they are used."""

    def __init__(self, folder: str, bits: int, sizes: dict[int, int], sums: dict[int, int], mass: dict[int, float]):
        shards = 1 << bits
        self.folder, self.bits, self.mass = folder, bits, mass
        self.offsets = [np.cumsum([0, *(sizes.get(i, 0) for i in range(shards))])]
        self.before = [np.cumsum([0, *(sums.get(i, 0) for i in range(shards))])]  # occurrences before each shard
        self.tokens, self.types = int(self.before[0][-1]), int(self.offsets[0][-1])
        self.shards = 1

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Id (or -1) of each word hash."""
        ids = np.full(len(hashes), -1)
        shard = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        for s, own in _grouped(shard):
            if self.offsets[0][s + 1] == self.offsets[0][s]:
                continue
            known = _vocabulary(f"{self.folder}/words/{s}")["hash"]
            at = np.minimum(np.searchsorted(known, hashes[own]), len(known) - 1)
            hit = known[at] == hashes[own]
            ids[own[hit]] = at[hit] + self.offsets[0][s]
        return ids

    def word_counts(self, ids: np.ndarray) -> np.ndarray:
        counts = np.zeros(len(ids), np.int64)
        for s, own in _grouped(np.searchsorted(self.offsets[0], ids, "right") - 1):
            a, at = _vocabulary(f"{self.folder}/words/{s}"), ids[own] - self.offsets[0][s]
            counts[own] = a["sum"][at + 1] - a["sum"][at]
        return counts

    def counts(self, k: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of nodes of order k, and occurrences of the nodes before each."""
        counts, before = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        for s, own in _grouped(np.searchsorted(self.offsets[k - 1], nodes, "right") - 1):
            at = nodes[own] - self.offsets[k - 1][s]
            if k == 1:
                sums = _vocabulary(f"{self.folder}/words/{s}")["sum"]
                low, high = sums[at], sums[at + 1]
            else:
                sums = _level(f"{self.folder}/{k}/{s}")[4]
                low, high = sums.get_both(at)
            counts[own] = high - low
            before[own] = low + self.before[k - 1][s]
        return counts, before

    def shard(self, count: np.ndarray, before: np.ndarray, word_before: np.ndarray) -> np.ndarray:
        """The shard of an n-gram, by its context's occurrences and its last word: never less for a later context or word."""
        place = before + (count * (word_before / max(1, self.tokens))).astype(np.int64)
        return np.minimum(place * self.shards // max(1, self.tokens), self.shards - 1)

    def find(self, k: int, context: np.ndarray, count: np.ndarray, before: np.ndarray, word_before: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Node of order k (or -1), its log10 probability, and the node at which its context's successors begin."""
        n = len(context)
        node, logp, start = np.full(n, -1), np.zeros(n), np.full(n, -1)
        shard = self.shard(count, before, word_before)
        home = self.shard(count, before, np.zeros(n, np.int64))
        for s, own in _grouped(shard):
            if self.offsets[k - 1][s + 1] == self.offsets[k - 1][s]:
                continue
            first, contexts, pointers, successors, _, quantities = _level(f"{self.folder}/{k}/{s}")
            local = context[own] - first
            inside = (local >= 0) & (local < contexts)
            own, local = own[inside], local[inside]
            # once for each run of questions with the same context
            fresh = np.flatnonzero(np.r_[True, local[1:] != local[:-1]]) if len(own) else own
            runs = np.diff(np.r_[fresh, len(own)])
            lo, hi = pointers.get_both(local[fresh])
            base = np.zeros(len(fresh), np.int64)
            later = (lo > 0) & (lo < hi)
            base[later] = successors.get(lo[later] - 1)
            lo, hi, base = (np.repeat(x, runs) for x in (lo, hi, base))
            some = lo < hi
            own, lo, hi, base = own[some], lo[some], hi[some], base[some]
            at = successors.find(base + 1 + successor[own], lo, hi)
            start[own] = lo + self.offsets[k - 1][s]
            hit = at >= 0
            own, at = own[hit], at[hit]
            node[own] = at + self.offsets[k - 1][s]
            logp[own] = _logs(quantities[at])
        # a context that is spread over shards begins in an earlier one
        spread = np.flatnonzero((home != shard) & (node >= 0))
        if len(spread):
            fresh = np.flatnonzero(np.r_[True, np.diff(context[spread]) != 0])
            begins = [self._begin(k, int(context[i]), int(home[i]), int(shard[i])) for i in spread[fresh]]
            begin = np.repeat([start[i] if b < 0 else b for i, b in zip(spread[fresh], begins, strict=True)], np.diff(np.r_[fresh, len(spread)]))
            start[spread] = np.minimum(start[spread], begin)
        return node, logp, start

    def _begin(self, k: int, context: int, home: int, shard: int) -> int:
        """The node at which the successors of context begin in the shards from home to before shard, or -1."""
        for x in range(home, shard):
            if self.offsets[k - 1][x + 1] > self.offsets[k - 1][x]:
                first, contexts, pointers, *_ = _level(f"{self.folder}/{k}/{x}")
                if 0 <= context - first < contexts:
                    lo, hi = (int(v[0]) for v in pointers.get_both(np.array([context - first])))
                    if lo < hi:
                        return lo + int(self.offsets[k - 1][x])
        return -1


def _grouped(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key and the places that have it."""
    steps = np.diff(keys)
    if (steps >= 0).all():
        order, cuts = np.arange(len(keys)), np.flatnonzero(steps) + 1
    else:
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for own in np.split(order, cuts):
        if len(own):
            yield int(keys[own[0]]), own


def _distinct(context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs: the order in which they ascend, and where in it each distinct pair begins, and how often it occurs."""
    context, successor = context.astype(np.int64), successor.astype(np.int64)
    if not len(context):
        return context, context, context
    low, least = successor.min(), context.min()
    if context.max() - least < 1 << 31 and successor.max() - low < 1 << 32:  # as one number
        key = (context - least) << 32 | (successor - low)
        order = np.argsort(key)
        key = key[order]
        fresh = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    else:
        order = np.lexsort((successor, context))
        c, s = context[order], successor[order]
        fresh = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (s[1:] != s[:-1])])
    return order, fresh, np.diff(np.r_[fresh, len(order)])


def _words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of an end, then each text's words and its end; the distinct tokens' hashes by code; tokens of each text."""
    flat, sizes = [b"\n"], []
    for t in texts:
        words = (t or b"").lower().split()
        flat += words
        flat.append(b"\n")
        sizes.append(len(words) + 1)
    known: dict[bytes, int] = defaultdict(count().__next__)
    code = np.fromiter(map(known.__getitem__, flat), np.int32, len(flat))
    return code, np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known)), np.array(sizes, np.int64)


class Slice:
    """Some texts as word codes: ascending with the words' ids, unknown words last, under one code."""

    def __init__(self, code: np.ndarray, ids: np.ndarray, sizes: np.ndarray, train: np.ndarray):
        self.code, self.ids, self.sizes, self.train = code, ids, sizes, train

    @classmethod
    def open(cls, path: str, trie: Trie, keep: bool = False) -> Slice:
        """A slice's file; where it has hashes they are looked up, and with keep the ids take their place in the file."""
        a, _ = fano.read(path)
        code = _unpack_small(a["code"]).astype(np.int32)
        if "ids" in a:
            return cls(code, _unpack(a["ids"]).astype(np.int64), a["sizes"], a["train"] > 0)
        ids = trie.words(_unpack(a["hashes"]))
        known = ids >= 0
        place = np.where(known, np.cumsum(known) - 1, known.sum()).astype(np.int32)
        own = cls(place[code], ids[known], a["sizes"], a["train"] > 0)
        if keep:
            _write_slice(path, own.code, "ids", own.ids, own.sizes, own.train)
        return own

    def walk(self, trie: Trie, order: int, at: np.ndarray, more: bool) -> tuple[np.ndarray, np.ndarray, dict]:
        """Counts of the tokens at the places `at`, their log10 probabilities by n-grams up to order, and the last order's grams; those with counts, if there is more to come.

        Grams: of each distinct n-gram, in order: node, start, logp, count, before, last (its last word's code); and of each token its n-gram, or -1.
        """
        counts, before = trie.counts(1, self.ids)
        counts, before, ids = np.append(counts, 0), np.append(before, trie.tokens), np.append(self.ids, -1)
        grams = {"node": ids, "start": np.zeros(len(ids), np.int64), "logp": trie.unigram(counts), "count": counts, "before": before, "last": np.arange(len(ids), dtype=np.int32), "of": self.code}
        tokens = grams["logp"][self.code[at]]
        here = np.arange(len(at), dtype=np.int32 if len(self.code) < 1 << 31 else np.int64)
        for k in range(2, order + 1):
            if k > 2:  # no n-gram runs over an end
                here = here[self.code[at[here] - 1] != self.code[0]]
                here = here[grams["of"][at[here] - 1] >= 0]
            left, right = grams["of"][at[here] - 1], grams["of"][at[here]]
            sort, first, _ = _distinct(left, right)
            left, right = left[sort[first]], right[sort[first]]
            of = np.full(len(self.code), -1, np.int32)
            fresh = np.zeros(len(sort), np.int32)
            fresh[first[1:]] = 1
            of[at[here[sort]]] = np.cumsum(fresh)
            n = len(left)
            # without a context of this order, the next lower order's probability stands
            logp = grams["logp"][right]
            times, context, node = grams["count"][left], grams["node"][left], grams["node"][right]
            logp += np.where(context >= 0, np.log10(trie.mass[k] / (times + trie.mass[k])), 0.0)
            new = {"node": np.full(n, -1), "start": np.full(n, -1), "logp": logp, "count": np.zeros(n, np.int32 if trie.tokens < 1 << 31 else np.int64), "before": np.zeros(n, np.int64), "last": grams["last"][right], "of": of}
            asked = np.flatnonzero((context >= 0) & (node >= 0))
            del sort, first, fresh
            for a in range(0, len(asked), QUESTIONS):
                ask = asked[a : a + QUESTIONS]
                successor = node[ask] if k == 2 else node[ask] - grams["start"][right[ask]]
                found, found_logp, start = trie.find(k, context[ask], times[ask], grams["before"][left[ask]], before[new["last"][ask]], successor)
                hit = found >= 0
                ask, found = ask[hit], found[hit]
                logp[ask], new["node"][ask], new["start"][ask] = found_logp[hit], found, start[hit]
                if k < order or more:
                    new["count"][ask], new["before"][ask] = trie.counts(k, found)
            tokens[here] = logp[of[at[here]]]
            grams = new
        return counts[self.code[at]], tokens, grams


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], list, np.ndarray]]:
    """Parts of the batches (row, train, text) with about SLICE bytes of text, over the batches' bounds: the parts, their texts, which of them train."""
    parts: list = []
    texts: list = []
    size = 0
    for part, some in chunks(batches, limit=SLICE // 4):
        parts.append(part)
        texts += some
        size += sum(len(t) for t in some if t is not None)
        if size >= SLICE:
            yield parts, texts, _train(parts)
            parts, texts, size = [], [], 0
    if parts:
        yield parts, texts, _train(parts)


def _train(parts: list[pa.RecordBatch]) -> np.ndarray:
    return np.concatenate([p.column("train").to_numpy(zero_copy_only=False) for p in parts]).astype(bool)


def _write_slice(path: str, code: np.ndarray, name: str, words: np.ndarray, sizes: np.ndarray, train: np.ndarray) -> None:
    packed = {"code": _pack_small(code), name: _pack(words)}
    fano.write(path, {k: np.frombuffer(v, np.uint8) for k, v in packed.items()} | {"sizes": sizes, "train": train.astype(np.uint8)}, {})


def _code(rows: DataFrame, folder: str) -> DataFrame:
    """(path, ids) of each slice of rows (id, train, text): a file of word codes, ascending with the words' hashes, in the shared folder, and the ids of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, texts, train in _slices(batches):
            path = f"{folder}/slices/{uuid.uuid4().hex}"
            code, hashes, sizes = _words(texts)
            order = np.argsort(hashes)
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            _write_slice(path, place[code], "hashes", hashes[order], sizes, train)
            ids = pa.concat_arrays([p.column(0) for p in parts])
            yield pa.record_batch([pa.array([path]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], names=["path", "ids"])

    return cut(map_batches(rows, run, f"path string, ids array<{rows.schema[0].dataType.simpleString()}>"))


def _count_words(slices: DataFrame) -> DataFrame:
    """(hash, n) over the training texts of slices as _code leaves them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                a, _ = fano.read(path)
                hashes = _unpack(a["hashes"])
                n = np.bincount(_unpack_small(a["code"])[1:][np.repeat(a["train"] > 0, a["sizes"])], minlength=len(hashes))
                yield pa.record_batch([pa.array(hashes[n > 0].view(np.int64)), pa.array(n[n > 0])], names=["hash", "n"])

    return map_batches(slices.select("path"), run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _write_words(counted: DataFrame, folder: str, bits: int) -> DataFrame:
    """Files of sorted hashes and running counts; (shard, size, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            shard, hashes, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for s, own in _grouped(shard):
                held.setdefault(s, []).append((hashes[own].view(np.uint64), n[own]))
            for s in sorted(held)[:-1]:  # sorted by shard: all but the last are whole
                yield done(s, held.pop(s))
        for s in sorted(held):
            yield done(s, held.pop(s))

    def done(s: int, parts: list) -> pa.RecordBatch:
        hashes, n = np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts])
        order = np.argsort(hashes)
        total = np.concatenate(([0], np.cumsum(n[order])))
        fano.write(f"{folder}/words/{s}", {"hash": hashes[order], "sum": total}, {})
        return pa.record_batch([pa.array([s], pa.int64()), pa.array([len(hashes)], pa.int64()), pa.array([int(total[-1])], pa.int64())], names=["shard", "size", "total"])

    shard = F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long")
    dealt = counted.select(shard.alias("shard"), "hash", "n").repartition(1 << bits, "shard").sortWithinPartitions("shard")
    return map_batches(dealt, run, "shard long, size long, total long")


def _blocks(slices: DataFrame, trie: Trie, k: int) -> DataFrame:
    """(shard, first, keys, counts, lower, size): the distinct n-grams of each slice's training texts, packed by shard."""
    shipped = slices.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_trie = shipped.value
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield block(own_trie, Slice.open(path, own_trie, keep=k == 2))

    def block(own_trie: Trie, own: Slice) -> pa.RecordBatch:
        at = 1 + np.flatnonzero(np.repeat(own.train, own.sizes))
        _, _, grams = own.walk(own_trie, k - 1, at, True)
        if k > 2:
            at = at[own.code[at - 1] != own.code[0]]
            at = at[grams["of"][at - 1] >= 0]
        left, right = grams["of"][at - 1], grams["of"][at]
        sort, first, n = _distinct(left, right)
        left, right = left[sort[first]], right[sort[first]]
        context, node = grams["node"][left], grams["node"][right]
        successor = node if k == 2 else node - grams["start"][right]
        word_before = own_trie.counts(1, own.ids)[1][grams["last"][right]] if len(left) else left
        shard = own_trie.shard(grams["count"][left], grams["before"][left], word_before)
        lower = quantised(grams["logp"][right])
        out: list[list] = [[], [], [], [], [], []]
        for s, mine in _grouped(shard):
            base = int(context[mine[0]])
            for column, value in zip(out, (s, base, _pack_pairs(context[mine] - base, successor[mine]), _pack_small(n[mine]), _pack_small(lower[mine]), len(mine)), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        return pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["shard", "first", "keys", "counts", "lower", "size"])

    return map_batches(slices.select("path"), run, "shard long, first long, keys binary, counts binary, lower binary, size long")


def _merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, successor) in order, with their counts' sums and the lower order's probability."""
    context, successor, n, lower = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, fresh, _ = _distinct(context, successor)
    keep = order[fresh]
    return context[keep], successor[keep], np.add.reduceat(n[order], fresh), lower[keep]


def _write_level(blocks: DataFrame, trie: Trie, k: int, top: bool) -> DataFrame:
    """Files of a level from its blocks; (shard, size, total)."""
    shipped = blocks.sparkSession.sparkContext.broadcast(trie)

    def done(s: int, parts: list) -> pa.RecordBatch:
        own_trie = shipped.value
        context, successor, n, lower = _merged(parts)
        lists = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        mass = own_trie.mass[k]
        times = own_trie.counts(k - 1, context[lists])[0]
        sizes = np.diff(np.r_[lists, len(context)])
        below = 10 ** (own_trie.unigram(own_trie.word_counts(successor)) if k == 2 else _logs(lower))
        logp = np.log10((n + mass * below) / (np.repeat(times, sizes) + mass))
        # each list starts behind the last value of the one before
        last = successor[np.r_[lists[1:], len(successor)] - 1]
        base = np.concatenate(([0], np.cumsum(last + 1)[:-1]))
        first = int(context[0])
        span = int(context[-1]) - first + 1
        pointers = np.zeros(span + 1, np.int64)
        pointers[context[lists] - first + 1] = sizes
        pointers = np.cumsum(pointers)
        arrays, facts = fano.encode(pointers, len(context) + 1, "pointers")
        more, also = fano.encode(np.repeat(base, sizes) + 1 + successor, int(base[-1] + last[-1] + 2), "successors")
        arrays |= more | {"logp": quantised(logp)}
        if not top:
            more, these = fano.encode(np.concatenate(([0], np.cumsum(n))), int(n.sum()) + 1, "sums")
            arrays |= more
            also = also | these
        fano.write(f"{own_trie.folder}/{k}/{s}", arrays, facts | also | {"first": first, "contexts": span})
        return pa.record_batch([pa.array([s], pa.int64()), pa.array([len(context)], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=["shard", "size", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        at = None
        for batch in batches:
            for s, f, keys, counts, lower in zip(*batch.columns[:5], strict=True):
                s = s.as_py()
                if s != at and held:
                    yield done(at, held)
                    held, size = [], 0
                at = s
                context, successor = _unpack_pairs(keys.as_py())
                held.append((context + f.as_py(), successor, _unpack_small(counts.as_py()), _unpack_small(lower.as_py()).astype(np.uint16)))
                size += len(context)
                if size > max(MERGE, 2 * len(held[0][0])):
                    held = [_merged(held)]
                    size = len(held[0][0])
        if held:
            yield done(at, held)

    return map_batches(blocks.filter("size > 0").repartition(trie.shards, "shard").sortWithinPartitions("shard"), run, "shard long, size long, total long")


def _rows(docs: DataFrame, id_col: str, text_col: str, train: F.Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), train.alias("train"), F.col(text_col).cast("binary").alias("text"))


def _folder(spark: SparkSession) -> str:
    folder = f"{mounted(shared_dir(spark))}/lm-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _vocabulary_of(slices: DataFrame, folder: str, mass: dict[int, float], shard_tokens: int) -> Trie:
    counted = _count_words(slices)
    bits = 4
    while True:
        state = {r.shard: r for r in _write_words(counted, folder, bits).collect()}
        trie = Trie(folder, bits, {s: r["size"] for s, r in state.items()}, {s: r.total for s, r in state.items()}, mass)
        wanted = max(1, trie.types // shard_tokens).bit_length()
        if wanted <= bits + 2:
            trie.shards = max(4, -(-trie.tokens // shard_tokens))
            return trie
        folder, bits = f"{folder}/finer", wanted  # far more words than thought: cut finer


def _levels(slices: DataFrame, trie: Trie, order: int) -> Trie:
    for k in range(2, order + 1) if trie.tokens else ():
        state = {r.shard: r for r in _write_level(_blocks(slices, trie, k), trie, k, k == order).collect()}
        trie.offsets.append(np.cumsum([0, *(state[i]["size"] if i in state else 0 for i in range(trie.shards))]))
        trie.before.append(np.cumsum([0, *(state[i].total if i in state else 0 for i in range(trie.shards))]))
    return trie


def build(rows: DataFrame, order: int = ORDER, mass: dict[int, float] | None = None, shard_tokens: int = SHARD_TOKENS) -> Trie:
    """A trie of the texts in rows (text binary), its files in the shared folder."""
    rows = _rows(rows.select("text", F.lit(0).alias("id")), "id", "text", F.lit(True))
    slices = _code(rows, folder := _folder(rows.sparkSession))
    return _levels(slices, _vocabulary_of(slices, folder, MASS if mass is None else mass, shard_tokens), order)


def _scored(slices: DataFrame, trie: Trie, id_col: str) -> DataFrame:
    shipped = slices.sparkSession.sparkContext.broadcast(trie)
    kind = slices.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_trie = shipped.value
        for batch in batches:
            for path, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = Slice.open(path, own_trie)
                n = len(own.sizes)
                first = np.concatenate(([0], np.cumsum(own.sizes)[:-1]))
                if own_trie.tokens:
                    counts, logp, _ = own.walk(own_trie, len(own_trie.offsets), np.arange(1, len(own.code)), False)
                    columns = [np.add.reduceat(counts > 0, first, dtype=np.int64), np.full(n, own_trie.tokens), np.add.reduceat(own_trie.unigram(counts), first), np.add.reduceat(logp, first)]
                else:
                    columns = [np.zeros(n, np.int64)] * 2 + [np.zeros(n)] * 2
                yield pa.record_batch([ids.values, pa.array(np.asarray(own.sizes)), *map(pa.array, columns)], names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return map_batches(slices, run, f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, trie: Trie, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    return _scored(_code(_rows(docs, id_col, text_col, F.lit(False)), trie.folder), trie, id_col)


def train_and_score(docs: DataFrame, train: F.Column, order: int = ORDER, mass: dict[int, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score() of all rows by a trie of those for which train holds; the texts are coded once for both."""
    rows = _rows(docs, id_col, text_col, train)
    slices = _code(rows, folder := _folder(rows.sparkSession))
    trie = _vocabulary_of(slices, folder, MASS if mass is None else mass, SHARD_TOKENS)
    return _scored(slices, _levels(slices, trie, order), id_col)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return fold(FOLDS, doc_id).eqNullSafe(1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = train_and_score(table(spark, sf_dir, "documents"), ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
