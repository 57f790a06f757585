"""SimHash near-duplicates through a Gray-ordered hierarchical index.

Fingerprints are 64-bit; two documents are linked if theirs differ in at most
RADIUS bits, and a group is a connected component of links.

Search: the 64 bits are cut into five fields. Two fingerprints within three
bits agree on at least two whole fields, so each distinct fingerprint is dealt
to the ten pairs of fields, and only fingerprints that share a pair's value
meet in a task. Within such a bucket a tree is built over the fingerprints in
Gray order: every node holds the mask and pattern of the bits on which all
below it agree and that no node above has settled. A query walks down with the
differences so far and leaves a whole subtree when they exceed the radius, or
when all of it is already in the query's component. A bucket above HOT rows is
dealt again by four parts of its other bits (three differences leave one part
whole), so no key gathers an unbounded group.

Only spanning links leave a bucket; components are joined by alternating star
contraction, as tables, never on the driver.

Defined results: a null or word-less text has fingerprint zero and is linked
like any other. Equal rows share their fingerprint and component. Ids are of
any type with an order. Rows with a null id get the component of their
fingerprint and never name one; if no row of a component has an id,
component_id is null. An empty table gives none. keep_one keeps one row of each
component: that of the least id (a null id counts last), then the least text by
two hashes and the length; of rows equal in both, one. Rows that share an id
but not a component are told apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterbrook.llm.common import chunks, cut, map_batches, table

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Bytes of a text whose shingles are in memory at once.
BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x09-\x0d\x20]")
#: Rows of a bucket above which it is dealt again by its other bits.
HOT = 4096
#: (lowest bit, width) of the five fields.
FIELDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PAIRS = tuple(combinations(range(5), 2))
FANOUT = 8
#: Names (some 40 bytes each) that keep_one broadcasts at most.
MOST_BROADCAST = 500_000
#: Index nodes that a search looks at together.
FRONTIER = 1 << 18


def shingles(text: bytes | None, k: int = SHINGLE) -> list[bytes]:
    """The k-word shingles of a text, with repeats; A-Z lower-cased, words split at ASCII white space."""
    words = (text or b"").lower().split()
    if len(words) < k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))


def _word_blocks(text: bytes, k: int) -> Iterator[list[bytes]]:
    """The words of a long text in lists, each beginning with the last k - 1 of the one before."""
    carried: list[bytes] = []
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + BLOCK)
        end = gap.start() if gap else len(text)
        words = carried + text[at:end].lower().split()
        at = end
        if len(words) >= k or at >= len(text):
            yield words
            carried = words[max(0, len(words) - k + 1) :]
        else:
            carried = words


def fingerprint_batch(texts: list[bytes | None], k: int = SHINGLE) -> np.ndarray:
    """uint64 SimHash of each text: a bit is set if it is set in over half of the shingles' hashes."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest

    def bits_of(hashes: list[int]) -> np.ndarray:
        return np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)

    for i, text in enumerate(texts):
        if text and len(text) > BLOCK:
            n, total = 0, np.zeros(64, np.int64)
            for words in _word_blocks(text, k):
                hashes = [digest(b" ".join(words[j : j + k]), SEED) for j in range(len(words) - k + 1)]
                if hashes:
                    n, total = n + len(hashes), total + bits_of(hashes)
            if not n:
                hashes = [digest(s, SEED) for s in shingles(text, k)]
                n, total = len(hashes), bits_of(hashes) if hashes else total
        else:
            hashes = [digest(s, SEED) for s in shingles(text, k)]
            n, total = len(hashes), bits_of(hashes) if hashes else None
        if n:
            out[i] = np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of docs; after them h1, h2 and n, two hashes and the length of its text."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    source = source.select("doc_id", F.xxhash64("text").alias("h1"), F.crc32("text").alias("h2"), F.octet_length("text").alias("n"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            yield pa.record_batch([part.column(0), pa.array(fingerprint_batch(texts).view(np.int64)), *part.columns[1:4]], names=["doc_id", "fp", "h1", "h2", "n"])

    return map_batches(source, run, f"doc_id {source.schema[0].dataType.simpleString()}, fp long, h1 long, h2 long, n int")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each pattern in the reflected Gray sequence."""
    x = x.astype(np.uint64, copy=True)
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Trees over buckets of fingerprints; buckets: the bucket's number of each fingerprint, equal numbers adjacent."""

    def __init__(self, codes: np.ndarray, buckets: np.ndarray):
        order = np.lexsort((gray_rank(codes), buckets))
        self.codes, self.buckets = codes[order], buckets[order]
        n = len(codes)
        self.parent = np.arange(n)  # union-find over the leaves
        levels = [(self.codes, np.full(n, ~np.uint64(0)), self.buckets, np.arange(n), np.arange(n) + 1)]
        while True:
            pattern, shared, bucket, _, _ = levels[-1]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            size = np.diff(np.r_[first, len(bucket)])
            if size.max() == 1 and len(levels) > 1:
                break
            within = np.arange(len(bucket)) - np.repeat(first, size)
            start = np.flatnonzero(within % FANOUT == 0)
            end = np.r_[start[1:], len(bucket)]
            ones = np.bitwise_and.reduceat(pattern & shared, start)
            zeros = np.bitwise_and.reduceat(~pattern & shared, start)
            levels.append((ones, ones | zeros, bucket[start], start, end))
        self.levels = levels
        # what a node settles itself: the bits on which it agrees and its parent doesn't
        self.own = []
        for depth, (_, shared, _, _, _) in enumerate(levels):
            above = np.zeros(len(shared), np.uint64)
            if depth + 1 < len(levels):
                _, up, _, start, end = levels[depth + 1]
                above = np.repeat(up, end - start)
            self.own.append(shared & ~above)

    def _settle(self) -> None:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return
            self.parent = up

    def _union(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the components of a and b to the least member."""
        while len(a):
            ra, rb = self.parent[a], self.parent[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))
            self._settle()

    def _whole(self) -> list[np.ndarray]:
        """For each level, the component that all leaves of a node are in, or -1."""
        out = [self.parent]
        for _, _, _, start, _ in self.levels[1:]:
            low, high = np.minimum.reduceat(out[-1], start), np.maximum.reduceat(out[-1], start)
            out.append(np.where(low == high, low, -1))
        return out

    def links(self, radius: int = RADIUS) -> np.ndarray:
        """Pairs of positions in self.codes that span, bucket by bucket, every component of links."""
        top = len(self.levels) - 1
        roots = self.levels[top][2]
        root = np.searchsorted(roots, self.buckets)
        crowd = np.bincount(root)[root] > 1
        queries = np.flatnonzero(crowd)
        step = 256
        for at in range(0, len(queries), step):
            whole = self._whole()
            self._walk([(queries[at : at + step], root[queries[at : at + step]], np.zeros(len(queries[at : at + step]), np.int64), top)], whole, radius)
            step = min(step * 2, 1 << 14)
        kid = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return np.stack([kid, self.parent[kid]], axis=1)

    def _walk(self, stack: list, whole: list[np.ndarray], radius: int) -> None:
        while stack:
            query, node, seen, depth = stack.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                stack += [(query[:half], node[:half], seen[:half], depth), (query[half:], node[half:], seen[half:], depth)]
                continue
            pattern = self.levels[depth][0]
            seen = seen + np.bitwise_count((self.codes[query] ^ pattern[node]) & self.own[depth][node])
            keep = (seen <= radius) & (whole[depth][node] != self.parent[query])
            query, node, seen = query[keep], node[keep], seen[keep]
            if depth == 0:
                self._union(query, node)
            elif len(query):
                start, end = self.levels[depth][3][node], self.levels[depth][4][node]
                n = end - start
                kids = np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                stack.append((np.repeat(query, n), kids, np.repeat(seen, n), depth - 1))


def _gathered(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[np.ndarray]:
    """The batches' rows in arrays of at least so many, but for the last."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([np.asarray(c.to_numpy(zero_copy_only=False), np.int64) for c in batch.columns], axis=1))
        if sum(map(len, held)) >= least:
            yield np.concatenate(held)
            held = []
    rows = np.concatenate(held) if held else np.zeros((0, 4), np.int64)
    if len(rows):
        yield rows


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (t, k, part, fp) to spanning links; whole buckets at a time."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch:
        fresh = np.any(rows[1:, :3] != rows[:-1, :3], axis=1) if len(rows) > 1 else np.zeros(0, bool)
        bucket = np.r_[0, np.cumsum(fresh)]
        several = np.bincount(bucket)[bucket] > 1
        a = b = np.zeros(0, np.int64)
        if several.any():
            index = GrayIndex(rows[several, 3].view(np.uint64), bucket[several])
            pairs, codes = index.links(), index.codes.view(np.int64)
            a, b = codes[pairs[:, 0]], codes[pairs[:, 1]]
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    for rows in _gathered(batches):
        ends = np.flatnonzero(np.any(rows[1:, :3] != rows[:-1, :3], axis=1)) + 1
        same = not held or (held[-1][-1, :3] == rows[0, :3]).all()
        if same and not len(ends):
            held.append(rows)
            continue
        last = ends[-1] if len(ends) else 0
        yield links(np.concatenate([*held, rows[:last]]))
        held = [rows[last:]]
    if held:
        yield links(np.concatenate(held))


def _buckets(codes: DataFrame) -> DataFrame:
    """(t, k, part, fp): each distinct fingerprint in its ten buckets; those over HOT dealt by four parts of the other bits."""

    def value(fields: tuple[int, ...]) -> F.Column:
        out = F.lit(0).cast("long")
        for f in fields:
            low, width = FIELDS[f]
            out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned("fp", low).bitwiseAND((1 << width) - 1))
        return out

    dealt = codes.select("fp", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), value(p).alias("k"), value(tuple(f for f in range(5) if f not in p)).alias("rest")) for t, p in enumerate(PAIRS)))).alias("x")).select("x.t", "x.k", "x.rest", "fp")
    hot = dealt.groupBy("t", "k").count().filter(F.col("count") > HOT).select("t", "k", F.lit(True).alias("hot"))
    parts = F.when(F.col("hot"), F.array(*(F.lit((i + 1) << 10).cast("long") + F.shiftrightunsigned("rest", 10 * i).bitwiseAND((1 << 10) - 1) for i in range(4)))).otherwise(F.array(F.lit(0).cast("long")))
    return dealt.join(hot, ["t", "k"], "left").select("t", "k", F.explode(parts).alias("part"), "fp")


def spanning_links(codes: DataFrame) -> DataFrame:
    """(a, b): links among the distinct fingerprints of codes (fp) that span every component."""
    dealt = _buckets(codes).select(F.col("t").cast("long"), "k", "part", "fp")
    return map_batches(dealt.repartition("t", "k", "part").sortWithinPartitions("t", "k", "part"), _search, "a long, b long")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each node of links (a, b) reaches, by alternating large and small stars."""
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        fresh = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        state = [x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (edges, fresh)]
        edges = fresh
        if state[0] == state[1]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _placed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """fingerprints(), and (fp, root) of each distinct one."""
    prints = cut(fingerprints(docs, id_col, text_col))
    codes = prints.select("fp").distinct()
    roots = components(spanning_links(codes))
    return prints, codes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of docs."""
    prints, placed = _placed(docs, id_col, text_col)
    placed = placed.join(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    owners = placed.select("fp", "root").join(named, "root").select("fp", "component_id")
    return prints.join(owners, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component.

    Rows are named by id and text. What goes is mostly little, so it is
    broadcast up to MOST_BROADCAST names; beyond, both sides are exchanged.
    """
    names = ["doc_id", "h1", "h2", "n"]
    prints, placed = _placed(docs, id_col, text_col)
    rows = prints.groupBy("fp", *names).agg(F.count("*").alias("copies")).join(placed, "fp")
    order = F.struct(F.col("doc_id").isNull(), *names)
    first = rows.groupBy("root").agg(F.min(order).alias("first"))
    # names that go, and names that stay but stand on several rows
    marked = rows.join(first, "root").select(*names, (order == F.col("first")).alias("stays"), "copies").filter("NOT stays OR copies > 1")
    marked = cut(marked)
    few = marked.count() <= MOST_BROADCAST
    text = F.col(text_col).cast("binary")
    whole = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h1"), F.crc32(text).alias("h2"), F.octet_length(text).alias("n"))

    def matched(side: DataFrame, how: str) -> DataFrame:
        side = side.select(*(F.col(c).alias(f"_{c}") for c in names))
        same = F.lit(True)
        for c in names:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return whole.join(F.broadcast(side) if few else side, same, how)

    once = matched(marked, "left_anti").select("row")
    again = matched(marked.filter("stays"), "left_semi").dropDuplicates(names).select("row")
    return once.union(again).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
