import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from helpers import ODD_TEXTS, empty, odd
from pyspark.sql import functions as F

from rasterbrook.llm import fano, lm


class Plain:
    """The same smoothing with dictionaries and no quantisation."""

    def __init__(self, texts, order, mass):
        self.order, self.mass = order, mass
        self.counts = [Counter() for _ in range(order + 1)]
        for t in texts:
            w = self.words(t)
            for k in range(1, order + 1):
                # the end before a text is only ever a context
                self.counts[k].update(tuple(w[i - k + 1 : i + 1]) for i in range(max(1, k - 1), len(w)))
        self.n = sum(self.counts[1].values())
        self.v = len(self.counts[1])

    @staticmethod
    def words(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\v\f\r":
            low = low.replace(c, " ")
        return ["\n", *[w for w in low.split(" ") if w], "\n"]

    def p(self, gram):
        if len(gram) == 1:
            return (self.counts[1][gram] + 0.5) / (self.n + 0.5 * (self.v + 1))
        m, times = self.mass[len(gram)], self.counts[len(gram) - 1][gram[:-1]]
        lower = self.p(gram[1:])
        return (self.counts[len(gram)][gram] + m * lower) / (times + m) if times else lower

    def score(self, t):
        w = self.words(t)
        at = range(1, len(w))
        grams = [tuple(w[max(0, i - self.order + 1) : i + 1]) for i in at]
        known = sum(self.counts[1][(w[i],)] > 0 for i in at)
        return len(w) - 1, known, self.n, sum(log10(self.p((w[i],))) for i in at), sum(log10(self.p(g)) for g in grams)


def check(rows, texts, plain):
    assert len(rows) == len(texts)
    for r in rows:
        n, known, total, base, score = plain.score(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6 * n)
        assert r.score == pytest.approx(score, abs=1e-9 + 3 * lm.STEP_LOG * n)


@pytest.mark.parametrize("order,shard", [(2, 1 << 22), (3, 1 << 22), (3, 500), (4, 3000)])
def test_scores_are_the_smoothed_sums(spark, tiny_dir, order, shard):
    rows = spark.read.parquet(f"{tiny_dir}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in rows}
    train = [t for d, t in texts.items() if zlib.crc32(str(d).encode()) % 5 != 1]
    mass = {2: 20.0, 3: 4.0, 4: 2.0}
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet").repartition(3)
    trie = lm.build(docs.filter(~lm.held_out()).select(F.col("text").cast("binary").alias("text")), order, mass, shard)
    check(lm.score(docs, trie).collect(), texts, Plain(train, order, mass))


def test_query_and_held_out_gain(spark, tiny_dir):
    rows = lm.query(spark, tiny_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one():
    plain = Plain(["a b a c", "b b a"], 3, lm.MASS)
    for context in (("\n",), ("a",), ("a", "b"), ("zz",)):
        words = [w for (w,) in plain.counts[1]] + ["unseen"]
        assert sum(plain.p((*context, w)) for w in words) == pytest.approx(1)


def test_odd_rows(spark):
    docs = odd(spark)
    trie = lm.build(docs.select(F.col("text").cast("binary").alias("text")), shard_tokens=2000)
    texts = dict(enumerate(ODD_TEXTS)) | {None: "no id here"}
    plain = Plain([r.text for r in docs.collect()], 3, lm.MASS)
    rows = lm.score(docs, trie).collect()
    assert len(rows) == 2 * len(ODD_TEXTS) + 1
    seen = {r.doc_id: r for r in rows}
    check(list(seen.values()), texts, plain)


def test_empty_tables(spark):
    trie = lm.build(empty(spark).select(F.col("text").cast("binary").alias("text")))
    assert lm.score(empty(spark), trie).collect() == []
    assert {(r.n_known, r.train_tokens, r.score) for r in lm.score(odd(spark), trie).collect()} == {(0, 0, 0.0)}


def test_wide_pairs_and_merges_in_runs():
    rng = np.random.default_rng(5)
    for top in (1 << 20, 1 << 40):
        context, successor = np.sort(rng.integers(0, top, 500)), rng.integers(0, top, 500)
        got = lm._unpack_pairs(lm._pack_pairs(context, successor))
        assert (got[0] == context).all() and (got[1] == successor).all()
    parts = [tuple(np.array(x) for x in ([3, 3, 9], [1, 2, 0], [1, 1, 4], [7, 8, 9])), tuple(np.array(x) for x in ([3, 9], [2, 1], [5, 1], [8, 6]))]
    assert [x.tolist() for x in lm._merged([lm._merged(parts[:1]), parts[1]])] == [[3, 3, 9, 9], [1, 2, 0, 1], [1, 6, 4, 1], [7, 8, 9, 6]]


def test_sequences(tmp_path):
    rng = np.random.default_rng(3)
    for n, universe in ((1, 10), (800, 5), (5000, 10**6), (40_000, 10**11), (10, 2**40), (70_000, 70_001)):
        values = np.sort(rng.integers(0, universe, n))
        fano.write(str(tmp_path / "x"), *fano.encode(values, universe, "x"))
        got = fano.Sequence(*fano.read(str(tmp_path / "x")), "x")
        assert (got.get(np.arange(n)) == values).all()
        if n > 1:
            here, after = got.get_both(np.arange(n - 1))
            assert (here == values[:-1]).all() and (after == values[1:]).all()
        once = np.unique(values)
        got = fano.Sequence(*fano.encode(once, universe, "x"), "x")
        ask = np.concatenate((rng.integers(0, universe, 3000), once[:3000]))
        at = np.minimum(np.searchsorted(once, ask), len(once) - 1)
        assert (got.find(ask, np.zeros(len(ask), np.int64), np.full(len(ask), len(once))) == np.where(once[at] == ask, at, -1)).all()


@pytest.mark.parametrize("n,universe", [(1, 1), (3, 11), (60, 64), (500, 10**6)])
def test_questions_beyond_the_universe_are_not_found(n, universe):
    values = np.unique(np.random.default_rng(n).integers(0, universe, n))
    got = fano.Sequence(*fano.encode(values, universe, "x"), "x")
    ask = np.r_[universe + np.arange(300), universe << np.arange(1, 20), values]
    want = np.r_[np.full(319, -1), np.arange(len(values))]
    assert (got.find(ask, np.zeros(len(ask), np.int64), np.full(len(ask), len(values))) == want).all()


def test_texts_are_coded_once_and_files_keep_ids_in_place_of_hashes(spark, tiny_dir):
    rows = lm._rows(spark.read.parquet(f"{tiny_dir}/documents.parquet"), "doc_id", "text", ~lm.held_out())
    slices = lm._code(rows, folder := lm._folder(spark))
    trie = lm._vocabulary_of(slices, folder, lm.MASS, lm.SHARD_TOKENS)
    for r in slices.select("path").collect():
        assert "hashes" in fano.read(r.path)[0]
        first, again = lm.Slice.open(r.path, trie, keep=True), lm.Slice.open(r.path, trie)
        assert "hashes" not in fano.read(r.path)[0]
        assert all((getattr(first, k) == getattr(again, k)).all() for k in ("code", "ids", "sizes", "train"))
        train = np.repeat(first.train, first.sizes)
        assert (trie.word_counts(first.ids[first.code[1:][train]]) > 0).all()


@pytest.mark.parametrize("width", [0, 1, 7, 8, 13, 32, 63])
def test_values_side_by_side(width):
    for n in (0, 1, 9, 64, 1001):
        values = np.random.default_rng(n).integers(0, 1 << width, n, dtype=np.uint64)
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        assert (fano._side_by_side(values, width) == np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")).all()
