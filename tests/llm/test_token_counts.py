import random

import public_tokenizers
import regex
from helpers import ODD_TEXTS, empty, odd
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterbrook.llm import token_counts
from rasterbrook.llm.pretokens import RANKS

PIECES = ["a", "the", " ", "  ", "\n", "'", "'s", "'l", "l", "'re", "1", "23", "é", "漢", "!", "?!", "\t ", " don't ", "x" * 40]


def full(text):
    words = regex.findall(public_tokenizers.PATTERN, text)
    return words, sum(token_counts.counter(RANKS)(words))


def plain(text, edits):
    limit = len(text)
    for start, end, new in sorted(edits, key=lambda e: e[:2], reverse=True):
        start = min(max(start, 0), limit if limit < len(text) else len(text))
        end = max(start, min(end, limit))
        text, limit = text[:start] + new + text[end:], start
    return text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=120), st.lists(st.tuples(st.integers(0, 200), st.integers(0, 30), st.lists(st.sampled_from(PIECES), max_size=4)), max_size=4), st.sampled_from([1, 3, 32]))
def test_edits_equal_a_full_count(pieces, changes, leaf):
    before = token_counts.LEAF
    token_counts.LEAF = leaf
    try:
        text = "".join(pieces)
        tree = token_counts.CountTree(text, token_counts.counter(RANKS))
        for start, cut, new in changes:
            start = min(start, len(text))
            end, new = min(start + cut, len(text)), "".join(new)
            tree.replace(start, end, new)
            text = text[:start] + new + text[end:]
            words, n = full(text)
            assert tree.text() == text
            assert [w for x in tree.leaves for w in x] == words
            assert (tree.n_tokens, tree.pretokens, tree.n_chars) == (n, len(words), len(text))
    finally:
        token_counts.LEAF = before


def test_only_the_touched_region_is_encoded():
    tree = token_counts.CountTree("some plain words here " * 5_000, token_counts.counter(RANKS))
    tree.replace(50_000, 50_005, "other")
    assert 0 < tree.encoded < 60


def test_whole_table(spark, tiny_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{tiny_dir}/documents.parquet").withColumn("e", token_counts.edit_log()).collect()}
    rows = token_counts.count_edited(spark.read.parquet(f"{tiny_dir}/documents.parquet"), token_counts.edit_log()).collect()
    assert len(rows) == len(docs) == token_counts.query(spark, tiny_dir).count()
    for r in rows:
        text = docs[r.doc_id].text
        edited = plain(text, [(e.start, e.end, e.text) for e in docs[r.doc_id].e])
        assert (r.edited, r.n_tokens, r.n_tokens_edited, r.n_edits) == (edited, full(text)[1], full(edited)[1], 3)


def test_odd_rows_edits_and_empty(spark):
    rows = token_counts.count_edited(odd(spark), token_counts.edit_log()).collect()
    assert len(rows) == 2 * len(ODD_TEXTS) + 1
    for r in rows:
        assert r.n_tokens_edited == full(r.edited)[1]
    assert token_counts.count_edited(empty(spark), token_counts.edit_log()).collect() == []
    tree = token_counts.CountTree("hello world", token_counts.counter(RANKS))
    assert tree.apply([None, {"start": 900, "end": 2, "text": "!"}, {"start": -5, "end": 0, "text": None}]) == 2
    assert tree.text() == "hello world!"
    assert tree.apply(None) == 0
    random.seed(1)


def test_invalid_utf8_is_replaced(spark):
    docs = spark.sql("SELECT 1 AS doc_id, cast(unhex('61FF62') AS string) AS text")
    row = token_counts.count_edited(docs, token_counts.edit_log()).first()
    assert row.n_tokens == full("a\ufffdb")[1]


def test_leaves_keep_their_counts():
    asked = []

    def count(words):
        asked.append(len(words))
        return token_counts.counter(RANKS)(words)

    tree = token_counts.CountTree("many other words here " * 400, count)
    for at in range(4_000, 0, -100):
        tree.replace(at, at + 2, " of new ones, and more, and yet more")
    assert sum(asked[1:]) == tree.encoded  # nothing but what edits touched
    assert tree.n_tokens == full(tree.text())[1]
