import os
import zlib

import numpy as np
import pytest
from helpers import ODD_TEXTS, empty, odd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterbrook.llm import token_files
from rasterbrook.llm.common import shared_dir

WHOLE = Tokenizer.from_file(token_files.TOKENIZER)
PIECES = ["a", "The", "İstanbul", "é", "é", "́", " ", "\n", "\x85", "\xa0", "\x1c", " ", "'s", "'S", "don't", "12", "²", "漢字", "🙂", "<|endoftext|>", "<|", "œuvre", "Σας", "ſ", "!?", ".", "\x00", "ß", "ĳ", "ŉ"]


def ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def new(spark, name):
    return f"{shared_dir(spark)}/{name}-{os.urandom(6).hex()}"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES) | st.text(max_size=4), max_size=30), st.sampled_from([3, 1 << 20]))
def test_pieces_encode_as_the_whole(parts, size):
    text = "".join(parts).encode("utf-8", "replace").decode()
    before, token_files.SLICE = token_files.SLICE, size
    try:
        coder = token_files.encoder(token_files.TOKENIZER)
        assert np.frombuffer(coder.encode(text), f"<u{coder.width}").tolist() == ids(text)
    finally:
        token_files.SLICE = before


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 100_000])
def test_the_hash_is_minimal_and_perfect(n):
    x = np.random.default_rng(n).integers(0, 1 << 63, 2 * n + 1, dtype=np.uint64)
    x = np.unique(x)[:n]
    own = token_files.PerfectHash.build(x)
    assert sorted(own.place(x).tolist()) == list(range(n))
    if n == 100_000:
        assert (8 * len(own.words) * 8 + 4 * len(own.ranks) * 8) / n < 8  # bits a key


def test_equal_hashes_are_refused():
    with pytest.raises(ValueError):
        token_files.PerfectHash.build(np.array([7, 7], np.uint64))


def brute(rows):
    """(id, start, ids) in order; rows of one id in any order."""
    out, at = {}, 0
    for key in sorted({r[0] for r in rows}, key=lambda k: (k is None, k)):
        texts = [ids(t) + [1] for k, t in rows if k == key]
        out[key] = at, sorted(texts)
        at += sum(map(len, texts))
    return out


def check(spark, files, docs):
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    found = {}
    for r in files.read(docs.select("doc_id").distinct()).collect():
        found.setdefault(r.doc_id, []).append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    assert found.keys() == want.keys()
    for key, (start, texts) in want.items():
        mine = sorted(found[key])
        assert sorted(x for _, x in mine) == texts
        for at, x in mine:
            assert at == start
            start += len(x)
        assert sorted(x.tolist() for x in files.get(key)) == texts


def test_whole_table(spark, tiny_dir):
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet")
    want, at = [], 0
    for r in docs.orderBy("doc_id").collect():
        own = ids(r.text) + [1]
        want.append((r.doc_id, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    assert sorted(tuple(r) for r in token_files.query(spark, tiny_dir).collect()) == want


def test_many_shards_and_parts(spark, tiny_dir):
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet")
    files = token_files.write(docs, new(spark, "files"), shard_bytes=20_000, part_keys=16)
    assert len([n for n in os.listdir(files.folder) if n.startswith("ids-")]) > 10
    assert len([n for n in os.listdir(files.folder) if n.startswith("index-")]) > 10
    assert not [n for n in os.listdir(files.folder) if n.startswith(".ids") or n.startswith(".index")]
    check(spark, files, docs)


def test_a_key_of_many_rows_over_shards(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"), F.concat(F.lit("word "), (F.col("id") % 40).cast("string")).alias("text"))
    files = token_files.write(docs, new(spark, "hot"), shard_bytes=2_000, part_keys=100)
    check(spark, files, docs)


def test_text_keys_and_unknown_keys(spark):
    docs = spark.createDataFrame([("b", "two"), ("a", "one"), ("é", "three"), (None, "four")], "doc_id string, text string")
    files = token_files.write(docs, new(spark, "text"))
    check(spark, files, docs)
    assert files.get("zz") == [] and len(files.get(None)) == 1
    asked = spark.createDataFrame([("zz",), ("b",), ("b",)], "doc_id string")
    assert [r.doc_id for r in files.read(asked).collect()] == ["b", "b"]


def test_odd_rows_and_empty(spark):
    files = token_files.write(odd(spark), new(spark, "odd"))
    check(spark, files, odd(spark))
    assert len(files.get(0)) == 2 and files.get(0)[0].tolist() == [1]
    assert files.read(odd(spark).select("doc_id").distinct()).count() == 2 * len(ODD_TEXTS) + 1
    none = token_files.write(empty(spark), new(spark, "empty"))
    assert none.read(odd(spark).select("doc_id")).count() == 0 and none.get(1) == []


def test_wide_ids(spark, monkeypatch):
    coder = token_files.encoder(token_files.TOKENIZER)
    monkeypatch.setattr(coder, "width", 4)
    monkeypatch.setattr(coder, "known", {})
    monkeypatch.setattr(coder, "older", {})
    assert np.frombuffer(coder.encode("One two, three"), "<u4").tolist() == ids("One two, three")
