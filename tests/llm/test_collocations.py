import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from helpers import check_sql, empty, odd

from rasterbrook.llm import collocations


def plain(docs, least, covered=80, top=2000):
    """The contract by plain counting; docs: (text bytes or None, lang)."""
    counts = {}
    for text, lang in docs:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or b"").lower()):
            words = re.findall(rb"[^\x20\x09]+", piece)
            for k in range(1, 5):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, own in counts.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        rows = []
        for p, a in own.items():
            if len(p) < 2 or a < least:
                continue
            score, _, l, r = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, b" ".join(p), l, r, p))
        spans = Counter()
        for *_, p in rows:
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    spans[p[i : i + m]] = max(spans[p[i : i + m]], own[p])
        rows = sorted(x for x in rows if 100 * spans[x[5]] < covered * -x[1])
        out |= {(lang, i, text.decode(errors="replace"), -a, l, r, n, -s) for i, (s, a, text, l, r, _) in enumerate(rows[:top], 1)}
    return out


def mined(df, **options):
    rows = collocations.mine(df, **options).collect()
    assert len(rows) == len({(r.lang, r["rank"]) for r in rows})
    return {tuple(r) for r in rows}


def of(df):
    return [(None if r.t is None else bytes(r.t), r.lang) for r in df.selectExpr("CAST(text AS BINARY) AS t", "lang").collect()]


def test_whole_table_by_sql(spark, tiny_dir):
    check_sql(spark, collocations.query, collocations.ORACLE_SQL, tiny_dir, ["documents"])


@pytest.mark.parametrize("words, least", [(collocations.BLOCK_WORDS, 5), (7, 3), (1, 30)])
def test_blocks_of_any_size_equal_plain_counts(spark, tiny_dir, monkeypatch, words, least):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", words)
    docs = spark.createDataFrame(spark.read.parquet(f"{tiny_dir}/documents.parquet").orderBy("doc_id").limit(6 if words < 100 else 60).collect())
    assert mined(docs, least=least) == plain(of(docs), least)


def test_crowded_buckets_lose_nothing(spark, tiny_dir, monkeypatch):
    """In a bitmap where all places are taken nothing is pruned, and the rows are the same."""
    docs = spark.createDataFrame(spark.read.parquet(f"{tiny_dir}/documents.parquet").limit(60).collect())
    monkeypatch.setattr(collocations, "_places", lambda hashes, k, bits: (hashes[: len(hashes) - k + 1] % 8).astype("uint64"))
    assert mined(docs, least=4) == plain(of(docs), 4)


def test_slices_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 5)
    text = "one two three. one two three one two. " * 20
    found = [w for part in collocations.word_lists(text.encode()) for w in part]
    assert found == text.replace(".", " . ").encode().split()


def test_odd_rows(spark):
    found = mined(odd(spark), least=2)
    assert found == plain(of(odd(spark)), 2)
    assert any(x[0] == "und" for x in found) and any(x[2] == "word word word word" for x in found)


def test_ties_invalid_bytes_and_clashing_columns(spark):
    rows = [(b"Aa bb, aa BB", "en"), (b"\xff\xfe x\xff \xff\xfe x\xff", None), (b"tie one tie two", "und"), (b"a\x00b c a\x00b c", "und")] * 3
    docs = spark.createDataFrame([(bytearray(t), lang, "p", 1, 2, 3) for t, lang in rows], "text binary, lang string, phrase string, n int, ids int, words int")
    assert mined(docs, least=2) == plain(rows, 2)


def test_counts_past_64_bits(spark):
    """2,000,000 times a count need not fit a long."""
    big = 5_000_000_000_000_000
    phrases = spark.createDataFrame([("en", 1, bytearray(b"a"), big), ("en", 1, bytearray(b"b"), big + 1), ("en", 2, bytearray(b"a b"), big - 1)], "lang string, n_words int, phrase binary, f long")
    row = collocations.scored(phrases).first()
    assert row.score == 2_000_000 * (big - 1) // (2 * big + 1)


def test_top_and_empty(spark):
    docs = spark.createDataFrame([(" ".join(f"p{i} q{i}." for i in range(40)), "en")] * 30, "text string, lang string")
    assert mined(docs, top=7) == plain(of(docs), 30, top=7)
    assert mined(empty(spark)) == set()


@pytest.mark.parametrize("text", [1, 1 << 12])
def test_more_parts_for_more_text(spark, tiny_dir, monkeypatch, text):
    """As many parts as a bitmap has places, and some: the rows are the same."""
    monkeypatch.setattr(collocations, "PART_TEXT", text)
    monkeypatch.setattr(collocations, "GIVEN", 3)
    docs = spark.createDataFrame(spark.read.parquet(f"{tiny_dir}/documents.parquet").orderBy("doc_id").limit(20).collect())
    assert mined(docs, least=3) == plain(of(docs), 3)


def test_packed_phrases():
    phrases, n = [b"a", b"b c", b"\xff", b"\x00 d"], np.array([1, 1 << 40, 3, 4])
    rows = collocations._packed(phrases, n, np.array([5, 0, 4, 1], np.uint64), 1)
    assert [(r["region"], zstandard.decompress(r["phrases"]), np.frombuffer(r["n"], "<i8").tolist()) for r in rows] == [(0, b"b c\n\x00 d", [1 << 40, 4]), (2, b"a\n\xff", [1, 3])]
    assert collocations._packed([], np.zeros(0, int), np.zeros(0, np.uint64), 1) == []
