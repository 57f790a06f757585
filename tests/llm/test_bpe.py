import base64
import hashlib
import random

import public_tokenizers
import regex
import tiktoken
from helpers import ODD_TEXTS, check_sql, empty, odd, same

from rasterbrook.llm import bpe, pretokens
from rasterbrook.llm.pretokens import load_ranks, splitter

NAMES = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(), special_tokens={})


def expected(rows):
    encoding = library()
    out = []
    for r in rows:
        ids = encoding.encode_ordinary(r.text or "")
        raw = encoding.decode_bytes(ids)
        assert raw == (r.text or "").encode()
        out.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()))
    return sorted(out, key=repr)


def test_whole_table_against_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert same(bpe.query(spark, sf_dir).collect(), NAMES) == expected(docs.select("doc_id", "text").collect())


def test_whole_table_against_sql(spark, sf_dir):
    check_sql(spark, bpe.query, bpe.ORACLE_SQL, sf_dir, ["documents"])


def test_odd_rows(spark):
    docs = odd(spark)
    out = bpe.round_trip(docs)
    assert same(bpe.digests(out).collect(), NAMES) == expected(docs.collect())
    assert {bytes(r.decoded) for r in out.collect()} == {(t or "").encode() for t in ODD_TEXTS} | {b"no id here"}


def test_empty(spark):
    assert bpe.digests(bpe.round_trip(empty(spark))).collect() == []


def long_words():
    rng = random.Random(4)
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    yield from (letters[:10_000], letters[:100_000], letters)
    yield base64.b64encode(rng.randbytes(30_000)).decode().replace("+", "A").replace("/", "B")
    yield "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(20_000))
    yield "abcdefg" * 3_000
    yield "ha" * 50_001
    yield "=" * 100_003
    yield ("the" * 7 + "quick" * 3) * 500


def test_long_words_are_the_library_s():
    codec, encoding = bpe.Codec(), library()
    for word in long_words():
        want = [i for piece in regex.findall(public_tokenizers.PATTERN, word) for i in encoding._core_bpe.encode_single_piece(piece.encode())]
        counts, ids, back = codec.run([word])
        assert ids[0] == " ".join(map(str, want)) and counts[0] == len(want) and back[0] == word.encode()


def test_invalid_utf8_is_replaced(spark):
    docs = spark.sql("SELECT 1 AS doc_id, cast(unhex('61FFC3622020E282') AS string) AS text")
    assert bytes(bpe.round_trip(docs).first().decoded).decode().replace("\ufffd", "?").startswith("a?")


def test_wide_ids(tmp_path):
    """Ids of 65,536 and more are kept apart."""
    ranks = load_ranks()
    path = tmp_path / "wide.tiktoken"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {r + 70_000 * (r >= 256)}\n" for t, r in ranks.items()))
    own, plain = bpe.Codec(str(path)), bpe.Codec()
    text = "Some unusual words: thouwh NDESWH ciónasta"
    assert own.run([text])[1][0] == " ".join(str(int(x) + 70_000 * (int(x) >= 256)) for x in plain.run([text])[1][0].split())


def test_both_recursions_agree_and_the_cache_may_be_dropped(monkeypatch):
    codec, encoding = bpe.Codec(), library()
    words = [w.encode() for w in [" thouwh", "NDESWH", "aaaaaaaaaaaaaaaaaaaaaaa", "ciónasta", "=====*****", "́̂", " 漢字漢字"]]
    want = [" ".join(map(str, encoding._core_bpe.encode_single_piece(w))) for w in words]
    assert codec.contract(words, False) == codec.contract(words, True) == list(zip(want, words, strict=True))
    monkeypatch.setattr(bpe, "CACHED", 3)
    assert codec.run(["a few words", "and some others", "a few words"])[1][0] == " ".join(map(str, encoding.encode_ordinary("a few words")))


def test_split_is_the_pattern():
    for t in ODD_TEXTS:
        assert splitter()(t or "") == regex.findall(public_tokenizers.PATTERN, t or "")


def test_blocks_split_alike(monkeypatch):
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(pretokens, "BLOCK", size)
        monkeypatch.setattr(bpe, "BLOCK", size)
        for t in [t for t in ODD_TEXTS if t and len(t) < 5_000] + ["a  b'll 'l l's\n\n x" * 20]:
            assert [w for words in pretokens.split_blocks(t) for w in words] == splitter()(t)
    texts = ["Some words, it's  said;\n\nand more.", None, "x", "a longer text of " * 40]
    got = bpe.Codec().run(texts)
    monkeypatch.undo()
    assert got == bpe.Codec().run(texts)
