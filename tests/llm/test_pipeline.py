import hashlib
import re

import public_tokenizers
import tiktoken
from test_decontam import naive as benchmark_hits
from test_simhash import naive_groups, naive_print

import pytest
from helpers import ODD_TEXTS, SCHEMA, empty, odd
from pyspark.sql import functions as F

import corpus_pipeline
from rasterbrook.llm.pretokens import load_ranks


def test_whole_table_stage_by_stage(spark, tiny_dir):
    """Each stage on its predecessor's rows, against brute force; then run() against the last of them."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, tiny_dir)
        docs = spark.createDataFrame(done.collect(), done.schema)
        got = {r.doc_id: r for r in docs.collect()}
        assert len(got) == docs.count()
        if name != "tokenise":
            assert docs.columns == columns
        if name == "language_id":
            want = {d for d, r in rows.items() if any(map(str.isalpha, r.text or ""))}
        elif name == "near_dedup":
            want = {int(d) for d, _, c in naive_groups([(d, naive_print(r.text)) for d, r in rows.items()]) if int(d) == c}
        elif name == "decontaminate":
            want = {d for d, r in rows.items() if not benchmark_hits(r.text, bench)[-1]}
        else:
            want = set(rows)
        assert set(got) == want
        if name in ("language_id", "near_dedup", "decontaminate"):
            assert all(got[d] == rows[d] for d in want)
        if name == "anonymise":
            assert all(r.n_chars == len(r.text) for r in got.values())
            assert not any(re.search(r"@mail\d|(?<!\d)\d{16}(?!\d)", r.text) and re.search(r"@mail\d", r.text) for r in got.values())
        if name == "tokenise":
            encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(), special_tokens={})
            for d, r in got.items():
                ids = encoding.encode_ordinary(rows[d].text)
                assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                assert r.decoded_sha256 == hashlib.sha256(rows[d].text.encode()).hexdigest()
        rows = got
    assert sorted(corpus_pipeline.run(spark, tiny_dir).collect()) == sorted(rows.values())


@pytest.fixture
def odd_dir(spark, tiny_dir, tmp_path):
    (tmp_path / "benchmark.parquet").symlink_to(f"{tiny_dir}/benchmark.parquet")
    rows = [(50, "one text of words about many things here", "en", "s", 40, "x", 1, 2, "w"), (50, "another one that has nothing in common with it", "en", "s", 45, "x", 1, 2, "w"), (None, "an unnamed row that says something else again", "en", "s", 45, "x", 1, 2, "w")]
    docs = odd(spark).union(spark.createDataFrame(rows * 2, SCHEMA))
    docs = docs.union(docs.filter("doc_id = 50").limit(1).withColumn("text", F.expr("cast(unhex('62726F6B656E20FF20627974657320686572652C2061C3') AS string)")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_odd_rows_pass_whole(spark, odd_dir):
    """Null, empty and equal texts, invalid UTF-8, null and repeated ids, columns of clashing names."""
    done = corpus_pipeline.run(spark, odd_dir).collect()
    lettered = [t for t in ODD_TEXTS if any(map(str.isalpha, t or ""))]
    found = {r.decoded_sha256 for r in done}
    words = {" ".join(t.lower().split()) for t in lettered}  # near-dedup lower-cases A-Z and splits at blanks
    assert len(done) == len(found) <= len(words) + 5
    for t in ("one text of words about many things here", "another one that has nothing in common with it", "an unnamed row that says something else again", "no id here", "a"):
        assert hashlib.sha256(t.encode()).hexdigest() in found
    assert hashlib.sha256("broken \ufffd bytes here, a\ufffd".encode()).hexdigest() in found
    assert sum(r.doc_id == 50 for r in done) == 3 and sum(r.doc_id is None for r in done) == 2


def test_empty_table(spark, tiny_dir, tmp_path):
    (tmp_path / "benchmark.parquet").symlink_to(f"{tiny_dir}/benchmark.parquet")
    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
