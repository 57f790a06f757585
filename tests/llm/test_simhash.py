import numpy as np
import xxhash
from pyspark.sql import functions as F

from rasterbrook.llm import simhash

SCHEMA = "doc_id long, text string, component_id string, fp int"


def naive_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_groups(prints):
    """{(doc_id, fp): least doc_id reachable} by comparing all pairs."""
    codes = sorted({p for _, p in prints})
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, p in prints:
        if d is not None:
            least[find(p)] = min(d, least.get(find(p), d))
    return sorted((str(d), f"{p:016x}", least.get(find(p))) for d, p in prints)


def got(df):
    return sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in df.collect())


def test_whole_table_against_all_pairs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = naive_groups([(r.doc_id, naive_print(r.text)) for r in rows])
    assert got(simhash.query(spark, sf_dir)) == want
    assert any(int(d) != c for d, _, c in want)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (5, "one"), (6, "a b"), (7, "x y z w"), (None, "one"), (None, "only here, no id"), (8, "w " * 50_000), (9, "ÀB c d e")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    assert got(simhash.near_duplicates(df)) == naive_groups([(d, naive_print(t)) for d, t in rows])


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def clusters(n, spread, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, n, dtype=np.uint64)
    out = [base]
    for _ in range(spread):
        flips = np.zeros(n, np.uint64)
        for _ in range(3):
            flips |= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64) * (rng.random(n) < 0.8)
        out.append(out[rng.integers(0, len(out))] ^ flips)
    return np.unique(np.concatenate(out))


def test_index_finds_every_component():
    codes = clusters(60, 12)
    buckets = (np.arange(len(codes)) % 3).astype(np.int64)
    order = np.argsort(buckets, kind="stable")
    index = simhash.GrayIndex(codes[order], buckets[order])
    index.links()
    found = {}
    for c, b, p in zip(index.codes.tolist(), index.buckets.tolist(), index.parent.tolist(), strict=True):
        found.setdefault((b, p), set()).add(c)
    want = []
    for b in range(3):
        group = naive_groups(list(enumerate(codes[buckets == b].tolist())))
        by = {}
        for _, fp, c in group:
            by.setdefault(c, set()).add(int(fp, 16))
        want += list(by.values())
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want))


def test_hot_buckets_are_dealt_again_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 5)
    codes = [int(c) & ~(0xFFFFFF) | 0x5A5A5A for c in clusters(40, 10, 2).tolist()]
    codes += [c ^ (1 << b) for c in codes[:40] for b in (3, 40)]
    codes = sorted(set(codes))
    df = spark.createDataFrame([(int(np.uint64(c).astype(np.int64)),) for c in codes], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.spanning_links(df)).collect()}
    found = {}
    for c in codes:
        s = int(np.uint64(c).astype(np.int64))
        found.setdefault(roots.get(s, s), set()).add(c)
    by = {}
    for _, fp, c in naive_groups(list(enumerate(codes))):
        by.setdefault(c, set()).add(int(fp, 16))
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, by.values()))


def test_components_of_long_chain(spark):
    df = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in simhash.components(df).collect()} == {0}


def test_keep_one_keeps_columns_and_one_of_each(spark, monkeypatch):
    rows = [(1, "a b c d", "x", 1), (2, "a b c d", "y", 2), (1, "a b c d", "x", 1), (None, "a b c d", "z", 3), (3, "p q r s t", None, None)]
    rows += [(5, "one text about many things", "x", 1), (5, "another that has nothing in common", "x", 1), (None, "named by nothing at all", None, None), (None, "named by nothing at all", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(str, [(1, "a b c d"), (3, "p q r s t"), (5, "one text about many things"), (5, "another that has nothing in common"), (None, "named by nothing at all")]))
    for most in (1000, 0):
        monkeypatch.setattr(simhash, "MOST_BROADCAST", most)
        out = simhash.keep_one(df)
        assert out.columns == df.columns
        assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == want


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("b", "a b c d"), ("a", "a b c d"), ("z", "quite another text")], "doc_id string, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()) == [("a", "a"), ("b", "a"), ("z", "z")]
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == ["a", "z"]


def test_blocks_change_nothing(monkeypatch):
    texts = [b"", b"   ", b"one", b" one  two ", b"One two three four five six", b"a\tb\nc d e f g h i j k l m n o p " * 5, b" " * 50 + b"x y z", b"x" * 99]
    want = simhash.fingerprint_batch(texts)
    for size in (1, 2, 5, 20):
        monkeypatch.setattr(simhash, "BLOCK", size)
        assert (simhash.fingerprint_batch(texts) == want).all()
