import hashlib
import pickle
import random
import re

from helpers import check_sql, empty, odd

from rasterbrook.llm import decontam

ITEM = "item_id long, text string"
LONG = " ".join(f"w{i}" for i in range(20))


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def naive(text, items):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(13, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit |= set(range(j, j + n))
                    names |= {name} if name is not None else set()
    named = sorted(map(str, names))
    return len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), 0 < len(w) <= 20 * len(hit)


def test_whole_table_against_sql(spark, sf_dir):
    check_sql(spark, decontam.query, decontam.ORACLE_SQL, sf_dir, ["documents", "benchmark"])


def test_odd_rows(spark):
    items = [(1, LONG), (1, LONG), (10, "one TWO"), (2, None), (3, "..."), (None, "near again"), (4, "x" + LONG), (5, "字 漢")]
    docs = [(1, f"pre {LONG} post"), (2, "One, two! three"), (3, None), (4, ""), (5, "near again " + "pad " * 60), (6, "pad " * 39 + "one two"), (7, "pad " * 38 + "one two"), (None, "one two"), (1, f"pre {LONG} post"), (8, "w0 w1 w2")]
    bench = spark.createDataFrame(items, ITEM)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(((str(d), *naive(t, items)) for d, t in docs), key=repr)
    for size in (1 << 20, 40):  # in one slice and in several
        got = decontam.mark(df, bench, slice_bytes=size).collect()
        assert sorted(((str(r.doc_id), r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in got), key=repr) == want


def test_removal_keeps_columns_and_clean_rows(spark):
    docs, bench = odd(spark), spark.createDataFrame([(1, "end of it all is near and the end of it all is near again")], ITEM)
    kept = decontam.remove_documents(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    cut = decontam.remove_spans(docs, bench)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    changed = {r.text for r in cut.filter("doc_id = 12").collect()}
    assert changed == {"The ."}
    same = {(r.doc_id, r.text) for r in docs.filter("doc_id <> 12").collect()}
    assert {(r.doc_id, r.text) for r in cut.filter("doc_id <> 12").collect()} == same


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b")], ITEM)
    assert decontam.mark(empty(spark), bench).collect() == []
    assert {r.n_hit for r in decontam.mark(odd(spark), bench.limit(0)).collect()} == {0}


def test_a_set_s_memory_is_bounded_by_its_text():
    rng = random.Random(1)
    items = [(str(i), " ".join(f"w{rng.randrange(10**6)}" for _ in range(500)).encode()) for i in range(600)]
    size = sum(len(t) for _, t in items)
    made = decontam.TestSet(items)
    arrays = [made.starts, made.vocabulary, made.items, *(a for w in made.windows.values() for a in w)]
    assert len(made.text) + sum(a.nbytes for a in arrays) < 7 * size
    assert len(pickle.dumps(made)) < 7 * size
    found = decontam.words(items[17][1])
    hit, names = decontam.np.zeros(len(found), bool), set()
    made.scan(found, decontam.word_hashes(found), hit, names)
    assert hit.all() and names == {"17"}
