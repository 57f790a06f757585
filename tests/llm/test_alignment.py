import hashlib
from collections import Counter

import pytest
import sentencepiece
from helpers import ODD_TEXTS, empty, odd
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rasterbrook.llm import alignment

A = Tokenizer.from_file(alignment.A_FILE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)
SIGNS = {}
for x in range(256):
    SIGNS[chr(x) if 0x21 <= x < 0x7F or 0xA1 <= x < 0xAD or 0xAE <= x else chr(256 + sum(not (0x21 <= y < 0x7F or 0xA1 <= y < 0xAD or 0xAE <= y) for y in range(x)))] = x
PIECES = ["a", " the", "Word", " ", "  ", "\n", "\r\n", "\t", "\x85", "\xa0", " ", "ﬁ", "é", "é", "漢字", "🙂", "▁", "<|endoftext|>", "</s>", "<0x0A>", "don't", "'s", "12", "1234", ",", ".", ";\r", "!?", "\x00", "{\r", "    x", "ß"]


def tokens(text):
    """(A ids, their bytes), (B ids, their bytes) of a whole text; None where it has none."""
    raw = (" " + (text or "")).encode()
    if not text:
        return None
    a = A.encode(" " + text, add_special_tokens=False)
    b = B.encode(text)
    ab = [bytes(SIGNS[c] for c in A.id_to_token(i)) for i in a.ids]
    bb = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    return ((a.ids, ab), (b, bb)) if b"".join(ab) == b"".join(bb) == raw else None


def spans(parts):
    at = 0
    for x in parts:
        yield at, at + len(x)
        at += len(x)


def facts(text):
    """Groups as text, and all links of a text, by comparing every A with every B token near it."""
    found = tokens(text)
    if not found:
        return None, []
    (a, ab), (b, bb) = found
    sa, sb = list(spans(ab)), list(spans(bb))
    ends = sorted({e for _, e in sa} & {e for _, e in sb})
    groups, start = [], 0
    for end in ends:
        ga = [str(i) for i, (s, e) in zip(a, sa, strict=True) if start <= s and e <= end]
        gb = [str(i) for i, (s, e) in zip(b, sb, strict=True) if start <= s and e <= end]
        groups.append(",".join(ga) + "|" + ",".join(gb))
        start = end
    links = [(i, j) for i, (s, e) in zip(a, sa, strict=True) for j, (t, f) in zip(b, sb, strict=True) if s < f and t < e]
    return (groups, len(a), len(b)), links


def brute(rows):
    out, docs = [], Counter()
    seen = {}
    for key, text in rows:
        if text not in seen:
            seen[text] = facts(text)
        docs.update(set(seen[text][1]))
    best = {}
    for (a, _), n in docs.items():
        best[a] = max(n, best.get(a, 0))
    for key, text in rows:
        own, links = seen[text]
        if own is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        groups, a, b = own
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((key, a, b, len(groups), len(links), sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links), sha))
    return sorted(out, key=repr)


def found(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[n] for n in names) for r in alignment.align(df)[0].collect()), key=repr)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES) | st.text(max_size=3), min_size=1, max_size=14))
def test_chunks_give_the_groups_of_the_whole_text(parts):
    text = "".join(parts).encode("utf-8", "replace").decode()
    block = alignment._Block(alignment.pair(alignment.A_FILE, alignment.B_FILE))
    block.add(1, text)
    row = block.row()
    own, links = facts(text)
    if own is None:
        assert (row["n_a"], row["n_links"], row["sha"], row["pairs"]) == ([0], [0], [""], [])
        return
    groups, a, b = own
    assert (row["n_a"], row["n_b"], row["n_groups"], row["n_links"]) == ([a], [b], [len(groups)], [len(links)])
    assert row["sha"] == [hashlib.sha256(";".join(groups).encode()).hexdigest()]
    assert sorted((p["a"], p["b"]) for p in row["pairs"]) == sorted(set(links))


@pytest.mark.parametrize("size", [8 << 20, 3000])
def test_rows_equal_brute_force(spark, tiny_dir, monkeypatch, size):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", size)
    docs = spark.createDataFrame(spark.read.parquet(f"{tiny_dir}/documents.parquet").where("n_chars < 3000").limit(40).collect())
    assert found(docs) == brute(rows_of(docs))


def test_pairs_and_groups_are_tables(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "one three one"), (2, "two")], "doc_id long, text string")
    rows, pairs, groups = alignment.align(docs)
    counts = {(r.a, r.b): r.n for r in pairs.collect()}
    want = Counter(p for t in ("one two", "one three one", "two") for p in set(facts(t)[1]))
    assert counts == dict(want)
    assert {r.g for r in groups.collect()} == {g for t in ("one two", "one three one") for g in facts(t)[0][0]}


def test_odd_rows_and_empty(spark):
    own = odd(spark).where("text IS NULL OR length(text) < 5000")
    assert found(own) == brute(rows_of(own))
    assert found(empty(spark)) == []
    whole = found(odd(spark))
    assert len(whole) == 2 * len(ODD_TEXTS) + 1
    assert {r[1] for r in whole if r[0] == 9} == {len(tokens(ODD_TEXTS[9])[0][0])}


def test_whole_table(spark, tiny_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny_dir}/documents.parquet").collect()}
    rows = alignment.query(spark, tiny_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = tokens(docs[r.doc_id])
        assert (r.n_a, r.n_b) == ((len(own[0][0]), len(own[1][0])) if own else (0, 0))
        assert r.n_groups <= min(r.n_a, r.n_b) and r.n_links == r.n_a + r.n_b - r.n_groups and r.n_best <= r.n_links <= r.count_sum


def test_many_keys_of_late_at_once():
    recent = alignment._Recent(2)
    for k in "abc":
        recent.put(k, (k,))
    assert recent.get_all(["a", "x", "c"]) == [("a",), None, ("c",)] and "a" in recent.new


def test_groups_of_new_pieces_are_found_for_many_at_once(monkeypatch):
    calls, plain = [], alignment.Pair._groups
    monkeypatch.setattr(alignment.Pair, "_groups", lambda *args: calls.append(1) or plain(*args))
    block = alignment._Block(alignment.Pair(alignment.A_FILE, alignment.B_FILE))
    for i in range(300):
        block.add(i, f"novel{i} qx{i * i}z, once")
    row = block.row()
    assert len(calls) == 1 and row["n_groups"] == [len(facts(f"novel{i} qx{i * i}z, once")[0][0]) for i in range(300)]


@pytest.mark.parametrize("name", ["LOT_CHARS", "LOT_PIECES", "LOT_GROUPS", "CACHED_PIECES", "MOST_GROUPS", "MOST_GROUP_CHARS"])
def test_lots_and_what_is_kept_change_no_row(monkeypatch, name):
    texts = ["one two, three\n\n four", "", "one ▁ broken", "漢字🙂 don't {\r x", "two ▁", "one two\t\tthree 12345 ", "a" * 300 + " one", "  two  ", "one two, three\n\n four"]
    monkeypatch.setattr(alignment, name, 2)
    own = alignment.Pair(alignment.A_FILE, alignment.B_FILE)
    for some in (texts, texts[::-1], texts[3:]):
        block = alignment._Block(own)
        for i, x in enumerate(some):
            block.add(i, x)
        row, want = block.row(), [facts(x) for x in some]
        assert row["sha"] == [hashlib.sha256(";".join(f[0]).encode()).hexdigest() if f else "" for f, _ in want]
        assert [row[c] for c in ("n_a", "n_b", "n_groups", "n_links")] == [[f[1] if f else 0 for f, _ in want], [f[2] if f else 0 for f, _ in want], [len(f[0]) if f else 0 for f, _ in want], [len(x) for _, x in want]]
        assert {(p["a"], p["b"]): p["n"] for p in row["pairs"]} == Counter(p for _, x in want for p in set(x))
        assert set(row["groups"]) == {g for f, _ in want if f for g in f[0]}
