"""Benchmark decontamination with a broadcast set of normalised test n-grams.

Words are runs of digits, a-z and non-ASCII characters after A-Z is
lower-cased. An item's windows are its runs of WINDOW words, or all its words
if it has fewer. The set is built on the driver from the benchmark, in slices
of at most SLICE_BYTES of text, and each slice is broadcast; documents are
scanned against one slice after another, so no set in memory outgrows the
bound however large the benchmark is. A slice is a few arrays, some five bytes
for each byte of text: its words, joined by blanks, where each word begins, the
sorted hashes of its distinct words and of its windows, and where these stand.
A scan hashes the distinct words of a slice of documents, hashes only windows
made of known words, probes the sorted hashes, and verifies each hit letter by
letter against the item's words.

Defined results: a null or word-less text has no words and no hits. Items that
are null or word-less have no windows. Items without an id mark words but are
not counted or named. Repeated items and documents each count as they stand.
With an empty benchmark nothing is hit; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterbrook.llm.common import LOWER, UPPER, chunks, map_batches, table

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Bytes of benchmark text behind one broadcast set.
SLICE_BYTES = 16 << 20

#: Every ASCII byte but 0-9 and letters to a blank, A-Z to a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = dict.fromkeys(found, 0)
    for w in known:
        known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def _window_hashes(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on."""
    out = np.zeros(len(at), np.uint64)
    for j in range(n):
        out = out * _MIX + hashes[at + j]
        out ^= out >> np.uint64(29)
    return out


class TestSet:
    """Windows of some items. items: (name or None, text)."""

    __test__ = False  # not a test class

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        flat: list[bytes] = []
        sizes = []
        for _, text in items:
            found = words(text)
            flat += found
            sizes.append(len(found))
        self.text = b" ".join(flat)
        self.starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in flat], dtype=np.int64)))
        hashes = word_hashes(flat)
        del flat
        self.vocabulary = np.unique(hashes)
        self.items = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))  # first word of each
        sizes = np.array(sizes, np.int64)
        length = np.minimum(sizes, window)
        self.windows = {}  # length: sorted hashes, and the first word of each
        for n in np.unique(length[length > 0]).tolist():
            own = np.flatnonzero(length == n)
            at = np.concatenate([np.arange(self.items[i], self.items[i + 1] - n + 1) for i in own])
            found = _window_hashes(hashes, at, n)
            order = np.argsort(found, kind="stable")
            self.windows[n] = found[order], at[order]

    def scan(self, found: list[bytes], hashes: np.ndarray, hit: np.ndarray, names: set) -> None:
        """Marks the words of found that lie in a window, and adds the items' names."""
        if not len(self.vocabulary) or not len(hashes):
            return
        known = self.vocabulary[np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)] == hashes
        runs = np.concatenate(([0], np.cumsum(known)))
        for n, (sorted_, places) in self.windows.items():
            at = np.flatnonzero(runs[n:] - runs[:-n] == n) if len(found) >= n else np.zeros(0, np.int64)
            if not len(at):
                continue
            mine = _window_hashes(hashes, at, n)
            lo, hi = np.searchsorted(sorted_, mine), np.searchsorted(sorted_, mine, "right")
            for i, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                here = b" ".join(found[i : i + n])
                for first in places[a:b].tolist():
                    if self.text[self.starts[first] : self.starts[first + n] - 1] == here:
                        hit[i : i + n] = True
                        names.add(self.names[np.searchsorted(self.items, first, "right") - 1])


def test_sets(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> Iterator[TestSet]:
    """Sets over slices of the benchmark, none from more than about slice_bytes of text."""
    items = bench.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("binary").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, ceil(total / slice_bytes))
    for i in range(n):
        rows = items.filter(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == i) if n > 1 else items
        yield TestSet([(r.name, bytes(r.text)) for r in rows.collect()], window)


test_sets.__test__ = False


def _spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Byte ranges of the runs of hit words."""
    out: list[dict] = []
    last = -2
    for i, m in enumerate(_WORD.finditer(text.translate(_FOLD))):
        if hit[i]:
            if last == i - 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            last = i
    return out


def mark(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, share: int = SHARE, slice_bytes: int = SLICE_BYTES, keep: bool = False) -> DataFrame:
    """A row per document: n_words, n_hit, items (sorted names), spans (byte ranges of hit words), contaminated; after the id, or with keep after all columns of docs in a struct named row."""
    context = docs.sparkSession.sparkContext
    shipped = [context.broadcast(s) for s in test_sets(bench, window=window, slice_bytes=slice_bytes)]
    head = F.struct(*(docs[f"`{c}`"] for c in docs.columns)) if keep else F.col(id_col)
    source = docs.select(head.alias("row"), F.col(text_col).cast("binary").alias("text"))
    schema = f"row {source.schema['row'].dataType.simpleString()}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, contaminated boolean"
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            out: list[list] = [[], [], [], [], []]
            split = [words(t) for t in texts]
            hashes = np.split(word_hashes(list(chain.from_iterable(split))), np.cumsum([len(x) for x in split])[:-1])
            state = [(found, np.zeros(len(found), bool), set(), h) for found, h in zip(split, hashes, strict=True)]
            for s in shipped:
                own = s.value
                for found, hit, names, h in state:
                    own.scan(found, h, hit, names)
                del own
                if len(shipped) > 1:
                    s.__dict__.pop("_value", None)  # one slice in memory at a time; it is read again from the broadcast's file
            for text, (found, hit, names, _) in zip(texts, state, strict=True):
                n = int(hit.sum())
                row = (len(found), n, sorted(x for x in names if x is not None), _spans(text, hit) if n else [], n > 0 and share * n >= len(found))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.record_batch([part.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["row", "n_words", "n_hit", "items", "spans", "contaminated"])

    marked = map_batches(source, run, schema)
    return marked if keep else marked.withColumnRenamed("row", id_col)


def remove_documents(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """docs without its contaminated rows."""
    return mark(docs, bench, keep=True, **options).filter(~F.col("contaminated")).select("row.*")


def remove_spans(docs: DataFrame, bench: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with the hit words of contaminated rows cut out of their text."""
    marked = mark(docs, bench, text_col=text_col, keep=True, **options)
    raw = F.col(f"row.`{text_col}`").cast("binary")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.end"))
    starts = F.concat(F.col("spans.start"), F.array(F.octet_length(raw).cast("long")))
    pieces = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda x: F.substring(raw, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")).cast("string"))
    text = F.when(F.col("contaminated"), F.array_join(pieces, "")).otherwise(F.col(f"row.`{text_col}`"))
    return marked.select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


_WORDS_SQL = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS_SQL}, []) AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_WORDS_SQL} AS w FROM benchmark WHERE text IS NOT NULL),
bl AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM bl)),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bl) WHERE len(w) >= n)),
hits AS (SELECT rid, i, n, item_id FROM dw JOIN bw USING (n, k)),
marks AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marks USING (rid) LEFT JOIN named USING (rid)
"""
