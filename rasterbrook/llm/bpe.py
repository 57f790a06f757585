"""Byte-level BPE by recursive DuckDB queries inside each partition.

A task collects the distinct pre-tokens of a slice of its texts. Those that
are no token themselves become token-position rows, one per byte, that a
recursive query joins with the merge table and contracts, each word's leftmost
pair of least rank in each step, until no pair is left. Decoding unnests the
ids and aggregates their bytes in order.

Words of over LONG_WORD bytes are cut into pieces of PIECE bytes, contracted
all at once, and joined again. A sequence of tokens is the word's encoding if
and only if each two neighbours, contracted alone, stay as they are (the first
merge over a boundary needs nothing but these two), so the seams are checked
by contracting the pair on either side, and where one fails, a window around it
is contracted anew, twice as wide each time. Windows of over LONG_WORD bytes
go through a second recursive query that contracts, in one step, all disjoint
leftmost-first occurrences of the least-ranked pair where that is the same (no
token built from the merged one has a lower rank), and keeps only the newest
row of each place.

Memory per task: one slice of text, its pre-tokens, at most twice CACHED words
and CACHED_BYTES from slices before, and rows in DuckDB in proportion to
ROWS_AT_ONCE or the longest window; a window is the whole word only where
no piece of it settles.

Defined results: a null or empty text has no tokens, ids '' and decodes to no
bytes. Invalid UTF-8 in a text is read as U+FFFD. Rows are independent, so
repeated rows repeat and an empty table stays so.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import suppress
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterbrook.llm.common import chunks, map_batches, release, table, utf8
from rasterbrook.llm.pretokens import BLOCK, RANKS, load_ranks, split_blocks, splitter

LONG_WORD = 64
#: Bytes of a long word's pieces; a multiple of the short periods that texts repeat with.
PIECE = 60
#: Rows that a contraction may make over all its steps, about.
ROWS_AT_ONCE = 2_000_000
#: Token ids are below this.
MOST_IDS = 1 << 31
#: Words per recursive query, and words kept from one slice to the next.
WORDS_AT_ONCE = 20_000
CACHED = 200_000
CACHED_BYTES = 24 << 20

_CONTRACT = """
WITH RECURSIVE s(w, p, t, p2, t2, done) AS (
  SELECT w, p, t, p2, t2, false FROM start
  UNION ALL (
  WITH live AS (SELECT * FROM s WHERE NOT done),
  best AS (SELECT w, min(CAST(r AS BIGINT) * 1024 + p) AS b FROM live JOIN merges ON a = t AND b = t2 GROUP BY w),
  pick AS (SELECT l.w, l.p, CAST(b >> 10 AS INTEGER) AS r, l.p2 AS q FROM best JOIN live l ON l.w = best.w AND l.p = CAST(b & 1023 AS SMALLINT)),
  swap AS (SELECT pick.*, n.p2, n.t2 FROM pick JOIN live n ON n.w = pick.w AND n.p = pick.q)
  SELECT l.w, l.p,
    CASE WHEN l.p = x.p THEN x.r ELSE l.t END,
    CASE WHEN l.p = x.p THEN x.p2 ELSE l.p2 END,
    CASE WHEN l.p = x.p THEN x.t2 WHEN l.p2 = x.p THEN x.r ELSE l.t2 END,
    x.w IS NULL
  FROM live l LEFT JOIN swap x ON x.w = l.w WHERE x.w IS NULL OR l.p <> x.q))
SELECT w, string_agg(CAST(s.t AS VARCHAR), ' ' ORDER BY p) AS ids, string_agg(v.hex, '' ORDER BY p) AS hex FROM s JOIN vocabulary v ON v.t = s.t WHERE done GROUP BY w
"""

_CONTRACT_LONG = """
WITH RECURSIVE s(w, p, t) USING KEY (w, p) AS (
  SELECT w, p, t FROM start
  UNION (
  SELECT w, p, CASE WHEN take THEN r ELSE -1 END FROM (
    SELECT *, lag(take, 1, false) OVER (PARTITION BY w ORDER BY p) AS gone FROM (
      SELECT *, hit AND CASE WHEN safe THEN row_number() OVER (PARTITION BY w, hit, k - nth ORDER BY p) % 2 = 1 ELSE nth = 1 END AS take FROM (
        SELECT *, sum(CAST(hit AS INT)) OVER (PARTITION BY w ORDER BY p) AS nth FROM (
          SELECT *, coalesce(r = min(r) OVER (PARTITION BY w), false) AS hit FROM (
            SELECT x.*, m.r, m.safe FROM (
              SELECT w, p, t, lead(t) OVER (PARTITION BY w ORDER BY p) AS t2, row_number() OVER (PARTITION BY w ORDER BY p) AS k FROM recurring.s WHERE t >= 0) x
            LEFT JOIN merges m ON m.a = x.t AND m.b = x.t2))))) WHERE take OR gone))
SELECT w, string_agg(CAST(s.t AS VARCHAR), ' ' ORDER BY p) AS ids, string_agg(v.hex, '' ORDER BY p) AS hex FROM s JOIN vocabulary v ON v.t = s.t GROUP BY w
"""

_DECODE = """
SELECT s, string_agg(v.hex, '' ORDER BY pos) AS hex FROM (
  SELECT s, CAST(unnest(ids) AS BIGINT) AS t, generate_subscripts(ids, 1) AS pos FROM (SELECT s, string_split(ids, ' ') AS ids FROM coded)) x
JOIN vocabulary v ON v.t = x.t GROUP BY s
"""


class Codec:
    """Encodes and decodes words with one rank file; a worker keeps one per file."""

    def __init__(self, path: str = RANKS):
        self.ranks = load_ranks(path)
        if max(self.ranks.values()) >= MOST_IDS:
            raise ValueError(f"token ids must be below {MOST_IDS}")
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        a, b, r = (np.array(x, np.int64) for x in (left, right, rank))
        lowest = np.full(max(self.ranks.values()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, a, r)
        np.minimum.at(lowest, b, r)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.execute("SET preserve_insertion_order = false")
        self._table("merges", {"a": a.astype(np.int32), "b": b.astype(np.int32), "r": r.astype(np.int32), "safe": lowest[r] > r})
        self._table("vocabulary", {"t": np.array(list(self.ranks.values()), np.int32), "hex": [x.hex() for x in self.ranks]})
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.token = {r: t for t, r in self.ranks.items()}
        self.whole = {}  # of the tokens that are texts, which a word may be as a whole, id and bytes
        for t, r in self.ranks.items():
            with suppress(UnicodeDecodeError):
                self.whole[t.decode()] = str(r), t
        self.apart: dict[tuple[int, int], bool] = {}  # pairs of tokens that stay as they are
        self.held = 0  # bytes of the words in self.known
        self.known: dict[str, tuple[str, bytes]] = {}  # a word's ids, and what they decode to
        self.older: dict[str, tuple[str, bytes]] = {}

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def contract(self, words: list[bytes], long: bool) -> list[tuple[str, bytes]]:
        """Ids of non-empty words, joined by a blank, and what they decode to."""
        size = np.array([len(w) for w in words])
        tokens = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        place = (np.arange(len(tokens)) - np.repeat(first, size)).astype(np.int32 if long else np.int16)
        after = np.append(tokens[1:], np.int32(-1))
        after[first + size - 1] = -1
        self._table("start", {"w": np.repeat(np.arange(len(words), dtype=np.int32), size), "p": place, "t": tokens, "p2": place + place.dtype.type(1), "t2": after})
        found = {w: (ids, bytes.fromhex(h)) for w, ids, h in self.db.execute(_CONTRACT_LONG if long else _CONTRACT).fetchall()}
        return [found[i] for i in range(len(words))]

    def contract_all(self, words: set[bytes]) -> dict[bytes, tuple[str, bytes]]:
        """contract() of each word, a bounded number of rows at a time."""
        out: dict[bytes, tuple[str, bytes]] = {}
        for long in (False, True):
            held: list[bytes] = []
            rows = 0
            for w in sorted((w for w in words if (len(w) > LONG_WORD) == long), key=len):  # like lengths take like numbers of steps
                more = len(w) if long else len(w) ** 2 // 2
                if held and (rows + more > ROWS_AT_ONCE or len(held) >= WORDS_AT_ONCE):
                    out.update(zip(held, self.contract(held, long), strict=True))
                    held, rows = [], 0
                held.append(w)
                rows += more
            if held:
                out.update(zip(held, self.contract(held, long), strict=True))
        return out

    def contract_long(self, words: list[bytes]) -> list[str]:
        """Ids of long words, by pieces that are joined and mended where two neighbours would have merged."""
        cut = [[w[i : i + PIECE] for i in range(0, len(w), PIECE)] for w in words]
        coded = self._numbers({p for c in cut for p in c})
        state = []  # tokens, and the places of the seams among them
        for c in cut:
            runs = [coded[p] for p in c]
            ends = np.cumsum([len(r) for r in runs])
            state.append(([t for r in runs for t in r], ends[:-1].tolist()))
        reach = 4
        while True:
            self._judge({(ids[i - 1], ids[i]) for ids, seams in state for i in seams})
            windows: list[list[list[int]]] = []
            for ids, seams in state:
                spans: list[list[int]] = []
                for i in seams:
                    if not self.apart[ids[i - 1], ids[i]]:
                        a, b = max(0, i - reach), min(len(ids), i + reach)
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = b
                        else:
                            spans.append([a, b])
                windows.append(spans)
            if not any(windows):
                return [" ".join(map(str, ids)) for ids, _ in state]
            raw = [[b"".join([self.token[t] for t in ids[a:b]]) for a, b in spans] for (ids, _), spans in zip(state, windows, strict=True)]
            coded = self._numbers({r for rs in raw for r in rs})
            fresh = []
            for (ids, _), spans, rs in zip(state, windows, raw, strict=True):
                out: list[int] = []
                seams, last = [], 0
                for (a, b), r in zip(spans, rs, strict=True):
                    out += ids[last:a]
                    seams += [len(out)] if a else []
                    out += coded[r]
                    seams += [len(out)] if b < len(ids) else []
                    last = b
                fresh.append((out + ids[last:], seams))
            state = fresh
            reach *= 2

    def _numbers(self, words: set[bytes]) -> dict[bytes, list[int]]:
        return {w: list(map(int, ids.split())) for w, (ids, _) in self.contract_all(words).items()}

    def _judge(self, pairs: set[tuple[int, int]]) -> None:
        """Makes self.apart know all these pairs."""
        if len(self.apart) > CACHED:
            self.apart = {}
        new = {p: self.token[p[0]] + self.token[p[1]] for p in pairs if p not in self.apart}
        coded = self.contract_all(set(new.values()))
        self.apart.update((p, coded[w][0] == f"{p[0]} {p[1]}") for p, w in new.items())

    def learn(self, words: set[str]) -> None:
        """Makes self.known know all these words."""
        if len(self.known) > CACHED or self.held > CACHED_BYTES:  # words that the last ones didn't use are forgotten
            self.older, self.known, self.held = self.known, {}, 0
        for w in words.intersection(self.older).difference(self.known):
            self.known[w] = self.older[w]
            self.held += len(w)
        new = words.difference(self.known)
        self.known.update((w, self.whole[w]) for w in new.intersection(self.whole))
        short = {}
        long = []
        for w in new.difference(self.whole):
            raw = w.encode()
            self.held += len(raw)
            if len(raw) <= LONG_WORD:
                short[raw] = w
            else:
                long.append((w, raw))
        self.known.update((short[raw], found) for raw, found in self.contract_all(set(short)).items())
        for (w, _), ids in zip(long, self.contract_long([raw for _, raw in long]), strict=True):
            self.known[w] = ids, self.decode([ids])[ids]

    def decode(self, coded: list[str]) -> dict[str, bytes]:
        """Sequences of ids to their bytes, by ordered aggregation."""
        self._table("coded", {"s": np.arange(len(coded)), "ids": coded})
        return {coded[s]: bytes.fromhex(h) for s, h in self.db.execute(_DECODE).fetchall()}

    def run(self, texts: list[str | None]) -> tuple[list[int], list[str], list[bytes]]:
        """Token counts, ids as text, and the bytes that the ids decode to."""
        split = splitter()
        pieces = [None if t and len(t) > BLOCK else split(t) if t else [] for t in texts]
        self.learn(set().union(*(p for p in pieces if p)))
        ids, back = [], []
        for words in pieces:
            found = list(map(self.known.__getitem__, words or ()))
            ids.append(" ".join([x for x, _ in found]))
            back.append(b"".join([x for _, x in found]))
        for i, text in enumerate(texts):
            if pieces[i] is None:  # a long text, a block at a time
                parts, raw = [], []
                for words in split_blocks(text):
                    self.learn(set(words))
                    found = list(map(self.known.__getitem__, words))
                    parts.append(" ".join([x for x, _ in found]))
                    raw.append(b"".join([x for _, x in found]))
                ids[i], back[i] = " ".join(parts), b"".join(raw)
        counts = [x.count(" ") + 1 if x else 0 for x in ids]
        return counts, ids, back


@cache
def codec(path: str) -> Codec:
    made = Codec(path)
    release()  # what the tables were built from
    return made


def round_trip(docs: DataFrame, path: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded): ids in decimal, joined by a blank; decoded is binary."""
    source = docs.select(F.col(id_col), utf8(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part, texts in chunks(batches):
            counts, ids, back = own.run(texts)
            yield pa.record_batch([part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.binary())], names=[id_col, "n_tokens", "ids", "decoded"])

    return map_batches(source, run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, n_tokens long, ids string, decoded binary")


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return coded.select(id_col, "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(round_trip(table(spark, sf_dir, "documents")))


# The same recursion over the rank file, and the pattern without its look-ahead: a mark parts
# a run of white space from its last character where another character follows.
_WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_MARK = r"\x{F8FF}"
ORACLE_SQL = rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
marked AS (SELECT rid, regexp_replace(text, '([{_WHITE}])([{_WHITE}][^{_WHITE}])', '\1' || chr(63743) || '\2', 'g') AS text FROM docs),
pieces AS (SELECT rid, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM (SELECT rid, regexp_extract_all(text, '''(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}{_MARK}]+|[{_WHITE}]+') AS l FROM marked)),
ranks AS (SELECT hex(from_base64(split_part(line, ' ', 1))) AS h, CAST(split_part(line, ' ', 2) AS INT) AS r FROM read_csv('{RANKS}', columns = {{'line': 'VARCHAR'}}, delim = '\x01', quote = '', escape = '', header = false)),
merges AS (SELECT a.r AS a, b.r AS b, c.r FROM (SELECT r, substr(h, 1, 2 * i) AS x, substr(h, 2 * i + 1) AS y FROM (SELECT h, r, unnest(range(1, length(h) // 2)) AS i FROM ranks)) c JOIN ranks a ON a.h = x JOIN ranks b ON b.h = y),
words AS (SELECT row_number() OVER () AS w, h, length(h) // 2 AS n FROM (SELECT DISTINCT hex(encode(piece)) AS h FROM pieces)),
bytes AS (SELECT w, p, r AS t FROM (SELECT w, substr(h, 2 * p + 1, 2) AS x, p FROM (SELECT w, h, unnest(range(n)) AS p FROM words)) JOIN ranks ON h = x),
s(w, p, t, p2, t2, done) AS (
  SELECT w, p, t, p + 1, coalesce(lead(t) OVER (PARTITION BY w ORDER BY p), -1), false FROM bytes
  UNION ALL (
  WITH live AS (SELECT * FROM s WHERE NOT done),
  best AS (SELECT w, min(CAST(r AS BIGINT) * 1048576 + p) AS k FROM live JOIN merges ON a = t AND b = t2 GROUP BY w),
  pick AS (SELECT l.w, l.p, CAST(k // 1048576 AS INT) AS r, l.p2 AS q FROM best JOIN live l ON l.w = best.w AND l.p = k % 1048576),
  swap AS (SELECT pick.*, n.p2, n.t2 FROM pick JOIN live n ON n.w = pick.w AND n.p = pick.q)
  SELECT l.w, l.p, CASE WHEN l.p = x.p THEN x.r ELSE l.t END, CASE WHEN l.p = x.p THEN x.p2 ELSE l.p2 END, CASE WHEN l.p = x.p THEN x.t2 WHEN l.p2 = x.p THEN x.r ELSE l.t2 END, x.w IS NULL
  FROM live l LEFT JOIN swap x ON x.w = l.w WHERE x.w IS NULL OR l.p <> x.q)),
coded AS (SELECT w, count(*) AS n, string_agg(CAST(t AS VARCHAR), ' ' ORDER BY p) AS ids, string_agg(ranks.h, '' ORDER BY p) AS back FROM s JOIN ranks ON ranks.r = t WHERE done GROUP BY w),
texts AS (SELECT rid, sum(coded.n) AS n, string_agg(ids, ' ' ORDER BY i) AS ids, string_agg(back, '' ORDER BY i) AS back FROM pieces p JOIN words ON words.h = hex(encode(p.piece)) JOIN coded USING (w) GROUP BY rid)
SELECT doc_id, CAST(coalesce(t.n, 0) AS BIGINT) AS n_tokens, sha256(coalesce(ids, '')) AS ids_sha256, sha256(unhex(coalesce(back, ''))) AS decoded_sha256 FROM docs LEFT JOIN texts t USING (rid)
"""
