"""Token counts that follow edits without encoding the document again.

A document's pre-tokens and their counts are kept in leaves of about LEAF, under
a segment tree whose nodes hold their subtree's characters and tokens. An edit walks down by
characters to its leaf, takes up the pre-tokens that it touches and those
whose match looked at a changed character, splits the new text from there, and
stops at the first boundary behind the edit that the old text had too: behind
it both split alike, since a match depends on nothing before its start. Only
what lies between is encoded; the sums on the leaves' paths are then updated.

Defined results: a null text counts as empty; invalid UTF-8 in a text is read
as U+FFFD. Edits are (start, end, text) in
characters of the old text; bounds are clamped to it, reversed bounds count as
an insertion at start, null edits and null fields as none, 0 and ''. They are
applied from the last to the first; one that overlaps its successor is cut
short at that one's start. Repeated rows repeat; an empty table stays so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterbrook.llm.common import chunks, map_batches, table, utf8
from rasterbrook.llm.pretokens import RANKS, load_ranks, splitter

LEAF = 32
#: Words whose counts a worker keeps.
CACHED = 300_000


@cache
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """words -> token counts, by one rank file; a worker keeps one per file."""
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    known: dict[str, int] = {}

    def count(words: list[str]) -> list[int]:
        if len(known) > CACHED:
            known.clear()
        try:
            return [known[w] for w in words]
        except KeyError:
            for w in set(words).difference(known):
                known[w] = len(encoding.encode_ordinary(w))
            return [known[w] for w in words]

    return count


class CountTree:
    """Pre-tokens of one text in leaves, and a segment tree of characters and tokens over them."""

    def __init__(self, text: str, count: Callable[[list[str]], list[int]]):
        self.split, self.count = splitter(), count
        words = self.split(text)
        self.pretokens = len(words)
        self.encoded = 0
        self._build(words, count(words))

    def _build(self, words: list[str], counts: list[int]) -> None:
        """Leaves of LEAF pre-tokens with their counts, and the sums over them."""
        starts = range(0, max(1, len(words)), LEAF)
        self.leaves = [words[i : i + LEAF] for i in starts]
        self.counts = [counts[i : i + LEAF] for i in starts]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars = [0] * (2 * self.width)
        self.tokens = [0] * (2 * self.width)
        for i, (leaf, n) in enumerate(zip(self.leaves, self.counts, strict=True)):
            self.chars[self.width + i] = sum(map(len, leaf))
            self.tokens[self.width + i] = sum(n)
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(w for leaf in self.leaves for w in leaf)

    def _find(self, at: int) -> tuple[int, int]:
        """Leaf with the character at `at` (the last leaf with any, at the end), and the characters before it."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if at - before >= self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.width, before

    def _set(self, leaf: int, words: list[str], counts: list[int]) -> None:
        self.leaves[leaf], self.counts[leaf] = words, counts
        node = self.width + leaf
        self.chars[node], self.tokens[node] = sum(map(len, words)), sum(counts)
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def replace(self, start: int, end: int, new: str) -> None:
        """Puts new in place of characters start to end."""
        if start == end and not new:
            return
        # from the first pre-token whose match looked at the character at start or behind it
        first, before = self._find(max(0, start - 2))
        ends = list(accumulate(map(len, self.leaves[first]), initial=before))
        skip = next((i for i, e in enumerate(ends[1:]) if e >= start - 1), len(ends) - 1)
        head, at = self.leaves[first][:skip], ends[skip]
        last, old, reach = first, self.leaves[first][skip:], ends[-1]
        head_counts, old_counts = self.counts[first][:skip], self.counts[first][skip:]
        while True:
            while reach < end or reach == at and last + 1 < len(self.leaves):
                last += 1
                old, old_counts = old + self.leaves[last], old_counts + self.counts[last]
                reach += sum(map(len, self.leaves[last]))
            span = "".join(old)
            changed = span[: start - at] + new + span[end - at :]
            closed = last + 1 >= len(self.leaves) or reach == self.n_chars
            shift = len(new) - (end - start)
            starts = {e + shift for e in accumulate(map(len, old), initial=at) if e >= end}
            words, place, kept = self.split(changed), at, None
            for i, w in enumerate(words):
                if i and place >= start + len(new) and place in starts:
                    kept = i
                    break
                place += len(w)
                if not closed and place + 1 >= at + len(changed):
                    break
            if kept is not None:
                rest = changed[place - at :]
                fresh = words[:kept]
                tail, n = [], len(rest)
                for w in reversed(old):
                    if n <= 0:
                        break
                    tail.append(w)
                    n -= len(w)
                tail.reverse()
                break
            if closed:
                fresh, tail = words, []
                break
            reach_before = reach
            last += 1
            old, old_counts = old + self.leaves[last], old_counts + self.counts[last]
            reach = reach_before + sum(map(len, self.leaves[last]))
        counts = self.count(fresh)
        self.encoded += len(fresh)
        self.pretokens += len(fresh) + len(tail) - len(old)
        # what is kept of the old leaves keeps its counts
        words = head + fresh + tail
        counts = head_counts + counts + old_counts[len(old) - len(tail) :]
        for i in range(first, last + 1):
            self._set(i, words if i == first else [], counts if i == first else [])
        if len(words) > 4 * LEAF:
            self._spread()

    def _spread(self) -> None:
        """Evens the leaves out; counts go with their pre-tokens."""
        self._build([w for leaf in self.leaves for w in leaf], [n for leaf in self.counts for n in leaf])

    def apply(self, edits: list[dict | None]) -> int:
        """Applies edits of the old text; returns how many."""
        size = self.n_chars
        clean = []
        for e in edits or []:
            if e is not None:
                start = min(max(e["start"] or 0, 0), size)
                clean.append((start, max(start, min(max(e["end"] or 0, 0), size)), e["text"] or ""))
        limit = size
        for start, end, new in sorted(clean, key=lambda e: e[:2], reverse=True):
            self.replace(start, min(end, limit), new)
            limit = start
        return len(clean)


def count_edited(docs: DataFrame, edits: Column, path: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_pretokens, n_edits, n_tokens_edited, n_reencoded, edited): counts before and after the edits, pre-tokens encoded for them, the edited text.

    edits: array<struct<start:int,end:int,text:string>> per row.
    """
    source = docs.select(F.col(id_col), utf8(text_col).alias("text"), edits.cast("array<struct<start:int,end:int,text:string>>").alias("edits"))
    names = ["n_tokens", "n_pretokens", "n_edits", "n_tokens_edited", "n_reencoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for part, texts in chunks(batches):
            out: list[list] = [[] for _ in names]
            edited = []
            for text, changes in zip(texts, part.column(2).to_pylist(), strict=True):
                tree = CountTree(text or "", count)
                row = [tree.n_tokens, tree.pretokens]
                row += [tree.apply(changes), tree.n_tokens, tree.encoded]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                edited.append(tree.text())
            yield pa.record_batch([part.column(0), *(pa.array(c, pa.int64()) for c in out), pa.array(edited, pa.string())], names=[id_col, *names, "edited"])

    return map_batches(source, run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, {', '.join(f'{n} long' for n in names)}, edited string")


def edit_log(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Three edits a row, placed by the id: an insertion, a deletion and a replacement."""
    size = F.coalesce(F.char_length(utf8(text_col)), F.lit(0))

    def at(k: int) -> Column:
        return F.pmod(F.crc32(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(str(k)))), size + 1).cast("int")

    def edit(start: Column, cut: int, text: str) -> Column:
        return F.struct(start.alias("start"), (start + cut).alias("end"), F.lit(text).alias("text"))

    return F.array(edit(at(0), 0, " newly added words"), edit(at(1), 12, ""), edit(at(2), 5, "2024's"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_edited(table(spark, sf_dir, "documents"), edit_log())
    return counted.select("doc_id", "n_tokens", "n_pretokens", "n_edits", "n_tokens_edited", "n_reencoded", F.sha2("edited", 256).alias("edited_sha256"))
