"""URL verdicts: rules first, then words found inside host names, scored by naive Bayes.

A unigram model is counted over all words of the pages' HTML text; its
dictionary is the whole table of their counts, which no process holds. The
substrings of up to STEM letters of each distinct host label and path part are
joined with it; longer words are found by their first STEM letters and looked up
in the name. With the words found a Viterbi pass splits the name, whole (an
unknown word of n letters costs 10 / (N 10^n), n at most STEM: longer runs of
unknown letters are several); the splits are joined with the pages' names. A
multinomial naive Bayes over the words, hashed to 2^BITS places, learns from
the pages that a rule judges and judges the others.

Defined results: a null url or one without `://` has empty host and path; it
has no words and gets the verdict of the classes' shares. Invalid UTF-8 in a
url or page is read as U+FFFD. Without labelled
pages everything unruled is allowed. Ties are allowed. Repeated pages repeat;
an empty table stays so.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterbrook.llm.common import ascii_lower, chunks, cut, map_batches, table, utf8

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BITS = 16
#: Letters of a word that are looked up at once.
STEM = 24
#: Substrings handed on at once.
SPREAD = 50_000
CLASSES = ("allow", "block")

_CLOSED = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style")}
_HIDDEN = re.compile(r"(?i)<(script|style)\b")
_WORDS = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[^\W_]+")


def host_of(url: Column) -> Column:
    """From behind the first :// to /, ?, # or the end, A-Z lower-cased; empty without one."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, like `net/`, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def without_tags(html: str) -> str:
    """The text outside tags, comments, scripts and styles, in one pass; what is never closed isn't one of these."""
    out, at, size = [], 0, len(html)
    open_ended: set[str] = set()  # what isn't closed from some place on isn't closed from a later one

    def end_of(kind: str, start: int) -> int:
        if kind in open_ended:
            return -1
        if kind in _CLOSED:
            found = _CLOSED[kind].search(html, start)
            end = found.end() if found else -1
        else:
            end = html.find(kind, start)
            end += len(kind) if end >= 0 else 0
        if end < 0:
            open_ended.add(kind)
        return end

    while at < size:
        start = html.find("<", at)
        if start < 0:
            break
        hidden, end = _HIDDEN.match(html, start), -1
        if hidden:
            end = end_of(hidden[1].lower(), hidden.end())
        elif html.startswith("<!--", start):
            end = end_of("-->", start + 4)
        if end < 0:
            end = end_of(">", start + 1)
        if end < 0:
            break
        out.append(html[at:start])
        at = end
    out.append(html[at:])
    return " ".join(out)


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n) over the text of all pages, words in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches):
            counts: Counter = Counter()
            for t in texts:
                counts.update(_WORDS.findall(without_tags(t or "").lower()))
            yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return map_batches(pages.select(utf8(html_col).alias("text")), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Splitter:
    """Unigram Viterbi segmentation."""

    def __init__(self, counts: dict[str, int], total: int):
        self.total = max(1, total)
        self.logp = {w: log(n / self.total) for w, n in counts.items()}

    def _cost(self, word: str) -> float:
        known = self.logp.get(word)
        return known if known is not None else log(10.0 / self.total) - len(word) * log(10.0)

    def split(self, name: str) -> tuple[str, ...]:
        long: dict[int, list[int]] = {}  # by its end, where a known word of over STEM letters begins
        for word in self.logp:
            at = name.find(word) if len(word) > STEM else -1
            while at >= 0:
                long.setdefault(at + len(word), []).append(at)
                at = name.find(word, at + 1)
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            score, start = max((best[i] + self._cost(name[i:end]), i) for i in (*long.get(end, ()), *range(max(0, end - STEM), end)))
            best.append(score)
            back.append(start)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return tuple(reversed(out))


def pieces(host: str, path: str) -> Iterator[tuple[str, str]]:
    """(prefix, name): what of host and path is split, in order."""
    for kind, text in (("h:", host), ("p:", path.lower())):
        for part in _PARTS.findall(text):
            yield kind, part


def substrings(name: str) -> Iterator[str]:
    """All substrings of at most STEM letters, with repeats."""
    for i in range(len(name)):
        for j in range(i + 1, min(len(name), i + STEM) + 1):
            yield name[i:j]


def segments(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words): the distinct names (name) split with the exact counts (word, n)."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    named = cut(names.select("name", F.monotonically_increasing_id().alias("id")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, str], None] = {}
            for name, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for word in substrings(name):
                    found[i, word] = None
                    if len(found) >= SPREAD:
                        yield made(found)
                        found = {}
            yield made(found)

    def made(found: dict[tuple[int, str], None]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([i for i, _ in found], pa.int64()), pa.array([w for _, w in found], pa.string())], names=["id", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, known = (c.to_pylist() for c in batch.columns)
            words = [Splitter({k["word"]: k["n"] for k in found or ()}, total).split(name) for name, found in zip(names, known, strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["name", "words"])

    parts = map_batches(named, spread, "id long, word string")
    exact = parts.join(counts, "word").select("id", "word", "n")
    if counts.filter(F.length("word") > STEM).isEmpty():
        every = exact
    else:
        parts = cut(parts)
        stems = counts.filter(F.length("word") > STEM).select(F.substring("word", 1, STEM).alias("stem"), F.col("word").alias("long"), "n")
        begun = parts.filter(F.length("word") == STEM).join(stems, F.col("word") == F.col("stem")).select("id", "long", "n")
        longer = begun.join(named, "id").filter(F.contains("name", "long")).select("id", F.col("long").alias("word"), "n")
        every = parts.join(counts, "word").select("id", "word", "n").union(longer)
    found = every.groupBy("id").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return map_batches(named.join(found, "id", "left").select("name", "known"), run, "name string, words array<string>")


def worded(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """parts with words: those of host and path in order, told apart by a prefix; digits are one word."""
    rows = cut(parts.withColumn("row", F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(r, at, *x) for r, host, path in zip(*(c.to_pylist() for c in batch.columns), strict=True) for at, x in enumerate(pieces(host, path))]
            columns = list(zip(*found, strict=True)) or [()] * 4
            digits = [name.isdigit() for name in columns[3]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip((*columns, digits), (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_()), strict=True)], names=["row", "at", "kind", "name", "digits"])

    each = cut(map_batches(rows.select("row", "host", "path"), run, "row long, at int, kind string, name string, digits boolean"))
    # cut, so that the join below has an exchange of its own on either side, and a hot name is split
    splits = cut(segments(each.filter("NOT digits").select("name").distinct(), counts))
    mine = F.transform(F.coalesce("words", F.array("name")), lambda w: F.concat("kind", w))
    words = each.join(splits, "name", "left").select("row", F.struct("at", mine.alias("words")).alias("w")).groupBy("row").agg(F.sort_array(F.collect_list("w")).alias("w"))
    return rows.join(words, "row", "left").select(*parts.columns, F.coalesce(F.flatten("w.words"), F.array().cast("array<string>")).alias("words"))


def place(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & (1 << BITS) - 1


class Bayes:
    """Multinomial naive Bayes over hashed words, with one added to each count."""

    def __init__(self, counts: np.ndarray, docs: np.ndarray):
        self.known = bool(docs.sum())
        self.logp = np.log((counts + 1) / (counts.sum(axis=0) + len(counts)))
        self.prior = np.log((docs + 1) / (docs.sum() + len(docs)))

    def blocked(self, words: list[str]) -> float:
        """Probability that a page with these words is to be blocked; 0 with nothing learned."""
        if not self.known:
            return 0.0
        s = self.prior + self.logp[[place(w) for w in words]].sum(axis=0)
        return float(1 / (1 + np.exp(np.clip(s[0] - s[1], -700, 700))))


def _parts(urls: DataFrame) -> DataFrame:
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return urls.select("page_id", host.alias("host"), path.alias("path")).select("*", *(c.alias(n) for c, n in zip(ruled(F.col("host"), F.col("path")), ("rule", "ruling"), strict=True)))


def bayes(parts: DataFrame) -> Bayes:
    """Learned from the rows of parts, with their words, that have a ruling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros((1 << BITS, 2), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for words, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k = CLASSES.index(verdict)
                docs[k] += 1
                for w in words:
                    counts[place(w), k] += 1
        at = np.flatnonzero(counts.any(axis=1))
        yield pa.record_batch([pa.array(np.append(at, -1)), *(pa.array(np.append(counts[at, k], docs[k])) for k in (0, 1))], names=["place", "allow", "block"])

    rows = map_batches(parts.filter("ruling IS NOT NULL").select("words", "ruling"), run, "place long, allow long, block long").groupBy("place").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).collect()
    counts, docs = np.zeros((1 << BITS, 2)), np.zeros(2)
    for r in rows:
        if r.place < 0:
            docs += (r.allow, r.block)
        else:
            counts[r.place] += (r.allow, r.block)
    return Bayes(counts, docs)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block, words): the rule's verdict, else the model's."""
    parts = _parts(pages.select(F.col(id_col).alias("page_id"), utf8(url_col).alias("url")))
    parts = cut(worded(parts, cut(word_counts(pages, html_col))))
    shipped = pages.sparkSession.sparkContext.broadcast(bayes(parts))
    kind = parts.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nb = shipped.value
        for batch in batches:
            p = [nb.blocked(w) for w in batch.column(5).to_pylist()]
            verdict = [r or ("block" if x > 0.5 else "allow") for r, x in zip(batch.column(4).to_pylist(), p, strict=True)]
            yield pa.record_batch([*batch.columns[:4], pa.array(verdict, pa.string()), pa.array(p, pa.float64()), batch.column(5)], names=["page_id", "host", "path", "rule", "verdict", "p_block", "words"])

    return map_batches(parts, run, f"page_id {kind}, host string, path string, rule string, verdict string, p_block double, words array<string>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "p_block", F.array_join("words", " ").alias("segments"))
