"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are character 1- to ORDER-grams of the lower-cased text, anything but
letters read as a blank, hashed to 2^BITS places; a place weighs
log(1 + count) times its inverse document frequency, and a text's vector has
length one. Document frequencies come from all training rows. The classifier
is fitted on the driver, on about SAMPLE rows of each language, SAMPLE_TOTAL in all,
drawn by hash, and on no more than SAMPLE_PLACES of their features (the
documented bound; rows with equal hashes count once), with
follow-the-regularised-leader steps under L1 and L2 penalties. A fifth of the
sample is kept for the temperature that the logits are divided by, chosen for
least negative log-likelihood.

Memory: at most MOST_WEIGHTS weights; with more languages than leave 2^BITS
places each, the n-grams are hashed to fewer places, so that any number of
languages is learned. Texts are read in bands of BAND characters.

Defined results: a text that is null or has no letter is `und` with score 0.
Invalid UTF-8 in a text is read as U+FFFD, which is no letter. Training rows
without a language or an id are not learned from. With nothing to learn from,
all texts are `und`. Ties go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterbrook.llm.common import chunks, cut, fold, map_batches, table, utf8

BITS = 15
ORDER = 3
SAMPLE = 800
SAMPLE_TOTAL = 20_000
SAMPLE_PLACES = 8_000_000
MOST_WEIGHTS = 1 << 23
#: Languages whose counts (some 40 bytes each) are broadcast; of more, rows are exchanged by language.
MOST_BROADCAST = 100_000
#: Characters of a text whose n-grams are in memory at once.
BAND = 1 << 18
EPOCHS = 3
#: FTRL's step sizes and the elastic net.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-3, 1e-3
FOLDS = 5
UND = "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _letters() -> np.ndarray:
    """Which ASCII characters are kept."""
    return np.array([chr(c).isalpha() for c in range(128)])


_KEEP = _letters()


def features(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the text's n-grams, ascending, and how often each occurs."""
    counts = np.zeros(1 << bits, np.int64)
    before = np.zeros(0, np.uint64)  # the last codes of the band before, which its n-grams begin with
    for start in range(0, max(1, len(text)), BAND):
        band = (" " if start == 0 else "") + text[start : start + BAND].lower() + (" " if start + BAND >= len(text) else "")
        codes = np.frombuffer(band.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.minimum(codes, 127)
        codes = np.where((codes >= 128) | _KEEP[low], codes, 32).astype(np.uint64)
        blank = codes == 32
        codes = codes[~(blank & np.r_[len(before) > 0 and before[-1] == 32, blank[:-1]])]
        run = np.concatenate((before, codes))
        h = np.zeros(len(run), np.uint64)
        for n in range(1, ORDER + 1):
            h = (h[: max(0, len(run) - n + 1)] + run[n - 1 :] + np.uint64(n)) * _MIX
            h ^= h >> np.uint64(29)
            fresh = h[max(0, len(before) - n + 1) :] * _MIX  # those that end in this band
            counts += np.bincount((fresh >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(fresh), np.int64), minlength=1 << bits)
        before = run[1 - ORDER :]
    places = np.flatnonzero(counts)
    return places, counts[places]


def bits_for(langs: int) -> int:
    """How many bits of a hash make a place, so that there are at most MOST_WEIGHTS weights."""
    return max(0, min(BITS, (MOST_WEIGHTS // max(1, langs)).bit_length() - 1))


class Model:
    """Weights, inverse document frequencies and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray):
        self.langs, self.idf = langs, idf.astype(np.float32)
        self.bits = (len(idf) - 1).bit_length()
        self.weights = np.zeros((len(idf) + 1, len(langs)), np.float32)  # the last row is the bias
        self.temperature = 1.0

    def vector(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf[places]
        return (x / max(float(np.sqrt((x * x).sum())), 1e-12)).astype(np.float32)

    def logits(self, places: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[places] + self.weights[-1]

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> None:
        """FTRL-proximal over (places, counts, language), in an order drawn once per epoch."""
        rng = np.random.default_rng(11)
        held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
        vectors = [(np.append(p, len(self.idf)), np.append(self.vector(p, c), np.float32(1)), y) for p, c, y in rows]
        z = np.zeros(self.weights.shape, np.float64)
        n = np.zeros(self.weights.shape, np.float64)

        def proximal(at: np.ndarray) -> np.ndarray:
            zs, ns = z[at], n[at]
            w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2)
            return np.where(np.abs(zs) <= L1, 0.0, w)

        learn = np.flatnonzero(~held)
        for _ in range(epochs):
            for i in rng.permutation(learn):
                at, x, y = vectors[i]
                w = proximal(at)
                s = x @ w
                p = np.exp(s - s.max())
                p /= p.sum()
                p[y] -= 1
                g = x[:, None] * p
                square = g * g
                z[at] += g - (np.sqrt(n[at] + square) - np.sqrt(n[at])) / ALPHA * w
                n[at] += square
        self.weights = proximal(np.arange(len(z))).astype(np.float32)
        self._calibrate([(self.logits(at[:-1], x[:-1]), y) for (at, x, y), h in zip(vectors, held, strict=True) if h])

    def _calibrate(self, rows: list[tuple[np.ndarray, int]]) -> None:
        if rows:
            s, y = np.array([s for s, _ in rows], np.float64), np.array([y for _, y in rows])

            def loss(t: float) -> float:
                a = s / t
                a -= a.max(axis=1, keepdims=True)
                return float(np.mean(np.log(np.exp(a).sum(axis=1)) - a[np.arange(len(y)), y]))

            self.temperature = min(np.geomspace(0.1, 10, 81).tolist(), key=loss)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UND, 0.0
        places, counts = features(text, self.bits)
        s = self.logits(places, self.vector(places, counts)).astype(np.float64) / self.temperature
        p = np.exp(s - s.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def _document_frequencies(rows: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """How many of the rows' texts have each place, and how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << bits) + 1, np.int64)
        for _, texts in chunks(batches):
            for t in texts:
                if has_letter(t):
                    total[features(t, bits)[0]] += 1
                    total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["place", "n"])

    out = np.zeros((1 << bits) + 1, np.int64)
    for r in map_batches(rows.select("text"), run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[r.place] = r.n
    return out[:-1], int(out[-1])


def train(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """rows: (doc_id, text, lang) to learn from."""
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = cut(rows.groupBy("lang").count())
    langs = sorted(r.lang for r in counts.select("lang").collect())
    bits = bits_for(len(langs))
    if not langs:
        return Model([], np.zeros(1 << bits))
    df, n = _document_frequencies(rows, bits)
    model = Model(langs, np.log((1 + n) / (1 + df)) + 1)
    sample = max(1, min(sample, SAMPLE_TOTAL // len(langs)))
    # a row is drawn if its hash falls into the first sample / count of all hashes
    few = F.broadcast(counts) if len(langs) <= MOST_BROADCAST else counts
    drawn = rows.withColumn("h", F.xxhash64(F.lit("sample"), "doc_id", "text")).join(few, "lang").filter((F.shiftrightunsigned("h", 11) / float(1 << 53)) < sample / F.col("count"))
    drawn = drawn.groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = {name: i for i, name in enumerate(langs)}
    vectors, size = [], 0
    for r in _vectors(drawn, bits).orderBy("h", "lang").toLocalIterator():
        size += len(r.places) // 4
        if vectors and size > SAMPLE_PLACES:
            break
        vectors.append((np.frombuffer(r.places, "<i4"), np.frombuffer(r.counts, "<i4"), order[r.lang]))
    model.fit(vectors)
    return model


def _vectors(rows: DataFrame, bits: int) -> DataFrame:
    """(lang, h, places, counts) of (lang, h, text) with a letter: what is sent to the driver is bounded however long the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            kept = [i for i, t in enumerate(texts) if has_letter(t)]
            found = [features(texts[i], bits) for i in kept]
            columns = [pa.array([x[j].astype("<i4").tobytes() for x in found], pa.binary()) for j in (0, 1)]
            yield pa.record_batch([*(part.column(c).take(pa.array(kept, pa.int64())) for c in ("lang", "h")), *columns], names=["lang", "h", "places", "counts"])

    return map_batches(rows, run, "lang string, h long, places binary, counts binary")


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score): row is a struct of all columns of docs."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), utf8(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for part, texts in chunks(batches):
            found = [own.predict(t) for t in texts]
            yield pa.record_batch([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["row", "lang_pred", "score"])

    return map_batches(source, run, f"row {source.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def trained_on(docs: DataFrame) -> Model:
    """A model from the rows of docs that are not held out."""
    return train(docs.select("doc_id", utf8("text").alias("text"), F.make_valid_utf8("lang").alias("lang")).filter(fold(FOLDS) != 0))


def known_language(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows in which no language is found."""
    return identify(docs, model).filter(F.col("lang_pred") != UND).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), trained_on(docs))
    return found.select(F.col("row.doc_id").alias("doc_id"), fold(FOLDS, F.col("row.doc_id")).eqNullSafe(0).alias("held_out"), "lang_pred", "score")
