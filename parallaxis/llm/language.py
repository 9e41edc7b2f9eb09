"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text becomes runs of lower-cased letters with one space between them; its character n-grams of orders 1 to
3 are hashed into FEATURES counters. The value of a feature is (1 + ln tf) * idf, and each text's vector has
length 1. The inverse document frequencies come from every document with a language that may be learned from. The weights
are fitted with FTRL-proximal and elastic-net penalties (the L1 part makes them sparse; of each feature only the languages
with a weight are kept and sent) on at most about SAMPLE_PER_LANGUAGE labelled documents of each language and SAMPLE_ROWS in
all, chosen by a hash of doc_id and text, one of each language at least. The MOST_LANGUAGES most frequent values of lang are
learned; while it fits, the driver takes about 260 KB for each. A fifth of the sample is kept from the fit and sets the
temperature that calibrates the scores. Every whole text is scored, whatever its length.

Letters are the code points of Unicode's letter categories, in all planes. Null texts and texts without a letter are `und`
with score 0. With nothing to learn from, all are `und`. Documents without a language or doc_id are not learned from; equal rows
are learned once, rows that share a doc_id are told apart by their texts. Equal scores go to the language first by code point. Repeated rows each get their row, an empty table gives an empty
result, other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Carried, discard, give_back, pick, resident, text_batches, written

FEATURES = 1 << 15
ORDERS = 3
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 600, 12_000
#: Languages that are learned at most.
MOST_LANGUAGES = 4_096
UNDETERMINED = "und"

_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def _letters() -> np.ndarray:
    """For each code point of the first two planes its lower-case letter, 0 if it is none."""
    table = np.zeros(0x20000, dtype=np.uint32)
    for cp in range(0x20000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def grams(text: str | None) -> np.ndarray:
    """The hashed n-grams of a text, one for each place and order; empty without letters."""
    table = resident(("language",), _letters)
    cp = np.frombuffer((text or "").encode("utf-32-le"), dtype=np.uint32)
    a = table[np.minimum(cp, 0x1FFFF)]
    if cp.size and int(cp.max()) > 0x1FFFF:
        far = cp > 0x1FFFF
        every, back = np.unique(cp[far], return_inverse=True)
        a[far] = np.array([c if chr(c).isalpha() else 0 for c in every.tolist()], dtype=np.uint32)[back]
    if not a.any():
        return np.empty(0, dtype=np.intp)
    a = np.concatenate([[0], a, [0]]).astype(np.uint32)
    a = a[np.concatenate([[True], (a[1:] != 0) | (a[:-1] != 0)])]
    found, h = [], np.zeros(len(a), dtype=np.uint32)
    for k in range(ORDERS):
        n = len(a) - k
        if n <= 0:
            break
        h = (h[:n] ^ a[k : k + n]) * _MULT[k]
        h ^= h >> np.uint32(15)
        found.append((h * np.uint32(0x2C1B3C6D)) >> np.uint32(17))
    return np.concatenate(found).astype(np.intp)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, how often each is there)."""
    g = grams(text)
    if not g.size:
        return g, np.empty(0, dtype=np.int64)
    n = np.bincount(g, minlength=FEATURES)
    at = np.flatnonzero(n)
    return at, n[at]


def vector(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(n)) * idf[at]
    return (x / max(np.sqrt(x @ x), 1e-12)).astype(np.float32)


@dataclass(frozen=True)
class Sparse:
    """Rows of a matrix, each as the columns that aren't zero and their values."""

    ends: np.ndarray  # of each row, after a zero
    column: np.ndarray
    value: np.ndarray
    columns: int

    @staticmethod
    def of(dense: np.ndarray) -> Sparse:
        row, column = np.nonzero(dense)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(dense)))])
        return Sparse(ends, column.astype(np.int32), dense[row, column].astype(np.float32), dense.shape[1])

    def sums(self, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        """x @ self[rows]"""
        first, n = self.ends[rows], self.ends[rows + 1] - self.ends[rows]
        places = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.column[places], weights=np.repeat(x, n) * self.value[places], minlength=self.columns)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: Sparse  # features + 1 (bias), languages
    idf: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.weights.sums(np.append(at, len(self.idf)), np.append(vector(at, n, self.idf), np.float32(1)))

    def predict(self, text: str | None) -> tuple[str, float]:
        at, n = counted(text)
        if not at.size or not self.languages:
            return UNDETERMINED, 0.0
        p = softmax(self.logits(at, n) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], languages: int, features: int = FEATURES, epochs: int = 4,
    alpha: float = 0.8, beta: float = 1.0, l1: float = 0.02, l2: float = 0.002, seed: int = 11,
) -> np.ndarray:
    """Weights by follow-the-regularised-leader, one example at a time. rows: features, values, class."""
    z = np.zeros((features + 1, languages), dtype=np.float32)
    s = np.zeros_like(z)
    rng = np.random.default_rng(seed)

    def weights(zs: np.ndarray, ss: np.ndarray) -> np.ndarray:
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ss)) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0, w)

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, k = rows[i]
            at, x = np.append(at, features), np.append(x, np.float32(1))
            zs, ss = z[at], s[at]
            w = weights(zs, ss)
            p = softmax(x @ w)
            p[k] -= 1
            g = x[:, None] * p[None, :]
            step = (np.sqrt(ss + g * g) - np.sqrt(ss)) / alpha
            z[at] = zs + g - step * w
            s[at] = ss + g * g
    return weights(z, s)


def fit_temperature(logits: np.ndarray, k: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search over its logarithm."""
    if not len(k):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.log(np.maximum(softmax(logits / math.exp(t))[np.arange(len(k)), k], 1e-12)).mean())

    low, high, ratio = math.log(0.5), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(doc_id.cast("string")) % by


def _document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Documents, and documents with each feature. What is collected has FEATURES rows at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(FEATURES + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                g = grams(text.as_py())
                n[np.flatnonzero(np.bincount(g, minlength=FEATURES))] += 1
                n[-1] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(at, pa.int64()), "n": pa.array(n[at], pa.int64())})

    rows = text_batches(texts).mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(FEATURES + 1, dtype=np.int64)
    for r in rows:
        n[r["feature"]] = r["n"]
    return int(n[-1]), n[:-1]


def fit(learn: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, most: int = SAMPLE_ROWS, most_languages: int = MOST_LANGUAGES) -> Model:
    """learn: doc_id, text, lang of the documents that may be learned from."""
    labelled = learn.where(F.col("lang").isNotNull())
    total, df = _document_frequencies(labelled.select("text"))
    idf = np.log((1.0 + total) / (1.0 + np.minimum(df, total))).astype(np.float32) + np.float32(1)
    labelled = labelled.withColumn("place", F.xxhash64(F.lit(5).cast("long"), "doc_id", "text") / 2.0**64 + 0.5)
    sizes = written(labelled.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("size"), F.min("place").alias("least")).orderBy(F.desc("size"), "of").limit(most_languages), "languages")
    languages = tuple(sorted(r["of"] for r in sizes.select("of").collect()))
    if not languages:
        discard(sizes)
        return Model((), Sparse.of(np.zeros((len(idf) + 1, 0), np.float32)), idf, 1.0)
    per_language = max(1, min(per_language, most // len(languages)))
    sample = labelled.join(F.broadcast(sizes), F.col("lang") == F.col("of")).where((F.col("place") < per_language / F.col("size")) | (F.col("place") == F.col("least")))
    sample = sample.select("doc_id", "text", "lang", "place").dropDuplicates(["doc_id", "lang", "place"])  # equal rows once, so the sample keeps its bound

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [counted(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "lang": batch.column(2), "place": batch.column(3),
                "at": pa.array([a.astype(np.int32) for a, _ in out], pa.list_(pa.int32())), "n": pa.array([n.astype(np.int32) for _, n in out], pa.list_(pa.int32())),
            })

    got = sample.mapInArrow(features, "doc_id long, lang string, place double, at array<int>, n array<int>").toArrow()
    number, seen, kept, fitted = {x: i for i, x in enumerate(languages)}, np.zeros(len(languages), dtype=int), [], []
    for i in np.lexsort((got["place"].to_numpy(), got["doc_id"].to_numpy())).tolist():
        at = np.array(got["at"][i].values, dtype=np.int32)
        if at.size:
            k = number[got["lang"][i].as_py()]
            seen[k] += 1
            (fitted if seen[k] % 5 else kept).append((at, vector(at, np.array(got["n"][i].values), idf), k))
    del got
    weights = Sparse.of(fit_ftrl(fitted, len(languages), len(idf)))
    logits = np.array([weights.sums(np.append(at, len(idf)), np.append(x, np.float32(1))) for at, x, _ in kept], dtype=np.float64).reshape(-1, len(languages))
    out = Model(languages, weights, idf, fit_temperature(logits, np.array([k for _, _, k in kept], dtype=int)))
    discard(sizes)
    give_back()
    return out


def predict(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score for every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # weights that aren't zero, of FEATURES x MOST_LANGUAGES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({key: batch.column(0), "lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([y for _, y in found], pa.float64())})

    return text_batches(docs.select(key, "text")).mapInArrow(run, f"{key} long, lang_pred string, score double")


def learnable(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    return pick(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & (remainder(F.col("doc_id"), folds) != held_out))


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the documents outside the held-out fold."""
    found = predict(pick(docs, "doc_id", "text"), fit(learnable(docs, folds, held_out)))
    out = F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def in_languages(docs: DataFrame, model: Model, least_score: float) -> DataFrame:
    """The rows of docs whose language is told, with at least this score."""
    c, sent = Carried(docs), docs.sparkSession.sparkContext.broadcast(model)
    place = c.place("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            found = [m.predict(t.as_py()) for t in pc.struct_field(batch.column(0), place)]
            yield batch.filter(pa.array([x != UNDETERMINED and y >= least_score for x, y in found], pa.bool_()))

    return c.restored(text_batches(c.rows).mapInArrow(run, c.rows.schema))
