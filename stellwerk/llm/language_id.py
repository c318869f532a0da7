"""Language of a text by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are n-grams of one to three characters of the lower-case text in which every run of characters
other than letters is one space; they are hashed to 65,536 buckets. A bucket's value is its share of the
text's n-grams times its inverse document frequency, which counts all training documents. Weights come from
the follow-the-regularised-leader rule with L1 and L2 penalties, on a bounded sample of the training
documents; on every fifth of these a temperature is fitted, so that scores are probabilities.

``fit`` bounds: about ``per_language`` documents (1,000) of each language, drawn by a hash of doc_id; every language is learned. Everything else covers all rows and whole texts.

A text that is null or has no letter is ``und`` with score 0. Training rows without text or language are left
out; without any training row every text is ``und``. A null doc_id counts as empty text for the split.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stellwerk.llm import columnar

BITS = 16
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
UNKNOWN = "und"
LEAST_SCORE = 0.5

# FTRL: step size, smoothing, L1 and L2 penalty, passes over the sample, scale of the features.
ALPHA, BETA, L1, L2, EPOCHS, SCALE = 0.3, 1.0, 0.05, 0.5, 5, 20.0

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def ngrams(texts: list[str | None]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the buckets of all n-grams and the row bounds among them; and which rows have a letter."""
    low = [" " + (t or "").lower() + " " for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.append(0, np.cumsum(np.fromiter(map(len, low), np.int64, len(low))))
    letter = letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after a letter
    keep[bounds[:-1]] = True  # and one at the start
    has = np.add.reduceat(letter, bounds[:-1], dtype=np.int64) > 0 if len(texts) else np.empty(0, bool)
    kept = np.append(0, np.cumsum(keep))
    points = np.where(letter, points, np.uint32(32))[keep]
    bounds = kept[bounds]
    found = []
    value = np.zeros(len(points), np.uint32)
    for n in ORDERS:
        value = value[: len(points) - n + 1] if n > 1 else value
        value = (value ^ points[n - 1 :]) * _MULTIPLIERS[n - 1]
        value ^= value >> np.uint32(15)
        bucket = ((value * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)).astype(np.int32)
        found.append((bucket, bounds))
    return found, has


def rows_of(found: list[tuple[np.ndarray, np.ndarray]], i: int) -> np.ndarray:
    """All buckets of one row."""
    return np.concatenate([b[bounds[i] : max(bounds[i], bounds[i + 1] - n + 1)] for n, (b, bounds) in zip(ORDERS, found)])


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, inverse document frequency and temperature included
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found, has = ngrams(texts)
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages or not len(texts):
            return names, scores
        sums, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for n, (buckets, bounds) in zip(ORDERS, found):
            lengths = np.maximum(bounds[1:] - bounds[:-1] - n + 1, 0)
            for c in range(len(self.languages)):
                running = np.append(0.0, np.cumsum(self.weights[:, c][buckets], dtype=np.float64))
                sums[:, c] += running[bounds[:-1] + lengths] - running[np.minimum(bounds[:-1], len(running) - 1)]
            total += lengths
        logits = sums / np.maximum(total, 1)[:, None] + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for i in np.flatnonzero(has):
            names[i], scores[i] = self.languages[best[i]], p[i, best[i]]
        return names, scores


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _document_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, rows = np.zeros(BUCKETS, np.int64), 0
    for batch in columnar.sliced(batches, "text"):
        found, _ = ngrams(batch.column("text").to_pylist())
        for i in range(batch.num_rows):
            seen = np.zeros(BUCKETS, bool)
            seen[rows_of(found, i)] = True
            counts += seen
        rows += batch.num_rows
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(counts[used], rows))], names=["bucket", "n"])


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in columnar.sliced(batches, "text"):
        found, _ = ngrams(batch.column("text").to_pylist())
        buckets, shares = [], []
        for i in range(batch.num_rows):
            ids, n = np.unique(rows_of(found, i), return_counts=True)
            buckets.append(ids.astype(np.uint16).tobytes())
            shares.append((n / n.sum()).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("place"), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())],
            names=["lang", "place", "buckets", "shares"],
        )


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of rows of (buckets, values, class)."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            buckets, values, label = rows[k]
            at, x = np.append(buckets, BUCKETS), np.append(values, 1.0)
            w = weights(at)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    all_weights = weights(np.arange(BUCKETS + 1))
    return all_weights[:-1], all_weights[-1]


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the smallest loss; 1 without rows."""
    if not len(labels):
        return 1.0

    def loss(t):
        scaled = logits / t
        scaled = scaled - scaled.max(axis=1, keepdims=True)
        return (np.log(np.exp(scaled).sum(axis=1)) - scaled[np.arange(len(labels)), labels]).mean()

    return min(np.geomspace(0.05, 5, 201), key=loss)


def fit(docs: DataFrame, per_language: int = 1000) -> Model:
    """Learn from ``text`` and ``lang`` of the rows that are not held out.

    Every non-null value of ``lang`` is a class, so the model grows with their number. Without any the model is empty.
    """
    rows = docs.where(~held_out(F.col("doc_id"))).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("string")).alias("place"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    counted = rows.select("text").mapInArrow(_document_counts, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = {r.bucket: r.n for r in counted}
    idf = np.full(BUCKETS, np.log(1.0 + counts[-1]) + 1.0)
    for bucket, n in counts.items():
        if bucket >= 0:
            idf[bucket] = np.log((1.0 + counts[-1]) / (1.0 + n)) + 1.0
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, per_language / n))])
    drawn = rows.where(F.shiftrightunsigned("place", 11) < F.coalesce(F.element_at(share, F.col("lang")), F.lit(0.0)) * float(1 << 53))
    sample = sorted(drawn.mapInArrow(_features, "lang string, place bigint, buckets binary, shares binary").collect(), key=lambda r: (r.lang, r.place, r.buckets))
    names = sorted({r.lang for r in sample})
    data = []
    for r in sample:
        ids = np.frombuffer(r.buckets, np.uint16).astype(np.int64)
        data.append((ids, np.frombuffer(r.shares, np.float32) * idf[ids] * SCALE, names.index(r.lang)))
    weights, bias = ftrl([d for i, d in enumerate(data) if i % 5], len(names))
    check = [d for i, d in enumerate(data) if i % 5 == 0]
    logits = np.array([x @ weights[ids] + bias for ids, x, _ in check]).reshape(len(check), len(names))
    t = _temperature(logits, np.array([label for _, _, label in check], int))
    return Model(names, (weights * idf[:, None] * SCALE / t).astype(np.float32), bias / t)


def _predictions(shared):
    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in columnar.sliced(batches, "text"):
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(names), pa.array(scores)],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    return predict


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """A struct ``row`` with the columns of ``docs``, ``lang_pred`` and ``score`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(docs.columns))]
    marked = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], F.col("text").cast("string").alias("text"))
    schema = T.StructType(
        [T.StructField(n, f.dataType) for n, f in zip(names, docs.schema)] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    row = F.struct(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
    return marked.mapInArrow(_predictions(shared), schema).select(row.alias("row"), "lang_pred", "score")


def known_language(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents whose language is recognised with a score of ``least`` or more.

    Where no row tells a language there is nothing to recognise: then all documents with a letter stay.
    """
    model = fit(docs)
    if not model.languages:
        return docs.where(F.col("text").cast("string").rlike("\\p{L}"))
    found = identify(docs, model)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
