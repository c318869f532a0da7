"""Severity of toxic language by cumulative-link ordinal regression.

Features of a text are the words it holds, in small letters, and the first four, five and seven bytes of longer
words, each hashed to 262,144 buckets; a bucket counts once per text. One weight vector is shared by all thresholds: the
probability of a grade above j is sigmoid(x * w - threshold j), with rising thresholds. The model yields the
probability of each grade and the expected severity, the sum of those probabilities over the thresholds.

Labels only say toxic or not. Grade 0 is not toxic; toxic texts are graded 1 to 3 by terciles of the share of
their words that mark toxic texts in the training sample (found in five toxic texts at least, and in those
nine times in ten).

``fit`` bounds: about ``per_class`` (3,000) labelled documents of each class, drawn by a hash of doc_id.
Scores cover whole texts. Null and empty texts have no features: severity is that of the thresholds alone.
Without labels of both classes every severity is 0. Rows with equal doc_id are scored each on its own; labels
that contradict one another for one doc_id count as toxic.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellwerk.llm import columnar

BUCKETS = 1 << 18
PREFIXES = (4, 5, 7)
GRADES = 4
# Texts count as toxic from this probability of any severity: on labelled documents that were not trained
# on it finds 98 % of the toxic ones and 0.2 % of the others.
TOXIC = 0.15
# Gradient steps, L1 penalty of the first fit, L2 penalty, and how much faster thresholds move than weights.
STEPS, L1, L2, LEVER = 200, 2e-3, 1e-5, 10.0


def features(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text its distinct buckets, and the bucket of each of its words."""
    data, offsets = columnar.utf8(texts)
    data = columnar.LOWER[data]
    starts, ends, rows = columnar.words(data, offsets)
    # Marks at the edges of a word don't belong to it.
    letter = (data >= 128) | ((data >= ord("a")) & (data <= ord("z"))) | ((data >= ord("0")) & (data <= ord("9")))
    if len(starts):
        places = np.flatnonzero(letter)
        if len(places):
            first = places[np.minimum(np.searchsorted(places, starts), len(places) - 1)]
            last = places[np.maximum(np.searchsorted(places, ends) - 1, 0)] + 1
            inside = (first >= starts) & (first < ends) & (last > first)
        else:
            first, last, inside = starts, ends, np.zeros(len(starts), bool)
        starts, ends, rows = first[inside], last[inside], rows[inside]
    words = (columnar.span_hashes(data, starts, ends) & np.uint64(BUCKETS - 1)).astype(np.int64)
    all_rows, values = [rows], [words]
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts > n)
        stems = columnar.span_hashes(data, starts[long], starts[long] + n) * np.uint64(0x9E3779B97F4A7C15)
        values.append((stems >> np.uint64(46)).astype(np.int64))
        all_rows.append(rows[long])
    pairs = np.unique(np.concatenate(all_rows) * BUCKETS + np.concatenate(values))
    edges = np.searchsorted(pairs, np.arange(len(offsets)) * BUCKETS)
    found = [pairs[a:b] % BUCKETS for a, b in zip(edges[:-1], edges[1:])]
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    own = [words[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    return found, own


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return (np.concatenate(rows) if rows else np.empty(0, np.int32)), np.repeat(np.arange(len(rows), dtype=np.int32), sizes)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # rising; empty for a model without labels

    def above(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probability of a grade above each threshold, a line per row."""
        buckets, row = _flat(rows)
        score = np.bincount(row, self.weights[buckets], len(rows))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def train(rows: list[np.ndarray], grades: np.ndarray) -> Model:
    """The L1 penalty picks the features; their weights are then fitted without it, which would shrink them."""
    picked = _steps(rows, grades, L1).weights != 0
    return _steps([r[picked[r]] for r in rows], grades, 0.0)


def _steps(rows: list[np.ndarray], grades: np.ndarray, l1: float) -> Model:
    """Accelerated proximal gradient steps; a bound of the curvature gives each weight a step size of its own."""
    buckets, row = _flat(rows)
    used = np.flatnonzero(np.bincount(buckets, minlength=BUCKETS))
    place = np.searchsorted(used, buckets).astype(np.int32)
    n, cuts = len(rows), GRADES - 1
    target = (grades[:, None] > np.arange(cuts)[None, :]).astype(float)
    size = np.bincount(row, minlength=n) + LEVER
    curve_w = np.bincount(place, (0.25 * cuts * size / n)[row], len(used)) + L2
    curve_t = 0.25 * LEVER * size.mean()
    w, t = np.zeros(len(used)), np.sort(np.log((1 - target.mean(axis=0)) / np.maximum(target.mean(axis=0), 1e-6))) / LEVER
    w_ahead, t_ahead, momentum = w, t, 1.0
    for _ in range(STEPS):
        score = np.bincount(row, w_ahead[place], n)
        p = 1 / (1 + np.exp(np.clip(LEVER * t_ahead[None, :] - score[:, None], -50, 50)))
        error = (p - target) / n
        g = np.bincount(place, error.sum(axis=1)[row], len(used)) + L2 * w_ahead
        new_w = w_ahead - g / curve_w
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - l1 / curve_w, 0)
        new_t = np.maximum.accumulate(t_ahead + LEVER * error.sum(axis=0) / curve_t)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        push = (momentum - 1) / following
        w_ahead, t_ahead = new_w + push * (new_w - w), np.maximum.accumulate(new_t + push * (new_t - t))
        w, t, momentum = new_w, new_t, following
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return Model(weights, LEVER * t)


def grade(toxic: np.ndarray, rows: list[np.ndarray], words: list[np.ndarray]) -> np.ndarray:
    """Severity grades of labelled texts: 0, and terciles of the share of marking words among toxic ones."""
    all_counts = np.bincount(_flat(rows)[0], minlength=BUCKETS)
    counts = np.bincount(_flat([r for r, t in zip(rows, toxic) if t])[0], minlength=BUCKETS)
    marking = (counts >= 5) & (counts >= 0.9 * all_counts)
    shares = np.array([marking[w].mean() if len(w) else 0.0 for w in words])
    cuts = np.quantile(shares[toxic], [1 / 3, 2 / 3])
    return np.where(toxic, 1 + (shares[:, None] > cuts[None, :]).sum(axis=1), 0)


def _labelled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in columnar.sliced(batches, "text"):
        found, own = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), *(pa.array([x.astype(np.int32).tobytes() for x in rows], pa.binary()) for rows in (found, own))],
            names=["doc_id", "toxic", "found", "own"],
        )


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> Model:
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    sizes = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(np.zeros(BUCKETS), np.empty(0))
    share = F.when(F.col("toxic") == 1, F.lit(per_class / sizes[1])).otherwise(F.lit(per_class / sizes[0]))
    drawn = marks.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < F.least(share, F.lit(1.0)) * float(1 << 53))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Some 6,000 ids at most.
    rows = texts.join(F.broadcast(drawn), "doc_id").mapInArrow(_labelled, "doc_id bigint, toxic int, found binary, own binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.found))
    toxic = np.array([r.toxic == 1 for r in rows], bool)
    if toxic.all() or not toxic.any():
        return Model(np.zeros(BUCKETS), np.empty(0))
    found, own = ([np.frombuffer(r[c], np.int32) for r in rows] for c in ("found", "own"))
    return train(found, grade(toxic, found, own))


def _scores(shared):
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in columnar.sliced(batches, "text"):
            if len(model.thresholds):
                above = model.above(features(batch.column("text"))[0])
            else:
                above = np.zeros((batch.num_rows, GRADES - 1))
            edges = np.hstack([np.ones((len(above), 1)), above, np.zeros((len(above), 1))])
            grades = edges[:, :-1] - edges[:, 1:]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(above.sum(axis=1)),
                    pa.array(grades.argmax(axis=1), pa.int32()),
                    pa.array(list(grades), pa.list_(pa.float64())),
                    pa.array(above[:, 0] >= TOXIC),
                ],
                names=["doc_id", "severity", "grade", "grade_probabilities", "toxic"],
            )

    return score


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, severity, grade, grade_probabilities, toxic`` for every row of ``doc_id, text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scores(shared), "doc_id bigint, severity double, grade int, grade_probabilities array<double>, toxic boolean")
