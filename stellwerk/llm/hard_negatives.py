"""Hard negatives of anchors by Fagin's threshold algorithm on exact integer scores.

Each row is an id, a label and a vector; components become ``floor(scale * x)``. A row's score for an anchor is their
integer inner product; higher scores come first, ties by smaller id. An anchor's positives are its first ``positives``
other rows of the same label. For each positive, the window of scores from ``low`` to ``high`` per cent of the
positive's score is searched for the first ``negatives`` rows of another label.

Rows are dealt to blocks of bounded size, anchors to chunks of bounded size, and a task gets one block and one chunk.
For each dimension it sorts the block's rows by that component. An anchor walks all lists at once, from the large end
where its own component is positive and from the small end where it is negative (sorted access); rows met are scored
in full (random access). The lists' current values give the highest score that an unseen row can reach,
the threshold; the walk ends when it falls strictly below the last wanted score of each window, or, while a window
holds too few rows, below its floor. (Strictly: an unseen row of the same score could have a smaller id.) Blocks
return their first rows of each window, and the first of these over all blocks are the result. Positives take one
such pass over all rows, negatives another, whose windows then hold for all blocks.

Work is a product of anchors and rows, as the task asks (each anchor against all rows); memory is that of a block.
No pair is formed beyond the rows that a walk meets.

Rows with a null label, a null vector, or a null or non-finite component take no part. Vectors shorter than others are
filled with zeros; empty ones score 0. A null id comes last in ties and stays null. Rows that share an id, or are equal
in everything, are rows of their own; as anchors each has its own result. Components beyond 64 bits saturate, and so do
scores. Fewer candidates than wanted give fewer rows, none give none; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stellwerk.llm.columnar import stored

# Components of a block: at least, at most; anchors of a chunk.
BLOCK = (1 << 19, 1 << 22)
BLOCKS = 64
CHUNK = 4096
FIRST_DEPTH = 32
# Stands for a null id inside the operator, so that it comes last.
NO_ID = (1 << 63) - 1
_MOST = (1 << 63) - 1

_FOUND = "anchor bigint, anchor_id bigint, place int, wanted_id bigint, wanted_score bigint, id bigint, score bigint, number bigint"


def prepared(rows: DataFrame, anchors: Column, scale: int = 256) -> DataFrame:
    """``number, id, label, vector, is_anchor`` of the rows that take part, written once."""
    vector = F.col("embedding")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return stored(
        rows.where(F.col("label").isNotNull() & vector.isNotNull() & finite).select(
            F.monotonically_increasing_id().alias("number"),
            F.coalesce(F.col("vec_id").cast("bigint"), F.lit(NO_ID)).alias("id"),
            F.col("label").cast("string").alias("label"),
            F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("vector"),
            F.coalesce(anchors, F.lit(False)).alias("is_anchor"),
        ),
        "vectors",
    )


def _matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Vectors as rows of one length: the longest, or the given one."""
    column = column.combine_chunks()
    column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    offsets, values = np.asarray(column.offsets), np.asarray(column.values)
    sizes = np.diff(offsets)
    wide = int(sizes.max()) if width is None and len(sizes) else width or 0
    inside = np.arange(wide) < sizes[:, None]
    out = np.zeros((len(sizes), wide), np.int64)
    out[inside] = values[(offsets[:-1, None] + np.arange(wide))[inside]] if wide else 0
    return out


def _bound(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


class Lists:
    """A block's rows, and for each dimension their order by that component."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)

    def walk(self, q: np.ndarray, fits: np.ndarray, lows: list[int], highs: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores met that can be among the first ``k`` fitting rows of some window."""
        n = len(self.vectors)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        if not len(up) and not len(down):
            rows = np.flatnonzero(fits)
            return rows, np.zeros(len(rows), self.vectors.dtype)
        seen = np.zeros(n, bool)
        rows, scores = np.empty(0, np.int64), np.empty(0, self.vectors.dtype)
        depth = 0
        while depth < n:
            stop = min(n, max(FIRST_DEPTH, 2 * depth))
            met = np.zeros(n, bool)
            met[self.order[n - stop : n - depth, up]] = True
            met[self.order[depth:stop, down]] = True
            fresh = np.flatnonzero(met & ~seen & fits)
            seen |= met
            values = self.vectors[fresh] @ q
            useful = (values >= min(lows)) & (values <= max(highs))
            rows, scores = np.append(rows, fresh[useful]), np.append(scores, values[useful])
            threshold = self.sorted[n - stop, up] @ q[up] + self.sorted[stop - 1, down] @ q[down]
            depth = stop
            if all(threshold < self._last(scores, low, high, k) for low, high in zip(lows, highs)):
                break
        return rows, scores

    @staticmethod
    def _last(scores: np.ndarray, low: int, high: int, k: int) -> int:
        """The window's kth score so far, or its floor."""
        inside = scores[(scores >= low) & (scores <= high)]
        return low if len(inside) < k else np.partition(inside, len(inside) - k)[len(inside) - k]


def _search(k: int, same: bool, low: int, high: int):
    """Search one block for one chunk of anchors: rows of the same label, or windows of rows of other labels."""

    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            vectors = _matrix(rows["vector"])
            queries = _matrix(anchors["a_vector"], vectors.shape[1])
            if _bound(vectors) * _bound(queries) * max(vectors.shape[1], 1) * max(high, 100) >= _MOST:
                vectors, queries = vectors.astype(object), queries.astype(object)  # whole numbers of any size
            ids, numbers = rows["id"].to_numpy(), rows["number"].to_numpy()
            names, labels = np.unique(np.array(rows["label"].to_pylist() + anchors["a_label"].to_pylist()), return_inverse=True)
            own, theirs = labels[: len(ids)], labels[len(ids) :]
            lists = Lists(vectors)
            for i, (number, at, wanted) in enumerate(zip(anchors["a_number"].to_pylist(), anchors["a_id"].to_pylist(), anchors["a_wanted"].to_pylist())):
                if same:
                    fits, windows = (own == theirs[i]) & (numbers != number), [(-_MOST, _MOST)]
                else:
                    fits = own != theirs[i]
                    windows = [(-(-low * w["score"] // 100), high * w["score"] // 100) for w in wanted]
                met, scores = lists.walk(queries[i], fits, *map(list, zip(*windows)), k)
                for place, (least, most) in enumerate(windows):
                    inside = np.flatnonzero((scores >= least) & (scores <= most))
                    for j in inside[np.lexsort((numbers[met[inside]], ids[met[inside]], -scores[inside]))][:k]:
                        w = wanted[place] if wanted else {"id": None, "score": None}
                        score = min(max(int(scores[j]), -_MOST), _MOST)
                        found.append((number, at, place, w["id"], w["score"], int(ids[met[j]]), score, int(numbers[met[j]])))
        names = [part.split()[0] for part in _FOUND.split(", ")]
        kinds = [pa.int32() if n == "place" else pa.int64() for n in names]
        columns = list(zip(*found)) or [()] * len(names)
        return pa.table({n: pa.array(c, kind) for n, c, kind in zip(names, columns, kinds)})

    return search


def _first(rows: DataFrame, anchors: DataFrame, blocks: int, chunks: int, k: int, same: bool, low: int, high: int) -> DataFrame:
    """The first ``k`` rows of each anchor and window over all blocks, with ``rank``."""
    block, chunk = (F.pmod(F.xxhash64("number"), F.lit(n)) for n in (blocks, chunks))
    every_block, every_chunk = (F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))) for n in (blocks, chunks))
    left = rows.withColumn("block", block).withColumn("chunk", every_chunk)
    # Columns of their own names: both sides come from one table.
    right = anchors.select(chunk.alias("of_chunk"), every_block.alias("of_block"), *[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    found = (
        left.groupBy("block", "chunk")
        .cogroup(right.groupBy("of_block", "of_chunk"))
        .applyInArrow(_search(k, same, low, high), _FOUND)
    )
    ranking = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id", "number")
    return found.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``vec_id, label, embedding``.

    ``anchors`` is the condition that makes a row an anchor.
    """
    rows = prepared(rows, anchors, scale)
    n, n_anchors, width = rows.agg(
        F.count("*"), F.count_if("is_anchor"), F.coalesce(F.max(F.size("vector")), F.lit(1))
    ).first()
    width = max(width, 1)
    per_block = min(max(n // BLOCKS, BLOCK[0] // width, 1), max(BLOCK[1] // width, 1))
    size = (max(1, -(-n // per_block)), max(1, -(-n_anchors // CHUNK)))
    none = F.lit(None).cast("array<struct<id: bigint, score: bigint>>")
    candidates = rows.select("number", "id", "label", "vector")
    searched = candidates.where(rows["is_anchor"]).withColumn("wanted", none)
    nearest = _first(candidates, searched, *size, positives, True, low, high)
    best = F.array_sort(F.collect_list(F.struct("rank", "id", "score")))
    wanted = nearest.groupBy(F.col("anchor").alias("number")).agg(F.transform(best, lambda b: F.struct(b["id"].alias("id"), b["score"].alias("score"))).alias("wanted"))
    windows = stored(searched.drop("wanted").join(wanted, "number"), "windows")
    found = _first(candidates, windows, *size, negatives, False, low, high)
    back = {c: F.nullif(c, F.lit(NO_ID)) for c in ("anchor_id", "wanted_id", "id")}
    return found.select(
        back["anchor_id"].alias("anchor_id"),
        back["wanted_id"].alias("positive_id"),
        "rank",
        back["id"].alias("negative_id"),
        F.col("wanted_score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
