"""Passages that repeat across documents, found by hashing runs of consecutive sentences.

A sentence ends after ``.``, ``!`` or ``?`` before white space, after the full-width forms of these, and at a
line feed. From each sentence starts a run: the fewest sentences, three at least, that hold 12 words; and one
or two sentences that hold 40 words are runs as well, so that long sentences need no third one. Runs are
compared by their words in small letters (A-Z), whatever white space lies between.

A run that occurs more than once stays where it occurs first: in the document with the smallest doc_id, and
there at its first place. Sentences covered by any other occurrence are removed.

Runs are hashed to 96 bits on the executors, once for each document; the join finds the smallest doc_id for
each hash (minima are taken before the shuffle, so a passage in a third of all documents costs one row per
task) and returns to each document the hashes that occur in an earlier one. No pair of documents is formed.

Null text stays null. Every row with a null doc_id is a document of its own, after all others. Rows that share
both doc_id and text are one document, recorded more than once: they don't remove each other's runs; rows that
share the doc_id alone are different documents, in the order of a hash of their texts. Texts without a repeated run are returned byte for byte; in
others, white space around removed sentences shrinks to what stood before them or to one line feed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stellwerk.llm import columnar
from stellwerk.llm.columnar import stored

SENTENCES = 3
WORDS = 12
LONG_WORDS = 40
# Stands for a null doc_id inside the operator.
NO_ID = (1 << 63) - 1
_OTHER = np.uint64(0xA0761D6478BD642F)

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
# UTF-8 of the full-width full stop, exclamation mark and question mark.
_WIDE = [(0xE3, 0x80, 0x82), (0xEF, 0xBC, 0x81), (0xEF, 0xBC, 0x9F)]


class Runs:
    """Sentences and runs of the texts of one batch slice."""

    def __init__(self, texts: pa.Array):
        data, offsets = columnar.utf8(texts)
        self.data, self.offsets = data, offsets
        starts, ends, rows = columnar.words(data, offsets)
        n = len(starts)
        # A word opens a sentence if it is the first of its text, or a stop or line feed lies before it.
        opens = np.ones(n, bool)
        if n:
            feeds = np.append(0, np.cumsum(data == 10))
            last = ends[:-1] - 1
            stop = _STOP[data[last]]
            for a, b, c in _WIDE:
                stop |= (data[last] == c) & (data[np.maximum(last - 1, 0)] == b) & (data[np.maximum(last - 2, 0)] == a)
            opens[1:] = stop | (rows[1:] != rows[:-1]) | (feeds[starts[1:]] > feeds[ends[:-1]])
        first = np.flatnonzero(opens)  # first word of each sentence
        stops = np.append(first[1:], n)
        self.sentence_row = rows[first]
        self.sentence_start = starts[first]
        hashes = columnar.span_hashes(columnar.LOWER[data], starts, ends)
        up, down = columnar.powers(n + 1)
        sums = np.append(np.uint64(0), np.cumsum(hashes * up[:n], dtype=np.uint64))
        # Runs: first and last sentence.
        i = np.arange(len(first))
        row_end = np.searchsorted(self.sentence_row, self.sentence_row, side="right")  # sentence after the row's last
        enough = np.searchsorted(stops, first + WORDS)  # the sentence in which the count is reached
        begin, end = [i], [np.maximum(i + SENTENCES - 1, enough)]
        for k in range(SENTENCES - 1):
            long = np.flatnonzero(stops[np.minimum(i + k, len(i) - 1)] - first >= LONG_WORDS) if len(i) else i
            begin.append(long)
            end.append(long + k)
        begin, end = np.concatenate(begin), np.concatenate(end)
        inside = end < row_end[begin] if len(begin) else np.empty(0, bool)
        self.begin, self.end = begin[inside], end[inside]
        a, b = first[self.begin], stops[self.end] if len(first) else self.end
        self.row = self.sentence_row[self.begin]
        self.hash = columnar.mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)).view(np.int64)
        # Half a second hash, of other values of the words: across the corpus, runs are equal if both are.
        others = np.append(np.uint64(0), np.cumsum(columnar.mix(hashes ^ _OTHER) * up[:n], dtype=np.uint64))
        self.check = (columnar.mix((others[b] - others[a]) * down[a] + (b - a).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        # Runs that have stood before in the same text.
        order = np.lexsort((self.begin, self.hash, self.row))
        same = (self.hash[order][1:] == self.hash[order][:-1]) & (self.row[order][1:] == self.row[order][:-1])
        self.again = np.zeros(len(order), bool)
        self.again[order[1:]] = same

    def removed(self, runs: np.ndarray) -> np.ndarray:
        """Sentences covered by the given runs."""
        edges = np.zeros(len(self.sentence_start) + 1, np.int64)
        np.add.at(edges, self.begin[runs], 1)
        np.add.at(edges, self.end[runs] + 1, -1)
        return np.cumsum(edges[:-1]) > 0


def _run_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in columnar.sliced(batches, "text"):
        runs = Runs(batch.column("text"))
        new = np.flatnonzero(~runs.again)
        ids = [pa.array(batch.column(c).to_numpy()[runs.row[new]]) for c in ("doc_id", "part")]
        yield pa.RecordBatch.from_arrays([pa.array(runs.hash[new]), pa.array(runs.check[new]), *ids], names=["run", "check", "doc_id", "part"])


def _rebuilt(raw: bytes, starts: np.ndarray, end: int, removed: np.ndarray) -> bytes:
    """The text without the removed sentences, each taken with the white space after it."""
    out = [raw[: starts[0]]]
    for start, stop, gone in zip(starts.tolist(), [*starts[1:].tolist(), end], removed.tolist()):
        part = raw[start:stop]
        if not gone:
            out.append(part)
        elif part.endswith(b"\n") and out[-1] and not out[-1].endswith(b"\n"):
            out[-1] = out[-1].rstrip(b" \t\r\x0b\x0c") + b"\n"
    return b"".join(out).rstrip()


def _cleaned(text_at: int):
    """Replace the text column (by position); the last two columns are the hashes to remove and the key."""

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in columnar.sliced(batches, f"c{text_at}"):
            texts = batch.column(text_at)
            runs = Runs(texts)
            hits = batch.column("hits")
            sizes = np.diff(hits.offsets.to_numpy()) if len(hits) else np.empty(0, np.int64)
            sizes = np.where(hits.is_null().to_numpy(zero_copy_only=False), 0, sizes)
            values = hits.flatten().to_numpy().view(np.uint64)
            rows = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64)
            known = columnar.mix(rows + np.uint64(1)) ^ values
            found = np.isin(columnar.mix(runs.row.astype(np.uint64) + np.uint64(1)) ^ runs.hash.view(np.uint64), known)
            removed = runs.removed(np.flatnonzero(found | runs.again))
            counts = np.zeros(batch.num_rows, np.int64)
            np.add.at(counts, runs.sentence_row[removed], 1)
            if counts.any():
                new = texts.to_pylist()
                raw = runs.data.tobytes()
                for i in np.flatnonzero(counts):
                    a, b = np.searchsorted(runs.sentence_row, [i, i + 1])
                    start, end = runs.offsets[i], runs.offsets[i + 1]
                    new[i] = _rebuilt(raw[start:end], runs.sentence_start[a:b] - start, int(end - start), removed[a:b]).decode("utf-8")
                texts = pa.array(new, pa.string())
            columns = [*batch.columns[:-1], pa.array(counts)]
            columns[text_at] = texts
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_removed"])

    return clean


def remove_repeated_passages(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeated passages removed from ``text`` (``n_chars`` follows, where it is a
    column) in a struct ``row``, and ``n_removed``, the number of sentences removed."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text_at, id_at = docs.columns.index("text"), docs.columns.index("doc_id")
    renamed = docs.withColumn("text", F.col("text").cast("string")).select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    id_column, text = F.col(names[id_at]).cast("bigint"), F.col(names[text_at])
    # A document is a doc_id and a part of it: the hash of its text or, without an id, the row's number. Only rows that need
    # a number are written, once, with it.
    known = renamed.where(id_column.isNotNull()).withColumns({"doc_id": id_column, "part": F.xxhash64(text)})
    nameless = renamed.where(id_column.isNull()).withColumns({"doc_id": F.lit(NO_ID), "part": F.monotonically_increasing_id()})
    marked = known.unionByName(stored(nameless, "rows"))
    document = F.struct("doc_id", "part")
    runs = stored(marked.select("doc_id", "part", text.alias("text")).mapInArrow(_run_rows, "run bigint, check int, doc_id bigint, part bigint"), "runs")
    repeated = runs.groupBy("run", "check").agg(F.min(document).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = runs.join(repeated.hint("shuffle_hash"), ["run", "check"]).where(document != F.col("first"))
    hits = later.groupBy("doc_id", "part").agg(F.collect_set("run").alias("hits"))

    # Rows with their texts are not sorted.
    joined = marked.join(hits.hint("shuffle_hash"), ["doc_id", "part"], "left").select(*names, "hits")
    kinds = [T.StructField(n, T.StringType() if i == text_at else docs.schema[i].dataType) for i, n in enumerate(names)]
    schema = T.StructType([*kinds, T.StructField("n_removed", T.LongType())])
    cleaned = joined.mapInArrow(_cleaned(text_at), schema)
    columns = {c: F.col(n) for c, n in zip(docs.columns, names)}
    if "n_chars" in columns:
        length = F.char_length(names[text_at]).cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(columns["n_chars"])
    return cleaned.select(F.struct(*[c.alias(n) for n, c in columns.items()]).alias("row"), "n_removed")
