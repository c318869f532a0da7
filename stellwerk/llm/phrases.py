"""Collocations: phrases of two or three words whose parts meet more often than their own counts suggest.

1. Slices of texts are cut into pieces and words (small letters A-Z) and written once, as numbers into a dictionary of
   the slice, with counts. The dictionaries, summed, give each word's count in its language; words below
   ``least`` occurrences cannot be part of a candidate, the others get dense ids. An id stands for word and language.
2. Each slice gets the ids of its dictionary by a join on words, one row for each word and slice, not for each occurrence,
   so that frequent words are no hot keys.
3. Pairs and triples of ids are packed, permuted and counted in quotient filters (``quotient_filter``). A task merges the
   filters of its slices, cuts them at the first bits of the permuted key, which spread evenly, and each of these
   shards is merged over all tasks. Counts are exact; phrases below ``least`` are left out only then.
4. A candidate's cuts take their counts from words and pairs, all of which are frequent, too. Scores are quotients of whole
   numbers of up to 38 digits. Phrases are ranked within their language by first rows per task, then over all.

Null text is empty, null lang is ``und``. Empty texts and pieces add nothing; repeated rows count as often as they stand
there; ids of documents play no part. An empty table gives no rows. Texts are handled whole; a slice holds about 2 MB
of text or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stellwerk.llm import columnar
from stellwerk.llm import quotient_filter as qf
from stellwerk.llm.columnar import stored
from stellwerk.llm.numbering import numbered

NO_LANG = "und"
SLICE = 2 << 20
# Entries of a task's filter before it is handed on, and of a shard at most, as an average.
ENTRIES = 1 << 19
SHARD = 1 << 19
# Parts of a language that are ranked apart.
PARTS = 64

_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in " \t"]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True

_SLICES = "width int, tokens binary, words array<string>, langs array<string>, counts array<bigint>"
_FILTERS = "length int, shard bigint, size int, quotient int, occupied binary, ends binary, remainders binary, counts binary"
_GRAMS = "length int, w1 bigint, w2 bigint, w3 bigint, a bigint"


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mask of the bytes of words; start, length and row of each word, and whether a piece begins with it."""
    inside = ~(_BLANK | _BREAK)[data]
    bounds = np.unique(offsets[(offsets > 0) & (offsets < len(data))])  # empty texts repeat a bound
    # A word begins or ends where the mask changes, and at the bounds of texts.
    edge = np.append(inside, False)
    edge[1:] ^= inside
    edge[bounds] = inside[bounds] | inside[bounds - 1]
    joined = bounds[inside[bounds] & inside[bounds - 1]]
    places = np.flatnonzero(edge).astype(np.int32)
    if len(joined):  # one word ends and the next one begins there
        places = np.sort(np.append(places, joined.astype(np.int32)))
    starts, ends = places[::2], places[1::2]
    rows = np.searchsorted(offsets, starts, side="right") - 1
    breaks = np.cumsum(_BREAK[data], dtype=np.int32)[starts]
    opens = np.ones(len(starts), bool)
    opens[1:] = (breaks[1:] != breaks[:-1]) | (rows[1:] != rows[:-1])
    return inside, ends - starts, rows, opens


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each slice: its words as places (from 1) in its dictionary, 0 between pieces."""
    for batch in columnar.sliced(batches, "text", SLICE):
        data, offsets = columnar.utf8(batch.column("text"))
        if not len(data):
            continue
        data = columnar.LOWER[data]
        inside, lengths, rows, opens = _pieces(data, offsets)
        if not len(lengths):
            continue
        ends = np.append(0, np.cumsum(lengths, dtype=np.int64))
        spelled = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(data[inside]))
        spelled = spelled.dictionary_encode()
        lang = pc.fill_null(batch.column("lang"), NO_LANG).dictionary_encode()
        n = len(lang.dictionary)
        entry = spelled.indices.to_numpy().astype(np.int64) * n + lang.indices.to_numpy()[rows]
        entries, place, counts = np.unique(entry, return_inverse=True, return_counts=True)
        kind = np.min_scalar_type(len(entries))
        tokens = np.zeros(len(entry) + int(opens.sum()), kind)
        tokens[np.arange(len(entry)) + np.cumsum(opens)] = place + 1
        words, langs = spelled.dictionary.take(pa.array(entries // n)).cast(pa.string()), lang.dictionary.take(pa.array(entries % n))
        columns = [pa.array([kind.itemsize], pa.int32()), pa.array([tokens.tobytes()], pa.binary())]
        for values, element in ((words, pa.string()), (langs, pa.string()), (pa.array(counts), pa.int64())):
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), values.cast(element)))
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SLICES.split(", ")])


def _grams(ids: np.ndarray, length: int, n_ids: int) -> tuple[qf.Keys, np.ndarray]:
    """Permuted keys of all runs of ``length`` ids, with counts; -1 stands between pieces and for rare words."""
    n = max(len(ids) - length + 1, 0)
    parts = [ids[i : i + n] for i in range(length)]
    whole = np.logical_and.reduce([p >= 0 for p in parts])
    half = qf.half_bits(n_ids, length)
    return qf.counted(qf.permuted(qf.packed([p[whole] for p in parts], n_ids), half), half)


class _Counter:
    """A task's counts of runs of one length."""

    def __init__(self, length: int, n_ids: int, shard_bits: int):
        self.length, self.n_ids = length, n_ids
        self.half = qf.half_bits(n_ids, length)
        self.cut = min(shard_bits, self.half)
        self.parts: list[tuple[qf.Keys, np.ndarray]] = []

    def add(self, ids: np.ndarray) -> Iterator[tuple]:
        self.parts.append(_grams(ids, self.length, self.n_ids))
        if sum(len(counts) for _, counts in self.parts) > ENTRIES:
            self._merge()
            if len(self.parts[0][1]) > ENTRIES // 2:
                yield from self.flush()

    def _merge(self) -> None:
        left, right, counts = (np.concatenate(x) for x in zip(*[(*keys, n) for keys, n in self.parts]))
        self.parts = [qf.counted((left, right), self.half, counts)]

    def flush(self) -> Iterator[tuple]:
        """A filter for each shard: the keys that begin with its bits, without them."""
        if not self.parts:
            return
        self._merge()
        ((left, right), counts), = self.parts
        self.parts = []
        rest = self.half - self.cut
        shards = (left >> np.uint64(rest)).astype(np.int64)
        first = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])) if len(shards) else []
        for a, b in zip(first, [*first[1:], len(shards)]):
            part = left[a:b] & np.uint64((1 << rest) - 1), right[a:b]
            yield self.length, int(shards[a]), *qf.encode(part, counts[a:b], (rest, self.half))


def _filters(n_ids: int, shard_bits: int):
    """Count the pairs and triples of slices into filters."""

    def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        if found:
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
            names = [c.split()[0] for c in _FILTERS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found), kinds)], names=names)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [_Counter(length, n_ids, shard_bits) for length in (2, 3)]
        for batch in batches:
            for i in range(batch.num_rows):
                kind = np.dtype(f"u{batch.column('width')[i].as_py()}")
                tokens = np.frombuffer(batch.column("tokens")[i].as_buffer(), kind).astype(np.int64)
                known = batch.column("ids")[i].values
                places, numbers = (known.field(f).to_numpy() for f in ("place", "number"))
                id_of = np.full(int(tokens.max()) + 1, -1, np.int64)
                id_of[places + 1] = numbers
                for counter in counters:
                    yield from rows(list(counter.add(id_of[tokens])))
        for counter in counters:
            yield from rows(list(counter.flush()))

    return count


def _frequent(n_ids: int, shard_bits: int, least: int):
    """Merge the filters of one length and shard; the phrases that occur often enough, as ids."""

    def merge(filters: pa.Table) -> pa.Table:
        length, shard = filters["length"][0].as_py(), filters["shard"][0].as_py()
        half = qf.half_bits(n_ids, length)
        rest = half - min(shard_bits, half)
        columns = [filters[c].to_pylist() for c in qf.Filter._fields]
        (left, right), counts = qf.merged([qf.Filter(*f) for f in zip(*columns)], (rest, half))
        often = counts >= least
        left = left[often] | np.uint64(shard << rest)
        ids = qf.unpacked(qf.restored((left, right[often]), half), n_ids, length)
        columns = [pa.array(np.full(int(often.sum()), length, np.int32)), *map(pa.array, ids)]
        if length == 2:
            columns.append(pa.nulls(len(columns[0]), pa.int64()))
        return pa.table([*columns, pa.array(counts[often])], names=[c.split()[0] for c in _GRAMS.split(", ")])

    return merge


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), in whole numbers."""
    wide = [c.cast("decimal(15,0)") for c in (a, left, right)]
    top = (wide[0] * wide[0] * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")
    return F.call_function("div", top, (wide[1] * wide[2]).cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = 10, covered: int = 50, most: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the first ``most`` phrases of each language.

    Phrases that lie inside a longer one with at least ``covered`` per cent of their occurrences are left out.
    """
    cast = [F.col(c).cast("string").alias(c) for c in ("text", "lang")]
    slices = stored(docs.select(*cast).mapInArrow(_slices, _SLICES).withColumn("slice", F.monotonically_increasing_id()), "slices")
    entry = F.posexplode(F.arrays_zip("words", "langs", "counts"))
    entries = slices.select("slice", entry.alias("place", "entry")).select(
        "slice", "place", F.col("entry.words").alias("word"), F.col("entry.langs").alias("lang"), F.col("entry.counts").alias("f")
    )
    totals = stored(entries.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    often = entries.groupBy("lang", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    words = stored(numbered(often, "words"), "ids")
    n_ids, n_tokens = words.count(), totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shard_bits = max(n_tokens // SHARD, 1).bit_length()

    known = entries.join(words, ["lang", "word"]).groupBy("slice").agg(F.collect_list(F.struct("place", "number")).alias("ids"))
    tokens = slices.select("slice", "width", "tokens").join(known.hint("shuffle_hash"), "slice")
    filters = tokens.select("width", "tokens", "ids").mapInArrow(_filters(n_ids, shard_bits), _FILTERS)
    grams = stored(filters.groupBy("length", "shard").applyInArrow(_frequent(n_ids, shard_bits, least), _GRAMS), "grams")

    first = words.select(F.col("number").alias("w1"), "lang", F.col("word").alias("word1"), F.col("f").alias("f1"))
    second = words.select(F.col("number").alias("w2"), F.col("word").alias("word2"), F.col("f").alias("f2"))
    pairs = stored(grams.where("length = 2").select("w1", "w2", "a").join(first, "w1").join(second, "w2"), "pairs")
    head = pairs.select("w1", "w2", "lang", "word1", "word2", "f1", F.col("a").alias("a12"))
    tail = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("word2").alias("word3"), F.col("f2").alias("f3"), F.col("a").alias("a23"))
    triples = grams.where("length = 3").drop("length")

    part = F.explode(F.array(F.struct(F.col("w1").alias("w1"), F.col("w2").alias("w2")), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"))))
    longer = triples.select(part.alias("part"), "a").groupBy("part.w1", "part.w2").agg(F.max("a").alias("longer"))
    alone = pairs.join(longer, ["w1", "w2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))

    def cut(left: str, right: str) -> Column:
        score = _score(F.col("a"), F.col(left), F.col(right))
        return F.struct(score.alias("score"), F.col(left).alias("l"), F.col(right).alias("r"))

    two = alone.select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", cut("f1", "f2").alias("cut"))
    early, late = cut("f1", "a23"), cut("a12", "f3")
    three = triples.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"]).select(
        "lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a",
        F.when(late["score"] < early["score"], late).otherwise(early).alias("cut"),
    )
    # The first phrases of parts of a language, then of these: one language is no task's whole work.
    order = [F.desc("cut.score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    of_part, of_lang = (Window.partitionBy(*keys).orderBy(*order) for keys in (["lang", "part"], ["lang"]))
    some = two.unionByName(three).withColumn("part", part).withColumn("rank", F.row_number().over(of_part)).where(F.col("rank") <= most)
    ranked = some.withColumn("rank", F.row_number().over(of_lang).cast("bigint")).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
