"""SentencePiece BPE encoding and decoding of whole batches by suffix-array matching.

The distinct words of a batch (each with the blanks before it, as no piece holds a blank after another
character) are joined to one text. A suffix array of it, ordered to the length of the longest piece, is
searched for every piece at once by bisection; the ranges found are all occurrences of all pieces, the edges of
the words' lattices. Sorted by where they end, they are relaxed from left to right: an edge continues the
encoding of what lies before it if the merges of the two pieces would not have joined across their boundary.
The encoding of a prefix is unique, so exactly one edge survives at each place, and the last places' edges give
the same pieces as merging the best pairs one after another.

Merge order must rise from parts to wholes, which fails for runs of blanks in some vocabularies: words with two
blanks in a row are merged pair by pair instead. Characters outside the vocabulary become byte pieces.

Null text counts as empty and has no pieces. Blanks are kept as they are, so decoding returns the text (only the
blank character of the vocabulary itself, U+2581, comes back as a blank, as the vocabulary has it so). Words are remembered between batches, half a million at most; memory follows the longest text.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellwerk.llm import columnar

REMEMBERED = 500_000
SLICE_BYTES = 3 << 20
# Characters of new words matched at a time; each has several edges.
ROUND = 1 << 19
# Places of a worker's table of pairs of pieces.
ANSWERS = 1 << 21
_BREAK = chr(0x10FFFF)  # between words; a noncharacter
_BLANK = "▁"
_START, _NONE = -1, -2


class Vocabulary:
    """Pieces of a model in merge order: single characters first, then wholes after their parts."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        text = {i: model.id_to_piece(i) for i in plain}
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        plain.sort(key=lambda i: (len(text[i]) > 1, -model.get_score(i), i))
        self.pieces = [text[i] for i in plain]
        self.ids = np.array(plain, np.int32)
        self.order = {p: k for k, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces))
        # Bytes of every id, for decoding.
        self.bytes = [b""] * len(ids)
        for i in plain:
            self.bytes[i] = text[i].replace(_BLANK, " ").encode("utf-8")
        for value, i in self.byte_ids.items():
            self.bytes[i] = bytes([value])
        # The two parts each piece is merged from; pieces that merging never reaches are not matched.
        self.parts: list[tuple[int, int] | None] = []
        reachable = []
        for k, piece in enumerate(self.pieces):
            last = self.merged(piece)[1] if len(piece) > 1 else None
            self.parts.append(last)
            if (len(piece) == 1 or last is not None) and _BLANK * 2 not in piece:
                reachable.append(k)
        self.reachable = np.array(reachable)
        self.matrix = np.zeros((len(reachable), self.longest), np.uint32)
        for row, k in enumerate(reachable):
            points = np.frombuffer(self.pieces[k].encode("utf-32-le"), np.uint32)
            self.matrix[row, : len(points)] = points
        self.lengths = np.array([len(self.pieces[k]) for k in reachable])
        # Characters that pieces hold.
        self.characters = np.zeros(0x110000, bool)
        self.characters[self.matrix] = True
        self.characters[0] = "\0" in self.order
        self._edges: tuple[dict, dict] = ({}, {})
        self._asked, self._answers = np.full(ANSWERS, -1, np.int64), np.zeros(ANSWERS, bool)

    def merged(self, word: str) -> tuple[list[str], tuple[int, int] | None]:
        """Merge pairs of the word one after another, the best pair first, of equal ones the left one; the pieces,
        and the parts of the last merge if one piece is left."""
        order, symbols, last = self.order, list(word), None
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(order[a + b], i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in order]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            # Pairs that have changed since they were noted are passed over.
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            last = (order[a], order[b]) if a in order and b in order else None
            symbols[i], symbols[j] = a + b, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and symbols[left] + symbols[right] in order:
                    heapq.heappush(heap, (order[symbols[left] + symbols[right]], left, symbols[left], symbols[right]))
        symbols = [x for x in symbols if x]
        return symbols, last if len(symbols) == 1 else None

    def _edge(self, piece: int, side: int) -> list[tuple[str, float]]:
        """The parts of a piece along one side, each with the place in the merge order at which it is used up."""
        known = self._edges[side].get(piece)
        if known is None:
            known, until, part = [], float("inf"), piece
            while True:
                known.append((self.pieces[part], until))
                if self.parts[part] is None:
                    break
                until, part = part, self.parts[part][side]
            self._edges[side][piece] = known
        return known

    def apart(self, left: int, right: int) -> bool:
        """Whether two pieces stay apart: no parts at their boundary are merged before either is used up."""
        for a, a_until in self._edge(left, 1):
            for b, b_until in self._edge(right, 0):
                k = self.order.get(a + b)
                if k is not None and k < a_until and k <= b_until:
                    return False
        return True

    def all_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``apart`` of many pairs; a pair's place in the table of answers holds the last pair asked for there."""
        keys = left.astype(np.int64) * len(self.pieces) + right
        place = (columnar.mix(keys.view(np.uint64)) % np.uint64(ANSWERS)).astype(np.int64)
        new = self._asked[place] != keys
        values = self._answers[place]
        if new.any():
            pairs, where = np.unique(keys[new], return_inverse=True)
            found = np.fromiter((self.apart(*divmod(k, len(self.pieces))) for k in pairs.tolist()), bool, len(pairs))
            values[new] = found[where]
            self._asked[place[new]], self._answers[place[new]] = keys[new], values[new]
        return values

    def to_ids(self, symbols: list[str]) -> np.ndarray:
        out = []
        for s in symbols:
            k = self.order.get(s)
            out.extend([self.ids[k]] if k is not None else [self.byte_ids[b] for b in s.encode("utf-8")])
        return np.array(out, np.int32)


def codes(points: np.ndarray, known: np.ndarray, matrix: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for what follows each place, compared over the matrix' width at least, in its order.

    And the range of numbers, end excluded, of what begins with each piece; it is empty for pieces with characters that
    do not occur. ``known`` tells of every character whether pieces hold it.
    """
    seen = np.zeros(len(known), bool)
    seen[points] = True
    kinds = np.flatnonzero(seen & known)
    digit = np.zeros(len(known), np.int64)
    digit[kinds] = np.arange(1, len(kinds) + 1)
    base, width = len(kinds) + 1, 1
    # As many characters at once as fit a number.
    while (base ** (2 * width)) < 1 << 62 and width < matrix.shape[1]:
        width *= 2
    value, step = digit[points], 1
    while step < width:
        value = value * base**step + _after(value, step)
        step *= 2
    # Each piece by parts of that width: full ones are one number, those cut short a range, those beyond the end anything.
    parts = -(-matrix.shape[1] // width)
    parts = 1 << (parts - 1).bit_length()
    digits = np.zeros((len(matrix), parts * width), np.int64)
    digits[:, : matrix.shape[1]] = digit[matrix]
    here = np.arange(parts * width) < lengths[:, None]
    possible = (digits.astype(bool) | ~here).all(axis=1)
    digits = np.where(here, digits, 0).reshape(len(matrix), parts, width)
    held = np.clip(lengths[:, None] - np.arange(parts) * width, 0, width)
    low = digits @ (base ** np.arange(width - 1, -1, -1, dtype=np.int64))
    high = low + base ** (width - held).astype(np.int64)
    while parts > 1:
        kept, _, value = _distinct(value)
        n = len(kept) + 1
        value = value * n + _after(value + 1, width)
        first, last = np.searchsorted(kept, low), np.searchsorted(kept, high)
        full, after = held[:, ::2] == width, held[:, 1::2] > 0
        second, third = np.where(after, first[:, 1::2] + 1, 0), np.where(after, last[:, 1::2] + 1, n)
        first, last = first[:, ::2], last[:, ::2]
        low = first * n + np.where(full, second, 0)
        high = np.where(full, np.where(last > first, first * n + third, low), last * n)
        held, width, parts = held[:, ::2] + held[:, 1::2], 2 * width, parts // 2
    low, high = low[:, 0], high[:, 0]
    return value, low, np.where(possible, high, low)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place of each, and which of them every value is."""
    order = np.argsort(values)
    ordered = values[order]
    first = np.ones(len(values), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(values), np.int64)
    which[order] = np.cumsum(first) - 1
    return ordered[first], order[first], which


def _after(rank: np.ndarray, step: int) -> np.ndarray:
    """The ranks ``step`` places later, 0 beyond the end."""
    return np.append(rank[step:], np.zeros(min(step, len(rank)), rank.dtype))


def occurrences(vocabulary: Vocabulary, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of the text, and for every piece the range of it that begins with the piece, by bisection."""
    value, low, high = codes(points, vocabulary.characters, vocabulary.matrix, vocabulary.lengths)
    order = np.argsort(value)
    value = value[order]
    return order.astype(np.int32), np.searchsorted(value, low), np.searchsorted(value, high)


def encode_words(vocabulary: Vocabulary, words: list[str]) -> list[np.ndarray]:
    """Ids of words in which blanks are written as the vocabulary's blank character."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ids, sizes = encode_points(vocabulary, points, np.fromiter(map(len, words), np.int64, len(words)))
    return np.split(ids, np.cumsum(sizes)[:-1]) if words else []


def encode_points(vocabulary: Vocabulary, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words given as their characters one after another and their sizes; all ids, and how many each word has.

    Words are matched in rounds of ``ROUND`` characters or one longer word.
    """
    ends = np.cumsum(sizes)
    ids, counts, start = [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
    while start < len(sizes):
        before = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, before + ROUND, side="right")))
        found, n = _matched(vocabulary, points[before : ends[stop - 1]], sizes[start:stop])
        ids.append(found)
        counts.append(n)
        start = stop
    return np.concatenate(ids), np.concatenate(counts)


def _matched(vocabulary: Vocabulary, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = np.repeat(np.arange(len(sizes)), sizes)
    blank = points == ord(_BLANK)
    odd = np.zeros(len(sizes), bool)
    odd[word[1:][blank[1:] & blank[:-1] & (word[1:] == word[:-1])]] = True
    odd[word[points == ord(_BREAK)]] = True
    if not odd.any():
        return _matched_simple(vocabulary, points, sizes)
    ends = np.cumsum(sizes)
    found, n = _matched_simple(vocabulary, points[~odd[word]], sizes[~odd])
    counts = np.zeros(len(sizes), np.int64)
    counts[~odd] = n
    merged = {}
    for i in np.flatnonzero(odd).tolist():
        text = points[ends[i] - sizes[i] : ends[i]].tobytes().decode("utf-32-le")
        merged[i] = vocabulary.to_ids(vocabulary.merged(text)[0])
        counts[i] = len(merged[i])
    ids = np.empty(counts.sum(), np.int32)
    ids[~np.repeat(odd, counts)] = found
    ids[np.repeat(odd, counts)] = np.concatenate(list(merged.values()))
    return ids, counts


def _matched_simple(vocabulary: Vocabulary, chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words have no two blanks in a row and no ``_BREAK``."""
    if not len(chars):
        return np.empty(0, np.int32), np.zeros(len(sizes), np.int64)
    points = np.full(len(chars) + len(sizes), ord(_BREAK), np.uint32)
    points[np.arange(len(chars)) + np.repeat(np.arange(len(sizes)), sizes)] = chars
    begins = (np.cumsum(sizes + 1) - sizes - 1).astype(np.int32)
    order, low, high = occurrences(vocabulary, points)
    some = np.flatnonzero(high > low)
    n = (high - low)[some]
    start = order[np.repeat((low[some] - np.cumsum(n) + n).astype(np.int32), n) + np.arange(n.sum(), dtype=np.int32)]
    row = np.repeat(some.astype(np.int32), n)
    del order, low, high
    # Characters without a piece are edges of their own, which nothing joins: they count as one piece more.
    single = points == ord(_BREAK)
    single[start[vocabulary.lengths[row] == 1]] = True
    unknown = np.flatnonzero(~single)
    pieces = np.append(vocabulary.reachable, len(vocabulary.pieces)).astype(np.int32)
    lengths = np.append(vocabulary.lengths, 1).astype(np.int32)
    start = np.append(start, unknown.astype(np.int32))
    row = np.append(row, np.full(len(unknown), len(pieces) - 1, np.int32))
    place = start + lengths[row] - np.repeat(begins, sizes + 1)[start]
    by_place = np.argsort(place.astype(np.uint16) if place.max(initial=0) < 1 << 16 else place, kind="stable")
    bounds = np.append(0, np.cumsum(np.bincount(place)[1:]))
    start, row = start[by_place], row[by_place]
    del place, by_place
    last, came = np.full(len(points) + 1, _NONE, np.int32), np.zeros(len(points) + 1, np.int32)
    last[begins] = _START
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        s = start[a:b]
        before = last[s]
        reached = np.flatnonzero(before != _NONE)
        s, r, before = s[reached], row[a:b][reached], before[reached]
        p = pieces[r]
        good = (before == _START) | (before == len(vocabulary.pieces)) | (p == len(vocabulary.pieces))
        check = np.flatnonzero(~good)
        good[check] = vocabulary.all_apart(before[check], p[check])
        s, p, end = s[good], p[good], (s + lengths[r])[good]
        last[end], came[end] = p, s
    # Back from the ends of all words at once; a place where a piece begins is marked with it.
    used = np.full(len(points), _NONE, np.int32)
    at = (begins + sizes)[sizes > 0]
    begin = begins[sizes > 0]
    while len(at):
        back = came[at]
        used[back] = last[at]
        more = back > begin
        at, begin = back[more], begin[more]
    places = np.flatnonzero(used != _NONE)
    found = np.append(vocabulary.ids, np.int32(-1))[used[places]]
    counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes + 1)[places], minlength=len(sizes))
    missing = found < 0
    if not missing.any():
        return found, counts
    # Characters without a piece become their bytes.
    lost = points[places[missing]]
    n = np.ones(len(found), np.int64)
    n[missing] += (lost >= 0x80).astype(np.int64) + (lost >= 0x800) + (lost >= 0x10000)
    out = np.repeat(found, n)
    bytes_of = np.frombuffer(lost.tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
    out[out < 0] = [vocabulary.byte_ids[b] for b in bytes_of.tolist()]
    return out, np.add.reduceat(np.append(n, 0), np.cumsum(counts) - counts) * (counts > 0)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of spans one after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Encoder:
    """Words already encoded are kept by their hash: the ids of all of them in one array, and where each word's begin."""

    def __init__(self, vocabulary: Vocabulary):
        self._vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self._hashes = np.empty(0, np.uint64)
        self._starts, self._sizes = np.empty(0, np.int64), np.empty(0, np.int64)
        self._ids = np.empty(0, np.int32)

    def _learn(self, hashes: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Encode words that lie in the text from ``begin`` to ``end``; their hashes are in order."""
        sizes = end - begin
        taken = data[_spans(begin, sizes)]
        points = np.frombuffer(taken.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
        points[points == 32] = ord(_BLANK)
        lengths = np.add.reduceat((taken & 0xC0) != 0x80, np.cumsum(sizes) - sizes, dtype=np.int64)
        ids, counts = encode_points(self._vocabulary, points, lengths)
        at = np.searchsorted(self._hashes, hashes)
        self._hashes = np.insert(self._hashes, at, hashes)
        self._starts = np.insert(self._starts, at, len(self._ids) + np.cumsum(counts) - counts)
        self._sizes = np.insert(self._sizes, at, counts)
        self._ids = np.append(self._ids, ids)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch and the bounds of its rows."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
        data, offsets = columnar.utf8(texts)
        blank = data == 32
        opens = blank.copy()
        opens[1:] &= ~blank[:-1]
        opens[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        begin = np.flatnonzero(opens)
        end = np.append(begin[1:], len(data)) if len(begin) else begin
        if len(self._hashes) > REMEMBERED:
            self._forget()
        hashes, sample, where = _distinct(columnar.span_hashes(data, begin, end))
        place = np.searchsorted(self._hashes, hashes)
        new = place == len(self._hashes)
        new[~new] = self._hashes[place[~new]] != hashes[~new]
        if new.any():
            self._learn(hashes[new], data, begin[sample[new]], end[sample[new]])
            place = np.searchsorted(self._hashes, hashes)
        sizes = self._sizes[place][where]
        ids = self._ids[_spans(self._starts[place][where], sizes)]
        return ids, np.append(0, np.cumsum(sizes))[np.searchsorted(begin, offsets)]


_encoders: dict[str, tuple[Vocabulary, Encoder]] = {}


def _tools(model_path: str) -> tuple[Vocabulary, Encoder]:
    if model_path not in _encoders:
        vocabulary = Vocabulary(model_path)
        _encoders[model_path] = vocabulary, Encoder(vocabulary)
    return _encoders[model_path]


def _encoded(model_path: str):
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tools(model_path)[1]
        for batch in columnar.sliced(batches, "text", SLICE_BYTES):
            ids, bounds = encoder.batch(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return encode


def _decoded(model_path: str):
    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _tools(model_path)[0].bytes
        for whole in batches:
            for batch in _by_length(whole):
                texts = []
                for ids in batch.column("ids"):
                    text = b"".join([pieces[i] for i in ids.values.to_numpy(zero_copy_only=False).tolist()]) if ids.is_valid else b""
                    texts.append(text[1:].decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return decode


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch cut into pieces of about as many ids as a slice has bytes."""
    sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_pylist()
    start, size = 0, 0
    for i, more in enumerate(sizes):
        if i > start and size + more > SLICE_BYTES // 4:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += more
    if start < len(sizes):
        yield batch.slice(start)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids`` of ``doc_id, text`` rows."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoded(model_path), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids, text`` of ``doc_id, ids`` rows; null ids count as none."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(model_path), "doc_id bigint, ids array<int>, text string")


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [zlib.crc32(ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()) for ids in batch.column("ids")]
        sizes = pc.list_value_length(batch.column("ids")).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(sums, pa.int64()), batch.column("text")], names=["doc_id", "n_ids", "ids_crc32", "text"])


_DIGESTS = "doc_id bigint, n_ids bigint, ids_crc32 bigint, text string"


def _hashed(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_ids", "ids_crc32", F.sha2("text", 256).alias("text_sha256"))


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_ids, ids_crc32`` (of little-endian unsigned 32-bit ids) and ``text_sha256`` of the decoded text."""
    return _hashed(decoded.mapInArrow(_digested, _DIGESTS))


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """``digests(decode(encode(docs)))`` with the three steps in one worker, so that each task has one instead of three."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    steps: list[Callable] = [_encoded(model_path), _decoded(model_path), _digested]

    def chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        return batches

    return _hashed(rows.mapInArrow(chained, _DIGESTS))
