"""Token sequences of at most 1024 ids packed by the sum-of-squares rule.

Texts are tokenized on the executors; a document is its ids and an end id. Only documents longer than a
sequence are cut, into full pieces after a first piece that may be shorter. Full pieces are sequences of
their own. The others are packed in groups of bounded size, drawn by a hash of the document: an item goes
where the sum over all gaps of the squared number of open sequences with that gap becomes smallest. A new
sequence is opened only where no open one has room, and groups take their items in falling length: on the
given documents that needs 0.7 % more sequences than the sum of lengths, the rule with free choice of new
sequences 4 %. Sequences that a group leaves with a gap are packed again as whole blocks, over ever fewer
groups, as long as that joins a quarter of them or more.

The added tokens of a vocabulary are found in plain text first, as its library does, and get their own ids; the
text between them is tokenized part by part.

Null text counts as empty (the end id alone). Rows that share a doc_id are packed each on its own, equal
rows too.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellwerk.llm import columnar
from stellwerk.llm.columnar import stored

END_ID = 2
LENGTH = 1024
# Items one task packs at a time.
GROUP = 25_000
# Another turn only if the one before left at most this share of its blocks.
WORTH_IT = 0.75
# Word ids a worker remembers before it starts anew.
REMEMBERED = 500_000

# White space beyond ASCII: a word may not be cut off after it.
_OTHER_SPACE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

_PIECES = "doc_id bigint, row_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class WordTokenizer:
    """Byte-level BPE ids of whole batches; every distinct word is encoded once.

    The pattern of the vocabulary never joins a character to white space after it, so a text may be cut
    before each run of white space. Texts with other than ASCII white space or an added token are encoded as they are.
    """

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int]):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        self._encode = encoding.encode_ordinary
        self._encode_all = lambda text: encoding.encode(text, allowed_special="all")
        self._added = [token.encode("utf-8") for token in added]
        self._known: dict[int, np.ndarray] = {}

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        data, offsets = columnar.utf8(texts)
        _, word_ends, rows = columnar.words(data, offsets)
        # A piece is the white space before a word, and the word; the last one takes white space at the end.
        first = np.append(True, rows[1:] != rows[:-1]) if len(rows) else np.empty(0, bool)
        last = np.append(first[1:], True) if len(rows) else first
        begin = np.where(first, offsets[rows], np.append(0, word_ends[:-1])[: len(rows)])
        end = np.where(last, offsets[rows + 1], word_ends)
        hashes = columnar.span_hashes(data, begin, end)
        distinct, sample, where = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._known) > REMEMBERED:
            self._known.clear()
        raw = data.tobytes()
        ids = []
        for h, at in zip(distinct.tolist(), sample.tolist()):
            found = self._known.get(h)
            if found is None:
                piece = raw[begin[at] : end[at]].decode("utf-8")
                found = self._known[h] = np.array(self._encode(piece), np.uint32)
            ids.append(found)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        out_sizes = sizes[where]
        out_ends = np.cumsum(out_sizes)
        source = np.repeat((np.cumsum(sizes) - sizes)[where] - (out_ends - out_sizes), out_sizes) + np.arange(out_ends[-1] if len(out_ends) else 0)
        out = flat[source]
        total = np.append(0, out_ends)
        result = []
        bounds = np.searchsorted(rows, np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            a, b = bounds[i], bounds[i + 1]
            text = raw[offsets[i] : offsets[i + 1]]
            if any(token in text for token in self._added):
                result.append(np.array(self._encode_all(text.decode("utf-8")), np.uint32))
            elif a == b or (not text.isascii() and _OTHER_SPACE.search(text.decode("utf-8"))):
                result.append(np.array(self._encode(text.decode("utf-8")), np.uint32))
            else:
                result.append(out[total[a] : total[b]])
        return result


_tokenizers: dict[tuple, WordTokenizer] = {}


def added_tokens(path: str) -> dict[str, int]:
    """Text and id of the added tokens of a vocabulary in the JSON form of the tokenizers library."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    # Tokens that take white space with them or need a word boundary are matched in another way.
    odd = [t["content"] for t in tokens if t["lstrip"] or t["rstrip"] or t["single_word"]]
    if odd:
        raise ValueError(f"added tokens with stripping or word boundaries: {odd}")
    # The longest of those that begin at one place is taken.
    return {t["content"]: t["id"] for t in sorted(tokens, key=lambda t: -len(t["content"]))}


def _pieces(ranks_path: str, pattern: str, added: dict[str, int]):
    key = (ranks_path, pattern, *added.items())

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizers.get(key) or _tokenizers.setdefault(key, WordTokenizer(ranks_path, pattern, added))
        for batch in columnar.sliced(batches, "text"):
            rows = []
            ids_of = tokenizer.batch(batch.column("text"))
            for doc_id, row_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("row_id").to_pylist(), ids_of):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                cut = len(ids) % LENGTH or LENGTH
                start, stop, piece = 0, cut, 0
                while start < len(ids):
                    rows.append((doc_id, row_id, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                    start, stop, piece = stop, stop + LENGTH, piece + 1
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "row_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return pieces


def sum_of_squares(sizes: np.ndarray, capacity: int = LENGTH) -> np.ndarray:
    """The bin of each item, in the order given.

    With N(g) open bins of gap g, an item of size s that goes into a bin of gap g changes the sum of squares
    by 2 * (N(g - s) - N(g) + 1); bins without a gap do not count. A tie goes to the smallest gap. A bin is
    opened only if no open one has room.
    """
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, made = np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        gaps = np.flatnonzero(count[s:capacity]) + s
        if len(gaps):
            change = 2 * (count[gaps - s] - count[gaps] + 1)
            change[gaps == s] = 1 - 2 * count[s]
            gap = int(gaps[change.argmin()])
            target = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, target, made = capacity, made, made + 1
        bins[i] = target
        if gap > s:
            stacks[gap - s].append(target)
            count[gap - s] += 1
    return bins


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["size", "block"], ascending=[False, True], kind="stable").reset_index(drop=True)
    frame["bin"] = sum_of_squares(frame["size"].to_numpy())
    first = frame.groupby("bin")["block"].transform("min")
    offset = frame.groupby("bin")["size"].cumsum() - frame["size"]
    total = frame.groupby("bin")["size"].transform("sum")
    return pd.DataFrame({"block": frame["block"], "into": first, "shift": offset.astype("int64"), "total": total.astype("int64")})


def pack(docs: DataFrame, ranks_path: str, pattern: str, added: dict[str, int] | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for ``doc_id, text`` rows; ``added`` are
    the added tokens of the vocabulary, without which such a string is text like any other."""
    numbered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "row_id", F.monotonically_increasing_id()
    )
    pieces = stored(numbered.mapInArrow(_pieces(ranks_path, pattern, added or {}), _PIECES), "pieces")
    # A block is what is packed as a whole: at first the one short piece of a row, later a sequence with a gap.
    placed = pieces.where((F.col("piece") == 0) & (F.col("length") < LENGTH)).select(
        F.col("row_id"), F.col("row_id").alias("block"), F.lit(0).cast("bigint").alias("offset"), F.col("length").alias("size")
    )
    n, turn, done = placed.count(), 0, None
    while n:
        groups, turn, before = -(-n // GROUP), turn + 1, n
        blocks = placed.where("row_id = block").select("block", "size", F.pmod(F.xxhash64("block", F.lit(turn)), F.lit(groups)).alias("group"))
        moved = stored(blocks.groupBy("group").applyInPandas(_pack, "block bigint, into bigint, shift bigint, total bigint"), "moved")
        placed = stored(
            placed.drop("size").join(moved, "block").select("row_id", F.col("into").alias("block"), (F.col("offset") + F.col("shift")).alias("offset"), F.col("total").alias("size")),
            "placed",
        )
        gaps = placed.where(F.col("size") < LENGTH)
        n = gaps.where("row_id = block").count() if groups > 1 else 0
        # Sequences that hardly fit together any more stay as they are.
        last = n > before * WORTH_IT or not n
        full = placed if last else placed.where(F.col("size") == LENGTH)
        done = full if done is None else done.unionByName(full)
        if last:
            break
        placed = gaps
    if done is not None:
        out = pieces.join(done.select("row_id", F.lit(0).alias("piece"), "block", "offset"), ["row_id", "piece"], "left")
    else:
        out = pieces.withColumns({"block": F.lit(None).cast("bigint"), "offset": F.lit(None).cast("bigint")})
    # Sequences of short pieces get even numbers, full pieces odd ones.
    alone = F.xxhash64("row_id", "piece")
    return out.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.when(F.col("block").isNotNull(), F.col("block") * 2).otherwise(alone.bitwiseOR(F.lit(1).cast("bigint"))).alias("sequence_id"),
        F.coalesce("offset", F.lit(0).cast("bigint")).alias("offset"),
    )
