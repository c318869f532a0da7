"""Near-duplicate documents by an inverted join of MinHash signatures.

1. Every whole text becomes its set of word shingles, a digest of that set and a MinHash signature of 64
   coordinates. Documents with equal sets form a class; only its smallest node goes on.
2. Documents are posted under their coordinate values. Of 64 coordinates, 63 are posted in 21 groups of
   three, the prefix: two signatures that agree in 44 or more coordinates differ in 20 at most and
   so share a whole posting. At a similarity of 0.8 the chance to share none is 3e-7.
3. Pairs of a posting list count their collisions over all coordinates; those below ``MATCHES`` are
   skipped (36 is 4.7 standard deviations below the mean at a similarity of 0.8).
4. Pairs left are confirmed on the full shingle sets and linked; components get their smallest id.

Postings never become all pairs of a list. First every document meets one leader per list (another one in
each list), and the three best of these pairs are confirmed; most lists then lie within one component and
are done. Lists with several components are joined in blocks inside the tasks: pairs of different
components that reach ``MATCHES``, and that have not met in an earlier list, are confirmed on the full sets
there, and a task emits an edge only if it joins two components, so fewer edges than it has documents.
Nothing is capped.

Null text and texts without words have an empty set and are linked with nothing. Every row is a node of its
own, by a number that is written once with the rows; doc_id, null or repeated, only names components: by
its smallest, null before all others. Of rows with that doc_id one is kept, with the smallest hash of its text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellwerk.llm import columnar
from stellwerk.llm.columnar import stored
from stellwerk.llm.components import connected_components

COORDINATES = 64
GROUP = 3
MATCHES = 36
# Documents of a posting list that one task compares at a time.
BLOCK = 1024
# Leaders of a document that are confirmed first.
TRIED = 3

_random = np.random.default_rng(20240917)
_FACTORS = _random.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)

_PROFILE = "node bigint, doc_id bigint, text_hash bigint, n_shingles bigint, d1 bigint, d2 bigint, signature binary, postings array<bigint>"


def signature(values: np.ndarray) -> np.ndarray:
    """The 64 coordinates (32 bits each) of a non-empty set of shingle hashes."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 4096):
        part = np.multiply.outer(_FACTORS, values[at : at + 4096])
        part += _SHIFTS[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def postings(coordinates: np.ndarray) -> np.ndarray:
    """A 64-bit key for each group of three coordinates, group number included."""
    grouped = coordinates[: COORDINATES // GROUP * GROUP].reshape(-1, GROUP).astype(np.uint64)
    key = np.arange(1, len(grouped) + 1, dtype=np.uint64)
    for column in grouped.T:
        key = columnar.mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def _sets(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in columnar.sliced(batches, "text"):
        data, offsets = columnar.utf8(batch.column("text"))
        data = columnar.LOWER[data]
        starts, ends, rows = columnar.words(data, offsets)
        hashes = columnar.span_hashes(data, starts, ends)
        values, bounds = columnar.shingles(hashes, rows, batch.num_rows, width)
        yield batch, [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def _profiles(width: int):
    def profile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, width):
            signatures, keys, digests = [], [], np.zeros((len(sets), 2), np.uint64)
            for i, values in enumerate(sets):
                if len(values):
                    coordinates = signature(values)
                    signatures.append((coordinates & 0xFF).astype(np.uint8).tobytes())
                    keys.append(postings(coordinates))
                    digests[i] = columnar.mix(values).sum(), columnar.mix(values ^ _SHIFTS[0]).sum()
                else:
                    signatures.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("node", "doc_id", "text_hash")],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests[:, 0].view(np.int64)),
                    pa.array(digests[:, 1].view(np.int64)),
                    pa.array(signatures, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["node", "doc_id", "text_hash", "n_shingles", "d1", "d2", "signature", "postings"],
            )

    return profile


def _set_rows(width: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, width):
            coordinates = [signature(values) for values in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    pa.array([values.tobytes() for values in sets], pa.binary()),
                    pa.array([(c & 0xFF).astype(np.uint8).tobytes() for c in coordinates], pa.binary()),
                    pa.array([postings(c) for c in coordinates], pa.list_(pa.int64())),
                ],
                names=["node", "shingles", "signature", "postings"],
            )

    return rows


def _similar(percent: int):
    """Keep the pairs whose sets satisfy 100 * intersection >= percent * union."""

    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                left, right = (np.frombuffer(x.as_buffer(), np.uint64) for x in (left, right))
                small, large = (left, right) if len(left) <= len(right) else (right, left)
                common = 0
                if 100 * len(small) >= percent * len(large):
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    common = int((large[at] == small).sum())
                good.append(100 * common >= percent * (len(left) + len(right) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return confirm


def _collisions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count equal coordinates of each pair; drop the pairs below MATCHES."""
    for batch in batches:
        matches = (_matrix(batch.column("left")) == _matrix(batch.column("right"))).sum(axis=1)
        found = batch.select(["member", "leader"]).append_column("matches", pa.array(matches, pa.int64()))
        yield found.filter(pa.array(matches >= MATCHES))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def _across_components(percent: int):
    def join_blocks(group: pa.Table) -> pa.Table:
        """Edges between components, from two blocks of one list or from one block."""
        ids, block = (group.column(c).to_numpy() for c in ("node", "block"))
        low, high, key = (group.column(c)[0].as_py() for c in ("low", "high", "key"))
        signatures = _matrix(group.column("signature").combine_chunks())
        posted = np.array(group.column("postings").to_pylist(), np.int64)
        band = int(np.flatnonzero(posted[0] == key)[0])
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        universe, place = np.unique(np.concatenate(sets), return_inverse=True)
        stops = np.cumsum(sizes)
        present = np.zeros(len(universe), np.int32)
        homes, home = np.unique(group.column("component").to_numpy(), return_inverse=True)
        edges = []
        right = np.flatnonzero(block == high)
        for i in np.flatnonzero(block == low):
            others = right[right > i] if low == high else right
            others = others[home[others] != home[i]]
            others = others[(signatures[others] == signatures[i]).sum(axis=1) >= MATCHES]
            others = others[~(posted[others, :band] == posted[i, :band]).any(axis=1)]
            if not len(others):
                continue
            own = place[stops[i] - sizes[i] : stops[i]]
            present[own] = 1
            common = np.add.reduceat(present[place], stops - sizes)[others]
            present[own] = 0
            for j in others[100 * common >= percent * (sizes[i] + sizes[others] - common)]:
                if home[j] != home[i]:
                    edges.append(sorted((ids[i], ids[j])))
                    home[home == home[j]] = home[i]
        edges = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({"a": edges[:, 0], "b": edges[:, 1]})

    return join_blocks


def _components(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """``node, doc_id, n_shingles, component_id, kept`` for written rows of ``node, doc_id, text``."""
    hashed = rows.select("node", "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    profiles = stored(hashed.mapInArrow(_profiles(width), _PROFILE), "profiles")
    filled = profiles.where("n_shingles > 0")
    # Of a class or component the first row is kept.
    rank = F.struct("doc_id", "text_hash", "node")
    classes = filled.groupBy("d1", "d2", "n_shingles").agg(F.min("node").alias("member_of"), F.min(rank).alias("first"), F.count("*").alias("n"))
    shared = classes.where("n > 1").drop("n")
    members = stored(
        profiles.select("node", "doc_id", "n_shingles", "d1", "d2", rank.alias("own"))
        .join(shared, ["d1", "d2", "n_shingles"], "left")
        .select("node", "doc_id", "n_shingles", "d1", "d2", F.coalesce("member_of", "node").alias("member_of"), F.coalesce("first", "own").alias("first")),
        "members",
    )
    others = members.where("node <> member_of").select("node", "d1", "d2")
    nodes = filled.join(others, ["node", "d1", "d2"], "left_anti").select("node", "signature", "postings")
    nodes = stored(nodes, "nodes")

    # Posting lists of two documents or more, each with a leader picked by the list's own key.
    posted = nodes.select("node", F.explode("postings").alias("key"))
    lists = posted.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(F.col("key"))).alias("first"), F.count("*").alias("n"))
    lists = lists.where("n > 1").select("key", "n", F.col("first").bitwiseXOR(F.col("key")).alias("leader"))
    entries = stored(posted.join(lists, "key"), "entries")
    signatures = nodes.select("node", "signature")

    def with_both(pairs: DataFrame, names: tuple[str, str], side: DataFrame, value: str) -> DataFrame:
        for name, out in zip(names, ("left", "right")):
            pairs = pairs.join(side.select(F.col("node").alias(name), F.col(value).alias(out)), name)
        return pairs

    met = entries.where("node <> leader").select(F.col("node").alias("member"), "leader").distinct()
    counted = with_both(met, ("member", "leader"), signatures, "signature")
    near = counted.mapInArrow(_collisions, "member bigint, leader bigint, matches bigint")
    # A document has one leader per list, 21 at most.
    ranked = near.groupBy("member").agg(F.sort_array(F.collect_list(F.struct((-F.col("matches")).alias("m"), "leader"))).alias("ranked"))
    best = ranked.select("member", F.explode(F.slice("ranked", 1, TRIED)).alias("best")).select(
        F.least("member", "best.leader").alias("a"), F.greatest("member", "best.leader").alias("b")
    )

    # Shingle sets of the documents in any list, written once.
    wanted = entries.select("node").distinct()
    sets = rows.select("node", "text").join(wanted.hint("shuffle_hash"), "node", "left_semi").mapInArrow(
        _set_rows(width), "node bigint, shingles binary, signature binary, postings array<bigint>"
    )
    sets = stored(sets, "sets")
    both = with_both(best.distinct(), ("a", "b"), sets, "shingles")
    homes = connected_components(both.mapInArrow(_similar(percent), "a bigint, b bigint"))

    placed = entries.join(homes, "node", "left").select(
        "key", "n", "node", F.coalesce("component", "node").alias("component")
    )
    spread = placed.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"))
    open_lists = spread.where("c1 <> c2").select("key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mixed = (
        placed.join(open_lists, "key", "left_semi")
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "component")
        .join(sets, "node")
    )
    across = mixed.groupBy("key", "low", "high").applyInArrow(_across_components(percent), "a bigint, b bigint")
    # The second graph has components as nodes.
    node, component = F.col("node"), F.col("component")
    lifted = stored(across.distinct(), "across")
    for name in ("a", "b"):
        home = homes.select(node.alias(name), component.alias("home"))
        lifted = lifted.join(home, name, "left").withColumn(name, F.coalesce("home", name)).drop("home")
    joined = connected_components(lifted)
    homes = stored(
        homes.join(joined.select(node.alias("component"), component.alias("top")), "component", "left")
        .select("node", F.coalesce("top", "component").alias("component"))
        .unionByName(joined.join(homes.select("node"), "node", "left_anti")),
        "homes",
    )

    firsts = members.where("node = member_of").select("node", "first")
    tops = homes.join(firsts, "node").groupBy("component").agg(F.min("first").alias("top"))
    homes = homes.join(tops, "component").select(F.col("node").alias("member_of"), "top")
    return members.join(homes, "member_of", "left").withColumn("top", F.coalesce("top", "first")).select(
        "node", "doc_id", "n_shingles", F.col("top.doc_id").alias("component_id"), (F.col("node") == F.col("top.node")).alias("kept")
    )


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``doc_id, text``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(rows.withColumn("node", F.monotonically_increasing_id()), "rows")
    return _components(rows, width, percent).drop("node")


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are kept: one of each component."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    rows = stored(rows.withColumn("node", F.monotonically_increasing_id()), "rows")
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    found = _components(rows.select("node", doc_id.cast("bigint").alias("doc_id"), text.cast("string").alias("text")), width, percent)
    left = rows.join(found.where("NOT kept").select("node"), "node", "left_anti")
    return left.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
