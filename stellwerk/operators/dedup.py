"""Duplicate removal: one survivor per key.

All five rules are the same operator with other keys. Filtering on row number 1 lets Spark put a
group limit before the shuffle, so each map task sends at most one row per key: a key that holds a
third of all rows reaches its reducer as one row per map task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellwerk.functions.keys import company_key
from stellwerk.functions.text import lower_trim

_RANK = "__rank"


def survivors(
    df: DataFrame,
    keys: Sequence[str | Column],
    order: Sequence[Column],
    tie_breakers: Sequence[Column] = (),
) -> DataFrame:
    """Keep the first row of every key under ``order``; ties fall to ``tie_breakers``."""
    ranking = Window.partitionBy(*keys).orderBy(*order, *tie_breakers)
    return df.withColumn(_RANK, F.row_number().over(ranking)).where(F.col(_RANK) == 1).drop(_RANK)


def row_fingerprint(df: DataFrame, without: Sequence[str] = ()) -> Column:
    """Content hash that makes an order total when nothing else distinguishes two rows."""
    return F.xxhash64(*[F.col(name) for name in sorted(df.columns) if name not in without])


# Where a stored row lies: file and position in it.
LOCATOR = ["_file", "_row"]

# Long columns that no rule looks at.
WIDE_COLUMNS = ["description", "skills"]


def _default_ties(df: DataFrame, ties: Sequence[Column] | None) -> Sequence[Column]:
    """The rules themselves leave ties open; these settle them by content, so re-runs agree.

    Long texts count last, and stored rows leave them out: there the position decides instead.
    """
    if ties is not None:
        return ties
    prints = [F.col(name) if name in df.columns else content for name, content in _prints(df).items()]
    found = [F.desc_nulls_last("posted_at"), F.asc("title"), F.asc_nulls_first("company"), *prints]
    return [*found, *[F.col(name) for name in LOCATOR]] if is_stored(df) else found


_PRINTS = ["__short", "__whole"]


def _prints(df: DataFrame) -> dict[str, Column]:
    """Hashes of the content that settle ties."""
    short, whole = _PRINTS
    found = {short: row_fingerprint(df, [*WIDE_COLUMNS, *LOCATOR, *_PRINTS])}
    return found if is_stored(df) else found | {whole: row_fingerprint(df, _PRINTS)}


def _with_prints(df: DataFrame) -> DataFrame:
    """Hash the content once for several rules, so that columns only the hashes look at are not carried along."""
    return df.withColumns(_prints(df))


def _latest_key(scope: Sequence[str]) -> list[str | Column]:
    return [*scope, "source", "source_id"]


def _batch_key(scope: Sequence[str]) -> list[str | Column]:
    hour = F.date_trunc("hour", "fetched_at")
    return [*scope, "source", F.lower(F.trim("title")), lower_trim(F.col("company")), hour]


def dedup_latest(df: DataFrame, scope: Sequence[str] = (), tie_breakers: Sequence[Column] | None = None) -> DataFrame:
    """Within a board: the latest observation of each posting id."""
    return survivors(df, _latest_key(scope), [F.desc("fetched_at")], _default_ties(df, tie_breakers))


def dedup_batch(df: DataFrame, scope: Sequence[str] = (), tie_breakers: Sequence[Column] | None = None) -> DataFrame:
    """Within a board and fetch hour: one posting per title and company."""
    return survivors(df, _batch_key(scope), [F.desc("fetched_at")], _default_ties(df, tie_breakers))


def dedup_cross_source(
    df: DataFrame, scope: Sequence[str] = (), tie_breakers: Sequence[Column] | None = None
) -> DataFrame:
    """Across boards: the best board wins, then the latest observation."""
    return survivors(
        df,
        [*scope, "dedup_key"],
        [F.desc("source_priority"), F.desc("fetched_at")],
        _default_ties(df, tie_breakers),
    )


def dedup_bronze(
    df: DataFrame,
    scope: Sequence[str] = (),
    tie_breakers: Sequence[Column] | None = None,
    keys: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The three bronze rules in sequence; ``scope`` (a day column) keeps days apart."""
    return bronze_rules(scope, tie_breakers, keys)(df)


# Columns made of others, by ``unify.with_keys``.
DERIVED = ["job_id", "dedup_key", "source_priority"]


@dataclass(frozen=True)
class Rules:
    """Rules that are applied one after the other.

    ``steps`` are those at the beginning that look for repeats, where most rows share their key with no other: each with
    its key. ``rest`` are the others. ``named`` are the rows that may stay at all, by a filter.
    """

    steps: Sequence[tuple[Sequence[str | Column], Callable[[DataFrame], DataFrame]]]
    rest: Callable[[DataFrame], DataFrame]
    whole: Callable[[DataFrame], DataFrame]
    named: Callable[[DataFrame], DataFrame] = lambda df: df

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.whole(df)


def bronze_rules(
    scope: Sequence[str] = (),
    tie_breakers: Sequence[Column] | None = None,
    keys: Callable[[DataFrame], DataFrame] | None = None,
) -> Rules:
    """The three bronze rules as one.

    ``keys`` makes the derived columns, which may be missing before: the first two rules do without them, and hashes do
    not compress in their shuffles. Where the last rule stands alone, stored rows that have them are not hashed again.
    """

    def prepared(df: DataFrame) -> DataFrame:
        rows = df if tie_breakers is not None else _with_prints(df)
        return rows if keys is None else rows.drop(*DERIVED)

    def last(rows: DataFrame) -> DataFrame:
        return dedup_cross_source(rows if keys is None else keys(rows), scope, tie_breakers).drop(*_PRINTS)

    def first(rule: Callable[..., DataFrame]) -> Callable[[DataFrame], DataFrame]:
        return lambda df: rule(prepared(df), scope, tie_breakers)

    def rules(df: DataFrame) -> DataFrame:
        return last(dedup_batch(dedup_latest(prepared(df), scope, tie_breakers), scope, tie_breakers))

    def rest(df: DataFrame) -> DataFrame:
        if keys is None or not set(DERIVED) <= set(df.columns):
            return last(prepared(df))
        rows = df if tie_breakers is not None else _with_prints(df)
        return dedup_cross_source(rows, scope, tie_breakers).drop(*_PRINTS)

    steps = [(_latest_key(scope), first(dedup_latest)), (_batch_key(scope), first(dedup_batch))]
    return Rules(steps, rest, rules)


# Bits of one of Spark's bitmaps, and how many bitmaps (64 MB, half a billion stored rows) are sent to every executor.
_BITS, _BROADCAST = 32_768, 16_384
_CHUNK, _KEPT, _NUMBER = "_chunk", "_kept", "_number"


def _place() -> Column:
    return F.col(LOCATOR[1]) + 1


def _bitmaps(rows: DataFrame) -> DataFrame:
    """Positions as bitmaps, one for each 32,768 rows of a file."""
    bit = F.bitmap_bit_position(_place())
    return rows.groupBy(LOCATOR[0], F.bitmap_bucket_number(_place()).alias(_CHUNK)).agg(
        F.bitmap_construct_agg(bit).alias(_KEPT)
    )


def _marked() -> Column:
    """Is the bit of this row set in the bitmap beside it?"""
    bit = F.bitmap_bit_position(_place())
    byte = F.conv(F.hex(F.substring(_KEPT, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (bit % 8).cast("int")) == 1


def numbered_files(df: DataFrame) -> DataFrame:
    """The files of stored rows with numbers in the order of their names; to be written, as numbers depend on the plan."""
    file = LOCATOR[0]
    return df.select(file).distinct().orderBy(file).withColumn(_NUMBER, F.monotonically_increasing_id())


def with_numbers(df: DataFrame, files: DataFrame) -> DataFrame:
    """Stored rows with the numbers of their files (written ``numbered_files``) in place of the names, which are longer
    than the rest of a short row and stand in every one."""
    file = LOCATOR[0]
    return df.join(F.broadcast(files), file).drop(file).withColumnRenamed(_NUMBER, file)


def with_names(kept: DataFrame, files: DataFrame) -> DataFrame:
    """Bitmaps with the names of their files again."""
    file = LOCATOR[0]
    return kept.withColumnRenamed(file, _NUMBER).join(F.broadcast(files), _NUMBER).select(file, _CHUNK, _KEPT)


def few_enough(small: DataFrame) -> bool:
    """May these written rows (files or bitmaps) be sent to every executor?"""
    return small.count() <= _BROADCAST


def kept_positions(df: DataFrame, rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Positions of the rows that a rule keeps, as bitmaps.

    The rule sees the short columns only, so nothing else is shuffled or sorted.
    """
    return _bitmaps(rule(df.drop(*WIDE_COLUMNS)))


def alone_positions(df: DataFrame, key: Sequence[str | Column]) -> DataFrame:
    """Positions of rows with a key no other row has, as bitmaps. Files are numbered.

    Only a hash of the key is shuffled with the position, and a frequent key once for each map task. Keys whose hashes
    are equal by chance count as shared.
    """
    file, row = LOCATOR
    keyed = df.select(F.xxhash64(*key).alias("_key"), file, row)
    seen = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min(file).alias(file), F.min(row).alias(row))
    return _bitmaps(seen.where(F.col("_n") == 1))


def without(df: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows whose position is in none of the (few, written) bitmaps."""
    chunked = df.withColumn(_CHUNK, F.bitmap_bucket_number(_place()))
    both = chunked.join(F.broadcast(marked), [LOCATOR[0], _CHUNK], "left")
    return both.where(~F.coalesce(_marked(), F.lit(False))).select(*df.columns)


def within(df: DataFrame, marked: DataFrame, hint: str = "broadcast") -> DataFrame:
    """Rows whose position is in one of the bitmaps."""
    chunked = df.withColumn(_CHUNK, F.bitmap_bucket_number(_place()))
    return chunked.join(marked.hint(hint), [LOCATOR[0], _CHUNK]).where(_marked()).select(*df.columns)


def either(one: DataFrame, other: DataFrame) -> DataFrame:
    """Positions in one set of bitmaps or the other."""
    return one.unionByName(other).groupBy(LOCATOR[0], _CHUNK).agg(F.bitmap_or_agg(_KEPT).alias(_KEPT))


def fetched(df: DataFrame, kept: DataFrame, stored: bool = False) -> DataFrame:
    """Stored rows at the kept positions, without their position.

    Bitmaps take a bit a row. If they are written (``stored``) and few enough, every executor gets them and the long
    rows are not shuffled at all; else they are shuffled once, into a hash join, and never sorted.
    """
    return within(df, kept, "broadcast" if stored and few_enough(kept) else "shuffle_hash").drop(*LOCATOR)


def _fetched_by_position(df: DataFrame, rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a rule to the short columns of stored rows, then fetch the survivors by their position."""
    return fetched(df, kept_positions(df, rule))


def is_stored(df: DataFrame) -> bool:
    """Do the rows carry their file position?"""
    return set(LOCATOR) <= set(df.columns)


def dedup_stored_bronze(
    df: DataFrame, scope: Sequence[str] = (), tie_breakers: Sequence[Column] | None = None
) -> DataFrame:
    """The three bronze rules for rows that carry their file position."""
    return _fetched_by_position(df, lambda short: dedup_bronze(short, scope, tie_breakers))


def dedup_across_days(df: DataFrame, tie_breakers: Sequence[Column] | None = None) -> DataFrame:
    """Over all silver days: the latest observation of each job id."""
    return survivors(
        df.where(F.col("job_id").isNotNull()),
        ["job_id"],
        [F.desc_nulls_last("fetched_at")],
        _default_ties(df, tie_breakers),
    )


def dedup_title_company(df: DataFrame, tie_breakers: Sequence[Column] | None = None) -> DataFrame:
    """Boards reissue ids for the same posting: one row per title and company, the latest."""
    return survivors(
        df,
        ["title_norm", company_key(F.col("company_norm"))],
        [F.desc_nulls_last("fetched_at")],
        _default_ties(df, tie_breakers),
    )


def staging(silver: DataFrame, tie_breakers: Sequence[Column] | None = None) -> DataFrame:
    """Silver over all days, one row per posting: input of the star schema."""
    both = staging_rules(tie_breakers)
    return _fetched_by_position(silver, both) if is_stored(silver) else both(silver)


def staging_rules(tie_breakers: Sequence[Column] | None = None) -> Rules:
    """The two rules over all days as one."""

    def prepared(df: DataFrame) -> DataFrame:
        return df if tie_breakers is not None else _with_prints(df)

    def last(rows: DataFrame) -> DataFrame:
        return dedup_title_company(rows, tie_breakers).drop(*_PRINTS)

    steps = [(["job_id"], lambda df: dedup_across_days(prepared(df), tie_breakers))]
    return Rules(
        steps,
        lambda df: last(prepared(df)),
        lambda df: last(dedup_across_days(prepared(df), tie_breakers)),
        lambda df: df.where(F.col("job_id").isNotNull()),
    )
