"""Per-user posting activity: cleaning, upsert, merge, folding of user actions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.schemas import APPLIED, SAVED, SEEN

KEY = ["username", "job_id"]
STATES = [SEEN, SAVED, APPLIED]

# Actions of the fold.
MARK_SEEN, TOGGLE_SAVED, SET_APPLIED, TOGGLE_APPLIED, REMOVE = (
    "mark_seen",
    "toggle_saved",
    "set_applied",
    "toggle_applied",
    "remove",
)


def clean_status(status: Column) -> Column:
    """Known states only, in the given order."""
    return F.filter(status, lambda s: s.isin(STATES))


def valid_username(df: DataFrame) -> DataFrame:
    """Rows whose user name has 3 to 30 lower-case letters, digits or underscores."""
    return df.where(F.col("username").rlike("^[a-z0-9_]{3,30}$"))


def _snapshot(snapshot: Column) -> Column:
    """An empty object is no snapshot."""
    return F.when(~F.trim(snapshot).isin("", "{}", "null"), snapshot)


def upsert_activity(base: DataFrame, updates: DataFrame, now: dt.datetime | str) -> DataFrame:
    """Apply a payload: status is replaced, a missing snapshot keeps the stored one.

    ``updates`` carries ``seq``, the position in its payload; later entries win.
    """
    newest = (
        updates.withColumn("snapshot", _snapshot(F.col("snapshot")))
        .groupBy(*KEY)
        .agg(
            F.max_by(clean_status(F.col("status")), "seq").alias("new_status"),
            F.max_by("snapshot", F.when(F.col("snapshot").isNotNull(), F.col("seq"))).alias("new_snapshot"),
            F.lit(True).alias("touched"),
        )
    )
    touched = F.col("touched").isNotNull()
    moment = F.lit(str(now)).cast(base.schema["updated_at"].dataType)
    return base.join(newest, KEY, "full_outer").select(
        *KEY,
        F.when(touched, F.col("new_status")).otherwise(F.col("status")).alias("status"),
        F.coalesce("new_snapshot", "snapshot").alias("snapshot"),
        F.when(touched, moment).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def _strongest_first(status: Column) -> Column:
    """Applied, saved, seen; unknown states last."""
    known = [s for s in reversed(STATES)]
    ranked = F.array_intersect(F.array(*[F.lit(s) for s in known]), status)
    return F.concat(ranked, F.array_except(status, F.array(*[F.lit(s) for s in known])))


def merge_activity(local: DataFrame, server: DataFrame) -> DataFrame:
    """Union of both sides per posting; the local snapshot has priority.

    A posting known to one side only keeps its status order.
    """
    mine = local.select(*KEY, F.col("status").alias("l_status"), F.col("snapshot").alias("l_snapshot"))
    theirs = server.select(*KEY, F.col("status").alias("s_status"), F.col("snapshot").alias("s_snapshot"))
    both = F.col("l_status").isNotNull() & F.col("s_status").isNotNull()
    return mine.join(theirs, KEY, "full_outer").select(
        *KEY,
        F.when(both, _strongest_first(F.array_union("l_status", "s_status")))
        .otherwise(F.coalesce("l_status", "s_status"))
        .alias("status"),
        F.coalesce("l_snapshot", "s_snapshot").alias("snapshot"),
    )


# ---- folding actions ---------------------------------------------------------------------------
#
# An entry is one of 16 states: bit 0 seen, bit 1 saved, bit 2 applied, bit 3 present. An action
# maps states to states, and so does any run of actions; runs that follow each other compose. So a
# long history is cut into blocks in the order of time, each block folded on its own, and the results
# composed step by step: no task needs the whole history of a key.

_SEEN, _SAVED, _APPLIED, _PRESENT = 1, 2, 4, 8
_STATE_COUNT = 16


def _after(state: Column, action: Column) -> Column:
    applied = state.bitwiseAND(F.lit(_APPLIED)) != 0
    set_applied = state.bitwiseOR(F.lit(_SAVED | _APPLIED | _PRESENT))
    return (
        F.when(action == MARK_SEEN, state.bitwiseOR(F.lit(_SEEN | _PRESENT)))
        .when(action == TOGGLE_SAVED, state.bitwiseXOR(F.lit(_SAVED)).bitwiseOR(F.lit(_PRESENT)))
        .when(action == SET_APPLIED, set_applied)
        .when(
            action == TOGGLE_APPLIED,
            F.when(applied, state.bitwiseAND(F.lit(_SEEN | _SAVED | _PRESENT))).otherwise(set_applied),
        )
        .when(action == REMOVE, F.lit(0))
        .otherwise(state)
    )


def _identity() -> Column:
    return F.array(*[F.lit(i) for i in range(_STATE_COUNT)])


# Actions folded at a time.
BLOCK_ROWS = 4096
_ROW_BITS = 33  # of monotonically_increasing_id: the row's place within its partition


def _later_first(first: Column, removes: Column, later: Column) -> Column:
    """Time of the first action since the last removal, over what came before and a run after it."""
    return F.when(removes, later).otherwise(F.coalesce(first, later))


def _folded(blocks: DataFrame, moment) -> DataFrame:
    """One run for the events of each block."""
    empty = F.lit(None).cast(moment)
    return blocks.select(
        *[c for c in blocks.columns if c != "events"],
        F.struct(F.get("events", 0)["ts"].alias("ts"), F.get("events", 0)["seq"].alias("seq")).alias("at"),
        F.aggregate(
            "events", _identity(), lambda states, event: F.transform(states, lambda s: _after(s, event["action"]))
        ).alias("states"),
        F.exists("events", lambda e: e["action"] == REMOVE).alias("removes"),
        # Actions after the block's last removal.
        F.aggregate(
            "events", empty, lambda first, e: F.when(e["action"] != REMOVE, F.coalesce(first, e["ts"]))
        ).alias("first_ts"),
    )


def _composed(runs: DataFrame, keys: list[str], moment) -> DataFrame:
    """One run for all runs of ``keys``, in the order of their first actions."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "states", "removes", "first_ts")))
    return runs.groupBy(*keys).agg(ordered.alias("runs")).select(
        *keys,
        F.get("runs", 0)["at"].alias("at"),
        F.aggregate("runs", _identity(), lambda states, run: F.transform(states, lambda s: F.get(run["states"], s))).alias("states"),
        F.exists("runs", lambda run: run["removes"]).alias("removes"),
        F.aggregate(
            "runs", F.lit(None).cast(moment), lambda first, run: _later_first(first, run["removes"], run["first_ts"])
        ).alias("first_ts"),
    )


def apply_actions(actions: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fold (username, job_id, ts, seq, action) into the resulting activity rows.

    Range partitioning by key and time spreads one key's history over many tasks and keeps each task's part
    contiguous. Sorted, a part is cut into blocks of ``block_rows`` actions, and each block becomes one map of the 16
    states. Maps compose: those of a partition first, then those of a key, of which there is one per partition. So an
    array never holds more than a block's actions or a partition's blocks, and one key with all rows needs no more memory
    than any other. ``saved_at`` is the time of the first action since the entry last came into being.
    """
    order, moment = [F.col("ts"), F.col("seq")], actions.schema["ts"].dataType
    place = F.col("place")
    ranged = (
        actions.repartitionByRange(*KEY, *order)
        .sortWithinPartitions(*KEY, *order)
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright(place, _ROW_BITS))
        .withColumn("block", F.floor(place.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) / F.lit(block_rows)))
    )
    events = F.array_sort(F.collect_list(F.struct("ts", "seq", "action")))
    runs = _folded(ranged.groupBy(*KEY, "part", "block").agg(events.alias("events")), moment)
    whole = _composed(_composed(runs, [*KEY, "part"], moment), KEY, moment)
    folded = whole.select(*KEY, F.get("states", 0).alias("state"), F.col("first_ts").alias("saved_at"))
    flags = [(_SEEN, SEEN), (_SAVED, SAVED), (_APPLIED, APPLIED)]
    status = F.array_compact(
        F.array(*[F.when(F.col("state").bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in flags])
    )
    return folded.where(F.col("state").bitwiseAND(F.lit(_PRESENT)) != 0).select(
        *KEY, status.alias("status"), "saved_at"
    )


def jobs_with_status(activity: DataFrame, state: str) -> DataFrame:
    return activity.where(F.array_contains("status", state)).orderBy(F.desc("saved_at"), *KEY)


def saved_jobs(activity: DataFrame) -> DataFrame:
    """Saved postings, newest first."""
    return jobs_with_status(activity, SAVED)


def applied_jobs(activity: DataFrame) -> DataFrame:
    """Postings applied to, newest first."""
    return jobs_with_status(activity, APPLIED)


def activity_counts(activity: DataFrame) -> DataFrame:
    """Saved and applied postings per user."""
    return activity.groupBy("username").agg(
        F.count_if(F.array_contains("status", SAVED)).alias("saved"),
        F.count_if(F.array_contains("status", APPLIED)).alias("applied"),
    )
