"""Mix sources to target weights, in whole documents, by thresholds on a hash.

A source's documents are taken as often as its target holds its size (``floor``); what is left of the
target goes to the documents whose hash lies below a threshold. Budgets are nested: with a larger budget every
document is taken at least as often as with a smaller one.

The threshold is found without sorting documents: sizes are summed by source and the first 12 bits of the hash;
running sums over these at most 4,096 numbers of a source tell in which bucket the budget ends; only the documents of
that bucket are summed again by the next 12 bits, and so on until a bucket holds one document. That one is taken
where it brings the source nearer to its target. The first sums are also those of the sources, and all later passes read the
boundary bucket alone.

The hash is 60 bits of the MD5 of id and text, so reruns agree, whatever the partitions. Rows equal in id and text
have one hash; they are told apart by a number that is written once with the sizes, and which of them is
taken cannot be seen in the result.

Sources are ordered by code point, null last, and weigh ``WEIGHTS``, repeating. Targets are the shares of ``SHARE``
of all sizes by weight; a target stops at ``MOST`` times the size of its source, and the excess goes to the
others by weight until none is above. Sizes are numbers of words (runs of characters other than ASCII
white space); null and empty texts have size 0 and take nothing. Null ids are ids like others. An empty table
gives no rows; sources whose documents are all empty have target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stellwerk.llm.columnar import stored
from stellwerk.llm.numbering import numbered

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
WORD = r"[^\x20\x09-\x0D]+"

# Bits read at each step, from the left: (column, bits to the right of them, their number).
_HASH_BITS = 60
_STEPS = [("hash", right, 12) for right in range(48, -1, -12)] + [("number", right, 12) for right in range(52, 3, -12)] + [("number", 0, 4)]


def hash60(doc_id: Column, text: Column) -> Column:
    """The first 15 hexadecimal digits of an MD5 of both."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), text)
    return F.conv(F.left(F.md5(key), F.lit(_HASH_BITS // 4)), 16, 10).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, hash, number`` of all documents, written once: texts are read once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return stored(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
            hash60(F.col("doc_id"), text).alias("hash"),
            F.monotonically_increasing_id().alias("number"),
        ),
        "sizes",
    )


def with_targets(
    sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """Add ``target`` to ``source, source_size``.

    A round caps all sources whose share exceeds what they may give, and the rest share what remains. Each round is
    one sum over the sources, and only its three numbers reach the driver. Shares only grow, so a capped source stays
    capped, and the rounds end when one caps no further source.
    """
    ranked = numbered(sources, "sources", [F.col("source").asc_nulls_last()])
    place = F.pmod("number", F.lit(len(weights))).cast("int")
    ranked = ranked.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), place)).drop("number")
    limit, weight = F.col("source_size") * F.lit(most), F.col("weight")
    total = share * ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    unit, capped = 0.0, None
    while True:
        full = weight * F.lit(unit) > limit
        held, free, n = ranked.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, weight)), F.lit(0)),
            F.count_if(full),
        ).first()
        if n == capped or not free:
            break
        unit, capped = (total - held) / free, n
    return ranked.withColumn("target", F.least(weight * F.lit(unit), limit.cast("double"))).drop("weight")


def _sums(rows: DataFrame, step: int) -> DataFrame:
    column, right, width = _STEPS[step]
    bucket = F.shiftrightunsigned(column, right).bitwiseAND(F.lit((1 << width) - 1))
    n = F.count_if(F.col("size") > 0).alias("n")
    return rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"), n)


def _inside(rows: DataFrame, ends: DataFrame, step: int) -> DataFrame:
    """The rows of each source's boundary bucket, with what is left of the budget there."""
    column, right, width = _STEPS[step]
    bucket = F.shiftrightunsigned(column, right).bitwiseAND(F.lit((1 << width) - 1))
    at = ends.select(F.col("source").alias("at_source"), F.col("bucket").alias("at_bucket"), F.col("rest").alias("budget"))
    here = F.col("source").eqNullSafe(F.col("at_source")) & (bucket == F.col("at_bucket"))
    return rows.where("size > 0").select("source", "hash", "number", "size").join(at, here).drop("at_source", "at_bucket")


def _boundaries(sums: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, bucket, rest, n``: the bucket in which each source's budget ends. At most 4,096 sums of a source
    are added up here."""
    wanted = budgets.select(F.col("source").alias("of_source"), "budget")
    running = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
    return (
        sums.join(wanted, F.col("source").eqNullSafe(F.col("of_source")))
        .withColumn("rest", F.col("budget") - (running - F.col("size")))
        .where("rest >= 0 AND rest < size")
        .select("source", "bucket", "rest", "n")
    )


def thresholds(sizes: DataFrame, sums: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, hash, number, last``: the document at which each source's budget ends.

    ``sums`` are those of the first step over all ``sizes``. Documents before the one returned (by hash, then
    number) fit the budget whole; ``last`` tells whether it is taken, too. Budgets are below the source's size.
    """
    rows, step = sizes, 0
    while True:
        ends = stored(_boundaries(sums, budgets), "boundaries")
        rows = stored(_inside(rows, ends, step), "boundary")
        if not ends.agg(F.coalesce(F.max("n"), F.lit(0)) > 1).first()[0]:
            return rows.select("source", "hash", "number", (F.col("size") <= 2 * F.col("budget")).alias("last"))
        budgets = ends.select("source", F.col("rest").alias("budget"))
        step += 1
        sums = _sums(rows, step)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every document.

    ``copies`` tells how often the mix takes the document, ``taken`` how many words that makes.
    """
    sizes = sized(docs)
    sums = stored(_sums(sizes, 0), "sums")
    sources = sums.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stored(with_targets(sources, weights, share, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    sources = sources.withColumn("whole", whole)
    budgets = sources.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    ends = thresholds(sizes, sums, budgets)
    ends = ends.select(
        F.col("source").alias("end_source"), F.col("hash").alias("end_hash"), F.col("number").alias("end_number"), "last"
    )
    plan = sources.join(ends, F.col("source").eqNullSafe(F.col("end_source")), "left")
    plan = stored(plan.withColumnRenamed("source", "of_source"), "plan")

    # One row for each source: broadcast only while Spark finds it small; beyond that a hot source's partition is split.
    both = sizes.join(plan, F.col("source").eqNullSafe(F.col("of_source")), "left")
    same = F.col("hash") == F.col("end_hash")
    before = (F.col("hash") < F.col("end_hash")) | (same & (F.col("number") < F.col("end_number")))
    at = same & (F.col("number") == F.col("end_number")) & F.col("last")
    copies = F.col("whole") + F.coalesce(before | at, F.lit(False)).cast("bigint")
    return both.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )
