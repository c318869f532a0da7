"""Document fingerprints from closed syncmers, in DataFrame expressions only.

A text is a sequence of tokens: runs of characters between white space, and single characters of scripts
that write words without it. Of the runs of four tokens (k-mers) those are anchors whose smallest inner run of
two tokens, by hash, is the first or the last one; a tie with the edge counts. Whether a k-mer is an anchor
depends on its own tokens alone, so equal passages have equal anchors wherever they stand, at positions that
differ by one constant. About two thirds of all k-mers are anchors, and no stretch of text goes without.

The fingerprint is the 64 smallest distinct anchor hashes (32 bits each, in hexadecimal, ascending), and the
likeness of two fingerprints the share of anchors in common, 2 * common / (both), as the smallest 64 of
their union show it. A text that replaces a quarter of another has a likeness of about 3/4 with it.

Null text counts as empty. A text of fewer than four tokens has one anchor, all its tokens; a text without
tokens has an empty fingerprint, of likeness 1 to another empty one and 0 to any other. Arrays hold one
text's tokens, so memory follows the longest text. The successor of a document is the one with the next
larger doc_id, after the last the first; a null doc_id counts as the smallest id. Of rows that share a doc_id
the smallest beginning of a text stands for the successor, and each row has a result of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellwerk.llm.columnar import stored

KMER = 4
INNER = 2
SIZE = 64
NO_ID = -(1 << 63)

# Thai, kana and ideographs, which are written without white space.
_SINGLE = "\\u0E00-\\u0E7F\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF"
TOKENS = f"[{_SINGLE}]|[^\\s{_SINGLE}]+"


def _places(array: Column, size: int) -> Column:
    """0 to the last place at which ``size`` elements fit."""
    n = F.size(array)
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def with_syncmers(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``, the anchors of the string column ``text`` as (position, 32-bit hash) structs."""
    tokens, inner = f"{out}_tokens", f"{out}_inner"
    t, h = F.col(tokens), F.col(inner)
    df = df.withColumn(tokens, F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0)))
    df = df.withColumn(inner, F.transform(_places(t, INNER), lambda i: F.xxhash64(F.get(t, i), F.get(t, i + 1))))
    runs = KMER - INNER + 1  # inner runs of a k-mer

    def closed(i: Column) -> Column:
        first, last = F.get(h, i), F.get(h, i + runs - 1)
        at_start, at_end = first <= last, last <= first
        for j in range(1, runs - 1):
            at_start, at_end = at_start & (first <= F.get(h, i + j)), at_end & (last <= F.get(h, i + j))
        return at_start | at_end

    def short(value: Column) -> Column:
        return F.shiftright(value, 32).cast("int")

    anchors = F.transform(
        F.filter(_places(h, runs), closed),
        lambda i: F.struct(i.alias("position"), short(F.xxhash64(*[F.get(h, i + j) for j in (*range(0, runs - 1, INNER), runs - 1)])).alias("hash")),
    )
    whole = F.array(F.struct(F.lit(0).alias("position"), short(F.xxhash64(t)).alias("hash")))
    none = F.slice(whole, 1, 0)
    found = F.when(F.size(t) >= KMER, anchors).when(F.size(t) > 0, whole).otherwise(none)
    return df.withColumn(out, found).drop(tokens, inner)


def sketch(anchors: Column) -> Column:
    """The smallest distinct hashes of an array of anchors."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(anchors, lambda a: a["hash"]))), 1, SIZE)


def as_text(smallest: Column) -> Column:
    # Hexadecimal of the low 32 bits.
    return F.array_join(F.transform(smallest, lambda x: F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of common anchors of two sketches, from 0 to 1."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SIZE)
    common = F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(2 * common / (1 + common))


def predecessors(ids: DataFrame) -> DataFrame:
    """``doc_id, before, before_n`` of distinct ``doc_id, n`` rows: the next smaller id and its n; for the
    smallest id the largest one's. Ids are dealt out by range; only the last one of each range meets the others."""
    ranged = stored(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    inside = Window.partitionBy("part").orderBy("doc_id")
    row = F.struct("doc_id", "n")
    linked = ranged.select("part", "doc_id", F.lag(row).over(inside).alias("before"))
    lasts = ranged.groupBy("part").agg(F.max("doc_id").alias("doc_id"), F.max_by("n", "doc_id").alias("n"))
    # As many rows as ranges.
    across = Window.orderBy("part")
    everything = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lasts = lasts.select("part", F.coalesce(F.lag(row).over(across), F.last(row).over(everything)).alias("outside"))
    return linked.join(lasts, "part").select("doc_id", F.coalesce("before", "outside").alias("b")).select(
        "doc_id", F.col("b.doc_id").alias("before"), F.col("b.n").alias("before_n")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``: each text and
    its edit, in which the beginning of the next document replaces the last quarter."""
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    ids = texts.select("doc_id", F.char_length("text").alias("n")).groupBy("doc_id").agg(F.max("n").alias("n"))
    heads = texts.join(predecessors(ids), "doc_id").select(
        F.col("before").alias("doc_id"), F.col("doc_id").alias("next_id"), F.left("text", F.floor(F.col("before_n") / 4).cast("int")).alias("head")
    )
    # One of the rows of an id stands for it.
    heads = heads.groupBy("doc_id", "next_id").agg(F.min("head").alias("head"))
    n, quarter = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    edits = texts.join(heads, "doc_id").select(
        "doc_id", "next_id", n.cast("bigint").alias("n_chars"), "text", F.concat(F.left("text", n - quarter), F.left("head", quarter)).alias("edited")
    )
    for text in ("text", "edited"):
        edits = with_syncmers(edits, text, f"{text}_anchors").withColumn(f"{text}_sketch", sketch(F.col(f"{text}_anchors"))).drop(f"{text}_anchors")
    edits = stored(edits.select("doc_id", "next_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "text_sketch", "edited_sketch"), "sketches")
    following = edits.groupBy(F.col("doc_id").alias("next_id")).agg(F.min("text_sketch").alias("next_sketch"))
    return edits.join(following, "next_id").select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_text(F.col("text_sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("text_sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("text_sketch"), F.col("next_sketch")).alias("near_next"),
    )
