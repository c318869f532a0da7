"""Registered queries of the training-data operators, on whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellwerk.llm import sql
from stellwerk.llm.columnar import new_folder, table
from stellwerk.llm.fingerprints import fingerprints
from stellwerk.llm.hard_negatives import hard_negatives
from stellwerk.llm.html_extraction import extract_text
from stellwerk.llm.language_id import fit, held_out, identify
from stellwerk.llm.mixing import mix
from stellwerk.llm.near_dedup import near_duplicates
from stellwerk.llm.packing import added_tokens, pack
from stellwerk.llm.phrases import collocations
from stellwerk.llm.piece_codec import round_trip
from stellwerk.llm.quality_rules import judge
from stellwerk.llm.substring_dedup import remove_repeated_passages
from stellwerk.llm.toxicity import toxicity
from stellwerk.llm.toxicity import fit as fit_toxicity
from stellwerk.llm.warc import page_of, page_records, use_warc


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def word_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def packed(docs: DataFrame) -> DataFrame:
    """Rows of the byte-level vocabulary, its added tokens included."""
    return pack(docs, vocabulary("byte_bpe_50k.tiktoken"), word_pattern(), added_tokens(vocabulary("byte_bpe_50k.json")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline.py``, which builds on this module."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeated_passages(table(spark, sf_dir, "documents"))
    return cleaned.select("row.doc_id", "row.text", "n_removed")


def op3_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Of the documents only id and text reach the prediction.
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the pages to archives, then read responses with their payload and revisits by their headers."""
    use_warc(spark)
    path = new_folder(spark, "warc")
    page_records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    responses = spark.read.format("warc").load(path).where("type = 'response'")
    headers = "record_id string, type string, refers_to string, payload_digest string, payload_length bigint"
    revisits = spark.read.format("warc").schema(headers).load(path).where("type = 'revisit'")
    none = F.lit(None).cast("bigint")
    return responses.select(
        page_of("record_id").alias("page_id"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        F.col("type").alias("record_type"),
        none.alias("refers_to"),
    ).unionByName(
        revisits.select(
            page_of("record_id").alias("page_id"),
            F.col("payload_length").alias("payload_bytes"),
            F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
            F.col("type").alias("record_type"),
            page_of("refers_to").alias("refers_to"),
        )
    )


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=4)
    # The query's rule is on ids; the operator keeps one row where several share an id.
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(table(spark, sf_dir, "documents")).select("row.doc_id", *[f"quality.{n}" for n in names])


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_closed_syncmers": op3_closed_syncmers,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_piece_codec": op5_piece_codec,
    "op6_language_id": op6_language_id,
    "op7_html_extraction": op7_html_extraction,
    "op8_warc": op8_warc,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_mixing": op11_mixing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_collocations": op13_collocations,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op10_quality_rules": sql.QUALITY,
    "op11_mixing": sql.MIXING,
    "op12_hard_negatives": sql.HARD_NEGATIVES,
    "op13_collocations": sql.COLLOCATIONS,
}
