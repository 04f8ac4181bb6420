"""Registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, html_blocks, jaccard_join, mixing, quality, quotes, secrets, token_counts, warc
from .shared import shared_folder


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed along ``mixing.CURRICULUM``: sizes, targets, words taken and training times of the first and the last pass."""
    return mixing.mix_sources(read(spark, sf_dir, "documents"), mixing.CURRICULUM).select(
        "doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"), F.round("last_position", 9).alias("last_position")
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives in the shared folder and read back; an unsound record ends the query."""
    folder = shared_folder(spark)
    warc.write_archives(read(spark, sf_dir, "pages"), folder)
    back = warc.read_archives(spark.read.schema("archive string, content binary").parquet(folder), payload=False)
    return back.select(
        F.coalesce("page_id", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("unsound record: "), "error")).cast("long"))).alias("page_id"),
        "payload_bytes", "payload_digest", "record_type", "refers_to",
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the size of their shingle set and the least id that links reach."""
    return jaccard_join.jaccard_classes(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and their edited texts with their fingerprints and how alike these are."""
    fp = fingerprint
    docs = read(spark, sf_dir, "documents")
    pieces = fp.with_next(docs, carry={"a": fp.paragraphs(F.col("text")), "sa": fp.sketch("a")})
    d = pieces.withColumn("n_chars", F.length("text").cast("long"))
    part = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - part).cast("int")), F.substring(F.col("next"), F.lit(1), part))
    d = d.withColumn("edited", edited).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sa", F.col("next_sa").alias("sx"), fp.paragraphs(F.col("edited")).alias("e")
    )
    d = d.withColumn("se", fp.sketch("e"))
    d = d.withColumns({"de": fp.differing("sa", "se"), "dx": fp.differing("sa", "sx")})
    return d.select(
        "doc_id", "n_chars", "edited_sha256", fp.fingerprint("sa").alias("fingerprint"), fp.fingerprint("se").alias("edited_fingerprint"),
        fp.likeness("sa", "se", "de").alias("near_edited"), fp.likeness("sa", "sx", "dx").alias("near_next"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model that learned from the labelled ones that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.quality_scores(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op6_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations without quotations, in reply order."""
    return quotes.link_quotations(read(spark, sf_dir, "conversations"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that are in benchmark windows and the items that they come from."""
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with counts and spans of secrets and linked credentials."""
    found = secrets.secret_spans(read(spark, sf_dir, "documents"))
    of_kind = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE))
    return found.select(
        "doc_id", of_kind(0).alias("n_assign"), of_kind(1).alias("n_access"), of_kind(2).alias("n_hex"),
        F.sha2(secrets.spans_text(base).cast("binary"), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"),
    )


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_blocks.extract_main_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: The vocabulary that op10 counts with; a file of the public tokenizers.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and word pieces of all documents by ``VOCABULARY``."""
    return token_counts.token_counts(read(spark, sf_dir, "documents"), VOCABULARY)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_warc, op3_jaccard_join, op4_fingerprints, op5_quality, op6_quotations, op7_winnowing, op8_secrets, op9_main_text,
        op10_token_counts, pipeline,
    )
}
