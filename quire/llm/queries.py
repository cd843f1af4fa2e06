"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, contamination, conversations, exact, licenses, lines, packing, pieces, simhash, spans, toxicity, vectors, warc
from .common import fresh_folder, pick, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))
    return packing.with_digest(pieces)


@register("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the sentences of passages that an earlier place already has."""
    return spans.remove_repeats(table(spark, sf_dir, "documents"))


@register("op3_warc", warc.WARC_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records, looked up in the capture index and read back."""
    pages = table(spark, sf_dir, "pages")
    archive = warc.write_archive(pages, fresh_folder(spark, "warc"))
    keys = pick(pages, url="url").select(warc.surt(F.col("url")).alias("key"))
    records = warc.read_records(spark, archive, warc.lookup(spark, archive, keys))
    kind = pages.schema["page_id"].dataType
    return records.select(F.col("page_id").try_cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").cast(kind).alias("refers_to"))


@register("op4_embedding_near_dedup", vectors.EMBEDDINGS_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with equal labels at cosine 0.93 or more."""
    return vectors.embedding_groups(table(spark, sf_dir, "embeddings"))


@register("op5_sentencepiece")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, and whether decoding them gives its text back."""
    return pieces.round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@register("op6_exact_dedup", exact.EXACT_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose texts are equal after folding white space."""
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@register("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components at 2 bits or fewer."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@register("op9_line_dedup", lines.LINES_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every page without the lines that are boilerplate of its host."""
    return lines.drop_boilerplate(table(spark, sf_dir, "pages"))


@register("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases, licence detections, labels and score of every document."""
    return licenses.scan_licences(table(spark, sf_dir, "documents"))


@register("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of held-out rows are not learned from."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@register("op12_decontamination", contamination.CONTAMINATION_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a 10-word window of the benchmark."""
    return contamination.with_digest(contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@register("op13_conversation_repair", conversations.REPAIR_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations with their faults and the cheapest edits that give a legal sequence of roles."""
    rows = table(spark, sf_dir, "conversations")
    return conversations.with_digest(rows, conversations.repair(conversations.damage(rows)))


@register("op11_collocations", collocations.COLLOCATIONS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases of 2 to 5 words that occur at least 100 times."""
    return collocations.collocations(table(spark, sf_dir, "documents"))
