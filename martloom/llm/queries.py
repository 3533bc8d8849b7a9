"""The operators as registered queries: each reads its whole table and returns its whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.llm.alignment import align, read_byte_tokenizer, read_piece_tokenizer
from martloom.llm.bpe import bpe_decode, bpe_encode
from martloom.llm.content_sort import exact_dedup
from martloom.llm.html_text import extract
from martloom.llm.jaccard_join import jaccard_join
from martloom.llm.language import identify
from martloom.llm.merkle import FIELDS, leaf_hash, merkle_manifest, verify
from martloom.llm.mixing import mix
from martloom.llm.quality import quality
from martloom.llm.simhash import simhash_near
from martloom.llm.substring_dedup import substring_dedup
from martloom.llm.toxicity import toxicity
from martloom.llm.url_reputation import Rule, url_filter

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join(table(spark, sf_dir, "documents"))
    return joined.documents.select("doc_id", "n_shingles", "component_id", "n_links")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    whole = found.untouched.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    sha = F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    return whole.union(found.changed.select("doc_id", "n_words", "n_removed", sha))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or tokenizer_path()
    decoded = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs, F.array(docs["source"]))
    own = mixed.documents.withColumn("source", F.element_at("sources", 1))
    quotas = F.broadcast(mixed.quotas.select(F.col("source").alias("name"), F.col("size").alias("source_size"), "target"))  # a row a source
    return own.join(quotas, F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of its id: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    bad = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filter(table(spark, sf_dir, "pages"), outcomes, RULES)


def op8_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality(table(spark, sf_dir, "documents")).select("doc_id", *counts, "base_failed", "kept")


def op9_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest").drop("row")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_near(table(spark, sf_dir, "documents")).documents
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str, path: str | None = None, pieces: str | None = None) -> DataFrame:
    a, b = read_byte_tokenizer(path or tokenizer_path()), read_piece_tokenizer(pieces or tokenizer_path(PIECES))
    return align(table(spark, sf_dir, "documents"), a, b).documents.drop("row")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides the CRC-32 of the id, the leaf that is verified is that of a row with one more character."""
    docs = table(spark, sf_dir, "documents")
    changed = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf_hash([changed.get(f, F.col(f)) for f in FIELDS]))
    return verify(merkle_manifest(docs, carry={"claim": claim})).withColumnRenamed("key", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_ngram_jaccard_join,
        op2_substring_dedup,
        op3_html_extraction,
        op4_language_id,
        op5_bpe_round_trip,
        op6_source_mixing,
        op7_url_reputation,
        op8_quality_bands,
        op9_content_sort_dedup,
        op10_toxicity,
        op11_simhash_near_dedup,
        op12_tokenizer_alignment,
        op13_merkle_manifest,
    )
}
