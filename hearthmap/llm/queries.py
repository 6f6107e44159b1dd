"""The operators of this package as queries over the given tables: (spark, folder) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthmap.llm import alignment, attribution, bpe, infill, langid, licenses, lines, mixing, near, preferences, substrings, urls, vectors

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
BYTE_LEVEL_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(langid.fold(F.col("doc_id")) != 1).select("text", "lang"))
    # label and id do not enter the prediction
    known = langid.identify(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(langid.fold(F.col("doc_id")) == 1, F.lit(False))
    return known.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.clean_lines(_table(spark, sf_dir, "documents")).drop("cleaned")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return attribution.section_tokens(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


DIGESTS = {"n_tokens": "n_tokens", "ids_sha256": "ids_sha256", "decoded_sha256": "decoded_sha256"}


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(RANK_FILE))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.code(docs, ranks, public_tokenizers.PATTERN, DIGESTS)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = preferences.swapped_endings(_table(spark, sf_dir, "conversations"))
    pairs = preferences.format_pairs(turns)
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), " ")
    return pairs.withColumns({m: spans(F.col(m)) for m in ("chosen_mask", "rejected_mask")})


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(_table(spark, sf_dir, "documents")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.fill_in_middle(_table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = alignment.Files.read(public_tokenizers.path(BYTE_LEVEL_FILE), public_tokenizers.path(PIECE_FILE))
    aligned = alignment.align(_table(spark, sf_dir, "documents"), files).drop("groups")
    rated = alignment.rate_links(aligned, alignment.pair_list(files))
    return rated.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_substring_dedup,
        op3_quality_rules,
        op4_url_filter,
        op5_minhash_dedup,
        op6_token_counts,
        op7_embedding_dedup,
        op8_source_mix,
        op9_byte_bpe,
        op10_chat_format,
        op11_license_scan,
        op12_fill_in_middle,
        op13_tokenizer_alignment,
    )
}
