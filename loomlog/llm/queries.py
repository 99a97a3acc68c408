"""One registered query per operator, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import (
    bpe, decontaminate, ngram_join, quality_model, rank_bpe, spelling, substrings, surrogates, target_sampling, token_counts, url_filter,
    warc, weak_rules,
)
from loomlog.session import checkpointed

SURROGATE_KEY = "corpus-2024"  # for the registered queries; a real run brings a secret of its own
#: Where the public vocabularies lie; read on the driver only.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_sha256(column) -> F.Column:
    return F.sha2(F.encode(column, "UTF-8"), 256)


def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, token_counts.byte_vocabulary(BYTE_BPE), keep=["doc_id"])


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])
    return marked.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        hex_sha256(F.array_join("hit_items", ",")).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    weights = quality_model.train(docs, labels, "doc_id")
    scored = quality_model.score(docs, weights, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = checkpointed(weak_rules.measure(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    judged = weak_rules.judge(measured, weak_rules.fit(measured))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace(docs, SURROGATE_KEY).select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.without_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])
    return done.select("doc_id", "n_words", gone.alias("n_removed"), hex_sha256("kept").alias("kept_sha256"))


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(warc.with_revisits(table(spark, sf_dir, "pages")))
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.read_vocabulary(BYTE_BPE)
    encoded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"])
    decoded = bpe.decode(encoded, vocabulary)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hex_sha256(F.array_join("ids", ",")).alias("ids_sha256"),
        hex_sha256("decoded").alias("decoded_sha256"),
    )


def target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    drawn = target_sampling.resample(docs, target, share=(25, 100), least_words=20, seed="7", buckets=10_000)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = spelling.word_counts(table(spark, sf_dir, "documents"), one_in=97)
    return spelling.variants(counted.where("n >= 3"))


def rank_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = rank_bpe.read_ranks(BYTE_RANKS, public_tokenizers.PATTERN)
    encoded = rank_bpe.encode(table(spark, sf_dir, "documents"), told, keep=["doc_id"])
    return rank_bpe.decode(encoded, told).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_token_counts": token_count,
    "op2_ngram_jaccard_join": ngram_jaccard_join,
    "op3_url_filters": url_filters,
    "op4_pii_surrogates": pii_surrogates,
    "op5_quality_classifier": quality_classifier,
    "op6_benchmark_decontamination": benchmark_decontamination,
    "op7_substring_dedup": substring_dedup,
    "op8_warc": warc_round_trip,
    "op9_quality_rules": quality_rules,
    "op10_bpe": bpe_round_trip,
    "op11_target_resampling": target_resampling,
    "op12_spelling_variants": spelling_variants,
    "op13_rank_bpe": rank_bpe_round_trip,
}
