"""From raw documents to token ids: each stage works on all that the one before it kept.

``run(spark, sf_dir)`` applies the stages to ``documents``. A stage is written as Parquet in the shared
folder and read again before the next one, so a lost executor never goes back behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import bpe, decontaminate, ngram_join, surrogates, weak_rules
from loomlog.llm.queries import BYTE_BPE, SURROGATE_KEY
from loomlog.session import new_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the posterior of the votes accept; the texts are measured once, and written with the measures."""
    written = f"{new_folder(spark, 'measured')}/documents"
    weak_rules.measure(docs).write.parquet(written)
    measured = spark.read.parquet(written)
    return weak_rules.accepted(weak_rules.judge(measured, weak_rules.fit(measured))).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id."""
    return ngram_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, of items without an id too."""
    marked = decontaminate.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where(F.size("spans") == 0).select(*docs.columns)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for personal data, and their new lengths."""
    return surrogates.replace(docs, SURROGATE_KEY).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they decode to."""
    vocabulary = bpe.read_vocabulary(BYTE_BPE)
    encoded = bpe.encode(docs, vocabulary, keep=["doc_id", "lang", "source"])
    return bpe.decode(encoded, vocabulary, into="text").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("bpe", bpe_tokens),
]

#: The votes' posterior and the surrogates cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "corpus")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
