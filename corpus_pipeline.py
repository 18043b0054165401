"""From raw documents to token ids: five stages, each on all that the one
before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import bpe, decontaminate, near_dedup, quality_rules, suffix_dedup
from papyra.llm.common import drop_table, materialize


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go, texts that are null or blank with
    them; repeated rows are judged each."""
    return quality_rules.cascade(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in their five-word shingles one stays, of repeated rows
    too; wordless texts stand alone, a row without an id stays only for itself."""
    return near_dedup.deduplicated(docs, k=5)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes and passages of 50 words that occur twice or more are
    cut from the texts; null, empty and short texts stay as they are, n_chars
    follows the text."""
    cut = suffix_dedup.without_repeats(docs, words=True)
    changed = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return cut.withColumns(changed)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts stay, repeated
    rows are judged each, an empty benchmark lets all pass."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their digests, per document; null and empty texts have none,
    repeated rows a row each."""
    return bpe.encode_documents(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("quality_rules", rules),
    ("minhash_near_dedup", near_copies),
    ("suffix_array_dedup", repeats),
    ("benchmark_decontamination", benchmarks),
    ("bpe_encode_decode", tokens),
]

#: Near-duplicate components and byte-level suffix matches are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
            if k:
                drop_table(before)
    return docs
