"""Queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, fingerprints, html_text, language_model, near_dedup, periodic_runs, quality_model, quality_rules, snapshot_diff, suffix_dedup, token_files, toxicity
from .common import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in ("documents", "pages") else found


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null and empty pages give an empty text, repeated
    rows a row each."""
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text by a model of the labelled rows outside the held-out
    fold; null texts count as empty and get a score, repeated rows a row each,
    rows without an id are scored and not held out."""
    docs = table(spark, sf_dir, "documents")
    return quality_model.score_quality(docs, quality_model.fit_quality(docs, table(spark, sf_dir, "labels")))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every text, null texts as empty ones (their end is
    one token); repeated rows train and score each, rows without an id score
    only."""
    docs = table(spark, sf_dir, "documents")
    return language_model.score(docs, language_model.fit(docs))


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of token ids and of the decoded text of every document; null and
    empty texts have no ids, repeated rows a row each."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of every text; null and blank texts have no words and
    fail, repeated rows are judged each."""
    return quality_rules.judged(table(spark, sf_dir, "documents")).drop("rejected_by")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it holds; null and empty texts
    hold none and have no row, repeated rows are reported each."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by a model of the labelled rows outside the held-out
    fold; null and empty texts get the lowest value, repeated rows a row each."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit_documents(docs, table(spark, sf_dir, "labels")))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each text loses to strings that occur elsewhere; null and empty texts
    have no bytes, repeated rows repeat each other and both lose."""
    return suffix_dedup.removal(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicates; null and wordless texts stand alone, equal texts
    are one class, rows without an id never represent one."""
    return near_dedup.classes_of(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files written and read back; null and empty texts are their end id
    alone, rows without an id come first, repeated rows are written each."""
    return token_files.read_token_files(token_files.write_token_files(table(spark, sf_dir, "documents")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run and digests of all runs, a tenth of the texts made periodic."""
    docs = periodic_runs.with_planted_periods(table(spark, sf_dir, "documents"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(docs))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k fingerprints of every text and of its edited text."""
    return fingerprints.with_edited(table(spark, sf_dir, "documents"))


def op13_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` against a later state of it."""
    return snapshot_diff.documents_diff(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {n: f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": quality_rules.ORACLE_SQL, "op13_snapshot_diff": snapshot_diff.ORACLE_SQL}
