"""Corpus pipeline over documents: each stage's rows are written as Parquet and read as the next one's.

Language ID rejects documents without a language, the n-gram Jaccard join keeps one
document of each group, decontamination drops documents that hold a benchmark
item, the secret scan masks what it finds, and SentencePiece encodes and decodes
what is left. Stages keep every column of their input, whatever its name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import decontaminate, jaccard, language, pieces, secret_scan
from pulsegrid.llm.store import held_out, read_table, stored

#: A document stays when its language is known and the posterior of that language is at least this.
LEAST_SCORE = 0.2


def _row_and_text(docs: DataFrame) -> DataFrame:
    """All columns as one, so that no name clashes with an operator's, and the text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier, learned from the labelled part of ``docs``, accepts."""
    model = language.fit(docs.where(~held_out(F.col("doc_id"))), "text", "lang", "doc_id")
    scored = language.predict(_row_and_text(docs), "text", model)
    accepted = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return scored.where(accepted).select("row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at 75 percent Jaccard similarity."""
    return jaccard.one_of_each(docs, "doc_id", "text")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item to 75 percent of its shingles."""
    items = read_table(spark, sf_dir, "benchmark")
    counted = decontaminate.count_contained(_row_and_text(docs), "text", items, "item_id", "text")
    return counted.where("n_items = 0").select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in the text and n_chars counted again where that happened."""
    ratios = secret_scan.fit_markov(secret_scan.labelled_tokens(docs, secret_scan.TRAIN_ROWS))
    found = secret_scan.scan(_row_and_text(docs), "text", ratios)
    masked = secret_scan.redact(found, "text", "found")
    changed = F.size("found") > 0

    def column(name: str):
        own = F.col(f"row.`{name}`")
        if name == "text":
            own = F.col("text")
        elif name == "n_chars":
            own = F.when(changed, F.length("text").cast(docs.schema[name].dataType)).otherwise(own)
        return own.alias(name)

    return masked.select(*[column(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document that is left."""
    return pieces.encode_digests(docs.select("doc_id", "text"), "text", pieces.default_model()).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_language),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scan", mask_secrets),
    ("sentencepiece", encode),
]

#: No SQL form: the models, shingle sets and merges of the stages have none; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; returns what the last one returns."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
