"""Documents to packed sequences: five stages, each on all rows that the one before it kept.

Each stage takes (spark, docs, sf_dir). Between two stages the rows are written as Parquet and
read again. Any columns besides those of ``documents`` are carried along, whatever their names.

Defined cases, of every stage: an empty table gives an empty one. Null and empty texts fail the
quality rules and have no language; where a stage is given them all the same, the Jaccard join
keeps them all, the secret scan leaves them, and packing gives each one piece with the end token.
Null ids are ids like any other, and rows are told apart by id and text. Repeated rows count as
often as they occur in rules and sampling; the Jaccard join keeps one. Of ties (equal ids within
a class) the one with the least hash of its text stays. Very long texts go through every stage whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundline.llm import jaccard, language, packing, quality, queries, secrets
from groundline.llm.common import Scratch, table


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns under names that clash with none of an operator's own."""
    names = {c: f"__c{n}" for n, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or whose host is rejected."""
    own, name = _numbered(docs)
    ruled = quality.host_rules(spark, own, own.columns, name["source"], name["text"])
    return ruled.where("kept").select(*own.columns).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose two best languages are too close."""
    return language.keep_predicted(spark, docs, language.learn(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    own, name = _numbered(docs)
    return jaccard.one_of_each(spark, own, name["doc_id"], name["text"]).toDF(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; keeps every document."""
    return secrets.redact(spark, docs, secrets.train(docs), length="n_chars" if "n_chars" in docs.columns else None)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(spark, docs, queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("byte_bpe_50k.tiktoken"), queries.split_pattern())


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Compression sizes, minima of hash functions and a trained network have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{number}-{name}")
        if number:
            scratch.drop(f"{number - 1}-{STAGES[number - 1][0]}")
    return docs
