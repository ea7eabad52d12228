"""A training corpus from `documents`, in five stages of millrace.llm: each is written as Parquet and read by the next.

Language ID drops documents without a language (und, a score below `LEAST_SCORE`, or less in
common with the training sample than its own texts have: other languages and scripts, letters at random); SimHash near-dedup keeps one
document of each group; decontamination drops documents that hold a benchmark passage; mixing repeats and leaves out
documents so that sources reach their targets; the last stage writes token files and reads them back.

Null texts have no language and go in the first stage; empty tables pass through all stages; repeated rows are
duplicates and go in the second; columns besides those of `documents` are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, langid, mixing, simhash, tokens
from millrace.llm.common import materialise, table
from millrace.llm.queries import tokenizer_path

#: A score of 0.5 means that no language stands out from the others; clean short texts come near it. Texts unlike all
#: languages come near it too, so `langid.foreign` tells those.
LEAST_SCORE = 0.25


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with neutral column names, which no operator's output can clash with, and the way back."""
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(v).alias(k) for k, v in names.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.Classifier(langid.training_rows(docs))
    work, names = _aside(docs)
    found = langid.identify(work, model, names["text"], foreign=True)
    return _back(found.filter(~F.col("foreign") & (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    work, names = _aside(docs)
    found = decontaminate.contamination(work, table(spark, sf_dir, "benchmark"), names["text"])
    return _back(found.filter(~F.col("contaminated")), names)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sampled(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.tokens_of(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID output", encoded),
]

#: Fingerprints, kernels and token ids are no matter of SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
