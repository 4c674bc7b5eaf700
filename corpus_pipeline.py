"""A corpus pipeline: quality rules, language, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet to the shared folder and hands the reread table to the next. All stages but the last
return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionflow.llm import covering_simhash, host_quality, mixture_packing, string_kernel, surrogates
from ionflow.llm.common import drop_all, materialise

TOKENIZER = "word_bpe_49k.json"
#: Scratch tables of the quality stage. A stage's result is written before the next one begins, which drops them.
_HELD: list[str] = []


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, on hosts that are not blocked, without soft failures that count there."""
    return host_quality.filter_documents(docs, held=_HELD)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the string kernel tells; the rest go."""
    drop_all(spark, _HELD)
    return string_kernel.filter_documents(docs, string_kernel.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return covering_simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; ``n_chars``, where it is given, is that of the new text."""
    new = surrogates.pseudonymise(docs)
    if "n_chars" not in docs.columns:
        return new
    return new.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens, mixed by source."""
    return mixture_packing.pack(docs, TOKENIZER, rest=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Fingerprints, kernels, permutations and BPE are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
