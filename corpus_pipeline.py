"""Corpus preparation: language, near duplicates, contamination, personal data, tokens.

Each stage is a function of (spark, docs, sf_dir) that works on all rows its
predecessor kept. All but the last return the columns of ``documents``.

Edge cases: nulls and empty texts are as each operator defines them; texts
without a letter go in the first stage; empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrace.llm import decontaminate, jaccard_join, language_id, pii
from voltrace.llm.components import durable
from voltrace.llm.queries import default_tokenizer, token_digests

#: Documents whose likeliest language has less than this likelihood are rejected, like those without one.
MIN_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; the given one is only learned from."""
    held_out = F.coalesce(language_id.remainder("doc_id", 5) == 0, F.lit(False))
    model = language_id.fit(docs, ~held_out)
    if not model.languages:  # nothing to learn from: only texts without a letter are known to have none
        return docs.where(F.col("text").rlike(r"\p{L}"))
    got = language_id.predict(docs, model)
    return got.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least id of each group of similar ones."""
    return jaccard_join.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    masked = pii.redact(docs, pii.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests."""
    return token_digests(docs, default_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("personal_data", mask_personal_data),
    ("tokens", tokenize),
]
#: Fitted models and the similarity join aren't SQL; a brute-force version in the tests stands in.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents`` one after another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
