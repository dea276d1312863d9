"""Corpus pipeline: toxicity, near duplicates, decontamination, source mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes each stage's result to the shared folder and reads it
again.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkslab.llm import decontaminate, jaccard, mixing, queries, tokens, toxicity
from sparkslab.plans.stage import new_path, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't call toxic; it learns outside fold 0 of 5.

    A null text is scored as an empty one, repeated rows alike.
    """
    return toxicity.clean(docs, toxicity.learn(docs, toxicity.training_fold(queries.table(spark, sf_dir, "labels"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class; of rows alike in id and text, one. A null id stays."""
    return jaccard.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture uses them: each at least once, small sources up to twice; a null source is one of its own."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mixture, read back; a null text is empty, a null id comes first."""
    return tokens.token_output(docs, queries.tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_tokens),
]

#: The models and the tokenizer are beyond SQL; each stage is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` on; what a stage itself has staged goes when its result is written."""
    docs = queries.table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        out = new_path(spark, f"pipeline-{i + 1}")
        with scratch(spark):
            made = step(spark, docs, sf_dir)
            made.write.option("compression", "zstd").parquet(out)
        docs = spark.read.schema(made.schema).parquet(out)
    return docs
