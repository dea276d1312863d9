"""Relevance of text groups to a query: TF-IDF or any embedding, by cosine."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkslab.functions.exprs import cosine
from sparkslab.plans.stage import stage

TOKEN = r"[\p{L}\p{N}_]{2,}"


class RelevanceSource(Protocol):
    """Scores groups of text against a query."""

    def score(self, groups: DataFrame, query: str) -> DataFrame:
        """(group_id, relevance)."""


class TfidfRelevance:
    """Cosine of smoothed TF-IDF vectors; a group's text may lie in many rows of (group_id, text).

    The query counts as one more text for document frequencies.  Counts are
    aggregated by group and term, so a group's rows are never put together.
    """

    def score(self, groups: DataFrame, query: str) -> DataFrame:
        """(group_id, relevance) for every group; null and empty texts have no terms."""
        spark = groups.sparkSession
        terms = F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(f"({TOKEN})"), 1)).alias("term")
        counts = stage(groups.select("group_id", terms).groupBy("group_id", "term").agg(F.count("*").alias("tf")), "tfidf-counts")
        asked = spark.createDataFrame([(query,)], "text string").select(terms).groupBy("term").agg(F.count("*").alias("qtf"))
        ids = stage(groups.select("group_id").distinct(), "tfidf-groups")
        n = ids.count() + 1
        df = counts.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(asked), "term", "full").select("term", (F.coalesce("df", F.lit(0)) + F.when(F.col("qtf").isNotNull(), 1).otherwise(0)).alias("df"), "qtf")
        idf = df.select("term", "qtf", (F.ln((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
        q2 = idf.where("qtf is not null").agg(F.sum((F.col("qtf") * F.col("idf")) ** 2)).first()[0] or 0.0
        w = F.col("tf") * F.col("idf")
        sums = counts.join(idf, "term").groupBy("group_id").agg(F.sum(w * w).alias("g2"), F.sum(F.when(F.col("qtf").isNotNull(), w * F.col("qtf") * F.col("idf")).otherwise(0.0)).alias("dot"))
        scored = sums.select("group_id", (F.col("dot") / (F.sqrt("g2") * F.sqrt(F.lit(float(q2))) + 1e-12)).alias("relevance"))
        return ids.join(scored, "group_id", "left").select("group_id", F.coalesce("relevance", F.lit(0.0)).alias("relevance"))


class EmbeddingRelevance:
    """Cosine under ``embed``, a function of a text Column to an array Column (a pandas UDF, for one)."""

    def __init__(self, embed: Callable[[Column], Column]) -> None:
        self.embed = embed

    def score(self, groups: DataFrame, query: str) -> DataFrame:
        """(group_id, relevance), one row for each row of the groups."""
        return groups.select("group_id", cosine(self.embed(F.col("text")), self.embed(F.lit(query))).alias("relevance"))
