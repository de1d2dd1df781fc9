"""Ranked hit lists: top-k by group, first-of-key, min-max scaling, fusion, relaxation levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Scores are ordered after rounding to so many digits, so that engines that add in other orders agree on ranks.
DIGITS = 9


def top_k(hits: DataFrame, k: int, by: Sequence[str] = ("qid",), score: str = "score", tie: Sequence[str] = ("key",)) -> DataFrame:
    """The k best hits of each group with their rank; ties go to the lower key."""
    w = Window.partitionBy(*by).orderBy(F.round(score, DIGITS).desc(), *tie)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def first_of(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__n")


def min_max(hits: DataFrame, score: str, out: str, by: Sequence[str] = ("qid",)) -> DataFrame:
    """Scores scaled to 0 to 1 within each group; 1 where all are alike."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return hits.withColumn(out, F.when(high - low < 1e-12, 1.0).otherwise((F.col(score) - low) / (high - low)))


def fuse(dense: DataFrame, lexical: DataFrame, k: int, dense_weight: float = 0.5, lexical_weight: float = 0.5) -> DataFrame:
    """Full outer merge of two hit lists (qid, key, score, rank) by weighted scaled scores; a missing side counts 0.

    Ties go to the better dense rank, then the better lexical one, then the lower key.
    """
    a = min_max(dense, "score", "dense_norm").select("qid", "key", F.col("score").alias("dense_score"), "dense_norm", F.col("rank").alias("dense_rank"))
    b = min_max(lexical, "score", "bm25_norm").select("qid", "key", F.col("score").alias("bm25_score"), "bm25_norm", F.col("rank").alias("bm25_rank"))
    both = a.join(b, ["qid", "key"], "full_outer").fillna(0.0, ["dense_norm", "bm25_norm"])
    both = both.withColumn("score", dense_weight * F.col("dense_norm") + lexical_weight * F.col("bm25_norm"))
    w = Window.partitionBy("qid").orderBy(F.round("score", DIGITS).desc(), F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last(), "key")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def relaxed(pairs: DataFrame, levels: Sequence[Column], by: Sequence[str] = ("qid",)) -> DataFrame:
    """Of each group the rows at its lowest level, where a row's level is the first condition that it meets."""
    level = F.when(F.lit(False), 0)
    for i, test in enumerate(levels):
        level = level.when(test, i)
    marked = pairs.withColumn("level", level).filter("level is not null")
    return marked.withColumn("__m", F.min("level").over(Window.partitionBy(*by))).filter("level = __m").drop("__m")
