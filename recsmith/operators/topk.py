"""Top-k per group and ranking orders.

A constant row_number bound lets Spark plan a partial WindowGroupLimit before
the shuffle, so each map task sends at most k rows per group: a hot group is
pre-limited on every partition instead of arriving whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score_order(score: str, *tiebreak: str) -> list[Column]:
    """score desc with NaN and null last (pandas/NumPy order), then ids asc."""
    s = F.col(score)
    return [F.when(s.isNull() | F.isnan(s), 1).otherwise(0).asc(), s.desc()] + [F.col(t).asc() for t in tiebreak]


def rank_within(df: DataFrame, by: list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """Rows with rank <= k per group (row_number, total order required)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= F.lit(k))


def topk_per_group(df: DataFrame, by: list[str], score: str, tiebreak: list[str], k: int,
                   k_col: str | None = None, k_max: int | None = None, rank_col: str = "rank") -> DataFrame:
    """k per group; with ``k_col`` every group has its own k, bounded by
    ``k_max`` (a constant bound first keeps the partial limit)."""
    bound = k_max if k_col else k
    out = rank_within(df, by, score_order(score, *tiebreak), bound, rank_col)
    if k_col:
        out = out.filter(F.col(rank_col) <= F.col(k_col))
    return out


def topk_global(df: DataFrame, score: str, tiebreak: list[str], k: int) -> DataFrame:
    """One ranking over the whole table: orderBy + limit is planned as
    TakeOrderedAndProject (per-partition top-k, then merge of k rows each)."""
    return df.orderBy(*score_order(score, *tiebreak)).limit(k)


def top_ids(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """value_counts().head(n): most frequent ids, ties by id asc."""
    c = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.col("n").desc(), F.col(key).asc()).limit(n)
