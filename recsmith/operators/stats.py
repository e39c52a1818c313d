"""Train-only statistics: global mean, user / item bias, history lengths,
z-score fitting. All are map-side-combined aggregates (partial + final), so a
hot user or item never gathers its rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def global_mean(df: DataFrame, col: str = "rating") -> DataFrame:
    """One row: mu = mean(col) (nulls ignored)."""
    return df.agg(F.avg(col).alias("mu"))


def global_mean_value(df: DataFrame, col: str = "rating") -> float:
    """mu as a driver scalar (a single number; used as a literal)."""
    v = global_mean(df, col).first()[0]
    return float(v) if v is not None else 0.0


def user_item_stats(train: DataFrame, mu: float, key: str, prefix: str, rating: str = "rating") -> DataFrame:
    """Per key: <prefix>_bias = mean(rating) - mu, <prefix>_hist_len = rows.

    Null keys are dropped first (a pandas groupby drops them; Spark would keep
    a null group).
    """
    return (train.filter(F.col(key).isNotNull())
            .groupBy(key)
            .agg((F.avg(rating) - F.lit(mu)).alias(f"{prefix}_bias"),
                 F.count(F.lit(1)).cast("int").alias(f"{prefix}_hist_len")))


def train_stats(ix: DataFrame, split: str | None = "train", rating: str = "rating"):
    """(mu, user_stats, item_stats) fitted on one split."""
    train = ix.filter(F.col("split") == split) if split else ix
    mu = global_mean_value(train, rating)
    users = user_item_stats(train, mu, "user_id", "user", rating)
    items = user_item_stats(train, mu, "business_id", "item", rating)
    return mu, users, items


def join_user_item_stats(df: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Two left equi joins; unseen users / items get 0 for all four stats.

    No broadcast hint: the planner broadcasts by measured size and otherwise
    shuffles both sides on the key (stats tables grow with users / items).
    """
    out = df.join(users, "user_id", "left").join(items, "business_id", "left")
    return out.fillna(0, subset=["user_hist_len", "item_hist_len"]).fillna(
        0.0, subset=["user_bias", "item_bias"])


def bias_prediction(df: DataFrame, mu: float) -> DataFrame:
    """pred = mu + b_u + b_i, after join_user_item_stats."""
    return df.withColumn("pred", F.lit(mu) + F.col("user_bias") + F.col("item_bias"))


def zscore_fit(train: DataFrame, cols: list[str]) -> dict:
    """Per column mean and population std (std 0 or undefined -> 1)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = train.agg(*aggs).first()
    out = {}
    for c in cols:
        m = row[f"m_{c}"]
        s = row[f"s_{c}"]
        out[c] = (float(m) if m is not None else 0.0,
                  1.0 if (s is None or s == 0.0) else float(s))
    return out


def zscore_apply(df: DataFrame, params: dict, suffix: str = "_z") -> DataFrame:
    for c, (m, s) in params.items():
        df = df.withColumn(c + suffix, (F.col(c).cast("double") - F.lit(m)) / F.lit(s))
    return df


def rmse_mae(df: DataFrame, pred: str = "pred", label: str = "rating", by: list[str] | None = None) -> DataFrame:
    e = F.col(pred) - F.col(label).cast("double")
    aggs = [F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
            F.count(F.lit(1)).alias("n")]
    return df.groupBy(*(by or [])).agg(*aggs)
