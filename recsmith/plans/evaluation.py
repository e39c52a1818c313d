"""Evaluation plans: bias baselines, ranking metrics over all models and
splits in one pass, candidate selection."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsmith.models.checkpoints import EpochStore
from recsmith.operators import metrics as M
from recsmith.operators import stats as ST

# fixed values: splits evaluated and cut-offs
EVAL_SPLITS = ("val", "test")
KS = (5, 10, 20)


def bias_scored(ix: DataFrame) -> DataFrame:
    """Every row with the bias prediction as ``score`` (and ``pred``)."""
    mu, users, items = ST.train_stats(ix)
    j = ST.bias_prediction(ST.join_user_item_stats(ix, users, items), mu)
    return j.withColumn("score", F.col("pred"))


def multi_model_scored(ix: DataFrame) -> DataFrame:
    """One long table (model, split, user, row, rating, score) for three
    bias-family scorers; evaluating it is one pass over all models."""
    mu, users, items = ST.train_stats(ix)
    j = ST.join_user_item_stats(ix, users, items)
    models = F.array(
        F.struct(F.lit("bias").alias("model"), (F.lit(mu) + F.col("user_bias") + F.col("item_bias")).alias("score")),
        F.struct(F.lit("item_bias").alias("model"), (F.lit(mu) + F.col("item_bias")).alias("score")),
        F.struct(F.lit("user_bias").alias("model"), (F.lit(mu) + F.col("user_bias")).alias("score")),
    )
    return j.select("row_id", "split", "user_id", "business_id", "rating", F.inline(models))


def bias_report(scored: DataFrame, model: str = "bias") -> DataFrame:
    """model, split, rmse, mae (all splits)."""
    r = ST.rmse_mae(scored, "pred", "rating", ["split"])
    return r.select(F.lit(model).alias("model"), "split", "rmse", "mae")


def evaluate(scored: DataFrame, by=("model", "split"), tiebreak=("row_id",), splits=EVAL_SPLITS, ks=KS) -> DataFrame:
    s = scored.filter(F.col("split").isin(*splits))
    return M.ranking_metrics(s, by=list(by), tiebreak=list(tiebreak), ks=ks)


def regularized_bias_candidates(ix: DataFrame, lambdas=(0.0, 1.0, 5.0, 10.0, 25.0)) -> DataFrame:
    """Validation RMSE of shrunk bias models b = sum(r - mu) / (n + lambda),
    one candidate per lambda, all from one aggregate per side."""
    train = ix.filter(F.col("split") == "train")
    mu = ST.global_mean_value(train)
    lam = F.explode(F.array(*[F.lit(float(x)) for x in lambdas])).alias("lam")
    u = (train.groupBy("user_id").agg(F.sum(F.col("rating") - F.lit(mu)).alias("su"), F.count(F.lit(1)).alias("nu")))
    i = (train.groupBy("business_id").agg(F.sum(F.col("rating") - F.lit(mu)).alias("si"), F.count(F.lit(1)).alias("ni")))
    val = ix.filter(F.col("split") == "val").select("user_id", "business_id", "rating", lam)
    j = val.join(u, "user_id", "left").join(i, "business_id", "left")
    pred = (F.lit(mu) + F.coalesce(F.col("su") / (F.col("nu") + F.col("lam")), F.lit(0.0))
            + F.coalesce(F.col("si") / (F.col("ni") + F.col("lam")), F.lit(0.0)))
    e = pred - F.col("rating")
    return j.groupBy("lam").agg(F.sqrt(F.avg(e * e)).alias("val_rmse"))


def best_candidate(curve: DataFrame, cand: str, metric: str, minimize: bool = True) -> DataFrame:
    """Candidate with the best metric, the first (smallest id) on ties."""
    if minimize:
        best = F.min_by(F.col(cand), F.struct(F.col(metric), F.col(cand)))
        val = F.min(metric)
    else:
        best = F.min_by(F.col(cand), F.struct(-F.col(metric), F.col(cand)))
        val = F.max(metric)
    return curve.agg(best.alias(f"best_{cand}"), val.alias(f"best_{metric}"))


def _bias_pred(rows: DataFrame, store: EpochStore, epoch: int) -> DataFrame:
    mu = float(store.load(epoch).state[0])
    users, items = (store.table(t, epoch).select(k, F.col("bias").alias(f"_{t}")) for t, k in (("users", "user_id"), ("items", "business_id")))
    j = rows.join(users, "user_id", "left").join(items, "business_id", "left")
    return j.withColumn("pred", F.lit(mu) + F.coalesce("_users", F.lit(0.0)) + F.coalesce("_items", F.lit(0.0)))


def bias_epoch_error(rows: DataFrame, store: EpochStore, epoch: int) -> dict[str, float]:
    """RMSE of a stored epoch's biases, by split."""
    e = F.col("pred") - F.col("rating")
    found = _bias_pred(rows, store, epoch).groupBy("split").agg(F.sqrt(F.avg(e * e)).alias("rmse")).collect()
    return {r["split"]: r["rmse"] for r in found if r["rmse"] is not None}


def fit_bias_epochs(ix: DataFrame, store: EpochStore, epochs: int, rate: float) -> EpochStore:
    """Bias model by damped steps: in every epoch each bias moves by ``rate`` of
    its distance to its mean residual. Every epoch is stored (train loss: mean
    squared error; metric: RMSE on val); a fit that stopped goes on after the
    last one."""
    done = store.last()
    if done is None:
        mu, users, items = ST.train_stats(ix)
        start = {"users": users.select("user_id", F.lit(0.0).alias("bias"), F.col("user_bias").alias("aim")),
                 "items": items.select("business_id", F.lit(0.0).alias("bias"), F.col("item_bias").alias("aim"))}
        store.save(0, np.array([mu]), 0, math.nan, math.nan, start)
        done = 0
    for ep in range(done + 1, epochs + 1):
        state = store.load(ep - 1).state
        step = (F.col("bias") + rate * (F.col("aim") - F.col("bias"))).alias("bias")
        tables = {t: store.table(t, ep - 1).select(k, step, "aim") for t, k in (("users", "user_id"), ("items", "business_id"))}
        # the metric reads the epoch's tables, and the epoch is complete with its metric: the tables first
        store.put(ep, state, tables)
        errors = bias_epoch_error(ix, store, ep)
        store.finish(ep, ep, errors.get("train", math.nan) ** 2, errors.get("val", math.nan))
    return store
