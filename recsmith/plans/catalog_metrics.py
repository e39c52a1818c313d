"""Registered evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from recsmith import oracle_sql as O
from recsmith.operators import metrics as M
from recsmith.operators import stats as ST
from recsmith.operators import topk as TK
from recsmith.plans import evaluation as EV
from recsmith.registry import register
from recsmith.sources import testdata as td

IX = O.ix_cte()
SCORED = f"""{IX}, {O.stats_ctes()},
  sc AS (SELECT ix.*, (SELECT mu FROM mu) + coalesce(us.user_bias, 0.0) + coalesce(ist.item_bias, 0.0) AS score
         FROM ix LEFT JOIN us USING (user_id) LEFT JOIN ist USING (business_id))"""


def _scored(spark, d):
    return EV.bias_scored(td.interactions(spark, d))


@register("positive_flag", f"WITH {IX} SELECT row_id, CAST(coalesce(rating >= 4.0, false) AS INTEGER) AS is_pos FROM ix")
def q_positive_flag(spark, d):
    return td.interactions(spark, d).select("row_id", M.positive_flag().cast("int").alias("is_pos"))


@register("user_ranking", f"""WITH {SCORED}
  SELECT split, user_id, row_id, CAST(rk AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY split, user_id ORDER BY score DESC, row_id) AS rk FROM sc
    WHERE split IN ('val', 'test')) WHERE rk <= 20""")
def q_user_ranking(spark, d):
    s = _scored(spark, d).filter(F.col("split").isin(*EV.EVAL_SPLITS))
    r = TK.rank_within(s, ["split", "user_id"], TK.score_order("score", "row_id"), 20)
    return r.select("split", "user_id", "row_id", F.col("rank").cast("int").alias("rank"))


@register("precision_recall_at_k", f"""WITH {SCORED}
  SELECT split, user_id, k, round(precision, 6) AS precision, round(recall, 6) AS recall
  FROM ({O.per_user_metrics_sql('sc', ['split'], ['row_id'])})""")
def q_precision_recall_at_k(spark, d):
    s = _scored(spark, d).filter(F.col("split").isin(*EV.EVAL_SPLITS))
    return M.per_user_metrics(s, by=["split"]).select("split", "user_id", "k", "precision", "recall")


@register("ndcg_at_k", f"""WITH {SCORED}
  SELECT split, user_id, k, round(ndcg, 6) AS ndcg FROM ({O.per_user_metrics_sql('sc', ['split'], ['row_id'])})""")
def q_ndcg_at_k(spark, d):
    s = _scored(spark, d).filter(F.col("split").isin(*EV.EVAL_SPLITS))
    return M.per_user_metrics(s, by=["split"]).select("split", "user_id", "k", "ndcg")


@register("ranking_metrics_mean", f"WITH {SCORED} {O.metrics_mean_sql('sc', ['split'], ['row_id'])}")
def q_ranking_metrics_mean(spark, d):
    return EV.evaluate(_scored(spark, d), by=["split"])


RMSE_SQL = f"""WITH {SCORED}
  SELECT split, round(sqrt(avg((score - rating) * (score - rating))), 6) AS rmse,
         round(avg(abs(score - rating)), 6) AS mae, count(*) AS n FROM sc GROUP BY split"""


@register("rmse_mae", RMSE_SQL)
def q_rmse_mae(spark, d):
    return ST.rmse_mae(_scored(spark, d), "pred", "rating", ["split"])


@register("bias_baseline_report", f"""WITH {SCORED}
  SELECT 'bias' AS model, split, round(sqrt(avg((score - rating) * (score - rating))), 6) AS rmse,
         round(avg(abs(score - rating)), 6) AS mae FROM sc GROUP BY split""")
def q_bias_baseline_report(spark, d):
    return EV.bias_report(_scored(spark, d))


MULTI = f"""{IX}, {O.stats_ctes()},
  j AS (SELECT ix.*, coalesce(us.user_bias, 0.0) AS ub, coalesce(ist.item_bias, 0.0) AS ib, (SELECT mu FROM mu) AS m
        FROM ix LEFT JOIN us USING (user_id) LEFT JOIN ist USING (business_id)),
  msc AS (SELECT row_id, split, user_id, rating, 'bias' AS model, m + ub + ib AS score FROM j
          UNION ALL SELECT row_id, split, user_id, rating, 'item_bias', m + ib FROM j
          UNION ALL SELECT row_id, split, user_id, rating, 'user_bias', m + ub FROM j)"""


@register("evaluate_models", f"WITH {MULTI} {O.metrics_mean_sql('msc', ['model', 'split'], ['row_id'])}")
def q_evaluate_models(spark, d):
    return EV.evaluate(EV.multi_model_scored(td.interactions(spark, d)), by=["model", "split"])


@register("union_metrics", f"""WITH {MULTI}
  SELECT model, split, round(sqrt(avg((score - rating) * (score - rating))), 6) AS rmse,
         round(avg(abs(score - rating)), 6) AS mae FROM msc GROUP BY model, split""")
def q_union_metrics(spark, d):
    ms = EV.multi_model_scored(td.interactions(spark, d))
    parts = []
    for model in ("bias", "item_bias", "user_bias"):
        one = ms.filter(F.col("model") == model).withColumn("pred", F.col("score"))
        parts.append(EV.bias_report(one, model))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


CAND_SQL = f"""WITH {IX},
  mu AS (SELECT avg(rating) AS mu FROM ix WHERE split = 'train'),
  u AS (SELECT user_id, sum(rating - (SELECT mu FROM mu)) AS su, count(*) AS nu FROM ix WHERE split = 'train' GROUP BY user_id),
  i AS (SELECT business_id, sum(rating - (SELECT mu FROM mu)) AS si, count(*) AS ni FROM ix WHERE split = 'train' GROUP BY business_id),
  lams AS (SELECT unnest([0.0, 1.0, 5.0, 10.0, 25.0]) AS lam),
  c AS (SELECT lam, sqrt(avg(power((SELECT mu FROM mu) + coalesce(su / (nu + lam), 0.0) + coalesce(si / (ni + lam), 0.0) - rating, 2))) AS val_rmse
        FROM ix CROSS JOIN lams LEFT JOIN u USING (user_id) LEFT JOIN i USING (business_id)
        WHERE split = 'val' GROUP BY lam)"""


@register("bias_candidates", f"WITH {CAND_SQL[5:]} SELECT lam, round(val_rmse, 6) AS val_rmse FROM c")
def q_bias_candidates(spark, d):
    return EV.regularized_bias_candidates(td.interactions(spark, d))


@register("best_epoch", f"""WITH {CAND_SQL[5:]}
  SELECT arg_min(lam, val_rmse) AS best_lam, round(min(val_rmse), 6) AS best_val_rmse FROM c""")
def q_best_epoch(spark, d):
    return EV.best_candidate(EV.regularized_bias_candidates(td.interactions(spark, d)), "lam", "val_rmse")


# ---------------------------------------------------------------- large ratings table

RL = O.ratings_large_cte()
RL_SCORED = f"""{RL}, {O.stats_ctes('rl')},
  sc AS (SELECT rl.*, (SELECT mu FROM mu) + coalesce(us.user_bias, 0.0) + coalesce(ist.item_bias, 0.0) AS score
         FROM rl LEFT JOIN us USING (user_id) LEFT JOIN ist USING (business_id))"""


def _rl_scored(spark, d):
    rl = td.ratings_large(spark, d)
    mu, users, items = ST.train_stats(rl)
    return ST.bias_prediction(ST.join_user_item_stats(rl, users, items), mu).withColumn("score", F.col("pred"))


@register("bias_baseline_report_large", f"""WITH {RL_SCORED}
  SELECT 'bias' AS model, split, round(sqrt(avg((score - rating) * (score - rating))), 6) AS rmse,
         round(avg(abs(score - rating)), 6) AS mae FROM sc GROUP BY split""")
def q_bias_baseline_report_large(spark, d):
    return EV.bias_report(_rl_scored(spark, d))


@register("ranking_metrics_large", f"""WITH {RL_SCORED}
  {O.metrics_mean_sql('sc', ['split'], ['business_id'] + td.RATINGS_LARGE_KEY)}""")
def q_ranking_metrics_large(spark, d):
    return EV.evaluate(_rl_scored(spark, d), by=["split"], tiebreak=["business_id"] + td.RATINGS_LARGE_KEY)
