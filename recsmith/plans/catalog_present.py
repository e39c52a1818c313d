"""Registered request and presentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from recsmith import oracle_sql as O
from recsmith.functions import presentation as PR
from recsmith.operators import metadata as MD
from recsmith.plans import recommend as R
from recsmith.plans.catalog_rank import RECOMMEND_SQL
from recsmith.registry import register
from recsmith.sources import testdata as td

REQ_CTE = """req AS (
  SELECT vec_id AS query_id,
         CASE WHEN vec_id % 5 = 0 THEN NULL ELSE 'query ' || CAST(vec_id AS VARCHAR) END AS query_text,
         CASE WHEN vec_id % 7 = 0 THEN NULL ELSE CAST(vec_id % 53 - 1 AS INTEGER) END AS k,
         CASE vec_id % 3 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 END AS wj,
         CASE vec_id % 3 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 END AS wt
  FROM embeddings)"""


def raw_requests(spark, d):
    """Requests with edge cases by rule: null text, null k, k outside 1..50."""
    base = td.query_requests(spark, d)
    v = F.col("query_id")
    return base.select(
        "query_id",
        F.when(v % 5 == 0, F.lit(None)).otherwise(F.col("query_text")).alias("query_text"),
        F.when(v % 7 == 0, F.lit(None)).otherwise(v % 53 - 1).cast("int").alias("k"),
        "weights", "query_emb")


@register("request_validation", f"""WITH {REQ_CTE}
  SELECT query_id, coalesce(query_text, '') AS query_text, coalesce(k, 10) AS k,
         coalesce(wj, 1.0) AS w_joint, coalesce(wt, 10.0) AS w_text,
         CAST(coalesce(k, 10) BETWEEN 1 AND 50 AS INTEGER) AS valid FROM req""")
def q_request_validation(spark, d):
    return R.validate_requests(raw_requests(spark, d)).drop("query_emb")


@register("mode_to_weights", """SELECT vec_id AS query_id, (vec_id % 11) / 10.0 AS mode, 1.0 AS w_joint,
    round((vec_id % 11) / 10.0 * 20.0, 6) AS w_text,
    CASE WHEN (vec_id % 11) / 10.0 < 0.2 THEN 'Discovery (Model Only)' WHEN (vec_id % 11) / 10.0 < 0.4 THEN 'Balanced'
         WHEN (vec_id % 11) / 10.0 < 0.7 THEN 'Search (Default)' ELSE 'Strict Match' END AS mode_label
  FROM embeddings""")
def q_mode_to_weights(spark, d):
    e = td.table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"),
                                                ((F.col("vec_id") % 11) / 10.0).alias("mode"))
    return e.select("query_id", "mode", *PR.mode_to_weights("mode"))


@register("result_presentation", f"""WITH r AS ({RECOMMEND_SQL})
  SELECT query_id, rank,
    round(least(CASE WHEN joint_score IS NULL OR isnan(joint_score) OR joint_score = 0 THEN 0.0 ELSE joint_score END / 8.0 * 100.0, 100.0), 6) AS joint_pct,
    round(least(CASE WHEN text_similarity IS NULL OR isnan(text_similarity) OR text_similarity = 0 THEN 0.0 ELSE text_similarity END / 15.0 * 100.0, 100.0), 6) AS text_pct,
    CASE WHEN representative_image_url IS NULL OR representative_image_url = '' THEN '{PR.CARD_PLACEHOLDER}'
         WHEN starts_with(representative_image_url, '/') THEN '{PR.ORIGIN}' || representative_image_url
         ELSE representative_image_url END AS img_src,
    coalesce(nullif(name, ''), '{PR.UNKNOWN_NAME}') AS display_name,
    CAST(coalesce(num_reviews, 0) AS BIGINT) AS display_reviews,
    CASE WHEN score IS NULL THEN NULL ELSE
      (CASE WHEN CAST(round(score * 1e6) AS BIGINT) < 0 THEN '-' ELSE '' END)
      || CAST((abs(CAST(round(score * 1e6) AS BIGINT)) + 50000) // 100000 // 10 AS VARCHAR) || '.'
      || CAST((abs(CAST(round(score * 1e6) AS BIGINT)) + 50000) // 100000 % 10 AS VARCHAR) END AS score_label
  FROM r""")
def q_result_presentation(spark, d):
    """Card fields over the flagship output (inputs are its 6-decimal values)."""
    from recsmith.registry import round_floats
    r = round_floats(R.recommend_testdata(spark, d))
    return r.select("query_id", "rank", *PR.result_presentation())


@register("star_buckets", f"""WITH {O.records_cte()}, {O.metadata_cte()}
  SELECT business_id,
    CAST(least(greatest(floor(avg_rating), 0), 5) AS INTEGER) AS full_stars,
    CASE WHEN floor(avg_rating) >= 0 AND floor(avg_rating) < 5 AND avg_rating - floor(avg_rating) >= 0.5 THEN 1 ELSE 0 END AS half_star,
    5 - CAST(least(greatest(floor(avg_rating), 0), 5) AS INTEGER)
      - CASE WHEN floor(avg_rating) >= 0 AND floor(avg_rating) < 5 AND avg_rating - floor(avg_rating) >= 0.5 THEN 1 ELSE 0 END AS empty_stars
  FROM md""")
def q_star_buckets(spark, d):
    md = MD.first_metadata_per_item(td.interactions(spark, d, with_pics=True, with_name=True))
    return md.select("business_id", *PR.star_buckets("avg_rating"))


@register("star_buckets_mean", f"""WITH {O.ix_cte()},
  m AS (SELECT business_id, avg(rating) AS a FROM ix WHERE business_id IS NOT NULL GROUP BY business_id)
  SELECT business_id,
    CAST(least(greatest(floor(a), 0), 5) AS INTEGER) AS full_stars,
    CASE WHEN floor(a) >= 0 AND floor(a) < 5 AND a - floor(a) >= 0.5 THEN 1 ELSE 0 END AS half_star,
    5 - CAST(least(greatest(floor(a), 0), 5) AS INTEGER)
      - CASE WHEN floor(a) >= 0 AND floor(a) < 5 AND a - floor(a) >= 0.5 THEN 1 ELSE 0 END AS empty_stars
  FROM m""")
def q_star_buckets_mean(spark, d):
    """Stars for the true mean rating of each business (fractional values)."""
    m = td.interactions(spark, d).filter(F.col("business_id").isNotNull()).groupBy("business_id").agg(
        F.avg("rating").alias("a"))
    return m.select("business_id", *PR.star_buckets("a"))


@register("detail_presentation", f"""WITH {O.records_cte()}, {O.metadata_cte()}
  SELECT business_id, coalesce(printf('%.1f', avg_rating), 'N/A') AS rating_label,
    coalesce(CAST(num_reviews AS VARCHAR), '') || ' reviews' AS reviews_label,
    CAST(NULL AS VARCHAR) AS location_label, 'Address not available' AS address_label,
    coalesce(name, '') || ' is located in .' AS about,
    CASE WHEN image_url IS NULL OR image_url = '' THEN '{PR.DETAIL_PLACEHOLDER}'
         WHEN starts_with(image_url, '/') THEN '{PR.ORIGIN}' || image_url ELSE image_url END AS img_src
  FROM md""")
def q_detail_presentation(spark, d):
    md = MD.first_metadata_per_item(td.interactions(spark, d, with_pics=True, with_name=True))
    det = MD.item_detail_lookup(md.select("business_id"), md)
    return det.select("business_id", *PR.detail_presentation())
