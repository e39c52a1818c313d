"""Diagnostics on the ranking: base vs query-steered top-k and their
overlap, per request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsmith.operators import similarity as SIM
from recsmith.operators import topk as TK

# fixed value: similarity weight of the steering diagnostic
STEER_WEIGHT = 0.5


def base_top(items: DataFrame, k: int = 10) -> DataFrame:
    """Query-independent top-k by base score (computed once, k rows)."""
    t = TK.topk_global(items.select("business_id", "base"), "base", ["business_id"], k)
    return TK.rank_within(t, [], TK.score_order("base", "business_id"), k)


def steered_top(items: DataFrame, queries: DataFrame, k: int = 10, lam: float = STEER_WEIGHT) -> DataFrame:
    """Per query top-k of base + lam * cosine (queries: query_id, qvec)."""
    q = queries.select("query_id", "qvec", F.lit(1.0).alias("w_joint"), F.lit(float(lam)).alias("w_text"))
    c = SIM.similarity_topk(items, q, k)
    return SIM.rank_candidates(c, None, k, k)


def topk_overlap(base: DataFrame, steered: DataFrame, queries: DataFrame) -> DataFrame:
    """|base top-k ∩ steered top-k| per query (0 when disjoint). The base set
    has k rows, so it is broadcast by construction."""
    hit = steered.join(F.broadcast(base.select("business_id")), "business_id", "inner")
    cnt = hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("overlap"))
    return (queries.select("query_id").join(cnt, "query_id", "left")
            .select("query_id", F.coalesce(F.col("overlap"), F.lit(0)).alias("overlap")))


def query_steering(items: DataFrame, queries: DataFrame, k: int = 10, show: int = 5) -> DataFrame:
    """Per query: overlap of base and steered top-k, first ``show`` ids of each.

    The base list is query independent (k rows): it is read once and used as
    a literal. The steered top-k (the blocked similarity product) is consumed
    by ONE aggregate that yields both the overlap and the top ids, so the
    product runs once; the per-query list holds at most ``show`` ids."""
    base = sorted((int(r["rank"]), r["business_id"]) for r in base_top(items, k).collect())   # k rows
    base_ids = [bid for _, bid in base]
    top_base = ",".join(base_ids[:show]) if base_ids else None
    s = steered_top(items, queries, k)
    in_base = (F.col("business_id").isin(*base_ids)) if base_ids else F.lit(False)
    first = F.when(F.col("rank") <= show, F.struct("rank", "business_id"))
    agg = s.groupBy("query_id").agg(F.count(F.when(in_base, 1)).alias("overlap"),
                                    F.array_sort(F.collect_list(first)).alias("_l"))
    top_steered = F.when(F.size("_l") > 0, F.array_join(F.transform("_l", lambda x: x["business_id"]), ","))
    return (queries.select("query_id").join(agg, "query_id", "left")
            .select("query_id", F.coalesce(F.col("overlap"), F.lit(0)).alias("overlap"),
                    F.lit(top_base).cast("string").alias("top_base"), top_steered.alias("top_steered")))
