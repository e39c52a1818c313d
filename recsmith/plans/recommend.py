"""Flagship: rank every item for a whole table of requests.

  item vectors (mean-pooled) + query-independent base score per item
  -> blocked similarity x fusion, best k_max per query per item block
  -> per-query top-k (score desc, business_id asc), k per request
  -> left join item metadata after the top-k (only k rows per query)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recsmith.operators import features as FT
from recsmith.operators import metadata as MD
from recsmith.operators import similarity as SIM
from recsmith.operators import stats as ST
from recsmith.operators.topk import rank_within
from recsmith.session import stored
from recsmith.sources import testdata as td

# fixed values: request defaults and bounds
DEFAULT_K = 10
MAX_K = 50
MIN_K = 1
DEFAULT_W_JOINT = 1.0
DEFAULT_W_TEXT = 10.0


def validate_requests(requests: DataFrame) -> DataFrame:
    """k defaults to 10 and must be in 1..50; text null -> ''; weights
    default joint 1.0, text 10.0. Adds ``valid`` (int)."""
    k = F.coalesce(F.col("k"), F.lit(DEFAULT_K))
    w = F.col("weights")
    return requests.select(
        "query_id",
        F.coalesce(F.col("query_text"), F.lit("")).alias("query_text"),
        k.cast("int").alias("k"),
        F.coalesce(w.getItem("joint_score"), F.lit(DEFAULT_W_JOINT)).cast("double").alias("w_joint"),
        F.coalesce(w.getItem("text_similarity"), F.lit(DEFAULT_W_TEXT)).cast("double").alias("w_text"),
        k.between(MIN_K, MAX_K).cast("int").alias("valid"),
        *[c for c in requests.columns if c in ("query_emb", "user_id", "user_half")],
    )


def item_base_scores(ix: DataFrame) -> DataFrame:
    """Query-independent base score per item: mu + item_bias (train), i.e. the
    bias model for an unknown user. Computed once, not per request."""
    mu, _, items = ST.train_stats(ix)
    return items.select("business_id", (F.lit(mu) + F.col("item_bias")).alias("base")), mu


def item_table(ix_vec: DataFrame, base: DataFrame, mu: float) -> DataFrame:
    pooled = FT.item_mean_pool(ix_vec, ["text_emb"])
    return (pooled.join(base, "business_id", "left")
            .select("business_id", F.col("text_emb").alias("vec"),
                    F.coalesce(F.col("base"), F.lit(mu)).alias("base")))


def one_per_id(requests: DataFrame) -> DataFrame:
    """One request per query_id: equal requests are answered once, and of
    requests that share an id the first in the order of their fields counts."""
    order = [F.col(c).asc() for c in ("query_text", "k", "w_joint", "w_text", "query_emb", "user_id") if c in requests.columns]
    return rank_within(requests, ["query_id"], order, 1, "_nth").drop("_nth")


def rejected(requests: DataFrame) -> DataFrame:
    """(query_id, reason) of the requests that get no ranking."""
    bad = validate_requests(requests).filter(F.col("valid") != 1)
    return bad.select("query_id", F.format_string(f"k=%d is not in {MIN_K}..{MAX_K}", "k").alias("reason"))


def rank_requests(items: DataFrame, requests: DataFrame, n_items: int | None = None,
                  n_queries: int | None = None, base: SIM.Base | None = None, dim: int | None = None) -> DataFrame:
    """Ranked items of each valid request: ranked to MAX_K first (a constant
    bound, so every map task sends at most MAX_K rows of a query), then each
    request's own k is joined to the ranks. ``base``: base scores that depend on
    the request, from extra columns of both tables."""
    req = one_per_id(validate_requests(requests).filter(F.col("valid") == 1))
    extra = base.query_cols if base else ()
    q = req.select("query_id", F.col("query_emb").alias("qvec"), "w_joint", "w_text", *extra)
    cands = SIM.similarity_topk(items, q, MAX_K, n_items=n_items, n_queries=n_queries, base=base, dim=dim)
    ranked = SIM.rank_candidates(cands, None, MAX_K, MAX_K)
    return ranked.join(req.select("query_id", "k"), "query_id").filter(F.col("rank") <= F.col("k")).drop("k")


def recommend(items: DataFrame, requests: DataFrame, metadata: DataFrame,
              n_items: int | None = None, n_queries: int | None = None, base: SIM.Base | None = None,
              dim: int | None = None) -> DataFrame:
    """items(business_id, vec, base) x requests(query_id, k, weights, query_emb)."""
    ranked = rank_requests(items, requests, n_items, n_queries, base, dim)
    md = metadata.select("business_id", "name", F.col("image_url").alias("representative_image_url"),
                         "avg_rating", "num_reviews")
    return ranked.join(md, "business_id", "left").select(
        "query_id", F.col("rank").cast("int").alias("rank"), "business_id",
        "score", "joint_score", "text_similarity", "name", "representative_image_url",
        "avg_rating", "num_reviews")


def items_testdata(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Item table, written once (its size, the length of its vectors and the
    ranking read it), and its size. Base scores come from the plain interactions,
    so the statistics never touch the vectors."""
    base, mu = item_base_scores(td.interactions(spark, sf_dir))
    items = stored(item_table(td.interactions(spark, sf_dir, with_vectors=True), base, mu), "items")
    return items, items.count()


def recommend_testdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, n = items_testdata(spark, sf_dir)
    # metadata reads only the record fields it uses (no review text)
    md = MD.first_metadata_per_item(td.interactions(spark, sf_dir, with_pics=True, with_name=True))
    requests = td.query_requests(spark, sf_dir)
    return recommend(items, requests, md, n, td.row_count(spark, sf_dir, "embeddings"))
