"""Registered ranking queries: recommend, top-k, similarity, fusion, steering."""

from __future__ import annotations

from recsmith import oracle_sql as O
from recsmith.plans import recommend as R
from recsmith.registry import register

RECOMMEND_SQL = f"""
WITH {O.ix_cte(vec=True)},
  {O.records_cte()},
  {O.stats_ctes()},
  {O.pool_cte()},
  {O.metadata_cte()},
  {O.queries_cte()},
  {O.qvec_cte()},
  inorm AS (SELECT business_id, sqrt(sum(v * v)) AS n FROM pool GROUP BY business_id),
  qn AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM qv GROUP BY query_id),
  dp AS (SELECT qv.query_id, p.business_id, sum(qv.v * p.v) AS d FROM qv JOIN pool p ON qv.pos = p.pos GROUP BY 1, 2),
  sc AS (
    SELECT dp.query_id, dp.business_id,
           coalesce((SELECT mu FROM mu) + ist.item_bias, (SELECT mu FROM mu)) AS joint_score,
           dp.d / (greatest(qn.n, 1e-12) * greatest(inorm.n, 1e-12)) AS text_similarity,
           q.k, q.w_joint, q.w_text
    FROM dp JOIN qn USING (query_id) JOIN inorm USING (business_id) JOIN q USING (query_id)
    LEFT JOIN ist USING (business_id)),
  rk AS (
    SELECT *, w_joint * joint_score + w_text * text_similarity AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY
               w_joint * joint_score + w_text * text_similarity DESC, business_id) AS rank
    FROM sc)
SELECT rk.query_id, CAST(rk.rank AS INTEGER) AS rank, rk.business_id,
       round(rk.score, 6) AS score, round(rk.joint_score, 6) AS joint_score,
       round(rk.text_similarity, 6) AS text_similarity,
       md.name, md.image_url AS representative_image_url, round(md.avg_rating, 6) AS avg_rating, md.num_reviews
FROM rk LEFT JOIN md USING (business_id)
WHERE rk.rank <= rk.k
"""


@register("recommend", RECOMMEND_SQL)
def q_recommend(spark, sf_dir):
    """Flagship: every request (one per embeddings row) ranked against every item."""
    return R.recommend_testdata(spark, sf_dir)


# ---------------------------------------------------------------- row-level similarity / fusion

from pyspark.sql import functions as F  # noqa: E402

from recsmith.functions import vectors as V  # noqa: E402
from recsmith.operators import features as FT  # noqa: E402
from recsmith.operators import similarity as SIM  # noqa: E402
from recsmith.operators import stats as ST  # noqa: E402
from recsmith.plans import steering as STEER  # noqa: E402
from recsmith.sources import testdata as td  # noqa: E402

ROW_COS = f"""{O.ix_cte(vec=True)}, {O.pool_cte()}, {O.stats_ctes()},
  rv AS (SELECT row_id, business_id, CAST(unnest(text_emb) AS DOUBLE) AS v, unnest(generate_series(1, len(text_emb))) AS pos FROM ix),
  rn AS (SELECT row_id, greatest(sqrt(sum(v * v)), 1e-12) AS n FROM rv GROUP BY row_id),
  pn AS (SELECT business_id, greatest(sqrt(sum(v * v)), 1e-12) AS n FROM pool GROUP BY business_id),
  cs AS (SELECT rv.row_id, sum(rv.v * p.v) / (max(rn.n) * max(pn.n)) AS cos
         FROM rv JOIN pool p ON p.business_id = rv.business_id AND p.pos = rv.pos
         JOIN rn ON rn.row_id = rv.row_id JOIN pn ON pn.business_id = rv.business_id GROUP BY rv.row_id),
  pr AS (SELECT ix.row_id, (SELECT mu FROM mu) + coalesce(us.user_bias, 0.0) + coalesce(ist.item_bias, 0.0) AS pred
         FROM ix LEFT JOIN us USING (user_id) LEFT JOIN ist USING (business_id))"""


def _row_cos(spark, d):
    ix = td.interactions(spark, d, with_vectors=True)
    pooled = FT.item_mean_pool(ix, ["text_emb"]).select("business_id", F.col("text_emb").alias("item_vec"))
    mu, users, items = ST.train_stats(td.interactions(spark, d))
    j = ST.bias_prediction(ST.join_user_item_stats(ix, users, items), mu).join(pooled, "business_id", "left")
    return j.withColumn("cos", V.cosine_similarity("text_emb", "item_vec"))


@register("cosine_similarity", f"WITH {ROW_COS} SELECT row_id, round(cos, 6) AS cos FROM cs")
def q_cosine_similarity(spark, d):
    """Each review vector against its business's pooled vector."""
    return _row_cos(spark, d).select("row_id", "cos")


@register("weighted_fusion", f"""WITH {ROW_COS}
  SELECT cs.row_id, round(1.0 * pr.pred + 10.0 * cs.cos, 6) AS score FROM cs JOIN pr USING (row_id)""")
def q_weighted_fusion(spark, d):
    """w_joint * base + w_text * similarity with the service defaults (1, 10)."""
    r = _row_cos(spark, d)
    return r.select("row_id", (F.lit(R.DEFAULT_W_JOINT) * F.col("pred") + F.lit(R.DEFAULT_W_TEXT) * F.col("cos"))
                    .alias("score"))


@register("steered_score", f"""WITH {ROW_COS}
  SELECT cs.row_id, round(pr.pred + 0.5 * cs.cos, 6) AS score FROM cs JOIN pr USING (row_id)""")
def q_steered_score(spark, d):
    r = _row_cos(spark, d)
    return r.select("row_id", (F.col("pred") + F.lit(STEER.STEER_WEIGHT) * F.col("cos")).alias("score"))


def _items_queries(spark, d):
    items, _ = R.items_testdata(spark, d)
    q = td.query_requests(spark, d).select("query_id", F.col("query_emb").alias("qvec"))
    return items, q


ALL_PAIRS = f"""{O.ix_cte(vec=True)}, {O.stats_ctes()}, {O.pool_cte()}, {O.qvec_cte()},
  inorm AS (SELECT business_id, sqrt(sum(v * v)) AS n FROM pool GROUP BY business_id),
  qn AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM qv GROUP BY query_id),
  dp AS (SELECT qv.query_id, p.business_id, sum(qv.v * p.v) AS d FROM qv JOIN pool p ON qv.pos = p.pos GROUP BY 1, 2),
  pairs AS (SELECT dp.query_id, dp.business_id,
                   coalesce((SELECT mu FROM mu) + ist.item_bias, (SELECT mu FROM mu)) AS base,
                   dp.d / (greatest(qn.n, 1e-12) * greatest(inorm.n, 1e-12)) AS sim
            FROM dp JOIN qn USING (query_id) JOIN inorm USING (business_id) LEFT JOIN ist USING (business_id)),
  steer AS (SELECT query_id, business_id, row_number() OVER (PARTITION BY query_id ORDER BY base + 0.5 * sim DESC, business_id) AS rank
            FROM pairs),
  btop AS (SELECT business_id, row_number() OVER (ORDER BY base DESC, business_id) AS rank
           FROM (SELECT DISTINCT business_id, base FROM pairs))"""


@register("topk_items", f"""WITH {ALL_PAIRS}
  SELECT CAST(rank AS INTEGER) AS rank, business_id FROM btop WHERE rank <= 10""")
def q_topk_items(spark, d):
    items, _ = _items_queries(spark, d)
    return STEER.base_top(items, 10).select(F.col("rank").cast("int"), "business_id")


@register("topk_per_query", f"""WITH {ALL_PAIRS}, {O.queries_cte()},
  r AS (SELECT pairs.query_id, business_id, q.w_joint * base + q.w_text * sim AS score, q.k,
               row_number() OVER (PARTITION BY pairs.query_id ORDER BY q.w_joint * base + q.w_text * sim DESC, business_id) AS rank
        FROM pairs JOIN q USING (query_id))
  SELECT query_id, CAST(rank AS INTEGER) AS rank, business_id, round(score, 6) AS score FROM r WHERE rank <= k""")
def q_topk_per_query(spark, d):
    items, n = R.items_testdata(spark, d)
    r = R.rank_requests(items, td.query_requests(spark, d), n, td.row_count(spark, d, "embeddings"))
    return r.select("query_id", F.col("rank").cast("int"), "business_id", "score")


@register("query_item_cross", f"""WITH {ALL_PAIRS}
  SELECT query_id, business_id, round(sim, 6) AS text_similarity FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, business_id) AS rn FROM pairs) WHERE rn = 1""")
def q_query_item_cross(spark, d):
    """Every query against every item (blocked), best item by cosine."""
    items, q = _items_queries(spark, d)
    q = q.select("query_id", "qvec", F.lit(0.0).alias("w_joint"), F.lit(1.0).alias("w_text"))
    c = SIM.similarity_topk(items, q, 1)
    return SIM.rank_candidates(c, None, 1, 1).select("query_id", "business_id", "text_similarity")


@register("topk_base_vs_steered", f"""WITH {ALL_PAIRS}
  SELECT query_id, 'steered' AS kind, CAST(rank AS INTEGER) AS rank, business_id FROM steer WHERE rank <= 10
  UNION ALL
  SELECT q.vec_id AS query_id, 'base', CAST(b.rank AS INTEGER), b.business_id FROM embeddings q JOIN btop b ON b.rank <= 10""")
def q_topk_base_vs_steered(spark, d):
    items, q = _items_queries(spark, d)
    b = STEER.base_top(items, 10)
    s = STEER.steered_top(items, q, 10)
    # the base list is query independent and has 10 rows: attach it to every
    # query as a literal array (no join), then explode
    base = [(int(r["rank"]), r["business_id"]) for r in b.select("rank", "business_id").collect()]
    arr = F.array(*[F.struct(F.lit(rk).alias("rank"), F.lit(bid).alias("business_id")) for rk, bid in base])
    bq = q.select("query_id", F.inline(arr))
    return (s.select("query_id", F.lit("steered").alias("kind"), F.col("rank").cast("int"), "business_id")
            .unionByName(bq.select("query_id", F.lit("base").alias("kind"), F.col("rank").cast("int"), "business_id")))


@register("topk_overlap", f"""WITH {ALL_PAIRS}
  SELECT q.vec_id AS query_id, count(s.business_id) AS overlap FROM embeddings q
  LEFT JOIN (SELECT * FROM steer WHERE rank <= 10 AND business_id IN (SELECT business_id FROM btop WHERE rank <= 10)) s
    ON s.query_id = q.vec_id GROUP BY q.vec_id""")
def q_topk_overlap(spark, d):
    items, q = _items_queries(spark, d)
    return STEER.topk_overlap(STEER.base_top(items, 10), STEER.steered_top(items, q, 10), q)


@register("query_steering", f"""WITH {ALL_PAIRS},
  ov AS (SELECT q.vec_id AS query_id, count(s.business_id) AS overlap FROM embeddings q
         LEFT JOIN (SELECT * FROM steer WHERE rank <= 10 AND business_id IN (SELECT business_id FROM btop WHERE rank <= 10)) s
           ON s.query_id = q.vec_id GROUP BY q.vec_id),
  st AS (SELECT query_id, string_agg(business_id, ',' ORDER BY rank) AS top_steered FROM steer WHERE rank <= 5 GROUP BY query_id)
  SELECT ov.query_id, ov.overlap, (SELECT string_agg(business_id, ',' ORDER BY rank) FROM btop WHERE rank <= 5) AS top_base,
         st.top_steered FROM ov LEFT JOIN st USING (query_id)""")
def q_query_steering(spark, d):
    items, q = _items_queries(spark, d)
    return STEER.query_steering(items, q)


# ---------------------------------------------------------------- stream job

@register("recommend_stream", RECOMMEND_SQL)
def q_recommend_stream(spark, d):
    """Requests written as 4 JSON files and ranked as a stream (one file per
    micro-batch); the union of the batch outputs equals ``recommend``."""
    from recsmith.operators import metadata as MD
    from recsmith.sources import ingest as IG
    from recsmith.streaming import recommend_stream as RS
    items, _ = R.items_testdata(spark, d)
    md = MD.first_metadata_per_item(td.interactions(spark, d, with_pics=True, with_name=True))
    req_path = IG.scratch_path(spark, "requests")
    td.query_requests(spark, d).repartition(4, "query_id").write.json(req_path)
    out = RS.run_to_end(spark, req_path, IG.scratch_path(spark, "recs_out"), IG.scratch_path(spark, "stream_ckpt"),
                        items, md)
    return out.drop("batch_id")
