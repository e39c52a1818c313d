"""Registered profile and diagnostic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from recsmith import oracle_sql as O
from recsmith.functions import text as TX
from recsmith.operators import features as FT
from recsmith.operators import profile as P
from recsmith.operators import stats as ST
from recsmith.operators import topk as TK
from recsmith.plans import features_build as FB
from recsmith.plans.catalog_text import DENSE_RAW
from recsmith.registry import register
from recsmith.sources import testdata as td

REC = O.records_cte()
IX = O.ix_cte()
REC_COLS = ["row_id", "split", "business_id", "user_id", "rating", "review_text", "pics", "history_reviews", "name"]


@register("table_shape", f"""WITH {REC}
  SELECT split, count(*) AS n_rows, {len(REC_COLS) - 1} AS n_cols FROM rec GROUP BY split""")
def q_table_shape(spark, d):
    r = td.raw_records(spark, d).select(*REC_COLS)
    return P.table_shape(r).withColumn("n_cols", F.col("n_cols").cast("int"))


NULL_COLS = [c for c in REC_COLS if c != "split"]


@register("null_profile", f"""WITH {O.flawed_cte()}
  SELECT split, c AS column, nn AS non_null, round_even(CASE WHEN n > 0 THEN (n - nn) * 100.0 / n ELSE 0.0 END, 2) AS missing_pct
  FROM (SELECT * FROM (SELECT split, count(*) AS n, {', '.join(f'count({c}) AS {c}' for c in NULL_COLS)} FROM rec GROUP BY split)
        UNPIVOT (nn FOR c IN ({', '.join(NULL_COLS)})))""")
def q_null_profile(spark, d):
    return P.null_profile(td.flawed_records(spark, d).select(*REC_COLS), by=["split"])


DESCRIBED = {"rating": "CAST(rating AS DOUBLE)", "text_length": "CAST(length(coalesce(review_text, '')) AS DOUBLE)",
             "n_pics": "CAST(len(pics) AS DOUBLE)", "history_length": "CAST(len(history_reviews) AS DOUBLE)"}


@register("describe_numeric", f"""WITH {O.flawed_cte()}, v AS ({' UNION ALL '.join(
      f'SELECT split, \'{k}\' AS "column", {e} AS x FROM rec' for k, e in DESCRIBED.items())})
  SELECT split, "column", stat, round(value, 6) AS value FROM (
    SELECT split, "column", count(x)::DOUBLE AS "count", avg(x) AS mean, stddev_samp(x) AS std, min(x) AS "min",
           quantile_cont(x, 0.25) AS "25%", quantile_cont(x, 0.5) AS "50%", quantile_cont(x, 0.75) AS "75%",
           max(x) AS "max" FROM v GROUP BY split, "column") UNPIVOT (value FOR stat IN ("count", mean, std, "min", "25%", "50%", "75%", "max"))""")
def q_describe_numeric(spark, d):
    """Every numeric column and length of the raw feed, per split."""
    r = td.flawed_records(spark, d).select(
        "split", "rating", F.length(F.coalesce("review_text", F.lit(""))).alias("text_length"),
        F.size("pics").alias("n_pics"), F.size("history_reviews").alias("history_length"))
    return P.describe_by(r, list(DESCRIBED), ["split"])


@register("describe_text_length", f"""WITH v AS (SELECT CAST(length(coalesce(text, '')) AS DOUBLE) AS x FROM documents)
  SELECT 'n_chars' AS column, stat, round(value, 6) AS value FROM (
    SELECT count(x)::DOUBLE AS "count", avg(x) AS mean, stddev_samp(x) AS std, min(x) AS "min",
           quantile_cont(x, 0.25) AS "25%", quantile_cont(x, 0.5) AS "50%", quantile_cont(x, 0.75) AS "75%",
           max(x) AS "max" FROM v) UNPIVOT (value FOR stat IN ("count", mean, std, "min", "25%", "50%", "75%", "max"))""")
def q_describe_text_length(spark, d):
    docs = td.table(spark, d, "documents").select(TX.char_length("text").alias("n_chars"))
    return P.describe_numeric(docs, "n_chars")


@register("rating_distribution", f"""WITH {IX}
  SELECT split, rating, count(*) AS n FROM ix WHERE rating IS NOT NULL GROUP BY split, rating""")
def q_rating_distribution(spark, d):
    return P.value_counts(td.interactions(spark, d), "rating", ["split"])


@register("rating_summary", f"""WITH {IX}
  SELECT split, round(avg(rating), 6) AS mean, round(stddev_samp(rating), 6) AS std FROM ix GROUP BY split""")
def q_rating_summary(spark, d):
    return td.interactions(spark, d).groupBy("split").agg(F.avg("rating").alias("mean"),
                                                          F.stddev_samp("rating").alias("std"))


@register("distinct_counts", f"""WITH {IX}
  SELECT split, count(DISTINCT business_id) AS n_business_id, count(DISTINCT user_id) AS n_user_id FROM ix GROUP BY split""")
def q_distinct_counts(spark, d):
    return P.distinct_counts(td.interactions(spark, d), ["business_id", "user_id"], ["split"])


@register("top_ids", f"""WITH {IX}
  SELECT * FROM (SELECT 'user_id' AS kind, user_id AS id, count(*) AS n FROM ix WHERE split = 'train' GROUP BY user_id
                 ORDER BY n DESC, id LIMIT 10)
  UNION ALL
  SELECT * FROM (SELECT 'business_id', business_id, count(*) AS n FROM ix WHERE split = 'train' GROUP BY business_id
                 ORDER BY n DESC, business_id LIMIT 10)""")
def q_top_ids(spark, d):
    tr = td.interactions(spark, d).filter(F.col("split") == "train")
    u = TK.top_ids(tr, "user_id").select(F.lit("user_id").alias("kind"), F.col("user_id").alias("id"), "n")
    b = TK.top_ids(tr, "business_id").select(F.lit("business_id").alias("kind"), F.col("business_id").alias("id"), "n")
    return u.unionByName(b)


@register("head_sample", f"""WITH {O.ix_cte(text=True)}
  SELECT split, CAST(i AS INTEGER) AS i,
         CASE WHEN length(review_text) > 140 THEN substring(review_text, 1, 140) || '…' ELSE review_text END AS sample
  FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY row_id) AS i FROM ix WHERE review_text IS NOT NULL)
  WHERE i <= 3""")
def q_head_sample(spark, d):
    return P.head_texts(td.interactions(spark, d, with_text=True), "review_text", "row_id", 3, 140, ["split"])


@register("preview_table", f"""WITH {IX} SELECT row_id, split, business_id, user_id, rating FROM ix ORDER BY row_id LIMIT 5""")
def q_preview_table(spark, d):
    return td.interactions(spark, d).orderBy("row_id").limit(5)


@register("alignment_report", f"""WITH {O.ix_cte(vec=True)}, {O.ix_cte('pr', pics=True)},
  m AS (SELECT business_id, split, sum(len(pics)) AS pc FROM pr GROUP BY 1, 2),
  j AS (SELECT ix.*, coalesce(m.pc, 0) AS pic_count, CASE WHEN coalesce(m.pc, 0) > 0 THEN 1 ELSE 0 END AS has_image FROM ix LEFT JOIN m USING (business_id, split)),
  r AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY row_id) - 1 AS rid, * EXCLUDE (split) FROM j)
  SELECT split, count(*) AS n_index, count(text_emb) AS n_text, CAST(sum(has_image) AS BIGINT) AS n_with_image, CAST(min(rid) AS BIGINT) AS min_row_id,
         CAST(max(rid) AS BIGINT) AS max_row_id, count(DISTINCT rid) AS n_distinct_row_id,
         CAST(min(rid) = 0 AND max(rid) = count(*) - 1 AND count(DISTINCT rid) = count(*) AS INTEGER) AS row_id_ok,
         CAST(sum(CASE WHEN list_bool_or(list_transform(text_emb, lambda x: isnan(x))) THEN 1 ELSE 0 END) AS BIGINT) AS nan_rows,
         round(avg(has_image) * 100, 6) AS pct_with_image, round(avg(pic_count), 6) AS pic_count_mean,
         CAST(max(pic_count) AS BIGINT) AS pic_count_max
  FROM r GROUP BY split""")
def q_alignment_report(spark, d):
    from recsmith.operators.sequence import row_id_assign
    ix = td.interactions(spark, d, with_vectors=True)
    m = FT.image_manifest(td.interactions(spark, d, with_pics=True))
    j = FT.join_image_counts(ix, m)
    # what the report needs of a vector is two flags: the rows that are sorted and numbered stay narrow
    j = j.select("split", F.col("row_id").alias("src_row"), F.col("text_emb").isNotNull().cast("int").alias("has_text"),
                 F.coalesce(P.has_nan("text_emb"), F.lit(False)).cast("int").alias("nan_text"), "has_image", "pic_count")
    # per-split contiguous ids, as the row-aligned matrices use
    j = row_id_assign(j, ["src_row"], ["split"])
    n = F.count(F.lit(1))
    return j.groupBy("split").agg(
        n.alias("n_index"), F.sum("has_text").cast("long").alias("n_text"), F.sum("has_image").cast("long").alias("n_with_image"),
        F.min("row_id").alias("min_row_id"), F.max("row_id").alias("max_row_id"),
        F.countDistinct("row_id").alias("n_distinct_row_id"),
        ((F.min("row_id") == 0) & (F.max("row_id") == n - 1) & (F.countDistinct("row_id") == n)).cast("int").alias("row_id_ok"),
        F.sum("nan_text").cast("long").alias("nan_rows"), (F.avg("has_image") * 100).alias("pct_with_image"),
        F.avg("pic_count").alias("pic_count_mean"), F.max("pic_count").cast("long").alias("pic_count_max"))


@register("alignment_matrices", f"""WITH {DENSE_RAW},
  vi AS (SELECT row_id, split, embedding FROM (SELECT e.event_id AS row_id, v.embedding FROM events e
         JOIN embeddings v ON v.vec_id = e.event_id % (SELECT count(*) FROM embeddings)) JOIN ix USING (row_id)),
  pv AS (SELECT row_id, split, embedding FROM (SELECT e.event_id AS row_id, v.embedding FROM events e
         LEFT JOIN embeddings v ON e.event_id % 4 > 0 AND v.vec_id = (e.event_id * 7) % (SELECT count(*) FROM embeddings)) JOIN ix USING (row_id)),
  lg AS (SELECT split, 'text_emb' AS matrix, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM vi
         UNION ALL SELECT split, 'img_emb', unnest(embedding)::DOUBLE, unnest(range(1, len(embedding) + 1)) FROM pv
         UNION ALL SELECT lf.split, 'dense', ((lf.x - fit.m) / fit.s)::FLOAT::DOUBLE, lf.pos FROM lf JOIN fit USING (pos)),
  n AS (SELECT split, count(*) AS n_rows FROM ix GROUP BY split),
  gone AS (SELECT split, count(*) FILTER (embedding IS NULL) AS n_missing FROM pv GROUP BY split)
  SELECT split, matrix, CAST(pos AS INTEGER) AS pos, any_value(n_rows) AS n_rows,
         CAST(CASE WHEN matrix = 'img_emb' THEN any_value(n_missing) ELSE 0 END AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS nan_rows,
         count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std
  FROM lg JOIN n USING (split) JOIN gone USING (split) GROUP BY split, matrix, pos""")
def q_alignment_matrices(spark, d):
    """Rows, missing and NaN vectors, and mean and deviation of every component
    of the text, picture (a row's first) and dense matrices, per split."""
    n = td.row_count(spark, d, "embeddings")
    pics = td.picture_vectors(spark, d).select(F.substring("pic_id", 2, 20).cast("long").alias("_v"), F.col("img_vec").alias("img_emb"))
    slot = F.when(F.col("row_id") % 4 > 0, (F.col("row_id") * 7) % F.lit(n))
    z, _ = FB.zscored_dense(spark, d)
    # a matrix is summed up where its vectors are joined: no vector travels for the join of another matrix
    ix = td.interactions(spark, d).select("row_id", "split")
    found = {"text_emb": td.join_text_vectors(spark, d, ix), "img_emb": ix.withColumn("_v", slot).join(pics, "_v", "left"),
             "dense": ix.join(z.select("row_id", "dense"), "row_id", "left")}
    text, image, dense = (P.summarize_matrices(rows, "split", [name]) for name, rows in found.items())
    return text.unionByName(image).unionByName(dense)


@register("row_id_assign", f"""WITH {IX}
  SELECT row_id AS src_row, split, row_number() OVER (PARTITION BY split ORDER BY row_id) - 1 AS row_id FROM ix""")
def q_row_id_assign(spark, d):
    from recsmith.operators.sequence import row_id_assign
    ix = td.interactions(spark, d).select(F.col("row_id").alias("src_row"), "split")
    return row_id_assign(ix, ["src_row"], ["split"])


@register("dictionary_codes", f"""WITH {IX}
  SELECT user_id, CAST(dense_rank() OVER (ORDER BY user_id) - 1 AS INTEGER) AS user_id_code
  FROM (SELECT DISTINCT user_id FROM ix WHERE split = 'train' AND user_id IS NOT NULL)""")
def q_dictionary_codes(spark, d):
    from recsmith.operators.sequence import dictionary_codes
    return dictionary_codes(td.interactions(spark, d).filter(F.col("split") == "train"), "user_id")


POP_SQL = f"""{IX},
  pop AS (SELECT business_id, count(*) AS num_ratings, avg(rating) AS mean_rating FROM ix
          WHERE split = 'train' AND business_id IS NOT NULL GROUP BY business_id)"""


def _pop(spark, d):
    tr = td.interactions(spark, d).filter(F.col("split") == "train").filter(F.col("business_id").isNotNull())
    return tr.groupBy("business_id").agg(F.count(F.lit(1)).alias("num_ratings"), F.avg("rating").alias("mean_rating"))


@register("item_popularity", f"WITH {POP_SQL} SELECT business_id, num_ratings, round(mean_rating, 6) AS mean_rating FROM pop")
def q_item_popularity(spark, d):
    return _pop(spark, d)


@register("join_item_popularity", f"""WITH {POP_SQL},
  items AS (SELECT DISTINCT business_id FROM ix WHERE business_id IS NOT NULL)
  SELECT items.business_id, coalesce(pop.num_ratings, 0) AS num_ratings, round(pop.mean_rating, 6) AS mean_rating
  FROM items LEFT JOIN pop USING (business_id)""")
def q_join_item_popularity(spark, d):
    items = td.interactions(spark, d).select("business_id").filter(F.col("business_id").isNotNull()).distinct()
    j = items.join(_pop(spark, d), "business_id", "left")
    return j.select("business_id", F.coalesce(F.col("num_ratings"), F.lit(0)).alias("num_ratings"), "mean_rating")


@register("popularity_score_pairs", f"""WITH {POP_SQL}, {O.stats_ctes()},
  items AS (SELECT DISTINCT business_id FROM ix WHERE business_id IS NOT NULL)
  SELECT items.business_id, coalesce(pop.num_ratings, 0) AS num_ratings,
         round((SELECT mu FROM mu) + coalesce(ist.item_bias, 0.0), 6) AS score
  FROM items LEFT JOIN pop USING (business_id) LEFT JOIN ist USING (business_id)""")
def q_popularity_score_pairs(spark, d):
    ix = td.interactions(spark, d)
    mu, _, items_stats = ST.train_stats(ix)
    items = ix.select("business_id").filter(F.col("business_id").isNotNull()).distinct()
    j = items.join(_pop(spark, d), "business_id", "left").join(items_stats, "business_id", "left")
    return j.select("business_id", F.coalesce(F.col("num_ratings"), F.lit(0)).alias("num_ratings"),
                    (F.lit(mu) + F.coalesce(F.col("item_bias"), F.lit(0.0))).alias("score"))


@register("popularity_buckets", f"""WITH {POP_SQL}, {O.stats_ctes()},
  items AS (SELECT DISTINCT business_id FROM ix WHERE business_id IS NOT NULL),
  p AS (SELECT coalesce(pop.num_ratings, 0) AS nr, (SELECT mu FROM mu) + coalesce(ist.item_bias, 0.0) AS s
        FROM items LEFT JOIN pop USING (business_id) LEFT JOIN ist USING (business_id))
  SELECT CAST(floor(nr / 10) AS BIGINT) AS bucket, count(*) AS n_items, round(avg(s), 6) AS mean_score FROM p GROUP BY 1""")
def q_popularity_buckets(spark, d):
    pairs = q_popularity_score_pairs(spark, d)
    return pairs.groupBy(F.floor(F.col("num_ratings") / 10).cast("long").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_items"), F.avg("score").alias("mean_score"))


@register("modality_correlation", f"""WITH {O.ix_cte(vec=True)}, {O.stats_ctes()},
  pv AS (SELECT business_id, sum(CAST(v AS DOUBLE)) / count(DISTINCT row_id) AS t FROM (
           SELECT business_id, row_id, unnest(text_emb) AS v FROM ix WHERE business_id IS NOT NULL) GROUP BY business_id),
  it AS (SELECT pv.business_id, pv.t AS text_only, coalesce(ist.item_bias, 0.0) AS dense_only,
                pv.t + coalesce(ist.item_bias, 0.0) AS full_score FROM pv LEFT JOIN ist USING (business_id))
  SELECT round(CASE WHEN stddev_pop(full_score) * stddev_pop(text_only) > 0
                    THEN covar_pop(full_score, text_only) / (stddev_pop(full_score) * stddev_pop(text_only)) END, 6) AS corr_text,
         round(CASE WHEN stddev_pop(full_score) * stddev_pop(dense_only) > 0
                    THEN covar_pop(full_score, dense_only) / (stddev_pop(full_score) * stddev_pop(dense_only)) END, 6) AS corr_dense,
         CAST(NULL AS DOUBLE) AS corr_img
  FROM it""")
def q_modality_correlation(spark, d):
    """Linear probe scorer (sum of pooled text vector + item bias): the
    correlation of the full score with each modality alone (others zeroed).
    Pictures have no per-item signal in this probe, so corr_img is null: its
    scores are constant."""
    ix = td.interactions(spark, d, with_vectors=True)
    _, _, items = ST.train_stats(ix.select("split", "user_id", "business_id", "rating"))
    pooled = FT.item_mean_pool(ix, ["text_emb"])
    tsum = F.aggregate("text_emb", F.lit(0.0).cast("double"), lambda a, x: a + x)
    it = pooled.join(items, "business_id", "left").select(
        tsum.alias("text_only"), F.coalesce(F.col("item_bias"), F.lit(0.0)).alias("dense_only"),
        F.lit(0.0).alias("img_only"))
    it = it.withColumn("full_score", F.col("text_only") + F.col("dense_only") + F.col("img_only"))
    return it.agg(P.guarded_corr("full_score", "text_only").alias("corr_text"),
                  P.guarded_corr("full_score", "dense_only").alias("corr_dense"),
                  P.guarded_corr("full_score", "img_only").alias("corr_img"))


@register("seeded_sample", f"""WITH {O.ix_cte()},
  items AS (SELECT DISTINCT business_id FROM ix WHERE business_id IS NOT NULL)
  SELECT business_id FROM items ORDER BY md5('42:' || business_id), business_id LIMIT 1000""")
def q_seeded_sample(spark, d, n: int = 1000, seed: int = 42):
    """Repeatable sample without replacement: the n smallest seeded hashes of
    the id (same rows at any partitioning and in any engine). Sampling is the
    feature here."""
    items = td.interactions(spark, d).select("business_id").filter(F.col("business_id").isNotNull()).distinct()
    return items.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "business_id").cast("binary")), "business_id").limit(n)


@register("describe_pic_count", f"""WITH {O.ix_cte('pr', pics=True)},
  v AS (SELECT CAST(sum(len(list_filter(pics, lambda p: p IS NOT NULL AND p <> ''))) AS DOUBLE) AS x
        FROM pr WHERE business_id IS NOT NULL GROUP BY business_id, split)
  SELECT 'pic_count' AS column, stat, round(value, 6) AS value FROM (
    SELECT count(x)::DOUBLE AS "count", avg(x) AS mean, stddev_samp(x) AS std, min(x) AS "min",
           quantile_cont(x, 0.25) AS "25%", quantile_cont(x, 0.5) AS "50%", quantile_cont(x, 0.75) AS "75%",
           max(x) AS "max" FROM v) UNPIVOT (value FOR stat IN ("count", mean, std, "min", "25%", "50%", "75%", "max"))""")
def q_describe_pic_count(spark, d):
    """describe() of the manifest's picture counts per (business, split)."""
    m = FT.image_manifest(td.interactions(spark, d, with_pics=True))
    return P.describe_numeric(m, "pic_count")
