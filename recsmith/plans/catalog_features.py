"""Registered feature queries: train statistics, joins, manifest, pooling,
cold start, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from recsmith import oracle_sql as O
from recsmith.functions import vectors as V
from recsmith.operators import features as FT
from recsmith.operators import stats as ST
from recsmith.plans import features_build as FB
from recsmith.plans.catalog_text import DENSE_RAW
from recsmith.registry import register
from recsmith.sources import testdata as td


def _ix(spark, d, **kw):
    return td.interactions(spark, d, **kw)


IX = O.ix_cte()

# ---------------------------------------------------------------- statistics


@register("global_mean", f"WITH {IX} SELECT avg(rating) AS mu FROM ix WHERE split = 'train'")
def q_global_mean(spark, d):
    return ST.global_mean(_ix(spark, d).filter(F.col("split") == "train"))


@register("user_bias", f"WITH {IX}, {O.stats_ctes()} SELECT user_id, user_bias FROM us")
def q_user_bias(spark, d):
    _, users, _ = ST.train_stats(_ix(spark, d))
    return users.select("user_id", "user_bias")


@register("item_bias", f"WITH {IX}, {O.stats_ctes()} SELECT business_id, item_bias FROM ist")
def q_item_bias(spark, d):
    _, _, items = ST.train_stats(_ix(spark, d))
    return items.select("business_id", "item_bias")


@register("history_lengths", f"""WITH {IX}, {O.stats_ctes()}
  SELECT 'user' AS kind, user_id AS id, user_hist_len AS hist_len FROM us
  UNION ALL SELECT 'item', business_id, item_hist_len FROM ist""")
def q_history_lengths(spark, d):
    _, users, items = ST.train_stats(_ix(spark, d))
    return (users.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), F.col("user_hist_len").alias("hist_len"))
            .unionByName(items.select(F.lit("item").alias("kind"), F.col("business_id").alias("id"),
                                      F.col("item_hist_len").alias("hist_len"))))


JOIN_STATS_SQL = f"""WITH {IX}, {O.stats_ctes()}
  SELECT ix.row_id, ix.split,
         coalesce(us.user_hist_len, 0) AS user_hist_len, coalesce(ist.item_hist_len, 0) AS item_hist_len,
         round(coalesce(us.user_bias, 0.0), 6) AS user_bias, round(coalesce(ist.item_bias, 0.0), 6) AS item_bias
  FROM ix LEFT JOIN us USING (user_id) LEFT JOIN ist USING (business_id)"""


@register("join_user_item_stats", JOIN_STATS_SQL)
def q_join_user_item_stats(spark, d):
    ix = _ix(spark, d)
    _, users, items = ST.train_stats(ix)
    return ST.join_user_item_stats(ix, users, items).select(
        "row_id", "split", "user_hist_len", "item_hist_len", "user_bias", "item_bias")


@register("bias_prediction", f"""WITH {IX}, {O.stats_ctes()}
  SELECT ix.row_id, ix.split, round((SELECT mu FROM mu) + coalesce(us.user_bias, 0.0) + coalesce(ist.item_bias, 0.0), 6) AS pred
  FROM ix LEFT JOIN us USING (user_id) LEFT JOIN ist USING (business_id)""")
def q_bias_prediction(spark, d):
    ix = _ix(spark, d)
    mu, users, items = ST.train_stats(ix)
    return ST.bias_prediction(ST.join_user_item_stats(ix, users, items), mu).select("row_id", "split", "pred")


@register("distinct_users_items", f"""WITH {IX}
  SELECT DISTINCT 'user' AS kind, user_id AS id FROM ix WHERE split = 'train'
  UNION ALL SELECT DISTINCT 'item', business_id FROM ix WHERE split = 'train'""")
def q_distinct_users_items(spark, d):
    ix = _ix(spark, d)
    return (FT.distinct_ids(ix, "user_id").select(F.lit("user").alias("kind"), F.col("user_id").alias("id"))
            .unionByName(FT.distinct_ids(ix, "business_id").select(F.lit("item").alias("kind"),
                                                                   F.col("business_id").alias("id"))))


COLD_SQL = f"""WITH {IX},
  tu AS (SELECT DISTINCT user_id FROM ix WHERE split = 'train'),
  ti AS (SELECT DISTINCT business_id FROM ix WHERE split = 'train')
  SELECT ix.row_id, ix.split,
         CAST(CASE WHEN tu.user_id IS NULL THEN 1 ELSE 0 END AS INTEGER) AS is_new_user,
         CAST(CASE WHEN ti.business_id IS NULL THEN 1 ELSE 0 END AS INTEGER) AS is_new_item
  FROM ix LEFT JOIN tu ON ix.user_id IS NOT DISTINCT FROM tu.user_id
          LEFT JOIN ti ON ix.business_id IS NOT DISTINCT FROM ti.business_id"""


@register("cold_start_flags", COLD_SQL)
def q_cold_start_flags(spark, d):
    return FT.cold_start_flags(_ix(spark, d)).select("row_id", "split", "is_new_user", "is_new_item")


@register("cold_start_report", f"""WITH c AS ({COLD_SQL})
  SELECT split, count(*) AS n_rows, CAST(sum(is_new_user) AS BIGINT) AS new_users,
         CAST(sum(is_new_item) AS BIGINT) AS new_items,
         round(100.0 * avg(is_new_user), 6) AS pct_new_user, round(100.0 * avg(is_new_item), 6) AS pct_new_item
  FROM c GROUP BY split""")
def q_cold_start_report(spark, d):
    c = FT.cold_start_flags(_ix(spark, d))
    return c.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("is_new_user").cast("long").alias("new_users"),
        F.sum("is_new_item").cast("long").alias("new_items"),
        (F.avg("is_new_user") * 100.0).alias("pct_new_user"), (F.avg("is_new_item") * 100.0).alias("pct_new_item"))


@register("split_filter", f"WITH {IX} SELECT row_id, business_id, user_id, rating FROM ix WHERE split = 'val'")
def q_split_filter(spark, d):
    return _ix(spark, d).filter(F.col("split") == "val").select("row_id", "business_id", "user_id", "rating")


# ---------------------------------------------------------------- pictures

REC = O.records_cte()


@register("clean_pic_ids", f"""WITH {REC}
  SELECT row_id, CAST(len(list_filter(pics, lambda p: p IS NOT NULL AND p <> '')) AS INTEGER) AS n_pics,
         CAST(len(pics) AS INTEGER) AS n_raw
  FROM rec""")
def q_clean_pic_ids(spark, d):
    r = td.interactions(spark, d, with_pics=True)
    return r.select("row_id", F.size(FT.clean_pic_ids("pics")).alias("n_pics"), F.size("pics").alias("n_raw"))


MANIFEST_SQL = f"""WITH {REC}
  SELECT business_id, split, CAST(sum(len(list_filter(pics, lambda p: p IS NOT NULL AND p <> ''))) AS INTEGER) AS pic_count,
         count(*) AS n_records
  FROM rec WHERE business_id IS NOT NULL GROUP BY business_id, split"""


@register("image_manifest", MANIFEST_SQL)
def q_image_manifest(spark, d):
    return FT.image_manifest(td.interactions(spark, d, with_pics=True))


@register("image_manifest_pics", f"""WITH {REC}
  SELECT business_id, split, row_id, CAST(pic_pos AS INTEGER) AS pic_pos, pic_id FROM (
    SELECT business_id, split, row_id, unnest(list_filter(pics, lambda p: p IS NOT NULL AND p <> '')) AS pic_id,
           unnest(generate_series(0, len(list_filter(pics, lambda p: p IS NOT NULL AND p <> '')) - 1)) AS pic_pos
    FROM rec WHERE business_id IS NOT NULL)""")
def q_image_manifest_pics(spark, d):
    return FT.manifest_pictures(td.interactions(spark, d, with_pics=True))


@register("has_image_flag", f"""WITH m AS ({MANIFEST_SQL})
  SELECT business_id, split, pic_count, CAST(pic_count > 0 AS INTEGER) AS has_image FROM m""")
def q_has_image_flag(spark, d):
    m = FT.image_manifest(td.interactions(spark, d, with_pics=True))
    return m.select("business_id", "split", "pic_count", (F.col("pic_count") > 0).cast("int").alias("has_image"))


@register("join_image_counts", f"""WITH {IX}, m AS ({MANIFEST_SQL})
  SELECT ix.row_id, ix.split, CAST(coalesce(m.pic_count, 0) AS INTEGER) AS pic_count,
         CAST(coalesce(m.pic_count, 0) > 0 AS INTEGER) AS has_image
  FROM ix LEFT JOIN m USING (business_id, split)""")
def q_join_image_counts(spark, d):
    m = FT.image_manifest(td.interactions(spark, d, with_pics=True))
    return FT.join_image_counts(_ix(spark, d), m).select("row_id", "split", "pic_count", "has_image")


@register("distinct_pictures", f"""WITH {REC}
  SELECT DISTINCT unnest(list_filter(pics, lambda p: p IS NOT NULL AND p <> '')) AS pic_id,
         CAST(NULL AS VARCHAR) AS url, CAST(NULL AS VARCHAR) AS local_path FROM rec""")
def q_distinct_pictures(spark, d):
    r = td.interactions(spark, d, with_pics=True)
    return (r.select(F.explode(FT.clean_pic_ids("pics")).alias("pic_id")).distinct()
            .withColumn("url", F.lit(None).cast("string")).withColumn("local_path", F.lit(None).cast("string")))


IMG_POOL_SQL = f"""WITH {REC},
  mp AS (SELECT business_id, split, unnest(list_filter(pics, lambda p: p IS NOT NULL AND p <> '')) AS pic_id
         FROM rec WHERE business_id IS NOT NULL),
  pv AS (SELECT 'p' || CAST(vec_id AS VARCHAR) AS pic_id, CAST(unnest(embedding) AS DOUBLE) AS v,
                unnest(generate_series(1, len(embedding))) AS pos FROM embeddings),
  pn AS (SELECT pic_id, greatest(sqrt(sum(v * v)), 1e-12) AS n FROM pv GROUP BY pic_id),
  m AS (SELECT mp.business_id, mp.split, pv.pos, avg(pv.v / pn.n) AS v, count(*) AS c
        FROM mp JOIN pv USING (pic_id) JOIN pn USING (pic_id) GROUP BY 1, 2, 3),
  mn AS (SELECT business_id, split, greatest(sqrt(sum(v * v)), 1e-12) AS n, max(c) AS n_pics FROM m GROUP BY 1, 2)"""


@register("image_pool", f"""{IMG_POOL_SQL}
  SELECT m.business_id, m.split, CAST(m.pos AS INTEGER) AS pos,
         round(CAST(CAST(m.v / mn.n AS FLOAT) AS DOUBLE), 6) AS img_emb, mn.n_pics
  FROM m JOIN mn USING (business_id, split)""")
def q_image_pool(spark, d):
    mp = FT.manifest_pictures(td.interactions(spark, d, with_pics=True))
    pooled = FT.image_pool(mp, td.picture_vectors(spark, d))
    return pooled.select("business_id", "split", F.posexplode("img_emb").alias("pos", "img_emb"), "n_pics").select(
        "business_id", "split", (F.col("pos") + 1).cast("int").alias("pos"), F.col("img_emb").cast("double"), "n_pics")


@register("join_item_images", f"""{IMG_POOL_SQL},
  pooled AS (SELECT m.business_id, m.split, sum(CAST(CAST(m.v / mn.n AS FLOAT) AS DOUBLE)) AS s
             FROM m JOIN mn USING (business_id, split) GROUP BY 1, 2),
  {IX}
  SELECT ix.row_id, ix.split, CAST(CASE WHEN p.s IS NULL THEN 1 ELSE 0 END AS INTEGER) AS img_missing,
         round(coalesce(p.s, 0.0), 6) AS img_sum
  FROM ix LEFT JOIN pooled p USING (business_id, split)""")
def q_join_item_images(spark, d):
    mp = FT.manifest_pictures(td.interactions(spark, d, with_pics=True))
    pooled = FT.image_pool(mp, td.picture_vectors(spark, d))
    j = FT.join_item_images(_ix(spark, d), pooled, 64)
    return j.select("row_id", "split", "img_missing",
                    F.aggregate("img_emb", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")).alias("img_sum"))


# ---------------------------------------------------------------- pooling / alignment


@register("item_mean_pool", f"""WITH {O.ix_cte(vec=True)}, {O.pool_cte()},
  n AS (SELECT business_id, count(*) AS n_rows FROM ix WHERE business_id IS NOT NULL GROUP BY business_id)
  SELECT business_id, CAST(pos AS INTEGER) AS pos, round(v, 6) AS text_emb, n_rows FROM pool JOIN n USING (business_id)""")
def q_item_mean_pool(spark, d):
    pooled = FT.item_mean_pool(_ix(spark, d, with_vectors=True), ["text_emb"])
    return pooled.select("business_id", F.posexplode("text_emb").alias("pos", "text_emb"), "n_rows").select(
        "business_id", (F.col("pos") + 1).cast("int").alias("pos"), "text_emb", "n_rows")


@register("sort_items", f"""WITH {O.ix_cte(vec=True)}
  SELECT business_id, CAST(row_number() OVER (ORDER BY business_id) AS INTEGER) AS item_pos
  FROM (SELECT DISTINCT business_id FROM ix WHERE business_id IS NOT NULL)""")
def q_sort_items(spark, d):
    # sorted ids for the item cache: a range-partitioned sort, rank from the sort
    items = FT.item_mean_pool(_ix(spark, d, with_vectors=True), ["text_emb"]).select("business_id")
    from recsmith.operators.sequence import dense_index
    return dense_index(items, ["business_id"], "item_pos", start=1)


@register("l2_normalize", f"""WITH {O.ix_cte(vec=True)},
  u AS (SELECT row_id, CAST(unnest(text_emb) AS DOUBLE) AS v, unnest(generate_series(1, len(text_emb))) AS pos FROM ix),
  n AS (SELECT row_id, greatest(sqrt(sum(v * v)), 1e-12) AS n FROM u GROUP BY row_id)
  SELECT row_id, round(sum(abs(v / n)), 6) AS l1_of_unit, round(max(v / n), 6) AS max_of_unit FROM u JOIN n USING (row_id) GROUP BY row_id""")
def q_l2_normalize(spark, d):
    ix = _ix(spark, d, with_vectors=True)
    u = ix.select("row_id", V.l2_normalize("text_emb").alias("u"))
    return u.select("row_id",
                    F.aggregate("u", F.lit(0.0).cast("double"), lambda a, x: a + F.abs(x)).alias("l1_of_unit"),
                    F.array_max("u").alias("max_of_unit"))


@register("align_by_row", f"""WITH {O.ix_cte(vec=True)}, {IX.replace('ix AS', 'ix2 AS')}
  SELECT ix.row_id, ix.split, CAST(len(ix.text_emb) AS INTEGER) AS text_dim, ix2.rating
  FROM ix JOIN ix2 ON ix.row_id = ix2.row_id AND ix.split = ix2.split""")
def q_align_by_row(spark, d):
    vec = _ix(spark, d, with_vectors=True).select("row_id", "split", "text_emb")
    idx = _ix(spark, d).select("row_id", "split", "rating")
    return FT.align_by_row(idx, vec).select("row_id", "split", F.size("text_emb").alias("text_dim"), "rating")


MODAL_SQL = f"""{IMG_POOL_SQL}, {O.ix_cte(vec=True)},
  pooled AS (SELECT m.business_id, m.split, sum(CAST(CAST(m.v / mn.n AS FLOAT) AS DOUBLE)) AS s
             FROM m JOIN mn USING (business_id, split) GROUP BY 1, 2),
  md AS (SELECT ix.row_id, CAST(len(ix.text_emb) + (SELECT max(pos) FROM m) AS INTEGER) AS dim,
                list_sum(list_transform(ix.text_emb, lambda x: CAST(x AS DOUBLE))) AS t, coalesce(p.s, 0.0) AS i, dz.d, dz.n
         FROM ix LEFT JOIN pooled p USING (business_id, split)
         LEFT JOIN (WITH {DENSE_RAW} SELECT row_id, sum(CAST(CAST((x - m) / s AS FLOAT) AS DOUBLE)) AS d, count(*) AS n
                    FROM lf JOIN fit USING (pos) GROUP BY row_id) dz USING (row_id))"""


def _modalities(spark, d):
    """Rows with their review vector, the pooled pictures of their business and their dense features."""
    pictures = td.picture_vectors(spark, d)
    pooled = FT.image_pool(FT.manifest_pictures(td.interactions(spark, d, with_pics=True)), pictures)
    z, _ = FB.zscored_dense(spark, d)
    rows = FT.join_item_images(_ix(spark, d, with_vectors=True), pooled, len(pictures.select("img_vec").first()[0]))
    return rows.join(z.select("row_id", "dense"), "row_id", "left")


def _total(x):
    return F.aggregate(x, F.lit(0.0).cast("double"), lambda a, v: a + v.cast("double"))


@register("concat_modalities", f"{MODAL_SQL} SELECT row_id, CAST(dim + n AS INTEGER) AS dim, round(t + i + d, 6) AS total FROM md")
def q_concat_modalities(spark, d):
    c = _modalities(spark, d).select("row_id", FT.concat_modalities(["text_emb", "img_emb", "dense"], "x"))
    return c.select("row_id", F.size("x").alias("dim"), _total("x").alias("total"))


@register("mask_modality", f"""{MODAL_SQL}
  SELECT row_id, 'text_emb' AS masked, CAST(dim + n AS INTEGER) AS dim, round(i + d, 6) AS total FROM md
  UNION ALL SELECT row_id, 'img_emb', CAST(dim + n AS INTEGER), round(t + d, 6) FROM md
  UNION ALL SELECT row_id, 'dense', CAST(dim + n AS INTEGER), round(t + i, 6) FROM md""")
def q_mask_modality(spark, d):
    """The joined input with one modality zeroed, for each of them in turn."""
    rows, kinds = _modalities(spark, d), ("text_emb", "img_emb", "dense")
    each = [F.struct(F.lit(k).alias("masked"),
                     F.concat(*[(V.zeros_like(c) if c == k else F.col(c)).cast("array<float>") for c in kinds]).alias("x")) for k in kinds]
    return rows.select("row_id", F.inline(F.array(*each))).select("row_id", "masked", F.size("x").alias("dim"), _total("x").alias("total"))
