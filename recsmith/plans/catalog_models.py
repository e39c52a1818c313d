"""Registered model jobs (rows-only checks: learned weights have no SQL
oracle; their properties are tested in tests/test_models.py)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recsmith import oracle_sql as O
from recsmith.functions import vectors as V
from recsmith.models import factorization as MF
from recsmith.models import text_encoder as TE
from recsmith.operators import features as FT
from recsmith.operators import stats as ST
from recsmith.plans import evaluation as EV
from recsmith.plans import joint_ranking as JR
from recsmith.plans import modeling as MO
from recsmith.registry import register
from recsmith.session import at_once, stored
from recsmith.sources import ingest as IG
from recsmith.sources import pictures as PX
from recsmith.sources import testdata as td

# fixed value: epochs of every training run
EPOCHS = 20


# ---------------------------------------------------------------- encoders

def _encoder(spark, d):
    """Texts by key and the encoder: a text counts once per train row that has it."""
    rows = td.interactions(spark, d, with_text_key=True).filter(F.col("split") == "train")
    n = rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("n"))
    texts = td.text_source(spark, d)
    return texts, TE.fit_text_encoder(texts.join(n, "text_key"), "review_text", weight="n")


@register("text_embed")
def q_text_embed(spark, d):
    """Review vectors from the encoder fitted on train (dim, norm per row): each
    text is encoded once, and rows join the result on the text key."""
    texts, enc = _encoder(spark, d)
    e = enc.encode(texts, "review_text", "text_vec").select("text_key", F.size("text_vec").alias("dim"),
                                                            V.l2_norm("text_vec").alias("norm"))
    return td.interactions(spark, d, with_text_key=True).join(e, "text_key", "left").select("row_id", "split", "dim", "norm")


@register("query_embed")
def q_query_embed(spark, d):
    """Request texts through the same fitted encoder (empty text allowed)."""
    _, enc = _encoder(spark, d)
    q = td.query_requests(spark, d).withColumn("query_text", F.coalesce("query_text", F.lit("")))
    e = enc.encode(q, "query_text", "query_vec")
    return e.select("query_id", F.size("query_vec").alias("dim"), V.l2_norm("query_vec").alias("norm"))


PICTURES_SQL = f"""{O.ix_cte(pics=True)},
  ids AS (SELECT DISTINCT unnest(pics) AS pic_id FROM ix),
  px AS (SELECT pic_id, CAST(substr(pic_id, 2) AS BIGINT) AS n,
                list_transform(embedding, lambda v: greatest(0, least(255, floor(128 + 400 * v::DOUBLE + 0.5)))::DOUBLE) AS p
         FROM ids JOIN embeddings ON 'p' || vec_id = pic_id),
  why AS (SELECT *, CASE WHEN n % 40 = 23 THEN 'no bytes' WHEN n % 40 = 7 THEN '59 of 64 bytes of pixels' END AS error FROM px)"""


def _pictures_packed(spark, d):
    """The pictures that records name, as 8 x 8 grey maps made from their
    catalogue vectors (FIXTURES.md; some are cut, some missing), in containers."""
    recs = td.interactions(spark, d, with_pics=True)
    ids = recs.select(F.explode(FT.clean_pic_ids("pics")).alias("pic_id")).distinct()
    pixel = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 400 * v.cast("double") + 0.5)))
    body = F.unhex(F.array_join(F.transform("img_vec", lambda v: F.lpad(F.hex(pixel(v).cast("long")), 2, "0")), ""))
    n = F.substring("pic_id", 2, 20).cast("long") % 40
    whole = F.concat(F.lit(b"P5\n8 8\n255\n"), body)
    content = F.when(n == 23, F.lit(None)).when(n == 7, F.substring(whole, 1, 11 + 59)).otherwise(whole)
    made = td.picture_vectors(spark, d).select("pic_id", content.alias("content"))
    path = PX.pack(ids.join(made, "pic_id", "left"), IG.scratch_path(spark, "pictures"))
    return PX.scan(spark, path, ids)


@register("scan_images", f"""WITH {PICTURES_SQL}
  SELECT pic_id, CASE WHEN error IS NULL THEN 8 END AS width, CASE WHEN error IS NULL THEN 8 END AS height,
         CASE WHEN error IS NULL THEN round(list_avg(p), 6) END AS brightness, error FROM why""")
def q_scan_images(spark, d):
    """Pictures read from containers and decoded; what cannot be decoded is null with the reason."""
    return PX.decode(_pictures_packed(spark, d)).select("pic_id", "width", "height", F.get("means", F.lit(0)).alias("brightness"), "error")


@register("image_embed", f"""WITH {PICTURES_SQL},
  c AS (SELECT pic_id, list_transform(p, lambda x: x / 255 - list_avg(p) / 255) AS v FROM why WHERE error IS NULL),
  e AS (SELECT pic_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM c)
  SELECT ids.pic_id, CAST(len(v) AS INTEGER) AS dim, CASE WHEN norm > 0 THEN 1.0 WHEN norm IS NOT NULL THEN 0.0 END AS norm,
         len(list_filter(v, lambda x: x / greatest(norm, 1e-12) > 0.001)) AS n_bright
  FROM ids LEFT JOIN e USING (pic_id)""")
def q_image_embed(spark, d):
    """Each distinct picture decoded and encoded once (predict_batch_udf): the
    brightness of its 8 x 8 parts, centred and normalised; null if it cannot be decoded."""
    from recsmith.models import image_encoder as IE
    e = IE.embed_images(PX.decode(_pictures_packed(spark, d)), "grid", "img_vec", IE.brightness_encoder(), shape=[64])
    bright = F.size(F.filter("img_vec", lambda x: x > 0.001)).cast("long")
    return e.select("pic_id", F.size("img_vec").alias("dim"), F.round(V.l2_norm("img_vec"), 4).alias("norm"), bright.alias("n_bright"))


# ---------------------------------------------------------------- factorization

@register("mf_fit")
def q_mf_fit(spark, d):
    _, cands = MF.fit_mf(td.interactions(spark, d))
    return spark.createDataFrame(cands, "rank int, reg double, val_rmse double")


@register("mf_predict")
def q_mf_predict(spark, d):
    ix = td.interactions(spark, d)
    m, _ = MF.fit_mf(ix)
    return ST.rmse_mae(m.predict(ix), "pred", "rating", ["split"]).withColumn("model", F.lit("mf"))


@register("mf_score")
def q_mf_score(spark, d):
    ix = td.interactions(spark, d)
    m, _ = MF.fit_mf(ix)
    return m.predict(ix.filter(F.col("split").isin("val", "test"))).select("row_id", "split", "pred")


# ---------------------------------------------------------------- towers / fusion

def _rows(spark, d, dense=False):
    return MO.row_features(spark, d, with_dense=dense, ix=MO.interactions_once(spark, d), pack=True)


@register("tower_fit")
def q_tower_fit(spark, d):
    rows = _rows(spark, d)
    dim = MO.dims(spark, d)["text_emb"]
    _, curve = MO.train_tower(rows, "text_emb", dim, EPOCHS, store=MO.tower_store(spark, d, "text_emb", EPOCHS))
    return MO.curve_frame(spark, curve, "text_tower")


@register("training_curve")
def q_training_curve(spark, d):
    rows = _rows(spark, d)
    dim = MO.dims(spark, d)["img_emb"]
    _, curve = MO.train_tower(rows, "img_emb", dim, EPOCHS, store=MO.tower_store(spark, d, "img_emb", EPOCHS))
    return MO.curve_frame(spark, curve, "img_tower")       # with the epoch whose weights are kept


@register("tower_score")
def q_tower_score(spark, d):
    """Best text tower (reloaded by val RMSE) scored on every split."""
    rows = _rows(spark, d)
    dim = MO.dims(spark, d)["text_emb"]
    model, _ = MO.train_tower(rows, "text_emb", dim, EPOCHS, store=MO.tower_store(spark, d, "text_emb", EPOCHS))
    s = model.score(rows, "text_emb", "pred")
    return ST.rmse_mae(s, "pred", "rating", ["split"]).withColumn("model", F.lit("text_tower"))


def _fusion_rows(spark, d):
    rows = _rows(spark, d, dense=True)
    return rows.withColumn("x", F.concat("text_emb", "img_emb", "dense"))


@register("late_fusion_fit")
def q_late_fusion_fit(spark, d):
    rows = _fusion_rows(spark, d)
    dim = MO.dims(spark, d)["x"]
    _, curve = MO.train_tower(rows, "x", dim, EPOCHS, store=MO.tower_store(spark, d, "x", EPOCHS))
    return MO.curve_frame(spark, curve, "late_fusion")


@register("late_fusion_score")
def q_late_fusion_score(spark, d):
    rows = _fusion_rows(spark, d)
    dim = MO.dims(spark, d)["x"]
    model, _ = MO.train_tower(rows, "x", dim, EPOCHS, store=MO.tower_store(spark, d, "x", EPOCHS))
    s = model.score(rows, "x", "pred")
    return ST.rmse_mae(s, "pred", "rating", ["split"]).withColumn("model", F.lit("late_fusion"))


# ---------------------------------------------------------------- joint

@register("joint_fit")
def q_joint_fit(spark, d):
    _, _, _, curve = JR.fitted(spark, d, EPOCHS)
    return spark.createDataFrame([(e, float(l), float(v)) for e, l, v in curve],
                                 "epoch int, train_loss double, val_ndcg10 double")


@register("joint_score_items")
def q_joint_score_items(spark, d):
    """Every item scored once for the default user (query independent)."""
    rows, _, jm, _ = JR.fitted(spark, d, EPOCHS)
    return jm.score_items(JR.pooled_items(rows)).select("business_id", "score")


# ---------------------------------------------------------------- evaluation / diagnostics

@register("evaluate_learned_models")
def q_evaluate_learned_models(spark, d):
    """Factorization, text, image and dense towers and late fusion, ranked per
    user on val/test: interactions and features are written once, the models are
    fitted at the same time, the towers score a row in one pass, and the scores
    of all models are evaluated together."""
    ix = MO.interactions_once(spark, d)
    by_mf, by_towers = at_once(spark, lambda: _mf_scored(ix), lambda: _towers_scored(spark, d, ix))
    return EV.evaluate(by_mf.unionByName(by_towers), by=["model", "split"])


SCORED = ["row_id", "split", "user_id", "rating"]
TOWERS = {"text_tower": "text_emb", "img_tower": "img_emb", "dense_tower": "dense", "late_fusion": "x"}


def _mf_scored(ix):
    """The rows to evaluate with the factorization's score, as a table."""
    mf, _ = MF.fit_mf(ix.select(*SCORED, "business_id"))
    rows = mf.predict(ix.filter(F.col("split").isin(*EV.EVAL_SPLITS)).select(*SCORED, "business_id"))
    return stored(rows.select(*SCORED, F.lit("mf").alias("model"), F.col("pred").alias("score")), "mf-scored")


def _towers_scored(spark, d, ix):
    """The rows to evaluate once for each tower, with its score, as a table."""
    rows = MO.model_rows(spark, d, ix)
    towers = MO.train_towers(spark, d, rows, list(TOWERS.values()), EPOCHS)
    held = rows.filter(F.col("split").isin(*EV.EVAL_SPLITS))
    held = held.select(*SCORED, *[t.udf()(F.col(c)).alias(n) for t, (n, c) in zip(towers, TOWERS.items(), strict=True)])
    scores = F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).alias("score")) for n in TOWERS])
    return stored(held.select(*SCORED, F.inline(scores)), "towers-scored")


@register("pca_2d")
def q_pca_2d(spark, d):
    """Pooled item text vectors projected on 2 principal components (centred
    first; sign fixed so the largest-magnitude loading is positive), with the
    item's mean train rating."""
    from recsmith.models import projection as PJ
    ix = td.interactions(spark, d, with_vectors=True)
    pooled = FT.item_mean_pool(ix, ["text_emb"])
    pts = PJ.pca_2d(pooled, "text_emb")
    pop = ix.filter(F.col("split") == "train").groupBy("business_id").agg(F.avg("rating").alias("mean_rating"))
    return pts.join(pop, "business_id", "left")
