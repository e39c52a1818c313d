"""Feature build as one lazy DataFrame graph: text features, picture counts,
train statistics, dense vector, z-scoring fitted on train."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recsmith.functions import text as TX
from recsmith.operators import features as FT
from recsmith.operators import stats as ST
from recsmith.session import stored
from recsmith.sources import testdata as td


def sentiment_params(spark: SparkSession):
    return (TX.lexicon_dict(td.lexicon(spark)), td.NEGATIONS, dict(td.BOOSTERS))


def text_features(df: DataFrame, spark: SparkSession, text_col: str = "review_text",
                  keep_cleaned: bool = False) -> DataFrame:
    """text_len_words, sentiment (and cleaned_text): one Arrow pass over whole
    texts (see functions.text.with_text_features for the measured reason)."""
    lex, neg, boost = sentiment_params(spark)
    if lex is None:
        raise ValueError("the lexicon is too large to travel: use keyed_text_features, which joins it")
    return TX.with_text_features(df, text_col, lex, neg, boost, keep_cleaned)


def keyed_text_features(rows: DataFrame, texts: DataFrame, spark: SparkSession,
                        key: str = "text_key", text_col: str = "review_text",
                        keep_cleaned: bool = False) -> DataFrame:
    """Text features for ``rows`` whose text is the ``texts`` row at ``key``.

    The features are a function of the text alone, so they are computed once
    per text on the text table (whole texts, one Arrow pass) and joined to the rows on the key: the join moves a few bytes per
    row instead of the text, and a text shared by many rows is processed once.
    A row whose key has no text gets the features of the empty text."""
    src, (lex, neg, boost) = td.spread(texts.select(key, text_col), key), sentiment_params(spark)
    if lex is None:
        clean = src.select(key, TX.clean_html_text(text_col).alias("cleaned_text"))
        clean = clean.withColumn("text_len_words", TX.word_count("cleaned_text"))
        tf = TX.with_sentiment_join(clean, key, "cleaned_text", "sentiment", td.lexicon(spark), neg, boost)
        tf = tf if keep_cleaned else tf.drop("cleaned_text")
    else:
        tf = TX.with_text_features(src, text_col, lex, neg, boost, keep_cleaned).drop(text_col)
    out = rows.join(tf, key, "left").drop(key)
    fill = {"text_len_words": F.lit(0), "sentiment": F.lit(0.0)}
    if keep_cleaned:
        fill["cleaned_text"] = F.lit("")
    return out.withColumns({c: F.coalesce(F.col(c), v) for c, v in fill.items()})


def interaction_text_features(spark: SparkSession, sf_dir: str, keep_cleaned: bool = False, ix: DataFrame | None = None) -> DataFrame:
    """Interaction rows (``ix``, with their text keys, if a plan has them) with text_len_words, sentiment (and cleaned_text)."""
    ix = td.interactions(spark, sf_dir, with_text_key=True) if ix is None else ix
    return keyed_text_features(ix, td.text_source(spark, sf_dir), spark, keep_cleaned=keep_cleaned)


def dense_table(spark: SparkSession, sf_dir: str, ix: DataFrame | None = None) -> DataFrame:
    """Per interaction row: the 8 raw features in FEATURE_ORDER. A plan that has
    the interactions stored, with text keys and pictures, gives them as ``ix``."""
    if ix is None:
        tf = interaction_text_features(spark, sf_dir)
        manifest = FT.image_manifest(td.interactions(spark, sf_dir, with_pics=True))
        ix = td.interactions(spark, sf_dir)
    else:
        tf = interaction_text_features(spark, sf_dir, ix=ix.drop("pics"))
        manifest = FT.image_manifest(ix)
    tf = FT.join_image_counts(tf, manifest)
    mu, users, items = ST.train_stats(ix.select("split", "user_id", "business_id", "rating"))
    return ST.join_user_item_stats(tf, users, items)


def zscored_dense(spark: SparkSession, sf_dir: str, ix: DataFrame | None = None):
    """(rows with z-scored dense vector, fitted params)."""
    # fit (one aggregate) and apply read the same narrow rows: written once to the shared folder
    raw = stored(dense_table(spark, sf_dir, ix), "dense-raw")
    params = ST.zscore_fit(raw.filter(F.col("split") == "train"), FT.FEATURE_ORDER)
    z = ST.zscore_apply(raw, params)
    z = FT.dense_vector(z, [c + "_z" for c in FT.FEATURE_ORDER], "dense")
    return z, params
