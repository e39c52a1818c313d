"""Registered text and dense-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from recsmith import oracle_sql as O
from recsmith.functions import text as TX
from recsmith.operators import features as FT
from recsmith.plans import features_build as FB
from recsmith.registry import register
from recsmith.sources import testdata as td


@register("clean_html_text", f"SELECT page_id, {O.clean_sql('html')} AS cleaned_text FROM pages")
def q_clean_html_text(spark, d):
    pages = td.spread(td.table(spark, d, "pages"), "page_id")
    return pages.select("page_id", TX.clean_html_text("html").alias("cleaned_text"))


DOC_CLEAN = f"dc AS (SELECT doc_id, {O.clean_sql('text')} AS c FROM documents)"


@register("word_count", f"""WITH {DOC_CLEAN}
  SELECT doc_id, CAST(CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END AS INTEGER) AS text_len_words FROM dc""")
def q_word_count(spark, d):
    docs = td.spread(td.table(spark, d, "documents"), "doc_id")
    return docs.select("doc_id", TX.word_count(TX.clean_html_text("text")).alias("text_len_words"))


@register("char_length_profile", """SELECT doc_id, CAST(length(coalesce(text, '')) AS INTEGER) AS n_chars,
  CAST(length(coalesce(text, '')) = n_chars AS INTEGER) AS matches_stored FROM documents""")
def q_char_length_profile(spark, d):
    docs = td.spread(td.table(spark, d, "documents"), "doc_id")
    n = TX.char_length("text")
    return docs.select("doc_id", n.alias("n_chars"), (n == F.col("n_chars")).cast("int").alias("matches_stored"))


@register("list_length", f"""WITH {O.records_cte()}
  SELECT row_id, CAST(coalesce(len(pics), 0) AS INTEGER) AS pics_len,
         CAST(coalesce(len(history_reviews), 0) AS INTEGER) AS history_len FROM rec""")
def q_list_length(spark, d):
    r = td.interactions(spark, d, with_pics=True, with_history=True)
    return r.select("row_id", TX.list_length("pics").alias("pics_len"),
                    TX.list_length("history_reviews").alias("history_len"))


@register("lexicon_sentiment", f"""WITH {DOC_CLEAN}, {O.sentiment_ctes('dc', 'doc_id', 'c')}
  SELECT doc_id, round(sentiment, 6) AS sentiment FROM sent""")
def q_lexicon_sentiment(spark, d):
    lex, neg, boost = FB.sentiment_params(spark)
    docs = td.spread(td.table(spark, d, "documents"), "doc_id").select("doc_id", TX.clean_html_text("text").alias("c"))
    return TX.with_sentiment(docs, "c", "sentiment", lex, neg, boost).select("doc_id", "sentiment")


# per interaction row text features: the row's text is a documents row
TEXT_FEATS = f"""{DOC_CLEAN}, {O.sentiment_ctes('dc', 'doc_id', 'c')},
  tf AS (SELECT dc.doc_id, CAST(CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END AS INTEGER) AS text_len_words,
                sent.sentiment FROM dc JOIN sent USING (doc_id)),
  {O.ix_cte()},
  ixt AS (SELECT ix.*, tf.text_len_words, tf.sentiment FROM ix
          LEFT JOIN tf ON tf.doc_id = ix.row_id % (SELECT count(*) FROM documents))"""


@register("text_features", f"""WITH {TEXT_FEATS}
  SELECT row_id, split, text_len_words, round(sentiment, 6) AS sentiment FROM ixt""")
def q_text_features(spark, d):
    return FB.interaction_text_features(spark, d).select("row_id", "split", "text_len_words", "sentiment")


MANIFEST = f"""{O.ix_cte('pr', pics=True)},
  m AS (SELECT business_id, split, CAST(sum(len(list_filter(pics, lambda p: p IS NOT NULL AND p <> ''))) AS INTEGER) AS pic_count
        FROM pr WHERE business_id IS NOT NULL GROUP BY 1, 2)"""

DENSE_RAW = f"""{TEXT_FEATS}, {MANIFEST}, {O.stats_ctes('ixt')},
  raw AS (SELECT ixt.row_id, ixt.split,
      CAST(coalesce(m.pic_count, 0) AS DOUBLE) AS f1, CAST(ixt.text_len_words AS DOUBLE) AS f2,
      CAST(ixt.sentiment AS DOUBLE) AS f3, CAST(coalesce(us.user_hist_len, 0) AS DOUBLE) AS f4,
      CAST(coalesce(ist.item_hist_len, 0) AS DOUBLE) AS f5, coalesce(us.user_bias, 0.0) AS f6,
      coalesce(ist.item_bias, 0.0) AS f7, CAST(coalesce(m.pic_count, 0) > 0 AS DOUBLE) AS f8
    FROM ixt LEFT JOIN m USING (business_id, split) LEFT JOIN us USING (user_id) LEFT JOIN ist USING (business_id)),
  lf AS (SELECT row_id, split, pos, x FROM raw, LATERAL (VALUES (1, f1), (2, f2), (3, f3), (4, f4), (5, f5), (6, f6), (7, f7), (8, f8)) t(pos, x)),
  fit AS (SELECT pos, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 OR stddev_pop(x) IS NULL THEN 1.0 ELSE stddev_pop(x) END AS s
          FROM lf WHERE split = 'train' GROUP BY pos)"""


@register("dense_vector", f"""WITH {DENSE_RAW}
  SELECT row_id, split, CAST(pos AS INTEGER) AS pos, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 6) AS value FROM lf""")
def q_dense_vector(spark, d):
    raw = FT.dense_vector(FB.dense_table(spark, d), FT.FEATURE_ORDER, "dense")
    return raw.select("row_id", "split", F.posexplode("dense").alias("pos", "value")).select(
        "row_id", "split", (F.col("pos") + 1).cast("int").alias("pos"), F.col("value").cast("double"))


@register("zscore_fit", f"""WITH {DENSE_RAW}
  SELECT CAST(pos AS INTEGER) AS pos, round(m, 6) AS mean, round(s, 6) AS std FROM fit""")
def q_zscore_fit(spark, d):
    from recsmith.operators import stats as ST
    raw = FB.dense_table(spark, d)
    params = ST.zscore_fit(raw.filter(F.col("split") == "train"), FT.FEATURE_ORDER)
    rows = [(i + 1, params[c][0], params[c][1]) for i, c in enumerate(FT.FEATURE_ORDER)]
    # 8 fitted parameters: a driver-side result of one aggregate
    return spark.createDataFrame(rows, "pos int, mean double, std double")


@register("zscore_apply", f"""WITH {DENSE_RAW}
  SELECT lf.row_id, lf.split, CAST(lf.pos AS INTEGER) AS pos,
         round(CAST(CAST((lf.x - fit.m) / fit.s AS FLOAT) AS DOUBLE), 6) AS value
  FROM lf JOIN fit USING (pos)""")
def q_zscore_apply(spark, d):
    z, _ = FB.zscored_dense(spark, d)
    return z.select("row_id", "split", F.posexplode("dense").alias("pos", "value")).select(
        "row_id", "split", (F.col("pos") + 1).cast("int").alias("pos"), F.col("value").cast("double"))
