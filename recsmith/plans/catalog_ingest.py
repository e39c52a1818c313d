"""Registered ingest, sink/scan round trips, metadata and picture planning
queries. Round trips write derived data to a fresh folder under the shared
checkpoint location and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsmith import oracle_sql as O
from recsmith.functions import vectors as V
from recsmith.operators import features as FT
from recsmith.operators import metadata as MD
from recsmith.operators import pictures as PC
from recsmith.operators import sequence as SQ
from recsmith.plans import evaluation as EV
from recsmith.plans import features_build as FB
from recsmith.plans.catalog_features import IMG_POOL_SQL
from recsmith.plans.catalog_text import DENSE_RAW
from recsmith.registry import register
from recsmith.sources import ingest as IG
from recsmith.sources import matrices as MX
from recsmith.sources import testdata as td

REC = O.records_cte()
IX = O.ix_cte()


def _records(spark, d):
    return td.raw_records(spark, d)


def _pics(spark, d, with_name=False):
    """Records with the fields that picture and metadata queries read: no review text."""
    return td.interactions(spark, d, with_pics=True, with_name=with_name)


REQ_SQL = f"""WITH {REC}
  SELECT row_id, split, business_id, user_id, rating, review_text, array_to_string(pics, '|') AS pics,
         CAST(len(history_reviews) AS INTEGER) AS history_reviews FROM rec"""


def _flat_required(df):
    return df.select("row_id", "split", "business_id", "user_id", "rating", "review_text",
                     F.array_join("pics", "|").alias("pics"), F.size("history_reviews").alias("history_reviews"))


@register("scan_split_json", REQ_SQL)
def q_scan_split_json(spark, d):
    """Records written as JSON lines (split column) and read back with the
    explicit record schema; a split without rows is an error."""
    path = IG.sink_json(_records(spark, d), IG.scratch_path(spark, "records_jsonl"))
    return _flat_required(IG.project_required(IG.require_splits(IG.scan_records_jsonl(spark, path))))


@register("discover_tables", "SELECT x.t AS \"table\", CAST(c.i AS INTEGER) AS pos, c.name AS \"column\", x.n AS n_rows FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS t, count(*) AS n, (SELECT list(name ORDER BY cid) FROM pragma_table_info('{t}')) AS cols FROM {t}" for t in td.TABLES)
    + ") x, LATERAL (SELECT unnest(cols) AS name, unnest(range(1, len(cols) + 1)) AS i) c")
def q_discover_tables(spark, d):
    """All tables of a folder by pattern, with their columns and row counts."""
    return IG.describe_tables(spark, f"{d.rstrip('/')}/*.parquet").drop("dtype")


@register("project_required", REQ_SQL)
def q_project_required(spark, d):
    return _flat_required(IG.project_required(_records(spark, d)))


@register("require_columns", f"""WITH {REC} SELECT split, count(*) AS n_rows FROM rec GROUP BY split""")
def q_require_columns(spark, d):
    r = IG.require_columns(_records(spark, d))
    return r.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@register("flatten_records", f"""WITH {REC}
  SELECT row_id, split, business_id AS "ids.business_id", user_id AS "ids.user_id",
         name AS "meta.name", rating AS "meta.rating" FROM rec""")
def q_flatten_records(spark, d):
    r = _records(spark, d).select("row_id", "split", F.struct("business_id", "user_id").alias("ids"),
                                  F.struct("name", "rating").alias("meta"))
    path = IG.sink_json(r, IG.scratch_path(spark, "nested_jsonl"))
    schema = T.StructType([
        T.StructField("row_id", T.LongType()), T.StructField("split", T.StringType()),
        T.StructField("ids", T.StructType([T.StructField("business_id", T.StringType()),
                                           T.StructField("user_id", T.StringType())])),
        T.StructField("meta", T.StructType([T.StructField("name", T.StringType()),
                                            T.StructField("rating", T.IntegerType())]))])
    return IG.flatten_records(IG.scan_jsonl(spark, path, schema))


@register("scan_jsonl", f"""WITH {REC}
  SELECT DISTINCT unnest(list_filter(pics, lambda p: p IS NOT NULL AND p <> '')) AS pic_id FROM rec""")
def q_scan_jsonl(spark, d):
    """A second JSON lines table (picture catalogue), schema inferred."""
    pics = _pics(spark, d).select(F.explode(FT.clean_pic_ids("pics")).alias("pic_id")).distinct()
    path = IG.sink_json(pics, IG.scratch_path(spark, "pictures_jsonl"))
    return IG.scan_jsonl(spark, path).select("pic_id")


@register("sink_parquet", f"""WITH {REC} SELECT split, count(*) AS n_rows, count(DISTINCT business_id) AS n_business
  FROM rec GROUP BY split""")
def q_sink_parquet(spark, d):
    path = IG.sink_parquet(_records(spark, d), IG.scratch_path(spark, "splits_parquet"))
    back = spark.read.parquet(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("business_id").alias("n_business"))


@register("scan_parquet", f"""WITH {REC} SELECT row_id, business_id, user_id, rating FROM rec WHERE split = 'val'""")
def q_scan_parquet(spark, d):
    """Partition-pruned read: only the split=val folder is listed and scanned."""
    path = IG.sink_parquet(td.interactions(spark, d).select("row_id", "split", "business_id", "user_id", "rating"),
                           IG.scratch_path(spark, "splits_parquet"))
    return spark.read.parquet(path).filter(F.col("split") == "val").select("row_id", "business_id", "user_id", "rating")


@register("union_splits", f"""WITH {REC} SELECT split, count(*) AS n_rows FROM rec GROUP BY split""")
def q_union_splits(spark, d):
    path = IG.sink_parquet(td.interactions(spark, d).select("row_id", "split", "business_id"),
                           IG.scratch_path(spark, "splits_parquet"))
    parts = [spark.read.parquet(f"{path}/split={s}").withColumn("split", F.lit(s)) for s in IG.SPLITS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@register("qa_report", f"""WITH {REC} SELECT split, count(*) AS rows, 1 AS columns_ok FROM rec GROUP BY split""")
def q_qa_report(spark, d):
    return IG.qa_report(IG.project_required(_records(spark, d)))


@register("contract_violations", f"""WITH {O.flawed_cte()},
  v AS (SELECT split,
      CAST(sum(CASE WHEN business_id IS NULL OR business_id = '' THEN 1 ELSE 0 END) AS BIGINT) AS empty_business_id,
      CAST(sum(CASE WHEN user_id IS NULL OR user_id = '' THEN 1 ELSE 0 END) AS BIGINT) AS empty_user_id,
      CAST(sum(CASE WHEN rating IS NULL OR NOT (rating BETWEEN 1 AND 5) THEN 1 ELSE 0 END) AS BIGINT) AS rating_out_of_range,
      CAST(sum(CASE WHEN coalesce(review_text, '') = '' AND rating IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS empty_text_without_rating,
      CAST(sum(CASE WHEN coalesce(list_bool_or(list_transform(pics, lambda p: p IS NULL OR p = '')), false) THEN 1 ELSE 0 END) AS BIGINT) AS bad_pic_id,
      CAST(sum(CASE WHEN coalesce(list_bool_or(list_transform(history_reviews, lambda p: p IS NULL OR p = '')), false) THEN 1 ELSE 0 END) AS BIGINT) AS bad_history_entry
    FROM rec GROUP BY split)
  SELECT split, rule, violations FROM v UNPIVOT (violations FOR rule IN
    (empty_business_id, empty_user_id, rating_out_of_range, empty_text_without_rating, bad_pic_id, bad_history_entry))""")
def q_contract_violations(spark, d):
    return IG.contract_violations(td.flawed_records(spark, d))


@register("quarantine_records", f"""WITH {O.flawed_cte()}
  SELECT row_id, split, array_to_string(list_filter([
      CASE WHEN coalesce(business_id, '') = '' THEN 'empty_business_id' END, CASE WHEN coalesce(user_id, '') = '' THEN 'empty_user_id' END,
      CASE WHEN rating IS NULL OR NOT (rating BETWEEN 1 AND 5) THEN 'rating_out_of_range' END,
      CASE WHEN coalesce(review_text, '') = '' AND rating IS NULL THEN 'empty_text_without_rating' END,
      CASE WHEN list_contains(pics, '') THEN 'bad_pic_id' END, CASE WHEN list_contains(history_reviews, '') THEN 'bad_history_entry' END],
      lambda x: x IS NOT NULL), ',') AS reasons
  FROM rec WHERE reasons <> ''""")
def q_quarantine_records(spark, d):
    """The rows that break a contract rule, with the rules they break."""
    _, bad = IG.quarantine(td.flawed_records(spark, d))
    return bad.select("row_id", "split", F.array_join("reasons", ",").alias("reasons"))


@register("provenance_manifest", f"""WITH {REC}
  SELECT count(*) FILTER (WHERE split = 'train') AS rows_train, count(*) FILTER (WHERE split = 'val') AS rows_val,
         count(*) FILTER (WHERE split = 'test') AS rows_test,
         (SELECT count(DISTINCT p) FROM (SELECT unnest(pics) AS p FROM rec)) AS image_manifest_count,
         42 AS random_seed, 'events' AS source_file, 'v1' AS dataset_version FROM rec""")
def q_provenance_manifest(spark, d):
    r = _records(spark, d)
    n_pics = r.select(F.explode("pics").alias("p")).distinct().count()
    m = IG.provenance_manifest(r, n_pics, 42, "events")
    return m.drop("created_at_utc")


@register("sink_vectors", f"""WITH {O.ix_cte(vec=True)}
  SELECT row_id, split, CAST(len(text_emb) AS INTEGER) AS dim,
         round(list_sum(list_transform(text_emb, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM ix""")
def q_sink_vectors(spark, d):
    ix = td.interactions(spark, d, with_vectors=True).select("row_id", "split", "text_emb")
    path = IG.sink_parquet(ix, IG.scratch_path(spark, "text_emb"))
    back = spark.read.parquet(path)
    return back.select("row_id", "split", F.size("text_emb").alias("dim"),
                       F.aggregate("text_emb", F.lit(0.0).cast("double"), lambda a, x: a + x).alias("total"))


@register("scan_vectors", f"""WITH {O.ix_cte(vec=True)}
  SELECT row_id, split, rating, CAST(len(text_emb) AS INTEGER) AS dim FROM ix""")
def q_scan_vectors(spark, d):
    vec = td.interactions(spark, d, with_vectors=True).select("row_id", "split", "text_emb")
    path = IG.sink_parquet(vec, IG.scratch_path(spark, "text_emb"))
    idx = td.interactions(spark, d).select("row_id", "split", "rating")
    j = FT.align_by_row(idx, spark.read.parquet(path))
    return j.select("row_id", "split", "rating", F.size("text_emb").alias("dim"))


@register("scan_item_cache", f"""{IMG_POOL_SQL}, {O.ix_cte(vec=True)}, {O.pool_cte()},
  per AS (SELECT business_id, split, count(*) AS n FROM ix WHERE business_id IS NOT NULL GROUP BY 1, 2),
  tot AS (SELECT business_id, sum(n) AS t FROM per GROUP BY 1),
  img AS (SELECT m.business_id, m.pos, sum(CAST(CAST(m.v / mn.n AS FLOAT) AS DOUBLE) * per.n) AS s
          FROM m JOIN mn USING (business_id, split) JOIN per USING (business_id, split) GROUP BY 1, 2)
  SELECT business_id, 'text_emb' AS kind, CAST(pos AS INTEGER) AS pos, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6) AS value FROM pool
  UNION ALL
  SELECT tot.business_id, 'img_emb', CAST(p.pos AS INTEGER), round(CAST(CAST(coalesce(img.s, 0.0) / tot.t AS FLOAT) AS DOUBLE), 6)
  FROM tot CROSS JOIN (SELECT DISTINCT pos FROM m) p LEFT JOIN img ON img.business_id = tot.business_id AND img.pos = p.pos
  UNION ALL
  SELECT ix.business_id, 'dense', CAST(dz.pos AS INTEGER), round(CAST(CAST(avg(dz.x) AS FLOAT) AS DOUBLE), 6)
  FROM ix JOIN (WITH {DENSE_RAW} SELECT row_id, pos, CAST(CAST((x - m) / s AS FLOAT) AS DOUBLE) AS x FROM lf JOIN fit USING (pos)) dz USING (row_id)
  WHERE ix.business_id IS NOT NULL GROUP BY ix.business_id, dz.pos""")
def q_scan_item_cache(spark, d):
    """Item cache of pooled text, picture and dense vectors, written and read back."""
    ix = td.interactions(spark, d, with_vectors=True)
    pooled = FT.image_pool(FT.manifest_pictures(_pics(spark, d)), td.picture_vectors(spark, d))
    dim = len(td.picture_vectors(spark, d).select("img_vec").first()[0])
    z, _ = FB.zscored_dense(spark, d)
    kinds = ("text_emb", "img_emb", "dense")
    items = FT.item_mean_pool(FT.join_item_images(ix, pooled, dim).join(z.select("row_id", "dense"), "row_id", "left"), list(kinds))
    cache = items.select("business_id", *[F.col(k).cast("array<float>").alias(k) for k in kinds], "n_rows")
    back = spark.read.parquet(IG.sink_parquet(cache, IG.scratch_path(spark, "item_cache"), partition_by=[]))
    parts = [IG.vectors_long(back, ["business_id"], k).withColumn("kind", F.lit(k)) for k in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("sink_metrics_csv", f"""WITH {O.ix_cte()}, {O.stats_ctes()},
  sc AS (SELECT ix.*, (SELECT mu FROM mu) + coalesce(us.user_bias, 0.0) + coalesce(ist.item_bias, 0.0) AS score
         FROM ix LEFT JOIN us USING (user_id) LEFT JOIN ist USING (business_id))
  SELECT 'bias' AS model, split, round(sqrt(avg((score - rating) * (score - rating))), 6) AS rmse,
         round(avg(abs(score - rating)), 6) AS mae FROM sc GROUP BY split""")
def q_sink_metrics_csv(spark, d):
    rep = EV.bias_report(EV.bias_scored(td.interactions(spark, d)))
    path = IG.sink_csv(rep, IG.scratch_path(spark, "metrics_csv"))
    return spark.read.schema("model string, split string, rmse double, mae double").option("header", True).csv(path)


MD_SQL = f"""WITH {REC}, {O.metadata_cte()}
  SELECT business_id, name, image_url, round(avg_rating, 6) AS avg_rating, num_reviews FROM md"""


@register("first_metadata_per_item", MD_SQL)
def q_first_metadata_per_item(spark, d):
    return MD.first_metadata_per_item(_pics(spark, d, with_name=True))


@register("sink_metadata_json", MD_SQL)
def q_sink_metadata_json(spark, d):
    md = MD.first_metadata_per_item(_pics(spark, d, with_name=True))
    path = IG.sink_json(md, IG.scratch_path(spark, "item_metadata"))
    return IG.scan_metadata(spark, path)


@register("scan_metadata", MD_SQL)
def q_scan_metadata(spark, d):
    """Written metadata plus an absent file (-> empty), unioned."""
    md = MD.first_metadata_per_item(_pics(spark, d, with_name=True))
    path = IG.sink_json(md, IG.scratch_path(spark, "item_metadata"))
    missing = IG.scan_metadata(spark, IG.scratch_path(spark, "absent"))
    return IG.scan_metadata(spark, path).unionByName(missing)


@register("drop_missing_business", f"""WITH {O.flawed_cte()}
  SELECT split, count(*) AS n_rows FROM rec WHERE business_id IS NOT NULL AND business_id <> '' GROUP BY split""")
def q_drop_missing_business(spark, d):
    return MD.drop_missing_business(td.flawed_records(spark, d)).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@register("coalesce_metadata", f"""WITH {REC}
  SELECT row_id, coalesce(nullif(name, ''), 'Business ' || business_id) AS name,
         CAST(rating AS DOUBLE) AS avg_rating, CAST(NULL AS BIGINT) AS num_reviews FROM rec""")
def q_coalesce_metadata(spark, d):
    c = MD.coalesce_metadata(_records(spark, d), keys=("row_id", "business_id"))
    return c.select("row_id", "name", "avg_rating", "num_reviews")


@register("image_url", f"""WITH {REC}
  SELECT row_id, CASE WHEN pics[1] IS NOT NULL AND pics[1] <> '' THEN '/media/images/' || pics[1] || '.jpg' END AS image_url
  FROM rec""")
def q_image_url(spark, d):
    return _pics(spark, d).select("row_id", MD.image_url("pics").alias("image_url"))


PICS = f"""{REC},
  pics AS (SELECT DISTINCT unnest(list_filter(pics, lambda p: p IS NOT NULL AND p <> '')) AS pic_id FROM rec),
  cand AS (SELECT pic_id, CAST(b.pos AS INTEGER) AS base_pos, b.base || pic_id AS url FROM pics,
           (VALUES (0, '{PC.BASES[0]}'), (1, '{PC.BASES[1]}')) b(pos, base)),
  listing AS (SELECT DISTINCT unnest(pics) AS pic_id, CAST(64 * 4 AS BIGINT) AS length FROM rec WHERE split = 'train'),
  att AS (SELECT cand.*, CASE WHEN (CAST(substr(pic_id, 2) AS BIGINT) + base_pos) % 3 = 0 THEN 404 ELSE 200 END AS status,
                 CASE (CAST(substr(pic_id, 2) AS BIGINT) + base_pos) % 4 WHEN 0 THEN 'text/html'
                      WHEN 1 THEN 'application/octet-stream' ELSE 'image/jpeg' END AS content_type FROM cand)"""


def _pictures(spark, d):
    return _pics(spark, d).select(F.explode(FT.clean_pic_ids("pics")).alias("pic_id")).distinct()


def _listing(spark, d):
    """files already present: the pictures of train records, with their size"""
    r = _pics(spark, d).filter(F.col("split") == "train")
    return r.select(F.explode("pics").alias("pic_id")).distinct().withColumn("length", F.lit(64 * 4).cast("long"))


def _attempts(spark, d):
    n = F.substring("pic_id", 2, 1 << 20).cast("long") + F.col("base_pos")
    c = PC.candidate_urls(_pictures(spark, d))
    return c.select("*", F.when(n % 3 == 0, 404).otherwise(200).alias("status"),
                    F.when(n % 4 == 0, "text/html").when(n % 4 == 1, "application/octet-stream")
                    .otherwise("image/jpeg").alias("content_type"))


@register("candidate_urls", f"WITH {PICS} SELECT pic_id, base_pos, url FROM cand")
def q_candidate_urls(spark, d):
    return PC.candidate_urls(_pictures(spark, d))


@register("anti_join_downloaded", f"""WITH {PICS}
  SELECT pic_id FROM pics WHERE pic_id NOT IN (SELECT pic_id FROM listing WHERE length > 0)""")
def q_anti_join_downloaded(spark, d):
    return PC.anti_join_downloaded(_pictures(spark, d), _listing(spark, d))


FETCH_SQL = f"""WITH {PICS},
  best AS (SELECT pic_id, arg_min(url, base_pos) AS url FROM att
           WHERE status = 200 AND (content_type LIKE 'image/%' OR content_type LIKE 'application/octet-stream%')
           GROUP BY pic_id),
  o AS (SELECT pics.pic_id,
          CASE WHEN l.pic_id IS NOT NULL THEN 'present' WHEN best.url IS NOT NULL THEN 'saved' ELSE 'failed' END AS outcome,
          CASE WHEN l.pic_id IS NULL THEN best.url END AS url
        FROM pics LEFT JOIN (SELECT pic_id FROM listing WHERE length > 0) l USING (pic_id) LEFT JOIN best USING (pic_id))"""


@register("fetch_outcome", f"{FETCH_SQL} SELECT * FROM o")
def q_fetch_outcome(spark, d):
    return PC.fetch_outcome(_pictures(spark, d), _attempts(spark, d), _listing(spark, d))


@register("fetch_tally", f"""{FETCH_SQL}
  SELECT count(*) FILTER (WHERE outcome <> 'failed') AS saved, count(*) FILTER (WHERE outcome = 'failed') AS failed FROM o""")
def q_fetch_tally(spark, d):
    return PC.fetch_tally(PC.fetch_outcome(_pictures(spark, d), _attempts(spark, d), _listing(spark, d)))


@register("item_detail_lookup", f"""WITH {REC}, {O.metadata_cte()},
  req AS (SELECT DISTINCT business_id FROM rec UNION ALL SELECT DISTINCT business_id || '_unknown' FROM rec)
  SELECT req.business_id, CAST(CASE WHEN md.business_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS found,
         md.name, CAST(NULL AS VARCHAR) AS address, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS state,
         CAST(NULL AS DOUBLE) AS sales_volume, md.image_url, round(md.avg_rating, 6) AS avg_rating, md.num_reviews
  FROM req LEFT JOIN md USING (business_id)""")
def q_item_detail_lookup(spark, d):
    r = _records(spark, d)
    ids = r.select("business_id").distinct()
    req = ids.unionByName(ids.select(F.concat("business_id", F.lit("_unknown")).alias("business_id")))
    out = MD.item_detail_lookup(req, MD.first_metadata_per_item(r))
    return out.select("business_id", "found", "name", "address", "city", "state", "sales_volume",
                      "image_url", "avg_rating", "num_reviews")


@register("item_detail_point", f"""WITH {REC}, {O.metadata_cte()},
  asked AS (SELECT min(business_id) AS id FROM md UNION ALL SELECT max(business_id) FROM md UNION ALL SELECT min(business_id) || '_unknown' FROM md)
  SELECT id AS asked, md.business_id, md.name, md.image_url, round(md.avg_rating, 6) AS avg_rating FROM asked LEFT JOIN md ON business_id = id""")
def q_item_detail_point(spark, d):
    """Point lookups (the first id, the last one, an unknown one) in the stored details."""
    md = MD.first_metadata_per_item(_pics(spark, d, with_name=True))
    path = MD.store_details(md, IG.scratch_path(spark, "details"))
    ends = md.agg(F.min("business_id").alias("lo"), F.max("business_id").alias("hi")).first()
    out = None
    for item in (ends.lo, ends.hi, None if ends.lo is None else f"{ends.lo}_unknown"):
        one = spark.createDataFrame([(item,)], "asked string").join(
            MD.detail_of(spark, path, item or "", md.schema).select("business_id", "name", "image_url", "avg_rating"), F.lit(True), "left")
        out = one if out is None else out.unionByName(one)
    return out


@register("join_metadata", f"""WITH {REC}, {O.metadata_cte()},
  pop AS (SELECT business_id, count(*) AS n FROM rec WHERE split = 'train' GROUP BY business_id),
  top AS (SELECT business_id, CAST(row_number() OVER (ORDER BY n DESC, business_id) AS INTEGER) AS rank FROM pop)
  SELECT top.rank, top.business_id, md.name, md.image_url AS representative_image_url,
         round(md.avg_rating, 6) AS avg_rating, md.num_reviews
  FROM top LEFT JOIN md USING (business_id) WHERE top.rank <= 10""")
def q_join_metadata(spark, d):
    from recsmith.operators import topk as TK
    r = _records(spark, d)
    top = TK.top_ids(r.filter(F.col("split") == "train"), "business_id", 10)
    ranked = TK.rank_within(top, [], [F.col("n").desc(), F.col("business_id").asc()], 10)
    md = MD.first_metadata_per_item(r)
    return ranked.join(md, "business_id", "left").select(
        F.col("rank").cast("int"), "business_id", "name", F.col("image_url").alias("representative_image_url"),
        "avg_rating", "num_reviews")


# ---------------------------------------------------------------- matrix files

MATRIX_SQL = """SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, CAST(len(embedding) AS INTEGER) AS dim,
       round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm,
       round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings"""


@register("sink_matrix", MATRIX_SQL)
def q_sink_matrix(spark, d):
    """The embeddings written as a NumPy matrix in the order of their ids, and read back."""
    path = IG.scratch_path(spark, "matrix")
    MX.write_matrix(td.table(spark, d, "embeddings"), path, "embedding", ["vec_id"])
    v = MX.read_matrix(spark, path)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return v.select("row_id", F.size("vec").alias("dim"), V.l2_norm("vec").alias("norm"), total.alias("total"))


@register("scan_matrix", """SELECT e.vec_id, m.row_id, round(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS dot
  FROM embeddings e JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS row_id FROM embeddings) m USING (vec_id)""")
def q_scan_matrix(spark, d):
    """Rows of a matrix file joined to their keys by position."""
    path = IG.scratch_path(spark, "matrix")
    vecs = td.table(spark, d, "embeddings")
    MX.write_matrix(vecs, path, "embedding", ["vec_id"], dtype="<f8")
    keys = SQ.dense_index(vecs.select("vec_id"), ["vec_id"], "row_id").withColumn("row_id", F.col("row_id").cast("long"))
    m = MX.read_matrix(spark, path)
    return keys.join(m, "row_id").join(vecs, "vec_id").select("vec_id", "row_id", V.dot("vec", "embedding").alias("dot"))
