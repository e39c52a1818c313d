"""Item metadata: first record per business wins (train -> val -> test, then
file order), with the field fallbacks of the metadata builder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsmith.operators.features import split_rank

# fixed values: url pattern of a business picture and the fallback name prefix
IMAGE_URL_PREFIX = "/media/images/"
IMAGE_URL_SUFFIX = ".jpg"
NAME_PREFIX = "Business "


def image_url(pics) -> F.Column:
    """'/media/images/{first pic}.jpg' when the first element is a non-empty
    string; no fallback to later elements."""
    pics = F.col(pics) if isinstance(pics, str) else pics
    first = F.try_element_at(pics, F.lit(1))
    return F.when(first.isNotNull() & (first != ""),
                  F.concat(F.lit(IMAGE_URL_PREFIX), first, F.lit(IMAGE_URL_SUFFIX)))


def _opt(df: DataFrame, name: str, typ: str) -> F.Column:
    return F.col(name).cast(typ) if name in df.columns else F.lit(None).cast(typ)


def coalesce_metadata(df: DataFrame, keys: tuple[str, ...] = ("business_id",)) -> DataFrame:
    """name or 'Business <id>' (empty counts as missing); rating else stars;
    review_count else num_reviews."""
    return df.select(
        *keys,
        F.coalesce(F.nullif(_opt(df, "name", "string"), F.lit("")),
                   F.concat(F.lit(NAME_PREFIX), F.col("business_id"))).alias("name"),
        image_url(_opt(df, "pics", "array<string>")).alias("image_url"),
        F.coalesce(_opt(df, "rating", "double"), _opt(df, "stars", "double")).alias("avg_rating"),
        F.coalesce(_opt(df, "review_count", "long"), _opt(df, "num_reviews", "long")).alias("num_reviews"),
    )


def drop_missing_business(records: DataFrame) -> DataFrame:
    return records.filter(F.col("business_id").isNotNull() & (F.col("business_id") != ""))


def first_metadata_per_item(records: DataFrame) -> DataFrame:
    """min_by over (split rank, row_id): one partial-aggregated shuffle, no
    sort of the group, so a hot business costs one buffer per task."""
    recs = drop_missing_business(records)
    fields = [c for c in ("name", "pics", "rating", "stars", "review_count", "num_reviews") if c in recs.columns]
    first = (recs.groupBy("business_id")
             .agg(F.min_by(F.struct(*fields), F.struct(split_rank().alias("s"), F.col("row_id"))).alias("f"))
             .select("business_id", "f.*"))
    return coalesce_metadata(first)


def item_detail_lookup(requests: DataFrame, metadata: DataFrame, key: str = "business_id") -> DataFrame:
    """Bulk point lookup: requests left join metadata; unknown ids keep the
    request with null details; optional address fields become typed nulls."""
    md = metadata
    for c in ("address", "city", "state"):
        if c not in md.columns:
            md = md.withColumn(c, F.lit(None).cast("string"))
    if "sales_volume" not in md.columns:
        md = md.withColumn("sales_volume", F.lit(None).cast("double"))
    md = md.withColumn("_found", F.lit(1))
    return requests.join(md, key, "left").withColumn("found", F.coalesce(F.col("_found"), F.lit(0))).drop("_found")


def _bucket(key: F.Column, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def store_details(metadata: DataFrame, path: str, buckets: int = 64, key: str = "business_id") -> str:
    """Metadata laid out for point lookups: a folder per hash bucket of the id,
    rows sorted by id (tight row-group statistics) with a bloom filter on it. A
    lookup opens the files of one bucket and reads the row groups that may have
    the id; nothing is aggregated or scanned as a whole. Choose buckets so that
    one holds some tens of MB."""
    rows = metadata.withColumn("bucket", _bucket(F.col(key), buckets)).repartition(F.col("bucket")).sortWithinPartitions("bucket", key)
    (rows.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.block.size", 8 << 20)
     .partitionBy("bucket").parquet(f"{path}/of-{buckets}"))
    return path


def detail_of(spark: SparkSession, path: str, item: str, schema, buckets: int = 64, key: str = "business_id") -> DataFrame:
    """The stored details of one id, no row if it is unknown. ``schema``: that of the stored metadata."""
    stored = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    rows = spark.read.schema(stored).parquet(f"{path}/of-{buckets}")
    return rows.filter((F.col("bucket") == _bucket(F.lit(item), buckets)) & (F.col(key) == item)).drop("bucket")
