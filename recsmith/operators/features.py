"""Feature jobs: picture manifest, image counts, dense vectors, cold-start
flags and per-item pooling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsmith.functions import vectors as V

# fixed values: dense feature order
FEATURE_ORDER = ["pic_count", "text_len_words", "sentiment", "user_hist_len",
                 "item_hist_len", "user_bias", "item_bias", "has_image"]

# fixed values: split order used by "first record wins"
SPLITS = ("train", "val", "test")


def split_rank(col: str = "split") -> F.Column:
    return F.when(F.col(col) == SPLITS[0], 0).when(F.col(col) == SPLITS[1], 1).otherwise(2)


def clean_pic_ids(pics) -> F.Column:
    """Keep non-null, non-empty ids; a null list becomes []."""
    pics = F.col(pics) if isinstance(pics, str) else pics
    return F.coalesce(F.filter(pics, lambda p: p.isNotNull() & (p != "")),
                      F.array().cast("array<string>"))


def manifest_pictures(records: DataFrame) -> DataFrame:
    """Long-form picture manifest: one row per (business_id, split, row_id, pic_pos, pic_id).

    The list a business would hold is kept exploded, ordered by
    (row_id, pic_pos): a hot business never becomes one in-memory list.
    """
    r = records.filter(F.col("business_id").isNotNull()).select(
        "business_id", "split", "row_id", F.posexplode(clean_pic_ids("pics")).alias("pic_pos", "pic_id"))
    return r


def image_manifest(records: DataFrame) -> DataFrame:
    """One row per (business_id, split): pic_count = sum of cleaned list sizes.

    Rows with no pictures still create the group (count 0), as in the
    reference; null business ids are dropped.
    """
    return (records.filter(F.col("business_id").isNotNull())
            .groupBy("business_id", "split")
            .agg(F.sum(F.size(clean_pic_ids("pics"))).cast("int").alias("pic_count"),
                 F.count(F.lit(1)).alias("n_records")))


def join_image_counts(ix: DataFrame, manifest: DataFrame) -> DataFrame:
    """Left join on (business_id, split); missing -> 0; has_image flag."""
    m = manifest.select("business_id", "split", "pic_count")
    return (ix.join(m, ["business_id", "split"], "left")
            .withColumn("pic_count", F.coalesce(F.col("pic_count"), F.lit(0)).cast("int"))
            .withColumn("has_image", (F.col("pic_count") > 0).cast("int")))


def dense_vector(df: DataFrame, cols: list[str] = FEATURE_ORDER, out: str = "dense") -> DataFrame:
    return df.withColumn(out, F.array(*[F.col(c).cast("float") for c in cols]))


def distinct_ids(ix: DataFrame, key: str, split: str = "train") -> DataFrame:
    return ix.filter(F.col("split") == split).select(key).distinct()


def cold_start_flags(ix: DataFrame, train_split: str = "train") -> DataFrame:
    """is_new_user / is_new_item against the distinct train ids.

    Existence is a left join to the distinct ids with a marker. A null id matches
    a null train id, as ``isin`` does; null ids stay out of the join (they would
    all meet in one task) and get the answer of one small aggregate.
    """
    keys = ("user_id", "business_id")
    train = F.col("split") == train_split
    seen = ix.agg(*[F.coalesce(F.max((train & F.col(k).isNull()).cast("int")), F.lit(0)).alias(k) for k in keys]).first()
    out = ix
    for k, flag in zip(keys, ("is_new_user", "is_new_item"), strict=True):
        ids = distinct_ids(ix, k, train_split).filter(F.col(k).isNotNull()).select(F.col(k).alias(k), F.lit(1).alias("_met"))
        out = out.join(ids, k, "left").withColumn(
            flag, F.when(F.col(k).isNull(), F.lit(1 - seen[k])).otherwise(F.col("_met").isNull().cast("int"))).drop("_met")
    return out


def packed_matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a column of packed vectors of one length (``dim`` if given), without nulls; reads the column's own memory."""
    if column.null_count:
        raise ValueError(f"{column.null_count} null vectors")
    if not len(column):
        return np.empty((0, dim or 0), np.float32)
    column = column.cast(pa.binary())
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    if not (size == (size[0] if dim is None else 4 * dim)).all():
        raise ValueError(f"vectors of another length than {dim or size[0] // 4}")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].view("<f4").reshape(len(column), -1)


def vector_mean(col: str, alias: str | None = None):
    """Mean of an array<float> column as array<double>: Summarizer keeps a
    fixed-size partial buffer per group, so it combines map-side."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(col)))).alias(alias or col)


def item_mean_pool(df: DataFrame, vector_cols: list[str], key: str = "business_id",
                   splits: list[str] | None = None) -> DataFrame:
    """Per item: mean of each vector column over its rows (of ``splits``, by
    default of all), plus n_rows. Packed vectors are summed up per item and task first."""
    df = df if splits is None else df.filter(F.col("split").isin(list(splits)))
    df = df.filter(F.col(key).isNotNull())
    if vector_cols and all(isinstance(df.schema[c].dataType, T.BinaryType) for c in vector_cols):
        made = ", ".join(f"`{c}` array<double>" for c in vector_cols)
        parts = df.select(key, *vector_cols).mapInArrow(_partial_means(key, vector_cols), f"`{key}` {df.schema[key].dataType.simpleString()}, {made}, _n long")
        n = F.col("_n").cast("double")
        aggs = [vector_to_array(Summarizer.mean(array_to_vector(F.col(c)), n)).alias(c) for c in vector_cols]
        return parts.groupBy(key).agg(*aggs, F.sum("_n").alias("n_rows"))
    aggs = [vector_mean(c) for c in vector_cols] + [F.count(F.lit(1)).alias("n_rows")]
    return df.groupBy(key).agg(*aggs)


# values (keys times vector values) of the sums that a task holds before it hands them on
SUMS_AT_ONCE = 4_000_000


def _partial_means(key: str, cols: list[str]):
    """Means of packed vectors per key, of the rows of a task that are held together, with their number."""
    def fn(it):
        place, sums, n = {}, None, None

        def handed():
            at = np.arange(len(place))
            ends = [pa.array(np.arange(len(at) + 1) * s.shape[1], pa.int32()) for s in sums]
            means = [pa.ListArray.from_arrays(e, pa.array((s[at] / n[at, None]).ravel())) for e, s in zip(ends, sums, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(list(place), kind), *means, pa.array(n[at].astype(np.int64))], names=[key, *cols, "_n"])

        for batch in it:
            if not batch.num_rows:
                continue
            kind = batch.column(key).type
            X = [packed_matrix(batch.column(c)).astype(np.float64) for c in cols]
            of = batch.column(key).dictionary_encode()
            if sums is None:
                sums, n = [np.zeros((0, x.shape[1])) for x in X], np.zeros(0)
            rows = np.array([place.setdefault(k, len(place)) for k in of.dictionary.to_pylist()])[of.indices.to_numpy()]
            more = len(place) - len(n)
            sums, n = [np.concatenate([s, np.zeros((more, s.shape[1]))]) for s in sums], np.concatenate([n, np.zeros(more)])
            order = np.argsort(rows, kind="stable")
            first = np.flatnonzero(np.diff(rows[order], prepend=-1))
            at = rows[order][first]
            n[at] += np.diff([*first, len(rows)])
            for s, x in zip(sums, X, strict=True):
                s[at] += np.add.reduceat(x[order], first, axis=0)
            if len(place) * sum(s.shape[1] for s in sums) >= SUMS_AT_ONCE:
                yield handed()
                place, sums = {}, None
        if sums is not None:
            yield handed()
    return fn


def image_pool(manifest_pics: DataFrame, pictures: DataFrame, by=("business_id", "split")) -> DataFrame:
    """Per group: normalise each picture vector, mean, normalise again.

    Each picture vector is normalised once in the catalogue before the join.
    Groups whose pictures have no vector do not appear (-> null downstream).
    """
    pv = pictures.select("pic_id", V.l2_normalize("img_vec").alias("v"))
    # a picture that a group has many times joins its vector once, with its count as weight
    times = manifest_pics.groupBy(*by, "pic_id").agg(F.count(F.lit(1)).alias("_w"))
    j = times.join(pv, "pic_id", "inner")
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("v")), F.col("_w").cast("double")))
    pooled = j.groupBy(*by).agg(mean.alias("m"), F.sum("_w").alias("n_pics"))
    return pooled.select(*by, V.l2_normalize("m").cast("array<float>").alias("img_emb"), "n_pics")


def join_item_images(ix: DataFrame, pooled: DataFrame, dim: int, by=("business_id", "split")) -> DataFrame:
    """Row -> its business image vector (or packed vector); missing -> zero vector and a flag."""
    j = ix.join(pooled.select(*by, "img_emb"), list(by), "left")
    zeros = F.lit(bytes(4 * dim)) if isinstance(pooled.schema["img_emb"].dataType, T.BinaryType) else V.zero_vector(dim)
    return (j.withColumn("img_missing", F.col("img_emb").isNull().cast("int"))
            .withColumn("img_emb", F.coalesce(F.col("img_emb"), zeros)))


def align_by_row(index: DataFrame, *mats: DataFrame, how: str = "inner", key: str = "row_id") -> DataFrame:
    """Row-aligned matrices become a key join on row_id (per split when present)."""
    out = index
    keys = [key, "split"] if "split" in index.columns else [key]
    for m in mats:
        k = [c for c in keys if c in m.columns]
        out = out.join(m, k, how)
    return out


def concat_modalities(cols: list[str], out: str = "x") -> F.Column:
    return F.concat(*[F.col(c).cast("array<float>") for c in cols]).alias(out)
