"""Contiguous positions in a sort order without a single-partition window.

  1. range-partition + sort within partitions on the order key
  2. per partition, a running position per group (mapInPandas, no shuffle)
  3. row counts per (partition, group): a table of n_partitions x n_groups rows
  4. offsets = running sum of earlier partitions' counts per group (tiny window)
  5. position = offset + local position, via a join on (partition, group)

The sorted frame is checkpointed to the shared checkpoint folder, so the
partition ids seen by steps 2-5 are the same even when tasks are re-run.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recsmith.session import checkpoint_dir


def _local_positions(by: list[str], out: str):
    def fn(it):
        seen: dict = {}
        for pdf in it:
            if len(pdf) == 0:
                yield pdf.assign(**{out: pd.Series([], dtype="int64")})
                continue
            if by:
                keys = list(pdf[by].itertuples(index=False, name=None))
                g = pd.Series(keys, index=pdf.index)
            else:
                g = pd.Series([()] * len(pdf), index=pdf.index)
            local = g.groupby(g, sort=False).cumcount().to_numpy()
            base = g.map(lambda k: seen.get(k, 0)).to_numpy()
            pdf = pdf.assign(**{out: (base + local).astype("int64")})
            for k, n in g.value_counts(sort=False).items():
                seen[k] = seen.get(k, 0) + int(n)
            yield pdf
    return fn


def positions(df: DataFrame, order_cols: list[str], out: str = "pos", by: list[str] = (),
              start: int = 0, num_partitions: int | None = None, reliable: bool = True) -> DataFrame:
    """Contiguous ``start..`` positions per ``by`` group following ``order_cols``
    (which must be a total order within the group)."""
    spark = df.sparkSession
    by = list(by)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    srt = (df.repartitionByRange(n, *by, *order_cols).sortWithinPartitions(*by, *order_cols)
           .withColumn("_pid", F.spark_partition_id()))
    if reliable:
        checkpoint_dir(spark)
        srt = srt.checkpoint(eager=True)
    schema = T.StructType(srt.schema.fields + [T.StructField("_local", T.LongType(), False)])
    loc = srt.mapInPandas(_local_positions(by, "_local"), schema)
    counts = srt.groupBy("_pid", *by).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    # n_partitions x n_groups rows: the planner broadcasts it if it is small
    j = loc.join(offs, ["_pid", *by], "inner")
    return j.withColumn(out, F.col("_off") + F.col("_local") + F.lit(start)).drop("_pid", "_local", "_off")


def dense_index(df: DataFrame, order_cols: list[str], out: str, start: int = 0) -> DataFrame:
    """Position of each row of an already-distinct frame in sorted order."""
    return positions(df, order_cols, out, (), start).withColumn(out, F.col(out).cast("int"))


def row_id_assign(df: DataFrame, order_cols: list[str], by: list[str] = ("split",)) -> DataFrame:
    """row_id 0..N-1 per split in the given order."""
    return positions(df, order_cols, "row_id", by, 0)


def dictionary_codes(df: DataFrame, key: str, code: str | None = None) -> DataFrame:
    """(key, code) with code = rank of the id in sorted distinct order, from 0.
    Null ids get -1 (they are not in the dictionary)."""
    code = code or f"{key}_code"
    d = df.select(key).filter(F.col(key).isNotNull()).distinct()
    return dense_index(d, [key], code, 0)


def encode(df: DataFrame, dictionary: DataFrame, key: str, code: str) -> DataFrame:
    """id -> code join; ids missing from the dictionary (or null) get -1."""
    return df.join(dictionary, key, "left").withColumn(code, F.coalesce(F.col(code), F.lit(-1)))
