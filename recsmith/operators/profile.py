"""Data profiles: null counts, describe (exact quantiles by a distributed
sort), distributions, distinct counts, shape, alignment checks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recsmith.session import stored


def null_profile(df: DataFrame, cols: list[str] | None = None, by: list[str] = ()) -> DataFrame:
    """(*by, column, non_null, missing_pct) from one aggregate pass, unpivoted.
    missing_pct = 100 * nulls / rows, 2 decimals, half-even."""
    cols = cols or [c for c in df.columns if c not in by]
    row = [F.count(F.lit(1)).alias("_n")] + [F.count(F.col(c)).alias(c) for c in cols]
    agg = df.groupBy(*by).agg(*row)
    stacked = agg.select(*by, "_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("non_null")) for c in cols])).alias("s"))
    return stacked.select(
        *by, "s.column", "s.non_null",
        F.bround(F.when(F.col("_n") > 0, (F.col("_n") - F.col("s.non_null")) * 100.0 / F.col("_n"))
                 .otherwise(F.lit(0.0)), 2).alias("missing_pct"))


def exact_quantiles(df: DataFrame, col: str, qs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Linear-interpolated quantiles (pandas/NumPy 'linear') found by rank among
    the counts of the distinct values: counted with partial aggregation, ranged
    over partitions, and only the partitions that hold a wanted rank (at
    floor/ceil of q*(n-1)) are summed up value by value."""
    spark = df.sparkSession
    vals = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = stored(vals.groupBy("v").agg(F.count(F.lit(1)).alias("n")).repartitionByRange(parts, "v")
                    .withColumn("pid", F.spark_partition_id()), "value-counts")
    sizes = sorted((r["pid"], r["n"]) for r in counts.groupBy("pid").agg(F.sum("n").alias("n")).collect())  # a row per partition
    n = sum(k for _, k in sizes)
    if n == 0:
        return spark.createDataFrame([(float(q), None) for q in qs], "q double, value double")
    need = {q: (math.floor(q * (n - 1)), math.ceil(q * (n - 1)), q * (n - 1) - math.floor(q * (n - 1))) for q in qs}
    got, before = {}, 0
    for pid, size in sizes:
        ranks = sorted({r - before for lo, hi, _ in need.values() for r in (lo, hi) if before <= r < before + size})
        if ranks:
            w = Window.partitionBy("pid").orderBy("v")
            upto = counts.filter(F.col("pid") == pid).select("v", "n", F.sum("n").over(w).alias("upto"))
            hit = F.filter(F.array(*[F.lit(r) for r in ranks]), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
            for r in upto.select("v", F.explode_outer(hit).alias("r")).filter("r is not null").collect():   # <= 2 rows per quantile
                got[before + int(r["r"])] = float(r["v"])
        before += size
    rows = [(float(q), got[lo] + (got[hi] - got[lo]) * f) for q, (lo, hi, f) in need.items()]
    return spark.createDataFrame(rows, "q double, value double")


def describe_numeric(df: DataFrame, col: str) -> DataFrame:
    """count, mean, std (sample), min, 25%, 50%, 75%, max as (stat, value)."""
    spark = df.sparkSession
    a = df.agg(F.count(col).cast("double").alias("count"), F.avg(col).alias("mean"),
               F.stddev_samp(col).alias("std"), F.min(col).cast("double").alias("min"),
               F.max(col).cast("double").alias("max")).first()
    qv = {r["q"]: r["value"] for r in exact_quantiles(df, col).collect()}
    rows = [("count", a["count"]), ("mean", a["mean"]), ("std", a["std"]), ("min", a["min"]),
            ("25%", qv[0.25]), ("50%", qv[0.5]), ("75%", qv[0.75]), ("max", a["max"])]
    return spark.createDataFrame([(col, s, None if v is None else float(v)) for s, v in rows],
                                 "column string, stat string, value double")


# a quantile sketch is off by at most n / ACCURACY ranks; brackets are two such steps to either side
ACCURACY = 10_000


def describe_by(df: DataFrame, cols: list[str], by: list[str], qs=(0.25, 0.5, 0.75)) -> DataFrame:
    """describe() of several columns per group, as (*by, column, stat, value).

    One aggregate gives the moments and, from quantile sketches, a bracket of
    values around every wanted rank. A second pass counts the values below each
    bracket and the distinct values inside it, so only about 4 / ACCURACY of a
    continuous column's values are shuffled (a row per distinct value and task of
    a column with few values), and the quantiles are exact. A bracket that turns
    out not to hold its rank is widened to the whole range and counted again."""
    keys = [*by, "column"]
    long = df.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])))
    long = long.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    edges = [x for q in qs for x in (max(0.0, q - 2 / ACCURACY), min(1.0, q + 2 / ACCURACY))]
    base = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
                                   F.min("v").alias("min"), F.max("v").alias("max"),
                                   F.percentile_approx("v", edges, ACCURACY).alias("edges"))
    base = stored(base, "describe-base")                     # a row per group and column
    want = F.array(*[F.struct(F.lit(f"{round(100 * q)}%").alias("stat"), (q * (F.col("n") - 1)).alias("h"),
                              F.get("edges", F.lit(2 * i)).alias("lo"), F.get("edges", F.lit(2 * i + 1)).alias("hi")) for i, q in enumerate(qs)])
    brackets = base.select(*keys, "min", "max", F.inline(want))
    found = _in_brackets(long, brackets, keys)
    held = stored(found, "describe-quantiles")
    missed = _keyed_join(brackets, held.filter("value is null").select(*keys, "stat"), [*keys, "stat"], "left_semi")
    again = _in_brackets(long, missed.withColumns({"lo": F.col("min"), "hi": F.col("max")}), keys)
    quant = held.filter("value is not null").unionByName(again) if not missed.isEmpty() else held
    plain = base.select(*keys, F.inline(F.array(*[F.struct(F.lit(k if k != "n" else "count").alias("stat"), F.col(k).cast("double").alias("value"))
                                                  for k in ("n", "mean", "std", "min", "max")])))
    return plain.unionByName(quant)


def _keyed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys where nulls are equal; the right side's keys are dropped."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(other[f"_{k}"])
    return left.join(other, on, how).drop(*[f"_{k}" for k in keys])


def _in_brackets(long: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, stat, value): the value at rank h of each bracket, between its two
    neighbours; null if the bracket does not hold them."""
    at = _keyed_join(long, brackets.select(*keys, "stat", "lo", "hi"), keys, "inner").filter("v <= hi")
    inside = F.when(F.col("v") >= F.col("lo"), F.col("v"))                      # all values below count as one
    counts = at.groupBy(*keys, "stat", inside.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys, "stat").orderBy(F.col("v").asc_nulls_first()))
    ranked = _keyed_join(counts.select(*keys, "stat", "v", "c", upto.alias("upto")), brackets.select(*keys, "stat", "h"), [*keys, "stat"], "inner")
    held = lambda r: F.col("v").isNotNull() & (r < F.col("upto")) & (r >= F.col("upto") - F.col("c"))
    lo, hi = F.max(F.when(held(F.floor("h")), F.col("v"))), F.max(F.when(held(F.ceil("h")), F.col("v")))
    return ranked.groupBy(*keys, "stat").agg(lo.alias("lo"), hi.alias("hi"), F.max(F.col("h") - F.floor("h")).alias("f")).select(
        *keys, "stat", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("f")).alias("value"))


def value_counts(df: DataFrame, col: str, by: list[str] = ()) -> DataFrame:
    """counts per value (nulls dropped), sorted by value."""
    return (df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(*by, col))


def distinct_counts(df: DataFrame, cols: list[str], by: list[str] = (), approx: bool = False) -> DataFrame:
    f = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.countDistinct(c))
    return df.groupBy(*by).agg(*[f(c).alias(f"n_{c}") for c in cols])


def table_shape(df: DataFrame, by: str = "split") -> DataFrame:
    ncols = len([c for c in df.columns if c != by])
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(ncols))


def schema_table(df: DataFrame) -> DataFrame:
    """column name and type as a small frame (from the schema, no data)."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields],
                                           "column string, dtype string")


def head_texts(df: DataFrame, text: str, order: str, n: int = 3, width: int = 140, by: list[str] = ()) -> DataFrame:
    """first n non-null texts per group (by ``order``), cut to ``width`` chars + '…'."""
    from recsmith.operators.topk import rank_within
    t = df.filter(F.col(text).isNotNull())
    r = rank_within(t, list(by), [F.col(order).asc()], n, "i")
    cut = F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("…"))).otherwise(F.col(text))
    return r.select(*by, F.col("i").cast("int").alias("i"), cut.alias("sample"))


def has_nan(v) -> F.Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.exists(v, lambda x: F.isnan(x))


def guarded_corr(a: str, b: str) -> F.Column:
    """Pearson correlation, null when either side is constant (no error
    under ANSI mode)."""
    den = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(den > 0, F.covar_pop(a, b) / den)


MATRIX_SUMS = "grp string, matrix string, pos int, rows long, missing long, nan_rows long, n long, mean double, m2 double"


def summarize_matrices(df: DataFrame, by: str, matrices: list[str]) -> DataFrame:
    """(by, matrix, pos, n_rows, n_missing, nan_rows, n, mean, std) of every
    component (pos from 1) of vector columns, in one pass.

    A task adds up its rows per group and matrix: rows, null vectors, rows with a
    NaN, and per component the count, mean and squared deviations of the values
    that are numbers. What leaves it is a row per component, whatever its rows.
    The moments are merged exactly (no difference of large squares); a vector of
    another length than the longest counts where it has components."""
    def run(batches):
        sums: dict[tuple, list] = {}
        for batch in batches:
            grp = np.array(batch.column("grp").to_pylist(), object)
            for name in matrices:
                col = batch.column(name)
                size = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
                for key in sorted(set(zip(grp.tolist(), size.tolist(), strict=True)), key=str):
                    at = np.flatnonzero((grp == key[0]) & (size == key[1]))
                    acc = sums.setdefault((key[0], name, key[1]), [0, 0, np.zeros(max(0, key[1])), np.zeros(max(0, key[1])), np.zeros(max(0, key[1]))])
                    acc[0] += len(at)
                    if key[1] <= 0:
                        continue
                    m = col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), key[1])
                    ok = ~np.isnan(m)
                    acc[1] += int((~ok).any(1).sum())
                    n = ok.sum(0)
                    mean = np.where(ok, m, 0).sum(0) / np.maximum(n, 1)
                    m2 = (np.where(ok, m - mean, 0) ** 2).sum(0)
                    total = acc[2] + n
                    away = mean - acc[3]
                    acc[4] += m2 + away ** 2 * acc[2] * n / np.maximum(total, 1)
                    acc[3] += away * n / np.maximum(total, 1)
                    acc[2] = total
        rows = []
        for (g, name, size), (count, nan, n, mean, m2) in sums.items():
            if size <= 0:                                    # a row that stands for vectors without components
                rows.append((g, name, 0, count, count if size < 0 else 0, 0, 0, 0.0, 0.0))
            rows += [(g, name, i + 1, count, 0, nan, int(n[i]), float(mean[i]), float(m2[i])) for i in range(max(0, size))]
        cols = list(zip(*rows, strict=True)) or [[]] * 9
        types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4, pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                         names=[x.split()[0] for x in MATRIX_SUMS.split(", ")])

    narrow = df.select(F.col(by).cast("string").alias("grp"), *[F.col(m).cast("array<double>").alias(m) for m in matrices])
    # read three times below: the vectors go through once, and their sums (a row per component and task) are kept
    part = stored(narrow.mapInArrow(run, MATRIX_SUMS), "matrix-sums")
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))
    some = part.filter("pos > 0").groupBy("grp", "matrix", "pos").agg(
        F.sum("rows").alias("with_pos"), F.sum("nan_rows").alias("nan_rows"), n.alias("n"), mean.alias("mean"),
        F.collect_list(F.struct("n", "mean", "m2")).alias("tasks"))
    # squared deviations of the tasks' means from the common one, and those inside the tasks
    dev = F.aggregate("tasks", F.lit(0.0), lambda a, t: a + t["m2"] + t["n"] * (t["mean"] - F.col("mean")) * (t["mean"] - F.col("mean")))
    none = part.filter("pos = 0").groupBy("grp", "matrix").agg(F.sum("rows").alias("empty"), F.sum("missing").alias("missing"))
    rows = part.filter("pos <= 1").groupBy("grp", "matrix").agg(F.sum("rows").alias("n_rows"))
    def attach(left: DataFrame, right: DataFrame, how: str) -> DataFrame:      # a null group is a group
        other = right.withColumnsRenamed({"grp": "_grp", "matrix": "_matrix"})
        return left.join(other, left["grp"].eqNullSafe(F.col("_grp")) & (left["matrix"] == F.col("_matrix")), how).drop("_grp", "_matrix")

    out = attach(attach(some, rows, "inner"), none, "left")
    return out.select(F.col("grp").alias(by), "matrix", "pos", "n_rows", F.coalesce("missing", F.lit(0)).cast("long").alias("n_missing"),
                      "nan_rows", "n", "mean", F.sqrt(dev / F.nullif(F.col("n"), F.lit(0))).alias("std"))
