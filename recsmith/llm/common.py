"""Small shared pieces: reading tables, tables in the shared folder, row keys
and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recsmith.session import checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read
    again: cuts the lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken or any(c.startswith(n.lower()) for c in taken):
            n += "_"
        out.append(n)
    return out


def text_key(text: Column) -> Column:
    """64-bit key of a text; used next to the document id, so that rows that
    share an id but not a text stay apart."""
    return F.xxhash64(text)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: (id, root), root the
    smallest id of the component; ids without an edge do not occur.

    Every vertex hooks to its smallest smaller neighbour, the hooks are followed
    to their roots by pointer jumping, and the edges are relabelled by the roots
    until none joins two roots. Only (id, id) pairs move; each round is written
    to the shared folder.
    """
    e = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter("lo < hi").distinct()
    e = materialize(e, "edges")
    comp = None
    while not e.isEmpty():
        parent = e.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("root"))
        parent = materialize(parent, "hooks")
        while True:                      # pointer jumping: every hook points to its root
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("up"))
            jumped = parent.join(up, "root", "left").select(
                "id", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved"))
            jumped = materialize(jumped, "jump")
            parent, more = jumped.drop("moved"), not jumped.filter("moved").isEmpty()
            if not more:
                break
        if comp is None:
            comp = parent
        else:
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("up"))
            comp = (comp.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root"))
                    .unionByName(parent)).distinct()
        lo = parent.select(F.col("id").alias("lo"), F.col("root").alias("rl"))
        hi = parent.select(F.col("id").alias("hi"), F.col("root").alias("rh"))
        e = e.join(lo, "lo", "left").join(hi, "hi", "left").select(
            F.coalesce("rl", "lo").alias("x"), F.coalesce("rh", "hi").alias("y"))
        e = materialize(e.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))
                        .filter("lo < hi").distinct(), "edges")
    if comp is None:
        return e.select(F.col("lo").alias("id"), F.col("hi").alias("root"))
    roots = comp.select(F.col("root").alias("id"), "root")
    return comp.unionByName(roots).distinct()
