"""2-D projection of item vectors with Spark ML PCA.

Spark's PCA does not centre on transform, so the mean vector (one
Summarizer aggregate) is subtracted first; each component's sign is fixed so
its largest-magnitude loading is positive (deterministic orientation)."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pca_2d(df: DataFrame, col: str, key: str = "business_id", k: int = 2) -> DataFrame:
    vec = df.select(key, array_to_vector(F.col(col)).alias("v"))
    mean = vec.agg(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray()   # one d-vector
    mlit = F.array(*[F.lit(float(x)) for x in mean])
    centred = df.select(key, array_to_vector(F.zip_with(F.col(col), mlit, lambda a, b: a - b)).alias("x"))
    model = PCA(k=k, inputCol="x", outputCol="p").fit(centred)
    pc = model.pc.toArray()                        # d x k loadings
    signs = np.sign(pc[np.abs(pc).argmax(axis=0), np.arange(k)])
    signs[signs == 0] = 1.0
    pts = model.transform(centred).select(key, vector_to_array("p").alias("p"))
    return pts.select(key, *[(F.col("p")[i] * float(signs[i])).alias(f"pc{i + 1}") for i in range(k)])
