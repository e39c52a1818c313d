"""Picture encoder behind ``predict_batch_udf``.

The encoder is pluggable: ``embed_images(df, col, out, make_predict=...)``
takes any factory returning a batch function bytes[] -> float[n, dim]. The
default (no pretrained network or weights are installed here) is a
byte-histogram projection: 256-bin byte frequencies projected with a seeded
Gaussian matrix and L2-normalised. Pictures are de-duplicated before
encoding, so each is encoded once however many businesses share it; rows
without bytes (missing or unreadable files) get a null vector.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 64
SEED = 7
BATCH = 64


def histogram_encoder(dim: int = DIM, seed: int = SEED):
    def make_predict():
        R = np.random.default_rng(seed).standard_normal((256, dim)) / math.sqrt(dim)

        def predict(contents: np.ndarray) -> np.ndarray:
            out = np.zeros((len(contents), dim), dtype=np.float32)
            for i, c in enumerate(contents):
                if c is None or len(c) == 0:
                    continue
                h = np.bincount(np.frombuffer(bytes(c), dtype=np.uint8), minlength=256).astype(np.float64)
                v = (h / h.sum()) @ R
                out[i] = v / max(np.linalg.norm(v), 1e-12)
            return out
        return predict
    return make_predict


def brightness_encoder(cells: int = 64):
    """Centred and normalised brightness of a decoded picture's parts (``pictures.decode``: grid)."""
    def make_predict():
        def predict(grids: np.ndarray) -> np.ndarray:
            m = np.asarray([np.zeros(cells) if g is None else g for g in grids], dtype=np.float64).reshape(len(grids), cells)
            m = m - m.mean(1, keepdims=True)
            return (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        return predict
    return make_predict


def embed_images(pictures: DataFrame, content: str = "content", out: str = "img_vec",
                 make_predict=None, dim: int = DIM, batch_size: int = BATCH, shape: list[int] | None = None) -> DataFrame:
    """(pic_id, out). ``shape``: that of an input, where it is an array column."""
    make_predict = make_predict or histogram_encoder(dim)
    udf = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size,
                            input_tensor_shapes=[shape] if shape else None)
    uniq = pictures.select("pic_id", content).dropDuplicates(["pic_id"])
    have = uniq.filter(F.col(content).isNotNull())
    enc = have.withColumn(out, udf(F.col(content))).select("pic_id", out)
    return uniq.select("pic_id").join(enc, "pic_id", "left")
