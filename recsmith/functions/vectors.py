"""Vector column functions, all JVM-side higher-order expressions.

Vectors are ``array<float>`` columns; arithmetic accumulates in double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: norm floor used when normalising (zero vectors stay zero)
NORM_EPS = 1e-12


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def l2_norm(v) -> Column:
    v = _c(v)
    return F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x))


def lp_norm(v, p: float = 2.0) -> Column:
    v = _c(v)
    if p == 2.0:
        return l2_norm(v)
    if p == 1.0:
        return F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + F.abs(x.cast("double")))
    s = F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + F.pow(F.abs(x.cast("double")), p))
    return F.pow(s, 1.0 / p)


def l2_normalize(v, eps: float = NORM_EPS, p: float = 2.0) -> Column:
    """v / max(||v||_p, eps) as array<double>; null stays null."""
    v = _c(v)
    n = F.greatest(lp_norm(v, p), F.lit(eps))
    # inside the function of the elements the norm would be computed for each of them: it is bound first
    return F.get(F.transform(F.array(n), lambda m: F.transform(v, lambda x: x.cast("double") / m)), F.lit(0))


def dot(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def cosine_similarity(a, b, eps: float = NORM_EPS) -> Column:
    """dot of the two normalised vectors."""
    return dot(a, b) / (F.greatest(l2_norm(a), F.lit(eps)) * F.greatest(l2_norm(b), F.lit(eps)))


def zeros_like(v) -> Column:
    """mask_modality helper: same length, all zeros."""
    return F.transform(_c(v), lambda x: F.lit(0.0).cast("float"))


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def as_float_array(v) -> Column:
    return _c(v).cast("array<float>")
