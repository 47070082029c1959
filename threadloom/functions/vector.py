"""Vector expressions: int8 quantisation, dot products, norms, cosines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def q8_scale(v: str | Column) -> Column:
    """Largest magnitude over 127; 0 for a zero vector."""
    return F.array_max(F.transform(_col(v), lambda e: F.abs(e.cast("double")))) / 127.0


def q8(v: str | Column) -> Column:
    """Components over the scale, halves rounded up; zeros for a zero vector."""
    one = F.transform(F.array(F.struct(_col(v).alias("v"), q8_scale(v).alias("s"))), lambda x: F.transform(
        x["v"], lambda e: F.when(x["s"] > 0, F.floor(e.cast("double") / x["s"] + 0.5)).otherwise(0).cast("tinyint")
    ))
    return F.get(one, F.lit(0))


def dequantise(q: str | Column, scale: str | Column) -> Column:
    return F.transform(_col(q), lambda e: e * _col(scale))


def dot(a: str | Column, b: str | Column) -> Column:
    """Integer dot product; components are widened first."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("int") * y.cast("int")), F.lit(0).cast("long"), lambda s, x: s + x)


def l2_norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Exact cosine in doubles; 0 if either norm is 0."""
    d = F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    n = l2_norm(a) * l2_norm(b)
    return F.when(n > 0, d / n).otherwise(0.0)


def approximate_cosine(q: Column, q_scale: Column, q_norm: Column, v: Column, v_scale: Column, v_norm: Column) -> Column:
    return dot(q, v) * q_scale * v_scale / (q_norm * v_norm)
