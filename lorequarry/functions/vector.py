"""Vector functions as Columns over arrays; floats become doubles first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def _with(fields: Column, f) -> Column:
    """``f`` of a struct that is computed once, not once per element of what ``f`` maps over."""
    return F.element_at(F.transform(F.array(fields), f), 1)


def normalized(v: Column) -> Column:
    """Scaled to length one; the zero vector stays."""
    parts = F.struct(doubles(v).alias("v"), norm(v).alias("n"))
    return _with(parts, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(x)))


def quantized(v: Column, dims: int) -> Column:
    """The first ``dims`` components, scaled to length one, as (codes 0..255, scale, offset); rounding is half to even."""
    code = lambda s: F.transform(s["u"], lambda x: F.when(s["scale"] > 0, F.bround((x - s["low"]) / s["scale"])).otherwise(F.lit(0.0)).cast("int"))
    scaled = _with(F.struct(normalized(F.slice(v, 1, dims)).alias("u")), lambda s: F.struct(s["u"].alias("u"), F.array_min(s["u"]).alias("low"), ((F.array_max(s["u"]) - F.array_min(s["u"])) / 255).alias("scale")))
    return _with(scaled, lambda s: F.struct(code(s).alias("codes"), s["scale"].alias("scale"), s["low"].alias("offset")))


def dequantized(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: c * q["scale"] + q["offset"])
