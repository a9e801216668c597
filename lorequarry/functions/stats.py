"""Statistics as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """Ends of the Wilson 95 % interval, clamped to [0, 1]; no trials give (0, 0)."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    p, z2 = hits / m, Z95 * Z95
    centre, half = p + z2 / (2 * m), Z95 * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m))
    low, high = (centre - half) / (1 + z2 / m), (centre + half) / (1 + z2 / m)
    none = F.coalesce(n, F.lit(0)) == 0
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), low)), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), high))


def rounded(x: Column, digits: int) -> Column:
    """Scaled and then rounded to a whole number, as the SQL of the queries rounds; ``F.round`` takes the decimal digits, so 10.87075 differs at four."""
    return F.round(x * 10.0**digits) / 10.0**digits


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))


def looks_random(text: Column, least_entropy: float = 3.0, least_length: int = 12) -> Column:
    """Cheap tests first: length, six distinct characters, fewer than two spaces, entropy."""
    distinct = F.size(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")))
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return (F.length(text) >= least_length) & (distinct >= 6) & (spaces < 2) & (entropy(text) >= least_entropy)


def hop_penalty(degree: Column) -> Column:
    return 1.0 / F.ln(F.greatest(degree, F.lit(1)) + F.lit(2.718281828459045))
