"""Vector Column expressions over array<float> / array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col


def as_double(v) -> Column:
    return F.transform(col(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    """Inner product in double precision."""
    prod = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda acc, x: acc + x * x))


def normalize(a) -> Column:
    """Unit-length copy (double); the zero vector stays zero."""
    n = norm(a)
    return F.transform(as_double(a), lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))
