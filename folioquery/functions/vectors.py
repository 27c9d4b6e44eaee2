"""Vector expressions over arrays, accumulated in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioquery.functions.text import col, let


def inner_product(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column | str) -> Column:
    """Euclidean length; 1 for a zero vector, so that it can be divided by."""
    n = F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    return let(n, lambda length: F.when(length == 0, F.lit(1.0)).otherwise(length))


def normalized(v: Column | str) -> Column:
    """The vector divided by its length, as floats."""
    scaled = lambda w, n: F.transform(w, lambda x: (x.cast("double") / n).cast("float"))
    return let(col(v), lambda w: let(norm(w), lambda n: scaled(w, n)))
