"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of the embedding model's two input kinds (fixed values).
PASSAGE_PREFIX = "passage: "
QUERY_PREFIX = "query: "


def embedding_input(text: Column, is_query: bool = False) -> Column:
    """X01."""
    prefix = QUERY_PREFIX if is_query else PASSAGE_PREFIX
    return F.concat(F.lit(prefix), F.coalesce(text.cast("string"), F.lit("")))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Scaled to length 1; the zero vector stays as it is."""
    scale = norm(v)
    return F.when(scale == 0, v.cast("array<double>")).otherwise(
        F.transform(v, lambda x: x.cast("double") / scale)
    )


def cosine(a: Column, b: Column) -> Column:
    """0 when either vector is zero."""
    both = norm(a) * norm(b)
    return F.when(both == 0, 0.0).otherwise(F.try_divide(dot(a, b), both))


def is_valid(v: Column, dimension: int) -> Column:
    """Right length and no null element."""
    return F.coalesce(
        (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull()), F.lit(False)
    )
