"""Vector arithmetic as native columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecweave.functions.binding import let


def _zero() -> Column:
    return F.lit(0.0)


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def has_embedding(v: Column) -> Column:
    """True for a vector that is present and not empty."""
    return v.isNotNull() & (F.size(v) > 0)


def _sum(values: Column) -> Column:
    return F.aggregate(values, _zero(), lambda acc, x: acc + x)


def squared_norm(v: Column) -> Column:
    return F.aggregate(as_double(v), _zero(), lambda acc, x: acc + x * x)


def norm(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def _checked(a: Column, b: Column, result: Column) -> Column:
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.raise_error(F.lit("empty vector")).cast("double"))
        .when(
            F.size(a) != F.size(b),
            F.raise_error(
                F.concat(F.lit("vector lengths differ: "), F.size(a), F.lit(" and "), F.size(b))
            ).cast("double"),
        )
        .otherwise(result)
    )


def dot_product(a: Column, b: Column) -> Column:
    return _checked(a, b, _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of the angle; 0.0 where either vector has no length."""
    dot = _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))
    value = let(norm(a) * norm(b), lambda n: F.when(n == 0, _zero()).otherwise(dot / n))
    return _checked(a, b, value)


def euclidean_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return _checked(a, b, F.sqrt(_sum(squares)))


def normalize(v: Column, strict: bool = True) -> Column:
    """Vector of unit length. An empty or zero vector is an error, or null when not strict."""
    none = F.lit(None).cast("array<double>")
    bad = F.raise_error(F.lit("cannot normalize an empty or zero vector")).cast("array<double>") if strict else none
    return F.when(v.isNull(), none).otherwise(
        let(
            norm(v),
            lambda n: F.when(n == 0, bad).otherwise(F.transform(as_double(v), lambda x: x / n)),
        )
    )
