"""Fixed-length vector arithmetic.

Dot products fold over the arrays: written out term by term they would exceed the size up to which the JVM
compiles a generated method. Aggregations are the opposite case (one ``sum`` per slot), because Spark splits
aggregate code into small methods and combines partial sums before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 when either side is the zero vector."""
    return cosine_from(dot(a, b), norm(a), norm(b))


def cosine_from(product: Column, norm_a: Column, norm_b: Column) -> Column:
    return F.when((norm_a == 0) | (norm_b == 0), F.lit(0.0)).otherwise(product / (norm_a * norm_b))


def normalize(v: Column) -> Column:
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def literal_names(names: list[str]) -> Column:
    return F.expr("array(" + ", ".join("'" + n.replace("'", "\\'") + "'" for n in names) + ")")


def add_scaled(target: Column, source: Column, scale: Column) -> Column:
    return F.zip_with(target, source, lambda t, x: t + x * scale)


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def is_zero(v: Column) -> Column:
    return ~F.exists(v, lambda x: x != 0)


def is_valid(v: Column, dim: int) -> Column:
    """Right length and finite throughout."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dim) & finite, F.lit(False))


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)


def weighted_sums(v: str, weight: str, dim: int) -> list[Column]:
    """One ``sum`` per slot, for use inside ``agg``: partial sums combine before the shuffle."""
    return [F.expr(f"sum(get({v}, {i}) * {weight}) AS _s{i}") for i in range(dim)]


def gather_sums(divisor: str, dim: int) -> Column:
    return F.expr("array(" + ", ".join(f"coalesce(_s{i}, 0D) / {divisor}" for i in range(dim)) + ")")


def tag_affinity(v: Column, slot_names: list[str], floor: float = 0.01) -> Column:
    names = literal_names(slot_names)
    return F.map_filter(F.map_from_arrays(names, v), lambda _, x: x > floor)


def top_contributions(a: Column, b: Column, slot_names: list[str], n: int) -> Column:
    """The largest positive terms of a dot product, named, strongest first, slot order on ties."""
    names = literal_names(slot_names)
    terms = F.transform(
        F.arrays_zip(names.alias("n"), a.alias("a"), b.alias("b")),
        lambda t, i: F.struct((-(t["a"] * t["b"])).alias("neg"), i.alias("slot"), t["n"].alias("dimension")),
    )
    ordered = F.array_sort(F.filter(terms, lambda t: t["neg"] < 0))
    return F.transform(F.slice(ordered, 1, n), lambda t: F.struct(t["dimension"], (-t["neg"]).alias("contribution")))


def half_up(x: Column, digits: int) -> Column:
    """Rounding with halves going up (towards +inf)."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
