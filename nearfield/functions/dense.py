"""Vectors as array<float> columns: distances, arithmetic, slices, comparison, casts and text.

Every function takes and returns Columns. NULL in, NULL out. Sums run in double
precision from the first element to the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_DIMS = 16000
NAN = "NaN"


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def d(x: Column) -> Column:
    return x.cast("double")


def fail(*parts: str | Column) -> Column:
    return F.raise_error(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with value computed once, also where fn uses it inside of a lambda."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def matched(a: Column, b: Column, result: Column) -> Column:
    """result, if both have the same dimension; an error otherwise."""
    return F.when(a.isNull() | b.isNull(), None).when(F.size(a) == F.size(b), result).otherwise(fail("different vector dimensions ", F.size(a), " and ", F.size(b)))


def pairwise(a: Column, b: Column, fn: Callable[[Column, Column], Column]) -> Column:
    return total(F.zip_with(a, b, lambda x, y: fn(d(x), d(y))))


def l2_squared_distance(a: Column, b: Column) -> Column:
    return matched(a, b, pairwise(a, b, lambda x, y: (x - y) * (x - y)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared_distance(a, b))


def inner_product(a: Column, b: Column) -> Column:
    return matched(a, b, pairwise(a, b, lambda x, y: x * y))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -inner_product(a, b)


def l1_distance(a: Column, b: Column) -> Column:
    return matched(a, b, pairwise(a, b, lambda x, y: F.abs(x - y)))


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def cosine_of(ip: Column, aa: Column, bb: Column) -> Column:
    """1 - similarity; NaN if either norm is zero."""
    return F.when(aa * bb > 0, 1 - clamped(ip / F.sqrt(aa * bb))).when(ip.isNull() | aa.isNull() | bb.isNull(), None).otherwise(F.lit(float(NAN)))


def square(v: Column) -> Column:
    return total(F.transform(v, lambda x: d(x) * d(x)))


def cosine_distance(a: Column, b: Column) -> Column:
    return cosine_of(inner_product(a, b), square(a), square(b))


def spherical_distance(a: Column, b: Column) -> Column:
    """Angle between unit vectors as a share of pi."""
    return F.acos(clamped(inner_product(a, b))) / F.pi()


def vector_dims(v: Column) -> Column:
    return F.size(v)


def vector_norm(v: Column) -> Column:
    return F.sqrt(square(v))


l2_norm = vector_norm


def finite(v: Column, kind: str = "value out of range: overflow") -> Column:
    """v, or an error if an element is infinite or NaN."""
    return let(v, lambda r: F.when(unbounded(r), fail(kind)).otherwise(r))


def unbounded(v: Column) -> Column:
    return F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


def l2_normalize(v: Column) -> Column:
    """v over its norm; a zero vector stays."""
    return let(vector_norm(v), lambda n: F.when(n > 0, finite(F.transform(v, lambda x: (d(x) / n).cast("float")))).otherwise(v))


def vector_add(a: Column, b: Column) -> Column:
    return matched(a, b, finite(F.zip_with(a, b, lambda x, y: (x + y).cast("float"))))


def vector_sub(a: Column, b: Column) -> Column:
    return matched(a, b, finite(F.zip_with(a, b, lambda x, y: (x - y).cast("float"))))


def vector_mul(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: (x * y).cast("float"))
    lost = F.exists(F.zip_with(a, b, lambda x, y: (x != 0) & (y != 0) & ((x * y).cast("float") == 0)), lambda x: x)
    return matched(a, b, F.when(lost, fail("value out of range: underflow")).otherwise(finite(product)))


def sized(v: Column, most: int = MOST_DIMS) -> Column:
    return let(v, lambda r: sizes(r, most).otherwise(r))


def sizes(r: Column, most: int = MOST_DIMS) -> Column:
    return F.when(F.size(r) > most, fail("vector cannot have more than ", str(most), " dimensions")).when(F.size(r) < 1, fail("vector must have at least 1 dimension"))


def vector_concat(a: Column, b: Column) -> Column:
    return sized(F.concat(a, b))


def subvector(v: Column, start: Column | int, count: Column | int) -> Column:
    """Elements start, .. start + count - 1, counted from 1 and cut to those there are."""
    start, count = (F.lit(x) if isinstance(x, int) else x for x in (start, count))
    start, count, n = start.cast("bigint"), count.cast("bigint"), F.size(v).cast("bigint")
    end = F.when(start > n - count, n + 1).otherwise(start + count)
    begin = F.greatest(start, F.lit(1))
    wrong = F.when(count < 1, fail("vector must have at least 1 dimension")).when((begin > n) | (end <= begin), fail("vector must have at least 1 dimension"))
    return wrong.otherwise(F.slice(v, begin.cast("int"), (end - begin).cast("int")))


def vector_cmp(a: Column, b: Column) -> Column:
    """-1, 0 or 1: by elements, then by dimension."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def vector_lt(a: Column, b: Column) -> Column:
    return a < b


def vector_le(a: Column, b: Column) -> Column:
    return a <= b


def vector_eq(a: Column, b: Column) -> Column:
    return a == b


def vector_ne(a: Column, b: Column) -> Column:
    return a != b


def vector_ge(a: Column, b: Column) -> Column:
    return a >= b


def vector_gt(a: Column, b: Column) -> Column:
    return a > b


def assert_dims(v: Column, dims: int) -> Column:
    """v, or an error if it hasn't so many dimensions."""
    return let(v, lambda r: F.when(r.isNull(), None).when(F.size(r) == dims, r).otherwise(fail("expected ", str(dims), " dimensions, not ", F.size(r))))


def array_to_vector(v: Column, dims: int | None = None) -> Column:
    """Integers, reals, doubles or decimals as a vector: no nulls, all finite in single precision, 1 to 16000 dimensions."""

    def checked(r: Column) -> Column:
        wrong = sizes(r).when(F.exists(r, lambda x: x.isNull()), fail("array must not contain nulls")).when(unbounded(r), fail("infinite value or NaN not allowed in vector"))
        if dims is not None:
            wrong = wrong.when(F.size(r) != dims, fail("expected ", str(dims), " dimensions, not ", F.size(r)))
        return wrong.otherwise(r)

    return let(F.transform(v, lambda x: x.cast("float")), checked)


def vector_to_array(v: Column) -> Column:
    return v.cast("array<float>")


NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def vector_from_text(s: Column, dims: int | None = None) -> Column:
    """A vector from "[1, 2.5, 3]"."""

    def read(t: Column) -> Column:
        good = t.rlike(rf"^\s*\[\s*{NUMBER}\s*(?:,\s*{NUMBER}\s*)*\]\s*$")
        parts = F.transform(F.split(F.regexp_replace(t, r"[\[\]\s]", ""), ","), lambda x: x.cast("float"))
        out = F.when(t.isNull(), None).when(good, let(parts, lambda v: finite(sized(v), "value out of range for type vector"))).when(t.rlike(r"^\s*\[\s*\]\s*$"), fail("vector must have at least 1 dimension"))
        return out.otherwise(fail('invalid input syntax for type vector: "', t, '"'))

    out = let(s, read)
    return out if dims is None else assert_dims(out, dims)


def number_to_text(x: Column) -> Column:
    """The shortest decimal that reads back as the same float, without a needless point."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def vector_to_text(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, number_to_text), ","), F.lit("]"))
