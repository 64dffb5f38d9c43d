"""Half-precision vectors: array<float> columns whose elements are binary16 numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.functions import bits, dense
from nearfield.functions.dense import d, fail

#: The least magnitude that rounds beyond the largest half.
LIMIT = 65520.0


def round_half(x: Column) -> Column:
    """The nearest binary16 number, ties to even; subnormals stay, what is too large is infinite."""
    a = F.abs(d(x))
    exponent = F.greatest(F.floor(F.log2(F.when(a > 0, a).otherwise(1.0))).cast("double"), F.lit(-14.0))
    unit = F.pow(F.lit(2.0), exponent - 10)
    near = F.rint(d(x) / unit) * unit
    return F.when(a >= LIMIT, F.when(d(x) > 0, float("inf")).otherwise(float("-inf"))).otherwise(near).cast("float")


def halves(v: Column, message: str = "value out of range: overflow") -> Column:
    return dense.let(F.transform(v, round_half), lambda h: dense.finite(h, message))


def to_half(v: Column) -> Column:
    """A vector or array as halfvec; values beyond 65504 are an error."""

    def checked(h: Column, v: Column) -> Column:
        first = F.element_at(F.filter(v, lambda x: F.abs(d(x)) >= LIMIT), 1)
        wrong = F.when(F.exists(h, lambda x: x.isNull()), fail("array must not contain nulls")).when(F.exists(h, F.isnan), fail("infinite value or NaN not allowed in halfvec"))
        return wrong.when(dense.unbounded(h), fail('"', dense.number_to_text(first), '" is out of range for type halfvec')).otherwise(h)

    return dense.let(v, lambda v: dense.let(F.transform(v, round_half), lambda h: checked(h, v)))


def array_to_halfvec(v: Column, dims: int | None = None) -> Column:
    out = dense.sized(to_half(v))
    return out if dims is None else dense.assert_dims(out, dims)


def halfvec_to_vector(v: Column) -> Column:
    return v


def halfvec_from_text(s: Column, dims: int | None = None) -> Column:
    return to_half(dense.vector_from_text(s, dims))


halfvec_to_text = dense.vector_to_text
l2_distance = dense.l2_distance
l2_squared_distance = dense.l2_squared_distance
inner_product = dense.inner_product
negative_inner_product = dense.negative_inner_product
cosine_distance = dense.cosine_distance
l1_distance = dense.l1_distance
spherical_distance = dense.spherical_distance
vector_dims = dense.vector_dims
l2_norm = dense.vector_norm
subvector = dense.subvector
halfvec_concat = dense.vector_concat
halfvec_cmp = dense.vector_cmp


def l2_normalize(v: Column) -> Column:
    return dense.let(dense.vector_norm(v), lambda n: F.when(n > 0, halves(F.transform(v, lambda x: d(x) / n))).otherwise(v))


def halfvec_add(a: Column, b: Column) -> Column:
    return dense.matched(a, b, halves(F.zip_with(a, b, lambda x, y: d(x) + d(y))))


def halfvec_sub(a: Column, b: Column) -> Column:
    return dense.matched(a, b, halves(F.zip_with(a, b, lambda x, y: d(x) - d(y))))


def halfvec_mul(a: Column, b: Column) -> Column:
    lost = F.exists(F.zip_with(a, b, lambda x, y: (x != 0) & (y != 0) & (round_half(d(x) * d(y)) == 0)), lambda x: x)
    return dense.matched(a, b, F.when(lost, fail("value out of range: underflow")).otherwise(halves(F.zip_with(a, b, lambda x, y: d(x) * d(y)))))


halfvec_lt = dense.vector_lt
halfvec_le = dense.vector_le
halfvec_eq = dense.vector_eq
halfvec_ne = dense.vector_ne
halfvec_ge = dense.vector_ge
halfvec_gt = dense.vector_gt
halfvec_to_array = dense.vector_to_array
binary_quantize = bits.binary_quantize


def to_binary(v: Column) -> Column:
    """The halves as two big-endian bytes each, for storage and exchange; v must hold halves."""
    return F.unhex(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(half_bits(x)), 4, "0")), ""))


def half_bits(x: Column) -> Column:
    """The 16 bits of a half as an integer."""
    a = F.abs(d(x))
    exponent = F.greatest(F.floor(F.log2(F.when(a > 0, a).otherwise(1.0))).cast("double"), F.lit(-14.0))
    normal = a >= 2.0**-14
    mantissa = F.when(normal, (a / F.pow(F.lit(2.0), exponent) - 1) * 1024).otherwise(a * 2.0**24).cast("bigint")
    sign = F.when((d(x) < 0) | (x.cast("string") == "-0.0"), 32768).otherwise(0)
    return (sign + F.when(normal, (exponent + 15) * 1024).otherwise(0.0).cast("bigint") + mantissa).cast("bigint")


def from_binary(b: Column) -> Column:
    """The halves of to_binary()."""
    n = (F.length(b) / 2).cast("int")
    raw = lambda k: F.conv(F.hex(F.substring(b, (k * 2 + 1).cast("int"), F.lit(2))), 16, 10).cast("bigint")

    def value(r: Column) -> Column:
        e, m = F.floor(r % 32768 / 1024), (r % 1024).cast("double")
        size = F.when(e == 0, m * 2.0**-24).otherwise((1 + m / 1024) * F.pow(F.lit(2.0), e - 15))
        return (size * F.when(r >= 32768, -1.0).otherwise(1.0)).cast("float")

    return F.when(b.isNull(), None).when(n == 0, F.array().cast("array<float>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: value(raw(k))))
