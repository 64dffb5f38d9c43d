"""Sparse vectors as struct<dim: int, indices: array<int>, values: array<float>>: indices ascending from 0, no zero values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.functions import dense, half
from nearfield.functions.dense import NUMBER, d, fail, let, total

MOST_DIM, MOST_NONZERO = 1_000_000_000, 16000


def made(dim: Column, pairs: Column) -> Column:
    """A sparse vector from an array of structs (i, x), zeros dropped and sorted."""

    def parts(kept: Column) -> Column:
        return F.struct(dim.cast("int").alias("dim"), F.transform(kept, lambda p: p["i"]).alias("indices"), F.transform(kept, lambda p: p["x"]).alias("values"))

    return let(F.array_sort(F.filter(pairs, lambda p: p["x"] != 0)), parts)


def to_sparse(v: Column) -> Column:
    """A dense vector (or halfvec, or array of numbers) as a sparse one."""
    pairs = lambda r: F.transform(r, lambda x, k: F.struct(k.cast("int").alias("i"), x.alias("x")))
    return let(dense.array_to_vector(v), lambda r: F.when(r.isNull(), None).otherwise(made(F.size(r), pairs(r))))


def to_dense(s: Column) -> Column:
    """All elements: runs of zeros between the stored ones."""
    zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)

    def filled(s: Column) -> Column:
        upto = F.transform(s["indices"], lambda i, k: F.concat(zeros((i - F.coalesce(F.get(s["indices"], k - 1), F.lit(-1)) - 1).cast("int")), F.array(F.get(s["values"], k))))
        last = F.coalesce(F.get(s["indices"], F.size(s["indices"]) - 1), F.lit(-1))
        return dense.sized(F.concat(F.flatten(upto), zeros((s["dim"] - 1 - last).cast("int"))))

    return let(s, lambda r: F.when(r.isNull(), None).otherwise(filled(r)))


def to_half(s: Column) -> Column:
    return let(to_dense(s), half.to_half)


def from_text(s: Column, dim: int | None = None) -> Column:
    """A sparse vector from "{1:1.5,3:3.5}/5"; indices count from 1."""
    item = rf"\s*\d+\s*:\s*{NUMBER}\s*"

    def read(t: Column) -> Column:
        good = t.rlike(rf"^\s*\{{(?:{item}(?:,{item})*|\s*)\}}\s*/\s*\d+\s*$")
        made_of = let(F.regexp_replace(t, r"\s", ""), lambda clean: let(F.regexp_extract(clean, r"/(\d+)$", 1).cast("bigint"), lambda n: entries(clean, n)))
        return F.when(t.isNull(), None).when(~good, fail('invalid input syntax for type sparsevec: "', t, '"')).otherwise(made_of)

    def entries(clean: Column, n: Column) -> Column:
        pairs = F.transform(
            F.filter(F.split(F.regexp_extract(clean, r"^\{(.*)\}", 1), ","), lambda p: p != ""),
            lambda p: let(F.split(p, ":"), lambda x: F.struct((x[0].cast("bigint") - 1).cast("int").alias("i"), x[1].cast("float").alias("x"))),
        )
        return let(pairs, lambda pairs: let(F.transform(pairs, lambda p: p["i"]), lambda places: checked(pairs, places, n)))

    def checked(pairs: Column, places: Column, n: Column) -> Column:
        return (
            F.when(n < 1, fail("sparsevec must have at least 1 dimension"))
            .when(n > MOST_DIM, fail("sparsevec cannot have more than ", str(MOST_DIM), " dimensions"))
            .when(F.exists(places, lambda i: (i < 0) | (i >= n)), fail("sparsevec index out of bounds"))
            .when(F.size(F.array_distinct(places)) < F.size(places), fail("sparsevec indices must not contain duplicates"))
            .when(F.size(pairs) > MOST_NONZERO, fail("sparsevec cannot have more than ", str(MOST_NONZERO), " non-zero elements"))
            .otherwise(made(n, pairs))
        )

    out = let(s, read)
    return out if dim is None else assert_dim(out, dim)


def to_text(s: Column) -> Column:
    return let(s, shown)


def shown(s: Column) -> Column:
    items = F.zip_with(s["indices"], s["values"], lambda i, x: F.concat((i + 1).cast("string"), F.lit(":"), dense.number_to_text(x)))
    return F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}/"), s["dim"].cast("string"))


def assert_dim(s: Column, dim: int) -> Column:
    return let(s, lambda r: F.when(r.isNull(), None).when(r["dim"] == dim, r).otherwise(fail("expected ", str(dim), " dimensions, not ", r["dim"])))


def merged(a: Column, b: Column, fn: Callable[[Column, Column], Column]) -> Column:
    """Sum of fn over all indices that either has; absent values are 0."""
    zero = F.lit(0.0)
    both = F.map_zip_with(F.map_from_arrays(a["indices"], a["values"]), F.map_from_arrays(b["indices"], b["values"]), lambda _, x, y: fn(F.coalesce(d(x), zero), F.coalesce(d(y), zero)))
    same = total(F.map_values(both))
    return F.when(a.isNull() | b.isNull(), None).when(a["dim"] == b["dim"], same).otherwise(fail("different sparsevec dimensions ", a["dim"], " and ", b["dim"]))


def l2_squared_distance(a: Column, b: Column) -> Column:
    return merged(a, b, lambda x, y: (x - y) * (x - y))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared_distance(a, b))


def inner_product(a: Column, b: Column) -> Column:
    return merged(a, b, lambda x, y: x * y)


def negative_inner_product(a: Column, b: Column) -> Column:
    return -inner_product(a, b)


def l1_distance(a: Column, b: Column) -> Column:
    return merged(a, b, lambda x, y: F.abs(x - y))


def cosine_distance(a: Column, b: Column) -> Column:
    return dense.cosine_of(inner_product(a, b), dense.square(a["values"]), dense.square(b["values"]))


def l2_norm(s: Column) -> Column:
    return dense.vector_norm(s["values"])


def l2_normalize(s: Column) -> Column:
    """s over its norm, without values that became 0; a zero vector stays."""

    def scaled(n: Column) -> Column:
        pairs = F.zip_with(s["indices"], s["values"], lambda i, x: F.struct(i.alias("i"), (d(x) / n).cast("float").alias("x")))
        return F.when(s.isNull(), None).when(n > 0, made(s["dim"], pairs)).otherwise(s)

    return let(l2_norm(s), scaled)


def sparsevec_cmp(a: Column, b: Column) -> Column:
    """-1, 0 or 1: by elements of which those not stored are 0, then by dimension."""
    return let(a, lambda x: let(b, lambda y: compared(x, y)))


def compared(a: Column, b: Column) -> Column:
    ai, av, bi, bv = a["indices"], a["values"], b["indices"], b["values"]
    n = F.least(F.size(ai), F.size(bi))

    def step(k: Column) -> Column:
        i, j, x, y = F.get(ai, k), F.get(bi, k), F.get(av, k), F.get(bv, k)
        return F.when(i < j, F.when(x < 0, -1).otherwise(1)).when(i > j, F.when(y < 0, 1).otherwise(-1)).when(x < y, -1).when(x > y, 1).otherwise(0)

    shared = F.when(n > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(0), lambda s, k: F.when(s != 0, s).otherwise(step(k)))).otherwise(0)
    more_b = (F.size(ai) < F.size(bi)) & (F.get(bi, n) < a["dim"])
    more_a = (F.size(ai) > F.size(bi)) & (F.get(ai, n) < b["dim"])
    rest = (
        F.when(more_b, F.when(F.get(bv, n) < 0, 1).otherwise(-1))
        .when(more_a, F.when(F.get(av, n) < 0, -1).otherwise(1))
        .when(a["dim"] < b["dim"], -1)
        .when(a["dim"] > b["dim"], 1)
        .otherwise(0)
    )
    return F.when(a.isNull() | b.isNull(), None).when(shared != 0, shared).otherwise(rest)


def sparsevec_lt(a: Column, b: Column) -> Column:
    return sparsevec_cmp(a, b) < 0


def sparsevec_le(a: Column, b: Column) -> Column:
    return sparsevec_cmp(a, b) <= 0


def sparsevec_eq(a: Column, b: Column) -> Column:
    return sparsevec_cmp(a, b) == 0


def sparsevec_ne(a: Column, b: Column) -> Column:
    return sparsevec_cmp(a, b) != 0


def sparsevec_ge(a: Column, b: Column) -> Column:
    return sparsevec_cmp(a, b) >= 0


def sparsevec_gt(a: Column, b: Column) -> Column:
    return sparsevec_cmp(a, b) > 0


def sort_key(s: Column) -> Column:
    """An array that orders as sparsevec_cmp() does: an element below zero comes before none, and the earlier the more so; one above zero after."""
    far = F.lit(float(1 << 40))
    items = F.zip_with(s["indices"], s["values"], lambda i, x: F.struct(F.when(x < 0, i - far).otherwise(far - i).alias("a"), d(x).alias("b")))
    return F.when(s.isNull(), None).otherwise(F.concat(items, F.array(F.struct(F.lit(0.0).alias("a"), s["dim"].cast("double").alias("b")))))
