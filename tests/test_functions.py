"""Scalar functions against literal results."""

import math
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nearfield.functions import bits, dense, half, sparse
from nearfield.functions import sql as sql_functions


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def vec(*x):
    return F.array(*[F.lit(float(v)).cast("float") for v in x])


def value(one, column):
    return one.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("fn", "a", "b", "expected"),
    [
        (dense.l2_distance, (0, 0), (3, 4), 5.0),
        (dense.l2_squared_distance, (0, 0), (3, 4), 25.0),
        (dense.inner_product, (1, 2), (3, 4), 11.0),
        (dense.negative_inner_product, (1, 2), (3, 4), -11.0),
        (dense.cosine_distance, (1, 2), (2, 4), 0.0),
        (dense.cosine_distance, (1, 1), (-1, -1), 2.0),
        (dense.l1_distance, (0, 0), (3, 4), 7.0),
        (dense.spherical_distance, (1, 0), (0, 1), 0.5),
    ],
)
def test_distances(one, fn, a, b, expected):
    assert value(one, fn(vec(*a), vec(*b))) == pytest.approx(expected)


def test_cosine_with_zero_vector_is_nan(one):
    assert math.isnan(value(one, dense.cosine_distance(vec(1, 2), vec(0, 0))))


def test_nulls_stay_null(one):
    none = F.lit(None).cast("array<float>")
    for fn in (dense.l2_distance, dense.cosine_distance, dense.vector_add, dense.vector_cmp, half.halfvec_add):
        assert value(one, fn(vec(1), none)) is None
    assert value(one, dense.l2_normalize(none)) is None
    assert value(one, bits.hamming_distance(bits.binary_quantize(none), bits.binary_quantize(vec(1)))) is None
    assert value(one, sparse.l2_distance(sparse.to_sparse(none), sparse.to_sparse(vec(1)))) is None
    assert value(one, dense.vector_from_text(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize("fn", [dense.l2_distance, dense.vector_add, dense.vector_mul, half.halfvec_sub])
def test_different_dimensions_raise(one, fn):
    with pytest.raises(PySparkException, match="different vector dimensions 2 and 1"):
        value(one, fn(vec(1, 2), vec(3)))


def test_arithmetic(one):
    a, b = vec(1, 2, 3), vec(4, 5, 6)
    assert value(one, dense.vector_add(a, b)) == [5, 7, 9]
    assert value(one, dense.vector_sub(a, b)) == [-3, -3, -3]
    assert value(one, dense.vector_mul(a, b)) == [4, 10, 18]
    assert value(one, dense.vector_concat(a, b)) == [1, 2, 3, 4, 5, 6]
    for fn, x, y, message in ((dense.vector_add, 3e38, 3e38, "overflow"), (dense.vector_mul, 1e-37, 1e-37, "underflow"), (dense.vector_mul, 1e37, 1e37, "overflow")):
        with pytest.raises(PySparkException, match=message):
            value(one, fn(vec(x), vec(y)))


@pytest.mark.parametrize(
    ("start", "count", "expected"), [(1, 3, [1, 2, 3]), (3, 2, [3, 4]), (-1, 3, [1]), (3, 9, [3, 4, 5]), (-2147483644, 2147483647, [1, 2]), (1, 0, None), (3, -1, None), (6, 1, None)]
)
def test_subvector(one, start, count, expected):
    column = dense.subvector(vec(1, 2, 3, 4, 5), start, count)
    if expected is None:
        with pytest.raises(PySparkException, match="at least 1 dimension"):
            value(one, column)
    else:
        assert value(one, column) == expected


def test_norm_and_normalize(one):
    assert value(one, dense.vector_norm(vec(3, 4))) == 5
    assert value(one, dense.l2_normalize(vec(3, 4))) == pytest.approx([0.6, 0.8])
    assert value(one, dense.l2_normalize(vec(0, 0))) == [0, 0]
    assert value(one, dense.vector_dims(vec(1, 2, 3))) == 3


def test_comparison_goes_by_elements_then_dimension(one):
    for a, b, cmp in (((1, 2, 3), (1, 2, 3), 0), ((1, 2, 3), (1, 2), 1), ((1, 2), (1, 2, 3), -1), ((1, 2), (2, 3, 4), -1), ((2, 3), (1, 2, 3), 1)):
        assert value(one, dense.vector_cmp(vec(*a), vec(*b))) == cmp
        assert value(one, dense.vector_lt(vec(*a), vec(*b))) == (cmp < 0)
        assert value(one, dense.vector_ge(vec(*a), vec(*b))) == (cmp >= 0)


@pytest.mark.parametrize("text", ["[1,2,3]", " [ 1, 2.5 ,-3e2 ] ", "[.5]", "[1.]"])
def test_text_round_trip(one, text):
    got = value(one, dense.vector_from_text(F.lit(text)))
    assert got == [float(x) for x in text.strip().strip("[]").split(",")]
    assert value(one, dense.vector_from_text(dense.vector_to_text(dense.vector_from_text(F.lit(text))))) == got


def test_text_form(one):
    assert value(one, dense.vector_to_text(vec(1, 2.5, -3))) == "[1,2.5,-3]"


@pytest.mark.parametrize(("text", "message"), [("[hello]", "invalid input"), ("[1,2", "invalid input"), ("1,2", "invalid input"), ("[1,,2]", "invalid input"), ("[]", "at least 1"), ("[4e38]", "out of range"), ("[1]x", "invalid input")])
def test_bad_text(one, text, message):
    with pytest.raises(PySparkException, match=message):
        value(one, dense.vector_from_text(F.lit(text)))


def test_casts(one):
    assert value(one, dense.array_to_vector(F.array(F.lit(1), F.lit(2)))) == [1, 2]
    assert value(one, dense.array_to_vector(F.array(F.lit(1.5).cast("decimal(3,1)")), 1)) == [1.5]
    for column, message in ((F.array(F.lit(None).cast("int")), "nulls"), (F.array(F.lit(4e38)), "infinite"), (F.array(F.lit(float("nan"))), "infinite"), (F.array().cast("array<float>"), "at least 1")):
        with pytest.raises(PySparkException, match=message):
            value(one, dense.array_to_vector(column))
    with pytest.raises(PySparkException, match="expected 3 dimensions, not 2"):
        value(one, dense.array_to_vector(vec(1, 2), 3))


def test_half_rounds_to_nearest_even(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal(500), rng.standard_normal(200) * 1e-6, rng.uniform(-65000, 65000, 300), [0.0, 65519.9, 2048.5, 2049.5, 2.0**-24, 2.0**-25, 2.0**-14]]).astype(np.float32)
    got = spark.createDataFrame([([float(v) for v in x],)], "v array<float>").select(half.to_half(F.col("v"))).first()[0]
    assert np.array_equal(np.array(got, np.float32), x.astype(np.float16).astype(np.float32))


def test_half_range(one):
    with pytest.raises(PySparkException, match='"65520" is out of range for type halfvec'):
        value(one, half.to_half(vec(65520)))
    with pytest.raises(PySparkException, match="overflow"):
        value(one, half.halfvec_add(vec(60000), vec(60000)))
    with pytest.raises(PySparkException, match="underflow"):
        value(one, half.halfvec_mul(vec(1e-4), vec(1e-4)))


def test_bits(one):
    b = lambda s: bits.bits_from_text(F.lit(s))
    assert value(one, bits.hamming_distance(b("111"), b("110"))) == 1
    assert value(one, bits.jaccard_distance(b("1111"), b("1110"))) == 0.25
    assert value(one, bits.jaccard_distance(b("1100"), b("0011"))) == 1
    assert value(one, bits.jaccard_distance(b(""), b(""))) == 1
    long = "10" * 50 + "1"
    assert value(one, bits.bits_to_text(b(long))) == long
    assert value(one, bits.bits_to_text(bits.binary_quantize(vec(1, 0, -1, 0.5)))) == "1001"
    with pytest.raises(PySparkException, match="different bit lengths 3 and 2"):
        value(one, bits.hamming_distance(b("111"), b("11")))
    with pytest.raises(PySparkException, match="not a valid binary string"):
        value(one, bits.bits_to_text(b("12")))


def test_sparse_text_and_forms(one):
    s = lambda t: sparse.from_text(F.lit(t))
    assert value(one, sparse.to_text(s("{3:3.5, 1:1.5, 2:0}/5"))) == "{1:1.5,3:3.5}/5"
    assert value(one, sparse.to_dense(s("{1:1.5,3:3.5}/5"))) == [1.5, 0, 3.5, 0, 0]
    assert value(one, sparse.to_dense(s("{}/3"))) == [0, 0, 0]
    assert value(one, sparse.to_text(sparse.to_sparse(vec(0, 2, 0, 4)))) == "{2:2,4:4}/4"
    for text, message in (("{1:1,1:2}/3", "duplicates"), ("{4:1}/3", "out of bounds"), ("{0:1}/3", "out of bounds"), ("{1:1}/0", "at least 1"), ("{1:1", "invalid input"), ("{1:1}/2000000000", "more than")):
        with pytest.raises(PySparkException, match=message):
            value(one, s(text))


def test_sparse_distances(one):
    s = lambda t: sparse.from_text(F.lit(t))
    assert value(one, sparse.l2_distance(s("{1:0}/2"), s("{1:3,2:4}/2"))) == 5
    assert value(one, sparse.inner_product(s("{1:1,2:2}/2"), s("{1:2,2:4}/2"))) == 10
    assert value(one, sparse.l1_distance(s("{1:1}/3"), s("{3:2}/3"))) == 3
    assert value(one, sparse.cosine_distance(s("{1:1,2:2}/2"), s("{1:2,2:4}/2"))) == pytest.approx(0)
    assert math.isnan(value(one, sparse.cosine_distance(s("{1:1}/2"), s("{}/2"))))
    assert value(one, sparse.l2_norm(s("{1:3,2:4}/9"))) == 5
    assert value(one, sparse.to_text(sparse.l2_normalize(s("{1:3,4:4}/4")))) == "{1:0.6,4:0.8}/4"
    with pytest.raises(PySparkException, match="different sparsevec dimensions 2 and 3"):
        value(one, sparse.l2_distance(s("{}/2"), s("{}/3")))


def test_sparse_comparison_is_that_of_dense_forms(spark):
    import itertools

    rows = [list(map(float, x)) for n in (1, 2, 3) for x in itertools.product((-1, 0, 2), repeat=n)]
    df = spark.createDataFrame([(a, b) for a in rows for b in rows], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    wrong = df.where(sparse.sparsevec_cmp(sparse.to_sparse(a), sparse.to_sparse(b)) != dense.vector_cmp(a, b)).count()
    assert wrong == 0
    assert df.where(sparse.sparsevec_eq(sparse.to_sparse(a), sparse.to_sparse(b)) != (a == b)).count() == 0


def test_sql_functions_agree_with_columns(spark):
    names = sql_functions.register(spark)
    assert "l2_distance" in names
    spark.createDataFrame([([1.0, 2.0], [3.0, 5.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>").createOrReplaceTempView("v")
    other = {"array_to_vector": dense.array_to_vector, "to_halfvec": half.to_half, "to_sparsevec": sparse.to_sparse, "sparsevec_norm": sparse.l2_norm, "binary_quantize": bits.binary_quantize, "subvector": lambda v: dense.subvector(v, 1, 2)}
    rows = spark.table("v")
    for name in names:
        kinds = [x.split(None, 1)[1] for x in re.split(r", (?=[a-z]+ [A-Z])", sql_functions.FUNCTIONS[name][0])]
        fn = other.get(name) or next(getattr(m, n) for m, n in ((dense, name), (half, name), (bits, name), (sparse, name.removeprefix("sparsevec_"))) if hasattr(m, n))
        wrap = {"ARRAY<FLOAT>": "{}", "ARRAY<DOUBLE>": "CAST({} AS ARRAY<DOUBLE>)", sql_functions.BITS: "binary_quantize({})", sql_functions.S: "to_sparsevec({})"}
        given = ["1", "2"] if name == "subvector" else []
        own = [wrap[k].format(c) for k, c in zip(kinds, "ab", strict=False) if k in wrap]
        got = [r[0] for r in spark.sql(f"SELECT {name}({', '.join(own + given)}) FROM v").collect()]
        want = [r[0] for r in rows.select(fn(*[F.expr(x) for x in own])).collect()]
        assert repr(got) == repr(want), name

    for name, wide in (("vector_add", 3e38), ("vector_sub", -3e38), ("vector_mul", 1e30), ("halfvec_add", 60000.0)):
        with pytest.raises(Exception, match="overflow"):
            spark.sql(f"SELECT {name}(CAST(array({abs(wide)}D) AS ARRAY<FLOAT>), CAST(array({wide}D) AS ARRAY<FLOAT>))").collect()
    for name, tiny in (("vector_mul", 1e-30), ("halfvec_mul", 1e-4)):
        with pytest.raises(Exception, match="underflow"):
            spark.sql(f"SELECT {name}(CAST(array({tiny}D) AS ARRAY<FLOAT>), CAST(array({tiny}D) AS ARRAY<FLOAT>))").collect()
    for text in ("vector_concat(CAST(array() AS ARRAY<FLOAT>), CAST(array() AS ARRAY<FLOAT>))", "subvector(CAST(array(1D) AS ARRAY<FLOAT>), 3, 1)"):
        with pytest.raises(Exception, match="at least 1 dimension"):
            spark.sql(f"SELECT {text}").collect()


@pytest.mark.parametrize("fn", [dense.vector_from_text, half.halfvec_from_text, sparse.from_text, lambda s: sparse.to_text(sparse.from_text(s)), lambda s: sparse.to_dense(sparse.from_text(s))])
def test_a_text_is_made_once(spark, fn):
    plan = spark.range(1).select(fn(F.initcap(F.col("id").cast("string"))).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("initcap") == 1
