"""The vector functions as SQL functions of a session; Catalyst inlines them into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

V = "ARRAY<FLOAT>"
SAME = "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN size(a) = size(b) THEN {} ELSE raise_error(concat('different vector dimensions ', size(a), ' and ', size(b))) END"
SUM = "aggregate(zip_with(a, b, (x, y) -> {}), 0D, (s, e) -> s + e)"
SQUARE = "aggregate({v}, 0D, (s, e) -> s + CAST(e AS DOUBLE) * CAST(e AS DOUBLE))"
X, Y = "CAST(x AS DOUBLE)", "CAST(y AS DOUBLE)"
IP = SUM.format(f"{X} * {Y}")
#: r, computed once, or an error if an element isn't finite.
FINITE = "transform(array({}), r -> CASE WHEN exists(r, e -> isnan(e) OR abs(e) = double('infinity')) THEN raise_error('value out of range: overflow') ELSE r END)[0]"
LOST = "CASE WHEN exists(zip_with(a, b, (x, y) -> x <> 0 AND y <> 0 AND {} = 0), l -> l) THEN raise_error('value out of range: underflow') ELSE {} END"
SIZED = "transform(array({}), r -> CASE WHEN size(r) > 16000 THEN raise_error('vector cannot have more than 16000 dimensions') WHEN size(r) < 1 THEN raise_error('vector must have at least 1 dimension') ELSE r END)[0]"
NORMS = f"({SQUARE.format(v='a')} * {SQUARE.format(v='b')})"

#: name: (parameters, result type, expression)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "l2_squared_distance": (f"a {V}, b {V}", "DOUBLE", SAME.format(SUM.format(f"({X} - {Y}) * ({X} - {Y})"))),
    "l2_distance": (f"a {V}, b {V}", "DOUBLE", f"sqrt({SAME.format(SUM.format(f'({X} - {Y}) * ({X} - {Y})'))})"),
    "inner_product": (f"a {V}, b {V}", "DOUBLE", SAME.format(IP)),
    "negative_inner_product": (f"a {V}, b {V}", "DOUBLE", f"-({SAME.format(IP)})"),
    "cosine_distance": (f"a {V}, b {V}", "DOUBLE", SAME.format(f"CASE WHEN {NORMS} > 0 THEN 1 - greatest(-1D, least(1D, {IP} / sqrt({NORMS}))) ELSE double('NaN') END")),
    "l1_distance": (f"a {V}, b {V}", "DOUBLE", SAME.format(SUM.format(f"abs({X} - {Y})"))),
    "spherical_distance": (f"a {V}, b {V}", "DOUBLE", SAME.format(f"acos(greatest(-1D, least(1D, {IP}))) / pi()")),
    "vector_dims": (f"a {V}", "INT", "size(a)"),
    "vector_norm": (f"a {V}", "DOUBLE", f"sqrt({SQUARE.format(v='a')})"),
    "l2_normalize": (f"a {V}", V, f"transform(array(sqrt({SQUARE.format(v='a')})), n -> CASE WHEN n > 0 THEN transform(a, x -> CAST({X} / n AS FLOAT)) ELSE a END)[0]"),
    "vector_add": (f"a {V}, b {V}", V, SAME.format(FINITE.format("zip_with(a, b, (x, y) -> CAST(x + y AS FLOAT))"))),
    "vector_sub": (f"a {V}, b {V}", V, SAME.format(FINITE.format("zip_with(a, b, (x, y) -> CAST(x - y AS FLOAT))"))),
    "vector_mul": (f"a {V}, b {V}", V, SAME.format(LOST.format("CAST(x * y AS FLOAT)", FINITE.format("zip_with(a, b, (x, y) -> CAST(x * y AS FLOAT))")))),
    "vector_concat": (f"a {V}, b {V}", V, SIZED.format("concat(a, b)")),
    "vector_cmp": (f"a {V}, b {V}", "INT", "CASE WHEN a < b THEN -1 WHEN a > b THEN 1 WHEN a = b THEN 0 END"),
}
for _name, _sign in (("lt", "<"), ("le", "<="), ("eq", "="), ("ne", "<>"), ("ge", ">="), ("gt", ">")):
    FUNCTIONS[f"vector_{_name}"] = FUNCTIONS[f"halfvec_{_name}"] = (f"a {V}, b {V}", "BOOLEAN", f"a {_sign} b")

BITS = "STRUCT<nbits: INT, words: ARRAY<BIGINT>>"
WORD = "shiftleft(aggregate(slice(a, k * 64 + 1, 64), 0L, (s, x) -> shiftleft(s, 1) | CASE WHEN x > 0 THEN 1L ELSE 0L END), 64 - size(slice(a, k * 64 + 1, 64)))"
LENGTHS = "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a.nbits = b.nbits THEN {} ELSE raise_error(concat('different bit lengths ', a.nbits, ' and ', b.nbits)) END"
ONES = "aggregate(zip_with(a.words, b.words, (x, y) -> x {} y), 0L, (s, w) -> s + bit_count(w))"
FUNCTIONS |= {
    "binary_quantize": (f"a {V}", BITS, f"CASE WHEN a IS NULL THEN NULL ELSE named_struct('nbits', size(a), 'words', CASE WHEN size(a) = 0 THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform(sequence(0, CAST(floor((size(a) - 1) / 64) AS INT)), k -> {WORD}) END) END"),
    "hamming_distance": (f"a {BITS}, b {BITS}", "DOUBLE", LENGTHS.format(f"CAST({ONES.format('^')} AS DOUBLE)")),
    "jaccard_distance": (f"a {BITS}, b {BITS}", "DOUBLE", LENGTHS.format(f"CASE WHEN {ONES.format('&')} = 0 THEN 1D ELSE 1 - {ONES.format('&')} / {ONES.format('|')} END")),
    "subvector": (f"a {V}, start INT, count INT", V, SIZED.format("slice(a, greatest(start, 1), CAST(greatest(0L, least(CAST(start AS BIGINT) + count, size(a) + 1L) - greatest(start, 1)) AS INT))")),
    "array_to_vector": ("a ARRAY<DOUBLE>", V, SIZED.format("CASE WHEN exists(a, x -> x IS NULL) THEN raise_error('array must not contain nulls') ELSE " + FINITE.format("transform(a, x -> CAST(x AS FLOAT))") + " END")),
    "vector_to_text": (f"a {V}", "STRING", "concat('[', array_join(transform(a, x -> regexp_replace(CAST(x AS STRING), '[.]0$', '')), ','), ']')"),
}

UNIT = "pow(2D, greatest(floor(log2(CASE WHEN abs({x}) > 0 THEN abs({x}) ELSE 1D END)), -14) - 10)"
HALF = f"CAST(CASE WHEN abs({{x}}) >= 65520D THEN sign({{x}}) * double('infinity') ELSE rint({{x}} / {UNIT}) * {UNIT} END AS FLOAT)"


def half(x: str) -> str:
    return HALF.format(x=f"({x})")


FUNCTIONS |= {
    "to_halfvec": (f"a {V}", V, FINITE.format(f"transform(a, x -> {half(X)})")),
    "halfvec_add": (f"a {V}, b {V}", V, SAME.format(FINITE.format(f"zip_with(a, b, (x, y) -> {half(f'{X} + {Y}')})"))),
    "halfvec_sub": (f"a {V}, b {V}", V, SAME.format(FINITE.format(f"zip_with(a, b, (x, y) -> {half(f'{X} - {Y}')})"))),
    "halfvec_mul": (f"a {V}, b {V}", V, SAME.format(LOST.format(half(f"{X} * {Y}"), FINITE.format(f"zip_with(a, b, (x, y) -> {half(f'{X} * {Y}')})")))),
    "halfvec_concat": FUNCTIONS["vector_concat"],
    "halfvec_cmp": FUNCTIONS["vector_cmp"],
}

S = "STRUCT<dim: INT, indices: ARRAY<INT>, values: ARRAY<FLOAT>>"
BOTH = "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a.dim = b.dim THEN {} ELSE raise_error(concat('different sparsevec dimensions ', a.dim, ' and ', b.dim)) END"
MERGED = "aggregate(map_values(map_zip_with(map_from_arrays(a.indices, a.values), map_from_arrays(b.indices, b.values), (k, p, q) -> transform(array(named_struct('x', coalesce(CAST(p AS DOUBLE), 0D), 'y', coalesce(CAST(q AS DOUBLE), 0D))), z -> {})[0])), 0D, (s, e) -> s + e)"
SPARSE_IP, SPARSE_NORMS = MERGED.format("z.x * z.y"), f"({SQUARE.format(v='a.values')} * {SQUARE.format(v='b.values')})"
FUNCTIONS |= {
    "sparsevec_inner_product": (f"a {S}, b {S}", "DOUBLE", BOTH.format(SPARSE_IP)),
    "sparsevec_l2_distance": (f"a {S}, b {S}", "DOUBLE", BOTH.format(f"sqrt({MERGED.format('(z.x - z.y) * (z.x - z.y)')})")),
    "sparsevec_l1_distance": (f"a {S}, b {S}", "DOUBLE", BOTH.format(MERGED.format("abs(z.x - z.y)"))),
    "sparsevec_cosine_distance": (f"a {S}, b {S}", "DOUBLE", BOTH.format(f"CASE WHEN {SPARSE_NORMS} > 0 THEN 1 - greatest(-1D, least(1D, {SPARSE_IP} / sqrt({SPARSE_NORMS}))) ELSE double('NaN') END")),
    "sparsevec_norm": (f"a {S}", "DOUBLE", f"sqrt({SQUARE.format(v='a.values')})"),
    "to_sparsevec": (f"a {V}", S, "CASE WHEN a IS NULL THEN NULL ELSE named_struct('dim', size(a), 'indices', filter(transform(a, (x, i) -> CASE WHEN x <> 0 THEN i END), i -> i IS NOT NULL), 'values', filter(a, x -> x <> 0)) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Define all of FUNCTIONS as temporary functions; their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
