"""Named queries of all types' functions, of index upkeep and of approximate search, with equivalent SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import bits, dense, half, sparse
from nearfield.functions import sql as sql_functions
from nearfield.operators import aggregates, bm25, knn, metrics
from nearfield.operators.bm25 import Bm25Index
from nearfield.operators.graph import GraphIndex
from nearfield.operators.hybrid import HybridQuery, hybrid_distance, hybrid_search, hybrid_search_many
from nearfield.operators.ivf import IvfIndex
from nearfield.operators.quantized import QuantizedIndex, psquare_estimate
from nearfield.operators.ranking import placed
from nearfield.plans.catalog import (
    ANY, BITS, DIFFERENT, HALF, LISTS, ORACLE_SQL, PAIRS, POSTINGS, RRF, SCALED, SHARED, SPARSE, all_queries, bm25_sql, first_vector, hybrid_docs, hybrid_index, lexical, lists, once, pairs, quantized_bits, query, rounded, scaled, search_sql, shown, sql_distance, table, thinned, top,
)
from nearfield.session import durable, shared_folder, spread
from nearfield.sources import trec
from nearfield.streaming.ingest import into_bm25


def half_sql(x: str) -> str:
    """x rounded to the nearest half, ties to even."""
    unit = f"power(2.0, greatest(floor(log2(CASE WHEN abs({x}) > 0 THEN abs(({x})::DOUBLE) ELSE 1 END)), -14) - 10)"
    return f"(round_even(({x})::DOUBLE / {unit}, 0) * {unit})"


HALF_PAIRS = f"{HALF}, hp AS (SELECT s.vec_id, s.v AS a, t.v AS b FROM h s JOIN h t ON t.vec_id = s.vec_id + 1)"
def both() -> tuple[Column, Column]:
    return F.col("a"), F.col("b")


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled(spark, sf_dir).withColumn("embedding", half.to_half(F.col("embedding")))


def show(x: Column, digits: int = 5) -> Column:
    """A rounded double, without a sign of zero."""
    return F.round(x.cast("double"), digits) + 0.0


@query(
    f"""WITH {HALF_PAIRS} SELECT vec_id, round({sql_distance("l2_squared", "a", "b")}, 5) AS l2_squared, round({sql_distance("l2", "a", "b")}, 6) AS l2, round(-{sql_distance("ip", "a", "b")}, 6) + 0.0 AS inner_product, round({sql_distance("ip", "a", "b")}, 6) + 0.0 AS negative_inner_product,
round({sql_distance("cosine", "a", "b")}, 6) + 0.0 AS cosine, round({sql_distance("l1", "a", "b")}, 5) AS l1, len(a)::BIGINT AS dims, round(sqrt(list_inner_product(a, a)), 6) AS norm FROM hp"""
)
def half_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = both()
    return pairs(halves(spark, sf_dir)).select(
        "vec_id",
        show(half.l2_squared_distance(a, b)).alias("l2_squared"),
        show(half.l2_distance(a, b), 6).alias("l2"),
        show(half.inner_product(a, b), 6).alias("inner_product"),
        show(half.negative_inner_product(a, b), 6).alias("negative_inner_product"),
        show(half.cosine_distance(a, b), 6).alias("cosine"),
        show(half.l1_distance(a, b)).alias("l1"),
        half.vector_dims(a).cast("bigint").alias("dims"),
        show(half.l2_norm(a), 6).alias("norm"),
    )


UNIT_HALF = f"u AS (SELECT vec_id, [{half_sql('x')} FOR x IN embedding] AS v FROM embeddings)"


@query(f"WITH {UNIT_HALF} SELECT s.vec_id, round(acos(greatest(-1, least(1, list_inner_product(s.v, t.v)))) / pi(), 6) AS distance FROM u s JOIN u t ON t.vec_id = s.vec_id + 1")
def half_spherical(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = both()
    e = table(spark, sf_dir, "embeddings").withColumn("embedding", half.to_half(F.col("embedding")))
    return pairs(e).select("vec_id", F.round(half.spherical_distance(a, b), 6).alias("distance"))


@query(
    f"""WITH {HALF_PAIRS}, far AS (SELECT vec_id, [CASE WHEN abs(x) < 0.01 THEN 0.5 ELSE x END FOR x IN a] AS a, [CASE WHEN abs(x) < 0.01 THEN 0.5 ELSE x END FOR x IN b] AS b FROM hp)
SELECT vec_id, z.i AS pos, {half_sql("z.x + z.y")} + 0.0 AS added, {half_sql("z.x - z.y")} + 0.0 AS subtracted, {half_sql("z.x * z.y")} + 0.0 AS multiplied
FROM (SELECT vec_id, unnest([{{'i': i - 1, 'x': a[i]::DOUBLE, 'y': b[i]::DOUBLE}} FOR i IN range(1, len(a) + 1)]) AS z FROM far)"""
)
def half_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = both()
    far = lambda v: F.transform(v, lambda x: F.when(F.abs(x) < 0.01, F.lit(0.5).cast("float")).otherwise(x))
    p = pairs(halves(spark, sf_dir)).select("vec_id", far(a).alias("a"), far(b).alias("b"))
    z = p.select("vec_id", F.posexplode(F.arrays_zip(half.halfvec_add(a, b).alias("p"), half.halfvec_sub(a, b).alias("m"), half.halfvec_mul(a, b).alias("t"))).alias("pos", "z"))
    plain = lambda c: F.col(f"z.{c}").cast("double") + 0.0
    return z.select("vec_id", F.col("pos").cast("bigint").alias("pos"), plain("p").alias("added"), plain("m").alias("subtracted"), plain("t").alias("multiplied"))


@query(
    f"""WITH {HALF_PAIRS} SELECT vec_id, len(a || b)::BIGINT AS concat_dims, (a || b)[65] + 0.0 AS concat_65, len(a[3:12])::BIGINT AS sub_dims, a[3] + 0.0 AS sub_first, {half_sql("a[1] / sqrt(list_inner_product(a, a))")} + 0.0 AS unit_first,
array_to_string([CASE WHEN x > 0 THEN 1 ELSE 0 END FOR x IN a], '') AS bits, a[64] + 0.0 AS last FROM hp"""
)
def half_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = both()
    joined, part = half.halfvec_concat(a, b), half.subvector(a, 3, 10)
    wide = half.halfvec_to_vector(half.from_binary(half.to_binary(a)))
    first = lambda v, k=0: v[k].cast("double") + 0.0
    return pairs(halves(spark, sf_dir)).select(
        "vec_id", F.size(joined).cast("bigint").alias("concat_dims"), first(joined, 64).alias("concat_65"), F.size(part).cast("bigint").alias("sub_dims"), first(part).alias("sub_first"),
        first(half.l2_normalize(a)).alias("unit_first"), bits.bits_to_text(half.binary_quantize(a)).alias("bits"), first(half.halfvec_to_array(wide), 63).alias("last"),
    )


@query(f"WITH {HALF_PAIRS} SELECT vec_id, a < b AS lt, a <= b AS le, a = b AS eq, a <> b AS ne, a >= b AS ge, a > b AS gt, CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS cmp FROM hp")
def half_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = both()
    ops = {"lt": half.halfvec_lt, "le": half.halfvec_le, "eq": half.halfvec_eq, "ne": half.halfvec_ne, "ge": half.halfvec_ge, "gt": half.halfvec_gt, "cmp": half.halfvec_cmp}
    return pairs(halves(spark, sf_dir)).select("vec_id", *[f(a, b).alias(n) for n, f in ops.items()])


@query(f"WITH {HALF} SELECT vec_id, row_number() OVER (ORDER BY v, vec_id) AS place FROM h")
def half_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(halves(spark, sf_dir), [F.col("embedding"), F.col("vec_id")]).select("vec_id", "place")


for _how, _fn in (("avg", aggregates.vector_avg), ("sum", aggregates.vector_sum)):

    def _half_aggregate(spark: SparkSession, sf_dir: str, fn: Callable = _fn) -> DataFrame:
        eighths = F.transform("embedding", lambda x: F.round(x * 8) / 8)
        e = scaled(spark, sf_dir).withColumn("embedding", half.to_half(eighths))
        parts = fn(e, "embedding", ["label"], "v", half_precision=True).select("label", F.posexplode("v").alias("pos", "x"))
        return parts.select("label", F.col("pos").cast("bigint").alias("pos"), (F.col("x").cast("double") + 0.0).alias("x"))

    query(
        f"""WITH {SCALED}, part AS (SELECT label, vec_id, unnest(v)::DOUBLE AS x, unnest(range(len(v))) AS pos FROM scaled JOIN embeddings USING (vec_id)),
m AS (SELECT label, pos, {_how}(round((x * 8)::FLOAT) / 8) AS x FROM part GROUP BY label, pos) SELECT label, pos, {half_sql("x")} + 0.0 AS x FROM m""".replace("embeddings USING (vec_id)", "(SELECT vec_id FROM embeddings) USING (vec_id)"),
        f"half_{_how}",
    )(_half_aggregate)

NUMBERS = "[o_orderkey % 100, o_custkey % 8, -(o_orderkey % 3)]"


@query(
    f"""SELECT o_orderkey, '[' || (o_orderkey % 100) || ',' || (o_custkey % 8) / 8 || ',' || -(o_orderkey % 3) || ']' AS dense, '{{' || array_to_string(list_filter([CASE WHEN o_orderkey % 100 <> 0 THEN '1:' || (o_orderkey % 100) END, CASE WHEN o_custkey % 8 <> 0 THEN '2:' || (o_custkey % 8) / 8 END,
CASE WHEN o_orderkey % 3 <> 0 THEN '3:' || -(o_orderkey % 3) END], lambda x: x IS NOT NULL), ',') || '}}/3' AS sparse, (o_orderkey % 100) + (o_custkey % 8) / 8 - (o_orderkey % 3) + 0.0::DOUBLE AS total FROM orders""".replace("(o_custkey % 8) / 8 || ','", "regexp_replace(((o_custkey % 8) / 8)::VARCHAR, '[.]0$', '') || ','").replace("'2:' || (o_custkey % 8) / 8", "'2:' || regexp_replace(((o_custkey % 8) / 8)::VARCHAR, '[.]0$', '')")
)
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select("o_orderkey", dense.array_to_vector(F.array(k % 100, (c % 8) / 8, -(k % 3))).alias("v"))
    o = o.select("o_orderkey", "v", dense.vector_to_text(F.col("v")).alias("dense"), half.halfvec_to_text(half.to_half(F.col("v"))).alias("half"), sparse.to_text(sparse.to_sparse(F.col("v"))).alias("sparse"))
    read = [dense.vector_from_text(F.col("dense"), 3), half.halfvec_from_text(F.col("half"), 3), sparse.to_dense(sparse.from_text(F.col("sparse"), 3))]
    total = sum((dense.total(F.transform(x, dense.d)) for x in read[1:]), dense.total(F.transform(read[0], dense.d))) / 3
    return o.select("o_orderkey", "dense", "sparse", show(total, 6).alias("total"))


@query(
    f"""WITH o AS (SELECT o_orderkey, {NUMBERS} AS n, o_totalprice AS price FROM orders) SELECT o_orderkey, n[1]::DOUBLE AS from_int, n[2]::DOUBLE / 4 AS from_real, round((price / 1000)::FLOAT::DOUBLE, 4) AS from_double, (n[1]::DOUBLE + n[2] / 100.0)::DECIMAL(9, 2)::FLOAT::DOUBLE AS from_decimal,
n[1]::DOUBLE AS half_int, n[2]::DOUBLE / 4 AS half_real, {half_sql("price / 100000")} AS half_double, {half_sql("(n[1]::DOUBLE + n[2] / 100.0)::DECIMAL(9, 2)")} AS half_decimal,
len(list_filter(n, lambda x: x <> 0))::BIGINT AS sparse_int, len(list_filter(n, lambda x: x <> 0))::BIGINT AS sparse_real, len(list_filter(n, lambda x: x <> 0))::BIGINT AS sparse_double, len(list_filter(n, lambda x: x <> 0))::BIGINT AS sparse_decimal, (n[1] + n[2] + n[3])::DOUBLE AS back FROM o"""
)
def every_array_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    n = F.array((k % 100).cast("int"), (c % 8).cast("int"), -(k % 3).cast("int"))
    quarter, cents = F.transform(n, lambda x: (x / 4).cast("float")), F.array(((k % 100) + (c % 8) / 100).cast("decimal(9,2)"), F.lit(1).cast("decimal(9,2)"))
    first = lambda v, at=0: v[at].cast("double") + 0.0
    nonzero = lambda v: F.size(sparse.to_sparse(v)["indices"]).cast("bigint")
    o = table(spark, sf_dir, "orders").withColumn("n", n)
    for step in (sparse.to_sparse, lambda v: sparse.assert_dim(v, 3), sparse.to_half, sparse.to_sparse, sparse.to_dense, lambda v: dense.assert_dims(v, 3)):  # there and back
        o = durable(o.withColumn("n", step(F.col("n"))), "cast")
    return o.select(
        "o_orderkey", first(dense.array_to_vector(n, 3)).alias("from_int"), first(dense.array_to_vector(quarter), 1).alias("from_real"), show(dense.array_to_vector(F.array(price / 1000))[0], 4).alias("from_double"), first(dense.array_to_vector(cents)).alias("from_decimal"),
        first(half.array_to_halfvec(n, 3)).alias("half_int"), first(half.array_to_halfvec(quarter), 1).alias("half_real"), first(half.array_to_halfvec(F.array(price / 100000))).alias("half_double"), first(half.array_to_halfvec(cents)).alias("half_decimal"),
        nonzero(n).alias("sparse_int"), nonzero(quarter).alias("sparse_real"), nonzero(n.cast("array<double>")).alias("sparse_double"), nonzero(n.cast("array<decimal(9,2)>")).alias("sparse_decimal"),
        dense.total(F.transform(dense.vector_to_array(F.col("n")), dense.d)).alias("back"),
    )


@query(f"WITH {SPARSE} SELECT vec_id, a < b AS lt, a <= b AS le, a = b AS eq, a <> b AS ne, a >= b AS ge, a > b AS gt, round({sql_distance('l2_squared', 'a', 'b')}, 5) AS l2_squared FROM sp")
def sparse_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = both()
    ops = {"lt": sparse.sparsevec_lt, "le": sparse.sparsevec_le, "eq": sparse.sparsevec_eq, "ne": sparse.sparsevec_ne, "ge": sparse.sparsevec_ge, "gt": sparse.sparsevec_gt}
    return pairs(thinned(spark, sf_dir)).select("vec_id", *[f(a, b).alias(n) for n, f in ops.items()], show(sparse.l2_squared_distance(a, b)).alias("l2_squared"))


@query("WITH s AS (SELECT vec_id, [CASE WHEN abs(x) > 0.15 THEN x ELSE 0 END FOR x IN embedding] AS v FROM embeddings) SELECT vec_id, row_number() OVER (ORDER BY v, vec_id) AS place FROM s")
def sparse_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = thinned(spark, sf_dir).select("vec_id", sparse.sort_key(F.col("embedding")).alias("key"))
    return placed(keyed, [F.col("key"), F.col("vec_id")]).select("vec_id", "place")


@query(
    """WITH s AS (SELECT vec_id, [CASE WHEN abs(x) > 0.15 THEN x ELSE 0 END FOR x IN embedding] AS v FROM embeddings)
SELECT vec_id, z.i AS pos, round((z.x / z.n)::FLOAT::DOUBLE, 4) + 0.0 AS x FROM (SELECT vec_id, unnest([{'i': i - 1, 'x': v[i]::DOUBLE, 'n': sqrt(list_inner_product(v::DOUBLE[], v::DOUBLE[]))} FOR i IN range(1, len(v) + 1)]) AS z FROM s) WHERE z.n > 0"""
)
def sparse_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = thinned(spark, sf_dir).where(F.size("embedding.indices") > 0)
    z = some.select("vec_id", F.posexplode(sparse.to_dense(sparse.l2_normalize(F.col("embedding")))).alias("pos", "x"))
    return z.select("vec_id", F.col("pos").cast("bigint").alias("pos"), show(F.col("x"), 4).alias("x"))


def sparse_first(spark: SparkSession, sf_dir: str) -> dict[int, float]:
    r = thinned(spark, sf_dir).where("vec_id = 0").first()["embedding"]
    return dict(zip(r["indices"], r["values"], strict=True))


def sparse_top(metric: str, k: int = 10) -> str:
    d = sql_distance(metric, "v", "q")
    return f"""WITH s AS (SELECT vec_id, [CASE WHEN abs(x) > 0.15 THEN x ELSE 0 END FOR x IN embedding] AS v FROM embeddings), q AS (SELECT v AS q FROM s WHERE vec_id = 0)
SELECT vec_id, round({d}, 6) + 0.0 AS distance FROM s, q WHERE list_inner_product(v::DOUBLE[], v::DOUBLE[]) > 0 ORDER BY round({d}, 9), vec_id LIMIT {k}"""


for _metric in ("l2", "ip", "cosine", "l1"):
    _d = sql_distance(_metric, "b.v", "a.v")

    def _sparse_join(spark: SparkSession, sf_dir: str, metric: str = _metric) -> DataFrame:
        s = thinned(spark, sf_dir).where(F.size("embedding.indices") > 0)
        found = knn.sparse_knn_join(s.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), s, 5, metric)
        return found.select("query_id", "vec_id", show(F.col("distance")).alias("distance"))

    query(
        f"""WITH s AS (SELECT * FROM (SELECT vec_id, [CASE WHEN abs(x) > 0.15 THEN x ELSE 0 END FOR x IN embedding] AS v FROM embeddings) WHERE list_inner_product(v::DOUBLE[], v::DOUBLE[]) > 0), p AS (SELECT a.vec_id AS query_id, b.vec_id, round({_d}, 9) AS d FROM s a, s b)
SELECT query_id, vec_id, round(d, 5) + 0.0 AS distance FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) <= 5""",
        f"sparse_knn_join_{_metric}",
    )(_sparse_join)

    def _sparse_graph(spark: SparkSession, sf_dir: str, metric: str = _metric) -> DataFrame:
        s = thinned(spark, sf_dir).where(F.size("embedding.indices") > 0)
        found = GraphIndex.build(s, metric, shard_rows=1000).search(sparse_first(spark, sf_dir), 10, 300)
        return found.select("vec_id", show(F.col("distance"), 6).alias("distance"))

    query(sparse_top(_metric), f"graph_sparse_{_metric}")(_sparse_graph)

    def _graph(spark: SparkSession, sf_dir: str, metric: str = _metric) -> DataFrame:
        e = scaled(spark, sf_dir)
        index = GraphIndex.build(e.where("vec_id % 4 > 0"), metric, shard_rows=1000).append(e.where("vec_id % 4 = 0"))
        return index.search(first_vector(e), 10, 300).select("vec_id", show(F.col("distance"), 6).alias("distance"))

    query(top(_metric).replace(" AS distance", " + 0.0 AS distance"), f"graph_{_metric}")(_graph)

    _half_d = sql_distance(_metric, "v", "q")

    def _half_graph(spark: SparkSession, sf_dir: str, metric: str = _metric) -> DataFrame:
        e = halves(spark, sf_dir)
        return GraphIndex.build(e, metric, shard_rows=1000).search(first_vector(e), 10, 300).select("vec_id", show(F.col("distance"), 6).alias("distance"))

    query(f"WITH {HALF}, q AS (SELECT v AS q FROM h WHERE vec_id = 0) SELECT vec_id, round({_half_d}, 6) + 0.0 AS distance FROM h, q ORDER BY round({_half_d}, 9), vec_id LIMIT 10", f"graph_half_{_metric}")(_half_graph)

    def _codes(spark: SparkSession, sf_dir: str, metric: str = _metric) -> DataFrame:
        e = scaled(spark, sf_dir)
        index = QuantizedIndex.build(e, 64, 4, metric, corrected=metric in ("ip", "cosine"), renorm=metric != "l1").write(f"{shared_folder(spark)}/codes-{uuid.uuid4().hex}")
        return index.search(first_vector(e), 10, oversampling=5).select("vec_id", show(F.col("distance"), 6).alias("distance"))

    query(top(_metric).replace(" AS distance", " + 0.0 AS distance"), f"quantized_{_metric}")(_codes)

for _metric, _distance in (("hamming", f"{DIFFERENT}::DOUBLE"), ("jaccard", f"round(CASE WHEN {SHARED} = 0 THEN 1.0 ELSE 1 - {SHARED} / (list_sum(f) + list_sum(q) - {SHARED})::DOUBLE END, 6)::DOUBLE")):

    def _bit_graph(spark: SparkSession, sf_dir: str, metric: str = _metric) -> DataFrame:
        b = quantized_bits(spark, sf_dir)
        first = [float(x > 0) for x in first_vector(b)]
        return rounded(GraphIndex.build(b, metric, shard_rows=1000, vec_col="code").search(first, 10, 400))

    query(f"WITH {BITS} SELECT vec_id, {_distance} AS distance FROM b, q ORDER BY distance, vec_id LIMIT 10", f"graph_{_metric}")(_bit_graph)


@query(f"WITH {BITS} SELECT vec_id, {DIFFERENT}::DOUBLE AS distance FROM b, q ORDER BY distance, vec_id LIMIT 10")
def ivf_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = quantized_bits(spark, sf_dir)
    return rounded(IvfIndex.build(b, LISTS, "hamming", vec_col="code").search([float(x > 0) for x in first_vector(b)], 10, probes=LISTS))


for _metric in ("ip", "cosine"):

    def _ivf(spark: SparkSession, sf_dir: str, metric: str = _metric) -> DataFrame:
        e = scaled(spark, sf_dir)
        index = IvfIndex.build(e.where("vec_id % 5 > 0"), LISTS, metric).append(e.where("vec_id % 5 = 0"))
        return index.search(first_vector(e), 10, probes=LISTS).select("vec_id", show(F.col("distance"), 6).alias("distance"))

    query(top(_metric).replace(" AS distance", " + 0.0 AS distance"), f"ivf_{_metric}")(_ivf)


@query(f"WITH {HALF}, q AS (SELECT v AS q FROM h WHERE vec_id = 0) SELECT vec_id, round(list_distance(v, q), 6) AS distance FROM h, q ORDER BY round(list_distance(v, q), 9), vec_id LIMIT 10")
def ivf_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = halves(spark, sf_dir)
    return rounded(IvfIndex.build(e, LISTS).stored().search(first_vector(e), 10, probes=LISTS))


@query(top("l2", where="label = 3 AND vec_id % 7 <> 1"))
def ivf_iterative(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scaled(spark, sf_dir)
    index = lists(spark, sf_dir).delete(e.where("vec_id % 7 = 1"))
    return rounded(index.search(first_vector(e), 10, probes=8, where=F.col("label") == 3, iterative=True))


@query(top("l2", where="label = 3"))
def ivf_partial_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scaled(spark, sf_dir)
    return rounded(IvfIndex.build(e.where("label = 3"), 4).search(first_vector(e), 10, probes=4))


@query(
    f"WITH {SCALED}, p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_distance(b.v::DOUBLE[], a.v::DOUBLE[]), 9) AS d FROM scaled a, scaled b) SELECT query_id, vec_id, round(d, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p QUALIFY rank <= 5"
)
def ivf_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lists(spark, sf_dir).search_many(all_queries(scaled(spark, sf_dir)), 5, LISTS)
    return found.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query(top("cosine"))
def quantized_one_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scaled(spark, sf_dir)
    return rounded(QuantizedIndex.build(e, 64, 1, "cosine").search(first_vector(e), 10, oversampling=30))


@query(top("l2"))
def quantized_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scaled(spark, sf_dir)
    return rounded(QuantizedIndex.build(e, 64, 4, renorm=True).graph(shard_rows=1000).search(first_vector(e), 10, 200))


@query(top("l2", where="label = 3 AND vec_id % 6 <> 2"))
def quantized_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scaled(spark, sf_dir)
    index = QuantizedIndex.build(e.where("vec_id % 2 = 0"), 64, 4).append(e.where("vec_id % 2 = 1")).delete(e.where("vec_id % 6 = 2"))
    return rounded(index.search(first_vector(e), 10, oversampling=4, where=F.col("label") == 3))


@query("SELECT count(*) AS scanned, least(count(*), 80) AS candidates, least(count(*), 80) AS rescored, least(count(*), 10) AS found, 10 AS requested_k FROM embeddings WHERE label = 3")
def quantized_search_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scaled(spark, sf_dir)
    return QuantizedIndex.build(e, 64, 4).search_stats(first_vector(e), 10, 8, F.col("label") == 3)


@query(f"WITH {SCALED} SELECT vec_id, round(list_inner_product(v::DOUBLE[], v::DOUBLE[]), 3) AS score FROM scaled")
def quantized_self_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = QuantizedIndex.build(scaled(spark, sf_dir), 64, 4, "cosine", renorm=True).self_scores()
    return found.select(F.col("id").alias("vec_id"), F.round("score", 3).alias("score"))


@query(f"SELECT count(*) AS n, (SELECT count(*) FROM embeddings) AS n_graph, count(*) AS n_codes, count(*) * 64 * 2 / 8 AS code_bytes, {LISTS}::BIGINT AS n_lists FROM embeddings".replace("* 64 * 2 / 8", "* 16"))
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scaled(spark, sf_dir)
    own = lists(spark, sf_dir).stats().agg(F.sum("n").alias("n"), F.count("*").alias("n_lists"))
    graph = once(spark, sf_dir, "graph", lambda: GraphIndex.build(e, "l2", shard_rows=250)).stats().agg(F.sum("n_rows").alias("n_graph"))
    codes = QuantizedIndex.build(e, 64, 2).stats().select("n_codes", "code_bytes")
    return own.crossJoin(graph).crossJoin(codes)


@query("SELECT l_orderkey, list_sort(list(l_quantity))[round_even(0.5 * (count(*) - 1), 0)::INT + 1] AS median FROM lineitem GROUP BY l_orderkey HAVING count(*) < 5")
def psquare_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("x")).where(F.size("x") < 5)
    return few.select("l_orderkey", psquare_estimate(F.col("x"), 0.5).alias("median"))


SIGNS = "t AS (SELECT vec_id, [CASE WHEN embedding[1] > 0 THEN 1 ELSE -1 END, CASE WHEN embedding[2] > 0 THEN 1 ELSE -1 END] AS v FROM embeddings)"


@query(
    f"WITH {SIGNS}, p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_distance(b.v::DOUBLE[], a.v::DOUBLE[]), 9) AS d FROM t a, t b) SELECT query_id, vec_id, round(d, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p QUALIFY rank <= 7"
)
def knn_join_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = lambda k: F.when(F.col("embedding")[k] > 0, 1.0).otherwise(-1.0).cast("float")
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.array(sign(0), sign(1)).alias("embedding"))
    return knn.knn_join(all_queries(t), t, 7).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


UPSERTED = "(SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'license granted for document ' || doc_id ELSE text END AS text FROM documents UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 10 = 3)"


def upserted(spark: SparkSession, sf_dir: str) -> Bm25Index:
    """Every tenth document replaced."""
    old = table(spark, sf_dir, "documents").where("doc_id % 10 = 3")
    new = old.select("doc_id", F.concat(F.lit("license granted for document "), F.col("doc_id").cast("string")).alias("text"))
    return lexical(spark, sf_dir).upsert(Bm25Index.of(new))


@query(
    f"""WITH {bm25_sql(["license", "rights", "apache"], docs="(SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 1000000000 AS doc_id, 'license granted for document ' || doc_id AS text FROM documents WHERE doc_id % 10 = 3)", dead="doc_id < 1000000000 AND doc_id % 10 = 3")}
SELECT doc_id % 1000000000 AS doc_id, round(score, 6) AS score FROM lex ORDER BY lex.score DESC, doc_id % 1000000000 LIMIT 20"""
)
def bm25_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(upserted(spark, sf_dir).topk(ANY, 20))


@query(search_sql(["license", "rights", "apache"], docs="(SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'license granted for document ' || doc_id ELSE text END AS text FROM documents)"))
def bm25_vacuumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(upserted(spark, sf_dir).vacuum(10).topk(ANY, 20))


@query(search_sql(["rights", "reserved"], "list_contains(found, 'rights') AND list_contains(found, 'reserved')"))
def bm25_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(lexical(spark, sf_dir).topk(bm25.plain("Rights, reserved!"), 20))


@query(search_sql(["license", "rights", "reserved"], "list_contains(found, 'license') OR (list_contains(found, 'rights') AND list_contains(found, 'reserved'))"))
def bm25_websearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(lexical(spark, sf_dir).topk(bm25.websearch('"License" or rights reserved'), 20))


@query(search_sql(["license", "rights", "apache"]))
def bm25_any_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(lexical(spark, sf_dir).topk(bm25.any_of("License: rights (Apache)"), 20))


@query(search_sql(["license", "rights", "apache"]))
def bm25_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of documents that came as a stream."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    spread(docs.select("doc_id", "text")).write.parquet(f"{at}/source")
    files = -(-len(spark.read.parquet(f"{at}/source").inputFiles()) // 3)  # in three batches at most
    stream = spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", max(1, files)).parquet(f"{at}/source")
    into_bm25(stream, f"{at}/index", f"{at}/checkpoint").awaitTermination()
    return shown(Bm25Index.read(spark, f"{at}/index").topk(ANY, 20))


for _metric in ("l2", "ip"):
    _d = sql_distance("l2_squared" if _metric == "l2" else _metric, "v", "q")

    def _hybrid(spark: SparkSession, sf_dir: str, metric: str = _metric) -> DataFrame:
        q = HybridQuery(first_vector(scaled(spark, sf_dir), 7), "license | rights", dense_k=30, bm25_k=30)
        found = hybrid_search(hybrid_docs(spark, sf_dir), q, hybrid_index(spark, sf_dir), limit=20, metric=metric)
        return found.select("id", "dense_rank", "bm25_rank", F.round("score", 6).alias("score"))

    query(
        f"""WITH {SCALED}, corpus AS (SELECT d.doc_id, d.text, s.v FROM documents d JOIN scaled s ON s.vec_id = d.doc_id), qv AS (SELECT v AS q FROM scaled WHERE vec_id = 7), {bm25_sql(["license", "rights"], docs="corpus")},
dr AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round({_d}, 9), doc_id) AS dense_rank FROM corpus, qv QUALIFY dense_rank <= 30), br AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS bm25_rank FROM lex QUALIFY bm25_rank <= 30),
g AS (SELECT id, dense_rank, bm25_rank, round({RRF}, 9) AS score FROM dr FULL JOIN br USING (id)) SELECT id, dense_rank, bm25_rank, round(score, 6) AS score FROM g
ORDER BY g.score DESC, CASE WHEN dense_rank IS NOT NULL AND bm25_rank IS NOT NULL THEN 0 ELSE 1 END, coalesce(dense_rank, 2147483647), coalesce(bm25_rank, 2147483647), id LIMIT 20""",
        f"hybrid_{_metric}",
    )(_hybrid)


@query(f"WITH {SCALED}, qv AS (SELECT v AS q FROM scaled WHERE vec_id = 7) SELECT vec_id, round({sql_distance('cosine', 'v', 'q')}, 6) + 0.0 AS plain, round({sql_distance('l2', 'v', 'q')}, 6) + 0.0 AS l2, round({sql_distance('ip', 'v', 'q')}, 6) + 0.0 AS ip FROM scaled, qv")
def hybrid_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scaled(spark, sf_dir)
    q = HybridQuery(first_vector(e, 7))
    return e.select("vec_id", *[show(hybrid_distance(F.col("embedding"), q, m), 6).alias(n) for n, m in (("plain", "cosine"), ("l2", "l2"), ("ip", "ip"))])


def batch_sql(score: str, where: str = "true") -> str:
    own = ORACLE_SQL["hybrid_batch"]
    own = own.replace("AS dense_rank FROM dd", "AS dense_rank, -d AS dense_score FROM dd").replace("AS bm25_rank FROM hit", "AS bm25_rank, score AS bm25_score FROM hit")
    return own.replace(f"round({RRF}, 9) AS score FROM dr FULL JOIN br USING (query_id, id)", f"round({score}, 9) AS score FROM dr FULL JOIN br USING (query_id, id) WHERE {where}")


def scaled_in_query(c: str) -> str:
    low, high = f"min({c}) OVER (PARTITION BY query_id)", f"max({c}) OVER (PARTITION BY query_id)"
    return f"coalesce(CASE WHEN {c} IS NULL THEN 0 WHEN {high} > {low} THEN ({c} - {low}) / ({high} - {low}) WHEN {c} > 0 THEN 1 ELSE 0 END, 0)"


for _name, _options, _sql in (
    ("hybrid_batch_weighted", {"fusion": "weighted", "alpha": 0.3}, batch_sql(f"0.3::DOUBLE * {scaled_in_query('dense_score')} + 0.7::DOUBLE * {scaled_in_query('bm25_score')}")),
    ("hybrid_batch_required", {"require_bm25_match": True}, batch_sql(RRF, "bm25_rank IS NOT NULL")),
):

    def _batch(spark: SparkSession, sf_dir: str, options: dict = _options) -> DataFrame:
        items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), bm25.simple_tokens(F.col("text")).alias("terms"))
        vectors = scaled(spark, sf_dir).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
        found = hybrid_search_many(hybrid_docs(spark, sf_dir), items.join(vectors, "query_id"), 10, hybrid_index(spark, sf_dir), branch_k=50, **options)
        return found.withColumn("score", F.round("score", 6))

    query(_sql, _name)(_batch)


@query("SELECT o_custkey::VARCHAR AS qid, o_orderkey::VARCHAR AS docid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, round(o_totalprice, 2) AS score, (o_orderkey % 4)::INT AS rel FROM orders")
def trec_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking and judgements, written as text and read again."""
    from pyspark.sql import Window

    at = f"{shared_folder(spark)}/trec-{uuid.uuid4().hex}"
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("qid"), F.col("o_orderkey").cast("string").alias("docid"), rank.alias("rank"), F.round("o_totalprice", 2).alias("score"))
    trec.write_run(o, f"{at}/run")
    o.select(F.concat_ws(" ", "qid", F.lit("0"), "docid", (F.col("docid").cast("bigint") % 4).cast("string"))).write.text(f"{at}/qrels")
    run, qrels = trec.read_run(spark, f"{at}/run"), trec.read_qrels(spark, f"{at}/qrels")
    return run.join(qrels, ["qid", "docid"]).select("qid", "docid", F.col("rank").cast("bigint").alias("rank"), "score", "rel")


@query(f"WITH {SCALED} SELECT vec_id, round(list_sum([x::DOUBLE FOR x IN v]), 4) + 0.0 AS total, len(v)::BIGINT AS dims FROM scaled")
def vector_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    trec.write_vectors(scaled(spark, sf_dir).select("vec_id", "embedding"), at)
    back = trec.read_vectors(spark, at, 64)
    return back.select(F.col("vec_id").cast("bigint").alias("vec_id"), show(dense.total(F.transform("embedding", dense.d)), 4).alias("total"), F.size("embedding").cast("bigint").alias("dims"))


@query("SELECT quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.95) AS p95, quantile_cont(l_quantity, 0.99) AS p99, round(avg(l_quantity), 6) AS mean, round(1000 * count(*) / sum(l_quantity), 6) AS qps FROM lineitem")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.latency_summary(table(spark, sf_dir, "lineitem"), "l_quantity")
    return found.withColumns({"mean": F.round("mean", 6), "qps": F.round("qps", 6)})


@query(
    f"""WITH {PAIRS}, t AS (SELECT vec_id, [CASE WHEN abs(x) > 0.5 THEN x ELSE 0 END FOR x IN a] AS a, [CASE WHEN abs(x) > 0.5 THEN x ELSE 0 END FOR x IN b] AS b, a AS f, b AS g FROM pair)
SELECT vec_id, round({sql_distance("ip", "a", "b")}, 5) + 0.0 AS sparse_ip, round({sql_distance("l2", "a", "b")}, 5) + 0.0 AS sparse_l2, round({sql_distance("l1", "a", "b")}, 4) + 0.0 AS sparse_l1, list_sum([(z[1] > 0 AND z[2] <= 0 OR z[1] <= 0 AND z[2] > 0)::INT FOR z IN list_zip(f, g)])::DOUBLE AS hamming,
{half_sql("f[1]::DOUBLE")} + 0.0 AS half_first, round((f[1] + g[1])::FLOAT::DOUBLE, 5) + 0.0 AS added, round(f[5]::DOUBLE, 5) + 0.0 AS sub_first, f < g AS lt FROM t"""
)
def sql_surface_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql_functions.register(spark)
    pairs(scaled(spark, sf_dir)).createOrReplaceTempView("nearfield_type_pairs")
    return spark.sql(
        """WITH t AS (SELECT vec_id, to_sparsevec(transform(a, x -> CASE WHEN abs(x) > 0.5BD THEN x ELSE CAST(0 AS FLOAT) END)) AS s, to_sparsevec(transform(b, x -> CASE WHEN abs(x) > 0.5BD THEN x ELSE CAST(0 AS FLOAT) END)) AS t, a, b FROM nearfield_type_pairs)
SELECT vec_id, round(-sparsevec_inner_product(s, t), 5) + 0D AS sparse_ip, round(sparsevec_l2_distance(s, t), 5) + 0D AS sparse_l2, round(sparsevec_l1_distance(s, t), 4) + 0D AS sparse_l1, hamming_distance(binary_quantize(a), binary_quantize(b)) AS hamming,
CAST(to_halfvec(a)[0] AS DOUBLE) + 0D AS half_first, round(CAST(vector_add(a, b)[0] AS DOUBLE), 5) + 0D AS added, round(CAST(subvector(a, 5, 3)[0] AS DOUBLE), 5) + 0D AS sub_first, vector_lt(a, b) AS lt FROM t"""
    )


@query(
    """WITH a AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 0)
SELECT 'semi' AS kind, k FROM a WHERE k IN (SELECT k FROM b) UNION ALL SELECT 'anti', k FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT 'union', k FROM (SELECT k FROM a UNION SELECT k FROM b)
UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)"""
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    a, b = o.where("k % 2 = 0"), o.where("k % 3 = 0")
    parts = {"semi": a.join(b, "k", "left_semi"), "anti": a.join(b, "k", "left_anti"), "union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    named = [df.select(F.lit(n).alias("kind"), "k") for n, df in parts.items()]
    return named[0].union(named[1]).union(named[2]).union(named[3]).union(named[4])


@query(f"WITH {SCALED}, q AS (SELECT v AS q FROM scaled WHERE vec_id = 0), m AS MATERIALIZED (SELECT s.vec_id, e.label, round(list_distance(v::DOUBLE[], q::DOUBLE[]), 9) AS d FROM scaled s JOIN embeddings e ON e.vec_id = s.vec_id, q ORDER BY d, s.vec_id LIMIT 50) SELECT label, count(*) AS n, round(min(d), 6) AS least, (SELECT count(*) FROM m) AS total FROM m GROUP BY label")
def materialized_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that is written once and read twice."""
    e = scaled(spark, sf_dir)
    near = durable(knn.knn(e, first_vector(e), 50).select("label", "distance"), "near")
    return near.groupBy("label").agg(F.count("*").alias("n"), F.round(F.min("distance"), 6).alias("least")).crossJoin(near.agg(F.count("*").alias("total")))
