"""Search operators against brute force and golden rankings."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nearfield.operators import aggregates, knn, metrics
from nearfield.operators.bm25 import Bm25Index, any_of, parsed, phrase, plain, websearch
from nearfield.operators.english import stem
from nearfield.operators.graph import GraphIndex
from nearfield.operators.hybrid import HybridQuery, hybrid_distance, hybrid_search
from nearfield.operators.ivf import IvfIndex
from nearfield.operators.metrics import processor_features
from nearfield.operators.quantized import QuantizedIndex, psquare
from nearfield.sources import trec

SCHEMA = "vec_id bigint, label int, embedding array<float>"


@pytest.fixture(scope="module")
def data():
    return np.random.default_rng(5).standard_normal((600, 12)).astype(np.float32)


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame([(i, i % 7, [float(x) for x in v]) for i, v in enumerate(data)], SCHEMA).cache()


def brute(data, q, metric):
    d = knn.distances(data.astype(np.float64), np.asarray(q, np.float64), metric)
    return [int(i) for i in np.lexsort((np.arange(len(data)), np.round(d, 9)))]


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine", "l1"])
def test_join_breaks_ties_of_copies_by_id(spark, metric):
    v = [[0.1, 0.7, -0.3], [-0.5, 0.2, 0.9]]
    ids = [int(i) for i in np.random.default_rng(3).permutation(700)]
    df = spark.createDataFrame([(i, 0, v[i < 200]) for i in ids], SCHEMA).coalesce(1)
    queries = spark.createDataFrame([(1, v[0]), (2, [0.0, 0.0, 0.0])], "query_id bigint, query array<float>")
    found = knn.knn_join(queries, df, 5, metric).orderBy("query_id", "rank").collect()
    zero = range(5) if metric in ("ip", "cosine") else range(200, 205)
    assert [r.vec_id for r in found if r.query_id == 1] == [200, 201, 202, 203, 204]
    assert [r.vec_id for r in found if r.query_id == 2] == list(zero)


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine", "l1"])
def test_knn_and_join_match_brute_force(rows, data, metric):
    q = [float(x) for x in data[3]]
    assert [r.vec_id for r in knn.knn(rows, q, 10, metric).collect()] == brute(data, q, metric)[:10]
    queries = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for sent in (knn.SENT_BYTES, 20_000):
        found = knn.knn_join(queries, rows, 5, metric, sent_bytes=sent).collect()
        assert len(found) == 3000
        by = {}
        for r in sorted(found, key=lambda r: r["rank"]):
            by.setdefault(r.query_id, []).append(r.vec_id)
        for i in range(0, 600, 37):
            assert by[i] == brute(data, data[i], metric)[:5]


def test_knn_edges(spark):
    df = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 0, None), (3, 0, [1.0, 1.0]), (4, 0, [1.0, 1.0])], SCHEMA)
    got = knn.knn(df, [1.0, 1.0], 10).collect()
    assert [r.vec_id for r in got] == [3, 4, 1, 2] and got[3].distance is None
    assert [r.vec_id for r in knn.knn(df, [1.0, 1.0], 10, where=F.col("vec_id") > 3).collect()] == [4]
    assert {r.vec_id for r in knn.range_search(df, [1.0, 1.0], 0.5).collect()} == {3, 4}
    assert [r.vec_id for r in knn.knn_to_row(df, 3, 1).collect()] == [4]
    queries = spark.createDataFrame([(9, [1.0, 1.0]), (10, None)], "query_id bigint, query array<float>")
    assert [(r.query_id, r.vec_id) for r in knn.knn_join(queries, df, 2).orderBy("rank").collect()] == [(9, 3), (9, 4)]
    assert knn.knn_join(queries.limit(0), df, 2).count() == 0
    with pytest.raises(PySparkException, match="different vector dimensions"):
        knn.knn_join(queries, spark.createDataFrame([(1, 0, [1.0])], SCHEMA), 1).collect()


def test_aggregates(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (1, [3.0, 5.0, 7.0]), (1, None), (2, None)], "k int, v array<float>")
    assert {r.k: r.avg for r in aggregates.vector_avg(df, "v", ["k"]).collect()} == {1: [2.0, 3.5, 5.0], 2: None}
    assert aggregates.vector_sum(df, "v").first()[0] == [4, 7, 10]
    assert aggregates.vector_avg(df.limit(0), "v").first()[0] is None
    mixed = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<float>")
    with pytest.raises(PySparkException, match="expected 1 dimensions, not 2"):
        aggregates.vector_avg(mixed, "v").collect()
    big = spark.createDataFrame([([3e38],), ([3e38],)], "v array<float>")
    with pytest.raises(PySparkException, match="overflow"):
        aggregates.vector_sum(big, "v").collect()
    assert aggregates.vector_avg(big, "v").first()[0] == pytest.approx([3e38])
    with pytest.raises(PySparkException, match="overflow"):
        aggregates.vector_sum(spark.createDataFrame([([60000.0],), ([60000.0],)], "v array<float>"), "v", half_precision=True).collect()


def test_ivf(rows, data, spark, tmp_path):
    index = IvfIndex.build(rows, 8).write(str(tmp_path / "ivf"))
    q = [float(x) for x in data[9]]
    assert [r.vec_id for r in index.search(q, 10, probes=8).collect()] == brute(data, q, "l2")[:10]
    assert sum(r.n for r in index.stats().collect()) == 600
    assert "PartitionFilters" in index.search(q, 10, probes=2)._jdf.queryExecution().executedPlan().toString()
    few = index.search(q, 50, probes=1, where=F.col("label") == 2, iterative=True)
    assert few.count() == 50
    exact = knn.knn_join(rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), rows, 10)
    found = index.search_many(rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10, probes=4)
    assert metrics.recall_at_k(found, exact, 10).agg(F.avg("recall")).first()[0] > 0.7
    more = index.append(spark.createDataFrame([(1000, 0, q)], SCHEMA)).delete(spark.createDataFrame([(9,)], "vec_id bigint"))
    assert more.search(q, 1, probes=2).first().vec_id == 1000
    for metric in ("ip", "cosine"):
        other = IvfIndex.build(rows, 8, metric)
        assert [r.vec_id for r in other.search(q, 5, probes=8).collect()] == brute(data, q, metric)[:5]
    binary = rows.withColumn("embedding", F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(0.0).cast("float")))
    flags = (data > 0).astype(float)
    q = [float(x) for x in flags[4]]
    assert [r.vec_id for r in IvfIndex.build(binary, 4, "hamming").search(q, 5, probes=4).collect()] == brute(flags, q, "l1")[:5]


def test_places_in_a_total_order(spark):
    from nearfield.operators.ranking import placed

    df = spark.range(500).select((F.col("id") % 7).alias("k"), "id", F.lit("x").alias("other"))
    got = [(r.place, r.k, r.id) for r in placed(df, [F.col("k").desc(), F.col("id")]).orderBy("place").collect()]
    assert got == [(n + 1, k, i) for n, (k, i) in enumerate(sorted(((i % 7, i) for i in range(500)), key=lambda x: (-x[0], x[1])))]
    assert placed(df.limit(0), [F.col("id")]).count() == 0


def test_ivf_edges(spark):
    df = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 0, None), (3, 0, [1.0, 1.0])], SCHEMA)
    assert sum(r.n for r in IvfIndex.build(df, 5, "cosine").stats().collect()) == 1
    assert IvfIndex.build(df.limit(0), 3).rows.count() == 0
    with pytest.raises(ValueError, match="l1"):
        IvfIndex.build(df, 5, "l1")


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine", "l1"])
def test_quantized(rows, data, metric):
    q = [float(x) for x in data[11]]
    want = brute(data, q, metric)[:10]
    for bits, least in ((4, 9), (2, 7), (1, 5)):
        got = [r.vec_id for r in QuantizedIndex.build(rows, 12, bits, metric).search(q, 10, oversampling=6).collect()]
        assert len(set(got) & set(want)) >= least, bits
    index = QuantizedIndex.build(rows, 12, 4, metric)
    assert [r.vec_id for r in index.search(q, 10, oversampling=60).collect()] == want
    picked = [i for i in brute(data, q, metric) if i % 7 == 3][:5]
    assert [r.vec_id for r in index.search(q, 5, oversampling=20, where=F.col("label") == 3).collect()] == picked
    assert index.stats().first().n_codes == 600
    gone = index.delete(rows.where(F.col("vec_id") == want[0]))
    assert gone.search(q, 3, oversampling=60).first().vec_id == want[1]


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine", "l1"])
def test_graph_recall(rows, data, metric, tmp_path):
    index = GraphIndex.build(rows, metric, shard_rows=300).stored(str(tmp_path / "g"))
    queries = [(i, [float(x) for x in data[i]]) for i in range(0, 600, 40)]
    found = {}
    for r in index.search_many(queries, 10, 80).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len(found[i] & set(brute(data, data[i], metric)[:10])) for i, _ in queries)
    assert hit / (10 * len(queries)) >= 0.9


def test_graph_edges(spark, rows, data):
    q = [1.0, 1.0]
    df = spark.createDataFrame([(1, 0, q), (2, 0, None), (3, 0, q), (4, 0, [0.0, 0.0])], SCHEMA)
    index = GraphIndex.build(df)
    assert [r.vec_id for r in index.search(q, 2).collect()] == [1, 3]
    assert [r.vec_id for r in index.delete(df.where("vec_id = 1")).search(q, 1).collect()] == [3]
    with pytest.raises(ValueError, match="ef_construction"):
        GraphIndex.build(df, m=16, ef_construction=20)
    q = [float(x) for x in data[0]]
    got = GraphIndex.build(rows).search(q, 5, where=F.col("label") == 1)
    assert {r.label for r in got.collect()} == {1} and got.count() == 5


DOCS = [(0, [0.0, 0.0, 0.0], "orphan lexical"), (1, [1.0, 0.0, 0.0], "postgres vector search"), (2, [1.0, 1.0, 0.0], "hybrid search"), (3, [0.0, 1.0, 0.0], "lexical search")]
IR = [(1, [0.95, 0.05, 0.0], "alpha exact semantic"), (2, [0.0, 1.0, 0.0], "alpha exact lexical"), (3, [1.0, 0.0, 0.0], "semantic neighbor"), (4, [0.0, 0.0, 1.0], "unrelated branch")]


def corpus(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id bigint, embedding array<float>, text string")


def test_bm25_corpus_is_what_has_a_vector(spark):
    index = Bm25Index.of(corpus(spark), vec_col="embedding")
    s = index.corpus_stats().first()
    assert (s.doc_count, s.total_doc_len, s.unique_terms) == (3, 7, 5)
    assert index.topk("orphan", 5).count() == 0
    assert [r.doc_id for r in index.topk("search", 5).collect()] == [2, 3, 1]
    assert [r.doc_id for r in index.topk("lexical & search", 5).collect()] == [3]
    assert [r.doc_id for r in index.topk("(hybrid | postgres) & search", 5).collect()] == [2, 1]


def test_bm25_scores(spark):
    index = Bm25Index.of(corpus(spark), vec_col="embedding")
    got = index.topk("hybrid", 1).first().score
    idf = np.log(1 + (3 - 1 + 0.5) / 1.5)
    assert got == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / (7 / 3))), abs=1e-8)
    assert index.topk("hybrid", 1, quantized=True).first().score == pytest.approx(got, abs=1e-4)


def test_bm25_maintenance(spark, tmp_path):
    base = Bm25Index.of(corpus(spark), vec_col="embedding")
    both = base.append(Bm25Index.of(corpus(spark, [(4, [0.0, 0.0, 1.0], "new lexical document"), (5, [1.0, 1.0, 1.0], "")])))
    assert both.topk("new | lexical", 5).count() == 2
    assert both.corpus_stats().first().doc_count == 5
    dead = both.delete(spark.createDataFrame([(3,)], "doc_id bigint"))
    assert [r.doc_id for r in dead.topk("lexical", 5).collect()] == [4]
    assert dead.corpus_stats().first().doc_count == 5
    small = dead.compact()
    assert small.corpus_stats().first().doc_count == 4
    dead.write(str(tmp_path / "i"))
    assert [r.doc_id for r in Bm25Index.read(spark, str(tmp_path / "i")).topk("lexical", 5).collect()] == [4]


def test_bm25_upsert_and_vacuum(spark):
    new = lambda i, t: Bm25Index.of(corpus(spark, [(i, [1.0, 0.0, 0.0], t)]))
    index = Bm25Index.of(corpus(spark), vec_col="embedding")
    gone = index.delete(spark.createDataFrame([(1,)], "doc_id bigint"))
    assert [r.doc_id for r in gone.append(new(1, "gamma")).topk("gamma", 5).collect()] == [1]
    assert [r.doc_id for r in index.upsert(new(3, "delta")).topk("delta | lexical", 5).collect()] == [3]
    twice = index.upsert(new(3, "delta")).upsert(new(3, "omega"))
    assert twice.topk("delta", 5).count() == 0 and twice.topk("omega", 5).count() == 1
    assert twice.corpus_stats().first().doc_count == 5
    stored = twice.stored()
    assert stored.topk("omega", 5).count() == 1 and stored.corpus_stats().first().doc_count == 5
    small = stored.vacuum()
    assert small.corpus_stats().first().doc_count == 3 and small.topk("omega", 5).count() == 1 and small.generation == 0
    assert index.vacuum() is index


def test_plain_and_web_queries():
    assert plain("The quick, quick fox") == parsed("the & quick & fox")
    assert plain("licenses running", "english") == parsed("licens & run")
    assert websearch('"Apache" license or rights reserved') == parsed("(apache & license) | (rights & reserved)")
    assert phrase("one") == parsed("one")
    for bad in (lambda: phrase("two words"), lambda: websearch('"two words"'), lambda: websearch("a -b"), lambda: plain("?!"), lambda: websearch(" or ")):
        with pytest.raises(ValueError):
            bad()


def test_psquare_is_near_the_quantile():
    x = np.random.default_rng(3).normal(size=5000)
    for p in (0.1, 0.5, 0.9):
        assert psquare(x, p) == pytest.approx(np.quantile(x, p), abs=0.05)
    assert psquare([], 0.5) is None and psquare([3.0, 1.0, 2.0], 0.5) == 2.0
    with pytest.raises(ValueError):
        psquare(x, 1.5)


def test_codes_keep_lengths_and_are_read_back(rows, data, tmp_path):
    index = QuantizedIndex.build(rows, data.shape[1], 2, "cosine", corrected=True, renorm=True)
    raw, length = index.book.encode(data[:50])
    assert np.sqrt((index.book.decode(raw, length) ** 2).sum(1)) == pytest.approx(np.sqrt((data[:50] ** 2).sum(1)), rel=1e-4)
    again = index.write(str(tmp_path / "codes"))
    assert again.book == index.book and again.search(data[0].tolist(), 3).collect() == index.search(data[0].tolist(), 3).collect()


def test_queries_in_rounds_give_the_same(rows, data, spark):
    q = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).where("vec_id < 40")
    one, many = (sorted(map(tuple, knn.knn_join(q, rows, 4, sent_bytes=b).collect())) for b in (knn.SENT_BYTES, 1000))
    assert one == many
    c = rows.where("vec_id < 9").select(F.col("vec_id").alias("center"), F.col("embedding").alias("c"))
    assert sorted(map(tuple, knn.nearest_of(rows, c).collect())) == sorted(map(tuple, knn.nearest_of(rows, c, sent_bytes=300).collect()))


def test_graph_grows_and_is_joined(rows, data):
    index = GraphIndex.build(rows.where("vec_id % 2 = 0"), "l2").append(rows.where("vec_id % 2 = 1"))
    want = [r.vec_id for r in knn.knn(rows, data[5].tolist(), 3).collect()]
    assert [r.vec_id for r in index.search(data[5].tolist(), 3, 100).collect()] == want
    few = index.delete(rows.where("vec_id % 3 = 0"))
    assert few.vacuum(90) is few
    joined = few.vacuum(10)
    assert joined.graphs.count() == 1 and [r.vec_id for r in joined.search(data[5].tolist(), 3, 100).collect()] == [r.vec_id for r in few.search(data[5].tolist(), 3, 100).collect()]


def test_processor_features(spark):
    assert processor_features(spark).where("enabled").count() > 0


def test_text_queries():
    assert parsed("a & b | c") == parsed("(a & b) | c")
    assert any_of("The the, End") == parsed("the | end")
    for bad in ("!a", "a <-> b", "a:*", "a &", "(a", "a b", ""):
        with pytest.raises(ValueError):
            parsed(bad)
    with pytest.raises(ValueError, match="64"):
        parsed(" | ".join(f"t{k}" for k in range(65)))


def test_stemmer():
    words = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "hoping": "hope", "generalization": "general", "happiness": "happi", "dying": "die", "licenses": "licens", "running": "run", "national": "nation", "controlling": "control", "knightly": "knight", "sky": "sky", "enjoy": "enjoy", "rate": "rate"}
    assert {w: stem(w) for w in words} == words


def test_english_analyzer(spark):
    index = Bm25Index.of(corpus(spark, [(1, None, "The searching of vectors"), (2, None, "a search")]), analyzer="english")
    assert {r.term for r in index.lexicon().collect()} == {"search", "vector"}


def test_fusion_golden(spark):
    docs = corpus(spark, IR)
    ids = lambda **o: [r.id for r in hybrid_search(docs, HybridQuery([1.0, 0.0, 0.0], "alpha", **o)).collect()]
    base = {"dense_k": 3, "bm25_k": 2}
    assert [r.doc_id for r in Bm25Index.of(docs).topk("alpha", 5).collect()] == [1, 2]
    assert ids(**base) == [1, 2, 3]
    assert ids(**base, bm25_weight=0.0) == [3, 1, 2]
    assert ids(**base, require_bm25_match=True) == [1, 2]
    assert ids(**base, final_k=1) == [1]
    assert ids(dense_k=0, bm25_k=2) == [1, 2]
    assert ids(dense_k=2, bm25_k=0) == [3, 1]
    assert ids(dense_k=0, bm25_k=0) == []
    alone = hybrid_search(docs, HybridQuery([1.0, 0.0, 0.0], dense_k=1, final_k=1)).collect()
    assert [r.id for r in alone] == [3, 1, 2, 4]


def test_weighted_ignores_rrf_settings(spark):
    docs = corpus(spark, IR)
    run = lambda **o: [(r.id, r.score) for r in hybrid_search(docs, HybridQuery([1.0, 0.0, 0.0], "alpha", fusion="weighted", **o)).collect()]
    assert run() == run(dense_weight=9.0, rrf_k=3)
    assert run(alpha=1.0)[0][0] == 3


@pytest.mark.parametrize(
    "options", [{}, {"text_query": "a", "fusion": "max"}, {"text_query": "a", "alpha": 2.0}, {"text_query": "a", "rrf_k": 0}, {"text_query": "a", "dense_k": -1}, {"text_query": "a", "final_k": 0}, {"text_query": "a", "bm25_weight": float("nan")}, {"text_query": "a", "require_bm25_match": None}]
)
def test_query_validation(options):
    with pytest.raises(ValueError):
        HybridQuery(**options)


def test_scalar_hybrid_distance(spark):
    df = corpus(spark, IR)
    q = HybridQuery([1.0, 0.0, 0.0])
    assert df.select(hybrid_distance(F.col("embedding"), q, "l2").alias("d")).orderBy("d").first().d == 0
    with pytest.raises(ValueError, match="hybrid_search"):
        hybrid_distance(F.col("embedding"), HybridQuery([1.0], "alpha"))


def test_budget_follows_the_limit():
    q = HybridQuery([1.0], "a")
    assert [q.budget(None, x) for x in (None, 1, 10, 1000)] == [400, 32, 80, 400]
    assert q.budget(7, 1) == 7 and q.budget(None, 1, auto=False) == 400


def test_metrics_and_trec(spark, tmp_path):
    (tmp_path / "run").write_text("q1 Q0 d1 1 3.0 m\nq1 Q0 d2 2 2.0 m\nq2 Q0 d9 1 1.0 m\n")
    (tmp_path / "qrels").write_text("q1 0 d2 2\nq1 0 d3 1\nq2 0 d1 1\n\nq3 0 d1 0\n")
    run, qrels = trec.read_run(spark, str(tmp_path / "run")), trec.read_qrels(spark, str(tmp_path / "qrels"))
    m = metrics.ir_metrics(run, qrels).first()
    dcg, ideal = 3 / np.log2(3), 3 + 1 / np.log2(3)
    assert (m.n_queries, m.ndcg, m.recall, m.mrr, m.map) == (3, pytest.approx(dcg / ideal / 3), pytest.approx(0.5 / 3), pytest.approx(0.5 / 3), pytest.approx(0.25 / 3))
    trec.write_run(run, str(tmp_path / "again"), "m")
    assert trec.read_run(spark, str(tmp_path / "again")).orderBy("qid", "rank").collect() == run.orderBy("qid", "rank").collect()
    vectors = spark.createDataFrame([("1", [1.0, 2.5])], "id string, embedding array<float>")
    trec.write_vectors(vectors, str(tmp_path / "v"))
    assert trec.read_vectors(spark, str(tmp_path / "v"), 2).collect() == vectors.collect()


def test_stream_appends(spark, tmp_path):
    from nearfield.streaming.ingest import into_bm25, into_ivf

    src = str(tmp_path / "src")
    corpus(spark).write.parquet(src)
    stream = spark.readStream.schema("doc_id bigint, embedding array<float>, text string").parquet(src)
    into_bm25(stream, str(tmp_path / "bm"), str(tmp_path / "c1")).awaitTermination()
    assert Bm25Index.read(spark, str(tmp_path / "bm")).topk("search", 5).count() == 3
    index = IvfIndex.build(corpus(spark), 2, id_col="doc_id")
    into_ivf(stream, index, str(tmp_path / "ivf"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ivf")).count() == 4


@pytest.mark.parametrize(("metric", "bits"), [("l2", 4), ("ip", 4), ("cosine", 4), ("l1", 4), ("cosine", 1)])
def test_codes_exclude_no_neighbour(rows, data, metric, bits):
    """Codes bring neighbours into another order; with few candidates the exact ones are found all the same."""
    for renorm, corrected in ((False, False), (True, metric in ("ip", "cosine"))):
        index = QuantizedIndex.build(rows, 12, bits, metric, renorm=renorm, corrected=corrected)
        for i in (11, 12, 13):
            got = [r.vec_id for r in index.search([float(x) for x in data[i]], 10, oversampling=1).collect()]
            assert got == brute(data, data[i], metric)[:10]


def test_ties_of_rounded_distances_go_by_id(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2, 0.3]), (2, [0.7, 1.4, 2.1]), (3, [0.3, 0.6, 0.9]), (4, [0.5, 1.0, 1.5]), (0, [1.1, 2.2, 3.3])], "vec_id int, embedding array<float>")
    assert [r.vec_id for r in knn.knn(df, [0.2, 0.4, 0.6], 4, "cosine").collect()] == [0, 1, 2, 3]
    assert [r.vec_id for r in QuantizedIndex.build(df, 3, 4, "cosine").search([0.2, 0.4, 0.6], 4, 1).collect()] == [0, 1, 2, 3]


def test_copies_and_minima_leave_out_no_neighbour():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.integers(-2, 3, (40, 3)), 30, axis=0).astype(np.float64)[rng.permutation(1200)]
    place, q = rng.permutation(1200), rng.standard_normal((50, 3))
    for metric in ("l2", "ip", "cosine", "l1"):
        got = {}
        for query, row, _ in knn.searched(x, lambda a, b: q[a:b], 50, place, 7, metric, 9):
            for i, r in zip(query.tolist(), row.tolist(), strict=True):
                got.setdefault(i, []).append(r)
        for i in range(50):
            d = np.round(knn.distances(x, q[i], metric), 9)
            assert got[i] == np.lexsort((place, d))[:7].tolist()
    assert len(knn.few_copies(x, place, 7)) <= 40 * 7


def test_all_pairs_are_not_shuffled(spark):
    s = spark.createDataFrame([(i, (9, [j for j in range(9) if (i + j) % 4 == 0], [1.0 + j for j in range(9) if (i + j) % 4 == 0])) for i in range(30)] + [(30, (9, [], []))], "vec_id bigint, embedding struct<dim: int, indices: array<int>, values: array<float>>")
    for sent in (knn.SENT_BYTES, 200):
        found = knn.sparse_products(s, s.withColumnRenamed("vec_id", "other_id"), "vec_id", "other_id", "embedding", sent_bytes=sent)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        own = {r.vec_id: dict(zip(r.embedding["indices"], r.embedding["values"], strict=True)) for r in s.collect()}
        want = {(a, b): sum(x * own[b].get(k, 0) for k, x in own[a].items()) for a in own for b in own if own[a].keys() & own[b].keys()}
        assert {(r.a, r.b): r.ip for r in found.collect()} == pytest.approx(want)


def test_metrics_by_class_list_no_judgements(spark):
    docs = spark.createDataFrame([(i, i % 3 if i < 29 else None) for i in range(30)], "docid bigint, class int")
    queries = docs.withColumnRenamed("docid", "qid")
    run = spark.createDataFrame([(q, (q * 7 + r * r) % 30, r) for q in range(25) for r in range(1, 13)], "qid bigint, docid bigint, rank bigint")
    found = metrics.class_metrics(run, queries, docs)
    plain = metrics.ir_metrics(run, queries.where("class IS NOT NULL").join(docs, "class").select("qid", "docid", F.lit(1).alias("rel"))).first()
    got = found.first()
    assert got.n_queries == 30 and plain.n_queries == 29
    assert [got[c] * 30 for c in ("ndcg", "recall", "mrr", "map")] == pytest.approx([plain[c] * 29 for c in ("ndcg", "recall", "mrr", "map")])


def test_words_are_counted_where_the_text_is(spark):
    text = [(1, "Foo, foo bar"), (2, "  "), (3, "ŠKODA x_y 12"), (4, None)] + [(i, f"w{i % 7} w{i % 3}") for i in range(5, 1300)]
    docs = spark.createDataFrame(text, "doc_id bigint, text string")
    index = Bm25Index.of(docs)
    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    found = {(r.doc_id, r.term): (r.tf, r.dl) for r in index.postings.collect()}
    assert {k: v for k, v in found.items() if k[0] < 5} == {(1, "foo"): (2, 3), (1, "bar"): (1, 3), (3, "škoda"): (1, 4), (3, "x"): (1, 4), (3, "y"): (1, 4), (3, "12"): (1, 4)}
    assert all(found[i, f"w{i % 7}"] == (2 if i % 7 == i % 3 else 1, 2) for i in range(5, 1300))
    assert index.sizes() == (1298, 7 + 2 * 1295)
    twice = Bm25Index.of(spark.createDataFrame([(1, "a b"), (1, "b c"), (1, "b")], "doc_id bigint, text string"))
    assert sorted((r.term, r.tf, r.dl) for r in twice.postings.collect()) == [("a", 1, 2), ("b", 1, 1), ("b", 2, 2), ("c", 1, 2)]


@pytest.mark.parametrize("metric", ["hamming", "jaccard"])
def test_bits_are_measured_by_a_product(metric):
    from nearfield.operators.graph import Graph, measure

    x = (np.random.default_rng(2).random((40, 64)) < 0.3).astype(np.float64)
    x[3] = 0
    assert (Graph(metric).apart(x) == np.stack([measure(x, q, metric) for q in x])).all()


def test_shards_are_built_by_many_tasks(spark, rows):
    index = GraphIndex.build(rows, "l2", shard_rows=75)
    assert len({r.p for r in index.graphs.select(F.input_file_name().alias("p")).collect()}) > 2
