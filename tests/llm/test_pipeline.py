"""The corpus pipeline stage by stage, and the registered queries, on the smallest tables."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import decontaminate, quality, registry, secrets, simhash, tokens
from tests.parity import connect, rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage gets and gives."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        out[name] = docs, spark.read.parquet(path)
        docs = out[name][1]
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").schema
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)
    for _, (before, after) in list(stages.items())[:-1]:
        assert after.schema == columns and ids(after) <= ids(before)


def test_quality_stage_takes_what_the_classifier_keeps(spark, stages):
    before, after = stages["quality_classifier"]
    verdict = quality.classified(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == ids(verdict.where("keep")) and 0.5 < after.count() / before.count() < 1
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {i for i, r in labels.items() if r.quality == 1 and r.toxic == 0}
    assert len(good & ids(after)) >= 0.95 * len(good)


def test_near_dedup_stage_leaves_one_of_each_group(stages):
    before, after = stages["near_dedup"]
    group = {r.doc_id: r.group_id for r in simhash.near_duplicates(before).collect()}
    assert ids(after) == {i for i in ids(before) if group.get(i, i) == i}


def test_near_dedup_stage_takes_copies_at_the_radius(spark):
    """Texts and edited copies whose codes differ in 11 or 12 bits, the most allowed: no copy stays."""
    rng, rows = random.Random(21), []
    for k in range(800):
        text = [f"w{rng.randrange(5000)}" for _ in range(60)]
        rows.append((2 * k, " ".join(text)))
        for at in rng.sample(range(60), 8):
            text[at] = f"w{rng.randrange(5000)}"
        rows.append((2 * k + 1, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    code = {r.doc_id: np.array([r.code, r.pair_code, r.other_pair_code]) for r in simhash.codes(docs).collect()}
    near = []
    for k in range(800):
        d = np.bitwise_count((code[2 * k] ^ code[2 * k + 1]).view(np.uint64)).astype(int)
        if d[0] in (11, 12) and d[1] + d[2] <= simhash.CONFIRM_RADIUS:
            near.append(2 * k)
    assert len(near) > 150
    some = docs.where(F.col("doc_id").isin(near + [k + 1 for k in near]))
    assert ids(corpus_pipeline.near_dedup(spark, some, SF)) == set(near)


def test_decontamination_stage_leaves_no_passage(spark, stages):
    before, after = stages["decontamination"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids(before) - ids(after) == ids(decontaminate.contamination(before, bench))
    assert decontaminate.contamination(after, bench).count() == 0


def test_secret_stage_blots_out_what_it_finds(stages):
    before, after = stages["secret_scans"]
    text = {r.doc_id: r for r in after.collect()}
    assert set(text) == ids(before)
    for r in secrets.secrets(before, keep_tokens=True).collect():
        assert r.token not in text[r.doc_id].text
    assert all(r.n_chars == len(r.text) for r in text.values() if secrets.MARK in r.text)


def test_packing_stage_holds_every_token(stages):
    before, after = stages["packing"]
    encode = tokens.Encoder(open(tokens.TOKENIZER, "rb").read())
    want = {r.doc_id: encode(r.text).tolist() for r in before.collect() if r.text}
    got = {}
    for r in after.orderBy("pack_id").collect():
        ids, at = np.frombuffer(bytes(r.ids), "<u2").tolist(), 0
        for i, a, b in zip(r.doc_ids, r.begins, r.ends, strict=True):
            got.setdefault(i, []).extend(ids[at : at + b - a])
            at += b - a
    assert got == {i: [*x, tokens.END_OF_DOCUMENT] for i, x in want.items()}


def test_stages_take_anything(spark, tmp_path):
    """Nulls in every column, empty, blank and very long texts, repeated rows, an empty table."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    some = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = [(None,) * 5, (1, None, "en", "h", None), (2, "", None, None, 0), (3, " \n", "en", "h", 2), (None, "a text without id and " * 9, "en", "h", 5), (4, "word " * 100_000, "en", "h", 9), (4, "word " * 100_000, "en", "h", 9), (5, "?" * 50_000, "en", "h", 9)]
    for number, docs in enumerate((some.union(spark.createDataFrame(odd, schema)), spark.createDataFrame([], schema))):
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{number}-{name}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            assert name == "packing" or docs.schema == schema
        assert (docs.count() > 0) == (number == 0)


def test_run_is_the_stages_in_a_row(spark, stages):
    key = lambda r: r.pack_id
    assert sorted(corpus_pipeline.run(spark, SF).collect(), key=key) == sorted(stages["packing"][1].collect(), key=key)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registered_queries(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE_SQL:
        assert rows(got) == rows(connect(SF).execute(registry.ORACLE_SQL[name]).df())
    elif name.split("_")[0] in ("op4", "op5", "op7"):
        assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    else:
        assert len(got)
