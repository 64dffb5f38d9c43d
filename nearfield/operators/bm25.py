"""Lexical ranking: postings, corpus statistics, boolean queries and BM25."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.operators.english import analyzed, english_tokens
from nearfield.session import durable, shared_folder, ship, spread

K1, B = 1.2, 0.75
MOST_TERMS = 64
TFNORM_STEPS = 65535


def simple_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


ANALYZERS = {"simple": simple_tokens, "english": english_tokens}
#: Documents whose words are counted at a time.
COUNTED = 500


def counted(docs: DataFrame, analyzer: str = "simple") -> DataFrame:
    """(doc_id, term, tf, dl) of each word of each row (doc_id, text), and a row without a term for each document.

    Words are counted where the text is, so that no word is shuffled and a text is taken apart once.
    """
    ship(docs.sparkSession)
    spaced = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ") if analyzer == "simple" else F.col("text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), COUNTED):
                ids, text = batch.column(0).slice(a, COUNTED), batch.column(1).slice(a, COUNTED)
                words = pc.split_pattern(text, " ") if analyzer == "simple" else pa.array([analyzed(t) for t in text.to_pylist()], pa.list_(pa.string()))
                doc, flat = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False)), words.flatten()
                some = pc.not_equal(flat, "")
                doc, coded = doc[some.to_numpy(zero_copy_only=False)], flat.filter(some).dictionary_encode()
                dl, n = np.bincount(doc, minlength=len(words)), max(1, len(coded.dictionary))
                key, tf = np.unique(doc * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                of = np.concatenate([key // n, np.arange(len(words))])
                term = coded.dictionary.take(pa.array(np.concatenate([key % n, np.zeros(len(words), np.int64)]), mask=np.arange(len(of)) >= len(key)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), term.cast(pa.string()), pa.array(np.concatenate([tf, np.zeros(len(words), np.int64)])), pa.array(dl[of])], ["doc_id", "term", "tf", "dl"])

    return docs.select("doc_id", spaced.alias("text")).mapInArrow(count, f"doc_id {kind}, term string, tf bigint, dl bigint")


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Op:
    kind: str  # "&" or "|"
    parts: tuple


def parsed(query: str) -> Term | Op:
    """A query of terms, &, | and parentheses; & binds closer. Negation, phrases, prefixes and weights are errors."""
    if found := re.search(r"!|<(?:->|\d+>)|:", query):
        raise ValueError(f"unsupported in a text query: {found.group()}")
    tokens = re.findall(r"[&|()]|'[^']*'|[^\s&|()']+", query)
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def level(kind: str) -> Term | Op:
        nonlocal at
        below = (lambda: level("&")) if kind == "|" else atom
        parts = [below()]
        while peek() == kind:
            at += 1
            parts.append(below())
        return parts[0] if len(parts) == 1 else Op(kind, tuple(parts))

    def atom() -> Term | Op:
        nonlocal at
        t = peek()
        at += 1
        if t == "(":
            inner = level("|")
            if peek() != ")":
                raise ValueError("a parenthesis is open in the text query")
            at += 1
            return inner
        if t is None or t in "&|)":
            raise ValueError("an operand is missing in the text query")
        return Term(t.strip("'").lower())

    out = level("|")
    if at < len(tokens):
        raise ValueError(f"an operator is missing before {tokens[at]} in the text query")
    if len(terms_of(out)) > MOST_TERMS:
        raise ValueError(f"a text query has at most {MOST_TERMS} terms")
    return out


def words_of(text: str, analyzer: str = "simple") -> tuple[str, ...]:
    """Distinct terms of a plain text, as the analyzer makes them."""
    found = analyzed(text) if analyzer == "english" else re.findall(r"[^\W_]+", text.lower())
    return tuple(dict.fromkeys(found or ()))


def joined(kind: str, terms: tuple[str, ...]) -> Term | Op:
    if not terms:
        raise ValueError("the text query has no term")
    if len(terms) > MOST_TERMS:
        raise ValueError(f"a text query has at most {MOST_TERMS} terms")
    return Term(terms[0]) if len(terms) == 1 else Op(kind, tuple(map(Term, terms)))


def plain(text: str, analyzer: str = "simple") -> Term | Op:
    """A query for all words of a plain text."""
    return joined("&", words_of(text, analyzer))


def phrase(text: str, analyzer: str = "simple") -> Term | Op:
    """A query for a phrase: postings hold no positions, so that more than one word is an error."""
    terms = words_of(text, analyzer)
    if len(terms) > 1:
        raise ValueError("unsupported in a text query: a phrase")
    return joined("&", terms)


def websearch(text: str, analyzer: str = "simple") -> Term | Op:
    """A query as in web search: all words, either side of "or"; quoted phrases of one word. Negation (-) is an error."""
    if re.search(r"(?:^|\s)-\S", text):
        raise ValueError("unsupported in a text query: negation")
    sides = []
    for side in re.split(r"(?i)(?:^|\s)or(?=\s|$)", text):
        quoted_ = [phrase(q, analyzer) for q in re.findall(r'"([^"]*)"', side) if words_of(q, analyzer)]
        terms = tuple(dict.fromkeys([t.text for t in quoted_] + list(words_of(re.sub(r'"[^"]*"', " ", side), analyzer))))
        if terms:
            sides.append(joined("&", terms))
    if not sides:
        raise ValueError("the text query has no term")
    out = sides[0] if len(sides) == 1 else Op("|", tuple(sides))
    if len(terms_of(out)) > MOST_TERMS:
        raise ValueError(f"a text query has at most {MOST_TERMS} terms")
    return out


def any_of(text: str) -> Term | Op:
    """A query for any word of a plain text."""
    found = tuple(dict.fromkeys(re.findall(r"[^\W_]+", text.lower())))
    if not found:
        raise ValueError("the text query has no term")
    return Term(found[0]) if len(found) == 1 else Op("|", tuple(map(Term, found)))


def terms_of(query: Term | Op) -> list[str]:
    """Distinct terms, in the order in which they come."""
    if isinstance(query, Term):
        return [query.text]
    return list(dict.fromkeys(t for p in query.parts for t in terms_of(p)))


def matches(query: Term | Op, found: Column) -> Column:
    """Whether an array of matched terms satisfies the query."""
    if isinstance(query, Term):
        return F.array_contains(found, query.text)
    out = matches(query.parts[0], found)
    for p in query.parts[1:]:
        out = out & matches(p, found) if query.kind == "&" else out | matches(p, found)
    return out


@dataclass(frozen=True)
class Bm25Index:
    """postings (doc_id, term, tf, dl, generation), one row for each word of each document, and docs (doc_id, dl, generation).

    dropped (doc_id, upto): dead documents, those of the generations up to `upto`.
    They are never returned, but stay in the counts until compaction. terms (term,
    df, cf) and counts (documents, their total length) are kept beside the postings
    once the index is stored.
    """

    postings: DataFrame
    docs: DataFrame
    dropped: DataFrame | None = None
    k1: float = K1
    b: float = B
    generation: int = 0
    terms: DataFrame | None = None
    counts: tuple[int, int] | None = None

    @classmethod
    def of(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vec_col: str | None = None, analyzer: str = "simple", k1: float = K1, b: float = B) -> Bm25Index:
        """Documents without text are left out; with vec_col also those whose vector is NULL or all zero. Words are counted at once, into durable tables."""
        if not (0 <= k1 <= 10 and 0 <= b <= 1):
            raise ValueError("bm25_k1 must lie in [0, 10] and bm25_b in [0, 1]")
        rows = docs.where(F.col(text_col).isNotNull())
        if vec_col:
            rows = rows.where(F.col(vec_col).isNotNull() & F.exists(vec_col, lambda x: x != 0))
        rows = spread(rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
        generation = F.lit(0).alias("generation")
        found = durable(counted(rows, analyzer), "counted")
        sized = durable(found.where(F.col("term").isNull()).select("doc_id", "dl"), "sized")
        postings = found.where(F.col("term").isNotNull())
        if sized.groupBy("doc_id", "dl").count().where("count > 1").limit(1).count():  # several texts of one id and length count as one
            postings = postings.groupBy("doc_id", "term", "dl").agg(F.sum("tf").alias("tf"))
        return cls(postings.select("doc_id", "term", "tf", "dl", generation), sized.select("doc_id", "dl", generation), None, k1, b)

    def write(self, path: str) -> Bm25Index:
        """Store the postings sorted by term, so that a query reads only its terms' row groups, with terms and counts; the index that is read from there.

        What is stored already is read while it is replaced, so path must be a new folder for a new state.
        """
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        if self.dropped is not None:
            self.dropped.groupBy("doc_id").agg(F.max("upto").alias("upto")).write.mode("overwrite").parquet(f"{path}/dropped")
        spark = self.docs.sparkSession
        terms = replace(self, postings=spark.read.parquet(f"{path}/postings"), terms=None).lexicon()
        terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        docs = spark.read.parquet(f"{path}/docs")
        counts = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), F.lit(self.generation).alias("generation"), F.lit(float(self.k1)).alias("k1"), F.lit(float(self.b)).alias("b"))
        counts.write.mode("overwrite").parquet(f"{path}/counts")
        return Bm25Index.read(spark, path)

    def stored(self) -> Bm25Index:
        """The index written to a new folder of the shared one."""
        return self.write(f"{shared_folder(self.docs.sparkSession)}/bm25-{uuid.uuid4().hex}")

    @classmethod
    def read(cls, spark: SparkSession, path: str, k1: float | None = None, b: float | None = None) -> Bm25Index:
        def part(name: str) -> DataFrame | None:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            return spark.read.parquet(f"{path}/{name}") if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None

        own, postings, docs = part("counts"), part("postings"), part("docs")
        if own is None or "batch" in docs.columns:  # batches from a stream: each a generation, counted when it is read
            postings, docs = (x.withColumn("generation", F.col("batch").cast("int") + 1 if "batch" in x.columns else F.lit(0)).drop("batch") if "generation" not in x.columns or "batch" in x.columns else x for x in (postings, docs))
            last = docs.agg(F.max("generation")).first()[0] or 0
            return cls(postings, docs, part("dropped"), K1 if k1 is None else k1, B if b is None else b, last)
        r = own.first()
        return cls(postings, docs, part("dropped"), r["k1"] if k1 is None else k1, r["b"] if b is None else b, r["generation"], part("terms"), (r["n"], r["total"]))

    def append(self, other: Bm25Index) -> Bm25Index:
        """A delta of new documents, a generation of its own; they count at once."""
        new = F.lit(self.generation + 1)
        terms = None if self.terms is None else self.terms.unionByName(other.lexicon()).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        counts = None if self.counts is None else tuple(x + y for x, y in zip(self.counts, other.sizes(), strict=True))
        more = lambda a, b: a.unionByName(b.withColumn("generation", new))
        return replace(self, postings=more(self.postings, other.live(other.postings)), docs=more(self.docs, other.live(other.docs)), generation=self.generation + 1, terms=terms, counts=counts)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> Bm25Index:
        """Documents of these ids that are there now are dead; such as come later are not."""
        new = ids.select(F.col(id_col).alias("doc_id"), F.lit(self.generation).alias("upto"))
        return replace(self, dropped=new if self.dropped is None else self.dropped.unionByName(new))

    def upsert(self, other: Bm25Index) -> Bm25Index:
        """Documents of other, in place of those of equal id."""
        return self.delete(other.docs).append(other)

    def compact(self) -> Bm25Index:
        """Dead documents leave the counts too."""
        return self if self.dropped is None else replace(self, postings=self.live(self.postings), docs=self.live(self.docs), dropped=None, terms=None, counts=None)

    def vacuum(self, threshold: int = 25) -> Bm25Index:
        """Compacted once the documents that were added or died since the last time are `threshold` percent of the rest."""
        dead = 0 if self.dropped is None else self.docs.join(self.dropped.groupBy("doc_id").agg(F.max("upto").alias("upto")), "doc_id").where("generation <= upto").count()
        delta = self.docs.where("generation > 0").count()
        base = self.docs.count() - delta
        if (delta + dead) * 100 < base * threshold:
            return self
        out = self.compact()
        first = F.lit(0).alias("generation")
        return replace(out, postings=out.postings.drop("generation").select("*", first), docs=out.docs.drop("generation").select("*", first), generation=0, terms=None, counts=None)

    def live(self, rows: DataFrame) -> DataFrame:
        if self.dropped is None:
            return rows
        dead = self.dropped.groupBy(F.col("doc_id").alias("__dead")).agg(F.max("upto").alias("__upto"))
        return rows.join(dead, (F.col("doc_id") == F.col("__dead")) & (F.col("generation") <= F.col("__upto")), "left_anti")

    def corpus_stats(self) -> DataFrame:
        """(doc_count, total_doc_len, unique_terms, avg_doc_len)"""
        docs = self.docs.agg(F.count("*").alias("doc_count"), F.coalesce(F.sum("dl"), F.lit(0)).cast("bigint").alias("total_doc_len"))
        terms = self.lexicon().agg(F.count("*").alias("unique_terms"))
        return docs.crossJoin(terms).withColumn("avg_doc_len", F.when(F.col("doc_count") > 0, F.col("total_doc_len") / F.col("doc_count")).otherwise(0.0))

    def sizes(self) -> tuple[int, int]:
        """Documents and their total length."""
        if self.counts is not None:
            return self.counts
        n, total = self.docs.agg(F.count("*"), F.sum("dl")).first()
        return n, int(total or 0)

    def totals(self) -> tuple[int, float]:
        """Documents and their average length."""
        n, total = self.sizes()
        return n, total / n if n else 0.0

    def lexicon(self) -> DataFrame:
        """(term, df, cf)"""
        return self.terms if self.terms is not None else self.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def scored(self, query: Term | Op, quantized: bool = False) -> DataFrame:
        """(doc_id, score) of all documents that satisfy the query. quantized: tf norms in steps of 1 / 65535."""
        terms = terms_of(query)
        n, average = self.totals()
        of_terms = self.postings.where(F.col("term").isin(terms))
        df = {r["term"]: r["df"] for r in self.lexicon().where(F.col("term").isin(terms)).collect()}
        if not df:
            return self.postings.where("false").select("doc_id", F.lit(0.0).alias("score"))
        idf = F.element_at(F.create_map(*[x for t, k in df.items() for x in (F.lit(t), F.log(F.lit(1 + (n - k + 0.5) / (k + 0.5))))]), F.col("term"))
        norm = F.lit(self.k1) * (F.lit(1 - self.b) + F.lit(self.b) * F.greatest(F.col("dl"), F.lit(1)) / F.lit(max(average, 1.0)))
        tf_norm = F.col("tf") * F.lit(self.k1 + 1) / (F.col("tf") + norm)
        if quantized:
            tf_norm = F.round(tf_norm / F.lit(self.k1 + 1) * TFNORM_STEPS) / TFNORM_STEPS * F.lit(self.k1 + 1)
        by = self.live(of_terms).withColumn("s", idf * tf_norm).groupBy("doc_id").agg(F.sum("s").alias("score"), F.collect_set("term").alias("found"))
        return by.where(matches(query, F.col("found"))).select("doc_id", F.round("score", 9).alias("score"))

    def topk_many(self, queries: DataFrame, k: int, query_id: str = "query_id", terms_col: str = "terms") -> DataFrame:
        """(query_id, doc_id, score, rank): the k best for each of many queries, given as arrays of terms of which any may match.

        One join on the term serves all queries, and one aggregation all scores.
        """
        n, average = self.totals()
        wanted = queries.select(F.col(query_id).alias("__q"), F.explode(F.array_distinct(terms_col)).alias("term"))
        of_terms = self.postings.join(wanted.select("term").distinct(), "term", "left_semi")
        df = self.lexicon().join(wanted.select("term").distinct(), "term", "left_semi").select("term", F.col("df").alias("__df"))
        idf = F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("__df") + 0.5) / (F.col("__df") + 0.5))
        norm = F.lit(self.k1) * (F.lit(1 - self.b) + F.lit(self.b) * F.greatest(F.col("dl"), F.lit(1)) / F.lit(max(average, 1.0)))
        score = idf * (F.col("tf") * F.lit(self.k1 + 1) / (F.col("tf") + norm))
        hits = self.live(of_terms).join(wanted.join(df, "term"), "term").groupBy("__q", "doc_id").agg(F.round(F.sum(score), 9).alias("score"))
        rank = F.row_number().over(Window.partitionBy("__q").orderBy(F.col("score").desc(), "doc_id"))
        return hits.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).select(F.col("__q").alias(query_id), "doc_id", "score", "rank")

    def topk(self, query: str | Term | Op, k: int, quantized: bool = False) -> DataFrame:
        """(doc_id, score) of the k best; ties go by doc_id."""
        tree = parsed(query) if isinstance(query, str) else query
        return self.scored(tree, quantized).orderBy(F.col("score").desc(), "doc_id").limit(k)
