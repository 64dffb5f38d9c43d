"""TREC run and judgement files, and vectors in text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.dense import vector_from_text, vector_to_text


def columns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(*[parts[k].alias(n) for k, n in enumerate(names) if n])


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docid, rank, score, method) from lines "qid Q0 docid rank score method"."""
    rows = columns(spark, path, ["qid", "", "docid", "rank", "score", "method"])
    return rows.withColumns({"rank": F.col("rank").cast("int"), "score": F.col("score").cast("double")})


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docid, rel) from lines "qid 0 docid rel"."""
    return columns(spark, path, ["qid", "", "docid", "rel"]).withColumn("rel", F.col("rel").cast("int"))


def write_run(run: DataFrame, path: str, method: str = "run") -> None:
    fields = ["qid", F.lit("Q0"), "docid", F.col("rank").cast("string"), F.col("score").cast("string"), F.lit(method)]
    run.select(F.concat_ws(" ", *fields).alias("value")).write.mode("overwrite").text(path)


def read_vectors(spark: SparkSession, path: str, dims: int | None = None, vec_col: str = "embedding", sep: str = "\t") -> DataFrame:
    """Rows of a delimited file with a header, whose vec_col holds text like [1,2,3]."""
    rows = spark.read.csv(path, sep=sep, header=True)
    return rows.withColumn(vec_col, vector_from_text(F.col(vec_col), dims))


def write_vectors(df: DataFrame, path: str, vec_col: str = "embedding", sep: str = "\t") -> None:
    df.withColumn(vec_col, vector_to_text(F.col(vec_col))).write.mode("overwrite").csv(path, sep=sep, header=True)
