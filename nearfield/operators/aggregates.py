"""Averages and sums of vectors, by group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from nearfield.functions import half
from nearfield.functions.dense import fail, finite
from nearfield.session import ship


def partial(df: DataFrame, vec_col: str, keys: Sequence[str]) -> DataFrame:
    """(keys, __dims, __n, __sum): for each batch of rows, its groups' vectors summed up in double precision."""
    ship(df.sparkSession)
    at = len(keys)
    rows = df.select(*keys, F.col(vec_col).cast("array<double>").alias("__v"))
    names = [*rows.columns[:at], "__dims", "__n", "__sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(at)
            size = np.where(v.is_null().to_numpy(zero_copy_only=False), -1, v.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False))
            code = np.unique(size, return_inverse=True)[1]
            for c in b.columns[:at]:
                code = code * (b.num_rows + 1) + c.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                code = np.unique(code, return_inverse=True)[1]
            first = np.unique(code, return_index=True)[1]
            n, sums = np.bincount(code), [None] * len(first)
            begin = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])[:-1]
            flat = v.flatten().to_numpy(zero_copy_only=False)
            for dims in np.unique(size[size >= 0]).tolist():
                own = np.flatnonzero(size == dims)
                own = own[np.argsort(code[own], kind="stable")]
                groups, start = np.unique(code[own], return_index=True)
                total = np.add.reduceat(flat[begin[own][:, None] + np.arange(dims)[None, :]], start, axis=0)
                for g, row in zip(groups.tolist(), total, strict=True):
                    sums[g] = row
            n[size[first] < 0] = 0
            take = pa.array(first)
            columns = [*(c.take(take) for c in b.columns[:at]), pa.array(size[first].astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(sums, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = StructType([*rows.schema.fields[:at], StructField("__dims", IntegerType()), StructField("__n", LongType()), StructField("__sum", ArrayType(DoubleType()))])
    return rows.mapInArrow(run, kinds)


def combined(df: DataFrame, vec_col: str, keys: Sequence[str], how: str, name: str, half_precision: bool) -> DataFrame:
    """One row for each group of keys, or one for all, with the elements combined in double precision and rounded once.

    NULL vectors don't count; a group without any vector has NULL. Different
    dimensions in a group are an error. Each batch of rows sends one sum a group, so
    that the elements that are shuffled number groups times dimensions a batch.
    """
    parts = partial(df, vec_col, keys).select(*keys, "__n", F.when(F.col("__n") > 0, F.col("__dims")).alias("__dims"), F.posexplode_outer("__sum").alias("__pos", "__x"))
    by = parts.groupBy(*keys, "__pos").agg(F.sum("__x").alias("__x"), F.sum("__n").alias("__n"), F.min("__dims").alias("__least"), F.max("__dims").alias("__most"))
    value = F.col("__x") / F.col("__n") if how == "avg" else F.col("__x")
    some = F.when(F.col("__pos").isNotNull(), F.struct("__pos", value.alias("__x")))
    all_of = by.groupBy(*keys).agg(F.array_sort(F.collect_list(some)).alias("__v"), F.min("__least").alias("__least"), F.max("__most").alias("__most"))
    values: Column = F.transform("__v", lambda p: p["__x"])
    values = half.halves(values) if half_precision else finite(F.transform(values, lambda x: x.cast("float")))
    out = F.when(F.size("__v") == 0, None).when(F.col("__least") < F.col("__most"), fail("expected ", F.col("__least"), " dimensions, not ", F.col("__most"))).otherwise(values)
    return all_of.select(*keys, out.alias(name))


def vector_avg(df: DataFrame, vec_col: str, keys: Sequence[str] = (), name: str = "avg", half_precision: bool = False) -> DataFrame:
    return combined(df, vec_col, keys, "avg", name, half_precision)


def vector_sum(df: DataFrame, vec_col: str, keys: Sequence[str] = (), name: str = "sum", half_precision: bool = False) -> DataFrame:
    """Sums; those of halfvecs are rounded once at the end, so that they don't depend on the order."""
    return combined(df, vec_col, keys, "sum", name, half_precision)
