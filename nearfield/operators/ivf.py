"""Approximate search by inverted lists: k-means centres, list assignment, probes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from nearfield.functions import bits
from nearfield.operators import knn
from nearfield.session import shared_folder, ship

MOST_LISTS = 32768


def kmeans(x: np.ndarray, k: int, spherical: bool = False, rounds: int = 50, seed: int = 0) -> np.ndarray:
    """Centres by k-means++ and Lloyd's steps, until no row changes; an empty cluster gets a random row."""
    rng = np.random.default_rng(seed)
    if len(x) <= k:  # too few rows: what is missing is random
        more = rng.random((k - len(x), x.shape[1]))
        return np.concatenate([x, unit(more) if spherical else more])
    centers = [x[rng.integers(len(x))]]
    near = ((x - centers[0]) ** 2).sum(1)
    for _ in range(k - 1):
        total = near.sum()
        centers.append(x[rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))])
        near = np.minimum(near, ((x - centers[-1]) ** 2).sum(1))
    c, label = np.array(centers), None
    for _ in range(rounds):
        new = closest(x, c)
        if label is not None and (new == label).all():
            break
        label = new
        n = np.bincount(label, minlength=k)
        sums = np.stack([np.bincount(label, x[:, j], k) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
        if spherical:
            c = unit(c)
    return c


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([((c * c).sum(1)[None, :] - 2 * (x[a : a + 4096] @ c.T)).argmin(1) for a in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def with_list(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("list_id", IntegerType())])


@dataclass(frozen=True)
class IvfIndex:
    """Rows with their list_id, and the lists' centres. metric: l2, ip or cosine; hamming counts differing bits of bit strings or 0/1 vectors."""

    rows: DataFrame
    centers: np.ndarray
    metric: str = "l2"
    id_col: str = "vec_id"
    vec_col: str = "embedding"

    @classmethod
    def build(cls, df: DataFrame, lists: int = 100, metric: str = "l2", id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 0, sample: int | None = None) -> IvfIndex:
        """Train centres on a sample of max(50 * lists, 10000) rows chosen by a hash of the id, and assign all rows.

        NULL vectors, and zero vectors for ip and cosine, aren't indexed. `sample`
        bounds what the driver holds.
        """
        if metric not in ("l2", "ip", "cosine", "hamming"):
            raise ValueError(f"inverted lists don't support {metric}")
        if not 1 <= lists <= MOST_LISTS:
            raise ValueError(f"lists must lie between 1 and {MOST_LISTS}")
        usable = cls.usable(df, metric, vec_col)
        n, want = usable.count(), sample or max(50 * lists, 10000)
        key = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 40))
        some = usable if n <= 2 * want else usable.where(key < int((1 << 40) * 1.5 * want / n))
        got = some.orderBy(key, id_col).limit(want).select(cls.plain(df, vec_col).alias("v")).toArrow()["v"].combine_chunks()
        x = knn.vectors(got) if len(got) else np.zeros((0, 1))
        spherical = metric in ("ip", "cosine")
        centers = kmeans(unit(x) if spherical else x, lists, spherical, seed=seed)
        if metric == "hamming":
            centers = (centers > 0.5).astype(np.float64)
        out = cls(usable, centers, metric, id_col, vec_col)
        return cls(out.assigned(usable), centers, metric, id_col, vec_col)

    @staticmethod
    def usable(df: DataFrame, metric: str, vec_col: str) -> DataFrame:
        rows = df.where(F.col(vec_col).isNotNull())
        return rows.where(F.exists(vec_col, lambda x: x != 0)) if metric in ("ip", "cosine") else rows

    def assigned(self, df: DataFrame) -> DataFrame:
        """Rows of df with the list_id of their closest centre, the first of equals."""
        ship(df.sparkSession)
        rows, centers, spherical = self.usable(df.drop("list_id"), self.metric, self.vec_col), self.centers, self.metric in ("ip", "cosine")
        schema, at = rows.schema, rows.columns.index(self.vec_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = knn.vectors(b.column(at), centers.shape[1])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(closest(unit(x) if spherical else x, centers).astype(np.int32))], [*b.schema.names, "list_id"])

        return rows.mapInArrow(run, with_list(schema))

    def write(self, path: str) -> IvfIndex:
        """Store the rows by list, so that a probe reads its lists' folders only."""
        spark = self.rows.sparkSession
        self.rows.repartition("list_id").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/rows")
        centers = [(k, c.tolist(), self.metric, self.id_col, self.vec_col) for k, c in enumerate(self.centers)]
        spark.createDataFrame(centers, "list_id int, center array<double>, metric string, id_col string, vec_col string").write.mode("overwrite").parquet(f"{path}/centers")
        return IvfIndex.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> IvfIndex:
        got = spark.read.parquet(f"{path}/centers").orderBy("list_id").collect()
        return cls(spark.read.parquet(f"{path}/rows"), np.array([r["center"] for r in got]), got[0]["metric"], got[0]["id_col"], got[0]["vec_col"])

    def stored(self) -> IvfIndex:
        """The index written to a new folder of the shared one."""
        return self.write(f"{shared_folder(self.rows.sparkSession)}/ivf-{uuid.uuid4().hex}")

    @staticmethod
    def plain(df: DataFrame, vec_col: str) -> Column:
        """Vectors as double precision, bit strings as they are."""
        return F.col(vec_col) if isinstance(df.schema[vec_col].dataType, StructType) else F.col(vec_col).cast("array<double>")

    def append(self, df: DataFrame) -> IvfIndex:
        return IvfIndex(self.rows.unionByName(self.assigned(df)), self.centers, self.metric, self.id_col, self.vec_col)

    def delete(self, ids: DataFrame) -> IvfIndex:
        return IvfIndex(self.rows.join(ids.select(self.id_col).distinct(), self.id_col, "left_anti"), self.centers, self.metric, self.id_col, self.vec_col)

    def order(self, query: Sequence[float]) -> np.ndarray:
        """Lists from the closest centre on."""
        q = np.asarray(query, np.float64)
        score = -self.centers @ q if self.metric in ("ip", "cosine") else ((self.centers - q) ** 2).sum(1)
        return np.argsort(score, kind="stable")

    def distance(self, query: Sequence[float]) -> Column:
        if isinstance(self.rows.schema[self.vec_col].dataType, StructType):
            return bits.hamming_distance(F.col(self.vec_col), bits.packed(F.array(*[F.lit(bool(x)) for x in query])))
        if self.metric == "hamming":
            return knn.METRICS["l1"](F.col(self.vec_col), knn.literal(query))
        return knn.METRICS[self.metric](F.col(self.vec_col), knn.literal(query))

    def search(self, query: Sequence[float], k: int, probes: int = 1, where: Column | None = None, iterative: bool = False, max_probes: int = MOST_LISTS) -> DataFrame:
        """The k nearest rows of the `probes` closest lists; iterative: of more and more lists, until k rows are found."""
        order = self.order(query)
        n = probes
        while True:
            lists = [int(x) for x in order[: min(n, max_probes)]]
            rows = self.rows.where(F.col("list_id").isin(lists))
            rows = rows if where is None else rows.where(where)
            if not iterative or n >= min(len(order), max_probes) or rows.limit(k).count() >= k:
                return knn.nearest(rows, self.distance(query), k, self.id_col)
            n += max(probes, n)

    def search_many(self, queries: DataFrame, k: int, probes: int = 1, query_id: str = "query_id", query_vec: str = "query") -> DataFrame:
        """(query_id, id, distance, rank): each query's k nearest rows of the lists that it probes.

        Queries travel to the rows in rounds; each task measures the rows of a list
        with the queries that probe it, by matrix products, and keeps k a query and
        batch. Many queries have the rows shared out evenly, so that long lists don't weigh on one task.
        """
        ship(queries.sparkSession)
        centers, metric, lists = self.centers, self.metric, min(probes, len(self.centers))
        flat = "l1" if metric == "hamming" else metric
        q = queries.where(F.col(query_vec).isNotNull()).select(F.col(query_id).alias("q"), self.plain(queries, query_vec).alias("v"))
        qtype, itype = q.schema["q"].dataType.simpleString(), self.rows.schema[self.id_col].dataType.simpleString()
        rows = self.rows.select(F.col(self.id_col).alias("i"), F.col(self.vec_col).alias("v"), "list_id")

        def scan(part: pa.Table) -> DataFrame:
            names, qs = part["q"].combine_chunks(), knn.vectors(part["v"].combine_chunks(), centers.shape[1])
            score = -qs @ centers.T if metric in ("ip", "cosine") else (centers * centers).sum(1)[None, :] - 2 * qs @ centers.T
            near = np.argsort(score, axis=1, kind="stable")[:, :lists]
            probed = np.zeros((len(qs), len(centers)), bool)
            np.put_along_axis(probed, near, True, axis=1)
            whole = bool(probed.all())

            def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in knn.grouped(batches):
                    place, x = knn.places(batch.column(0)), knn.vectors(batch.column(1), centers.shape[1])
                    own = np.zeros(len(x), np.int32) if whole else batch.column(2).to_numpy(zero_copy_only=False)
                    for a in range(0, len(qs), 4096):
                        got = []
                        for n in np.unique(own).tolist():
                            row, some = np.flatnonzero(own == n), np.flatnonzero(probed[a : a + 4096, n]) + a
                            for query, at, distance in knn.searched(x[row], lambda c, d: qs[some[c:d]], len(some), place[row], k, flat, 9):  # noqa: B023
                                got.append((some[query], row[at], distance))
                        if got:  # the k first of all lists
                            query, row, distance = (np.concatenate(c) for c in zip(*got, strict=True))
                            by = np.lexsort((place[row], distance, query))
                            by = by[np.arange(len(by)) - np.searchsorted(query[by], query[by]) < k]
                            yield pa.RecordBatch.from_arrays([names.take(pa.array(query[by])), batch.column(0).take(pa.array(row[by])), pa.array(distance[by])], ["q", "i", "distance"])

            wanted = rows if whole else rows.where(F.col("list_id").isin(np.flatnonzero(probed.any(0)).tolist()))
            return knn.shared_out(wanted, len(qs)).mapInArrow(search, f"q {qtype}, i {itype}, distance double")

        found = knn.in_rounds(q, 8 * centers.shape[1], knn.SENT_BYTES, k, scan)
        return found.select(F.col("q").alias(query_id), F.col("i").alias(self.id_col), "distance", "rank")

    def stats(self) -> DataFrame:
        """(list_id, n)"""
        return self.rows.groupBy("list_id").agg(F.count("*").alias("n"))
