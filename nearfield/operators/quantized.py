"""Approximate search over rotated, scalar-quantized codes with an exact second look."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators import knn
from nearfield.operators.graph import GraphIndex
from nearfield.session import ship


@lru_cache(8)
def gaussian_levels(bits: int) -> np.ndarray:
    """The values that represent a standard normal variable best in squared error with 2**bits codes (Lloyd's algorithm)."""
    x = np.linspace(-6, 6, 24001)
    p = np.exp(-x * x / 2)
    level = np.linspace(-2, 2, 1 << bits) if bits > 1 else np.array([-0.8, 0.8])
    for _ in range(400):
        of = np.searchsorted((level[1:] + level[:-1]) / 2, x)
        level = np.bincount(of, p * x, len(level)) / np.bincount(of, p, len(level))
    return level


@lru_cache(4)
def rotation(dims: int, seed: int = 0) -> np.ndarray:
    """An orthogonal matrix that spreads every vector's length over all coordinates."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


@dataclass(frozen=True)
class Codebook:
    """How vectors become codes: each coordinate of the vector, turned and brought to length sqrt(dims), is shifted and scaled and takes the nearest level."""

    dims: int
    bits: int
    seed: int = 0
    shift: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    renorm: bool = False

    def turned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = np.sqrt((x * x).sum(1))
        return x @ rotation(self.dims, self.seed) * (np.sqrt(self.dims) / np.where(length > 0, length, 1))[:, None], length

    def encode(self, x: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Packed codes and the lengths to decode them with."""
        y, length = self.turned(x)
        y = (y - np.array(self.shift)) / np.array(self.scale) if self.shift else y
        level = gaussian_levels(self.bits)
        code = np.searchsorted((level[1:] + level[:-1]) / 2, y).astype(np.uint8)
        per = 8 // self.bits
        padded = np.pad(code, ((0, 0), (0, -self.dims % per))).reshape(len(x), -1, per)
        packed = (padded << (np.arange(per) * self.bits).astype(np.uint8)).sum(2).astype(np.uint8)
        raw = [r.tobytes() for r in packed]
        if self.renorm:  # so that a decoded vector is as long as its own
            own = np.sqrt((self.levels(raw) ** 2).sum(1))
            length = length * np.sqrt(self.dims) / np.where(own > 0, own, 1)
        return raw, length.astype(np.float32)

    def levels(self, raw: list[bytes]) -> np.ndarray:
        """Turned coordinates that the codes stand for."""
        per = 8 // self.bits
        packed = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1) if raw else np.zeros((0, -(-self.dims // per)), np.uint8)
        code = (packed[:, :, None] >> (np.arange(per) * self.bits).astype(np.uint8)) & ((1 << self.bits) - 1)
        y = gaussian_levels(self.bits)[code.reshape(len(raw), -1)[:, : self.dims]]
        return y * np.array(self.scale) + np.array(self.shift) if self.shift else y

    def off(self, x: np.ndarray, raw: list[bytes], scale: np.ndarray, metric: str) -> np.ndarray:
        """How far each vector is at most from what its code stands for: in L1 for l1, between directions for cosine, else in L2."""
        s = scale.astype(np.float64)
        if metric == "l1":
            e, size = np.abs(x - self.decode(raw, s)).sum(1), np.abs(x).sum(1)
        else:
            y, length = self.turned(x)
            if metric == "cosine":
                length = s = np.ones(len(x))
            e, size = np.sqrt(((y * length[:, None] - self.levels(raw) * s[:, None]) ** 2).sum(1) / self.dims), length
        return np.nextafter((e + 1e-9 * (e + size)).astype(np.float32), np.float32(np.inf))

    def decode(self, raw: list[bytes], length: np.ndarray) -> np.ndarray:
        """The vectors that the codes stand for."""
        return (self.levels(raw) * (length / np.sqrt(self.dims))[:, None]) @ rotation(self.dims, self.seed).T


def correction(rows: DataFrame, vec_col: str, book: Codebook) -> Codebook:
    """The codebook with each turned coordinate's mean and standard deviation over all rows, from sums of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = book.turned(knn.vectors(b.column(0), book.dims))[0]
            yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int64()), pa.array([y.sum(0)]), pa.array([(y * y).sum(0)])], ["n", "s", "q"])

    got = rows.select(vec_col).mapInArrow(run, "n bigint, s array<double>, q array<double>")
    n = got.agg(F.sum("n")).first()[0] or 0
    if n < 2:
        return book
    by = got.select(F.posexplode(F.arrays_zip("s", "q")).alias("k", "x")).groupBy("k").agg(F.sum("x.s").alias("s"), F.sum("x.q").alias("q")).orderBy("k").collect()
    mean = np.array([r["s"] for r in by]) / n
    spread = np.sqrt(np.maximum((np.array([r["q"] for r in by]) - n * mean**2) / (n - 1), 0))
    return replace(book, shift=tuple(mean.tolist()), scale=tuple(np.where(spread > 0, spread, 1).tolist()))


def psquare(values: Sequence[float], p: float) -> float | None:
    """The p-quantile as the P-square algorithm of Jain and Chlamtac estimates it, with five markers and no sorting; exact under five values."""
    if not 0 <= p <= 1:
        raise ValueError("the quantile must lie between 0 and 1")
    values = [float(x) for x in values]
    if len(values) < 5:
        return sorted(values)[round(p * (len(values) - 1))] if values else None
    height, place = sorted(values[:5]), [1.0, 2.0, 3.0, 4.0, 5.0]
    want, step = [1, 1 + 2 * p, 1 + 4 * p, 3 + 2 * p, 5], [0, p / 2, p, (1 + p) / 2, 1]
    for x in values[5:]:
        height[0], height[4] = min(height[0], x), max(height[4], x)
        cell = next((k for k in range(3) if x < height[k + 1]), 3)
        place = [n + (k > cell) for k, n in enumerate(place)]
        want = [w + s for w, s in zip(want, step, strict=True)]
        for k in (1, 2, 3):
            off = want[k] - place[k]
            if (off >= 1 and place[k + 1] - place[k] > 1) or (off <= -1 and place[k - 1] - place[k] < -1):
                d = 1 if off > 0 else -1
                left, right = place[k] - place[k - 1], place[k + 1] - place[k]
                curve = height[k] + d / (place[k + 1] - place[k - 1]) * ((left + d) * (height[k + 1] - height[k]) / right + (right - d) * (height[k] - height[k - 1]) / left)
                if not height[k - 1] < curve < height[k + 1]:
                    curve = height[k] + d * (height[k + d] - height[k]) / (place[k + d] - place[k])
                height[k], place[k] = curve, place[k] + d
    return height[2]


def psquare_estimate(values: Column, p: float) -> Column:
    """psquare() of each array; NULL for a NULL or empty one."""
    ship(SparkSession.active())

    @F.pandas_udf("double")
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda x: None if x is None else psquare(x, p))

    return run(values)


@dataclass(frozen=True)
class QuantizedIndex:
    """codes (id, code, scale, off): one code of `bits` bits a coordinate of the rotated vector, the vector's length, and a bound of how far the vector is from what its code stands for."""

    rows: DataFrame
    codes: DataFrame
    book: Codebook
    metric: str = "l2"
    id_col: str = "vec_id"
    vec_col: str = "embedding"

    @classmethod
    def build(cls, df: DataFrame, dims: int, bits: int = 4, metric: str = "l2", id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 0, corrected: bool = False, renorm: bool = False) -> QuantizedIndex:
        """NULL vectors, and zero vectors for cosine, aren't indexed.

        corrected: codes are of coordinates with their own mean and deviation taken
        out, for cosine and ip; renorm: decoded vectors have their own length.
        """
        if bits not in (1, 2, 4):
            raise ValueError("bits must be 1, 2 or 4")
        if metric not in ("l2", "ip", "cosine", "l1"):
            raise ValueError(f"quantized codes don't support {metric}")
        if corrected and metric not in ("ip", "cosine"):
            raise ValueError("only cosine and ip can be corrected")
        ship(df.sparkSession)
        out = cls(df, df, Codebook(dims, bits, seed, renorm=renorm), metric, id_col, vec_col)
        rows = out.usable(df)
        book = correction(rows, vec_col, out.book) if corrected else out.book
        out = replace(out, rows=rows, book=book)
        return replace(out, codes=out.encoded(rows))

    def usable(self, df: DataFrame) -> DataFrame:
        rows = df.where(F.col(self.vec_col).isNotNull())
        return rows.where(F.exists(self.vec_col, lambda x: x != 0)) if self.metric == "cosine" else rows

    def encoded(self, rows: DataFrame) -> DataFrame:
        book, metric = self.book, self.metric

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = knn.vectors(b.column(1), book.dims)
                raw, length = book.encode(x)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array(length), pa.array(book.off(x, raw, length, metric))], ["id", "code", "scale", "off"])

        kind = rows.schema[self.id_col].dataType.simpleString()
        return rows.select(F.col(self.id_col).alias("id"), self.vec_col).mapInArrow(encode, f"id {kind}, code binary, scale float, off float")

    def write(self, path: str) -> QuantizedIndex:
        """Store codes, rows and codebook; the index that is read from there."""
        spark, b = self.rows.sparkSession, self.book
        self.codes.write.mode("overwrite").parquet(f"{path}/codes")
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        own = [(b.dims, b.bits, b.seed, list(b.shift), list(b.scale), b.renorm, self.metric, self.id_col, self.vec_col)]
        spark.createDataFrame(own, "dims int, bits int, seed int, shift array<double>, scale array<double>, renorm boolean, metric string, id_col string, vec_col string").write.mode("overwrite").parquet(f"{path}/book")
        return QuantizedIndex.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> QuantizedIndex:
        r = spark.read.parquet(f"{path}/book").first()
        book = Codebook(r["dims"], r["bits"], r["seed"], tuple(r["shift"]), tuple(r["scale"]), r["renorm"])
        return cls(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/codes"), book, r["metric"], r["id_col"], r["vec_col"])

    def coarse(self, query: Sequence[float], n: int, codes: DataFrame | None = None) -> DataFrame:
        """(id, coarse) of the n least estimated distances; every task keeps n."""
        q, book, metric = np.asarray(query, np.float64), self.book, self.metric
        norm, turned = float(np.sqrt(q @ q)), q @ rotation(book.dims, book.seed)
        codes = self.codes if codes is None else codes

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                raw, s = b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                if metric == "l1":  # decoded and turned back
                    d = np.abs(book.decode(raw, s) - q).sum(1)
                else:
                    dot = book.levels(raw) @ turned / np.sqrt(book.dims)
                    d = -s * dot if metric == "ip" else np.maximum(0, norm * norm + s * s - 2 * s * dot) if metric == "l2" else 1 - dot / (norm or 1)
                keep = np.argsort(d, kind="stable")[:n]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array(d[keep])], ["id", "coarse"])

        kind = self.codes.schema["id"].dataType.simpleString()
        return codes.mapInArrow(scan, f"id {kind}, coarse double").orderBy("coarse", "id").limit(n)

    def least(self, query: Sequence[float], codes: DataFrame) -> DataFrame:
        """(id, least) of all codes: the least distance that the vector may have. The triangle inequality gives it, for ip and cosine that of Cauchy and Schwarz."""
        q, book, metric = np.asarray(query, np.float64), self.book, self.metric
        norm, turned = float(np.sqrt(q @ q)), q @ rotation(book.dims, book.seed)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                raw, s, off = b.column(1).to_pylist(), *(b.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in (2, 3))
                if metric == "l1":
                    d, size = np.abs(book.decode(raw, s) - q).sum(1) - off, np.abs(q).sum()
                elif metric == "l2":
                    d, size = np.sqrt(((book.levels(raw) * (s / np.sqrt(book.dims))[:, None] - turned) ** 2).sum(1)) - off, norm
                else:
                    dot, far = book.levels(raw) @ turned / np.sqrt(book.dims), off * norm
                    d, size = (-s * dot - far, norm * s) if metric == "ip" else (1 - (dot + far) / (norm or np.nan), 1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d - 1e-9 * (np.abs(d) + off + size))], ["id", "least"])

        kind = self.codes.schema["id"].dataType.simpleString()
        return codes.mapInArrow(scan, f"id {kind}, least double")

    def search(self, query: Sequence[float], k: int, oversampling: int = 4, where: Column | None = None, rescore: bool = True) -> DataFrame:
        """The k nearest rows. where filters before the scan.

        oversampling * k candidates by their codes are measured first; then all
        rows whose codes don't exclude that they are as near as the k-th of these,
        so that the result is exact. Without rescore, the k least estimates.
        """
        rows, codes = self.rows, self.codes
        if where is not None:
            rows = rows.where(where)
            codes = codes.join(rows.select(F.col(self.id_col).alias("id")), "id", "left_semi")
        near = self.coarse(query, k * oversampling if rescore else k, codes)
        found = rows.join(F.broadcast(near), rows[self.id_col] == near["id"]).drop("id")
        if not rescore:
            return found.withColumnRenamed("coarse", "distance").orderBy("distance", self.id_col).limit(k)
        distance = knn.METRICS[self.metric](F.col(self.vec_col), knn.literal(query))
        first = knn.nearest(found, distance, k, self.id_col).agg(F.max("distance").alias("__kth"), F.count("*").alias("__n"))
        kth = first.select(F.coalesce(F.when(F.col("__n") >= k, F.col("__kth")), F.lit(float("inf"))).alias("__kth"))
        may = self.least(query, codes).join(F.broadcast(kth), ~(F.col("least") > F.col("__kth") + 1e-9)).select(F.col("id").alias("__id")).distinct()
        return knn.nearest(rows.join(may, F.col(self.id_col) == F.col("__id"), "left_semi"), distance, k, self.id_col)

    def search_stats(self, query: Sequence[float], k: int, oversampling: int = 4, where: Column | None = None) -> DataFrame:
        """(scanned, candidates, rescored, found, requested_k) of such a search."""
        live = self.rows if where is None else self.rows.where(where)
        near = self.coarse(query, k * oversampling, self.codes.join(live.select(F.col(self.id_col).alias("id")), "id", "left_semi"))
        counts = near.agg(F.count("*").alias("candidates")).crossJoin(live.agg(F.count("*").alias("scanned")))
        return counts.select("scanned", "candidates", F.col("candidates").alias("rescored"), F.least("candidates", F.lit(k)).cast("bigint").alias("found"), F.lit(k).alias("requested_k"))

    def graph(self, **options: int) -> GraphIndex:
        """Graphs over what the codes stand for; what a walk finds is measured exactly on the rows."""
        book, names = self.book, [self.id_col, self.vec_col]

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = book.decode(b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False).astype(np.float64))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], names)

        kind = self.codes.schema["id"].dataType.simpleString()
        decoded = self.codes.mapInArrow(decode, f"`{self.id_col}` {kind}, `{self.vec_col}` array<float>")
        return replace(GraphIndex.build(decoded, self.metric, id_col=self.id_col, vec_col=self.vec_col, **options), rows=self.rows)

    def self_scores(self, weights: Sequence[float] | None = None) -> DataFrame:
        """(id, score): each code's weighted inner product with itself; weights are those of the turned coordinates, 1 / deviation squared if corrected."""
        book = self.book
        w = np.ones(book.dims) if not book.scale else 1 / np.array(book.scale) ** 2
        w = w if weights is None else np.asarray(weights, np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                y, s = book.levels(b.column(1).to_pylist()), b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s * s * (y * y * w).sum(1) / book.dims)], ["id", "score"])

        kind = self.codes.schema["id"].dataType.simpleString()
        return self.codes.mapInArrow(run, f"id {kind}, score double")

    def append(self, df: DataFrame) -> QuantizedIndex:
        rows = self.usable(df)
        return replace(self, rows=self.rows.unionByName(rows), codes=self.codes.unionByName(self.encoded(rows)))

    def delete(self, ids: DataFrame) -> QuantizedIndex:
        gone = ids.select(F.col(self.id_col).alias("id")).distinct()
        return replace(self, rows=self.rows.join(gone, self.rows[self.id_col] == gone["id"], "left_anti"), codes=self.codes.join(gone, "id", "left_anti"))

    def stats(self) -> DataFrame:
        """(n_codes, code_bytes, bits, dims)"""
        return self.codes.agg(F.count("*").alias("n_codes"), F.coalesce(F.sum(F.length("code")), F.lit(0)).alias("code_bytes"), F.lit(self.book.bits).alias("bits"), F.lit(self.book.dims).alias("dims"))
