"""Approximate search by proximity graphs: one hierarchical graph for each shard, results merged."""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nearfield.functions import bits
from nearfield.operators import knn
from nearfield.session import durable, ship


class Sparse:
    """Rows of sparse vectors over the indices that any of them has."""

    def __init__(self, n: int, of: np.ndarray, index: np.ndarray, value: np.ndarray, used: np.ndarray):
        self.n, self.of, self.index, self.value, self.used = n, of, index, value, used
        self.begin = np.searchsorted(of, np.arange(n + 1))
        self.square, self.total = np.bincount(of, value**2, n), np.bincount(of, np.abs(value), n)

    @classmethod
    def of_column(cls, column: pa.Array, unit: bool) -> Sparse:
        r = knn.SparseRows(column)
        used, index = np.unique(r.index, return_inverse=True)
        value = r.value / np.sqrt(r.square)[r.of] if unit else r.value
        return cls(r.n, r.of, index, value, used)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, k: object) -> Sparse | Query:
        if isinstance(k, (int, np.integer)):
            part = slice(self.begin[k], self.begin[k + 1])
            return Query(self.index[part], self.value[part], len(self.used))
        k = np.asarray(k)
        many = self.begin[k + 1] - self.begin[k]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.begin[k], many)
        return Sparse(len(k), np.repeat(np.arange(len(k)), many), self.index[at], self.value[at], self.used)

    def query(self, vector: dict[int, float], unit: bool) -> Query:
        """A query; what it has at indices that no row has is the same for all rows."""
        items = sorted(vector.items())
        index, value = np.array([i for i, _ in items], np.int64), np.array([x for _, x in items], np.float64)
        value = value / (np.sqrt((value**2).sum()) or 1) if unit else value
        at = np.minimum(np.searchsorted(self.used, index), max(len(self.used) - 1, 0))
        hit = self.used[at] == index if len(self.used) else np.zeros(len(index), bool)
        return Query(at[hit], value[hit], len(self.used))

    def measure(self, q: Query, metric: str) -> np.ndarray:
        own = q.dense[self.index]
        if metric == "l1":
            return self.total + q.total + np.bincount(self.of, np.abs(self.value - own) - np.abs(self.value) - np.abs(own), self.n)
        ip = np.bincount(self.of, self.value * own, self.n)
        return -ip if metric in ("ip", "cosine") else self.square + q.square - 2 * ip


class Query:
    def __init__(self, index: np.ndarray, value: np.ndarray, width: int):
        self.dense = np.zeros(width)
        self.dense[index] = value
        self.square, self.total = float((value**2).sum()), float(np.abs(value).sum())


def measure(x: np.ndarray | Sparse, q: np.ndarray | Query, metric: str) -> np.ndarray:
    """Distances that order as the metric's, of rows to one query."""
    if isinstance(x, Sparse):
        return x.measure(q, metric)
    if metric == "jaccard":
        both, either = np.minimum(x, q).sum(-1), np.maximum(x, q).sum(-1)
        return np.where(both > 0, 1 - both / np.maximum(either, 1), 1.0)
    if metric in ("l1", "hamming"):
        return np.abs(x - q).sum(-1)
    if metric in ("ip", "cosine"):
        return -(x @ q)
    return ((x - q) ** 2).sum(-1)


class Graph:
    """A navigable small world of several layers; equal vectors share a node."""

    def __init__(self, metric: str, m: int = 16, ef_construction: int = 64, seed: int = 0):
        if not 2 <= m <= 100 or ef_construction < 2 * m:
            raise ValueError("m must lie between 2 and 100 and ef_construction be at least 2 * m")
        self.metric, self.m, self.ef = metric, m, ef_construction
        self.links: list[list[list[int]]] = []  # for each node, for each of its layers
        self.entry, self.seed = -1, seed

    def fill(self, x: np.ndarray) -> Graph:
        self.x = x
        rng = np.random.default_rng(self.seed)
        levels = np.minimum(np.floor(-np.log(1 - rng.random(len(x))) / np.log(self.m)).astype(int), 16)
        for k, level in enumerate(levels):
            self.insert(k, int(level))
        return self

    def insert(self, node: int, level: int) -> None:
        self.links.append([[] for _ in range(level + 1)])
        if self.entry < 0:
            self.entry = node
            return
        q, top = self.x[node], len(self.links[self.entry]) - 1
        near = [(float(measure(self.x[[self.entry]], q, self.metric)[0]), self.entry)]
        for layer in range(top, level, -1):
            near = self.layer(q, near, 1, layer)
        for layer in range(min(top, level), -1, -1):
            near = self.layer(q, near, self.ef, layer)
            most = self.m * 2 if layer == 0 else self.m
            mine = self.links[node][layer] = self.chosen(near, self.m)
            for other in mine:
                theirs = self.links[other][layer]
                theirs.append(node)
                if len(theirs) > most:
                    d = measure(self.x[theirs], self.x[other], self.metric)
                    self.links[other][layer] = self.chosen(sorted(zip(d.tolist(), theirs, strict=True)), most)
        if level > top:
            self.entry = node

    def chosen(self, near: list[tuple[float, int]], n: int) -> list[int]:
        """Neighbours that lie closer to the node than to one another; then the nearest of the rest."""
        x = self.x[[e for _, e in near]]
        plain = isinstance(x, Sparse) or self.metric == "l1" or (self.metric in ("hamming", "jaccard") and not ((x == 0) | (x == 1)).all())
        apart = (np.stack([measure(x, x[k], self.metric) for k in range(len(x))]) if plain else self.apart(x)).tolist()
        kept: list[int] = []
        rest: list[int] = []
        for k, (d, _) in enumerate(near):
            if len(kept) >= n:
                break
            own = apart[k]
            (kept if all(own[o] > d for o in kept) else rest).append(k)
        return [near[k][1] for k in kept + rest[: n - len(kept)]]

    def apart(self, x: np.ndarray) -> np.ndarray:
        """Distances of all rows to one another; for hamming and jaccard of zeros and ones."""
        ip = x @ x.T
        if self.metric in ("ip", "cosine"):
            return -ip
        square = np.diag(ip)
        if self.metric == "jaccard":
            return np.where(ip > 0, 1 - ip / np.maximum(square[:, None] + square[None, :] - ip, 1), 1.0)
        return square[:, None] + square[None, :] - 2 * ip

    def layer(self, q: np.ndarray, entries: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ef nearest nodes of a layer that a best-first walk finds, nearest first."""
        seen = {e for _, e in entries}
        todo = list(entries)
        heapq.heapify(todo)
        best = [(-d, e) for d, e in entries]
        heapq.heapify(best)
        while todo:
            d, e = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            new = [o for o in self.links[e][layer] if o not in seen] if layer < len(self.links[e]) else []
            if not new:
                continue
            seen.update(new)
            for dist, o in zip(measure(self.x[new], q, self.metric).tolist(), new, strict=True):
                if len(best) < ef or dist < -best[0][0]:
                    heapq.heappush(todo, (dist, o))
                    heapq.heappush(best, (-dist, o))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, e) for d, e in best)

    def search(self, q: np.ndarray, ef: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        near = [(float(measure(self.x[[self.entry]], q, self.metric)[0]), self.entry)]
        for layer in range(len(self.links[self.entry]) - 1, 0, -1):
            near = self.layer(q, near, 1, layer)
        return self.layer(q, near, ef, 0)


def kind(df: DataFrame, vec_col: str) -> str:
    """dense, sparse or bits, by the column's type."""
    t = df.schema[vec_col].dataType
    return "dense" if not isinstance(t, StructType) else "sparse" if "indices" in t.names else "bits"


def packed(graph: Graph, members: list[list[int]]) -> bytes:
    """A shard's graph as plain arrays."""
    arrays = {
        "levels": np.array([len(x) for x in graph.links], np.int32),
        "sizes": np.array([len(y) for x in graph.links for y in x], np.int32),
        "links": np.array([o for x in graph.links for y in x for o in y], np.int32),
        "entry": np.array([graph.entry], np.int32),
        "many": np.array([len(m) for m in members], np.int32),
        "members": np.array([r for m in members for r in m], np.int32),
    }
    if isinstance(graph.x, Sparse):
        arrays |= {"of": graph.x.of.astype(np.int32), "index": graph.x.index.astype(np.int32), "value": graph.x.value.astype(np.float32), "used": graph.x.used}
    else:
        arrays["x"] = graph.x.astype(np.float32)
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes, metric: str) -> tuple[Graph, list[list[int]]]:
    with np.load(io.BytesIO(data), allow_pickle=False) as a:
        a = dict(a)
    graph = Graph(metric)
    links, sizes, at, k = a["links"].tolist(), a["sizes"].tolist(), 0, 0
    for layers in a["levels"].tolist():
        own = []
        for size in sizes[k : k + layers]:
            own.append(links[at : at + size])
            at += size
        graph.links.append(own)
        k += layers
    graph.entry = int(a["entry"][0])
    if "x" in a:
        graph.x = a["x"].astype(np.float64)
    else:
        graph.x = Sparse(len(a["levels"]), a["of"].astype(np.int64), a["index"].astype(np.int64), a["value"].astype(np.float64), a["used"])
    ends = np.cumsum(a["many"])
    return graph, [a["members"][e - n : e].tolist() for e, n in zip(ends.tolist(), a["many"].tolist(), strict=True)]


#: Numbers that the vectors of a shard hold at most, unless one vector has more.
SHARD_NUMBERS = 32 << 20


@dataclass(frozen=True)
class GraphIndex:
    """graphs (shard, graph, ids): one row for each shard of about shard_rows vectors."""

    rows: DataFrame
    graphs: DataFrame
    metric: str
    id_col: str
    vec_col: str
    m: int = 16
    ef_construction: int = 64

    @classmethod
    def build(cls, df: DataFrame, metric: str = "l2", m: int = 16, ef_construction: int = 64, shard_rows: int = 20_000, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 0) -> GraphIndex:
        """Graphs over dense, sparse or bit vectors, by l2, ip, cosine or l1, and hamming or jaccard for bits.

        NULL vectors, and zero vectors for cosine, aren't indexed. Shards are built side
        by side; their number grows with the data, in rows and in numbers.
        """
        Graph(metric, m, ef_construction)
        ship(df.sparkSession)
        kind_of = kind(df, vec_col)
        rows = df.where(F.col(vec_col).isNotNull())
        values = F.col(f"{vec_col}.values") if kind_of == "sparse" else F.col(vec_col)
        rows = rows.where(F.exists(values, lambda x: x != 0)) if metric == "cosine" else rows
        n, numbers = rows.agg(F.count("*"), F.sum(F.size(values if kind_of != "bits" else f"{vec_col}.words"))).first()
        shards = max(1, -(-n // shard_rows), -(-int(numbers or 0) * (64 if kind_of == "bits" else 1) // SHARD_NUMBERS))
        itype, unit = rows.schema[id_col].dataType.simpleString(), metric == "cosine"

        def make(table: pa.Table) -> pa.Table:
            table = table.sort_by("id")
            column = table["v"].combine_chunks()
            if kind_of == "sparse":
                x = Sparse.of_column(column, unit)
                rows_of: dict[bytes, list[int]] = {}
                for k in range(len(x)):
                    part = slice(x.begin[k], x.begin[k + 1])
                    rows_of.setdefault(x.index[part].tobytes() + x.value[part].tobytes(), []).append(k)
                groups = list(rows_of.values())
            else:
                x = knn.vectors(column)
                x = x / np.sqrt((x * x).sum(1, keepdims=True)) if unit else x
                of = np.unique(x, axis=0, return_inverse=True)[1]
                by = np.argsort(of, kind="stable")
                groups = [g.tolist() for g in np.split(by, np.flatnonzero(np.diff(of[by])) + 1)]
            order = np.random.default_rng(seed).permutation(len(groups))
            members = [groups[k] for k in order]
            graph = Graph(metric, m, ef_construction, seed).fill(x[[g[0] for g in members]])
            return pa.table({"shard": table["shard"][:1], "graph": pa.array([packed(graph, members)], pa.binary()), "ids": pa.array([table["id"].to_pylist()])})

        keyed = rows.select(F.pmod(F.xxhash64(id_col), F.lit(shards)).alias("shard"), F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
        keyed = keyed.repartition(min(shards, 16 * df.sparkSession.sparkContext.defaultParallelism), "shard")  # a small shuffle isn't put into few tasks
        graphs = durable(keyed.groupBy("shard").applyInArrow(make, f"shard bigint, graph binary, ids array<{itype}>"), "graphs")
        return cls(rows, graphs, metric, id_col, vec_col, m, ef_construction)

    def append(self, df: DataFrame) -> GraphIndex:
        """New rows, as shards of their own beside those there are; vacuum() joins them."""
        new = GraphIndex.build(df, self.metric, self.m, self.ef_construction, id_col=self.id_col, vec_col=self.vec_col)
        return replace(self, rows=self.rows.unionByName(new.rows), graphs=self.graphs.unionByName(new.graphs))

    def vacuum(self, threshold: int = 25, shard_rows: int = 20_000) -> GraphIndex:
        """Built anew once `threshold` percent of the nodes' rows are dead, or shards are less than half full on average; else as it is."""
        live = self.rows.count()
        shards, held = self.graphs.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
        if (held - live) * 100 < held * threshold and shards <= max(1, 2 * -(-held // shard_rows)):
            return self
        return GraphIndex.build(self.rows, self.metric, self.m, self.ef_construction, shard_rows, self.id_col, self.vec_col)

    def stored(self, path: str) -> GraphIndex:
        """The index with its graphs written to path."""
        self.graphs.write.mode("overwrite").parquet(path)
        return replace(self, graphs=self.graphs.sparkSession.read.parquet(path))

    def search_many(self, queries: Sequence[tuple[object, Sequence[float] | dict[int, float]]], k: int, ef_search: int = 40) -> DataFrame:
        """(query_id, id, distance, rank): each shard's ef_search nearest, merged, measured exactly.

        Sparse queries are given as numbers by index, bit strings as zeros and ones.
        """
        names, metric = [n for n, _ in queries], self.metric
        itype, vtype = self.rows.schema[self.id_col].dataType.simpleString(), self.rows.schema[self.vec_col].dataType.simpleString()
        qtype, kind_of = "bigint" if all(isinstance(n, int) for n in names) else "string", kind(self.rows, self.vec_col)
        vectors = [v for _, v in queries]

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for raw, ids in zip(b.column(0), b.column(1), strict=True):
                    graph, members = unpacked(raw.as_py(), metric)
                    own = [graph.x.query(v, metric == "cosine") if kind_of == "sparse" else np.asarray(v, np.float64) for v in vectors]
                    found = [(n, row) for n, q in zip(names, own, strict=True) for _, node in graph.search(q, max(k, ef_search)) for row in members[node]]
                    columns = list(zip(*found, strict=True)) or [(), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64() if qtype == "bigint" else pa.string()), ids.values.take(pa.array(columns[1], pa.int64()))], ["query_id", "id"])

        near = self.graphs.select("graph", "ids").mapInArrow(find, f"query_id {qtype}, id {itype}")
        spark = self.rows.sparkSession
        if kind_of == "sparse":
            dim = (self.rows.select(F.col(f"{self.vec_col}.dim")).first() or [1])[0]
            given = [(n, (dim, sorted(v), [float(v[i]) for i in sorted(v)])) for n, v in queries]
            sent = spark.createDataFrame(given, f"__n {qtype}, __q {vtype}")
        else:
            sent = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in queries], f"__n {qtype}, __q array<double>")
            sent = sent.withColumn("__q", bits.packed(F.transform("__q", lambda x: x > 0))) if kind_of == "bits" else sent
        pairs = near.join(F.broadcast(sent), near["query_id"] == F.col("__n")).join(self.rows.select(F.col(self.id_col).alias("id"), F.col(self.vec_col).alias("__v")), "id")
        v, q = F.col("__v"), F.col("__q")
        if metric == "jaccard" and kind_of == "dense":
            total = lambda f: F.aggregate(F.zip_with(v, q, lambda x, y: f(x.cast("double"), y)), F.lit(0.0), lambda s, x: s + x)
            both = total(F.least)
            distance: Column = F.when(both > 0, 1 - both / total(F.greatest)).otherwise(1.0)
        else:
            name = f"sparse_{metric}" if kind_of == "sparse" else "l1" if metric == "hamming" and kind_of == "dense" else metric
            distance = knn.METRICS[name](v, q)
        measured = pairs.select("query_id", F.col("id").alias(self.id_col), F.round(distance, 9).alias("distance"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), self.id_col))
        return measured.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)

    def search(self, query: Sequence[float] | dict[int, float], k: int, ef_search: int = 40, where: Column | None = None, max_scan: int = 20_000) -> DataFrame:
        """The k nearest rows, always in strict order of distance; with where, ef_search doubles until k rows pass or max_scan are looked at.

        Fewer than k rows then mean that max_scan ended the search.
        """
        ef = ef_search
        while True:
            near = self.search_many([(0, query)], max(k, ef), ef).select(self.id_col, "distance")
            found = self.rows.join(F.broadcast(near), self.id_col)
            found = found if where is None else found.where(where)
            out = found.orderBy("distance", self.id_col).limit(k)
            if where is None or ef >= max_scan or out.count() >= k:  # each round looks at twice as many
                return out
            ef *= 2

    def delete(self, ids: DataFrame) -> GraphIndex:
        """Dead rows are found no more; their nodes stay until the next build."""
        return replace(self, rows=self.rows.join(ids.select(self.id_col).distinct(), self.id_col, "left_anti"))

    def stats(self) -> DataFrame:
        """(shard, n_rows, graph_bytes)"""
        return self.graphs.select("shard", F.size("ids").alias("n_rows"), F.length("graph").alias("graph_bytes"))
