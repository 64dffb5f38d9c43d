"""Language-model scoring: a byte n-gram trie in Elias-Fano levels."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.eliasfano import EliasFano
from nearfield.llm.kernels import U, mapped, mix, publish, slices, to_bytes
from nearfield.session import quoted, ship

ORDER = 5
#: Counts that a task gathers before it sums them up.
GATHER = 1 << 22
CODES = 256
#: Slots of a worker's table of scores already looked up.
CACHE_BITS = 21


def grams(texts: list, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the texts (UTF-8), it and the order - 1 bytes before it as one integer, zeros before the start; bounds."""
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    gap = b"\0" * (order - 1)
    joined = np.frombuffer(gap + gap.join(parts), np.uint8)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(bounds[-1]) + np.repeat((np.arange(len(parts)) + 1) * (order - 1), lengths)
    key = np.zeros(len(joined), np.uint64)
    shifted = joined.astype(np.uint64)
    for k in range(order):
        key[k:] |= shifted[: len(joined) - k] << U(8 * k)
    return key[at], bounds


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts (each 1 if none are given)."""
    if counts is None:
        keys = np.sort(keys)
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[head], np.diff(np.concatenate([head, [len(keys)]]))
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts


def counted(docs: DataFrame, order: int = ORDER, text_col: str = "text") -> DataFrame:
    """(gram, n): how often each run of order bytes occurs over all documents, text starts padded with zeros."""
    ship(docs.sparkSession)
    if not 2 <= order <= 8:
        raise ValueError("order must lie between 2 and 8: that many bytes fit a key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0
        for _, texts in slices(batches, 1 << 20):
            k, n = summed(grams(texts, order)[0])
            keys.append(k)
            counts.append(n)
            size += len(k)
            if size > GATHER:
                k, n = summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, size = [k], [n], 0 if len(k) < GATHER // 2 else len(k)
                if len(k) >= GATHER // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["gram", "n"])
                    keys, counts, size = [], [], 0
        if keys:
            k, n = summed(np.concatenate(keys), np.concatenate(counts))
            for a in range(0, len(k), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(k[a : a + (1 << 16)].view(np.int64)), pa.array(n[a : a + (1 << 16)])], ["gram", "n"])

    source = docs.select(F.lit(0).cast("bigint").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return source.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def kneser_ney(keys: np.ndarray, counts: np.ndarray, order: int) -> list[dict[str, np.ndarray]]:
    """Interpolated Kneser-Ney levels from the counts of the longest n-grams, of which 0, the start of all texts, must be one.

    Level k has, ascending, its k-byte keys, log2 probabilities and log2 weights of
    the shorter context after them (0 for those that are no context). Counts below
    the highest level are of distinct bytes before an n-gram.
    """
    levels = [{"key": keys, "n": counts}]
    for k in range(order - 1, 0, -1):
        mask = U((1 << (8 * k)) - 1)
        tail, n = summed(levels[0]["key"] & mask)
        levels.insert(0, {"key": tail, "n": n})
    below_p = None
    for k, level in enumerate(levels, 1):
        key, n = level["key"], level["n"].astype(np.float64)
        once, twice = float((level["n"] == 1).sum()), float((level["n"] == 2).sum())
        discount = once / (once + 2 * twice) if once and twice else 0.5
        context = key >> U(8)
        head = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        of = np.cumsum(np.concatenate([[0], context[1:] != context[:-1]]))
        total, kinds = np.add.reduceat(n, head), np.diff(np.concatenate([head, [len(key)]]))
        gamma = discount * kinds / total
        if k == 1:
            below = np.full(len(key), 1 / 256)
        else:
            below = below_p[np.searchsorted(levels[k - 2]["key"], key & U((1 << (8 * (k - 1))) - 1))]
        level["p"] = (n - discount) / total[of] + gamma[of] * below
        below_p = level["p"]
        if k == 1:
            level["rest"] = float(gamma[0]) / 256
        else:
            up = levels[k - 2]
            up["back"] = np.ones(len(up["key"]))
            up["back"][np.searchsorted(up["key"], context[head])] = gamma
    levels[-1]["back"] = np.ones(len(keys))
    return levels


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight-bit codes of log2 values, in bins of equal width, and the bins' means."""
    v = np.log2(values)
    low, high = float(v.min()), float(v.max())
    code = np.minimum((v - low) * (CODES / max(high - low, 1e-9)), CODES - 1).astype(np.uint8)
    n = np.maximum(np.bincount(code, minlength=CODES), 1)
    return code, (np.bincount(code, v, CODES) / n).astype(np.float32)


class Trie:
    """n-grams by level; a node's children are the bytes that follow it.

    Level k holds for its nodes in order: the byte (level 1), or from level 2 on the
    byte's rank among the successors of the context without its first byte, made
    monotone by adding each parent's base; where each node's children begin; codes of
    probability and back-off weight. Bytes, ranks and pointers are Elias-Fano
    sequences; all arrays may be memory-mapped.
    """

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        self.order, self.rest = int(arrays["order"][0]), float(arrays["rest"][0])
        self.level = [self.sequence(f"level{k}") for k in range(1, self.order + 1)]
        self.pointer = [self.sequence(f"pointer{k}") for k in range(1, self.order)]

    def sequence(self, name: str) -> EliasFano:
        n, bits = map(int, self.a[f"{name}.shape"])
        return EliasFano(n, bits, self.a[f"{name}.low"], self.a[f"{name}.high"], self.a[f"{name}.samples"])

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, order: int) -> Trie:
        levels = kneser_ney(keys, counts, order)
        arrays = {"order": np.array([order]), "rest": np.array([levels[0]["rest"]])}

        def put(name: str, values: np.ndarray, universe: int) -> None:
            e = EliasFano.of(values, universe)
            arrays.update({f"{name}.shape": np.array([e.n, e.low_bits]), f"{name}.low": e.low, f"{name}.high": e.high, f"{name}.samples": e.samples})

        for k, level in enumerate(levels, 1):
            key = level["key"]
            if k == 1:
                put("level1", key, 257)
            else:
                up = levels[k - 2]["key"]
                parents = np.searchsorted(up, key >> U(8))
                first = np.searchsorted(key >> U(8), up)
                put(f"pointer{k - 1}", np.concatenate([first, [len(key)]]), len(key) + 1)
                rank = cls.ranks(levels, k, key)
                most = np.zeros(len(up), np.int64)
                np.maximum.at(most, parents, rank + 1)
                base = np.concatenate([[0], np.cumsum(most)])
                put(f"level{k}", rank + base[parents], int(base[-1]) + 1)
            arrays[f"p{k}"], arrays[f"p{k}.mean"] = quantised(level["p"])
            if k < order:
                arrays[f"back{k}"], arrays[f"back{k}.mean"] = quantised(level["back"])
        return cls(arrays)

    @staticmethod
    def ranks(levels: list[dict], k: int, key: np.ndarray) -> np.ndarray:
        """Rank of the last byte among the children of the context without its first byte."""
        if k == 2:
            return np.searchsorted(levels[0]["key"], key & U(255))
        shorter = levels[k - 2]["key"]
        tail = key & U((1 << (8 * (k - 1))) - 1)
        return np.searchsorted(shorter, tail) - np.searchsorted(shorter >> U(8), tail >> U(8))

    def child(self, k: int, parent: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Index in level k of the child of that rank of nodes of level k - 1, or -1: a successor search in its range."""
        begin, end = self.pointer[k - 2].get(parent), self.pointer[k - 2].get(parent + 1)
        out = np.full(len(parent), -1)
        some = np.flatnonzero(end > begin)
        begin, end, rank = begin[some], end[some], rank[some]
        seq = self.level[k - 1]
        # every range ends with its greatest rank, and the next one's base follows it
        base = np.where(begin > 0, seq.get(np.maximum(begin - 1, 0)) + 1, 0)
        want, lo, hi = rank + base, begin.copy(), end.copy()
        while (lo < hi).any():
            mid = (lo + hi) // 2
            less = seq.get(np.minimum(mid, seq.n - 1)) < want
            going = lo < hi
            lo, hi = np.where(going & less, mid + 1, lo), np.where(going & ~less, mid, hi)
        hit = (lo < end) & (seq.get(np.minimum(lo, seq.n - 1)) == want)
        out[some[hit]] = lo[hit]
        return out

    def nodes(self, gram: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length k the distinct k-byte runs of the n-grams and their places in level k, -1 for those not there."""
        out = []
        for k in range(1, self.order + 1):
            mask = U((1 << (8 * k)) - 1)
            key = np.unique(np.concatenate([(gram >> U(8 * s)) & mask for s in range(self.order - k + 1)]))
            place = np.full(len(key), -1)
            if k == 1:
                root = np.full(256, -1)
                root[self.level[0].all()] = np.arange(self.level[0].n)
                place = root[key.astype(np.int64)]
            else:
                shorter, known = out[-1]
                parent, tail = (known[np.searchsorted(shorter, x)] for x in (key >> U(8), key & (mask >> U(8))))
                both = np.flatnonzero((parent >= 0) & (tail >= 0))
                rank = tail[both]
                if k > 2:  # the tail's place among its parent's children
                    middle = out[-2][1][np.searchsorted(out[-2][0], (key[both] & (mask >> U(8))) >> U(8))]
                    rank = rank - self.pointer[k - 3].get(middle)
                if len(both):
                    place[both] = self.child(k, parent[both], rank)
            out.append((key, place))
        return out

    def log2p(self, gram: np.ndarray) -> np.ndarray:
        """log2 probability of each n-gram's last byte after the ones before it."""
        score = np.full(len(gram), np.log2(self.rest))
        found = self.nodes(gram)
        for k, (key, place) in enumerate(found, 1):
            node = place[np.searchsorted(key, gram & U((1 << (8 * k)) - 1))]
            weight = np.zeros(len(gram), np.float32)
            if k > 1:
                shorter, places = found[k - 2]
                context = places[np.searchsorted(shorter, (gram >> U(8)) & U((1 << (8 * (k - 1))) - 1))]
                weight = np.where(context >= 0, self.value("back", k - 1, np.maximum(context, 0)), 0)
            score = np.where(node >= 0, self.value("p", k, np.maximum(node, 0)), score + weight)
        return score

    def value(self, what: str, k: int, at: np.ndarray) -> np.ndarray:
        return self.a[f"{what}{k}.mean"][self.a[f"{what}{k}"][at]]

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in self.a.values())

    def to_bytes(self) -> bytes:
        return to_bytes(self.a)

    @classmethod
    def mapped(cls, path: str) -> Trie:
        """A trie whose levels stay in the file and are mapped into memory."""
        return cls(mapped(path))


def trained(docs: DataFrame, order: int = ORDER, text_col: str = "text") -> Trie | None:
    """The trie of all n-grams of all documents; None if there is no text."""
    table = counted(docs, order, text_col).toArrow()
    keys, counts = table["gram"].to_numpy().astype(np.int64).view(np.uint64), table["n"].to_numpy()
    if not len(keys):
        return None
    keys, counts = summed(np.concatenate([keys, np.zeros(1, np.uint64)]), np.concatenate([counts, [1]]))
    return Trie.build(keys, counts, order)


_scorers: dict[str, Scorer] = {}


class Scorer:
    """Scores of n-grams, those looked up before from a hashed table."""

    @classmethod
    def of(cls, name: str) -> Scorer:
        """The worker's scorer for a published file; one is kept from task to task."""
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = cls(Trie.mapped(os.path.join(SparkFiles.getRootDirectory(), name)))
        return _scorers[name]

    def __init__(self, trie: Trie, bits: int = CACHE_BITS):
        self.trie, self.bits = trie, bits
        self.key, self.score = np.full(1 << bits, ~U(0)), np.zeros(1 << bits, np.float32)

    def __call__(self, gram: np.ndarray) -> np.ndarray:
        slot = (mix(gram) >> U(64 - self.bits)).astype(np.int64)
        miss = np.flatnonzero(self.key[slot] != gram)
        out = self.score[slot]
        if len(miss):
            new, inverse = np.unique(gram[miss], return_inverse=True)
            found = np.concatenate([self.trie.log2p(new[a : a + 200_000]) for a in range(0, len(new), 200_000)]).astype(np.float32)
            out[miss] = found[inverse]
            at = (mix(new) >> U(64 - self.bits)).astype(np.int64)
            self.key[at], self.score[at] = new, found
            last = self.key[at] == new  # of those that share a slot only one stays
            self.score[at[last]] = found[last]
        return out


def scored(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, log2_probability, bits_per_byte) of every row of docs under the n-gram model of all of them.

    The model counts every run of `order` bytes of every whole text and smooths by
    interpolated Kneser-Ney; probabilities and back-off weights have 8-bit codes.
    bits_per_byte is null for texts without bytes; a null text counts as empty.
    Empty tables give no row. Repeated rows count and are scored each; a null doc_id
    stays null. Columns but id_col and text_col are not read; ids must be integers or
    cast to them. order lies between 2 and 8.

    The driver holds the distinct n-grams. Those of 5 bytes grow far slower than the
    corpus (README), as no context is longer than order - 1 bytes.
    """
    spark = docs.sparkSession
    ship(spark)
    trie, name = trained(docs, order, text_col), f"ngrams-{uuid.uuid4().hex}"
    if trie is not None:
        publish(spark, trie.to_bytes(), name)
    empty = trie is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = None if empty else Scorer.of(name)
        for ids, texts in slices(batches, 1 << 20):
            gram, bounds = grams(texts, order)
            total = np.zeros(len(ids))
            if len(gram):
                sums = np.concatenate([[0.0], np.cumsum(score(gram), dtype=np.float64)])
                total = sums[bounds[1:]] - sums[bounds[:-1]]
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n), pa.array(total), pa.array(-total / np.maximum(n, 1), mask=n == 0)],
                ["doc_id", "n_bytes", "log2_probability", "bits_per_byte"],
            )

    source = docs.select(F.col(quoted(id_col)).cast("bigint").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, n_bytes bigint, log2_probability double, bits_per_byte double")
