"""Packing documents into training sequences along a space-filling curve."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm import tokens
from nearfield.llm.kernels import U, map_text, sums, words
from nearfield.session import durable, release

SEQUENCE_TOKENS = 2048
DIMENSIONS = 3
GRID_BITS = 16
HASH_BITS = 14
#: Tokens of a stretch of the curve that one task packs, and the most stretches.
PART_TOKENS = 1 << 22
MOST_PARTS = 1 << 15
#: Documents a stretch whose keys are looked at to choose the stretches' bounds.
SAMPLED = 64


@lru_cache(4)
def directions(dimensions: int, seed: int = 10) -> np.ndarray:
    """A Gaussian direction for each hashed word."""
    return np.random.default_rng(seed).standard_normal((1 << HASH_BITS, dimensions)).astype(np.float32)


def unit_points(texts: list, dimensions: int) -> np.ndarray:
    """Each text's vector of hashed word counts, scaled to length 1, on the directions; the origin for texts without words."""
    h, bound = words(texts)
    bucket = (h >> U(64 - HASH_BITS)).astype(np.int64)
    v = sums(directions(dimensions)[bucket], bound)
    of = np.repeat(np.arange(len(texts)), np.diff(bound))
    cell, n = np.unique((of << HASH_BITS) | bucket, return_counts=True)
    square = np.bincount(cell >> HASH_BITS, n.astype(np.float64) ** 2, len(texts))
    return v / np.sqrt(np.maximum(square, 1))[:, None]


def projected(docs: DataFrame, dimensions: int = DIMENSIONS, tokenizer: str = tokens.TOKENIZER, end_of_document: int | None = tokens.END_OF_DOCUMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, v, ids): each document's unit_points, and its token ids in two little-endian bytes each, end_of_document last.

    Null and empty texts have no token at all and lie at the origin.
    """
    ranks = Path(tokenizer).read_bytes()
    if max(tokens.greatest_id(ranks), end_of_document or 0) >> 16:
        raise ValueError("ids don't fit in 2 bytes")
    tail = np.array([] if end_of_document is None else [end_of_document], "<u2")

    def run(ids: list, texts: list) -> pa.RecordBatch:
        encode = tokens.encoder(ranks)
        own = [np.concatenate([encode(t).astype("<u2"), tail]) if t else tail[:0] for t in texts]
        flat = pa.array(unit_points(texts, dimensions).ravel(), pa.float64())
        at = pa.array(np.arange(0, len(flat) + 1, dimensions), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.ListArray.from_arrays(at, flat), pa.array([x.tobytes() for x in own], pa.binary())], ["doc_id", "n_tokens", "v", "ids"]
        )

    return map_text(docs, run, "doc_id bigint, n_tokens bigint, v array<double>, ids binary", id_col, text_col)


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of grid points, rows of x, with so many bits in each dimension (Skilling's transform)."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def to_grid(v: np.ndarray, mean: np.ndarray, deviation: np.ndarray, bits: int) -> np.ndarray:
    """Grid cells of vectors; the logistic curve spreads standardised values evenly."""
    z = (v - mean) / np.where(deviation > 0, deviation, 1)
    return np.minimum((1 / (1 + np.exp(-1.702 * np.clip(z, -20, 20))) * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def scale_of(points: DataFrame, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the points in each dimension."""
    stats = points.agg(*[f(F.col("v")[k]).alias(f"{n}{k}") for k in range(dimensions) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return np.array([stats[f"m{k}"] or 0.0 for k in range(dimensions)]), np.array([stats[f"s{k}"] or 0.0 for k in range(dimensions)])


def part_of(key: np.ndarray, doc: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the bounds, ascending rows (key, doc), are at or before each (key, doc)."""
    n = len(bounds)
    order = np.lexsort((np.arange(n + len(key)) >= n, np.concatenate([bounds[:, 1], doc]), np.concatenate([bounds[:, 0], key])))
    out = np.empty(n + len(key), np.int64)
    out[order] = np.cumsum(order < n)
    return out[n:]


def keyed(points: DataFrame, scale: tuple[np.ndarray, np.ndarray], bounds: np.ndarray, dimensions: int, bits: int) -> DataFrame:
    """points with their place on the curve, key, and the stretch of it that they lie in, part, instead of v."""
    rest = [c for c in points.columns if c not in ("v", "doc_id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            key = hilbert(to_grid(v, *scale, bits), bits)
            part = part_of(key, b.column(1).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), bounds)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(key), *b.columns[1:]], ["part", "key", "doc_id", *rest])

    schema = "part int, key bigint, doc_id bigint, " + ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in rest)
    return points.select("v", "doc_id", *rest).mapInArrow(run, schema)


def bounds_of(small: DataFrame, total: int, n: int, part_tokens: int) -> np.ndarray:
    """Rows (key, doc) that cut the curve into stretches of about part_tokens tokens, from a sample of SAMPLED documents a stretch."""
    parts = min(MOST_PARTS, -(-total // part_tokens))
    if parts < 2:
        return np.zeros((0, 2), np.int64)
    share = min(1.0, SAMPLED * parts / n)
    some = small if share == 1 else small.where(F.pmod(F.xxhash64("doc_id", "key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = some.select("key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), "n_tokens").toArrow()
    if not got.num_rows:
        return np.zeros((0, 2), np.int64)
    key, doc, size = (got[c].to_numpy() for c in ("key", "doc", "n_tokens"))
    by = np.lexsort((doc, key))
    upto = np.cumsum(size[by])
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts))
    return np.stack([key[by][at], doc[by][at]], axis=1)


PIECE = "pack_id bigint, at bigint, doc_ids array<bigint>, begins array<bigint>, ends array<bigint>, ids binary"


def pieces(rows: DataFrame, base: dict[int, int], size: int) -> DataFrame:
    """Rows of PIECE from rows (part, doc_id, ids) in order: sequences, and at the ends of a stretch the parts of them that lie in it. base: each stretch's first place."""

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], [c.split()[0] for c in PIECE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, made = None, 0, []
        docs, begins, ends, chunks = [], [], [], []

        def close() -> None:
            nonlocal docs, begins, ends, chunks
            if docs:
                raw = b"".join(chunks)
                first = at - len(raw) // 2
                made.append((first // size, first, docs, begins, ends, raw))
            docs, begins, ends, chunks = [], [], [], []

        for b in batches:
            for own, doc, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own != part:
                    close()
                    part, at = own, base[own]
                n, done = len(raw) // 2, 0
                while done < n:
                    take = min(n - done, size - at % size)
                    docs.append(doc)
                    begins.append(done)
                    ends.append(done + take)
                    chunks.append(raw[2 * done : 2 * (done + take)])
                    done, at = done + take, at + take
                    if at % size == 0:
                        close()
                    if len(made) >= 1000:
                        yield batch_of(made)
                        made = []
        close()
        if made:
            yield batch_of(made)

    return rows.select("part", "doc_id", "ids").mapInArrow(run, PIECE)


def packed(
    docs: DataFrame, sequence_tokens: int = SEQUENCE_TOKENS, dimensions: int = DIMENSIONS, bits: int = GRID_BITS, part_tokens: int = PART_TOKENS, tokenizer: str = tokens.TOKENIZER, end_of_document: int | None = tokens.END_OF_DOCUMENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(pack_id, doc_ids, begins, ends, ids, n_docs, n_tokens): sequences of sequence_tokens token ids along the Hilbert curve.

    Documents are put in the order of (key, doc_id, number of tokens, token ids) and
    their token ids, end_of_document after each document, cut into sequences, of
    which only the last may be short. ids holds a sequence in two little-endian
    bytes a token; begins and ends give, for each of doc_ids, which of its tokens
    the sequence holds. The result doesn't depend on the partitioning: ties of the
    key go by the columns named, and rows equal in all of them are alike.

    Null and empty texts and empty tables have no token and are in no sequence; a
    text of blanks has its blanks' tokens. Very long texts fill as many sequences as
    they need. Repeated rows are packed as often as they come, a null doc_id as null
    before the others of its key. Columns but id_col and text_col are not read; ids
    must be integers or cast to them.

    Texts are encoded once, into a written table. A sample of keys cuts the curve
    into stretches of about part_tokens tokens, at (key, doc_id), so that equal texts
    don't all fall into one. One shuffle brings the ids of a stretch together; each
    stretch's share of tokens gives the next one's first place.
    """
    written = durable(projected(docs, dimensions, tokenizer, end_of_document, id_col, text_col), "points")
    points = written.where("n_tokens > 0")
    scale = scale_of(points, dimensions)
    none = np.zeros((0, 2), np.int64)
    small = durable(keyed(points.select("v", "doc_id", "n_tokens"), scale, none, dimensions, bits), "keys")
    n, total = small.agg(F.count("*"), F.sum("n_tokens")).first()
    bounds = bounds_of(small, int(total or 0), n, part_tokens)
    sizes = keyed(points.select("v", "doc_id", "n_tokens"), scale, bounds, dimensions, bits).groupBy("part").agg(F.sum("n_tokens"))
    base, before = {}, 0
    for part, size in sorted(tuple(r) for r in sizes.collect()):
        base[part], before = before, before + size
    rows = keyed(points, scale, bounds, dimensions, bits).repartitionById(len(bounds) + 1, F.col("part"))
    rows = rows.sortWithinPartitions("part", "key", "doc_id", "n_tokens", "ids")
    made = durable(pieces(rows, base, sequence_tokens), "pieces")
    release(written, small)
    whole = F.length("ids") == 2 * sequence_tokens
    names = ["doc_ids", "begins", "ends"]
    ends = made.where(~whole).groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("at", *names, "ids"))).alias("p"))
    joined = ends.select("pack_id", *[F.flatten(f"p.{c}").alias(c) for c in names], F.aggregate("p.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))
    out = made.where(whole).select("pack_id", *names, "ids").unionByName(joined)
    return out.select("*", F.size("doc_ids").cast("bigint").alias("n_docs"), (F.length("ids") / 2).cast("bigint").alias("n_tokens"))
