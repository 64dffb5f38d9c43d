"""Array kernels over batches of whole texts, used inside Arrow functions."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.session import quoted, shared_folder, ship

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
#: Characters handled at a time; one longer text makes a slice of its own.
SLICE_CHARS = 1 << 20


def map_text(df: DataFrame, fn: Callable[[list, list], pa.RecordBatch | None], schema: str, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """Apply fn(ids, texts) to slices of (id, text) rows; other columns are not read.

    fn gets Python lists, with None for nulls, and returns a record batch of the schema.
    """
    ship(df.sparkSession)
    source = df.select(F.col(quoted(id_col)).cast("bigint").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches, slice_chars):
            out = fn(ids, texts)
            if out is not None and out.num_rows:
                yield out

    return source.mapInArrow(run, schema)


def filter_text(df: DataFrame, accepts: Callable[[list], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows of df whose text is accepted, all columns as they are; rows stay where they are. accepts gets slices of texts, with None for nulls."""
    ship(df.sparkSession)
    at = next(k for k, c in enumerate(df.columns) if c.lower() == text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at).cast(pa.string())
            masks = [accepts(texts) for _, texts in slices([pa.RecordBatch.from_arrays([text, text], ["id", "text"])])]
            if masks:
                yield batch.filter(pa.array(np.concatenate(masks)))

    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])  # names with dots can't be passed on
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def slices(batches: Iterator[pa.RecordBatch], slice_chars: int = SLICE_CHARS) -> Iterator[tuple[list, ...]]:
    """The columns (ids, texts and any more) in slices of about slice_chars characters of text."""
    for batch in batches:
        step = 512
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            columns = [c.to_pylist() for c in part.columns]
            begin = size = 0
            for k, text in enumerate(columns[1]):
                size += len(text) if text else 0
                if size >= slice_chars:
                    yield tuple(c[begin : k + 1] for c in columns)
                    begin, size = k + 1, 0
            if begin < part.num_rows:
                yield tuple(c[begin:] for c in columns)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(1)
def fold_table() -> np.ndarray:
    """Lower-case code of each letter or digit, 0 for all other characters."""
    table = np.zeros(0x32000, np.uint32)
    for c in range(0x32000):
        ch = chr(c)
        if ch.isalnum():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, n of each at least."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_CHARS * 5 // 4)
        for k, b in enumerate((BASE, BASE_INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def codepoints(joined: str) -> np.ndarray:
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)


def folded(texts: list, gap: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of the texts, joined with gap, and where each text begins (with the end)."""
    parts = [t or "" for t in texts]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + len(gap)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    cp = codepoints(gap.join(parts) + gap)
    table = fold_table()
    return table[np.minimum(cp, len(table) - 1)], starts


def words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-case words of all texts, and the texts' bounds in them.

    A word is a run of letters and digits.
    """
    f, starts = folded(texts)
    inside = f != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside.size and inside[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]  # every text ends with a gap
    power, inverse = powers(len(f) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(f.astype(np.uint64) * power[: len(f)], dtype=np.uint64)])
    h = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    return h, np.searchsorted(begin, starts)


def pairs_of(h: np.ndarray) -> np.ndarray:
    """Hashes of adjacent words."""
    return mix(h[:-1] * U(0xD6E8FEB86659FD93) + h[1:])


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values (by rows) between bounds, 0 for empty ranges."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def hashed_sample(df: DataFrame, n: int) -> DataFrame:
    """About n rows of df (all, if it has fewer), chosen by a hash of their first column's values.

    A threshold on the hash, set from the number of rows, passes about n and a half;
    only those are put in order.
    """
    key = F.xxhash64(df[quoted(df.columns[0])])
    total = df.count()
    if total > 2 * n:
        df = df.where(F.pmod(key, F.lit(1 << 40)) < int((1 << 40) * 1.5 * n / total))
    return df.orderBy(F.pmod(key, F.lit(1 << 40)), *df.columns).limit(n)


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """All arrays one after the other, each at a multiple of 64, after a table of contents."""
    head, body, at = [], [], 0
    for name, x in arrays.items():
        x = np.ascontiguousarray(x)
        head.append(f"{name} {x.dtype.str} {len(x)} {at}")
        raw = x.tobytes()
        body.append(raw + b"\0" * (-len(raw) % 64))
        at += len(body[-1])
    top = "\n".join(head).encode()
    return len(top).to_bytes(8, "little") + top + b"\0" * (-(len(top) + 8) % 64) + b"".join(body)


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of to_bytes() in a file, mapped into memory."""
    raw = np.memmap(path, np.uint8, "r")
    size = int(raw[:8].view("<u8")[0])
    begin = size + 8 + (-(size + 8) % 64)
    arrays = {}
    for line in bytes(raw[8 : 8 + size]).decode().splitlines():
        name, kind, n, at = line.rsplit(" ", 3)
        width = np.dtype(kind).itemsize
        arrays[name] = raw[begin + int(at) : begin + int(at) + int(n) * width].view(kind)
    return arrays


def publish(spark: SparkSession, data: bytes, name: str) -> None:
    """Put a file into the shared folder and have every executor fetch it."""
    path = f"{shared_folder(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    with tempfile.NamedTemporaryFile(dir=SparkFiles.getRootDirectory(), delete=False) as f:
        f.write(data)
    fs.mkdirs(target.getParent())
    fs.copyFromLocalFile(True, True, jvm.org.apache.hadoop.fs.Path(f"file://{f.name}"), target)
    spark.sparkContext.addFile(path)
