"""Quality rules: lines that recur across a host's documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.kernels import U, codepoints, fold_table, mix, powers, slices
from nearfield.session import durable, quoted, ship

#: Documents of a host in which a line may stand.
MOST_DOCUMENTS = 10
#: Share of its words that a document must keep.
LEAST_KEPT = 0.5
#: Frequent lines that are sent to every task at most (8 bytes each); beyond it they are joined.
MOST_SENT = 1 << 22
LINE_BASE = U(0xC2B2AE3D27D4EB4F)

_lines: list[tuple[np.ndarray, np.ndarray]] = []


def line_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of LINE_BASE and of its inverse, n of each at least."""
    if not _lines or len(_lines[0][0]) < n:
        size, out = max(n, 1 << 18), []
        for b in (LINE_BASE, U(pow(int(LINE_BASE), -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _lines[:] = [(out[0], out[1])]
    return _lines[0]


def line_keys(texts: list, hosts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, words, end, text) of all lines of the texts.

    key: hash of the line's lower-case words and its host, 0 for a line without
    words; words: how many; end: the place after its last character, in the texts
    joined by line ends; text: the index of its text.
    """
    parts = [t or "" for t in texts]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    cp = codepoints("\n".join(parts) + "\n")
    table = fold_table()
    f = table[np.minimum(cp, len(table) - 1)]
    inside = f != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]
    power, inverse = powers(len(f) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(f.astype(np.uint64) * power[: len(f)], dtype=np.uint64)])
    word = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    stop = np.flatnonzero(cp == 10)
    last = np.searchsorted(begin, stop)
    first = np.concatenate([[0], last[:-1]])
    up, down = line_powers(len(word) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * up[: len(word)], dtype=np.uint64)])
    of = np.searchsorted(np.cumsum(lengths), stop, "right")
    host = np.array(hosts, np.int64).view(np.uint64)[of]
    many = last - first
    key = mix(mix((total[last] - total[first]) * down[first] + many.astype(np.uint64)) ^ mix(host + U(1)))
    key[many == 0] = 0
    return key, many, stop, of


def among(key: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted array."""
    if not len(known):
        return np.zeros(len(key), bool)
    return known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key


def source(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> list:
    host = F.xxhash64(F.coalesce(F.col(quoted(host_col)).cast("string"), F.lit("\0")))
    return [F.col(quoted(id_col)).cast("bigint").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"), host.alias("host")]


def frequent(docs: DataFrame, most_documents: int, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(line) keys of the lines that more than most_documents distinct ids of their host have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, hosts in slices(batches):
            key, _, _, of = line_keys(texts, hosts)
            known = (key != 0) & np.array([i is not None for i in ids])[of]
            key, of = key[known], np.array([i or 0 for i in ids], np.int64)[of[known]]
            by = np.lexsort((of, key))
            key, of = key[by], of[by]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(of[new])], ["line", "doc"])

    rows = docs.select(*source(docs, id_col, text_col, host_col)).mapInArrow(run, "line bigint, doc bigint")
    return rows.groupBy("line").agg(F.countDistinct("doc").alias("n")).where(F.col("n") > most_documents).select("line")


def stripped(ids: list, texts: list, hosts: list, removed: Callable[[np.ndarray, np.ndarray], np.ndarray], least_kept: float) -> pa.RecordBatch:
    """Each text without the lines whose (key, text) is removed."""
    key, many, stop, of = line_keys(texts, hosts)
    gone = (key != 0) & removed(key, of)
    n = len(texts)
    lines, dropped = np.bincount(of, minlength=n), np.bincount(of[gone], minlength=n)
    words, left = np.bincount(of, many, minlength=n), np.bincount(of[~gone], many[~gone], minlength=n)
    first = np.concatenate([[0], np.cumsum(lines)])
    out = []
    for k, text in enumerate(texts):
        if text and dropped[k]:
            own = ~gone[first[k] : first[k + 1]]
            text = "\n".join(x for x, stays in zip(text.split("\n"), own, strict=True) if stays)
        out.append(text)
    empty = np.array([not t for t in texts], bool)
    lines[empty] = 0
    keep = (dropped == 0) | ((left > 0) & (left >= least_kept * words))
    columns = [pa.array(ids, pa.int64()), pa.array(out, pa.string()), pa.array(lines), pa.array(dropped), pa.array(keep)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_lines", "n_removed", "keep"])


SCHEMA = "doc_id bigint, text string, n_lines bigint, n_removed bigint, keep boolean"


def cleaned(
    docs: DataFrame, most_documents: int = MOST_DOCUMENTS, least_kept: float = LEAST_KEPT, most_sent: int = MOST_SENT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, keep) for every row of docs.

    A line counts by its lower-case words; lines without words are neither counted
    nor removed. Lines that more than most_documents distinct documents of a host
    have are removed from all of that host's texts, every occurrence of them. A
    document that keeps less than least_kept of its words, or none, has keep false.

    Null texts stay null and empty ones empty, both without lines and kept. Rows that
    repeat a doc_id count as one document, those without doc_id as none; all are
    cleaned. Rows without host share one. Empty tables give no row.

    One shuffle carries (line hash, id) pairs. Up to most_sent frequent lines travel
    to every task as a sorted array; more are joined to the documents that have them.
    """
    ship(docs.sparkSession)
    found = durable(frequent(docs, most_documents, id_col, text_col, host_col), "lines")
    rows = docs.select(*source(docs, id_col, text_col, host_col))
    if found.count() <= most_sent:
        known = np.sort(found.toArrow()["line"].to_numpy().astype(np.int64).view(np.uint64))

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, texts, hosts in slices(batches):
                yield stripped(ids, texts, hosts, lambda key, of: among(key, known), least_kept)

        return rows.mapInArrow(sent, SCHEMA)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_of, texts, hosts in slices(batches):
            key, _, _, of = line_keys(texts, hosts)
            some = key != 0
            yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(np.array(rows_of, np.int64)[of[some]])], ["line", "own"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, hosts, gone in slices(batches):

            def removed(key: np.ndarray, of: np.ndarray, gone: list = gone) -> np.ndarray:
                out = np.zeros(len(key), bool)
                for k, own in enumerate(gone):
                    if own:
                        at = slice(*np.searchsorted(of, [k, k + 1]))
                        out[at] = np.isin(key[at], np.array(own, np.int64).view(np.uint64))
                return out

            yield stripped(ids, texts, hosts, removed, least_kept)

    own = F.xxhash64("text", "host")  # equal texts of a host lose the same lines
    of = rows.select(own.alias("own"), "text", "host").mapInArrow(pairs, "line bigint, own bigint")
    gone = of.join(found, "line", "left_semi").groupBy(F.col("own").alias("of")).agg(F.collect_set("line").alias("gone"))
    return rows.withColumn("own", own).join(gone, F.col("own") == F.col("of"), "left").select("id", "text", "host", "gone").mapInArrow(joined, SCHEMA)
