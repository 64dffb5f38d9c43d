"""Benchmark decontamination by Wu-Manber multi-pattern search."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.kernels import U, filter_text, folded, map_text, mapped, mix, publish, to_bytes
from nearfield.session import quoted

SPACE, BREAK = 32, 1
WINDOW_WORDS = 8
#: Words of the shortest item whose documents are rejected.
SHORTEST_ITEM = 5
#: Characters below which patterns are searched by themselves.
SHORT_PATTERN = 16
BLOCK = 5
SHIFT_BITS = 18
SHARD_CHARS = 8_000_000


def normal_form(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case words of each text with one space around every word; a break lies between texts.

    Returns the characters and the places of the breaks.
    """
    f, starts = folded(texts, " \n ")
    f[starts[1:] - 2] = BREAK
    keep = f != 0
    keep[1:] |= keep[:-1].copy()
    keep[0] = True
    out = f[keep]
    out[out == 0] = SPACE
    return out, np.flatnonzero(out == BREAK)


class WuManber:
    """Many patterns searched at once in arrays of characters.

    shift: for the hash of a block of characters, how far the search may jump when
    that block ends at the current place. Blocks that end a pattern's first m
    characters have shift 0; their hash then selects the patterns to compare.
    """

    def __init__(self, chars: np.ndarray, begin: np.ndarray, end: np.ndarray, block: int = BLOCK, bits: int = SHIFT_BITS):
        self.chars, self.begin, self.end, self.bits = chars, begin, end, bits
        self.m = int((end - begin).min())
        self.block = min(block, self.m)
        self.shift = np.full(1 << bits, self.m - self.block + 1, np.int32)
        for q in range(self.block, self.m + 1):
            np.minimum.at(self.shift, self.hashed(chars, begin + q - 1), self.m - q)
        suffix = self.hashed(chars, begin + self.m - 1)
        self.order = np.argsort(suffix, kind="stable")
        self.bucket = np.searchsorted(suffix[self.order], np.arange((1 << bits) + 1))
        self.prefix = self.head(chars, begin)

    def arrays(self) -> dict[str, np.ndarray]:
        own = {k: getattr(self, k) for k in ("chars", "begin", "end", "shift", "order", "bucket", "prefix")}
        return own | {"sizes": np.array([self.m, self.block, self.bits])}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> WuManber:
        self = cls.__new__(cls)
        for k in ("chars", "begin", "end", "shift", "order", "bucket", "prefix"):
            setattr(self, k, arrays[k])
        self.m, self.block, self.bits = arrays["sizes"].tolist()
        return self

    def hashed(self, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in range(self.block - 1, -1, -1):
            h = h * U(0x100000001B3) + chars[at - k]
        return (mix(h) >> U(64 - self.bits)).astype(np.int64)

    def head(self, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in range(min(12, self.m)):
            h = h * U(0x100000001B3) + chars[at + k]
        return h

    def search(self, text: np.ndarray, lane: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """(place, pattern) of every occurrence. Stretches of the text are searched side by side."""
        m, n = self.m, len(text)
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(m - 1, n, lane)
        stop = np.minimum(at + lane, n)
        stops = []
        while len(at):
            jump = self.shift[self.hashed(text, at)]
            zero = jump == 0
            if zero.any():
                stops.append(at[zero])
            at = at + np.maximum(jump, 1)
            going = at < stop
            if not going.all():
                at, stop = at[going], stop[going]
        if not stops:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(stops)
        h = self.hashed(text, at)
        first, many = self.bucket[h], self.bucket[h + 1] - self.bucket[h]
        at = np.repeat(at, many) - m + 1
        pattern = self.order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)]
        same = (self.head(text, at) == self.prefix[pattern]) & (at + (self.end - self.begin)[pattern] <= n)
        at, pattern = at[same], pattern[same]
        equal = np.fromiter(
            (np.array_equal(text[a : a + self.end[p] - self.begin[p]], self.chars[self.begin[p] : self.end[p]]) for a, p in zip(at, pattern, strict=True)), bool, len(at)
        )
        return at[equal], pattern[equal]


def windows(ids: list, texts: list, words: int, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(characters, begin, end, item) of the patterns: each run of so many words, with the spaces around it.

    Items of fewer words are one pattern; those of fewer than shortest words, nulls included, have none.
    """
    chars, breaks = normal_form(texts)
    space = np.flatnonzero(chars == SPACE)
    begin, end, item = [], [], []
    left = np.concatenate([[-1], breaks[:-1]])
    for who, a, b in zip(ids, left, breaks, strict=True):
        s = space[np.searchsorted(space, a) : np.searchsorted(space, b)]
        if len(s) and chars[a + 1] != SPACE:
            s = np.concatenate([[a], s])  # the break stands before the first word
        n = len(s) - 1
        if who is None or n < shortest:
            continue
        w = min(words, n)
        begin.append(s[: n - w + 1])
        end.append(s[w:] + 1)
        item.append(np.full(n - w + 1, who, np.int64))
    if not begin:
        empty = np.zeros(0, np.int64)
        return chars, empty, empty, empty
    return chars, np.concatenate(begin), np.concatenate(end), np.concatenate(item)


def patterns(ids: list, texts: list, words: int, shortest: int) -> list[dict[str, np.ndarray]]:
    """The arrays of a search structure, with each pattern's item, for short patterns and for the others: a search jumps no further than its shortest pattern is long."""
    if not ids:
        return []
    chars, begin, end, item = windows(ids, [f" {t}" if t else "" for t in texts], words, shortest)
    seen, keep = set(), []
    for k, (a, b, i) in enumerate(zip(begin, end, item, strict=True)):
        key = (int(i), chars[a:b].tobytes())
        if key not in seen:
            seen.add(key)
            keep.append(k)
    keep = np.array(keep, np.int64)
    size = (end - begin)[keep]
    groups = (keep[size < SHORT_PATTERN], keep[size >= SHORT_PATTERN])
    return [WuManber(chars, begin[own], end[own]).arrays() | {"item": item[own]} for own in groups if len(own)]


class Searchers:
    """The benchmark's search structures, in shards of about shard_chars characters.

    One shard travels with the tasks. More are written to files that every executor
    fetches and maps into memory, one after the other, so that the driver holds one
    at a time and the documents are read once however many there are.
    """

    def __init__(self, benchmark: DataFrame, words: int, shortest: int, item_col: str, item_text_col: str, shard_chars: int):
        items = benchmark.select(F.col(quoted(item_col)).cast("bigint").alias("item"), F.col(quoted(item_text_col)).cast("string").alias("text")).where("item is not null and text is not null")
        total = items.agg(F.sum(F.length("text"))).first()[0] or 0
        n = max(1, -(-int(total) // shard_chars))
        self.sent, self.names = [], []
        for k in range(n):
            part = (items if n == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k)).collect()
            for arrays in patterns([r["item"] for r in part], [r["text"] for r in part], words, shortest):
                if n == 1:
                    self.sent.append(arrays)
                else:
                    self.names.append(f"patterns-{uuid.uuid4().hex}")
                    publish(benchmark.sparkSession, to_bytes(arrays), self.names[-1])

    def __iter__(self) -> Iterator[tuple[WuManber, np.ndarray]]:
        for arrays in self.sent:
            yield WuManber.of(arrays), arrays["item"]
        for name in self.names:
            arrays = mapped(os.path.join(SparkFiles.getRootDirectory(), name))
            yield WuManber.of(arrays), arrays["item"]


def contamination(
    docs: DataFrame, benchmark: DataFrame, words: int = WINDOW_WORDS, shortest: int = 1, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_chars: int = SHARD_CHARS
) -> DataFrame:
    """(doc_id, item_id, n_windows): how many different runs of `words` words of an item a document has.

    Case and all characters but letters and digits are ignored. An item of fewer
    words is searched as a whole, one of fewer than `shortest` words not at all.
    Documents without a match, null and empty texts and empty tables give no row;
    each row of docs is searched by itself, so repeated rows repeat in the result.
    A null doc_id stays null; items without id are not searched. Texts of any length
    are searched whole. Columns but those named are not read; ids must be integers or
    cast to them.
    """
    found = Searchers(benchmark, words, shortest, item_col, item_text_col, shard_chars)

    def search(ids: list, texts: list) -> pa.RecordBatch | None:
        chars, breaks = normal_form([f" {t}" if t else "" for t in texts])
        hits = []
        for wm, item in found:
            at, pattern = wm.search(chars)
            if len(at):  # which pattern of which structure
                hits.append(np.stack([np.searchsorted(breaks, at), item[pattern], pattern, np.full(len(at), len(hits))]))
        if not hits:
            return None
        hit = np.unique(np.concatenate(hits, axis=1), axis=1)
        rows, many = np.unique(hit[:2], axis=1, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([ids[d] for d in rows[0]], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(many, pa.int64())], ["doc_id", "item_id", "n_windows"])

    return map_text(docs, search, "doc_id bigint, item_id bigint, n_windows bigint", id_col, text_col)


def clean(
    docs: DataFrame, benchmark: DataFrame, words: int = WINDOW_WORDS, shortest: int = SHORTEST_ITEM, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_chars: int = SHARD_CHARS
) -> DataFrame:
    """The rows of docs in which contamination() finds nothing, columns unchanged. Null and empty texts stay.

    Items of fewer than `shortest` words reject no document here, as an answer of one
    word would reject nearly all. Rows are searched where they are, without a shuffle.
    Repeated rows and rows without id are judged each; empty tables stay empty.
    """
    found = Searchers(benchmark, words, shortest, item_col, item_text_col, shard_chars)

    def accepts(texts: list) -> np.ndarray:
        chars, breaks = normal_form([f" {t}" if t else "" for t in texts])
        keep = np.ones(len(texts), bool)
        for wm, _ in found:
            keep[np.searchsorted(breaks, wm.search(chars)[0])] = False
        return keep

    return filter_text(docs, accepts, text_col)
