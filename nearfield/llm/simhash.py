"""Near-duplicate groups: all pairs of SimHash codes within a radius, by tables over blocks of the code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.kernels import fresh, map_text, mix, pairs_of, words
from nearfield.session import durable, quoted, release

RADIUS = 12
#: Of the 128 bits of both pair codes.
CONFIRM_RADIUS = 36
#: Codes are searched by blocks, each by a table of its first bits: so many blocks, and bits at most. The pairs found don't depend on either.
TABLES = 4
KEY_BITS = 16
#: With fewer bits most pairs would be compared anyway.
LEAST_BITS = 10
CODES = ["code", "pair_code", "other_pair_code"]
#: Nodes in a part, and the number of parts that smaller tables are cut into, of so many nodes at least.
PART_ROWS, LEAST_PARTS, FEW_ROWS = 1 << 20, 8, 1 << 12
LEFT, RIGHT, BOTH = 0, 1, 2
#: Pairs of codes compared at a time.
TILE = 1 << 17
#: (query, node) pairs in flight during a tree search.
FRONTIER = 1 << 21


def simhash(h: np.ndarray) -> int:
    """The sign of each bit's balance over the distinct hashes."""
    h = np.sort(h)
    h = h[np.concatenate([[True], h[1:] != h[:-1]])]
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def codes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, code, pair_code, other_pair_code): 64-bit SimHash of the set of words and, by two hashes, of the set of adjacent word pairs.

    A text without a word gets the hash of its characters for all; null and empty
    texts and rows without id have no row.
    """

    def run(ids: list, texts: list) -> pa.RecordBatch:
        h, bound = words(texts)
        out = []
        for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
            if i is None or not t:
                continue
            own = h[bound[k] : bound[k + 1]]
            if not len(own):
                own = mix(np.array([hash_chars(t)], np.uint64))
            both = pairs_of(own) if len(own) > 1 else own
            out.append((i, simhash(own), simhash(both), simhash(mix(both + np.uint64(1)))))
        cols = list(zip(*out, strict=True)) or [()] * 4
        codes64 = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols[1:]]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *codes64], ["doc_id", *CODES])

    return map_text(docs, run, "doc_id bigint, code bigint, pair_code bigint, other_pair_code bigint", id_col, text_col)


def hash_chars(text: str) -> int:
    x = 0xCBF29CE484222325
    for b in text.encode("utf-8", "surrogatepass"):
        x = ((x ^ b) * 0x100000001B3) & (1 << 64) - 1
    return x


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class BKForest:
    """BK-trees over codes, one for each group; groups must be contiguous.

    A node's children are keyed by their integer Hamming distance to it; each edge
    leads to one child. All trees are built together, one level at a time. Near the
    radius of near copies trees prune almost nothing, so links() compares by blocks.
    """

    def __init__(self, code: np.ndarray, group: np.ndarray):
        n = len(code)
        self.code = code
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        set_of = group.copy()
        left = np.arange(n)
        self.root = np.zeros(n, np.int64)
        above = None
        while len(left):
            head = np.concatenate([[True], set_of[1:] != set_of[:-1]])
            top = left[np.flatnonzero(head)[np.cumsum(head) - 1]]
            if above is None:
                self.root = top.copy()
            else:
                parent[left[head]], edge[left[head]] = above[head], last[head]
            rest = ~head
            left, top = left[rest], top[rest]
            d = distance(code[left], code[top]).astype(np.int64)
            by = np.lexsort((left, d, top))
            left, above, last = left[by], top[by], d[by]
            set_of = above * 65 + last
        child = np.flatnonzero(parent >= 0)
        key = parent[child] * 65 + edge[child]
        by = np.argsort(key)
        self.child, self.key = child[by], key[by]

    def within(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node), query > node, of one group at most radius apart, every code being a query."""
        n = len(self.code)
        size = max(1, FRONTIER // 64)
        for begin in range(0, n, size):
            stack = [(np.arange(begin, min(n, begin + size)), self.root[begin : begin + size])]
            while stack:
                query, node = stack.pop()
                d = distance(self.code[query], self.code[node]).astype(np.int64)
                hit = (d <= radius) & (query > node)
                if hit.any():
                    yield query[hit], node[hit]
                lo = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
                many = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right") - lo
                total = int(many.sum())
                if total:
                    at = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
                    query, node = np.repeat(query, many), self.child[at]
                    for k in range(0, total, FRONTIER):
                        stack.append((query[k : k + FRONTIER], node[k : k + FRONTIER]))


def blocks(radius: int, tables: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, distance) of the blocks a code is cut into: codes at most radius apart are at most that distance apart in one block at least.

    Were they further apart in every block, by its distance + 1 or more, they would be
    radius + 1 apart or more, the sum of those. Blocks left with a distance of -1 are not searched.
    """
    edges = [64 * k // tables for k in range(tables + 1)]
    share = [(radius + 1) // tables + (k < (radius + 1) % tables) for k in range(tables)]
    return [(a, b - a, d - 1) for a, b, d in zip(edges[:-1], edges[1:], share, strict=True) if d]


def by_prefix(code: np.ndarray, first: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes ordered by so many bits from the first on, where each value of these bits begins (with the end), and the codes' places."""
    key = ((code >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    place = np.argsort(key, kind="stable")
    return code[place], np.searchsorted(key[place], np.arange((1 << bits) + 1)), place


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int, bits: int, tables: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (place in left, place in right) of codes at most radius apart, some more than once.

    In each block the codes of left that have the same prefix, of `bits` bits at most, are
    compared with all codes of right whose prefix is near enough; few codes with all.
    """
    prefix = min(bits, len(left).bit_length() - 5)  # some 16 codes of left share one
    for first, size, far in blocks(radius, tables):
        used = min(prefix, size) if prefix >= LEAST_BITS else 0
        own, own_at, own_place = by_prefix(left, first, used)
        other, other_at, other_place = by_prefix(right, first, used)
        flips = np.arange(1 << used)
        flips = flips[np.bitwise_count(flips) <= far]
        for value in np.flatnonzero(np.diff(own_at)):
            near = np.sort(flips ^ value)
            begin, many = other_at[near], other_at[near + 1] - other_at[near]
            at = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
            codes, end = other[at], own_at[value + 1]
            step = max(1, TILE // max(1, len(at)))
            for k in range(own_at[value], end, step):
                hit = np.flatnonzero(distance(own[k : min(k + step, end), None], codes) <= radius)
                if len(hit):
                    yield own_place[k + hit // len(at)], other_place[at[hit % len(at)]]
        if far >= used:  # that was every pair
            return


def in_bulk(pairs: Iterator[tuple[np.ndarray, np.ndarray]], size: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, at least size of them at a time but for the last."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    total = 0
    for pair in pairs:
        held.append(pair)
        total += len(pair[0])
        if total >= size:
            yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
            held, total = [], 0
    if held:
        yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])


def links(nodes: DataFrame, radius: int, confirm_radius: int, bits: int, tables: int, part_rows: int = PART_ROWS) -> DataFrame:
    """(a, b), a > b: links whose connected parts are those of all pairs within the radii.

    nodes: (node, *CODES), each combination of codes once. The nodes are cut into parts of
    about part_rows by a hash; each two parts, and each part with itself, make a task that
    finds all close pairs of codes between them.
    """
    n = nodes.count()
    parts = max(1, -(-n // part_rows), min(LEAST_PARTS, -(-n // FEW_ROWS)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, pair, other = (batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (1, 2, 3))
            part = (mix(code ^ mix(pair ^ mix(other))) % np.uint64(parts)).astype(np.int64)
            for with_part in range(parts):
                least, most = np.minimum(part, with_part), np.maximum(part, with_part)
                task = most * (most + 1) // 2 + least
                side = np.where(part == with_part, BOTH, np.where(part < with_part, LEFT, RIGHT))
                yield pa.RecordBatch.from_arrays([pa.array(task.astype(np.int32)), pa.array(side.astype(np.int8)), *batch.columns], ["task", "side", "node", *CODES])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)] for batch in batches]
        if not got:
            return
        tasks, sides, *columns = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        for task in np.unique(tasks):
            at = np.flatnonzero(tasks == task)
            at = at[np.argsort(columns[0][at], kind="stable")]
            node, side = columns[0][at], sides[at]
            code, pair, other = (x[at].view(np.uint64) for x in columns[1:])
            left, right = np.flatnonzero(side != RIGHT), np.flatnonzero(side != LEFT)
            label = np.arange(len(node))
            for a, b in in_bulk(close_pairs(code[left], code[right], radius, bits, tables)):
                a, b = left[a], right[b]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                sure = distance(pair[a], pair[b]) + distance(other[a], other[b]) <= confirm_radius
                label = joined(label, a[sure], b[sure])
            moved = np.flatnonzero(node[label] != node)
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], ["a", "b"])

    spreads = nodes.select("node", *CODES).mapInArrow(spread, "task int, side byte, node bigint, code bigint, pair_code bigint, other_pair_code bigint")
    return spreads.repartitionById(parts * (parts + 1) // 2, F.col("task")).mapInArrow(search, "a bigint, b bigint")


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (least member) after joining the parts of a and b."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): its part's least node. Alternating large-star and small-star steps."""
    e = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        e, old = durable(small, "edges"), e
        release(old)
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())
        if state == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = state


def near_duplicates(docs: DataFrame, radius: int = RADIUS, confirm_radius: int = CONFIRM_RADIUS, bits: int = KEY_BITS, tables: int = TABLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id) of the documents that have a near copy; group_id is the group's least doc_id.

    Two documents are near copies if their word codes differ in at most radius bits
    and their pair codes in at most confirm_radius of 128 bits; groups are the connected
    parts. The search is exact: no pair within the radii is left out. `bits` and `tables`
    only say how it goes about it.

    Null and empty texts and rows without id belong to no group; empty tables have
    none. Rows that repeat a doc_id count as one document. Ties go to the least
    doc_id. Texts of any length count whole. Columns but id_col and text_col are not
    read; ids must be integers or cast to them.
    """
    code = durable(codes(docs, id_col, text_col), "codes")
    nodes = durable(code.groupBy(*CODES).agg(F.min("doc_id").alias("node")), "nodes")
    part = components(links(nodes, radius, confirm_radius, bits, tables))
    roots = nodes.join(part, "node", "left").select(*CODES, F.coalesce("root", "node").alias("root"))
    members = code.join(roots, CODES).select("doc_id", "root").distinct()
    groups = members.groupBy("root").agg(F.count("*").alias("n"), F.min("doc_id").alias("group_id")).where("n > 1")
    return members.join(groups, "root").select("doc_id", "group_id")


def groups(docs: DataFrame, **options: object) -> DataFrame:
    """(group_id, doc_ids, n_docs): each group of near copies once, its doc_ids ascending."""
    found = near_duplicates(docs, **options)
    return found.groupBy("group_id").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"), F.count("*").alias("n_docs"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of docs without all but the least doc_id of each group; columns unchanged.

    Of rows equal in doc_id and text one stays. Different texts under one doc_id are
    no copies of one another for that: they all stay, whatever their groups. Rows
    without id, null and empty texts stay, and empty tables stay empty.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    dropped, again = fresh(docs, "__dropped_id"), fresh(docs, "__again")
    key, text = F.col(quoted(id_col)).cast("bigint"), F.xxhash64(F.col(quoted(text_col)).cast("string"))
    counts = docs.groupBy(key.alias(again)).agg(F.count("*").alias("n"), (F.min(text) != F.max(text)).alias("mixed")).where((F.col("n") > 1) & F.col(again).isNotNull())
    repeated = durable(counts.select(again, "mixed"), "again")
    drop = found.where("doc_id <> group_id").select(F.col("doc_id").alias(dropped)).join(repeated.where("mixed"), F.col(dropped) == F.col(again), "left_anti")
    kept = docs.join(durable(drop, "dropped"), key == F.col(dropped), "left_anti")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, key == F.col(again), "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(repeated, key == F.col(again), "left_anti").unionByName(once)
