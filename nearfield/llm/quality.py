"""Quality classifier: gated-attention multiple-instance learning over passages."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.kernels import U, codepoints, filter_text, fold_table, hashed_sample, map_text, mix, powers
from nearfield.session import quoted

#: Labelled documents that training uses at most.
SAMPLE = 4000
PASSAGE_WORDS = 16
BUCKET_BITS = 18
WORD_DIMENSIONS = 8
PREFIXES = (4, 5)
HIDDEN = 24
GATE = 12
HEADS = ("quality", "toxic")
UPPER, LOWER, DIGIT, BLANK, LINE, COMMON, OTHER = range(7)


def kind_table() -> np.ndarray:
    table = np.full(0x3000, OTHER, np.int8)
    for c in range(0x3000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = UPPER if ch.isupper() else LOWER
        elif ch.isalnum():
            table[c] = DIGIT
        elif ch == "\n":
            table[c] = LINE
        elif ch.isspace():
            table[c] = BLANK
        elif ch in ".,;:'\"()-?":
            table[c] = COMMON
    return table


_kinds: list[np.ndarray] = []


@dataclass
class Bags:
    """Passages of some texts: their words' buckets, surface features and owners."""

    bucket: np.ndarray  # of every word: itself and its first PREFIXES letters, a column each
    at: np.ndarray  # where each passage's words begin, with the end
    surface: np.ndarray  # a row for each passage
    doc: np.ndarray  # index of each passage's text


def passages(texts: list) -> Bags:
    """Stretches of PASSAGE_WORDS words of each whole text, with all characters up to the next stretch.

    A text without words is one passage; a null or empty one has none.
    """
    if not _kinds:
        _kinds.append(kind_table())
    parts = [t or "" for t in texts]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    cp = codepoints("\n".join(parts) + "\n")
    table, kinds = fold_table(), _kinds[0]
    f = table[np.minimum(cp, len(table) - 1)]
    kind = np.where(cp < len(kinds), kinds[np.minimum(cp, len(kinds) - 1)], np.where(f != 0, LOWER, OTHER))
    inside = f != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]
    power, inverse = powers(len(f) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(f.astype(np.uint64) * power[: len(f)], dtype=np.uint64)])
    hashed = lambda to, salt: mix((total[to] - total[begin]) * inverse[begin] + (to - begin + salt).astype(np.uint64)) >> U(64 - BUCKET_BITS)
    h = np.stack([hashed(end, 0)] + [hashed(np.minimum(end, begin + n), 1000 * n) for n in PREFIXES], axis=1).astype(np.int64)
    bound = np.searchsorted(begin, starts)
    many = np.diff(bound)
    within = np.arange(len(h)) - np.repeat(bound[:-1], many)
    first = np.flatnonzero(within % PASSAGE_WORDS == 0)
    doc = np.repeat(np.arange(len(parts)), many)[first]
    char = np.where(within[first] == 0, starts[doc], begin[first])
    bare = np.flatnonzero((many == 0) & (lengths > 0))
    doc = np.concatenate([doc, bare])
    char = np.concatenate([char, starts[bare]])
    word = np.concatenate([first, bound[bare]])
    by = np.lexsort((char, doc))
    doc, char, word = doc[by], char[by], word[by]
    stop = np.concatenate([char[1:], [0]])
    final = np.concatenate([doc[1:] != doc[:-1], [True]]) if len(doc) else np.zeros(0, bool)
    if len(doc):
        stop[final] = starts[doc[final]] + lengths[doc[final]]
    else:
        stop = np.zeros(0, np.int64)
    at = np.concatenate([word, [len(h)]]).astype(np.int64)
    n = np.zeros((len(doc), 7), np.float32)
    for k in range(7):
        c = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])
        n[:, k] = c[stop] - c[char]
    chars, letters = np.maximum(n.sum(1), 1), np.maximum(n[:, UPPER] + n[:, LOWER], 1)
    count = np.diff(at)
    again = np.zeros(len(h) + 1, np.int64)
    if len(h):
        again[2:] = np.cumsum((h[1:, 0] == h[:-1, 0]) & (within[1:] > 0))
    repeated = again[at[1:]] - again[at[:-1]]
    surface = np.stack(
        [n[:, UPPER] / letters, n[:, DIGIT] / chars, n[:, OTHER] / chars, n[:, COMMON] / chars, n[:, BLANK] / chars, n[:, LINE] / chars, letters / np.maximum(count, 1) / 10, count / PASSAGE_WORDS, repeated / np.maximum(count, 1)], axis=1
    ).astype(np.float32)
    return Bags(h, at, surface, doc)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """Encoder of passages and, for each head, gated attention and a logistic score of the weighted passage.

    weight_k = softmax_k(w . (tanh(V h_k) * sigmoid(U h_k))); score = sigmoid(c . sum_k weight_k h_k + d)
    """

    def __init__(self, rows: np.ndarray, mean: np.ndarray, deviation: np.ndarray, words: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rows, self.mean, self.deviation = rows, mean, deviation
        self.middle, self.spread = np.zeros(WORD_DIMENSIONS, np.float32), np.ones(WORD_DIMENSIONS, np.float32)
        self.lean = np.zeros((words + 1, len(HEADS)), np.float32)  # of each known word; a passage's extremes are features
        wide = WORD_DIMENSIONS + len(mean) + 2 * len(HEADS)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": np.zeros((words + 1, WORD_DIMENSIONS), np.float32), "W": init(wide, HIDDEN), "b": np.zeros(HIDDEN, np.float32)}
        for k in HEADS:
            self.p |= {f"V{k}": init(HIDDEN, GATE), f"U{k}": init(HIDDEN, GATE), f"w{k}": init(GATE), f"c{k}": init(HIDDEN), f"d{k}": np.zeros(1, np.float32)}

    def encode(self, bags: Bags) -> tuple[np.ndarray, ...]:
        row = self.rows[bags.bucket]
        e = self.p["E"][row[:, 0]]
        for k in range(1, row.shape[1]):
            e += self.p["E"][row[:, k]]
        x = np.zeros((len(bags.doc), WORD_DIMENSIONS), np.float32)
        ends = np.zeros((len(bags.doc), 2 * len(HEADS)), np.float32)
        count = np.diff(bags.at)
        some = count > 0
        if some.any():
            first = bags.at[:-1][some]
            x[some] = np.add.reduceat(e, first, axis=0)
            own = self.lean[row].reshape(len(row), -1, len(HEADS))
            ends[some] = np.concatenate([np.maximum.reduceat(own.max(1), first, axis=0), np.minimum.reduceat(own.min(1), first, axis=0)], axis=1)
        scale = 1 / np.sqrt(np.maximum(count, 1)).astype(np.float32)
        x = np.concatenate([(x * scale[:, None] - self.middle) / self.spread, np.clip((bags.surface - self.mean) / self.deviation, -5, 5), ends], axis=1)
        return row, scale, x, np.maximum(x @ self.p["W"] + self.p["b"], 0)

    def attend(self, k: str, h: np.ndarray, first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
        a, g = np.tanh(h @ self.p[f"V{k}"]), sigmoid(h @ self.p[f"U{k}"])
        s = (a * g) @ self.p[f"w{k}"]
        s = np.exp(s - np.maximum.reduceat(s, first)[of])
        weight = s / np.add.reduceat(s, first)[of]
        z = np.add.reduceat(weight[:, None] * h, first, axis=0)
        return a, g, weight, z, sigmoid(z @ self.p[f"c{k}"] + self.p[f"d{k}"][0])

    def scores(self, texts: list) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Which texts have passages, how many, and each head's scores of those."""
        bags = passages(texts)
        if not len(bags.doc):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), {k: np.zeros(0) for k in HEADS}
        first = np.flatnonzero(np.concatenate([[True], bags.doc[1:] != bags.doc[:-1]]))
        many = np.diff(np.concatenate([first, [len(bags.doc)]]))
        of = np.repeat(np.arange(len(first)), many)
        h = self.encode(bags)[3]
        return bags.doc[first], many, {k: self.attend(k, h, first, of)[4] for k in HEADS}

    def step(self, bags: Bags, target: dict[str, np.ndarray], weight: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss over the texts of the bags."""
        p = self.p
        first = np.flatnonzero(np.concatenate([[True], bags.doc[1:] != bags.doc[:-1]]))
        of = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(bags.doc)]])))
        row, scale, x, h = self.encode(bags)
        grad, gh = {}, np.zeros_like(h)
        for k in HEADS:
            a, g, share, z, y = self.attend(k, h, first, of)
            go = (weight[k] * (y - target[k]) / len(first)).astype(np.float32)
            grad[f"c{k}"], grad[f"d{k}"] = z.T @ go, go.sum(keepdims=True)
            gz = (go[:, None] * p[f"c{k}"])[of]
            gs = (h * gz).sum(1)
            gs = share * (gs - np.add.reduceat(share * gs, first)[of])
            grad[f"w{k}"] = (a * g).T @ gs
            both = gs[:, None] * p[f"w{k}"]
            ga, gg = both * g * (1 - a * a), both * a * g * (1 - g)
            grad[f"V{k}"], grad[f"U{k}"] = h.T @ ga, h.T @ gg
            gh += share[:, None] * gz + ga @ p[f"V{k}"].T + gg @ p[f"U{k}"].T
        gh *= h > 0
        grad["W"], grad["b"] = x.T @ gh, gh.sum(0)
        gx = (gh @ p["W"].T)[:, :WORD_DIMENSIONS] / self.spread * scale[:, None]
        each = np.repeat(gx, np.diff(bags.at), axis=0)
        grad["E"] = np.stack([np.bincount(row.ravel(), np.repeat(each[:, d], row.shape[1]), len(p["E"])) for d in range(WORD_DIMENSIONS)], axis=1)
        grad["E"][0] = 0
        return grad


def fitted(texts: list, target: dict[str, np.ndarray], epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Attention:
    """A model trained on whole texts by Adam. Words that under three of the texts have count as unknown."""
    bags = [passages([t]) for t in texts]
    used = [k for k, b in enumerate(bags) if len(b.doc)]
    seen = np.zeros(1 << BUCKET_BITS, np.int32)
    for k in used:
        seen[np.unique(bags[k].bucket)] += 1
    rows = np.zeros(1 << BUCKET_BITS, np.int32)
    known = np.flatnonzero(seen >= 3)
    rows[known] = np.arange(1, len(known) + 1)
    surface = np.concatenate([bags[k].surface for k in used]) if used else np.zeros((1, 9), np.float32)
    model = Attention(rows, surface.mean(0), surface.std(0) + np.float32(1e-3), len(known), seed)
    for d, k in enumerate(HEADS):
        model.lean[1:, d] = model.p["E"][1:, d] = leaning(bags, used, target[k], known)
    if used:
        x = np.concatenate([model.encode(bags[k])[2][:, : len(HEADS)] for k in used])
        model.middle[: len(HEADS)], model.spread[: len(HEADS)] = x.mean(0), x.std(0) + np.float32(1e-3)
    weight = {}
    for k in HEADS:
        share = np.clip(target[k][used].mean() if used else 0.5, 0.02, 0.98)
        weight[k] = np.where(target[k] == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.8
    rng = np.random.default_rng(seed)
    m, v, t = ({n: np.zeros_like(x) for n, x in model.p.items()} for _ in range(2)), None, 0
    m, v = m
    for epoch in range(epochs):
        order = rng.permutation(used)
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            some = [bags[k] for k in pick]
            sizes = [len(b.doc) for b in some]
            words = np.cumsum([0] + [len(b.bucket) for b in some])
            joint = Bags(
                np.concatenate([b.bucket for b in some]),
                np.concatenate([b.at[:-1] + w for b, w in zip(some, words, strict=False)] + [words[-1:]]),
                np.concatenate([b.surface for b in some]),
                np.repeat(np.arange(len(some)), sizes),
            )
            grad = model.step(joint, {k: target[k][pick] for k in HEADS}, {k: weight[k][pick] for k in HEADS})
            t += 1
            now = rate * min(1.0, 2 * (1 - epoch / epochs))
            for n, g in grad.items():
                m[n] = 0.9 * m[n] + 0.1 * g
                v[n] = 0.999 * v[n] + 0.001 * g * g
                model.p[n] = (model.p[n] * (1 - 1e-4) - (now / 10 if n == "E" else now) * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def leaning(bags: list[Bags], used: list[int], target: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each known word, how surely (in standard errors over 3) texts of either class have it more often; 0 below 3 errors."""
    with_word = np.zeros((2, 1 << BUCKET_BITS))
    size = np.zeros(2)
    for k in used:
        c = int(target[k])
        with_word[c][np.unique(bags[k].bucket)] += 1
        size[c] += 1
    a, b = with_word[1][known] + 0.5, with_word[0][known] + 0.5
    rest_a, rest_b = size[1] - a + 1, size[0] - b + 1
    z = np.log(a / rest_a * rest_b / b) / np.sqrt(1 / a + 1 / rest_a + 1 / b + 1 / rest_b)
    return np.where(np.abs(z) > 3, np.clip(z / 3, -3, 3), 0).astype(np.float32)


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Attention | None:
    """A model from at most `sample` labelled documents, taken in the order of a hash of their ids.

    Labels with nulls are left out; of repeated ones the greatest of each column counts.
    None if no labelled document has text.
    """
    key = F.col("doc_id").cast("bigint")
    rows = labels.groupBy(key.alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).where("id is not null and quality is not null and toxic is not null")
    known = {r["id"]: r for r in hashed_sample(rows, sample).collect()}
    if not known:
        return None
    of = F.col(quoted(id_col)).cast("bigint")
    got = docs.where(of.isin(list(known))).select(of.alias("id"), F.col(quoted(text_col)).cast("string").alias("text")).where("length(text) > 0").collect()
    texts = {}
    for r in sorted(got, key=lambda r: (r["id"], r["text"])):
        texts.setdefault(r["id"], r["text"])
    if not texts:
        return None
    target = {k: np.array([float(known[i][k]) for i in texts], np.float32) for k in HEADS}
    return fitted(list(texts.values()), target)


def classified(docs: DataFrame, labels: DataFrame, least_quality: float = 0.5, most_toxic: float = 0.5, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, quality_score, toxic_score, n_passages, keep) for every row of docs.

    keep: quality_score >= least_quality and toxic_score < most_toxic. Null and
    empty texts have null scores, no passages, and keep false. Repeated rows are
    scored each. Without any usable label all scores are null, and all documents
    with text are kept. Empty tables give no row; scores that tie with a limit pass
    the lower and fail the upper one. Texts of any length are read whole. Columns but
    those named are not read; ids must be integers or cast to them.
    """
    model = trained(docs, labels, sample, id_col, text_col)

    def run(ids: list, texts: list) -> pa.RecordBatch:
        score, passages_of, none, keep = judged(model, texts, least_quality, most_toxic)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(score[k], pa.float64(), mask=none) for k in HEADS), pa.array(passages_of), pa.array(keep)], ["doc_id", "quality_score", "toxic_score", "n_passages", "keep"])

    return map_text(docs, run, "doc_id bigint, quality_score double, toxic_score double, n_passages bigint, keep boolean", id_col, text_col)


def judged(model: Attention | None, texts: list, least_quality: float, most_toxic: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Each head's scores, numbers of passages, which texts have no scores, which are kept."""
    n = len(texts)
    passages_of, keep = np.zeros(n, np.int64), np.array([bool(t) for t in texts])
    score, none = {k: np.zeros(n) for k in HEADS}, np.ones(n, bool)
    if model is not None:
        doc, many, found = model.scores(texts)
        passages_of[doc], none[doc] = many, False
        for k in HEADS:
            score[k][doc] = found[k]
        keep &= ~none & (score["quality"] >= least_quality) & (score["toxic"] < most_toxic)
    return score, passages_of, none, keep


def accepted(docs: DataFrame, labels: DataFrame, least_quality: float = 0.5, most_toxic: float = 0.5, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that classified() keeps, columns unchanged. Rows are judged where they are, without a shuffle."""
    model = trained(docs, labels, sample, id_col, text_col)
    return filter_text(docs, lambda texts: judged(model, texts, least_quality, most_toxic)[3], text_col)
