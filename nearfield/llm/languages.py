"""Language identification: string kernels, Nyström landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.kernels import U, folded, hashed_sample, map_text, mix
from nearfield.session import quoted

#: Labelled documents that training uses at most.
SAMPLE = 2000
LANDMARKS = 96
RIDGE = 1e-3
#: Texts whose presence rows are multiplied at once hold this many cells at most.
CELLS = 1 << 22
#: and this many characters, or one longer text.
CHARS = 1 << 19
CHAR_BITS = U(18)


def spectrum(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(keys, text) of all 1-, 2- and 3-grams of lower-case letters and digits within words, the blanks around words included."""
    f, starts = folded(["", *texts], " \n ")  # so that the first word too has a blank before it
    keep = f != 0
    keep[1:] |= keep[:-1].copy()
    keep[0] = True
    f, place = f[keep].astype(np.uint64), np.flatnonzero(keep)
    if len(f) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    of = np.searchsorted(starts, place, "right") - 2
    letter = f != 0
    one = np.flatnonzero(letter)
    two = np.flatnonzero(letter[1:])  # what ends a word before the pair is its blank
    end = np.flatnonzero(letter[:-1] & ~letter[1:])
    three = np.flatnonzero(letter[1:-1])
    key = np.concatenate(
        [
            f[one] | U(1 << 60),
            (f[two] << CHAR_BITS) | f[two + 1] | U(2 << 60),
            (f[end] << CHAR_BITS) | U(2 << 60),
            (f[three] << U(36)) | (f[three + 1] << CHAR_BITS) | f[three + 2] | U(3 << 60),
        ]
    )
    return key, np.concatenate([of[one], of[two + 1], of[end], of[three + 1]])


class Columns:
    """An open-addressed table from n-gram keys to columns."""

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        self.bits = max(8, (8 * max(self.n, 1)).bit_length())
        self.key, self.column = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(self.n), self.slot(keys)
        while len(left):
            free = self.column[at] < 0
            self.column[at[free]], self.key[at[free]] = left[free], keys[left[free]]
            stay = self.column[at] != left
            left, at = left[stay], (at[stay] + 1) & (1 << self.bits) - 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot(keys)
        out = self.column[at]
        left = np.flatnonzero((out >= 0) & (self.key[at] != keys))
        at = at[left]
        while len(left):
            at = (at + 1) & (1 << self.bits) - 1
            out[left] = self.column[at]
            wrong = (out[left] >= 0) & (self.key[at] != keys[left])
            left, at = left[wrong], at[wrong]
        return out


class Kernel:
    """Presence kernels with the landmarks: k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), G being all n-grams of a text."""

    def __init__(self, landmarks: list):
        vocabulary = np.unique(np.concatenate([np.unique(spectrum([t])[0]) for t in landmarks]))
        self.columns = Columns(vocabulary)
        self.width = max(1, len(vocabulary))
        rows = np.concatenate([self.presence([t])[0] for t in landmarks])
        self.size = np.sqrt(np.maximum(rows.sum(1), 1))
        self.landmarks = np.ascontiguousarray((rows / self.size[:, None]).T)

    def presence(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """A row for each text with 1 for each landmarks' n-gram that it has, and how many other different n-grams it has."""
        out = np.zeros((len(texts), self.width), np.float32)
        keys, of = spectrum(texts)
        if not len(keys):
            return out, np.zeros(len(texts))
        column = self.columns.find(keys)
        known = column >= 0
        out[of[known], column[known]] = 1
        other = np.unique(mix(keys[~known]) ^ mix(of[~known].astype(np.uint64)), return_index=True)[1]
        return out, np.bincount(of[~known][other], minlength=len(texts)).astype(np.float64)

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Kernel values, a row for each text and a column for each landmark, and how many known n-grams each text has."""
        out, many = [np.zeros((0, self.landmarks.shape[1]), np.float32)], [np.zeros(0)]
        at = 0
        while at < len(texts):
            to = size = 0
            for to in range(at + 1, len(texts) + 1):
                size += len(texts[to - 1] or "")
                if size >= CHARS or (to - at + 1) * self.width > CELLS:
                    break
            rows, others = self.presence(texts[at:to])
            n = rows.sum(1)
            out.append((rows @ self.landmarks / np.sqrt(np.maximum(n + others, 1))[:, None]).astype(np.float32))
            many.append(n)
            at = to
        return np.concatenate(out), np.concatenate(many)


class Classifier:
    """One ridge regression for each language on the landmarks' kernels: a = (K'K + n ridge M)^-1 K'Y."""

    def __init__(self, texts: list, names: list, landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.names = sorted(set(names))
        order = {n: [k for k, x in enumerate(names) if x == n] for n in self.names}
        chosen = [own[d] for d in range(max(map(len, order.values()))) for own in order.values() if d < len(own)]
        chosen = chosen[: max(landmarks, len(self.names))]
        self.kernel = Kernel([texts[k] for k in chosen])
        k = self.kernel(texts)[0].astype(np.float64)
        m = k[chosen]
        y = np.where(np.array(names)[:, None] == np.array(self.names)[None, :], 1.0, -1.0)
        left = k.T @ k + len(texts) * ridge * (m + m.T) / 2 + 1e-9 * len(texts) * np.eye(len(chosen))
        self.weights = np.linalg.solve(left, k.T @ y).astype(np.float32)

    def scores(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        k, many = self.kernel(texts)
        return k @ self.weights, many


def trained(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Classifier | None:
    """A classifier from about `sample` labelled documents at most, chosen by a hash of their ids; None if none has text."""
    of, text, lang = F.col(quoted(id_col)).cast("bigint"), F.col(quoted(text_col)).cast("string"), F.col(quoted(lang_col)).cast("string")
    usable = docs.where(of.isNotNull() & lang.isNotNull() & (F.length(text) > 0))
    ids = sorted({r["id"] for r in hashed_sample(usable.select(of.alias("id")), sample).collect()})
    if not ids:
        return None
    got = usable.where(of.isin(ids)).groupBy(of.alias("id")).agg(F.min(F.struct(lang.alias("lang"), text.alias("text"))).alias("r")).collect()
    got.sort(key=lambda r: (mix(np.array([r["id"]], np.int64).view(np.uint64))[0], r["id"]))
    return Classifier([r["r"]["text"] for r in got], [r["r"]["lang"] for r in got], landmarks, ridge)


def identified(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, language, score, margin) for every row of docs.

    language: of the greatest score; margin: how far the next one's score lies
    below it. Languages come from lang_col of at most about `sample` rows; rows
    without label, id or text teach nothing. The greatest score of equal ones is that of
    the first name. Null and empty texts, and texts that share no n-gram with
    any landmark, have nulls; so have all if no row has a label. With one language
    margins are null. Repeated rows are scored each; a null doc_id stays null. Empty
    tables give no row. Texts of any length count whole. Columns but those named are
    not read; ids must be integers or cast to them.
    """
    model = trained(docs, sample, landmarks, ridge, id_col, text_col, lang_col)

    def run(ids: list, texts: list) -> pa.RecordBatch:
        n = len(ids)
        best, score, margin, none = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.ones(n, bool)
        names = model.names if model is not None else []
        if names:
            s, many = model.scores(texts)
            none = many == 0
            best = s.argmax(1)
            score = s[np.arange(n), best].astype(np.float64)
            if len(names) > 1:
                margin = score - np.partition(s, -2, axis=1)[:, -2]
        label = pa.array([None if x else names[b] for b, x in zip(best, none, strict=True)], pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), label, pa.array(score, pa.float64(), mask=none), pa.array(margin, pa.float64(), mask=none | (len(names) < 2))], ["doc_id", "language", "score", "margin"]
        )

    return map_text(docs, run, "doc_id bigint, language string, score double, margin double", id_col, text_col)
