"""Secret scans: a battery of randomness tests with false-discovery control."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.kernels import map_text, slices
from nearfield.session import durable, release

#: Symbols of the shortest token that is tested, unless the caller asks for another.
SHORTEST = 16
FALSE_DISCOVERIES = 0.01
RANDOMNESS_LEVEL = 0.001
MARK = "[SECRET]"
#: Signs that join the parts of a run: none, '/', '-' and '_', all three, and all signs.
JOINTS = ("", "/", "-_", "/-_", "/-_+")
SIGNS = "+/-_"
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
LOWER, UPPER, DIGITS = SYMBOLS[26:52], SYMBOLS[:26], SYMBOLS[52:62]
#: Encodings in the order in which they are tried, smaller ones first; each symbol's place is its value.
ALPHABETS = {
    "decimal": DIGITS,
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "lower": LOWER,
    "UPPER": UPPER,
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "letters": UPPER + LOWER,
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
    "base64any": UPPER + LOWER + DIGITS + "+/-_",
}
NAMES, SIZES = list(ALPHABETS), np.array([len(a) for a in ALPHABETS.values()])
#: Least evidence (natural log of a p-value) of the last bin and width of a bin.
LOG_BINS, LOG_WIDTH = 4000, 0.05


def values_table() -> np.ndarray:
    """Each byte's value in each encoding, -1 if it is not in its alphabet."""
    out = np.full((len(NAMES), 256), -1, np.int64)
    for row, alphabet in zip(out, ALPHABETS.values(), strict=True):
        row[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    return out


def places_table() -> np.ndarray:
    """Each byte's place in SYMBOLS, or the place after the last."""
    out = np.full(256, len(SYMBOLS), np.int64)
    out[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))
    return out


VALUES, PLACES = values_table(), places_table()
WIDE = len(SYMBOLS) + 1


class Tokens:
    """Many tokens as one array of bytes and their bounds; the smallest alphabet that holds one is its encoding."""

    def __init__(self, tokens: list[str]):
        self.raw = np.frombuffer("".join(tokens).encode(), np.uint8)
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.first = np.cumsum(self.size) - self.size
        self.of = np.repeat(np.arange(len(tokens)), self.size)
        fits = np.stack([np.logical_and.reduceat(row[self.raw] >= 0, self.first) for row in VALUES]) if tokens else np.zeros((len(NAMES), 0), bool)
        self.encoding = fits.argmax(0)


def candidates(text: str, shortest: int) -> list[tuple[int, str]]:
    """(place, token) of each run of SYMBOLS and of its parts between joints, of `shortest` symbols at least, each once. Joints at a part's begin don't belong to it."""
    out = {}
    for m in runs_of(shortest).finditer(text):
        run, begin = m.group(), m.start()
        if run.isalnum():
            out[begin, m.end()] = run
            continue
        for joints in JOINTS:
            for part in parts_of(joints, shortest).finditer(run):
                at, end = part.span()
                at += len(part.group()) - len(part.group().lstrip(SIGNS))
                if end - at >= shortest:
                    out[begin + at, begin + end] = run[at:end]
    return [(at, token) for (at, _), token in out.items()]


@lru_cache(16)
def runs_of(shortest: int) -> re.Pattern:
    return re.compile(r"[A-Za-z0-9+/_-]{%d,}" % shortest)


@lru_cache(64)
def parts_of(joints: str, shortest: int) -> re.Pattern:
    return re.compile("[A-Za-z0-9%s]{%d,}" % ("".join("\\" + c for c in SIGNS if c not in joints), shortest))


def normal_tail(z: np.ndarray) -> np.ndarray:
    """P(N > z)."""
    return 0.5 * np.fromiter(map(math.erfc, np.asarray(z) / math.sqrt(2)), np.float64, len(z))


def total(x: np.ndarray, t: Tokens) -> np.ndarray:
    """Sums over each token."""
    return np.add.reduceat(x.astype(np.float64), t.first)


def uniform_p(values: np.ndarray, t: Tokens, size: np.ndarray) -> np.ndarray:
    """Chi-squared uniformity of the symbols, joined into cells that expect four symbols at least (Wilson-Hilferty tail)."""
    cells = np.maximum(2, np.minimum(size, t.size // 4))
    begin = np.cumsum(cells) - cells
    seen = np.bincount(begin[t.of] + values * cells[t.of] // size[t.of], minlength=int(cells.sum()))
    of = np.repeat(np.arange(len(cells)), cells)
    k, c, s = np.arange(len(of)) - begin[of], cells[of], size[of]
    symbols = -(-(k + 1) * s // c) + (-k * s // c)  # of the alphabet that fall into the cell
    expected = t.size[of] * symbols / s
    x = np.add.reduceat((seen - expected) ** 2 / expected, begin)
    d = cells - 1
    return normal_tail(((x / d) ** (1 / 3) - (1 - 2 / (9 * d))) / np.sqrt(2 / (9 * d)))


def runs_p(values: np.ndarray, t: Tokens, size: np.ndarray) -> np.ndarray:
    """Wald-Wolfowitz runs above and below the middle of the alphabet, two-sided."""
    high = values * 2 >= size[t.of]
    n, a = t.size, total(high, t)
    b = n - a
    steps = np.concatenate([[False], high[1:] != high[:-1]])
    steps[t.first] = False
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / np.maximum(n - 1, 1)
    p = 2 * normal_tail(np.maximum(0.0, (np.abs(1 + total(steps, t) - mean) - 0.5) / np.sqrt(np.where(var > 0, var, 1))))
    return np.where((a == 0) | (b == 0), 2.0 ** (1 - n), np.where(var > 0, p, 1.0))


def serial_p(values: np.ndarray, t: Tokens) -> np.ndarray:
    """Correlation of neighbouring symbols, two-sided."""
    x = values - (total(values, t) / t.size)[t.of]
    s = total(x * x, t)
    both = np.concatenate([[0.0], x[1:] * x[:-1]])
    both[t.first] = 0
    r = total(both, t) / np.where(s > 0, s, 1)
    return np.where(s > 0, 2 * normal_tail(np.abs(r + 1 / t.size) * np.sqrt(t.size)), 2.0 ** (1 - t.size))


def battery(t: Tokens) -> np.ndarray:
    """Rows of (uniformity, runs, serial correlation, all three by Fisher's method) p-values of the tokens as random draws."""
    if not len(t.size):
        return np.zeros((0, 4))
    values, size = VALUES[t.encoding[t.of], t.raw], SIZES[t.encoding]
    p = np.clip(np.stack([uniform_p(values, t, size), runs_p(values, t, size), serial_p(values, t)], axis=1), 1e-300, 1)
    half = -np.log(p).sum(1)
    return np.concatenate([p, (np.exp(-half) * (1 + half + half * half / 2))[:, None]], axis=1)


def pair_counts(texts: list) -> np.ndarray:
    """How often each pair of neighbouring symbols occurs in the texts; all other bytes count as one symbol more."""
    place = PLACES[np.frombuffer(("\n" + "\n".join(t or "" for t in texts) + "\n").encode("utf-8", "surrogatepass"), np.uint8)]
    return np.bincount(place[:-1] * WIDE + place[1:], minlength=WIDE * WIDE)


#: Of each symbol: its class (capital, small letter, digit, each sign, all other bytes), the symbol that stands for it whatever its case, and that one's kind.
CLASS = np.array([0] * 26 + [1] * 26 + [2] * 10 + [3, 4, 5, 6, 7])
FOLD = np.array([*range(26), *range(26), *range(26, WIDE - 26)])
KIND = np.array([0] * 26 + [1] * 10 + [2, 3, 4, 5, 6])


class Text:
    """The corpus's own text as a chain of symbols.

    The class of each symbol follows that of the one before it; which symbol of its
    class it is follows the one before it without regard to case, so that capitals
    and joined words are judged by the letters of all words.
    """

    def __init__(self, counts: np.ndarray):
        n = counts.reshape(WIDE, WIDE).astype(np.float64)
        classes, folds = np.full((8, 8), 0.5), np.zeros((WIDE - 26, WIDE - 26))
        np.add.at(classes, (CLASS[:, None], CLASS[None, :]), n)
        np.add.at(folds, (FOLD[:, None], FOLD[None, :]), n)
        folds += 0.5
        within = np.stack([folds[:, KIND == k].sum(1) for k in range(7)], axis=1)
        chance = folds / within[:, KIND]
        classes /= classes.sum(1, keepdims=True)
        self.next = np.log(classes[CLASS[:, None], CLASS[None, :]] * chance[FOLD[:, None], FOLD[None, :]])
        own = n.sum(1) + 0.5
        self.first = np.log(own / own.sum())

    def log_p(self, t: Tokens) -> np.ndarray:
        """ln of the ratio of each token's probability in text to that as a uniform draw, 0 at most: a p-value for text, by Markov's inequality."""
        if not len(t.size):
            return np.zeros(0)
        place = PLACES[t.raw]
        each = np.concatenate([[0.0], self.next[place[:-1], place[1:]]])
        each[t.first] = self.first[place[t.first]]
        return np.minimum(0.0, total(each, t) + t.size * np.log(SIZES[t.encoding]))


def bin_of(log_p: np.ndarray, size: np.ndarray, mean: float) -> np.ndarray:
    """Bins of the log p-values, weighted by length (weights of mean 1) and rounded up."""
    return np.clip(np.floor(-(log_p - np.log(size / mean)) / LOG_WIDTH), 0, LOG_BINS).astype(np.int64)


TESTED = "doc_id bigint, position bigint, token string, encoding string, p_uniform double, p_runs double, p_serial double, p_random double"


def scanned(docs: DataFrame, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Candidates with their tests, and for each slice of texts the counts of its pairs of symbols."""

    def run(ids: list, texts: list) -> pa.RecordBatch | None:
        rows = [(i, at, token) for i, t in zip(ids, texts, strict=True) if t for at, token in candidates(t, shortest)]
        t = Tokens([r[2] for r in rows])
        columns = [*(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))), pa.array([NAMES[k] for k in t.encoding], pa.string()), *map(pa.array, battery(t).T.copy())]
        columns = [pa.concat_arrays([c, pa.nulls(1, c.type)]) for c in columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array([None] * len(rows) + [pair_counts(texts)], pa.list_(pa.int64()))], [*(x.split()[0] for x in TESTED.split(", ")), "counts"])

    return map_text(docs, run, f"{TESTED}, counts array<bigint>", id_col, text_col)


@dataclass(frozen=True)
class Rule:
    """What all candidates of a corpus say about which of them are secrets."""

    text: Text
    mean: float
    least: int
    level: float

    def __call__(self, t: Tokens, p_random: np.ndarray) -> np.ndarray:
        return (bin_of(self.text.log_p(t), t.size, self.mean) >= self.least) & (p_random > self.level)


def ruled(docs: DataFrame, false_discoveries: float, randomness_level: float, shortest: int, id_col: str, text_col: str) -> tuple[DataFrame, Rule]:
    """Candidates with log_p_text, and the rule that they set."""
    rows = durable(scanned(docs, shortest, id_col, text_col), "candidates")
    counts = np.zeros(WIDE * WIDE, np.int64)
    for r in rows.where("counts is not null").select(F.posexplode("counts").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        counts[r["k"]] = r["n"]
    text = Text(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            log_p = text.log_p(Tokens(b.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(log_p)], [*b.schema.names, "log_p_text"])

    found = durable(rows.where("token is not null").drop("counts").mapInArrow(run, f"{TESTED}, log_p_text double").withColumn("length", F.length("token").cast("bigint")), "tested")
    release(rows)
    m, mean = found.agg(F.count("*"), F.avg("length")).first()
    mean = float(mean or 1)
    weighted = F.col("log_p_text") - F.log(F.col("length") / F.lit(mean))
    level = F.least(F.lit(LOG_BINS), F.greatest(F.lit(0), F.floor(-weighted / LOG_WIDTH))).cast("int")
    binned = found.withColumn("bin", level)
    least = threshold({r["bin"]: r["count"] for r in binned.groupBy("bin").count().collect()}, m, false_discoveries)
    return binned, Rule(text, mean, least, randomness_level)


def secrets(docs: DataFrame, false_discoveries: float = FALSE_DISCOVERIES, randomness_level: float = RANDOMNESS_LEVEL, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text", keep_tokens: bool = False) -> DataFrame:
    """(doc_id, position, length, encoding, p_uniform, p_runs, p_serial, p_random, log_p_text) of each secret; with keep_tokens also token.

    Candidates are all runs of `shortest` base64 symbols at least, and as well their
    parts between '/', '-', '_' and '+', as these also join secrets to words and
    paths. Each is a test of its own and a row of its own, so rows of one run may
    overlap. The smallest alphabet that holds one is its encoding. It must look like
    a random draw from that alphabet: chi-squared uniformity, runs and serial
    correlation, combined by Fisher's method, don't reject that at randomness_level.
    And it must not look like text: the ratio of its probability under the
    corpus's pairs of symbols to that under uniform draws is a p-value for text, on which
    Benjamini-Hochberg's procedure, weighted by length (weights of mean 1), keeps the
    share of false discoveries below false_discoveries over all candidates of the
    corpus. A number is thus judged by how seldom so many digits follow one another.
    Log p-values are rounded up to bins of 0.05, whose counts are, besides
    those of pairs of symbols, all that the driver sees.

    Positions count characters from 0. Null and empty texts and empty tables have
    no candidates. Repeated rows are tested each; a null doc_id stays null. Texts of
    any length are read whole. Columns but id_col and text_col are not read; ids must
    be integers or cast to them.
    """
    found, rule = ruled(docs, false_discoveries, randomness_level, shortest, id_col, text_col)
    kept = found.where((F.col("bin") >= rule.least) & (F.col("p_random") > randomness_level))
    names = ["doc_id", "position", "length", "encoding", "p_uniform", "p_runs", "p_serial", "p_random", "log_p_text"]
    return kept.select(*names, *(["token"] if keep_tokens else []))


def threshold(bins: dict[int, int], m: int, rate: float) -> int:
    """The least bin that Benjamini-Hochberg rejects over m tests whose p-values are exp(-bin * LOG_WIDTH)."""
    best, upto = LOG_BINS + 1, 0
    for b in sorted(bins, reverse=True):
        upto += bins[b]
        if b > 0 and -b * LOG_WIDTH <= math.log(rate * upto / m):
            best = b
    return best


def blotted(text: str, found: list[tuple[int, str]], mark: str) -> str:
    """text without the tokens (place, token), wherever they stand: those that overlap go together."""
    spans: list[list[int]] = []
    for at, token in sorted(found):
        if spans and at < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], at + len(token))
        else:
            spans.append([at, at + len(token)])
    out, last = [], 0
    for at, end in spans:
        out += [text[last:at], mark]
        last = end
    text = "".join([*out, text[last:]])
    for token in sorted({token for _, token in found}, key=len, reverse=True):
        text = text.replace(token, mark)
    return text


def redacted(
    docs: DataFrame, false_discoveries: float = FALSE_DISCOVERIES, randomness_level: float = RANDOMNESS_LEVEL, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text", mark: str = MARK
) -> DataFrame:
    """All rows of docs, each secret in the text replaced by mark; n_chars, if there is one, follows. Columns unchanged.

    Secrets are those of secrets(). One scan of the texts sets the rule, another
    applies it to each text where it is, so that texts are never shuffled. Null and
    empty texts and those without secrets stay as they are, and so do rows without
    id and repeated ones.
    """
    rule = ruled(docs, false_discoveries, randomness_level, shortest, id_col, text_col)[1]
    at = next(k for k, c in enumerate(docs.columns) if c.lower() == text_col.lower())
    size = next((k for k, c in enumerate(docs.columns) if c.lower() == "n_chars"), None)

    def change(texts: list) -> dict[int, str]:
        rows = [(k, place, token) for k, t in enumerate(texts) if t for place, token in candidates(t, shortest)]
        t = Tokens([r[2] for r in rows])
        found: dict[int, list] = {}
        for k in np.flatnonzero(rule(t, battery(t)[:, 3])):
            found.setdefault(rows[k][0], []).append(rows[k][1:])
        return {k: blotted(texts[k], x, mark) for k, x in found.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, new, done = b.column(at).cast(pa.string()), {}, 0
            for _, texts in slices([pa.RecordBatch.from_arrays([text, text], ["id", "text"])]):
                new |= {done + k: x for k, x in change(texts).items()}
                done += len(texts)
            if new:
                columns = list(b.columns)
                mask, order = np.zeros(b.num_rows, bool), np.array(sorted(new))
                mask[order] = True
                own = pa.array([new[k] for k in order.tolist()], pa.string())
                columns[at] = pc.replace_with_mask(text, pa.array(mask), own).cast(b.schema.field(at).type)
                if size is not None:
                    lengths = pa.array([len(new[k]) for k in order.tolist()], pa.int64()).cast(b.schema.field(size).type)
                    columns[size] = pc.replace_with_mask(b.column(size), pa.array(mask), lengths)
                b = pa.RecordBatch.from_arrays(columns, schema=b.schema)
            yield b

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names with dots can't be passed on
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
