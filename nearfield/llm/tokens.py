"""Token ids as one array, with document boundaries in an Elias-Fano sequence."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.eliasfano import EliasFano
from nearfield.llm.kernels import slices
from nearfield.session import quoted, ship

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_DOCUMENT = 50256
SHARD_TOKENS = 1 << 21
#: Runs of blanks as long as this are encoded by themselves, as the pattern can't match them at any length.
LONG_BLANKS = regex.compile(r"\p{White_Space}{512,}")
#: So long a run shows in every 64th character.
MAY_BE_LONG = regex.compile(r"\p{White_Space}{7}")


def encoding_of(ranks: bytes) -> object:
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


class Encoder:
    """A tokenizer whose ids of a whole text come as an array."""

    def __init__(self, ranks: bytes):
        self.encoding = encoding_of(ranks)

    def __call__(self, text: str | None) -> np.ndarray:
        """Ids of the whole text; a null text has none.

        Of a long run of blanks the pattern takes all but the last as one piece, or
        all at the end of the text; such pieces are cut out, so that no length of a
        run is too much for the pattern.
        """
        if not text:
            return np.zeros(0, np.uint32)
        if not MAY_BE_LONG.search(text[::64]):
            return self.plain(text)
        parts, at = [], 0
        for m in LONG_BLANKS.finditer(text):
            end = m.end() - (m.end() < len(text))
            parts += [self.plain(text[at : m.start()]), np.array(self.encoding._encode_single_piece(text[m.start() : end]), np.uint32)]
            at = end
        if not parts:
            return self.plain(text)
        return np.concatenate([*parts, self.plain(text[at:])])

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.uint32)


@lru_cache(2)
def encoder(ranks: bytes) -> Encoder:
    """The worker's encoder for a vocabulary, kept from task to task."""
    return Encoder(ranks)


def greatest_id(ranks: bytes) -> int:
    return max((int(line.split()[1]) for line in ranks.splitlines() if line), default=0)


SCHEMA = "shard string, doc_ids array<bigint>, n_docs bigint, n_tokens bigint, width int, ids binary, low_bits int, low binary, high binary, samples binary"


def shard(name: str, doc_ids: list, parts: list[np.ndarray], width: int) -> pa.RecordBatch:
    ends = np.cumsum([len(p) for p in parts])
    ef = EliasFano.of(ends, int(ends[-1]) + 1)
    ids = np.concatenate(parts).astype(f"<u{width}")
    row = [name, doc_ids, len(parts), int(ends[-1]), width, ids.tobytes(), ef.low_bits, ef.low.tobytes(), ef.high.tobytes(), ef.samples.astype("<u8").tobytes()]
    types = [pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])


def token_shards(docs: DataFrame, tokenizer: str = TOKENIZER, end_of_document: int | None = END_OF_DOCUMENT, shard_tokens: int = SHARD_TOKENS, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of SCHEMA: the ids of many documents in one little-endian array of width bytes each, and where they end.

    Every row of docs has its place in a shard's doc_ids, in reading order; null and
    empty texts have the end_of_document id alone (no id if that is None), repeated
    rows are stored each. A shard closes once it has shard_tokens ids; a longer
    document makes a longer shard. Empty tables give no shard. low_bits, low, high
    and samples are an Elias-Fano sequence of the documents' ends; `document` reads
    single documents by its select structure.
    """
    ship(docs.sparkSession)
    ranks = Path(tokenizer).read_bytes()
    if max(greatest_id(ranks), end_of_document or 0) >> (8 * width):
        raise ValueError(f"ids don't fit in {width} bytes")
    tail = np.array([] if end_of_document is None else [end_of_document], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(ranks)
        part, count, doc_ids, parts, total = TaskContext.get().partitionId(), 0, [], [], 0
        for ids, texts in slices(batches, 1 << 19):
            for i, text in zip(ids, texts, strict=True):
                doc_ids.append(i)
                parts.append(np.concatenate([encode(text), tail]).astype(np.uint16 if width == 2 else np.uint32))
                total += len(parts[-1])
                if total >= shard_tokens:
                    yield shard(f"{part:06d}-{count:06d}", doc_ids, parts, width)
                    count, doc_ids, parts, total = count + 1, [], [], 0
        if parts:
            yield shard(f"{part:06d}-{count:06d}", doc_ids, parts, width)

    return docs.select(F.col(quoted(id_col)).cast("bigint").alias("id"), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def boundaries(row: dict) -> EliasFano:
    """The documents' ends in a shard."""
    raw = lambda k: np.frombuffer(bytes(row[k]), np.uint8)
    return EliasFano(row["n_docs"], row["low_bits"], raw("low"), raw("high"), raw("samples").view("<u8"))


def document(row: dict, k: int) -> np.ndarray:
    """Ids of the shard's k-th document."""
    ef = boundaries(row)
    begin = int(ef.get(np.array([k - 1]))[0]) if k else 0
    end = int(ef.get(np.array([k]))[0])
    return np.frombuffer(bytes(row["ids"]), f"<u{row['width']}")[begin:end]
