"""Bit strings as struct<nbits: int, words: array<bigint>>, most significant bit first, the last word filled up with zeros."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.functions.dense import fail


def packed(flags: Column) -> Column:
    """A bit string from an array of booleans."""
    n = F.size(flags)

    def word(k: Column) -> Column:
        part = F.slice(flags, (k * 64 + 1).cast("int"), 64)
        bits = F.aggregate(part, F.lit(0).cast("bigint"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x, 1).otherwise(0).cast("bigint")))
        return F.call_function("shiftleft", bits, 64 - F.size(part))

    words = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 64).cast("int")), word))
    return F.when(flags.isNull(), None).otherwise(F.struct(n.alias("nbits"), words.alias("words")))


def binary_quantize(v: Column) -> Column:
    """A bit for each element: whether it is above zero."""
    return packed(F.transform(v, lambda x: x > 0))


def bits_from_text(s: Column) -> Column:
    good = s.rlike("^[01]*$")
    flags = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: c == "1")
    return F.when(s.isNull(), None).when(good, packed(flags)).otherwise(fail('"', s, '" is not a valid binary string'))


def bits_to_text(b: Column) -> Column:
    return F.substring(F.array_join(F.transform(b["words"], lambda w: F.lpad(F.conv(F.hex(w), 16, 2), 64, "0")), ""), F.lit(1), b["nbits"])


def same_length(a: Column, b: Column, result: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), None).when(a["nbits"] == b["nbits"], result).otherwise(fail("different bit lengths ", a["nbits"], " and ", b["nbits"]))


def ones(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda s, w: s + F.bit_count(w))


def hamming_distance(a: Column, b: Column) -> Column:
    return same_length(a, b, ones(F.zip_with(a["words"], b["words"], lambda x, y: x.bitwiseXOR(y))).cast("double"))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - |a & b| / |a | b|; 1 if they share no bit."""
    both = ones(F.zip_with(a["words"], b["words"], lambda x, y: x.bitwiseAND(y)))
    either = ones(F.zip_with(a["words"], b["words"], lambda x, y: x.bitwiseOR(y)))
    return same_length(a, b, F.when(both == 0, 1.0).otherwise(1 - both / either))
