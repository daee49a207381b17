"""Scalar functions on DNA strings, as Spark columns."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_K = 31
_LETTERS, _BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def checked_k(k: int) -> int:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be from 1 to {MAX_K}, not {k}")
    return k


def enc(text: Column, other: str = "") -> Column:
    """A text as DNA: letters by their place in the alphabet, modulo four; everything else is `other`."""
    return F.regexp_replace(F.translate(F.lower(text), _LETTERS, _BASES), "[^ACGT]", other)


def normalize_base(seq: Column) -> Column:
    """Upper case, with U as T; other letters stay, and break k-mers."""
    return F.translate(F.upper(seq), "U", "T")


def revcomp(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def canonical(seq: Column) -> Column:
    return F.least(seq, revcomp(seq))


def pack(kmer: Column) -> Column:
    """Two bits a base, the first base highest; at most 31 bases."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def unpack(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def trim(seq: Column, front: int, back: int) -> Column:
    """Without `front` bases at the start and `back` at the end; empty where nothing is left."""
    if front < 0 or back < 0:
        raise ValueError("trims must not be negative")
    return F.substring(seq, F.lit(front + 1), F.greatest(F.length(seq) - front - back, F.lit(0)))


def truncate(seq: Column, length: int, k: int) -> Column:
    """The first bases that are counted of a read; no limit for length 0."""
    return F.substring(seq, 1, max(length, k)) if length else seq


def coverage_ratio(a: Column, b: Column) -> Column:
    """The larger over the smaller; 1 where both are zero, 0 where one is."""
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(low > 0, high / low).when(high == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def coverage_class(cov: Column) -> Column:
    return F.when(cov <= 0, "zero").when(cov < 3, "low").otherwise("ok")


def first_invalid(seq: Column, valid: str = "ACGTUacgtu") -> Column:
    """The 1-based place of the first invalid base, or null."""
    clean = F.length(F.regexp_extract(seq, f"^[{valid}]*", 0))
    return F.when(clean < F.length(seq), clean + 1)


_PAIRS = str.maketrans({format(x, "x"): "ACGT"[x >> 2] + "ACGT"[x & 3] for x in range(16)})


@F.arrow_udf(StringType())
def _in_base_four(digits: pa.Array) -> pa.Array:
    """Decimal digits in base four, as bases, by Python's own long integers."""
    sys.set_int_max_str_digits(0)
    return pa.array([None if d is None else format(int(d), "x").translate(_PAIRS).lstrip("A") or "A" for d in digits.to_pylist()], pa.string())


def index_to_dna(index: Column) -> Column:
    """A decimal index in base four, as bases; white space in it is skipped.  Up to 18 digits in Spark's own arithmetic, beyond by long integers, whole batches at once."""
    index = F.regexp_replace(index, r"\s", "")
    digits = F.when(F.rlike(index, F.lit("^[0-9]+$")), F.regexp_replace(index, "^0+(?=.)", ""))
    short = F.translate(F.conv(digits, 10, 4), "0123", "ACGT")
    return F.when(F.length(digits) <= 18, short).otherwise(_in_base_four(F.when(F.length(digits) > 18, digits)))


def left_pad_a(seq: Column, length: int) -> Column:
    return F.when(F.length(seq) < length, F.lpad(seq, length, "A")).otherwise(seq)


def hamming(a: Column, b: Column) -> Column:
    """Differing places of the common length."""
    n = F.least(F.length(a), F.length(b))
    pairs = F.zip_with(F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), ""), lambda x, y: (x != y).cast("int"))
    return F.when(n == 0, 0).otherwise(F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def starts_with_prefix(kmer: Column, prefix: Column) -> Column:
    """Whether a k-mer or its reverse complement starts with a prefix."""
    return F.startswith(kmer, prefix) | F.startswith(revcomp(kmer), prefix)
