import sys
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixlake.functions import dna, kmers

TURN = str.maketrans("ACGT", "TGCA")


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s"))).first()[0]


def brute(seq, k):
    seq = seq.upper().replace("U", "T")
    out = []
    for i in range(len(seq) - k + 1):
        w = seq[i : i + k]
        if set(w) <= set("ACGT"):
            out.append((i, min(w, w[::-1].translate(TURN))))
    return out


@pytest.mark.parametrize("engine", ["arrow", "sql"])
@pytest.mark.parametrize("k", [1, 2, 4, 7, 31])
def test_kmers_match_brute_force(spark, engine, k):
    seqs = ["ACGTACGT", "AAAAAAAA", "", None, "acgun" * 30, "GATTACA" * 40 + "N" + "ACGT" * 60, "NNNN", "A" * 30, "TTTTGGGGCCCCAAAATGCA" * 25]
    df = spark.createDataFrame(list(enumerate(seqs)), "strand_id long, seq string")
    got = kmers.kmers_ordered(df, k, engine=engine).withColumn("kmer", dna.unpack(F.col("kmer"), k)).collect()
    want = [(i, pos, km) for i, s in enumerate(seqs) for pos, km in brute(s or "", k)]
    assert sorted((r.strand_id, r.pos, r.kmer) for r in got) == sorted(want)


def test_distinct_kmers(spark):
    df = spark.createDataFrame([(0, "ACGTACGT"), (1, "AAAAAAAA")], "strand_id long, seq string")
    assert sorted((r.strand_id, r["count"]) for r in kmers.kmers_distinct(df, 4).groupBy("strand_id").count().collect()) == [(0, 3), (1, 1)]


def test_k_is_checked(spark):
    df = spark.createDataFrame([], "strand_id long, seq string")
    for k in (0, 32):
        with pytest.raises(ValueError):
            kmers.kmers_ordered(df, k)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("ACGT", min_size=1, max_size=31))
def test_canonical_is_the_same_for_both_strands(spark, s):
    turned = s[::-1].translate(TURN)
    df = spark.createDataFrame([(s, turned)], "a string, b string")
    r = df.select(dna.canonical(F.col("a")).alias("a"), dna.canonical(F.col("b")).alias("b"), dna.unpack(dna.pack(F.col("a")), len(s)).alias("p")).first()
    assert r.a == r.b == min(s, turned) and r.p == s


def test_revcomp(spark):
    assert one(spark, "AAAA", dna.revcomp) == "TTTT"
    assert one(spark, "ACGT", dna.revcomp) == "ACGT"
    assert one(spark, "AACG", dna.canonical) == one(spark, "CGTT", dna.canonical)


def test_trims_and_pads(spark):
    assert one(spark, "ACGTACGT", lambda s: dna.trim(s, 2, 3)) == "GTA"
    assert one(spark, "ACGT", lambda s: dna.trim(s, 3, 3)) == ""
    assert one(spark, "ACGT", lambda s: dna.left_pad_a(s, 6)) == "AAACGT"
    assert one(spark, "ACGTACGT", lambda s: dna.left_pad_a(s, 6)) == "ACGTACGT"
    assert one(spark, "ACGTACGT", lambda s: dna.truncate(s, 3, 5)) == "ACGTA"
    assert one(spark, "ACXGT", dna.first_invalid) == 3
    assert one(spark, "ACGTu", dna.first_invalid) is None


def test_index_to_dna(spark):
    def want(n):
        out = ""
        while n:
            out, n = "ACGT"[n % 4] + out, n // 4
        return out or "A"

    for n in (0, 1, 3, 4, 27, 10**17, 10**18 - 1, 10**18, 2**64 + 12345, 10**40 + 7, 4**50):
        assert one(spark, str(n), dna.index_to_dna) == want(n)
    assert one(spark, "000012", dna.index_to_dna) == want(12)
    assert one(spark, "12x", dna.index_to_dna) is None


def test_coverage_ratio_and_class(spark):
    df = spark.createDataFrame([(4, 2), (2, 4), (0, 0), (3, 0), (0, 3)], "a int, b int")
    assert [r[0] for r in df.select(dna.coverage_ratio(F.col("a"), F.col("b"))).collect()] == [2.0, 2.0, 1.0, 0.0, 0.0]
    assert [r[0] for r in df.select(dna.coverage_class(F.col("a"))).collect()] == ["ok", "low", "zero", "ok", "zero"]


def test_hamming(spark):
    df = spark.createDataFrame([("ACGT", "ACGA"), ("", "A"), ("AAAA", "TT")], "a string, b string")
    assert [r[0] for r in df.select(dna.hamming(F.col("a"), F.col("b"))).collect()] == [1, 0, 2]


def test_long_indexes_take_little_time(spark):
    """Twenty digits to some thousand, 20,000 rows: seconds, not minutes."""
    numbers = [10**20 + i**5 for i in range(20_000)] + [7**n for n in (500, 2000, 6000)]
    sys.set_int_max_str_digits(0)
    started = time.monotonic()
    got = [r[0] for r in spark.createDataFrame([(str(n),) for n in numbers], "x string").select(dna.index_to_dna(F.col("x"))).collect()]
    assert time.monotonic() - started < 20
    values = [int(x.translate(str.maketrans("ACGT", "0123")), 4) for x in got]
    assert values == numbers and all(x[0] != "A" for x in got)
