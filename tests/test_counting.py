"""Counting in buckets and looking paths up there, against plain Python."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from helixlake.functions import kmers
from helixlake.functions.dna import unpack
from helixlake.operators import batchqc, counts, recovery


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def windows(seq, k):
    seq = (seq or "").upper().replace("U", "T")
    return [(i, min(w, turned(w))) for i in range(len(seq) - k + 1) if set(w := seq[i : i + k]) <= set("ACGT")]


def sequences(rng, n, most):
    return ["".join(rng.choice("ACGTACGTacgUN") for _ in range(rng.randint(0, most))) for _ in range(n)] + ["", None, "A" * most]


@pytest.mark.parametrize("budget", [None, 2, 50])
def test_any_number_of_buckets_counts_the_same(spark, budget):
    rng = random.Random(1)
    seqs = sequences(rng, 60, 80)
    want: dict = {}
    for s in seqs:
        for _, w in windows(s, 5):
            want[w] = want.get(w, 0) + 1
    df = spark.createDataFrame([(s,) for s in seqs], "seq string").repartition(3)
    assert kmers.Deal(df, budget=budget).bits >= (4 if budget is None else 6)
    packed = kmers.kmer_occurrences(df, 5, budget=budget)
    assert rows(packed.select(unpack(F.col("kmer"), 5), "n")) == rows(kmers.kmer_occurrences(df, 5, text=True, budget=budget)) == sorted(want.items(), key=repr)


def test_more_bases_make_more_buckets(spark):
    few, many = (spark.createDataFrame([("ACGT" * n,)], "seq string") for n in (10, 100_000))
    assert kmers.Deal(many, budget=1000).bits == kmers.Deal(few, budget=1000).bits + 6 and 2 ** kmers.Deal(many, budget=1000).bits >= 2 * 400_000 / 1000


@pytest.mark.parametrize("source", ["reads", "table"])
@pytest.mark.parametrize("every", [False, True])
def test_paths_are_looked_up(spark, source, every):
    rng = random.Random(7)
    reads, strands = sequences(rng, 30, 60), sequences(rng, 12, 40)
    strands[2] = "ACGACGACGACG" * 3
    seen: dict = {}
    for s in reads:
        for _, w in windows(s, 4):
            seen[w] = seen.get(w, 0) + 1
    want = {}
    for i, s in enumerate(strands):
        path = windows(s, 4)
        if not every:
            path = [(p, w) for n, (p, w) in enumerate(path) if w not in [x for _, x in path[:n]]]
        if path:
            want[f"s{i}"] = ([p for p, _ in path], [w for _, w in path], [min(seen.get(w, 0), 9) for _, w in path])
    df = spark.createDataFrame([(s,) for s in reads], "seq string").repartition(2)
    own = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(strands)], "name string, seq string")
    counted = df if source == "reads" else kmers.kmer_occurrences(df, 4)
    got = kmers.Paths(own, counted, 4, 9, "name", every).rows().select("name", "pos", F.transform("kmer", lambda x: unpack(x, 4)).alias("kmer"), "cov").collect()
    assert {r["name"]: (r.pos, r.kmer, r.cov) for r in got} == want


def test_rows_and_arrays_give_the_same(spark):
    rng = random.Random(3)
    own = spark.createDataFrame([(i, f"n{i}", s) for i, s in enumerate(sequences(rng, 20, 60))], "strand_id long, name string, seq string")
    found = counts.kmer_counts(spark.createDataFrame([(s,) for s in sequences(rng, 40, 60)], "seq string"), 4)
    arrays, plain = recovery.strand_paths(own, found, 4), recovery.covered_kmers(own, found, 4)
    for of in (lambda x: recovery.strand_stats(own, x, 2), recovery.ratio_ranges, recovery.target_histogram, recovery.listed_ratios):
        assert rows(of(arrays)) == rows(of(plain))
    summary = {r.strand_id: r for r in batchqc.sequence_summary(batchqc.path_coverage(own, found, 4)).collect()}
    for r in batchqc.path_coverage(own, found, 4).collect():
        s = summary[r.strand_id]
        ratios = [max(a, b) / min(a, b) if min(a, b) else 1.0 if a == b else 0.0 for a, b in zip(r.cov, r.cov[1:])]
        assert (s.kmer_count, s.observed, s.min_cov, s.max_cov) == (len(r.cov), sum(c > 0 for c in r.cov), min(r.cov), max(r.cov))
        assert s.mean_cov == pytest.approx(sum(r.cov) / len(r.cov)) and s.max_ratio == max(ratios, default=1.0)
