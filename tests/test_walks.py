"""Walks on reads and plain tables count what they can reach, and find what a stored table of all k-mers has."""

import random
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from helixlake.functions import kmers
from helixlake.operators import counts, graph, store

K = 27


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def genome(rng, n=300):
    """Reads with errors, breaks, both orientations, copies, and runs of one base; and queries into them."""
    text = "".join(rng.choice("ACGT") for _ in range(n)) + "A" * 70 + "ACGT" * 15
    seqs = []
    for _ in range(60):
        at = rng.randrange(len(text) - 40)
        read = "".join(rng.choice("ACGTN") if rng.random() < 0.01 else c for c in text[at : at + rng.randint(20, 90)])
        seqs.append(turned(read.replace("N", "A")) if rng.random() < 0.5 else read)
    seqs += [seqs[0], "", None, text.lower()]
    asked = [text[at : at + rng.randint(K, 60)] for at in (0, 3, 50, 120, n - 5, n + 20, n + 75)] + ["ACGT", "A" * K, turned(text[80:140]), "C" * K, "AN" * K]
    return seqs, asked


@pytest.fixture(scope="module")
def tables(spark):
    seqs, asked = genome(random.Random(11))
    reads = spark.createDataFrame([(s,) for s in seqs], "seq string").repartition(3)
    own = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    return reads, own, asked


def seen(reads):
    out: dict = {}
    for (s,) in reads.collect():
        s = (s or "").upper()
        for i in range(len(s) - K + 1):
            if set(w := s[i : i + K]) <= set("ACGT"):
                w = min(w, turned(w))
                out[w] = out.get(w, 0) + 1
    return out


def tree(found, asked, depth, best_only):
    """What a walk finds, in plain Python."""
    out = set()
    for i, q in enumerate(asked):
        if len(q) < K or set(q) - set("ACGT"):
            continue
        for direction, start in (("up", q[:K]), ("down", q[-K:])):
            level = [(start, "")]
            for step in range(1, depth + 1):
                new = []
                for kmer, path in level:
                    near = [(b, b + kmer[:-1] if direction == "up" else kmer[1:] + b) for b in "ACGT"]
                    near = sorted((-found[min(n, turned(n))], b, n) for b, n in near if min(n, turned(n)) in found)
                    for rank, (cov, b, n) in enumerate(near[:1] if best_only else near, 1):
                        out.add((i, direction, step, path + b, b, n, -cov, rank))
                        new.append((n, path + b))
                level = new
    return out


def moved(spark, df):
    """Bytes that a query shuffles, spills and writes; df: makes it, for walks write while they are made."""
    status = spark.sparkContext._jsc.sc().statusStore()

    def total():
        stages = status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in map(stages.apply, range(stages.size())))

    before = total()
    df().write.format("noop").mode("overwrite").save()
    time.sleep(1)
    return total() - before


def large(spark):
    """Two million bases, and the ends of a few reads as queries."""
    rng = random.Random(13)
    seqs = ["".join(rng.choices("ACGT", k=2000)) for _ in range(1000)]
    return spark.createDataFrame([(s,) for s in seqs], "seq string").repartition(4).localCheckpoint(), spark.createDataFrame([(i, s[300:400]) for i, s in enumerate(seqs[:20])], "query_id long, query string")


@pytest.mark.parametrize("source", ["reads", "table", "raw table", "many", "stored"])
def test_neighbors_and_queries(spark, tables, source, monkeypatch):
    reads, own, asked = tables
    found = seen(reads)
    if source == "many":
        monkeypatch.setattr(store, "ASKED_AT_ONCE", 3)
    made = {"table": lambda: counts.kmer_counts(reads, K), "raw table": lambda: counts.raw_counts(reads, K), "stored": lambda: store.stored(reads, K)}.get(source, lambda: reads)()
    want = set()
    for i, q in enumerate(asked):
        if len(q) >= K and not set(q) - set("ACGT"):
            for b in "ACGT":
                for direction, n in (("up", b + q[: K - 1]), ("down", q[-K + 1 :] + b)):
                    want.add((i, direction, b, n, found.get(min(n, turned(n)), 0)))
    got = rows(graph.kmer_neighbors(own, made, K))
    assert set(got) == want and len(got) == len(want) and any(r[4] for r in got)
    for r in graph.kmer_query(own, made, K).collect():
        if r.error is None:
            q = asked[r.query_id]
            assert r.coverage == min(found.get(min(x, turned(x)), 0) for x in (q[:K], q[-K:]))
            assert (r.in_degree, r.out_degree) == tuple(sum(w[0] == r.query_id and w[1] == d and w[4] > 0 for w in want) for d in ("up", "down"))


def test_reads_longer_than_what_is_packed_at_once(spark, tables, monkeypatch):
    reads, own, _ = tables
    cores = store.KmerTable._few(graph.anchors(own, K).select(F.expr(f"bigint(conv(translate(least(left(kmer, {K - 2}), translate(reverse(left(kmer, {K - 2})), 'ACGT', 'TGCA')), 'ACGT', '0123'), 4, 10))")))
    near = lambda: rows(kmers.occurrences_near(reads, kmers.np.array(cores), K, 2))
    want = near()
    monkeypatch.setattr(kmers, "BATCH_BASES", 7)
    monkeypatch.setattr(kmers, "BUDGET", 5)
    assert near() == want and len(want) > 20


def test_neighbors_move_what_is_asked_for(spark):
    reads, own = large(spark)
    assert moved(spark, lambda: graph.kmer_neighbors(own, reads, 31)) < 200_000


@pytest.mark.parametrize("source", ["reads", "table", "many", "stored"])
def test_trees(spark, tables, source, monkeypatch):
    reads, own, asked = tables
    if source == "many":
        monkeypatch.setattr(store, "ASKED_AT_ONCE", 3)
    made = {"table": lambda: counts.kmer_counts(reads, K), "stored": lambda: store.stored(reads, K)}.get(source, lambda: reads)()
    want = tree(seen(reads), asked, 3, False)
    got = rows(graph.branch_tree(own, made, K, 3))
    assert set(got) == want and len(got) == len(want) > 50
    top = graph.branch_tree(own, made, K, 1)
    assert {(r[0], r[1], r[3]) for r in rows(graph.expand_nodes(top, made, K))} == {(w[0], w[1], w[3]) for w in want if w[2] == 2}


def test_trees_move_what_is_asked_for(spark):
    reads, own = large(spark)
    assert moved(spark, lambda: graph.branch_tree(own, reads, 31, 3)) < 400_000


@pytest.mark.parametrize("source", ["reads", "table", "many", "stored"])
def test_greedy_paths(spark, tables, source, monkeypatch):
    reads, own, asked = tables
    if source == "many":
        monkeypatch.setattr(store, "ASKED_AT_ONCE", 3)
    made = {"table": lambda: counts.kmer_counts(reads, K), "stored": lambda: store.stored(reads, K)}.get(source, lambda: reads)()
    for up, down in ((6, 6), (2, 5)):
        want = {w for w in tree(seen(reads), asked, 6, True) if w[2] <= (up if w[1] == "up" else down)}
        got = rows(graph.greedy_path(own, made, K, up, down))
        assert set(got) == want and len(got) == len(want) > 20


def test_greedy_paths_move_what_is_asked_for(spark):
    reads, own = large(spark)
    assert moved(spark, lambda: graph.greedy_path(own, reads, 31, 6)) < 600_000


@pytest.mark.parametrize("source", ["reads", "table", "stored"])
@pytest.mark.parametrize("k", [9, K])
def test_first_of_prefixes(spark, tables, source, k, monkeypatch):
    reads, _, _ = tables
    monkeypatch.setattr(store, "HITS_AT_ONCE", 10)
    monkeypatch.setattr(kmers, "BATCH_BASES", 50)
    monkeypatch.setattr(graph, "MAX_STARTS", 4)
    both: dict = {}
    for kmer, cov in rows(counts.kmer_counts(reads, k, text=True)):
        both[kmer] = both[turned(kmer)] = cov
    prefixes = ["A", "ACG", "TT", "C", "AAAAAAA", "CGTACGT", "GGGGGGGG"]
    want = {(p, x, both[x], i, sum(y.startswith(p) for y in both) >= 4) for p in prefixes for i, x in enumerate(sorted(y for y in both if y.startswith(p))[:4], 1)}
    made = {"table": lambda: counts.kmer_counts(reads, k), "stored": lambda: store.stored(reads, k)}.get(source, lambda: reads)()
    got = rows(graph.prefix_starts(spark.createDataFrame([(p, p) for p in prefixes], "query_id string, prefix string"), made, k))
    assert set(got) == want and len(got) == len(want) > 20


def test_indexes_move_no_table(spark, monkeypatch):
    """Many walks of one step: the reads' pieces, and what is asked for."""
    monkeypatch.setattr(store, "ASKED_AT_ONCE", 50)
    reads, _ = large(spark)
    own = spark.createDataFrame([(i, str(i * 50)) for i in range(40)], "query_id long, index string")
    assert moved(spark, lambda: graph.index_query(own, reads, 31, 8)) < 5_000_000
