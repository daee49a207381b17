"""Queries against their SQL on tables that are larger in one respect than the given ones, and what they move."""

import os
import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from helixlake.functions import kmers
from helixlake.operators import assignment, counts, links, recovery, report

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def large_keys(tmp_path_factory):
    """The tables of sf0.001 with a few parts more, whose numbers have more than eight digits in base four."""
    at = tmp_path_factory.mktemp("large")
    for name in os.listdir(SF):
        if name != "part.parquet":
            os.symlink(f"{SF}/{name}", at / name)
    duckdb.sql(f"COPY (SELECT * REPLACE (p_partkey + i * 65530 AS p_partkey) FROM '{SF}/part.parquet', range(3) t(i)) TO '{at}/part.parquet'")
    return str(at)


def same_as_sql(spark, name, folder):
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{t}')")
    got = entry.queries()[name](spark, folder)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert want and rows(got.select(*columns)) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["j5_w4_index_starts", "g5_index_query"])
def test_indexes_of_more_than_eight_bases(spark, large_keys, name):
    same_as_sql(spark, name, large_keys)


def moved(spark, df):
    """Bytes that a query shuffles and spills."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).diskBytesSpilled() for i in range(stages.size()))

    before = total()
    df.write.format("noop").mode("overwrite").save()
    time.sleep(1)
    return total() - before


@pytest.mark.parametrize("what", ["counts", "membership"])
def test_kmers_are_moved_in_pieces(spark, what):
    """Far less than the eight bytes of a k-mer."""
    rng = random.Random(5)
    df = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(2000))) for i in range(500)], "strand_id long, seq string").repartition(2)
    df = df.localCheckpoint()
    found = counts.kmer_counts(df, 31) if what == "counts" else counts.strand_membership(df, 31)
    assert moved(spark, found) < 4 * 500 * 1970


@pytest.mark.parametrize("k", [1, 4, 13, 17, 19, 20, 25, 31])
def test_pieces_hold_every_window(k):
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGTACGTN") for _ in range(rng.randint(0, 150))) for _ in range(40)] + ["A" * 9000, "", None, "ACGT" * 2500]
    bucket, pieces = kmers.Pieces.cut(pa.array(seqs), k, 5, np.arange(len(seqs)))
    owner, pos, kmer = kmers._windows(pa.array(seqs), k)
    got = zip(np.repeat(pieces.s, pieces.sizes), np.repeat(pieces.pos, pieces.sizes) + kmers._within(pieces.sizes), pieces.kmers())
    assert [tuple(map(int, x)) for x in got] == [tuple(map(int, x)) for x in zip(owner, pos, kmer)]
    keys = pieces.kmers() * kmers._ODD
    assert kmers.Deal(None, 5).of(keys, k).tolist() == np.repeat(bucket, pieces.sizes).tolist()
    order = np.array(rng.sample(range(len(pieces.sizes)), len(pieces.sizes)))
    assert sorted(pieces.taken(order).kmers()) == sorted(pieces.kmers())


@pytest.mark.parametrize("name", ["j2_target_in_reads", "j2_noise_kmers", "u3_target_sets", "a7_target_histogram", "w6_entangled_topn", "a3_strand_membership_count", "f18_parse_cs"])
def test_same_as_sql(spark, name):
    same_as_sql(spark, name, SF)


def test_blocks_are_moved_once(spark, monkeypatch):
    """Reads that all strands are held against: the blocks of both meet without a copy of each for each."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    strands = spark.createDataFrame([(f"s{i}", text(60)) for i in range(300)], "strand_id string, seq string").localCheckpoint()
    reads = spark.createDataFrame([(f"r{i}", text(60), None) for i in range(200)], "read_id string, seq string, best long").localCheckpoint()
    want = rows(assignment.exhausted(reads, strands, 2))
    for name, value in (("FEW_BLOCKS", 2), ("STRANDS_A_BLOCK", 12), ("READS_A_BLOCK", 50)):
        monkeypatch.setattr(assignment, name, value)
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(x.shuffleWriteBytes() for x in (lambda a: [a.apply(i) for i in range(a.size())])(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))
    before = written()
    got = rows(assignment.exhausted(reads, strands, 2))
    best = lambda found: {r: max(x[2] for x in found if x[0] == r) for r in {x[0] for x in found}}
    close = lambda found: {x for x in found if x[2] >= best_of[x[0]] - 2}
    best_of = best(want)
    assert best(got) == best_of and close(got) == close(want)
    time.sleep(1)
    # 4 blocks of reads and 25 of strands; a copy of each block of reads for each of strands took 25 times their size, twice
    assert written() - before < 16 * 500 * 70


@pytest.mark.parametrize("name", ["p4_qc_report", "f24_verdicts"])
def test_reports_same_as_sql(spark, name):
    same_as_sql(spark, name, SF)


def test_buckets_of_large_files_follow_their_bases(spark, monkeypatch, tmp_path):
    """Not their bytes: rows of tasks that hand out to very many buckets are mostly overhead."""
    rng = random.Random(2)
    spark.createDataFrame([("".join(rng.choice("ACGT") for _ in range(3000)),) for _ in range(100)], "seq string").write.parquet(f"{tmp_path}/reads")
    monkeypatch.setattr(kmers, "EXPANSION", 1 << 18)
    assert kmers.Deal(spark.read.parquet(f"{tmp_path}/reads")).bits == 4


def test_report_moves_each_side_once(spark):
    """Fewer bytes than the reads' and strands' pieces took before, when both were sent twice."""
    rng = random.Random(3)
    df = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(2000))) for i in range(500)], "strand_id long, seq string").repartition(2).localCheckpoint()
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        time.sleep(1)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    found = report.qc_report(df, df, 31, primer=0).first()
    assert (found.strands, found.passed, found.paths, found.exist, found.lost, found.noise) == (500, 500, 500, 985000, 0, 0)
    assert total() - before < 4.5 * 500 * 1970


def test_report_of_odd_strands(spark):
    """Breaks, lower case, repeats, strands without k-mers, and primers: as by the single operators."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("ACGTacgtUN" if rng.random() < 0.2 else "ACGT") for _ in range(n))
    seqs = [text(rng.randint(0, 60)) for _ in range(40)]
    seqs += [seqs[3], seqs[4][:20] + seqs[5], "A" * 40, "N" * 30, "", None]
    strands = spark.createDataFrame(list(enumerate(seqs)), "strand_id long, seq string")
    reads = spark.createDataFrame([(i, s) for i, s in enumerate([*seqs[:30], *seqs[:9], text(50)])], "read_id long, seq string")
    for primer, m, cutoff in ((0, 0, 0), (0, 1, 1), (3, 0, 1)):
        got = report.qc_report(strands, reads, 9, screen_m=m, primer=primer, cutoff=cutoff).first()
        grid = recovery.strand_recovery(strands, reads, 9, [cutoff]).first()
        screen = links.screen_totals(links.entanglement(strands, 9, m, primer)).first()
        assert got.cross_links == links.cross_link_count(strands, 9, 1).first()[0] and got.reads == 40
        assert (got.strands, got.passed, got.entangled, got.skipped) == tuple(screen)
        assert all(got[c] == grid[c] for c in ("paths", "exist", "lost", "noise", "sm", "kd", "kn"))


@pytest.mark.parametrize("what, budget", [("counts", None), ("counts", 3000), ("noise", None), ("noise", 3000)])
def test_results_of_kmers_compress(spark, monkeypatch, tmp_path, what, budget):
    """Rows that overlap stand side by side: with Snappy a row takes less than half of its 35 bytes, also where a bucket is added up several times."""
    if budget:
        monkeypatch.setattr(kmers, "BUDGET", budget)
    rng = random.Random(5)
    df = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(4000))) for i in range(250)] + [(-1, "ACGTN" * 20), (-2, None)], "strand_id long, seq string").repartition(2).localCheckpoint()
    if what == "counts":
        found = counts.kmer_counts(df, 31, text=True)
    else:
        found = recovery.compared_sets(df.where("strand_id < 0"), df.where("strand_id >= 0"), 31).where("set = 'noise'").select(F.expr("lpad(conv(kmer, 10, 4), 31, '0')").alias("kmer"), "cov")
    found.coalesce(1).write.parquet(f"{tmp_path}/out", compression="snappy")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.select("kmer").distinct().count() == 250 * 3970
    assert sum(os.path.getsize(f"{tmp_path}/out/{x}") for x in os.listdir(f"{tmp_path}/out") if x.endswith(".parquet")) < 15 * 250 * 3970
