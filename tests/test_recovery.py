import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from helixlake.functions.dna import unpack
from helixlake.operators import batchqc, counts, graph, links, recovery, report
from helixlake.streaming import counts as streaming

STRANDS = [(0, "strand1", "ACGT" * 4), (1, "strand2", "TTTTGGGGCCCCAAAATGCA")]
READS = [("rd1", "ACGT" * 4), ("rd2", "TTTTGGGGCCCCAAAA"), ("rd3", "GATTACA" * 2 + "GA")]
LINKS = [(0, "s1", "ACGT" * 8), (1, "s2", "ACGT" * 8), (2, "s3", "GGGGCCCCAAAATTTT" * 2)]


def strands(spark, data=STRANDS):
    return spark.createDataFrame(data, "strand_id long, name string, seq string")


def reads(spark, data=READS):
    return spark.createDataFrame(data, "read_id string, seq string")


@pytest.fixture(scope="module")
def short(spark):
    return counts.kmer_counts(reads(spark, [("r1", "ACGT" * 3), ("r2", "ACGT" * 3)]), 4)


def test_golden_counts(spark, short):
    assert rows(short.select(unpack(F.col("kmer"), 4), "cov")) == [("ACGT", 6), ("CGTA", 8), ("GTAC", 4)]
    assert tuple(counts.summary(short, 4).first())[:2] == (3, 18)


def test_golden_grid(spark):
    grid = recovery.strand_recovery(strands(spark), reads(spark), 8, range(3), (0.0, 3.0, 1.0))
    cells = {0: (2, 1, 7, 8, 4, 0.5, 4 / 12, 0.875), 1: (2, 1, 2, 7, 5, 0.5, 5 / 12, 2 / 7), 2: (2, 0, 0, 2, 10, 0.0, 10 / 12, 0.0)}
    got = grid.collect()
    assert len(got) == 12
    for r in got:
        assert tuple(r)[2:] == pytest.approx(cells[r.coverage])


def test_uniform_strand_and_nan(spark):
    u = "ACTGGCATTGCAACGTTAGC"
    grid = recovery.strand_recovery(strands(spark, [(0, "u1", u)]), reads(spark, [("r", u)]), 8, range(2), (0.0, 2.0, 1.0), skip=1)
    for r in grid.collect():
        if r.coverage == 0:
            assert tuple(r)[2:] == (1, 1, 0, 13, 0, 1.0, 0.0, 0.0)
        else:
            assert tuple(r)[2:9] == (1, 0, 0, 0, 13, 0.0, 1.0) and math.isnan(r.kn)


def test_grid_ratios():
    assert recovery.grid_ratios(0, 0, 0.2) == [0]
    assert recovery.grid_ratios(1, 0.5, 0.2) == [1]
    assert len(recovery.grid_ratios(0.0, 1.0, 0.2)) == 6
    with pytest.raises(ValueError):
        recovery.grid_ratios(0, 1, 0)


def test_empty_inputs_give_nan(spark):
    row = recovery.strand_recovery(strands(spark, []), reads(spark, []), 8).first()
    assert row.total == 0 and math.isnan(row.sm)


def test_short_and_single_kmer_strands(spark):
    data = [(0, "short", "ACG"), (1, "same", "AAAAA"), (2, "gap", "ACGTNACGT")]
    found = counts.kmer_counts(reads(spark, [("r", "AAAAA")]), 4)
    stats = recovery.strand_stats(strands(spark, data), recovery.covered_kmers(strands(spark, data), found, 4))
    assert rows(stats) == [(0, None, None), (1, 2, 0.0), (2, 0, 0.0)]


def test_saturation_comes_after_the_sum(spark):
    raw = counts.raw_counts(reads(spark, [("r", "A" * 12_000)]), 4)
    both = counts.capped(counts.merged_counts([raw, raw]))
    assert both.first().cov == counts.READ_CAP


def test_truncation_and_short_reads(spark):
    found = counts.kmer_counts(reads(spark, [("a", "ACGTACGT"), ("b", "AC")]), 4, 5)
    assert found.agg(F.sum("cov")).first()[0] == 2


def test_histograms_agree(spark):
    found = counts.kmer_counts(reads(spark), 8)
    spectrum = counts.spectrum(found)
    sums = counts.suffix_sums(spectrum).orderBy("cov").collect()
    assert sums[0].at_least == found.count() and [r.at_least for r in sums] == sorted((r.at_least for r in sums), reverse=True)
    covered = recovery.covered_kmers(strands(spark), found, 8)
    sets = {r["set"]: r["count"] for r in recovery.target_sets(covered, found).groupBy("set").count().collect()}
    assert sets == {"shared": 8, "lost": 4, "noise": 7}


def test_cross_links(spark):
    own = strands(spark, LINKS)
    assert links.cross_link_count(own, 8).first()[0] == 3
    assert links.cross_link_count(own, 31).first()[0] == 1
    assert links.cross_link_count(own, 8, 100).first()[0] == 0


def test_entanglement(spark):
    own = strands(spark, LINKS)
    assert rows(links.entanglement(own, 8, 0, 0).select("name", "status")) == [("s1", "filtered"), ("s2", "filtered"), ("s3", "passed")]
    totals = [links.screen_totals(links.entanglement(own, 8, m, 0)).first().filtered for m in (0, 1, 10)]
    assert totals == sorted(totals, reverse=True)
    assert tuple(links.screen_totals(links.entanglement(own)).first()) == (3, 0, 0, 3)
    for options in ({"k": 32}, {"primer": -1}, {"m": -1}):
        with pytest.raises(ValueError):
            links.entanglement(own, **options)
    listed = links.entangled_names(links.entanglement(own, 8, 0, 0), 1).collect()
    assert [tuple(r) for r in listed] == [(0, True)]


def test_profile_and_summary(spark, short):
    own = strands(spark, [(0, "q", "ACGT" * 3)])
    r = batchqc.sequence_summary(batchqc.path_coverage(own, short, 4)).first()
    assert (r.kmer_count, r.observed, r.missing, r.complete, r.min_cov, r.max_cov) == (9, 9, 0, True, 4, 8)
    profile = batchqc.sequence_profile(own, short, 4).orderBy("pos").collect()
    assert [p.kmer for p in profile[:3]] == ["ACGT", "CGTA", "GTAC"] and profile[-1].ratio is None


def test_batch_qc(spark, short):
    data = [*STRANDS, (2, "short", "AC"), (3, "bad", "ACGTXACGT")]
    qc = batchqc.batch_qc(strands(spark, data), short, 4)
    got = {r.strand_id: r for r in qc.collect()}
    assert got[0].status == "ok" and got[0].kmer_count == 13 and got[0].observed > 0
    assert got[2].status == "skipped" and got[3].status == "error" and got[3].message.endswith(" 5")
    assert tuple(batchqc.batch_totals(qc).first())[:4] == (4, 2, 1, 1)
    trimmed = batchqc.batch_qc(strands(spark), short, 4, 2, 3).orderBy("strand_id").first()
    assert trimmed.analyzed_length == 11


def test_kmer_queries(spark, short):
    own = spark.createDataFrame([(0, "acgt"), (1, "AC"), (2, "ACXT"), (3, "ACG TACG")], "query_id long, query string")
    got = {r.query_id: r for r in graph.kmer_query(own, short, 4).collect()}
    assert (got[0].coverage, got[0].in_degree, got[0].out_degree, got[0].truncated) == (6, 1, 1, False)
    assert got[1].error == "shorter than k" and got[2].error == "invalid base" and got[3].truncated


def test_tree_and_greedy_path(spark):
    found = counts.kmer_counts(reads(spark, [("a", "ACGTTGCA"), ("b", "ACGTTGAA"), ("c", "ACGTTGAA")]), 4)
    own = spark.createDataFrame([(0, "ACGT")], "query_id long, query string")
    tree = graph.branch_tree(own, found, 4, 0, 4)
    assert {(r.step, r.path) for r in tree.where("direction = 'down'").collect()} >= {(1, "T"), (2, "TG"), (3, "TGA"), (3, "TGC"), (4, "TGAA")}
    assert tree.where("direction = 'up'").count() == 0
    path = graph.greedy_path(own, found, 4, 0, 6).where("direction = 'down'").orderBy("step").collect()
    assert [r.base for r in path][:4] == ["T", "G", "A", "A"]
    assert graph.branch_tree(own, found, 4, 0, 0).count() == 0
    top = tree.where("step = 3")
    assert graph.expand_nodes(top, found, 4).where("step = 4").count() == tree.where("step = 4").count()


def test_index_query(spark):
    found = counts.kmer_counts(reads(spark, [("a", "AAACGTTGCATT")]), 4)
    own = spark.createDataFrame([(0, "0"), (1, "27"), (2, "x"), (3, "100000")], "query_id long, index string")
    got = {r.query_id: r for r in graph.index_decoded(own, 4, 3).collect()}
    assert got[0].dna == "AAA" and got[0].padded and got[0].completed
    assert got[1].dna == "CGT" and got[2].dna is None and got[3].truncated
    starts = graph.prefix_starts(graph.index_decoded(own, 4, 3).where("completed").select("query_id", F.col("dna").alias("prefix")), found, 4)
    assert rows(starts.where("query_id = 1").select("kmer", "cov")) == [("CGTT", 2)]  # AACG, its reverse complement, is in the read too
    assert graph.index_query(own, found, 4, 3).where("query_id = 1").count() > 0


def test_report(spark):
    r = report.qc_report(strands(spark, LINKS), reads(spark), 8, primer=0)
    row = r.first()
    assert (row.cross_links, row.passed, row.entangled, row.skipped) == (3, 1, 2, 0)
    graded = {v.metric: v.verdict for v in report.verdicts(r).collect()}
    assert graded["entangled"] == "bad" and graded["cross_links"] == "warn"


def test_stream_equals_batch(spark, tmp_path):
    data = reads(spark, [*READS, *[(f"x{i}", "GATTACAGATTACA") for i in range(8)]])
    data.repartition(3).write.parquet(str(tmp_path / "reads"))
    want = rows(counts.kmer_counts(data, 5))
    stream = streaming.stream_reads(spark, str(tmp_path / "reads"))
    streaming.merge_into_store(stream, 5, str(tmp_path / "store"), str(tmp_path / "checkpoint")).awaitTermination()
    assert rows(counts.capped(streaming.read_store(spark, str(tmp_path / "store")))) == want
    q = streaming.incremental_counts(streaming.stream_reads(spark, str(tmp_path / "reads")), 5).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("counts")) == want
