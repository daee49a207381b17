import gzip
import json

import pytest
from conftest import rows

from helixlake.operators import counts, links, recovery
from helixlake.sources import scratch, sequences, sinks, tables


def scan(spark, path, split=64 << 20):
    return sequences.scan_sequences(spark, f"file://{path}", split)


def test_fasta(spark, tmp_path):
    path = tmp_path / "a.fa"
    path.write_bytes(b"before\n>s1 first one\r\nACGT\r\n\r\nAC\r\n>s2\nGGGG\n>empty\n>s3\tx\nTT")
    got = scan(spark, path).orderBy("offset").collect()
    assert [(r.name, r.comment, r.seq) for r in got] == [("s1", "first one", "ACGTAC"), ("s2", None, "GGGG"), ("empty", None, ""), ("s3", "x", "TT")]
    assert [tuple(r) for r in sequences.as_strands(scan(spark, path)).orderBy("strand_id").collect()][1] == (1, "s2", "GGGG")


def test_fastq_splits_give_the_same_rows(spark, tmp_path):
    path = tmp_path / "a.fq"
    path.write_text("".join(f"@r{i} c\n{'ACGT' * (i % 7 + 1)}\n+\n{'@>+I' * (i % 7 + 1)}\n" for i in range(200)))
    want = rows(scan(spark, path).select("name", "seq", "qual", "corrupt"))
    assert len(want) == 200 and not any(r[3] for r in want)
    for split in (50, 333, 1000):
        assert rows(scan(spark, path, split).select("name", "seq", "qual", "corrupt")) == want


def test_multi_line_fastq_splits_give_the_same_rows(spark, tmp_path):
    def wrapped(text, width):
        return "\n".join(text[i : i + width] for i in range(0, len(text), width))

    path = tmp_path / "a.fq"
    for plus in ("", "r{i}", "other"):
        with open(path, "w") as f:
            for i in range(120):
                n, first = 7 + i * 5 % 41, "@>+I"[i % 4]
                qual = "".join(first if at % 10 == 0 else "I5@>+"[(i + at) % 5] for at in range(n))
                f.write(f"@r{i} c\n{wrapped(('ACGTN' * 10)[:n], 10)}\n+{plus.format(i=i)}\n{wrapped(qual, 10)}\n" + "\n" * (i % 9 == 0))
        want = rows(scan(spark, path).select("offset", "name", "seq", "qual", "corrupt"))
        assert len(want) == 120 and not any(r[4] for r in want)
        for split in (97, 250, 1001, 4000):
            assert rows(scan(spark, path, split).select("offset", "name", "seq", "qual", "corrupt")) == want


def test_broken_and_multi_line_fastq(spark, tmp_path):
    path = tmp_path / "a.fq"
    path.write_text("@a\nACGT\nAC\n+\nIIII\nII\n@b\nACGT\n+\nII")
    assert rows(scan(spark, path).select("name", "seq", "corrupt")) == [("a", "ACGTAC", False), ("b", "ACGT", True)]
    assert sequences.as_reads(scan(spark, path)).count() == 1


def test_gzip_and_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in/a.fa.gz", "wt") as f:
        f.write(">a\nACGT\n>b\nTT\n")
    (tmp_path / "in/b.fa").write_text(">c\nGG\n")
    assert rows(scan(spark, tmp_path / "in").select("name", "seq")) == [("a", "ACGT"), ("b", "TT"), ("c", "GG")]


def test_tab_tables(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("Head-Index\tDNA\nid 1\tacgt\nACGTN\nx\tnone\ny\tAC\tGGN\n")
    assert tables.detect_format(spark, str(path)) == "tab"
    assert [tuple(r) for r in tables.scan_strands(spark, str(path)).orderBy("strand_id").collect()] == [(0, "id_1", "ACGT"), (1, "seq2", "ACGTN"), (2, "y", "GGN")]
    simple = tmp_path / "s.txt"
    simple.write_text("Name\tDNA\na\tac-gt\nb\t--\n")
    assert rows(tables.scan_tab_simple(spark, str(simple))) == [("a", "AC-GT"), ("b", "--")]
    assert rows(tables.normalize_reference(spark, str(simple))) == [("a", "ACGT")]
    (tmp_path / "f.fa").write_text("\n>a\nAC\n")
    assert tables.detect_format(spark, str(tmp_path / "f.fa")) == "fasta"


def test_paf(spark, tmp_path):
    path = tmp_path / "a.paf"
    path.write_text("q\t4\t0\t4\t+\tt\t9\t2\t6\t4\t4\t60\ttp:A:P\tcs:Z::4\tx:\ncut\t1\n")
    got = tables.scan_paf(spark, str(path)).orderBy("line").collect()
    assert (got[0].target, got[0].target_start, got[0].mapq, got[0].tags) == ("t", 2, 60, {"tp": "P", "cs": ":4"})
    assert got[1].fields == 2 and got[1].target is None


def test_qc_messages(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    batch = lambda n: {"type": "batch", "rows": [{"index": 0, "name": n, "rawLength": 4, "analyzedLength": 4, "status": "ok", "summary": {"observed": 2, "complete": True, "meanCoverage": 1.5}}]}
    path.write_text("\n".join(["noise", json.dumps({"type": "ready"}), json.dumps(batch("old")), json.dumps(batch("new"))]))
    r = tables.scan_qc_jsonl(spark, str(path)).collect()
    assert len(r) == 1 and r[0].name == "new" and r[0].summary.observed == 2 and r[0].summary.complete


def test_text_sinks(spark, tmp_path):
    own = spark.createDataFrame([(0, "a", "ACGTAC"), (1, "b", "AC"), (2, "c", "ACGT")], "strand_id long, name string, seq string")
    found = counts.kmer_counts(spark.createDataFrame([("r", "ACGTAC")], "read_id string, seq string"), 4)
    covered = recovery.covered_kmers(own, found, 4)
    # ACGT and GTAC are their own reverse complements; CGTA is that of TACG
    assert rows(sinks.coverage_lines(covered, own)) == [("a\t1 1 1",), ("c\t1",)]
    assert rows(sinks.ratio_lines(covered, own)) == [("a\t1.000 1.000",)]
    assert sinks.range_lines(recovery.ratio_ranges(covered)).count() == 2
    grid = recovery.strand_recovery(own, spark.createDataFrame([("r", "ACGTAC")], "read_id string, seq string"), 4, range(2))
    sinks.write_metric_grid(grid, str(tmp_path / "grid"))
    sinks.write_metric_grid(grid.repartition(7), str(tmp_path / "dealt"))
    for at in ("grid", "dealt"):
        lines = [r[0].split("\t") for r in spark.read.text(str(tmp_path / at)).collect()]
        assert lines[0][:2] == ["Ratio", "Coverage"] and [x[:2] for x in lines[1:]] == [["0.00", "0"], ["0.00", "1"]]
    back = tables.scan_metric_grid(spark, str(tmp_path / "grid")).orderBy("coverage").collect()
    assert len(back) == 2 and back[0].total == 3
    sinks.write_screen(links.entanglement(own, 4, 0, 0), str(tmp_path / "passed"), str(tmp_path / "filtered"))
    assert rows(spark.read.text(str(tmp_path / "filtered"))) == [("a",), ("c",)]
    sinks.write_json(own, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_strands_are_numbered_along_many_splits(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for f in "ab":
        (tmp_path / f"in/{f}.txt").write_text("".join(f"{f}{i}\tACGT\n" if i % 3 else f"head {i}\n" for i in range(400)))
        (tmp_path / f"{f}.fa").write_text("".join(f">{f}{i}\nACGT\n" for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = tables.scan_tab_strands(spark, str(tmp_path / "in"))
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 3
        want = [f"{f}{i}" for f in "ab" for i in range(400) if i % 3]
        assert [(r.strand_id, r.name) for r in got.orderBy("strand_id").collect()] == list(enumerate(want))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    monkeypatch.setattr(sequences, "SPLIT_BYTES", 300)
    found = sequences.as_strands(scan(spark, tmp_path / "a.fa", 300)).orderBy("strand_id").collect()
    assert [(r.strand_id, r.name) for r in found] == [(i, f"a{i}") for i in range(400)]


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_dir(Session)


def test_subsample(spark):
    own = spark.range(25).withColumnRenamed("id", "strand_id")
    assert [r[0] for r in sequences.subsample(own, 10).collect()] == [0, 10, 20]
