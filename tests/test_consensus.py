import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from helixlake.operators import alignment, assignment, batchqc, counts

STRANDS = [("strand1", "ACGT" * 4), ("strand2", "TTTTGGGGCCCCAAAATGCA")]
READS = [("rd1", "ACGT" * 4), ("rd2", "TTTTGGGGCCCCAAAA"), ("rd3", "GATTACA" * 2 + "GA")]


def test_read_consensus_golden(spark):
    own = spark.createDataFrame(STRANDS, "strand_id string, seq string")
    reads = spark.createDataFrame(READS, "read_id string, seq string")
    got = {r.name: r for r in assignment.read_consensus(reads, own, None).collect()}
    one, two = got["strand1"], got["strand2"]
    assert one.exact_match and one.mean_depth == 1.0
    assert (two.consensus, two.mean_depth, two.covered_bases, two.n_count, two.distance) == ("TTTTGGGGCCCCNAAANNNA", 0.8, 16, 4, 4)
    assert rows(assignment.read_consensus(reads, own, 5).select("name", "consensus")) == [(n, got[n].consensus) for n in sorted(got)]


def test_kmer_qc_of_the_same(spark):
    own = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(STRANDS)], "strand_id long, name string, seq string")
    found = counts.kmer_counts(spark.createDataFrame(READS, "read_id string, seq string"), 5)
    assert tuple(counts.summary(found, 5).first())[:2] == (15, 36)
    qc = {r.strand_id: r for r in batchqc.batch_qc(own, found, 5).collect()}
    assert (qc[0].observed, qc[0].kmer_count, qc[0].complete, qc[0].min_cov, qc[0].mean_cov, qc[0].max_ratio) == (12, 12, True, 6, 6.0, 1.0)
    assert (qc[1].observed, qc[1].kmer_count, qc[1].min_cov, qc[1].mean_cov, qc[1].max_cov, qc[1].max_ratio) == (12, 16, 0, 1.5, 2, 1.0)


def paf(spark, data):
    rows_ = [(str(i), t, s, 10, 10, 60, {"tp": tp, **({"cs": cs} if cs else {})}) for i, (t, s, tp, cs) in enumerate(data)]
    return spark.createDataFrame(rows_, "row_id string, target string, target_start int, matches int, block_length int, mapq int, tags map<string,string>")


def test_quality_buckets(spark):
    own = spark.createDataFrame([("a", "ACGT")], "name string, seq string")
    data = paf(spark, [("a", 0, "P", ":4"), ("a", 0, "S", ":4"), ("a", 0, "P", None), ("z", 0, "P", ":4")])
    got = alignment.quality_buckets(data, own)
    assert rows(got.select("row_id", "bucket")) == [("0", "used"), ("1", "secondary"), ("2", "low_quality"), ("3", "unknown_target")]
    assert tuple(alignment.bucket_totals(got).first()) == (4, 3, 1, 1, 1, 1)


def test_cs_tokens(spark):
    data = spark.createDataFrame([("r", 2, ":3*ac-gg+tt~gt12ag:1")], "row_id string, target_start int, cs string")
    got = alignment.parse_cs(data, ["row_id"]).orderBy("n").collect()
    assert [(r.op, r.length, r.offset) for r in got] == [(":", 3, 0), ("*", 1, 3), ("-", 2, 4), ("+", 0, 6), ("~", 12, 6), (":", 1, 18)]
    assert [r.text for r in got] == ["3", "ac", "gg", "tt", "gt12ag", "1"]


CS_TOKEN = r":[0-9]+|\*[a-zA-Z]{2}|-[a-zA-Z]+|\+[a-zA-Z]+|~[a-zA-Z]{2}[0-9]+[a-zA-Z]{2}"


def test_cs_tokens_match_a_pattern(spark):
    rng = random.Random(1)
    tags = ["".join(rng.choice([":", ":12", "*ac", "*", "-g", "+ttT", "~gt3ag", "~g", "7", "x", "-"]) for _ in range(rng.randint(0, 9))) for _ in range(300)] + [None, "", ":0"]
    got = {}
    for r in alignment.parse_cs(spark.createDataFrame([(i, 0, t) for i, t in enumerate(tags)], "row_id int, target_start int, cs string"), ["row_id"]).collect():
        got.setdefault(r.row_id, []).append((r.n, r.op + r.text))
    for i, t in enumerate(tags):
        # a sign begins a token, so one that is cut short by the next ends there
        assert [x for _, x in sorted(got.get(i, []))] == re.findall(CS_TOKEN, t or ""), t


def test_consensus_matches_a_list_of_bases(spark):
    rng = random.Random(2)
    own = [(f"s{i}", "".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 40)))) for i in range(12)]
    data, seen = [], {}
    for i in range(400):
        name, seq = rng.choice(own)
        start = rng.randint(0, max(0, len(seq) - 1))
        at, cs = start, ""
        while at < len(seq) + 2 and rng.random() < 0.9:
            op = rng.choice(":*-+")
            n = rng.randint(1, 9)
            if op == ":":
                cs += f":{n}"
                for p in range(at, at + n):
                    seen.setdefault((name, p), []).append(None)
                at += n
            elif op == "*":
                b = rng.choice("acgtn")
                cs += f"*x{b}"
                if b != "n":
                    seen.setdefault((name, at), []).append(b.upper())
                at += 1
            elif op == "-":
                cs += "-" + "a" * n
                at += n
            else:
                cs += "+" + "c" * n
        data.append((name, start, "P", cs))
    df = spark.createDataFrame(own, "name string, seq string")
    for front, back in ((0, 0), (3, 2)):
        piled = {}
        for r in alignment.pileup(paf(spark, data), df, front, back).collect():
            piled[r.name, r.pos, r.base] = r.n
        want = {}
        for name, seq in own:
            for p in range(front, len(seq) - back):
                for b in seen.get((name, p), []):
                    k = (name, p - front, b or seq[p])
                    want[k] = want.get(k, 0) + 1
        assert piled == want
        called = {r.name: r for r in alignment.paf_consensus(paf(spark, data), df, front=front, back=back).collect()}
        votes = {(r.name, r.pos): r for r in alignment.majority_vote(alignment.pileup(paf(spark, data), df, front, back)).collect()}
        for name, seq in own:
            size = max(0, len(seq) - front - back)
            assert called[name].consensus == "".join(votes[name, p].base if (name, p) in votes else "N" for p in range(size))
            assert called[name].mean_depth == pytest.approx(sum(votes[name, p].depth for p in range(size) if (name, p) in votes) / size if size else 0)
            assert called[name].read_count == sum(d[0] == name and d[3] != "" for d in data)


def test_paf_consensus(spark):
    own = spark.createDataFrame([("a", "ACGTACGT"), ("b", "AAAA")], "name string, seq string")
    # place 2 has two reads of g and three of t (exactly 0.6); deletions give no depth
    data = paf(spark, [("a", 0, "P", ":8"), ("a", 0, "P", ":8"), ("a", 0, "P", ":2*gt:5"), ("a", 0, "P", ":2*gt:5"), ("a", 0, "P", ":2*gt:2-cgt")])
    got = {r.name: r for r in alignment.paf_consensus(data, own).collect()}
    assert got["a"].consensus == "ACTTACGT" and got["a"].distance == 1 and not got["a"].exact_match
    assert got["a"].mean_depth == pytest.approx((5 * 5 + 4 * 3) / 8)
    assert (got["b"].consensus, got["b"].read_count, got["b"].n_count) == ("NNNN", 0, 4)
    trimmed = {r.name: r for r in alignment.paf_consensus(data, own, front=1, back=1).collect()}
    assert trimmed["a"].consensus == "CTTACG"


def test_vote_ties(spark):
    piled = spark.createDataFrame([("a", 0, "C", 1), ("a", 0, "A", 1), ("a", 1, "G", 3), ("a", 1, "T", 2)], "name string, pos int, base string, n long")
    assert rows(alignment.majority_vote(piled).select("pos", "base")) == [(0, "N"), (1, "G")]
    assert rows(alignment.majority_vote(piled, 1, 0.5).select("pos", "base")) == [(0, "A"), (1, "G")]


def test_comparison(spark):
    consensus = spark.createDataFrame([(n, e) for n, e in (("a", True), ("b", True), ("c", False), ("d", False))], "name string, exact_match boolean")
    qc = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "name string, complete boolean")
    for c in ("status", "observed", "kmer_count", "min_cov", "mean_cov", "max_cov"):
        qc = qc.withColumn(c, F.lit("1"))
    got = alignment.consensus_join(consensus, qc)
    assert rows(got.select("name", "status", "classification")) == [("a", "1", "agreement_recovered"), ("b", "1", "consensus_only"), ("c", "1", "kmer_only"), ("d", "missing", "agreement_missing_or_broken")]
    assert dict(rows(alignment.comparison_summary(got)))["kmer_only"] == 1
    assert [r.name for r in alignment.disagreements(got).collect()] == ["b", "c"]


def test_alignment_prefers_the_diagonal():
    score, identity, bases = assignment.align("ACGT", "ACGT")
    assert (score, identity, bases) == (8, 1.0, "ACGT")
    assert assignment.align("ACGT", "AGT") == (4, 1.0, "A-GT")
    assert assignment.align("", "AC") == (-4, 0.0, "") and assignment.align("AC", "") == (-4, 0.0, "--")


def test_alignments_match_the_whole_table(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(assignment, "CELLS", 500)
    pairs = [("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 7))), "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 7)))) for _ in range(400)]
    score, identity, bases = assignment.align_all([a for a, _ in pairs], [b for _, b in pairs])
    for k, (a, b) in enumerate(pairs):
        t = [[-2 * (i + j) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i][j] = max(t[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), t[i - 1][j] - 2, t[i][j - 1] - 2)
        i, j, out, met, same = len(a), len(b), "", 0, 0
        while i or j:
            if i and j and t[i][j] == t[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1):
                i, j, out, met = i - 1, j - 1, b[j - 1] + out, met + 1
                same += a[i] == b[j]
            elif i and t[i][j] == t[i - 1][j] - 2:
                i, out = i - 1, "-" + out
            else:
                j -= 1
        assert (score[k], identity[k], bases[k]) == (t[-1][-1], pytest.approx(same / met if met else 0), out)


def test_many_pairs_need_a_k(spark, monkeypatch):
    monkeypatch.setattr(assignment, "ALL_PAIRS", 5)
    own = spark.createDataFrame(STRANDS, "strand_id string, seq string")
    with pytest.raises(ValueError, match="give a k"):
        assignment.candidates(spark.createDataFrame(READS, "read_id string, seq string"), own, None)
