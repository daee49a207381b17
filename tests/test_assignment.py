"""Read assignment against the alignment of all pairs."""

import random

import numpy as np
import pytest

from helixlake.functions import distances
from helixlake.operators import assignment


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def worn(rng, seq, share):
    """seq with a share of its bases changed, lost, or followed by another."""
    out = ""
    for c in seq:
        x = rng.random()
        out += rng.choice("ACGT".replace(c, "")) if x < share * 0.7 else "" if x < share * 0.85 else c + rng.choice("ACGT") if x < share else c
    return out


def cases(seed):
    rng = random.Random(seed)
    primer = dna(rng, 12)
    strands = [(k, primer + dna(rng, rng.choice([44, 48, 48, 52]))) for k in range(60)]
    strands += [(200 + k, worn(rng, strands[k][1], 0.05)) for k in range(15)]  # near strands: second best scores are close
    strands += [(300, strands[0][1]), (301, dna(rng, 30)), (302, "")]
    reads = [(k, worn(rng, rng.choice(strands)[1], rng.choice([0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25]))) for k in range(260)]
    reads += [(900, "A" * 60), (901, "ACG"), (902, ""), (903, "N" * 30), (904, dna(rng, 60)), (905, strands[3][1][:31]), (906, strands[4][1].replace("C", "N"))]
    return reads, strands


def expected(reads, strands, min_identity=0.75, ambiguity=2):
    pairs = [(s, r) for _, r in reads for _, s in strands]
    score, identity, bases = assignment.align_all([s for s, _ in pairs], [r for _, r in pairs])
    score, identity = score.reshape(len(reads), -1), identity.reshape(len(reads), -1)
    out = {}
    for i, (read, _) in enumerate(reads):
        order = sorted(range(len(strands)), key=lambda k: (-score[i, k], -identity[i, k], strands[k][0]))
        first, second = order[:2]
        if identity[i, first] >= min_identity:
            out[read] = (read, strands[first][0], int(score[i, first]), float(identity[i, first]), bases[i * len(strands) + first], bool(score[i, first] - score[i, second] <= ambiguity))
    return out


@pytest.mark.parametrize("k, blocks", [(None, None), (6, None), (31, 16)])
def test_no_read_is_lost(spark, monkeypatch, k, blocks):
    if blocks:
        monkeypatch.setattr(assignment, "READS_A_BLOCK", blocks)
        monkeypatch.setattr(assignment, "STRANDS_A_BLOCK", blocks)
    monkeypatch.setattr(assignment, "FREQUENT", 20)  # the primer's seeds are in all strands
    reads, strands = cases(k or 1)
    own = spark.createDataFrame(strands, "strand_id long, seq string")
    got = assignment.assigned(spark.createDataFrame([*reads, (907, None)], "read_id long, seq string"), own, k).collect()
    assert {r.read_id: tuple(r) for r in got} == expected(reads, strands)
    assert len(got) == len({r.read_id for r in got})


def test_empty_tables_and_text_ids(spark):
    reads, strands = spark.createDataFrame([("a.b", "ACGTACGTAC")], "read_id string, seq string"), spark.createDataFrame([("s", "ACGTACGTAC")], "strand_id string, seq string")
    assert [tuple(r) for r in assignment.assigned(reads, strands).collect()] == [("a.b", "s", 20, 1.0, "ACGTACGTAC", False)]
    assert assignment.assigned(reads, strands.where("false")).collect() == []
    assert assignment.assigned(reads.where("false"), strands).collect() == []


def test_scores_without_alignments(monkeypatch):
    monkeypatch.setattr(assignment, "CELLS", 3000)
    rng = random.Random(3)
    pairs = [(dna(rng, rng.randint(0, 40)), dna(rng, rng.randint(0, 40))) for _ in range(300)]
    a, b = zip(*pairs)
    assert (assignment.scores(a, b) == assignment.align_all(a, b)[0]).all()


def test_bound_of_scores():
    """No pair scores more than its changes allow, counted by the grams that it lacks."""
    rng = random.Random(8)
    for _ in range(300):
        strand = dna(rng, rng.randint(20, 60))
        read = worn(rng, strand, rng.random() * 0.4)
        counts, total = assignment._grams([read])
        common = counts @ np.minimum(assignment._grams([strand])[0], 1).T
        changes = np.ceil((total - common[:, 0]) / assignment.GRAM).astype(int)
        assert assignment.scores([strand], [read])[0] <= assignment.most_scored(np.array(len(strand)), np.array(len(read)), changes)[0]


def test_seed_lengths():
    assert [assignment.seed_length(n) for n in (0, 1, 120_000, 42_000_000)] == [6, 6, 10, 14]


def test_near_strands_are_all_found():
    """All pairs with fewer edits than the search tells of are found, with their distance; letters that are no bases and long sequences are found too."""
    rng = random.Random(4)
    strands = [dna(rng, rng.choice([0, 10, 11, 20, 58, 60, 60, 60, 63, 66])) for _ in range(400)] + ["ACGTN" * 12, "acgt" * 15, "é一" * 20 + dna(rng, 20)]
    strands += [worn(rng, rng.choice(strands), 0.06) for _ in range(80)]
    reads = [worn(rng, rng.choice(strands), rng.choice([0, 0.05, 0.1, 0.15])) for _ in range(200)] + ["A" * 60, "", "ACG", dna(rng, 200), "ACGTN" * 12, "é一" * 20 + strands[402][-20:]]
    r, s, edits, told = distances.Near(strands).search(reads)
    found = {(int(a), int(b)): int(c) for a, b, c in zip(r, s, edits)}
    assert len(found) == len(r) and told[:200].max() >= 10
    for i, read in enumerate(reads):
        apart = (len(read) + np.array([len(x) for x in strands]) - assignment.align_all(strands, [read] * len(strands))[0]) // 3
        assert {(i, k) for k in np.flatnonzero(apart < told[i]).tolist()} <= found.keys()
        assert all(c in (-1, apart[k]) for (a, k), c in found.items() if a == i)


def test_a_frequent_part_tells_nothing(monkeypatch):
    monkeypatch.setattr(distances, "FREQUENT", 30)
    rng = random.Random(6)
    primer = dna(rng, 12)
    strands = [primer + dna(rng, 48) for _ in range(100)]
    told = distances.Near(strands).search(strands)[3]
    assert set(told.tolist()) == {8}


def test_few_reads_are_held_against_all_strands(spark, monkeypatch):
    """Reads with eight changes of sixty bases, and copies of one that resembles nothing: that one alone, and once."""
    rng = random.Random(12)
    strands = [(f"s{k}", dna(rng, 60)) for k in range(150)]
    changed = lambda seq, k: "".join(c if (p - k) % 7 or p >= 56 else rng.choice("ACGT".replace(c, "")) for p, c in enumerate(seq))
    reads = [(k, changed(strands[k][1], k)) for k in range(150)] + [(1000 + k, "A" * 60) for k in range(50)]
    held = []
    exhausted = assignment.exhausted
    monkeypatch.setattr(assignment, "exhausted", lambda rest, *others: held.append(rest.count()) or exhausted(rest, *others))
    got = assignment.assigned(spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(strands, "strand_id string, seq string")).collect()
    assert {r.read_id: tuple(r) for r in got} == expected(reads, strands)
    assert held == [1]
