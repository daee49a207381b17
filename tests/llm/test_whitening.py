"""Whitening against sums in whole numbers, a second way to the polynomial, and numpy's eigenvectors."""

from fractions import Fraction

import numpy as np
import pytest

from helixlake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, id string, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], "own", "own") for k, v in rows], SCHEMA).repartition(3)


def polynomial(a):
    """Coefficients of det(x - a), from the constant one up, by traces of powers."""
    d, m, out = len(a), np.zeros((len(a),) * 2, dtype=object), [Fraction(1)]
    for k in range(1, d + 1):
        m = a.dot(m) + np.eye(d, dtype=int).astype(object) * out[-1]
        out.append(-Fraction(int(np.trace(a.dot(m)))) / k)
    return [int(c) for c in reversed(out)]


def exact(values):
    x = np.array([[int(np.floor(np.float64(np.float32(e)) * 64)) + 1_000_000 for e in v] for v in values], dtype=object)
    n, s = len(x), x.sum(axis=0)
    return x, n, s, n * x.T.dot(x) - np.multiply.outer(s, s)


def test_characteristic_polynomial(spark):
    rng = np.random.default_rng(3)
    for d, rank in ((1, 1), (2, 2), (7, 7), (9, 4)):
        b = rng.integers(-(10**6), 10**6, (d, rank)).astype(object)
        a = b.dot(b.T)
        assert whitening.characteristic(spark, a) == polynomial(a)
    p = whitening.primes_beyond(1)[0]
    swaps = np.array([[0, 0, 1], [0, 2, 0], [1, 0, 0]], dtype=object)  # needs rows to be swapped, or has none below
    assert [int(c) for c in whitening.characteristic_mod((swaps % p).astype(np.int64), p)] == [c % p for c in polynomial(swaps)]


def test_roots_are_counted_with_multiplicity():
    c = [0, 0, -12, 16, -7, 1]  # x^2 (x - 2)^2 (x - 3)
    assert [whitening.roots_above(c, x, 0) for x in (0, 1, 2, 3)] == [3, 3, 1, 0]
    found = whitening.isolated(c, 7, 5)
    assert [(above, m) for above, m, *_ in found] == [(0, 1), (1, 2)]
    low, high, bits = found[1][2:]
    assert Fraction(low, 2**bits) < 2 <= Fraction(high, 2**bits)
    root = whitening.refined([-2, 0, 1], 0, 2, 0)
    assert root == 2 or abs(Fraction(root) - 1) < 2
    fine = whitening.refined([-2, 0, 1], 1 << 200, 2 << 200, 200)
    assert abs(fine * fine - (2 << 400)) <= 8 << 200


def test_whitened_rows_match_numpy(spark):
    rng = np.random.default_rng(5)
    values = (rng.normal(size=(300, 6)) * [3, 2, 1, 0.5, 0.3, 0.2]).astype(np.float32)
    rows = list(enumerate(values)) + [(7, values[7]), (None, values[8])]
    every = np.array([v for _, v in rows])
    got = whitening.whitened(vectors(spark, rows), components=4).collect()
    x, n, s, a = exact(every)
    e, u = np.linalg.eigh(a.astype(np.float64) / n**2)
    centred = (x - s / n).astype(np.float64)
    w = centred @ u[:, ::-1] / np.sqrt(e[::-1])
    deviation = {i: int(sum((n * x[i] - s) ** 2)) for i in range(n)}
    assert len(got) == 4 * n and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    for c in range(1, 5):
        own = sorted((r for r in got if r.component == c), key=lambda r: (r.vec_id is None, r.vec_id))
        order = sorted(range(n), key=lambda i: (rows[i][0] is None, rows[i][0]))
        mine = np.array([r.whitened for r in own])
        other = w[order, c - 1]
        assert min(np.abs(mine - other).max(), np.abs(mine + other).max()) < 1e-9
        assert [r.deviation for r in own] == [deviation[i] for i in order]
        assert own[0].explained == pytest.approx(e[::-1][c - 1] / e.sum(), rel=1e-12)


def test_equal_roots_and_directions_without_variance(spark):
    points = [[sx, sy, sz, 5.0, sx] for sx in (-1, 1) for sy in (-1, 1) for sz in (-1, 1)]  # y and z alike, one constant, x twice
    got = whitening.whitened(vectors(spark, list(enumerate(points)))).collect()
    assert {r.component for r in got} == {1, 2, 3}
    assert [round(next(r.explained for r in got if r.component == c), 12) for c in (1, 2, 3)] == [0.5, 0.25, 0.25]
    w = np.array([[r.whitened for r in sorted(got, key=lambda r: (r.component, r.vec_id)) if r.component == c] for c in (1, 2, 3)])
    assert np.abs(w @ w.T / 8 - np.eye(3)).max() < 1e-12
    assert max(r.identity_error for r in got) < 1e-12


def test_close_roots_are_told_apart(spark):
    # roots that differ in the 16th digit: in doubles any turned pair would do as well
    a = np.diag([10**20 + 1, 10**20, 7]).astype(object)
    found = whitening.principal(spark, a, 3)
    assert [[round(x, 15) for x in v] for *_, v in found] == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]


def test_odd_rows_are_dropped(spark):
    good = [(1, [0.5, 1.0]), (2, [1.5, -1.0]), (3, [0.0, 0.25])]
    bad = [(4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (10, [1e30, 0.0])]
    got = whitening.whitened(vectors(spark, good + bad)).collect()
    assert sorted({r.vec_id for r in got}) == [1, 2, 3] and {r.n for r in got} == {3}
    for rows in ([], bad[:5], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = whitening.whitened(vectors(spark, rows))
        assert out.collect() == [] and out.columns[:4] == ["vec_id", "component", "n", "deviation"]


def test_large_entries_stay_exact(spark):
    rows = [(1, [2.0**50, 1.0]), (2, [-(2.0**50), 3.0]), (3, [7.0, 5.0]), (4, [0.0, 0.0])]
    x, n, s, a = exact([v for _, v in rows])
    frame = vectors(spark, rows)
    usable, d, count = whitening.usable(frame, "vec_id", "embedding", 64)
    sums, found = whitening.scatter(usable, d, count)
    assert (found == a).all()
    got = {r.vec_id: r for r in whitening.whitened(frame).where("component = 1").collect()}
    for i, (k, _) in enumerate(rows):
        deviation = int(sum((n * x[i] - s) ** 2))
        assert (got[k].deviation if got[k].deviation is not None else int(got[k].deviation_beyond)) == deviation


def test_narrow_and_text_ids(spark):
    frame = spark.createDataFrame([("a.b", [1.0, 0.0]), ("c", [0.0, 2.0])], "`the.id` string, v array<double>")
    assert {r[0] for r in whitening.whitened(frame.withColumnRenamed("the.id", "key"), "key", "v").collect()} == {"a.b", "c"}
