"""Whitening of embeddings from an exact characteristic polynomial.

Entries become integers, and the vectors' scatter matrix A = n * sum(x x') - S S' (n squared times the covariance) is summed without rounding.  Its
characteristic polynomial is found modulo many primes, by Hessenberg reduction in one task for each few primes, and put together by the Chinese
remainder theorem.  As all of its roots are real, the sign changes of the polynomial shifted to a point are exactly the roots above that point, counted
with multiplicity: bisection by that count isolates the roots.  Each is refined in a task of its own by Newton steps inside the bracket, to
`ROOT_BITS` bits below the trace, and its components come from inverse iteration on the nearly singular matrix in fixed-point numbers of that length.
Roots closer than `SEPARATE_BITS` are one root of several components, any orthonormal ones of their space.

What the driver sees is bounded by the dimension d, whatever the number of rows: d * d sums, the d + 1 coefficients for each prime, and the components.

Cases: rows whose vector is null, or holds a null, an infinite or a not-a-number entry are dropped, as are those of an entry of 2 ** 56 or more, whose integer
is no long; the dimension is the length that most of the rest have (of equally many the least), and rows of other lengths, the empty one too, are dropped.
Repeated rows count each time; null and repeated ids are kept.  Directions without variance have no component, so one row, or equal rows, or
an empty table, give an empty result.  Ids are of any type; other columns of the input are not touched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Bits below the trace at which roots are told apart, to which they are refined, and more bits of the fixed-point numbers of the iteration.
SEPARATE_BITS, ROOT_BITS, GUARD_BITS = 256, 384, 64
#: A sum is exchanged as so many parts of 32 bits, the last one signed.
LIMBS = 6
PRIMES_A_TASK = 8
ROUNDS = 3


def integers(batch: pa.RecordBatch, d: int, scale: int) -> np.ndarray:
    """floor(scale * entry) of each vector: the longs of the contract without the shift that all have in common."""
    return np.floor(batch.column("v").flatten().to_numpy() * scale).astype(np.int64).reshape(-1, d)


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> tuple[DataFrame, int, int]:
    """(id, v) of the rows that count, their dimension, and their number."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.size("v") > 0)
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(2**62 // scale))))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return (rows.where(F.size("v") == top["d"]), top["d"], top["count"]) if top else (rows, 0, 0)


def _exact_product(y: np.ndarray) -> np.ndarray:
    """y' y in whole numbers, by doubles where these hold all sums."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    wide = y.astype(object)
    return wide.T @ wide


def _limbs(i: list[int], j: list[int], values: list[int]) -> pa.RecordBatch:
    mask = (1 << 32) - 1
    parts = [[v >> 32 * k & mask for v in values] for k in range(LIMBS - 1)] + [[v >> 32 * (LIMBS - 1) for v in values]]
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(p, pa.int64()) for p in parts)], names=["i", "j", *(f"l{k}" for k in range(LIMBS))])


def scatter(rows: DataFrame, d: int, n: int, scale: int = SCALE) -> tuple[list[int], np.ndarray]:
    """The sums of the integer vectors by dimension, and n * sum(y y') - sum(y) sum(y)', exact.  A task adds up its rows; Spark adds up the tasks' parts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((d, d), dtype=object), np.zeros(d, dtype=object)
        for batch in batches:
            if batch.num_rows:
                y = integers(batch, d, scale)
                products += _exact_product(y)
                sums += y.astype(object).sum(axis=0)
        for i in range(d):
            yield _limbs([i] * (d - i + 1), [-1, *range(i, d)], [sums[i], *products[i, i:]])

    fields = ", ".join(f"l{k} long" for k in range(LIMBS))
    parts = rows.select("v").mapInArrow(run, f"i int, j int, {fields}").groupBy("i", "j").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)))
    sums, products = [0] * d, np.zeros((d, d), dtype=object)
    for i, j, *limbs in parts.collect():
        value = sum(x << 32 * k for k, x in enumerate(limbs))
        if j < 0:
            sums[i] = value
        else:
            products[i, j] = products[j, i] = value
    s = np.array(sums, dtype=object)
    return sums, n * products - np.multiply.outer(s, s)


def is_prime(n: int) -> bool:
    """By the bases 2, 3, 5 and 7, which are enough below 3,215,031,751."""
    odd, twos = n - 1, 0
    while not odd & 1:
        odd, twos = odd >> 1, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """The greatest primes below 2 ** 31 whose product is more than `bound`."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def characteristic_mod(a: np.ndarray, p: int) -> np.ndarray:
    """The coefficients of det(x - a) modulo a prime, from the constant one up.  a: residues as longs."""
    h, d = a.copy(), len(a)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m]) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    of = np.zeros((d + 1, d + 1), dtype=np.int64)  # of the leading minors
    of[0, 0] = 1
    for k in range(1, d + 1):
        of[k, 1:] = of[k - 1, :-1]
        factors, t = np.zeros(k, dtype=np.int64), 1
        factors[k - 1] = h[k - 1, k - 1]
        for i in range(k - 1, 0, -1):
            t = t * int(h[i, i - 1]) % p
            factors[i - 1] = t * int(h[i - 1, k - 1]) % p
        of[k] = (of[k] - (factors[:, None] * of[:k] % p).sum(axis=0)) % p
    return of[d]


def characteristic(spark: SparkSession, a: np.ndarray) -> list[int]:
    """The coefficients of det(x - a) from the constant one up, for a symmetric matrix without negative roots: those of d such roots with the sum T
    are at most comb(d, k) * (T / d) ** k."""
    d, trace = len(a), sum(a.diagonal())
    bound = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = primes_beyond(2 * bound)
    entries = a.tolist()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(entries, dtype=object)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                found = characteristic_mod((whole % primes[k]).astype(np.int64), primes[k])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([found.tolist()], pa.list_(pa.int64()))], names=["id", "residues"])

    tasks = spark.range(0, len(primes), 1, -(-len(primes) // PRIMES_A_TASK))
    product, out = 1, [0] * (d + 1)
    for p in primes:
        product *= p
    for k, residues in tasks.mapInArrow(run, "id long, residues array<long>").collect():
        rest = product // primes[k]
        weight = rest * pow(rest, -1, primes[k])
        out = [(c + r * weight) % product for c, r in zip(out, residues)]
    return [c - product if 2 * c > product else c for c in out]


def roots_above(coefficients: list[int], at: int, bits: int) -> int:
    """How many roots of a polynomial with real roots only are greater than at / 2 ** bits, counted with multiplicity: its sign changes when shifted there."""
    d = len(coefficients) - 1
    q = [c << bits * (d - i) for i, c in enumerate(coefficients)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            q[j] += at * q[j + 1]
    signs = [c > 0 for c in q if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def isolated(coefficients: list[int], trace: int, wanted: int) -> list[tuple[int, int, int, int, int]]:
    """(roots above, roots in it, low, high, bits) of intervals (low, high] / 2 ** bits that hold the `wanted` greatest positive roots, each one root
    or several that are too close to be told apart."""
    size = trace.bit_length()
    stack, out = [(0, 1 << size, 0, roots_above(coefficients, 0, 0), 0)], []
    wanted = min(wanted, stack[0][3])
    while stack:
        low, high, bits, above_low, above_high = stack.pop()
        if above_low == above_high or above_high >= wanted:
            continue
        if above_low - above_high == 1 or (high - low) << SEPARATE_BITS <= 1 << size + bits:
            out.append((above_high, above_low - above_high, low, high, bits))
            continue
        if (low + high) & 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        above = roots_above(coefficients, middle, bits)
        stack += [(low, middle, bits, above_low, above), (middle, high, bits, above, above_high)]
    return sorted(out)


def _value(coefficients: list[int], x: int, bits: int) -> tuple[int, int]:
    """The polynomial and its slope at x / 2 ** bits, times 2 ** (bits * d) and 2 ** (bits * (d - 1))."""
    value = slope = 0
    for i, c in enumerate(reversed(coefficients)):
        slope = slope * x + value
        value = value * x + (c << bits * i)
    return value, slope


def refined(coefficients: list[int], low: int, high: int, bits: int) -> int:
    """The only root in (low, high] / 2 ** bits, at most 2 units too great."""
    right, _ = _value(coefficients, high, bits)
    if not right:
        return high
    x = (low + high) // 2
    while high - low > 2:
        value, slope = _value(coefficients, x, bits)
        if not value:
            return x
        inside = (value > 0) == (right > 0)
        low, high = (low, x) if inside else (x, high)
        x_next = (low + high) // 2
        if slope:
            step = value // slope
            beyond = x - step + (-1 if inside else 1) * ((abs(step) >> 10) + 1)  # a little beyond the root, to close the bracket there
            x_next = beyond if low < beyond < high else x_next
        x = x_next
    return high


def null_space(a: np.ndarray, value: int, bits: int, m: int) -> list[list[float]]:
    """m orthonormal vectors that a - value / 2 ** bits nearly maps to zero, by inverse iteration in fixed-point numbers."""
    d, more = len(a), bits + GUARD_BITS
    lu = np.array([[int(x) << more for x in row] for row in a], dtype=object)
    for i in range(d):
        lu[i, i] -= value << GUARD_BITS
    order = np.arange(d)
    for k in range(d):
        i = k + max(range(d - k), key=lambda r: abs(lu[k + r, k]))
        if i != k:
            lu[[i, k]] = lu[[k, i]]
            order[[i, k]] = order[[k, i]]
        lu[k, k] = lu[k, k] or 1
        lu[k + 1 :, k] = (lu[k + 1 :, k] << more) // lu[k, k]
        lu[k + 1 :, k + 1 :] -= np.multiply.outer(lu[k + 1 :, k], lu[k, k + 1 :]) >> more
    rng = np.random.default_rng(d)
    space = [np.array([int(x) << more for x in rng.integers(1, 1 << 20, d)], dtype=object) for _ in range(m)]
    for _ in range(ROUNDS):
        for v, y in enumerate(space):
            y = y[order]
            for k in range(d - 1):
                y[k + 1 :] -= lu[k + 1 :, k] * y[k] >> more
            for k in range(d - 1, -1, -1):
                y[k] = (y[k] << more) // lu[k, k]
                y[:k] -= lu[:k, k] * y[k] >> more
            for _ in range(2):
                for other in space[:v]:
                    y = y - (other * (sum(other * y) >> more) >> more)
                y = (y << more) // isqrt(sum(y * y))
            space[v] = y
    out = []
    for y in space:
        lead = max(range(d), key=lambda i: abs(y[i]))
        out.append([int(x) / (1 << more) * (1 if y[lead] > 0 else -1) for x in y])
    return out


def principal(spark: SparkSession, a: np.ndarray, wanted: int) -> list[tuple[int, float, float, list[float]]]:
    """(number, root, share of the trace, unit vector) of the greatest positive roots of a, in falling order; a root in a task."""
    trace = int(sum(a.diagonal()))
    if not trace:
        return []
    coefficients = characteristic(spark, a)
    intervals = isolated(coefficients, trace, wanted)
    bits = max(ROOT_BITS - trace.bit_length(), max(i[4] for i in intervals) + 8)
    entries = a.tolist()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                above, m, low, high, given = intervals[k]
                low, high = low << bits - given, high << bits - given
                root = refined(coefficients, low, high, bits) if m == 1 else (low + high) // 2
                found = null_space(np.array(entries, dtype=object), root, bits, m)
                numbers = list(range(above + 1, above + m + 1))
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([root / (1 << bits)] * m), pa.array([root / (trace << bits)] * m), pa.array(found, pa.list_(pa.float64()))], names=["component", "root", "explained", "vector"])

    found = spark.range(0, len(intervals), 1, len(intervals)).mapInArrow(run, "component int, root double, explained double, vector array<double>").collect()
    return sorted((tuple(r) for r in found), key=lambda r: r[0])[:wanted]


def _mean_square_errors(rows: DataFrame, whiten, k: int, n: int) -> float:
    """The largest absolute entry of the whitened rows' covariance (divisor n) minus the identity."""

    def totals(means: np.ndarray | None):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k if means is None else (k, k))
            for batch in batches:
                if batch.num_rows:
                    w = whiten(batch)
                    total += w.sum(axis=0) if means is None else (w - means).T @ (w - means)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["i", "t"])

        found = rows.select("v").mapInArrow(run, "i int, t double").groupBy("i").agg(F.sum("t").alias("t")).collect()
        return np.array([t for _, t in sorted(map(tuple, found))])

    means = totals(None) / n
    return float(np.abs(totals(means).reshape(k, k) / n - np.eye(k)).max())


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error, deviation_beyond): for each usable row and component its whitened coordinate.

    Entries become x = floor(scale * entry) + shift (the shift cancels in every column).  deviation: the row's sum of (n * x - S) ** 2, exact, null where it is
    no long; then deviation_beyond has its digits."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_beyond string"
    rows, d, n = usable(vectors, id_col, vector_col, scale)
    sums, a = scatter(rows, d, n, scale) if n else ([], np.zeros((0, 0), dtype=object))
    found = principal(spark, a, components) if n else []
    if not found:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    k, numbers = len(found), np.array([c for c, *_ in found], dtype=np.int32)
    basis = np.array([v for *_, v in found]).T / np.sqrt([root / n**2 for _, root, _, _ in found])
    explained = np.array([e for _, _, e, _ in found])
    whole = np.array([s // n for s in sums], dtype=np.int64)
    part = np.array([s % n / n for s in sums])

    def whiten(batch: pa.RecordBatch) -> np.ndarray:
        return (integers(batch, d, scale) - whole - part) @ basis

    def deviations(y: np.ndarray) -> list[int]:
        most = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums))
        kind = np.int64 if most * most * d < 1 << 63 else object
        z = n * y.astype(kind) - np.array(sums, dtype=kind)
        return (z * z).sum(axis=1).tolist()

    error = _mean_square_errors(rows, whiten, k, n)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            exact = deviations(integers(batch, d, scale))
            fits = [x if x < 1 << 63 else None for x in exact]
            beyond = [None if x < 1 << 63 else str(x) for x in exact]
            of = pa.array(np.repeat(np.arange(batch.num_rows), k))
            size = len(of)
            columns = [batch.column("id").take(of), pa.array(np.tile(numbers, batch.num_rows)), pa.array(np.full(size, n)), pa.array(fits, pa.int64()).take(of), pa.array(whiten(batch).ravel()), pa.array(np.tile(explained, batch.num_rows)), pa.array(np.full(size, error)), pa.array(beyond, pa.string()).take(of)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_beyond"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
