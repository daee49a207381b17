"""K-mers of sequences.  Two engines with the same rows: built-in expressions over overlapping chunks, and Arrow batches.

A window with a letter that is no base is no k-mer.  Packed k-mers have two bits a base; canonical ones are the lesser of a k-mer and
its reverse complement, which is the same in packed and in text order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import beside, written
from .dna import canonical, checked_k, normalize_base, pack

#: Windows of a chunk: substring() walks from the start of its string, so strings are kept short.
CHUNK = 200
#: Bases that a task packs at once.
BATCH_BASES = 1 << 20

_CODES = np.full(256, 4, dtype=np.uint8)
for _code, _letters in enumerate(("Aa", "Cc", "Gg", "TtUu")):
    for _letter in _letters:
        _CODES[ord(_letter)] = _code


def _packed(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of k codes, forward and reverse complement, by joining windows of half the length.  They are of the codes' type, which must be wide enough."""
    if k == 1:
        return codes, 3 - codes
    half = k // 2
    forward, reverse = _packed(codes, half)
    n = len(codes) - 2 * half + 1
    two = forward[:n] << 2 * half | forward[half : half + n], reverse[half : half + n] << 2 * half | reverse[:n]
    if k % 2 == 0:
        return two
    n -= 1
    last = codes[k - 1 : k - 1 + n]
    return two[0][:n] << 2 | last, (3 - last) << 2 * (k - 1) | two[1][:n]


def _codes(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all sequences' letters, one after the other, and where each begins, and the end."""
    seqs = seqs.cast(pa.large_string()).fill_null("")
    _, at, data = seqs.buffers()
    at = np.frombuffer(at, np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
    codes = _CODES[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if data is not None else np.zeros(0, np.uint8)
    return codes, at - at[0]


def _both_windows(seqs: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, position, packed k-mer, its reverse complement) of every valid window."""
    codes, at = _codes(seqs)
    if len(codes) < k:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    bad = np.append(0, np.cumsum(codes == 4))
    forward, reverse = _packed(np.where(codes == 4, 0, codes).astype(np.uint64), k)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(forward)]
    ok = np.flatnonzero((bad[k:] == bad[:-k]) & (np.arange(len(forward)) + k <= at[owner + 1]))
    return owner[ok], ok - at[owner[ok]], forward[ok], reverse[ok]


def forward_windows(seqs: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, position, packed k-mer as it stands) of every valid window."""
    owner, pos, forward, _ = _both_windows(seqs, k)
    return owner, pos, forward.astype(np.int64)


def _valid(codes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Whether each window lies in one sequence and has no break; there are k codes at least."""
    valid = np.ones(len(codes) - k + 1, dtype=bool)
    ends = at[1:-1]
    for back in range(1, min(k, len(codes))):
        over = ends - back
        valid[over[(over >= 0) & (over < len(valid))]] = False
    if (codes == 4).any():
        bad = np.append(0, np.cumsum(codes == 4))
        valid &= bad[k:] == bad[:-k]
    return valid


def _canonical(seqs: pa.Array, k: int) -> np.ndarray:
    """The packed canonical k-mer of every valid window, where no one asks whose it is."""
    codes, at = _codes(seqs)
    if len(codes) < k:
        return np.zeros(0, np.uint64)
    valid = _valid(codes, at, k)
    forward, reverse = _packed(np.where(codes == 4, 0, codes).astype(np.uint64), k)
    return np.minimum(forward, reverse)[valid]


def turned(kmers: np.ndarray, k: int) -> np.ndarray:
    """The reverse complements of packed k-mers: pairs of bits are inverted, and swapped in ever larger blocks."""
    x = ~kmers.view(np.uint64)
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        m = np.uint64(mask)
        x = x >> np.uint64(shift) & m | (x & m) << np.uint64(shift)
    return (x.byteswap() >> np.uint64(64 - 2 * k)).view(np.int64)


def _windows(seqs: pa.Array, k: int, step: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, position, packed canonical k-mer) of every valid window, or of those at multiples of `step`."""
    owner, pos, forward, reverse = _both_windows(seqs, k)
    kmer = np.minimum(forward, reverse).astype(np.int64)
    if step > 1:
        keep = pos % step == 0
        owner, pos, kmer = owner[keep], pos[keep], kmer[keep]
    return owner, pos, kmer


def _pieces(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.append(0, np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy()))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(size, size[i] + BATCH_BASES, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def kmers_ordered(seqs: DataFrame, k: int, id_col: str = "strand_id", engine: str = "arrow", step: int = 1) -> DataFrame:
    """(id_col, pos, kmer): the packed canonical k-mer at every valid position, from 0, or at multiples of `step`; repeats included.  seqs: id_col, seq."""
    checked_k(k)
    if engine == "sql":
        n = F.length("seq") - k + 1
        chunks = F.explode(F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(CHUNK)), lambda s: F.struct(s.alias("at"), F.substring(F.col("seq"), s + 1, F.lit(CHUNK + k - 1)).alias("part")))))
        parts = seqs.select(id_col, normalize_base(F.col("seq")).alias("seq")).select(id_col, chunks.alias("c"))
        windows = F.transform(F.sequence(F.lit(0), F.length("c.part") - k), lambda i: F.substring(F.col("c.part"), i + 1, F.lit(k)))
        rows = parts.select(id_col, F.col("c.at").alias("at"), F.posexplode(windows).alias("i", "kmer")).where(~F.rlike("kmer", F.lit("[^ACGT]")) & ((F.col("at") + F.col("i")) % step == 0))
        return rows.select(id_col, (F.col("at") + F.col("i")).alias("pos"), pack(canonical(F.col("kmer"))).alias("kmer"))
    if engine != "arrow":
        raise ValueError(f"no engine {engine}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, "seq"):
            owner, pos, kmer = _windows(batch.column("seq"), k, step)
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(owner)), pa.array(pos.astype(np.int32)), pa.array(kmer)], names=[id_col, "pos", "kmer"])

    kind = seqs.schema[id_col].dataType.simpleString()
    return seqs.select(id_col, "seq").mapInArrow(run, f"{id_col} {kind}, pos int, kmer long")


def _first_in_each(owner: np.ndarray, kmer: np.ndarray) -> np.ndarray:
    """Where each sequence's different k-mers come first.  Sequences stand one after the other, so a stable order of k-mers keeps theirs."""
    order = np.argsort(kmer, kind="stable")
    kmer, owner = kmer[order], owner[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (kmer[1:] != kmer[:-1]) | (owner[1:] != owner[:-1])
    return order[new]


def kmers_distinct(seqs: DataFrame, k: int, id_col: str = "strand_id", engine: str = "arrow") -> DataFrame:
    """(id_col, kmer, pos): each row's different k-mers with the first position of each.  A sequence is a row, so nothing is shuffled; the engine of
    built-in expressions groups by id, which then must be different for each row."""
    checked_k(k)
    if engine == "sql":
        return kmers_ordered(seqs, k, id_col, engine).groupBy(id_col, "kmer").agg(F.min("pos").alias("pos"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, "seq"):
            owner, pos, kmer = _windows(batch.column("seq"), k)
            first = _first_in_each(owner, kmer)
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(owner[first])), pa.array(kmer[first]), pa.array(pos[first].astype(np.int32))], names=[id_col, "kmer", "pos"])

    kind = seqs.schema[id_col].dataType.simpleString()
    return seqs.select(id_col, "seq").mapInArrow(run, f"{id_col} {kind}, kmer long, pos int")


#: K-mers are looked up by an odd multiple of themselves: its upper bits are even for any input, and it can be undone.
ODD = 0x9E3779B97F4A7C15
_ODD, _UNDO = np.uint64(ODD), np.uint64(pow(ODD, -1, 1 << 64))
#: Buckets for each of Spark's shuffle partitions at least, different k-mers of a bucket at most (there are more buckets where that asks for it), and k-mers that a
#: task which makes lists holds before it adds up equal ones.  A task that reads buckets holds one: 16 bytes for each of its k-mers, twice as much of lists that are not added
#: up yet, and their copy: some 200 MB.
BUCKETS, BUDGET, HELD = 4, 1 << 21, 4 << 20
#: Bases that a byte of a file may hold, and buckets up to which the size of files tells their number: of too many buckets each has a few bytes of what a task hands out at once, and rows cost more than what is in them.
EXPANSION, MOST_ESTIMATED = 8, 1 << 12
#: Bases of the minimizers that deal out k-mers of `LEAST_PIECED` bases or more; k-mers of a piece at most, and bytes of pieces that a task holds before it hands them out.
MINIMIZER, LEAST_PIECED, MOST_PIECE, HELD_PIECES = 12, 20, 4096, 8 << 20
#: asks: lists as they are stored, lists or pieces to count, pieces that ask.
STORED, COUNTS, ASKS = -1, 0, 1
_LISTS = "bucket int, asks int, keys binary, counts binary, s binary, pos binary, sizes binary, bases binary"
_NAMES = [x.split()[0] for x in _LISTS.split(", ")]


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Runs of values as binary cells; starts: of each run, and the end."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _cell(batch: pa.RecordBatch, column: str, i: int, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(column)[i].as_buffer(), kind)


def _before(sizes: np.ndarray) -> np.ndarray:
    """Where runs of these sizes begin, and the end."""
    return np.append(0, np.cumsum(sizes, dtype=np.int64))


def _within(sizes: np.ndarray) -> np.ndarray:
    """The number of each entry in its run."""
    at = _before(sizes)
    return np.arange(at[-1]) - np.repeat(at[:-1], sizes)


def _scattered(codes: np.ndarray, k: int, m: int) -> np.ndarray:
    """For each window of k codes the least of its minimizers' scattered values, which is the same for its reverse complement; spread over 64 bits."""
    if m > 16:
        forward, reverse = _packed(codes.astype(np.uint64), m)
        return np.minimum(forward, reverse) * _ODD * _ODD
    forward, reverse = _packed(codes.astype(np.uint32), m)
    least = (np.minimum(forward, reverse) ^ np.uint32(0x2545F491)) * np.uint32(0x9E3779B1)
    width, size = k - m + 1, 1
    while 2 * size <= width:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    return least.astype(np.uint64) * _ODD


class Pieces:
    """Runs of windows side by side that go to one bucket.  A piece has its bases packed, two bits each, its number of windows (`sizes`), its sequence's number and its place there.

    K-mers of `LEAST_PIECED` bases or more are dealt out by their minimizer, which neighbours mostly share, so that a piece of some ten k-mers takes as many bytes, and not eight for each."""

    def __init__(self, sizes: np.ndarray, bases: np.ndarray, s: np.ndarray | None, pos: np.ndarray | None, k: int):
        self.sizes, self.bases, self.s, self.pos, self.k = sizes, bases, s, pos, k

    @staticmethod
    def bytes_of(sizes: np.ndarray, k: int) -> np.ndarray:
        return (sizes + (k + 2)) // 4

    @classmethod
    def cut(cls, seqs: pa.Array, k: int, bits: int, numbers: np.ndarray) -> tuple[np.ndarray, Pieces]:
        """The buckets of the sequences' pieces, and those, in order."""
        codes, at = _codes(seqs)
        if len(codes) < k:
            none = np.zeros(0, np.int64)
            return none, cls(none, np.zeros(0, np.uint8), none, none, k)
        valid = np.flatnonzero(_valid(codes, at, k))
        codes = np.where(codes == 4, np.uint8(0), codes)
        bucket = (_scattered(codes, k, minimizer(k)) >> np.uint64(64 - bits)).astype(np.int32)[valid]
        new = np.ones(len(valid), bool)
        new[1:] = (valid[1:] != valid[:-1] + 1) | (bucket[1:] != bucket[:-1])
        if k == 1:  # only windows of one base are side by side where two sequences meet
            new |= np.isin(valid, at)
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(valid)))
        if sizes.max(initial=0) > MOST_PIECE:
            first = np.flatnonzero(new | (_within(sizes) % MOST_PIECE == 0))
            sizes = np.diff(np.append(first, len(valid)))
        start = valid[first]
        four = np.append(codes, np.zeros(3, np.uint8))
        four = four[:-3] << 6 | four[1:-2] << 4 | four[2:-1] << 2 | four[3:]
        size = cls.bytes_of(sizes, k)
        bases = four[np.minimum(np.repeat(start, size) + 4 * _within(size), len(four) - 1)]
        owner = np.searchsorted(at, start, side="right") - 1
        return bucket[first], cls(sizes, bases, numbers[owner], start - at[owner], k)

    def kmers(self) -> np.ndarray:
        """The packed canonical k-mers of all windows, in order."""
        place = _within(self.sizes)
        byte = np.repeat(_before(self.bytes_of(self.sizes, self.k))[:-1], self.sizes) + (place >> 2)
        data = np.append(self.bases, np.zeros(9, np.uint8))
        odd = (place & 3).astype(np.uint64) * np.uint64(2)
        words = np.ndarray((len(self.bases) + 1,), ">u8", data, strides=(1,))
        forward = (words[byte].astype(np.uint64) << odd | data[byte + 8].astype(np.uint64) >> (np.uint64(8) - odd)) >> np.uint64(64 - 2 * self.k)
        return np.minimum(forward, turned(forward, self.k).view(np.uint64))

    def taken(self, order: np.ndarray) -> Pieces:
        """These pieces, in this order."""
        size = self.bytes_of(self.sizes, self.k)
        bases = self.bases[np.repeat(_before(size)[:-1][order], size[order]) + _within(size[order])]
        return Pieces(self.sizes[order], bases, None if self.s is None else self.s[order], None if self.pos is None else self.pos[order], self.k)

    def cells(self, starts: np.ndarray) -> list[pa.Array]:
        """s, pos, sizes and bases of runs of pieces as binary cells; starts: of each run, and the end."""
        none = pa.nulls(len(starts) - 1, pa.binary())
        at = _before(self.bytes_of(self.sizes, self.k))
        return [none if self.s is None else _binary(self.s.astype(np.int64), starts), none if self.pos is None else _binary(self.pos.astype(np.int32), starts), _binary(self.sizes.astype(np.uint16), starts), _binary(self.bases, at[starts])]

    @classmethod
    def read(cls, batch: pa.RecordBatch, i: int, k: int) -> Pieces:
        column = lambda c, kind: _cell(batch, c, i, kind) if batch.column(c)[i].is_valid else None
        return cls(column("sizes", np.uint16).astype(np.int64), column("bases", np.uint8), column("s", np.int64), column("pos", np.int32), k)

    @classmethod
    def joined(cls, parts: list[Pieces]) -> Pieces:
        one = lambda of: None if of[0] is None else np.concatenate(of)
        return cls(*(one([getattr(p, c) for p in parts]) for c in ("sizes", "bases", "s", "pos")), parts[0].k)

    def repeats(self, keys: np.ndarray) -> np.ndarray:
        """Whether each window's key is in its sequence before.  Pieces stand in the order of sequences and places."""
        s = np.repeat(self.s, self.sizes)
        order = np.argsort(keys, kind="stable")
        again = np.zeros(len(keys), bool)
        again[order[1:]] = (keys[order[1:]] == keys[order[:-1]]) & (s[order[1:]] == s[order[:-1]])
        return again


def minimizer(k: int) -> int:
    """Bases of the minimizers of k-mers; short k-mers are dealt out by themselves."""
    return MINIMIZER if k >= LEAST_PIECED else k


class Deal:
    """Lists of scattered k-mers, cut into buckets: so many that none has more than `budget` k-mers, as far as k-mers are spread evenly."""

    def __init__(self, source: DataFrame | None, bits: int | None = None, budget: int | None = None):
        """source: reads (seq) or a table of counts (kmer); not needed where the bits are given.

        The buckets of reads follow the size of their files, of which each byte may hold `EXPANSION` bases; where no such size is known, or that would make too many
        buckets, the bases are summed first.  Rows of tables are counted."""
        if bits is None:
            budget, least = budget or BUDGET, BUCKETS * int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            # buckets are even, so twice as many as are needed leave room for their differences
            reads = "seq" in source.columns
            needed = 2 * EXPANSION * int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // budget if reads else MOST_ESTIMATED + 1
            if needed > MOST_ESTIMATED:
                most = F.coalesce(F.sum(F.length("seq")), F.lit(0)) if reads else F.count("*")
                needed = -(-2 * source.agg(most).first()[0] // budget)
            bits = max(1, (max(least, needed) - 1).bit_length())
        self.bits = bits

    def of(self, keys: np.ndarray, k: int) -> np.ndarray:
        """The bucket of each scattered k-mer."""
        if minimizer(k) == k:
            return ((_mixed(keys, k) if k <= 16 else keys * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.zeros(len(keys), np.int64)
        for low in range(0, len(keys), 1 << 16):
            kmers = undone(keys[low : low + (1 << 16)]).view(np.uint64)
            codes = (kmers[:, None] >> (2 * np.arange(k - 1, -1, -1)).astype(np.uint64) & np.uint64(3)).astype(np.uint8)
            # windows that reach from one k-mer into the next are left out
            out[low : low + len(kmers)] = (_scattered(codes.ravel(), k, minimizer(k))[::k] >> np.uint64(64 - self.bits)).astype(np.int64)
        return out

    def lists(self, keys: np.ndarray, n: np.ndarray, k: int) -> pa.RecordBatch:
        """_LISTS of sorted different keys and their counts."""
        bucket = self.of(keys, k)
        order = np.argsort(bucket, kind="stable")
        full, first = np.unique(bucket[order], return_index=True)
        starts = np.append(first, len(order)).astype(np.int64)
        none = pa.nulls(len(full), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), COUNTS, np.int32)), _binary(keys[order], starts), _binary(n[order].astype(np.int64), starts), none, none, none, none], names=_NAMES)

    def counted(self, source: DataFrame, k: int, once: bool = False) -> DataFrame:
        """_LISTS: different k-mers with their occurrences, or what tells the number of sequences that have them.  source: seq (and s, their numbers); or a table (kmer, n or cov), whose
        counts are taken as they are."""
        if "seq" not in source.columns:
            return self._listed(source, k)
        if once or minimizer(k) < k:
            return self._pieced(source, k, COUNTS, once)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, size = [], 0
            for batch in _pieces(batches, "seq"):
                kmer = _canonical(batch.column("seq"), k)
                kmer *= _ODD
                parts.append(np.unique(kmer, return_counts=True))
                size += len(parts[-1][0])
                if size > HELD:
                    yield self.lists(*added(parts), k)
                    parts, size = [], 0
            if size:
                yield self.lists(*added(parts), k)

        return source.select("seq").mapInArrow(run, _LISTS)

    def _listed(self, counts: DataFrame, k: int) -> DataFrame:
        n = "cov" if "cov" in counts.columns else "n"

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column("kmer").to_numpy().view(np.uint64) * _ODD
                yield self.lists(*added([(keys, batch.column("n").to_numpy()), (keys[:0], batch.column("n").to_numpy()[:0])]), k)

        return counts.select("kmer", F.col(n).cast("long").alias("n")).mapInArrow(run, _LISTS)

    def asking(self, seqs: DataFrame, k: int) -> DataFrame:
        """_LISTS: the pieces of sequences, which ask for their k-mers.  seqs: s, seq.  A row has all of a sequence's pieces in its bucket."""
        return self._pieced(seqs, k, ASKS, True)

    def _pieced(self, seqs: DataFrame, k: int, kind: int, owned: bool) -> DataFrame:
        numbered = "s" in seqs.columns

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, size, done = [], 0, 0

            def flush() -> pa.RecordBatch:
                bucket, pieces = np.concatenate([b for b, _ in parts]), Pieces.joined([p for _, p in parts])
                order = np.argsort(bucket, kind="stable")
                full, first = np.unique(bucket[order], return_index=True)
                none = pa.nulls(len(full), pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), kind, np.int32)), none, none, *pieces.taken(order).cells(np.append(first, len(order)))], names=_NAMES)

            for batch in _pieces(batches, "seq"):
                numbers = batch.column("s").to_numpy() if numbered else done + np.arange(batch.num_rows)
                done += batch.num_rows
                bucket, pieces = Pieces.cut(batch.column("seq"), k, self.bits, numbers)
                if not owned:
                    pieces.s = None
                if not owned or kind == COUNTS:
                    pieces.pos = None
                parts.append((bucket, pieces))
                size += len(pieces.bases)
                if size > HELD_PIECES:
                    yield flush()
                    parts, size = [], 0
            if size:
                yield flush()

        return seqs.select(*(["s"] if numbered else []), "seq").mapInArrow(run, _LISTS)


def _mixed(keys: np.ndarray, k: int) -> np.ndarray:
    """What _scattered() makes of short k-mers, from their scattered form."""
    return ((undone(keys).view(np.uint64).astype(np.uint32) ^ np.uint32(0x2545F491)) * np.uint32(0x9E3779B1)).astype(np.uint64) * _ODD


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and their sums, of several such lists."""
    if len(parts) == 1:
        return parts[0]
    keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")  # runs are sorted already
    keys = keys[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.add.reduceat(n[order], start) if len(keys) else n


def undone(keys: np.ndarray) -> np.ndarray:
    return (keys * _UNDO).view(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Values as planes of their bytes, which compress well where upper ones are equal."""
    return values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def stored_list(keys: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys and their counts as they are stored: the keys' differences, and the counts, by planes."""
    return _planes(np.diff(keys, prepend=np.uint64(0))), _planes(n)


def read_list(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    planes = lambda c: np.ascontiguousarray(_cell(batch, c, i, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(planes("keys"), dtype=np.uint64), planes("counts").view(np.int64)


Question = tuple[np.ndarray, Pieces]


def buckets(batches: Iterable[pa.RecordBatch], k: int, again: bool = False, packed: bool = False, seen: list | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, Iterator[Question]]]:
    """(bucket, keys, counts, questions) of each bucket, of rows of _LISTS that are sorted by bucket and asks.  Questions (keys of all windows, pieces) come one row at a
    time, and are to be read before the next bucket.  again: the pieces that were counted are the questions too; they are held, packed, until they are read.  packed: questions are pieces alone, of
    numbered sequences, some rows in one.  seen: is given the bucket's windows as they were read, as keys where these are not many, else as pieces, for in_order()."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            if batch.num_rows:
                for i, (bucket, kind) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("asks").to_pylist())):
                    yield bucket, kind, batch, i

    def asked(pieces: Iterable[Pieces]) -> Iterator[Question]:
        for p in pieces:
            yield p.kmers() * _ODD, p

    def gathered(pieces: Iterable[Pieces]) -> Iterator[Pieces]:
        some, size = [], 0
        for p in pieces:
            some.append(p)
            size += int(p.sizes.sum())
            if size > ROWS_AT_ONCE:
                yield Pieces.joined(some)
                some, size = [], 0
        if some:
            yield Pieces.joined(some)

    for bucket, own in groupby(rows(), key=lambda r: r[0]):
        parts, plain, size, plain_size, held, kept, few, few_size, read = [], [], 0, 0, None, [], [], 0, []

        def unpack() -> None:
            """Pieces that belong to no one are unpacked many rows at a time."""
            nonlocal few, few_size
            if few:
                plain.append(Pieces.joined(few).kmers() * _ODD)
            few, few_size = [], 0

        def settle() -> None:
            """Adds up the windows that were read."""
            nonlocal plain, plain_size, parts, size
            unpack()
            if plain:
                together = np.concatenate(plain)
                parts.append(np.unique(together, return_counts=True))
                size += len(parts[-1][0])
                if seen is not None:
                    read[:] = kept if read else [together]
            plain, plain_size = [], 0
            if size > 2 * BUDGET and len(parts) > 1:
                parts = [added(parts)]
                size = len(parts[0][0]) // 2  # of what is different, at least as much again comes before it is added up

        for row in own:
            _, kind, batch, i = row
            if kind == ASKS:
                held = row
                break
            if kind == STORED:
                parts.append(read_list(batch, i))
                size += len(parts[-1][0])
                settle()
            elif batch.column("bases")[i].is_valid:
                pieces = Pieces.read(batch, i, k)
                if pieces.s is None:
                    few.append(pieces)
                    new = int(pieces.sizes.sum())
                    few_size += new
                    if few_size > ROWS_AT_ONCE:
                        unpack()
                else:
                    keys = pieces.kmers() * _ODD
                    plain.append(keys[~pieces.repeats(keys)])
                    new = len(plain[-1])
                plain_size += new
                if again or seen is not None:
                    kept.append(pieces)
                if plain_size > BUDGET:
                    settle()
            else:
                parts.append(tuple(_cell(batch, c, i, t) for c, t in (("keys", np.uint64), ("counts", np.int64))))
                size += len(parts[-1][0])
                settle()
        settle()
        keys, n = added(parts) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        if seen is not None:
            seen[:] = read
        rest = (Pieces.read(batch, i, k) for _, _, batch, i in chain([held] if held else [], own))
        yield bucket, keys, n, gathered(rest) if packed else asked(kept if again else rest)


def found(keys: np.ndarray, n: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The count of each key that is asked for, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(asked), np.int64)
    k = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[k] == asked, n[k], 0)


def in_order(keys: np.ndarray, seen: list) -> np.ndarray:
    """The order of sorted keys in which a bucket's windows have them first, those that no window has last.  Neighbours overlap by all bases but one, so that rows of text compress to two thirds of what they take in
    the order of keys."""
    if not len(keys):
        return np.zeros(0, np.int64)
    done, place, out = np.zeros(len(keys), bool), np.empty(len(keys), np.int64), []
    for part in seen:
        asked = part if isinstance(part, np.ndarray) else part.kmers() * _ODD
        i = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        i = i[(keys[i] == asked) & ~done[i]]
        here = np.arange(len(i))
        place[i[::-1]] = here[::-1]
        i = i[place[i] == here]
        done[i] = True
        out.append(i)
    return np.concatenate([*out, np.flatnonzero(~done)])


def dealt(lists: DataFrame) -> DataFrame:
    """Lists by bucket, counts before questions."""
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lists.repartition(n, "bucket").sortWithinPartitions("bucket", "asks")


_LETTERS = np.frombuffer(b"ACGT", np.uint8)


def as_text(kmers: np.ndarray, k: int) -> pa.Array:
    """Packed k-mers as text."""
    out = np.empty((len(kmers), k), np.uint8)
    for i in range(k):
        out[:, i] = _LETTERS[kmers >> 2 * (k - 1 - i) & 3]
    return pa.LargeStringArray.from_buffers(len(kmers), pa.py_buffer(np.arange(len(kmers) + 1, dtype=np.int64) * k), pa.py_buffer(out)).cast(pa.string())


def kmer_occurrences(seqs: DataFrame, k: int, once: bool = False, text: bool = False, budget: int | None = None) -> DataFrame:
    """(kmer, n): how often each k-mer occurs, or in how many sequences.  seqs: seq.  Tasks exchange pieces of sequences, or lists of short k-mers and counts, not a row
    for each k-mer.  text: k-mers as text, not packed, in an order that compresses.  budget: k-mers of a bucket, see BUDGET."""
    checked_k(k)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list | None = [] if text else None
        for _, keys, n, _ in buckets(batches, k, seen=seen):
            if text:
                order = in_order(keys, seen)
                keys, n = keys[order], n[order]
            for low in range(0, len(keys), ROWS_AT_ONCE):
                kmer = undone(keys[low : low + ROWS_AT_ONCE])
                yield pa.RecordBatch.from_arrays([as_text(kmer, k) if text else pa.array(kmer), pa.array(n[low : low + ROWS_AT_ONCE])], names=["kmer", "n"])

    return dealt(Deal(seqs, budget=budget).counted(seqs.select("seq"), k, once)).mapInArrow(run, f"kmer {'string' if text else 'long'}, n long")


def occurrences_near(source: DataFrame, cores: np.ndarray, k: int, margin: int) -> DataFrame:
    """(kmer, n): how often each k-mer occurs that holds one of `cores`, packed canonical k-mers that are `margin` bases shorter, in either orientation.  A core is in at most
    (margin + 1) * 4 ** margin different ones.  Tasks pass over all others, so that only what is asked for is exchanged.  source: seq, or a table (kmer, n or cov), whose counts are
    taken as they are."""
    checked_k(k)
    size, cores = k - margin, np.unique(cores.view(np.uint64) * _ODD)
    reads, n = "seq" in source.columns, "cov" if "cov" in source.columns else "n"
    shift = np.uint64(64 - max(16, (16 * len(cores)).bit_length()))

    def held(kmers: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Whether packed canonical ones are cores: marks tell most that aren't."""
        keys = kmers * _ODD
        hit = marks[keys >> shift]
        own = keys[hit]
        hit[hit] = cores[np.minimum(np.searchsorted(cores, own), len(cores) - 1)] == own
        return hit

    def in_reads(seqs: pa.Array, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, at = _codes(seqs)
        if len(codes) < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        valid, found = _valid(codes, at, k), [np.zeros(0, np.uint64)]
        codes = np.where(codes == 4, np.uint8(0), codes)
        for low in range(0, len(valid), BATCH_BASES):  # a read may be longer than what is packed at once
            part, ok = codes[low : low + BATCH_BASES + k - 1], valid[low : low + BATCH_BASES]
            hit = held(np.minimum(*_packed(part.astype(np.uint64), size)), marks)
            wanted = np.zeros(len(ok), bool)
            for back in range(margin + 1):
                wanted |= hit[back : back + len(ok)]
            start = np.flatnonzero(wanted & ok)
            kmers = np.zeros(len(start), np.uint64)
            for i in range(k):
                kmers = kmers << np.uint64(2) | part[start + i].astype(np.uint64)
            found.append(np.minimum(kmers, turned(kmers, k).view(np.uint64)))
        return np.unique(np.concatenate(found), return_counts=True)

    def in_table(kmers: np.ndarray, counted: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit = np.zeros(len(kmers), bool)
        for back in range(margin + 1):
            core = kmers >> np.uint64(2 * back) & np.uint64((1 << 2 * size) - 1)
            hit |= held(np.minimum(core, turned(core, size).view(np.uint64)), marks)
        return added([(kmers[hit], counted[hit]), (kmers[:0], counted[:0])])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(1 << 64 - int(shift), bool)
        marks[cores >> shift] = True
        parts, new = [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            kmers, counted = added(parts)
            for low in range(0, len(kmers), ROWS_AT_ONCE):
                yield pa.RecordBatch.from_arrays([pa.array(kmers[low : low + ROWS_AT_ONCE].view(np.int64)), pa.array(counted[low : low + ROWS_AT_ONCE].astype(np.int64))], names=["kmer", "n"])

        for batch in _pieces(batches, "seq") if reads else batches:
            part = in_reads(batch.column("seq"), marks) if reads else in_table(batch.column("kmer").to_numpy().view(np.uint64), batch.column("n").to_numpy(), marks)
            if not len(part[0]):
                continue
            parts.append(part)
            new += len(part[0])
            if new > BUDGET:
                parts = [added(parts)]
                new = len(parts[0][0])
                if 2 * new > BUDGET:
                    yield from rows()
                    parts, new = [], 0
        if parts:
            yield from rows()

    if not len(cores):
        return source.sparkSession.createDataFrame([], "kmer long, n long")
    own = source.select("seq") if reads else source.where("kmer IS NOT NULL").select("kmer", F.col(n).cast("long").alias("n"))
    return own.mapInArrow(run, "kmer long, n long").groupBy("kmer").agg(F.sum("n").alias("n"))


def occurrences_of(reads: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(kmer, n): how often those of many k-mers occur that occur at all.  Both sides travel as pieces, and meet where the reads' are counted.  reads: seq; asked: seq, of different k-mers."""
    checked_k(k)
    deal = Deal(reads)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, n, questions in buckets(batches, k):
            for wanted, _ in questions:
                number = found(keys, n, wanted)
                there = number > 0
                yield pa.RecordBatch.from_arrays([pa.array(undone(wanted[there])), pa.array(number[there])], names=["kmer", "n"])

    asking = deal.asking(asked.select(F.lit(0).cast("long").alias("s"), "seq"), k)
    return dealt(deal.counted(reads.select("seq"), k).unionByName(asking, allowMissingColumns=True)).mapInArrow(run, "kmer long, n long")


def counted_lists(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k-mers, counts) of some reads after others."""
    for batch in _pieces(batches, "seq"):
        kmer, n = np.unique(_canonical(batch.column("seq"), k), return_counts=True)
        yield kmer.view(np.int64), n


def merged(counts: DataFrame) -> DataFrame:
    """(kmer, n): the sums of a table that has k-mers more than once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, n, _ in buckets(batches, MERGED_K):
            yield pa.RecordBatch.from_arrays([pa.array(undone(keys)), pa.array(n)], names=["kmer", "n"])

    return dealt(Deal(counts).counted(counts, MERGED_K)).mapInArrow(run, "kmer long, n long")


#: A length for tables whose k-mers' length isn't known: they are dealt out by their whole scattered value.
MERGED_K = LEAST_PIECED - 1
#: Rows of k-mers that a task hands out at once.
ROWS_AT_ONCE = 1 << 16


def count_histogram(seqs: DataFrame, k: int, cap: int, once: bool = False) -> DataFrame:
    """(n, kmers): how many k-mers have each count, capped; a few rows for each bucket, so that a count comes more than once."""
    checked_k(k)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, n, _ in buckets(batches, k):
            count, kmers = np.unique(np.minimum(n, cap), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(count), pa.array(kmers.astype(np.int64))], names=["n", "kmers"])

    return dealt(Deal(seqs).counted(seqs.select("seq"), k, once)).mapInArrow(run, "n long, kmers long")


def most_shared(strands: DataFrame, k: int, cap: int, id_col: str = "strand_id") -> DataFrame:
    """(id_col, n), written: for each strand that has k-mers the greatest number of strands, capped, that one of its k-mers is in.  Strands' pieces are sent once: they are counted, and then
    looked up in what they were counted to.  Tasks send the greatest numbers of a bucket's strands, a few for each strand in all."""
    checked_k(k)
    own = written(strands.select(id_col, "seq", F.monotonically_increasing_id().alias("s")))
    deal = Deal(own)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            s, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(s, kind="stable")
            number, first = np.unique(s[order], return_index=True)
            return number, np.maximum.reduceat(n[order], first)

        for _, keys, n, questions in buckets(batches, k, again=True):
            n = np.minimum(n, cap).astype(np.int32)
            for asked, pieces in questions:
                held.append((pieces.s, np.maximum.reduceat(found(keys, n, asked), _before(pieces.sizes)[:-1])))
                size += len(pieces.s)
                if size > ANSWERS_AT_ONCE:
                    held = [joined()]
                    size = len(held[0][0])
                    if 2 * size > ANSWERS_AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["s", "n"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined()], names=["s", "n"])

    most = dealt(deal.counted(own.select("s", "seq"), k, True)).mapInArrow(run, "s long, n int").groupBy("s").agg(F.max("n").cast("long").alias("n"))
    return written(own.select(id_col, "s").join(most, "s").drop("s"))


def compared(reads: DataFrame, targets: DataFrame, k: int, cap: int, cutoff: int = 0) -> DataFrame:
    """(kmer, cov, t): the different k-mers of the reads that have more than `cutoff` of them, with their capped counts, and those of the targets; t: whether a target has it.  cov is null for
    targets' k-mers below.  The reads' stand in an order that compresses.  Both are cut into pieces, and compared where the reads' are counted.  reads, targets: seq."""
    checked_k(k)
    deal = Deal(reads)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list = []
        for _, keys, n, questions in buckets(batches, k, seen=seen):
            keep = n > cutoff
            keys, n = keys[keep], np.minimum(n[keep], cap)
            hit, lost = np.zeros(len(keys), bool), [np.zeros(0, np.uint64)]
            for asked, _ in questions:
                asked = np.unique(asked)
                there = found(keys, n, asked) > 0
                hit[np.searchsorted(keys, asked[there])] = True
                lost.append(asked[~there])
                if sum(map(len, lost)) > 2 * len(lost[0]) + BUDGET:
                    lost = [np.unique(np.concatenate(lost))]
            order = in_order(keys, seen)
            for own, cov, t in ((undone(keys[order]), n[order], hit[order]), (undone(np.unique(np.concatenate(lost))), None, None)):
                for low in range(0, len(own), ROWS_AT_ONCE):
                    part = own[low : low + ROWS_AT_ONCE]
                    columns = [pa.nulls(len(part), pa.int32()), pa.array(np.ones(len(part), bool))] if cov is None else [pa.array(cov[low : low + ROWS_AT_ONCE].astype(np.int32)), pa.array(t[low : low + ROWS_AT_ONCE])]
                    yield pa.RecordBatch.from_arrays([pa.array(part), *columns], names=["kmer", "cov", "t"])

    asking = deal.asking(targets.select(F.lit(0).cast("long").alias("s"), "seq"), k)
    return dealt(deal.counted(reads, k).unionByName(asking, allowMissingColumns=True)).mapInArrow(run, "kmer long, cov int, t boolean")


#: Kinds of rows of surveyed(): histograms, and strands.
MEMBERS, READS, TARGETS, STRANDS = range(4)
LINKED, BROKEN = 1, 2


def surveyed(strands: DataFrame, reads: DataFrame, k: int, strand_cap: int, read_cap: int, links: int, cutoff: int) -> DataFrame:
    """(kind, value, n), written: how many of the strands' different k-mers are in `value` strands (MEMBERS), how many of the reads' have the count `value` (READS), and how many of the strands' have that in the
    reads (TARGETS), a few rows for each value; and (STRANDS) the marks (`value`: LINKED and BROKEN, or both) of strands `n` which have a k-mer in more than `links` other strands, or one with a count of `cutoff` at most.
    Both sides travel as pieces, once: strands' are counted and looked up where the reads' are counted, and of a strand nothing returns but its marks.  strands, reads: seq."""
    checked_k(k)
    deal = Deal(reads)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, size = [], 0

        def histogram(kind: int, counts: np.ndarray) -> pa.RecordBatch:
            value, n = np.unique(counts, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(value), kind, np.int32)), pa.array(value.astype(np.int32)), pa.array(n.astype(np.int64))], names=["kind", "value", "n"])

        def joined() -> tuple[np.ndarray, np.ndarray]:
            s, mark = (np.concatenate(x) for x in zip(*marked))
            order = np.argsort(s, kind="stable")
            number, first = np.unique(s[order], return_index=True)
            return number, np.bitwise_or.reduceat(mark[order], first)

        def marks() -> pa.RecordBatch:
            number, mark = marked[0]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(number), STRANDS, np.int32)), pa.array(mark.astype(np.int32)), pa.array(number)], names=["kind", "value", "n"])

        for _, keys, n, questions in buckets(batches, k, packed=True):
            yield histogram(READS, np.minimum(n, read_cap))
            kept = list(questions)
            parts, waiting = [], 0
            for pieces in kept:
                asked = pieces.kmers() * _ODD
                parts.append(np.unique(asked[~pieces.repeats(asked)], return_counts=True))
                waiting += len(parts[-1][0])
                if waiting > 2 * BUDGET:
                    parts = [added(parts)]
                    waiting = len(parts[0][0]) // 2
            if not parts:
                continue
            own, members = added(parts)
            members, cov = np.minimum(members, strand_cap), np.minimum(found(keys, n, own), read_cap)
            yield histogram(MEMBERS, members)
            yield histogram(TARGETS, cov)
            mark = ((members - 1 > links) * LINKED | (cov <= cutoff) * BROKEN).astype(np.uint8)
            if not mark.any():
                continue
            for pieces in kept:
                here = np.bitwise_or.reduceat(mark[np.searchsorted(own, pieces.kmers() * _ODD)], _before(pieces.sizes)[:-1])
                some = np.flatnonzero(here)
                marked.append((pieces.s[some], here[some]))
                size += len(some)
            if size > ANSWERS_AT_ONCE:
                marked = [joined()]
                size = len(marked[0][0])
                if 2 * size > ANSWERS_AT_ONCE:
                    yield marks()
                    marked, size = [], 0
        if size:
            marked = [joined()]
            yield marks()

    asking = deal.asking(strands.select(F.monotonically_increasing_id().alias("s"), "seq"), k)
    return written(dealt(deal.counted(reads.select("seq"), k).unionByName(asking, allowMissingColumns=True)).mapInArrow(run, "kind int, value int, n long"))


#: What tasks that look up send to those that gather a strand's k-mers: parts are groups of strands, or a histogram of counts (whose values are in cov, and their numbers in s).
_ANSWERS = "part int, s binary, pos binary, sizes binary, bases binary, cov binary"
READ_HISTOGRAM, TARGET_HISTOGRAM = -1, -2
ANSWERS_AT_ONCE = 1 << 20
#: The count of a window whose k-mer its strand has before; caps are lower.
AGAIN = (1 << 16) - 1


def _answered(lists: DataFrame, k: int, cap: int, parts: int, every: bool, histograms: bool) -> DataFrame:
    """_ANSWERS: the capped count of each k-mer that is asked for, by pieces, in lists by group of strands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[Pieces, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            pieces, cov = Pieces.joined([p for p, _ in waiting]), np.concatenate([c for _, c in waiting])
            waiting.clear()
            part = pieces.s % parts
            order = np.argsort(part, kind="stable")
            full, first = np.unique(part[order], return_index=True)
            starts, at = np.append(first, len(order)), _before(pieces.sizes)
            cov = cov[np.repeat(at[:-1][order], pieces.sizes[order]) + _within(pieces.sizes[order])]
            own = pieces.taken(order)
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *own.cells(starts), _binary(cov, _before(own.sizes)[starts])], names=["part", "s", "pos", "sizes", "bases", "cov"])

        def histogram(kind: int, counts: np.ndarray) -> pa.RecordBatch:
            value, n = np.unique(counts, return_counts=True)
            one = np.array([0, len(value)])
            none = pa.nulls(1, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), _binary(n.astype(np.int64), one), none, none, none, _binary(value.astype(np.uint16), one)], names=["part", "s", "pos", "sizes", "bases", "cov"])

        size = 0
        for _, keys, n, questions in buckets(batches, k):
            n = np.minimum(n, cap)
            hit, missing, missed = np.zeros(len(keys), bool), [], 0
            for asked, pieces in questions:
                cov = found(keys, n, asked)
                if histograms:
                    hit[np.searchsorted(keys, asked[cov > 0])] = True
                    missing.append(np.unique(asked[cov == 0]))
                    missed += len(missing[-1])
                    if missed > BUDGET:
                        missing = [np.unique(np.concatenate(missing))]
                        missed = len(missing[0]) // 2
                cov = cov.astype(np.uint16)
                if not every:
                    cov[pieces.repeats(asked)] = AGAIN
                waiting.append((pieces, cov))
                size += len(asked)
                if size > ANSWERS_AT_ONCE:
                    yield flush()
                    size = 0
            if histograms:
                yield histogram(READ_HISTOGRAM, n)
                lost = np.unique(np.concatenate(missing)) if missing else np.zeros(0, np.uint64)
                yield histogram(TARGET_HISTOGRAM, np.append(n[hit], np.zeros(len(lost), np.int64)))
        if waiting:
            yield flush()

    return dealt(lists).mapInArrow(run, _ANSWERS)


def _gathered(answers: DataFrame, k: int, columns: list[str]) -> DataFrame:
    """(s, pos, kmer, cov), or those of the columns: a row for each strand, with arrays in the order of positions."""
    kinds = {"pos": "int", "kmer": "long", "cov": "int"}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def strands(own: list[tuple[Pieces, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            pieces, cov = Pieces.joined([p for p, _ in own]), np.concatenate([c for _, c in own])
            order = np.lexsort((pieces.pos, pieces.s))
            at = _before(pieces.sizes)
            cov = cov[np.repeat(at[:-1][order], pieces.sizes[order]) + _within(pieces.sizes[order])]
            pieces = pieces.taken(order)
            keep = cov != AGAIN
            number, first = np.unique(np.repeat(pieces.s, pieces.sizes)[keep], return_index=True)
            values = {
                "pos": lambda: (np.repeat(pieces.pos, pieces.sizes) + _within(pieces.sizes)).astype(np.int32),
                "kmer": lambda: pieces.kmers().view(np.int64),
                "cov": lambda: cov.astype(np.int32),
            }
            ends = pa.array(np.append(first, keep.sum()).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(number), *(pa.ListArray.from_arrays(ends, pa.array(values[c]()[keep])) for c in columns)], names=["s", *columns])

        now, own = None, []
        for batch in batches:
            for i, part in enumerate(batch.column("part").to_pylist()):
                if part != now and own:
                    yield from strands(own)
                    own = []
                now = part
                own.append((Pieces.read(batch, i, k), _cell(batch, "cov", i, np.uint16)))
        if own:
            yield from strands(own)

    n = int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return answers.repartition(n, "part").sortWithinPartitions("part").mapInArrow(run, "s long, " + ", ".join(f"{c} array<{kinds[c]}>" for c in columns))


class Paths:
    """Strands' k-mers with their counts, looked up where the counts are.

    Strands go to the buckets of their k-mers in pieces, answers come back by pieces for groups of strands, of about `BUDGET` k-mers each; there each strand becomes one row of arrays.
    source: reads (seq), which are counted on the way; a table of counts (kmer, n or cov); or a stored table (its `bits`, and lists)."""

    def __init__(self, strands: DataFrame, source, k: int, cap: int, id_col: str = "strand_id", every: bool = False, histograms: bool = False):
        checked_k(k)
        if cap >= AGAIN:
            raise ValueError(f"caps must be below {AGAIN}")
        self.id_col, self.k = id_col, k
        self.own = written(strands.select(F.col(id_col).alias("id"), "seq", F.monotonically_increasing_id().alias("s")))
        bases = self.own.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
        deal = Deal(source) if isinstance(source, DataFrame) else source.deal
        counted = deal.counted(source, k) if isinstance(source, DataFrame) else source.lists
        lists = counted.unionByName(deal.asking(self.own, k), allowMissingColumns=True)
        self.answers = _answered(lists, k, cap, max(1, -(-2 * bases // BUDGET)), every, histograms)
        if histograms:
            self.answers = written(self.answers)

    def rows(self, *columns: str) -> DataFrame:
        """(id_col, pos, kmer, cov), or those of the columns, of each strand that has k-mers: arrays, in the order of positions."""
        columns = columns or ("pos", "kmer", "cov")
        names = self.own.select(F.col("id").alias(self.id_col), F.col("s").alias("number"))
        packed = _gathered(self.answers.where("part >= 0"), self.k, list(columns))
        return packed.join(beside(names), F.col("s") == F.col("number")).select(self.id_col, *columns)

    def histogram(self, kind: int) -> DataFrame:
        """(cov, kmers): how many different k-mers of the reads, or of the strands, have each count."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(_cell(batch, "cov", i, np.uint16).astype(np.int32)), pa.array(_cell(batch, "s", i, np.int64))], names=["cov", "kmers"])

        return self.answers.where(F.col("part") == kind).select("cov", "s").mapInArrow(run, "cov int, kmers long").groupBy("cov").agg(F.sum("kmers").alias("kmers"))
