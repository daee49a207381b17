"""Consensus from reads that are not aligned yet: each read goes to the strand it aligns to best."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.distances import Near, Planes, distances
from ..functions.kmers import forward_windows, kmers_distinct, kmers_ordered
from ..sources.scratch import beside, settled, written
from .alignment import majority_vote

MATCH, MISMATCH, GAP = 2, -1, -2
MIN_IDENTITY, AMBIGUITY = 0.75, 2


#: Pairs up to which all may be aligned without a k.
ALL_PAIRS = 1 << 22
#: Strands that a seed may be in before it tells nothing.
FREQUENT = 64
#: Reads, strands and bases of a block; strands of a block that are aligned to a read first; pairs that are aligned at once; bases of the grams that bound scores.
READS_A_BLOCK, STRANDS_A_BLOCK, BLOCK_BASES, FIRST, PAIRS_AT_ONCE, GRAM = 256, 2048, 1 << 20, 4, 1 << 15, 5
#: Blocks of strands (of some 2 MB) up to which they are broadcast, and tasks that blocks are dealt out to.
FEW_BLOCKS, MOST_TASKS = 16, 4096
#: Reads, strands and bases of a block of the search for near strands, and blocks of reads that a task holds.
NEAR_READS, NEAR_STRANDS, NEAR_BASES, NEAR_HELD = 1 << 13, 1 << 17, 1 << 23, 32
#: Cells of the tables that are filled in at once.
CELLS = 1 << 23


def _letters(texts: list[str], own: list[int], size: int) -> np.ndarray:
    """Texts of one length as rows of letters; all letters beyond Latin-1 are one."""
    return np.frombuffer("".join(texts[k] for k in own).encode("latin-1", "replace"), np.uint8).reshape(len(own), size)


def align_all(strands: list[str], reads: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Score, identity over aligned pairs, and what the read has at each base of the strand (- for a gap), of a global alignment of each pair.  A step on
    the diagonal is preferred to one in the strand, and that to one in the read.  Pairs of the same lengths are aligned together."""
    score, identity, bases = np.zeros(len(reads), np.int64), np.zeros(len(reads)), [""] * len(reads)
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (s, r) in enumerate(zip(strands, reads)):
        groups.setdefault((len(s), len(r)), []).append(k)
    for (n, m), members in groups.items():
        step = max(1, CELLS // ((n + 1) * (m + 1)))
        for low in range(0, len(members), step):
            own = members[low : low + step]
            score[own], identity[own], found = _aligned(_letters(strands, own, n), _letters(reads, own, m))
            for k, row in zip(own, found):
                bases[k] = row.tobytes().decode("latin-1")
    return score, identity, bases


def _aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the tables of all pairs are computed at once: within a row, gaps in the read are a running maximum once their cost is taken out."""
    (pairs, n), m = a.shape, b.shape[1]
    ramp = GAP * np.arange(m + 1)
    row = np.tile(ramp, (pairs, 1))
    diagonal, up = np.zeros((n, pairs, m + 1), bool), np.zeros((n, pairs, m + 1), bool)
    for i in range(n):
        straight = row[:, :-1] + np.where(b == a[:, i : i + 1], MATCH, MISMATCH)
        down = row + GAP
        best = down.copy()
        best[:, 0] = GAP * (i + 1)
        np.maximum(best[:, 1:], straight, out=best[:, 1:])
        row = np.maximum.accumulate(best - ramp, axis=1) + ramp
        diagonal[i, :, 1:], up[i] = row[:, 1:] == straight, row == down
    out = np.full((pairs, n), ord("-"), np.uint8)
    i, j, p = np.full(pairs, n), np.full(pairs, m), np.arange(pairs)
    met, same = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    while len(p := np.flatnonzero((i > 0) | (j > 0))):
        at = np.maximum(i[p] - 1, 0)
        straight = (i[p] > 0) & (j[p] > 0) & diagonal[at, p, j[p]] if n else np.zeros(len(p), bool)
        down = ~straight & (i[p] > 0) & ((j[p] == 0) | up[at, p, j[p]]) if n else np.zeros(len(p), bool)
        q = p[straight]
        i[q], j[q] = i[q] - 1, j[q] - 1
        out[q, i[q]] = b[q, j[q]]
        met[q], same[q] = met[q] + 1, same[q] + (a[q, i[q]] == b[q, j[q]])
        i[p[down]] -= 1
        j[p[~straight & ~down]] -= 1
    return row[:, -1], np.where(met > 0, same / np.maximum(met, 1), 0.0), out


def align(strand: str, read: str) -> tuple[int, float, str]:
    score, identity, bases = align_all([strand], [read])
    return int(score[0]), float(identity[0]), bases[0]


def candidates(reads: DataFrame, strands: DataFrame, k: int | None) -> DataFrame:
    """(read_id, strand_id): pairs to align.  With k, those that share a k-mer, found by a join; without, all pairs, for small sets only: more than
    `ALL_PAIRS` are refused."""
    if k is None:
        if reads.count() * strands.count() > ALL_PAIRS:
            raise ValueError(f"more than {ALL_PAIRS} pairs: give a k")
        return reads.select("read_id").join(strands.select("strand_id"), how="cross")
    return kmers_distinct(reads, k, "read_id").select("read_id", "kmer").join(kmers_distinct(strands, k).select("strand_id", "kmer"), "kmer").select("read_id", "strand_id").distinct()


def score_of(strand: np.ndarray, read: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """The score of sequences of these lengths that are so many edits apart: a base costs half of MATCH less wherever it is matched, so that the best alignment is that of the fewest edits."""
    return strand + read - 3 * edits


def scores(strands: list[str], reads: list[str]) -> np.ndarray:
    """The score of a global alignment of each pair, without the alignment: by the edit distance where both are short and have no other letters than bases.  The tables of others are
    filled by their diagonals, those of all pairs of the same lengths at once."""
    out = np.zeros(len(reads), np.int64)
    a, b = Planes(strands), Planes(reads)
    plain = np.flatnonzero(a.plain & b.plain)
    out[plain] = score_of(a.size[plain], b.size[plain], distances(a, b, plain, plain))
    groups: dict[tuple[int, int], list[int]] = {}
    for k in np.flatnonzero(~(a.plain & b.plain)).tolist():
        groups.setdefault((len(strands[k]), len(reads[k])), []).append(k)
    for (n, m), members in groups.items():
        step = max(1, CELLS // (4 * (n + 1)))
        for low in range(0, len(members), step):
            own = members[low : low + step]
            out[own] = _diagonals(*(np.ascontiguousarray(x.T) for x in (_letters(strands, own, n), _letters(reads, own, m))))
    return out


def _diagonals(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Last cells of the tables.  a, b: a column for each pair.  Row i of a diagonal d is the cell (i, d - i)."""
    (n, pairs), m = a.shape, len(b)
    turned = np.ascontiguousarray(b[::-1])
    kind = np.int16 if 2 * (n + m) < 1 << 15 else np.int32
    two, one, now = (np.zeros((n + 1, pairs), kind) for _ in range(3))
    for d in range(1, n + m + 1):
        low, high = max(0, d - m), min(n, d)
        first, last = max(low, 1), min(high, d - 1)
        if low == 0:
            now[0] = GAP * d
        if high == d:
            now[d] = GAP * d
        if first <= last:
            best = np.where(a[first - 1 : last] == turned[m - d + first : m - d + last + 1], kind(MATCH), kind(MISMATCH))
            best += two[first - 1 : last]
            gap = np.maximum(one[first - 1 : last], one[first : last + 1])
            gap += kind(GAP)
            np.maximum(best, gap, out=now[first : last + 1])
        two, one, now = one, now, two
    return one[n].astype(np.int64)


def most_scored(strand: np.ndarray, read: np.ndarray, changes: np.ndarray) -> np.ndarray:
    """The greatest score that sequences of these lengths can have if at least so many bases are mismatched or beside a gap: 3 is lost for each beyond those that the
    difference of lengths brings with it."""
    apart = np.abs(strand - read)
    return 2 * np.minimum(strand, read) - 2 * apart - 3 * np.maximum(changes - apart, 0)


def _most_scored_of_any(shortest: int, longest: int) -> Column:
    """most_scored() over all lengths of strands, for reads with columns size and changes: greatest where the difference of lengths accounts for all changes."""
    at = F.least(F.greatest(F.col("size") + F.col("changes"), F.lit(shortest)), F.lit(longest))
    apart = F.abs(at - F.col("size"))
    return 2 * F.least(at, F.col("size")) - 2 * apart - 3 * F.greatest(F.col("changes") - apart, F.lit(0))


def seed_length(bases: int) -> int:
    """The length from which a seed is by chance in a strand or less, for strands of that many bases in all."""
    return min(max(-(-max(bases, 1).bit_length() // 2) + 1, 6), 31)


def seeded(reads: DataFrame, strands: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(read_id, changes), (read_id, strand_id): pairs that share one of the read's seeds, which are its windows of k bases side by side; and how many of its seeds tell
    something, those that more than `FREQUENT` strands have left out.  A strand that is not paired with the read has none of those, so that each spans a change."""
    of_strands = written(kmers_distinct(strands, k).select("kmer", "strand_id"))
    frequent = written(of_strands.groupBy("kmer").count().where(F.col("count") > FREQUENT).select("kmer"))
    seeds = written(kmers_ordered(reads, k, "read_id", step=k).select("read_id", "kmer").join(beside(frequent), "kmer", "left_anti"))
    pairs = seeds.join(of_strands, "kmer").select("read_id", "strand_id").distinct()
    return seeds.groupBy("read_id").agg(F.count("*").cast("int").alias("changes")), pairs


def scored(pairs: DataFrame, reads: DataFrame, strands: DataFrame) -> DataFrame:
    """(read_id, strand_id, score), written."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = scores(batch.column("strand").to_pylist(), batch.column("read").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("read_id"), batch.column("strand_id"), pa.array(score)], names=["read_id", "strand_id", "score"])

    kinds = {c: d.schema[c].dataType.simpleString() for c, d in (("read_id", reads), ("strand_id", strands))}
    texts = pairs.join(reads.select("read_id", F.col("seq").alias("read")), "read_id").join(strands.select("strand_id", F.col("seq").alias("strand")), "strand_id")
    return written(texts.select("read_id", "strand_id", "read", "strand").mapInArrow(run, f"read_id {kinds['read_id']}, strand_id {kinds['strand_id']}, score long"))


def _grams(seqs: list[str], size: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """How often each gram of `size` bases is in each sequence, and how many it has."""
    owner, _, gram = forward_windows(pa.array(seqs, pa.string()), size)
    counts = np.bincount(owner * 4**size + gram, minlength=len(seqs) * 4**size).reshape(len(seqs), -1)
    return counts.astype(np.float32), counts.sum(axis=1)


def _letter_counts(seqs: list[str]) -> list[np.ndarray]:
    """How many of each letter every sequence has, and how many of all others."""
    known = [np.array([s.count(c) for s in seqs], dtype=np.int64) for c in "ACGT"]
    return [*known, np.array([len(s) for s in seqs], dtype=np.int64) - sum(known)]


class Block:
    """A block of strands that blocks of reads are held against, with every pair whose score can matter."""

    def __init__(self, ids: list, seqs: list[str]):
        self.ids, self.seqs = ids, seqs
        self.has = np.minimum(_grams(seqs)[0], 1)
        self.letters = _letter_counts(seqs)
        self.size = np.array([len(s) for s in seqs])

    def bounds(self, reads: list[str]) -> np.ndarray:
        """The greatest score that each pair can have.  A change spoils `GRAM` of a read's grams at most, so those that a strand has none of bound its score; so do the
        letters that both have, of which no more can match."""
        counts, total = _grams(reads)
        changes = np.ceil((total[:, None] - counts @ self.has.T) / GRAM).astype(np.int64)
        size = np.array([len(r) for r in reads])
        matches = sum(np.minimum(a[:, None], b[None, :]) for a, b in zip(_letter_counts(reads), self.letters))
        short, apart = np.minimum(self.size[None, :], size[:, None]), np.abs(self.size[None, :] - size[:, None])
        return np.minimum(most_scored(self.size[None, :], size[:, None], changes), (MATCH - MISMATCH) * matches + MISMATCH * short + GAP * apart)

    def _aligned(self, reads: list[str], r: np.ndarray, s: np.ndarray) -> np.ndarray:
        parts = [scores([self.seqs[x] for x in s[low : low + PAIRS_AT_ONCE]], [reads[x] for x in r[low : low + PAIRS_AT_ONCE]]) for low in range(0, len(r), PAIRS_AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def first(self, reads: list[str]) -> np.ndarray:
        """For each read the best score with the strands that promise most."""
        most = self.bounds(reads)
        few = min(FIRST, most.shape[1])
        s = np.argpartition(-most, few - 1, axis=1)[:, :few]
        return self._aligned(reads, np.repeat(np.arange(len(reads)), few), s.ravel()).reshape(-1, few).max(axis=1)

    def best(self, reads: list[str], least: list[int], ambiguity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(read, strand, score) of all pairs within `ambiguity` of each read's `least` score, which it has with some strand: only those that can be are aligned."""
        need = np.array(least) - ambiguity
        r, s = np.nonzero(self.bounds(reads) >= need[:, None])
        score = self._aligned(reads, r, s)
        keep = score >= need[r]
        return r[keep], s[keep], score[keep]


def _in_blocks(rows: DataFrame, id_col: str, most: int, name: str, columns: list[str], most_bases: int | None = None) -> tuple[DataFrame, int]:
    """(name, list): rows in blocks of about `most` of them or `most_bases` (`BLOCK_BASES`) bases, and the number of blocks."""
    n, bases = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()
    blocks = max(1, -(-n // most), -(-bases // (most_bases or BLOCK_BASES)))
    block = F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias(name)
    return written(rows.select(block, F.struct(*columns).alias("row")).groupBy(name).agg(F.collect_list("row").alias(f"{name}_rows"))), blocks


def exhausted(reads: DataFrame, strands: DataFrame, ambiguity: int) -> DataFrame:
    """(read_id, strand_id, score): reads (read_id, seq, best) against all strands, in blocks of both: every pair within `ambiguity` of the read's best score, and some others.
    Blocks of strands meet each block of reads, by a broadcast where they are few and else by a product of partitions, and no pair is made a row before its score is known to matter.  First each read is aligned to the strands of each block
    that promise most; the best score of those then excludes nearly all others."""
    kinds = {c: d.schema[c].dataType for c, d in (("read_id", reads), ("strand_id", strands))}
    names = {c: kind.simpleString() for c, kind in kinds.items()}
    types = {c: to_arrow_type(kind) for c, kind in kinds.items()}
    of_strands, n_strands = _in_blocks(strands, "strand_id", STRANDS_A_BLOCK, "s", ["strand_id", "seq"])

    def against(reads: DataFrame, of: Callable[[Block, list[dict]], pa.RecordBatch], schema: str) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, block = None, None
            for batch in batches:
                for k in range(batch.num_rows):
                    if (s := batch.column("s")[k].as_py()) != held:
                        rows = batch.column("s_rows")[k].as_py()
                        held, block = s, Block([x["strand_id"] for x in rows], [x["seq"] for x in rows])
                    yield of(block, batch.column("r_rows")[k].as_py())

        of_reads, n_reads = _in_blocks(reads, "read_id", READS_A_BLOCK, "r", ["read_id", "seq", "best"])
        if n_strands <= FEW_BLOCKS:
            tasks = of_reads.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n_strands - 1)))).repartition(max(1, min(n_reads * n_strands, MOST_TASKS)), "r", "s")
            both = tasks.join(F.broadcast(of_strands), "s").sortWithinPartitions("s").select("s", "s_rows", "r_rows")
        else:
            # each block is moved once, and read by each task that needs it; all blocks of reads that a task has follow each other for a block of strands
            side = int(MOST_TASKS**0.5)
            left, right = of_strands.repartition(min(n_strands, side), "s"), of_reads.select("r", "r_rows").repartition(min(n_reads, side), "r")
            both = left.hint("shuffle_replicate_nl").crossJoin(right).select("s", "s_rows", "r_rows")
        return both.mapInArrow(run, schema)

    def first(block: Block, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x["read_id"] for x in rows], types["read_id"]), pa.array(block.first([x["seq"] for x in rows]))], names=["read_id", "score"])

    def every(block: Block, rows: list[dict]) -> pa.RecordBatch:
        r, s, score = block.best([x["seq"] for x in rows], [x["best"] for x in rows], ambiguity)
        return pa.RecordBatch.from_arrays([pa.array([rows[x]["read_id"] for x in r], types["read_id"]), pa.array([block.ids[x] for x in s], types["strand_id"]), pa.array(score)], names=["read_id", "strand_id", "score"])

    found = against(reads, first, f"read_id {names['read_id']}, score long").groupBy("read_id").agg(F.max("score").alias("score"))
    known = written(reads.join(found, "read_id").select("read_id", "seq", F.greatest("best", "score").alias("best")))
    return written(against(known, every, f"read_id {names['read_id']}, strand_id {names['strand_id']}, score long"))


def near_strands(reads: DataFrame, strands: DataFrame, ambiguity: int) -> tuple[DataFrame, DataFrame]:
    """(read_id, strand_id, score), (read_id, changes): reads (read_id, seq) with strands few edits away, which have a part of the read with one edit at most, within `ambiguity` of the read's best such
    strand of the block; and for each read the changes that all strands at least have that were not compared with it.  A block of strands meets all blocks of reads of a task, one after the other."""
    kinds = {c: d.schema[c].dataType for c, d in (("read_id", reads), ("strand_id", strands))}
    names = {c: kind.simpleString() for c, kind in kinds.items()}
    types = {c: to_arrow_type(kind) for c, kind in kinds.items()}
    of_strands, n_strands = _in_blocks(strands, "strand_id", NEAR_STRANDS, "s", ["strand_id", "seq"], NEAR_BASES)
    of_reads, n_reads = _in_blocks(reads, "read_id", NEAR_READS, "r", ["read_id", "seq"], NEAR_BASES)
    side = max(-(-3 * reads.sparkSession.sparkContext.defaultParallelism // n_strands), -(-n_reads // NEAR_HELD))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, ids = None, None, []
        for batch in batches:
            for k in range(batch.num_rows):
                if (number := batch.column("s")[k].as_py()) != held:
                    rows = batch.column("s_rows")[k].values
                    held, block, ids = number, Near(rows.field("seq").to_pylist()), rows.field("strand_id").to_pylist()
                rows = batch.column("r_rows")[k].values
                seqs, own = rows.field("seq").to_pylist(), rows.field("read_id").to_pylist()
                r, s, edits, told = block.search(seqs)
                score = score_of(block.own.size[s], np.array([len(x) for x in seqs], np.int64)[r], edits)
                if len(odd := np.flatnonzero(edits < 0)):
                    score[odd] = scores([block.seqs[x] for x in s[odd]], [seqs[x] for x in r[odd]])
                top = np.full(len(seqs), np.iinfo(np.int64).min)
                np.maximum.at(top, r, score)
                keep = np.flatnonzero(score >= top[r] - ambiguity)
                yield pa.RecordBatch.from_arrays([pa.array([own[x] for x in r[keep]], types["read_id"]), pa.array([ids[x] for x in s[keep]], types["strand_id"]), pa.array(score[keep]), pa.nulls(len(keep), pa.int32())], names=["read_id", "strand_id", "score", "changes"])
                yield pa.RecordBatch.from_arrays([pa.array(own, types["read_id"]), pa.nulls(len(own), types["strand_id"]), pa.nulls(len(own), pa.int64()), pa.array(told.astype(np.int32))], names=["read_id", "strand_id", "score", "changes"])

    left, right = of_strands.repartition(n_strands, "s"), of_reads.select("r", "r_rows").repartition(min(n_reads, side), "r")
    both = left.hint("shuffle_replicate_nl").crossJoin(right).select("s", "s_rows", "r_rows")
    found = written(both.mapInArrow(run, f"read_id {names['read_id']}, strand_id {names['strand_id']}, score long, changes int"))
    return found.where("changes IS NULL").drop("changes"), found.where("changes IS NOT NULL").groupBy("read_id").agg(F.min("changes").alias("changes"))


@settled
def assigned(reads: DataFrame, strands: DataFrame, k: int | None = None, min_identity: float = MIN_IDENTITY, ambiguity: int = AMBIGUITY) -> DataFrame:
    """(read_id, strand_id, score, identity, bases, ambiguous): each read's best strand by score, then identity, then strand_id; without reads whose best identity
    is too low.  ambiguous: the second best score is within `ambiguity`.  As if all pairs were aligned, whatever k is.

    Equal reads are one.  Pairs that share a seed of k bases are scored first.  A read's seeds lie side by side, so a strand that has none of them differs from the read at each, which bounds its
    score; where the best score found is not above that bound by more than `ambiguity`, all strands few edits away are searched for.  Reads whose best score is not above the bound of what
    that search leaves out are held against all strands in blocks.  k: by the size of the strands if not given."""
    every_read, strands = written(reads.select("read_id", "seq").where("seq IS NOT NULL")), written(strands.select("strand_id", "seq").where("seq IS NOT NULL"))
    reads = written(every_read.select("seq").distinct().select(F.monotonically_increasing_id().alias("read_id"), "seq"))
    bases, shortest, longest = strands.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)), F.coalesce(F.min(F.length("seq")), F.lit(0)), F.coalesce(F.max(F.length("seq")), F.lit(0))).first()

    def unsure(reads: DataFrame, changes: DataFrame, pairs: DataFrame) -> DataFrame:
        """(read_id, seq, best), written: reads that strands which are not among the pairs may resemble as much; those have so many changes at least."""
        state = reads.join(changes, "read_id", "left").join(pairs.groupBy("read_id").agg(F.max("score").alias("best")), "read_id", "left")
        state = state.select("read_id", "seq", "best", F.length("seq").alias("size"), F.coalesce("changes", F.lit(0)).alias("changes"))
        sure = F.coalesce(F.col("best") - ambiguity > _most_scored_of_any(shortest, longest), F.lit(False))
        return written(state.where(~sure).select("read_id", "seq", "best"))

    changes, pairs = seeded(reads, strands, k or seed_length(bases))
    seen = scored(pairs, reads, strands)
    asked = unsure(reads, changes, seen)
    near, changes = near_strands(asked.select("read_id", "seq"), strands, ambiguity)
    seen = written(seen.unionByName(near).dropDuplicates(["read_id", "strand_id"]))
    rest = unsure(asked.select("read_id", "seq"), changes, seen)
    every = seen.join(rest.select("read_id"), "read_id", "left_anti").unionByName(exhausted(rest, strands, ambiguity))
    close = F.count_if(F.col("score") >= F.col("top") - ambiguity).over(Window.partitionBy("read_id"))
    top = every.withColumn("top", F.max("score").over(Window.partitionBy("read_id"))).withColumn("close", close).where(F.col("score") == F.col("top"))
    best = _chosen(top, reads, strands, min_identity).withColumnRenamed("read_id", "number")
    return best.join(reads.select(F.col("read_id").alias("number"), "seq"), "number").join(every_read, "seq").select("read_id", *(c for c in best.columns if c != "number"))


def _chosen(top: DataFrame, reads: DataFrame, strands: DataFrame, min_identity: float) -> DataFrame:
    """Of strands with the read's best score, the one of the best identity, then the least."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, identity, bases = align_all(batch.column("strand").to_pylist(), batch.column("read").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("read_id"), batch.column("strand_id"), pa.array(score, pa.int32()), pa.array(identity, pa.float64()), pa.array(bases, pa.string()), batch.column("close")], names=["read_id", "strand_id", "score", "identity", "bases", "close"])

    kinds = {c: d.schema[c].dataType.simpleString() for c, d in (("read_id", reads), ("strand_id", strands))}
    texts = top.join(reads.select("read_id", F.col("seq").alias("read")), "read_id").join(strands.select("strand_id", F.col("seq").alias("strand")), "strand_id")
    aligned = texts.select("read_id", "strand_id", "read", "strand", "close").mapInArrow(run, f"read_id {kinds['read_id']}, strand_id {kinds['strand_id']}, score int, identity double, bases string, close long")
    rank = F.row_number().over(Window.partitionBy("read_id").orderBy(F.desc("identity"), "strand_id"))
    best = aligned.withColumn("rank", rank).where((F.col("rank") == 1) & (F.col("identity") >= min_identity))
    return best.select("read_id", "strand_id", "score", "identity", "bases", (F.col("close") > 1).alias("ambiguous"))


def read_consensus(reads: DataFrame, strands: DataFrame, k: int | None = None, min_identity: float = MIN_IDENTITY, ambiguity: int = AMBIGUITY, min_depth: int = 1, min_majority: float = 0.6) -> DataFrame:
    """(name, read_count, mean_depth, covered_bases, n_count, distance, exact_match, consensus, ambiguous, best_identity) of every strand; name is its strand_id.
    distance: edit distance."""
    best = assigned(reads, strands, k, min_identity, ambiguity)
    per = best.groupBy(F.col("strand_id").alias("name")).agg(F.count("*").alias("reads"), F.max("ambiguous").alias("ambiguous"), F.max("identity").alias("best"))
    columns = best.select(F.col("strand_id").alias("name"), F.posexplode(F.split("bases", "")).alias("pos", "base")).groupBy("name", "pos", "base").agg(F.count("*").alias("n"))
    votes = majority_vote(columns, min_depth, min_majority)
    found = votes.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("pos", "base"))).alias("bases"), F.sum("depth").alias("depth"), F.count("*").alias("covered"))
    own = strands.select(F.col("strand_id").alias("name"), "seq").join(found, "name", "left").join(per, "name", "left")
    size = F.length("seq")
    letters = F.when(size > 0, F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.coalesce(F.col("bases")[i], F.lit("N"))))
    own = own.withColumn("consensus", F.coalesce(F.array_join(letters, ""), F.lit("")))
    return own.select(
        "name",
        F.coalesce("reads", F.lit(0)).cast("long").alias("read_count"),
        F.when(size > 0, F.coalesce("depth", F.lit(0)) / size).otherwise(F.lit(0.0)).alias("mean_depth"),
        F.coalesce("covered", F.lit(0)).cast("long").alias("covered_bases"),
        F.length(F.regexp_replace("consensus", "[^N]", "")).alias("n_count"),
        F.levenshtein("consensus", "seq").alias("distance"),
        (F.col("consensus") == F.col("seq")).alias("exact_match"),
        "consensus",
        F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"),
        F.coalesce("best", F.lit(0.0)).alias("best_identity"),
    )
