"""SimHash near-duplicate detection with Golay-code fuzzy hashing.

A fingerprint is cut into segments of at most 23 bits.  Each segment is decoded to the numbers of all Golay code words
near it (`golay.keys`: one or six), so that segments with two differing bits or fewer share a number.  Of five differing bits or fewer no two
segments can have three, so all segments but one have two or fewer: leaving out each segment in turn, the products of the others'
numbers are the keys, and any two such fingerprints share one.  With three segments a key has 24 bits; large tables take four, and keys of 36
bits, so that a key's rows stay few (`segments_for`); either finds all pairs.
Rows that share a key are compared in the task that holds the key; a key with more than `BLOCK` rows is dealt out in pairs
of blocks.  A task emits one spanning forest of all links that it finds, never all pairs, and `components` joins those.

Cases: null and empty texts (or texts of blanks) have no shingles and fingerprint zero, and link to each other; a text of fewer
words than a shingle has one shingle, the whole sequence; repeated rows give repeated results; ids are of any type that has an order, and null ids
come last in it; empty tables give empty results; other columns of the input are not touched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import golay
from .components import components
from .substrings import BASES, Rolling
from .tables import FEW_ROWS, beside, dropped, settled, table, unused, without, written
from .words import PLAIN_LOWER, Words, chunks, mixed, split_words

#: Most rows of one key that one task compares at once.
BLOCK = 2048
#: Items whose keys are made by one task, and at once.
ITEMS_A_TASK, KEYED_AT_ONCE = 8192, 2048
#: Segments of a 64-bit fingerprint: (bits, lowest bit).
THREE, FOUR = ((22, 0), (21, 22), (21, 43)), ((16, 0), (16, 16), (16, 32), (16, 48))
#: Different fingerprints from which four segments are taken: a key of 24 bits would have some hundred rows then.
MANY = 50_000_000
#: Links that a task holds before it reduces them to a forest.
LINKS_AT_ONCE = 500_000


def segments_for(n: int) -> tuple[tuple[int, int], ...]:
    return THREE if n < MANY else FOUR


def shingle_hashes(words: Words, size: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each shingle of `size` words joined by a space (a shorter text: of all its words), and where each text's begin."""
    joined, starts, ends = words.joined()
    n = words.per_doc
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    at = np.append(0, np.cumsum(count))
    left = np.arange(at[-1]) - np.repeat(at[:-1] - words.first[:-1], count)
    right = np.minimum(left + size, np.repeat(words.first[1:], count)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[left].tolist(), ends[right].tolist())), np.uint64, len(left))
    return hashes, at


def shingle_keys(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each shingle as above, by rolling sums of word hashes: for sets of shingles, where any hash will do."""
    n = words.per_doc
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    at = np.append(0, np.cumsum(count))
    left = np.arange(at[-1]) - np.repeat(at[:-1] - words.first[:-1], count)
    right = np.minimum(left + size, np.repeat(words.first[1:], count))
    rolling = Rolling(words.hashes()[0], BASES[0])
    return mixed((rolling.sums[right] - rolling.sums[left]) * rolling.inverse[left] ^ (right - left).astype(np.uint64)), at


def majority(hashes: np.ndarray, at: np.ndarray, bits: int = 64) -> np.ndarray:
    """For each run of hashes the number whose bit is set where over half of them have it."""
    out = np.zeros(len(at) - 1, dtype=np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        half = np.diff(at)[full]
        for bit in range(bits):
            ones = np.add.reduceat((hashes >> np.uint64(bit) & np.uint64(1)).astype(np.int32), at[full])
            out[full] |= (2 * ones > half).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id_col, fp): a 64-bit fingerprint of each row's lower-cased text, as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            fp = majority(*shingle_hashes(split_words(batch.column("text"), PLAIN_LOWER), shingle))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def fuzzy_keys(prints: DataFrame, segments: tuple[tuple[int, int], ...]) -> DataFrame:
    """(key, fp): one row for each key of each fingerprint."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("fp").to_numpy()
            for at in range(0, len(every), KEYED_AT_ONCE):
                fp = every[at : at + KEYED_AT_ONCE].view(np.uint64)
                decoded = [golay.keys((fp >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64)) for bits, low in segments]
                for k, chosen in enumerate(combinations(decoded, len(segments) - 1)):
                    key, ok = np.full((len(fp), 1), k, dtype=np.int64), np.ones((len(fp), 1), dtype=bool)
                    for numbers in chosen:
                        key = (key[:, :, None] << 12 | np.maximum(numbers, 0)[:, None, :]).reshape(len(fp), -1)
                        ok = (ok[:, :, None] & (numbers >= 0)[:, None, :]).reshape(len(fp), -1)
                    yield pa.RecordBatch.from_arrays([pa.array(key[ok]), pa.array(fp[np.nonzero(ok)[0]].view(np.int64))], names=["key", "fp"])

    return prints.select("fp").mapInArrow(run, "key long, fp long")


def blocked(rows: DataFrame, by: str, spread: str, most: int, counted: DataFrame | None = None) -> DataFrame:
    """Adds columns i and j: rows of a value of `by` with more than `most` rows are dealt to all pairs of blocks of about half
    as many rows, so that any two rows of the value meet in one pair (i, j) at least.  Values with so many rows are written first:
    Spark then knows their size, and broadcasts them if they are few, without a shuffle of the rows.  counted: the rows' values of `by` from
    a cheaper source, where there is one."""
    hot = written((rows if counted is None else counted).groupBy(by).count().where(F.col("count") > most).select(by, F.ceil(F.col("count") * 2 / most).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64(spread, F.lit(by)), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = F.when(F.col("blocks").isNull(), 0).otherwise(own)
    return rows.join(beside(hot), by, "left").select(*rows.columns, own.alias("own"), other.alias("other")).select(*rows.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of the component of each of n nodes, over edges a - b."""
    least = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        new = new[new]
        if np.array_equal(new, least):
            return least
        least = new


def _links(rows: dict[str, np.ndarray], start: np.ndarray, names: list[str], near) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within each run of rows, from the first row of each linked part; start: of each run, and the end."""
    size = np.diff(start)
    left, right, a_small, b_small = [], [], [], []
    small = np.repeat(size <= 64, size)
    left_in_run = np.repeat(start[1:], size) - np.arange(start[-1]) - 1
    for step in range(1, 64):
        i = np.flatnonzero(small & (left_in_run >= step))
        if not len(i):
            break
        i = i[near({c: rows[c][i] for c in names}, {c: rows[c][i + step] for c in names})]
        a_small.append(i)
        b_small.append(i + step)
    if a_small:
        root = forest(np.concatenate(a_small), np.concatenate(b_small), start[-1])
        member = np.flatnonzero(root != np.arange(start[-1]))
        left.append(root[member])
        right.append(member)
    for k in np.flatnonzero(size > 64):
        at = np.arange(start[k], start[k + 1])
        a, b = [], []
        for i in range(0, len(at), 256):
            part = at[i : i + 256]
            x, y = np.nonzero(near({c: rows[c][part][:, None] for c in names}, {c: rows[c][at][None, :] for c in names}))
            a.append(x + i)
            b.append(y)
        root = forest(np.concatenate(a), np.concatenate(b), len(at))
        member = np.flatnonzero(root != np.arange(len(at)))
        left.append(at[root[member]])
        right.append(at[member])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Forest:
    """A spanning forest of links that come in parts."""

    def __init__(self):
        self.a, self.b, self.size = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.size += len(a)
        if self.size > LINKS_AT_ONCE:
            a, b = self.links()
            self.a, self.b, self.size = [a], [b], 0  # grows again by as many before the next reduction

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(least node, node) of each node that is not the least of its part."""
        if not self.a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        nodes, at = np.unique(np.concatenate([*self.a, *self.b]), return_inverse=True)
        root = forest(at[: len(at) // 2], at[len(at) // 2 :], len(nodes))
        member = np.flatnonzero(root != np.arange(len(nodes)))
        return nodes[root[member]], nodes[member]


def runs(batches: Iterable[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns and the starts of runs of equal values of `by`, and the end, of rows that are sorted by them; runs stay whole."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy() for c in batch.schema.names}
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
        new = np.zeros(len(rows[by[0]]) - 1, dtype=bool)
        for c in by:
            new |= rows[c][1:] != rows[c][:-1]
        change = np.flatnonzero(new) + 1
        if len(change):
            yield {c: v[: change[-1]] for c, v in rows.items()}, np.append(0, change)
            rows = {c: v[change[-1] :] for c, v in rows.items()}
        held = rows
    if held is not None:
        yield held, np.array([0, len(held[by[0]])])


def close_links(prints: DataFrame, distance: int, segments: tuple[tuple[int, int], ...] | None = None) -> DataFrame:
    """(a, b): links that span what is linked by `distance` differing bits or fewer, as far as keys meet: with certainty up to five.
    prints: fp, a signed long, each once."""
    n = prints.count()
    prints = prints.repartition(max(1, -(-n // ITEMS_A_TASK)))
    keyed = blocked(fuzzy_keys(prints, segments or segments_for(n)), "key", "fp", BLOCK)

    def near(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> np.ndarray:
        return np.bitwise_count((x["fp"] ^ y["fp"]).view(np.uint64)) <= distance

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Forest()
        for rows, start in runs(batches, ("key", "i", "j")):
            a, b = _links(rows, start, ["fp"], near)
            found.add(rows["fp"][a], rows["fp"][b])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found.links()], names=["a", "b"])

    # by fingerprint within a key: parts that tasks have in common then get the same links, from their least one
    dealt = keyed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """(id_col, fp, component): each row's 64-bit fingerprint and the least id that is reachable over links between fingerprints
    that differ in `distance` (at most 5) bits or fewer."""
    if not 0 <= distance <= 5:
        raise ValueError("three segments find fingerprints that differ in 5 bits at most")
    prints = written(fingerprints(docs, id_col, text_col, shingle))
    least = F.min(F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id")))
    classes = written(prints.groupBy("fp").agg(least.alias("least")))
    found = components(close_links(classes.select("fp"), distance))
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_print = written(rooted.join(least, "root").select("fp", "component.id"))
    return prints.select(F.col(id_col).alias("own"), "fp").join(beside(by_print), "fp", "left").select(F.col("own").alias(id_col), "fp", F.col("id").alias("component"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


#: Differing bits up to which fingerprints of sets of words put two texts into one cluster.
CLOSE = 12
#: Texts of a cluster that one task compares in full at once, and those of a cluster that are in each of its blocks.
FULL_BLOCK, ANCHORS = 256, 8
#: Cells of the table of shingle frequencies, as a power of two: of a segment, and at most (of two bits each: 128 MB).
SEGMENT_BITS, MOST_BITS = 16, 29
#: Counts from which a cell is of level 1, 2 and 3.
LEVELS = (2, 8, 64)
#: Pairs of two groups that one shingle names in a first round.
FEW_PAIRS = 4
#: Bits of the parity map of a set of shingles, as words of 64.
PARITY = ("p0", "p1", "p2", "p3")


def _distinct_runs(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each run, in order, and where each run's begin."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[new], np.append(0, np.cumsum(np.bincount(doc[new], minlength=len(at) - 1)))


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, page, s1, s2, size, fp): a hash of the text, two hashes of its set of shingles, the set's size, and a fingerprint of its set of words.

    Few changed words change many shingles but few words, so the fingerprint is taken over words; what is close there
    is compared by shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = split_words(batch.column("text"), PLAIN_LOWER)
            hashes, at = _distinct_runs(*shingle_keys(words, shingle))
            size = np.diff(at)
            full = np.flatnonzero(size)
            sums = np.zeros((2, batch.num_rows), dtype=np.uint64)
            if len(full):
                sums[0, full] = np.add.reduceat(hashes, at[full])
                sums[1, full] = np.add.reduceat(hashes * (hashes | np.uint64(1)), at[full])
            prints = majority(*_distinct_runs(words.hashes()[0], words.first))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("page"), *(pa.array(s.view(np.int64)) for s in sums), pa.array(size.astype(np.int64)), pa.array(prints.view(np.int64))], names=["id", "page", "s1", "s2", "size", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text_col).mapInArrow(run, f"id {kind}, page long, s1 long, s2 long, size long, fp long")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("page"), text.alias("text"))


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """texts with the column text replaced by the sorted hashes of its different shingles."""
    kept = [c for c in texts.columns if c != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes, at = _distinct_runs(*shingle_keys(split_words(batch.column("text"), PLAIN_LOWER), shingle))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists], names=[*kept, "shingles"])

    return texts.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", shingles array<long>")


def _similar(group: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sorted sets whose Jaccard similarity is at least `similarity`."""
    size = np.array([len(g) for g in group])
    owner = np.repeat(np.arange(len(group)), size)
    values, column = np.unique(np.concatenate(group), return_inverse=True)
    common = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(common) - 1
    keep = common[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(group), len(group)), dtype=np.float64)
    step = 16_384
    for low in range(0, int(common.sum()), step):
        a, b = np.searchsorted(column, [low, low + step])
        has = np.zeros((len(group), step), dtype=np.float32)
        has[owner[a:b], column[a:b] - low] = 1
        both += has @ has.T
    union = size[:, None] + size[None, :] - both
    x, y = np.nonzero(np.triu(both >= similarity * union - 1e-9, 1))
    return x, y


def frequency_levels(texts: DataFrame, shingle: int, bits: int) -> bytes:
    """Two bits for each of 2 ** bits cells: the level of the number of texts with a shingle of that cell, by `LEVELS`; never too low."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen: list[np.ndarray]) -> pa.RecordBatch:
            cells = np.sort(np.concatenate(seen))
            segments = cells >> np.uint32(SEGMENT_BITS)
            start = np.flatnonzero(np.append(True, segments[1:] != segments[:-1]))
            at = np.append(start, len(cells)).astype(np.int32) * 2
            inside = cells.astype(np.uint16).tobytes()
            lists = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(inside)])
            return pa.RecordBatch.from_arrays([pa.array(segments[start].astype(np.int32)), lists], names=["segment", "cells"])

        seen, size = [], 0
        for batch in chunks(batches):
            hashes, _ = _distinct_runs(*shingle_keys(split_words(batch.column("text"), PLAIN_LOWER), shingle))
            if len(hashes):
                seen.append((hashes & np.uint64((1 << bits) - 1)).astype(np.uint32))
                size += len(hashes)
            if size > 2_000_000:
                yield out(seen)
                seen, size = [], 0
        if seen:
            yield out(seen)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, None

        def done() -> pa.RecordBatch:
            level = np.searchsorted(LEVELS, counts, side="right").astype(np.uint8).reshape(-1, 4)
            packed = level[:, 0] | level[:, 1] << 2 | level[:, 2] << 4 | level[:, 3] << 6
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([packed.tobytes()], pa.binary())], names=["segment", "levels"])

        for batch in batches:
            for segment, cells in zip(batch.column("segment").to_pylist(), batch.column("cells")):
                if segment != now:
                    if now is not None:
                        yield done()
                    now, counts = segment, np.zeros(1 << SEGMENT_BITS, dtype=np.int64)
                counts += np.bincount(np.frombuffer(cells.as_buffer(), np.uint16), minlength=1 << SEGMENT_BITS)
        if now is not None:
            yield done()

    counted = texts.select("text").mapInArrow(count, "segment int, cells binary").repartition("segment").sortWithinPartitions("segment")
    levels = np.zeros(1 << bits >> 2, dtype=np.uint8)
    size = 1 << SEGMENT_BITS >> 2
    # of fixed size, whatever the input: at most 2 ** (bits - SEGMENT_BITS) rows
    for segment, found in counted.mapInArrow(merge, "segment int, levels binary").toLocalIterator():
        levels[segment * size : (segment + 1) * size] = np.frombuffer(found, np.uint8)
    return levels.tobytes()


def _candidates(rows: dict[str, np.ndarray], start: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a run that are of different groups and can be similar by sizes, places and parities."""
    share = similarity / (1 + similarity)

    def able(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = rows["size"][i], rows["size"][j]
        ok = (rows["root"][i] != rows["root"][j]) & (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9)
        # of what two sets share, nothing stands before the first shingle that they share
        ok &= np.minimum(a - rows["place"][i], b - rows["place"][j]) >= share * (a + b) - 1e-9
        # a bit of the parities differs only where a shingle is in one set alone
        differ = sum(np.bitwise_count((rows[c][i] ^ rows[c][j]).view(np.uint64)).astype(np.int32) for c in PARITY)
        return ok & (differ <= (1 - 2 * share) * (a + b) + 1e-9)

    size = np.diff(start)
    small = np.repeat(size <= 64, size)
    left_in_run = np.repeat(start[1:], size) - np.arange(start[-1]) - 1
    for step in range(1, 64):
        i = np.flatnonzero(small & (left_in_run >= step))
        if not len(i):
            break
        i = i[able(i, i + step)]
        yield i, i + step
    for k in np.flatnonzero(size > 64):
        at = np.arange(start[k], start[k + 1])
        for i in range(0, len(at), 256):
            x, y = np.nonzero(able(at[i : i + 256][:, None], at[i:][None, :]))
            yield at[x + i], at[y + i]


def missed_links(texts: DataFrame, groups: DataFrame, shingles: int, shingle: int, similarity: float) -> DataFrame:
    """(a, b): all pairs of texts of different groups whose sets of shingles have a Jaccard similarity of `similarity` or more.

    In any order of all shingles two such sets share one of their first n - ceil(similarity * n) + 1.  The order is from rare to
    frequent by `frequency_levels`; a shingle of one text alone is shared by none, so most texts have no rows.  Rows of a
    shingle are paired where sizes, places and parities allow, and the pairs are compared in full: in a first round a few of each two groups, in a second
    all of groups that are still apart.  texts: (node, text); groups: (node, root), nodes without a row being groups of their own; shingles: about how many there are."""
    bits = min(max(int(shingles).bit_length(), SEGMENT_BITS), MOST_BITS)
    shared = texts.sparkSession.sparkContext.broadcast(frequency_levels(texts, shingle, bits))

    def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(shared.value, np.uint8)
        for batch in chunks(batches):
            hashes, at = _distinct_runs(*shingle_keys(split_words(batch.column("text"), PLAIN_LOWER), shingle))
            size = np.diff(at)
            doc = np.repeat(np.arange(len(size)), size)
            parity = np.bincount(doc * 256 + (hashes >> np.uint64(56)).astype(np.int64), minlength=len(size) * 256).reshape(-1, 256) & 1
            parity = np.packbits(parity.astype(np.uint8), axis=1).view(np.int64)
            cell = hashes & np.uint64((1 << bits) - 1)
            level = levels[cell >> np.uint64(2)] >> (cell.astype(np.uint8) & 3) * 2 & 3
            order = np.lexsort((hashes, level, doc))
            place = np.arange(len(doc)) - np.repeat(at[:-1], size)
            most = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
            k = np.flatnonzero((place < np.repeat(most, size)) & (level[order] > 0))
            of = doc[k]
            columns = [hashes[order[k]].view(np.int64), size[of].astype(np.int32), place[k].astype(np.int32), *(parity[of, c] for c in range(len(PARITY)))]
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(of)), *map(pa.array, columns)], names=["node", "key", "size", "place", *PARITY])

    def pairs(most: int | None):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, start in runs(batches, ("key", "i", "j")):
                for i, j in _candidates(rows, start, similarity):
                    if most is not None:
                        k = _few_of_each(rows["root"][i], rows["root"][j], rows["node"][i] ^ rows["node"][j], most)
                        i, j = i[k], j[k]
                    a, b = rows["node"][i], rows["node"][j]
                    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        return run

    fields = ", ".join(f"{c} long" for c in PARITY)
    prefix_rows = written(texts.mapInArrow(prefixes, f"node long, key long, size int, place int, {fields}"))
    shared.destroy()

    def between(groups: DataFrame, most: int | None) -> DataFrame:
        rows = written(prefix_rows.join(beside(groups), "node", "left").withColumn("root", F.coalesce("root", "node")))
        # a shingle within one group has no pairs
        several = written(rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key"))
        dealt = blocked(rows.join(beside(several), "key"), "key", "node", BLOCK).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
        able = written(dealt.mapInArrow(pairs(most), "a long, b long").distinct())
        named = written(able.select(F.col("a").alias("node")).unionByName(able.select(F.col("b").alias("node"))).distinct())
        full = written(shingle_sets(texts.join(beside(named), "node", "left_semi"), shingle))
        left, right = (full.select(F.col("node").alias(c), F.col("shingles").alias(v)) for c, v in (("a", "x"), ("b", "y")))
        both = F.size(F.array_intersect("x", "y"))
        links = able.join(left, "a").join(right, "b").where(both >= similarity * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b")
        links = written(links)
        dropped(rows, several, able, named, full)
        return links

    # large groups are joined by a few of their pairs first; of what is then still apart, all pairs are compared
    first = between(groups, FEW_PAIRS)
    joined = components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(first))
    return first.unionByName(between(joined, None))


def _few_of_each(one: np.ndarray, other: np.ndarray, mark: np.ndarray, most: int) -> np.ndarray:
    """Some of the pairs of each two groups, up to `most`, of different members."""
    low, high = np.minimum(one, other), np.maximum(one, other)
    order = np.lexsort((mixed(mark.view(np.uint64)), high, low))
    low, high = low[order], high[order]
    start = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return np.sort(order[rank < most])


def cluster_links(texts: DataFrame, clusters: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): spanning links between texts of a cluster that are similar in full.  A large cluster is dealt out in blocks, which its first
    `ANCHORS` texts are all in, so that blocks of similar texts are linked; similar texts that are not linked here are left to missed_links.
    texts: (node, text); clusters: (node, root)."""
    sizes = written(clusters.groupBy("root").count().where(F.col("count") > FULL_BLOCK).select("root", F.ceil(F.col("count") / FULL_BLOCK).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    anchor = F.pmod(F.xxhash64("node", F.lit("anchor")), F.ceil(F.col("blocks") * FULL_BLOCK / ANCHORS)) == 0
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    block = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).when(anchor, every).otherwise(F.array(own)))
    named = texts.join(beside(clusters), "node").join(beside(sizes), "root", "left")
    dealt = shingle_sets(named.select("root", "node", "blocks", "text"), shingle)

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_numpy()
        a, b = _similar([x.values.to_numpy() for x in group.column("shingles").combine_chunks()], similarity)
        root = forest(a, b, len(nodes))
        member = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table({"a": nodes[root[member]], "b": nodes[member]})

    return dealt.select("root", "node", "shingles", block.alias("block")).groupBy("root", "block").applyInArrow(compare, "a long, b long")


def _class_texts(docs: DataFrame, id_col: str, text_col: str, marks: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, text): the text of each class, which is that of its first row, once."""
    keys = written(classes.select("node", F.col("first.id").alias("i"), F.col("first.page").alias("p")))
    same = lambda x: x["id"].eqNullSafe(keys["i"]) & (x["page"] == keys["p"])
    rows = _texts(docs, id_col, text_col)
    texts = rows.join(beside(keys), same(rows)).select("node", "text")
    again = marks.groupBy("id", "page").agg(F.count("*").alias("rows")).where("rows > 1")
    again = written(again.join(keys, same(again)).select("node"))
    if not again.isEmpty():
        texts = texts.join(beside(again), "node", "left_anti").unionByName(texts.join(beside(again), "node", "left_semi").dropDuplicates(["node"]))
    # what was joined by a shuffle is used more than once
    return texts if keys.count() <= FEW_ROWS and again.isEmpty() else written(texts)


@settled
def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id_col, page, least, least_page, rows): for each distinct id and text (page: its xxhash64) the least id, and that one's text, that is reachable
    over pairs of texts whose sets of shingles have a Jaccard similarity of `similarity` or more; and how many rows have that id and text.

    Texts of equal sets are one class.  Classes with close fingerprints (found by Golay keys) form clusters; a cluster's texts
    are compared in full, and the links that hold are joined to groups.
    The keys find such a pair with high probability, not with certainty; what they miss between groups, `missed_links` finds,
    so the result is exact."""
    marks = written(sketches(docs, id_col, text_col, shingle))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "page"))
    classes = written(marks.groupBy("s1", "s2", "size").agg(first.alias("first"), F.min("fp").alias("fp")).withColumn("node", F.monotonically_increasing_id()))
    close = components(close_links(classes.select("fp").distinct(), CLOSE))
    close = close.unionByName(close.select(F.col("root").alias("node"), "root").distinct())
    own = classes.select("node", "fp")
    many = own.groupBy("fp").count().where("count > 1").select("fp", F.col("fp").alias("root"))
    roots = written(close.withColumnRenamed("node", "fp").unionByName(many).groupBy("fp").agg(F.min("root").alias("root")))
    clusters = written(own.join(beside(roots), "fp").select("node", "root"))
    texts = _class_texts(docs, id_col, text_col, marks, classes)
    groups = components(cluster_links(texts, clusters, shingle, similarity))
    shingles = classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    missed = missed_links(texts, groups, shingles, shingle, similarity)
    groups = components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(missed))
    rooted = written(classes.select("s1", "s2", "size", "first", "node").join(beside(groups), "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = written(rooted.groupBy("root").agg(F.min("first").alias("least")))
    by_class = written(rooted.join(beside(least), "root").select("s1", "s2", "size", "least"))
    found = marks.join(beside(by_class), ["s1", "s2", "size"]).groupBy("id", "page", "least").agg(F.count("*").alias("rows"))
    return found.select(F.col("id").alias(id_col), "page", F.col("least.id").alias("least"), F.col("least.page").alias("least_page"), "rows")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that have the least id of their group of similar texts, as they are; one of those with one id and one text."""
    found = similar_texts(docs, id_col, text_col, shingle, similarity)
    first = F.col(id_col).eqNullSafe(F.col("least")) & (F.col("page") == F.col("least_page"))
    gone = written(found.where(~first).select(id_col, "page"))
    again = written(found.where(first & (F.col("rows") > 1)).select(id_col, "page"))
    dropped(found)
    keys = [F.col(id_col), F.xxhash64(F.col(text_col).cast("string"))]
    kept = without(docs, gone, keys)
    if again.isEmpty():
        return kept
    page = unused(docs.columns, "page")
    once = again.toDF(unused(docs.columns, "again_id"), unused(docs.columns, "again_page"))
    same = keys[0].eqNullSafe(once[once.columns[0]]) & (keys[1] == once[once.columns[1]])
    copies = kept.join(beside(once), same, "left_semi").withColumn(page, keys[1]).dropDuplicates([id_col, page]).select(*(F.col(f"`{c}`") for c in docs.columns))
    return without(kept, again, keys).unionByName(copies)
