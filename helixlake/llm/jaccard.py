"""Similarity join of shingle sets: size-banded tiles with hashed bitmap signatures, then exact intersection of sorted arrays.

Texts with equal sets are one class, and a class is compared once.  Two sets of similarity s share one of their first n - ceil(s * n) + 1 shingles in any common order; the
order is from rare to frequent (by a count-min table that holds all texts), and a shingle of one class alone is dropped.  What is left is dealt
out in tiles: by shingle and by size band, a doubling of the set's size; a set that may match smaller ones is a guest of the band below.
Within a tile a pair must pass the ratio of sizes, the places of the shingle in both orders, and the signatures: a bit for each hash value, the parity of the set's
shingles that have it, as many bits as the band has shingles (64 to `MOST_SIGNED`).  A bit differs only where a shingle is in one set alone, so the number of differing bits bounds
the overlap from above.  What passes is intersected in full.

Pairs of one component need no look, so large groups are joined first: by stars around the least class of each of `STARS` min-hashes, then by each row's `PARTNERS` most
promising partners in its tile, and then all pairs that are still apart.  A tile of many rows, most of them in one component by then, is dealt out in blocks of that component's
rows, each beside the others: its rows are not paired with each other.

Cases: null and empty texts (or texts of blanks) have the empty set, link with nothing, and are their own component; a text of fewer words than a shingle has one shingle, the whole sequence;
repeated rows give repeated results; ids are of any type that has an order, and null ids come last in it; empty tables give empty results; other columns of the input are not
touched, whatever their names.  Shingles are told apart by 64 bits of hash, sets by 128.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .simhash import MOST_BITS, SEGMENT_BITS, _class_texts, _distinct_runs, _texts, frequency_levels, runs, shingle_keys, shingle_sets
from .tables import beside, dropped, settled, table, written
from .words import PLAIN_LOWER, chunks, mixed, split_words

SHINGLE, SIMILARITY = 4, 0.85
#: Bits of a signature, at most, and at least; words of 64 bits that hold it.
MOST_SIGNED, LEAST_SIGNED = 1024, 64
WORDS = MOST_SIGNED // 64
#: Rows of a tile that one task compares at once.
TILE_ROWS = 2048
STARS, PARTNERS = 2, 4
#: Pairs whose signatures are compared at once.
PAIRS_AT_ONCE = 1 << 18


def marks_of(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, page, s1, s2, size): a hash of the text, two hashes of its set of shingles, and the set's size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes, at = _distinct_runs(*shingle_keys(split_words(batch.column("text"), PLAIN_LOWER), shingle))
            full = np.flatnonzero(np.diff(at))
            sums = np.zeros((2, batch.num_rows), dtype=np.uint64)
            if len(full):
                sums[0, full] = np.add.reduceat(hashes, at[full])
                sums[1, full] = np.add.reduceat(hashes * (hashes | np.uint64(1)), at[full])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("page"), *(pa.array(s.view(np.int64)) for s in sums), pa.array(np.diff(at).astype(np.int64))], names=["id", "page", "s1", "s2", "size"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text_col).mapInArrow(run, f"id {kind}, page long, s1 long, s2 long, size long")


def prefixes(texts: DataFrame, levels, bits: int, shingle: int, similarity: float) -> DataFrame:
    """(node, key, size, place): the shingles of each set's prefix that another set may have."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(levels.value, np.uint8)
        for batch in chunks(batches):
            hashes, at = _distinct_runs(*shingle_keys(split_words(batch.column("text"), PLAIN_LOWER), shingle))
            size = np.diff(at)
            doc = np.repeat(np.arange(len(size)), size)
            cell = hashes & np.uint64((1 << bits) - 1)
            level = table[cell >> np.uint64(2)] >> (cell.astype(np.uint8) & 3) * 2 & 3
            order = np.lexsort((hashes, level, doc))
            place = np.arange(len(doc)) - np.repeat(at[:-1], size)
            most = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
            k = np.flatnonzero((place < np.repeat(most, size)) & (level[order] > 0))
            of = doc[k]
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(of)), pa.array(hashes[order[k]].view(np.int64)), pa.array(size[of].astype(np.int32)), pa.array(place[k].astype(np.int32))], names=["node", "key", "size", "place"])

    return texts.mapInArrow(run, "node long, key long, size int, place int")


def width_of(size: np.ndarray) -> np.ndarray:
    """Bits of the signature of sets of that many shingles: of the least power of two that is greater."""
    return np.clip(1 << np.frexp(size.astype(np.float64))[1].astype(np.int64), LEAST_SIGNED, MOST_SIGNED)


def _signature_rows(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The signature of each run of hashes, in the first words of a row of WORDS."""
    size = np.diff(at)
    doc = np.repeat(np.arange(len(size)), size)
    bit = (hashes >> np.uint64(40)).astype(np.int64) & np.repeat(width_of(size), size) - 1
    odd = np.bincount(doc * MOST_SIGNED + bit, minlength=len(size) * MOST_SIGNED).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(size), MOST_SIGNED), axis=1, bitorder="little").view(np.uint64)


def folded(signature: np.ndarray, width: int) -> np.ndarray:
    """Signatures of twice as many bits as signatures of `width` bits."""
    half = width // 64
    out = np.zeros_like(signature)
    out[:, :half] = signature[:, :half] ^ signature[:, half : 2 * half]
    return out


def signatures(sets: DataFrame) -> DataFrame:
    """(node, size, m0, m1, signature) of sets (node, shingles): their size, min-hashes, and signature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                lists = part.column("shingles")
                at = np.append(0, np.cumsum(lists.value_lengths().to_numpy())).astype(np.int64)
                hashes = lists.flatten().to_numpy().view(np.uint64)
                least = [np.minimum.reduceat(mixed(hashes ^ np.uint64(k + 1)), at[:-1]).view(np.int64) for k in range(STARS)]
                signed = _signature_rows(hashes, at)
                raw = pa.Array.from_buffers(pa.binary(8 * WORDS), len(signed), [None, pa.py_buffer(np.ascontiguousarray(signed).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(np.diff(at).astype(np.int32)), *(pa.array(m) for m in least), raw], names=["node", "size", *(f"m{k}" for k in range(STARS)), "signature"])

    return sets.mapInArrow(run, f"node long, size int, {', '.join(f'm{k} long' for k in range(STARS))}, signature binary")


def intersect_size(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted arrays of different values have in common."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum()) if len(large) else 0


def linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar in full, written."""
    hundredths = round(similarity * 10_000)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # sets are sorted as unsigned numbers
            left, right = ((c.values.to_numpy().view(np.uint64), c.offsets.to_numpy()) for c in (batch.column("x"), batch.column("y")))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k in range(batch.num_rows):
                x, y = (v[at[k] : at[k + 1]] for v, at in (left, right))
                both = intersect_size(x, y)
                keep[k] = 10_000 * both >= hundredths * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    x, y = (sets.select(F.col("node").alias(c), F.col("shingles").alias(v), F.size("shingles").alias(f"n_{c}")) for c, v in (("a", "x"), ("b", "y")))
    able = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9
    return written(pairs.join(x, "a").join(y, "b").where(able).select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def stars(signed: DataFrame) -> DataFrame:
    """(a, b): each set with the least set that has its min-hash, for each of the min-hashes."""
    out = None
    for k in range(STARS):
        centre = written(signed.groupBy(F.col(f"m{k}").alias("m")).agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("m", "a"))
        pairs = signed.select(F.col(f"m{k}").alias("m"), F.col("node").alias("b")).join(beside(centre), "m").where("a <> b").select("a", "b")
        out = pairs if out is None else out.unionByName(pairs)
    return written(out.distinct())


def tiles(rows: DataFrame, similarity: float) -> DataFrame:
    """rows with their tile's band, and whether they are guests there: of the band below their own, where they may match its sets."""
    own = F.floor(F.log2(F.col("size").cast("double")) + 1e-9).cast("int")
    may = (F.col("own") > 0) & (F.col("size") * similarity < F.pow(F.lit(2.0), F.col("own")))
    bands = F.when(may, F.array(F.col("own"), F.col("own") - 1)).otherwise(F.array("own"))
    return rows.withColumn("own", own).withColumn("band", F.explode(bands)).withColumn("guest", F.col("band") < F.col("own")).drop("own")


def dealt(rows: DataFrame, most: int) -> DataFrame:
    """rows (key, band, root, node and others) with a column part.  Tiles of more than `most` rows are dealt out: the rows of the tile's largest component in
    blocks, those of others in blocks of their own; a part is a block of either kind, or two blocks of others."""
    hot = written(rows.groupBy("key", "band").count().where(F.col("count") > most).select("key", "band", "count"))
    by_root = rows.join(beside(hot.select("key", "band")), ["key", "band"], "left_semi").groupBy("key", "band", "root").count()
    main = by_root.groupBy("key", "band").agg(F.max(F.struct("count", "root")).alias("top"))
    plan = hot.join(main, ["key", "band"]).select("key", "band", F.col("top.root").alias("main"), F.ceil(F.col("top.count") * 2 / most).cast("int").alias("blocks"), F.greatest(F.ceil((F.col("count") - F.col("top.count")) * 2 / most), F.lit(1)).cast("int").alias("others"))
    plan = written(plan)
    named = rows.join(beside(plan), ["key", "band"], "left")
    spread = F.xxhash64("node", "key")
    block, other = F.pmod(spread, F.col("blocks")).cast("int"), F.pmod(spread, F.col("others")).cast("int")
    part = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    zero = F.lit(0)
    of_main = F.transform(F.sequence(zero, F.col("others") - 1), lambda j: part(0, block, j))
    beside_main = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda i: part(0, i, other))
    among = F.when(F.col("others") > 1, F.transform(F.sequence(zero, F.col("others") - 1), lambda j: part(1, F.least(other, j), F.greatest(other, j)))).otherwise(F.array().cast("array<struct<kind:int,i:int,j:int>>"))
    parts = F.when(F.col("main").isNull(), F.array(part(0, zero, zero))).when(F.col("root") == F.col("main"), of_main).otherwise(F.concat(beside_main, among))
    return named.select(*rows.columns, F.explode(parts).alias("part"))


def _able(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of rows that can be similar, and how much overlap their signatures allow beyond what is asked."""
    share = similarity / (1 + similarity)
    a, b = rows["size"][i], rows["size"][j]
    ok = (rows["root"][i] != rows["root"][j]) & ~(rows["guest"][i] & rows["guest"][j]) & (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9)
    # of what two sets share, nothing stands before the first shingle that they share
    ok &= np.minimum(a - rows["place"][i], b - rows["place"][j]) >= share * (a + b) - 1e-9
    i, j, a, b = i[ok], j[ok], a[ok], b[ok]
    differ = np.zeros(len(i), np.int64)
    for low in range(0, len(i), PAIRS_AT_ONCE):
        own = slice(low, low + PAIRS_AT_ONCE)
        differ[own] = np.bitwise_count(rows["signature"][i[own]] ^ rows["signature"][j[own]]).sum(axis=1)
    room = (a + b - differ) / 2 - share * (a + b)
    ok = room >= -1e-9
    return i[ok], j[ok], room[ok]


def _promising(i: np.ndarray, j: np.ndarray, room: np.ndarray, most: int) -> np.ndarray:
    """The pairs that are among the `most` of the greatest room of one of their rows."""
    keep = np.zeros(len(i), dtype=bool)
    for one in (i, j):
        order = np.lexsort((-room, one))
        start = np.flatnonzero(np.append(True, one[order][1:] != one[order][:-1])) if len(order) else np.zeros(0, np.int64)
        rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        keep[order[rank < most]] = True
    return np.flatnonzero(keep)


def _pairs(rows: dict[str, np.ndarray], start: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of each run that can be similar."""
    size = np.diff(start)
    small = np.repeat(size <= 64, size)
    left = np.repeat(start[1:], size) - np.arange(start[-1]) - 1
    for step in range(1, 64):
        i = np.flatnonzero(small & (left >= step))
        if not len(i):
            break
        yield _able(rows, i, i + step, similarity)
    for k in np.flatnonzero(size > 64):
        # rows are sorted by size: a row's partners end where sets are too large
        own = rows["size"][start[k] : start[k + 1]]
        ends = start[k] + np.searchsorted(own, own / similarity + 1e-6, side="right")
        for low in range(start[k], start[k + 1], 256):
            at = np.arange(low, min(low + 256, start[k + 1]))
            many = ends[at - start[k]] - at - 1
            i = np.repeat(at, many)
            j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + i + 1
            yield _able(rows, i, j, similarity)


def compared(parts: DataFrame, similarity: float, most: int | None) -> DataFrame:
    """(a, b): pairs of different components that may be similar, of a part of a tile; most: of each row, those of the most promising partners only."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            both = np.unique(np.concatenate(found), axis=0)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        def plain() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                numbers = np.arange(batch.num_rows, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(numbers), batch.column("signature")], names=[*kept, "number", "signature"])

        for rows, start in _runs(plain()):
            ways = list(_pairs(rows, start, similarity))
            if not ways:
                continue
            i, j, room = (np.concatenate(x) for x in zip(*ways))
            if most is not None:
                k = _promising(i, j, room, most)
                i, j = i[k], j[k]
            a, b = rows["node"][i], rows["node"][j]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
            if sum(map(len, found)) > PAIRS_AT_ONCE:
                yield out()
        if found:
            yield out()

    kept = ["key", "band", "kind", "i", "j", "node", "root", "size", "place", "guest"]
    flat = parts.select("key", "band", "part.kind", "part.i", "part.j", "node", "root", "size", "place", "guest", "signature")
    order = ["key", "band", "kind", "i", "j"]
    return written(flat.repartition(*order).sortWithinPartitions(*order, "size", "node").mapInArrow(run, "a long, b long").distinct())


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns and starts of whole tiles; signatures are folded to the band's width where they are a guest's."""

    def numeric(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint64).reshape(-1, WORDS)
        columns = [batch.column(c).cast(pa.int64()) for c in batch.schema.names if c != "signature"]
        names = [c for c in batch.schema.names if c != "signature"]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(raw[:, w].view(np.int64)) for w in range(WORDS))], names=[*names, *(f"w{w}" for w in range(WORDS))])

    for rows, start in runs((numeric(b) for b in batches if b.num_rows), ("key", "band", "kind", "i", "j")):
        signature = np.stack([rows.pop(f"w{w}").view(np.uint64) for w in range(WORDS)], axis=1)
        guest = rows["guest"].astype(bool)
        own, below = width_of(rows["size"]), np.clip(1 << (rows["band"] + 1), LEAST_SIGNED, MOST_SIGNED)
        for width in np.unique(below[guest & (own > below)]):
            at = np.flatnonzero(guest & (own > below) & (below == width))
            signature[at] = folded(signature[at], int(width))
        yield rows | {"guest": guest, "signature": signature}, start


@settled
def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(id_col, n_shingles, component) of each row: its set's size, and the least id that it reaches over pairs of sets with a Jaccard similarity of `similarity` (at least a half) or more."""
    if not 0.5 <= similarity <= 1:
        raise ValueError("a guest of the band below its own meets all sets of half its size and more, no smaller ones")
    marks = written(marks_of(docs, id_col, text_col, shingle))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "page"))
    classes = written(marks.where("size > 0").groupBy("s1", "s2", "size").agg(first.alias("first")).withColumn("node", F.monotonically_increasing_id()))
    groups = _groups(docs, id_col, text_col, marks, classes, shingle, similarity, tile_rows)
    rooted = written(classes.join(beside(groups), "node", "left").withColumn("root", F.coalesce("root", "node")).select("s1", "s2", "size", "first", "root"))
    least = written(rooted.groupBy("root").agg(F.min("first").alias("least")))
    by_class = written(rooted.join(beside(least), "root").select("s1", "s2", "size", F.col("least.id").alias("component")))
    found = marks.join(beside(by_class), ["s1", "s2", "size"], "left")
    component = F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("component"))
    return found.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component"))


def _groups(docs: DataFrame, id_col: str, text_col: str, marks: DataFrame, classes: DataFrame, shingle: int, similarity: float, tile_rows: int) -> DataFrame:
    """(node, root) of the classes that are linked with others."""
    texts = _class_texts(docs, id_col, text_col, marks, classes)
    total = classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bits = min(max(int(total).bit_length(), SEGMENT_BITS), MOST_BITS)
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(texts, shingle, bits))
    every = written(tiles(prefixes(texts, levels, bits, shingle, similarity), similarity))
    levels.destroy()
    several = written(every.groupBy("key", "band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min("guest").alias("all_guests")).where("low <> high AND NOT all_guests").select("key", "band"))
    rows = written(every.join(beside(several), ["key", "band"], "left_semi"))
    named = written(rows.select("node").distinct())
    sets = written(shingle_sets(texts.join(beside(named), "node", "left_semi"), shingle))
    signed = written(signatures(sets))
    dropped(every, several, named)
    links = linked(stars(signed), sets, similarity)
    groups = written(components(links))
    for most in (PARTNERS, None):
        now = rows.join(beside(groups), "node", "left").withColumn("root", F.coalesce("root", "node"))
        now = written(now)
        apart = written(now.groupBy("key", "band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", "band"))
        open_rows = written(now.join(beside(apart), ["key", "band"], "left_semi"))
        signatures_of = signed.select("node", "signature")
        pairs = compared(dealt(open_rows, tile_rows).join(signatures_of, "node"), similarity, most)
        more = linked(pairs, sets, similarity)
        dropped(now, apart, open_rows, pairs)
        groups = written(components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))
    return groups


def op12_similar_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents")).withColumnRenamed("component", "component_id")
