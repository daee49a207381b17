"""Consensus of strands from alignments in PAF, and its comparison with k-mer quality control."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import unused

BASES = "ACGT"
#: Signs of the tokens of a cs tag: `:n` matches, `*xy` a substitution, `-seq` a deletion, `+seq` an insertion, `~xxnyy` an intron.
SIGNS = b":*-+~"
SECONDARY, LOW_QUALITY, UNKNOWN_TARGET, USED = "secondary", "low_quality", "unknown_target", "used"


def identity(matches: Column, length: Column) -> Column:
    return F.when(length > 0, matches / length).otherwise(F.lit(0.0))


def quality_buckets(alignments: DataFrame, strands: DataFrame, min_mapq: int = 0, min_identity: float = 0.0) -> DataFrame:
    """alignments with bucket: secondary, low_quality (mapping quality, identity or a missing cs tag), unknown_target, or used.

    alignments: target, target_start, matches, block_length, mapq, tags (map by two letters); strands: name."""
    known = unused(alignments.columns, "known")
    names = strands.select(F.col("name").alias("target"), F.lit(True).alias(known)).distinct()
    low = (F.col("mapq") < min_mapq) | (identity(F.col("matches"), F.col("block_length")) < min_identity) | F.col("tags")["cs"].isNull()
    bucket = F.when(F.coalesce(F.col("tags")["tp"], F.lit("")) != "P", SECONDARY).when(low, LOW_QUALITY).when(F.col(known).isNull(), UNKNOWN_TARGET).otherwise(USED)
    return alignments.join(names, "target", "left").withColumn("bucket", bucket).drop(known)


def bucket_totals(buckets: DataFrame) -> DataFrame:
    """One row of alignment totals."""
    of = lambda b: F.count_if(F.col("bucket") == b).alias(b)
    return buckets.agg(F.count("*").alias("total"), F.count_if(F.col("bucket") != SECONDARY).alias("primary"), of(SECONDARY), of(LOW_QUALITY), of(UNKNOWN_TARGET), of(USED))


@dataclass
class Tokens:
    """The tokens of some cs tags: which tag each is of, its number in that, its sign, its text's place in data, and the target bases it takes and
    those before it."""

    data: np.ndarray
    row: np.ndarray
    n: np.ndarray
    sign: np.ndarray
    start: np.ndarray
    end: np.ndarray
    length: np.ndarray
    offset: np.ndarray


def _run(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags in a row hold from each place on."""
    stops = np.append(np.flatnonzero(~flags), len(flags))
    return stops[np.searchsorted(stops, at)] - at


def _number(data: np.ndarray, start: np.ndarray, digits: np.ndarray) -> np.ndarray:
    value = np.zeros(len(start), dtype=np.int64)
    for k in range(int(digits.max(initial=0))):
        more = digits > k
        value[more] = value[more] * 10 + data[start[more] + k] - 48
    return value


def tokens_of(tags: pa.Array) -> Tokens:
    """All tokens of cs tags at once; what is no whole token is passed over, nulls have none."""
    tags = tags.cast(pa.large_string()).fill_null("")
    _, at, data = tags.buffers()
    at = np.frombuffer(at, np.int64)[tags.offset : tags.offset + len(tags) + 1]
    data = np.append(np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), np.zeros(8, np.uint8))
    at = at - at[0]
    digit = (data >= 48) & (data <= 57)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    place = np.flatnonzero(np.isin(data, np.frombuffer(SIGNS, np.uint8)))
    row = np.searchsorted(at, place, side="right") - 1
    room = at[row + 1] - place - 1
    sign = data[place]
    digits, letters = np.minimum(_run(digit, place + 1), room), np.minimum(_run(letter, place + 1), room)
    size = np.select([sign == 58, sign == 42, (sign == 45) | (sign == 43)], [digits, np.where(letters >= 2, 2, 0), letters], 0)
    length = np.select([sign == 58, sign == 42, sign == 45], [_number(data, place + 1, np.where(sign == 58, digits, 0)), 1, letters], 0)
    for k in np.flatnonzero((sign == 126) & (letters == 2)):  # introns, which strands hardly have
        count = min(int(_run(digit, place[k : k + 1] + 3)[0]), room[k] - 2)
        if count > 0 and min(int(_run(letter, place[k : k + 1] + 3 + count)[0]), room[k] - 2 - count) >= 2:
            size[k], length[k] = count + 4, int(data[place[k] + 3 : place[k] + 3 + count].tobytes())
    whole = np.flatnonzero(size > 0)
    place, row, sign, size, length = place[whole], row[whole], sign[whole], size[whole], length[whole]
    first = np.searchsorted(row, np.arange(len(tags)))
    before = np.append(0, np.cumsum(length))
    return Tokens(data, row, np.arange(len(row)) - first[row], sign, place + 1, place + 1 + size, length, before[:-1] - before[first[row]])


def parse_cs(alignments: DataFrame, key: list[str]) -> DataFrame:
    """(*key, target_start, n, op, text, length, offset): the tokens of each cs tag, with the target bases each takes and those before it.
    op is the token's sign.  alignments: *key, target_start, cs.  Tags are parsed in Arrow batches, and no row moves."""
    kept = [*key, "target_start"]
    kinds = {f.name: f.dataType.simpleString() for f in alignments.schema}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = tokens_of(batch.column("cs"))
            size = t.end - t.start
            at = np.append(0, np.cumsum(size))
            text = t.data[np.repeat(t.start - at[:-1], size) + np.arange(at[-1])]
            text = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(text)])
            op = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(np.arange(len(size) + 1, dtype=np.int32)), pa.py_buffer(t.sign.astype(np.uint8))])
            own = pa.array(t.row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in kept), pa.array(t.n.astype(np.int32)), op, text, pa.array(t.length.astype(np.int32)), pa.array(t.offset.astype(np.int32))], names=[*kept, "n", "op", "text", "length", "offset"])

    return alignments.select(*kept, "cs").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", n int, op string, text string, length int, offset int")


_EVENT = "array<struct<pos:int,depth:long,a:long,c:long,g:long,t:long>>"
#: Events that a task holds before it hands out each strand's.
EVENTS_AT_ONCE = 1 << 19


def _events(used: DataFrame, front: int) -> DataFrame:
    """(name, pile): changes of depth at a place and substitutions there, a strand's in one array; at place -1, alignments.  A task sums them until it holds many; where rows come
    by name, as a join leaves them, a strand has a row or two.  used: name, target_start, cs, size (of the trimmed strand)."""

    def of(batch: pa.RecordBatch, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (name and position as one number) that are different, and their five sums."""
        size, begin = batch.column("size").to_numpy().astype(np.int64), batch.column("target_start").to_numpy().astype(np.int64)
        t = tokens_of(batch.column("cs"))
        start = begin[t.row] + t.offset - front
        base = _BASE[t.data[np.minimum(t.start + 1, len(t.data) - 1)]]
        alt = np.flatnonzero((t.sign == 42) & (start >= 0) & (start < size[t.row]) & (base < 4))
        low, high = np.maximum(start, 0), np.minimum(start + t.length, size[t.row])
        span = np.flatnonzero((t.sign == 58) & (low < high))
        # (strand, place, column, change)
        parts = [(name, np.full(len(name), -1), 0, 1), (name[t.row[span]], low[span], 0, 1), (name[t.row[span]], high[span], 0, -1), (name[t.row[alt]], start[alt], 0, 1), (name[t.row[alt]], start[alt] + 1, 0, -1)]
        parts += [(name[t.row[alt[base[alt] == k]]], start[alt[base[alt] == k]], 1 + k, 1) for k in range(4)]
        place = np.concatenate([p[0] << 32 | p[1] + 1 for p in parts])
        keys, at = np.unique(place, return_inverse=True)
        sums = np.zeros((5, len(keys)), dtype=np.int64)
        done = 0
        for own, _, column, change in parts:
            sums[column] += change * np.bincount(at[done : done + len(own)], minlength=len(keys))
            done += len(own)
        return keys, sums

    def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, sums = np.concatenate([k for k, _ in parts]), np.concatenate([x for _, x in parts], axis=1)
        order = np.argsort(keys, kind="stable")
        different, first = np.unique(keys[order], return_index=True)
        return different, np.add.reduceat(sums[:, order], first, axis=1)

    def rows(known: dict[str, int], parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, sums = joined(parts)
        names = pa.array(list(known), pa.string())
        number, first = np.unique(keys >> 32, return_index=True)
        ends = np.append(first, len(keys))
        for low in range(0, len(number), STRANDS_AT_ONCE):
            at = ends[low : low + STRANDS_AT_ONCE + 1]
            own = slice(at[0], at[-1])
            events = pa.StructArray.from_arrays([pa.array(((keys[own] & 0xFFFFFFFF) - 1).astype(np.int32)), *(pa.array(x) for x in sums[:, own])], names=["pos", "depth", "a", "c", "g", "t"])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(number[low : low + STRANDS_AT_ONCE])), pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), events)], names=["name", "pile"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts, size = {}, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("name").dictionary_encode()
            number = np.array([known.setdefault(x, len(known)) for x in names.dictionary.to_pylist()], dtype=np.int64)
            parts.append(of(batch, number[names.indices.to_numpy()]))
            size += len(parts[-1][0])
            if size > EVENTS_AT_ONCE:
                parts = [joined(parts)]
                size = len(parts[0][0])
                if 2 * size > EVENTS_AT_ONCE:
                    yield from rows(known, parts)
                    known, parts, size = {}, [], 0
        if parts:
            yield from rows(known, parts)

    return used.select("name", "target_start", "cs", "size").mapInArrow(run, f"name string, pile {_EVENT}")


#: Strands whose piles a task hands out, or reads, at once.
STRANDS_AT_ONCE = 1 << 11
_BASE = np.full(256, 4, dtype=np.int64)
for _k, _letter in enumerate(BASES):
    _BASE[[ord(_letter), ord(_letter.lower())]] = _k


def _piles(alignments: DataFrame, strands: DataFrame, front: int, back: int) -> DataFrame:
    """(name, target, pile): each strand's trimmed sequence once, with its summed events in an array, null without alignments.  alignments: target,
    target_start, tags, of known strands; strands: name, seq.  An array has an event for each place of its strand at most, of each time that a task hands the strand out."""
    target = F.substring(F.upper("seq"), F.lit(front + 1), F.greatest(F.length("seq") - front - back, F.lit(0)))
    own = strands.select("name", target.alias("target"))
    used = alignments.select(F.col("target").alias("name"), "target_start", F.col("tags")["cs"].alias("cs")).join(own.select("name", F.length("target").alias("size")).distinct(), "name")
    piles = _events(used, front).groupBy("name").agg(F.flatten(F.collect_list("pile")).alias("pile"))
    return own.join(piles, "name", "left")


def _few_strands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, STRANDS_AT_ONCE):
            yield batch.slice(low, STRANDS_AT_ONCE)


class Columns:
    """Counts of A, C, G, T at each place of some strands, one strand after the other.  What is no substitution is the strand's own base."""

    def __init__(self, batch: pa.RecordBatch):
        targets, piles = batch.column("target").cast(pa.large_string()).fill_null(""), batch.column("pile")
        _, at, data = targets.buffers()
        at = np.frombuffer(at, np.int64)[targets.offset : targets.offset + len(targets) + 1]
        self.letters = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        self.at = at - at[0]
        self.size = np.diff(self.at)
        self.strand = np.repeat(np.arange(len(self.size)), self.size)
        owner = np.repeat(np.arange(len(piles)), np.array([len(x) if x.is_valid else 0 for x in piles], dtype=np.int64))
        events = piles.flatten()
        pos = events.field("pos").to_numpy().astype(np.int64)
        place = pos + self.at[owner] + owner  # one more place behind each strand, where depth ends
        inside = pos >= 0
        change = np.zeros(len(self.letters) + len(self.size), dtype=np.int64)
        np.add.at(change, place[inside], events.field("depth").to_numpy()[inside])
        depth = np.cumsum(change)[np.arange(len(self.letters)) + self.strand]
        self.reads = np.bincount(owner[~inside], events.field("depth").to_numpy()[~inside], len(self.size)).astype(np.int64)
        self.counts = np.zeros((4, len(self.letters)), dtype=np.int64)
        # substitutions are inside of the strand
        alt = np.flatnonzero(inside & (pos < self.size[owner]))
        for k, c in enumerate("acgt"):
            np.add.at(self.counts[k], pos[alt] + self.at[owner[alt]], events.field(c).to_numpy()[alt])
        self.other = np.maximum(depth - self.counts.sum(axis=0), 0)
        self.base = _BASE[self.letters]
        known = np.flatnonzero(self.base < 4)
        self.counts[self.base[known], known] += self.other[known]


def pileup(alignments: DataFrame, strands: DataFrame, front: int = 0, back: int = 0) -> DataFrame:
    """(name, pos, base, n): counts at each covered place of the trimmed strands, from 0.  Matches and substitutions by a base give depth; what
    is no substitution is the strand's own base.  alignments: target, target_start, tags, of known strands; strands: name, seq.

    Depth comes from two events for each token, summed along the strand, so matched bases are not listed one by one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_strands(batches):
            c = Columns(batch)
            base, place = np.nonzero(c.counts)
            n = c.counts[base, place]
            odd = np.flatnonzero((c.base == 4) & (c.other > 0))
            letters = [*(BASES[k] for k in base), *(chr(x) for x in c.letters[odd])]
            place, n = np.append(place, odd), np.append(n, c.other[odd])
            own = c.strand[place]
            yield pa.RecordBatch.from_arrays([batch.column("name").take(pa.array(own)), pa.array((place - c.at[own]).astype(np.int32)), pa.array(letters, pa.string()), pa.array(n)], names=["name", "pos", "base", "n"])

    return _piles(alignments, strands, front, back).mapInArrow(run, "name string, pos int, base string, n long")


def _consensus(piles: DataFrame, min_depth: int, min_majority: float) -> DataFrame:
    """(name, read_count, mean_depth, covered_bases, n_count, distance, exact_match, consensus) of _piles(), by the vote of majority_vote(), for all places of a batch of strands at once."""
    kinds = {"name": pa.string(), "read_count": pa.int64(), "mean_depth": pa.float64(), "covered_bases": pa.int64(), "n_count": pa.int32(), "distance": pa.int32(), "exact_match": pa.bool_(), "consensus": pa.string()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_strands(batches):
            c = Columns(batch)
            depth, top = c.counts.sum(axis=0), c.counts.argmax(axis=0)  # the first of even ones
            most = np.take_along_axis(c.counts, top[None, :], axis=0)[0]
            sure = (depth > 0) & (depth >= min_depth) & (most / np.maximum(depth, 1) >= min_majority)
            called = np.where(sure, np.frombuffer(BASES.encode(), np.uint8)[top], ord("N"))
            per = lambda x: np.bincount(c.strand, x, len(c.size))
            wrong = per(called != c.letters).astype(np.int32)
            text = pa.Array.from_buffers(pa.large_string(), len(c.size), [None, pa.py_buffer(c.at), pa.py_buffer(called.astype(np.uint8))]).cast(pa.string())
            columns = [batch.column("name"), c.reads, np.where(c.size > 0, per(depth) / np.maximum(c.size, 1), 0.0), per(depth > 0).astype(np.int64), per(called == ord("N")).astype(np.int32), wrong, wrong == 0, text]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, kinds.values())], names=list(kinds))

    return piles.mapInArrow(run, "name string, read_count long, mean_depth double, covered_bases long, n_count int, distance int, exact_match boolean, consensus string")


def majority_vote(piled: DataFrame, min_depth: int = 1, min_majority: float = 0.6) -> DataFrame:
    """(name, pos, depth, base): the most frequent base of each place, the first of A, C, G, T where even, N below the depth or the share."""
    order = F.row_number().over(Window.partitionBy("name", "pos").orderBy(F.desc("n"), "base"))
    ranked = piled.where(F.col("base").isin(*BASES)).select("*", F.sum("n").over(Window.partitionBy("name", "pos")).alias("depth"), order.alias("rank"))
    sure = (F.col("depth") >= min_depth) & (F.col("n") / F.col("depth") >= min_majority)
    return ranked.where("rank = 1").select("name", "pos", "depth", F.when(sure, F.col("base")).otherwise("N").alias("base"))


def classify(exact: Column, complete: Column) -> Column:
    return F.when(exact & complete, "agreement_recovered").when(exact, "consensus_only").when(complete, "kmer_only").otherwise("agreement_missing_or_broken")


def consensus_join(consensus: DataFrame, qc: DataFrame) -> DataFrame:
    """consensus rows with the strand's k-mer quality control (name, status, observed, kmer_count, complete, min_cov, mean_cov, max_cov) and class; status
    missing where there is none."""
    cols = ["status", "observed", "kmer_count", "complete", "min_cov", "mean_cov", "max_cov"]
    own = consensus.join(qc.select("name", *cols), "name", "left")
    complete = F.coalesce("complete", F.lit(False))
    own = own.withColumn("status", F.coalesce("status", F.lit("missing"))).withColumn("complete", complete)
    return own.withColumn("classification", classify(F.col("exact_match"), F.col("complete")))


def comparison_summary(compared: DataFrame) -> DataFrame:
    """(metric, value): strands, exact ones, complete ones, and those of each class."""
    of = lambda c: F.count_if(F.col("classification") == c).alias(c)
    one = compared.agg(
        F.count("*").alias("strands"), F.count_if("exact_match").alias("exact"), F.count_if("complete").alias("complete"), *(of(c) for c in ("agreement_recovered", "agreement_missing_or_broken", "consensus_only", "kmer_only"))
    )
    return one.unpivot([], one.columns, "metric", "value")


def disagreements(compared: DataFrame, limit: int = 200) -> DataFrame:
    """The first `limit` strands on which the two methods differ, by name."""
    return compared.where(F.col("classification").isin("consensus_only", "kmer_only")).orderBy("name").limit(limit)


def paf_consensus(alignments: DataFrame, strands: DataFrame, min_mapq: int = 0, min_identity: float = 0.0, front: int = 0, back: int = 0, min_depth: int = 1, min_majority: float = 0.6) -> DataFrame:
    """Alignments to a consensus of every strand, all N without reads (distance: differing places): events of tokens are summed by place, then gathered by strand, and each strand's sequence is joined to them once."""
    used = quality_buckets(alignments, strands, min_mapq, min_identity).where(F.col("bucket") == USED)
    return _consensus(_piles(used, strands, front, back), min_depth, min_majority)
