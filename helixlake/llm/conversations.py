"""Conversation structure repair by generalised LR parsing with weighted edits.

A conversation's roles must read as nothing, or an optional system turn and then pairs of user and assistant.  An LR automaton of that grammar runs over all
edits of the given turns at once: keep, rerole, delete, and insert an empty turn.  Its stacks form a graph (`Stack`: equal stacks are one node, and
share what lies below their tops), and stack tops that become equal are merged by the least (cost, audit), audit being the edits' initials so far.  Edits read as
many turns as they have letters other than I, so of two equally dear audits at one turn neither begins the other, and the merge loses no answer.

Turns are sorted by ranges of (conversation, turn, role, text), so that a long conversation spreads over many tasks, and cut into blocks.  A conversation that
is one block inside a task is solved where it lies.  For the blocks of others a table is made from each stack to each: the least (cost, audit).  One task adds up
a conversation's tables in order, holding for each stack only its cost and its audit's rank; the audits of the path that it finds are then
applied to the blocks wherever they lie, and texts stream through the digest in order.  No conversation is held whole.

Cases: null roles and texts are one space; null conversation ids are one conversation; turns are read as longs, nulls (and what is no number) come first;
rows of one turn go by role, then by a hash of the text; repeated rows are duplicates of each other; an empty role can't be kept, and joins no legal pair; a conversation
that lost all rows has zeros, an empty audit and the digest of an empty string; an empty table gives an empty result; ids are of any type that has an order, and other columns of the
input are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import beside, settled, table, written

#: The LR tables of S -> (nothing) | B | s B; B -> u a | B u a.  Targets of shifts; symbols that a reduction pops; targets after it; accepting states.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 5, (3, "u"): 6, (4, "u"): 6, (6, "a"): 7}
REDUCE = {5: 2, 7: 3}
GOTO = {0: 3, 1: 4}
ACCEPT = {0, 3, 4}

ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATION = 2, 3, 2, 1
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"
#: Rows and characters of text of a block, about, at most.
BLOCK_ROWS, BLOCK_CHARS = 2048, 1 << 20

Front = dict[int, tuple[int, str]]


class Stack:
    """A node of the graph of stacks: a top state, and the node below it.  Equal stacks are one object."""

    known: dict[tuple, Stack] = {}

    def __init__(self, state: int, below: Stack | None):
        self.state, self.below = state, below

    @classmethod
    def of(cls, state: int, below: Stack | None) -> Stack:
        return cls.known.setdefault((state, below), cls(state, below))

    def read(self, initial: str) -> Stack | None:
        """The stack after a turn of that initial, with all reductions done; None where the grammar has no such turn there."""
        if (self.state, initial) not in SHIFT:
            return None
        top = Stack.of(SHIFT[self.state, initial], self)
        while top.state in REDUCE:
            for _ in range(REDUCE[top.state]):
                top = top.below
            top = Stack.of(GOTO[top.state], top)
        return top


def _moves() -> tuple[list[Stack], list[dict[str, int]]]:
    """All stacks that turns can lead to, the empty one first, and where each initial leads from each."""
    stacks, moves = [Stack.of(0, None)], []
    for stack in stacks:
        found = {r: stack.read(r) for r in "sua"}
        stacks += [s for s in dict.fromkeys(found.values()) if s and s not in stacks]
        moves.append({r: stacks.index(s) for r, s in found.items() if s})
    return stacks, moves


STACKS, MOVES = _moves()
ENDS = {i for i, s in enumerate(STACKS) if s.state in ACCEPT}


def _offer(front: Front, to: int, way: tuple[int, str]) -> bool:
    """Merges a way into the equal stack top."""
    better = to not in front or way < front[to]
    if better:
        front[to] = way
    return better


def with_inserts(front: Front) -> Front:
    work = list(front)
    while work:
        i = work.pop()
        cost, audit = front[i]
        for initial in ROLES:
            j = MOVES[i].get(initial)
            if j is not None and _offer(front, j, (cost + INSERT, audit + "I")):
                work.append(j)
    return front


def after(front: Front, initial: str, fault: int) -> Front:
    """The stack tops after one more row."""
    out: Front = {}
    more = TRUNCATION if fault == TRUNCATED else 0
    for i, (cost, audit) in front.items():
        _offer(out, i, (cost + DELETE, audit + "D"))
        if fault in (FINE, TRUNCATED):
            if initial in MOVES[i]:
                _offer(out, MOVES[i][initial], (cost + more, audit + "K"))
            for other in ROLES:
                if other in MOVES[i]:
                    _offer(out, MOVES[i][other], (cost + REROLE + more, audit + "R"))
    return with_inserts(out)


def start() -> Front:
    return with_inserts({0: (0, "")})


def parsed(rows: list[dict], front: Front) -> Front:
    for r in rows:
        front = after(front, r["role"][:1], r["fault"])
    return front


def best(rows: list[dict]) -> tuple[int, str]:
    """The least (cost, audit) that repairs all rows of a conversation."""
    front = parsed(rows, start())
    return min(front[i] for i in ENDS if i in front)


def edited(rows: list[dict], audit: str, at: int) -> tuple[list[tuple[str, str, str]], int]:
    """(edit, role, text) of each letter of an audit that begins with a stack, and where it ends.  Of users and assistants, any stack takes one only."""
    out, k = [], 0
    for edit in audit:
        role, text = "", ""
        if edit != "I":
            role, text, k = rows[k]["role"], rows[k]["text"], k + 1
        if edit in "RI":
            initial = next(r for r in ROLES if r in MOVES[at])
            role = ROLES[initial]
        if edit != "D":
            at = MOVES[at][role[:1]]
        out.append((edit, role, text))
    return out, at


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): rows after the damage that a checksum of their place names; copies: 0 where the row is dropped, 2 where it is repeated."""
    place = F.concat(F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    hit = F.crc32(place) % 20
    words = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    words = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(words, "[.!?]", "")).otherwise(words)
    who = F.when(hit == 4, "user").otherwise(F.col(role).cast("string"))
    copies = F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1)
    return rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), who.alias("role"), words.alias("text"), copies.alias("copies"))


def turns(rows: DataFrame, conv: str, turn: str, role: str, text: str, copies: Column | None = None) -> DataFrame:
    """(conv, turn, role, text, k1, k2, row): rows as often as `copies` says, with 128 bits for role and text, and a number of their own; written."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select(F.col(conv).alias("conv"), F.col(turn).try_cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), (F.lit(1) if copies is None else copies).alias("copies"))
    each = plain.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copies")
    return written(each.select("*", F.xxhash64("role", "text").alias("k1"), F.xxhash64("role", "text", F.lit(2)).alias("k2"), F.monotonically_increasing_id().alias("row")))


def faults(rows: DataFrame) -> DataFrame:
    """turns() with the first fault of each row.  The first row of each role and text is found by an aggregation, which combines a repeated text within tasks."""
    first = F.min(F.struct(F.col("turn").isNotNull(), "turn", "row")).alias("first")
    seen = written(rows.groupBy("conv", "k1", "k2").agg(F.count("*").alias("n"), first).where("n > 1").select(F.col("conv").alias("c"), F.col("k1").alias("x"), F.col("k2").alias("y"), F.col("first.row").alias("first")))
    same = rows["conv"].eqNullSafe(seen["c"]) & (rows["k1"] == seen["x"]) & (rows["k2"] == seen["y"])
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(bare == "", BLANK).when(F.col("first") != F.col("row"), DUPLICATE).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    return rows.join(beside(seen), same, "left").select(*rows.columns, fault.alias("fault"))


ROWS = "array<struct<turn: bigint, role: string, text: string, fault: int>>"
ARROW_ROWS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.int32())]))


def blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv, block, whole, rows): runs of a conversation's rows in order; block numbers follow the order too.  whole: it has no other block."""
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, kinds = TaskContext.get().partitionId(), 0, None
        now, held, size, first, cut = None, [], 0, True, False
        out: list[tuple] = []

        def close(whole: bool) -> None:
            nonlocal number, held, size
            out.append((now, part << 40 | number, whole, held))
            number, held, size = number + 1, [], 0

        def flush() -> pa.RecordBatch:
            conv, block, whole, lists = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(conv, kinds), pa.array(block, pa.int64()), pa.array(whole), pa.array(lists, ARROW_ROWS)], names=["conv", "block", "whole", "rows"])

        waiting = 0
        for batch in batches:
            kinds = batch.schema.field("conv").type
            ids = batch.column("conv").to_pylist()
            records = batch.select(["turn", "role", "text", "fault"]).to_pylist()
            for conv, record in zip(ids, records):
                if held and conv != now:
                    close(whole=not first and not cut)
                    first, cut = False, False
                elif held and (len(held) >= block_rows or size >= BLOCK_CHARS):
                    close(whole=False)
                    cut = True
                now = conv
                held.append(record)
                size += len(record["text"])
                waiting += len(record["text"]) + 64
                if waiting > BLOCK_CHARS and out:
                    yield flush()
                    waiting = 0
        if held:
            close(whole=False)
        if out:
            yield flush()

    order = ["conv", "turn", "role", "k1", "row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "fault")
    return written(dealt.mapInArrow(run, f"conv {kind}, block long, whole boolean, rows {ROWS}"))


def _tables(parts: DataFrame) -> DataFrame:
    """(conv, block, cells): for each block the least way from each stack to each."""
    kind = parts.schema["conv"].dataType.simpleString()
    cell = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, rows in enumerate(batch.column("rows")):
                rows = rows.as_py()
                ways = [(i, j, *way) for i in range(len(STACKS)) for j, way in parsed(rows, {i: (0, "")}).items()]
                cells = [dict(zip(("start", "end", "cost", "audit"), w)) for w in ways]
                yield pa.RecordBatch.from_arrays([batch.column("conv").slice(k, 1), batch.column("block").slice(k, 1), pa.array([cells], cell)], names=["conv", "block", "cells"])

    return written(parts.select("conv", "block", "rows").mapInArrow(run, f"conv {kind}, block long, cells array<struct<start: int, end: int, cost: bigint, audit: string>>"))


class Path:
    """The cheapest way through a conversation's blocks, of which it sees one table after the other.

    Of each stack's audit it keeps its rank among the others and the insertions at its end: what precedes those ends with a row's edit, and never begins
    another stack's."""

    def __init__(self):
        self.front = {i: (cost, 0, len(audit)) for i, (cost, audit) in start().items()}
        self.blocks: list[int] = []
        self.back: list[dict[int, int]] = []

    def add(self, block: int, cells: list[dict]) -> None:
        ways: dict[int, tuple] = {}
        for c in cells:
            if c["start"] in self.front:
                cost, rank, inserts = self.front[c["start"]]
                way = (cost + c["cost"], rank, "I" * inserts + c["audit"], c["start"])
                ways[c["end"]] = min(way, ways.get(c["end"], way))
        bases = {j: (rank, audit.rstrip("I")) for j, (_, rank, audit, _) in ways.items()}
        ranks = {b: k for k, b in enumerate(sorted(set(bases.values())))}
        self.front = {j: (cost, ranks[bases[j]], len(audit) - len(bases[j][1])) for j, (cost, _, audit, _) in ways.items()}
        self.blocks.append(block)
        self.back.append({j: way[3] for j, way in ways.items()})

    def found(self) -> list[tuple[int, int, int]]:
        """(block, stack before it, stack after it)."""
        at, out = min((self.front[i], i) for i in ENDS if i in self.front)[1], []
        for block, back in zip(reversed(self.blocks), reversed(self.back)):
            out.append((block, back[at], at))
            at = back[at]
        return out[::-1]


def _paths(tables: DataFrame) -> DataFrame:
    """(block, start, end) of the cheapest way of each conversation."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            block, first, last = zip(*path.found())
            return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["block", "start", "end"])

        now, path = None, None
        for batch in batches:
            for conv, block, cells in zip(batch.column("conv").to_pylist(), batch.column("block").to_pylist(), batch.column("cells")):
                if path is not None and conv != now:
                    yield out()
                    path = None
                now, path = conv, path or Path()
                path.add(block, cells.as_py())
        if path is not None:
            yield out()

    dealt = tables.repartition("conv").sortWithinPartitions("conv", "block")
    return dealt.mapInArrow(run, "block long, start int, end int")


def planned(cut: DataFrame) -> DataFrame:
    """(conv, block, whole, rows, start, cost, audit): blocks with the edits that repair their conversation, and the stack that they begin with."""
    kind = cut.schema["conv"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ways = [best(rows.as_py()) for rows in batch.column("rows")]
            costs, audits = zip(*ways) if ways else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([0] * len(ways), pa.int32()), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=[*batch.schema.names, "start", "cost", "audit"])

    done = cut.where("whole").mapInArrow(run, f"conv {kind}, block long, whole boolean, rows {ROWS}, start int, cost long, audit string")
    parts = cut.where("NOT whole")
    tables = _tables(parts)
    way = written(_paths(tables)).alias("way")
    chosen = tables.drop("conv").join(beside(way), "block").select("block", F.col("way.start").alias("start"), F.filter("cells", lambda c: (c["start"] == F.col("way.start")) & (c["end"] == F.col("way.end")))[0].alias("cell"))
    # insertions before the first row are of no block
    lead = {i: len(a) for i, (_, a) in start().items()}
    chosen = written(chosen.select("block", "start", "cell.cost", "cell.audit"))
    firsts = written(parts.groupBy("conv").agg(F.min("block").alias("block")).select("block", F.lit(True).alias("is_first")))
    inserts = F.coalesce(*(F.when(F.col("start") == i, n) for i, n in lead.items()), F.lit(0))
    inserts = F.when(F.col("is_first"), inserts).otherwise(0)
    rest = parts.join(beside(chosen), "block").join(beside(firsts), "block", "left")
    rest = rest.select("conv", "block", "whole", "rows", F.when(F.col("is_first"), 0).otherwise(F.col("start")).alias("start"), (F.col("cost") + INSERT * inserts).alias("cost"), F.concat(F.repeat(F.lit("I"), inserts), "audit").alias("audit"))
    return done.unionByName(rest)


def messages(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv, block, place, edit, role, text): the repaired conversations' turns in the order of block and place, with K, R or I; and what was deleted, with D."""
    kind = rows.schema[conv].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (records, audit, at) in enumerate(zip(batch.column("rows"), batch.column("audit").to_pylist(), batch.column("start").to_pylist())):
                found, _ = edited(records.as_py(), audit, at)
                if found:
                    size = pa.array([k] * len(found))
                    edit, who, words = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column("conv").take(size), batch.column("block").take(size), pa.array(range(len(found)), pa.int64()), pa.array(edit), pa.array(who), pa.array(words)], names=["conv", "block", "place", "edit", "role", "text"])

    plan = planned(blocks(faults(turns(rows, conv, turn, role, text)), block_rows))
    return plan.mapInArrow(run, f"conv {kind}, block long, place long, edit string, role string, text string").withColumnRenamed("conv", conv)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Report:
    """What is told of a conversation, from its blocks in order."""

    def __init__(self):
        self.counts = dict.fromkeys(COUNTS, 0)
        self.least = self.last = None
        self.different, self.initial = 0, None
        self.audits: list[str] = []
        self.digest, self.begun = hashlib.sha256(), False

    def add(self, rows: list[dict], audit: str, at: int, cost: int) -> None:
        for r in rows:
            fault, turn, initial = r["fault"], r["turn"], r["role"][:1]
            if fault:
                self.counts[("", "blank", "duplicate", "truncated")[fault]] += 1
            if self.initial is not None and self.initial + initial not in LEGAL:
                self.counts["illegal"] += 1
            self.initial = initial
            if turn is not None:
                self.least = turn if self.least is None else self.least
                self.different += turn != self.last
                self.last = turn
        for edit, role, text in edited(rows, audit, at)[0]:
            if edit != "D":
                self.digest.update((("\n" if self.begun else "") + role + ":" + text).encode())
                self.begun = True
        self.audits.append(audit)
        self.counts["cost"] += cost

    def done(self) -> tuple:
        if self.last is not None:
            self.counts["gaps"] = self.last - self.least + 1 - self.different
        return (*self.counts.values(), "".join(self.audits), self.digest.hexdigest())


@settled
def report(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.  copies: how often a row is there, 0 included."""
    kind = rows.schema[conv].dataType.simpleString()
    given = turns(rows, conv, turn, role, text, None if copies is None else F.col(copies))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told, kinds = None, None, None
        ids, out = [], []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            arrays = [pa.array(ids, kinds), *(pa.array(c, pa.int64()) for c in columns[: len(COUNTS)]), *(pa.array(c, pa.string()) for c in columns[len(COUNTS) :])]
            batch = pa.RecordBatch.from_arrays(arrays, names=["conv", *COUNTS, "audit", "repaired_sha256"])
            ids.clear()
            out.clear()
            return batch

        for batch in batches:
            kinds = batch.schema.field("conv").type
            for c, records, audit, at, cost in zip(*(batch.column(x).to_pylist() if x != "rows" else batch.column(x) for x in ("conv", "rows", "audit", "start", "cost"))):
                if told is not None and c != now:
                    ids.append(now)
                    out.append(told.done())
                    told = None
                now, told = c, told or Report()
                told.add(records.as_py(), audit, at, cost)
            if out:
                yield flush()
        if told is not None:
            ids.append(now)
            out.append(told.done())
            yield flush()

    schema = f"conv {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"
    plan = planned(blocks(faults(given), block_rows))
    parts = plan.where("NOT whole").repartition("conv").sortWithinPartitions("conv", "block")
    found = plan.where("whole").mapInArrow(run, schema).unionByName(parts.mapInArrow(run, schema))
    if copies is not None:
        lost = rows.groupBy(F.col(conv).alias("conv")).agg(F.max(F.col(copies)).alias("most")).where("most = 0 OR most IS NULL")
        nothing = [F.lit(0).cast("long").alias(c) for c in COUNTS]
        found = found.unionByName(lost.select("conv", *nothing, F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256")))
    return found.withColumnRenamed("conv", conv)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report(damage(table(spark, sf_dir, "conversations")), "conv", copies="copies")
    return out.withColumnRenamed("conv", "conv_id")
