"""Conversation repair against a search over all edits, and its cases."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from helixlake.llm import conversations

WORD, SCHEMA = r"[^\x20\x09-\x0D]", "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """The least (cost, audit): ways are tried in that order, without any being merged."""
    queue = [(0, "", 0, "")]
    while queue:
        cost, audit, k, roles = heapq.heappop(queue)
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, roles
        ways = [(2, "I", 0, r) for r in "ua"]
        if k < len(rows):
            role, fault = rows[k]
            ways.append((3, "D", 1, ""))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                ways += [(2 + more, "R", 1, r) for r in "ua"]
                ways += [(more, "K", 1, role[:1])] if role else []
        for more, edit, step, r in ways:
            if re.fullmatch("s?(ua)*u?", roles + r) and audit.count("I") < len(rows) + 2:
                heapq.heappush(queue, (cost + more, audit + edit, k + step, roles + r))


def damaged(rows):
    out, convs = {}, {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        convs[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(hit, 1)
    return convs


def told(rows):
    """The report of one conversation's rows (turn, role, text), which are in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        marks = re.findall(WORD, text)
        faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit, roles = cheapest([(r[1], f) for r, f in zip(rows, faults)])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    lines, k, place = [], 0, 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[k][1:]
        k += edit != "I"
        if edit != "D":
            lines.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[roles[place]]}:{text}")
            place += 1
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def some(rng, convs, most=6):
    texts = ["Yes.", "No!", "why", "Well?  ", "", " \n", "Ünd so.", "😀"]
    roles = ["user", "assistant", "system", "tool", "user", "assistant"]
    return [(c, turn * rng.choice([1, 1, 1, 2]), rng.choice(roles), rng.choice(texts)) for c in range(convs) for turn in range(rng.randint(1, most))]


def ordered(rows):
    """Rows of one turn go by role, then by hash: the tests let equal turns have one role and text only where their order matters."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize("block_rows", [1, 2, 2048])
def test_report_matches_a_search_over_all_edits(spark, block_rows):
    rng = random.Random(block_rows)
    rows = [r for r in some(rng, 80)]
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
    rows += [(900, 5, "user", "Hi."), (900, 5, "user", "Hi."), (900, 6, "assistant", "Hi."), (901, None, "user", "Ok."), (901, None, "user", "Ok."), (901, 3, "", "Ok."), (None, 1, None, None), (None, 2, "user", "One."), (902, None, "user", "Alone.")]
    rng.shuffle(rows)
    expected = {c: told(ordered(r)) if r else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, r in damaged(rows).items()}
    given = spark.createDataFrame([(*r, "own", 1) for r in rows], SCHEMA + ", block string, copies long").repartition(5)
    got = conversations.report(conversations.damage(given), "conv", copies="copies", block_rows=block_rows).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == expected
    assert len(got) == len(expected)


def test_long_conversation_in_blocks_is_that_in_one(spark):
    rng = random.Random(9)
    rows = list({(c, t): (c, t, r, x + str(rng.randint(0, 40))) for c, t, r, x in some(rng, 3, 300)}.values())
    given = spark.createDataFrame(rows, SCHEMA)
    one = conversations.report(given, block_rows=10_000).sort("conv_id").collect()
    for size in (3, 50):
        assert conversations.report(given, block_rows=size).sort("conv_id").collect() == one


def test_messages_read_as_the_grammar_asks(spark):
    rng = random.Random(4)
    rows = some(rng, 30)
    for size in (2, 2048):
        got = conversations.messages(spark.createDataFrame(rows, SCHEMA), block_rows=size).collect()
        for conv in {r[0] for r in rows}:
            kept = [r for r in sorted((r for r in got if r.conv_id == conv), key=lambda r: (r.block, r.place))]
            assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in kept if r.edit != "D"))
            assert sum(r.edit != "I" for r in kept) == sum(r[0] == conv for r in rows)
            assert all(r.text == "" for r in kept if r.edit == "I")


def test_equal_stacks_are_one_node():
    assert len(conversations.STACKS) == 8
    assert len({(s.state, id(s.below)) for s in conversations.STACKS}) == 8


def test_odd_tables(spark):
    assert conversations.report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert conversations.messages(spark.createDataFrame([], SCHEMA)).collect() == []
    odd = spark.createDataFrame([("a.b", "x", "user", "Hi."), ("a.b", "7", "assistant", "Yes.")], "`conv` string, `start` string, `rows` string, `a.text` string")
    got = conversations.report(odd, "conv", "start", "rows", "`a.text`").collect()
    assert [tuple(r)[:8] for r in got] == [("a.b", 0, 0, 0, 0, 0, 0, "KK")]


def test_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "x" * 1_500_000)]
    got = conversations.report(spark.createDataFrame(rows, SCHEMA)).first()
    assert (got.truncated, got.cost, got.audit) == (1, 1, "KK")
