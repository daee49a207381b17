"""Stored tables: lookups that are pruned, prefixes, runs that are merged, and batches that come again."""

import random
import re

import numpy as np
import pytest
from conftest import rows

from helixlake.operators import counts, store
from helixlake.streaming import counts as streaming


def reads(spark, rng, n=40):
    return spark.createDataFrame([("".join(rng.choice("ACGT") for _ in range(rng.randint(3, 90))),) for _ in range(n)], "seq string")


def test_lookups_read_the_buckets_they_ask_for(spark, tmp_path):
    rng = random.Random(1)
    df = reads(spark, rng, 300)
    table = store.stored(df, 9, str(tmp_path / "t"))
    want = {r.kmer: r.cov for r in counts.kmer_counts(df, 9).collect()}
    some = sorted(want)[:3]
    asked = spark.createDataFrame([(x,) for x in [*some, some[0], 5, None]], "key long")
    assert {r.kmer: r.cov for r in table.counts_of(asked).collect()} == {k: want[k] for k in [*some, 5] if k in want}
    keys = np.array(some, dtype=np.int64).view(np.uint64) * store._ODD
    scan = table.lists_for(keys)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*group", plan) and re.search(r"PushedFilters: \[[^\n]*bucket", plan)
    # a few lists of a few folders
    assert scan.count() <= 3 < table.lists.count() / 20
    every = spark.createDataFrame([(x,) for x in want], "key long")
    assert {r.kmer: r.cov for r in table.counts_of(every).collect()} == want


def test_many_questions_take_several_scans(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    df = reads(spark, rng)
    table = store.stored(df, 5, str(tmp_path / "t"))
    want = rows(counts.kmer_counts(df, 5))
    monkeypatch.setattr(store, "ASKED_AT_ONCE", 40)
    assert rows(table.counts_of(counts.kmer_counts(df, 5).select("kmer"))) == want
    texts = [r[0] for r in counts.kmer_counts(df, 5, text=True).select("kmer").collect()]
    prefixes = spark.createDataFrame([(t[:n],) for t in texts for n in (2, 3)], "prefix string")
    got = table.starting_with(prefixes, 4).collect()
    both = {t: c for t, c in rows(counts.kmer_counts(df, 5, text=True))}
    both |= {t[::-1].translate(str.maketrans("ACGT", "TGCA")): c for t, c in both.items()}
    assert {(r.prefix, r.kmer, r["cov"]) for r in got} >= {(p, t, both[t]) for p in {t[:n] for t in texts for n in (2, 3)} for t in sorted(x for x in both if x.startswith(p))[:4]}


def test_turned():
    rng = random.Random(3)
    for k in (1, 2, 7, 31):
        texts = ["".join(rng.choice("ACGT") for _ in range(k)) for _ in range(50)]
        code = lambda t: int("".join(str("ACGT".index(c)) for c in t), 4)
        got = store.turned(np.array([code(t) for t in texts], dtype=np.int64), k)
        assert got.tolist() == [code(t[::-1].translate(str.maketrans("ACGT", "TGCA"))) for t in texts]


def test_runs_are_merged_and_batches_come_once(spark, tmp_path):
    rng = random.Random(4)
    parts = [reads(spark, rng, 20) for _ in range(5)]
    table = store.KmerTable.create(spark, str(tmp_path / "t"), 5, parts[0])
    for i, part in enumerate(parts):
        table.add(part, i, most_runs=3)
        again = store.KmerTable(spark, table.path)
        again.add(part, i)  # a batch that is run again
        assert again.runs == table.runs
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    want = rows(counts.raw_counts(whole, 5))
    assert len(table.runs) == 2 and table.batches == list(range(5))
    assert rows(table.rows()) == want
    summary = table.summary().first()
    assert tuple(summary) == (len(want), sum(n for _, n in want))
    table.compact()
    assert len(table.runs) == 1 and rows(store.KmerTable(spark, table.path).rows()) == want
    assert len([n for n in table._names("data") if n.startswith("run=")]) == 1


def test_a_failure_between_write_and_commit(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    first, second = reads(spark, rng, 20), reads(spark, rng, 20)
    table = store.stored(first, 5, str(tmp_path / "t"))

    def fail(*args):
        raise RuntimeError("lost")

    for what in (lambda t: t.add(second, 7), lambda t: t.compact()):
        with monkeypatch.context() as m:
            m.setattr(store.KmerTable, "_commit", fail)
            with pytest.raises(RuntimeError):
                what(store.KmerTable(spark, table.path))
        assert rows(store.KmerTable(spark, table.path).rows()) == rows(counts.raw_counts(first, 5))
    again = store.KmerTable(spark, table.path)
    again.add(second, 7)
    again.compact()
    assert rows(again.rows()) == rows(counts.raw_counts(first.unionByName(second), 5))


def test_larger_tables_get_more_buckets(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    df = reads(spark, rng, 200)
    table = store.stored(df.limit(1), 7, str(tmp_path / "t"))
    before = table.coarse
    table.add(df)
    monkeypatch.setattr(store, "BUDGET", 50)
    table.compact()
    assert table.coarse > before and table.fine >= table.coarse + store.FINER_BITS
    want = rows(counts.raw_counts(df.unionByName(df.limit(1)), 7))
    assert rows(table.rows()) == want
    assert rows(table.counts_of(counts.raw_counts(df, 7).select("kmer")).select("kmer")) == [(k,) for k, _ in want]


def test_streamed_files(spark, tmp_path):
    rng = random.Random(8)
    df = reads(spark, rng, 60)
    df.repartition(6).write.parquet(str(tmp_path / "reads"))
    told = []
    streaming.merge_into_store(streaming.stream_reads(spark, str(tmp_path / "reads")), 5, str(tmp_path / "store"), str(tmp_path / "checkpoint"), most_runs=2, told=lambda n, r: told.append((n, *r))).awaitTermination()
    want = rows(counts.raw_counts(df, 5))
    assert rows(streaming.read_store(spark, str(tmp_path / "store"))) == want
    assert [t[0] for t in told] == list(range(6)) and told[-1][1:] == (len(want), sum(n for _, n in want))
