import inspect

import duckdb
import pytest
from conftest import rows

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def test_names():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 60
    assert all(len(inspect.signature(q).parameters) == 2 for q in queries.values())


def test_flagship(spark):
    assert entry.entry(spark).count() == 20


@pytest.mark.parametrize("name", ["f5_kmers_ordered", "a1_kmer_count", "a4_a5_strand_stats", "p2_cross_links", "p3_entanglement", "g8_batch_qc", "a15_pileup", "src2_fastq"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert rows(got.select(*columns)) == sorted(want, key=repr)
