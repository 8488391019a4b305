"""Benchmark passages in rows without an id, in rows that share one, and of items without one."""

import random

import duckdb

from quaestor.llm import decontamination
from quaestor.llm.queries import QUERIES
from tests.llm.conftest import sentence


def test_leaks_are_found_by_row(spark):
    rng = random.Random(6)
    whole, halves, nameless = sentence(rng, 40), sentence(rng, 40), sentence(rng, 30)
    first, second = " ".join(halves.split()[:24]), " ".join(halves.split()[20:])
    clean = [sentence(rng, 50) for _ in range(4)]
    rows = [(None, f"{clean[0]} {whole} {clean[1]}"), (None, clean[0]), (None, None), (None, "")]
    rows += [(1, whole), (1, clean[1]), (2, first), (2, second), (3, f"{clean[2]} {nameless}"), (4, clean[3])]
    docs = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, leak string").repartition(3)
    items = spark.createDataFrame([(1, whole), (2, halves), (None, nameless), (None, None)], "item_id long, text string")
    kept = decontamination.without_leaks(docs, items)
    assert kept.columns == docs.columns
    expected = [(None, clean[0]), (None, None), (None, ""), (1, clean[1]), (2, first), (2, second), (4, clean[3])]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(expected, key=str)


def test_the_query_finds_items_in_rows_without_an_id_as_its_sql_does(spark, tmp_path):
    rng = random.Random(7)
    passage = sentence(rng, 30)
    docs = spark.createDataFrame([(None, f"{sentence(rng, 9)} {passage}"), (None, sentence(rng, 20)), (1, sentence(rng, 20))], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    expected = con.execute(decontamination.SQL).fetchall()
    assert len(expected) == 1 and expected[0][0] is None
    assert [tuple(r) for r in QUERIES["op4_decontamination"](spark, str(tmp_path)).collect()] == expected
