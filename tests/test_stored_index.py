"""The stored index against search over the texts, through refreshes and rewrites."""

import random

import pytest
from pyspark.sql import functions as F

from quaestor.operators import lexical as L
from quaestor.operators import stored_index as I
from quaestor.plans.search import search, search_index
from quaestor.session import materialised

WORDS = [f"mot{i}" for i in range(80)] + ["rues", "rue", "écoles", "école", "trams"]
SCHEMA = "question_id string, titre string, auteur string, destinataire string, question string, reponse string"


def sentence(rng, n):
    return " ".join(rng.choices(WORDS, [1 / (i + 1) for i in range(len(WORDS))], k=n))


def records(spark, rng, ids):
    rows = [(f"R-{i:03d}", sentence(rng, 3), "A", "M", sentence(rng, 8), None if i % 9 == 4 else sentence(rng, rng.randint(5, 60))) for i in ids]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    asked = [(i, sentence(rng, rng.randint(1, 6)) + " " + rng.choice(WORDS[40:]), 6) for i in range(12)] + [(50, "inconnu", 6), (51, "", 6)]
    return materialised(records(spark, rng, range(300))), spark.createDataFrame(asked, "query_id long, text string, limit int")


def told(hits):
    return sorted((r.query_id, r.hit_rank, r.passage_id, round(r.score, 9)) for r in hits.collect())


def same_postings(index, rows, stemmed):
    found = sorted((r.term, r.question_id, r.in_title) for r in index.entries().collect())
    expected = sorted((r.term, r.question_id, r.in_title) for r in L.postings(rows, stemmed).collect())
    assert found == expected
    counts = {}
    for term, _, _ in expected:
        counts[term] = counts.get(term, 0) + 1
    assert {r.term: r.df for r in index.frequencies().collect()} == counts
    assert index.n_records == L.answered(rows).count()


def test_search_skips_slots_and_finds_the_same(spark, corpus, tmp_path, monkeypatch):
    rows, queries = corpus
    monkeypatch.setattr(I, "FIRST_SLOTS", 2)
    monkeypatch.setattr(I, "SLOT_RECORDS", 2)
    index = I.build_index(rows, str(tmp_path), "v1", stemmed=False, parts=4)
    assert told(search_index(index, queries)) == told(search(rows, queries, stemmed=False))
    share = I.read_share(index, materialised(L.query_terms(queries, stemmed=False)), 14).agg(F.sum("slots").alias("n"), F.sum("scored").alias("m")).first()
    assert share.m < 0.8 * share.n


def test_a_search_reads_the_folders_of_its_terms(spark, corpus, tmp_path):
    rows, queries = corpus
    index = I.build_index(rows, str(tmp_path), "v1", stemmed=False, parts=16)
    one = materialised(L.query_terms(queries.where("query_id = 0"), stemmed=False))
    weights = materialised(I.term_weights(index, one))
    bounds = I._bounds(index, weights, 40)
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(bounds._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [part#" in plan and "PushedFilters: [" in plan and "In(term, [" in plan
    assert "ReadSchema: struct<term:string,slot:int,titled:boolean>" in plan and "regexp_extract_all" not in plan


def test_terms_beyond_the_literals_are_joined(spark, corpus, tmp_path, monkeypatch):
    rows, queries = corpus
    index = I.build_index(rows, str(tmp_path), "v1", parts=4)
    few = told(search_index(index, queries))
    monkeypatch.setattr(I, "LITERALS", 1)
    assert told(search_index(index, queries)) == few == told(search(rows, queries))


def test_refreshes_equal_a_rebuild(spark, corpus, tmp_path, monkeypatch):
    """Records change, leave, lose their answer and come back; at last the segments are rewritten as one."""
    monkeypatch.setattr(I, "MOST_SEGMENTS", 3)
    rows, queries = corpus
    rng, root = random.Random(4), str(tmp_path)
    I.build_index(rows, root, "v1", parts=3)
    n = F.substring("question_id", 3, 9).cast("int")
    versions = [
        rows.where(n % 5 != 0).withColumn("reponse", F.when(n % 7 == 0, F.lit(None)).when(n % 11 == 0, F.lit("écoles nouvelles zinzolin")).otherwise(F.col("reponse"))),
        rows.unionByName(records(spark, rng, range(300, 330))),
        rows.where(n < 100),
    ]
    for i, version in enumerate(versions, 2):
        version = materialised(version)
        index = I.refresh_index(version, root, f"v{i}")
        assert index.state["version"] == f"v{i}" and index.number == i
        same_postings(index, version, True)
        if i == 3:
            assert told(search_index(index, queries)) == told(search(version, queries))
    assert len(index.state["segments"]) == 1  # the fourth segment was one too many
    same_postings(I.open_index(spark, root, 2), materialised(versions[0]), True)  # what the second commit saw


def test_nothing_changed_and_no_records(spark, corpus, tmp_path):
    rows, queries = corpus
    I.build_index(rows, str(tmp_path / "a"), "v1", stemmed=False, parts=2)
    index = I.refresh_index(rows, str(tmp_path / "a"), "v2")
    same_postings(index, rows, False)
    empty = I.build_index(rows.limit(0), str(tmp_path / "b"), "v1", stemmed=False, parts=2)
    assert search_index(empty, queries).count() == 0
    same_postings(I.refresh_index(rows.limit(20), str(tmp_path / "b"), "v2"), rows.limit(20), False)
    with pytest.raises(FileNotFoundError):
        I.open_index(spark, str(tmp_path / "c"))


def test_blocks_take_one_shuffle_and_one_entry_a_record(spark):
    """Roots said in several forms, in the title and outside of it; a record without an answer has none."""
    rows = [("a", "chats", "chat noir", "chats"), ("b", "x", "noire", "chat"), ("c", "chat", "x", None)]
    records = spark.createDataFrame([(i, t, "", "", q, r) for i, t, q, r in rows], "question_id string, titre string, auteur string, destinataire string, question string, reponse string")
    forms = spark.createDataFrame([("chat", "chat"), ("chats", "chat"), ("noir", "noir"), ("noire", "noir")], "word string, term string")
    blocks = I.term_blocks(records, forms, 1)
    assert {(b.term, b.titled, b.n, tuple(sorted((e.question_id, e.in_title) for e in b.entries))) for b in blocks.collect()} == {
        ("chat", True, 2, (("a", True), ("b", False))),
        ("noir", False, 2, (("a", False), ("b", False))),
    }
    assert blocks._jdf.queryExecution().sparkPlan().toString().count("Join") == 1
    for known in (forms, None):
        plan = I.term_blocks(records, known, 4)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1


def test_records_are_shuffled_once_and_their_words_put_in_order_once(spark, corpus):
    """No list of entries is shuffled or gathered before its block is whole; with too many forms only what is said in the rare ones moves."""
    rows, _ = corpus
    forms = spark.createDataFrame([("rue", "ru", 300), ("rues", "ru", 2)], "word string, term string, n long")

    def plan(*args):
        return I.term_blocks(rows, *args)._jdf.queryExecution().executedPlan().toString()

    for text in (plan(None, 4), plan(forms, 4)):
        assert "ObjectHashAggregate" not in text and text.count("Sort [") == 1
        assert text.count("Exchange hashpartitioning(slot") == 1 == text.count("Exchange hashpartitioning(")
    assert "_salt" not in plan(forms, 4, None, 4)
    told = {(b.term, e.question_id) for b in I.term_blocks(rows, forms, 4, 3, 4).collect() for e in b.entries}
    assert told and told == {(b.term, e.question_id) for b in I.term_blocks(rows, forms, 4).collect() for e in b.entries}


def test_more_forms_than_are_sent_to_a_task(spark, corpus, tmp_path, monkeypatch):
    rows, queries = corpus
    monkeypatch.setattr(I, "TOLD_FORMS", 9)
    index = I.build_index(rows, str(tmp_path), "v1", parts=3)
    same_postings(index, rows, True)
    n = F.substring("question_id", 3, 9).cast("int")
    later = materialised(rows.where(n % 5 != 0).withColumn("reponse", F.when(n % 7 == 0, F.lit("écoles zinzolin")).otherwise(F.col("reponse"))))
    same_postings(I.refresh_index(later, str(tmp_path), "v2"), later, True)


def test_a_build_works_its_records_out_once(spark, corpus, tmp_path):
    rows, _ = corpus
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    I.build_index(rows.mapInArrow(counted, rows.schema), str(tmp_path), "v1", stemmed=False, parts=2)
    assert seen.value == rows.count()
