"""Envelopes read in byte ranges equal the whole file parsed at once."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quaestor.sources.corpus_files import read_corpus
from quaestor.sources.envelopes import array_elements, elements, pieces

ODD = ["", "plain", "a]b", "]", "][", '"]', '\\"],[\\', "\\", "},{", "}", "{", "é]ü", "line\n]end", "," * 30, '","', "[[", '{"data": [["x"]]}', "x" * 5000]


@pytest.fixture()
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(x) for x in names]
    for name in names:
        spark.conf.set(name, "700")
    yield
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


@pytest.mark.parametrize("indent", [None, 1])
def test_arrays_equal_the_parsed_file(spark, tmp_path, small_ranges, indent):
    dice = random.Random(5)
    rows = [[dice.choice(ODD) for _ in range(dice.randrange(5))] for _ in range(120)]
    for name, part in (("a", rows), ("b", rows[:1]), ("c", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"total": 3, "data": part}, indent=indent, ensure_ascii=False), encoding="utf-8")
    found = array_elements(spark, str(tmp_path), "[", "array<string>").collect()
    assert sorted(r.value for r in found) == sorted(rows + rows[:1])
    cut = pieces(spark, str(tmp_path), "[")
    assert cut.select("file").distinct().count() == 3
    assert spark.read.option("lineSep", "]").text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 5
    order = elements(spark, str(tmp_path / "a.json"), "[").where("body is not null").orderBy("element").collect()
    assert [json.loads(r.body + "]") for r in order] == rows


@pytest.mark.parametrize("last", [False, True])
def test_corpus_keeps_its_envelope(spark, tmp_path, small_ranges, last):
    records = [{"id": f"r{i}", "numero": i, "question": ODD[i % len(ODD)], "reponse": None if i % 3 else "oui }, {"} for i in range(60)]
    facts = {"extrait_le": "2026-01-02", "nombre_elements": len(records), "methode_echantillonnage": 'a "{" b'}
    whole = {"questions": records, **facts} if last else {**facts, "questions": records}
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps(whole), encoding="utf-8")
    envelope, found = read_corpus(spark, str(path))
    assert [r.asDict() for r in envelope.collect()] == [facts]
    assert sorted((r.question_id, r.numero, r.question, r.reponse) for r in found.collect()) == sorted((r["id"], r["numero"], r["question"], r["reponse"]) for r in records)


def test_corpus_without_records(spark, tmp_path):
    path = tmp_path / "corpus.json"
    path.write_text('{"extrait_le": "2026", "nombre_elements": 0, "questions": []}\n', encoding="utf-8")
    envelope, found = read_corpus(spark, str(path))
    assert [tuple(r) for r in envelope.collect()] == [("2026", 0, None)]
    assert found.collect() == []


def test_as_many_envelopes_as_the_rows_need(spark, tmp_path, monkeypatch):
    from quaestor.sources import corpus_files
    from quaestor.sources.index_pages import read_index

    monkeypatch.setattr(corpus_files, "ENVELOPE_ROWS", 10)
    rows = spark.range(95).select(F.array(F.col("id").cast("string"), F.lit("a]b")).alias("row"))
    corpus_files.write_envelopes(rows, f"{tmp_path}/index", 2)
    files = list((tmp_path / "index").glob("shard=*/*.txt"))
    assert len(files) == 10 and max(len(json.loads(x.read_text())["data"]) for x in files) <= 30
    found = [tuple(r.row) for r in read_index(spark, f"{tmp_path}/index").collect() if r.row]
    assert sorted(found) == sorted((str(i), "a]b") for i in range(95))
