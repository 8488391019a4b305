"""Many selections at once against every pattern tried on every title."""

import random
import re

from pyspark.sql import functions as F

from quaestor.operators import refresh
from quaestor.operators.refresh import pattern_keys, selected_titles


def test_keys_are_parts_that_every_match_contains(spark):
    patterns = ["dossier 1[0-9]* ", "abc?", "abc?def", "^Été", "a.c", "x|yzz", "(abc)", r"\bcantine", r"a\.bcd", "abc{0}d", "[abc]def", "[]abc]def", "abcd*", "aß été", "", None]
    rows = spark.createDataFrame([(str(i), p) for i, p in enumerate(patterns)], "name string, pattern string")
    found = {r.pattern: r.key for r in pattern_keys(rows).collect()}
    assert set(found) == {p for p in patterns if p is not None}
    for none in ("abc?", "a.c", "x|yzz", "(abc)", r"a\.bcd", "abc{0}d", "[]abc]def", ""):
        assert found[none] == ""
    assert found["abc?def"] == "def" and found["[abc]def"] == "def" and found["abcd*"] == "abc" and found["^Été"] == "été"
    assert found["aß été"] in (" ét", "été") and found[r"\bcantine"] in "cantine" and found["dossier 1[0-9]* "] in "dossier 1"


def test_five_thousand_selections_equal_brute_force(spark):
    dice = random.Random(2)
    words = ["Dossier", "école", "ÉCOLE", "cantine", "transport", "über", "taux", "a|b", "İstanbul", "ſol", "kilo", "Kilo"]
    titles = [" ".join(dice.choice(words) if dice.random() < 0.7 else str(dice.randrange(6000)) for _ in range(dice.randrange(6))) for _ in range(300)]
    rows = [(i, dice.choice([None, *titles]), dice.choice([None, *titles]), "own") for i in range(400)] + [(0, "", None, "own"), (0, "dossier 7", "dossier 7", "own")]
    patterns = [f"dossier {n}$" for n in range(4950)] + [f"{a}.*{b}" for a in ("école", "cantine", "kilo", "sol") for b in ("taux", "[0-9]+", "x?dossier")]
    patterns += ["^$", "(école|taux)", r"\d{4}", "taux|transport", "kilo?", "istanbul", r"\btaux\b", ".", "zzz", "cant[ia]ne d"]
    selections = spark.createDataFrame([(f"s{i}", p, "label") for i, p in enumerate(patterns)], "name string, pattern string, label string")
    found = selected_titles(spark.createDataFrame(rows, "id int, titre string, titre_nl string, name string"), selections)
    assert found.columns == ["id", "titre", "titre_nl", "name", "selection"]
    trials = [(f"s{i}", re.compile(p, re.IGNORECASE)) for i, p in enumerate(patterns)]
    expected = [(*row, name) for row in rows for name, trial in trials if trial.search(row[1] or "") or trial.search(row[2] or "")]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)
    assert expected


def test_no_rows_and_no_selections(spark):
    rows = spark.createDataFrame([("a", None)], "titre string, titre_nl string")
    none = spark.createDataFrame([], "name string, pattern string")
    assert selected_titles(rows, none).collect() == []
    assert selected_titles(rows.limit(0), none.union(spark.createDataFrame([("n", "a")], none.schema))).collect() == []


def test_numbered_patterns_have_keys_of_their_own(spark):
    numbers = spark.range(5000).select(F.col("id").cast("string").alias("name"), F.concat(F.lit(r"\bDossier "), F.col("id").cast("string"), F.lit("[0-9]* ?[^0-9]")).alias("pattern"))
    assert pattern_keys(numbers).groupBy("key").count().agg(F.max("count")).first()[0] <= 2


def test_more_keys_than_can_be_broadcast(spark, monkeypatch):
    titles = [(i, f"Dossier {i} clos" if i % 3 else None, f"vraag {i}" if i % 2 else None) for i in range(60)]
    rows = spark.createDataFrame([*titles, titles[1]], "id int, titre string, titre_nl string")
    patterns = [(str(n), rf"dossier {n}[0-9]* ?[^0-9]") for n in range(60)] + [("all", "clos|vraag"), ("nl", "vraag 1")]
    selections = spark.createDataFrame(patterns, "name string, pattern string")
    expected = sorted(map(tuple, selected_titles(rows, selections).select("id", "selection").collect()))
    assert expected
    for budget in (62 * 32, 1):
        monkeypatch.setattr(refresh, "fits_broadcast", lambda rows, size, budget=budget: rows * size <= budget)
        monkeypatch.setattr(refresh, "small_side", lambda df, rows, size, budget=budget: df)
        assert sorted(map(tuple, selected_titles(rows, selections).select("id", "selection").collect())) == expected
