"""Digest trees against joins of whole stores, and sketches against exact ranks."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from quaestor.operators import digest_tree as M
from quaestor.operators import evaluation as E

KEYS = ["id"]


def compared(before, after):
    value = F.col("text")
    unequal = M.unequal_buckets(M.digest_tree(before, KEYS, value), M.digest_tree(after, KEYS, value)).checkpoint()
    return unequal, {(r.id, r.change) for r in M.differences(before, after, KEYS, value, unequal).collect()}


def test_changes_are_found_and_only_their_buckets(spark):
    rows = [(f"k{i}", None if i % 7 == 0 else f"text {i % 50}") for i in range(3000)] + [(None, "a"), (None, "a"), ("", None), ("twice", "x"), ("twice", "y")]
    changed = [r for r in rows if r[0] not in ("k1", "twice")]
    changed = [("k2", "other") if r[0] == "k2" else ("k7", "") if r[0] == "k7" else r for r in changed]
    changed.remove((None, "a"))
    changed += [("twice", "y"), ("twice", "x"), ("new", "n")]
    random.Random(3).shuffle(changed)
    schema = "id string, text string"
    unequal, found = compared(spark.createDataFrame(rows, schema), spark.createDataFrame(changed, schema))
    assert found == {("k1", "removed"), ("k2", "rewritten"), ("k7", "rewritten"), (None, "rewritten"), ("new", "added")}
    by_level = {r.level: r["count"] for r in unequal.groupBy("level").count().collect()}
    assert by_level[0] == 1 and by_level[M.DIGITS] == 5


@pytest.mark.parametrize("empty", [False, True])
def test_equal_stores_end_at_the_root(spark, empty):
    rows = spark.createDataFrame([] if empty else [("a", None), ("b", "x")], "id string, text string")
    unequal, found = compared(rows, rows)
    assert unequal.count() == 0 and found == set()


def test_sketches_of_hours_merge_within_the_error(spark):
    dice, begin = random.Random(8), datetime.datetime(2026, 1, 1)
    logs = []
    for i in range(20_000):
        ms = {"search": int(dice.lognormvariate(4, 1)), "same": 5} | ({"rare": i} if i % 4000 == 0 else {}) | ({"none": None} if i < 3 else {})
        logs.append((begin + datetime.timedelta(seconds=i * 9), json.dumps({"ms": ms})))
    logs = spark.createDataFrame(logs, "ts timestamp, payload string")
    sketches = E.hourly_sketches(logs)
    assert sketches.where("step = 'search'").count() == 50
    found = {(r.step, r.share): r for r in E.rank_errors(logs, E.sketched_percentiles(sketches, ["step"])).collect()}
    assert {k[0] for k in found} == {"search", "same", "rare"}
    assert all(r.rank_error <= E.SKETCH_RANK_ERROR for r in found.values())
    assert found["same", 0.95].ms == 5 and found["rare", 0.5].ms == 8000 and found["search", 0.5].requests == 20_000
