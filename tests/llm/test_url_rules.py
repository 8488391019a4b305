"""The trie against every entry by hand, and the join that replaces it for long lists."""

import random

import pytest

from quaestor.llm.url_rules import ENTRY, Trie, entries, judged


def by_hand(rows, host, path):
    fitting = [
        ((tier, len(h) + len(p), h.count("."), verdict == "block"), verdict, h + p if tier else None)
        for verdict, h, p, tier in rows
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fitting, key=lambda x: x[0])[1:] if fitting else None


@pytest.fixture(scope="module")
def lists():
    rng = random.Random(8)
    labels, segments = ["a", "b", "com", "org", "", "ab"], ["", "x", "xy", "é", "1"]

    def host():
        return ".".join(rng.choices(labels, k=rng.randint(1, 4)))

    def path():
        return "".join("/" + rng.choice(segments) for _ in range(rng.randint(0, 4)))

    rows = [(rng.choice(["allow", "block"]), host(), path(), rng.randint(0, 1)) for _ in range(300)]
    return rows, [(host(), path()) for _ in range(2000)]


def test_trie_equals_every_entry(lists):
    rows, urls = lists
    trie = Trie(rows)
    for host, path in urls:
        assert trie.longest(host, path) == by_hand(rows, host, path)


def test_join_equals_trie(spark, lists):
    rows, urls = lists
    pages = spark.createDataFrame([(i, f"http://{h}{p}?q", "x", "y") for i, (h, p) in enumerate(urls)] + [(None, None, "x", "y"), (5, "none", "x", "y")], "page_id long, url string, rule string, host string")
    table = spark.createDataFrame(rows + [(None, "a", "", 1), ("block", None, "", 1), ("maybe", "a", "", 1), ("allow", "a", None, 1)], ENTRY)
    by_trie = sorted(map(str, judged(pages, table).collect()))
    assert by_trie == sorted(map(str, judged(pages, table, trie_bytes=0).collect()))
    assert len(by_trie) == len(urls) + 2


def test_no_entries(spark):
    pages = spark.createDataFrame([(1, "http://a/"), (2, None)], "page_id long, url string")
    rows = entries(spark).limit(0)
    assert [tuple(r) for r in judged(pages, rows).orderBy("page_id").collect()] == [(1, "a", "/", None, "allow"), (2, "", "", None, "block")]
    assert judged(pages.limit(0), rows).count() == 0
