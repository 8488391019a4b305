"""Best positions against scores of all pairs, and the bounds that end a search."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quaestor.llm import ranked_search
from quaestor.llm.ranked_search import Best, Shard, best_documents, weight

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(documents, items, k):
    split = [(d, words(t)) for d, t in documents]
    split = [(d, Counter(x), len(x)) for d, x in split if x]
    n, total = len(split), sum(x for _, _, x in split)
    df = Counter(w for _, x, _ in split for w in x)
    out = []
    for item_id, text in items:
        scores = []
        for d, counts, length in split:
            m = 50 + (50 * length * n) // total
            score = sum(weight(n, df[w]) * ((10**9 * counts[w]) // (1000 * counts[w] + 20 * m)) for w in set(words(text)) if w in counts)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item_id, rank, None if blank else d, -s) for rank, (s, blank, d) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def found(spark, documents, items, k):
    docs = spark.createDataFrame([(d, t, 1) for d, t in documents], "doc_id long, text string, score int").repartition(5)
    asked = spark.createDataFrame([(i, t, "r") for i, t in items], "item_id long, text string, rank string")
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in best_documents(docs, asked, k).collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["é日", "Ünder_line", "x-y"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    documents = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60)))) for i in range(400)]
    documents += [(1000 + i, documents[7][1]) for i in range(40)] + [(None, documents[7][1]), (3, "w1 w2"), (3, "w1 w2"), (5, None), (6, ""), (7, "-- !?")]
    documents += [(2000, "w59 " * 5000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(12)]
    items += [(0, "w0 w1 w2 W59"), (None, documents[7][1]), (20, None), (21, "unknown"), (22, "")]
    return documents, items


@pytest.mark.parametrize("shard", [1, 300, 1 << 21])
def test_equals_scores_of_all_pairs(spark, corpus, monkeypatch, shard):
    monkeypatch.setattr(ranked_search, "SHARD_ENTRIES", shard)
    monkeypatch.setattr(ranked_search, "FIRST_DEPTH", 2)
    documents, items = corpus
    assert found(spark, documents, items, 10) == by_hand(documents, items, 10)


def test_blocks_of_items_change_nothing(spark, corpus, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 40)
    documents, items = corpus
    assert found(spark, documents, items, 7) == by_hand(documents, items, 7)


def test_ties_at_the_bound_go_to_the_smaller_id():
    """All documents score alike: a search that stopped at equality would keep those it met first."""
    size = 500
    ids = np.arange(size)[::-1].copy()
    shard = Shard(ids, np.zeros(size, bool), np.ones(size, np.int64), np.ones(size, np.int64), np.zeros(size, np.int64), np.ones(size, np.int64), np.array([100]), size, size)
    best = Best(5)
    shard.search(np.array([0]), best)
    assert best.ids.tolist() == [0, 1, 2, 3, 4]


def test_a_search_ends_early_and_direct_accesses_move_the_best_positions():
    """Documents that lead every list are found without reading the lists to their ends."""
    rng = np.random.default_rng(2)
    size, terms = 5000, 4
    counts = np.stack([np.where(np.arange(size) < 20, 50, rng.integers(1, 4, size)) for _ in range(terms)], axis=1)
    lengths = np.full(size, 200)
    shard = Shard(np.arange(size), np.zeros(size, bool), lengths, np.full(size, terms), np.tile(np.arange(terms), size), counts.ravel(), np.full(terms, 700), size, 200 * size)
    best = Best(10)
    scored = shard.search(np.arange(terms), best)
    assert best.ids.tolist() == list(range(10))
    assert scored < size / 10


def test_a_text_of_several_megabytes_is_split_in_pieces():
    text = ("ab " * 900_000 + "Z" * 1_200_000 + " é").encode()
    parts = list(ranked_search.terms_of(text))
    assert len(parts) > 2
    assert [w for part in parts for w in part] == [b"ab"] * 900_000 + [b"z" * 1_200_000, "é".encode()]


def test_no_documents_and_no_items(spark, corpus):
    documents, items = corpus
    assert found(spark, [(1, None), (2, "..")], items, 5) == Counter()
    assert found(spark, documents, [], 5) == Counter()
