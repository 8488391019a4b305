import math
import random
from collections import Counter

import pytest

from quaestor.llm import backoff_lm


def brute(texts):
    words = [[w for w in (t or "").encode().translate(backoff_lm._LOWER).split()] for t in texts]
    pairs = [Counter(zip([None, *w], w)) for w in words]
    whole = sum(pairs, Counter())
    used, followed = Counter(), Counter()
    for (v, w), n in whole.items():
        used[w] += n
        followed[v] += n
    total = sum(used.values()) or 1
    out = []
    for own in pairs:
        own_used, own_followed = Counter(), Counter()
        for (v, w), n in own.items():
            own_used[w] += n
            own_followed[v] += n
        score = 0.0
        for (v, w), n in own.items():
            other = whole[v, w] - n
            if other:
                score += n * math.log(other / (followed[v] - own_followed[v]))
            else:
                uses = used[w] - own_used[w]
                score += n * math.log(backoff_lm.BACKOFF * (uses or backoff_lm.BACKOFF) / total)
        out.append((sum(own.values()), score))
    return out


def check(spark, rows, tmp_path):
    path = str(tmp_path / "documents")
    spark.createDataFrame(rows, "doc_id long, text string, log_score string").repartition(3).write.parquet(path)
    got = backoff_lm.with_scores(spark.read.parquet(path)).collect()
    expected = sorted((r[0] is None, r[0] or 0, n, s) for r, (n, s) in zip(rows, brute([r[1] for r in rows])))
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.log_score) for r in got)
    assert [x[:3] for x in found] == [x[:3] for x in expected]
    assert [x[3] for x in found] == pytest.approx([x[3] for x in expected], abs=1e-6)
    assert all((r.mean_score is None) == (r.n_words == 0) for r in got)


def texts(count):
    random.seed(5)
    words = [f"w{i}" for i in range(60)]
    out = [(i, " ".join(random.choices(words, weights=[1 / (k + 1) for k in range(60)], k=random.randint(0, 80))), "x") for i in range(count)]
    return [*out, (None, "w1 W2\tw3", "x"), (3, None, None), (4, "", None), (5, " \n ", None), out[0], out[0], (9, "only here " * 40, "x"), (10, "w1 " * 3000, "x")]


def test_scores_equal_brute_force_with_all_words_frequent(spark, tmp_path):
    check(spark, texts(60), tmp_path)


@pytest.mark.parametrize("frequent", [0, 1, 6, 25])
def test_the_choice_of_frequent_words_changes_no_score(spark, tmp_path, monkeypatch, frequent):
    monkeypatch.setattr(backoff_lm, "FREQUENT_WORDS", frequent)
    check(spark, texts(40), tmp_path)


def test_one_document_and_none(spark, tmp_path):
    check(spark, [(1, "a b a", None)], tmp_path / "one")
    assert backoff_lm.with_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blocks_round_trip():
    import numpy as np

    columns = {x: np.arange(5, dtype=t) * (7 if x != "kind" else 0) for x, t in backoff_lm._FIELDS}
    back = backoff_lm._unpacked(backoff_lm._packed(columns), 5)
    assert all((back[x] == columns[x]).all() for x in columns)


def test_a_text_of_more_words_than_a_task_numbers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(backoff_lm, "MEMO", 50)
    rows = [(1, " ".join(f"x{i}" for i in range(3000)), None), (2, " ".join(f"x{i}" for i in range(0, 3000, 2)), None), *texts(20)]
    check(spark, rows, tmp_path)
