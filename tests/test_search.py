import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaestor.operators import evaluation as E
from quaestor.operators import ranking as K
from quaestor.operators.bounded_fusion import ScoreList, fused_block
from quaestor.operators.lexical import filter_terms, lexical_query, lexical_scores, postings, query_terms, vocabulary
from quaestor.operators.semantic import nearest_passages, semantic_scores, similar_passages, top_similar
from quaestor.operators.sizing import hot_join
from quaestor.plans.search import Vectors, search

RECORDS = "question_id string, titre string, auteur string, destinataire string, question string, reponse string"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        ("Q1", "Barques de location", "A", "M", "Combien de barques en location ?", "Des barques en location attendent au quai."),
        ("Q2", "Phare 12", "B", "M", "Quelle portée pour le phare 12 ?", "Sa lampe éclaire 30 000 mètres par nuit."),
        ("Q3", "Permis des pêcheurs", "C", "M", "Comment pêcher ?", "Les pêcheurs embarquent.\nLes pêcheurs reçoivent un permis de filet."),
        ("Q4", "Bouées", "D", "M", "Quelles bouées ?", None),
    ]
    return spark.createDataFrame(rows, RECORDS)


def queries(spark, *texts):
    return spark.createDataFrame([(i, t, 6) for i, t in enumerate(texts)], "query_id bigint, text string, limit int")


def test_lexical_query_sends_words_as_written(spark):
    asked = queries(spark, "Que sait-on sur les marées hautes ?", "cœur du port", "filets")
    got = {r.query_id: r.lexical_query for r in lexical_query(query_terms(asked)).collect()}
    assert got == {0: "marees OR hautes", 1: "coeur OR port", 2: "filets"}


def test_search_finds_answered_records_and_filters_the_rest(spark, corpus):
    asked = queries(spark, "permis de filet des pêcheurs", "Combien de grues géantes au musée ?", "barques location", "Quelles bouées ?")
    got = {}
    for row in search(corpus, asked).collect():
        got.setdefault(row.query_id, []).append(row.question_id)
    assert got[0][0] == "Q3" and got[2] == ["Q1"] and set(got) <= {0, 2}


def test_search_is_the_same_alone_and_in_a_batch(spark, corpus):
    texts = ["phare 12", "permis de filet", "barques location"]
    batch = {(r.query_id, r.hit_rank, r.passage_id) for r in search(corpus, queries(spark, *texts)).collect()}
    alone = set()
    for i, text in enumerate(texts):
        alone |= {(i, r.hit_rank, r.passage_id) for r in search(corpus, queries(spark, text)).collect()}
    assert batch == alone


def test_scores_do_not_depend_on_how_the_terms_are_spread(spark, corpus):
    asked = queries(spark, "pêcheurs permis phare barques location")
    terms = query_terms(asked, stemmed=False)
    few = {(r.question_id, round(r.lexical, 9)) for r in lexical_scores(corpus, terms, 1).collect()}
    many = {(r.question_id, round(r.lexical, 9)) for r in lexical_scores(corpus.repartition(3), terms, 10**9).collect()}
    assert few == many and few


def test_records_are_matched_in_place_as_by_a_join(spark, corpus, monkeypatch):
    from quaestor.operators import lexical

    terms = query_terms(queries(spark, "pêcheurs permis phare barques location"), stemmed=False)
    forms = lexical.word_forms(terms, None)
    # Two rows of one id are one record, which only the join sees.
    twice = corpus.unionByName(corpus.limit(1).withColumn("question", F.lit("phare et barques")))

    def found(records):
        rows = lexical.matched_records(records, forms, 40, stemmed=False)
        return sorted((r.question_id, sorted((e.term, bool(e.in_title)) for e in r.entries)) for r in rows.collect())

    in_place, of_two = found(corpus), found(twice)
    plans = []
    monkeypatch.setattr(lexical, "_matched_in_place", lambda *x: plans.append(x))
    found(twice)
    assert not plans  # no record is taken for two
    monkeypatch.setattr(lexical, "LITERAL_TERMS", 0)
    assert in_place == found(corpus) and of_two == found(twice) and any(entries[1:] for _, entries in in_place)


def test_hot_join_salted_equals_plain(spark):
    left = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "k bigint, w string")
    plain = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, hot_join(left, right, ["k"], "v", 10**12, 8).collect())) == plain


def fused_by_hand(lexical, semantic, limit=8):
    def ranks(scores):
        return {d: 1 + sum(other > s for other in scores.values()) for d, s in scores.items()}

    lex, sem = ranks(lexical), ranks({d: s for d, s in semantic.items() if s >= 0.35})
    rows = []
    for d in set(lex) | set(sem):
        score = (1 / (60 + lex[d]) if d in lex else 0) + (1 / (60 + sem[d]) if d in sem else 0)
        rows.append((not (lex.get(d) == 1 or sem.get(d) == 1), -round(score, 12), d))
    return [(d, -score) for _, score, d in sorted(rows)[:limit]]


@pytest.mark.parametrize("seed", range(4))
def test_fusion_is_exact_with_ties_and_deep_ranks(spark, seed):
    rng = random.Random(seed)
    lexical, semantic = {}, {}
    for query in range(3):
        docs = [f"D{i:04d}" for i in range(700)]
        values = [1.0, 2.0] if seed == 0 else [round(rng.random() * 5, 2) for _ in range(60 if seed == 1 else 600)]
        lexical[query] = {d: rng.choice(values) + 0.01 for d in docs if rng.random() < 0.9}
        semantic[query] = {d: rng.choice([0.3, 0.4, 0.5]) if seed < 2 else rng.random() for d in docs if rng.random() < 0.5}
    lex = spark.createDataFrame([(q, d, s) for q in lexical for d, s in lexical[q].items()], "query_id int, question_id string, lexical double")
    sem = spark.createDataFrame([(q, d, s) for q in semantic for d, s in semantic[q].items()], "query_id int, question_id string, semantic double")
    got = {}
    for r in K.fuse(lex, sem, 3).collect():
        got.setdefault(r.query_id, set()).add((r.question_id, round(r.score, 12)))
    for q in lexical:
        assert got[q] == {(d, round(s, 12)) for d, s in fused_by_hand(lexical[q], semantic[q])}


@pytest.mark.parametrize("seed", range(4))
def test_bounded_fusion_equals_the_fusion_of_all_pairs(spark, seed):
    """Lists given as arrays of scores; seeds 0 and 1 have ties far beyond the cut."""
    rng = random.Random(seed)
    ids = np.array([3, 5, 8])
    docs = [f"D{i:04d}" for i in range(700)]
    values = [1.0, 2.0] if seed == 0 else [round(rng.random() * 5, 2) + 0.01 for _ in range(60 if seed == 1 else 600)]
    lexical = {q: {d: rng.choice(values) for d in docs if rng.random() < 0.9} for q in range(3)}
    semantic = {q: {d: rng.choice([0.4, 0.5]) if seed < 2 else 0.35 + rng.random() for d in docs if rng.random() < 0.5} for q in range(3)}

    def scored(lists):
        rows = [(d, [lists[q].get(d, 0.0) for q in range(3)]) for d in docs]
        frame = spark.createDataFrame(rows, "question_id string, s array<double>").repartition(3)

        def scores(batches):
            for batch in batches:
                if len(batch):
                    yield batch.column("question_id"), np.array(batch.column("s").to_pylist())

        return ScoreList(frame, scores)

    got = {}
    for r in fused_block(scored(lexical), scored(semantic), ids).collect():
        got.setdefault(r.query_id, set()).add((r.question_id, round(r.score, 12)))
    for i, q in enumerate(ids):
        assert got[q] == {(d, round(s, 12)) for d, s in fused_by_hand(lexical[i], semantic[i])}


def test_similar_passages_broadcast_and_tiled_agree(spark):
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame(
        [(f"D{i}", f"D{i}:reponse:0", [float(x) for x in rng.normal(size=5)]) for i in range(80)] + [("Z", "Z:reponse:0", [1.0])],
        "question_id string, passage_id string, embedding array<float>",
    )
    asked = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=5)]) for i in range(7)], "query_id bigint, qvec array<float>")
    one = similar_passages(vectors, asked, 7, 5)
    other = similar_passages(vectors, asked, 7, 5, budget=0)

    def rows(df):
        return sorted((r.query_id, r.passage_id, round(r.similarity, 9)) for r in df.collect())

    assert rows(one) == rows(other) and len(rows(one)) > 50
    best = {(r.query_id, r.question_id): r.semantic for r in semantic_scores(one).collect()}
    assert all(v >= 0.35 for v in best.values())


def test_hybrid_keeps_semantic_leaders(spark, corpus):
    asked = queries(spark, "phare 12")
    vectors = Vectors(
        spark.createDataFrame([("Q3", "Q3:reponse:0", [1.0, 0.0])], "question_id string, passage_id string, embedding array<float>"),
        spark.createDataFrame([(0, [1.0, 0.1])], "query_id bigint, qvec array<float>"),
        2,
    )
    assert {r.question_id for r in search(corpus, asked, vectors).collect()} >= {"Q2", "Q3"}


def test_ranking_differences_name_the_most_specific_kind(spark):
    q1a, q1b, q1c, q2a = "P-1:reponse:0", "P-1:reponse:1", "P-1:reponse:2", "P-2:reponse:0"
    cases = [
        ([(q1a, 1.0)], [(q1a, 1.0)], None),
        ([(q1a, 1.0)], [], "sql-vide"),
        ([], [(q1a, 1.0)], "local-vide"),
        ([(q1a, 1.0)], [(q2a, 1.0)], "premiere-question"),
        ([(q1a, 1.0)], [(q1a, 1.0), (q2a, 1.0)], "questions"),
        ([(q1a, 1.0), (q1b, 1.0)], [(q1a, 1.0), (q1c, 1.0)], "passages"),
        ([(q1a, 1.0), (q1b, 1.0)], [(q1b, 1.0), (q1a, 1.0)], "ordre"),
        ([(q1a, 1.0)], [(q1a, 0.5)], "scores"),
        ([(q1a, 1.0000001)], [(q1a, 1.0000002)], None),
    ]

    def table(side):
        rows = [(i, n + 1, p, s) for i, case in enumerate(cases) for n, (p, s) in enumerate(case[side])]
        return spark.createDataFrame(rows, "query_id int, hit_rank int, passage_id string, score double")

    got = {r.query_id: r.kind for r in E.ranking_differences(table(0), table(1)).collect()}
    assert got == {i: kind for i, (_, _, kind) in enumerate(cases) if kind}


def test_summary_leaves_known_gaps_out_of_failures(spark):
    judged = spark.createDataFrame(
        [(1, "titre", 1, True, None), (2, "titre", 2, True, None), (3, "titre", None, False, "limite"), (4, "titre", 1, True, "limite")],
        "query_id int, kind string, rank int, pass boolean, gap string",
    )
    row = E.summary(judged).first()
    assert (row.failed, row.known_gaps, row.resolved_gaps, row.top1) == (0, 1, 1, 0.5)
    assert math.isclose(row.mrr, 2.5 / 4)


def test_filter_terms_and_vocabulary_share_roots(spark, corpus):
    stems = {r.word: r.stem for r in vocabulary(corpus).collect()}
    assert stems["barques"] == "barqu" and stems["12"] == "12"
    got = {r.term for r in filter_terms(queries(spark, "mesures barques"), ["mesure"]).collect()}
    assert got == {"barqu"}


def test_random_queries_are_reproducible(spark):
    words = spark.createDataFrame([(f"mot{i}",) for i in range(400)], "word string")
    first = sorted(map(tuple, E.random_queries(words, 20, 5).collect()))
    assert first == sorted(map(tuple, E.random_queries(words.repartition(7), 20, 5).collect()))
    assert all(1 <= len(set(text.split())) == len(text.split()) <= 4 for _, text in first)
    assert first != sorted(map(tuple, E.random_queries(words, 20, 6).collect()))


def test_cells_leave_out_what_cannot_be_among_the_nearest(spark):
    """Clustered vectors, several of a record, copies and vectors of no length: the same records as over all pairs."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    points = np.concatenate([c + 0.15 * rng.normal(size=(50, 16)) for c in centres])
    points[100:130] = points[100]
    rows = [(f"D{i % 1500:04d}", f"D{i % 1500:04d}:reponse:{i // 1500}", [float(x) for x in p]) for i, p in enumerate(points)]
    rows += [("Z", "Z:reponse:0", [1.0]), ("Y", "Y:reponse:0", [0.0] * 16), ("X", "X:reponse:0", None)]
    vectors = spark.createDataFrame(rows, "question_id string, passage_id string, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(i, [float(x) for x in points[i * 37] + 0.1 * rng.normal(size=16)]) for i in range(30)] + [(99, [0.0] * 16)], "query_id bigint, qvec array<float>")
    best, share = nearest_passages(vectors, asked, 31, 16)
    plain = top_similar(similar_passages(vectors, asked, 31, 16))

    def told(df):
        return sorted((r.query_id, r.hit_rank, r.question_id, r.passage_id, round(r.similarity, 9)) for r in df.collect())

    assert told(best) == told(plain) and len(told(best)) >= 180
    assert share < 0.5
    none, share = nearest_passages(vectors.limit(0), asked, 31, 16)
    assert none.count() == 0 and share == 0


def test_searches_in_two_modes_share_one_match(spark, monkeypatch):
    from quaestor.plans import catalog, search

    folder, calls, whole = "/root/testdata/sf0.001", [], search.matched_and_weights

    def told(*args):
        calls.append(1)
        return whole(*args)

    monkeypatch.setattr(search, "matched_and_weights", told)
    mixed = [tuple(r) for r in catalog.mixed_mode_search(spark, folder).collect()]
    assert len(calls) == 1
    records, queries, n = catalog._search_inputs(spark, folder)
    flagged = queries.withColumn("use_vectors", F.length("text") > 200)
    vectors = catalog._vectors(spark, folder, queries)
    apart = [
        search.search(records, flagged.where("use_vectors"), vectors, False, n),
        search.search(records, flagged.where("not use_vectors"), None, False, n),
    ]
    rows = [(r.query_id, r.hit_rank, r.passage_id, round(r.score, 6)) for part in apart for r in part.collect()]
    assert mixed and sorted((a, b, c, round(d, 6)) for a, b, c, d in mixed) == sorted(rows)


def test_stemmed_postings_are_shuffled_once_and_agree_however_few_words_are_broadcast(spark, corpus):
    """Against the roots counted by hand; a record in two rows counts as one, a word without a record is in no posting."""
    rows = corpus.unionByName(corpus.where("question_id = 'Q2'"))
    stem_of = {r.word: r.stem for r in vocabulary(rows).collect()}
    expected = {}
    for r in postings(rows, stemmed=False).where("term is not null").collect():
        tf, titled = expected.get((stem_of[r.term], r.question_id), (0, False))
        expected[stem_of[r.term], r.question_id] = (tf + r.tf, titled or r.in_title)
    for bound in (1 << 20, 12, 0):
        found = postings(rows, broadcast_rows=bound)
        got = [((r.term, r.question_id), (r.tf, r.in_title)) for r in found.collect()]
        assert len(got) == len(dict(got)) and dict(got) == expected
    plan = postings(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
