import random
import re

from pyspark.sql import functions as F

from quaestor.functions.text import query_words
from quaestor.operators import answers as A
from quaestor.operators.evaluation import rare_title_words

HOSTS = ("records.example.org",)
RECORDS = "question_id string, titre string, auteur string, destinataire string, date_reponse date, reponse string, url_source string"
HITS = "query_id int, hit_rank int, passage_id string, question_id string, section string, position int, content string"
GENERATED = "query_id int, status string, paragraphs array<struct<text:string,sourceIds:array<string>>>, limits string"


def excerpts(spark, text, focuses, limit=700):
    df = spark.createDataFrame([(text, focuses)], "text string, focuses array<string>")
    column = A.focused_excerpts(F.col("text"), F.transform("focuses", lambda f: F.array_distinct(query_words(f))), limit)
    return df.select(column).first()[0]


def check_excerpts(text, focuses, limit, found):
    """Marks, lengths, order and coverage of the excerpts of a text of one kind of white space."""
    clean = re.sub("[ \t]+", " ", text).strip()
    bodies = [x.removeprefix("… ").removesuffix(" …") for x in found]
    at = -1
    for excerpt, body in zip(found, bodies):
        assert body in clean
        assert clean.index(body) > at or clean.count(body) > 1
        at = clean.index(body)
        assert excerpt.endswith(" …") == (not clean.endswith(body))
        assert excerpt.startswith("… ") or clean.startswith(body)
    assert sum(map(len, bodies)) <= max(1, len(focuses)) * limit
    for focus in focuses:
        present = [w for w in focus.split() if w in re.findall("[a-z]+", clean.lower())]
        assert not present or any(w in body.lower() for w in present for body in bodies)


def test_a_short_text_is_its_own_excerpt(spark):
    assert excerpts(spark, "Deux  mots.", ["absent"]) == ["Deux mots."]
    assert excerpts(spark, "sans majuscule", ["absent"]) == ["… sans majuscule"]


def test_excerpts_keep_order_length_marks_and_words(spark):
    rng = random.Random(23)
    vocabulary = ["sable", "rive", "barque", "phare", "quai", "mouette", "vague", "corde"]
    for _ in range(12):
        text = " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", " ;", "!"]) for _ in range(rng.randint(60, 300)))
        focuses = [rng.choice(vocabulary) for _ in range(rng.randint(1, 2))]
        check_excerpts(text, focuses, 300, excerpts(spark, text, focuses, 300))


def test_followups_take_their_context(spark):
    topic = "Combien de barques la capitainerie a-t-elle louées cet été ?"
    followup = "Et pourquoi ?"
    new = "Le phare du nord sera-t-il repeint avant la saison des tempêtes ?"
    cases = [(followup, [topic], f"{topic} {followup}"), (new, [topic], new), (followup, [], followup), (followup, [topic, new], f"{new} {followup}")]
    df = spark.createDataFrame([(i, m, h) for i, (m, h, _) in enumerate(cases)], "i int, m string, h array<string>")
    got = [r[0] for r in df.orderBy("i").select(A.contextual_query(F.col("m"), F.col("h"))).collect()]
    assert got == [expected for _, _, expected in cases]


def test_conversations_cut_in_slices_read_the_same_history(spark):
    rng = random.Random(2)
    texts = ["Et quand ?", "Pourquoi cela ?", "Que fait la ville pour les parcs ?", "Selon la réponse ministérielle, combien ?"]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(texts)) for c in range(3) for t in range(60)]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {(r.conv_id, r.turn): r.query for r in A.conversation_queries(turns, chunk_turns=7).collect()}
    whole = {(r.conv_id, r.turn): r.query for r in A.conversation_queries(turns, chunk_turns=10**6).collect()}
    assert got == whole and len(got) == 90
    histories = spark.createDataFrame(
        [(c, t, x, [r[3] for r in rows if r[0] == c and r[1] < t and r[2] == "user"]) for c, t, role, x in rows if role == "user"],
        "c int, t int, m string, h array<string>",
    )
    direct = {(r.c, r.t): r.q for r in histories.select("c", "t", A.contextual_query(F.col("m"), F.col("h")).alias("q")).collect()}
    assert got == direct


def fixture(spark):
    records = spark.createDataFrame(
        [
            ("Q1", "Titre 1", "A", "M", None, "Premier passage.\nSecond passage.", "http://records.example.org/1"),
            ("Q2", "Titre 2", "B", "M", None, "Cela ne relève pas de ma compétence.", "https://records.example.org/2"),
        ],
        RECORDS,
    )
    hits = spark.createDataFrame(
        [
            (0, 1, "Q1:reponse:0", "Q1", "reponse", 0, "Premier passage."),
            (0, 2, "Q1:reponse:1", "Q1", "reponse", 1, "Second passage."),
            (0, 3, "Q2:reponse:0", "Q2", "reponse", 0, "Cela ne relève pas de ma compétence."),
        ],
        HITS,
    )
    return records, hits


def test_extractive_answer_groups_by_record(spark):
    records, hits = fixture(spark)
    queries = spark.createDataFrame([(0, "passage"), (1, "rien")], "query_id int, text string")
    got = {r.query_id: r for r in A.extractive_answers(hits, queries, records, HOSTS).collect()}
    assert [s.id for s in got[0].sources] == ["Q1:reponse:0", "Q2:reponse:0"]
    assert got[0].sources[0].excerpts == ["Premier passage.", "Second passage."]
    assert got[0].sources[0].url == "https://records.example.org/1"
    assert got[0].paragraphs[0].text == "Passages de la réponse du date non renseignée :"
    assert "absence de compétence" in got[0].paragraphs[1].text
    assert got[1].status == "insuffisant" and got[1].sources == []


def test_generated_answers_are_checked_and_renumbered(spark):
    records, hits = fixture(spark)
    a, b = "Q1:reponse:0", "Q1:reponse:1"
    many = [("p", [a])] * 9
    cases = [
        ("documente", [("Premier point.", [a, b]), ("Second point.", [b])], "documente"),
        ("documente", [("Faux", ["inconnu"])], "AI_UNKNOWN_CITATION"),
        ("documente", [("Faux", [])], "AI_MISSING_CITATION"),
        ("documente", [("  ", [a])], "AI_OUTPUT_INVALID"),
        ("documente", many, "AI_OUTPUT_INVALID"),
        ("documente", [], "AI_OUTPUT_INVALID"),
        ("insuffisant", [("Fournissez vos pièces.", [a])], "insuffisant"),
        ("autre", [("x", [a])], "AI_OUTPUT_INVALID"),
        ("documente", [("x", []), ("y", ["inconnu"])], "AI_MISSING_CITATION"),
        ("documente", [("x", [a, "inconnu"]), ("y", [])], "AI_UNKNOWN_CITATION"),
    ]
    generated = spark.createDataFrame([(i, s, p, "") for i, (s, p, _) in enumerate(cases)], GENERATED)
    per_query = hits.drop("query_id").crossJoin(generated.select("query_id"))
    checks = A.citation_checks(generated, per_query)
    assert {r.query_id: r.verdict for r in checks.collect()} == {i: v for i, (_, _, v) in enumerate(cases)}
    got = {r.query_id: r for r in A.generated_answers(generated, checks, per_query, records, HOSTS).collect()}
    assert set(got) == {0, 6}
    assert [p.sourceIds for p in got[0].paragraphs] == [[a], [a]]
    assert [s.id for s in got[0].sources] == [a] and len(got[0].sources[0].excerpts) >= 2
    assert got[6].status == "insuffisant" and got[6].sources == []


def test_context_adds_passages_in_turn(spark):
    _, hits = fixture(spark)
    first = hits.where("hit_rank = 1")
    passages = spark.createDataFrame(
        [("Q1", f"Q1:reponse:{i}", "reponse", i, f"passage {i}") for i in range(6)] + [("Q1", "Q1:question:0", "question", 0, "passage")],
        "question_id string, passage_id string, section string, position int, content string",
    )
    queries = spark.createDataFrame([(0, "passage")], "query_id int, text string")
    got = [r.passage_id for r in A.context_hits(first, passages, queries).orderBy("context_rank").collect()]
    assert got == ["Q1:reponse:0", "Q1:reponse:1", "Q1:reponse:2", "Q1:reponse:3"]
    assert A.context_hits(first, passages, queries, 1).count() == 1


def test_words_are_compared_by_root(spark):
    said = ["La digue sera-t-elle fermée ?", "Et les barques, barque, phares, phare, digue, digues, rives ?", "Et les barques, phares, falaises, rives, digues ?"]
    turns = spark.createDataFrame([(1, i, "user", x) for i, x in enumerate(said)] + [(None, 0, "user", None), (None, None, "user", "Et ?")], "conv_id int, turn int, role string, text string")
    rows = A.conversation_queries(turns).collect()
    assert len(rows) == len(said) + 2
    assert {r.turn: r.followup for r in rows if r.conv_id == 1} == {0: False, 1: True, 2: False}
    hit = spark.createDataFrame([(0, 1, "Q1:reponse:0", "Q1", "reponse", 0, "x")], HITS)
    parts = spark.createDataFrame([("Q1", f"Q1:reponse:{i}", "reponse", i, x) for i, x in enumerate(["x", "Les barques du port.", "Le phare."])], "question_id string, passage_id string, section string, position int, content string")
    asked = spark.createDataFrame([(0, "une barque")], "query_id int, text string")
    assert {r.passage_id for r in A.context_hits(hit, parts, asked).collect()} == {"Q1:reponse:0", "Q1:reponse:1"}
    text = "Rien ici. " * 60 + "Trois barques attendent. " + "Rien encore. " * 60
    cited = spark.createDataFrame([(0, "p", text, [["barque"]])], "query_id int, passage_id string, content string, focuses array<array<string>>")
    assert "barques attendent" in A.with_excerpts(cited).first().excerpts[0]


def test_rare_words_are_single_by_root(spark):
    rows = [("Q1", "Les tramways fluviaux du port", "q", "r"), ("Q2", "Le port", "tramway", "r"), ("Q3", "Les digues", "digue", "r"), ("Q4", "Les falaises", "q", None)]
    records = spark.createDataFrame([(i, t, "", "", q, r) for i, t, q, r in rows], "question_id string, titre string, auteur string, destinataire string, question string, reponse string")
    assert {tuple(r) for r in rare_title_words(records).collect()} == {("fluviaux", "Q1"), ("digues", "Q3")}


def test_excerpts_are_cut_in_many_tasks_and_matches_counted_once(spark):
    rows = [(i, f"p{i}", "Un phare. " * 400 + "La barque part.", [["barque"]]) for i in range(40)]
    cited = spark.createDataFrame(rows, "query_id int, passage_id string, content string, focuses array<array<string>>")
    cut = A.with_excerpts(cited)
    assert cut.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert all("La barque part." in r.excerpts[0] for r in cut.collect())
    plan = spark.createDataFrame([("x", [["y"]])], "t string, f array<array<string>>").repartition(1)
    plan = plan.select(A.focused_excerpts(F.col("t"), F.col("f")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") <= 2
