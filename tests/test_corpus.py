import datetime as dt
import html
import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quaestor.functions import records as R
from quaestor.functions.html import html_text
from quaestor.operators import quality as Q
from quaestor.operators import refresh as N
from quaestor.operators import versions as C
from quaestor.sources import corpus_files as S
from quaestor.sources import index_pages as P
from quaestor.sources.commit_log import CommitLog, Conflict

HOSTS = ("records.example.org", "www.records.example.org")
STORE = "content_hash string, passage_id string, section string, embedding array<float>, embedding_model string"
VERSIONS = "version_id string, active boolean, count int, index_config string, created_at timestamp, activated_at timestamp, activation_unknown boolean"
T0 = dt.datetime(2024, 6, 1, 12)


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_official_links_only(spark):
    links = [
        "http://www.records.example.org", "https://records.example.org/a?b=1#c", "https://records.example.org.evil.com/", "javascript:alert(1)",
        "https://user:pass@records.example.org/", "https://records.example.org:8080/", "ftp://records.example.org/",
    ]
    got = column(spark, links, lambda c: R.official_url(c, HOSTS))
    assert got == ["https://www.records.example.org/", "https://records.example.org/a?b=1#c"] + [None] * 5


def test_dates_labels_and_codes(spark):
    assert column(spark, ["05/03/2026", "31/02/2026", "", "x", None], R.parse_day) == [dt.date(2026, 3, 5)] + [None] * 4
    assert column(spark, ["2026-03-05", None], lambda c: R.date_label(c.cast("date"))) == ["5 mars 2026", "date non renseignée"]
    assert column(spark, ["19-24", "89-95"], R.full_legislature) == ["2019-2024", "1989-1995"]
    assert column(spark, ["QUOTA_UNAVAILABLE", "boom", None], R.failure_code) == ["QUOTA_UNAVAILABLE", "UNEXPECTED", "UNEXPECTED"]
    assert column(spark, ["passages-1;m;1536", None, "passages-1;sans-embeddings;1536", "passages-1;m;3072", ""], lambda c: R.query_model(c, F.lit("x"))) == ["m", "x", None, None, None]


def test_pseudonym_is_the_keyed_digest(spark):
    import hashlib
    import hmac

    expected = hmac.new(b"clef secrete", "session-é".encode(), hashlib.sha256).hexdigest()
    assert column(spark, ["session-é"], lambda c: R.pseudonym(c, "clef secrete")) == [expected]


def test_html_text_decodes_every_entity(spark):
    markup = "<p>Caf&eacute; &amp;lt; &hellip; &#233;&nbsp; x<br/>deux</p><script>var t='</p>'</script><!-- c --><style>p{}</style>\n\n<li>fin</li>"
    assert column(spark, [markup], html_text) == [f"Café &lt; {html.unescape('&hellip;')} é x\ndeux\nfin"]


def test_entities_that_are_not_closed_stay(spark):
    titles = ["<title>a &amp;&amp; b&amp</title><p>Un", "&eacutex &notit; &hellip", "&#233 &#xe9 &#233;&#xE9;&hellip;", "AT&T &ltd; &ampx"]
    assert column(spark, titles, html_text) == ["a && b&ampUn", "&eacutex &notit; &hellip", f"&#233 &#xe9 éé{html.unescape('&hellip;')}", "AT&T &ltd; &ampx"]


def page(question, answer):
    cells = "" if question is None else f"<tr><td><b>Question &nbsp;&nbsp;</b><td valign='top'>{question}</td></tr>"
    cells += "" if answer is None else f"<tr><td><b>R&eacute;ponse</b></td><td>{answer}</td></tr>"
    return f'<section id="fiche"><b>Session:</b> 2024<p>question n° 12</p><b>Date de réponse:</b> 01/02/2026<table>{cells}</table></section>'


def test_pages_are_parsed_or_rejected_with_a_reason(spark):
    pages = [page("Texte.<br>Suite", "Réponse &amp; fin"), page("", None), page(None, "Texte"), "<html>autre</html>", page("Q", None)]
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate(pages)], "moncode string, html string")
    got = {r.moncode: r for r in P.parse_pages(df, P.PageLayout("fiche")).collect()}
    assert (got["0"].question, got["0"].reponse, got["0"].numero, got["0"].date_reponse) == ("Texte.\nSuite", "Réponse & fin", 12, dt.date(2026, 2, 1))
    assert [got[str(i)].reject_reason for i in range(5)] == [None, "question_text_empty", "question_block_missing", "unknown_structure", None]
    assert got["4"].reponse is None and got["0"].session == "2024"
    again = page("Première", "Une").replace("</table>", "<tr><td><b>Question</b></td><td>Seconde</td></tr></table>")
    (row,) = P.parse_pages(spark.createDataFrame([("9", again)], "moncode string, html string"), P.PageLayout("fiche")).collect()
    assert (row.question, row.reponse) == ("Seconde", "Une")


def test_old_unanswered_records_come_back_every_four_weeks(spark):
    days = [dt.date(2031, 1, 6) + dt.timedelta(weeks=w) for w in range(12)]
    df = spark.createDataFrame([(str(code), day) for code in (3, 98, 5501, 70002, 999999) for day in days], "code string, today date")
    never = F.lit(None)
    due = df.where(R.needs_recheck(F.col("code"), F.lit("2019-03-04").cast("date"), never.cast("string"), never.cast("date"), F.col("today")))
    seen = {}
    for r in due.orderBy("today").collect():
        seen.setdefault(r.code, []).append(r.today)
    assert len(seen) == 5
    for found in seen.values():
        assert [(b - a).days for a, b in zip(found, found[1:])] == [28, 28]


def test_refresh_plan_and_merge(spark):
    today = dt.date(2031, 5, 10)
    before = lambda n: today - dt.timedelta(days=n)
    current = spark.createDataFrame(
        [("501", None, before(30), None, None), ("502", None, before(90), "Ancien", before(3)), ("503", None, before(900), "Ancien", before(800)), ("504", None, before(20), None, None), ("505", None, before(40), None, None)],
        "moncode string, legislature string, date_reception date, reponse string, date_reponse date",
    )
    rows = spark.createDataFrame([(c, before(10)) for c in ("501", "502", "503", "505", "601", "602")], "moncode string, date_reception date")
    plan = N.recheck_plan(rows, current, F.lit(today))
    assert {r.moncode: r.action for r in plan.collect()} == {
        "501": "recheck", "502": "recheck", "503": "kept", "504": "kept", "505": "recheck", "601": "candidate", "602": "candidate"
    }
    missing = N.missing_from_index(spark.createDataFrame([("504",)], "moncode string"), rows, current)
    assert [tuple(r) for r in missing.collect()] == [("504", "incomplete_row")]
    planned = plan.where("action <> 'kept'").withColumn("seq", F.col("moncode").cast("int"))
    fetched = spark.createDataFrame(
        [("501", "Relu", None), ("505", None, "question_block_missing"), ("601", "Relu", None), ("602", None, "question_block_missing")], "moncode string, reponse string, reject_reason string"
    ).selectExpr("moncode", "cast(null as string) legislature", "cast(null as date) date_reception", "reponse", "cast(null as date) date_reponse", "reject_reason")
    outcomes = N.fetch_outcomes(planned, fetched)
    kept = current.join(planned.select("moncode"), "moncode", "left_anti")
    got = {r.moncode: (r.origin, r.reponse) for r in N.merged(current.limit(0), kept, current, fetched, outcomes).collect()}
    assert got == {
        "501": ("rechecked", "Relu"), "502": ("previous", "Ancien"), "503": ("kept", "Ancien"), "504": ("kept", None), "505": ("previous", None), "601": ("added", "Relu")
    }
    assert [tuple(r) for r in N.exclusions(outcomes).collect()] == [("602", "question_block_missing")]
    assert N.stopping_outcomes(outcomes).first()[0] == 1


def test_failures_in_a_row_stop_a_run(spark):
    outcomes = ["ok", "network", "network", "ok", "network", "network", "network", "empty"]
    df = spark.createDataFrame([("r", i, o) for i, o in enumerate(outcomes)], "run string, seq int, outcome string")
    for chunk in (2, 100):
        got = N.failure_runs(df, ["run"], F.floor(F.col("seq") / chunk), "seq", 10, 3).orderBy("seq").collect()
        assert [r.in_a_row for r in got] == [0, 1, 2, 0, 1, 2, 3, 0] and [r.stops for r in got].index(True) == 6


def activation(spark, members, passages, config, count, passage_count):
    versions = spark.createDataFrame([("v", False, count, config, T0, None, False)], VERSIONS)
    m = spark.createDataFrame([("v", q, h) for q, h in members], "version_id string, question_id string, content_hash string")
    p = spark.createDataFrame([(h, f"{h}:{i}", "reponse", [0.1] if vector else None, model) for i, (h, vector, model) in enumerate(passages)], STORE)
    e = spark.createDataFrame([("v", passage_count)], "version_id string, passage_count bigint")
    return C.activation_checks(versions, m, p, e).first().verdict


def test_activation_verdicts(spark):
    two = [("Q1", "h1"), ("Q2", "h2")]
    b = "passages-1;m-B;1536"
    assert activation(spark, two, [("h1", True, "m-B"), ("h2", True, "m-B")], b, 2, 2) == "ok"
    assert activation(spark, two, [("h1", True, "m-B"), ("h2", True, "m-A")], b, 2, 2) == "Embedding model mismatch"
    assert activation(spark, two[:1], [("h1", False, "m-B")], b, 1, 1) == "Embedding model mismatch"
    assert activation(spark, two, [("h1", True, "m-B"), ("h1", True, "m-B")], b, 2, 2) == "Question without passage"
    assert activation(spark, two, [("h1", True, "m-B"), ("h2", True, "m-B")], b, 2, 4) == "Incomplete corpus"
    assert activation(spark, two[:1], [("h1", False, None)], "passages-1;sans-embeddings;1536", 1, 1) == "ok"
    assert activation(spark, two, [("h1", True, "m-A"), ("h2", True, "m-B")], None, 2, 2) == "Mixed embedding models"


def test_retention_sentence(spark):
    def summary(rows):
        flagged = spark.createDataFrame(rows, "active boolean, kept boolean, activation_unknown boolean, activated_at timestamp")
        return C.retention_summary(flagged, 2).first().summary

    rollback, unknown, recent, removed = (False, True, False, T0), (False, True, True, None), (False, True, False, None), (False, False, False, None)
    assert summary([rollback] + [unknown] * 4) == (
        "Rétention : 0 version supprimée ; conservé : 1 version pour retour arrière (cible : 2, hors versions récentes protégées), "
        "4 versions antérieures à la migration, jamais supprimée(s)."
    )
    assert summary([removed] * 3 + [rollback] * 2 + [recent]).endswith("protégées), 1 import récent non activé.")


def test_embedding_batches_and_budget(spark):
    items = spark.createDataFrame([(0, "a", 2, 4), (1, "b", 1, 2), (2, "c", 1, 4), (3, "d", 1, 2)], "seq bigint, question_id string, n_inputs int, n_bytes int")
    for inputs, size in ((3, 100), (10, 6)):
        got = [r.batch for r in C.embedding_batches(items, inputs, size).orderBy("seq").collect()]
        assert got == ([0, 0, 1, 1] if inputs == 3 else [0, 0, 1, 1])
    big = spark.createDataFrame([(0, "big", 1, 50), (1, "e", 1, 1)], "seq bigint, question_id string, n_inputs int, n_bytes int")
    assert [r.batch for r in C.embedding_batches(big, 10, 10).orderBy("seq").collect()] == [0, 1]


def test_folds_are_whole_where_a_join_on_their_key_becomes_a_broadcast_at_run_time(spark):
    from quaestor.operators.running import ordered_fold

    def step(state, row):
        state["n"] += 1
        return [(row[0], row[1], state["n"])]

    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {x: spark.conf.get(x, None) for x in names}
    left = spark.range(0, 400, 1, 4).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 400).alias("at"))
    right = spark.range(3).select(F.col("id").alias("k"), F.lit("x").alias("other"))
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        folded = ordered_fold(left.join(right, "k"), ["k"], ["at"], lambda: {"n": 0}, step, "k bigint, at bigint, place bigint").collect()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    expected = [(k, at, place) for k in range(3) for place, at in enumerate(sorted(i * 7 % 400 for i in range(400) if i % 3 == k), 1)]
    assert sorted(map(tuple, folded)) == expected


def test_embedding_batches_are_the_same_for_any_shard_size(spark):
    sizes = [(i, f"Q{i}", 1 + i * i % 7, 10 + i * 37 % 90) for i in range(300)] + [(300, "Q300", 40, 1), (302, "Q302", 1, 5000)]
    items = spark.createDataFrame(sizes, "seq bigint, question_id string, n_inputs bigint, n_bytes bigint")
    expected, inputs, size, batch = [], 0, 0, -1
    for _, _, n, b in sizes:
        if batch < 0 or inputs + n > 9 or size + b > 300:
            batch, inputs, size = batch + 1, 0, 0
        inputs, size = inputs + n, size + b
        expected.append(batch)
    for shard_items in (1, 10, 37, 1000):
        assert [r.batch for r in C.embedding_batches(items, 9, 300, shard_items).orderBy("seq").collect()] == expected
    requests = spark.createDataFrame([("r", i, i, b) for i, b in enumerate((2, 5, 4, 0))], "run string, seq bigint, request_id bigint, n_bytes bigint")
    replay = C.budget_replay(requests, ["run"], ["seq"], 2, 6).orderBy("request_id").collect()
    assert [r.accepted for r in replay] == [True, False, True, False]


def test_growth_log_totals(spark):
    runs = spark.createDataFrame([("2026-09-24 1", "2026-09", 106, 106), ("2026-09-24 2", "2026-09", 0, 106), ("2026-10-01", "2026-10", 300, 400)], "run string, month string, added bigint, logged_total bigint")
    got = N.growth_log(runs).orderBy("run").collect()
    assert [(r.total, r.agrees) for r in got] == [(106, True), (106, True), (406, False)]


def test_files_round_trip(spark, tmp_path):
    record = {"id": "R-1", "moncode": "1", "base": 1, "assemblee": "PRB", "legislature": "2024-2029", "session": None, "type": "q", "numero": 3, "langue": "fr", "titre": "T", "titre_nl": None, "auteur": "A", "destinataire": "M", "date_reception": "2026-01-05", "date_publication": None, "date_reponse": None, "question": "Q ?", "reponse": None, "url_source": "https://records.example.org/1"}
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps({"extrait_le": "x", "nombre_elements": 2, "methode_echantillonnage": "m", "questions": [record, {**record, "id": "R-2"}]}), encoding="utf-8")
    envelope, records = S.read_corpus(spark, str(path))
    assert Q.count_matches(envelope, records).first().ok
    report = {r.rule: r.violations for r in Q.corpus_report(records, HOSTS).collect()}
    assert report["repeated natural key"] == 1 and report["url_source"] == 0 and report["repeated id"] == 0
    root = str(tmp_path / "root")
    S.publish(records.select("id"), root, "corpus", "a")
    S.publish(records.select("id").limit(1), root, "corpus", "b")
    assert S.read_published(spark, root, "corpus").count() == 1
    assert S.read_store(spark, root, "store") is None
    S.append_absent(records.select("id", "titre"), root, "store", ["id"])
    S.append_absent(records.select("id", F.lit("autre").alias("titre")), root, "store", ["id"])
    assert {tuple(r) for r in S.read_store(spark, root, "store").collect()} == {("R-1", "T"), ("R-2", "T")}
    assert S.read_published(spark, root, "corpus", 1).count() == 2  # what the first commit saw
    S.export_records(records, str(tmp_path / "export"))
    assert S.read_records(spark, str(tmp_path / "export")).count() == 2
    snapshot = S.write_snapshot(records.select("moncode"), root, "20260924T121228Z", "missing")
    assert spark.read.parquet(snapshot).first().run_ts == "20260924T121228Z"
    index = tmp_path / "index.json"
    row = ["PRB", "", '<a href="/?moncode=7&base=1">x</a>', "", "", "20/09/2026", "Q", "", "T &amp; U", "N", "A", "M", "", "", "", "1"]
    index.write_text(json.dumps({"data": [row, ["X"] + row[1:], row[:5] + ["31/02/2026"] + row[6:]]}), encoding="utf-8")
    assert [(r.moncode, r.titre) for r in P.index_rows(P.read_index(spark, str(index))).collect()] == [("7", "T & U")]


@pytest.mark.parametrize("name", ["lexical_topk", "recheck_plan", "version_weight", "page_extract", "corpus_round_trip", "published_reports", "random_queries", "seeded_words", "vocabulary_stems", "followup_context"])
def test_registered_queries_match_their_sql(spark, name):
    from __spark_entry__ import oracle_sql, queries
    from tests.compare import compare, duck

    folder = "/root/testdata/sf0.001"
    assert compare(spark, duck(folder), folder, name, queries()[name], oracle_sql()[name]) is None


def test_running_values_keep_rows_of_null_keys(spark):
    from quaestor.operators.running import running

    rows = [(None, 1, 2), (None, 2, 3), ("a", 1, 5), ("a", None, 7)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    got = running(df, ["k"], F.floor(F.col("t") / 2), ["t"], sums={"total": F.col("v")}).collect()
    assert sorted((r.k or "", r.t or 0, r.total) for r in got) == [("", 1, 2), ("", 2, 5), ("a", 0, 7), ("a", 1, 12)]


def test_as_many_random_queries_as_asked(spark):
    from quaestor.operators.evaluation import random_queries

    words = spark.createDataFrame([(w,) for w in "quai rive phare barque filet".split()], "word string")
    got = {r.query_id: r.text for r in random_queries(words, 40, 3).collect()}
    assert sorted(got) == list(range(40)) and all(1 <= len(set(t.split())) == len(t.split()) <= 4 for t in got.values())
    assert got == {r.query_id: r.text for r in random_queries(words.repartition(3), 40, 3).collect()}
    assert random_queries(words.limit(0), 5, 3).count() == 0


def test_a_long_secret_stands_as_its_digest(spark):
    import hmac

    from quaestor.functions.records import pseudonym

    for secret in ("short", "x" * 64, "long secret " * 20):
        got = spark.range(1).select(pseudonym(F.lit("visitor"), secret)).first()[0]
        assert got == hmac.new(secret.encode(), b"visitor", "sha256").hexdigest()


def test_the_lost_passage_is_one_of_the_active_version(spark, tmp_path):
    from quaestor.plans.catalog import _without_a_passage
    from quaestor.sources.loading import load_version

    schema = "question_id string, titre string, auteur string, destinataire string, question string, reponse string"
    texts = ("Ceci.", "Cela.")
    # Whichever text has the smaller hash, it is the former one in one of the two orders.
    for i, order in enumerate((texts, texts[::-1])):
        root, verdicts = str(tmp_path / str(i)), []
        for name, text in (("a", order[0]), ("b", order[1]), ("c", order[1])):
            if name == "c":
                _without_a_passage(spark, root)
            rows = spark.createDataFrame([("R-1", "T", None, "M", "Quoi ?", text)], schema)
            verdicts.append(load_version(rows, root, name, "m", F.lit(T0), "substitut", 4).first().verdict)
        assert verdicts == ["ok", "ok", "Incomplete corpus"]


def test_a_load_may_run_again(spark, tmp_path):
    from quaestor.sources.loading import load_version, version_members

    schema = "question_id string, titre string, auteur string, destinataire string, question string, reponse string"
    records = spark.createDataFrame([("R-1", "T", None, "M", "Quoi ?", "Ceci."), ("R-2", None, "A", None, "Qui ?", None)], schema)
    root, at = str(tmp_path), F.lit(T0)
    assert [load_version(records, root, "a", "m", at, "substitut", 4).first().verdict for _ in range(2)] == ["ok", "ok"]
    assert load_version(records.limit(0), root, "none", "m", at).count() == 1
    log = CommitLog(spark, root)
    folder = log.folder("data/passages")
    S.read_store(spark, root, "passages").where("section = 'question'").write.parquet(f"{root}/{folder}")
    log.commit(lambda _, state: {**state, "stores": {**state["stores"], "passages": {**state["stores"]["passages"], "folders": [folder]}}})
    refused = load_version(records, root, "b", "m", at, "substitut", 4).first()
    assert (refused.verdict, refused.n_passages) == ("Incomplete corpus", 2)
    assert S.read_store(spark, root, "documents").count() == 2
    assert version_members(spark, root).where("version_id = 'a'").count() == 2
    versions = {r.version_id: r.active for r in S.read_published(spark, root, "versions").collect()}
    assert set(versions) == {"a", "none", "b"} and not versions["b"]


def test_writers_that_meet_lose_nothing(spark, tmp_path):
    """Eight writers at once, each with keys of its own and keys of all; every commit sees those before it."""
    root = str(tmp_path)
    log = CommitLog(spark, root)

    def write(i):
        rows = spark.range(40).where(F.col("id") < 5).unionByName(spark.range(100 * i + 100, 100 * i + 110)).withColumn("writer", F.lit(i))
        return S.append_absent(rows, root, "rows", ["id"])

    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(write, range(8)))
    assert sorted(numbers) == list(range(1, 9)) and log.latest() == 8
    ids = [r.id for r in S.read_store(spark, root, "rows").collect()]
    assert len(ids) == len(set(ids)) == 85
    assert S.read_store(spark, root, "rows", 3).count() == 35
    with pytest.raises(Conflict):
        log.create(8, {})
    assert log.commit(lambda number, state: None) == 8


def test_replay_in_rounds_equals_one_request_after_the_other(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 40), i, rng.choice([5, 20, 60, 150])) for i in range(300)] + [("large", 1, 900, 500), ("one", 1, 901, 100)]
    requests = spark.createDataFrame(rows, "run string, seq long, request_id long, n_bytes long").repartition(4)
    expected, state = {}, {}
    for run, seq, request, size in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        calls, used = state.get(run, (0, 0))
        fits = calls < 7 and used + size <= 200
        state[run] = (calls + fits, used + size * fits)
        expected[request] = (fits, *state[run])
    got = {r.request_id: (r.accepted, r.used_calls, r.used_bytes) for r in C.budget_replay(requests, ["run"], ["seq"], 7, 200).collect()}
    assert got == expected
    assert C.budget_replay(requests.limit(0), ["run"], ["seq"], 7, 200).count() == 0
    assert not any(r.accepted for r in C.budget_replay(requests, ["run"], ["seq"], 7, 1).collect())


RUN_LIMITS = {"max_records": 100, "max_downloads": 50, "max_network_failures": 4, "max_empty_texts": 2, "max_missing": 3, "in_a_row": 3, "asked": 5}


def run_by_hand(attempts, n_current, n_missing, limits):
    """One page after the other, as a collector reads them."""
    if n_current > limits.max_records:
        return ["refused: records"] * len(attempts)
    if n_missing > limits.max_missing:
        return ["refused: missing from index"] * len(attempts)
    if sum(a == "recheck" for a, _ in attempts) > limits.max_downloads:
        return ["refused: rechecks"] * len(attempts)
    out, downloads, added, postponed, row, emptied, blockless = [], 0, 0, 0, 0, 0, 0
    for action, outcome in attempts:
        if action == "candidate" and (added >= min(limits.asked, limits.max_records - n_current) or downloads >= limits.max_downloads):
            break
        stop = None
        if outcome == "network":
            postponed, row = postponed + 1, row + 1
            stop = "network failures" if postponed > limits.max_network_failures or row >= limits.in_a_row else None
        else:
            downloads, row = downloads + 1, 0
            if action == "recheck" and outcome == "question_text_empty":
                emptied += 1
                stop = "empty texts" if emptied > limits.max_empty_texts else None
            elif outcome == "question_block_missing":
                blockless += action == "candidate"
                stop = "page of another structure" if action == "recheck" else "pages without a question" if blockless > limits.max_empty_texts else None
            elif action == "candidate" and outcome == "ok":
                added += 1
        out.append(f"stops: {stop}" if stop else "read")
        if stop:
            break
    return out + ["not reached"] * (len(attempts) - len(out))


@pytest.mark.parametrize("seed", range(8))
def test_a_refresh_stops_or_ends_as_page_after_page(spark, seed):
    import random

    rng = random.Random(seed)
    weights = [[20, 1, 1, 1], [40, 1, 0, 0], [6, 3, 0, 0], [10, 0, 4, 0], [10, 0, 0, 4], [10, 1, 1, 0], [30, 0, 0, 0], [9, 1, 0, 2]][seed]
    kinds = ("ok", "network", "question_text_empty", "question_block_missing")
    attempts = [("recheck", rng.choices(kinds, [*weights[:3], 0])[0]) for _ in range(rng.randint(0, 30))]
    attempts += [("candidate", rng.choices(kinds, weights)[0]) for _ in range(rng.randint(0, 40))]
    limits = N.RefreshLimits(**{**RUN_LIMITS, "max_downloads": [50, 12, 50, 50, 50, 8, 50, 50][seed]})
    rows = spark.createDataFrame([(3 * i, str(i), a, o) for i, (a, o) in enumerate(attempts)], "seq long, moncode string, action string, outcome string").repartition(3)
    current = [60, 97, 60, 60, 60, 60, 101, 60][seed]
    found = N.refresh_run(rows, F.lit(current), F.lit(2), limits, chunk=10)
    assert [r.state for r in found.orderBy("seq").collect()] == run_by_hand(attempts, current, 2, limits)


def test_limits_of_a_refresh_are_checked():
    for wrong in ({"asked": 801}, {"asked": -1}, {"max_records": 0}, {"max_missing": -1}):
        with pytest.raises(ValueError):
            N.RefreshLimits(**wrong)


def test_a_later_load_moves_no_text_to_find_what_is_new(spark, tmp_path, monkeypatch):
    """What is new is told by its digests; repeated rows and rows without an id or texts are loaded as they are."""
    from quaestor.sources import loading

    schema = "question_id string, titre string, auteur string, destinataire string, question string, reponse string"
    rows = [("R-1", "T", None, "M", "Quoi ?", "Ceci."), ("R-1", "T", None, "M", "Quoi ?", "Ceci."), (None, None, None, None, None, None)]
    later = [*rows, ("R-2", "T", "A", "M", "Qui ?", "Cela.")]
    plans, whole = [], loading.append_absent

    def told(new, root, name, keys):
        plans.append(new._jdf.queryExecution().optimizedPlan().toString())
        return whole(new, root, name, keys)

    monkeypatch.setattr(loading, "append_absent", told)
    for name, part in (("a", rows), ("b", later)):
        loading.load_version(spark.createDataFrame(part, schema), str(tmp_path), name, "m", F.lit(T0))
    assert len(plans) == 4 and all("LeftAnti" not in x for x in plans)
    assert sorted(str(r.question_id) for r in S.read_store(spark, str(tmp_path), "documents").collect()) == ["None", "R-1", "R-2"]
    assert loading.version_members(spark, str(tmp_path)).where("version_id = 'b'").count() == 4
