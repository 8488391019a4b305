"""Every registered query: one callable (spark, folder) → DataFrame per operator or job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaestor import fixed_values as V
from quaestor.functions import records as R
from quaestor.functions import text as T
from quaestor.functions import vectors as X
from quaestor.functions.html import html_text
from quaestor.operators import answers as A
from quaestor.operators import digest_tree as M
from quaestor.operators import evaluation as E
from quaestor.operators import lexical as L
from quaestor.operators import quality as Q
from quaestor.operators import quota as U
from quaestor.operators import ranking as K
from quaestor.operators import refresh as N
from quaestor.operators import stored_index as I
from quaestor.operators import versions as C
from quaestor.operators.passages import passages, weighted_words
from quaestor.operators.semantic import nearest_passages, similar_passages
from quaestor.plans.search import Vectors, match, mixed_search, ranked_documents, search, search_index, selected_passages, words_per_query
from quaestor.session import materialised, shared_folder
from quaestor.sources import corpus_files as S
from quaestor.sources import driver_tables as D
from quaestor.sources import index_pages as P
from quaestor.sources.commit_log import CommitLog
from quaestor.sources.loading import active_records, load_version, version_members

DIMENSIONS = 64
PAGE_HOSTS = ("ththin.example.com", "therin.example.net", "blog.ththan.example.net", "m.therou.example.com", "www.ththin.example.net")
SELECTIONS = (("dossiers 1", "dossier 1[0-9]* ", "1994-1999"), ("vraag 99", "vraag over dossier .*99", "1999-2004"))
LAYOUT = P.PageLayout("record-fr", "https://records.example.org/detail?code=", "&base=1")
QUOTA_LIMITS = U.Limits(session_hourly=1, daily_ai=40, ip_daily_ai=3)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def day(column: str) -> Column:
    """Dates are returned as text, whatever the engine that reads them."""
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def six(column: str) -> Column:
    return F.round(column, V.SCORE_DECIMALS).alias(column)


def joined(column: str | Column, separator: str = "|") -> Column:
    return F.array_join(column, separator)


def today() -> Column:
    return F.lit(D.TODAY).cast("date")


def now() -> Column:
    return F.lit(D.NOW).cast("timestamp")


# --- Sources ------------------------------------------------------------------


@query
def index_scan(spark, folder):
    rows = P.most_recent_first(P.index_rows(D.index_file_rows(spark, folder)))
    return rows.select("moncode", day("date_reception"), "titre", "titre_nl", "auteur", "destinataire")


@query
def envelope_scan(spark, folder):
    """The index written as envelopes of one JSON object each, two or more as the index grows, and read back in byte ranges."""
    path = shared_folder(spark, "envelopes")
    S.write_envelopes(D.index_file_rows(spark, folder), path, 2)
    rows = P.index_rows(P.read_index(spark, path))
    return rows.select("moncode", day("date_reception"), "titre", "titre_nl", "auteur", "destinataire")


@query
def sample_per_author(spark, folder):
    rows = P.sample_per_author(P.index_rows(D.index_file_rows(spark, folder)), "2000-06-30")
    return rows.select("moncode", day("date_reception"), "auteur")


@query
def index_stats(spark, folder):
    return P.index_statistics(D.index_file_rows(spark, folder))


@query
def page_text(spark, folder):
    pages = D.text_table(spark, folder, "pages")
    return pages.select("page_id", html_text(F.col("html")).alias("text"))


@query
def page_extract(spark, folder):
    parsed = P.parse_pages(D.record_pages(spark, folder), LAYOUT)
    return parsed.select(
        "moncode", "id", "url_source", "session", F.coalesce("numero", F.lit(-1)).alias("numero"), day("date_publication"),
        "question", "reponse", "empreinte_contenu", "reject_reason", joined(P.pdf_links(F.col("html"))).alias("pdf_links"),
    )


@query
def page_acts(spark, folder):
    """Rows of five cells, from orders written as table rows."""
    orders = D.table(spark, folder, "orders")
    cells = [F.date_format("o_orderdate", "dd/MM/yyyy"), "o_orderstatus", F.when(F.col("o_totalprice") > 250000, F.col("o_orderpriority")).otherwise(""), F.lit("a"), F.lit("b")]
    row = F.concat(F.lit("<table><tr><td>x</td></tr><tr>"), *[F.concat(F.lit("<td> "), c, F.lit("</td>")) for c in cells], F.lit("</tr></table>"))
    acts = P.procedural_acts(orders.select("o_orderkey", row.alias("html")), "o_orderkey", "html")
    return acts.select("o_orderkey", "position", day("date"), "acte", "acteur")


@query
def extraction_fidelity(spark, folder):
    return P.fidelity(D.records(spark, folder), D.record_pages(spark, folder))


# --- Record functions ---------------------------------------------------------


@query
def url_rule(spark, folder):
    pages = D.table(spark, folder, "pages")
    return pages.select("page_id", R.official_url(F.col("url"), PAGE_HOSTS).alias("official_url"))


@query
def fold_accents(spark, folder):
    documents = D.text_table(spark, folder, "documents")
    return documents.select("doc_id", T.fold_accents(F.col("text")).alias("folded"), T.search_words(F.col("text")).alias("searched"))


@query
def word_tokens(spark, folder):
    documents = D.text_table(spark, folder, "documents").select("doc_id", T.query_words(F.col("text")).alias("words"), T.index_words(F.col("text")).alias("indexed"))
    return documents.select(
        "doc_id",
        F.size("words").alias("n_words"),
        joined(F.array_sort(F.array_distinct("words")), " ").alias("tokens"),
        joined("indexed", " ").alias("indexed"),
    )


@query
def vocabulary_stems(spark, folder):
    return L.vocabulary(D.records(spark, folder))


def _derived_answers(spark, folder):
    """Documents preceded by one of six openings, to meet every rule on answers."""
    openings = (
        "Aucune des questions ne relève de mes attributions. ", "Cela NE RELÈVENT PAS de la compétence du ministre. ",
        "Je vous renvoie au site. ", "Voir la réponse à la question 12. ", "Veuillez adresser toutes vos questions à ma collègue. ", "",
    )
    opening = F.element_at(F.array(*[F.lit(o) for o in openings]), (F.pmod("doc_id", F.lit(6)) + 1).cast("int"))
    return D.records(spark, folder).select("doc_id", F.concat(opening, F.col("reponse")).alias("reponse"))


@query
def nature(spark, folder):
    return _derived_answers(spark, folder).select("doc_id", R.nature(F.col("reponse")).alias("nature"))


@query
def latest_date(spark, folder):
    current = D.current_records(spark, folder)
    latest = R.latest_date(F.col("date_reception"), F.col("date_publication"), F.col("date_reponse"))
    return current.select("moncode", F.date_format(latest, "yyyy-MM-dd").alias("latest"))


@query
def display_labels(spark, folder):
    rows = P.index_rows(D.index_file_rows(spark, folder))
    label = R.date_label(F.when(F.day("date_reception") > 2, F.col("date_reception")))
    return rows.select("moncode", R.short_title(F.col("titre")).alias("short_title"), label.alias("date_label"))


@query
def legislature_names(spark, folder):
    short = F.concat_ws("-", F.date_format("o_orderdate", "yy"), F.date_format(F.add_months("o_orderdate", 60), "yy"))
    orders = D.table(spark, folder, "orders")
    return orders.select("o_orderkey", R.full_legislature(short).alias("legislature"))


@query
def index_config(spark, folder):
    customers = D.table(spark, folder, "customer")
    model = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("modele-"), F.pmod("c_custkey", F.lit(3)).cast("string")))
    dimensions = F.when(F.pmod("c_custkey", F.lit(5)) == 0, "3072").otherwise("1536")
    config = F.when(F.pmod("c_custkey", F.lit(7)) > 0, F.regexp_replace(R.index_config(model), "1536$", dimensions))
    return customers.select(
        "c_custkey", config.alias("config"), R.query_model(config, F.lit("modele-ancien")).alias("query_model")
    )


@query
def content_hash(spark, folder):
    record = F.struct("question_id", "moncode", "titre", "auteur", "destinataire", "question", "reponse", "url_source")
    config = R.index_config(F.lit("modele-1"))
    return D.records(spark, folder).select("question_id", R.content_hash(record, config).alias("content_hash"))


@query
def passage_record_ids(spark, folder):
    parts = passages(D.records(spark, folder)).select("passage_id")
    return parts.select("passage_id", R.passage_record(F.col("passage_id")).alias("question_id"))


@query
def corpus_validation(spark, folder):
    return Q.corpus_report(D.records(spark, folder).withColumns({"base": F.lit(1), "langue": F.col("auteur")}), D.RECORD_HOSTS)


@query
def record_violations(spark, folder):
    records = D.records(spark, folder).withColumn("langue", F.col("auteur"))
    return Q.validated(records, D.RECORD_HOSTS).select("question_id", joined("violations").alias("violations"))


@query
def record_fields(spark, folder):
    """Every record as a JSON line, in 19 of 20 of which one field is missing, null or a list; the fields that break their type."""
    fixed = {"base": F.lit(1), "assemblee": F.lit("PRB"), "legislature": F.lit("2024-2029"), "session": F.lit(None).cast("string"), "type": F.lit("1"),
             "langue": F.lit("fr"), "titre_nl": F.lit("titel"), "date_publication": F.lit(None).cast("date")}
    records = D.records(spark, folder).withColumn("id", F.col("question_id")).withColumn("numero", F.col("doc_id") % 1000).withColumns(fixed)
    fragments = []
    for number, (name, _) in enumerate(V.RECORD_FIELDS):
        whole = F.expr(f"substring(to_json(struct({name}), map('ignoreNullFields', 'false')), 2)")
        spoiled = F.when(F.floor(F.col("doc_id") / 20) % 3 == 1, F.lit(f'"{name}":null')).when(F.floor(F.col("doc_id") / 20) % 3 == 2, F.lit(f'"{name}":[1]'))
        fragments.append(F.when(F.col("doc_id") % 20 == number, spoiled).otherwise(F.regexp_replace(whole, r"\}$", "")))
    line = F.concat(F.lit("{"), F.concat_ws(",", *fragments), F.lit("}"))
    return Q.typed_fields(records.select("question_id", line.alias("line"))).select("question_id", joined("violations").alias("violations"))


@query
def query_rules(spark, folder):
    turns = D.table(spark, folder, "conversations")
    asked = turns.groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("text"), F.collect_list(F.when(F.col("role") == "user", F.col("text"))).alias("history")
    )
    return Q.checked_queries(asked).select("conv_id", joined("violations").alias("violations"))


@query
def pseudonyms(spark, folder):
    events = D.table(spark, folder, "events").select(F.col("user_id").cast("string").alias("session")).distinct()
    return events.select("session", R.pseudonym(F.col("session"), "clef").alias("pseudonym"), R.pseudonym(F.col("session"), "une autre clef").alias("other"))


@query
def time_stamps(spark, folder):
    ts = F.col("ts").cast("timestamp")
    return D.table(spark, folder, "events").select(
        "event_id", R.hour_stamp(ts).alias("hour"), R.day_stamp(ts).alias("day"), R.run_stamp(ts).alias("run")
    )


@query
def failure_codes(spark, folder):
    logs = D.table(spark, folder, "events").select(
        F.when(F.col("event_type") == "error", F.upper("event_type")).when(F.col("event_type") == "view", "QUOTA_UNAVAILABLE").otherwise(F.col("event_type")).alias("message")
    )
    return E.outcome_counts(logs)


# --- Passages and index -------------------------------------------------------


@query
def passage_split(spark, folder):
    return passages(D.records(spark, folder)).select("passage_id", "question_id", "section", "position", "content")


@query
def search_text(spark, folder):
    return passages(D.records(spark, folder)).select("passage_id", "search_text")


@query
def passage_sizes(spark, folder):
    parts = passages(D.records(spark, folder))
    return parts.groupBy("question_id").agg(F.count("*").alias("n_inputs"), F.sum(F.octet_length("search_text")).alias("n_bytes"))


@query
def passage_words(spark, folder):
    return weighted_words(passages(D.records(spark, folder)))


@query
def format_fingerprint(spark, folder):
    return Q.format_fingerprint(passages(D.records(spark, folder)))


@query
def postings(spark, folder):
    return L.postings(D.records(spark, folder), stemmed=False)


@query
def document_frequency(spark, folder):
    records = D.records(spark, folder)
    n_records = L.answered(records).agg(F.count("*").alias("n")).scalar()
    return L.document_frequency(L.postings(records, stemmed=False), n_records).select("term", "df", six("idf"))


@query
def postings_stemmed(spark, folder):
    return L.postings(D.records(spark, folder))


@query
def query_terms(spark, folder):
    return L.lexical_query(L.query_terms(D.queries(spark, folder), stemmed=False))


@query
def query_lexemes(spark, folder):
    asked = L.lexical_query(L.query_terms(D.queries(spark, folder), stemmed=False))
    plain = F.replace(F.substring("lexical_query", 1, V.MAX_QUERY_CHARS), F.lit(" OR "), F.lit(" "))
    return asked.select("query_id", joined(F.array_sort(F.array_distinct(T.index_words(T.search_words(plain)))), " ").alias("lexemes"))


@query
def query_expansion(spark, folder):
    """Texts that call for synonyms: conversation turns followed by a word of each rule in turn."""
    word = F.element_at(F.array(*[F.lit(w) for w in ("", " la chaleur", " un Métro", " les élections", " autobus")]), (F.pmod("turn", F.lit(5)) + 1).cast("int"))
    turns = D.table(spark, folder, "conversations").withColumn("text", F.concat("text", word))
    return turns.select("conv_id", "turn", T.expanded(F.col("text")).alias("expanded"))


# --- Search -------------------------------------------------------------------


def _search_inputs(spark, folder):
    records, queries = D.records(spark, folder), D.queries(spark, folder)
    return records, queries, queries.count()


def _vectors(spark, folder, queries):
    asked = D.query_vectors(spark, folder).join(queries.select("query_id"), "query_id", "left_semi")
    return Vectors(D.record_vectors(spark, folder), asked, DIMENSIONS)


@query
def lexical_topk(spark, folder):
    records, queries, n = _search_inputs(spark, folder)
    terms = materialised(L.query_terms(queries, stemmed=False))
    best = K.top_lexical(L.lexical_scores(records, terms, n))
    return best.select("query_id", "question_id", six("lexical"), six("score"), "leader")


@query
def lexical_search(spark, folder):
    records, queries, n = _search_inputs(spark, folder)
    return search(records, queries, stemmed=False, n_queries=n, filtered=False).select(
        "query_id", "hit_rank", "passage_id", "question_id", "position", six("score")
    )


@query
def relevance_filter(spark, folder):
    records, queries, n = _search_inputs(spark, folder)
    return search(records, queries, stemmed=False, n_queries=n).select("query_id", "hit_rank", "passage_id", six("score"))


@query
def lexical_search_stemmed(spark, folder):
    records, queries, n = _search_inputs(spark, folder)
    return search(records, queries, n_queries=n).select("query_id", "hit_rank", "passage_id", six("score"))


@query
def clamped_selection(spark, folder):
    """Records selected for limits below, within and above what a search returns."""
    records, queries, n = _search_inputs(spark, folder)
    asked = queries.withColumn("limit", F.element_at(F.array(*[F.lit(x) for x in (-2, 0, 1, 3, 8, 50)]), (F.pmod("query_id", F.lit(6)) + 1).cast("int")))
    best = ranked_documents(records, asked, materialised(L.query_terms(asked, stemmed=False)), n)
    return K.select_documents(best, asked).select("query_id", "question_id", "document_rank", F.col("_limit").alias("allowed"))


@query
def indexed_search(spark, folder):
    """The stemmed search from a stored index, written by this job."""
    records, queries, n = _search_inputs(spark, folder)
    index = I.build_index(records, shared_folder(spark, "index"), "v1")
    return search_index(index, queries, n).select("query_id", "hit_rank", "passage_id", six("score"))


def _changed_records(records):
    """Records as a later version has them: a seventh left, an eleventh has a longer answer, a thirteenth none, a few are new."""
    n = F.col("doc_id")
    answer = F.when(n % 13 == 0, F.lit(None)).when(n % 11 == 0, F.concat("reponse", F.lit("\nComplément publié plus tard."))).otherwise(F.col("reponse"))
    kept = records.where(n % 7 != 0).withColumn("reponse", answer)
    new = records.where(n % 17 == 0).withColumn("question_id", F.concat(F.lit("N-"), n))
    return kept.unionByName(new)


@query
def index_after_refresh(spark, folder):
    """Records of each term after the index of one version was brought to the next by their difference."""
    records, root = D.records(spark, folder), shared_folder(spark, "index")
    I.build_index(records, root, "v1")
    index = I.refresh_index(_changed_records(records), root, "v2")
    found = index.entries().groupBy("term").agg(F.count("*").alias("entries"), F.sum(F.col("in_title").cast("long")).alias("in_titles"))
    return index.frequencies().join(found, "term", "full").select("term", "df", "entries", "in_titles", F.lit(index.n_records).cast("long").alias("n_records"))


@query
def occurrence_rank(spark, folder):
    records, queries, n = _search_inputs(spark, folder)
    terms = materialised(L.query_terms(queries, stemmed=False))
    selected = K.select_documents(ranked_documents(records, queries, terms, n), queries)
    found = selected_passages(selected, records, words_per_query(terms, None, "wanted"), None, n)
    return K.best_passages(found).select("query_id", "passage_id", "occurrences", "passage_rank")


def _similar(spark, folder):
    records, queries, n = _search_inputs(spark, folder)
    vectors = _vectors(spark, folder, queries)
    searched = vectors.passages.join(L.answered(records).select("question_id"), "question_id", "left_semi")
    return similar_passages(searched, vectors.queries, n, DIMENSIONS)


@query
def cosine_topk(spark, folder):
    records, queries, n = _search_inputs(spark, folder)
    vectors = _vectors(spark, folder, queries)
    searched = vectors.passages.join(L.answered(records).select("question_id"), "question_id", "left_semi")
    best, _ = nearest_passages(searched, vectors.queries, n, DIMENSIONS)
    return best.select("query_id", "hit_rank", "question_id", "passage_id", six("similarity"))


@query
def rrf_hybrid(spark, folder):
    records, queries, n = _search_inputs(spark, folder)
    terms = materialised(L.query_terms(queries, stemmed=False))
    best = ranked_documents(records, queries, terms, n, vectors=_vectors(spark, folder, queries))
    return best.select(
        "query_id", "question_id", F.coalesce("lexical_rank", F.lit(0)).alias("lexical_rank"), F.coalesce("semantic_rank", F.lit(0)).alias("semantic_rank"), six("score"), "leader"
    )


@query
def hybrid_search(spark, folder):
    records, queries, n = _search_inputs(spark, folder)
    hits = search(records, queries, _vectors(spark, folder, queries), stemmed=False, n_queries=n)
    return hits.select("query_id", "hit_rank", "passage_id", "question_id", "position", six("score"))


@query
def mixed_mode_search(spark, folder):
    records, queries, n = _search_inputs(spark, folder)
    flagged = queries.withColumn("use_vectors", F.length("text") > 200)
    hits = mixed_search(records, flagged, _vectors(spark, folder, queries), stemmed=False, n_queries=n)
    return hits.select("query_id", "hit_rank", "passage_id", six("score"))


@query
def linear_ranker(spark, folder):
    records, queries, n = _search_inputs(spark, folder)
    parts = passages(L.answered(records)).where(F.col("section") == "reponse")
    words = parts.select("question_id", "passage_id", T.index_words(F.col("search_text")).alias("words")).select(
        "question_id", "passage_id", F.explode_outer("words").alias("word")
    )
    terms = materialised(L.query_terms(queries, stemmed=False)).select("query_id", F.col("term").alias("word"))
    counted = L.hot_join(words, terms, ["word"], "passage_id", n * V.MAX_QUERY_TERMS, L.TERM_ROW_BYTES).groupBy(
        "query_id", "question_id", "passage_id"
    ).agg(F.count("*").alias("occurrences"))
    scored = counted.join(_similar(spark, folder), ["query_id", "question_id", "passage_id"], "full")
    return K.linear_ranking(scored).select("query_id", "hit_rank", "passage_id", six("relevance"))


@query
def substitute_vectors(spark, folder):
    parts = passages(D.records(spark, folder)).select("passage_id", X.substitute_vector(F.col("search_text"), 8).alias("v"))
    return parts.select("passage_id", joined(F.transform("v", lambda x: F.format_number(x, 5))).alias("vector"), F.round(X.norm(F.col("v")), 6).alias("length"))


@query
def vector_checks(spark, folder):
    store = D.passage_store(spark, folder)
    usable = X.usable_vector(F.col("embedding"), F.col("embedding_model"), F.lit("m-A"), DIMENSIONS)
    return store.groupBy(F.coalesce("embedding_model", F.lit("-")).alias("model")).agg(
        F.count("*").alias("passages"), F.count_if(usable).alias("usable")
    )


# --- Conversations and answers ------------------------------------------------


def _turns(spark, folder):
    """Conversation turns, some of them opened as follow-ups or as questions on a named topic."""
    openings = ("", "", "Et quand ? ", "Pourquoi ", "Selon la réponse ministérielle, ", "Au sujet de ")
    opening = F.element_at(F.array(*[F.lit(o) for o in openings]), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6)) + 1).cast("int"))
    turns = D.table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    whole = turns.withColumn("text", F.concat(opening, "text"))
    # Beside the whole turns conversations of short and empty ones, under numbers of their own.
    remainder = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6))
    short = F.when(remainder == 3, F.substring_index("text", " ", 3)).when(remainder == 2, F.lit("")).otherwise(F.col("text"))
    return whole.unionByName(turns.select((-1 - F.col("conv_id")).alias("conv_id"), "turn", "role", F.concat(opening, short).alias("text")))


@query
def followup_context(spark, folder):
    return A.conversation_queries(_turns(spark, folder)).select("conv_id", "turn", "followup", "query")


def _hits(spark, folder):
    records, queries, n = _search_inputs(spark, folder)
    return records, queries, materialised(search(records, queries, stemmed=False, n_queries=n))


@query
def context_expansion(spark, folder):
    records, queries, n = _search_inputs(spark, folder)
    hits = materialised(search(records, queries, n_queries=n))
    chosen = records.join(hits.select("question_id").distinct(), "question_id", "left_semi")
    return A.context_hits(hits, passages(chosen), queries).select("query_id", "context_rank", "passage_id", "origin")


@query
def source_groups(spark, folder):
    records, queries, hits = _hits(spark, folder)
    found = A.extractive_answers(hits, queries, records, D.RECORD_HOSTS)
    return found.select(
        "query_id", "mode", "status", "notice",
        joined(F.transform("paragraphs", lambda p: p["text"])).alias("paragraphs"),
        joined(F.transform("sources", lambda s: s["id"])).alias("source_ids"),
        joined(F.transform("sources", lambda s: s["url"])).alias("urls"),
        joined(F.transform("sources", lambda s: s["nature"])).alias("natures"),
    )


@query
def excerpts(spark, folder):
    records, queries, hits = _hits(spark, folder)
    focus = queries.select("query_id", F.array(F.array_distinct(T.query_words(F.col("text")))).alias("focuses"))
    cut = A.with_excerpts(hits.join(focus, "query_id"))
    return cut.select("query_id", "passage_id", F.posexplode("excerpts").alias("n", "excerpt"))


def _generated(spark, folder, queries, hits):
    """Generated answers written from the hits: valid ones and one kind of mistake in turn."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("hit_rank", "passage_id"))), lambda x: x["passage_id"])
    cited = queries.join(hits.groupBy("query_id").agg(ids.alias("ids")), "query_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    kind = F.pmod("query_id", F.lit(6))
    extra = F.when(kind == 1, F.array(F.lit("inconnu"))).when(kind == 2, F.array().cast("array<string>")).otherwise(F.slice("ids", 1, 1))
    text = F.when(kind == 3, "  ").otherwise(F.col("text"))
    paragraphs = F.array(
        F.struct(text.alias("text"), F.slice("ids", 1, 2).alias("sourceIds")), F.struct(F.lit("Second point.").alias("text"), extra.alias("sourceIds"))
    )
    return cited.select(
        "query_id",
        F.when(kind == 4, "insuffisant").when(kind == 5, F.when(F.size("ids") > 3, "autre").otherwise("documente")).otherwise("documente").alias("status"),
        paragraphs.alias("paragraphs"),
        F.lit("").alias("limits"),
    )


@query
def citation_check(spark, folder):
    records, queries, hits = _hits(spark, folder)
    return A.citation_checks(_generated(spark, folder, queries, hits), hits)


@query
def generated_answers(spark, folder):
    records, queries, hits = _hits(spark, folder)
    generated = _generated(spark, folder, queries, hits)
    found = A.generated_answers(generated, A.citation_checks(generated, hits), hits, records, D.RECORD_HOSTS)
    return found.select(
        "query_id", "mode", "status",
        joined(F.transform("paragraphs", lambda p: F.concat_ws(" > ", p["text"], joined(p["sourceIds"], ",")))).alias("paragraphs"),
        joined(F.transform("sources", lambda s: s["id"])).alias("source_ids"),
    )


@query
def fallback_answers(spark, folder):
    """Passages that stand in for rejected syntheses of hybrid hits: of a fresh lexical search, and of the filtered hits where there is none."""
    records, queries, fresh = _hits(spark, folder)
    hybrid = search(records, queries, _vectors(spark, folder, queries), stemmed=False, n_queries=queries.count(), filtered=True)
    hybrid = materialised(hybrid)
    checks = materialised(A.citation_checks(_generated(spark, folder, queries, hybrid), hybrid))
    with_fresh = A.fallback_hits(checks, fresh, hybrid).select(F.lit("fresh").alias("kind"), "query_id", "passage_id")
    return with_fresh.unionByName(A.fallback_hits(checks, None, hybrid).select(F.lit("filtered").alias("kind"), "query_id", "passage_id"))


@query
def response_contract(spark, folder):
    """Extractive answers, some with a field spoiled, against the response contract."""
    records, queries, hits = _hits(spark, folder)
    found = A.extractive_answers(hits, queries, records, D.RECORD_HOSTS).withColumn("request_id", F.col("query_id").cast("string"))
    kind = F.pmod("query_id", F.lit(5))
    spoiled = found.withColumns(
        {
            "mode": F.when(kind == 1, "autre").otherwise(F.col("mode")),
            "notice": F.when(kind == 2, F.lit(None)).otherwise(F.col("notice")),
            "sources": F.when(kind == 3, F.transform("sources", lambda s: s.withField("url", F.replace(s["url"], F.lit("https"), F.lit("http")))))
            .when(kind == 4, F.transform("sources", lambda s: s.withField("excerpts", F.array().cast("array<string>"))))
            .otherwise(F.col("sources")),
        }
    )
    return Q.checked_responses(spoiled).select("query_id", joined("violations").alias("violations"))


# --- Versions -----------------------------------------------------------------


@query
def dedup_store(spark, folder):
    members = D.version_members(spark, folder)
    documents = D.doc_store(spark, folder).select("content_hash", F.col("titre").alias("document"))
    store = D.passage_store(spark, folder).select("content_hash", "passage_id", "embedding")
    copies = members.join(documents, "content_hash")
    passage_copies = members.join(store, "content_hash")
    docs, parts, refs = C.deduplicated(copies, passage_copies)
    per_record = parts.groupBy("question_id").agg(F.count("*").alias("passages"), F.count_if(F.col("embedding").isNotNull()).alias("embedded"))
    return docs.groupBy("question_id").agg(F.count("*").alias("contents")).join(per_record, "question_id", "left").join(
        refs.groupBy("question_id").agg(F.count("*").alias("refs")), "question_id"
    ).select("question_id", "contents", "refs", F.coalesce("passages", F.lit(0)).alias("passages"), F.coalesce("embedded", F.lit(0)).alias("embedded"))


@query
def compatibility_view(spark, folder):
    store = D.doc_store(spark, folder).select("content_hash", F.col("titre").alias("document"))
    return C.compatibility_view(D.version_members(spark, folder), store).select("version_id", "question_id", "document")


def _items(spark, folder):
    """Wanted contents (content_hash, question_id, n_passages) of a new import with model m-A."""
    parts = passages(D.stored_records(spark, folder), "digest")
    return parts.groupBy("question_id", "digest").agg(F.count("*").alias("n_passages"), F.sum(F.octet_length("search_text")).alias("n_bytes")).select(
        "question_id", F.concat(F.lit("A:"), "digest").alias("content_hash"), "n_passages", "n_bytes"
    )


@query
def ready_contents(spark, folder):
    items = _items(spark, folder)
    ready = C.ready_counts(items, D.doc_store(spark, folder), D.passage_store(spark, folder), "m-A")
    return items.join(ready, "content_hash").select("question_id", "n_passages", "ready_passages")


@query
def work_to_embed(spark, folder):
    items = _items(spark, folder)
    ready = C.ready_counts(items, D.doc_store(spark, folder), D.passage_store(spark, folder), "m-A")
    return C.to_embed(items, ready).select("question_id", "n_passages")


def _batches(spark, folder):
    parts = passages(D.records(spark, folder), "doc_id")
    items = parts.groupBy("question_id", "doc_id").agg(F.count("*").alias("n_inputs"), F.sum(F.octet_length("search_text")).alias("n_bytes"))
    # doc_id is dense and gives the order of the corpus.
    return C.embedding_batches(items.withColumn("seq", F.col("doc_id")), 32, 20_000)


@query
def embed_plan(spark, folder):
    return _batches(spark, folder).select("question_id", "batch")


@query
def embed_budget(spark, folder):
    return C.budget_check(_batches(spark, folder), V.BUDGET_MAX_CALLS, V.BUDGET_MAX_BYTES)


def _requests(spark, folder):
    """One run of requests per part of the orders' priority, in order of key; sizes from prices."""
    orders = D.table(spark, folder, "orders")
    return orders.select(
        F.col("o_orderpriority").alias("run"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("request_id"), F.floor("o_totalprice").cast("bigint").alias("n_bytes")
    )


@query
def budget_overflow(spark, folder):
    flagged = C.first_overflow(_requests(spark, folder), ["run"], F.floor(F.col("seq") / 1000), ["seq"], 25, 6_000_000)
    return flagged.select("request_id", "run", "calls", "bytes", "accepted")


@query
def budget_replay(spark, folder):
    return C.budget_replay(_requests(spark, folder), ["run"], ["seq"], 25, 6_000_000)


def _expected_passages(spark, folder):
    stored = D.passage_store(spark, folder).groupBy("content_hash").agg(F.count("*").alias("n"))
    return D.version_members(spark, folder).join(stored, "content_hash", "left").groupBy("version_id").agg(
        (F.coalesce(F.sum("n"), F.lit(0)) + F.when(F.col("version_id") == "v3", 1).otherwise(0)).alias("passage_count")
    )


def _checks(spark, folder):
    return C.activation_checks(
        D.versions(spark, folder), D.version_members(spark, folder), D.passage_store(spark, folder), _expected_passages(spark, folder)
    )


@query
def activation_checks(spark, folder):
    return _checks(spark, folder)


@query
def activation(spark, folder):
    checks = materialised(_checks(spark, folder))
    after = [C.activated(D.versions(spark, folder), checks, v, now()) for v in ("v1", "v4")]
    return after[0].select(F.lit("v1").alias("asked"), "version_id", "active").unionByName(after[1].select(F.lit("v4").alias("asked"), "version_id", "active"))


@query
def prune(spark, folder):
    return C.retention(D.versions(spark, folder), 1, now()).select("version_id", "active", "kept")


@query
def removable_contents(spark, folder):
    kept = C.retention(D.versions(spark, folder), 1, now())
    return C.removable_contents(D.doc_store(spark, folder), D.version_members(spark, folder), kept, now()).select("content_hash", "question_id")


@query
def retention_summary(spark, folder):
    return C.retention_summary(C.retention(D.versions(spark, folder), 1, now()), 1)


@query
def clone_unchanged(spark, folder):
    wanted = D.version_members(spark, folder).where(F.col("version_id") == "v2").select("question_id", "content_hash")
    return C.reusable(D.version_members(spark, folder), D.passage_store(spark, folder), wanted, "v4", "m-A").select("question_id")


@query
def version_weight(spark, folder):
    sizes = D.passage_store(spark, folder).groupBy("content_hash").agg(F.sum(F.octet_length("content")).alias("bytes"))
    return C.version_weights(D.version_members(spark, folder), sizes)


@query
def corpus_info(spark, folder):
    info = C.corpus_info(D.versions(spark, folder), D.version_members(spark, folder), D.doc_store(spark, folder))
    return info.select("version_id", "count", "method", "answer_count", day("latest_document"))


@query
def version_export(spark, folder):
    documents = C.version_documents(D.version_members(spark, folder), D.doc_store(spark, folder), "v1")
    return documents.select("question_id", "titre", "reponse", day("date_reception")).orderBy("question_id")


@query
def store_audit(spark, folder):
    before = D.doc_store(spark, folder)
    after = before.withColumn("reponse", F.when(F.col("titre") < "C", F.lit("autre")).otherwise(F.col("reponse")))
    return C.rewritten_contents(before, after, ["content_hash"], F.coalesce("reponse", F.lit("")))


@query
def store_differences(spark, folder):
    """Two states of the store, compared by digest trees that were written with them; the unequal buckets of each level as well."""
    root = shared_folder(spark, "audit")
    before = D.doc_store(spark, folder).where("titre >= 'B'")
    after = D.doc_store(spark, folder).where("titre < 'X'").withColumn("reponse", F.when(F.col("titre") < "C", F.lit("autre")).otherwise(F.col("reponse")))
    keys, value, trees = ["content_hash"], F.col("reponse"), []
    for name, store in (("before", before), ("after", after)):
        M.digest_tree(store, keys, value).write.parquet(f"{root}/{name}")
        trees.append(spark.read.parquet(f"{root}/{name}"))
    unequal = materialised(M.unequal_buckets(*trees))
    rows = M.differences(before, after, keys, value, unequal).select("content_hash", "bucket", "change")
    counts = unequal.groupBy("level").agg(F.count("*").cast("string").alias("bucket"))
    return rows.unionByName(counts.select(F.lit(None).cast("string").alias("content_hash"), "bucket", F.concat(F.lit("unequal at level "), "level").alias("change")))


@query
def insert_absent(spark, folder):
    rows = D.doc_store(spark, folder).select("content_hash", "question_id")
    store = D.version_members(spark, folder).where(F.col("version_id") == "v1").select("content_hash").distinct()
    return C.insert_absent(rows, store, ["content_hash"])


@query
def integrity(spark, folder):
    return C.integrity(D.versions(spark, folder), D.version_members(spark, folder), D.doc_store(spark, folder), D.passage_store(spark, folder))


@query
def applied_versions(spark, folder):
    applied = D.table(spark, folder, "nation").where(F.col("n_regionkey") != 3).select((F.col("n_nationkey") + 1).cast("int").alias("version"))
    return C.applied_version(applied, 25)


# --- Loading and files --------------------------------------------------------


def _without_a_passage(spark, root):
    """The passage store under ``root`` after the loss of one passage of the active version, as a damaged disk would leave it."""
    log = CommitLog(spark, root)

    def change(number, state):
        rows = S.store_in(log, state, "passages")
        active = S.read_published(spark, root, "versions", number).where("active").select("version_id")
        own = version_members(spark, root, number).join(F.broadcast(active), "version_id", "left_semi")
        lost = rows.join(own, "content_hash", "left_semi").agg(F.min(F.struct("passage_id", "content_hash")).alias("x")).select("x.*")
        folder = log.folder("data/passages")
        rows.join(F.broadcast(lost), ["passage_id", "content_hash"], "left_anti").write.parquet(f"{log.root}/{folder}")
        return {**state, "stores": {**state["stores"], "passages": {**state["stores"]["passages"], "folders": [folder]}}}

    log.commit(change)


@query
def load_job(spark, folder):
    """Three loads into new stores: French records still unanswered; all as they are; again, after the store lost a passage."""
    root = shared_folder(spark, "corpus")
    whole = D.records(spark, folder)
    early = whole.withColumn("reponse", F.when(F.col("auteur") == "fr", F.lit(None)).otherwise(F.col("reponse")))
    checks = []
    for name, rows in (("v1", early), ("v2", whole), ("v3", whole)):
        if name == "v3":
            _without_a_passage(spark, root)
        checks.append(load_version(rows, root, name, f"méthode {name}", now(), "substitut", 8))
    told = checks[0].unionByName(checks[1]).unionByName(checks[2])
    documents, parts = S.read_store(spark, root, "documents"), S.read_store(spark, root, "passages")
    return S.read_published(spark, root, "versions").join(told, "version_id").select(
        "version_id", "active", "count", "method", "n_passages", "verdict",
        documents.agg(F.count("*")).scalar().alias("stored_documents"),
        documents.agg(F.count_distinct("question_id")).scalar().alias("stored_records"),
        parts.agg(F.count("*")).scalar().alias("stored_passages"),
        parts.agg(F.count_if(F.size("embedding") == 8)).scalar().alias("embedded"),
    )


@query
def concurrent_loads(spark, folder):
    """Two writers whose rows overlap: the second commits between the first one's reading and its commit, which is tried again."""
    root = shared_folder(spark, "corpus")
    log = CommitLog(spark, root)
    rows = D.records(spark, folder).select("question_id", "titre")
    first, second = rows.where(F.col("question_id") < "D-7"), rows.where(F.col("question_id") >= "D-4")
    S.append_absent(rows.where(F.col("question_id") < "D-2"), root, "contents", ["question_id"])
    change, attempts = S.absent_appended(log, first, "contents", ["question_id"]), []

    def overtaken(number, state):
        new = change(number, state)
        if not attempts:
            S.append_absent(second, root, "contents", ["question_id"])
            S.publish(second, root, "report", "second")
        attempts.append(number)
        return new

    log.commit(overtaken)
    S.publish(first, root, "report", "first")
    latest = S.read_published(spark, root, "report")
    copies = S.read_store(spark, root, "contents").groupBy("question_id").agg(F.count("*").alias("copies"))
    reported = latest.select("question_id", F.lit(True).alias("reported"))
    return copies.join(reported, "question_id", "left").select("question_id", "copies", F.coalesce("reported", F.lit(False)).alias("reported"), F.lit(len(attempts)).alias("attempts"))


@query
def active_search(spark, folder):
    """Search in the active version: the first load is active, the second is refused, the index is of the first."""
    root, queries = shared_folder(spark, "corpus"), D.queries(spark, folder)
    whole = D.records(spark, folder)
    load_version(_changed_records(whole), root, "v1", "méthode v1", now())
    _without_a_passage(spark, root)
    load_version(_changed_records(whole), root, "v2", "méthode v2", now())
    version, records = active_records(spark, root)
    index = I.build_index(records, f"{root}/index", version, stemmed=False)
    return search_index(index, queries, queries.count()).select("query_id", "hit_rank", "passage_id", six("score"), F.lit(index.state["version"]).alias("version_id"))


@query
def corpus_round_trip(spark, folder):
    """The corpus exported as JSON lines and read back."""
    path = shared_folder(spark, "export")
    records = D.records(spark, folder).withColumn("id", F.col("question_id"))
    S.export_records(records.drop("doc_id"), path)
    return S.read_records(spark, path).select(
        "question_id", "moncode", "titre", "auteur", "destinataire", "question", "reponse", day("date_reception"), day("date_reponse"), "url_source"
    )


@query
def published_reports(spark, folder):
    """Snapshots of two runs, a table published twice, and the report on what is read back."""
    root = shared_folder(spark, "runs")
    records = D.records(spark, folder).select("question_id", "auteur", "reponse")
    for stamp, rows in (("20240501T080000Z", records.where("reponse is null")), ("20240601T080000Z", records)):
        snapshot = S.write_snapshot(rows, root, stamp, "records")
        S.publish(rows, root, "corpus", stamp)
    runs = spark.read.parquet(snapshot).groupBy(F.col("run_ts").cast("string").alias("part")).agg(F.count("*").alias("n"), F.count("reponse").alias("answered"))
    latest = S.read_published(spark, root, "corpus").agg(F.lit("latest").alias("part"), F.count("*").alias("n"), F.count("reponse").alias("answered"))
    S.write_report(runs.unionByName(latest), f"{root}/report")
    return spark.read.schema("part string, n bigint, answered bigint").json(f"{root}/report")


# --- Refresh ------------------------------------------------------------------


@query
def recheck_plan(spark, folder):
    rows = P.index_rows(D.index_file_rows(spark, folder))
    return N.recheck_plan(rows, D.current_records(spark, folder), today())


@query
def recheck_plan_full(spark, folder):
    rows = P.index_rows(D.index_file_rows(spark, folder))
    return N.recheck_plan(rows, D.current_records(spark, folder), today(), full=True).groupBy("action").agg(F.count("*").alias("records"))


@query
def missing_from_index(spark, folder):
    return _missing(spark, folder)


def _missing(spark, folder):
    raw = D.index_file_rows(spark, folder)
    listed = raw.where(F.get("row", P.ASSEMBLY) == V.WRITTEN_QUESTION_ASSEMBLY).select(P.code_of(F.get("row", P.LINK)).alias("moncode"))
    return N.missing_from_index(listed, P.index_rows(raw), D.current_records(spark, folder))


@query
def title_selection(spark, folder):
    selections = spark.createDataFrame(list(SELECTIONS), "name string, pattern string, legislature string")
    return N.selected_titles(P.index_rows(D.index_file_rows(spark, folder)), selections).select("moncode", "selection")


@query
def many_selections(spark, folder):
    """A selection for every part, all tried on the titles of the index at once."""
    number = F.col("p_partkey").cast("string")
    selections = D.table(spark, folder, "part").select(F.concat(F.lit("p"), number).alias("name"), F.concat(F.lit(r"\bDossier "), number, F.lit("[0-9]* ?[^0-9]")).alias("pattern"))
    return N.selected_titles(P.index_rows(D.index_file_rows(spark, folder)), selections).select("moncode", "selection")


@query
def legislature_split(spark, folder):
    current = D.current_records(spark, folder)
    return current.select("moncode", R.is_collected(F.col("legislature"), "2024-2029").alias("collected"))


@query
def per_legislature(spark, folder):
    return N.per_legislature(D.current_records(spark, folder))


@query
def method_text(spark, folder):
    counts = N.per_legislature(D.current_records(spark, folder))
    previous = D.table(spark, folder, "region").where(F.col("r_regionkey") == 0).select(
        F.lit("Questions. Législature 1999-2004 : 12 fiches choisies. Législature 2004-2009 : aucune. Fin.").alias("methode_echantillonnage")
    )
    return N.method_text(previous, counts, "2024-2029", "fiches collectées des plus récentes aux plus anciennes")


def _refresh(spark, folder):
    """Outcomes of a refresh whose pages are orders: failures by price, empty texts by priority."""
    rows = P.index_rows(D.index_file_rows(spark, folder))
    current = D.current_records(spark, folder)
    planned = N.recheck_plan(rows, current, today()).where("action != 'kept'").withColumn("seq", F.col("moncode").cast("bigint"))
    orders = D.table(spark, folder, "orders")
    fetched = orders.where(F.col("o_totalprice") > 150000).select(
        F.col("o_orderkey").cast("string").alias("moncode"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "question_text_empty").when(F.col("o_totalprice") > 380000, "question_block_missing").alias("reject_reason"),
        F.lit(None).cast("string").alias("legislature"), F.to_date("o_orderdate").alias("date_reception"), F.lit(None).cast("date").alias("date_publication"),
        F.lit(None).cast("date").alias("date_reponse"), F.lit("Texte relu").alias("reponse"),
    )
    return rows, current, planned, fetched, N.fetch_outcomes(planned, fetched)


@query
def refresh_outcomes(spark, folder):
    outcomes = _refresh(spark, folder)[4]
    return outcomes.groupBy("action", "outcome").agg(F.count("*").alias("pages"))


@query
def refresh_merge(spark, folder):
    rows, current, planned, fetched, outcomes = _refresh(spark, folder)
    kept = current.join(planned.where("action = 'recheck'").select("moncode"), "moncode", "left_anti")
    frozen = current.where(F.lit(False))
    return N.merged(frozen, kept, current, fetched, outcomes).select("moncode", "origin", "reponse")


@query
def refresh_losses(spark, folder):
    """Current records, those that the merged corpus lacks, and outcomes that stop the run."""
    rows, current, planned, fetched, outcomes = _refresh(spark, folder)
    kept = current.join(planned.where("action = 'recheck'").select("moncode"), "moncode", "left_anti")
    merged = N.merged(current.where(F.lit(False)), kept, current, fetched, outcomes)
    lost = current.join(merged.select("moncode"), "moncode", "left_anti").agg(F.count("*")).scalar()
    return current.agg(F.count("*").alias("n_current")).select("n_current", lost.alias("lost"), N.stopping_outcomes(outcomes).scalar().alias("stopping"))


@query
def exclusions(spark, folder):
    return N.exclusions(_refresh(spark, folder)[4])


@query
def refresh_caps(spark, folder):
    outcomes = _refresh(spark, folder)[4]
    counts = outcomes.agg(
        F.count("*").alias("downloads"), F.count_if(F.col("outcome") == "network").alias("network failures"),
        F.count_if((F.col("outcome") == "question_text_empty") & (F.col("action") == "recheck")).alias("empty texts"),
    )
    counts = counts.select(
        "*",
        D.current_records(spark, folder).agg(F.count("*")).scalar().alias("records"),
        _missing(spark, folder).agg(F.count("*")).scalar().alias("missing from index"),
        outcomes.agg(F.count_if(F.col("action") == "recheck")).scalar().alias("rechecks"),
        outcomes.agg(F.count_if((F.col("action") == "candidate") & (F.col("outcome") == "question_block_missing"))).scalar().alias("pages without a question"),
        outcomes.agg(F.count_if((F.col("action") == "candidate") & (F.col("outcome") == "ok"))).scalar().alias("additions"),
    )
    limits = {"downloads": V.MAX_DOWNLOADS, "network failures": V.MAX_NETWORK_FAILURES, "empty texts": V.MAX_EMPTY_TEXTS, "records": V.MAX_RECORDS}
    limits |= {"missing from index": V.MAX_MISSING_FROM_INDEX, "rechecks": V.MAX_DOWNLOADS, "pages without a question": V.MAX_EMPTY_TEXTS, "additions": V.MAX_ADDITIONS}
    return N.cap_checks(counts, limits)


def _run(spark, folder, limits, outcomes=None):
    """A run over the planned pages, rechecks first, their outcomes changed by ``outcomes`` if given."""
    _, current, _, _, found = _refresh(spark, folder)
    found = found if outcomes is None else outcomes(found)
    seq = F.when(F.col("action") == "candidate", F.lit(10_000_000_000)).otherwise(0) + F.col("moncode").cast("bigint")
    n_current = current.agg(F.count("*")).scalar()
    n_missing = _missing(spark, folder).agg(F.count("*")).scalar()
    return N.refresh_run(found.withColumn("seq", seq), n_current, n_missing, limits)


def _readable(outcomes):
    """Rechecked pages keep their structure."""
    broken = (F.col("action") == "recheck") & (F.col("outcome") == "question_block_missing")
    return outcomes.withColumn("outcome", F.when(broken, "ok").otherwise(F.col("outcome")))


_MANY = 10**9
REFRESH_RUNS = {
    "published limits": (N.RefreshLimits(), None),
    "any number": (N.RefreshLimits(_MANY, _MANY, _MANY, _MANY, _MANY, _MANY, 60), _readable),
    "downloads": (N.RefreshLimits(_MANY, 5000, _MANY, _MANY, _MANY, _MANY, 800), _readable),
    "structure": (N.RefreshLimits(_MANY, _MANY, _MANY, _MANY, _MANY, _MANY, 60), None),
    "in a row": (N.RefreshLimits(_MANY, _MANY, _MANY, _MANY, _MANY, 12, 800), _readable),
    "empty": (N.RefreshLimits(_MANY, _MANY, _MANY, 30, _MANY, _MANY, 800), _readable),
}


@query
def refresh_stop(spark, folder):
    """The same planned pages under several limits: where each run stops or ends, and what it has read until then."""
    told = None
    for name, (limits, outcomes) in REFRESH_RUNS.items():
        row = N.run_summary(_run(spark, folder, limits, outcomes)).select(F.lit(name).alias("run"), "*")
        told = row if told is None else told.unionByName(row)
    return told


@query
def refresh_attempts(spark, folder):
    """Each planned page of a run that runs out of additions, with its state."""
    return _run(spark, folder, *REFRESH_RUNS["any number"]).select("moncode", "action", "outcome", "state")


@query
def additions(spark, folder):
    rows = P.index_rows(D.index_file_rows(spark, folder))
    current = D.current_records(spark, folder)
    new = rows.join(current.select("moncode"), "moncode", "left_anti").select("moncode", "date_reception")
    n_current = current.agg(F.count("*").alias("n")).scalar()
    return N.additions(new, n_current, 1_000_000_000, 50).select("rank", "moncode", day("date_reception"))


def _fetches(spark, folder):
    """Events as pages read by one run per type of day; errors and views are unreachable pages."""
    return D.table(spark, folder, "events").select(
        F.date_format("ts", "yyyy-MM").alias("run"), "event_id", F.when(F.col("event_type").isin("error", "view"), "network").otherwise("ok").alias("outcome")
    )


@query
def failure_runs(spark, folder):
    runs = N.failure_runs(_fetches(spark, folder), ["run"], F.floor(F.col("event_id") / 500), "event_id", 4000, 3)
    return runs.select("event_id", "run", "failures", "in_a_row", "stops")


@query
def growth_log(spark, folder):
    """Orders added per day as runs of a growing corpus; totals logged on the 7th are off, those of the 8th are missing."""
    runs = D.table(spark, folder, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("run")).agg(F.count("*").alias("added"))
    # One row per day of the calendar.
    total = F.sum("added").over(W.orderBy("run"))
    logged = runs.withColumns(
        {
            "month": F.substring("run", 1, 7),
            "logged_total": F.when(F.col("run").endswith("-07"), total + 1).when(~F.col("run").endswith("-08"), total),
        }
    )
    return N.growth_log(logged).select("run", "added", "total", "agrees")


# --- Quotas -------------------------------------------------------------------


@query
def quota_hourly(spark, folder):
    return U.hourly_use(D.usage_events(spark, folder), "ip", 1)


@query
def quota_full(spark, folder):
    return U.decisions(D.usage_events(spark, folder), QUOTA_LIMITS)


@query
def quota_counters(spark, folder):
    events = D.usage_events(spark, folder)
    return U.counter_uses(events.where("kind = 'reserve'"), U.decisions(events, QUOTA_LIMITS)).groupBy(
        F.split_part("bucket", F.lit(":"), F.lit(1)).alias("counter")
    ).agg(F.count("*").alias("buckets"), F.sum("used").alias("used"))


@query
def quota_window(spark, folder):
    return U.window_quota(D.usage_events(spark, folder), 1, 3, 3600)


@query
def quota_stream(spark, folder):
    """The stream's decisions over the whole event table, read as a stream."""
    from quaestor.streaming.quota_stream import run_available

    root = shared_folder(spark, "quota")
    D.usage_events(spark, folder).write.parquet(f"{root}/events")
    schema = spark.read.parquet(f"{root}/events").schema
    events = spark.readStream.schema(schema).parquet(f"{root}/events")
    return run_available(events, f"{root}/out", f"{root}/state", QUOTA_LIMITS)


# --- Evaluation ---------------------------------------------------------------


def _cases(spark, folder):
    queries = D.queries(spark, folder)
    expected = materialised(D.expected_records(spark, folder))
    known = expected.select("query_id").distinct().withColumn("_known", F.lit(True))
    cases = queries.join(known, "query_id", "left").select(
        "query_id",
        F.when(F.col("_known").isNull(), V.OFF_TOPIC).when(F.length("text") > 200, "titre").otherwise("citoyen").alias("kind"),
        F.col("_known").isNull().alias("off_topic"),
        F.when(F.length("text") > 250, 1).cast("int").alias("max_rank"),
        F.when(F.contains("text", F.lit("\n")), "plusieurs lignes").alias("gap"),
    )
    return cases, expected


def _judged(spark, folder):
    records, queries, hits = _hits(spark, folder)
    cases, expected = _cases(spark, folder)
    return records, queries, hits, cases, expected, E.judged_cases(cases, expected, E.distinct_records(hits))


@query
def case_judgement(spark, folder):
    judged = _judged(spark, folder)[5]
    return judged.select("query_id", "kind", F.coalesce("rank", F.lit(0)).alias("rank"), "pass", "reason")


@query
def display_judgement(spark, folder):
    records, queries, hits, cases, expected, judged = _judged(spark, folder)
    shown = A.extractive_answers(hits, queries, records, D.RECORD_HOSTS).select("query_id", F.explode("sources.id").alias("_id")).select(
        "query_id", R.passage_record(F.col("_id")).alias("question_id")
    )
    return E.with_display(judged, expected, shown).select("query_id", "kind", "pass", "reason")


@query
def eval_summary(spark, folder):
    return E.summary(_judged(spark, folder)[5]).select("cases", "failed", "known_gaps", "resolved_gaps", six("top1"), six("mrr"))


@query
def pass_rates(spark, folder):
    return E.pass_rates(_judged(spark, folder)[5])


@query
def answer_judgement(spark, folder):
    records, queries, hits = _hits(spark, folder)
    cases, expected = _cases(spark, folder)
    generated = _generated(spark, folder, queries, hits)
    answers = A.generated_answers(generated, A.citation_checks(generated, hits), hits, records, D.RECORD_HOSTS)
    return E.judged_answers(cases, expected, answers)


@query
def ranking_diff(spark, folder):
    """Lexical hits before and after the relevance filter, as two rankings of the same queries."""
    records, queries, n = _search_inputs(spark, folder)
    found = match(records, queries, stemmed=False, n_queries=n)
    local = search(records, queries, stemmed=False, n_queries=n, matched=found)
    other = search(records, queries, _vectors(spark, folder, queries), stemmed=False, n_queries=n, matched=found)
    return E.ranking_differences(local, other).select("query_id", "kind")


@query
def ranking_diff_tally(spark, folder):
    return E.difference_tally(ranking_diff(spark, folder))


@query
def expectation_misses(spark, folder):
    hits = _hits(spark, folder)[2]
    return E.expectation_misses(_cases(spark, folder)[1], E.distinct_records(hits))


@query
def result_contract(spark, folder):
    records, queries, n = _search_inputs(spark, folder)
    hits = search(records, queries, _vectors(spark, folder, queries), stemmed=False, n_queries=n)
    return E.result_contract(hits, queries, F.lit(V.DEFAULT_RESULTS))


@query
def title_vocabulary(spark, folder):
    return E.title_vocabulary(D.records(spark, folder))


@query
def rare_words(spark, folder):
    return E.rare_title_words(D.records(spark, folder))


@query
def random_queries(spark, folder):
    return E.random_queries(E.title_vocabulary(D.records(spark, folder)), 100, 20260930)


@query
def seeded_words(spark, folder):
    return E.seeded_order(E.rare_title_words(D.records(spark, folder)), 20260930, 15).select("word", "question_id")


def _request_logs(spark, folder):
    return D.table(spark, folder, "events").select(
        "ts",
        F.to_json(
            F.struct(
                F.struct(
                    F.floor(F.col("value") * 10).cast("int").alias("quota"), F.get_json_object("props", "$.k").cast("int").alias("search"),
                    F.when(F.col("event_type") == "purchase", F.floor(F.col("value") * 100).cast("int")).alias("generation"),
                ).alias("ms")
            )
        ).alias("payload"),
    )


@query
def latency_stats(spark, folder):
    return E.latency_statistics(_request_logs(spark, folder)).select("step", "requests", six("mean_ms"), "p50_ms", "p95_ms", "max_ms")


@query
def latency_sketch(spark, folder):
    """Percentiles from hourly sketches that are stored and merged; each with whether its rank is within the stated error."""
    logs, path = _request_logs(spark, folder), shared_folder(spark, "latency")
    E.hourly_sketches(logs).write.parquet(path)
    found = E.sketched_percentiles(spark.read.parquet(path), ["step"])
    return E.rank_errors(logs, found).select("step", "requests", "share", "min_ms", "max_ms", (F.col("rank_error") <= E.SKETCH_RANK_ERROR).alias("within_error"))
