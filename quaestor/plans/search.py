"""Lexical and hybrid search of a batch of queries over a corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaestor.fixed_values import FILTER_GENERIC_WORDS, MAX_QUERY_TERMS, MAX_RESULTS, RELEVANCE_SHARE
from quaestor.functions.text import index_words, query_words, split_passages
from quaestor.functions.vectors import cosine
from quaestor.operators.bounded_fusion import fused
from quaestor.operators.lexical import (
    answered,
    filter_terms,
    matched_and_weights,
    query_terms,
    scores_of,
    vocabulary,
    word_forms,
)
from quaestor.operators.ranking import (
    best_passages,
    interleave,
    select_documents,
    top_lexical,
)
from quaestor.operators.sizing import small_side
from quaestor.operators.stored_index import StoredIndex, indexed_scores, records_of, written_forms
from quaestor.session import materialised


@dataclass(frozen=True)
class Vectors:
    """Vectors of passages (question_id, passage_id, embedding) and of queries (query_id, qvec)."""

    passages: DataFrame
    queries: DataFrame
    dimensions: int


@dataclass(frozen=True)
class Match:
    """One pass over the texts for several searches: the queries' terms, the vocabulary (None unstemmed), the matched records and the weights."""

    terms: DataFrame
    words: DataFrame | None
    matched: DataFrame
    weights: DataFrame

    def of(self, queries: DataFrame) -> Match:
        """The same match for some of its queries."""
        own = queries.select("query_id").distinct()
        return Match(self.terms.join(own, "query_id", "left_semi"), self.words, self.matched, self.weights.join(own, "query_id", "left_semi"))


def match(records: DataFrame, queries: DataFrame, stemmed: bool = True, n_queries: int | None = None) -> Match:
    """The terms of all ``queries`` matched with the records, for searches that each answer some of them or all."""
    n_queries = queries.count() if n_queries is None else n_queries
    words = materialised(vocabulary(records)) if stemmed else None
    terms = materialised(query_terms(queries, stemmed))
    matched, weights = matched_and_weights(records, terms, n_queries, words)
    return Match(terms, words, matched, materialised(weights))


def words_per_query(terms: DataFrame, words: DataFrame | None, name: str) -> DataFrame:
    """(query_id, name): map from each written form to its root."""
    forms = terms.select("query_id", "term").join(word_forms(terms, words), "term")
    return forms.groupBy("query_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "term"))).alias(name))


def _spread(records: DataFrame) -> DataFrame:
    """Few but long texts on all cores: a scan or a join leaves them where they were found."""
    return records.repartition(records.sparkSession.sparkContext.defaultParallelism, "question_id")


def selected_passages(
    selected: DataFrame,
    records: DataFrame,
    wanted: DataFrame,
    vectors: Vectors | None,
    n_queries: int,
    words_bounded: bool = True,
) -> DataFrame:
    """Answer passages of the selected records with their occurrences of query words and similarity.

    ``words_bounded``: ``wanted`` holds at most ``MAX_QUERY_TERMS`` words per query (not so with written forms).
    """
    n_rows = n_queries * MAX_RESULTS
    chosen = small_side(selected, n_rows, 64)
    asked = small_side(wanted, n_queries, 64 * MAX_QUERY_TERMS) if words_bounded else wanted
    # A record that many queries select is split once.
    texts = answered(records).join(chosen.select("question_id").distinct(), "question_id", "left_semi")
    parts = _spread(texts.select("question_id", "reponse")).select(
        "question_id", F.posexplode_outer(split_passages(F.col("reponse"))).alias("position", "content")
    )
    parts = materialised(parts.withColumn("words", index_words(F.col("content"))))
    found = parts.join(chosen, "question_id").join(asked, "query_id")
    hits = found.select(
        "query_id",
        "question_id",
        "score",
        "document_rank",
        "_limit",
        F.concat_ws(":", "question_id", F.lit("reponse"), F.col("position").cast("string")).alias("passage_id"),
        "position",
        "content",
        F.size(F.filter("words", lambda w: F.map_contains_key("wanted", w))).alias("occurrences"),
    )
    if vectors is None:
        return hits.withColumn("similarity", F.lit(0.0))
    # Only vectors of selected records are moved.
    chosen_ids = small_side(selected.select("question_id").distinct(), n_rows, 32)
    stored = vectors.passages.join(chosen_ids, "question_id", "left_semi").select("passage_id", "embedding")
    hits = hits.join(stored, "passage_id", "left").join(
        small_side(vectors.queries, n_queries, 8 * vectors.dimensions), "query_id", "left"
    )
    return hits.withColumn("similarity", F.coalesce(cosine(F.col("embedding"), F.col("qvec")), F.lit(0.0))).drop(
        "embedding", "qvec"
    )


def relevant(hits: DataFrame, records: DataFrame, own: DataFrame, words: DataFrame | None, n_queries: int) -> DataFrame:
    """Hits whose record holds at least 60 % of the query's own words (query_id, term); none when the query has none."""
    own = materialised(own)
    forms = words_per_query(own, words, "forms")
    totals = own.groupBy("query_id").agg(F.count("*").alias("n_filter"))
    pairs = small_side(hits.select("query_id", "question_id").distinct(), n_queries * MAX_RESULTS, 32)
    text = F.concat_ws(" ", "titre", "question", "reponse")
    ids = small_side(hits.select("question_id").distinct(), n_queries * MAX_RESULTS, 32)
    texts = _spread(records.join(ids, "question_id", "left_semi").select("question_id", text.alias("text")))
    said = materialised(texts.select("question_id", F.array_distinct(query_words(F.col("text"))).alias("said")))
    checked = (
        said.join(pairs, "question_id")
        .join(forms, "query_id")
        .join(small_side(totals, n_queries, 16), "query_id")
        .select(
            "query_id",
            "question_id",
            F.size(
                F.array_distinct(
                    F.transform(F.filter("said", lambda w: F.map_contains_key("forms", w)), lambda w: F.element_at("forms", w))
                )
            ).alias("matched"),
            "n_filter",
        )
        .where(F.col("matched") / F.col("n_filter") >= RELEVANCE_SHARE)
        .select("query_id", "question_id")
    )
    return hits.join(small_side(checked, n_queries * MAX_RESULTS, 32), ["query_id", "question_id"], "left_semi")


def ranked_documents(
    records: DataFrame,
    queries: DataFrame,
    terms: DataFrame,
    n_queries: int,
    words: DataFrame | None = None,
    vectors: Vectors | None = None,
) -> DataFrame:
    """Best records of each query: rank fusion with vectors, lexical ranks without."""
    matched, weights = matched_and_weights(records, terms, n_queries, words)
    return _ranked(matched, weights if vectors is None else materialised(weights), records, n_queries, vectors)


def _ranked(matched: DataFrame, weights: DataFrame, records: DataFrame, n_queries: int, vectors: Vectors | None) -> DataFrame:
    if vectors is None:
        return top_lexical(scores_of(matched, weights, n_queries))
    searched = vectors.passages.join(answered(records).select("question_id"), "question_id", "left_semi")
    return fused(matched, weights, searched, vectors.queries, vectors.dimensions)


def search(
    records: DataFrame,
    queries: DataFrame,
    vectors: Vectors | None = None,
    stemmed: bool = True,
    n_queries: int | None = None,
    filtered: bool | None = None,
    matched: Match | None = None,
) -> DataFrame:
    """Hits of every query: query_id, hit_rank, passage_id, question_id, section, content, position, score.

    ``queries``: query_id, text, limit. With vectors the two rankings are fused
    and all hits are kept; without, hits must share enough words with the query
    (``filtered`` overrides this). ``matched``: the match of these queries, if another search needs it too.
    """
    n_queries = queries.count() if n_queries is None else n_queries
    if vectors is not None:
        # Only vectors of these queries are sent anywhere.
        own = vectors.queries.join(queries.select("query_id").distinct(), "query_id", "left_semi")
        vectors = Vectors(vectors.passages, own, vectors.dimensions)
    found = match(records, queries, stemmed, n_queries) if matched is None else matched
    best = _ranked(found.matched, found.weights, records, n_queries, vectors)
    selected = materialised(select_documents(best, queries))
    return _hits(selected, records, queries, found.terms, found.words, vectors, n_queries, vectors is None if filtered is None else filtered)


def _hits(
    selected: DataFrame,
    records: DataFrame,
    queries: DataFrame,
    terms: DataFrame,
    words: DataFrame | None,
    vectors: Vectors | None,
    n_queries: int,
    filtered: bool,
    own: DataFrame | None = None,
) -> DataFrame:
    """The hits of the selected records, which ``records`` holds.

    ``words``: the written forms of the queries' terms, None unstemmed. ``own``: the queries' own terms, if they are known.
    """
    wanted = words_per_query(terms, words, "wanted")
    rows = interleave(best_passages(selected_passages(selected, records, wanted, vectors, n_queries, words is None)))
    hits = rows.select(
        "query_id",
        "hit_rank",
        "passage_id",
        "question_id",
        F.lit("reponse").alias("section"),
        "content",
        "position",
        "score",
    )
    if filtered:
        own = filter_terms(queries, FILTER_GENERIC_WORDS, words is not None) if own is None else own
        # Read for the pairs and again for their rows.
        hits = relevant(materialised(hits), records, own, words, n_queries)
        again = F.row_number().over(W.partitionBy("query_id").orderBy("hit_rank"))
        hits = hits.withColumn("hit_rank", again)
    return hits


def search_index(index: StoredIndex, queries: DataFrame, n_queries: int | None = None, filtered: bool = True) -> DataFrame:
    """The hits of ``search`` without vectors, from a stored index: no text is split but those of the selected records."""
    n_queries = queries.count() if n_queries is None else n_queries
    stemmed = index.state["stemmed"]
    terms = materialised(query_terms(queries, stemmed))
    best = top_lexical(indexed_scores(index, terms, n_queries))
    selected = materialised(select_documents(best, queries))
    records = materialised(records_of(index, selected))
    own = materialised(filter_terms(queries, FILTER_GENERIC_WORDS, stemmed))
    words = materialised(written_forms(index, terms.select("term").unionByName(own.select("term")))) if stemmed else None
    return _hits(selected, records, queries, terms, words, None, n_queries, filtered, own)


def mixed_search(
    records: DataFrame, queries: DataFrame, vectors: Vectors, stemmed: bool = True, n_queries: int | None = None
) -> DataFrame:
    """Hybrid search for queries flagged ``use_vectors``, filtered lexical search for the others."""
    n_queries = queries.count() if n_queries is None else n_queries
    with_vector = queries.join(vectors.queries.select("query_id"), "query_id", "left_semi").where("use_vectors")
    without = queries.join(with_vector.select("query_id"), "query_id", "left_anti")
    found = match(records, queries, stemmed, n_queries)
    return search(records, with_vector, vectors, stemmed, n_queries, matched=found.of(with_vector)).unionByName(
        search(records, without, None, stemmed, n_queries, matched=found.of(without))
    )
