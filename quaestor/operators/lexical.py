"""Rare-word weighted search over many queries at once.

The index is partitioned by record: the words of a record stay together, the
query terms (at most ``MAX_QUERY_TERMS`` per query) go to the records, and the
score of a record is summed where its words are. A frequent word therefore
never gathers its records in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaestor.fixed_values import (
    MAX_QUERY_TERMS,
    QUERY_GENERIC_WORDS,
    TITLE_WEIGHT,
)
from quaestor.functions.records import present, record_text
from quaestor.functions.stemming import with_stems
from quaestor.functions.text import expanded, fold_accents, index_words, query_words, word_array
from quaestor.operators.sizing import BROADCAST_BYTES, hot_join
from quaestor.session import materialised

TERM_ROW_BYTES = 64
#: Terms up to which a pass over the texts is told them by value.
LITERAL_TERMS = 1 << 14
# A term every record has: its document frequency is the number of records.
EVERY_RECORD = ""


def answered(records: DataFrame) -> DataFrame:
    """Only records with an answer are searched."""
    return records.where(present(F.col("reponse")))


def indexed_text() -> Column:
    return record_text(*(F.col(c) for c in ("titre", "auteur", "destinataire", "question", "reponse")))


def vocabulary(records: DataFrame) -> DataFrame:
    """(word, stem) for every distinct word of the records."""
    words = records.select(F.explode_outer(F.array_distinct(word_array(fold_accents(indexed_text())))).alias("word"))
    return with_stems(words.distinct())


def _rooted(words: DataFrame, stemmed: bool) -> DataFrame:
    return with_stems(words, "word", "term") if stemmed else words.withColumn("term", F.col("word"))


def root_maps(rows: DataFrame, keys: list[str], words: Column) -> DataFrame:
    """(keys, roots): map from each of ``words`` to its root; no row for keys without words. For texts of bounded length."""
    said = rows.select(*keys, F.explode(words).alias("word")).distinct()
    return with_stems(said).groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("word", "stem"))).alias("roots"))


def rooted(words: Column, roots: Column | None) -> Column:
    """The roots of an array of words, from a map; the words themselves without one."""
    return words if roots is None else F.transform(words, lambda w: F.element_at(roots, w))


def _without_generic(terms: DataFrame, generic_words: list[str], stemmed: bool) -> DataFrame:
    if not stemmed:
        return terms.where(~F.col("term").isin(*generic_words))
    words = terms.sparkSession.createDataFrame([(w,) for w in generic_words], "word string")
    generic = with_stems(words, "word", "term").select("term").distinct()
    return terms.join(F.broadcast(generic), "term", "left_anti")


def query_terms(queries: DataFrame, stemmed: bool = True) -> DataFrame:
    """(query_id, pos, word, term, n_terms): the scored terms of each query.

    One term per root, in the order written, with the word as first written;
    generic words are left out and the first ``MAX_QUERY_TERMS`` are kept.
    """
    words = queries.select(
        "query_id", F.posexplode(F.array_distinct(query_words(expanded(F.col("text"))))).alias("pos", "word")
    )
    terms = _rooted(words, stemmed)
    terms = terms.groupBy("query_id", "term").agg(F.min_by("word", "pos").alias("word"), F.min("pos").alias("pos"))
    terms = _without_generic(terms, QUERY_GENERIC_WORDS, stemmed)
    # A query has at most a few hundred words: its group is small by nature.
    ordered = W.partitionBy("query_id").orderBy("pos")
    ranked = terms.withColumn("_rank", F.row_number().over(ordered)).where(F.col("_rank") <= MAX_QUERY_TERMS)
    return ranked.withColumn("n_terms", F.count("*").over(W.partitionBy("query_id"))).select(
        "query_id", (F.col("_rank") - 1).alias("pos"), "word", "term", "n_terms"
    )


def lexical_query(terms: DataFrame) -> DataFrame:
    """(query_id, lexical_query): the words joined by OR."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"])
    return terms.groupBy("query_id").agg(F.array_join(words, " OR ").alias("lexical_query"))


def filter_terms(queries: DataFrame, generic_words: list[str], stemmed: bool = True) -> DataFrame:
    """(query_id, term): distinct roots of the query as written, without generic words."""
    words = queries.select("query_id", F.explode(F.array_distinct(query_words(F.col("text")))).alias("word"))
    return _without_generic(_rooted(words, stemmed).select("query_id", "term").distinct(), generic_words, stemmed)


def word_forms(terms: DataFrame, words: DataFrame | None) -> DataFrame:
    """(term, word): the written forms of the wanted terms; ``words`` is the vocabulary when stemmed."""
    wanted = terms.select("term").distinct()
    if words is None:
        return wanted.select("term", F.col("term").alias("word"))
    return words.select(F.col("stem").alias("term"), "word").join(wanted, "term")


def document_words(records: DataFrame) -> DataFrame:
    """(question_id, word, title_words): distinct index words of each answered record. Narrow."""
    # Two steps: what is computed next to an explode is computed for every exploded row.
    # The outer form spares the filter on non-empty arrays, which would tokenize every text twice.
    prepared = answered(records).select(
        "question_id",
        index_words(F.col("titre")).alias("title_words"),
        F.array_append(F.array_distinct(index_words(indexed_text())), F.lit(EVERY_RECORD)).alias("words"),
    )
    return prepared.select("question_id", "title_words", F.explode_outer("words").alias("word"))


def power_of(count: str) -> Column:
    return F.floor(F.log2(count))


def least_power(words: DataFrame, rows: int) -> int:
    """The least power of two such that of the words (n: how often each occurs) at most ``rows`` occur as often; 0 if there are no more."""
    sizes, held = {r.power: r.words for r in words.groupBy(power_of("n").alias("power")).agg(F.count("*").alias("words")).collect()}, 0
    for size in sorted(sizes, reverse=True):
        held += sizes[size]
        if held > rows:
            return size + 1
    return 0


def postings(records: DataFrame, stemmed: bool = True, broadcast_rows: int = BROADCAST_BYTES // TERM_ROW_BYTES) -> DataFrame:
    """(term, question_id, tf, in_title): the index, clustered by record."""
    prepared = answered(records).select(
        "question_id",
        index_words(F.col("titre")).alias("title_words"),
        index_words(indexed_text()).alias("words"),
    )
    exploded = prepared.select("question_id", "title_words", F.explode_outer("words").alias("word"))
    words = exploded.select("question_id", "word", F.array_contains("title_words", F.col("word")).alias("in_title"))
    if not stemmed:
        counted = words.groupBy("question_id", "word").agg(F.count("*").alias("tf"), F.max("in_title").alias("in_title"))
        return counted.select(F.col("word").alias("term"), "question_id", "tf", "in_title")
    stems = materialised(with_stems(words.groupBy("word").agg(F.count("*").alias("n"))))
    return _postings_of_roots(words, stems, broadcast_rows)


def _postings_of_roots(words: DataFrame, stems: DataFrame, broadcast_rows: int) -> DataFrame:
    """(term, question_id, tf, in_title) of words (question_id, word, in_title) by their stems (word, n, stem).

    The most frequent words, as many as a broadcast holds, meet their stems where the texts are, so that a frequent word
    never gathers its records in one task and one shuffle is left. Only rarer ones, if there are any, are joined by word.
    """
    sums = F.sum("tf").alias("tf"), F.max("in_title").alias("in_title")
    power, least = power_of("n"), least_power(stems, broadcast_rows)
    frequent = F.broadcast(stems.where(power >= least).select("word", "stem"))
    if not least:
        return words.join(frequent, "word").groupBy(F.col("stem").alias("term"), "question_id").agg(F.count("*").alias("tf"), F.max("in_title").alias("in_title"))
    told = words.join(frequent, "word", "left")
    own = F.when(F.col("stem").isNull(), F.col("word"))
    counted = materialised(told.groupBy("stem", own.alias("word"), "question_id").agg(F.count("*").alias("tf"), F.max("in_title").alias("in_title")))
    rare = counted.where("stem is null").drop("stem").join(stems.where(power < least).select("word", "stem"), "word")
    columns = [F.col("stem").alias("term"), "question_id", "tf", "in_title"]
    return counted.where("stem is not null").select(columns).unionByName(rare.select(columns)).groupBy("term", "question_id").agg(*sums)


def document_frequency(index: DataFrame, n_records: Column) -> DataFrame:
    """(term, df, idf) from postings."""
    return index.groupBy("term").agg(F.count("question_id").alias("df")).withColumn("idf", idf(F.col("df"), n_records))


def idf(df: Column, n_records: Column) -> Column:
    return F.log(1 + n_records / (1 + df))


def _matched_in_place(records: DataFrame, terms: list[str]) -> DataFrame:
    """``matched_records`` of words that are terms themselves, and of records that are rows: narrow."""
    wanted = ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in [EVERY_RECORD, *terms])
    prepared = answered(records).select(
        "question_id",
        F.coalesce(index_words(F.col("titre")), F.array().cast("array<string>")).alias("title_words"),
        F.array_append(F.array_distinct(index_words(indexed_text())), F.lit(EVERY_RECORD)).alias("words"),
    )
    # The title's words are looked up once a record: what a lambda refers to may be computed for each of its elements.
    found = prepared.select("question_id", "title_words", F.expr(f"filter(words, w -> w IN ({wanted}))").alias("found"))
    titled = F.transform(F.array_intersect("found", "title_words"), lambda w: F.struct(w.alias("term"), F.lit(True).alias("in_title")))
    others = F.transform(F.array_except("found", "title_words"), lambda w: F.struct(w.alias("term"), F.lit(False).alias("in_title")))
    return found.select("question_id", F.concat(titled, others).alias("entries"))


def matched_records(records: DataFrame, forms: DataFrame, n_terms: int, stemmed: bool = True) -> DataFrame:
    """(question_id, entries): the wanted terms of each record (term, in_title), a row for each record.

    Written once: the only pass over the texts serves the frequencies and the scores. Terms that are words, up to
    ``LITERAL_TERMS`` of them, are told by value, so that a record's entries stay where its text is; roots, more terms and
    records of several rows are joined and grouped.
    """
    if not stemmed and n_terms <= LITERAL_TERMS and records.groupBy("question_id").count().where("count > 1").isEmpty():
        return materialised(_matched_in_place(records, [r.word for r in forms.select("word").distinct().collect()]))
    every = forms.sparkSession.createDataFrame([(EVERY_RECORD, EVERY_RECORD)], "term string, word string")
    wanted = forms.select("term", "word").unionByName(every)
    found = hot_join(document_words(records), wanted, ["word"], "question_id", n_terms + 1, TERM_ROW_BYTES)
    flagged = found.select(
        "question_id", "term", F.array_contains("title_words", F.col("word")).alias("in_title")
    ).repartition("question_id")
    each = flagged.groupBy("question_id", "term").agg(F.max("in_title").alias("in_title"))
    return materialised(each.groupBy("question_id").agg(F.collect_list(F.struct("term", "in_title")).alias("entries")))


def matched_and_weights(
    records: DataFrame, terms: DataFrame, n_queries: int, words: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The matched records, and (term, query_id, weight) of the queries' terms."""
    n_terms = n_queries * MAX_QUERY_TERMS
    forms = word_forms(terms, words)
    # A root has any number of written forms: they are counted before they are sent anywhere.
    n_forms = n_terms if words is None else forms.count()
    matched = matched_records(records, forms, n_forms, words is not None)
    frequency = matched.select(F.inline("entries")).groupBy("term").agg(F.count("*").alias("df"))
    n_records = frequency.where(F.col("term") == EVERY_RECORD).select("df").scalar()
    weight = idf(F.col("df"), n_records) / F.sqrt("n_terms")
    return matched, terms.join(frequency, "term").select("term", "query_id", weight.alias("weight"))


def lexical_scores(
    records: DataFrame, terms: DataFrame, n_queries: int, words: DataFrame | None = None
) -> DataFrame:
    """(query_id, question_id, lexical) for every record that has a term of the query.

    ``n_queries`` bounds the query side: it has at most ``MAX_QUERY_TERMS`` rows
    per query, which decides between broadcast and salted shuffle.
    """
    matched, weights = matched_and_weights(records, terms, n_queries, words)
    return scores_of(matched, weights, n_queries)


def scores_of(matched: DataFrame, weights: DataFrame, n_queries: int) -> DataFrame:
    """(query_id, question_id, lexical) of the matched records by the weights (term, query_id, weight) of at most ``n_queries`` queries."""
    n_terms = n_queries * MAX_QUERY_TERMS
    each = matched.select("question_id", F.inline("entries"))
    scored = hot_join(each, weights, ["term"], "question_id", n_terms, TERM_ROW_BYTES)
    return scored.groupBy("query_id", "question_id").agg(
        F.sum(F.col("weight") * F.when(F.col("in_title"), TITLE_WEIGHT).otherwise(1)).alias("lexical")
    )
