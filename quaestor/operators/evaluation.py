"""Retrieval quality: judged cases, summaries, ranked-list differences, generated queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaestor.fixed_values import (
    DEFAULT_MAX_RANK,
    OFF_TOPIC,
    REASON_EXPECTED_MISSING,
    REASON_NOT_SHOWN,
    REASON_OFF_TOPIC_RESULTS,
    REASON_OFF_TOPIC_SHOWN,
    SCORE_DECIMALS,
    STOP_WORDS,
)
from quaestor.functions.records import passage_record, present
from quaestor.functions.stemming import with_stems
from quaestor.functions.text import fold_accents, query_words
from quaestor.operators.lexical import answered

#: Size parameter of the quantile sketches, the error of a rank that it stands for (twice the usual 99 % bound of 1.33 % for one sketch), and the percentiles.
SKETCH_SIZE, SKETCH_RANK_ERROR, SHARES = 200, 0.0266, (0.5, 0.95)


def distinct_records(hits: DataFrame) -> DataFrame:
    """(query_id, question_id, record_rank): records of a result in the order first met."""
    first = hits.groupBy("query_id", "question_id").agg(F.min("hit_rank").alias("_first"))
    order = W.partitionBy("query_id").orderBy("_first")
    return first.select("query_id", "question_id", F.row_number().over(order).alias("record_rank"))


def judged_cases(cases: DataFrame, expected: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, kind, rank, pass, reason) per case.

    ``cases``: query_id, kind, off_topic, max_rank, gap. ``expected``: query_id,
    question_id, any number per case. ``found``: ranked distinct records.
    """
    ranks = expected.join(found, ["query_id", "question_id"]).groupBy("query_id").agg(F.min("record_rank").alias("rank"))
    counts = found.groupBy("query_id").agg(F.count("*").alias("n_found"))
    facts = cases.join(ranks, "query_id", "left").join(counts, "query_id", "left").na.fill(0, ["n_found"])
    worst = F.coalesce("max_rank", F.lit(DEFAULT_MAX_RANK))
    reason = (
        F.when(F.col("off_topic"), F.when(F.col("n_found") > 0, REASON_OFF_TOPIC_RESULTS))
        .when(F.col("rank").isNull(), REASON_EXPECTED_MISSING)
        .when(F.col("rank") > worst, F.concat(F.lit("rang "), F.col("rank").cast("string"), F.lit(" au-delà de "), worst.cast("string")))
    )
    return facts.select(
        "query_id", "kind", "off_topic", "gap", F.when(~F.col("off_topic"), F.col("rank")).alias("rank"), reason.alias("reason")
    ).withColumn("pass", F.col("reason").isNull())


def with_display(judged: DataFrame, expected: DataFrame, shown: DataFrame) -> DataFrame:
    """Also judges the sources shown (query_id, question_id): expected ones there, none for an off-topic case."""
    good = shown.join(expected, ["query_id", "question_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("n_good"))
    every = shown.groupBy("query_id").agg(F.count("*").alias("n_shown"))
    facts = judged.join(good, "query_id", "left").join(every, "query_id", "left").na.fill(0, ["n_good", "n_shown"])
    reason = F.coalesce(
        "reason",
        F.when(F.col("off_topic"), F.when(F.col("n_shown") > 0, REASON_OFF_TOPIC_SHOWN)).when(
            F.col("n_good") == 0, REASON_NOT_SHOWN
        ),
    )
    return facts.withColumn("reason", reason).withColumn("pass", F.col("reason").isNull()).drop("n_good", "n_shown")


def summary(judged: DataFrame) -> DataFrame:
    """One row: cases, failures without a known gap, known and resolved gaps, top-1 share, MRR."""
    expecting = F.col("kind") != OFF_TOPIC
    total = F.greatest(F.count_if(expecting), F.lit(1))
    gap = F.col("gap").isNotNull()
    return judged.agg(
        F.count("*").alias("cases"),
        F.count_if(~F.col("pass") & ~gap).alias("failed"),
        F.count_if(~F.col("pass") & gap).alias("known_gaps"),
        F.count_if(F.col("pass") & gap).alias("resolved_gaps"),
        (F.count_if(expecting & (F.col("rank") == 1)) / total).alias("top1"),
        (F.coalesce(F.sum(F.when(expecting, 1.0 / F.col("rank"))), F.lit(0.0)) / total).alias("mrr"),
    )


def pass_rates(judged: DataFrame) -> DataFrame:
    return judged.groupBy("kind").agg(F.count_if("pass").alias("passed"), F.count("*").alias("cases"))


def judged_answers(cases: DataFrame, expected: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, pass) of generated answers: documented and citing an expected record, or insufficient without source.

    ``answers``: query_id, mode, status, sources.
    """
    cited = answers.select("query_id", F.explode("sources.id").alias("_id")).select(
        "query_id", passage_record(F.col("_id")).alias("question_id")
    )
    good = cited.join(expected, ["query_id", "question_id"], "left_semi").select("query_id").distinct().withColumn("_good", F.lit(True))
    facts = cases.join(answers, "query_id").join(good, "query_id", "left")
    passed = F.when(F.col("off_topic"), (F.col("status") == "insuffisant") & (F.size("sources") == 0)).otherwise(
        (F.col("mode") == "ia") & (F.col("status") == "documente") & F.coalesce("_good", F.lit(False))
    )
    return facts.select("query_id", "kind", passed.alias("pass"))


def ranking_differences(local: DataFrame, other: DataFrame) -> DataFrame:
    """(query_id, kind) of every difference between two ranked lists (query_id, hit_rank, passage_id, score).

    One kind per query, the most specific; lists that agree may differ by
    scores, one row per passage.
    """

    def folded(hits: DataFrame, side: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("hit_rank", "passage_id", F.round("score", SCORE_DECIMALS).alias("score"))))
        return hits.groupBy("query_id").agg(ordered.alias(side))

    both = folded(local, "a").join(folded(other, "b"), "query_id", "full").select(
        "query_id", *[F.coalesce(side, F.array()).alias(side) for side in ("a", "b")]
    )

    def ids(side: str) -> Column:
        return F.transform(side, lambda x: x["passage_id"])

    def records(side: str) -> Column:
        return F.array_distinct(F.transform(side, lambda x: passage_record(x["passage_id"])))

    kind = (
        F.when(F.size("b") == 0, "sql-vide")
        .when(F.size("a") == 0, "local-vide")
        .when(F.get(records("a"), 0) != F.get(records("b"), 0), "premiere-question")
        .when(records("a") != records("b"), "questions")
        .when(F.array_sort(ids("a")) != F.array_sort(ids("b")), "passages")
        .otherwise("ordre")
    )
    lists = both.where(ids("a") != ids("b")).select("query_id", F.lit(None).cast("string").alias("passage_id"), kind.alias("kind"))
    pairs = both.where(ids("a") == ids("b")).select("query_id", F.explode(F.arrays_zip("a", "b")).alias("p"))
    scores = pairs.where(F.col("p.a.score") != F.col("p.b.score")).select(
        "query_id", F.col("p.a.passage_id").alias("passage_id"), F.lit("scores").alias("kind")
    )
    return lists.unionByName(scores)


def difference_tally(differences: DataFrame) -> DataFrame:
    return differences.groupBy("kind").agg(F.count("*").alias("differences"))


def expectation_misses(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, kind 'attendu') of queries none of whose expected records was found."""
    hit = expected.join(found, ["query_id", "question_id"], "left_semi").select("query_id").distinct()
    return expected.select("query_id").distinct().join(hit, "query_id", "left_anti").withColumn("kind", F.lit("attendu"))


def result_contract(hits: DataFrame, queries: DataFrame, limit: Column) -> DataFrame:
    """(query_id, n_rows, only_answers, ok): between one row and the limit, answers only."""
    counted = hits.groupBy("query_id").agg(
        F.count("*").alias("n_rows"), F.bool_and(F.col("section") == "reponse").alias("only_answers")
    )
    return queries.join(counted, "query_id", "left").select(
        "query_id",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("only_answers", F.lit(True)).alias("only_answers"),
        (F.coalesce("n_rows", F.lit(0)).between(1, limit) & F.coalesce("only_answers", F.lit(True))).alias("ok"),
    )


def title_vocabulary(records: DataFrame) -> DataFrame:
    """(word): distinct title words of four letters or more."""
    words = F.regexp_extract_all(fold_accents(F.col("titre")), F.lit("[a-z]{4,}"), F.lit(0))
    return records.select(F.explode(words).alias("word")).distinct()


def _draw(seed: int, digits: int, *columns: str) -> Column:
    """A number drawn by the seed for each value: leading hex digits of an md5 digest, as any engine computes it."""
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key), 1, digits), 16, 10).cast("bigint")


def random_queries(vocabulary: DataFrame, count: int, seed: int) -> DataFrame:
    """(query_id, text): ``count`` queries of one to four words, the same for the same seed and words.

    Words are numbered in hash buckets, so that no task sorts them all, and each
    query draws numbers by hash; a word drawn twice stands once. Without words
    there are no queries.
    """
    dealt = vocabulary.select("word").distinct().withColumn("_bucket", _draw(seed, 3, "word"))
    sizes = dealt.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    placed = dealt.withColumn("_at", F.row_number().over(W.partitionBy("_bucket").orderBy("word")) - 1)
    numbered = placed.join(F.broadcast(starts), "_bucket").select("word", (F.col("_start") + F.col("_at")).alias("_number"))
    total = sizes.agg(F.sum("_size").alias("_total")).scalar()
    asked = vocabulary.sparkSession.range(count).withColumnRenamed("id", "query_id").withColumn("_total", total).where("_total > 0")
    draws = asked.select(
        "query_id", "_total", F.explode(F.sequence(F.lit(1), (1 + F.pmod(_draw(seed, 12, "query_id"), F.lit(4))).cast("int"))).alias("_n")
    ).select("query_id", "_n", F.pmod(_draw(seed, 12, "query_id", "_n"), F.col("_total")).alias("_number"))
    words = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_n", "word"))), lambda x: x["word"]))
    return draws.join(numbered, "_number").groupBy("query_id").agg(F.array_join(words, " ").alias("text"))


def rare_title_words(records: DataFrame) -> DataFrame:
    """(word, question_id): title words of five letters or more whose root stands in a single record, which is answered.

    Searched alone, each must bring its record back. Of words of one root the last of the title counts. Words are
    reduced to the first and last record that have them before their roots are taken, so a frequent word gathers nothing.
    """
    texts = F.concat_ws(" ", "titre", "auteur", "question", "reponse")
    single = F.col("_first") == F.col("_last")
    spread = [F.min("question_id").alias("_first"), F.max("question_id").alias("_last")]
    again = [F.min("_first").alias("_first"), F.max("_last").alias("_last")]
    said = records.select("question_id", F.explode_outer(F.array_distinct(query_words(texts))).alias("word"))
    everywhere = with_stems(said.groupBy("word").agg(*spread).where("word is not null")).groupBy("stem").agg(*again).where(single)
    letters = F.regexp_extract_all(fold_accents(F.col("titre")), F.lit("[a-z]{5,}"), F.lit(0))
    letters = F.array_distinct(F.filter(letters, lambda w: ~w.isin(*STOP_WORDS)))
    titled = answered(records).select("question_id", F.posexplode(letters).alias("pos", "word")).groupBy("word").agg(*spread, F.max("pos").alias("pos"))
    owners = with_stems(titled).groupBy("stem").agg(*again, F.max_by("word", "pos").alias("word")).where(single)
    return owners.join(everywhere.select("stem"), "stem", "left_semi").select("word", F.col("_first").alias("question_id"))


def seeded_order(words: DataFrame, seed: int, limit: int) -> DataFrame:
    """The first ``limit`` words of a reproducible shuffle."""
    return words.orderBy(F.md5(F.concat_ws(":", "word", F.lit(str(seed)))), "word").limit(limit)


def _durations(logs: DataFrame, *others: Column) -> DataFrame:
    return logs.select(*others, F.explode(F.from_json("payload", "ms map<string,int>")["ms"]).alias("step", "ms"))


def latency_statistics(logs: DataFrame) -> DataFrame:
    """(step, requests, mean_ms, p50_ms, p95_ms, max_ms) from request logs (payload: JSON with an ``ms`` map)."""
    steps = _durations(logs)
    # Percentiles keep one count per distinct duration, whole milliseconds.
    return steps.groupBy("step").agg(
        F.count("*").alias("requests"),
        F.avg("ms").alias("mean_ms"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ms)").cast("int").alias("p50_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").cast("int").alias("p95_ms"),
        F.max("ms").alias("max_ms"),
    )


def hourly_sketches(logs: DataFrame) -> DataFrame:
    """(hour, step, requests, min_ms, max_ms, sketch) from request logs (ts, payload): quantile sketches of bounded size, which can be merged."""
    known = _durations(logs, F.date_trunc("hour", "ts").alias("hour")).where(F.col("ms").isNotNull())
    return known.groupBy("hour", "step").agg(
        F.count("*").alias("requests"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"),
        F.kll_sketch_agg_bigint(F.col("ms").cast("long"), SKETCH_SIZE).alias("sketch"),
    )


def sketched_percentiles(sketches: DataFrame, keys: list[str], shares: tuple[float, ...] = SHARES) -> DataFrame:
    """(keys, requests, min_ms, max_ms, share, ms) of the merged sketches: by step, by step and hour, or by any coarser key."""
    merged = sketches.groupBy(*keys).agg(
        F.sum("requests").alias("requests"), F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms"),
        F.kll_merge_agg_bigint("sketch", SKETCH_SIZE).alias("sketch"),
    )
    found = F.inline(F.array(*[F.struct(F.lit(x).alias("share"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(x)).alias("ms")) for x in shares]))
    return merged.select(*keys, "requests", "min_ms", "max_ms", found)


def rank_errors(logs: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (step, share, ms...) with rank_error: how far its share lies outside the shares of durations below and up to its value."""
    durations = _durations(logs).where(F.col("ms").isNotNull()).select("step", F.col("ms").alias("own_ms"))
    # A row for each step and share: few, whatever the logs hold.
    beside = durations.join(F.broadcast(found.select("step", "share", "ms")), "step").groupBy("step", "share").agg(
        (F.count_if(F.col("own_ms") < F.col("ms")) / F.count("*")).alias("below"), (F.count_if(F.col("own_ms") <= F.col("ms")) / F.count("*")).alias("up_to")
    )
    error = F.greatest(F.col("below") - F.col("share"), F.col("share") - F.col("up_to"), F.lit(0.0))
    return found.join(beside, ["step", "share"]).withColumn("rank_error", error)


def outcome_counts(logs: DataFrame) -> DataFrame:
    """(code, requests) of request logs by normalised failure code."""
    from quaestor.functions.records import failure_code

    return logs.groupBy(failure_code(F.col("message")).alias("code")).agg(F.count("*").alias("requests"))


def has_answer(records: DataFrame) -> DataFrame:
    return records.select("question_id", present(F.col("reponse")).alias("answered"))
