"""From hits to cited answers: follow-ups, context, excerpts, sources, checks of generated answers."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaestor.fixed_values import (
    ANSWER_STATUSES,
    CONTEXT_BEST_RECORDS,
    CONTEXT_LIMIT,
    CONTEXT_ROUNDS,
    EXCERPT_CHARS,
    EXTRACT_HITS,
    EXTRACT_NOTICE,
    FOLLOWUP_MAX_TOKENS,
    GENERATED_NOTICE,
    INCOMPETENCE_TEXT,
    INSUFFICIENT_NOTICE,
    INSUFFICIENT_TEXT,
    MAX_HISTORY,
    MAX_PARAGRAPH_CHARS,
    MAX_PARAGRAPHS,
    NEW_TOPIC_PATTERN,
    PASSAGE_TEXT,
    PASSAGES_TEXT,
    SHORT_FOLLOWUP_PATTERN,
    SOURCE_FOLLOWUP_PATTERN,
)
from quaestor.functions.records import date_label, nature, official_url, present
from quaestor.functions.stemming import with_stems
from quaestor.functions.text import expanded, fold_accents, once, query_words, sentence_pieces
from quaestor.operators.lexical import root_maps, rooted
from quaestor.operators.running import running


def opens_followup(text: Column) -> Column:
    """Openings that make a message a follow-up if it is short."""
    return fold_accents(F.trim(text)).rlike(SHORT_FOLLOWUP_PATTERN)


def is_followup(text: Column, roots: Column | None = None) -> Column:
    """A message that continues the previous one rather than naming its own topic.

    ``roots``: map from each word to its root; words count as written without it.
    """
    folded = fold_accents(F.trim(text))
    short = opens_followup(text) & (F.size(F.array_distinct(rooted(query_words(text), roots))) < FOLLOWUP_MAX_TOKENS)
    return ~folded.rlike(NEW_TOPIC_PATTERN) & (short | folded.rlike(SOURCE_FOLLOWUP_PATTERN))


def contextual_query(message: Column, history: Column, roots: Column | None = None) -> Column:
    """The message preceded by what it follows up on.

    ``history``: earlier user questions, oldest first. The newest ones are taken
    back to the first that is not itself a follow-up, four at most.
    """
    newest = F.slice(F.reverse(history), 1, MAX_HISTORY)
    taken = F.aggregate(
        newest,
        F.struct(F.lit("").alias("text"), F.lit(True).alias("open")),
        lambda acc, h: F.when(
            acc["open"], F.struct(F.concat(h, F.lit(" "), acc["text"]).alias("text"), is_followup(h, roots).alias("open"))
        ).otherwise(acc),
    )["text"]
    return F.when(is_followup(message, roots) & (F.size(history) > 0), F.concat(taken, message)).otherwise(message)


def conversation_queries(turns: DataFrame, chunk_turns: int = 1000) -> DataFrame:
    """(conv_id, turn, text, followup, query): user turns with their contextual query.

    ``turns``: conv_id, turn, role, text. The last four questions before a turn
    are found through their rank among the user turns, computed in two levels,
    and a window over slices of the conversation that overlap by four turns: a
    conversation of any length is spread over many tasks.
    """
    user = turns.where(F.col("role") == "user").select("conv_id", "turn", "text", F.xxhash64("text").alias("_said"))
    # Only messages with such an opening are counted by roots.
    keys = ["conv_id", "turn", "_said"]
    roots = root_maps(user.where(opens_followup(F.col("text"))), keys, query_words(F.col("text")))
    roots = roots.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "roots")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    flagged = user.join(roots, same, "left").select(
        "conv_id", "turn", "text", is_followup(F.col("text"), F.col("roots")).alias("followup")
    )
    ranked = running(flagged, ["conv_id"], F.floor(F.col("turn") / chunk_turns), ["turn"], sums={"n": F.lit(1)})
    slice_of = F.floor((F.col("n") - 1) / chunk_turns)
    # The last turns of a slice are also read, as history only, by the next one.
    tail = F.pmod(F.col("n") - 1, F.lit(chunk_turns)) >= chunk_turns - MAX_HISTORY
    homes = F.when(tail, F.array(slice_of, slice_of + 1)).otherwise(F.array(slice_of))
    spread = ranked.select("*", slice_of.alias("_home"), F.explode(homes).alias("_slice"))
    order = W.partitionBy("conv_id", "_slice").orderBy("n")
    opened = F.lit(True)
    context = []
    for back in range(1, MAX_HISTORY + 1):
        context.append(F.when(opened, F.lag("text", back).over(order)))
        opened = opened & F.coalesce(F.lag("followup", back).over(order), F.lit(False))
    query = F.when(F.col("followup"), F.concat_ws(" ", *reversed(context), "text")).otherwise(F.col("text"))
    return spread.select("conv_id", "turn", "text", "followup", query.alias("query"), "_home", "_slice").where(
        F.col("_home") == F.col("_slice")
    ).drop("_home", "_slice")


def context_hits(hits: DataFrame, record_passages: DataFrame, queries: DataFrame, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """The hits, then other answer passages of the same records that hold a word of the query's roots.

    ``record_passages``: question_id, passage_id, section, position, content. One
    more passage per record in turn, best records first; only the three best get
    more than one. Adds ``context_rank`` and ``origin``.
    """
    first = hits.groupBy("query_id", "question_id").agg(F.min("hit_rank").alias("first_hit"))
    order = W.partitionBy("query_id")
    numbered = first.withColumn("record_rank", F.row_number().over(order.orderBy("first_hit"))).join(
        hits.groupBy("query_id").agg(F.count("*").alias("n_hits")), "query_id"
    )
    wanted = with_stems(queries.select("query_id", F.explode(F.array_distinct(query_words(expanded(F.col("text"))))).alias("word")))
    wanted = wanted.select("query_id", "stem").distinct()
    others = (
        record_passages.where(F.col("section") == "reponse")
        .join(numbered, "question_id")
        .join(hits.select("query_id", "passage_id"), ["query_id", "passage_id"], "left_anti")
    )
    said = others.select("query_id", "passage_id", F.explode(F.array_distinct(query_words(F.col("content")))).alias("word"))
    mentions = with_stems(said).join(wanted, ["query_id", "stem"]).select("query_id", "passage_id").distinct()
    others = others.join(mentions, ["query_id", "passage_id"], "left_semi")
    by_position = W.partitionBy("query_id", "question_id").orderBy("position")
    extra = others.withColumn("round", F.row_number().over(by_position)).where(
        (F.col("round") <= CONTEXT_ROUNDS) & ((F.col("round") == 1) | (F.col("record_rank") <= CONTEXT_BEST_RECORDS))
    )
    ranked = extra.withColumn(
        "context_rank", F.col("n_hits") + F.row_number().over(order.orderBy("round", "record_rank"))
    ).where(F.col("context_rank") <= limit)
    columns = ["query_id", "context_rank", "passage_id", "question_id", "position", "content"]
    return (
        hits.withColumn("context_rank", F.col("hit_rank"))
        .select(*columns, F.lit("hit").alias("origin"))
        .unionByName(ranked.select(*columns, F.lit("context").alias("origin")))
    )


def focused_excerpts(text: Column, focuses: Column, max_chars: int = EXCERPT_CHARS, roots: Column | None = None) -> Column:
    """Parts of a text around the words of each focus, whole sentences, in order, cut marks added.

    ``focuses``: array of word arrays; ``roots``: map from the words of both to
    their roots, which are compared (words as written without it). For each focus the piece with most of its
    words grows towards the neighbour with more of them while it fits; windows
    that touch are merged. Written with array functions over the pieces of one
    passage, so excerpts stay in the JVM.
    """
    clean = F.trim(F.regexp_replace(text, "[ \t]+", " "))

    def opened(excerpt: Column) -> Column:
        return excerpt.rlike(r"^\p{Ll}")

    pieces = sentence_pieces(clean)
    prepared = F.transform(
        pieces, lambda p: F.struct(F.length(p).alias("size"), F.array_distinct(rooted(query_words(p), roots)).alias("words"), p.alias("text"))
    )

    def window(parts: Column, focus: Column) -> Column:
        # The words of the focus and the matches of the pieces are computed once, not again for each piece.
        return once(focus, lambda f: once(F.transform(parts, lambda p: F.size(F.array_intersect(p["words"], f))), lambda matches: grown(parts, matches)))

    def grown(parts: Column, matches: Column) -> Column:
        best = F.array_position(matches, F.array_max(matches))
        begin = F.struct(
            best.cast("int").alias("first"), best.cast("int").alias("last"), F.element_at(parts, best.cast("int"))["size"].alias("size")
        )

        def grow(state: Column, _: Column) -> Column:
            before, after = F.get(parts, state["first"] - 2), F.get(parts, state["last"])
            fits_before = F.coalesce(state["size"] + before["size"] <= max_chars, F.lit(False))
            fits_after = F.coalesce(state["size"] + after["size"] <= max_chars, F.lit(False))
            backwards = fits_before & (
                ~fits_after | (F.get(matches, state["first"] - 2) > F.get(matches, state["last"]))
            )
            return (
                F.when(backwards, F.struct((state["first"] - 1).alias("first"), state["last"].alias("last"), (state["size"] + before["size"]).alias("size")))
                .when(fits_after, F.struct(state["first"].alias("first"), (state["last"] + 1).alias("last"), (state["size"] + after["size"]).alias("size")))
                .otherwise(state)
            )

        return F.aggregate(parts, begin, grow)

    def merge(acc: Column, w: Column) -> Column:
        last = F.element_at(acc, -1)
        touches = (F.size(acc) > 0) & (w["first"] - 1 <= last["last"])
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], w["last"]).alias("last"), last["size"].alias("size"))
        return F.when(touches, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(w)))

    def excerpts(parts: Column) -> Column:
        windows = F.array_sort(F.transform(focuses, lambda f: window(parts, rooted(f, roots))))
        empty = F.array().cast("array<struct<first:int,last:int,size:int>>")
        merged = F.aggregate(windows, empty, merge)

        def excerpt(w: Column) -> Column:
            joined = F.trim(
                F.array_join(F.transform(F.slice(parts, w["first"], w["last"] - w["first"] + 1), lambda p: p["text"]), "")
            )
            joined = F.regexp_replace(joined, r"^\s+|\s+$", "")
            return F.concat(
                F.when((w["first"] > 1) | opened(joined), "… ").otherwise(""),
                joined,
                F.when(w["last"] < F.size(parts), " …").otherwise(""),
            )

        return F.transform(merged, excerpt)

    whole = F.array(F.concat(F.when(opened(clean), "… ").otherwise(""), clean))
    # The pieces are computed once and handed to the functions above.
    cut = once(prepared, excerpts)
    return F.when(F.length(clean) <= max_chars, whole).otherwise(cut)


def with_excerpts(cited: DataFrame) -> DataFrame:
    """Adds the excerpts of each cited passage (query_id, passage_id, content, focuses...), words compared by root."""
    keys = ["query_id", "passage_id"]
    roots = root_maps(cited, keys, F.concat(query_words(F.col("content")), F.flatten("focuses")))
    cut = focused_excerpts(F.col("content"), F.col("focuses"), roots=F.col("roots"))
    # Few rows, each of much work: without a number of their own they would be put together in one task.
    spread = cited.join(roots, keys, "left").repartition(cited.sparkSession.sparkContext.defaultParallelism, *keys)
    return spread.withColumn("excerpts", cut).drop("roots")


def sources(cited: DataFrame, records: DataFrame, hosts: Iterable[str]) -> DataFrame:
    """(query_id, question_id, source_id, source_rank, ...): one source per cited record.

    ``cited``: query_id, question_id, passage_id, cite_rank, section, position,
    content, focuses (array of word arrays). Excerpts follow the document:
    question before answer, then position.
    """
    prepared = with_excerpts(cited)
    in_document = F.array_sort(
        F.collect_list(
            F.struct((F.col("section") == "reponse").alias("late"), F.col("position"), F.col("excerpts"), F.col("passage_id"))
        )
    )
    grouped = prepared.groupBy("query_id", "question_id").agg(
        F.min_by("passage_id", "cite_rank").alias("source_id"),
        F.min("cite_rank").alias("first_rank"),
        F.collect_list("passage_id").alias("passage_ids"),
        F.flatten(F.transform(in_document, lambda x: x["excerpts"])).alias("excerpts"),
    )
    order = W.partitionBy("query_id").orderBy("first_rank")
    ranked = grouped.withColumn("source_rank", F.row_number().over(order))
    return records.select(
        "question_id",
        F.col("titre").alias("title"),
        F.col("auteur").alias("author"),
        F.col("destinataire").alias("recipient"),
        F.col("date_reponse").alias("date"),
        official_url(F.col("url_source"), hosts).alias("url"),
        nature(F.col("reponse")).alias("nature"),
    ).join(ranked, "question_id")


def _source_struct() -> Column:
    return F.struct("source_rank", F.col("source_id").alias("id"), "title", "author", "recipient", "date", "url", "excerpts", "nature")


def extractive_answers(hits: DataFrame, queries: DataFrame, records: DataFrame, hosts: Iterable[str]) -> DataFrame:
    """One answer per query from its first three answer hits; 'insuffisant' when there is none.

    (query_id, mode, status, paragraphs, sources, notice).
    """
    order = W.partitionBy("query_id").orderBy("hit_rank")
    first = (
        hits.where(F.col("section") == "reponse")
        .withColumn("cite_rank", F.row_number().over(order))
        .where(F.col("cite_rank") <= EXTRACT_HITS)
    )
    focused = first.join(
        queries.select("query_id", F.array(F.array_distinct(query_words(F.col("text")))).alias("focuses")), "query_id"
    )
    found = sources(focused, records, hosts)
    label = date_label(F.col("date"))
    wording = (
        F.when(F.col("nature") == "incompetence", INCOMPETENCE_TEXT)
        .when(F.size("passage_ids") > 1, PASSAGES_TEXT)
        .otherwise(PASSAGE_TEXT)
    )
    text = F.replace(wording, F.lit("%s"), label)
    paragraph = F.struct("source_rank", text.alias("text"), F.array("source_id").alias("sourceIds"))
    by_query = found.groupBy("query_id").agg(
        F.array_sort(F.collect_list(paragraph)).alias("paragraphs"), F.array_sort(F.collect_list(_source_struct())).alias("sources")
    )
    answered = queries.select("query_id").join(by_query, "query_id", "left")
    none = F.col("paragraphs").isNull()
    return answered.select(
        "query_id",
        F.lit("extraits").alias("mode"),
        F.when(none, "insuffisant").otherwise("documente").alias("status"),
        F.when(none, F.array(F.struct(F.lit(INSUFFICIENT_TEXT).alias("text"), F.array().cast("array<string>").alias("sourceIds"))))
        .otherwise(F.transform("paragraphs", lambda p: F.struct(p["text"].alias("text"), p["sourceIds"].alias("sourceIds"))))
        .alias("paragraphs"),
        F.transform(
            F.coalesce("sources", F.array()),
            lambda s: F.struct(*[s[c].alias(c) for c in ("id", "title", "author", "recipient", "date", "url", "excerpts", "nature")]),
        ).alias("sources"),
        F.when(none, INSUFFICIENT_NOTICE).otherwise(EXTRACT_NOTICE).alias("notice"),
    )


def citation_checks(generated: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, verdict, cited, unknown, uncited): checks of generated answers against their hits.

    The verdict on citations is that of the first paragraph with an error.

    ``generated``: query_id, status, paragraphs array<struct<text, sourceIds>>,
    limits. An insufficient answer drops everything it says.
    """
    paragraphs = generated.select("query_id", F.posexplode("paragraphs").alias("p", "paragraph"))
    cites = paragraphs.select("query_id", F.explode("paragraph.sourceIds").alias("passage_id"))
    known = hits.select("query_id", "passage_id", F.lit(True).alias("known")).distinct()
    # Each query cites a few passages: reduced per query before the hits are looked up.
    looked = cites.distinct().join(known, ["query_id", "passage_id"], "left")
    counts = looked.groupBy("query_id").agg(
        F.count_if("known").alias("cited"),
        F.count_if(F.col("known").isNull()).alias("unknown"),
        F.collect_list(F.when(F.col("known").isNull(), F.col("passage_id"))).alias("_unknown_ids"),
    )

    def error(p: Column) -> Column:
        unknown = F.exists(p["sourceIds"], lambda x: x.isNull() | F.array_contains("_unknown_ids", x))
        return F.when(unknown, "AI_UNKNOWN_CITATION").when(F.size(p["sourceIds"]) == 0, "AI_MISSING_CITATION")

    facts = generated.join(counts, "query_id", "left").na.fill(0, ["cited", "unknown"]).withColumns(
        {
            "uncited": F.size(F.filter("paragraphs", lambda p: F.size(p["sourceIds"]) == 0)),
            "_bad_text": F.exists(
                "paragraphs", lambda p: ~present(p["text"]) | (F.length(p["text"]) > MAX_PARAGRAPH_CHARS)
            ),
            "_error": F.get(F.filter(F.transform("paragraphs", error), lambda e: e.isNotNull()), F.lit(0)),
        }
    )
    verdict = (
        F.when(~F.coalesce(F.col("status").isin(*ANSWER_STATUSES), F.lit(False)), "AI_OUTPUT_INVALID")
        .when(F.col("status") == "insuffisant", "insuffisant")
        .when(~F.size("paragraphs").between(1, MAX_PARAGRAPHS) | F.col("_bad_text"), "AI_OUTPUT_INVALID")
        .otherwise(F.coalesce("_error", F.lit("documente")))
    )
    return facts.select("query_id", verdict.alias("verdict"), "cited", "unknown", "uncited")


def generated_answers(
    generated: DataFrame, checks: DataFrame, hits: DataFrame, records: DataFrame, hosts: Iterable[str]
) -> DataFrame:
    """Accepted generated answers with their sources grouped and citations renumbered.

    Same columns as ``extractive_answers``; rejected answers are left out.
    """
    accepted = generated.join(checks.where(F.col("verdict").isin("documente", "insuffisant")).select("query_id", "verdict"), "query_id")
    documented = accepted.where(F.col("verdict") == "documente")
    paragraphs = documented.select("query_id", F.posexplode("paragraphs").alias("p", "paragraph"))
    cites = paragraphs.select(
        "query_id", "p", F.col("paragraph.text").alias("text"), F.posexplode("paragraph.sourceIds").alias("c", "passage_id")
    )
    cited = cites.groupBy("query_id", "passage_id").agg(
        F.min(F.struct("p", "c")).alias("_first"), F.array_sort(F.collect_set(F.struct("p", "text"))).alias("_texts")
    )
    ordered = cited.select(
        "query_id",
        "passage_id",
        (F.shiftleft(F.col("_first.p").cast("bigint"), 32) + F.col("_first.c")).alias("cite_rank"),
        F.transform("_texts", lambda t: F.array_distinct(query_words(t["text"]))).alias("focuses"),
    )
    found = sources(
        ordered.join(hits.select("query_id", "passage_id", "question_id", "section", "position", "content"), ["query_id", "passage_id"]),
        records,
        hosts,
    )
    renumbered = found.select("query_id", "source_id", F.explode("passage_ids").alias("passage_id"))
    rewritten = (
        cites.join(renumbered, ["query_id", "passage_id"])
        .groupBy("query_id", "p", "text")
        .agg(F.array_sort(F.collect_list(F.struct("c", "source_id"))).alias("_ids"))
        .select(
            "query_id",
            F.struct("p", "text", F.array_distinct(F.transform("_ids", lambda x: x["source_id"])).alias("sourceIds")).alias("paragraph"),
        )
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list("paragraph")).alias("written"))
    )
    by_query = found.groupBy("query_id").agg(F.array_sort(F.collect_list(_source_struct())).alias("sources"))
    joined = accepted.join(rewritten, "query_id", "left").join(by_query, "query_id", "left")
    none = F.col("verdict") == "insuffisant"
    return joined.select(
        "query_id",
        F.lit("ia").alias("mode"),
        F.col("verdict").alias("status"),
        F.when(none, F.array(F.struct(F.lit(INSUFFICIENT_TEXT).alias("text"), F.array().cast("array<string>").alias("sourceIds"))))
        .otherwise(F.transform("written", lambda p: F.struct(p["text"].alias("text"), p["sourceIds"].alias("sourceIds"))))
        .alias("paragraphs"),
        F.transform(
            F.coalesce("sources", F.array()),
            lambda s: F.struct(*[s[c].alias(c) for c in ("id", "title", "author", "recipient", "date", "url", "excerpts", "nature")]),
        ).alias("sources"),
        F.when(none, INSUFFICIENT_NOTICE).when(F.col("limits") != "", F.col("limits")).otherwise(GENERATED_NOTICE).alias("notice"),
    )


def fallback_hits(checks: DataFrame, fresh: DataFrame | None, filtered_hybrid: DataFrame) -> DataFrame:
    """Hits to extract from for rejected syntheses: a fresh lexical search, else the filtered hybrid hits."""
    rejected = checks.where(~F.col("verdict").isin("documente", "insuffisant")).select("query_id")
    return (filtered_hybrid if fresh is None else fresh).join(rejected, "query_id", "left_semi")
