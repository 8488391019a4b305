"""An index that is stored once and searched many times, and that follows its corpus by differences.

The index lives in segments, folders written once and named by a commit (``sources.commit_log``):

- ``postings``: a row for each term and slot of records, with whether any of them has the term in its title (the
  block's largest factor) and the records; records are dealt to slots by hash, alike for all terms, so that
  the blocks of several terms can be bounded together;
- ``frequencies``: records of each term, negative for records that left;
- ``forms``: the written forms of each term;
- ``contents``: the records themselves;
- ``removed``: records of earlier segments that this one replaces or drops.

Postings, frequencies and forms are partitioned by a hash of the term, contents by one of the record: a search reads the
folders of its own terms, and of a block its bound first and its records only if it can reach the k-th score.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaestor.fixed_values import MAX_QUERY_TERMS, MAX_RESULTS, TITLE_WEIGHT
from quaestor.functions.records import content_hash
from quaestor.functions.stemming import with_stems
from quaestor.functions.text import fold_accents, index_words, word_array
from quaestor.operators.lexical import TERM_ROW_BYTES, answered, idf, indexed_text, least_power, power_of
from quaestor.operators.ranking import tied
from quaestor.operators.sizing import BROADCAST_BYTES, counted_side, hot_join, small_side
from quaestor.session import materialised
from quaestor.sources.commit_log import CommitLog

#: Records of a slot on average, and folders of each table.
SLOT_RECORDS, PARTS = 8, 32
#: Files that a folder's rows are spread over while they are written.
WRITERS_PER_PART = 8
#: Characters of text whose words a task puts in order at once, and written forms of which each task has the roots.
TASK_CHARS, TOLD_FORMS = 16 << 20, BROADCAST_BYTES // TERM_ROW_BYTES
#: Bytes of an id.
ID_BYTES = 32
#: Slots of a query that are scored before any is skipped.
FIRST_SLOTS = 16
#: Terms or records up to which a scan is told them by value; more are joined.
LITERALS = 4096
#: Segments beyond which a refresh rewrites the index as one.
MOST_SEGMENTS = 8
#: What rounding can add to a bound of at most ``MAX_QUERY_TERMS`` summands.
SLACK = 1e-8

POSTINGS = "term string, slot int, titled boolean, n int, entries array<struct<question_id:string,in_title:boolean>>, part int"
FREQUENCIES = "term string, df long, part int"
FORMS = "term string, word string, part int"
COUNTED_FORMS = "term string, word string, n long, part int"
REMOVED = "question_id string"
MEMBERS = "question_id string, content_hash string"


def part_of(key: str | Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _said(rows: DataFrame, words: Column) -> DataFrame:
    """The words of each row (title_words), one by one, and whether they stand in its title."""
    said = rows.withColumn("word", F.explode_outer(words)).where("word != ''")
    return said.withColumn("in_title", F.array_contains("title_words", F.col("word"))).drop("title_words", "words")


def _rooted_apart(records: DataFrame, frequent: DataFrame, rare: DataFrame) -> DataFrame:
    """Rows like those of records, each with a term that a record has in a ``rare`` form (word, term)."""
    seldom = _said(records, F.col("words")).join(frequent, "word", "left_anti").join(rare, "word")
    titles = F.when(F.col("in_title"), F.array("term")).when(~F.col("in_title"), F.array().cast("array<string>"))
    return seldom.select("question_id", "slot", titles.alias("title_words"), F.col("term").alias("words"), F.lit(True).alias("rooted"))


def term_blocks(
    records: DataFrame, forms: DataFrame | None, slots: int, tasks: int | None = None, least: int = 0, parts: int = PARTS
) -> DataFrame:
    """(part, term, slot, titled, n, entries) of the answered records, by written forms (word, term); None: words are terms.

    Whole records are shuffled to the ``tasks`` of their slots; there their words are put in order once, so that the entries
    of a block stand together and the blocks come out in the order they are stored in. A record that has a root in several
    forms is one entry. Forms are sent to every task; if they are too many, only those that occur 2^``least`` times or more
    (n), and what is said in others finds its root before, apart from the texts.
    """
    prepared = answered(records).select(
        "question_id",
        part_of("question_id", slots).alias("slot"),
        index_words(F.col("titre")).alias("title_words"),
        F.array_distinct(index_words(indexed_text())).alias("words"),
    )
    # Words have no spaces; as one text they take half the room of an array.
    packed = prepared.withColumns({"words": F.array_join("words", " "), "rooted": F.lit(False)})
    frequent = forms
    if least:
        frequent = F.broadcast(forms.where(power_of("n") >= least).select("word", "term"))
        packed = packed.unionByName(_rooted_apart(prepared, frequent, forms.where(power_of("n") < least).select("word", "term")))
    dealt = packed.repartition("slot") if tasks is None else packed.repartition(tasks, "slot")
    rooted = _said(dealt, F.split("words", " "))
    if least:
        rooted = rooted.join(frequent, "word", "left").withColumn("term", F.when(F.col("rooted"), F.col("word")).otherwise(F.col("term"))).where("term is not null")
    else:
        rooted = rooted.withColumnRenamed("word", "term") if forms is None else rooted.join(F.broadcast(forms.select("word", "term")), "word")
    rooted = rooted.select("question_id", "slot", "term", "in_title", part_of("term", parts).alias("part"))
    block = W.partitionBy("part", "term", "slot").orderBy("question_id")
    every = block.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    entry = F.struct("question_id", "in_title")
    found = rooted.withColumns({"found": F.collect_list(entry).over(every), "place": F.row_number().over(block)}).where("place = 1")
    titled = F.array_distinct(F.transform(F.filter("found", lambda e: e["in_title"]), lambda e: e["question_id"]))
    sides = found.select("part", "term", "slot", F.transform("found", lambda e: e["question_id"]).alias("all"), titled.alias("titled"))

    def entries(ids: Column, in_title: bool) -> Column:
        return F.transform(ids, lambda x: F.struct(x.alias("question_id"), F.lit(in_title).alias("in_title")))

    both = F.concat(entries(F.col("titled"), True), entries(F.array_except("all", "titled"), False))
    blocks = sides.select("part", "term", "slot", (F.size("titled") > 0).alias("titled"), both.alias("entries"))
    return blocks.select("part", "term", "slot", "titled", F.size("entries").alias("n"), "entries")


def _tasks(chars: int, spark: SparkSession) -> int:
    """Tasks that texts of so many characters are dealt to: bounded ones, and small ones as long as there are cores for them."""
    return max(-(-chars // TASK_CHARS), min(spark.sparkContext.defaultParallelism, -(-chars // (TASK_CHARS >> 4))), 1)


def _volume(kept: DataFrame) -> tuple[int, int]:
    """How many records there are and how many tasks their texts take."""
    row = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(indexed_text())), F.lit(0)).alias("chars")).first()
    return row.n, _tasks(row.chars, kept.sparkSession)


def _counted(forms: DataFrame) -> tuple[DataFrame, int]:
    """(word, term, n): stored written forms once each, and the least power of two of those that are sent to every task."""
    once = forms.groupBy("word", "term").agg(F.sum(F.coalesce("n", F.lit(1))).alias("n"))
    return once, least_power(once, TOLD_FORMS)


@dataclass(frozen=True)
class StoredIndex:
    """One snapshot of an index."""

    log: CommitLog
    number: int
    state: dict[str, Any]

    @property
    def spark(self) -> SparkSession:
        return self.log.spark

    @property
    def parts(self) -> int:
        return self.state["parts"]

    @property
    def slots(self) -> int:
        return self.state["slots"]

    @property
    def n_records(self) -> int:
        return self.state["n_records"]

    def folders(self, name: str) -> list[str]:
        return [f"{x}/{name}" for x in self.state["segments"]]

    def table(self, name: str, schema: str) -> DataFrame:
        """A table of all segments."""
        rows = None
        for folder in self.folders(name):
            one = self.log.read([folder], schema)
            rows = one if rows is None else rows.unionByName(one)
        return rows

    def removed_after(self, segment: int) -> DataFrame | None:
        """Records that a later segment replaces or drops, None if there is no later one."""
        later = self.folders("removed")[segment + 1 :]
        return counted_side(self.log.read(later, REMOVED).distinct(), ID_BYTES) if later else None

    def live(self, name: str, schema: str) -> DataFrame:
        """A table of records without those that later segments remove."""
        rows = None
        for i, folder in enumerate(self.folders(name)):
            one, gone = self.log.read([folder], schema), self.removed_after(i)
            one = one if gone is None else one.join(gone, "question_id", "left_anti")
            rows = one if rows is None else rows.unionByName(one)
        return rows

    def contents(self) -> DataFrame:
        return self.live("contents", self.state["contents"])

    def members(self) -> DataFrame:
        return self.live("members", MEMBERS)

    def entries(self, choose: Callable[[DataFrame], DataFrame] = lambda blocks: blocks) -> DataFrame:
        """(term, slot, question_id, in_title) of the records that are still there, of the blocks that ``choose`` keeps."""
        rows = None
        for i, folder in enumerate(self.folders("postings")):
            one = choose(self.log.read([folder], POSTINGS))
            one = one.select("term", "slot", F.inline("entries"))
            gone = self.removed_after(i)
            one = one if gone is None else one.join(gone, "question_id", "left_anti")
            rows = one if rows is None else rows.unionByName(one)
        return rows

    def frequencies(self) -> DataFrame:
        """(term, df) of all terms that a record still has."""
        return self.table("frequencies", FREQUENCIES).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


# ---- writing ----


def _hashed(records: DataFrame) -> DataFrame:
    fields = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    return records.withColumn("content_hash", content_hash(fields, F.lit("index")))


def _in_place(rows: DataFrame, path: str, *order: str) -> None:
    """Writes rows (with part) to the folders of their parts from where they are."""
    rows.sortWithinPartitions("part", *order).write.partitionBy("part").parquet(path)


def _written(rows: DataFrame, path: str, parts: int, key: str) -> None:
    rows = rows.withColumn("part", part_of(key, parts))
    spread = rows.repartition("part", F.pmod(F.xxhash64(*rows.columns[:2]), F.lit(WRITERS_PER_PART)))
    _in_place(spread, path, key)


def _segment(
    log: CommitLog, records: DataFrame, removed: DataFrame, negative: DataFrame | None, parts: int, slots: int | None, stemmed: bool
) -> tuple[str, int, int]:
    """Writes a segment of ``records`` (with content_hash); its folder, the number of its answered records and the slots.

    ``negative``: (term, df) of records that leave. ``slots``: None for as many as the records need. The records are
    worked out once, for their own table; all others are made from that.
    """
    folder = log.folder("segments")
    path = f"{log.root}/{folder}"
    _in_place(records.withColumn("part", part_of("question_id", parts)), f"{path}/contents", "question_id")
    stored = log.read([f"{folder}/contents"], _schema_of(records)).drop("part")
    stored.select("question_id", "content_hash").write.parquet(f"{path}/members")
    removed.select("question_id").write.parquet(f"{path}/removed")
    kept = answered(stored)
    n, tasks = _volume(kept)
    slots = max(1, -(-n // SLOT_RECORDS)) if slots is None else slots
    forms, least = None, 0
    if stemmed:
        words = kept.select(F.explode_outer(F.array_distinct(word_array(fold_accents(indexed_text())))).alias("word"))
        roots = with_stems(words.groupBy("word").agg(F.count("*").alias("n")), "word", "term")
        _written(roots.select("term", "word", "n"), f"{path}/forms", parts, "term")
        forms, least = _counted(log.read([f"{folder}/forms"], COUNTED_FORMS))
    _in_place(term_blocks(kept, forms, slots, tasks, least, parts), f"{path}/postings", "term", "slot")
    if not stemmed:
        said = log.read([f"{folder}/postings"], POSTINGS).select("term").distinct()
        _written(said.select("term", F.col("term").alias("word")), f"{path}/forms", parts, "term")
    counted = log.read([f"{folder}/postings"], POSTINGS).groupBy("term").agg(F.sum("n").alias("df"))
    if negative is not None:
        counted = counted.unionByName(negative.select("term", (-F.col("df")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df")).where("df != 0")
    _written(counted, f"{path}/frequencies", parts, "term")
    return folder, n, slots


def _schema_of(records: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema) + ", part int"


def build_index(records: DataFrame, root: str, version: str, stemmed: bool = True, parts: int = PARTS) -> StoredIndex:
    """Writes the index of ``records`` (question_id once each) as the new state under ``root``."""
    log = CommitLog(records.sparkSession, root)
    hashed = _hashed(records)
    folder, n, slots = _segment(log, hashed, hashed.limit(0), None, parts, None, stemmed)
    state = {"version": version, "stemmed": stemmed, "parts": parts, "slots": slots, "n_records": n, "contents": _schema_of(records), "segments": [folder]}
    number = log.commit(lambda _, before: state)
    return StoredIndex(log, number, state)


def open_index(spark: SparkSession, root: str, number: int | None = None) -> StoredIndex:
    """The last snapshot under ``root``, or a numbered one."""
    log = CommitLog(spark, root)
    number, state = log.state(number)
    if not state:
        raise FileNotFoundError(f"no index under {root}")
    return StoredIndex(log, number, state)


def refresh_index(records: DataFrame, root: str, version: str) -> StoredIndex:
    """Brings the index to ``records`` by what changed: records that are new or differ are indexed, those gone are taken off.

    Of the unchanged records only the digests are compared. Beyond ``MOST_SEGMENTS`` the index is
    written anew; so it is when it has outgrown its slots twice over.
    """
    log = CommitLog(records.sparkSession, root)

    def change(number: int, state: dict[str, Any]) -> dict[str, Any]:
        index = StoredIndex(log, number, state)
        hashed, keys = _hashed(records), ["question_id", "content_hash"]
        before, own = index.members(), materialised(hashed.select(*keys))
        # Digests are compared, then the texts of those that differ are looked up: equal digests are equal records.
        differ = counted_side(own.join(before, keys, "left_anti").select("content_hash").distinct(), TERM_ROW_BYTES)
        changed = hashed.join(differ, "content_hash", "left_semi").select(*hashed.columns)
        removed = materialised(before.join(own, keys, "left_anti").select("question_id"))
        gone = answered(records_of(index, removed))
        left, tasks = _volume(gone)
        # Every word of a stored record is among the forms of the segments.
        forms, least = _counted(index.table("forms", COUNTED_FORMS)) if state["stemmed"] else (None, 0)
        negative = term_blocks(gone, forms, index.slots, tasks, least, index.parts).groupBy("term").agg(F.sum("n").alias("df"))
        folder, n, _ = _segment(log, changed, removed, negative, index.parts, index.slots, state["stemmed"])
        new = {**state, "version": version, "n_records": state["n_records"] + n - left, "segments": [*state["segments"], folder]}
        if len(new["segments"]) > MOST_SEGMENTS or new["n_records"] > 2 * SLOT_RECORDS * index.slots:
            folder, n, slots = _segment(log, hashed, hashed.limit(0), None, index.parts, None, state["stemmed"])
            new = {**new, "slots": slots, "segments": [folder]}
        return new

    number = log.commit(change)
    return open_index(records.sparkSession, root, number)


# ---- searching ----


def _chooser(keys: DataFrame, column: str, parts: int) -> Callable[[DataFrame], DataFrame]:
    """Keeps the rows whose ``column`` is among ``keys``, reading the folders of these keys only."""
    keys = keys.select(column).distinct().withColumn("part", part_of(column, parts))
    told = keys.limit(LITERALS + 1).collect()
    if len(told) <= LITERALS:
        folders, values = sorted({r.part for r in told}), [r[column] for r in told]
        return lambda rows: rows.where(F.col("part").isin(folders)).where(F.col(column).isin(values))
    side = counted_side(keys, TERM_ROW_BYTES)
    return lambda rows: rows.join(side, ["part", column], "left_semi")


def _wanted(rows: DataFrame, keys: DataFrame, column: str, parts: int) -> DataFrame:
    return _chooser(keys, column, parts)(rows)


def records_of(index: StoredIndex, ids: DataFrame) -> DataFrame:
    """The stored records of the given question_id."""
    return _wanted(index.contents(), ids, "question_id", index.parts).drop("part")


def written_forms(index: StoredIndex, terms: DataFrame) -> DataFrame:
    """(word, stem): the written forms of the terms, as a vocabulary."""
    return _wanted(index.table("forms", FORMS), terms, "term", index.parts).select("word", F.col("term").alias("stem")).distinct()


def term_weights(index: StoredIndex, terms: DataFrame) -> DataFrame:
    """(term, part, query_id, weight) of the terms that a record has."""
    rows = _wanted(index.table("frequencies", FREQUENCIES), terms, "term", index.parts)
    frequency = rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    weight = idf(F.col("df"), F.lit(index.n_records)) / F.sqrt("n_terms")
    return terms.join(frequency, "term").select("term", part_of("term", index.parts).alias("part"), "query_id", weight.alias("weight"))


def _factor(titled: Column) -> Column:
    return F.when(titled, TITLE_WEIGHT).otherwise(1)


def _bounds(index: StoredIndex, weights: DataFrame, n_terms: int) -> DataFrame:
    """(query_id, slot, bound): no record of the slot scores more. Of the blocks only their heads are read."""
    heads = _wanted(index.table("postings", POSTINGS), weights, "term", index.parts).select("term", "slot", "titled")
    if len(index.state["segments"]) > 1:  # one segment has one block of a term and a slot
        heads = heads.groupBy("term", "slot").agg(F.max("titled").alias("titled"))
    met = hot_join(heads, weights.select("term", "query_id", "weight"), ["term"], "slot", n_terms, TERM_ROW_BYTES)
    return met.groupBy("query_id", "slot").agg(F.sum(F.col("weight") * _factor(F.col("titled"))).alias("bound"))


def _scored(index: StoredIndex, chosen: DataFrame, weights: DataFrame, n_terms: int) -> DataFrame:
    """(query_id, question_id, lexical) of all records in the chosen slots (query_id, slot) of each query."""
    asked = materialised(chosen.join(weights, "query_id").select("part", "term", "slot", "query_id", "weight"))
    blocks = counted_side(asked.select("part", "term", "slot").distinct(), TERM_ROW_BYTES)
    of_terms = _chooser(asked, "term", index.parts)
    entries = index.entries(lambda rows: of_terms(rows).join(blocks, ["part", "term", "slot"], "left_semi"))
    asked = small_side(asked.drop("part"), asked.count(), TERM_ROW_BYTES)
    met = entries.join(asked, ["term", "slot"])
    return met.groupBy("query_id", "question_id").agg(F.sum(F.col("weight") * _factor(F.col("in_title"))).alias("lexical"))


def indexed_scores(index: StoredIndex, terms: DataFrame, n_queries: int, k: int = MAX_RESULTS) -> DataFrame:
    """(query_id, question_id, lexical): the ``k`` best records of each query, ties by id, and some others.

    The slots of the highest bounds are scored first; then those whose bound still reaches the k-th score.
    """
    n_terms = n_queries * MAX_QUERY_TERMS
    weights = materialised(term_weights(index, terms))
    bounds = materialised(_bounds(index, weights, n_terms))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "slot"))
    first = materialised(bounds.withColumn("place", place).where(F.col("place") <= FIRST_SLOTS).select("query_id", "slot"))
    scored = materialised(_best_of(_scored(index, first, weights, n_terms), k))
    last = scored.where(F.col("place") == k).select("query_id", F.col("lexical").alias("least"))
    rest = bounds.join(small_side(last, n_queries, 24), "query_id", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK)
    rest = rest.select("query_id", "slot").join(small_side(first, n_queries * FIRST_SLOTS, 24), ["query_id", "slot"], "left_anti")
    more = _best_of(_scored(index, rest, weights, n_terms), k)
    return scored.unionByName(more).drop("place")


def _best_of(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best records of each query by score, ties by id, with their place."""
    order = W.partitionBy("query_id").orderBy(F.desc(tied(F.col("lexical"))), "question_id")
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def read_share(index: StoredIndex, terms: DataFrame, n_queries: int, k: int = MAX_RESULTS) -> DataFrame:
    """(query_id, slots, scored): how many slots hold a term of the query, and how many of them a search has to read."""
    weights = materialised(term_weights(index, terms))
    bounds = _bounds(index, weights, n_queries * MAX_QUERY_TERMS)
    best = _best_of(indexed_scores(index, terms, n_queries, k), k)
    last = best.where(F.col("place") == k).select("query_id", F.col("lexical").alias("least"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "slot"))
    judged = bounds.withColumn("place", place).join(small_side(last, n_queries, 24), "query_id", "left")
    needed = (F.col("place") <= FIRST_SLOTS) | (F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK)
    return judged.groupBy("query_id").agg(F.count("*").alias("slots"), F.sum(needed.cast("long")).alias("scored"))
