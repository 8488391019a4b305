"""Incremental refresh: what to download again, and how fetched pages change the corpus.

``rows`` are usable index rows (moncode, date_reception, ...); ``current`` are
corpus records (moncode, legislature, date_reception, date_reponse, reponse, ...).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaestor.fixed_values import (
    DEFAULT_LEGISLATURE,
    METHOD_CLOSING,
    METHOD_OPENING,
    METHOD_SENTENCE_PATTERN,
)
from quaestor.fixed_values import (
    CONSECUTIVE_FAILURES,
    MAX_ADDITIONS,
    MAX_DOWNLOADS,
    MAX_EMPTY_TEXTS,
    MAX_MISSING_FROM_INDEX,
    MAX_NETWORK_FAILURES,
    MAX_RECORDS,
)
from quaestor.functions.records import needs_recheck, title_matches
from quaestor.operators.running import running
from quaestor.operators.sizing import counted_side, fits_broadcast, small_side
from quaestor.session import materialised


def recheck_plan(rows: DataFrame, current: DataFrame, today: Column, full: bool = False) -> DataFrame:
    """(moncode, action): 'recheck', 'kept' or 'candidate' for every known or listed record."""
    listed = rows.select("moncode", F.lit(True).alias("_listed"))
    due = F.lit(True) if full else needs_recheck(
        F.col("moncode"), F.col("received"), F.col("reponse"), F.col("date_reponse"), today
    )
    known = current.select(
        "moncode", F.col("date_reception").alias("received"), "reponse", "date_reponse", F.lit(True).alias("_known")
    )
    both = known.join(listed, "moncode", "full")
    return both.select(
        "moncode",
        F.when(F.col("_known").isNull(), "candidate")
        .when(F.coalesce(F.col("_listed"), F.lit(False)) & due, "recheck")
        .otherwise("kept")
        .alias("action"),
    )


def missing_from_index(listed_codes: DataFrame, rows: DataFrame, current: DataFrame) -> DataFrame:
    """(moncode, reason) of current records that no usable row lists."""
    absent = current.select("moncode").join(rows.select("moncode"), "moncode", "left_anti")
    listed = listed_codes.select("moncode", F.lit(True).alias("_listed")).distinct()
    return absent.join(listed, "moncode", "left").select(
        "moncode", F.when(F.col("_listed"), "incomplete_row").otherwise("not_listed").alias("reason")
    )


def _folded(text: Column) -> Column:
    """One form of all letters that a pattern takes for the same one, whatever the case."""
    return F.lower(F.upper(F.translate(text, "İıſ", "iis")))


#: Characters of a key. The longer it is, the fewer titles hold it: three digits would stand in most titles with a number.
KEY_LENGTHS = (12, 6, 3)


def _grams(text: Column, letter: str) -> Column:
    """The runs of so many letters as there are in a key, from each position of a text."""
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=({letter}{{{n}}}))"), F.lit(1)) for n in KEY_LENGTHS]))


def pattern_keys(selections: DataFrame) -> DataFrame:
    """(name, pattern, key) of selections: a run of characters that every title a pattern matches contains, of which few patterns have the same.

    It is taken from the plain text between wildcards, classes and repeated characters, and is as long as one of ``KEY_LENGTHS``. A
    pattern without such text, or with alternatives, groups or bounds, has an empty key.
    """
    simple = F.regexp_replace("pattern", r"\\[bBdDsSwW]", ".")
    simple = F.regexp_replace(simple, r"\[\^?[^\[\]&^\\]+\]", ".")
    unsafe = simple.rlike(r"[|\\(){\[\]]")
    plain = F.regexp_replace(simple, r"(?s).[*+?]+", ".")
    runs = _grams(plain, "[A-Za-z0-9 À-ÖØ-Ýà-öø-ý]")
    grams = F.when(unsafe, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(runs, _folded)))
    numbered = selections.where("pattern is not null").select("name", "pattern", F.monotonically_increasing_id().alias("number"), grams.alias("grams"))
    numbered = materialised(numbered)
    spread = numbered.select("number", F.explode("grams").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("patterns"))
    # Of keys that as many patterns have, the longest.
    rarest = spread.join(shared, "key").groupBy("number").agg(F.min(F.struct("patterns", (-F.length("key")).alias("n"), "key"))["key"].alias("key"))
    return numbered.join(rarest, "number", "left").select("name", "pattern", F.coalesce("key", F.lit("")).alias("key"))


def selected_titles(rows: DataFrame, selections: DataFrame) -> DataFrame:
    """Rows × named selections (name, pattern, label) whose pattern a title matches.

    A title meets the patterns whose key it contains, and those without a key; only these are tried, once for all rows of equal
    titles. Each pattern has one key, so no title and selection meet twice. The keys are broadcast if they are few; if they are
    more, their hashes, which leave only those parts of the titles that some pattern has; beyond that both sides are shuffled.
    """
    keys = materialised(pattern_keys(selections).select(F.col("name").alias("selection"), F.col("pattern").alias("_pattern"), F.col("key").alias("_key")))
    n_keys = keys.count()
    titles = rows.select("titre", "titre_nl").distinct()
    folded = [_grams(_folded(F.coalesce(F.col(x), F.lit(""))), ".") for x in ("titre", "titre_nl")]
    parts = titles.select("*", F.explode(F.array_distinct(F.concat(*folded))).alias("_key"))
    if not fits_broadcast(n_keys, 1024) and fits_broadcast(n_keys, 32):
        hashes = keys.select(F.xxhash64("_key").alias("_hash")).distinct()
        parts = parts.withColumn("_hash", F.xxhash64("_key")).join(F.broadcast(hashes), "_hash", "left_semi").drop("_hash")
    met = parts.join(small_side(keys.where("_key <> ''"), n_keys, 1024), "_key").drop("_key")
    # Patterns without a key are tried on every title.
    met = met.unionByName(titles.crossJoin(small_side(keys.where("_key = ''").drop("_key"), n_keys, 1024)))
    found = met.where(title_matches(F.col("_pattern"), F.col("titre"), F.col("titre_nl")))
    found = found.select(F.col("titre").alias("_titre"), F.col("titre_nl").alias("_titre_nl"), "selection")
    same = F.col("titre").eqNullSafe(F.col("_titre")) & F.col("titre_nl").eqNullSafe(F.col("_titre_nl"))
    return rows.join(found, same).drop("_titre", "_titre_nl")


def fetch_outcomes(planned: DataFrame, fetched: DataFrame) -> DataFrame:
    """Outcome of each planned page: 'ok', a reject reason, or 'network' when it could not be read.

    ``planned``: seq, moncode, action. ``fetched``: moncode, reject_reason.
    """
    read = fetched.select("moncode", F.lit(True).alias("_read"), "reject_reason")
    return planned.join(read, "moncode", "left").select(
        "seq", "moncode", "action", F.when(F.col("_read").isNull(), "network").otherwise(F.coalesce("reject_reason", F.lit("ok"))).alias("outcome")
    )


def merged(frozen: DataFrame, kept: DataFrame, previous: DataFrame, fetched: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The new corpus, each record with its ``origin``.

    A rechecked record takes its new text when the page was read, and keeps the
    previous one whatever else came of it, so no record is lost; outcomes that must
    stop the run are counted by ``stopping_outcomes``. A candidate enters only when
    its page was read.
    """
    columns = previous.columns
    ok = outcomes.where(F.col("outcome") == "ok")
    new = fetched.join(ok.select("moncode", "action"), "moncode").select(
        *columns, F.when(F.col("action") == "recheck", "rechecked").otherwise("added").alias("origin")
    )
    failed = outcomes.where((F.col("action") == "recheck") & (F.col("outcome") != "ok"))
    back = previous.join(failed.select("moncode"), "moncode", "left_semi").select(
        *columns, F.lit("previous").alias("origin")
    )
    return (
        frozen.select(*columns, F.lit("frozen").alias("origin"))
        .unionByName(kept.select(*columns, F.lit("kept").alias("origin")))
        .unionByName(back)
        .unionByName(new)
    )


def stopping_outcomes(outcomes: DataFrame) -> DataFrame:
    """(stopping): rechecks that came back neither read, empty nor unreachable; a run with any is not to be published."""
    lost = (F.col("action") == "recheck") & ~F.col("outcome").isin("ok", "question_text_empty", "network")
    return outcomes.agg(F.count_if(lost).alias("stopping"))


def exclusions(outcomes: DataFrame) -> DataFrame:
    """(moncode, reason) of candidates set aside."""
    return outcomes.where(
        (F.col("action") == "candidate") & F.col("outcome").isin("question_text_empty", "question_block_missing")
    ).select("moncode", F.col("outcome").alias("reason"))


def failure_runs(outcomes: DataFrame, keys: list[str], chunk: Column, order: str, max_failures: int, in_a_row: int) -> DataFrame:
    """Adds, per run and in order, total failures, failures in a row, and whether the run must stop there.

    A failure counts from the last page that was read: the sequence number of
    that page is a running maximum.
    """
    failed = F.col("outcome") == "network"
    numbered = running(outcomes, keys, chunk, [order], sums={"n": F.lit(1), "failures": failed.cast("int")})
    marked = running(
        numbered, keys, chunk, [order], maxima={"last_read": F.when(F.col("outcome") != "network", F.col("n"))}
    )
    return marked.withColumn(
        "in_a_row", F.when(failed, F.col("n") - F.coalesce("last_read", F.lit(0))).otherwise(0)
    ).withColumn("stops", failed & ((F.col("failures") > max_failures) | (F.col("in_a_row") >= in_a_row))).drop("last_read")


@dataclass(frozen=True)
class RefreshLimits:
    """What a run may do before it stops or ends."""

    max_records: int = MAX_RECORDS
    max_downloads: int = MAX_DOWNLOADS
    max_network_failures: int = MAX_NETWORK_FAILURES
    max_empty_texts: int = MAX_EMPTY_TEXTS
    max_missing: int = MAX_MISSING_FROM_INDEX
    in_a_row: int = CONSECUTIVE_FAILURES
    asked: int = MAX_ADDITIONS

    def __post_init__(self) -> None:
        if min(self.max_records, self.max_downloads) < 1 or min(self.max_network_failures, self.max_empty_texts, self.max_missing) < 0:
            raise ValueError("limits of records and downloads are positive, the others at least 0")
        if not 0 <= self.asked <= MAX_ADDITIONS:
            raise ValueError(f"at most {MAX_ADDITIONS} additions in a run")


def early_stop(n_current: Column, n_missing: Column, n_rechecks: Column, limits: RefreshLimits) -> Column:
    """Why a run may not read a single page, or null."""
    return (
        F.when(n_current > limits.max_records, "records")
        .when(n_missing > limits.max_missing, "missing from index")
        .when(n_rechecks > limits.max_downloads, "rechecks")
    )


def refresh_run(attempts: DataFrame, n_current: Column, n_missing: Column, limits: RefreshLimits, chunk: int = 1000) -> DataFrame:
    """What becomes of each planned page of a run: seq, moncode, action, outcome, and its ``state``.

    ``attempts``: seq (rechecks before candidates, from 0 or any number on), moncode, action, outcome. States: 'read' (its outcome
    counts), 'stops: <reason>' (the page at which the run ends without a new corpus), 'not reached' (the run had
    stopped, or had enough additions or downloads), or 'refused: <reason>' for all pages of a run that may not begin. The
    totals are running sums over the whole sequence: up to the first candidate that isn't needed all
    pages were read, so that they are those of the run itself.
    """
    recheck, candidate = F.col("action") == "recheck", F.col("action") == "candidate"
    network = F.col("outcome") == "network"
    sums = {
        "n": F.lit(1),
        "downloads": (~network).cast("long"),
        "added": (candidate & (F.col("outcome") == "ok")).cast("long"),
        "postponed": network.cast("long"),
        "emptied": (recheck & (F.col("outcome") == "question_text_empty")).cast("long"),
        "blockless": (candidate & (F.col("outcome") == "question_block_missing")).cast("long"),
    }
    slices = F.floor(F.col("seq") / chunk)
    summed = running(attempts.select("seq", "moncode", "action", "outcome"), [], slices, ["seq"], sums=sums)
    marked = running(summed, [], slices, ["seq"], maxima={"last_read": F.when(~network, F.col("n"))})
    in_a_row = F.col("n") - F.coalesce("last_read", F.lit(0))
    before = {name: F.col(name) - value for name, value in sums.items()}
    room = F.least(F.lit(limits.asked), F.lit(limits.max_records) - n_current)
    needless = candidate & ((before["added"] >= room) | (before["downloads"] >= limits.max_downloads))
    reason = (
        F.when(network & ((F.col("postponed") > limits.max_network_failures) | (in_a_row >= limits.in_a_row)), "network failures")
        .when(recheck & (F.col("outcome") == "question_text_empty") & (F.col("emptied") > limits.max_empty_texts), "empty texts")
        .when(candidate & (F.col("outcome") == "question_block_missing") & (F.col("blockless") > limits.max_empty_texts), "pages without a question")
        .when(recheck & (F.col("outcome") == "question_block_missing"), "page of another structure")
    )
    judged = marked.withColumns({"_needless": needless, "_reason": reason})
    ends = judged.agg(
        F.min(F.when(F.col("_needless"), F.col("seq"))).alias("_end"),
        F.min(F.when(F.col("_reason").isNotNull(), F.col("seq"))).alias("_stop"),
        early_stop(n_current, n_missing, F.count_if(F.col("action") == "recheck"), limits).alias("_refusal"),
    )
    whole = judged.join(F.broadcast(ends), how="cross")  # one row
    reached = F.coalesce(F.col("seq") < F.col("_end"), F.lit(True)) & F.coalesce(F.col("seq") <= F.col("_stop"), F.lit(True))
    state = (
        F.when(F.col("_refusal").isNotNull(), F.concat(F.lit("refused: "), "_refusal"))
        .when(~reached, "not reached")
        .when(F.coalesce(F.col("seq") == F.col("_stop"), F.lit(False)), F.concat(F.lit("stops: "), "_reason"))
        .otherwise("read")
    )
    return whole.select("seq", "moncode", "action", "outcome", state.alias("state"))


def run_summary(run: DataFrame) -> DataFrame:
    """One row: why the run has no new corpus (null if it has one), and what it read, added, postponed, emptied and set aside."""
    read = F.col("state") == "read"
    counted = {
        "rechecked": read & (F.col("action") == "recheck") & (F.col("outcome") == "ok"),
        "added": read & (F.col("action") == "candidate") & (F.col("outcome") == "ok"),
        "postponed": read & (F.col("outcome") == "network"),
        "emptied": read & (F.col("action") == "recheck") & (F.col("outcome") == "question_text_empty"),
        "excluded": read & (F.col("action") == "candidate") & F.col("outcome").isin("question_text_empty", "question_block_missing"),
        "not_reached": F.col("state") == "not reached",
    }
    ended = F.max(F.when(F.col("state").rlike("^(stops|refused): "), F.regexp_replace("state", "^[a-z]+: ", "")))
    return run.agg(ended.alias("stopped_by"), *[F.count_if(condition).alias(name) for name, condition in counted.items()])


def cap_checks(counts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(cap, value, allowed, ok) from one row of counts."""
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("cap"), F.col(name).cast("bigint").alias("value"), F.lit(limit).cast("bigint").alias("allowed"))
            for name, limit in limits.items()
        ]
    )
    return counts.select(F.inline(rows)).withColumn("ok", F.col("value") <= F.col("allowed"))


def additions(candidates: DataFrame, n_current: Column, max_records: int, asked: int) -> DataFrame:
    """The most recent candidates that still fit under the size of the corpus (``asked`` at most)."""
    order = [F.desc("date_reception"), F.desc(F.col("moncode").cast("bigint"))]
    first = candidates.orderBy(*order).limit(asked)
    # At most ``asked`` rows are left to number.
    return first.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order))).where(
        F.col("rank") <= F.least(F.lit(asked), F.lit(max_records) - n_current)
    )


def per_legislature(records: DataFrame) -> DataFrame:
    return records.groupBy(F.coalesce("legislature", F.lit(DEFAULT_LEGISLATURE)).alias("legislature")).agg(
        F.count("*").alias("records")
    )


def method_text(previous: DataFrame, counts: DataFrame, legislature: str, sentence: str) -> DataFrame:
    """One row with the description of the corpus: one sentence per legislature, newest first.

    ``previous``: methode_echantillonnage. The collected legislature gets the new
    sentence, others keep theirs, and one without a sentence gets its count.
    """
    found = previous.select(
        F.explode(F.regexp_extract_all("methode_echantillonnage", F.lit(METHOD_SENTENCE_PATTERN), F.lit(0))).alias("kept")
    ).select(F.regexp_extract("kept", METHOD_SENTENCE_PATTERN, 1).alias("legislature"), "kept")
    kept = found.groupBy("legislature").agg(F.last("kept").alias("kept"))
    own = F.concat(F.lit("Législature "), "legislature", F.lit(f" : {sentence}."))
    default = F.concat(F.lit("Législature "), "legislature", F.lit(" : "), F.col("records").cast("string"), F.lit(" fiches."))
    lines = counts.join(kept, "legislature", "left").select(
        "legislature", F.when(F.col("legislature") == legislature, own).otherwise(F.coalesce("kept", default)).alias("line")
    )
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("legislature", "line"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["line"]), " ")
    return lines.agg(F.concat(F.lit(METHOD_OPENING), joined, F.lit(METHOD_CLOSING)).alias("methode_echantillonnage"))


def growth_log(runs: DataFrame) -> DataFrame:
    """Adds the running total and whether it agrees with the logged one.

    ``runs``: run, month, added, excluded, absent, logged_total.
    """
    summed = running(runs, [], F.col("month"), ["run"], sums={"total": F.col("added")})
    return summed.withColumn("agrees", F.col("logged_total").isNull() | (F.col("logged_total") == F.col("total")))
