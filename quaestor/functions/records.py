"""Column functions over the fields of a record."""

from __future__ import annotations

import hashlib

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaestor.fixed_values import (
    DEFAULT_LEGISLATURE,
    EMBEDDING_DIMENSIONS,
    EPOCH_ORDINAL,
    FRENCH_MONTHS,
    INDEX_FORMAT,
    NATURE_INCOMPETENCE,
    NATURE_REFERRAL,
    NATURE_REFERRAL_CHARS,
    NO_EMBEDDINGS,
    RECENT_ANSWER_DAYS,
    ROTATION_WEEKS,
    TITLE_PREFIX,
    UNANSWERED_DAYS,
    UNDATED_LABEL,
)


def present(text: Column) -> Column:
    """True when a text holds something else than blanks."""
    return F.coalesce(text.rlike(r"\S"), F.lit(False))


def parse_day(text: Column) -> Column:
    """dd/mm/yyyy → date, null when absent or impossible."""
    clean = F.trim(text)
    return F.when(clean.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(clean, "d/M/yyyy"))


def latest_date(*dates: Column) -> Column:
    return F.greatest(*dates)


def full_legislature(short: Column) -> Column:
    """'19-24' → '2019-2024', '89-95' → '1989-1995'."""
    years = F.transform(
        F.split(short, "-"),
        lambda y: (y.cast("int") + F.when(y.cast("int") < 50, 2000).otherwise(1900)).cast("string"),
    )
    return F.array_join(years, "-")


def is_collected(legislature: Column, collected: str) -> Column:
    return F.coalesce(legislature, F.lit(DEFAULT_LEGISLATURE)) == collected


def title_matches(pattern: Column | str, *titles: Column) -> Column:
    """True when any title matches the pattern, whatever the case."""
    insensitive = F.concat(F.lit("(?iu)"), pattern if isinstance(pattern, Column) else F.lit(pattern))
    found = F.lit(False)
    for title in titles:
        found = found | F.regexp(F.coalesce(title, F.lit("")), insensitive)
    return found


def nature(answer: Column) -> Column:
    """What an answer amounts to; the first rule that applies wins."""
    return (
        F.when(~present(answer), "absente")
        .when(answer.rlike(f"(?iu){NATURE_INCOMPETENCE}"), "incompetence")
        .when((F.length(answer) < NATURE_REFERRAL_CHARS) & answer.rlike(f"(?iu){NATURE_REFERRAL}"), "renvoi")
        .otherwise("fond")
    )


def official_url(url: Column, hosts: Iterable[str]) -> Column:
    """The https form of a link to one of the official hosts, null for any other link."""
    parts = r"^(?i:https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
    host = F.lower(F.regexp_extract(url, parts, 1))
    path = F.regexp_extract(url, parts, 2)
    tail = F.concat(F.regexp_extract(url, parts, 3), F.regexp_extract(url, parts, 4))
    # A port or credentials make the authority differ from the bare host name.
    return F.when(
        host.isin(*hosts), F.concat(F.lit("https://"), host, F.when(path == "", "/").otherwise(path), tail)
    )


def search_text(title: Column, author: Column, recipient: Column, section: Column, text: Column) -> Column:
    """Text indexed and embedded for one passage."""
    return F.concat_ws("\n", title, author, recipient, F.upper(section), text)


def record_text(title: Column, author: Column, recipient: Column, question: Column, answer: Column) -> Column:
    """Everything indexed for a record: the search texts of all its passages, without repeats.

    For records with a question and an answer, the only ones that are searched.
    """
    return F.concat_ws("\n", title, author, recipient, F.lit("QUESTION"), question, F.lit("REPONSE"), answer)


def index_config(model: Column, text_format: str = INDEX_FORMAT, dimensions: int = EMBEDDING_DIMENSIONS) -> Column:
    return F.concat_ws(
        ";", F.lit(text_format), F.coalesce(model, F.lit(NO_EMBEDDINGS)), F.lit(str(dimensions))
    )


def query_model(config: Column, legacy: Column, dimensions: int = EMBEDDING_DIMENSIONS) -> Column:
    """Model to embed queries with for a version, null when only lexical search is possible."""
    model = F.get(F.split(config, ";"), 1)
    declared = F.get(F.split(config, ";"), 2)
    usable = (model != "") & (model != NO_EMBEDDINGS) & (declared == str(dimensions))
    return F.when(config.isNull(), legacy).when(usable, model)


def content_hash(record: Column, config: Column) -> Column:
    """Key of what is stored for a record: the record and the index configuration."""
    return F.sha2(F.concat_ws("\n", F.to_json(record, {"ignoreNullFields": "false"}), config), 256)


def short_title(title: Column) -> Column:
    return F.regexp_replace(title, f"^(?iu){TITLE_PREFIX}", "")


def date_label(day: Column) -> Column:
    """'3 mars 2026', or the wording for an unknown date."""
    month = F.element_at(F.array(*[F.lit(m) for m in FRENCH_MONTHS]), F.month(day))
    return F.coalesce(
        F.when(day.isNotNull(), F.concat_ws(" ", F.day(day).cast("string"), month, F.year(day).cast("string"))),
        F.lit(UNDATED_LABEL),
    )


def failure_code(message: Column) -> Column:
    return F.when(message.rlike("^[A-Z][A-Z_]+$"), message).otherwise("UNEXPECTED")


def upstream_code(kind: Column, message: Column) -> Column:
    """Code of a failed generation, from the kind of error and its message."""
    return (
        F.when(kind == "timeout", "AI_TIMEOUT")
        .when(kind == "api", "AI_API_ERROR")
        .when(message == "Affirmation sans source", "AI_MISSING_CITATION")
        .when(message == "Référence inconnue", "AI_UNKNOWN_CITATION")
        .otherwise("AI_OUTPUT_INVALID")
    )


def in_rotation(code: Column, today: Column, weeks: int = ROTATION_WEEKS) -> Column:
    """Old unanswered records come back every ``weeks`` weeks, spread by number."""
    week = F.floor((F.datediff(today, F.lit("1970-01-01").cast("date")) + EPOCH_ORDINAL) / 7)
    return F.pmod(code.cast("bigint"), F.lit(weeks)) == F.pmod(week, F.lit(weeks))


def needs_recheck(
    code: Column,
    received: Column,
    answer: Column,
    answered: Column,
    today: Column,
    unanswered_days: int = UNANSWERED_DAYS,
    recent_answer_days: int = RECENT_ANSWER_DAYS,
) -> Column:
    """Unanswered and recent, unanswered and in rotation, or answered lately."""
    waiting = (received >= F.date_sub(today, unanswered_days)) | in_rotation(code, today)
    fresh = F.coalesce(answered >= F.date_sub(today, recent_answer_days), F.lit(False))
    return F.when(present(answer), fresh).otherwise(waiting)


def passage_record(passage_id: Column) -> Column:
    """Record id of a passage id."""
    return F.regexp_replace(passage_id, r":(reponse|question):\d+$", "")


def hour_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd-HH")


def day_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def pseudonym(value: Column, secret: str) -> Column:
    """Keyed digest of a session or address (HMAC-SHA-256 written with built-in digests)."""
    key = secret.encode()
    if len(key) > 64:  # a longer key stands as its digest
        key = hashlib.sha256(key).digest()
    padded = key.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in padded).hex())) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)
