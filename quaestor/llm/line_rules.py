"""Line-first cleaning: each line is judged by rules, failing lines go, then documents that lost too much text go.

Rules of a line: no closing punctuation; navigation (bars between few words); symbols instead of words; shouting in
capitals; one word over and over; a boilerplate phrase. The rules are plain counts and patterns, so SQL can say the same.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.llm.common import slices, text_bytes

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
LEAST_WORDS = 50
#: A document is rejected if more than this share (percent) of its words stands in 3-word windows that repeat.
MOST_REPEATED = 50
#: A document is rejected if more than this share (percent) of its word characters goes with its lines.
MOST_LOST = 50
#: Percent of a line's words: bars of navigation, symbols, repeats of the word before; percent of letters: capitals.
BARS, SIGNS, REPEATS, CAPITALS = 20, 60, 50, 70
CLOSING = ".!?:;)]\"'…»”"
#: Phrases of boilerplate lines, lower case.
PHRASES = (
    "all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy", "enable javascript",
    "sign up", "log in", "subscribe to", "click here", "back to top", "lorem ipsum",
)

_WORDS = regex.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lines_failed", "chars_lost")


def line_fails(line: str) -> bool:
    """Whether a line that has a word fails a rule."""
    words = _WORDS.findall(line)
    count = len(words)
    if line.rstrip(WHITE)[-1] not in CLOSING:
        return True
    if 100 * line.count("|") > BARS * count or 100 * (sum(map(line.count, SYMBOLS)) + line.count("!")) > SIGNS * count:
        return True
    capitals, small = (sum(a <= x <= b for x in line) for a, b in (("A", "Z"), ("a", "z")))
    if count >= 3 and 100 * capitals > CAPITALS * (capitals + small):
        return True
    if 100 * sum(a == b for a, b in zip(words, words[1:], strict=False)) > REPEATS * count:
        return True
    low = line.lower()
    return any(x in low for x in PHRASES)


def measured(text: str | None) -> tuple:
    """The values of ``COLUMNS`` for a whole text, and the text without its failing lines; lines without a word stay."""
    text = text or ""
    words = _WORDS.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(windows) < len(words) - 2:
        covered = bytearray(len(words))
        for i, window in enumerate(zip(words, words[1:], words[2:], strict=False)):
            if windows[window] > 1:
                covered[i : i + 3] = b"\1\1\1"
        repeated = sum(covered)
    seen: set[str] = set()
    left: list[str] = []
    lines = duplicates = failed = lost = 0
    for line in text.split("\n"):
        if not line.strip(WHITE):
            left.append(line)
            continue
        lines += 1
        duplicates += line in seen
        seen.add(line)
        if line_fails(line):
            failed += 1
            lost += sum(map(len, _WORDS.findall(line)))
        else:
            left.append(line)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), duplicates, repeated, lines, failed, lost, "\n".join(left)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in slices(text_bytes(batch.column("text"))[1]):
            part = batch.slice(low, high - low)
            found = [measured(x) for x in part.column("text").to_pylist()]
            columns = dict(zip((*COLUMNS, "clean_text"), zip(*found, strict=True), strict=True))
            failed = [n < LEAST_WORDS or 100 * r > MOST_REPEATED * n for n, r in zip(columns["n_words"], columns["n_repeat_words"], strict=True)]
            kept = [not f and 100 * lost <= MOST_LOST * chars for f, lost, chars in zip(failed, columns["chars_lost"], columns["word_chars"], strict=True)]
            texts = pa.array([None if x is None else y for x, y in zip(part.column("text").to_pylist(), columns["clean_text"], strict=True)], pa.string())
            counts = [pa.array(columns[x], pa.int64()) for x in COLUMNS]
            yield pa.RecordBatch.from_arrays([part.column("row"), *counts, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), texts], names=["row", *COLUMNS, "base_failed", "kept", "clean_text"])


def with_clean_text(documents: DataFrame) -> DataFrame:
    """``row`` (all columns of the row), the counts, base_failed, kept (neither failed nor stripped of too much text) and clean_text.

    clean_text is the text without its failing lines, also where the document is not kept; null for a null text. A null or
    empty text has no word, so it fails. Repeated rows give repeated results.
    """
    return _with_clean_text(documents, documents.columns)


def _with_clean_text(documents: DataFrame, carried: list[str]) -> DataFrame:
    rows = documents.select(F.struct(*[F.col(f"`{x}`") for x in carried]).alias("row"), "text")
    schema = T.StructType([rows.schema["row"], *(T.StructField(x, T.LongType()) for x in COLUMNS)])
    return rows.mapInArrow(_judged, schema.add("base_failed", "boolean").add("kept", "boolean").add("clean_text", "string"))


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, counts, verdict and clean_text of every row, as ``with_clean_text`` has them. Only doc_id and text are read."""
    found = _with_clean_text(documents, ["doc_id"])
    return found.select("row.doc_id", *COLUMNS, "base_failed", "kept", "clean_text")


def cleaned(text: str | None) -> str:
    """The text without its failing lines; lines without a word stay."""
    return measured(text)[-1]


def _quoted(text: str) -> str:
    return text.replace("'", "''")


_W = r"'[^\x20\x09-\x0D]+'"
_CLOSING_CLASS = r"[.!?:;)\]\"''…»”]"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT doc_id, r, t, regexp_extract_all(t, {_W}) AS ws FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM g) WHERE c > 1),
n AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM p, (VALUES (0), (1), (2)) AS v(o) GROUP BY r),
s AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d),
l AS (SELECT r, k, line, regexp_extract_all(line, {_W}) AS lw FROM s WHERE regexp_matches(line, {_W})),
f AS (
  SELECT r, row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS dup,
    len(array_to_string(lw, '')) AS chars,
    NOT regexp_matches(line, '{_CLOSING_CLASS}[\\x20\\x09-\\x0D]*$')
    OR 100 * len(regexp_replace(line, '[^|]', '', 'g')) > {BARS} * len(lw)
    OR 100 * len(regexp_replace(line, '[^#*$%&|<>!]', '', 'g')) > {SIGNS} * len(lw)
    OR (len(lw) >= 3 AND 100 * len(regexp_replace(line, '[^A-Z]', '', 'g')) > {CAPITALS} * len(regexp_replace(line, '[^A-Za-z]', '', 'g')))
    OR 100 * len(list_filter(range(1, len(lw)), lambda i: lw[i] = lw[i + 1])) > {REPEATS} * len(lw)
    OR {" OR ".join(f"contains(lower(line), '{_quoted(x)}')" for x in PHRASES)} AS bad
  FROM l),
a AS (SELECT r, count(*) FILTER (dup) AS n_dup_lines, coalesce(sum(chars) FILTER (bad), 0) AS lost FROM f GROUP BY r),
b AS (
  SELECT doc_id, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN n USING (r) LEFT JOIN a USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  n_words >= {LEAST_WORDS} AND 100 * n_repeat_words <= {MOST_REPEATED} * n_words AND 100 * lost <= {MOST_LOST} * word_chars AS kept
FROM b
"""
