"""Column functions over text: folding, tokens, query expansion, passage and piece splitting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaestor.fixed_values import (
    ACCENTED,
    DOTTED_WORD_PATTERN,
    INDEX_STOP_WORDS,
    LIGATURES,
    PASSAGE_CHARS,
    PATH_PATTERN,
    PIECE_CHARS,
    STOP_WORDS,
    SYNONYM_RULES,
    UNACCENTED,
    WORD_PATTERN,
)

# Whitespace as the collected texts use it: ASCII plus the Unicode spaces.
SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: what a lambda refers to is computed for each element, its argument is not."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold_accents(text: Column) -> Column:
    """Lower case without accents, ligatures opened."""
    folded = F.translate(F.lower(text), ACCENTED, UNACCENTED)
    for ligature, letters in LIGATURES:
        folded = F.replace(folded, F.lit(ligature), F.lit(letters))
    return folded


def search_words(text: Column) -> Column:
    """Folded text where words joined by a dot or an at sign are apart."""
    return F.regexp_replace(fold_accents(text), DOTTED_WORD_PATTERN, "$1 ")


def word_array(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(WORD_PATTERN), F.lit(0))


def query_words(text: Column) -> Column:
    """Words of a text without the application's stop words, in order, repeated words kept."""
    return F.filter(word_array(fold_accents(text)), lambda word: ~word.isin(*STOP_WORDS))


def index_words(text: Column) -> Column:
    """Words of a text as the index holds them: path-like tokens and index stop words left out."""
    folded = fold_accents(text)
    plain = F.when(F.contains(text, F.lit("/")), F.regexp_replace(folded, PATH_PATTERN, " ")).otherwise(folded)
    return F.filter(word_array(plain), lambda word: ~word.isin(*INDEX_STOP_WORDS))


def expanded(text: Column) -> Column:
    """The text followed by the synonyms its words call for."""
    folded = fold_accents(text)
    additions = [F.when(folded.rlike(pattern), words).otherwise("") for pattern, words in SYNONYM_RULES]
    return F.concat(text, *additions)


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", " ")


def _trim_left(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+", "")


def split_passages(text: Column, max_chars: int = PASSAGE_CHARS) -> Column:
    """Parts of a text of at most ``max_chars``, whole paragraphs first.

    A part is the longest run of whole paragraphs that fits. A paragraph that
    is too long on its own starts a new part and is cut between words; a single
    longer word stays whole. One regular expression reads the parts off the
    text, so the work stays in the JVM and linear in its length.
    """
    # A too-long paragraph is brought to single spaces and preceded by a mark
    # that no part may cross.
    paragraphs = F.filter(F.split(text, "\n"), lambda p: p != "")
    marked = F.transform(
        paragraphs,
        lambda p: F.when(
            F.length(p) > max_chars, F.concat(F.lit("\u0001"), collapse_spaces(_trim_left(p)))
        ).otherwise(p),
    )
    flow = F.replace(F.array_join(marked, "\n"), F.lit("\n\u0001"), F.lit("\u0001"))
    part = (
        rf"(?s)(?!\n)([^\u0001]{{1,{max_chars}}}(?=[\n\u0001]|\z)"
        rf"|[^\n\u0001]{{1,{max_chars}}}(?= )|[^ \n\u0001]+) ?"
    )
    return F.regexp_extract_all(flow, F.lit(part), F.lit(1))


def sentence_pieces(text: Column, max_chars: int = PIECE_CHARS) -> Column:
    """Sentences of a text; one longer than ``max_chars`` is cut between words."""
    sentences = F.regexp_extract_all(text, F.lit(r"[^.!?;:]*[.!?;:]+\s*|[^.!?;:]+"), F.lit(0))
    piece = rf"(?s).{{1,{max_chars}}}\z|.{{0,{max_chars - 1}}}\s|\S+\s?"
    return F.flatten(F.transform(sentences, lambda s: F.regexp_extract_all(s, F.lit(piece), F.lit(0))))
