"""The line rules' text output through Spark."""

from collections import Counter

from quaestor.llm import line_rules


def by_hand(text):
    return None if text is None else "\n".join(x for x in text.split("\n") if not x.strip(line_rules.WHITE) or not line_rules.line_fails(x))


def test_failing_lines_are_removed_through_spark(spark, odd_tables):
    docs = spark.read.parquet(f"{odd_tables}/documents.parquet")
    found = line_rules.with_clean_text(docs).collect()
    assert Counter((r.doc_id, r.lang, r.k, by_hand(r.text)) for r in docs.collect()) == Counter((r.row.doc_id, r.row.lang, r.row.k, r.clean_text) for r in found)
    for r in found:
        chars = sum(map(len, line_rules._WORDS.findall(r.clean_text or "")))
        assert r.chars_lost == r.word_chars - chars
    assert any(r.chars_lost for r in found)
    judged = line_rules.judged(docs).collect()
    assert Counter((r.doc_id, r.clean_text, r.chars_lost) for r in judged) == Counter((r.row.doc_id, r.clean_text, r.chars_lost) for r in found)
