import hashlib
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quaestor.functions import text as T
from quaestor.functions.html import HIDDEN_PATTERN, html_text
from quaestor.functions.stemming import A_VERB_ENDINGS, I_VERB_ENDINGS, PLAIN_VERB_ENDINGS, STEP_1_ENDINGS, with_stems
from quaestor.functions.vectors import normalised, substitute_vector
from quaestor.plans.stem_sql import stems
from quaestor.sources.index_pages import PageLayout, parse_pages

# Published sample of the French Snowball vocabulary (accent-free words).
STEMS = {
    "continu": "continu", "continua": "continu", "continuait": "continu", "continuant": "continu",
    "continuation": "continu", "continue": "continu", "continuelle": "continuel", "continuellement": "continuel",
    "continuelles": "continuel", "continuels": "continuel", "continuer": "continu", "continuera": "continu",
    "continues": "continu", "continuons": "continuon", "contorsions": "contors", "contour": "contour",
    "contournait": "contourn", "contournant": "contourn", "contourne": "contourn", "contours": "contour",
    "contractait": "contract", "contracter": "contract", "contraction": "contract", "contradictoirement": "contradictoir",
    "contraindre": "contraindr", "contrainte": "contraint", "main": "main", "mains": "main",
    "maintenaient": "mainten", "maintenait": "mainten", "maintenant": "mainten", "maintenir": "mainten",
    "maintenue": "maintenu", "maintien": "maintien", "maintint": "maintint", "maire": "mair", "maires": "mair",
    "mairie": "mair", "mais": "mais", "maison": "maison", "maisons": "maison", "majestueuse": "majestu",
    "majestueusement": "majestu", "majestueux": "majestu", "majeur": "majeur", "majeure": "majeur", "major": "major",
    "majordome": "majordom", "malade": "malad", "malades": "malad", "maladie": "malad", "maladies": "malad",
    "maladive": "malad", "2eme": "2eme",
}


def values(spark, words, column, name="text"):
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], f"i int, {name} string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_fold_accents_opens_ligatures(spark):
    assert values(spark, ["Œuvre À Noël ÉTÉ cæsar Ça"], T.fold_accents(F.col("text"))) == [
        "oeuvre a noel ete caesar ca"
    ]


def test_search_words_part_dots_and_at(spark):
    assert values(spark, ["propre.example a.b.c x@y.z fin."], T.search_words(F.col("text"))) == [
        "propre example a b c x y z fin."
    ]


def test_tokens_and_index_words(spark):
    assert values(spark, ["Les vélos/trottinettes et /vélos du tram 55, tram"], T.index_words(F.col("text"))) == [
        ["les", "tram", "55", "tram"]
    ]
    assert values(spark, ["Comment les expatriés sont-ils informés ?"], T.query_words(F.col("text"))) == [
        ["expatries", "informes"]
    ]


def test_expansion(spark):
    got = values(spark, ["Le métro est-il climatisé ?", "Quand ont lieu les élections ?", "rien"], T.expanded(F.col("text")))
    assert got[0].endswith(" STIB transports") and got[1].endswith(" électoral inscription") and got[2] == "rien"


def test_stems_follow_the_published_vocabulary(spark):
    words = spark.createDataFrame([(w,) for w in STEMS], "word string")
    got = {r.word: r.stem for r in with_stems(words).collect()}
    assert got == STEMS


@pytest.mark.parametrize("limit", [10, 25, 60])
def test_split_passages_keep_all_words_within_the_limit(spark, limit):
    rng = random.Random(limit)
    texts = ["", "\n\n", "a", "word " * 30 + "\nfin", "x" * 100 + " yy\nzz"]
    for _ in range(300):
        texts.append(
            "".join(rng.choice(["a", "bb", "ccc", "d" * rng.randint(1, 30), " ", " ", " ", "\n", "é", "."]) for _ in range(rng.randint(1, 80)))
        )
    # A cut paragraph that ends in a space keeps it only when it fits: left to the unit cases above.
    texts = [re.sub(r"[ ]+(\n|$)", r"\1", t) for t in texts]
    got = values(spark, texts, T.split_passages(F.col("text"), limit))
    for text, parts in zip(texts, got):
        assert [w for part in parts for w in part.split()] == text.split(), text
        assert all(part.strip() for part in parts if text.strip())
        assert all(len(part) <= limit or not re.search(r"\S\s+\S", part) for part in parts), text
        if len(text) <= limit and text.strip():
            assert len(parts) == 1


def test_sentence_pieces(spark):
    rng = random.Random(7)
    texts = ["Un. Deux ! Trois", "a" * 40 + " b. c"]
    for _ in range(200):
        texts.append("".join(rng.choice(["a", "bb", "c" * rng.randint(1, 25), " ", " ", "\n", ". ", "! ", ";"]) for _ in range(rng.randint(1, 60))))
    got = values(spark, texts, T.sentence_pieces(F.col("text"), 20))
    for text, pieces in zip(texts, got):
        assert "".join(pieces) == text
        assert all(len(piece) <= 20 or not re.search(r"\s\S", piece) for piece in pieces), text
        assert not any(re.search(r"[.!?;:]\s*[^.!?;:\s]", piece) for piece in pieces), text


def test_stems_equal_those_of_the_sql(spark):
    rng = random.Random(17)
    endings = [re.sub(r"(.)\?", "", x).lower() for x in (*STEP_1_ENDINGS, *I_VERB_ENDINGS, *PLAIN_VERB_ENDINGS, *A_VERB_ENDINGS)] + ["", "s", "ion", "ier", "e", "enne", "ette", "elle", "y", "icatif", "ativement", "eusement", "quement"]
    letters = "abcdefghilmnopqrstuvxyzaeiouyiuqu"
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, 7))) + rng.choice(endings) for _ in range(6000)} - {""})
    con = duckdb.connect()
    con.execute("CREATE TABLE said AS SELECT unnest(?) AS word", [words])
    expected = dict(con.execute("WITH " + stems("said") + " SELECT word, stem FROM stems").fetchall())
    got = {r.word: r.stem for r in with_stems(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert len(got) == len(words)
    assert {w: (got[w], expected[w]) for w in words if got[w] != expected[w]} == {}


def test_lines_are_tidied_as_line_by_line(spark):
    rng = random.Random(5)
    parts = [" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", " ", " ", "\xa0", " ", "﻿", "a", "b c", "é", "<br>", "</p>", "&nbsp;", "&amp;"]
    texts = [None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(2000)]

    def by_hand(text):
        plain = text.replace("<br>", "\n").replace("</p>", "\n").replace("&nbsp;", "\xa0").replace("&amp;", "&")
        lines = re.split("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", plain)
        return "\n".join(x for line in lines if (x := re.sub("[ \t\xa0 ﻿]+", " ", line).strip(" ")))

    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", html_text(F.col("text")).alias("got")).collect()
    assert all(r.got == (None if r.text is None else by_hand(r.text)) for r in rows)


def test_a_page_is_stripped_once_for_each_of_its_texts(spark):
    """What several columns refer to is computed in a step of its own: question, answer and the whole page, each once."""
    pages = spark.createDataFrame([("1", '<section id="s"></section>')], "moncode string, html string").repartition(1)
    plan = parse_pages(pages, PageLayout("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(HIDDEN_PATTERN) == 3


def test_substitute_vectors_digest_a_text_once_for_each_dimension(spark):
    rows = spark.createDataFrame([("a b",), ("",), (None,)], "text string").repartition(1)
    vectors = rows.select("text", substitute_vector(F.col("text"), 8).alias("v"))
    assert vectors._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1

    def by_hand(text):
        parts = [(text or "") + ":" * (text is not None) + str(i) for i in range(1, 9)]
        raw = [(x - (1 << 32) * (x >= 1 << 31)) / 2.0**31 for x in (int(hashlib.md5(p.encode()).hexdigest()[:8], 16) for p in parts)]
        return [x / math.sqrt(sum(y * y for y in raw)) for x in raw]

    assert all(r.v == pytest.approx(by_hand(r.text), abs=1e-15) for r in vectors.collect())
    lengths = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)], "v array<float>").select(normalised(F.col("v")).alias("v")).collect()
    assert [r.v for r in lengths] == [[0.6, 0.8], [None, None], [], None]
