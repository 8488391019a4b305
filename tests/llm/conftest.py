import random

import pytest

PROSE = "the of and to in is that for with on as by this at from are was be it an".split()


def sentence(rng, words):
    return " ".join(rng.choice(PROSE) + rng.choice(["", "ing", "er", "tion"]) for _ in range(words)).capitalize() + "."


@pytest.fixture(scope="session")
def odd_tables(spark, tmp_path_factory):
    """Small tables with nulls, empty and long texts, ties, repeated rows, and extra columns of clashing names."""
    rng = random.Random(11)
    folder = str(tmp_path_factory.mktemp("odd"))
    passage = sentence(rng, 40)
    items = [(0, passage), (1, sentence(rng, 3)), (2, None), (3, ""), (4, sentence(rng, 9)), (4, sentence(rng, 9)), (None, passage)]
    texts = ["\n".join(sentence(rng, rng.randint(4, 20)) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    texts += [passage, f"{texts[0]}\n{passage}\n{texts[1]}", texts[2] + " Changed.", items[1][1], items[4][1] + " " + items[5][1]]
    texts += [None, "", " \n\t ", "a", "#### $$$$ !!!!", "x" * 5000, "a b c " * 4000, "no end\n" * 60, "<|endoftext|> é日本\x00\x85 \x1c", "STUPID IDIOT " * 60]
    rows = [(i, x, ["en", "de", None][i % 3], "s", len(x or ""), 1.5, "k", i) for i, x in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4], "en", None, None, None, None, None), (None, None, None, None, None, None, None, None), (5, texts[6], "fr", "s", 1, 1.0, "k", 0)]
    rows += [(100 + i, texts[7], "en", "s", 3, 0.0, "k", 1) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, removed string, k long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(70)] + [(3, 0, 1), (None, 1, 1), (8, None, None), (10**9, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    pages = [(i, f"http://x/{i}", x, "d") for i, x in enumerate([None, "", "short", "short", "p" * 99, "p" * 100, "p" * 100, "é" * 50, "é" * 50, "q" * 70000])]
    pages += [pages[6], (None, None, "p" * 100, "d"), (None, "u\r\nInjected: x", "r" * 200, "d"), (40, "", "r\r\n\r\n" * 40, "d"), (-3, None, "é" * 50, "d")]
    urls = ["https://ORG/", "http://a.example.org/es/x?y#z", "http://a.example.org/es?y", "x://example.org/en/123#/es/", "http://notexample.org/es/", "https://www.com/de/1", "//com/de/", "http://com", "ftp://u:p@x.com:80/fr/", "a://b://com/de/"]
    urls += ["http://casino-win.example.net/x", "https://www.SPAM-FARM.example.com/fr/1", "http://xcasino-win.example.net/", "http://é.org\n/en/1", "http://org./", "http://.org/", "http:///de/", "", "http://a.b.c.d.example.org/en/1/" + "s/" * 3000]
    pages += [(100 + i, x, "h", "d") for i, x in enumerate(urls)] + [(100, urls[0], "h", "d")]
    spark.createDataFrame(pages, "page_id long, url string, html string, digest string").repartition(2).write.parquet(f"{folder}/pages.parquet")
    vectors = [[rng.gauss(0, 1 + j) for j in range(6)] for _ in range(80)]
    vectors += [vectors[0], None, [], [1.0] * 5, [1.0] * 7, [None] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1e30] * 6, [0.0] * 6, [-0.01] * 6]
    rows = [(i, x, i % 2, "c", 0.5) for i, x in enumerate(vectors)] + [(None, vectors[1], 0, "c", 0.5), (3, vectors[3], 1, "c", 0.5)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int, vector string, whitened double").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_tables(spark, odd_tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{odd_tables}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder
