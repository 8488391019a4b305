"""Benchmark items inside documents: size-partitioned MinHash containment search, verified by exact shingles.

An item is contained if at least ``CONTAINMENT`` of its distinct word shingles are in the document. Items are partitioned
by size (powers of two). A partition's sketch keeps so many of an item's least shingle hashes that a document
with none of them cannot hold enough of the item: of u shingles (the partition's upper bound) u - ceil(t u) + 1.
Documents, whatever their length, are looked up by all their shingle hashes, and each hit with a sketch is a candidate.
Candidates are verified by the shingles themselves. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import stored

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
#: Rows up to which a counted side is broadcast (two numbers a row); beyond, the join is shuffled.
BROADCAST_ROWS = 1_000_000


def words_of(text: str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")


def _windows(words: Column, of_window) -> Column:
    """``of_window(i)`` for the place i (from 0) of each shingle; a shorter text is one shingle, an empty one has none."""
    count = F.size(words)
    places = F.when(count >= SHINGLE_WORDS, F.sequence(F.lit(0), count - SHINGLE_WORDS)).when(count > 0, F.array(F.lit(0)))
    return F.transform(places, of_window)


def _shingles(words: str) -> Column:
    return F.array_distinct(_windows(F.col(words), lambda i: F.concat_ws(" ", F.slice(F.col(words), i + 1, SHINGLE_WORDS))))


def _hashes(hashed: str) -> Column:
    """Hash of each shingle, from the hashes of its words; missing words count as zero."""
    return _windows(F.col(hashed), lambda i: F.xxhash64(*(F.coalesce(F.get(F.col(hashed), i + k), F.lit(0)) for k in range(SHINGLE_WORDS))))


def _hashed_words(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hashed", F.transform("words", lambda w: F.xxhash64(w)))


def _checked(side: DataFrame) -> DataFrame:
    """Broadcast if counted and small enough."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def sketches(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(hash, item_id): the least shingle hashes of each item, as many as its size partition asks for."""
    rows = _hashed_words(items.select("item_id", words_of("text").alias("words")))
    rows = rows.select("item_id", F.array_sort(F.array_distinct(_hashes("hashed"))).alias("hashes")).where(F.size("hashes") > 0)
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("hashes").cast("double"))))
    length = (upper - F.ceil(upper * containment - 1e-9) + 1).cast("int")
    return rows.select("item_id", F.explode(F.slice("hashes", F.lit(1), length)).alias("hash")).distinct()


def contained_items(documents: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every item contained in a document.

    Null or wordless texts contain nothing and are contained in nothing; texts under five words are one shingle. Rows of
    one doc_id (or item_id) are taken together, those without a doc_id too; items with a null id are left out.
    """
    items = items.where("item_id is not null and text is not null").select("item_id", "text")
    documents = documents.where("text is not null").select("doc_id", "text")
    sketch = _checked(stored(sketches(items, containment), "sketches"))
    looked_up = _hashed_words(documents.select("doc_id", words_of("text").alias("words"))).select("doc_id", F.explode(_hashes("hashed")).alias("hash"))
    candidates = stored(looked_up.join(sketch, "hash").select("doc_id", "item_id").distinct(), "candidates")
    asked = _checked(stored(candidates.select(F.col("doc_id").alias("asked_id")).distinct(), "candidate-ids"))
    shingled = documents.join(asked, F.col("doc_id").eqNullSafe(F.col("asked_id")), "left_semi").select("doc_id", words_of("text").alias("words")).select("doc_id", F.explode(_shingles("words")).alias("shingle"))
    of_items = items.select("item_id", words_of("text").alias("words")).select("item_id", F.explode(_shingles("words")).alias("shingle")).distinct()
    of_items = stored(of_items, "item-shingles")
    sizes = of_items.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    shared = shingled.join(_checked(of_items), "shingle").select("doc_id", "item_id", "shingle").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    found = candidates.select(F.col("doc_id").alias("found_id"), F.col("item_id").alias("found_item"))
    verified = shared.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("item_id") == F.col("found_item"))).join(_checked(sizes), "item_id")
    verified = verified.where(F.col("n_shared") >= F.ceil(F.col("n_shingles") * containment - 1e-9))
    return verified.select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def without_leaks(documents: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of ``documents`` whose own text contains no item; neither needs an id, and rows of one doc_id are apart.

    Items of one item_id are taken together, an item without an id stands for itself.
    """
    of_text = documents.select(F.md5("text").alias("doc_id"), "text")
    named = items.select(F.coalesce(F.concat(F.lit("id "), F.col("item_id").cast("string")), F.md5("text")).alias("item_id"), "text")
    leaks = contained_items(of_text, named, containment).select(F.col("doc_id").alias("leak")).distinct()
    leaks = _checked(stored(leaks, "leaks"))
    return documents.join(leaks, F.md5(documents["text"]) == leaks["leak"], "left_anti").select(*[F.col(f"`{x}`") for x in documents.columns])


SQL = f"""
WITH iw AS (SELECT item_id AS id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
si AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= {SHINGLE_WORDS} THEN list_transform(range(1, len(w) - {SHINGLE_WORDS - 2}), lambda i: array_to_string(w[i:i + {SHINGLE_WORDS - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM iw),
sd AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= {SHINGLE_WORDS} THEN list_transform(range(1, len(w) - {SHINGLE_WORDS - 2}), lambda i: array_to_string(w[i:i + {SHINGLE_WORDS - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM dw),
n AS (SELECT id, count(*) AS n_shingles FROM si GROUP BY id),
m AS (SELECT sd.id AS doc_id, si.id AS item_id, count(*) AS n_shared FROM sd JOIN si USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM m JOIN n ON n.id = m.item_id WHERE n_shared >= ceil(n_shingles * {CONTAINMENT} - 1e-9)
"""
