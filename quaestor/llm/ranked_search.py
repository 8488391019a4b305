"""Ranked lexical search with the Best Position Algorithm over impact lists.

An impact list holds the documents of one term by falling impact, that is by what the term adds to a document's score.
Documents are cut into shards of bounded size, each with its own lists, so a term that every document has is spread
over all shards. Within a shard an item's lists are read side by side from the front; each document met is scored in full
by direct accesses to the item's other lists, and these accesses mark its positions there as seen too. The best position
of a list is the end of its unbroken run of seen positions. No unseen document can score more than the sum of the impacts
just past the best positions, a tighter bound than that of the last positions read; the search stops when this sum is
strictly below the k-th score (at equality a smaller doc_id could still win) or nothing is left. The k best of one shard
are the start for the next one of the same task. The k best of all tasks are merged in two steps, so that no item's
candidates meet in one task before they are few.

Items go in blocks of bounded vocabulary; each block is one pass over the texts and a few over the counts it writes.

Rows: each row of the documents is a document and each row of the items an item, with or without an id. Null ids come
last among equal scores. Texts that are null or have no term match nothing and don't count in N; an item without a
known term has no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm.common import stored, text_bytes

K = 50
#: Different terms of the items of one block, and entries of the impact lists of one shard, unless one row has more.
BLOCK_TERMS, SHARD_ENTRIES = 1 << 17, 1 << 21
#: Positions read from each list in the first round, and at most in a later one.
FIRST_DEPTH, LARGEST_DEPTH = 16, 1 << 12
#: Groups of tasks whose candidates of one item are cut to the best before all are.
MERGE_GROUPS = 128
#: Bytes of a text that are split at once.
PIECE_BYTES = 1 << 20

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, in lists of a piece each."""
    text, low = text.translate(_TERM_BYTES), 0
    while low < len(text):
        cut = text.find(b" ", low + PIECE_BYTES)
        high = len(text) if cut < 0 else cut
        yield text[low:high].split()
        low = high


def weight(n_documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * frequency + 1)))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, bounds = text_bytes(batch.column("text"))
        terms = [sorted({x for part in terms_of(raw[a:b].tobytes()) for x in part}) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(terms, pa.list_(pa.binary()))], names=["item_id", "terms"])


def _counted(vocabulary: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per document its number of terms, and which of the vocabulary it has how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = text_bytes(batch.column("text"))
            lengths, terms, counts, ends = [], [], [], [0]
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                n, found = 0, Counter()
                for part in terms_of(raw[low:high].tobytes()):
                    n += len(part)
                    found.update(map(vocabulary.get, part))
                found.pop(None, None)
                lengths.append(n)
                terms.extend(found.keys())
                counts.extend(found.values())
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )

    return run


def _frequencies(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents of each term in the rows of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["term", "df"])

    return run


class Best:
    """The k best documents of an item so far: by falling score, then by id, null last."""

    def __init__(self, k: int):
        self.k = k
        self.scores = self.ids = np.zeros(0, np.int64)
        self.blank = np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, blank: np.ndarray) -> None:
        keep = (scores > 0) & (scores >= self.bound())
        if keep.any():
            scores, ids, blank = (np.concatenate(x) for x in ((self.scores, scores[keep]), (self.ids, ids[keep]), (self.blank, blank[keep])))
            order = np.lexsort((ids, blank, -scores))[: self.k]
            self.scores, self.ids, self.blank = scores[order], ids[order], blank[order]

    def bound(self) -> int:
        """The k-th score; zero while there are fewer."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0


class Shard:
    """Impact lists of some documents, for reading by falling impact and for direct access by document."""

    def __init__(self, ids: np.ndarray, blank: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, n_documents: int, n_terms: int):
        self.ids, self.blank = ids, blank
        document = np.repeat(np.arange(len(ids)), sizes)
        m = 100 - 50 + (50 * lengths * n_documents) // n_terms
        impact = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m[document]))
        order = np.lexsort((document, -impact, terms))
        self.documents, self.impacts = document[order], impact[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        keys = terms[order].astype(np.int64) * len(ids) + self.documents
        self.places = np.argsort(keys)
        self.keys = keys[self.places]

    def search(self, terms: np.ndarray, best: Best) -> int:
        """Adds the documents that can be among the best; the number of documents scored."""
        terms = terms[self.starts[terms] < self.starts[terms + 1]]
        if not len(terms):
            return 0
        starts, lengths = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        offsets = np.cumsum(lengths) - lengths
        seen = np.zeros(int(lengths.sum()), bool)
        met = np.zeros(len(self.ids), bool)
        position, depth = np.zeros(len(terms), np.int64), FIRST_DEPTH
        while True:
            bound = int(sum(self.impacts[s + p] for s, p, n in zip(starts, position, lengths, strict=True) if p < n))
            if bound == 0 or bound < best.bound():
                return int(met.sum())
            read = [self.documents[s + p : s + min(p + depth, n)] for s, p, n in zip(starts, position, lengths, strict=True)]
            new = np.unique(np.concatenate(read))
            new = new[~met[new]]
            met[new] = True
            asked = (terms.astype(np.int64)[:, None] * len(self.ids) + new[None, :]).ravel()
            at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            there = np.flatnonzero(self.keys[at] == asked)
            place, which = self.places[at[there]], there // max(1, len(new))
            score = np.zeros(len(new), np.int64)
            np.add.at(score, there % max(1, len(new)), self.impacts[place])
            best.add(score, self.ids[new], self.blank[new])
            seen[offsets[which] + place - starts[which]] = True
            for i, (o, p, n) in enumerate(zip(offsets, position, lengths, strict=True)):
                run = seen[o + p : o + n]
                gap = int(run.argmin()) if len(run) else 0
                position[i] = n if len(run) and run[gap] else p + gap
            depth = min(2 * depth, LARGEST_DEPTH)


def _searched(items: list[tuple[object, np.ndarray]], weights: np.ndarray, n_documents: int, n_terms: int, k: int, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        held: list[tuple[np.ndarray, ...]] = []

        def search() -> None:
            shard = Shard(*(np.concatenate(x) for x in zip(*held, strict=True)), weights, n_documents, n_terms)
            for (_, terms), found in zip(items, best, strict=True):
                shard.search(terms, found)
            held.clear()

        for batch in batches:
            terms, counts = batch.column("terms"), batch.column("counts")
            sizes = np.diff(terms.offsets.to_numpy())
            ends = np.cumsum(sizes)
            low = 0
            while low < len(sizes):
                room = SHARD_ENTRIES - sum(len(x[4]) for x in held)
                before = int(ends[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(ends, before + room, "right")))
                part = slice(low, high)
                ids = batch.column("doc_id")[part]
                entries = slice(before, int(ends[high - 1]))
                held.append(
                    (
                        ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
                        ids.is_null().to_numpy(zero_copy_only=False),
                        batch.column("n")[part].to_numpy(zero_copy_only=False),
                        sizes[part],
                        terms.flatten().to_numpy(zero_copy_only=False)[entries],
                        counts.flatten().to_numpy(zero_copy_only=False)[entries],
                    )
                )
                if sum(len(x[4]) for x in held) >= SHARD_ENTRIES:
                    search()
                low = high
        if held:
            search()
        for i, ((item_id, _), found) in enumerate(zip(items, best, strict=True)):
            if len(found.scores):
                same = len(found.scores)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * same, pa.int32()), pa.array([item_id] * same, item_type), pa.array(found.ids, mask=found.blank), pa.array(found.scores)],
                    names=["item", "item_id", "doc_id", "score"],
                )

    return run


def _best_of_block(documents: DataFrame, items: list, item_kind: str, k: int) -> DataFrame:
    spark = documents.sparkSession
    names = sorted({bytes(x) for row in items for x in row.terms})
    numbers = {x: i for i, x in enumerate(names)}
    vocabulary = spark.sparkContext.broadcast(numbers)
    counted = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: _counted(vocabulary.value)(batches), "doc_id long, n long, terms array<int>, counts array<long>"
    )
    counted = stored(counted, "query-terms").where("n > 0")
    total = counted.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    found = counted.select("terms").mapInArrow(_frequencies(len(names)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    weights = np.zeros(len(names), np.int64)
    for row in found:  # at most one row for each term of the block
        weights[row.term] = weight(total.documents, row.df)
    asked = [(row.item_id, np.array(sorted(numbers[bytes(x)] for x in row.terms), np.int64)) for row in items]
    item_type = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_kind]
    inside = spark.sparkContext.broadcast((asked, weights))
    ranked = counted.mapInArrow(
        lambda batches: _searched(*inside.value, total.documents, total.terms, k, item_type)(batches), f"item int, item_id {item_kind}, doc_id long, score long"
    )
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    grouped = ranked.withColumn("part", F.spark_partition_id() % MERGE_GROUPS)
    few = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    last = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return last.select("item_id", "rank", "doc_id", "score")


def best_documents(documents: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` best ``documents`` (doc_id, text) of each of ``items`` (item_id, text)."""
    kind = items.schema["item_id"].dataType.simpleString()
    split = stored(items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {kind}, terms array<binary>").where(F.size("terms") > 0), "item-terms")
    n_terms = split.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-2 * n_terms // BLOCK_TERMS)
    dealt = split.withColumn("block", F.pmod(F.xxhash64("terms"), F.lit(max(1, blocks))))
    out = documents.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).collect()  # about half of BLOCK_TERMS
        if rows:
            out = out.unionByName(_best_of_block(documents, rows, kind, k))
    return out


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
q AS (SELECT row_number() OVER () AS item, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
total AS (SELECT count(*) AS n_all, CAST(sum(len(words)) AS BIGINT) AS l FROM d WHERE len(words) > 0),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(words) AS term FROM d) GROUP BY row, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
asked AS (SELECT DISTINCT item, term FROM (SELECT item, unnest(words) AS term FROM q)),
m AS (SELECT row, doc_id, 100 - 50 + ((50 * len(words) * n_all) // l) AS m FROM d, total WHERE len(words) > 0),
scored AS (SELECT item, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
    FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m USING (row) GROUP BY item, row),
ranked AS (SELECT item, m.doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, m.doc_id NULLS LAST, row) AS rank
    FROM scored JOIN m USING (row) WHERE score > 0)
SELECT q.item_id, CAST(rank AS INTEGER) AS rank, ranked.doc_id, score FROM ranked JOIN q USING (item) WHERE rank <= {K}
"""
