"""Near-duplicates by SimHash fingerprints, searched with a Gray-order hierarchical index.

Fingerprints of equal documents are collapsed first. Two fingerprints of at most ``DISTANCE`` differing bits agree in
at least two of six blocks of bits, so each fingerprint is dealt to the fifteen buckets of its block pairs. Inside
a bucket the fingerprints are sorted by Gray rank, so that neighbours share most bits; runs of neighbours become
nodes, runs of nodes become upper nodes, and each node keeps the bits that all below it share. A search walks down
from the root, adds the differences in the bits that a node newly fixes, and leaves a whole group as soon as they
exceed the distance, or as soon as the group already is one with the query. A bucket gives one link for each
fingerprint and not all pairs; the links are joined into components by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import slices, stored, text_bytes

DISTANCE = 4
SHINGLE_WORDS = 4
SEED = 42
#: Blocks of the 64 bits: (first bit, bits). With four differences two of six blocks are free of any.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Entries of a node of the index.
FANOUT = 8
#: Queries that walk down the index together: at first few, later at most so many.
FIRST_QUERIES, MOST_QUERIES = 64, 4096


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text's word shingles, as an unsigned number; no word gives zero."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(x) for x in zip(*(words[i:] for i in range(shingle_words)), strict=False)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, SEED) for x in shingles), np.uint64, len(shingles))
    set_in = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 1 << 16):
        set_in += np.unpackbits(hashes[low : low + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view(np.uint64)[0])


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for low, high in slices(text_bytes(texts)[1]):
            values = np.array([fingerprint(x, shingle_words) for x in texts[low:high].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[low:high], "fp": values.view(np.int64)})


def fingerprints(documents: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed number) of every row."""
    return documents.select("doc_id", "text").mapInArrow(lambda batches: _fingerprints(batches, shingle_words), "doc_id long, fp long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each 64-bit value in the reflected Gray code."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical index over buckets of fingerprints; one tree for each bucket.

    ``values`` are sorted by bucket and Gray rank; ``starts`` tells where each bucket begins, and ends with their number.
    """

    def __init__(self, values: np.ndarray, starts: np.ndarray):
        self.values = values
        self.labels = np.arange(len(values))
        full = np.full(len(values), ~np.uint64(0))
        # From the leaves up: bits that all below share, their values, place of the first child, end of the children.
        self.levels = [(full, values, None, None)]
        self.bounds = [starts]
        while (np.diff(starts) > 1).any():
            sizes = np.diff(starts)
            counts = (sizes + FANOUT - 1) // FANOUT
            above = np.concatenate([[0], np.cumsum(counts)])
            tree = np.repeat(np.arange(len(sizes)), counts)
            first = starts[tree] + FANOUT * (np.arange(above[-1]) - above[tree])
            end = np.minimum(first + FANOUT, starts[tree + 1])
            shared, pattern = self.levels[-1][:2]
            lead = pattern[first]
            same = ~np.bitwise_or.reduceat(pattern ^ np.repeat(lead, end - first), first)
            shared = np.bitwise_and.reduceat(shared, first) & same
            self.levels.append((shared, lead, first, end))
            starts = above
            self.bounds.append(starts)

    def _uniform(self) -> list[np.ndarray]:
        """For each level the label that all leaves of a node have, or -1."""
        out = [self.labels]
        for _, _, first, _ in self.levels[1:]:
            low, high = np.minimum.reduceat(out[-1], first), np.maximum.reduceat(out[-1], first)
            out.append(np.where(low == high, low, -1))
        return out

    def search(self, queries: np.ndarray, trees: np.ndarray, distance: int, uniform: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, leaf) of at most ``distance`` differing bits, without groups that already share the query's label."""
        top = len(self.levels) - 1
        asked, node = np.arange(len(queries)), self.bounds[top][trees]
        spent, fixed = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.uint64)
        own = self.labels[queries]
        for level in range(top, -1, -1):
            shared, pattern, first, end = self.levels[level]
            spent = spent + np.bitwise_count((pattern[node] ^ self.values[queries[asked]]) & shared[node] & ~fixed)
            live = (spent <= distance) & (uniform[level][node] != own[asked])
            asked, node, spent = asked[live], node[live], spent[live]
            if level == 0:
                break
            fixed = shared[node]
            count = end[node] - first[node]
            ends = np.cumsum(count)
            child = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[node] - (ends - count), count)
            asked, spent, fixed, node = np.repeat(asked, count), np.repeat(spent, count), np.repeat(fixed, count), child
        return queries[asked], node

    def join(self, distance: int) -> np.ndarray:
        """For each leaf the smallest leaf of its component within the bucket."""
        sizes = np.diff(self.bounds[0])
        tree = np.repeat(np.arange(len(sizes)), sizes)
        low, block = 0, FIRST_QUERIES
        while low < len(self.values):
            queries = np.arange(low, min(low + block, len(self.values)))
            left, right = self.search(queries, tree[queries], distance, self._uniform())
            if len(left):
                self.labels = united(self.labels, left, right)
            low, block = low + block, min(2 * block, MOST_QUERIES)
        return self.labels


def united(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The labels after joining each pair's sets; a label is the smallest member of its set."""
    labels = labels.copy()
    while True:
        a, b = labels[left], labels[right]
        open_ = a != b
        if not open_.any():
            return labels
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels[labels] != labels).any():
            labels = labels[labels]


#: Fingerprints that a task holds at once, if no single bucket has more.
BUCKET_ROWS = 1 << 18


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links inside each bucket; the rows come sorted by bucket."""

    def solved(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        values = fp.view(np.uint64)
        order = np.lexsort((gray_rank(values), bucket))
        bucket, values = bucket[order], values[order]
        heads = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        alone = heads & np.concatenate([heads[1:], [True]])
        bucket, values, heads = bucket[~alone], values[~alone], heads[~alone]
        labels = GrayIndex(values, np.concatenate([np.flatnonzero(heads), [len(values)]])).join(distance) if len(values) else np.zeros(0, np.int64)
        linked = np.flatnonzero(labels != np.arange(len(values)))
        return pa.RecordBatch.from_pydict({"a": values[labels[linked]].view(np.int64), "b": values[linked].view(np.int64)})

    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append((batch.column("bucket").to_numpy(), batch.column("fp").to_numpy()))
        rows += batch.num_rows
        if rows >= BUCKET_ROWS:
            bucket, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(bucket, bucket[-1]))
            if cut:
                yield solved(bucket[:cut], fp[:cut])
            held, rows = [(bucket[cut:], fp[cut:])], len(bucket) - cut
    if rows:
        yield solved(*(np.concatenate(x) for x in zip(*held, strict=True)))


def links(unique: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between fingerprints: as many as join what is within ``distance`` bits, through any chain.

    ``unique`` has one row per fingerprint (column fp). At most four differing bits are supported by the blocks.
    """
    if not 0 <= distance <= 4:
        raise ValueError("the blocks find pairs of at most four differing bits")
    bits = [F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << n) - 1)) for low, n in BLOCKS]
    buckets = [F.lit(k * (1 << 24)) + bits[i] * (1 << 11) + bits[j] for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]
    dealt = unique.select("fp", F.explode(F.array(*buckets)).alias("bucket"))
    partitions = int(unique.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = dealt.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(lambda batches: _links(batches, distance), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """member and root (the smallest reachable member) of every vertex of ``edges`` (a, b), by alternating stars.

    A large star moves the larger neighbours of each vertex to its smallest one, a small star the smaller ones;
    neither loses a connection. Neighbours are never gathered: each star is a minimum per vertex, joined back.
    """
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        small = small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u != v").distinct()
        edges = stored(small, "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("member"), F.col("v").alias("root"))
        before = now


def near_duplicates(documents: DataFrame, distance: int = DISTANCE, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of ``documents``: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable.

    A null, empty or blank text has fingerprint zero, which links like any other; a null doc_id takes part and is passed
    over as a component's id (null if there is no other). Only doc_id and text are read.
    """
    printed = stored(fingerprints(documents, shingle_words), "fingerprints")
    unique = printed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(unique.select("fp"), distance))
    placed = unique.join(roots.withColumnRenamed("member", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = placed.join(least, "root").select("fp", "component_id")
    return printed.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
