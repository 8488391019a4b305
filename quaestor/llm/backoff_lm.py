"""Stupid-backoff scores of documents under a bigram model of all other documents.

A word scores log(c(v w) / c(v .)) if its bigram stands in another document, else log(0.4 c(w) / N); a word of no other
document scores as 0.4 of one occurrence. Counts leave the scored document out; N counts all words.

The work is a count table joined to the exploded bigrams, by hash, in one exchange. A document sends each of its bigrams
once, with its own counts. The most frequent words have their totals broadcast (their number is fixed, and which they
are changes no score): a bigram of two of them is dealt by the pair, one with a rarer word by that word, so that the
totals of the rare word come together there, and one of two rarer words to both. No key gathers more than one row per
document and word pair. Entries of one task for one part travel as one block of sorted, byte-transposed columns, and so
do a part's sums for a run of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import mixed, slices, stored, text_bytes

BACKOFF = 0.4
#: Words whose totals are broadcast, and entries of a part of the exchange.
FREQUENT_WORDS, PART_ENTRIES = 1 << 16, 1 << 19
#: Entries (or words) that a task holds before it tells them.
HELD = 1 << 19
#: The start of a document, as a word.
START = np.uint64(0x5DEECE66D)
_ID = 1 << 16
#: Words that a task numbers before it begins anew, if no single text has more.
MEMO = 400_000
#: Documents whose sums come together are those with equal row numbers but for so many bits.
RUN_BITS = 10

# Kinds of entries: two frequent words; by a rare history; by a rare word; a document's own row.
PAIR, HISTORY, WORD, DOCUMENT = range(4)
_FIELDS = (("kind", np.uint8), ("key", np.uint64), ("other", np.uint64), ("row", np.uint64), ("n", np.uint32), ("v_own", np.uint32), ("w_own", np.uint32))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Words(dict):
    """Numbers of the words met so far, from 1 on, and their hashes; 0 is the start of a document."""

    def __init__(self):
        super().__init__()
        self.hashes = [int(START)]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word, 1))
        return number

    def full(self) -> bool:
        return len(self.hashes) >= MEMO


def _numbered(texts: list[str | None], memo: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word of the texts, and the number of words of each text."""
    words = [(x or "").encode().translate(_LOWER).split() for x in texts]
    counts = np.array([len(x) for x in words], np.int64)
    return np.fromiter(map(memo.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum())), counts


def _before(numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The word before each word, 0 at the start of a text."""
    before = np.concatenate([[0], numbers[:-1]])[: len(numbers)]
    before[(np.cumsum(counts) - counts)[counts > 0]] = 0
    return before


def _summed(*keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct combinations of the keys, the sum of weights of each, and the combination of each row."""
    order = np.lexsort(keys[::-1])
    ordered = [x[order] for x in keys]
    new = np.zeros(len(order), bool)
    for x in ordered:
        new[1:] |= x[1:] != x[:-1]
    new[:1] = True
    group = np.cumsum(new) - 1
    of_row = np.empty(len(order), np.int64)
    of_row[order] = group
    first = np.flatnonzero(new)
    return [x[first] for x in ordered], np.bincount(of_row, weights, len(first)).astype(np.int64), of_row


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo, used, followed = _Words(), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def added(total: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        now = np.bincount(numbers, minlength=len(memo.hashes))
        now[: len(total)] += total
        return now

    def told() -> pa.RecordBatch:
        some = np.flatnonzero(used + followed)
        words = np.array(memo.hashes, np.uint64)[some].view(np.int64)
        return pa.RecordBatch.from_pydict({"word": words, "u": used[some], "h": followed[some]})

    for batch in batches:
        for low, high in slices(text_bytes(batch.column("text"))[1]):
            numbers, counts = _numbered(batch.column("text")[low:high].to_pylist(), memo)
            used, followed = added(used, numbers), added(followed, _before(numbers, counts))
            if memo.full():
                yield told()
                memo, used, followed = _Words(), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if used.any():
        yield told()


class _Frequent:
    """Place and totals of the frequent words; -1 for others."""

    def __init__(self, words: np.ndarray, followed: np.ndarray, used: np.ndarray):
        order = np.argsort(words)
        self.words, self.h, self.u = words[order], followed[order].astype(np.float64), used[order].astype(np.float64)

    def places(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)


def _alone(uses: np.ndarray, total: float) -> np.ndarray:
    """Score of a word that is not scored by its bigram, of so many uses elsewhere."""
    return np.log(BACKOFF * np.where(uses > 0, uses, BACKOFF) / total)


def _packed(columns: dict[str, np.ndarray]) -> bytes:
    key = columns["key"]
    columns = columns | {"key": np.concatenate([key[:1], key[1:] - key[:-1]])}
    return b"".join(np.ascontiguousarray(columns[x].astype(t).view(np.uint8).reshape(len(key), -1).T).tobytes() for x, t in _FIELDS)


def _unpacked(block: bytes, count: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, kind in _FIELDS:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(block, np.uint8, count * size, at).reshape(size, count)
        out[name] = np.ascontiguousarray(planes.T).view(kind).reshape(count)
        at += count * size
    out["key"] = np.cumsum(out["key"], dtype=np.uint64)
    return out


def _of_runs(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each row the sum of ``n`` over the rows of its key; equal keys stand together."""
    if not len(keys):
        return n
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(keys))))


def _entries(batches: Iterator[pa.RecordBatch], frequent: _Frequent, total: float, parts: int) -> Iterator[pa.RecordBatch]:
    memo, held, size = _Words(), [], 0
    hashes, place = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def told() -> Iterator[pa.RecordBatch]:
        whole = {x: np.concatenate([y[x] for y, _ in held]) for x, _ in _FIELDS}
        part = (mixed(whole["key"] * np.uint64(4) + whole["kind"]) % np.uint64(parts)).astype(np.int64)
        documents = pa.concat_tables([x for _, x in held])
        order = np.lexsort((whole["key"], part))
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(p, order[a:b]) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        blocks = [_packed({x: y[mine] for x, y in whole.items()}) for _, mine in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in rows], pa.int32()), pa.array([len(x) for _, x in rows], pa.int32()), pa.array(blocks, pa.binary()), *(pa.nulls(len(rows), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
            names=["part", "n", "block", "row", "doc_id", "n_words", "own"],
        )
        for batch in documents.to_batches():
            spread = (mixed(batch.column("row").to_numpy().view(np.uint64)) % np.uint64(parts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(spread), pa.nulls(len(spread), pa.int32()), pa.nulls(len(spread), pa.binary()), *batch.columns], names=["part", "n", "block", "row", "doc_id", "n_words", "own"])

    for batch in batches:
        rows = batch.column("row").to_numpy().view(np.uint64)
        for low, high in slices(text_bytes(batch.column("text"))[1]):
            numbers, counts = _numbered(batch.column("text")[low:high].to_pylist(), memo)
            if len(place) < len(memo.hashes):
                new = np.array(memo.hashes[len(place) :], np.uint64)
                hashes, place = np.concatenate([hashes, new]), np.concatenate([place, frequent.places(new)])
            # One number for text, word before and word: sorted once, a text's words before come together in it. A slice of
            # more than one text has few words, one of a single text leaves 31 bits for each of the two.
            bits = len(memo.hashes).bit_length()
            triples = np.repeat(np.arange(len(counts)) << (2 * bits), counts) | _before(numbers, counts) << bits | numbers
            triples, n = np.unique(triples, return_counts=True)
            text, v, w = triples >> (2 * bits), (triples >> bits) & ((1 << bits) - 1), triples & ((1 << bits) - 1)
            v_own = _of_runs(triples >> bits, n)
            by_word = np.argsort(text << bits | w, kind="stable")
            w_own = np.empty_like(n)
            w_own[by_word] = _of_runs((text << bits | w)[by_word], n[by_word])
            v_at, w_at, v, w = place[v], place[w], hashes[v], hashes[w]
            # What a frequent word scores without its bigram is known here; a match elsewhere replaces it.
            known = np.flatnonzero(w_at >= 0)
            alone = np.bincount(text[known], n[known] * _alone(frequent.u[w_at[known]] - w_own[known], total), len(counts))
            pair, by_v, by_w = (v_at >= 0) & (w_at >= 0), v_at < 0, w_at < 0
            found: dict[str, list] = {x: [] for x, _ in _FIELDS}
            for kind, mine, key, other in (
                (PAIR, pair, v_at * _ID + w_at, np.zeros(len(v), np.uint64)),
                (HISTORY, by_v, v, np.where(w_at >= 0, w_at.astype(np.uint64), w)),
                (WORD, by_w, w, np.where(v_at >= 0, v_at.astype(np.uint64), v)),
            ):
                at = np.flatnonzero(mine)
                values = {"kind": np.full(len(at), kind), "key": key[at], "other": other[at], "row": rows[low + text[at]], "n": n[at], "v_own": np.where(v_at[at] >= 0, v_own[at], 0), "w_own": np.where(w_at[at] >= 0, w_own[at], 0)}
                for x, kind_ in _FIELDS:
                    found[x].append(values[x].astype(kind_))
            documents = pa.table([batch.column("row")[low:high], batch.column("doc_id")[low:high], pa.array(counts, pa.int64()), pa.array(alone.astype(np.float64))], names=["row", "doc_id", "n_words", "own"])
            held.append(({x: np.concatenate(y) for x, y in found.items()}, documents))
            size += len(held[-1][0]["key"]) + high - low
            if memo.full():
                memo, hashes, place = _Words(), np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if size >= HELD:
                yield from told()
                held, size = [], 0
    if held:
        yield from told()


_SUMS = "run long, row long, doc_id long, n_words long, total double, n int, sums binary"


def _joined(rows: pa.Table, frequent: _Frequent, total: float) -> pa.Table:
    """Sums per document of what the entries of one part score; and the documents' own rows."""
    own = rows.filter(pc.is_null(rows.column("n")))
    run = own.column("row").to_numpy() >> RUN_BITS
    own = pa.table([pa.array(run), *(own.column(x) for x in ("row", "doc_id", "n_words", "own")), pa.nulls(len(run), pa.int32()), pa.nulls(len(run), pa.binary())], names=_SUM_NAMES)
    blocks = [(x.as_py(), y.as_py()) for x, y in zip(rows.column("block"), rows.column("n"), strict=True) if y.is_valid]
    if not blocks:
        return own
    parts = [_unpacked(x, y) for x, y in blocks]
    e = {x: np.concatenate([y[x] for y in parts]) for x, _ in _FIELDS}
    del parts
    kind, n = e["kind"], e["n"].astype(np.int64)
    # A frequent word's place and a rare word's hash are told apart by whether the document's count of it is given.
    placed = np.where(kind == HISTORY, e["w_own"], e["v_own"]) > 0
    _, pair_total, pair = _summed(kind, e["key"], placed, e["other"], weights=n)
    elsewhere = pair_total[pair] - n
    _, key_total, key = _summed(kind, e["key"], weights=n)
    _, key_own, of_row = _summed(kind, e["key"], e["row"], weights=n)
    others = (key_total[key] - key_own[of_row]).astype(np.float64)
    matched = elsewhere > 0
    score = np.where(matched, np.log(np.maximum(elsewhere, 1)), 0.0)
    v = np.where(kind == PAIR, e["key"] // _ID, e["other"]).astype(np.int64)
    w = np.where(kind == PAIR, e["key"] % _ID, e["other"]).astype(np.int64)
    at = np.flatnonzero(matched & (kind != HISTORY) & (e["v_own"] > 0))
    score[at] -= np.log(frequent.h[v[at]] - e["v_own"][at])
    at = np.flatnonzero(matched & (kind != WORD) & (e["w_own"] > 0))
    score[at] -= _alone(frequent.u[w[at]] - e["w_own"][at], total)
    at = np.flatnonzero(matched & (kind == HISTORY))
    score[at] -= np.log(others[at])
    at = np.flatnonzero(~matched & (kind == WORD))
    score[at] = _alone(others[at], total)
    score[matched & (kind == WORD) & (e["v_own"] == 0)] = 0.0  # told where the history is
    documents, at = np.unique(e["row"], return_inverse=True)
    sums = np.bincount(at, n * score, len(documents))
    runs = (documents >> np.uint64(RUN_BITS)).view(np.int64)
    first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
    ends = np.concatenate([first[1:], [len(runs)]])
    told = [(documents[a:b] - (documents[a:b] >> np.uint64(RUN_BITS) << np.uint64(RUN_BITS))).astype(np.uint16).tobytes() + sums[a:b].tobytes() for a, b in zip(first, ends, strict=True)]
    none = [pa.nulls(len(first), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())]
    return pa.concat_tables([own, pa.table([pa.array(runs[first]), *none, pa.array((ends - first).astype(np.int32)), pa.array(told, pa.binary())], names=_SUM_NAMES)])


_SUM_NAMES = [x.split()[0] for x in _SUMS.split(", ")]


def _whole(rows: pa.Table) -> pa.Table:
    """Documents of one run with the sums of all parts."""
    own = rows.filter(pc.is_null(rows.column("n")))
    place = np.full(1 << RUN_BITS, 0, np.int64)
    place[own.column("row").to_numpy() & ((1 << RUN_BITS) - 1)] = np.arange(len(own))
    total = own.column("total").to_numpy().copy()
    for block, n in zip(rows.column("sums"), rows.column("n"), strict=True):
        if n.is_valid:
            data, count = block.as_py(), n.as_py()
            at = place[np.frombuffer(data, np.uint16, count)]
            total[at] += np.frombuffer(data, np.float64, count, 2 * count)
    return pa.table([own.column("doc_id"), own.column("n_words"), pa.array(total)], names=["doc_id", "n_words", "log_score"])


def with_scores(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, log_score (sum over the words) and mean_score (per word; null without words) of every row.

    Words are split at white space, A-Z lower-cased. A null, empty or blank text has no word and scores 0. Rows are
    documents of their own, also if they repeat. ``documents`` is read from files, so that its order is
    the same whenever it is read.
    """
    texts = documents.select("doc_id", "text")
    counts = texts.select("text").mapInArrow(_word_counts, "word long, u long, h long").groupBy("word").agg(F.sum("u").alias("u"), F.sum("h").alias("h"))
    counts = stored(counts, "words")
    total = counts.agg(F.sum("u")).first()[0] or 0
    top = counts.orderBy(F.desc(F.greatest("u", "h")), "word").limit(FREQUENT_WORDS).toPandas()
    frequent = _Frequent(top["word"].to_numpy(np.int64).view(np.uint64), top["h"].to_numpy(), top["u"].to_numpy())
    parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PART_ENTRIES + 1)
    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    schema = "part int, n int, block binary, row long, doc_id long, n_words long, own double"
    entries = numbered.mapInArrow(lambda batches: _entries(batches, frequent, float(total or 1), parts), schema)
    sums = entries.repartition(parts, "part").groupBy("part").applyInArrow(lambda rows: _joined(rows, frequent, float(total or 1)), _SUMS)
    whole = sums.groupBy("run").applyInArrow(_whole, "doc_id long, n_words long, log_score double")
    return whole.select("doc_id", "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_score"))
