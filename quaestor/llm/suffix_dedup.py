"""Removal of repeated passages by longest-previous-factor arrays over a sampled, partitioned suffix order.

Every byte covered by a string of ``length`` bytes that also starts earlier (in a smaller doc_id, or before it in the
same document) goes; the first occurrence stays. A repeat lies anywhere, so the strings are dealt by content:

1. *Anchors.* Each window of ``length`` bytes is represented by its least 24-byte gram (by hash, the leftmost of equals).
   Equal windows have equal anchors at equal places. Neighbouring windows with one anchor form a run, about one
   for 39 bytes, so few suffixes stand for all.
2. *Names.* Runs of equal bytes have one name. Each task keeps the first of those it meets, so the shuffle by gram
   gets at most one row for a name and task; later ones are repeats as a whole.
3. *Suffix order.* Runs with one gram but different names agree only in part (a passage in other surroundings). Their
   bytes are fetched, their suffixes sorted by prefix doubling, and the longest previous factor of each is the larger
   of its common prefixes with the previous and the next suffix of smaller position. One of at least ``length``
   bytes marks a repeat.

A gram frequent in ever other surroundings (a licence line) would gather too many runs: such grams are counted first
and stand behind all others in the choice of anchors, so a window that has any other gram is dealt by that one. A
filter of fixed size holds them; whatever it holds changes where windows meet, never which ones do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.llm.common import RangeHash, mixed, octets, stored, text_bytes, text_parts

LENGTH = 100
GRAM = 24
#: Windows looked at together; a longer document is taken in such parts.
PART = 1 << 18
#: Runs that a task holds to find equal names among them, and those it hands on at once.
HELD_RUNS, TOLD_RUNS = 1 << 19, 1 << 16
#: A gram with so many differently surrounded runs within single tasks is frequent.
FREQUENT = 32
#: Places of the filter of frequent grams (bits of the gram's hash).
FILTER_BITS = 22
#: Bytes whose suffixes are sorted together, if no gram has more.
SORTED_BYTES = 1 << 20

_LAST = (1 << 63) - 1
_POSITION = np.uint64((1 << 24) - 1)
_RUNS = "gram long, name long, k long, ord int, at int, n int"


def grams(eights: np.ndarray) -> np.ndarray:
    """Hash of the 24 bytes from each position on."""
    out = eights * np.uint64(0x9E3779B97F4A7C15)
    for step, factor in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9)):
        out ^= out >> np.uint64(29)
        out[:-step] += eights[step:] * np.uint64(factor)
    return mixed(out)


def runs_of(raw: np.ndarray, bounds: np.ndarray, length: int, frequent: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """gram, name, text, offset and number of windows of each run of the texts in ``raw``."""
    found: list[tuple[np.ndarray, ...]] = []
    sizes = np.diff(bounds)
    row = 0
    while row < len(sizes):
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + PART, "right")) - 1)
        for low in range(int(bounds[row]), max(int(bounds[last]) - length + 1, int(bounds[row])), PART if last == row + 1 else 1 << 62):
            high = min(int(bounds[last]), low + PART + length - 1) if last == row + 1 else int(bounds[last])
            if high - low >= length:
                found.append(_runs_of_part(raw[low:high], bounds[row : last + 1], low, row, length, frequent))
        row = last
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs_of_part(raw: np.ndarray, bounds: np.ndarray, low: int, row: int, length: int, frequent: np.ndarray | None) -> tuple[np.ndarray, ...]:
    eights = octets(raw)
    gram = grams(eights)
    order = gram >> np.uint64(1)
    if frequent is not None:
        order |= frequent[gram & np.uint64(len(frequent) - 1)].astype(np.uint64) << np.uint64(63)
    order = (order & ~_POSITION) | np.arange(len(raw), dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while 2 * have <= width:
        order = np.minimum(order[:-have], order[have:])
        have *= 2
    if have < width:
        order = np.minimum(order[: len(order) - (width - have)], order[width - have :])
    # Windows must end inside the text they begin in.
    own = np.arange(len(raw) - length + 1)
    ends = np.clip(bounds[1:] - low, 0, len(raw))
    text = np.searchsorted(ends, own, "right")
    own = own[own + length <= ends[np.minimum(text, len(ends) - 1)]]
    text = np.searchsorted(ends, own, "right")
    anchor = (order[own] & _POSITION).astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))[: len(own)]
    n = np.diff(np.concatenate([heads, [len(own)]]))
    start = own[heads]
    name = RangeHash(eights).of(start, start + n - 1 + length)
    return gram[anchor[heads]], name, text[heads] + row, start + low - bounds[text[heads]], n


def _frequent(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def counted() -> pa.RecordBatch:
        gram, name = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((name, gram))
        gram, name = gram[order], name[order]
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (name[1:] != name[:-1])])[: len(gram)]
        gram, count = np.unique(gram[new], return_counts=True)
        return pa.RecordBatch.from_pydict({"gram": gram[count > 1].view(np.int64), "n": count[count > 1]})

    size = 0
    for part in (x for batch in batches for x in text_parts(batch)):
        held.append(runs_of(*text_bytes(part.column("text")), length, None)[:2])
        size += len(held[-1][0])
        if size >= HELD_RUNS:
            yield counted()
            held, size = [], 0
    if held:
        yield counted()


def frequent_grams(texts: DataFrame, length: int) -> np.ndarray | None:
    """The filter of grams that stand in many surroundings; its size is fixed."""
    counted = texts.select("text").mapInArrow(lambda batches: _frequent(batches, length), "gram long, n long")
    often = counted.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    places = often.select(F.col("gram").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).cast("int").alias("place")).distinct().toPandas()["place"].to_numpy()
    if not len(places):
        return None
    out = np.zeros(1 << FILTER_BITS, bool)
    out[places] = True
    return out


def _named_runs(batches: Iterator[pa.RecordBatch], length: int, packed: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Runs, of equal ones the first; the others, joined where they touch, have a negative n and any gram."""
    frequent = None if packed is None else np.unpackbits(packed).astype(bool)
    held: list[tuple[np.ndarray, ...]] = []

    def told() -> Iterator[pa.RecordBatch]:
        gram, name, k, ord_, at, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((at, ord_, k, name, gram))
        again = np.zeros(len(gram), bool)
        again[1:] = (gram[order[1:]] == gram[order[:-1]]) & (name[order[1:]] == name[order[:-1]])
        same = again.copy()
        for x in (k, ord_, at):
            same[1:] &= x[order[1:]] == x[order[:-1]]
        own, later = order[~again], order[again & ~same]
        for low in range(0, len(own), TOLD_RUNS):
            yield rows(*(x[own[low : low + TOLD_RUNS]] for x in (gram, name, k, ord_, at, n)))
        later = joined(*(x[later].astype(np.int64) for x in (k, ord_, at, n)))
        for low in range(0, len(later[0]), TOLD_RUNS):
            k, ord_, at, n = (x[low : low + TOLD_RUNS] for x in later)
            yield rows(mixed((k ^ (at << 20)).view(np.uint64)), np.zeros(len(k), np.uint64), k, ord_, at, -n)

    def rows(gram, name, k, ord_, at, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (gram, name, k)] + [pa.array(x.astype(np.int32)) for x in (ord_, at, n)], names=["gram", "name", "k", "ord", "at", "n"])

    size = 0
    for part in (x for batch in batches for x in text_parts(batch)):
        gram, name, text, at, n = runs_of(*text_bytes(part.column("text")), length, frequent)
        k, ord_ = (part.column(x).to_numpy()[text] for x in ("k", "ord"))
        held.append((gram, name, k.astype(np.int64), ord_.astype(np.int32), at.astype(np.int32), n.astype(np.int32)))
        size += len(gram)
        if size >= HELD_RUNS:
            yield from told()
            size = 0
    if held:
        yield from told()


def joined(k: np.ndarray, ord_: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of windows, those that touch or overlap made one."""
    if not len(k):
        return k, ord_, at, n
    order = np.lexsort((at, ord_, k))
    k, ord_, at, n = k[order], ord_[order], at[order], n[order]
    document = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]) | (ord_[1:] != ord_[:-1])])) << 32
    reach = np.maximum.accumulate(document + at + n)
    first = np.flatnonzero(np.concatenate([[True], (document + at)[1:] > reach[:-1]]))
    last = np.concatenate([first[1:], [len(k)]]) - 1
    return k[first], ord_[first], at[first], reach[last] - document[first] - at[first]


def _compared_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs sorted by gram, name and position: repeats (gram null), and the first of each name if a gram has several names."""
    last: dict = {}  # the row before: its gram and name, position, whether it is the only name so far, and its row if not yet told
    for batch in batches:
        gram, name, k, ord_, at, n = (batch.column(i).to_numpy() for i in range(6))
        if last:
            gram, name, k, ord_, at, n = (np.concatenate([[last[x]], y]) for x, y in zip(("gram", "name", "k", "ord", "at", "n"), (gram, name, k, ord_, at, n), strict=True))
        lead = 1 if last else 0
        count = len(gram)
        if not count:
            continue
        new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
        new_name = np.concatenate([[True], new_gram[1:] | (name[1:] != name[:-1])])
        through = n < 0
        # Whether the gram has more than one name: known to the end of its rows, or to the end of this batch.
        group = np.cumsum(new_gram) - 1
        names = np.bincount(group[new_name], minlength=group[-1] + 1)
        several = names[group] > 1
        first_at = np.maximum.accumulate(np.where(new_name, np.arange(count), 0))
        first = [x[first_at] for x in (k, ord_, at)]
        if lead:  # the carried row stands for the first of its name
            mine = first_at == 0
            first = [np.where(mine, last[x], y) for x, y in zip(("fk", "ford", "fat"), first, strict=True)]
            if last["several"]:
                several |= group == 0
        same = (first[0] == k) & (first[1] == ord_) & (first[2] == at)
        told = np.arange(count) >= lead
        repeat = ~new_name & ~same & told & ~through | through & told
        edge = new_name & several & ~through & told
        out = [x[repeat] for x in (gram, k, ord_, at, np.abs(n))]
        edges = [x[edge] for x in (gram, k, ord_, at, n)]
        waiting = last.get("waiting") if lead and several[0] else None
        if waiting:
            edges = [np.concatenate([[w], x]) for w, x in zip(waiting, edges, strict=True)]
        i = count - 1
        j = int(first_at[i])
        carried_first = lead and j == 0
        still = None
        if not several[i] and not through[i]:
            still = last.get("waiting") if carried_first else tuple(x[j] for x in (gram, k, ord_, at, n))
        last = {"gram": gram[i], "name": name[i], "k": k[i], "ord": ord_[i], "at": at[i], "n": n[i], "fk": first[0][i], "ford": first[1][i], "fat": first[2][i], "several": bool(several[i]), "waiting": still}
        none = pa.nulls(int(repeat.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([none, pa.array(edges[0].astype(np.int64))])] + [pa.array(np.concatenate([a, b]).astype(t)) for a, b, t in zip(out[1:], edges[1:], (np.int64, np.int32, np.int32, np.int32), strict=True)],
            names=["gram", "k", "ord", "at", "n"],
        )


def suffix_names(raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Prefix doubling: for widths 8, 16, ... the rank of the ``width`` bytes at each position; and the order of the suffixes at ``starts``.

    Suffixes are compared by ``length`` bytes, equal ones ordered by position.
    """
    names = {8: np.unique(octets(raw).byteswap(), return_inverse=True)[1].astype(np.int64)}
    width = 8
    while 2 * width <= length:
        pair = names[width].copy()
        pair[:-width] = (pair[:-width] << 32) | (names[width][width:] + 1)
        pair[-width:] <<= 32
        width *= 2
        names[width] = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    whole = names[width][starts] << 32 | names[width][starts + length - width]
    return names, np.lexsort((starts, whole))


def nearest_smaller(position: np.ndarray, step: int) -> np.ndarray:
    """For each place of the suffix order the nearest place before (-1) or after (1) it with a smaller position; -1 if none."""
    count = len(position)
    near = np.arange(count) + step
    near[(near < 0) | (near >= count)] = -1
    while True:
        wrong = np.flatnonzero((near >= 0) & (position[near] > position))
        if not len(wrong):
            return near
        near[wrong] = near[near[wrong]]


def common_prefix(names: dict[int, np.ndarray], raw: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Bytes, at most ``length``, that the suffixes at a and b have in common."""
    out = np.zeros(len(a), np.int64)
    for width in sorted(names, reverse=True):
        for _ in range(2 if width == max(names) else 1):
            x, y = np.minimum(a + out, len(raw) - 1), np.minimum(b + out, len(raw) - 1)
            out += np.where((names[width][x] == names[width][y]) & (out + width <= length), width, 0)
    for _ in range(7):
        x, y = a + out, b + out
        same = (out < length) & (raw[np.minimum(x, len(raw) - 1)] == raw[np.minimum(y, len(raw) - 1)]) & (x < len(raw)) & (y < len(raw))
        out += same
    return np.minimum(out, length)


def longest_previous_factors(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each suffix at ``starts`` (ascending) the longest prefix, up to ``length`` bytes, that also begins at a smaller start."""
    if not len(starts):
        return np.zeros(0, np.int64)
    names, order = suffix_names(raw, starts, length)
    position = starts[order]
    out = np.zeros(len(starts), np.int64)
    for step in (-1, 1):
        near = nearest_smaller(position, step)
        has = np.flatnonzero(near >= 0)
        out[order[has]] = np.maximum(out[order[has]], common_prefix(names, raw, position[has], position[near[has]], length))
    return out


def _factors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows among runs of one gram; the rows come sorted by gram and position."""

    def solved(gram, k, ord_, at, n, pieces) -> pa.RecordBatch:
        # Positions grow with the order of the runs inside a gram; runs of different grams have no window in common.
        # A document listed twice has each of its runs twice.
        new = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (k[1:] != k[:-1]) | (ord_[1:] != ord_[:-1]) | (at[1:] != at[:-1])]))
        k, ord_, at, n, pieces = k[new], ord_[new], at[new], n[new], pieces.take(pa.array(new))
        raw, bounds = text_bytes(pieces)
        run = np.repeat(np.arange(len(n)), n)
        starts = bounds[:-1][run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        hit = np.flatnonzero(longest_previous_factors(raw, starts, length) >= length)
        k, ord_, at, n = joined(k[run[hit]], ord_[run[hit]], at[run[hit]] + starts[hit] - bounds[:-1][run[hit]], np.ones(len(hit), np.int64))
        return pa.RecordBatch.from_pydict({"k": k.astype(np.int64), "ord": ord_.astype(np.int32), "at": at.astype(np.int32), "n": n.astype(np.int32)})

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            held.append(part)
            size += part.column("piece").nbytes
            if size < SORTED_BYTES:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            gram = rows.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))
            if cut:
                yield solved(*_columns(rows.slice(0, cut)))
                rows = rows.slice(cut)
            held = rows.to_batches()
            size = rows.column("piece").nbytes
    if held:
        yield solved(*_columns(pa.Table.from_batches(held)))


def _columns(rows: pa.Table) -> tuple:
    return (*(rows.column(x).to_numpy().astype(np.int64) for x in ("gram", "k", "ord", "at", "n")), rows.column("piece"))


def _keyed(documents: DataFrame) -> DataFrame:
    """text of each row and its place in the order: k (doc_id, null last) and ord, which tells different rows of one doc_id apart.

    ord is odd for a null doc_id. Rows equal in doc_id and text are one document listed twice and share both. Other
    columns, if there are any, are in the struct ``rest``.
    """
    others = [F.struct(*[F.col(f"`{x}`") for x in documents.columns if x != "text"]).alias("rest")] if len(documents.columns) > 2 else []
    keyed = documents.select(*others, F.coalesce("doc_id", F.lit(_LAST)).alias("k"), F.col("doc_id").isNull().cast("int").alias("ord"), "text")
    repeated = keyed.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")
    if repeated.isEmpty():
        return keyed
    ranked = keyed.join(repeated, "k", "left_semi").withColumn("ord", F.col("ord") + 2 * F.dense_rank().over(Window.partitionBy("k").orderBy("ord", "text")))
    return keyed.join(repeated, "k", "left_anti").unionByName(ranked)


def repeated_spans(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``documents``: k, ord and text as in ``_keyed``, ``rest`` if there are more columns, and ``removed``, an
    array of (at, n): n windows from byte ``at`` on are repeats, which covers n + length - 1 bytes; null if there are none."""
    if not GRAM + 8 <= length < 128:
        raise ValueError(f"the compared length must be from {GRAM + 8} to 127 bytes")
    keyed = _keyed(documents)
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frequent = frequent_grams(keyed, length)
    packed = None if frequent is None else np.packbits(frequent)
    runs = keyed.select("k", "ord", "text").mapInArrow(lambda batches: _named_runs(batches, length, packed), _RUNS)
    dealt = runs.repartition(partitions, "gram").sortWithinPartitions("gram", "name", "k", "ord", "at")
    found = stored(dealt.mapInArrow(_compared_names, "gram long, k long, ord int, at int, n int"), "repeats")
    pieces = found.where("gram is not null").join(keyed, ["k", "ord"])
    pieces = pieces.select("gram", "k", "ord", "at", "n", F.expr(f"substring(cast(text as binary), at + 1, n + {length - 1})").alias("piece"))
    placed = pieces.repartition(partitions, "gram").sortWithinPartitions("gram", "k", "ord", "at")
    factors = placed.mapInArrow(lambda batches: _factors(batches, length), "k long, ord int, at int, n int")
    spans = found.where("gram is null").select("k", "ord", "at", "n").unionByName(factors)
    removed = spans.groupBy("k", "ord").agg(F.collect_list(F.struct("at", "n")).alias("removed"))
    return keyed.join(removed, ["k", "ord"], "left")


_OUTCOME = T.StructType().add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("kept", "string")


def _outcome(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_parts(batch):
            texts, removed = part.column("text"), part.column("removed")
            raw, bounds = text_bytes(texts)
            rows: dict[str, list] = {x: [] for x in _OUTCOME.names}
            for i, (null, ranges) in enumerate(zip(texts.is_null().to_pylist(), removed, strict=True)):
                text = raw[bounds[i] : bounds[i + 1]]
                at, n = (ranges.values.field(x).to_numpy().astype(np.int64) for x in ("at", "n")) if ranges.is_valid else np.zeros((2, 0), np.int64)
                edge = np.zeros(len(text) + 1, np.int32)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + n + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = text[~gone].tobytes()
                rows["n_bytes"].append(len(text))
                rows["n_removed"].append(len(text) - len(kept))
                rows["n_spans"].append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(text) else 0)
                rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                rows["kept"].append(None if null else kept.decode("utf-8", "ignore"))
            names = [x for x in part.schema.names if x not in ("text", "removed")]
            yield pa.RecordBatch.from_arrays([part.column(x) for x in names] + [pa.array(rows[f.name], pa.string() if f.dataType == T.StringType() else pa.int64()) for f in _OUTCOME], names=names + _OUTCOME.names)


def without_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``documents``, repeats of at least ``length`` bytes cut out of text, first occurrences kept.

    Adds (in a struct ``repeats``) n_bytes of the whole text, n_removed, n_spans (maximal removed runs) and
    kept_sha256 (digest of the remaining bytes). A cut inside a letter drops what is left of it from text, not from the
    digest. A null text stays null and counts as empty; texts under ``length`` bytes are kept whole. A null doc_id
    comes after all others. Rows with one doc_id but different texts are ordered by text; rows equal in both are one
    document listed twice, and neither is a repeat of the other.
    """
    spans = repeated_spans(documents, length)
    kept = [f for f in spans.schema if f.name not in ("text", "removed")]
    cut = spans.mapInArrow(lambda batches: _outcome(batches, length), T.StructType(kept + list(_OUTCOME)))
    if "rest" in spans.columns:
        columns = {x: F.col(f"rest.`{x}`") for x in documents.columns if x != "text"}
    else:
        columns = {"doc_id": F.when(F.col("ord") % 2 == 0, F.col("k"))}
    columns["text"] = F.col("kept")
    return cut.select(*[columns[x].alias(x) for x in documents.columns], F.struct(*_OUTCOME.names[:-1]).alias("repeats"))
