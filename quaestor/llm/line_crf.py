"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its own features and those of its neighbours speak for one of the two; the chain adds a bonus
for two good or two bad lines in a row. Forward-backward gives each line's probability of being good, and a document's
score is their mean, weighted by the lines' lengths.

Labels are known of documents only, so training takes each line of a labelled document to have its label, and weighs
documents alike. It sees a bounded sample of documents, in sequences of bounded length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import RangeHash, labelled_sample, slices, text_bounds, text_bytes

#: About so many labelled documents are trained on.
TRAINED_DOCUMENTS = 4000
#: Lines of a training sequence; a longer document gives several.
TRAINED_LINES = 64
#: A document that scores less is rejected.
REJECTED = 0.3
ROUNDS, RATE, PENALTY = 200, 0.2, 3e-4

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _class(letters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(letters.encode(), np.uint8)] = True
    return out


_UPPER, _LOWER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz")
_CLASSES = {
    "upper": _UPPER,
    "letter": _UPPER | _LOWER | (np.arange(256) >= 128),
    "digit": _class("0123456789"),
    "symbol": _class("#*$%&<>{}[]=_~^\\/@+"),
    "shout": _class("!"),
    "bar": _class("|"),
    "stop": _class(".,;:?'\"()-"),
}
_ENDING = _class(".!?")
#: Own features of a line, and those of them that its neighbours lend to it.
FEATURES = ("one", "length", "words", "word_length", "upper", "digit", "symbol", "shout", "bar", "stop", "again", "ends", "repeated")
LENT = ("length", "upper", "symbol", "shout", "bar", "again", "ends")
WIDTH = len(FEATURES) + 2 * len(LENT) + 2


def line_features(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and length of each line that has a word, and the number of such lines of each text."""
    documents = len(bounds) - 1
    breaks = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([bounds[:-1], breaks + 1]))
    starts = starts[starts < len(raw)]
    document = np.searchsorted(bounds, starts, "right") - 1
    ends = np.minimum(np.concatenate([starts[1:], [len(raw)]]), bounds[document + 1])
    ends = ends - ((ends > starts) & (raw[np.maximum(ends - 1, 0)] == 10))
    black = ~_WHITE[raw]
    inside = np.concatenate([[False], black[:-1]])
    inside[bounds[:-1][bounds[:-1] < len(raw)]] = False
    word = np.flatnonzero(black & ~inside)
    first, after = np.searchsorted(word, starts), np.searchsorted(word, ends)
    has = after > first
    starts, ends, document, first, after = (x[has] for x in (starts, ends, document, first, after))
    counts = np.bincount(document, minlength=documents)
    if not len(starts):
        return np.zeros((0, WIDTH), np.float32), np.zeros(0), counts

    def within(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[ends] - total[starts]).astype(np.float64)

    found = {name: within(members[raw]) for name, members in _CLASSES.items()}
    words, solid = (after - first).astype(np.float64), within(black)
    # A word ends at the next white space or at the end of the text.
    stops = np.flatnonzero(_WHITE[raw] | np.isin(np.arange(len(raw)), bounds[1:-1]))
    at = np.searchsorted(stops, word)
    word_end = np.where(at < len(stops), stops[np.minimum(at, max(len(stops) - 1, 0))] if len(stops) else len(raw), len(raw))
    hashes = RangeHash(raw.astype(np.uint64) + np.uint64(1), 1)
    named = hashes.of(word, np.maximum(word_end, word + 1))
    same = np.concatenate([[0], np.cumsum(named[1:] == named[:-1])]) if len(word) else np.zeros(1, np.int64)
    again = (same[after - 1] - same[first]).astype(np.float64)
    line = hashes.of(starts, ends)
    order = np.lexsort((line, document))
    equal = (line[order][1:] == line[order][:-1]) & (document[order][1:] == document[order][:-1])
    repeated = np.zeros(len(line))
    repeated[order] = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
    last = np.searchsorted(np.flatnonzero(black), ends) - 1
    tail = raw[np.flatnonzero(black)[np.maximum(last, 0)]]
    own = {
        "one": np.ones(len(line)),
        "length": np.log1p(ends - starts) / 6,
        "words": np.log1p(words) / 4,
        "word_length": np.minimum(solid / words / 12, 2),
        "upper": found["upper"] / np.maximum(found["letter"], 1),
        "digit": found["digit"] / solid,
        "symbol": np.minimum(found["symbol"] / words, 3),
        "shout": np.minimum(found["shout"] / words, 3),
        "bar": np.minimum(found["bar"] / words, 3),
        "stop": np.minimum(found["stop"] / words, 3),
        "again": again / words,
        "ends": _ENDING[tail].astype(np.float64),
        "repeated": repeated,
    }
    before = np.concatenate([[False], document[1:] == document[:-1]])
    behind = np.concatenate([before[1:], [False]])
    columns = [own[x] for x in FEATURES]
    columns += [np.where(before, np.concatenate([[0], own[x][:-1]]), 0) for x in LENT] + [~before]
    columns += [np.where(behind, np.concatenate([own[x][1:], [0]]), 0) for x in LENT] + [~behind]
    return np.stack(columns, axis=1).astype(np.float32), (ends - starts).astype(np.float64), counts


@dataclass
class Chain:
    """Weights of the features for a good line, the bonus of two good and of two bad lines in a row, and the share of good documents."""

    weights: np.ndarray
    good: float
    bad: float
    prior: float


class _Steps:
    """Positions of the lines of many sequences by step, longest sequence first, so that one step serves all that are long enough."""

    def __init__(self, counts: np.ndarray):
        start = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        sizes = counts[order]
        self.at = [start[order[: np.searchsorted(-sizes, -step, "left")]] + step for step in range(int(counts.max(initial=0)))]


def _messages(odds: np.ndarray, steps: _Steps, good: float, bad: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages as log-odds of good against bad."""
    forward, backward = odds.copy(), np.zeros_like(odds)
    for here in steps.at[1:]:
        f = forward[here - 1]
        forward[here] += np.logaddexp(f + good, 0) - np.logaddexp(f, bad)
    for here in reversed(steps.at[1:]):
        h = odds[here] + backward[here]
        backward[here - 1] = np.logaddexp(h + good, 0) - np.logaddexp(h, bad)
    return forward, backward


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def trained(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, shares: np.ndarray, prior: float) -> Chain:
    """Weights of greatest penalised conditional likelihood, by gradient steps with running scales.

    ``counts`` are lines per sequence, ``labels`` and ``shares`` (weight) are per sequence.
    """
    features = features.astype(np.float64)
    steps = _Steps(counts)
    sequence = np.repeat(np.arange(len(counts)), counts)
    label, share = labels[sequence].astype(np.float64), shares[sequence]
    pair = np.flatnonzero(sequence[1:] == sequence[:-1])
    both_good, both_bad = (share[pair] * label[pair]).sum(), (share[pair] * (1 - label[pair])).sum()
    theta = np.zeros(features.shape[1] + 2)
    speed, scale = np.zeros_like(theta), np.zeros_like(theta)
    for turn in range(1, ROUNDS + 1):
        weights, (good, bad) = theta[:-2], theta[-2:]
        odds = features @ weights
        forward, backward = _messages(odds, steps, good, bad)
        slope = features.T @ (share * (label - _logistic(forward + backward)))
        left, right = forward[pair], (odds + backward)[pair + 1]
        parts = np.stack([left + right + good, np.full(len(pair), bad), left, right])
        parts = np.exp(parts - parts.max(axis=0, initial=-np.inf, keepdims=True)) if len(pair) else parts
        parts = share[pair] * parts / parts.sum(axis=0) if len(pair) else parts
        gradient = np.concatenate([slope, [both_good - parts[0].sum(), both_bad - parts[1].sum()]]) / max(1e-9, share.sum()) - PENALTY * theta
        speed, scale = 0.9 * speed + 0.1 * gradient, 0.99 * scale + 0.01 * gradient**2
        theta = theta + RATE * (speed / (1 - 0.9**turn)) / (np.sqrt(scale / (1 - 0.99**turn)) + 1e-6)
    return Chain(theta[:-2], float(theta[-2]), float(theta[-1]), prior)


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in slices(text_bounds(batch.column("text"))):
            part = batch.slice(low, high - low)
            features, _, counts = line_features(*text_bytes(part.column("text")))
            ends = np.cumsum(counts)
            blobs = [features[end - n : end].tobytes() for n, end in zip(counts, ends, strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "quality": part.column("quality"), "features": pa.array(blobs, pa.binary())})


def fitted(documents: DataFrame, labels: DataFrame, bound: int = TRAINED_DOCUMENTS) -> Chain:
    """A chain fitted to about ``bound`` of the documents that ``labels`` (doc_id, quality of 0 or 1) tells of."""
    chosen = labelled_sample(documents, labels, "quality", bound).select("doc_id", "text", "quality")
    sample = chosen.mapInArrow(_training_rows, "doc_id long, quality int, features binary").toPandas()
    sample = sample.sort_values(["doc_id", "quality", "features"], kind="stable")
    quality = sample["quality"].to_numpy()
    prior = float((quality.sum() + 1) / (len(quality) + 2))
    features = np.frombuffer(b"".join(map(bytes, sample["features"])), np.float32).reshape(-1, WIDTH)
    counts = np.array([len(x) // (4 * WIDTH) for x in sample["features"]], np.int64)
    pieces = (counts + TRAINED_LINES - 1) // TRAINED_LINES
    document = np.repeat(np.arange(len(counts)), pieces)
    rank = np.arange(len(document)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lengths = np.minimum(counts[document] - rank * TRAINED_LINES, TRAINED_LINES)
    if not len(lengths):
        return Chain(np.zeros(WIDTH), 0.0, 0.0, prior)
    return trained(features, lengths, quality[document], 1 / counts[document], prior)


def document_scores(raw: np.ndarray, bounds: np.ndarray, chain: Chain) -> np.ndarray:
    """Length-weighted mean of the lines' probabilities of being good; the prior for a text without words."""
    features, lengths, counts = line_features(raw, bounds)
    odds = features.astype(np.float64) @ chain.weights
    forward, backward = _messages(odds, _Steps(counts), chain.good, chain.bad)
    document = np.repeat(np.arange(len(counts)), counts)
    total = np.bincount(document, lengths, len(counts))
    good = np.bincount(document, lengths * _logistic(forward + backward), len(counts))
    return np.where(total > 0, np.clip(good / np.maximum(total, 1), 0, 1), chain.prior)


def _scored(batches: Iterator[pa.RecordBatch], chain: Chain) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for low, high in slices(text_bounds(texts)):
            part = batch.slice(low, high - low)
            scores = document_scores(*text_bytes(texts[low:high]), chain)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores)], names=["row", "text", "score"])


def with_quality(documents: DataFrame, chain: Chain) -> DataFrame:
    """row (a struct of all columns but text), text and score (0 to 1) of every row of ``documents``.

    A null, empty or blank text gets the prior, the share of good documents in training. Repeated rows get equal scores.
    """
    rows = documents.select(F.struct(*[F.col(f"`{x}`") for x in documents.columns if x != "text"]).alias("row"), "text")
    return rows.mapInArrow(lambda batches: _scored(batches, chain), rows.select("*", F.lit(0.0).alias("score")).schema)
