"""Toxic passages by maximum-scoring segments.

Each unit of a word (the word, and its first four, five and six letters) has a log-odds of standing in toxic against
clean documents, smoothed by a Dirichlet prior in proportion to all documents and lowered by a multiple of their standard
error. A word scores by its most toxic unit, else a small negative amount, so that the expected score is negative. One linear scan finds all
maximal segments of a text. On clean text the best scores follow an extreme-value law: its rate solves
sum(p * exp(rate * score)) = 1 over clean words, and a segment of score S in n words is expected K n exp(-rate S) times.
The evidence of a document's significant segments is calibrated on labelled documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import labelled_sample, slices, stored, text_bytes

#: About so many labelled documents are trained on.
TRAINED_DOCUMENTS = 20_000
#: Units of the lexicon, at most, and the standard errors by which a unit's log-odds are lowered before they count.
LEXICON_UNITS = 20_000
DOUBT = 3.0
#: Weight of the Dirichlet prior, in occurrences.
PRIOR = 20_000.0
#: What each other word costs.
DRIFT = 0.25
#: Expected number of chance segments of a score from which on it isn't significant.
SIGNIFICANT = 0.05
PREFIXES = (4, 5, 6)

_WORD = regex.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def units_of(word: str) -> list[str]:
    """The word, and its beginnings (marked so that they differ from words)."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


@dataclass
class Lexicon:
    """Scores of toxic units, the law of chance scores, and the calibration of a document's evidence."""

    units: dict[str, float]
    rate: float = 1.0
    chance: float = 1.0
    slope: float = 1.0
    offset: float = -2.0

    def score_of(self, word: str) -> float:
        return max((self.units.get(x, -DRIFT) for x in units_of(word)), default=-DRIFT)


class _Scores(dict):
    """Bounded memo of words' scores."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        out = self.lexicon.score_of(word)
        if len(self) > 300_000:
            self.clear()
        self[word] = out
        return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score), in linear time.

    Candidates are kept with the running total before and after them. A new positive run is joined to the last candidate
    that began lower, if that one ended no higher; what lies between is swallowed.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.cumsum(scores)
    heads = positive[np.concatenate([[True], np.diff(positive) > 1])]
    tails = positive[np.concatenate([np.diff(positive) > 1, [True]])]
    kept: list[list] = []  # first, end, total before, total after, index of the nearest candidate before that began lower
    for first, tail in zip(heads.tolist(), tails.tolist(), strict=True):
        run = [first, tail + 1, float(total[first] - scores[first]), float(total[tail]), -1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= run[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= run[3]:
                run[4] = j
                kept.append(run)
                break
            run[0], run[2] = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, after - before) for a, b, before, after, _ in kept]


def passages(text: str | None, lexicon: Lexicon, memo: _Scores | None = None) -> tuple[list[tuple[int, int, float]], int]:
    """Significant segments (first word, end, expected number by chance) and the number of words."""
    words = words_of(text)
    memo = _Scores(lexicon) if memo is None else memo
    scores = np.fromiter(map(memo.__getitem__, words), np.float64, len(words))
    out = []
    for first, end, score in maximal_segments(scores):
        expected = lexicon.chance * len(words) * exp(-min(700.0, lexicon.rate * score))
        if expected <= SIGNIFICANT:
            out.append((first, end, expected))
    return out, len(words)


def evidence(found: list[tuple[int, int, float]]) -> float:
    """Sum of the segments' log significances, damped."""
    return log1p(sum(-log(max(x, 1e-300)) for _, _, x in found))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        units = sorted({*counts[0], *counts[1]})
        return pa.RecordBatch.from_pydict({"unit": pa.array(units, pa.string()), "clean": [counts[0][x] for x in units], "toxic": [counts[1][x] for x in units]})

    counts = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update({unit for word in set(words_of(text.as_py())) for unit in units_of(word)})
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield told(counts)
                counts = (Counter(), Counter())
    yield told(counts)


def _chance_rows(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """Per training document: number of words, number of toxic words, and the scores of its maximal segments."""
    memo = _Scores(lexicon)
    for batch in batches:
        out = {"toxic": batch.column("toxic"), "words": [], "hits": [], "scores": []}
        for text in batch.column("text"):
            words = words_of(text.as_py())
            scores = np.fromiter(map(memo.__getitem__, words), np.float64, len(words))
            out["words"].append(len(words))
            out["hits"].append(scores[scores > 0].tolist())
            out["scores"].append([x for _, _, x in maximal_segments(scores)])
        yield pa.RecordBatch.from_arrays([out["toxic"], pa.array(out["words"], pa.int64()), pa.array(out["hits"], pa.list_(pa.float64())), pa.array(out["scores"], pa.list_(pa.float64()))], names=["toxic", "words", "hits", "scores"])


def fitted(documents: DataFrame, labels: DataFrame, bound: int = TRAINED_DOCUMENTS) -> Lexicon:
    """Lexicon, chance law and calibration from about ``bound`` of the documents that ``labels`` (doc_id, toxic of 0 or 1) tells of."""
    sample = stored(labelled_sample(documents, labels, "toxic", bound).select("text", "toxic"), "toxic-sample")
    counts = sample.mapInArrow(_counted, "unit string, clean long, toxic long").groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = counts.agg(F.sum("clean"), F.sum("toxic")).first()
    if not totals[0] or not totals[1]:
        return Lexicon({})
    prior = F.lit(PRIOR) * (F.col("toxic") + F.col("clean")) / float(totals[0] + totals[1])
    odds = lambda count, total: F.log((count + prior) / (F.lit(float(total)) + PRIOR - count - prior))
    scored = counts.select("unit", "toxic", "clean", (odds(F.col("toxic"), totals[1]) - odds(F.col("clean"), totals[0])).alias("delta"), F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior)).alias("width"))
    certain = scored.select("unit", (F.col("delta") - DOUBT * F.col("width")).alias("score")).where("score > 0")
    lexicon = Lexicon({row.unit: row.score for row in certain.orderBy(F.desc("score"), "unit").limit(LEXICON_UNITS).collect()})
    rows = sample.mapInArrow(lambda batches: _chance_rows(batches, lexicon), "toxic int, words long, hits array<double>, scores array<double>").toPandas()
    clean = rows[rows["toxic"] == 0]
    lexicon.rate, lexicon.chance = chance_law(int(clean["words"].sum()), np.array([x for y in clean["hits"] for x in y]), np.array([x for y in clean["scores"] for x in y]), list(lexicon.units.values()))
    found = []
    for words, scores in zip(rows["words"], rows["scores"], strict=True):
        expected = [lexicon.chance * words * exp(-min(700.0, lexicon.rate * x)) for x in scores]
        found.append(evidence([(0, 0, x) for x in expected if x <= SIGNIFICANT]))
    lexicon.slope, lexicon.offset = calibrated(np.array(found), rows["toxic"].to_numpy())
    return lexicon


def chance_law(words: int, hits: np.ndarray, segments: np.ndarray, scores: list[float]) -> tuple[float, float]:
    """Rate and factor of the extreme-value law of clean text: of ``words`` clean words those in ``hits`` scored above zero.

    One more hit of the mean score is taken for granted, so that the rate is finite where clean text has none.
    """
    values = np.append(hits, np.mean(scores) if scores else 1.0)
    share = 1 / (words + 1)
    mean = lambda rate: float((share * np.exp(np.minimum(700, rate * values))).sum() + (1 - share * len(values)) * exp(-rate * DRIFT))
    low, high = 1e-6, 1.0
    while mean(high) < 1:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    least = float(segments.min()) if len(segments) else float(values.min())
    return low, (len(segments) + 1) / ((words + 1) * exp(-low * least))


def calibrated(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic law of the label, by Newton steps with a small penalty."""
    design = np.stack([values, np.ones(len(values))], axis=1)
    theta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        theta = theta + np.linalg.solve(hessian, design.T @ (labels - p) - 0.1 * theta)
    return float(theta[0]), float(theta[1])


def _scored(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    memo = _Scores(lexicon)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("expected", pa.float64())]))
    for batch in batches:
        for low, high in slices(text_bytes(batch.column("text"))[1]):
            part = batch.slice(low, high - low)
            found = [passages(x, lexicon, memo)[0] for x in part.column("text").to_pylist()]
            scores = [1 / (1 + exp(-max(-30.0, min(30.0, lexicon.slope * evidence(x) + lexicon.offset)))) for x in found]
            spans = pa.array([[{"first": a, "end": b, "expected": e} for a, b, e in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), spans], names=["doc_id", "score", "passages"])


def with_toxicity(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score (0 to 1) and passages (first word, end, expected number by chance) of every row.

    A null or empty text has no passage and gets the score of such documents. Only doc_id and text are read.
    """
    schema = "doc_id long, score double, passages array<struct<first:int,end:int,expected:double>>"
    return documents.select("doc_id", "text").mapInArrow(lambda batches: _scored(batches, lexicon), schema)
