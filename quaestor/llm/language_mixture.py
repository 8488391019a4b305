"""Language identification by mixture inference.

Letter trigrams, hashed to a fixed number of classes, have a likelihood in each language. Expectation-maximisation
finds the proportions of languages that make a document's trigrams likeliest. The set of languages grows, the
strongest first, while the gain in likelihood is worth another parameter (the trigrams overlap, so each counts for a
third of an observation). The prediction is the language of the largest proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import bounded_share, mixed, slices, text_bytes

#: About so many documents are learnt from.
TRAINED_DOCUMENTS = 20_000
#: Classes that trigrams are hashed to.
CLASSES = 1 << 13
SMOOTHING = 0.5
ROUNDS = 12
#: Independent observations per trigram.
WEIGHT = 1 / 3
UNDETERMINED = "und"

_LETTERS = np.array([chr(x).isalpha() for x in range(1 << 16)])


def classes_of(text: str | None) -> np.ndarray:
    """Class of each letter trigram; whatever isn't a letter is one space."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTERS[np.minimum(points, (1 << 16) - 1)]
    far = np.flatnonzero(points >= 1 << 16)
    letter[far] = [chr(x).isalpha() for x in points[far].tolist()]
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.where(letter, points, 32).astype(np.uint64)
    keep = letter | np.concatenate([[True], letter[:-1]])
    points = np.concatenate([[32], points[keep], [32]]).astype(np.uint64)
    joined = points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:]
    return (mixed(joined) % np.uint64(CLASSES)).astype(np.int64)


@dataclass
class Languages:
    names: list[str]
    #: Likelihood of each class (rows) in each language (columns).
    likelihood: np.ndarray


def mixture(counts: np.ndarray, likelihood: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the languages and the log-likelihood they give."""
    share = np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    total = counts.sum()
    for _ in range(ROUNDS):
        new = share * ((counts / (likelihood @ share)) @ likelihood) / total
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, float(counts @ np.log(likelihood @ share))


def languages_of(text: str | None, model: Languages) -> list[tuple[str, float]]:
    """The selected languages and their proportions, the largest first; none for a text without letters."""
    found = classes_of(text)
    if not len(found) or not model.names:
        return []
    dense = np.bincount(found, minlength=CLASSES)
    seen = np.flatnonzero(dense)
    counts, likelihood = dense[seen].astype(np.float64), model.likelihood[seen]
    single = counts @ np.log(likelihood)
    best = int(single.argmax())
    chosen, share, value = [best], np.ones(1), float(single[best])
    if len(model.names) > 1:
        strength = mixture(counts, likelihood)[0].copy()
        price = 0.5 * np.log(max(2.0, WEIGHT * counts.sum()))
        strength[best] = -1
        for other in np.argsort(-strength, kind="stable")[:-1]:
            more, likely = mixture(counts, likelihood[:, [*chosen, other]])
            if WEIGHT * (likely - value) <= price:
                break
            chosen, share, value = [*chosen, int(other)], more, likely
    return sorted(((model.names[i], float(x)) for i, x in zip(chosen, share, strict=True)), key=lambda x: (-x[1], x[0]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
            if lang not in total:
                total[lang] = np.zeros(CLASSES, np.int64)
            total[lang] += np.bincount(classes_of(text.as_py()), minlength=CLASSES)
    for lang in sorted(total):
        seen = np.flatnonzero(total[lang])
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(seen), pa.string()), "class": pa.array(seen, pa.int64()), "n": pa.array(total[lang][seen], pa.int64())})


def fitted(documents: DataFrame, bound: int = TRAINED_DOCUMENTS) -> Languages:
    """Likelihoods from about ``bound`` rows of ``documents`` (doc_id, text, lang), those without a lang left out."""
    known = documents.where("lang is not null").select("doc_id", "text", "lang")
    sample = known.where(bounded_share(known, bound)).select("text", "lang")
    rows = sample.mapInArrow(_counted, "lang string, class long, n long").groupBy("lang", "class").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(rows["lang"].unique())
    counts = np.full((CLASSES, len(names)), SMOOTHING)
    np.add.at(counts, (rows["class"].to_numpy(np.int64), np.searchsorted(names, rows["lang"]) if names else np.zeros(0, np.int64)), rows["n"].to_numpy(np.float64))
    return Languages([str(x) for x in names], counts / counts.sum(axis=0))


def _predicted(batches: Iterator[pa.RecordBatch], model: Languages) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
    for batch in batches:
        for low, high in slices(text_bytes(batch.column("text"))[1]):
            part = batch.slice(low, high - low)
            found = [languages_of(x, model) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([x[0][0] if x else UNDETERMINED for x in found], pa.string()),
                    pa.array([min(1.0, x[0][1]) if x else 0.0 for x in found], pa.float64()),
                    pa.array([[{"lang": a, "share": b} for a, b in x] for x in found], kind),
                ],
                names=["doc_id", "lang_pred", "score", "languages"],
            )


def with_languages(documents: DataFrame, model: Languages) -> DataFrame:
    """doc_id, lang_pred, score (its proportion) and languages (all selected, with proportions) of every row.

    A null text or one without letters is ``und`` with score 0. Only doc_id and text are read.
    """
    schema = "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    return documents.select("doc_id", "text").mapInArrow(lambda batches: _predicted(batches, model), schema)
