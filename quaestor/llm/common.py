"""Helpers the training-data operators share: tables, stored results, texts as bytes, hashes of byte ranges."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.session import ensure_checkpoint_dir

#: Bytes of text that are worked on at once inside a task, if no single text is longer.
SLICE_BYTES = 1 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new name in the checkpoint folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """The rows of ``df``, written once as Parquet to the shared folder (or ``folder`` in it) and read from there.

    Cuts the lineage: a lost executor costs the tasks that were running, not the work before them.
    """
    path = f"{folder}/{label}-{uuid.uuid4().hex}" if folder else shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession, folder: str) -> None:
    """Removes a folder of stored tables that no result reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def bounded_share(ids: DataFrame, bound: int) -> Column:
    """True for the share of ``ids`` (column doc_id) of about ``bound`` rows, by hash of the id; all rows if there are fewer."""
    share = min(1.0, bound / max(1, ids.count()))
    return F.pmod(F.xxhash64(F.lit("share"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """doc_id, text and ``label`` (0 or 1) of about ``bound`` labelled documents, chosen by hash of the id.

    Of labels that contradict each other the larger counts. The chosen labels are broadcast: their number is bounded.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias(label))
    chosen = known.where(bounded_share(known, bound))
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts (or binaries) of a column as one array of bytes, and where each begins and the last ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    plain = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if plain else pa.large_string()).fill_null(b"" if plain else "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes; a longer text stands alone."""
    low, rows = 0, len(bounds) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + limit, "right")) - 1)
        yield low, high
        low = high


def text_bounds(column: pa.Array) -> np.ndarray:
    """Where each text of a column begins and the last ends, counted from anywhere; the texts are not copied."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = column.buffers()[1]
    if offsets is None or not len(column):
        return np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of bounded text (column text)."""
    for low, high in slices(text_bounds(batch.column("text"))):
        yield batch.slice(low, high - low)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * _MIX
    values ^= values >> np.uint64(27)
    values *= _GOLDEN
    return values ^ (values >> np.uint64(31))


def octets(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; past the end there are zeros."""
    out = np.zeros(len(raw) + 8, np.uint64)
    out[: len(raw)] = raw
    for width in (1, 2, 4):
        out[:-width] |= out[width:] << np.uint64(8 * width)
    return out[: len(raw)]


class RangeHash:
    """Hashes of byte ranges, from running sums over one scrambled number per position.

    ``values`` are numbers that stand for ``reach`` bytes from each position on; ranges have at least as many bytes.
    """

    def __init__(self, values: np.ndarray, reach: int = 8):
        powers = np.full(len(values) + 1, _GOLDEN, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        inverse = np.full(len(values) + 1, np.uint64(pow(int(_GOLDEN), -1, 1 << 64)), np.uint64)
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mixed(values) * powers[:-1], out=self.sums[1:])
        self.reach = reach

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = (self.sums[end - (self.reach - 1)] - self.sums[start]) * self.inverse[start]
        return mixed(total + (end - start).astype(np.uint64) * _MIX)


def gathered(blob: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``ids`` of an offset table, one after the other, and the running length after each."""
    lengths = offsets[ids + 1] - offsets[ids]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(offsets[ids] - (ends - lengths), lengths)
    return blob[at], ends
