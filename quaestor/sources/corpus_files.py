"""Corpus files, snapshots, published versions and append-only stores."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.operators.versions import insert_absent
from quaestor.sources.commit_log import CommitLog
from quaestor.sources.envelopes import array_elements, surroundings

RECORD_SCHEMA = (
    "id string, moncode string, base int, assemblee string, legislature string, session string, type string, "
    "numero int, langue string, titre string, titre_nl string, auteur string, destinataire string, "
    "date_reception date, date_publication date, date_reponse date, question string, reponse string, "
    "url_source string, empreinte_contenu string"
)
ENVELOPE_SCHEMA = "extrait_le string, nombre_elements int, methode_echantillonnage string"


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(envelope, records) of a corpus file: one JSON object holding the records, read in byte ranges."""
    records = array_elements(spark, path, "{", RECORD_SCHEMA).select("value.*").withColumn("question_id", F.col("id"))
    return surroundings(spark, path, ENVELOPE_SCHEMA), records


#: Rows of an envelope that a task puts in order before it writes them.
ENVELOPE_ROWS = 100_000


def write_envelopes(rows: DataFrame, path: str, shards: int) -> None:
    """Index rows (row array<string>) as files ``{"data": [[...], ...]}``, by hash of the row; the first element is empty.

    There are at least ``shards`` files, and more where they would have over ``ENVELOPE_ROWS`` rows each: a task orders whole files.
    """
    shards = max(shards, -(-rows.count() // ENVELOPE_ROWS))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    lines = rows.select(shard.alias("shard"), F.lit(1).alias("part"), F.concat(F.lit(","), F.to_json("row")).alias("value"))
    edges = rows.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.inline(F.array(
        F.struct(F.lit(0).alias("part"), F.lit('{"data": [[]').alias("value")), F.struct(F.lit(2).alias("part"), F.lit("]}").alias("value")),
    )))
    ordered = lines.unionByName(edges).repartition(shards, "shard").sortWithinPartitions("shard", "part")
    ordered.select("shard", "value").write.mode("errorifexists").partitionBy("shard").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a corpus published as JSON lines, the form large corpora are exchanged in."""
    return spark.read.schema(RECORD_SCHEMA).json(path).withColumn("question_id", F.col("id"))


def export_records(documents: DataFrame, path: str) -> None:
    """Documents ordered by id, as JSON lines."""
    documents.orderBy("question_id").write.mode("errorifexists").json(path)


def write_snapshot(rows: DataFrame, root: str, run_stamp: str, name: str) -> str:
    """One part of a run's snapshot (index, pages, excluded, missing...), kept under the run's stamp."""
    path = f"{root}/{name}"
    rows.withColumn("run_ts", F.lit(run_stamp)).write.mode("append").partitionBy("run_ts").parquet(path)
    return path


def publish(rows: DataFrame, root: str, name: str, version: str) -> None:
    """Writes a new version in full, then commits it: readers see the old or the new one, never a mixture.

    Of two publishers the one whose commit comes later is the latest, whatever their clocks say.
    """
    log = CommitLog(rows.sparkSession, root)
    folder = log.folder(f"data/{name}")
    rows.write.mode("errorifexists").parquet(f"{log.root}/{folder}")
    log.commit(lambda _, state: published_state(state, name, version, folder, rows))


def published_state(state: dict[str, Any], name: str, version: str, folder: str, rows: DataFrame) -> dict[str, Any]:
    """The state after publishing ``rows``, which were written to ``folder``."""
    entry = {"version": version, "folder": folder, "schema": schema_of(rows)}
    return {**state, "published": {**state.get("published", {}), name: entry}}


def schema_of(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def read_published(spark: SparkSession, root: str, name: str, number: int | None = None) -> DataFrame:
    """The latest published version of a table, or that of a numbered commit."""
    log = CommitLog(spark, root)
    entry = log.state(number)[1]["published"][name]
    return log.read([entry["folder"]], entry["schema"])


def store_in(log: CommitLog, state: dict[str, Any], name: str) -> DataFrame | None:
    """The rows of a store as of ``state``, None if there is none yet."""
    entry = state.get("stores", {}).get(name)
    return entry and log.read(entry["folders"], entry["schema"])


def read_store(spark: SparkSession, root: str, name: str, number: int | None = None) -> DataFrame | None:
    """The rows of a store as of the last commit, or of a numbered one; None if there is none yet."""
    log = CommitLog(spark, root)
    return store_in(log, log.state(number)[1], name)


def absent_appended(log: CommitLog, rows: DataFrame, name: str, keys: list[str]) -> Callable[[int, dict[str, Any]], dict[str, Any] | None]:
    """A change that appends the rows whose key the store lacks, as of the state it is applied to.

    Applied again after another writer's commit, it sees that writer's rows, so no key is stored twice.
    """

    def change(_: int, state: dict[str, Any]) -> dict[str, Any] | None:
        store = store_in(log, state, name)
        absent = rows.dropDuplicates(keys) if store is None else insert_absent(rows, store, keys)
        folder = log.folder(f"data/{name}")
        absent.write.parquet(f"{log.root}/{folder}")
        if store is not None and log.read([folder], schema_of(rows)).isEmpty():
            return None
        folders = [*state.get("stores", {}).get(name, {}).get("folders", []), folder]
        return {**state, "stores": {**state.get("stores", {}), name: {"folders": folders, "schema": schema_of(rows)}}}

    return change


def append_absent(rows: DataFrame, root: str, name: str, keys: list[str]) -> int:
    """Appends the rows whose key the store lacks; stored rows are never rewritten. The number of the commit."""
    log = CommitLog(rows.sparkSession, root)
    return log.commit(absent_appended(log, rows, name, keys))


def write_report(report: DataFrame, path: str) -> None:
    """A report of a few rows (counts of a run) as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)
