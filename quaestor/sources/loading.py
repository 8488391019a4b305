"""The load job: records → content and passage stores → members → version → activation."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.fixed_values import EMBEDDING_DIMENSIONS
from quaestor.functions.records import content_hash, index_config
from quaestor.functions.vectors import substitute_vector
from quaestor.operators.passages import passages
from quaestor.operators.sizing import counted_side
from quaestor.operators.versions import activated, activation_checks
from quaestor.session import materialised
from quaestor.sources.commit_log import CommitLog
from quaestor.sources.corpus_files import append_absent, published_state, read_published, read_store, store_in

#: Bytes of a content_hash in a row of its own.
HASH_BYTES = 128
MEMBERS = "version_id string, question_id string, content_hash string"


def load_version(
    records: DataFrame,
    root: str,
    version_id: str,
    method: str,
    now: Column,
    model: str | None = None,
    dimensions: int = EMBEDDING_DIMENSIONS,
) -> DataFrame:
    """Stores ``records`` under ``root`` as a new version, activates it if its checks pass, and returns its checks.

    Stores are appended to: a content that is there already is neither written nor embedded again, so a load that
    was cut short is run again under the same name. ``model`` names the substitute vectors, None stores none. The
    passages that the stores must hold are counted in the records themselves. Loads may run side by side: each
    step is a commit that sees those before it, so that no content is stored twice and no version is lost.
    """
    spark = records.sparkSession
    log = CommitLog(spark, root)
    config = index_config(F.lit(model).cast("string"), dimensions=dimensions)
    fields = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    hashed = records.withColumn("content_hash", content_hash(fields, config))
    stored = read_store(spark, root, "documents")
    # Only passages of contents that no earlier load stored are split and embedded.
    new = hashed
    if stored is not None:
        # Digests are compared by themselves, so that no text is moved to find what is new.
        unknown = hashed.select("content_hash").join(stored.select("content_hash"), "content_hash", "left_anti").distinct()
        new = hashed.join(counted_side(unknown, HASH_BYTES), "content_hash", "left_semi")
    parts = passages(new, "content_hash")
    vector = F.lit(None).cast("array<double>") if model is None else substitute_vector(F.col("search_text"), dimensions)
    stored_parts = parts.withColumns({"embedding": vector, "embedding_model": F.lit(model).cast("string")})
    append_absent(stored_parts, root, "passages", ["content_hash", "passage_id"])
    # Documents follow their passages: a content that is stored is stored in full.
    append_absent(new.withColumn("created_at", now), root, "documents", ["content_hash"])

    expected = passages(records).agg(F.count("*").alias("passage_count")).select(F.lit(version_id).alias("version_id"), "passage_count")
    expected = materialised(expected)
    own = hashed.select(F.lit(version_id).alias("version_id"), "question_id", "content_hash")
    folder = log.folder("data/members")
    own.write.parquet(f"{log.root}/{folder}")
    own = log.read([folder], MEMBERS)
    row = own.agg(F.count("*").cast("int").alias("count")).select(
        F.lit(version_id).alias("version_id"), F.lit(False).alias("active"), "count", now.alias("extracted_at"), F.lit(method).alias("method"),
        now.alias("created_at"), F.lit(None).cast("timestamp").alias("activated_at"), F.lit(False).alias("activation_unknown"), config.alias("index_config"),
    )
    checks = None

    def activate(_: int, state: dict[str, Any]) -> dict[str, Any]:
        nonlocal checks
        checks = materialised(activation_checks(row, own, store_in(log, state, "passages"), expected))
        known = state.get("published", {}).get("versions")
        others = known and log.read([known["folder"]], known["schema"]).where(F.col("version_id") != version_id)
        versions = activated(row if known is None else others.unionByName(row), checks, version_id, now)
        target = log.folder("data/versions")
        versions.coalesce(1).write.parquet(f"{log.root}/{target}")
        after = published_state(state, "versions", version_id, target, versions)
        return {**after, "members": {**state.get("members", {}), version_id: folder}}

    log.commit(activate)
    return checks


def version_members(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """(version_id, question_id, content_hash) of all loaded versions."""
    log = CommitLog(spark, root)
    return log.read(list(log.state(number)[1].get("members", {}).values()), MEMBERS)


def active_records(spark: SparkSession, root: str, number: int | None = None) -> tuple[str, DataFrame]:
    """The active version's name and its records, all as of one commit."""
    log = CommitLog(spark, root)
    number, state = log.state(number)
    active = read_published(spark, root, "versions", number).where("active").select("version_id").first()
    if active is None:
        raise LookupError(f"no active version under {root}")
    members = log.read([state["members"][active.version_id]], MEMBERS).select("content_hash")
    return active.version_id, store_in(log, state, "documents").join(members, "content_hash", "left_semi").drop("content_hash", "created_at")
