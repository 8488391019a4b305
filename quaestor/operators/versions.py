"""Content store, corpus versions, activation, retention.

Tables: ``versions`` (version_id, active, count, extracted_at, method, created_at,
activated_at, activation_unknown, index_config), ``members`` (version_id,
question_id, content_hash), ``doc_store`` (content_hash, question_id, created_at,
...) and ``passage_store`` (content_hash, passage_id, section, position, content,
embedding, embedding_model).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaestor.fixed_values import NO_EMBEDDINGS, SECTIONS
from quaestor.functions.records import latest_date, present
from quaestor.operators.running import ordered_fold, running
from quaestor.operators.sizing import counted_side
from quaestor.session import materialised

HOUR = "INTERVAL 1 HOUR"


def first_copies(rows: DataFrame, keys: list[str], *preferred: Column) -> DataFrame:
    """One row per key, the preferred one. A key with many copies is reduced before the shuffle."""
    order = W.partitionBy(*keys).orderBy(*preferred)
    return rows.withColumn("_copy", F.row_number().over(order)).where(F.col("_copy") == 1).drop("_copy")


def deduplicated(copies: DataFrame, passage_copies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Version copies → (doc_store, passage_store, members). Embedded passage copies are preferred.

    ``copies``: version_id, question_id, content_hash, document. ``passage_copies``:
    version_id, question_id, content_hash, passage_id, embedded and passage columns.
    """
    doc_store = first_copies(copies, ["content_hash"], F.col("question_id"), F.col("version_id")).drop("version_id")
    passage_store = first_copies(
        passage_copies, ["content_hash", "passage_id"], F.col("embedding").isNull(), F.col("version_id")
    ).drop("version_id")
    return doc_store, passage_store, copies.select("version_id", "question_id", "content_hash")


def compatibility_view(members: DataFrame, doc_store: DataFrame) -> DataFrame:
    """The former one-row-per-version-copy shape: version_id, question_id, content_hash, document."""
    return members.join(doc_store.select("content_hash", "document"), "content_hash")


def insert_absent(rows: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: those whose key the store lacks, one per key."""
    return rows.dropDuplicates(keys).join(store.select(*keys), keys, "left_anti")


def ready_counts(hashes: DataFrame, doc_store: DataFrame, passage_store: DataFrame, model: str | None) -> DataFrame:
    """(content_hash, ready_passages) of the requested hashes already stored."""
    known = doc_store.join(hashes.select("content_hash").distinct(), "content_hash", "left_semi").select("content_hash")
    usable = (
        F.col("passage_id").isNotNull()
        if model is None
        else F.col("embedding").isNotNull() & (F.col("embedding_model") == model)
    )
    return known.join(
        passage_store.select("content_hash", "passage_id", "embedding", "embedding_model"), "content_hash", "left"
    ).groupBy("content_hash").agg(F.count_if(usable).alias("ready_passages"))


def to_embed(items: DataFrame, ready: DataFrame) -> DataFrame:
    """Items (content_hash, n_passages, ...) whose stored passages are not all ready."""
    complete = items.join(ready, "content_hash").where(F.col("ready_passages") == F.col("n_passages"))
    return items.join(complete.select("content_hash"), "content_hash", "left_anti")


def _packed(opened: tuple[int, int], item: tuple[int, int], max_inputs: int, max_bytes: int) -> tuple[tuple[int, int], bool]:
    """The open batch after an item, and whether the item began it. Nothing is open before the first item."""
    inputs, size = opened[0] + item[0], opened[1] + item[1]
    if not opened[0] or inputs > max_inputs or size > max_bytes:
        return item, True
    return (inputs, size), False


def _shard_links(max_inputs: int, max_bytes: int):
    """Per shard: the first items, and for each of them, as the head of a batch, the batch left open and the number begun."""

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        items = list(zip(frame["n_inputs"].tolist(), frame["n_bytes"].tolist(), strict=True))
        begun = [0] * min(max_inputs, len(items))
        # Heads whose open batches have come to be equal go on as one.
        states: dict[tuple[int, int], list[int]] = {}
        for i, item in enumerate(items):
            moved: dict[tuple[int, int], list[int]] = {}
            for opened, heads in states.items():
                after, fresh = _packed(opened, item, max_inputs, max_bytes)
                moved.setdefault(after, []).extend(heads)
                for head in heads if fresh else ():
                    begun[head] += 1
            if i < len(begun):
                moved.setdefault(item, []).append(i)
                begun[i] += 1
            states = moved
        left = {head: opened for opened, heads in states.items() for head in heads}
        first = items[: len(begun)]
        row = {
            "shard": int(frame["shard"].iloc[0]),
            "first_inputs": [n for n, _ in first],
            "first_bytes": [b for _, b in first],
            "open_inputs": [left[h][0] for h in range(len(begun))],
            "open_bytes": [left[h][1] for h in range(len(begun))],
            "begun": begun,
        }
        return pd.DataFrame([row])

    return links


def embedding_batches(items: DataFrame, max_inputs: int, max_bytes: int, shard_items: int = 100_000) -> DataFrame:
    """Adds ``batch``: whole records in order, at most ``max_inputs`` texts and ``max_bytes`` per batch.

    ``items``: seq (growing with the order), question_id, n_inputs (1 at least), n_bytes. An
    oversized record has a batch of its own. The order is cut into shards of ``shard_items``,
    which change no batch: a batch that reaches into the next shard covers fewer than
    ``max_inputs`` of its records, so a first pass tells for each possible head what the shard
    leaves open, these links (one row per shard) are followed in order, and a second pass packs
    every shard from its true head.
    """
    shard_items = max(shard_items, max_inputs)
    narrow = items.select(
        F.floor(F.col("seq") / shard_items).cast("bigint").alias("shard"),
        F.col("seq").cast("bigint"),
        "question_id",
        F.col("n_inputs").cast("bigint"),
        F.col("n_bytes").cast("bigint"),
    )
    lists = ("first_inputs", "first_bytes", "open_inputs", "open_bytes", "begun")
    linked = narrow.select("shard", "seq", "n_inputs", "n_bytes").groupBy("shard").applyInPandas(
        _shard_links(max_inputs, max_bytes), "shard bigint, " + ", ".join(f"{c} array<bigint>" for c in lists)
    )

    def follow(state: dict, row: tuple) -> list[tuple]:
        _, shard, first_inputs, first_bytes, open_inputs, open_bytes, begun = row
        head, before, opened = 0, state["begun"], state["open"]
        for item in zip(map(int, first_inputs), map(int, first_bytes), strict=True):
            after, fresh = _packed(opened, item, max_inputs, max_bytes)
            if fresh:
                break
            opened, head = after, head + 1
        if head < len(begun):
            opened = int(open_inputs[head]), int(open_bytes[head])
            state["begun"] += int(begun[head])
        state["open"] = opened
        return [(shard, head, before)]

    heads = ordered_fold(
        linked.select(F.lit(0).alias("run"), "shard", *lists),
        ["run"],
        ["shard"],
        lambda: {"open": (0, 0), "begun": 0},
        follow,
        "shard bigint, head bigint, before bigint",
    )

    def step(state: dict, row: tuple) -> list[tuple]:
        _, seq, question_id, inputs, size, head, before = row
        if state["at"] < head:
            batch = before - 1
        else:
            state["open"], fresh = _packed(state["open"], (inputs, size), max_inputs, max_bytes)
            state["begun"] += fresh
            batch = before + state["begun"] - 1
        state["at"] += 1
        return [(seq, question_id, inputs, size, batch)]

    return ordered_fold(
        narrow.join(heads, "shard"),
        ["shard"],
        ["seq"],
        lambda: {"open": (0, 0), "begun": 0, "at": 0},
        step,
        "seq bigint, question_id string, n_inputs bigint, n_bytes bigint, batch bigint",
    )


def budget_check(batches: DataFrame, max_calls: int, max_bytes: int) -> DataFrame:
    """(calls, bytes, fits) of planned batches."""
    return batches.agg(
        F.count_distinct("batch").alias("calls"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")
    ).withColumn("fits", (F.col("calls") <= max_calls) & (F.col("bytes") <= max_bytes))


def first_overflow(requests: DataFrame, keys: list[str], chunk: Column, order: list, max_calls: int, max_bytes: int) -> DataFrame:
    """Adds running ``calls`` and ``bytes`` and whether the request passes a budget that stops at its first overflow."""
    summed = running(requests, keys, chunk, order, sums={"calls": F.lit(1), "bytes": F.col("n_bytes")})
    return summed.withColumn("accepted", (F.col("calls") <= max_calls) & (F.col("bytes") <= max_bytes))


def budget_replay(requests: DataFrame, keys: list[str], order: list[str], max_calls: int, max_bytes: int) -> DataFrame:
    """Replays reservations in order: a refused one changes nothing, a later smaller one may pass.

    ``requests``: key columns, order columns, request_id, n_bytes. A run accepts at most ``max_calls`` requests, so
    it is replayed in as many rounds at most: the next request accepted is the first after the last one that still
    fits, a minimum over all requests of the run, wherever they are stored. No task holds a run or reads it in order.
    """
    place = F.struct(*order, "request_id")
    marks = [f"_k{i}" for i in range(len(keys))]
    rows = materialised(requests.select(*[F.col(k).alias(m) for k, m in zip(keys, marks, strict=True)], place.alias("_at"), "request_id", "n_bytes"))

    steps, left = None, rows.withColumn("_used", F.lit(0).cast("long"))
    for call in range(1, max_calls + 1):
        fitting = left.where(F.col("_used") + F.col("n_bytes") <= max_bytes)
        first = fitting.groupBy(*marks).agg(F.min(F.struct("_at", (F.col("_used") + F.col("n_bytes")).alias("bytes"))).alias("x"))
        taken = counted_side(first.select(*marks, F.col("x._at").alias("_last"), F.lit(call).cast("long").alias("calls"), F.col("x.bytes").alias("bytes")), 96)
        if taken.isEmpty():
            break
        steps = taken if steps is None else steps.unionByName(taken)
        left = _after(rows, taken, marks)
    if steps is None:
        return rows.select("request_id", F.lit(False).alias("accepted"), F.lit(0).cast("long").alias("used_calls"), F.lit(0).cast("long").alias("used_bytes"))
    # At most ``max_calls`` acceptances a run.
    accepted = steps.groupBy(*marks).agg(F.array_sort(F.collect_list(F.struct("_last", "calls", "bytes"))).alias("_taken"))
    told = _beside(rows, accepted, marks, "left")
    until = F.filter(F.coalesce("_taken", F.array().cast(accepted.schema["_taken"].dataType)), lambda x: x["_last"] <= F.col("_at"))
    now = F.when(F.size(until) > 0, F.element_at(until, -1))
    return told.select(
        "request_id",
        F.coalesce(now["_last"] == F.col("_at"), F.lit(False)).alias("accepted"),
        F.coalesce(now["calls"], F.lit(0).cast("long")).alias("used_calls"),
        F.coalesce(now["bytes"], F.lit(0).cast("long")).alias("used_bytes"),
    )


def _beside(rows: DataFrame, states: DataFrame, marks: list[str], how: str = "inner") -> DataFrame:
    """Each row with the state of its run; a null key is one like any other."""
    other = states.select(*[F.col(m).alias(f"_s{m}") for m in marks], *[c for c in states.columns if c not in marks])
    same = reduce(and_, [F.col(m).eqNullSafe(F.col(f"_s{m}")) for m in marks], F.lit(True))
    return rows.join(other, same, how).drop(*[f"_s{m}" for m in marks])


def _after(rows: DataFrame, taken: DataFrame, marks: list[str]) -> DataFrame:
    """The requests after the last accepted one of their run, with the bytes used until then."""
    return _beside(rows, taken.withColumnRenamed("bytes", "_used"), marks).where(F.col("_at") > F.col("_last")).drop("_last", "calls")


def activation_checks(
    versions: DataFrame, members: DataFrame, passage_store: DataFrame, expected: DataFrame
) -> DataFrame:
    """One row per version to activate: counts, each check and the verdict.

    ``expected``: version_id, passage_count. The verdict is the first failing
    check, or 'ok'.
    """
    asked = counted_side(
        versions.join(expected, "version_id").select("version_id", "count", "index_config", "passage_count"), 256
    )
    own = members.join(asked.select("version_id"), "version_id", "left_semi")
    n_members = own.groupBy("version_id").agg(F.count("*").alias("n_members"))
    model = F.split_part("index_config", F.lit(";"), F.lit(2))
    declared = F.when(F.col("index_config").isNotNull() & (model != NO_EMBEDDINGS), model)
    # Passages are reduced per content before they meet the members.
    per_content = passage_store.groupBy("content_hash").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("embedding").isNull()).alias("without_vector"),
        F.collect_set(F.coalesce("embedding_model", F.lit(""))).alias("models"),
    )
    joined = (
        own.join(per_content, "content_hash", "left")
        .join(asked.select("version_id", declared.alias("model")), "version_id")
    )
    wrong_model = F.exists("models", lambda m: m != F.coalesce("model", F.lit("")))
    facts = joined.groupBy("version_id").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_passages"),
        F.count_if(F.col("n").isNull()).alias("without_passage"),
        F.array_size(F.array_distinct(F.flatten(F.collect_set("models")))).alias("n_models"),
        F.count_if(wrong_model | (F.col("model").isNotNull() & (F.col("without_vector") > 0))).alias("mismatched"),
    )
    checked = (
        asked.join(n_members, "version_id", "left").join(facts, "version_id", "left").na.fill(
            0, ["n_members", "n_passages", "without_passage", "n_models", "mismatched"]
        )
    )
    complete = (
        (F.col("n_members") == F.col("count"))
        & (F.col("n_passages") == F.col("passage_count"))
        & (F.col("passage_count") >= F.col("count"))
    )
    return checked.select(
        "version_id",
        "n_members",
        "n_passages",
        "without_passage",
        "n_models",
        "mismatched",
        F.when(~complete, "Incomplete corpus")
        .when(F.col("without_passage") > 0, "Question without passage")
        .when(F.col("index_config").isNull() & (F.col("n_models") > 1), "Mixed embedding models")
        .when(F.col("index_config").isNotNull() & (F.col("mismatched") > 0), "Embedding model mismatch")
        .otherwise("ok")
        .alias("verdict"),
    )


def activated(versions: DataFrame, checks: DataFrame, version_id: str, now: Column) -> DataFrame:
    """The versions after activating one: unchanged unless its checks passed."""
    passed = checks.where((F.col("version_id") == version_id) & (F.col("verdict") == "ok")).select(F.lit(True).alias("_go"))
    go = F.coalesce(passed.limit(1).scalar(), F.lit(False))
    chosen = F.col("version_id") == version_id
    return versions.withColumns(
        {
            "active": F.when(go, chosen).otherwise(F.col("active")),
            "activated_at": F.when(go & chosen, now).otherwise(F.col("activated_at")),
        }
    )


def retention(versions: DataFrame, keep: int, now: Column) -> DataFrame:
    """Adds ``kept``: active, of unknown activation, under an hour old, or among the newest activated."""
    former = ~F.col("active") & ~F.col("activation_unknown") & F.col("activated_at").isNotNull()
    newest = versions.where(former).orderBy(F.desc("activated_at"), F.desc("version_id")).limit(keep).select(
        "version_id", F.lit(True).alias("_newest")
    )
    flagged = versions.join(F.broadcast(newest), "version_id", "left")
    return flagged.withColumn(
        "kept",
        F.col("active")
        | F.col("activation_unknown")
        | (F.col("created_at") >= now - F.expr(HOUR))
        | F.coalesce("_newest", F.lit(False)),
    ).drop("_newest")


def removable_contents(doc_store: DataFrame, members: DataFrame, kept: DataFrame, now: Column) -> DataFrame:
    """Contents over an hour old that no kept version refers to."""
    referred = members.join(counted_side(kept.where("kept").select("version_id"), 64), "version_id", "left_semi")
    return doc_store.where(F.col("created_at") < now - F.expr(HOUR)).join(
        referred.select("content_hash"), "content_hash", "left_anti"
    )


def retention_summary(flagged: DataFrame, keep: int) -> DataFrame:
    """One row: the counts and the sentence describing a retention run."""
    inactive = flagged.where(~F.col("active"))
    counts = inactive.agg(
        F.count_if(~F.col("kept")).alias("removed"),
        F.count_if(F.col("kept") & F.col("activation_unknown")).alias("unknown"),
        F.count_if(F.col("kept") & ~F.col("activation_unknown") & F.col("activated_at").isNotNull()).alias("rollback"),
        F.count_if(F.col("kept") & ~F.col("activation_unknown") & F.col("activated_at").isNull()).alias("recent"),
    )

    def counted(name: str, one: str, many: str) -> Column:
        return F.concat_ws(" ", F.col(name).cast("string"), F.when(F.col(name) > 1, many).otherwise(one))

    kept = F.concat_ws(
        ", ",
        F.concat(
            counted("rollback", "version", "versions"),
            F.lit(f" pour retour arrière (cible : {keep}, hors versions récentes protégées)"),
        ),
        F.when(
            F.col("unknown") > 0,
            F.concat(
                counted("unknown", "version antérieure", "versions antérieures"),
                F.lit(" à la migration, jamais supprimée(s)"),
            ),
        ),
        F.when(F.col("recent") > 0, counted("recent", "import récent non activé", "imports récents non activés")),
    )
    sentence = F.concat(
        F.lit("Rétention : "),
        counted("removed", "version supprimée", "versions supprimées"),
        F.lit(" ; conservé : "),
        kept,
        F.lit("."),
    )
    return counts.withColumn("summary", sentence)


def version_weights(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(version_id, records, bytes, own_bytes): own contents are those of a single version.

    ``sizes``: content_hash, bytes.
    """
    sharing = members.groupBy("content_hash").agg(F.count_distinct("version_id").alias("n_versions"))
    per_content = sharing.join(sizes, "content_hash", "left")
    return (
        members.join(per_content, "content_hash")
        .groupBy("version_id")
        .agg(
            F.count("*").alias("records"),
            F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
            F.coalesce(F.sum(F.when(F.col("n_versions") == 1, F.col("bytes"))), F.lit(0)).alias("own_bytes"),
        )
    )


def corpus_info(versions: DataFrame, members: DataFrame, doc_store: DataFrame) -> DataFrame:
    """Figures of the active version: count, answered records, most recent date."""
    active = counted_side(versions.where("active"), 512)
    documents = members.join(active.select("version_id"), "version_id", "left_semi").join(
        doc_store, "content_hash"
    )
    facts = documents.groupBy("version_id").agg(
        F.count_if(present(F.col("reponse"))).alias("answer_count"),
        F.max(latest_date(*(F.col(c) for c in ("date_reception", "date_publication", "date_reponse")))).alias(
            "latest_document"
        ),
    )
    return active.select("version_id", "count", "extracted_at", "method").join(facts, "version_id", "left")


def version_documents(members: DataFrame, doc_store: DataFrame, version_id: str) -> DataFrame:
    """Documents of one version, to be ordered by id on export."""
    own = members.where(F.col("version_id") == version_id).select("question_id", "content_hash")
    return own.join(doc_store.drop("question_id"), "content_hash").drop("content_hash")


def reusable(members: DataFrame, passage_store: DataFrame, wanted: DataFrame, source: str, model: str) -> DataFrame:
    """Requested (question_id, content_hash) that a version holds with every passage embedded by the model."""
    bad = passage_store.where(
        F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model))
    ).select("content_hash")
    return (
        members.where(F.col("version_id") == source)
        .select("question_id", "content_hash")
        .join(wanted, ["question_id", "content_hash"], "left_semi")
        .join(bad, "content_hash", "left_anti")
    )


def rewritten_contents(before: DataFrame, after: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Keys present in both snapshots of a store whose content differs: stored rows never change."""
    digest = F.xxhash64(value)
    old = before.select(*keys, digest.alias("_old"))
    new = after.select(*keys, digest.alias("_new"))
    return old.join(new, keys).where(F.col("_old") != F.col("_new")).select(*keys)


def applied_version(applied: DataFrame, expected: int) -> DataFrame:
    """(current, expected, missing, up_to_date) from the table of applied schema versions."""
    spark = applied.sparkSession
    numbers = spark.range(1, expected + 1).select(F.col("id").cast("int").alias("version"))
    gaps = numbers.join(applied.select("version"), "version", "left_anti").agg(
        F.array_join(F.array_sort(F.collect_list("version")), ",").alias("missing")
    )
    current = applied.agg(F.max("version").alias("v")).scalar()
    return gaps.select(
        current.alias("current"), F.lit(expected).alias("expected"), "missing", (current == expected).alias("up_to_date")
    )


def integrity(versions: DataFrame, members: DataFrame, doc_store: DataFrame, passage_store: DataFrame) -> DataFrame:
    """(rule, violations): keys, references, allowed values and the single active version."""

    def duplicates(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("violations"))

    def orphans(df: DataFrame, parent: DataFrame, key: str) -> DataFrame:
        return df.join(parent.select(key), key, "left_anti").agg(F.count("*").alias("violations"))

    rules = {
        "versions primary key": duplicates(versions, "version_id"),
        "members primary key": duplicates(members, "version_id", "question_id"),
        "documents primary key": duplicates(doc_store, "content_hash"),
        "passages primary key": duplicates(passage_store, "content_hash", "passage_id"),
        "members refer to versions": orphans(members, versions, "version_id"),
        "members refer to documents": orphans(members, doc_store, "content_hash"),
        "passages refer to documents": orphans(passage_store, doc_store, "content_hash"),
        "section values": passage_store.agg(F.count_if(~F.col("section").isin(*SECTIONS)).alias("violations")),
        "positive counts": versions.agg(F.count_if(F.col("count") <= 0).alias("violations")),
        "one active version": versions.agg(F.abs(F.count_if("active") - 1).alias("violations")),
    }
    parts = [df.select(F.lit(name).alias("rule"), "violations") for name, df in rules.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
