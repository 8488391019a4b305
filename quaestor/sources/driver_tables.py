"""The test tables read as the entities the jobs work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions.records import present
from quaestor.operators.sizing import hot_join, small_side


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of long texts. One stored in fewer files than there are cores is spread over them."""
    rows = table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _title(first_line: Column) -> Column:
    sentence = F.trim(F.substring_index(first_line, ".", 1))
    return F.when(sentence == "", first_line).otherwise(sentence)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as records: the first line asks, the other lines answer."""
    first = F.substring_index("text", "\n", 1)
    rest = F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)")
    return text_table(spark, folder, "documents").select(
        "doc_id",
        F.concat(F.lit("D-"), F.col("doc_id")).alias("question_id"),
        F.col("doc_id").cast("string").alias("moncode"),
        _title(first).alias("titre"),
        F.col("lang").alias("auteur"),
        F.col("source").alias("destinataire"),
        first.alias("question"),
        F.when(present(rest), rest).alias("reponse"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(700)).cast("int")).alias("date_reception"),
        F.when(
            present(rest), F.date_add(F.lit("2024-02-10").cast("date"), F.pmod("doc_id", F.lit(700)).cast("int"))
        ).alias("date_reponse"),
        F.concat(F.lit("http://records.example.org/detail?code="), F.col("doc_id")).alias("url_source"),
    )


def queries(spark: SparkSession, folder: str, limit: int = 6) -> DataFrame:
    """Benchmark items as queries."""
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), "text", F.lit(limit).alias("limit")
    )


def record_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as vectors of the first answer passage of the record of the same number."""
    return table(spark, folder, "embeddings").select(
        F.concat(F.lit("D-"), F.col("vec_id")).alias("question_id"),
        F.concat(F.lit("D-"), F.col("vec_id"), F.lit(":reponse:0")).alias("passage_id"),
        "embedding",
    )


def query_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """A query's vector is the embedding of the same number."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


# --- Derived inputs -----------------------------------------------------------
#
# The tables hold no index, no versions and no usage log: the inputs below are
# computed from whole tables, row by row.

TODAY = "2001-08-10"
NOW = "2024-06-01 12:00:00"
RECORD_HOSTS = ("records.example.org",)


def index_file_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as positional index rows (row array<string>)."""
    day = F.col("o_orderdate")
    received = (
        F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("31/02/"), F.year(day).cast("string")))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "")
        .otherwise(F.date_format(day, "dd/MM/yyyy"))
    )
    customer = F.col("o_custkey").cast("string")
    cells = {
        0: F.when(F.col("o_orderstatus").isin("O", "F"), "PRB").otherwise("COCOM"),
        2: F.concat(F.lit('<a href="/detail/?moncode='), F.col("o_orderkey").cast("string"), F.lit('&base=1">fiche</a>')),
        5: received,
        6: F.concat(F.lit("Genre "), "o_orderstatus"),
        8: F.concat(F.lit("Question écrite concernant le dossier "), customer, F.lit(" &amp; suites")),
        9: F.concat(F.lit("Vraag over dossier "), customer),
        10: F.concat(F.lit("Auteur "), F.pmod("o_custkey", F.lit(97)).cast("string")),
        11: F.lit("Ministre"),
        15: F.when(F.col("o_totalprice") > 400000, "2").otherwise("1"),
    }
    row = F.array(*[cells.get(i, F.lit("")) for i in range(16)])
    return table(spark, folder, "orders").select(row.alias("row"))


def current_records(spark: SparkSession, folder: str) -> DataFrame:
    """Orders that are not urgent as records of the current corpus."""
    answered = F.col("o_orderstatus") != "O"
    return table(spark, folder, "orders").where(F.col("o_orderpriority") != "1-URGENT").select(
        F.col("o_orderkey").cast("string").alias("moncode"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None))
        .when(F.year("o_orderdate") < 1999, "1994-1999")
        .otherwise("1999-2004")
        .alias("legislature"),
        F.to_date("o_orderdate").alias("date_reception"),
        F.when(F.col("o_orderstatus") == "F", F.date_add(F.to_date("o_orderdate"), 30)).alias("date_publication"),
        F.when(answered, F.date_add(F.to_date("o_orderdate"), 90)).alias("date_reponse"),
        F.when(answered, "Texte de la réponse").alias("reponse"),
    )


def record_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(moncode, html): record pages written from documents, and raw pages of another structure."""
    source = records(spark, folder)

    def escaped(text: Column) -> Column:
        return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("<br>"))

    question = F.when(F.col("auteur") == "es", "").otherwise(escaped(F.col("question")))
    row = F.when(
        F.col("auteur") == "de", ""
    ).otherwise(F.concat(F.lit("<tr><td><b>Question&nbsp;</b></td><td>"), question, F.lit("</td></tr>")))
    answer = F.when(
        F.col("reponse").isNotNull(),
        F.concat(F.lit("<tr><td><b>R&eacute;ponse</b></td><td><p>"), escaped(F.col("reponse")), F.lit("</p></td></tr>")),
    ).otherwise("")
    html = F.concat(
        F.lit('<html><section id="record-fr"><!-- <b>Session:</b> non --><b>Session:</b> 2023-2024<br><b>Date de publication:</b> '),
        F.date_format("date_reception", "dd/MM/yyyy"),
        F.lit("<br><p>question n° "),
        F.col("moncode"),
        F.lit('</p><a href="/doc/'),
        F.col("moncode"),
        F.lit('.pdf">annexe</a><table>'),
        row,
        answer,
        F.lit("</table></section></html>"),
    )
    other = text_table(spark, folder, "pages").select(
        F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("moncode"), "html"
    )
    return source.select("moncode", html.alias("html")).unionByName(other)


VERSION_VARIANTS = ("v1", "v2", "v3", "v4", "v5")


def version_members(spark: SparkSession, folder: str) -> DataFrame:
    """(version_id, question_id, content_hash, ...) of five versions of the documents.

    v1 and v3 hold contents without vectors, v2 mixes models, v4 only embedded
    contents, v5 some contents that were never stored.
    """
    base = stored_records(spark, folder)
    variant = (
        F.when(F.col("version_id").isin("v1", "v3"), "0")
        .when((F.col("version_id") == "v2") & (F.col("auteur") == "fr"), "0")
        .when((F.col("version_id") == "v5") & (F.col("destinataire") == "src3"), "X")
        .when(F.col("version_id") == "v5", "0")
        .otherwise("A")
    )
    return base.select("*", F.explode(F.array(*[F.lit(v) for v in VERSION_VARIANTS])).alias("version_id")).select(
        "version_id", "question_id", F.concat_ws(":", variant, "digest").alias("content_hash")
    )


def stored_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records with the digest of their content."""
    content = F.concat_ws("\n", "question_id", "question", F.coalesce("reponse", F.lit("")))
    return records(spark, folder).withColumn("digest", F.sha2(content, 256))


def doc_store(spark: SparkSession, folder: str) -> DataFrame:
    """Documents stored twice: without vectors ('0') and embedded ('A')."""
    created = F.when(F.col("auteur") == "es", F.lit("2024-06-01 11:30:00")).otherwise(F.lit("2024-05-01 08:00:00"))
    return stored_records(spark, folder).select(
        "*", F.explode(F.array(F.lit("0"), F.lit("A"))).alias("variant")
    ).select(
        F.concat_ws(":", "variant", "digest").alias("content_hash"),
        "question_id",
        created.cast("timestamp").alias("created_at"),
        "titre",
        "reponse",
        "date_reception",
        F.lit(None).cast("date").alias("date_publication"),
        "date_reponse",
    )


def passage_store(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of the stored documents; those of the embedded variant carry the vectors there are."""
    from quaestor.operators.passages import passages

    parts = passages(stored_records(spark, folder), "digest")
    vectors = record_vectors(spark, folder).select("passage_id", F.col("embedding").alias("vector"))
    both = parts.join(vectors, "passage_id", "left").select(
        "*", F.explode(F.array(F.lit("0"), F.lit("A"))).alias("variant")
    )
    embedded = F.col("variant") == "A"
    return both.select(
        F.concat_ws(":", "variant", "digest").alias("content_hash"),
        "passage_id",
        "question_id",
        "section",
        "position",
        "content",
        F.when(embedded, F.col("vector")).alias("embedding"),
        F.when(embedded, F.lit("m-A")).alias("embedding_model"),
    )


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """The five versions with the counts of their members."""
    name = F.col("version_id")

    def by_version(values: dict[str, str | None], default: str | None = None) -> Column:
        column = F.lit(default)
        for version, value in values.items():
            column = F.when(name == version, F.lit(value)).otherwise(column)
        return column

    return version_members(spark, folder).groupBy("version_id").agg(F.count("*").cast("int").alias("count")).select(
        "version_id",
        (name == "v1").alias("active"),
        "count",
        F.lit("2024-05-31 00:00:00").cast("timestamp").alias("extracted_at"),
        F.concat(F.lit("méthode "), name).alias("method"),
        by_version({"v5": "2024-06-01 11:40:00"}, "2024-05-01 00:00:00").cast("timestamp").alias("created_at"),
        by_version({"v1": "2024-05-30 00:00:00", "v2": "2024-05-20 00:00:00", "v3": "2024-05-10 00:00:00"})
        .cast("timestamp")
        .alias("activated_at"),
        F.lit(False).alias("activation_unknown"),
        by_version(
            {"v1": "passages-1;sans-embeddings;64", "v3": "passages-1;sans-embeddings;64", "v4": "passages-1;m-A;64", "v5": "passages-1;sans-embeddings;64"}
        ).alias("index_config"),
    )


def usage_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as quota requests: an error gives back the previous request of the same user."""
    from pyspark.sql import Window as W

    before = W.partitionBy("user_id").orderBy("ts", "event_id")
    error = F.col("event_type") == "error"
    previous = F.lag(F.struct("ts", "event_id", "event_type")).over(before)
    released = error & previous.isNotNull() & (previous["event_type"] != "error")
    return (
        table(spark, folder, "events")
        .withColumn("_previous", previous)
        .select(
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("user_id").cast("string").alias("session"),
            F.pmod("user_id", F.lit(20)).cast("string").alias("ip"),
            F.when(released, F.col("_previous.event_type") == "purchase")
            .otherwise(F.col("event_type") == "purchase")
            .alias("paid"),
            F.when(released, "release").otherwise("reserve").alias("kind"),
            F.when(released, F.col("_previous.ts").cast("timestamp")).alias("reserved_at"),
            F.when(released, F.col("_previous.event_id")).alias("reservation_id"),
        )
    )


def expected_records(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, question_id): records whose document contains the benchmark passage.

    The longest inner word of a passage of three words or more stands alone in any document that
    contains it: documents meet such passages on that word, without their texts, and only the
    texts of pairs are compared. Shorter passages are compared with every document.
    """
    inner = F.expr("slice(split(trim(text), '\\\\s+'), 2, greatest(size(split(trim(text), '\\\\s+')) - 2, 0))")
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    asked = table(spark, folder, "benchmark").where(F.col("text").isNotNull()).select(
        F.col("item_id").alias("query_id"), F.col("text").alias("passage"), F.when(F.size(inner) > 0, longest).alias("word")
    )
    n_asked, size = asked.agg(F.count("*"), F.coalesce(F.max(F.octet_length("passage")), F.lit(0))).first()
    documents = text_table(spark, folder, "documents").select("doc_id", "text")
    words = documents.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    long = asked.where(F.col("word").isNotNull())
    pairs = hot_join(words, long.select("query_id", "word"), ["word"], "doc_id", n_asked, 128).select("query_id", "doc_id")
    met = documents.join(pairs, "doc_id").join(small_side(long.select("query_id", "passage"), n_asked, 32 + size), "query_id")
    short = small_side(asked.where(F.col("word").isNull()).select("query_id", "passage"), n_asked, 32 + size)
    contained = F.contains("text", F.col("passage"))
    found = met.where(contained).select("query_id", "doc_id").unionByName(documents.join(short, contained).select("query_id", "doc_id"))
    return found.select("query_id", F.concat(F.lit("D-"), F.col("doc_id")).alias("question_id")).distinct()
