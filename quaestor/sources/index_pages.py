"""The official index and record pages: positional rows and HTML to typed records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaestor.fixed_values import WRITTEN_QUESTION_ASSEMBLY, WRITTEN_QUESTION_TYPE
from quaestor.functions.html import INNER_SPACE, LINE_ENDS, html_text, tidy_lines, unescape, without_tags
from quaestor.functions.records import parse_day
from quaestor.functions.text import SPACE
from quaestor.sources.envelopes import array_elements

# Positions in an index row.
ASSEMBLY, LINK, RECEIVED, KIND, TITLE_FR, TITLE_NL, AUTHOR, RECIPIENT, TYPE = 0, 2, 5, 6, 8, 9, 10, 11, 15

CODE_PATTERN = r"moncode=(\d+)"
LABEL = r"\s*(?:&nbsp;|\s)*</b>\s*(?:</td>)?\s*<td[^>]*>(.*?)</td>"
QUESTION_CELL = rf"(?s)<td[^>]*>\s*<b>Question{LABEL}"
ANSWER_CELL = rf"(?s)<td[^>]*>\s*<b>R(?:é|&eacute;)ponse{LABEL}"
# In a text whose lines are not tidied yet.
NUMBER_PATTERN = rf"question{INNER_SPACE}+n°[{SPACE}{LINE_ENDS}]*(\d+)"
PDF_LINK = r"""(?s)<a[^>]+href=['"]([^'"]*\.pdf[^'"]*)['"][^>]*>.*?</a>"""
TABLE_ROW = r"(?s)<tr>(.*?)</tr>"
TABLE_CELL = r"(?s)<td[^>]*>(.*?)</td>"
ACT_CELLS = 5


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(row array<string>) of index files ``{"data": [[...], ...]}``, each read in byte ranges."""
    return array_elements(spark, path, "[", "array<string>").select(F.col("value").alias("row"))


def code_of(link: Column) -> Column:
    return F.regexp_extract(link, CODE_PATTERN, 1)


def index_rows(raw: DataFrame) -> DataFrame:
    """Usable rows of the index: written questions with a valid reception date."""

    def at(position: int) -> Column:
        return F.get("row", position)

    return raw.where((at(ASSEMBLY) == WRITTEN_QUESTION_ASSEMBLY) & (at(TYPE) == WRITTEN_QUESTION_TYPE)).select(
        code_of(at(LINK)).alias("moncode"),
        parse_day(at(RECEIVED)).alias("date_reception"),
        unescape(at(TITLE_FR)).alias("titre"),
        unescape(at(TITLE_NL)).alias("titre_nl"),
        unescape(at(AUTHOR)).alias("auteur"),
        unescape(at(RECIPIENT)).alias("destinataire"),
    ).where(F.col("date_reception").isNotNull())


def most_recent_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("date_reception"), F.desc(F.col("moncode").cast("bigint")))


def sample_per_author(rows: DataFrame, until: str, size: int = 10) -> DataFrame:
    """The latest row of each author received by ``until``; the ``size`` most recent ones."""
    latest = W.partitionBy("auteur").orderBy(F.desc("date_reception"), F.desc(F.col("moncode").cast("bigint")))
    first = rows.where(F.col("date_reception") <= F.lit(until).cast("date")).withColumn(
        "_rank", F.row_number().over(latest)
    ).where(F.col("_rank") == 1)
    return most_recent_first(first.drop("_rank")).limit(size)


def index_statistics(raw: DataFrame) -> DataFrame:
    """(statistic, value, rows): rows of the whole index by assembly and by kind, and written questions."""
    counted = raw.groupBy(
        F.get("row", ASSEMBLY).alias("assembly"), F.get("row", KIND).alias("kind"), F.get("row", TYPE).alias("type")
    ).agg(F.count("*").alias("n"))
    written = (F.col("assembly") == WRITTEN_QUESTION_ASSEMBLY) & (F.col("type") == WRITTEN_QUESTION_TYPE)
    labelled = F.explode(
        F.array(
            F.struct(F.lit("assembly").alias("statistic"), F.col("assembly").alias("value")),
            F.struct(F.lit("kind").alias("statistic"), F.col("kind").alias("value")),
            F.struct(F.lit("written questions").alias("statistic"), F.when(written, F.col("assembly")).alias("value")),
        )
    )
    parts = counted.select("n", labelled.alias("s")).where(F.col("s.value").isNotNull())
    return parts.groupBy("s.statistic", "s.value").agg(F.sum("n").alias("rows"))


@dataclass(frozen=True)
class PageLayout:
    """What the collected site calls things; the deployment supplies it."""

    section_id: str
    url_prefix: str = ""
    url_suffix: str = ""
    id_prefix: str = "PRB-1-"


def parse_pages(pages: DataFrame, layout: PageLayout) -> DataFrame:
    """Adds the parsed fields of each page (moncode, html) and ``reject_reason``.

    A page is rejected, with its reason, when its structure is unknown, when it
    has no question block, or when the question is empty.
    """
    section = F.regexp_extract("html", rf'(?s)<section id="{layout.section_id}".*?</section>', 0)
    located = pages.withColumn("_section", F.regexp_replace(section, "(?s)<!--.*?-->", ""))
    body = F.col("_section")

    def last_cell(pattern: str) -> Column:
        return F.coalesce(F.try_element_at(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), F.lit(-1)), F.lit(""))

    # In steps: what several columns of one step refer to is computed once, in the step before.
    stripped = located.select(
        *pages.columns,
        "_section",
        body.rlike(QUESTION_CELL).alias("_has_question"),
        # Of several cells with a label the last one counts.
        without_tags(last_cell(QUESTION_CELL)).alias("_question"),
        without_tags(last_cell(ANSWER_CELL)).alias("_answer"),
        without_tags(body).alias("_text"),
    )
    decoded = stripped.select(
        *pages.columns,
        (body != "").alias("_known"),
        "_has_question",
        unescape(body).alias("_readable"),
        tidy_lines(unescape(F.col("_question"))).alias("_question"),
        tidy_lines(unescape(F.col("_answer"))).alias("_answer"),
        F.regexp_extract(unescape(F.col("_text")), NUMBER_PATTERN, 1).alias("_number"),
    )
    labels = {"session": "Session", "date_publication": "Date de publication", "date_reponse": "Date de réponse"}
    fields = {f"_{name}": F.trim(F.regexp_extract("_readable", rf"{label}:</b>\s*([^<]+)", 1)) for name, label in labels.items()}

    def field(name: str) -> Column:
        return F.when(F.col(f"_{name}") != "", F.col(f"_{name}"))

    parsed = decoded.withColumns(fields).select(
        *pages.columns,
        F.concat(F.lit(layout.id_prefix), F.col("moncode")).alias("id"),
        F.concat(F.lit(layout.url_prefix), F.col("moncode"), F.lit(layout.url_suffix)).alias("url_source"),
        field("session").alias("session"),
        F.when(F.col("_number") != "", F.col("_number").cast("int")).alias("numero"),
        parse_day(field("date_publication")).alias("date_publication"),
        parse_day(field("date_reponse")).alias("date_reponse"),
        F.when(F.col("_has_question"), F.col("_question")).alias("question"),
        F.when(F.col("_answer") != "", F.col("_answer")).alias("reponse"),
        F.sha2("html", 256).alias("empreinte_contenu"),
        "_known",
    )
    reason = (
        F.when(~F.col("_known"), "unknown_structure")
        .when(F.col("question").isNull(), "question_block_missing")
        .when(F.col("question") == "", "question_text_empty")
    )
    return parsed.withColumn("reject_reason", reason).drop("_known")


def pdf_links(markup: Column) -> Column:
    """Distinct links to PDF files, in page order."""
    return F.array_distinct(F.regexp_extract_all(markup, F.lit(PDF_LINK), F.lit(1)))


def procedural_acts(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, position, date, acte, acteur): table rows of five cells that start with a date."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(markup, F.lit(TABLE_ROW), F.lit(1))).alias("position", "_row"))
    cells = rows.select(key, "position", F.regexp_extract_all("_row", F.lit(TABLE_CELL), F.lit(1)).alias("_cells")).where(
        F.size("_cells") == ACT_CELLS
    )
    named = cells.select(
        key,
        "position",
        parse_day(html_text(F.get("_cells", 0))).alias("date"),
        html_text(F.get("_cells", 1)).alias("acte"),
        html_text(F.get("_cells", 2)).alias("acteur"),
    )
    return named.where(F.col("date").isNotNull()).withColumn("acteur", F.nullif("acteur", F.lit("")))


def fidelity(records: DataFrame, pages: DataFrame) -> DataFrame:
    """(question_id, question_found, answer_found, complete): every stored text occurs in its source page."""

    def flat(text: Column) -> Column:
        return F.trim(F.regexp_replace(text, r"\s+", " "))

    source = pages.select("moncode", flat(html_text(F.col("html"))).alias("_page"))
    return records.join(source, "moncode").select(
        "question_id",
        F.contains("_page", flat(F.col("question"))).alias("question_found"),
        F.coalesce(F.contains("_page", flat(F.col("reponse"))), F.lit(True)).alias("answer_found"),
        (F.col("reponse").isNotNull() & F.col("date_reponse").isNotNull()).alias("complete"),
    )
