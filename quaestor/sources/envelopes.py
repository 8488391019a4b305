"""Envelopes: JSON files of one object around one long array, read in byte ranges by as many tasks as the file has.

A file is cut at the character that closes an element, wherever it stands, which Spark's text source does within any
range of bytes. Whether such a character closed an element or belongs to a string follows from the number of quotes
before it: counted in each range, summed over the ranges of a file (one row a range), then within a range. Pieces of a
string that holds the character are joined again; all others are elements as they are.

The array's elements are arrays or objects without arrays or objects inside; no other value of the object is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CLOSING = {"[": "]", "{": "}"}
#: A JSON string. Possessive, so that long texts need no stack.
STRING = r'"(?:[^"\\]++|\\.)*+"'

RANGE = ("file", "start")
#: Tasks that the ranges are ordered in, for each task that reads them: files may be far smaller than what one task reads.
TASKS_PER_SCAN = 4


def _count(text: Column, character: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))).cast("long")


def pieces(spark: SparkSession, path: str, opening: str) -> DataFrame:
    """(file, element, piece, opened): what stands between closing characters; pieces of one element share its number.

    ``opened`` is null for a piece that is an element of its own, else its place among those to be joined.
    """
    raw = spark.read.option("lineSep", CLOSING[opening]).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("piece"),
    )
    # As many tasks as there is text for, whatever the session's partitions: a task orders the ranges it has.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_SCAN * raw.rdd.getNumPartitions())
    counted = raw.withColumn("quotes", _count(F.regexp_replace("piece", r"(?s)\\.", ""), '"')).repartition(tasks, *RANGE)
    earlier = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    so_far = W.partitionBy(*RANGE).orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*RANGE).orderBy("place").rowsBetween(W.unboundedPreceding, -1)

    def sums(rows: DataFrame, value: str, name: str) -> DataFrame:
        """What the ranges before each one hold."""
        ranges = rows.groupBy(*RANGE).agg(F.sum(value).alias(name))
        return ranges.select(*RANGE, F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name))

    running = counted.join(sums(counted, "quotes", "quotes_before"), [*RANGE])
    odd = (F.col("quotes_before") + F.sum("quotes").over(so_far)) % 2 == 1
    marked = running.withColumn("inside", odd).withColumn("ended", F.when(F.col("inside"), 0).otherwise(1))
    numbered = marked.join(sums(marked, "ended", "ended_before"), [*RANGE])
    number = F.col("ended_before") + F.coalesce(F.sum("ended").over(before), F.lit(0))
    whole = ~F.col("inside") & (F.col("quotes") % 2 == 0)
    # A piece with an even number of quotes that ends outside a string began outside of one too.
    return numbered.select("file", number.alias("element"), "piece", F.when(~whole, F.struct("start", "place")).alias("opened"))


def elements(spark: SparkSession, path: str, opening: str) -> DataFrame:
    """(file, element, head, body): each element as JSON without its closing character in ``body``, null for what is none.

    ``head`` holds what surrounds the array: the object up to its first element, and from the array's end on.
    """
    parts = pieces(spark, path, opening)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("opened", "piece"))), lambda x: x["piece"])
    joined = parts.where(F.col("opened").isNotNull()).groupBy("file", "element").agg(F.array_join(ordered, CLOSING[opening]).alias("piece"))
    whole = parts.where(F.col("opened").isNull()).select("file", "element", "piece").unionByName(joined)
    mark = "\\" + opening
    later = F.col("piece").rlike(rf"^\s*,\s*{mark}")
    first = rf'(?s)^((?:[^"{mark}]++|{STRING}|{mark})*)({mark}(?:[^"{mark}]++|{STRING})*+)$'
    # The object (or its array) opens too, so the first piece of a file opens twice unless the array is empty.
    opens = (F.col("element") == 0) & (_count(F.regexp_replace("piece", rf"(?s){STRING}", ""), opening) >= 2)
    body = F.when(later, F.regexp_replace("piece", r"^\s*,\s*", "")).when(opens, F.regexp_extract("piece", first, 2))
    head = F.when(opens, F.regexp_extract("piece", first, 1)).when(~later, F.col("piece"))
    return whole.select("file", "element", head.alias("head"), body.alias("body"))


def array_elements(spark: SparkSession, path: str, opening: str, schema: str) -> DataFrame:
    """(value) of every element, parsed by its schema; null if it can't be."""
    found = elements(spark, path, opening).where(F.col("body").isNotNull())
    return found.select(F.from_json(F.concat("body", F.lit(CLOSING[opening])), schema).alias("value"))


def surroundings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a file: the other fields of an object whose array holds objects."""
    heads = elements(spark, path, "{").where(F.col("head").isNotNull() & (F.trim("head") != ""))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("element", "head"))), lambda x: x["head"])
    # The object's start and its end, at most two pieces a file.
    whole = heads.where(~F.col("head").rlike(r"^\s+$")).groupBy("file").agg(F.concat(F.array_join(ordered, ""), F.lit("}")).alias("object"))
    return whole.select(F.from_json("object", schema).alias("value")).select("value.*")
