"""Verdicts on urls by a trie over reversed host labels and path segments; the longest matching entry wins.

An entry has a verdict (allow or block), a host and a path. It fits its host and all subdomains if the url's path starts
with the entry's, inside a segment too. Of the fitting entries of the highest tier the longest (code points of host and
path together) decides, at equal length that of more host labels; of equal entries block wins. Entries of tier 1 are the
rules that are reported; entries of tier 0 are the operator's own lists, asked only where no rule fits. Urls that
no entry fits are allowed if they have a host and blocked if they have none.

Entries up to ``TRIE_BYTES`` are broadcast as a trie; more are joined with the urls by host suffix and path prefix, spread by a
salt since a short entry fits a large share of all urls.

A null url, or one without ``://``, has an empty host and path. Host and path of an entry may be empty but not null; entries
with nulls or other verdicts are ignored. Repeated pages are judged each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm.common import stored

# The rules of the query, and names whose sites are blocked under each of the suffixes.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "spam-farm")
SUFFIXES = ("example.com", "example.net", "example.org")

ENTRY = "verdict string, host string, path string, tier int"
#: Bytes of hosts and paths up to which the entries are broadcast.
TRIE_BYTES = 4 << 20
#: Parts that the urls of one key are spread over in the join.
SALTS = 16

_URL = "://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def own_lists() -> list[tuple[str, str, str, int]]:
    return [("block", f"{name}.{suffix}", "", 0) for name in BLOCKED_NAMES for suffix in SUFFIXES]


def entries(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    """``rules`` and the operator's own lists as a table of entries."""
    return spark.createDataFrame([(*x, 1) for x in rules] + own_lists(), ENTRY)


class Trie:
    """Entries by host labels from the right, then by whole path segments; the last segment of an entry is a prefix."""

    def __init__(self, rows: list[tuple[str, str, str, int]]):
        self.root: dict = {}
        for verdict, host, path, tier in rows:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            *whole, last = path.split("/")
            node = node.setdefault("paths", {})
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            rank = (tier, len(host) + len(path), host.count("."), verdict == "block")
            found, entry = node.setdefault("ends", {}), (rank, verdict, host + path if tier else None)
            if last not in found or rank > found[last][0]:
                found[last] = entry
            node["sizes"] = sorted({len(x) for x in found}, reverse=True)

    def longest(self, host: str, path: str) -> tuple[str, str | None] | None:
        """Verdict and rule of the entry that decides, if one fits."""
        segments, best, node = path.split("/"), None, self.root
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            at = node.get("paths")
            for segment in segments:
                if at is None:
                    break
                for size in at.get("sizes", ()):
                    entry = at["ends"].get(segment[:size]) if size <= len(segment) else None
                    if entry and (best is None or entry[0] > best[0]):
                        best = entry
                at = at.get("segments", {}).get(segment)
        return best and best[1:]


def _walked(trie) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict = {}
            rules, verdicts = [], []
            for key in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                if key not in known:
                    known[key] = trie.value.longest(*key) or ("allow" if key[0] else "block", None)
                verdict, rule = known[key]
                rules.append(rule)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return run


def _joined(urls: DataFrame, rows: DataFrame, page_id: str) -> DataFrame:
    """The same verdicts by equality of host suffix and path prefix; a url has a key for each of its labels and each length of an entry."""
    lengths = [r[0] for r in rows.select(F.length("path")).distinct().collect()]  # at most the longest path
    numbered = stored(urls.withColumn("row", F.monotonically_increasing_id()), "urls")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    fitting = F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: x <= F.length("path"))
    keys = numbered.select("row", "path", F.explode(suffixes).alias("host"), fitting.alias("fitting")).select(
        "row", "host", F.explode("fitting").alias("n"), "path", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")
    )
    keys = keys.select("row", "host", F.col("path").substr(F.lit(1), F.col("n")).alias("path"), "salt")
    dots = F.size(F.split("host", r"\."))
    rank = F.struct("tier", (F.length("host") + F.length("path")).alias("length"), dots.alias("labels"), (F.col("verdict") == "block").alias("blocks"))
    best = F.max(F.struct(rank.alias("rank"), "verdict", F.when(F.col("tier") > 0, F.concat("host", "path")).alias("rule"))).alias("best")
    distinct = rows.groupBy("host", "path").agg(best)
    spread = distinct.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = keys.join(spread, ["host", "path", "salt"]).groupBy("row").agg(F.max("best").alias("best"))
    unlisted = F.when(F.col("host") == "", "block").otherwise("allow")
    return numbered.join(found, "row", "left").select(page_id, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", unlisted).alias("verdict"))


def judged(pages: DataFrame, rows: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """page_id, host, path, rule (null without one) and verdict of each of ``pages`` (page_id, url) by the entries ``rows``."""
    rows = rows.where("verdict in ('allow', 'block') and host is not null and path is not null and tier is not null").select("verdict", "host", "path", "tier")
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    held = rows.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 16)).first()[0] or 0
    if held > trie_bytes:
        return _joined(urls, rows, "page_id")
    trie = pages.sparkSession.sparkContext.broadcast(Trie([tuple(r) for r in rows.collect()]))
    kind = pages.schema["page_id"].dataType.simpleString()
    return urls.mapInArrow(_walked(trie), f"page_id {kind}, host string, path string, rule string, verdict string")


_ENTRIES = ", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in [*((*x, 1) for x in RULES), *own_lists()])

SQL = f"""
WITH u AS (SELECT row_number() OVER () AS row, page_id,
    translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract(url, '{_URL}', 2), '') AS path FROM pages),
e(verdict, host, path, tier) AS (VALUES {_ENTRIES}),
f AS (SELECT u.row, e.verdict, CASE WHEN tier > 0 THEN e.host || e.path END AS rule,
    row_number() OVER (PARTITION BY u.row ORDER BY tier DESC, length(e.host) + length(e.path) DESC, length(e.host) - length(replace(e.host, '.', '')) DESC, e.verdict = 'block' DESC) AS place
    FROM u JOIN e ON (u.host = e.host OR ends_with(u.host, '.' || e.host)) AND starts_with(u.path, e.path))
SELECT page_id, host, path, f.rule, coalesce(f.verdict, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN f ON f.row = u.row AND place = 1
"""
