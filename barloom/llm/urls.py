"""URL rules by a sort-merge range join.

A host is written with its labels reversed (``org.example.www.``), so that a rule for a host and all its
subdomains is the interval of the keys with one prefix.  Rules and urls are dealt out by ranges of the key,
a rule to each range that its interval meets; a sweep over each sorted range keeps a stack of the rules whose
interval is open.  Of these, the longest whose path starts the url's path decides.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower, table

# Fixed by the task: host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DEFAULT = "allow"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# Keys sampled to choose the ranges; they affect the balance only.
SAMPLE = 20_000
SWEPT = "page_id bigint, host string, path string, rule string, verdict string"


def reversed_key(host: Column) -> Column:
    """``a.b.c`` as ``c.b.a.``; an empty host has the empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def url_parts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path``; both are empty for a null url and one without ``://``."""
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    return pages.select(
        F.col(f"`{id_col}`").alias("page_id"), ascii_lower(F.regexp_extract(url, PARTS, 1)).alias("host"), F.regexp_extract(url, PARTS, 2).alias("path")
    )


def range_ends(keyed: DataFrame, parts: int, rows: int) -> list[tuple[str, str]]:
    """``parts - 1`` ends of ranges of (key, salt), from a sample of about SAMPLE rows; the salt splits a hot host."""
    share = min(1.0, SAMPLE / max(rows, 1))
    cut_at = int(share * 16**8)
    picked = keyed.where(F.conv(F.substring("salt", 25, 8), 16, 10).cast("bigint") < F.lit(cut_at)) if share < 1 else keyed
    seen = sorted((r["key"], r["salt"]) for r in picked.select("key", "salt").toLocalIterator())
    return [seen[len(seen) * k // parts] for k in range(1, parts)] if seen else []


def ranges_of(ends: Sequence[tuple[str, str]], key: str) -> range:
    """The ranges that the interval of the keys with this prefix meets."""
    first = bisect_left(ends, (key, ""))
    last = first
    while last < len(ends) and (ends[last][0].startswith(key) or ends[last][0] < key):
        last += 1
    return range(first, last + 1)


def sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Rows in order of (pid, key, kind): rules go on the stack, urls get the longest open rule that fits."""
    stack: list[tuple[str, str, str, str]] = []
    at = None
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in ("pid", "key", "kind", "page_id", "host", "path", "verdict")}
        out: dict[str, list] = {n: [] for n in ("page_id", "host", "path", "rule", "verdict")}
        for pid, key, kind, page, host, path, verdict in zip(*cols.values(), strict=True):
            if pid != at:
                stack, at = [], pid
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, host, path, verdict))
                continue
            fits = [r for r in stack if path.startswith(r[2])]
            best = max(fits, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2]), default=None)
            for name, value in zip(out, (page, host, path, best and best[1] + best[2], best[3] if best else default), strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["page_id"], pa.int64()), *[pa.array(out[n], pa.string()) for n in ("host", "path", "rule", "verdict")]], names=list(out)
        )


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row; ``rules`` has ``host, path, verdict``.

    The longest rule (host and path together) wins; of rules with the same host and path
    the verdict last in alphabetical order holds (``block`` over ``allow``).  A rule with an empty host fits every host.  A null url
    fits only such rules; repeated rows are judged each; other columns are not read; empty tables are fine.
    """
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = url_parts(pages, id_col, url_col).withColumn("key", reversed_key(F.col("host")))
    urls = urls.withColumn("salt", F.md5(F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("path"))))
    ends = range_ends(urls, parts, pages.count())
    unique = rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    unique = unique.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", reversed_key(F.col("host")))

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            spread = [(pid, r) for r in rows for pid in ranges_of(ends, r["key"])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in spread], pa.int32()), *[pa.array([r[n] for _, r in spread], pa.string()) for n in ("key", "host", "path", "verdict")]],
                names=["pid", "key", "host", "path", "verdict"],
            )

    def deal_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = zip(batch.column("key").to_pylist(), batch.column("salt").to_pylist(), strict=True)
            pids = pa.array([bisect_right(ends, place) for place in places], pa.int32())
            yield pa.RecordBatch.from_arrays([pids, *[batch.column(n) for n in ("key", "page_id", "host", "path")]], names=["pid", "key", "page_id", "host", "path"])

    dealt_rules = unique.mapInArrow(deal_rules, "pid int, key string, host string, path string, verdict string")
    dealt_urls = urls.mapInArrow(deal_urls, "pid int, key string, page_id bigint, host string, path string")
    left = dealt_rules.select("pid", "key", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("page_id"), "host", "path", "verdict")
    right = dealt_urls.select("pid", "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    together = left.unionByName(right).repartitionById(parts, "pid").sortWithinPartitions("pid", "key", "kind")
    return together.mapInArrow(lambda batches: sweep(batches, default), SWEPT)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for the url of every page."""
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP9_SQL = rf"""
WITH rules(host, path, verdict) AS (VALUES {', '.join(repr(r) for r in RULES)}),
u AS (
  SELECT page_id, translate(regexp_extract(COALESCE(url, ''), '{PARTS}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(COALESCE(url, ''), '{PARTS}', 2) AS path
  FROM pages),
n AS (SELECT *, ROW_NUMBER() OVER () AS row FROM u),
m AS (
  SELECT n.row, MAX_BY(r.host || r.path, length(r.host || r.path)) AS rule, MAX_BY(r.verdict, length(r.host || r.path)) AS verdict
  FROM n JOIN rules AS r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
  GROUP BY n.row)
SELECT n.page_id, n.host, n.path, m.rule, COALESCE(m.verdict, '{DEFAULT}') AS verdict FROM n LEFT JOIN m USING (row)
"""
