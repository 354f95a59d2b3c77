"""Line dedup by site-relative frequency (native Spark only).

Group pages by host, divide the pages that hold a line by the host's pages, and drop lines above a boilerplate ratio.

Edge cases: a null or empty text has no lines to drop; lines without a word (only ASCII white space) are never
dropped; a line that repeats in one page counts once; a null host is a host of its own; a line of fewer than min_pages
pages repeats nothing and stays (at 2, a host of one page loses nothing; at 1, the ratio alone decides); a very long text
is one row of lines like any other; repeated rows count as pages each; an empty table gives an empty result; further columns,
whatever their names, stay. Lines are told apart by a 64-bit hash within their host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

#: A line goes if more than this share of its host's pages holds it, and this number of pages at least.
RATIO, MIN_PAGES = 0.1, 2
#: Rows (16 bytes each) up to which the boilerplate table is broadcast; beyond it Spark shuffles and splits hot hosts.
BROADCAST_ROWS = 1_000_000
_WORD = "[^\\x20\\x09-\\x0D]"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.when(line.rlike(_WORD), F.xxhash64(line))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, line (hash), pages, host_pages of each line above the ratio; at most lines-a-page / ratio rows a host."""
    host = F.coalesce(F.concat(F.lit("h:"), F.col(host_col).cast("string")), F.lit("null"))
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col(text_col)), _key), lambda k: k.isNotNull()))
    counts = (
        docs.select(host.alias("host"), F.explode(keys).alias("line"))
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    totals = docs.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("host_pages"))
    return counts.join(totals, "host").where(F.col("pages") > F.col("host_pages") * ratio)


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with a column `_line_dedup`: struct(text, n_lines, n_dropped); the other columns are as they were.

    The boilerplate table is written first and counted; within the bound, one array a host is broadcast and documents
    are never shuffled.
    """
    found = written(boilerplate(docs, host_col, text_col, ratio, min_pages), "boilerplate")
    own, boiler, kept = (fresh(docs, n) for n in ("_host", "_boiler", "_kept"))
    hosts = found.groupBy(F.col("host").alias(own)).agg(F.collect_list("line").alias(boiler))
    if found.count() <= BROADCAST_ROWS:
        hosts = F.broadcast(hosts)
    host = F.coalesce(F.concat(F.lit("h:"), F.col(host_col).cast("string")), F.lit("null"))
    lines = _lines(F.col(text_col))
    left = F.when(F.col(boiler).isNull(), lines).otherwise(
        F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col(boiler), _key(x)), F.lit(False)))
    )
    joined = docs.withColumn(own, host).join(hosts, own, "left").withColumn(kept, left)
    text = F.when(F.size(kept) == F.size(lines), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    made = F.struct(text.alias("text"), F.size(lines).alias("n_lines"), (F.size(lines) - F.size(kept)).alias("n_dropped"))
    return joined.select(*docs.columns, made.alias("_line_dedup"))


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, n_lines, n_dropped, kept_chars, kept_sha256."""
    out = drop_boilerplate(docs.select("doc_id", "source", "text"))
    text = F.coalesce(F.col("_line_dedup.text"), F.lit(""))
    return out.select(
        "doc_id", "source", F.col("_line_dedup.n_lines").cast("long").alias("n_lines"), F.col("_line_dedup.n_dropped").cast("long").alias("n_dropped"),
        F.char_length(text).cast("long").alias("kept_chars"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM d),
c AS (SELECT source, line, count(DISTINCT doc_id) AS pages FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL),
t AS (SELECT source, count(*) AS host_pages FROM d GROUP BY ALL),
b AS (SELECT c.source, c.line FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE pages >= {MIN_PAGES} AND pages > host_pages * {RATIO}),
k AS (SELECT l.doc_id, l.source, count(*) AS n_lines, count(b.line) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE b.line IS NULL), '') AS kept
  FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line GROUP BY ALL)
SELECT doc_id, source, n_lines, n_dropped, length(kept) AS kept_chars, sha256(kept) AS kept_sha256 FROM k
"""
