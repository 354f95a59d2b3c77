"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join (native Spark only).

Lists hold exact canonical URLs and host-and-path rules. Both are keys; each URL is expanded to the few keys that
could match it, the filter drops keys that no list holds, and the join removes false positives.

Edge cases: a null URL or one without `://` has an empty host and path and is allowed; a very long URL gives one key for each
length of a rule's path and label of its host; of rules of equal length that fit, the one that is later in the alphabet decides; a
repeated page is judged as often as it comes; empty lists allow everything; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rules of the query: verdict and host/path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Bits a key in the filter, and blocks of 64 bytes up to which it is broadcast (64 MB); beyond, it is shuffled.
BITS_PER_KEY, BROADCAST_BLOCKS = 16, 1 << 20
_WORDS = 8


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host in lower case, path and query; scheme, fragment and a final slash do not count."""
    query = F.regexp_extract(url, "(?s)^.*?://[^?#]*(\\?[^#]*)", 1)
    return F.concat(host_of(url), F.regexp_replace(path_of(url), "/$", ""), F.coalesce(query, F.lit("")))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks))


def _bit(key_hash: str, i: int) -> str:
    return f"cast(shiftrightunsigned({key_hash}, {6 * i}) & 63 as int)"


def bloom_blocks(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(block, w0..w7) of n distinct keys: one bit in each of the eight words of a key's block."""
    blocks = max(1, -(-n * BITS_PER_KEY // (64 * _WORDS)))
    hashed = keys.select(_block(F.col("key"), blocks).alias("block"), F.xxhash64(F.lit("bits"), "key").alias("h"))
    words = [F.expr(f"bit_or(shiftleft(1L, {_bit('h', i)}))").alias(f"w{i}") for i in range(_WORDS)]
    return hashed.groupBy("block").agg(*words), blocks


def possible(probes: DataFrame, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """The probes (a column key) that may be listed."""
    side = F.broadcast(filter_blocks) if blocks <= BROADCAST_BLOCKS else filter_blocks
    hashed = probes.withColumn("block", _block(F.col("key"), blocks)).withColumn("h", F.xxhash64(F.lit("bits"), "key"))
    passes = " AND ".join(f"(shiftrightunsigned(w{i}, {_bit('h', i)}) & 1) = 1" for i in range(_WORDS))
    return hashed.join(side, "block").where(passes).select(*probes.columns)


def url_filter(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed_hit.

    `listed` has a column url: canonical or not, these URLs are blocked unless a rule says otherwise. The longest
    rule that fits decides; without one, the list does.
    """
    spark = pages.sparkSession
    urls = listed.select(F.concat(F.lit("u:"), canonical(F.col("url"))).alias("key")).where("key <> 'u:'").distinct()
    urls = urls.select("key", F.lit("block").alias("verdict"), F.lit(None).cast("string").alias("rule"))
    rule_rows = [(f"r:{r}", v, r) for v, r in rules]
    keys = urls.unionByName(spark.createDataFrame(rule_rows, "key string, verdict string, rule string")) if rule_rows else urls
    keys = written(keys, "listed")
    lengths = sorted({len(r[r.index("/") :]) for _, r in rules})
    blooms, blocks = bloom_blocks(keys, keys.count())

    judged = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    parts = judged.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    # One URL may stand on a third of all pages: each distinct URL is probed once.
    distinct = parts.where(F.col("host") != "").select("url", "host", "path").distinct()
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    prefixes = F.filter(F.array(*[F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    rule_keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(F.lit("r:"), s, p))))
    probes = distinct.select("url", F.explode(F.array_union(F.array(F.concat(F.lit("u:"), canonical(F.col("url")))), rule_keys)).alias("key"))
    hits = possible(probes, blooms, blocks).join(keys, "key")
    best = hits.groupBy("url").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.char_length("rule").alias("n"), "rule", "verdict"))).alias("best"),
        F.max(F.col("rule").isNull()).alias("listed_hit"),
    )
    listed_hit = F.coalesce(F.col("listed_hit"), F.lit(False))
    return parts.join(best, "url", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(listed_hit, "block").otherwise("allow")).alias("verdict"), listed_hit.alias("listed_hit"),
    )


#: The host labels whose pages make up the query's list.
LISTED_LABELS = ("cheap-pills", "spam-farm")


def listed_urls(pages: DataFrame) -> DataFrame:
    """The URLs that the query lists: those of hosts with a label above."""
    return pages.where(F.arrays_overlap(F.split(host_of(F.col("url")), "\\."), F.array(*map(F.lit, LISTED_LABELS)))).select("url")


_CASES = " ".join(
    f"WHEN (host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}') THEN '{r}'"
    for _, r in sorted(RULES, key=lambda x: -len(x[1]))
)
_VERDICTS = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in RULES)
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path, coalesce(regexp_extract(url, '^.*?://[^?#]*(\\?[^#]*)', 1, 's'), '') AS query FROM pages),
r AS (SELECT *, CASE {_CASES} END AS rule, host || regexp_replace(path, '/$', '') || query AS canon FROM p),
l AS (SELECT DISTINCT canon FROM r WHERE list_has_any(string_split(host, '.'), {list(LISTED_LABELS)}))
SELECT page_id, host, path, rule, CASE {_VERDICTS} WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, l.canon IS NOT NULL AS listed_hit
FROM r LEFT JOIN l ON r.canon = l.canon AND r.host <> ''
"""
