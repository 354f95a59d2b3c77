"""Queries of single functions, predicates and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import access as A
from ..functions import layout as L
from ..functions import text as T
from ..operators import layout, metrics, retrieve, review
from ..sources import files
from ..sources.scratch import scratch, written
from .layout_queries import BLOCKS, COUNT, HEADINGS, LOW, READ, TYPE, WIDTH, blocks, sections
from .registry import query
from .search_queries import host, within

# sources and sinks

NAMES = "(SELECT c_nationkey AS nation, string_agg(CASE WHEN c_nationkey % 5 = 0 THEN lower(c_name) ELSE c_name END, chr(10) ORDER BY c_name) || chr(10) AS body FROM customer GROUP BY 1)"


@query(f"SELECT CAST(nation AS INT) AS nation, octet_length(encode(body)) AS length, sha256(body) AS sha256, CASE WHEN nation % 5 = 0 THEN 'not a pdf' END AS reason, CASE WHEN nation % 5 > 0 THEN nation % 2 = 1 END AS is_new FROM {NAMES}")
def s08_land_binaries(t):
    """Files of customers' names, one a nation; those in lower case lack the magic bytes, even nations were landed before."""
    nation = F.col("c_nationkey")
    lines = t("customer").select(nation.alias("nation"), F.when(nation % 5 == 0, F.lower("c_name")).otherwise(F.col("c_name")).alias("value"))
    path = scratch(lines.sparkSession, "binaries")
    lines.repartition("nation").sortWithinPartitions("nation", "value").write.partitionBy("nation").text(path)
    first, bad = files.land_binaries(lines.sparkSession, path, magic="Customer", suffix=".txt")
    nation_of = F.regexp_extract("path", r"nation=(\d+)", 1).cast("int")
    known = first.where(nation_of % 2 == 0).select(F.concat(F.lit("earlier/"), F.regexp_extract("path", r"nation=\d+", 0)).alias("path"), "sha256")
    good, _ = files.land_binaries(lines.sparkSession, path, magic="Customer", suffix=".txt", known=known)
    new = F.col("is_new") & ~F.startswith("path", F.lit("earlier/"))  # what is not new has the earlier path
    both = good.withColumn("reason", F.lit(None).cast("string")).withColumn("is_new", new).unionByName(bad, allowMissingColumns=True)
    return both.select(nation_of.alias("nation"), "length", "sha256", "reason", "is_new")


@query("SELECT ord, title, year FROM {papers} WHERE year BETWEEN 2005 AND 2010")
def x04_landed_papers(t):
    """Papers through a Python data source: a partition a file, the range of years pushed into it."""
    papers = t("papers").select("ord", "stable_id", "title", "year", "citation_count")
    spark, path = papers.sparkSession, scratch(papers.sparkSession, "landed-papers")
    papers.repartitionByRange(4, "year").write.parquet(path)
    name = files.register_source(spark, files.LandedPapers)
    pushed = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(pushed, "false")
    spark.conf.set(pushed, "true")
    try:
        read = spark.read.format(name).option("path", path).load().where("year >= 2005 AND year <= 2010")
        return written(read.select("ord", "title", "year"), "read")  # read while the setting holds
    finally:
        spark.conf.set(pushed, before)


@query("SELECT id, project_id, tokens FROM {usage}")
def s10_append_sink(t):
    rows = t("usage").select("id", "project_id", "tokens")
    path = scratch(rows.sparkSession, "appended")
    files.append_sink(rows.where("tokens < 1000"), path)
    files.append_sink(rows.where("tokens >= 1000"), path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@query("SELECT 'set' || CAST(floor(doc_id / 100.0) AS BIGINT) AS dataset_id, 't' || doc_id AS task_id, category, CAST(relevant AS VARCHAR) AS relevant, CAST(predicted AS VARCHAR) AS predicted FROM {gold}")
def s11_read_eval(t):
    """Evaluation sets of at most 100 tasks, each landed as one JSON file."""
    value = lambda c, name: F.struct(F.array(F.col(c).cast("string")).alias(name))
    task = F.struct(F.concat(F.lit("t"), "doc_id").alias("task_id"), "category", value("relevant", "relevant_ids").alias("reference"), value("predicted", "selected_ids").alias("prediction"), F.lit("exact").alias("scoring"))
    sets = t("gold").groupBy(F.expr("cast(floor(doc_id / 100.0) as bigint)").alias("part")).agg(F.collect_list(task).alias("tasks"))
    path = scratch(sets.sparkSession, "sets")
    sets.select("part", F.concat(F.lit("set"), "part").alias("dataset_id"), "tasks").write.partitionBy("part").json(path)
    return files.read_eval(sets.sparkSession, path).select("dataset_id", "task_id", "category", F.col("reference.relevant_ids")[0].alias("relevant"), F.col("prediction.selected_ids")[0].alias("predicted"))


@query("SELECT category, count(*) AS n, count_if(relevant = predicted) AS n_right FROM {gold} GROUP BY 1")
def s12_write_snapshot(t):
    result = t("gold").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("relevant") == F.col("predicted")).alias("n_right"))
    path = scratch(result.sparkSession, "snapshot")
    files.write_snapshot(result, path)
    return result.sparkSession.read.schema(result.schema).json(path)


# URLs

@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN starts_with(url, 'https:') WHEN 4 THEN true ELSE page_id % 5 = 1 END AS shaped FROM pages")
def p09_https_shaped(t):
    k, url = F.col("page_id"), F.col("url")
    tried = (
        F.when(k % 5 == 0, url).when(k % 5 == 1, F.concat(F.lit("https://"), F.substring_index(url, "://", -1))).when(k % 5 == 2, F.concat(F.lit("https://user:word@example.com/"), k))
        .when(k % 5 == 3, F.concat(F.lit("ftp://example.com/"), k)).otherwise(F.concat(F.lit("HTTPS://example.org/"), k))
    )
    return t("pages").select("page_id", A.is_https_shaped(tried).alias("shaped"))


@query(f"SELECT page_id, {host('url')} AS host, CASE WHEN page_id % 2 = 0 THEN {host('url')} ELSE '' END AS broken FROM pages")
def f09_host_of(t):
    broken = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("http://a b:c/"), "page_id"))
    return t("pages").select("page_id", A.host_of(F.col("url")).alias("host"), A.host_of(broken).alias("broken"))


@query(f"SELECT page_id, CASE WHEN {within('url', 'example.org')} THEN 3 WHEN {within('url', 'example.com')} THEN 2 ELSE 1 END AS tier FROM pages")
def f10_url_tier(t):
    return t("pages").select("page_id", A.url_tier(F.col("url"), ["example.com"], ["example.org"]).alias("tier"))


# layout

@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND length(p_name) BETWEEN 3 AND 100 THEN p_name END AS section FROM part")
def p15_useful_section(t):
    k, name = F.col("p_partkey"), F.col("p_name")
    title = F.when(k % 4 == 0, F.concat(F.lit("  "), name)).when(k % 4 == 1, F.concat(F.lit("= "), name)).when(k % 4 == 2, F.concat(k, F.lit(" 12 34 56"))).otherwise(F.concat(F.lit("arg  min "), name))
    return t("part").select("p_partkey", L.useful_section(title).alias("section"))


@query(f"SELECT doc_id, page, ord, CAST(median(size) OVER (PARTITION BY doc_id, page) AS DOUBLE) AS median_size FROM ({BLOCKS})")
def w03_page_median_size(t):
    return layout.page_median_size(blocks(t)).select("doc_id", "page", "ord", "median_size")


@query(f"""SELECT doc_id, ord, length({LOW}) <= 160 AND {COUNT} <= 18 AND NOT regexp_matches({LOW}, '[.。]$') AND length(regexp_replace({LOW}, '[^\\p{{{{L}}}}]', '', 'g')) >= greatest(3.0, length({LOW}) * 0.4)
 AND (regexp_matches({LOW}, '(?i)^(?:\\d+(?:\\.\\d+)*\\.?\\s+)?(?:abstract|introduction|related work|method(?:ology)?|experiments?|results?|discussion|conclusion|references)\\b') OR size >= greatest(12.0, median_size * 1.25)) AS heading
 FROM (SELECT * REPLACE (CASE WHEN ord % 9 = 0 THEN '2.1 Related  Work ' ELSE text END AS text) FROM ({READ}))""")
def f19_is_heading(t):
    rows = layout.page_median_size(layout.reading_order(blocks(t), WIDTH))
    text = F.when(F.col("ord") % 9 == 0, "2.1 Related  Work ").otherwise(F.col("text"))
    return rows.select("doc_id", "ord", L.is_heading(text, F.col("size"), F.col("median_size")).alias("heading"))


@query(f"SELECT doc_id, ord, round_even(least(1.0, 0.7 + greatest(size - median_size, 0.0) / 20), 9) AS confidence FROM ({READ})")
def f20_heading_confidence(t):
    rows = layout.page_median_size(blocks(t))
    return rows.select("doc_id", "ord", F.bround(L.heading_confidence(F.col("size"), F.col("median_size")), 9).alias("confidence"))


CAPTIONED = "CASE ord % 5 WHEN 1 THEN ' Fig.  ' || (ord % 9 + 1) || chr(10) || 'shows ' || text WHEN 2 THEN 'table' || ord || 'b: ' || text WHEN 3 THEN 'See Fig. 2 ' || text ELSE text END"
CAPTION_LOW = "trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g'), ' ')"
CAPTION = "(?i)^(?:(?:fig(?:ure)?\\.?)|table) *(\\d+[A-Za-z]?)\\b"


@query(f"SELECT doc_id, ord, regexp_matches({CAPTION_LOW}, '{CAPTION}') AS caption, nullif(regexp_extract({CAPTION_LOW}, '{CAPTION}', 0), '') AS label FROM (SELECT doc_id, ord, {CAPTIONED} AS text FROM ({BLOCKS}))")
def f21_is_caption(t):
    text = F.expr(CAPTIONED)
    return blocks(t).select("doc_id", "ord", L.is_caption(text).alias("caption"), L.caption_label(text).alias("label"))


@query(f"SELECT doc_id, ord, {TYPE} AS type FROM ({HEADINGS})")
def f22_section_type(t):
    return sections(t).select("doc_id", "ord", L.section_type(F.concat(F.lit(" "), F.upper("title"))).alias("type"))


# sets, scores, payloads

BASKETS = "(SELECT l_orderkey, list_distinct(list(l_partkey % 7)) AS a, list_distinct(list(l_suppkey % 5)) AS b FROM lineitem GROUP BY 1)"
LISTED = "list_sort(list_filter({0}, lambda x: {2} list_contains({1}, x)))"


def listed(a: str, b: str, word: str = "") -> str:
    return f"array_to_string({LISTED.replace('{0}', a).replace('{1}', b).replace('{2}', word)}, ',')"


@query(f"SELECT l_orderkey, {listed('a', 'b')} AS both, {listed('a', 'b', 'NOT')} AS only_a, {listed('b', 'a', 'NOT')} AS only_b, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS a_in_b FROM {BASKETS}")
def u04_set_ops(t):
    sets = t("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 7).alias("a"), F.collect_set(F.col("l_suppkey") % 5).alias("b")).select("l_orderkey", T.set_ops(F.col("a"), F.col("b")).alias("s"))
    joined = lambda c: F.array_join(F.array_sort(f"s.{c}"), ",").alias(c)
    return sets.select("l_orderkey", joined("both"), joined("only_a"), joined("only_b"), "s.a_in_b")


@query("SELECT p_partkey, string_agg(w, ' ' ORDER BY i) AS words FROM (SELECT p_partkey, w, min(i) AS i FROM (SELECT p_partkey, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT p_partkey, string_split(p_type, ' ') || string_split(p_name, ' ') || string_split(p_type, ' ') AS ws FROM part)) GROUP BY ALL) GROUP BY 1")
def u06_ordered_union(t):
    first = F.split("p_type", " ")
    second = F.concat(F.split("p_name", " "), first)
    return t("part").select("p_partkey", F.array_join(T.ordered_union(first, second), " ").alias("words"))


@query("SELECT evidence_id, round_even(0.45 * least(evidence_id % 8, 5) / 5.0 + CASE WHEN evidence_id % 3 = 0 THEN 0.25 ELSE 0 END + CASE WHEN evidence_id % 4 = 0 THEN 0.2 ELSE 0 END + 0.1 * (1 - CAST(confidence AS DOUBLE)), 6) AS priority FROM {evidence}")
def f26_priority_score(t):
    e = F.col("evidence_id")
    return t("evidence").select("evidence_id", F.bround(review.priority_score(e % 8, e % 3 == 0, e % 4 == 0, F.col("confidence").cast("double")), 6).alias("priority"))


@query("SELECT ord, title, doi, year FROM {papers}")
def f29_payload(t):
    payload = T.to_payload(F.col("title"), F.col("doi"), F.col("year"))
    read = t("papers").select("ord", payload.alias("payload")).select("ord", T.from_payload(F.col("payload"), "title string, doi string, year int").alias("p"))
    return read.select("ord", "p.*")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 ELSE greatest(0.0, (epoch(TIMESTAMP '1997-06-01 12:00:00') - epoch(o_orderdate)) / 60.0) END AS minutes FROM orders")
def f30_elapsed_minutes(t):
    k = F.col("o_orderkey")
    since = F.when(k % 4 == 0, " ").when(k % 4 == 1, "no time").otherwise(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"))
    return t("orders").select("o_orderkey", metrics.elapsed_minutes(since, F.lit("1997-06-01 12:00:00").cast("timestamp")).alias("minutes"))


@query("""
WITH s AS (SELECT stable_id, title, year, abstract, list_min(list_filter([strpos(lower(abstract), x) - 1 for x in ['der', 'los']], lambda p: p >= 0)) AS spot FROM {papers})
SELECT stable_id, title, year, CASE WHEN length(abstract) <= 90 THEN abstract ELSE substr(abstract, greatest(0, coalesce(spot, 0) - 30) + 1, 90) END AS snippet FROM s""")
def p19_compact(t):
    return retrieve.compact(t("papers"), ["der", "los"], 90)
