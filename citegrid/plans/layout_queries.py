"""Queries of page layout and mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import layout as L
from ..operators import layout, mentions
from .registry import query

# A block is a line of a document: 20 a page, placed by whole-number arithmetic.
BLOCKS = """SELECT doc_id, CAST(pos AS BIGINT) AS ord, CAST(1 + pos // 20 AS INT) AS page, line AS text, CASE WHEN pos % 5 = 0 THEN 40.0 WHEN pos % 2 = 0 THEN 320.0 ELSE 45.0 END AS x0, CASE WHEN pos % 5 = 0 THEN 560.0 WHEN pos % 2 = 0 THEN 560.0 ELSE 290.0 END AS x1,
 CAST(20 + (pos % 20) * 38 AS DOUBLE) AS y0, CAST(20 + (pos % 20) * 38 + 30 AS DOUBLE) AS y1, CAST(9 + length(line) % 7 AS DOUBLE) AS size
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE trim(line) <> ''"""
WIDTH, HEIGHT = 600.0, 800.0


def blocks(t) -> DataFrame:
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).where(F.trim("text") != "")
    at = F.col("pos")
    x0 = F.when(at % 5 == 0, 40.0).when(at % 2 == 0, 320.0).otherwise(45.0)
    x1 = F.when(at % 5 == 0, 560.0).when(at % 2 == 0, 560.0).otherwise(290.0)
    y0 = (20 + (at % 20) * 38).cast("double")
    return lines.select("doc_id", at.cast("long").alias("ord"), F.expr("cast(1 + pos div 20 as int)").alias("page"), "text", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), (y0 + 30).alias("y1"), (9 + F.char_length("text") % 7).cast("double").alias("size"))


NARROW, RIGHT = "(x1 - x0 < 360.0)", "((x0 + x1) / 2 > 300.0)"
READ = f"""SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY band, round_even(y0, 1), x0, ord) AS read_ord FROM (SELECT *, CASE WHEN NOT cols OR NOT {NARROW} THEN 0 WHEN NOT {RIGHT} THEN 1 ELSE 2 END AS band FROM (
 SELECT *, count_if({NARROW} AND {RIGHT}) OVER w > 0 AND count_if({NARROW} AND NOT {RIGHT}) OVER w > 0 AND count_if({NARROW}) OVER w >= 4 AS cols, median(size) OVER w AS median_size FROM ({BLOCKS}) WINDOW w AS (PARTITION BY doc_id, page)))"""
LOW = "trim(regexp_replace(text, '[\\s\\p{{Z}}\\x1C-\\x1F\\x85]+', ' ', 'g'), ' ')"
COUNT = f"len(string_split({LOW}, ' '))"
ROLE = f"""CASE WHEN (y1 <= 72.0 OR y0 >= 728.0) AND {COUNT} <= 8 AND (regexp_matches({LOW}, '^[-–—·\\s]*\\d+[-–—·\\s]*$') OR regexp_matches({LOW}, '(?i)^[-–—·\\s]*[ivxlcdm]+[-–—·\\s]*$')) THEN 'page_number'
 WHEN y1 <= 72.0 AND length({LOW}) <= 220 AND {COUNT} <= 30 THEN 'header' WHEN y0 >= 728.0 AND length({LOW}) <= 220 AND {COUNT} <= 30 THEN 'footer'
 WHEN length({LOW}) <= 160 AND {COUNT} <= 18 AND NOT regexp_matches({LOW}, '[.。]$') AND length(regexp_replace({LOW}, '[^\\p{{{{L}}}}]', '', 'g')) >= greatest(3.0, length({LOW}) * 0.4) AND size >= greatest(12.0, median_size * 1.25) THEN 'heading' ELSE 'body' END"""
ROLES = f"SELECT *, {ROLE} AS role FROM ({READ})"


def roles(t) -> DataFrame:
    return layout.with_roles(layout.page_median_size(layout.reading_order(blocks(t), WIDTH)), HEIGHT)


@query(f"SELECT doc_id, ord, read_ord, median_size FROM ({READ})")
def w02_reading_order(t):
    return layout.page_median_size(layout.reading_order(blocks(t), WIDTH)).select("doc_id", "ord", "read_ord", "median_size")


@query(f"SELECT doc_id, ord, role FROM ({ROLES})")
def f17_block_role(t):
    return roles(t).select("doc_id", "ord", "role")


@query(f"SELECT doc_id, ord FROM ({ROLES}) WHERE role IN ('body', 'caption')")
def p13_content_blocks(t):
    return layout.content_blocks(roles(t)).select("doc_id", "ord")


@query(f"SELECT doc_id, page, string_agg(text, chr(10) ORDER BY read_ord) AS text FROM ({ROLES}) WHERE role NOT IN ('header', 'footer', 'page_number') GROUP BY ALL")
def a34_page_text(t):
    return layout.page_text(roles(t))


TITLES = "['Abstract', '1 Introduction', 'Our Method', 'Experiments', 'Discussion', 'References', 'Thanks']"
HEADINGS = f"SELECT doc_id, ord, page, {TITLES}[1 + ord % 7] AS title FROM ({BLOCKS}) WHERE ord % 6 = 0"
TYPE = "CASE lower(title) WHEN 'abstract' THEN 'abstract' WHEN '1 introduction' THEN 'background' WHEN 'our method' THEN 'method' WHEN 'experiments' THEN 'experiment' WHEN 'discussion' THEN 'discussion' WHEN 'references' THEN 'references' ELSE 'other' END"
SECTIONS = f"""SELECT doc_id, ord, title, page AS start_page, greatest(page, coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY ord), page_count)) AS end_page, {TYPE} AS type
 FROM ({HEADINGS}) JOIN (SELECT doc_id, max(page) AS page_count FROM ({BLOCKS}) GROUP BY 1) USING (doc_id)"""
PAGES = f"SELECT DISTINCT doc_id, page FROM ({BLOCKS})"


def sections(t) -> DataFrame:
    titles = F.array(*map(F.lit, ("Abstract", "1 Introduction", "Our Method", "Experiments", "Discussion", "References", "Thanks")))
    heads = blocks(t).where("ord % 6 = 0").select("doc_id", "ord", "page", F.get(titles, (F.col("ord") % 7).cast("int")).alias("title"))
    return layout.section_spans(heads, blocks(t))


@query(SECTIONS)
def w01_section_spans(t):
    return sections(t)


@query(f"WITH s AS ({SECTIONS}) SELECT p.doc_id, p.page, arg_max(title, ord) AS section, arg_max(type, ord) AS section_type FROM ({PAGES}) p LEFT JOIN s ON s.doc_id = p.doc_id AND p.page BETWEEN start_page AND end_page GROUP BY ALL")
def j07_section_of_page(t):
    return layout.section_of_page(blocks(t).select("doc_id", "page").distinct(), sections(t))


@query(f"WITH s AS ({SECTIONS}) SELECT * FROM ({PAGES}) p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = p.doc_id AND type = 'references' AND p.page BETWEEN start_page AND end_page)")
def j08_drop_reference_pages(t):
    return layout.drop_reference_pages(blocks(t).select("doc_id", "page").distinct(), sections(t))


RUNS = f"""SELECT r.doc_id, r.page, r.run, any_value(h.heading) AS heading, string_agg(r.text, chr(10) ORDER BY read_ord) AS text FROM (SELECT *, count_if(role = 'heading') OVER (PARTITION BY doc_id, page ORDER BY read_ord) AS run FROM ({ROLES})) r
LEFT JOIN (SELECT doc_id, page, text AS heading, count_if(role = 'heading') OVER (PARTITION BY doc_id, page ORDER BY read_ord) AS run, role FROM ({ROLES}) QUALIFY role = 'heading') h ON h.doc_id = r.doc_id AND h.page = r.page AND h.run = r.run WHERE r.role IN ('body', 'caption') GROUP BY ALL"""


@query(RUNS)
def w04_block_runs(t):
    return layout.block_runs(roles(t))


CAPTIONS = f"SELECT doc_id, page, ord, y0, y1, CASE WHEN ord % 8 = 1 THEN 'Table ' ELSE 'Fig. ' END || (ord % 9 + 1) || ' shows ' || length(text) AS text FROM ({BLOCKS}) WHERE ord % 4 = 1"


def nearest_sql(kind: str, word: str) -> str:
    nearest = "arg_min(c.text, (least(abs(c.y0 - g.y1), abs(g.y0 - c.y1)), c.ord))"
    return f"""SELECT g.doc_id, g.page, g.region_id, '{kind}' AS kind, {nearest} AS caption, nullif(regexp_extract({nearest}, '{word} \\d+'), '') AS label
 FROM (SELECT doc_id, page, ord AS region_id, y0, y1 FROM ({BLOCKS}) WHERE ord % 4 <> 1) g LEFT JOIN ({CAPTIONS}) c ON c.doc_id = g.doc_id AND c.page = g.page AND starts_with(c.text, '{word}') GROUP BY ALL"""


@query(f"{nearest_sql('figure', 'Fig.')} UNION ALL {nearest_sql('table', 'Table')}")
def j12_nearest_caption(t):
    """All blocks but the captions are regions, once as figures and once as tables; captions of both kinds stand between them."""
    k = F.col("ord")
    made = F.concat(F.when(k % 8 == 1, "Table ").otherwise("Fig. "), k % 9 + 1, F.lit(" shows "), F.char_length("text"))
    rows = blocks(t).withColumn("text", F.when(k % 4 == 1, made).otherwise(""))
    regions = rows.where("ord % 4 <> 1").select("doc_id", "page", k.alias("region_id"), "y0", "y1")
    near = [layout.nearest_caption(regions, rows, kind).withColumn("kind", F.lit(kind)) for kind in ("figure", "table")]
    return near[0].unionByName(near[1]).select("doc_id", "page", "region_id", "kind", "caption", "label")


@query("""WITH r AS (SELECT p_partkey % 30 AS doc_id, p_partkey AS ord, p_size * 12 AS width, p_size * 9 AS height, CASE WHEN p_partkey % 2 = 0 THEN 'raster' ELSE 'vector' END AS kind, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS caption, 'h' || (p_partkey % 200) AS sha256 FROM part)
SELECT doc_id, ord FROM r WHERE width * height >= 20000 AND CASE WHEN kind = 'raster' THEN width >= 80 AND height >= 80 ELSE width >= 100 AND height >= 80 AND caption IS NOT NULL END QUALIFY row_number() OVER (PARTITION BY doc_id, sha256 ORDER BY ord) = 1""")
def p14_figure_candidates(t):
    k = F.col("p_partkey")
    raw = t("part").select((k % 30).alias("doc_id"), k.alias("ord"), (F.col("p_size") * 12).alias("width"), (F.col("p_size") * 9).alias("height"), F.when(k % 2 == 0, "raster").otherwise("vector").alias("kind"), F.when(k % 3 > 0, F.col("p_name")).alias("caption"), F.concat(F.lit("h"), k % 200).alias("sha256"))
    return layout.figure_candidates(raw).select("doc_id", "ord")


@query("""WITH s AS (SELECT l_orderkey AS doc_id, l_partkey % 3 AS block, l_linenumber % 2 AS line, l_linenumber AS span, ' ' || l_returnflag || '  x' AS text, l_quantity AS size FROM lineitem),
l AS (SELECT doc_id, block, line, trim(regexp_replace(string_agg(text, '' ORDER BY span, text), '\\s+', ' ', 'g')) AS text, max(size) AS size FROM s GROUP BY ALL)
SELECT doc_id, block, string_agg(text, chr(10) ORDER BY line) AS text, CAST(max(size) AS DOUBLE) AS size FROM l GROUP BY ALL""")
def a33_spans_to_blocks(t):
    spans = t("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), (F.col("l_partkey") % 3).alias("block"), (F.col("l_linenumber") % 2).alias("line"), F.col("l_linenumber").alias("span"), F.concat(F.lit(" "), "l_returnflag", F.lit("  x")).alias("text"), F.col("l_quantity").alias("size"))
    return layout.spans_to_blocks(spans).select("doc_id", "block", "text", F.col("size").cast("double").alias("size"))


# mentions

HITS = """SELECT doc_id, page, hit_ord, 'figure' AS kind, regexp_extract(text, 'Fig\\. (\\d+)', 1) AS key FROM {mention_pages} UNION ALL SELECT doc_id, page, hit_ord, 'table', regexp_extract(text, 'Table (\\d+)', 1) FROM {mention_pages}"""
KEYED = "SELECT doc_id, fig_ord, label, page, caption, lower(nullif(regexp_extract(label, '(\\d+[A-Za-z]?)', 1), '')) AS key FROM {figures}"


@query(HITS)
def f16_head_mentions(t):
    return mentions.head_mentions(t("mention_pages"))


@query("""SELECT doc_id, page, hit_ord, CAST(0 AS INT) AS pos, 'figure' AS kind, regexp_extract(text, 'Fig\\. (\\d+)', 1) AS key, text AS snippet FROM {mention_pages} UNION ALL SELECT doc_id, page, hit_ord, 1, 'table', regexp_extract(text, 'Table (\\d+)', 1), text FROM {mention_pages}""")
def x02_mention_hits(t):
    return mentions.mention_hits(t("mention_pages"))


def visuals(t) -> DataFrame:
    return t("figures").withColumn("kind", F.lit("figure"))


@query("SELECT fig_ord, lower(nullif(regexp_extract(label, '(\\d+[A-Za-z]?)', 1), '')) AS key, nullif(regexp_extract(lower(regexp_extract(label, '(\\d+[A-Za-z]?)', 1)), '^(\\d+)', 1), '') AS core FROM {figures}")
def f14_visual_key(t):
    return t("figures").select("fig_ord", L.visual_key(F.col("label")).alias("key"), L.core_key(L.visual_key(F.col("label"))).alias("core"))


@query(f"SELECT h.doc_id, h.hit_ord, h.key AS hit_key, k.fig_ord FROM ({HITS}) h JOIN ({KEYED}) k ON h.kind = 'figure' AND k.doc_id = h.doc_id AND k.key = h.key")
def j09_link_mentions(t):
    return mentions.link_mentions(mentions.head_mentions(t("mention_pages")), visuals(t)).select("doc_id", "hit_ord", "hit_key", "fig_ord")


UNMATCHED = f"SELECT doc_id, key, 'Fig. ' || key AS label, arg_min(page, hit_ord) AS page, min(hit_ord) AS first_hit FROM ({HITS}) h WHERE kind = 'figure' AND NOT EXISTS (SELECT 1 FROM ({KEYED}) k WHERE k.doc_id = h.doc_id AND k.key = h.key) GROUP BY doc_id, key"


def unmatched(t) -> DataFrame:
    return mentions.unmatched_references(mentions.head_mentions(t("mention_pages")), t("figures"))


@query(UNMATCHED)
def j10_unmatched_references(t):
    return unmatched(t)


@query(f"SELECT doc_id, page, label FROM ({UNMATCHED}) u WHERE doc_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM {{figures}} f WHERE f.doc_id = u.doc_id AND lower(f.label) = lower(u.label))")
def j11_repair_figures(t):
    pages = t("mention_pages").select("doc_id", "page", (F.col("doc_id") % 3 != 0).alias("has_screenshot")).distinct()
    return mentions.repair_figures(unmatched(t), t("figures"), pages).select("doc_id", "page", "label")


@query(f"""WITH l AS (SELECT h.doc_id, k.fig_ord, h.page, h.hit_ord, 'snippet ' || h.page AS snippet FROM ({HITS}) h JOIN ({KEYED}) k ON h.kind = 'figure' AND k.doc_id = h.doc_id AND k.key = h.key),
d AS (SELECT doc_id, fig_ord, snippet, min(hit_ord) AS o FROM l GROUP BY ALL) SELECT doc_id, fig_ord, snippet, row_number() OVER (PARTITION BY doc_id, fig_ord ORDER BY o) AS mention_no FROM d QUALIFY mention_no <= 6""")
def a10_attach_mentions(t):
    links = mentions.link_mentions(mentions.head_mentions(t("mention_pages")), visuals(t)).withColumn("pos", F.lit(0)).withColumn("snippet", F.concat(F.lit("snippet "), "page"))
    return mentions.attach_mentions(links).select("doc_id", "fig_ord", "snippet", "mention_no")


@query()
def x05_greedy_attach(t):
    return mentions.greedy_attach(mentions.mention_hits(t("mention_pages")), visuals(t))


MADE = "SELECT doc_id, 'figure' AS kind, fig_ord, hit_ord AS mention_no, 'snippet ' || (hit_ord % 9) AS snippet FROM {mention_pages} JOIN {figures} USING (doc_id, page)"


def made(t, n: int, distinct: bool) -> DataFrame:
    rows = t("mention_pages").select("doc_id", "page", F.col("hit_ord").alias("mention_no"), F.concat(F.lit("snippet "), F.col("hit_ord") % 9).alias("snippet"))
    return mentions.on_page(rows, visuals(t), n, distinct)


@query(f"WITH d AS (SELECT doc_id, fig_ord, snippet, min(mention_no) AS mention_no FROM ({MADE}) GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY doc_id, fig_ord ORDER BY mention_no) AS rank FROM d QUALIFY rank <= 4")
def k09_top_mentions(t):
    return mentions.top_mentions(made(t, 4, True), 4).select("doc_id", "fig_ord", "snippet", "mention_no", "rank")


@query(f"SELECT doc_id, fig_ord, mention_no, row_number() OVER (PARTITION BY doc_id, fig_ord ORDER BY mention_no) AS mention_index FROM ({MADE}) QUALIFY mention_index <= 8")
def k10_number_mentions(t):
    return mentions.number_mentions(made(t, 8, False), 8).select("doc_id", "fig_ord", "mention_no", "mention_index")


@query(f"""SELECT doc_id, page, 'unmatched' AS warning, label FROM ({UNMATCHED}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page, first_hit) <= 6
UNION ALL SELECT DISTINCT p.doc_id, p.page, 'text_light', '' FROM (SELECT doc_id, page, max(text) AS text FROM {{mention_pages}} GROUP BY ALL) p JOIN {{figures}} f ON f.doc_id = p.doc_id AND f.page = p.page WHERE length(p.text) < 46""")
def k11_layout_warnings(t):
    """Texts have white space around them, which does not count."""
    pages = t("mention_pages").groupBy("doc_id", "page").agg(F.concat(F.lit(" \n\u00a0\u0085"), F.max("text"), F.lit("\t \n")).alias("text"))
    return mentions.layout_warnings(unmatched(t), pages, t("figures"), light=46)
