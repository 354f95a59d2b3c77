"""Queries of readers, functions and streams, over files and streams that Spark derives from the given tables."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import text as T
from ..operators import evals, evidence
from ..sources import files, records
from ..sources.scratch import scratch
from ..streaming import live
from .layout_queries import BLOCKS, COUNT, LOW, blocks
from .registry import query
from .search_queries import norm


def landed(df: DataFrame, label: str) -> str:
    path = scratch(df.sparkSession, label)
    df.write.json(path)
    return path


HEAD = "split_part(text, chr(10), 1)"
WORDS = f"nullif(trim(regexp_replace({HEAD}, ' +', ' ', 'g'), ' '), '')"


def head_line():
    return F.get(F.split("text", "\n"), F.lit(0))


BLANK = "[ \\t\\n\\r\\f\\x0B]+"
WORDS = f"list_filter(regexp_split_to_array(text, '{BLANK}'), lambda w: w <> '')"


def indexed(text: str):
    """A map of each word of a text to its places; null where it has none."""
    return T.inverted_index(F.filter(F.split(text, BLANK), lambda w: w != ""))


@query(f"""SELECT '10.5/a' || doc_id AS stable_id, 'W' || doc_id AS source_id, CASE WHEN doc_id % 3 > 0 THEN source || ' in ' || lang ELSE coalesce(nullif({HEAD}, ''), 'Untitled') END AS title, sha256(nullif(array_to_string({WORDS}, ' '), '')) AS abstract_hash,
 CAST(greatest(0, n_chars - 900) AS INT) AS citation_count, CAST(1990 + n_chars % 35 AS INT) AS year, source AS venue, lang || ',' || source AS authors, 'o:' || doc_id AS orcid, CASE doc_id % 3 WHEN 0 THEN 'https://oa.example/' || doc_id || '.pdf' WHEN 1 THEN 'https://oa.example/' || doc_id END AS open_access_url, 'openalex W' || doc_id AS record FROM documents""")
def s01_read_openalex(t):
    d, n, none = F.col("doc_id"), F.col("n_chars"), F.lit(None).cast("string")
    author = lambda c, orcid: F.struct(F.struct(c.alias("display_name"), orcid.alias("orcid")).alias("author"))
    best = F.when(d % 3 < 2, F.struct(F.concat(F.lit("https://oa.example/"), d).alias("landing_page_url"), F.when(d % 3 == 0, F.concat(F.lit("https://oa.example/"), d, F.lit(".pdf"))).otherwise("").alias("pdf_url")))
    works = t("documents").select(
        F.concat(F.lit("https://openalex.org/W"), d).alias("id"), F.concat(F.lit("https://doi.org/10.5/A"), d).alias("doi"), F.when(d % 3 > 0, F.concat("source", F.lit(" in "), "lang")).otherwise("").alias("display_name"), head_line().alias("title"),
        (1990 + n % 35).alias("publication_year"), (n - 900).alias("cited_by_count"), indexed("text").alias("abstract_inverted_index"), best.alias("best_oa_location"),
        F.array(author(F.col("lang"), F.concat(F.lit("o:"), d)), author(F.lit(""), none), author(F.col("source"), none)).alias("authorships"), F.struct(F.struct(F.col("source").alias("display_name")).alias("source")).alias("primary_location"),
    )
    out = records.read_openalex(works.sparkSession, landed(works, "works"))
    record = F.col("source_records")[0]
    return out.select("stable_id", "source_id", "title", F.sha2(F.col("abstract").cast("binary"), 256).alias("abstract_hash"), "citation_count", "year", "venue", F.array_join("authors", ",").alias("authors"), F.col("author_records")[0]["orcid"].alias("orcid"), "open_access_url", F.concat_ws(" ", record["source"], record["id"]).alias("record"))


TITLE_2 = f"{HEAD} || ' ' || source"


@query(f"""SELECT CASE WHEN doc_id % 2 = 0 THEN '10.6/b' || doc_id ELSE 'crossref:' || {norm(TITLE_2)} || ':' || (1990 + n_chars % 30) END AS stable_id, CASE WHEN doc_id % 2 = 0 THEN '10.6/b' || doc_id ELSE {norm(TITLE_2)} END AS source_id, {TITLE_2} AS title, CAST(1990 + n_chars % 30 AS INT) AS year,
 'A & ' || source || ' Café – ' || doc_id AS venue, CASE WHEN doc_id % 3 > 0 THEN 'P & Co' END AS publisher, lang || ' ' || source AS authors, doc_id / 4.0 AS score FROM documents""")
def s02_read_crossref(t):
    """Venues in two parts with named and numbered entities; publishers with blanks around them or nothing else."""
    d, none = F.col("doc_id"), F.lit(None).cast("string")
    items = t("documents").select(
        F.when(d % 2 == 0, F.concat(F.lit("10.6/B"), d)).alias("DOI"), F.array(head_line(), F.col("source")).alias("title"), F.array(F.concat(F.lit("  A &amp; "), "source"), F.concat(F.lit("Caf&eacute; &#8211; "), d, F.lit("&nbsp;"))).alias("container-title"), F.when(d % 3 > 0, " P & Co ").otherwise("  ").alias("publisher"), (d / 4).alias("score"),
        F.array(F.struct(F.col("lang").alias("given"), F.col("source").alias("family")), F.struct(F.lit("").alias("given"), none.alias("family"))).alias("author"), F.struct(F.array(F.array(1990 + F.col("n_chars") % 30)).alias("date-parts")).alias("published-online"),
    )
    out = records.read_crossref(items.sparkSession, landed(items, "items"))
    return out.select("stable_id", "source_id", "title", "year", "venue", "publisher", F.array_join("authors", ",").alias("authors"), F.col("source_records")[0]["score"].alias("score"))


CONTROLS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"
FLAT = "trim(regexp_replace(regexp_replace({}, '" + CONTROLS + "', '', 'g'), '[\\s\\p{{{{Z}}}}\\x85]+', ' ', 'g'), ' ')"


@query(f"""SELECT CASE WHEN doc_id % 4 = 0 THEN '10.9/D' || doc_id ELSE 'arxiv:2401.' || doc_id END AS stable_id, '2401.' || doc_id AS arxiv_id, CASE WHEN doc_id % 4 = 0 THEN '10.9/D' || doc_id END AS doi, CASE WHEN doc_id % 7 = 0 THEN 'Untitled' ELSE {FLAT.format(HEAD)} END AS title,
 sha256(nullif({FLAT.format('text')}, '')) AS abstract_hash, CASE WHEN doc_id % 11 > 0 THEN CAST(2000 + doc_id % 20 AS INT) END AS year, 'Ann ' || lang || ',Bob' AS authors, 'http://arxiv.org/pdf/2401.' || doc_id AS open_access_url FROM documents WHERE doc_id % 11 = 0 OR doc_id % 20 BETWEEN 5 AND 15""")
def s03_read_arxiv(t):
    """Some entries have a DOI, some no title, some no readable year."""
    d = F.col("doc_id")
    plain = lambda c: F.regexp_replace(c, CONTROLS, "")  # noqa: E731  what XML cannot hold
    link = lambda href, title: F.struct(href.alias("_href"), F.lit(title).alias("_title"))
    entries = t("documents").select(
        F.concat(F.lit("http://arxiv.org/abs/2401."), d, F.lit("v3")).alias("id"), F.when(d % 7 > 0, F.concat(F.lit("\n  "), plain(head_line()))).alias("title"), plain(F.col("text")).alias("summary"), F.when(d % 4 == 0, F.concat(F.lit("10.9/D"), d)).alias("doi"),
        F.when(d % 11 == 0, "soon").otherwise(F.concat(2000 + d % 20, F.lit("-01-02T00:00:00Z"))).alias("published"), F.array(F.struct(F.concat(F.lit("Ann\n"), "lang").alias("name")), F.struct(F.lit("Bob").alias("name"))).alias("author"),
        F.array(link(F.lit("http://arxiv.org/abs/x"), None), link(F.concat(F.lit("http://arxiv.org/pdf/2401."), d), "pdf")).alias("link"),
    )
    path = scratch(entries.sparkSession, "entries")
    entries.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(path)
    out = records.read_arxiv(t("documents").sparkSession, path, 2005, 2015)
    return out.select("stable_id", "arxiv_id", "doi", "title", F.sha2(F.col("abstract").cast("binary"), 256).alias("abstract_hash"), "year", F.array_join("authors", ",").alias("authors"), "open_access_url")


@query(f"""SELECT 'arxiv:24.' || doc_id AS stable_id, coalesce(nullif({HEAD}, ''), 'Untitled') AS title, sha256(text) AS abstract_hash, CASE WHEN doc_id % 2 = 0 THEN 2024 END AS year, lang || ',' || source AS authors, CASE WHEN doc_id % 2 = 0 THEN 'https://a.example/' ELSE 'https://p.example/' END || doc_id AS open_access_url
FROM documents WHERE doc_id % 6 < 5 AND doc_id % 7 > 0""")
def s04_read_arxiv_tool(t):
    """Whole texts in answers of five shapes: plain, nested fields, a list of texts, JSON within texts, other fields; and errors."""
    d, even = F.col("doc_id"), F.col("doc_id") % 2 == 0
    named = lambda c, test: F.when(test, c)
    own = F.when(d % 7 == 0, " ").otherwise(F.concat(F.lit("http://arxiv.org/abs/24."), d, F.lit("v12/")))
    paper = F.struct(
        named(own, even).alias("id"), named(own, ~even).alias("paper_id"), head_line().alias("title"), F.col("text").alias("abstract"), named(F.lit("2024-02-01"), even).alias("published"),
        named(F.concat(F.lit("https://a.example/"), d), even).alias("url"), named(F.concat(F.lit("https://p.example/"), d), ~even).alias("pdf_url"),
    )
    # Authors are a name and an object with a name, which one type cannot hold: the list is put in as text.
    authors = F.concat(F.lit('["'), "lang", F.lit('", {"name": "'), "source", F.lit('"}]'))
    papers = F.concat(F.lit('{"papers": [{"authors": '), authors, F.lit(", "), F.substring(F.to_json(paper), 2, 1 << 30), F.lit("]}"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    text = lambda c: F.concat(F.lit('{"type": "text", "text": '), quoted(c), F.lit("}"))
    shapes = [
        papers, F.concat(F.lit('{"n": 1, "result": {"data": '), papers, F.lit("}}")), F.concat(F.lit('{"content": ['), text(F.lit("found:")), F.lit(", "), text(papers), F.lit("]}")),
        F.concat(F.lit('{"structuredContent": {"result": '), quoted(papers), F.lit("}}")), F.concat(F.lit('{"meta": {"n": 1}, "output": ['), text(F.concat(F.lit('{"data": '), papers, F.lit("}"))), F.lit("]}")), F.lit('{"status": "error", "message": "papers?"}'),
    ]
    answers = t("documents").select(T.bind(F.array(*shapes), lambda x: F.get(x, (d % 6).cast("int"))).alias("value"))
    path = scratch(answers.sparkSession, "answers")
    answers.write.text(path)
    out = records.read_arxiv_tool(answers.sparkSession, path, "q").where(F.col(records.CORRUPT).isNull())
    return out.select("stable_id", "title", F.sha2(F.col("abstract").cast("binary"), 256).alias("abstract_hash"), "year", F.array_join("authors", ",").alias("authors"), "open_access_url")


@query("""SELECT 'W' || page_id AS stable_id, unnest(CASE WHEN page_id % 2 = 0 THEN [{'url': url || '.pdf', 'landing': url, 'pos': 0}, {'url': url, 'landing': url, 'pos': 1}] ELSE [{'url': url, 'landing': url, 'pos': 0}] END
 || [{'url': 'https://other.example/' || page_id, 'landing': 'https://other.example/' || page_id, 'pos': 2}, {'url': 'https://other.example/' || page_id || '/f', 'landing': url, 'pos': 3}], recursive := true), 'repository' AS source_type, 'l' AS license FROM pages""".replace("{", "{{").replace("}", "}}"))
def s05_explode_locations(t):
    """Four places of each work, of which two have one URL unless the first has a file of its own."""
    p, none = F.col("page_id"), F.lit(None).cast("string")
    other = F.concat(F.lit("https://other.example/"), p)
    place = lambda url, pdf: F.struct(url.alias("landing_page_url"), pdf.alias("pdf_url"), F.lit("repository").alias("host_type"), F.lit(True).alias("is_oa"), F.lit("v").alias("version"), F.lit("l").alias("license"), F.struct(F.lit("d").alias("display_name"), F.lit("repository").alias("type"), F.lit("h").alias("host_organization_name")).alias("source"))
    best, rest = place(F.col("url"), F.when(p % 2 == 0, F.concat("url", F.lit(".pdf")))), (place(F.col("url"), F.lit("")), place(other, none), place(F.col("url"), F.concat(other, F.lit("/f"))))
    works = t("pages").select(F.concat(F.lit("W"), p).alias("stable_id"), best.alias("best_oa_location"), F.array(*rest).alias("locations"))
    return records.explode_locations(works).select("stable_id", "url", F.col("landing_page_url").alias("landing"), "pos", "source_type", "license")


def sources(t):
    """Three landed sources of the documents: works, items of which some lines are cut, and a folder that is no table."""
    docs = t("documents")
    spark, d = docs.sparkSession, F.col("doc_id")
    works = docs.where(d % 3 == 0).select(F.concat(F.lit("https://openalex.org/W"), d).alias("id"), head_line().alias("title"), F.col("text").alias("abstract"))
    items = docs.where(d % 3 > 0).select(F.concat(F.lit("10.6/B"), d).alias("DOI"), F.array(head_line()).alias("title"), "doc_id")
    lines = items.select(F.concat(F.to_json(F.struct("DOI", "title")), F.lit(" ")).alias("value"), "doc_id").select(F.when(d % 17 == 0, F.expr("substr(value, 1, length(value) - 3)")).otherwise(F.col("value")))
    paths = {"openalex": landed(works, "works"), "crossref": scratch(spark, "items")}
    lines.write.text(paths["crossref"])
    reads = {"openalex": lambda: records.read_openalex(spark, paths["openalex"]), "crossref": lambda: records.read_crossref(spark, paths["crossref"]), "broken": lambda: spark.read.schema("stable_id string").parquet(paths["crossref"])}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return records.union_sources(spark, reads)


@query(f"SELECT CASE WHEN doc_id % 3 = 0 THEN 'W' || doc_id ELSE '10.6/b' || doc_id END AS stable_id, coalesce(nullif({HEAD}, ''), 'Untitled') AS title FROM documents WHERE doc_id % 3 = 0 OR doc_id % 17 > 0")
def u01_union_sources(t):
    return sources(t)[0].select("stable_id", "title")


@query("SELECT 'openalex' AS source, true AS ok, count_if(doc_id % 3 = 0) AS papers, 0 AS corrupt FROM documents UNION ALL SELECT 'crossref', true, count_if(doc_id % 3 > 0 AND doc_id % 17 > 0), count_if(doc_id % 3 > 0 AND doc_id % 17 = 0) FROM documents UNION ALL SELECT 'broken', false, 0, 0")
def u01_source_status(t):
    return sources(t)[1].select("source", "ok", "papers", "corrupt")


@query("SELECT ord, year FROM {papers} WHERE year BETWEEN 2005 AND 2010")
def s06_scan_papers(t):
    papers = t("papers").select("ord", "year")
    path = scratch(papers.sparkSession, "papers")
    papers.write.partitionBy("year").parquet(path)
    return records.scan_papers(papers.sparkSession, path, 2005, 2010).select("ord", F.col("year").cast("int").alias("year"))


@query("SELECT 'd' || doc_id AS document_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS ord, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INT) AS page_number, unnest(string_split(text, chr(10))) AS text FROM documents")
def s07_read_parsed(t):
    pages = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct((i + 1).alias("page_number"), line.alias("text")))
    docs = t("documents").select(F.concat(F.lit("d"), "doc_id").alias("document_id"), pages.alias("pages"))
    return files.read_parsed(docs.sparkSession, landed(docs, "parsed"), multi_line=False)["pages"].select("document_id", "ord", "page_number", "text")


@query("""SELECT DISTINCT 'doi:' || doi AS id, CASE WHEN doi IN (SELECT doi FROM {papers} WHERE lang = 'en' AND doi IS NOT NULL) THEN 'primary' WHEN doi IN (SELECT doi FROM {papers} WHERE year > 2010 AND doi IS NOT NULL) THEN 'secondary' ELSE 'not_found' END AS provenance FROM {papers} WHERE doi IS NOT NULL""")
def j17_lookup_metadata(t):
    rows = t("papers").select("lang", "doi", "stable_id", "source_id", "title", "year")
    ids = rows.where("doi IS NOT NULL").select(F.concat(F.lit("doi:"), "doi").alias("id")).distinct()
    return records.lookup_metadata(ids, rows.where("lang = 'en'"), rows.where("year > 2010")).select("id", "provenance").distinct()


RAW_DOI = "CASE n_chars % 5 WHEN 0 THEN ' doi: ' WHEN 1 THEN ' HTTPS://doi.org/10.' || n_chars || '/' || upper(source) || '. ' WHEN 2 THEN 'DOI:10.' || n_chars || '/' || lang || ' .' WHEN 3 THEN 'http://DOI.org/10.' || n_chars || '/' || upper(lang) ELSE source END"


@query(f"SELECT doc_id, nullif(regexp_replace(regexp_replace(lower(trim({RAW_DOI})), '^(https://doi\\.org/|http://doi\\.org/|doi:)', ''), '[ .]+$', ''), '') AS doi FROM documents")
def f02_doi_forms(t):
    return t("documents").withColumn("raw", F.expr(RAW_DOI)).select("doc_id", T.normalize_doi(F.col("raw")).alias("doi"))


@query(f"SELECT doc_id, regexp_replace(trim({RAW_DOI}), '(?i)^(https?://doi\\.org/|doi:) *', '') AS bare FROM documents")
def f03_bare_doi(t):
    return t("documents").withColumn("raw", F.expr(RAW_DOI)).select("doc_id", T.bare_doi(F.col("raw")).alias("bare"))


@query(f"SELECT doc_id, sha256(nullif(array_to_string({WORDS}, ' '), '')) AS abstract_hash FROM documents")
def f04_reconstruct_abstract(t):
    rows = t("documents").select("doc_id", indexed("text").alias("index"))
    return rows.select("doc_id", F.sha2(T.reconstruct_abstract(F.col("index")).cast("binary"), 256).alias("abstract_hash"))


@query("""SELECT doc_id, start, substr(trim(regexp_replace(substr(text, greatest(0, start - 160) + 1, start + 240 - greatest(0, start - 160)), '[\\s\\p{{Z}}\\x1C-\\x1F\\x85]+', ' ', 'g'), ' '), 1, 400) AS snippet
FROM (SELECT doc_id, text, unnest(list_distinct([0, 100, CAST(length(text) // 2 AS INT), CAST(greatest(0, length(text) - 1) AS INT)])) AS start FROM documents)""")
def f15_mention_snippet(t):
    """Around the first character, the hundredth, the middle and the last one of each text."""
    n = F.char_length("text")
    places = F.array_distinct(F.array(F.lit(0), F.lit(100), F.floor(n / 2).cast("int"), F.greatest(F.lit(0), n - 1)))
    rows = t("documents").select("doc_id", "text", F.explode(places).alias("start"))
    return rows.select("doc_id", "start", T.mention_snippet(F.col("text"), F.col("start")).alias("snippet"))


NUMBERED = "CASE WHEN ord % 7 = 0 THEN '- ' || ord || ' -' WHEN ord % 7 = 1 THEN ' XIV ' WHEN ord % 7 = 2 THEN 'page ' || ord ELSE text END"


@query(f"""SELECT doc_id, ord, {COUNT} <= 8 AND (regexp_matches({LOW}, '^[-–—·\\s]*\\d+[-–—·\\s]*$') OR regexp_matches({LOW}, '(?i)^[-–—·\\s]*[ivxlcdm]+[-–—·\\s]*$')) AS page_number, round_even(least(1.0, 0.7 + greatest(size - 11.0, 0.0) / 20), 9) AS confidence
 FROM (SELECT doc_id, ord, size, {NUMBERED} AS text FROM ({BLOCKS}))""")
def f18_block_flags(t):
    text = F.expr(NUMBERED)
    return blocks(t).select("doc_id", "ord", L.is_page_number(text).alias("page_number"), F.bround(L.heading_confidence(F.col("size"), F.lit(11.0)), 9).alias("confidence"))


DRAWN = "text || CASE ord % 6 WHEN 0 THEN ' Network overview' WHEN 1 THEN ', an ablation' WHEN 2 THEN ' (Qualitative Results)' WHEN 3 THEN ' component  analysis' ELSE '' END"
DRAWN_KIND = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(c), '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in L.FIGURE_WORDS) + " ELSE 'other' END"


@query(f"""SELECT doc_id, ord, {DRAWN_KIND} AS kind, CASE WHEN length({LOW}) BETWEEN 3 AND 100 AND length(regexp_replace({LOW}, '[^\\p{{{{L}}}}]', '', 'g')) / length({LOW}) >= 0.55 AND NOT regexp_matches({LOW}, '(?i)arg\\s*min|^[=+\\-]|[{{{{}}}}]{{{{2}}}}') THEN {LOW} END AS section
 FROM (SELECT doc_id, ord, text, {DRAWN} AS c FROM ({BLOCKS}))""")
def f23_figure_type(t):
    return blocks(t).select("doc_id", "ord", L.figure_type(F.expr(DRAWN)).alias("kind"), L.useful_section(F.col("text")).alias("section"))


@query("WITH w AS (SELECT p_partkey, trim(x) AS x, row_number() OVER (PARTITION BY p_partkey) AS i FROM (SELECT p_partkey, unnest(string_split(p_name, ' ') || [upper(p_name)]) AS x FROM part)) SELECT p_partkey, count(DISTINCT lower(x)) AS n FROM w WHERE x <> '' GROUP BY 1")
def f32_distinct_ci(t):
    return t("part").select("p_partkey", F.size(T.distinct_ci(F.array_append(F.split("p_name", " "), F.upper("p_name")))).cast("long").alias("n"))


SENTENCES = "list_filter(string_split(text, '.'), lambda x: length(x) > 3)"
PICKED = "list_distinct({}[{}:{}])"


def f1_sql(e: str, p: str) -> str:
    both = f"len(list_intersect({e}, {p}))::DOUBLE"
    return f"CASE WHEN len(list_intersect({e}, {p})) = 0 THEN 0.0 ELSE 2.0 * ({both} / len({p})) * ({both} / len({e})) / ({both} / len({p}) + {both} / len({e})) END"


@query(f"""WITH c AS (SELECT conv_id, turn, text, {WORDS} AS w, {SENTENCES} AS s FROM conversations), x AS (SELECT *, {PICKED.format('w', 1, 9)} AS e, {PICKED.format('w', 3, 11)} AS p, w[1:6] AS r, list_distinct(w[1:6]) AS rd, w[2:7] AS h FROM c),
v AS (SELECT *, CASE (conv_id + turn) % 4 WHEN 0 THEN {f1_sql('e', 'p')} WHEN 1 THEN (1.0 - least(1.0, abs(len(w) % 5 - len(w) % 7)::DOUBLE / greatest(1, len(w) % 5)) + {f1_sql('e', 'p')}) / 2
 WHEN 2 THEN CASE WHEN len(s) = 0 THEN 0.0 ELSE len(list_filter(s, lambda y: len(list_filter(string_split(y, ' '), lambda z: length(z) > 6)) > 0 AND length(y) % 3 > 0))::DOUBLE / len(s) END
 ELSE (CASE WHEN len(rd) = 0 THEN 1.0 ELSE len(list_intersect(rd, h))::DOUBLE / len(rd) END + (length(text) % 6 + 5.0) / 10.0) / 2 END AS q FROM x)
SELECT conv_id, turn, round_even(q, 6) AS score, q >= 0.8 AS passed FROM v""")
def a28_score_tasks(t):
    """Tasks whose nested answers are the words and sentences of conversations: a sentence is a claim, its long words the evidence."""
    n, category = F.size("w"), F.get(F.array(*map(F.lit, ("search", "figure", "evidence", "rubric"))), ((F.col("conv_id") + F.col("turn")) % 4).cast("int"))
    rows = t("conversations").withColumn("w", F.filter(F.split("text", BLANK), lambda w: w != "")).withColumn("s", F.filter(F.split("text", "[.]"), lambda x: F.char_length(x) > 3))
    claim = lambda s: F.struct(F.filter(F.split(s, " "), lambda z: F.char_length(z) > 6).alias("evidence_ids"), (F.char_length(s) % 3 > 0).alias("source_valid"))
    e, p = F.slice("w", 1, 9), F.slice("w", 3, 9)
    reference = F.struct(e.alias("relevant_ids"), (n % 5).alias("count"), e.alias("types"), F.col("s").alias("claims"), F.slice("w", 1, 6).alias("required_fields"))
    prediction = F.struct(p.alias("selected_ids"), (n % 7).alias("count"), p.alias("types"), F.transform("s", claim).alias("claims"), F.slice("w", 2, 6).alias("present_fields"), F.array((F.char_length("text") % 6).cast("double"), F.lit(5.0)).alias("review_scores"))
    return evals.score_tasks(rows.select("conv_id", "turn", category.alias("category"), reference.alias("reference"), prediction.alias("prediction"))).select("conv_id", "turn", "score", "passed")


@query("""WITH f AS (SELECT doc_id, list(DISTINCT label) AS labels, min(CASE WHEN label = 'Fig. 3' THEN page END) AS fp, max(caption) AS body FROM {figures} GROUP BY 1),
m AS (SELECT doc_id, list(DISTINCT page) AS pages, list(DISTINCT CASE WHEN contains(text, 'Fig. 9 ') THEN page END) AS mp, count(DISTINCT page) AS n, list(DISTINCT CASE page % 3 WHEN 0 THEN 'method' WHEN 1 THEN 'experiment' ELSE 'other' END) AS types FROM {mention_pages} GROUP BY 1),
q AS (SELECT doc_id, list_contains(labels, 'Fig. 3') AS label_found, coalesce(fp = 1 + doc_id % 6, false) AS page_right, list_contains(mp, 4) AS mentions_found, NOT contains(body, 'blue') AS header_absent, n >= 6 AS page_numbers, NOT list_contains(pages, 1 + doc_id % 12) AS references_excluded, list_contains(types, 'method') AS sections_typed FROM f JOIN m USING (doc_id))
SELECT *, label_found AND page_right AND mentions_found AND header_absent AND page_numbers AND references_excluded AND sections_typed AS all_pass FROM (SELECT doc_id, coalesce(label_found, false) AS label_found, page_right, coalesce(mentions_found, false) AS mentions_found, header_absent, page_numbers, references_excluded, sections_typed FROM q)""")
def a32_layout_quality(t):
    """Documents' figures and mentions against what each should have."""
    d, lit = F.col("doc_id"), F.lit
    figures = t("figures").groupBy("doc_id").agg(F.collect_set("label").alias("figure_labels"), F.min(F.when(F.col("label") == "Fig. 3", F.col("page"))).alias("figure_page"), F.max("caption").alias("body_text"))
    types = F.when(F.col("page") % 3 == 0, "method").when(F.col("page") % 3 == 1, "experiment").otherwise("other")
    pages = t("mention_pages").groupBy("doc_id").agg(F.collect_set("page").alias("evidence_pages"), F.collect_set(F.when(F.contains("text", lit("Fig. 9 ")), F.col("page"))).alias("mention_pages"), F.count_distinct("page").alias("n_page_numbers"), F.collect_set(types).alias("section_types"))
    gold = {"gold_label": lit("Fig. 3"), "gold_page": 1 + d % 6, "gold_mention_pages": F.array(lit(4)), "gold_header": lit("blue"), "n_pages": lit(6), "gold_references_page": (1 + d % 12).cast("int"), "gold_section_types": F.array(lit("method"))}
    flags = ("label_found", "page_right", "mentions_found", "header_absent", "page_numbers", "references_excluded", "sections_typed", "all_pass")
    return evals.layout_quality(figures.join(pages, "doc_id").withColumns(gold)).select("doc_id", *flags)


@query("SELECT evidence_id, CASE evidence_type WHEN 'figure' THEN 'path' || evidence_id ELSE CASE WHEN page % 2 = 0 THEN 'crop' || page END END AS crop, CASE evidence_type WHEN 'figure' THEN 'cap' || evidence_id ELSE CASE WHEN page % 2 = 0 THEN 'tab' || page ELSE claim END END AS caption FROM {evidence} WHERE evidence_type <> 'text'")
def j13_resolve_crops(t):
    rows = t("evidence").select("evidence_id", "evidence_type", "page", F.col("paper_id").alias("doc_id"), F.lit("Table 1").alias("label"), F.concat(F.lit("path"), "evidence_id").alias("source_path"), F.col("claim").alias("excerpt"))
    figures = rows.where("evidence_type = 'figure'").select("doc_id", F.col("source_path").alias("path"), F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.concat(F.lit(c), "evidence_id").alias("caption")) for i, c in ((1, "a later "), (0, "cap"))])).alias("f")).select("doc_id", "path", "f.*")
    tables = rows.where("page % 2 = 0").select("doc_id", "page", "label", F.concat(F.lit("crop"), "page").alias("crop"), F.concat(F.lit("tab"), "page").alias("caption"), F.lit(0).alias("ord")).distinct()
    return evidence.resolve_crops(rows, figures, tables).select("evidence_id", "crop", "caption")


@query(f"SELECT ord, {norm('title')} AS norm_title FROM {{papers}}")
def x01_nfkc_casefold(t):
    return t("papers").select("ord", T.normalize_title(F.col("title")).alias("norm_title"))


@query("SELECT doc_id, length(text) / 10.0 AS score FROM documents")
def x03_judge_batch(t):
    docs = t("documents").select("doc_id", "text")
    import pandas as pd

    def judge(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": p.doc_id, "score": p.text.str.len() / 10.0})

    return files.judge_batch(docs, judge, "doc_id long, score double").select("doc_id", "score")


# streams: a table is landed as files and read as a stream until it is used up


def stream_of(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str) -> None:
    """Run a stream until its files are used up: each micro-batch writes its own folder, in complete mode the last one stays."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{'all' if mode == 'complete' else f'batch={number}'}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drained(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """What the stream gives, as a table."""
    spark = stream.sparkSession
    out = scratch(spark, label)
    run_to_end(stream, out, scratch(spark, label), mode)
    return spark.read.schema(stream.schema).parquet(f"{out}/all" if mode == "complete" else f"{out}/batch=*")


def drained_in_parts(parts: list[DataFrame], of: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """What a stream of the parts gives, one after the other: each lands in as many files as Spark writes, and the stream goes on
    from where it ended before."""
    spark = parts[0].sparkSession
    path, out, checkpoint = (scratch(spark, label) for _ in range(3))
    for part in parts:
        part.write.mode("append").parquet(path)
        stream = of(spark.readStream.schema(part.schema).parquet(path))
        run_to_end(stream, out, checkpoint, "append")
    return spark.read.schema(stream.schema).parquet(f"{out}/batch=*")


@query("SELECT project_id % 50 AS key, (epoch_us(created_at) // 1000000 - 1704067200) // 691200 AS part FROM {traces} GROUP BY ALL")
def t01_dedup_requests(t):
    """Requests of spans of eight days, each drawn together into its first day: within a span a request stands once, and a
    span later it is forgotten."""
    second = F.unix_seconds(F.col("created_at").cast("timestamp")) - 1704067200
    part = F.floor(second / 691200)
    rows = t("traces").select((F.col("project_id") % 50).alias("key"), part.alias("part"), F.timestamp_seconds(1704067200 + part * 691200 + F.floor(second % 691200 / 8)).alias("ts"))
    last = rows.agg(F.max("part")).first()[0]
    parts = [rows.where(F.col("part") == i) for i in range(int(last) + 1)]
    return drained_in_parts(parts, lambda stream: live.dedup_requests(stream, key="key"), "deduplicated").select("key", "part")


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', created_at), '%Y-%m-%d %H:%M:%S') AS start, project_id, count(*) AS total, count_if(NOT success) AS failed, CAST(sum(latency_ms) AS BIGINT) AS latency_ms FROM {traces} GROUP BY ALL")
def t02_trace_windows(t):
    rows = t("traces").select("project_id", "success", "latency_ms", F.col("created_at").cast("timestamp").alias("created_at"))
    out = drained(live.windowed_trace_metrics(stream_of(rows, "traces"), delay="400 days"), "windows", "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "project_id", "total", "failed", "latency_ms")


@query("""SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, project_id, count(*) AS total, count_if(NOT success) AS failed FROM (SELECT *, unnest([time_bucket(INTERVAL '1 day', created_at), time_bucket(INTERVAL '1 day', created_at) + INTERVAL '12 hours', time_bucket(INTERVAL '1 day', created_at) - INTERVAL '12 hours']) AS s FROM {traces} WHERE id % 3 <> 0)
 WHERE created_at >= s AND created_at < s + INTERVAL '1 day' GROUP BY ALL HAVING s + INTERVAL '1 day' <= (SELECT max(created_at) FROM {traces}) - INTERVAL '10 minutes'""")
def t02_sliding_windows(t):
    """Append mode: windows that the watermark has closed; a third of the rows come after all others, too late to count."""
    rows = t("traces").select("id", "project_id", "success", "latency_ms", F.col("created_at").cast("timestamp").alias("created_at"))
    late = F.col("id") % 3 == 0
    last = rows.agg(F.max("created_at").alias("m"))
    marker = last.select(F.lit(1).cast("long").alias("id"), F.lit(-1).cast("long").alias("project_id"), F.lit(True).alias("success"), F.lit(0).cast("long").alias("latency_ms"), F.col("m").alias("created_at"))
    closed = rows.where(late).join(F.broadcast(last), F.col("created_at") < F.date_trunc("day", F.col("m")) - F.expr("interval 2 days")).select(*rows.columns)
    parts = [rows.where(~late).unionByName(marker), marker, closed]  # a watermark drops late rows from the next batch but one
    out = drained_in_parts(parts, lambda stream: live.windowed_trace_metrics(stream, "1 day", "12 hours", "10 minutes"), "windows")
    return out.where("project_id >= 0").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "project_id", "total", "failed")


@query("""WITH u AS (SELECT *, id % 97 = 0 AS ack FROM {usage}), s AS (SELECT *, count_if(ack) OVER (PARTITION BY project_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS stretch FROM u),
r AS (SELECT *, sum(CASE WHEN ack THEN 0 ELSE tokens END) OVER w AS tk, count_if(NOT ack AND kind = 'vision') OVER w AS vn FROM s WINDOW w AS (PARTITION BY project_id, stretch ORDER BY created_at, id ROWS UNBOUNDED PRECEDING))
SELECT project_id, id, CASE WHEN tk >= 100000 THEN 'tokens' ELSE 'vision' END AS reason, CAST(tk AS BIGINT) AS tokens, vn AS vision FROM r WHERE NOT ack AND (tk >= 100000 OR vn >= 6) QUALIFY row_number() OVER (PARTITION BY project_id, stretch ORDER BY created_at, id) = 1""")
def t03_budget_gate(t):
    at = F.col("created_at").cast("timestamp")
    rows = t("usage").select("id", "project_id", F.when(F.col("id") % 97 == 0, "ack").otherwise(F.col("kind")).alias("kind"), "tokens", at.alias("created_at"))
    spark = rows.sparkSession
    cuts = [None, *rows.select(F.expr("percentile_approx(unix_micros(created_at), array(0.25, 0.5, 0.75))").alias("c")).first()["c"], None]
    micros = F.unix_micros("created_at")
    parts = [rows.where((F.lit(a is None) | (micros > (a or 0))) & (F.lit(b is None) | (micros <= (b or 0)))) for a, b in zip(cuts, cuts[1:], strict=False)]
    with rocksdb(spark):
        return drained_in_parts(parts, lambda stream: live.budget_gate(stream, 100000, 6), "gates").select("project_id", "id", "reason", "tokens", "vision")


@contextmanager
def rocksdb(spark):
    """The state store that stateful processors need, for the streams within."""
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(store, before)


@query("""WITH b AS (SELECT project_id, time_bucket(INTERVAL '1 hour', created_at) AS start, sum(CASE WHEN id % 97 > 0 THEN tokens ELSE 0 END) AS tk, count_if(id % 97 > 0 AND kind = 'vision') AS vn, count_if(id % 97 = 0) AS acks FROM {usage} GROUP BY ALL),
s AS (SELECT *, coalesce(sum(CASE WHEN acks > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch FROM b WHERE start + INTERVAL '1 hour' <= (SELECT max(created_at) FROM {usage}) - INTERVAL '10 minutes'),
r AS (SELECT *, sum(tk) OVER w AS t, sum(vn) OVER w AS v FROM s WINDOW w AS (PARTITION BY project_id, stretch ORDER BY start ROWS UNBOUNDED PRECEDING))
SELECT project_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, CASE WHEN t >= 100000 THEN 'tokens' ELSE 'vision' END AS reason, CAST(t AS BIGINT) AS tokens, CAST(v AS BIGINT) AS vision FROM r WHERE t >= 100000 OR v >= 6 QUALIFY row_number() OVER (PARTITION BY project_id, stretch ORDER BY start) = 1""")
def t03_window_gate(t):
    """The whole table as one stream of as many files as Spark writes."""
    kind = F.when(F.col("id") % 97 == 0, "ack").otherwise(F.col("kind")).alias("kind")
    rows = t("usage").select("project_id", kind, "tokens", F.col("created_at").cast("timestamp").alias("created_at"))
    with rocksdb(rows.sparkSession):
        out = drained(live.window_gate(stream_of(rows, "usage"), 100000, 6), "gates")
    return out.select("project_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "reason", "tokens", "vision")


@query("SELECT project_id, item_key, status, attempts FROM {work_items} QUALIFY row_number() OVER (PARTITION BY project_id, item_key ORDER BY updated_at DESC, ord DESC) = 1")
def t04_live_blocks(t):
    rows = t("work_items").select("project_id", "item_key", "status", "attempts", "updated_at", "ord")
    spark = rows.sparkSession
    target = scratch(spark, "live")
    live.live_upsert(stream_of(rows, "items"), target, scratch(spark, "live")).awaitTermination()
    return live.read_live(spark, target, ["project_id", "item_key"], ["updated_at", "ord"]).select("project_id", "item_key", "status", "attempts")


@query("SELECT DISTINCT sha256(text) AS sha256 FROM documents")
def t06_ingest_documents(t):
    docs = t("documents").select("doc_id", F.col("text").alias("content"))
    target = scratch(docs.sparkSession, "ingested")
    live.ingest_documents(stream_of(docs, "incoming"), target, scratch(docs.sparkSession, "ingested")).awaitTermination()
    return docs.sparkSession.read.parquet(target).select("sha256")
