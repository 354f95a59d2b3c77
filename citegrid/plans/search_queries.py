"""Queries of resolution, retrieval and access."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import access as A
from ..functions import text as T
from ..operators import access, ranking, resolve, retrieve
from ..sources.scratch import scratch
from .registry import query

GROUPS, EXCLUDED = [["of the"], ["de la", "der"], ["los"]], ["and the"]
REQUEST = retrieve.Request("the and thing of edge over onto", ("that", "tion"), 2005, 2020, 20)
PUBLISHERS, INDEXES = ("example.com",), ("example.org",)


def norm(c: str, fold: bool = True) -> str:
    """A text as keys have it; of what folding does beyond lower case, the given titles have only the sharp s."""
    low = f"replace(lower({c}), 'ß', 'ss')" if fold else f"lower({c})"
    return f"trim(regexp_replace(regexp_replace({low}, '[^\\p{{{{L}}}}\\p{{{{N}}}}_\\s]', ' ', 'g'), '[\\s\\p{{{{Z}}}}]+', ' ', 'g'), ' ')"


def toks(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.STOPWORDS)
    return f"list_distinct(list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), '[a-zA-Z0-9][a-zA-Z0-9+-]*'), lambda x: lower(x)), lambda x: NOT list_contains([{stop}], x)))"


GOAL = toks("'" + " ".join([REQUEST.question, *REQUEST.keywords]) + "'")
WORDS = toks("'" + " ".join(REQUEST.keywords) + "'")
SCORE = f"""
CASE WHEN len({GOAL}) = 0 THEN 0.0 ELSE round_even(least(1.0, greatest(0.0, 0.5 * (len(list_intersect({GOAL}, {toks('title')})) / len({GOAL})) + 0.3 * (len(list_intersect({GOAL}, {toks('abstract')})) / len({GOAL}))
 + 0.15 * (len(list_intersect({WORDS}, list_concat({toks('title')}, {toks('abstract')}))) / len({WORDS})) + 0.05 * coalesce(least(1.0, greatest(0.0, (year - 2005) / 15.0)), 0.0))), 6) END"""
SCORED = f"SELECT *, {SCORE} AS lexical_score FROM {{papers}}"
STABLE = f"CASE WHEN doi <> '' THEN 'doi:' || doi WHEN source_id <> '' THEN 'openalex:' || lower(source_id) ELSE 'title:' || {norm('title')} || ':' || coalesce(CAST(year AS VARCHAR), 'unknown') END"
MERGE = f"CASE WHEN doi <> '' THEN 'doi:' || doi WHEN arxiv_id <> '' THEN 'arxiv:' || arxiv_id ELSE 'title:' || {norm('title')} || ':' || coalesce(CAST(year AS VARCHAR), 'None') END"


@query(f"SELECT ord, {norm('title')} AS norm_title, regexp_replace(regexp_replace(lower(trim(doi)), '^(https://doi\\.org/|http://doi\\.org/|doi:)', ''), '[ .]+$', '') AS norm_doi, {norm('lang')} AS norm_lang FROM {{papers}}")
def f01_normalize(t):
    return t("papers").select("ord", T.normalize_title(F.col("title")).alias("norm_title"), T.normalize_doi(F.col("doi")).alias("norm_doi"), T.normalize_title(F.col("lang")).alias("norm_lang"))


@query(f"SELECT ord, array_to_string(list_sort({toks('abstract')}), ' ') AS tokens FROM {{papers}}")
def f05_tokens(t):
    return t("papers").select("ord", F.array_join(F.array_sort(T.tokens(F.col("abstract"))), " ").alias("tokens"))


@query(f"SELECT ord, lexical_score FROM ({SCORED})")
def f06_lexical_score(t):
    return retrieve.with_lexical_score(t("papers"), REQUEST).select("ord", "lexical_score")


@query("""
WITH s AS (SELECT stable_id, title, year, abstract, list_min(list_filter([strpos(lower(abstract), x) - 1 for x in ['nation', 'esto', 'ouer']], lambda p: p >= 0)) AS spot FROM {papers})
SELECT stable_id, title, year, CASE WHEN length(abstract) <= 300 THEN abstract ELSE substr(abstract, greatest(0, coalesce(spot, 0) - 100) + 1, 300) END AS snippet FROM s""")
def f07_relevant_snippet(t):
    return retrieve.compact(t("papers"), ["nation", "esto", "ouer"], 300)


def as_json(c: str) -> str:
    return f"coalesce(CAST(to_json({c}) AS VARCHAR), 'null')"


@query(f"SELECT ord, sha256('{{{{\"abstract\":' || {as_json('abstract')} || ',\"doi\":' || {as_json('doi')} || ',\"title\":' || {as_json('title')} || ',\"year\":' || {as_json('year')} || '}}}}') AS fingerprint FROM {{papers}}")
def f08_fingerprint(t):
    return t("papers").select("ord", T.fingerprint(title=F.col("title"), abstract=F.col("abstract"), year=F.col("year"), doi=F.col("doi")).alias("fingerprint"))


@query(f"SELECT ord, {STABLE} AS stable_key FROM {{papers}}")
def p20_paper_key(t):
    return resolve.paper_key(t("papers")).select("ord", "stable_key")


FIRST = "arg_min({c}, ord) FILTER (WHERE {c} <> '') AS {c}".replace("{", "{{").replace("}", "}}")


def first(c: str) -> str:
    return f"arg_min({c}, ord) FILTER (WHERE {c} <> '') AS {c}"


@query(f"""
WITH k AS (SELECT *, {MERGE} AS merge_key FROM {{papers}}),
s AS (SELECT merge_key, source, min(ord) AS o FROM k GROUP BY ALL), q AS (SELECT merge_key, query, min(ord) AS o FROM k GROUP BY ALL),
g AS (SELECT merge_key, min(ord) AS group_ord, arg_min(stable_id, ord) AS stable_id, arg_min(title, ord) AS title, arg_min(year, ord) AS year, arg_min(array_to_string(authors, ','), ord) AS authors, arg_min(lang, ord) AS lang,
 {first('abstract')}, {first('doi')}, {first('arxiv_id')}, {first('open_access_url')}, {first('venue')}, {first('publisher')}, max(citation_count) AS citation_count, count(*) AS records, string_agg(source || ':' || source_id, ',' ORDER BY ord) AS source_records FROM k GROUP BY merge_key)
SELECT g.*, sl.sources, ql.queries FROM g JOIN (SELECT merge_key, string_agg(source, ',' ORDER BY o) AS sources FROM s GROUP BY 1) sl USING (merge_key) JOIN (SELECT merge_key, string_agg(query, ',' ORDER BY o) AS queries FROM q GROUP BY 1) ql USING (merge_key)""")
def a01_merge_sources(t):
    out = resolve.merge_sources(t("papers"))
    for c in ("sources", "queries", "authors"):
        out = out.withColumn(c, F.array_join(c, ","))
    out = out.withColumn("source_records", F.array_join(F.transform("source_records", lambda r: F.concat_ws(":", r["source"], r["id"])), ","))
    return out.drop("source_id", "request_id")


@query(f"""
WITH k AS (SELECT *, {STABLE} AS stable_key FROM {{papers}}), q AS (SELECT stable_key, query, min(ord) AS o FROM k GROUP BY ALL),
l AS (SELECT stable_key, abstract FROM k QUALIFY row_number() OVER (PARTITION BY stable_key ORDER BY length(coalesce(abstract, '')) DESC, ord) = 1),
f AS (SELECT stable_key, ord AS group_ord, stable_id, source_id, title, year, arxiv_id, source, lang, open_access_url, venue, request_id, array_to_string(authors, ',') AS authors, publisher FROM k QUALIFY row_number() OVER (PARTITION BY stable_key ORDER BY ord) = 1),
g AS (SELECT stable_key, {first('doi')}, max(citation_count) AS citation_count, count(*) AS records FROM k GROUP BY 1)
SELECT f.*, g.doi, g.citation_count, g.records, l.abstract, ql.queries FROM f JOIN g USING (stable_key) JOIN l USING (stable_key) JOIN (SELECT stable_key, string_agg(query, ',' ORDER BY o) AS queries FROM q GROUP BY 1) ql USING (stable_key)""")
def a02_deduplicate(t):
    return resolve.deduplicate(t("papers")).withColumn("queries", F.array_join("queries", ",")).withColumn("authors", F.array_join("authors", ","))


@query(f"""
WITH k AS (SELECT *, {STABLE} AS stable_key FROM {{papers}})
SELECT stable_key, count(*) AS size, string_agg(source_id, ',' ORDER BY ord) AS members, 'Merged ' || count(*) || ' records using ' || stable_key AS log FROM k GROUP BY stable_key HAVING count(*) > 1""")
def a03_duplicate_report(t):
    return resolve.duplicate_report(t("papers")).withColumn("members", F.array_join("members", ","))


@query("WITH h AS (SELECT *, sha256(text) AS h FROM documents) SELECT doc_id, source, h FROM h QUALIFY row_number() OVER (PARTITION BY source, h ORDER BY doc_id) = 1")
def a04_dedup_by_hash(t):
    docs = t("documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return resolve.dedup_by_hash(docs, ["source"], "h", "doc_id")


@query("SELECT project_id, item_key, status, attempts, ord FROM {work_items} QUALIFY row_number() OVER (PARTITION BY project_id, item_key ORDER BY updated_at DESC, ord DESC) = 1")
def a05_latest_per_key(t):
    return resolve.latest_per_key(t("work_items").select("project_id", "item_key", "status", "attempts", "ord", "updated_at"), ["project_id", "item_key"], ["updated_at", "ord"]).drop("updated_at")


@query("""
WITH b AS (SELECT ord, title, citation_count FROM {papers}), u AS (SELECT ord, 'new ' || title AS title, citation_count + 1 AS citation_count FROM {papers} WHERE ord % 3 = 0 UNION ALL SELECT ord + 100000, title, 0 FROM {papers} WHERE ord % 50 = 0)
SELECT * FROM u UNION ALL SELECT * FROM b WHERE ord NOT IN (SELECT ord FROM u)""")
def s09_upsert(t):
    base = t("papers").select("ord", "title", "citation_count")
    changed = base.where("ord % 3 = 0").select("ord", F.concat(F.lit("new "), "title").alias("title"), (F.col("citation_count") + 1).alias("citation_count"))
    added = base.where("ord % 50 = 0").select((F.col("ord") + 100000).alias("ord"), "title", F.lit(0).alias("citation_count"))
    return resolve.upsert(base.withColumn("at", F.lit(0)), changed.unionByName(added).withColumn("at", F.lit(1)), ["ord"], "at").drop("at")


@query("""
WITH b AS (SELECT ord, title, citation_count FROM {papers}), u AS (SELECT ord, 'new ' || title AS title, citation_count + 1 AS citation_count FROM {papers} WHERE ord % 3 = 0 UNION ALL SELECT ord + 100000, title, 0 FROM {papers} WHERE ord % 50 = 0)
SELECT *, 0 AS again FROM u UNION ALL SELECT *, 0 FROM b WHERE ord NOT IN (SELECT ord FROM u)""")
def s09_upsert_into(t):
    """A table on disk that is filled, updated, and updated again by the same rows (again: the parts that this touches)."""
    base = t("papers").select("ord", "title", "citation_count", F.lit(0).alias("at"))
    changed = base.where("ord % 3 = 0").select("ord", F.concat(F.lit("new "), "title").alias("title"), (F.col("citation_count") + 1).alias("citation_count"), F.lit(1).alias("at"))
    added = base.where("ord % 50 = 0").select((F.col("ord") + 100000).alias("ord"), "title", F.lit(0).alias("citation_count"), F.lit(1).alias("at"))
    path = scratch(base.sparkSession, "upserted")
    resolve.upsert_into(path, base, ["ord"], "at")
    again = [resolve.upsert_into(path, changed.unionByName(added), ["ord"], "at") for _ in range(2)][1]
    return base.sparkSession.read.parquet(path).select("ord", "title", "citation_count", F.lit(len(again)).alias("again"))


@query("SELECT source_id, min(ord) AS first_ord, row_number() OVER (ORDER BY min(ord)) - 1 AS group_ord FROM {papers} GROUP BY source_id")
def w08_first_seen(t):
    return resolve.first_seen(t("papers"), "source_id")


MATCH = " || ".join(f"CASE WHEN contains(' ' || s || ' ', ' {w} ') THEN '{w};' ELSE '' END" for w in ("of the", "de la", "der", "los"))
CONCEPT = f"SELECT *, {MATCH} AS matched, matched <> '' AND NOT contains(' ' || s || ' ', ' and the ') AS included FROM (SELECT *, {norm(chr(39) + chr(39) + ' || title || ' + chr(39) + ' ' + chr(39) + ' || abstract', False)} AS s FROM {{papers}})"


def _matched():
    return F.array_join(F.transform("matched", lambda x: F.concat(x, F.lit(";"))), "")


@query(f"SELECT ord, matched, included FROM ({CONCEPT})")
def p01_concept_filter(t):
    return retrieve.concept_filter(t("papers"), GROUPS, EXCLUDED).select("ord", _matched().alias("matched"), "included")


@query(f"SELECT ord, matched, included FROM ({CONCEPT})")
def p02_concept_join(t):
    return retrieve.concept_filter(t("papers"), GROUPS, EXCLUDED, literal_terms=0).select("ord", _matched().alias("matched"), "included")


@query(f"WITH c AS ({CONCEPT}), w AS (SELECT ord, request_id, included AND year > 2021 AS keep FROM c), n AS (SELECT request_id, count_if(keep) AS group_kept, count(*) AS group_rows FROM w GROUP BY 1) SELECT w.ord, w.request_id, group_kept, group_rows, group_kept = 0 AS fallback_used FROM w JOIN n USING (request_id) WHERE keep OR group_kept = 0")
def p03_filter_or_all(t):
    papers = retrieve.concept_filter(t("papers"), GROUPS, EXCLUDED).withColumn("keep", F.col("included") & (F.col("year") > 2021))
    return retrieve.filter_or_all(papers, "keep", "request_id").select("ord", "request_id", "group_kept", "group_rows", "fallback_used")


@query(f"SELECT request_id, stable_id, lexical_score, row_number() OVER (PARTITION BY request_id ORDER BY lexical_score DESC, stable_id) AS lex_rank FROM ({SCORED}) QUALIFY lex_rank <= 10")
def k01_lexical_candidates(t):
    return retrieve.lexical_candidates(retrieve.with_lexical_score(t("papers"), REQUEST), REQUEST).select("request_id", "stable_id", "lexical_score", "lex_rank")


DECISIONS = "SELECT 'doc:' || doc_id AS stable_id, label_ord AS ord, quality = 1 OR doc_id % 2 = 0 AS include, (doc_id % 97) / 100.0 AS semantic, 'judged ' || doc_id AS reason FROM (SELECT doc_id, quality, doc_id AS label_ord FROM labels UNION ALL SELECT doc_id, 1 - quality, doc_id + 1000000 FROM labels WHERE doc_id % 5 = 0)"


def decisions(t):
    labels = t("labels").select("doc_id", "quality", F.col("doc_id").alias("ord"))
    again = labels.where("doc_id % 5 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"), (F.col("doc_id") + 1000000).alias("ord"))
    rows = labels.unionByName(again)
    return rows.select(F.concat(F.lit("doc:"), "doc_id").alias("stable_id"), "ord", ((F.col("quality") == 1) | (F.col("doc_id") % 2 == 0)).alias("include"), ((F.col("doc_id") % 97) / F.lit(100.0)).alias("semantic"), F.concat(F.lit("judged "), "doc_id").alias("reason"), F.array(F.lit("aspect")).alias("aspects"))


LAST = f"SELECT * FROM ({DECISIONS}) QUALIFY row_number() OVER (PARTITION BY stable_id ORDER BY ord DESC) = 1"


@query(f"SELECT p.ord, d.include, d.semantic, d.reason FROM {{papers}} p LEFT JOIN ({LAST}) d USING (stable_id)")
def j04_attach_decisions(t):
    return retrieve.attach_decisions(t("papers"), decisions(t)).select("ord", "include", "semantic", "reason")


RANKED = f"""SELECT request_id, stable_id, lexical_score, semantic, round_even(least(1.0, greatest(0.0, coalesce(semantic, lexical_score))), 6) AS final_score,
 CASE WHEN semantic IS NOT NULL THEN 'aspect' ELSE array_to_string(list_sort(list_intersect({toks("'" + REQUEST.question + "'")}, {toks('title')})), ',') END AS matched_aspects,
 row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN semantic IS NULL THEN 1 ELSE 0 END, semantic DESC, lexical_score DESC, stable_id) AS rank
 FROM ({SCORED}) LEFT JOIN (SELECT stable_id, include, semantic FROM ({LAST})) d USING (stable_id) WHERE coalesce(include, true)"""


def _ranked(t, limit=None):
    judged = retrieve.attach_decisions(retrieve.with_lexical_score(t("papers"), REQUEST), decisions(t))
    out = retrieve.final_rank(judged, REQUEST.question, limit=limit)
    return out.select("request_id", "stable_id", "lexical_score", "semantic", "final_score", F.array_join("matched_aspects", ",").alias("matched_aspects"), "rank")


@query(RANKED)
def k02_final_rank(t):
    return _ranked(t)


@query(f"SELECT * FROM ({RANKED}) WHERE rank <= 20")
def k03_select_top(t):
    return retrieve.select_top(_ranked(t, REQUEST.maximum_papers), REQUEST.maximum_papers)


@query("SELECT query, ord, row_number() OVER (PARTITION BY query ORDER BY ord) AS query_rank FROM {papers} QUALIFY query_rank <= 30")
def k05_cap_per_query(t):
    return retrieve.cap_per_query(t("papers"), 20).select("query", "ord", "query_rank")


@query("SELECT ord, stable_id, citation_count FROM {papers} ORDER BY citation_count DESC, ord LIMIT 25 OFFSET 50")
def k08_list_page(t):
    return ranking.list_page(t("papers").select("ord", "stable_id", "citation_count"), [F.desc("citation_count"), F.asc("ord")], 25, 50)


@query("""
WITH p AS (SELECT ord, request_id, arxiv_id, CASE WHEN ord % 2 = 0 THEN '  ' ELSE abstract END AS abstract, CASE WHEN ord % 4 = 0 THEN NULL ELSE year END AS year FROM {papers}),
m AS (SELECT arxiv_id, min('  abstract of ' || arxiv_id || ' ') AS abstract, min(year) AS year FROM {papers} WHERE arxiv_id IS NOT NULL AND ord % 7 <> 0 GROUP BY 1),
f AS (SELECT ord, arxiv_id FROM p WHERE coalesce(arxiv_id, '') <> '' AND trim(coalesce(abstract, '')) = '' QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY ord) <= 10)
SELECT p.ord, sha256(coalesce(m.abstract, p.abstract)) AS abstract_hash, coalesce(p.year, m.year) AS year FROM p LEFT JOIN f ON p.ord = f.ord LEFT JOIN m ON f.arxiv_id = m.arxiv_id""")
def j16_enrich_abstracts(t):
    papers = t("papers").select("ord", "request_id", "arxiv_id", F.when(F.col("ord") % 2 == 0, "  ").otherwise(F.col("abstract")).alias("abstract"), F.when(F.col("ord") % 4 != 0, F.col("year")).alias("year"))
    meta = t("papers").where("arxiv_id IS NOT NULL AND ord % 7 <> 0").groupBy("arxiv_id").agg(F.min(F.concat(F.lit("  abstract of "), "arxiv_id", F.lit(" "))).alias("abstract"), F.min("year").alias("year"))
    return retrieve.enrich_abstracts(papers, meta).select("ord", F.sha2(F.col("abstract").cast("binary"), 256).alias("abstract_hash"), "year")


@query(f"""
WITH u AS (SELECT count(DISTINCT {STABLE}) AS n FROM {{papers}}), k AS (SELECT count_if(included) AS n FROM ({CONCEPT}) WHERE ord IN (SELECT min(ord) FROM (SELECT *, {STABLE} AS stable_key FROM {{papers}}) GROUP BY stable_key)), r AS (SELECT count(*) AS n FROM {{papers}})
SELECT r.n AS n_raw, u.n AS n_unique, k.n AS n_kept, least(k.n, 5) AS n_selected, r.n - u.n AS n_duplicates, u.n - k.n AS n_dropped FROM u, k, r""")
def a31_search_counters(t):
    papers = retrieve.concept_filter(resolve.paper_key(t("papers")), GROUPS, EXCLUDED)
    return retrieve.search_counters(papers, "stable_key", F.col("included"), 5)


@query("WITH s AS (SELECT source, max(citation_count) AS latency_ms, source <> 'arxiv' AS ok FROM {papers} GROUP BY source) SELECT max(latency_ms) FILTER (WHERE ok) AS latency_ms, count_if(NOT ok) AS failed, (SELECT count(*) FROM {papers}) AS total FROM s")
def a36_source_summary(t):
    papers = t("papers")
    status = papers.groupBy("source").agg(F.max("citation_count").alias("latency_ms")).withColumn("ok", F.col("source") != "arxiv")
    return retrieve.source_summary(status, papers)


@query("SELECT ord, stable_id FROM {papers} WHERE contains(lower(title || ' ' || lang || ' x'), 'tion')")
def p16_search_cards(t):
    return retrieve.search_cards(t("papers").withColumn("authors", F.array("lang", F.lit("x"))), "TION").select("ord", "stable_id")


# access

HOST = "lower(coalesce(regexp_extract({0}, '^[a-zA-Z]+://(?:[^/@]*@)?([^/?#:]+)', 1), ''))"
IN = "({0} = '{1}' OR ends_with({0}, '.{1}'))"


def host(c: str) -> str:
    return HOST.replace("{0}", c)


def within(c: str, h: str) -> str:
    return IN.replace("{0}", host(c)).replace("{1}", h)


IS_PUB = f"(source_type = 'journal' OR {within('url', 'example.com')})"
USABLE = f"""SELECT paper_ord, pos, url, pdf_url, source_type, version, is_oa FROM {{oa_locations}} WHERE url <> '' AND NOT stale AND NOT ({IS_PUB} AND NOT is_oa)
 UNION ALL SELECT paper_ord, 1152921504606846976, open_access_url, NULL, NULL, NULL, true FROM {{oa_papers}} p WHERE open_access_url <> '' AND NOT EXISTS (SELECT 1 FROM {{oa_locations}} l WHERE l.paper_ord = p.paper_ord AND l.url = p.open_access_url AND (l.stale OR NOT ({IS_PUB.replace('url', 'l.url').replace('source_type', 'l.source_type')} AND NOT l.is_oa)))"""
TIER = f"CASE WHEN {within('url', 'example.org')} THEN 3 WHEN source_type = 'repository' THEN 0 WHEN {IS_PUB} THEN 2 ELSE 1 END"
ORDERED = f"""SELECT paper_ord, final_url, is_pdf, tier, row_number() OVER (PARTITION BY paper_ord ORDER BY tier, np, no, nv, url, pos) AS position FROM (
 SELECT paper_ord, coalesce(nullif(pdf_url, ''), url) AS final_url, coalesce(pdf_url, '') <> '' AS is_pdf, coalesce({TIER}, 1) AS tier, CASE WHEN coalesce(pdf_url, '') <> '' THEN 0 ELSE 1 END AS np, CASE WHEN is_oa THEN 0 ELSE 1 END AS no,
  CASE WHEN lower(version) IN ('acceptedversion', 'submittedversion') THEN 0 ELSE 1 END AS nv, url, pos FROM ({USABLE}) QUALIFY row_number() OVER (PARTITION BY paper_ord, final_url ORDER BY tier, np, no, nv, url, pos) = 1)"""
PREPRINT = f"""SELECT paper_ord, final_url, is_pdf, synthesized, row_number() OVER (PARTITION BY paper_ord ORDER BY spot) AS position FROM (
 SELECT paper_ord, final_url, is_pdf, false AS synthesized, CAST(position AS DOUBLE) AS spot FROM ({ORDERED})
 UNION ALL SELECT p.paper_ord, 'https://arxiv.org/pdf/' || rtrim(arxiv_id, '/'), true, true, coalesce((SELECT min(position) FROM ({ORDERED}) c WHERE c.paper_ord = p.paper_ord AND {within('final_url', 'example.com')}), 1e9) - 0.5 FROM {{oa_papers}} p WHERE arxiv_id <> '')"""
SHAPED = f"SELECT *, {host('final_url')} AS h FROM ({PREPRINT}) WHERE starts_with(final_url, 'https://')"
PREDICT = f"""WITH s AS ({SHAPED}), b AS (SELECT paper_ord, count_if(h NOT IN ('doi.org', 'dx.doi.org')) AS usable, count(*) AS shaped, arg_min(h, position) FILTER (WHERE h NOT IN ('doi.org', 'dx.doi.org')) AS bh, arg_min(is_pdf, position) FILTER (WHERE h NOT IN ('doi.org', 'dx.doi.org')) AS bp FROM s GROUP BY 1),
j AS (SELECT p.paper_ord, doi, coalesce(usable, 0) AS usable, coalesce(shaped, 0) AS shaped, bh, bp, CASE WHEN bh = 'example.org' OR ends_with(bh, '.example.org') THEN 3 WHEN bh = 'example.com' OR ends_with(bh, '.example.com') THEN 2 ELSE 1 END AS tier FROM {{oa_papers}} p LEFT JOIN b USING (paper_ord)),
l AS (SELECT *, CASE WHEN usable > 0 AND tier = 1 AND bp THEN 'direct_pdf' WHEN usable > 0 AND tier = 1 THEN 'landing_page' WHEN usable > 0 AND tier = 3 THEN 'index_only' WHEN usable > 0 THEN 'publisher_only' WHEN doi <> '' AND shaped > 0 THEN 'doi_link' WHEN doi <> '' THEN 'doi_only' ELSE 'none' END AS label FROM j)
SELECT paper_ord, CASE label WHEN 'direct_pdf' THEN 'direct' WHEN 'landing_page' THEN 'likely' WHEN 'none' THEN 'manual' ELSE 'uncertain' END AS level, label, CASE WHEN usable > 0 THEN bh WHEN doi <> '' THEN 'doi.org' END AS host, CASE WHEN usable > 0 THEN usable WHEN doi <> '' AND shaped > 0 THEN shaped ELSE 0 END AS candidates FROM l"""


def _usable(t):
    return access.usable_locations(t("oa_locations"), t("oa_papers"), PUBLISHERS)


def _candidates(t):
    return access.candidates_of(t("oa_locations"), t("oa_papers"), PUBLISHERS, INDEXES)


@query(f"SELECT pos, {host('url')} AS host, CASE WHEN {within('url', 'example.org')} THEN 'index' WHEN {within('url', 'example.com')} THEN 'publisher' ELSE 'other' END AS kind, CASE WHEN {within('url', 'example.org')} THEN 3 WHEN {within('url', 'example.com')} THEN 2 ELSE 1 END AS tier, starts_with(url, 'https://') AS https FROM {{oa_locations}}")
def p08_host_class(t):
    url = F.col("url")
    return t("oa_locations").select("pos", A.host_of(url).alias("host"), A.host_class(A.host_of(url), PUBLISHERS, INDEXES).alias("kind"), A.url_tier(url, PUBLISHERS, INDEXES).alias("tier"), A.is_https_shaped(url).alias("https"))


@query(f"SELECT paper_ord, pos, url FROM ({USABLE})")
def p10_usable_locations(t):
    return _usable(t).select("paper_ord", "pos", "url")


@query(ORDERED)
def k04_order_candidates(t):
    return access.order_candidates(_usable(t), PUBLISHERS, INDEXES)


@query(PREPRINT)
def w07_insert_preprint(t):
    return _candidates(t)


@query("SELECT paper_ord, CASE WHEN arxiv_id <> '' THEN 'https://arxiv.org/pdf/' || rtrim(arxiv_id, '/') END AS url FROM {oa_papers}")
def f11_preprint_url(t):
    return t("oa_papers").select("paper_ord", A.preprint_pdf_url(F.col("arxiv_id"), F.col("stable_id")).alias("url"))


DETAIL = "replace(CASE label " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in access.DETAILS.items()).replace("{host}", "{{host}}") + " END, '{{host}}', coalesce(host, ''))"


@query(f"SELECT *, {DETAIL} AS detail FROM ({PREDICT})")
def f12_predict_full_text(t):
    return access.predict_full_text(_candidates(t), t("oa_papers"), PUBLISHERS, INDEXES)


@query(f"SELECT count_if(level = 'direct') AS direct, count_if(level = 'likely') AS likely, count_if(level IN ('uncertain', 'manual')) AS manual FROM ({PREDICT})")
def a24_availability_counts(t):
    return access.availability_counts(f12_predict_full_text(t))


ORIGIN, PATH = "regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1)", "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
FOLDERS = f"list_filter(string_split({PATH}, '/'), lambda x, i: i > 1 AND i < len(string_split({PATH}, '/')) AND x <> '')"


@query(f"""SELECT page_id, CASE page_id % 9 WHEN 0 THEN {ORIGIN} || '/' || page_id || '.pdf' WHEN 1 THEN 'https://cdn.example.org/./' || page_id || '.pdf' WHEN 2 THEN {ORIGIN} || '/' || array_to_string({FOLDERS}[:-2] || ['f', page_id || '.pdf?x=1#top'], '/')
 WHEN 3 THEN {ORIGIN} || {PATH} || '?download=' || page_id WHEN 4 THEN regexp_extract(url, '^[a-zA-Z]+:') || '//user@cdn.example.org:8443/' || page_id || '.pdf' WHEN 5 THEN {ORIGIN} || '/' || array_to_string({FOLDERS} || [page_id || '.pdf'], '/')
 WHEN 6 THEN 'https://www.figshare.com:8080/articles/' || page_id || '/download' END AS pdf FROM pages""")
def f13_pdf_link(t):
    """Links of all kinds: rooted, absolute (as it is), relative, of the query, with a host, to the page itself; figshare pages; none."""
    return t("landing").select("page_id", A.pdf_link_from_page(F.col("url"), F.col("html")).alias("pdf"))


OUTCOME = "CASE WHEN status IN (408, 425, 429, 500, 502, 503, 504) THEN 'transient' WHEN status IN (404, 410) THEN 'gone' WHEN status IN (403, 418) THEN 'blocked' WHEN status >= 400 THEN 'failed' WHEN media_type = 'application/pdf' THEN 'ok' WHEN status = 202 THEN 'challenge' ELSE 'landing' END"


@query(f"SELECT event_id, {OUTCOME} AS outcome FROM {{fetch_log}}")
def p12_classify_fetch(t):
    return access.classify_fetch(t("fetch_log")).select("event_id", "outcome")


@query(f"""
WITH o AS (SELECT *, {OUTCOME} AS outcome FROM {{fetch_log}}), f AS (SELECT DISTINCT paper_ord, pos, url || ': ' || outcome AS f FROM o WHERE outcome <> 'ok'),
s AS (SELECT paper_ord, substr(string_agg(f, '; ' ORDER BY pos, f), 1, 1000) AS failures FROM f GROUP BY 1), a AS (SELECT paper_ord, arg_min(url, (pos, url)) FILTER (WHERE outcome = 'ok') AS acquired, count(DISTINCT url) FILTER (WHERE outcome = 'gone') AS gone_urls FROM o GROUP BY 1)
SELECT a.paper_ord, acquired, gone_urls, CASE WHEN acquired IS NULL THEN failures END AS failures FROM a LEFT JOIN s USING (paper_ord)""")
def a35_acquisition_outcome(t):
    return access.acquisition_outcome(t("fetch_log"))


GONE = "SELECT url FROM {oa_locations} WHERE pos % 6 = 1"


@query(f"SELECT paper_ord, pos, url, true AS stale FROM {{oa_locations}} WHERE NOT stale AND url IN ({GONE})")
def p11_mark_stale(t):
    return access.mark_stale(t("oa_locations"), t("oa_locations").where("pos % 6 = 1")).select("paper_ord", "pos", "url", "stale")


@query(f"SELECT paper_ord, stable_id, CAST(NULL AS VARCHAR) AS open_access_url FROM {{oa_papers}} WHERE open_access_url IN (SELECT open_access_url FROM {{oa_papers}} WHERE paper_ord % 2 = 0)")
def p11_clear_stale_urls(t):
    gone = t("oa_papers").where("paper_ord % 2 = 0").select(F.col("open_access_url").alias("url"))
    return access.clear_stale_urls(t("oa_papers"), gone).select("paper_ord", "stable_id", "open_access_url")


@query(f"SELECT paper_ord, final_url FROM ({PREPRINT}) c WHERE NOT EXISTS (SELECT 1 FROM {{oa_locations}} l WHERE l.pos % 2 = 0 AND l.paper_ord = c.paper_ord AND l.url = c.final_url)")
def u07_new_candidates(t):
    return access.new_candidates(_candidates(t), t("oa_locations").where("pos % 2 = 0")).select("paper_ord", "final_url")


META = "SELECT doi, min(open_access_url) AS found_url, bool_or(paper_ord % 4 = 3) AS failed FROM {oa_papers} WHERE doi IS NOT NULL AND paper_ord % 9 <> 0 GROUP BY doi"


@query(f"""SELECT p.paper_ord, m.found_url, CASE WHEN coalesce(p.doi, '') = '' THEN 'no_doi' WHEN m.failed THEN 'lookup_failed' WHEN m.found_url IS NULL THEN 'none_found' ELSE 'found' END AS reason
FROM {{oa_papers}} p LEFT JOIN ({META}) m ON p.doi = m.doi WHERE p.paper_ord NOT IN (SELECT paper_ord FROM ({PREPRINT}))""")
def j27_refresh_candidates(t):
    meta = t("oa_papers").where("doi IS NOT NULL AND paper_ord % 9 <> 0").groupBy("doi").agg(F.min("open_access_url").alias("found_url"), F.bool_or(F.col("paper_ord") % 4 == 3).alias("failed"))
    return access.refresh_candidates(t("oa_papers"), _candidates(t), meta)


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'auth' WHEN 'click' THEN 'rate' WHEN 'error' THEN 'connect' WHEN 'signup' THEN 'not_found' ELSE 'other' END AS reason FROM events")
def f34_failure_reason(t):
    text = F.when(F.col("event_type") == "view", "API_KEY missing").when(F.col("event_type") == "click", "HTTP 429").when(F.col("event_type") == "error", "Read Timeout").when(F.col("event_type") == "signup", "DOI Not Found").otherwise(F.lit(None))
    return t("events").select("event_id", A.failure_reason(text).alias("reason"))


@query("SELECT conv_id * 1000 + turn AS response_id, turn % 6 IN (1, 2, 5) AS truncated FROM conversations")
def f36_truncated_json(t):
    """Fenced, cut after an inner brace, cut before a value, within prose, malformed, cut in a string."""
    return t("responses").select("response_id", T.is_truncated(F.col("body")).alias("truncated"))


@query(f"""SELECT p.ord AS paper_ord, p.title, array_to_string(p.authors, ',') AS authors, p.year, p.venue, p.publisher, p.source, CASE WHEN a.paper_ord IS NULL THEN NULL WHEN a.acquired IS NOT NULL THEN 'acquired' ELSE 'awaiting_upload' END AS full_text, v.level, v.host, v.detail FROM {{papers}} p
LEFT JOIN (SELECT paper_ord, arg_min(url, pos) FILTER (WHERE outcome = 'ok') AS acquired FROM (SELECT *, {OUTCOME} AS outcome FROM {{fetch_log}}) GROUP BY 1) a ON a.paper_ord = p.ord LEFT JOIN (SELECT *, {DETAIL} AS detail FROM ({PREDICT})) v ON v.paper_ord = p.ord""")
def j25_result_cards(t):
    from ..operators import ledger

    papers = t("papers").select(F.col("ord").alias("paper_ord"), "title", F.array_join("authors", ",").alias("authors"), "year", "venue", "publisher", "source")
    out = ledger.result_cards(papers, access.acquisition_outcome(t("fetch_log")), f12_predict_full_text(t))
    return out.select(*papers.columns, "full_text", "full_text_hint.level", "full_text_hint.host", "full_text_hint.detail")
