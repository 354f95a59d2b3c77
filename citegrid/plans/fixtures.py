"""Stand-ins for the library's tables, as SQL over the given tables.

Each text runs unchanged in Spark and in DuckDB; names in braces are tables or other stand-ins.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FIXTURES: dict[str, str] = {
    "papers": """
SELECT doc_id AS ord, 'doc:' || doc_id AS stable_id, 'W' || (doc_id % 400) AS source_id, split_part(text, chr(10), 1) AS title, text AS abstract,
  CASE WHEN doc_id % 3 = 0 THEN '10.1000/' || (doc_id % 200) END AS doi, CASE WHEN doc_id % 3 = 1 THEN '2401.' || (doc_id % 150) END AS arxiv_id,
  CAST(2000 + doc_id % 25 AS INT) AS year, CAST(n_chars % 500 AS INT) AS citation_count,
  CASE WHEN doc_id % 3 = 0 THEN 'openalex' WHEN doc_id % 3 = 1 THEN 'arxiv' ELSE 'crossref' END AS source, source AS query, lang,
  CASE WHEN doc_id % 4 = 0 THEN 'https://oa.example.org/' || doc_id END AS open_access_url, CASE WHEN doc_id % 2 = 0 THEN 'venue ' || (doc_id % 7) ELSE '' END AS venue,
  doc_id % 10 AS request_id, split('Ann ' || (doc_id % 9) || ';Bob ' || lang, ';') AS authors, CASE WHEN doc_id % 5 = 0 THEN 'press ' || (doc_id % 11) END AS publisher
FROM {documents}""",
    "oa_locations": """
SELECT CAST(floor(page_id / 3.0) AS BIGINT) AS paper_ord, page_id AS pos, CASE WHEN page_id % 3 = 0 THEN url ELSE replace(url, 'http:', 'https:') END AS url,
  CASE WHEN page_id % 4 = 0 THEN replace(url, 'http:', 'https:') || '.pdf' END AS pdf_url,
  CASE page_id % 3 WHEN 0 THEN 'repository' WHEN 1 THEN 'journal' ELSE 'other' END AS source_type,
  CASE page_id % 5 WHEN 0 THEN 'acceptedVersion' WHEN 1 THEN 'submittedVersion' WHEN 2 THEN 'publishedVersion' END AS version,
  page_id % 5 <> 0 AS is_oa, page_id % 17 = 0 AS stale
FROM {pages}""",
    "oa_papers": """
SELECT doc_id AS paper_ord, 'doc:' || doc_id AS stable_id, CASE WHEN doc_id % 3 = 0 THEN '10.1000/' || doc_id END AS doi,
  CASE WHEN doc_id % 5 = 1 THEN '2401.' || doc_id || '/' END AS arxiv_id, CASE WHEN doc_id % 7 = 0 THEN 'https://oa.example.org/' || doc_id END AS open_access_url
FROM {documents}""",
    "landing": """
SELECT page_id, CASE page_id % 9 WHEN 6 THEN 'HTTPS://www.figshare.com:8080/articles/' || page_id || '/?file=1#x' WHEN 8 THEN 'https://figshare.com/articles/' || page_id || '/download' ELSE url END AS url, html || CASE page_id % 9
  WHEN 0 THEN '<meta name="citation_pdf_url" content=" /files/../' || page_id || '.pdf">' WHEN 1 THEN '<meta http-equiv="refresh" content="0; url=https://cdn.example.org/./' || page_id || '.pdf">'
  WHEN 2 THEN '<meta name="citation_pdf_url" content="../f/./' || page_id || '.pdf?x=1#top">' WHEN 3 THEN '<meta name="citation_pdf_url" content="?download=' || page_id || '">'
  WHEN 4 THEN '<meta name="citation_pdf_url" content="//user@cdn.example.org:8443/' || page_id || '.pdf">' WHEN 5 THEN '<meta name="citation_pdf_url" content="' || url || '"><meta http-equiv="refresh" content="5; url=' || page_id || '.pdf">' ELSE '' END AS html
FROM {pages}""",
    "fetch_log": """
SELECT event_id, user_id AS paper_ord, event_id % 7 AS pos, 'https://host' || (event_id % 40) || '.example/f' AS url,
  CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 403 WHEN 'error' THEN 503 WHEN 'signup' THEN 404 ELSE 202 END AS status,
  CASE WHEN event_id % 2 = 0 THEN 'application/pdf' ELSE 'text/html' END AS media_type
FROM {events}""",
    "figures": "SELECT CAST(floor(p_partkey / 40.0) AS BIGINT) AS doc_id, CAST(p_partkey AS BIGINT) AS fig_ord, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'Fig. ' || (p_partkey % 9 + 1) || CASE WHEN p_partkey % 4 = 0 THEN 'b' ELSE '' END END AS label, CAST(1 + p_partkey % 6 AS INT) AS page, p_name AS caption FROM {part}",
    "mention_pages": "SELECT CAST(floor(l_partkey / 40.0) AS BIGINT) AS doc_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS hit_ord, CAST(1 + l_linenumber % 6 AS INT) AS page, 'As shown in Fig. ' || (l_linenumber + 6) || ' and Table ' || (l_partkey % 5) || ' the gain holds' AS text FROM {lineitem}",
    "claims": """
SELECT CAST(o_orderkey AS BIGINT) AS claim_ord, CAST(o_custkey AS BIGINT) AS paper_id, CAST(o_orderkey % 8 AS INT) AS field_no, 'claim ' || o_orderkey AS value,
  CASE WHEN o_orderstatus = 'O' THEN 'inference' ELSE 'supported' END AS kind, CASE WHEN o_orderpriority = '1-URGENT' THEN 'comparison' ELSE 'paper' END AS scope
FROM {orders}""",
    "refs": "SELECT CAST(l_orderkey AS BIGINT) AS claim_ord, CAST(l_linenumber AS INT) AS pos, CAST(l_partkey AS BIGINT) AS evidence_id FROM {lineitem}",
    "evidence": """
SELECT CAST(p_partkey AS BIGINT) AS evidence_id, CAST(p_partkey AS BIGINT) AS ord, CASE p_size % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'figure' ELSE 'table' END AS evidence_type,
  p_size / 50.0 AS confidence, p_name AS claim, CAST(1 + p_partkey % 12 AS INT) AS page, CAST(p_partkey % 40 AS BIGINT) AS paper_id,
  CASE p_partkey % 4 WHEN 0 THEN 'method' WHEN 1 THEN 'experiment' WHEN 2 THEN 'background' ELSE 'other' END AS section_type
FROM {part}""",
    "notes": """
SELECT evidence_id, ord, evidence_type, paper_id, page, claim,
  CASE evidence_id % 6 WHEN 0 THEN '1 Introduction' WHEN 1 THEN 'Our Method' WHEN 2 THEN 'Experiments' WHEN 3 THEN 'Conclusion' WHEN 4 THEN 'Abstract' END AS section,
  CASE evidence_id % 5 WHEN 0 THEN 'We propose a method and a model; the challenge is noise in ' || claim WHEN 1 THEN 'Results on a dataset: accuracy, comparison with the baseline, an Ablation'
    WHEN 2 THEN 'In conclusion, a limitation for future work' WHEN 3 THEN '方法 and 实验 of ' || claim END AS excerpt
FROM {evidence}""",
    "reviews": """
SELECT CAST(p_partkey AS BIGINT) AS evidence_id, CASE p_partkey % 5 WHEN 1 THEN 'doubted' WHEN 2 THEN 'confirmed' WHEN 3 THEN 'excluded' ELSE 'confirmed' END AS status,
  CASE WHEN p_partkey % 5 >= 3 THEN 'human' ELSE 'auto' END AS source,
  CASE p_partkey % 7 WHEN 1 THEN '自动复核：' || p_name WHEN 2 THEN '图文一致：' || p_name WHEN 3 THEN NULL WHEN 4 THEN 'see 自动复核：' ELSE p_type END AS note
FROM {part} WHERE p_partkey % 5 <> 0""",
    "checks": "SELECT CAST(l_partkey AS BIGINT) AS evidence_id, CASE l_returnflag WHEN 'R' THEN 'inconsistent' WHEN 'A' THEN 'consistent' ELSE 'unverifiable' END AS status, CASE WHEN l_linenumber % 3 = 0 THEN 'inconsistent' ELSE 'consistent' END AS gold FROM {lineitem}",
    "traces": "SELECT CAST(event_id AS BIGINT) AS id, CAST(user_id AS BIGINT) AS project_id, event_type, event_type <> 'error' AS success, CASE WHEN event_id % 13 <> 0 THEN CAST(floor(value * 10) AS BIGINT) END AS latency_ms, ts AS created_at FROM {events}",
    "usage": "SELECT CAST(event_id AS BIGINT) AS id, CAST(user_id AS BIGINT) AS project_id, CASE WHEN event_type = 'view' THEN 'vision' ELSE 'text' END AS kind, CAST(floor(value * 100) AS BIGINT) AS tokens, ts AS created_at FROM {events}",
    "work_items": """
SELECT CAST(o_custkey AS BIGINT) AS project_id, 'scope' || (o_orderkey % 4) AS run_scope, 'k' || (o_orderkey % 25) AS item_key, 'h' || (o_orderkey % 3) AS input_hash,
  CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status, CAST(1 + o_orderkey % 3 AS INT) AS attempts, o_orderdate AS updated_at, CAST(o_orderkey AS BIGINT) AS ord
FROM {orders}""",
    "work_inputs": "SELECT DISTINCT CAST(o_custkey AS BIGINT) AS project_id, 'scope' || (o_orderkey % 4) AS run_scope, 'k' || (o_orderkey % 50) AS item_key, 'h1' AS input_hash FROM {orders}",
    "jobs": "SELECT CAST(o_custkey AS BIGINT) AS project_id, CAST(o_orderkey AS BIGINT) AS job_id, CASE o_orderstatus WHEN 'P' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'completed' END AS status, o_orderdate AS created_at FROM {orders}",
    "projects": "SELECT CAST(c_custkey AS BIGINT) AS project_id, CASE c_custkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' ELSE 'waiting' END AS status, c_name AS title, c_mktsegment AS topic FROM {customer}",
    "responses": """
SELECT conv_id * 1000 + turn AS response_id, CASE turn % 6 WHEN 0 THEN '```json' || chr(10) || '{{"answer": "' || conv_id || '", "turn": ' || turn || '}}' || chr(10) || '```' WHEN 1 THEN '{{"list": [{{"answer": "' || conv_id || '"}}, {{"turn": {{"n": ' || turn || '}}'
  WHEN 2 THEN '{{"answer": "' || conv_id || '", "turn": ' WHEN 3 THEN 'Here it is: {{"answer": "' || conv_id || '"}} as asked' WHEN 4 THEN '{{"answer": "' || conv_id || '" "turn": ' || turn || '}}' ELSE '  {{"answer": "turn ' || turn END AS body
FROM {conversations}""",
    "gold": "SELECT d.doc_id, l.quality = 1 AS relevant, d.n_chars > 500 AS predicted, CASE d.doc_id % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'figure' WHEN 2 THEN 'evidence' ELSE 'rubric' END AS category FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id",
}
_BRACES = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def _plain_counts(sql: str) -> str:
    """count_if(x) as a count of a case, which DuckDB types as BIGINT rather than HUGEINT."""
    mark = "count_if("
    while (at := sql.find(mark)) >= 0:
        end, depth = at + len(mark), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + len(mark) : end - 1]} THEN 1 END){sql[end:]}"
    return sql


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a stand-in, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = FIXTURES[name]
    return spark.sql(text, **{t: load(spark, sf_dir, t) for t in _BRACES.findall(text)})


def with_sql(body: str) -> str:
    """body with a WITH clause that defines each stand-in it names in braces; tables go by their own names."""
    names: list[str] = []

    def need(text: str) -> None:
        for t in _BRACES.findall(text):
            if t in FIXTURES and t not in names:
                need(FIXTURES[t])
                names.append(t)

    need(body)
    plain = lambda text: _BRACES.sub(r"\1", text).replace("{{", "{").replace("}}", "}")
    head = ",\n".join(f"{n} AS ({plain(FIXTURES[n])})" for n in names)
    text = _plain_counts(plain(body).strip())
    if text.upper().startswith("WITH "):
        return f"WITH {head},\n{text[5:]}" if head else text
    return f"WITH {head}\n{text}" if head else text
