"""Queries of evidence, claims, review and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evals, evidence, layout, metrics, retrieve, review
from . import layout_queries
from .registry import query

CITED = """SELECT r.evidence_id, c.claim_ord, r.pos, c.paper_id, c.field_no, c.scope, c.value, n.evidence_count FROM {claims} c JOIN {refs} r USING (claim_ord)
 JOIN (SELECT claim_ord, count(*) AS evidence_count FROM {refs} GROUP BY 1) n USING (claim_ord) WHERE c.kind = 'supported'"""
INDEX = f"SELECT evidence_id, count(*) AS cited_by, bool_or(scope = 'comparison') AS supports_comparison, min(claim_ord) AS first_claim, max(claim_ord) AS last_claim FROM ({CITED}) GROUP BY 1"


def citations(t):
    return review.explode_citations(t("claims"), t("refs"))


@query(CITED)
def j05_explode_citations(t):
    return citations(t)


@query(INDEX)
def a09_citation_index(t):
    return review.citation_index(citations(t))


@query(f"WITH c AS ({CITED}) SELECT evidence_id, arg_min(claim_ord, (claim_ord, pos)) AS claim_ord, arg_min(value, (claim_ord, pos)) AS value FROM c WHERE evidence_id IN (SELECT evidence_id FROM {{evidence}} WHERE evidence_type IN ('figure', 'table')) GROUP BY 1")
def a20_review_targets(t):
    return review.review_targets(citations(t), t("evidence"))


@query(f"SELECT evidence_id, count(*) AS cited_total, count_if(evidence_count = 1) AS downgrade, count_if(evidence_count <> 1) AS retained, bool_or(scope = 'comparison') AS supports_comparison FROM ({CITED}) GROUP BY 1")
def a22_impact_preview(t):
    return review.impact_preview(citations(t))


QUEUE = f"""SELECT evidence_id, ord, evidence_type, status, source, cited_by, segment, priority FROM (
 SELECT e.evidence_id, e.ord, e.evidence_type, r.status, r.source, coalesce(i.cited_by, 0) AS cited_by, coalesce(r.status = 'doubted', false) AS doubted, coalesce(r.source = 'human', false) AS human,
  CASE WHEN coalesce(r.status = 'doubted', false) AND coalesce(i.cited_by, 0) > 0 THEN 'high_risk' WHEN NOT coalesce(r.source = 'human', false) AND coalesce(i.cited_by, 0) >= 2 AND e.evidence_type IN ('figure', 'table') THEN 'high_impact' ELSE 'normal' END AS segment,
  round_even(0.45 * least(CAST(coalesce(i.cited_by, 0) AS DOUBLE), 5.0) / 5.0 + 0.25 * CASE WHEN i.supports_comparison THEN 1.0 ELSE 0.0 END + 0.20 * CASE WHEN r.status = 'doubted' THEN 1.0 ELSE 0.0 END + 0.10 * (1.0 - CAST(e.confidence AS DOUBLE)), 9) AS priority
 FROM {{evidence}} e LEFT JOIN {{reviews}} r USING (evidence_id) LEFT JOIN ({INDEX}) i USING (evidence_id))
WHERE coalesce(status, '') <> 'excluded' AND NOT (human AND NOT doubted) AND NOT (cited_by = 0 AND evidence_type = 'text')"""


def queue(t):
    out = review.build_queue(t("evidence"), t("reviews"), review.citation_index(citations(t)))
    return out.select("evidence_id", "ord", "evidence_type", "status", "source", "cited_by", "segment", "priority")


@query(QUEUE)
def f27_build_queue(t):
    return queue(t)


@query(f"SELECT evidence_id, priority FROM ({QUEUE}) WHERE segment IN ('high_risk', 'high_impact')")
def p17_filter_segment(t):
    return review.filter_segment(queue(t), "priority").select("evidence_id", "priority")


@query(f"SELECT evidence_id, priority, row_number() OVER (ORDER BY priority DESC, ord) - 1 AS position FROM ({QUEUE})")
def k07_order_queue(t):
    return review.order_queue(queue(t)).select("evidence_id", "priority", "position")


@query(f"SELECT count_if(segment = 'high_risk') AS high_risk, count_if(segment = 'high_impact') AS high_impact, count(*) AS actionable, (SELECT count_if(status = 'excluded') FROM {{reviews}}) AS excluded FROM ({QUEUE})")
def a23_queue_stats(t):
    return review.queue_stats(queue(t), t("reviews"))


@query("SELECT evidence_id, evidence_type FROM {evidence} WHERE evidence_id NOT IN (SELECT evidence_id FROM {reviews} WHERE status <> 'unreviewed')")
def j02_undecided(t):
    return review.undecided(t("evidence"), t("reviews")).select("evidence_id", "evidence_type")


@query("SELECT evidence_id, evidence_type FROM {evidence} WHERE evidence_id NOT IN (SELECT evidence_id FROM {reviews} WHERE status = 'excluded')")
def j03_drop_excluded(t):
    return review.drop_excluded(t("evidence"), t("reviews")).select("evidence_id", "evidence_type")


@query("""SELECT c.claim_ord, c.value, coalesce(e.evidence, '') AS evidence FROM {claims} c LEFT JOIN (SELECT claim_ord, string_agg(evidence_id || ':' || evidence_type || ':' || page, ',' ORDER BY pos, evidence_id) AS evidence
 FROM {refs} JOIN (SELECT * FROM {evidence} WHERE page <> 5) USING (evidence_id) GROUP BY 1) e USING (claim_ord)""")
def j06_inline_evidence(t):
    out = review.inline_evidence(t("claims"), t("refs"), t("evidence").where("page <> 5"))
    texts = F.transform("evidence", lambda e: F.concat_ws(":", e["evidence_id"], e["evidence_type"], e["page"]))
    return out.select("claim_ord", "value", F.array_join(texts, ",").alias("evidence"))


@query("""SELECT evidence_id, count(*) AS n_checks, count_if(status = 'consistent') AS n_consistent, count_if(status = 'inconsistent') AS n_inconsistent, count_if(status = 'unverifiable') AS n_unverifiable,
 CASE WHEN count_if(status = 'inconsistent') > 0 THEN 'doubted' WHEN count_if(status = 'consistent') = count(*) THEN 'confirmed' END AS status FROM {checks} GROUP BY 1""")
def a18_consensus(t):
    return review.consensus(t("checks"))


@query(f"SELECT count(*) AS high_risk FROM {{reviews}} WHERE status = 'doubted' AND evidence_id IN (SELECT evidence_id FROM ({CITED}))")
def a21_high_risk_count(t):
    return review.high_risk_count(citations(t), t("reviews"))


@query("SELECT DISTINCT paper_id, evidence_id FROM {claims} JOIN {refs} USING (claim_ord)")
def a25_cited_ids(t):
    return review.cited_ids(t("claims"), t("refs"))


@query("""WITH b AS (SELECT DISTINCT claim_ord FROM {refs} WHERE evidence_id NOT IN (SELECT evidence_id FROM {evidence} WHERE page <> 3)), n AS (SELECT claim_ord, count(*) AS n FROM {refs} GROUP BY 1)
SELECT c.claim_ord, CASE WHEN b.claim_ord IS NOT NULL THEN 'inference' ELSE kind END AS kind, CASE WHEN b.claim_ord IS NOT NULL THEN 0 ELSE coalesce(n.n, 0) END AS n_refs FROM {claims} c LEFT JOIN b USING (claim_ord) LEFT JOIN n USING (claim_ord)""")
def f28_sanitize_claims(t):
    return review.sanitize_claims(t("claims"), t("refs"), t("evidence").where("page <> 3")).select("claim_ord", "kind", "n_refs")


@query("SELECT claim_ord, field_no % 2 AS field_no, value FROM {claims}")
def u02_flatten_claims(t):
    claims = t("claims").select("claim_ord", F.array(F.struct("value")).alias("c"), (F.col("field_no") % 2).alias("f"))
    empty = F.array().cast("array<struct<value:string>>")
    wide = claims.select("claim_ord", F.when(F.col("f") == 0, F.col("c")).otherwise(empty).alias("problem"), F.when(F.col("f") == 1, F.col("c")).otherwise(empty).alias("methods"))
    return review.flatten_claims(wide, ["claim_ord"], ["problem", "methods"]).select("claim_ord", "field_no", "value")


@query("SELECT count_if(status = 'confirmed') AS confirmed, count_if(status = 'doubted') AS doubted, count_if(status = 'excluded') AS excluded, count_if(status = 'unreviewed') AS unreviewed FROM {reviews}")
def a11_review_counts(t):
    return metrics.review_counts(t("reviews"))


# chunks and addresses


def pages(t):
    return t("documents").select("doc_id", F.lit(1).alias("page"), "text")


GAP = "[\\s\\x0B\\x1C-\\x1F\\x85\\p{{Z}}]"


def chunk_sql(source: str, keys: str) -> str:
    """Chunks of the texts of a SQL source by its rule, one step of a recursion a chunk."""
    marks = ("\n", "。", ". ", "；", "; ")
    literal = lambda m: "chr(10)" if m == "\n" else f"'{m}'"
    tail = lambda at: f"reverse(substr(body, {at} + 476, 475))"
    place = lambda at, m: f"475 - (nullif(strpos({tail(at)}, reverse({literal(m)})), 0) - 1) - {len(m)}"
    stop = lambda at: f"CASE WHEN n - {at} <= 950 THEN n ELSE coalesce({at} + 476 + greatest({', '.join(place(at, m) for m in marks)}), {at} + 950) END"
    return f"""WITH RECURSIVE src AS (SELECT {keys}, regexp_replace(text, '{GAP}+$', '') AS body FROM ({source})), lead AS (SELECT *, length(body) AS n, length(body) - length(regexp_replace(body, '^{GAP}+', '')) AS pos FROM src WHERE body <> ''),
steps AS (SELECT {keys}, body, n, pos, {stop('pos')} AS stop FROM lead UNION ALL SELECT {keys}, body, n, pos, {stop('pos')} FROM (SELECT {keys}, body, n, greatest(pos + 1, stop - 140) AS pos FROM steps WHERE stop < n)),
cut AS (SELECT {keys}, pos, substr(body, pos + 1, stop - pos) AS piece FROM steps), kept AS (SELECT *, regexp_replace(piece, '^{GAP}+', '') AS lefty FROM cut), made AS (SELECT *, regexp_replace(lefty, '{GAP}+$', '') AS excerpt FROM kept)
SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY pos) - 1 AS INT) AS chunk_no, CAST(pos + length(piece) - length(lefty) AS INT) AS span_start, CAST(pos + length(piece) - length(lefty) + length(excerpt) AS INT) AS span_end, excerpt, sha256(excerpt) AS sha256 FROM made WHERE excerpt <> ''"""


CHUNKS = chunk_sql("SELECT doc_id, 1 AS page, text FROM documents", "doc_id, page")
BUILT = f"""SELECT doc_id, page, sha256, chunk_no, span_start, span_end, excerpt, concat_ws(':', 'text', page, span_start, span_end, sha256) AS locator, sha256(doc_id || '|' || concat_ws(':', 'text', page, span_start, span_end, sha256)) AS evidence_id
 FROM ({CHUNKS}) QUALIFY row_number() OVER (PARTITION BY doc_id, page, sha256 ORDER BY chunk_no) = 1"""


@query(CHUNKS)
def f24_chunks(t):
    return evidence.chunks(pages(t))


@query(BUILT)
def a08_build_evidence(t):
    return evidence.build_evidence(evidence.chunks(pages(t)))


@query(chunk_sql(f"SELECT doc_id, page, run, text FROM ({layout_queries.RUNS}) WHERE doc_id % 9 > 0 UNION ALL SELECT doc_id, 1, 0, text FROM documents WHERE doc_id % 9 = 0", "doc_id, page, run"))
def w04_chunk_runs(t):
    runs = layout.block_runs(layout_queries.roles(t).where("doc_id % 9 > 0"))
    return evidence.chunk_runs(runs, pages(t).withColumn("has_blocks", F.col("doc_id") % 9 > 0))


@query(f"""SELECT doc_id, chunk_no, reason, reason IS NULL AS ok FROM (SELECT e.doc_id, e.chunk_no, CASE WHEN e.doc_id % 11 = 0 THEN 'page missing' WHEN substr(CASE WHEN e.doc_id % 7 = 0 THEN 'x' || d.text ELSE d.text END, span_start + 1, span_end - span_start) <> excerpt THEN 'text differs' WHEN e.doc_id % 13 = 0 THEN 'hash differs' END AS reason
 FROM ({BUILT}) e JOIN documents d ON d.doc_id = e.doc_id)""")
def j14_verify_sources(t):
    made = evidence.build_evidence(evidence.chunks(pages(t))).withColumn("sha256", F.when(F.col("doc_id") % 13 == 0, "0").otherwise(F.col("sha256")))
    now = pages(t).where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x"), "text")).otherwise(F.col("text")))
    return evidence.verify_sources(made, now).select("doc_id", "chunk_no", "reason", "ok")


def visuals(t, changed=False):
    """Figures and tables as they were, or as they are when evidence of them is checked again."""
    k = F.col("fig_ord")
    rows = t("figures").select("doc_id", "page", "label", "fig_ord", F.when(k % 5 > 0, F.col("caption")).alias("caption"), F.concat(F.lit("p/"), k).alias("path"))
    if changed:
        rows = rows.where(k % 13 > 0).withColumn("caption", F.when(k % 3 == 0, F.concat("caption", F.lit("!"))).otherwise(F.col("caption")))
    figures = rows.where(k % 2 == 0).withColumn("figure_id", F.concat(F.lit("f"), k)).withColumn("sha256", F.sha2(F.coalesce("caption", F.lit("")).cast("binary"), 256))
    return figures, rows.where(k % 2 == 1).withColumn("table_id", F.concat(F.lit("t"), k))


VISUALS = """SELECT doc_id, page, evidence_type, label, excerpt, source_path, sha256, concat_ws(':', evidence_type, page, id, sha256) AS locator, sha256(doc_id || '|' || concat_ws(':', evidence_type, page, id, sha256)) AS evidence_id FROM (
 SELECT doc_id, page, CASE WHEN fig_ord % 2 = 0 THEN 'figure' ELSE 'table' END AS evidence_type, CASE WHEN fig_ord % 2 = 0 THEN 'f' ELSE 't' END || fig_ord AS id, coalesce(label, CASE WHEN fig_ord % 2 = 0 THEN 'f' ELSE 't' END || fig_ord) AS label, CASE WHEN fig_ord % 5 > 0 THEN caption END AS excerpt,
  'p/' || fig_ord AS source_path, sha256(CASE WHEN fig_ord % 2 = 0 THEN CASE WHEN fig_ord % 5 > 0 THEN caption ELSE '' END ELSE coalesce(CASE WHEN fig_ord % 5 > 0 THEN caption END, label, 't' || fig_ord) END) AS sha256 FROM {figures})"""


@query(VISUALS)
def a08_visual_evidence(t):
    figures, tables = visuals(t)
    return evidence.figure_evidence(figures).unionByName(evidence.table_evidence(tables))


NOW = """SELECT doc_id, page, label, fig_ord, CASE WHEN fig_ord % 5 > 0 THEN CASE WHEN fig_ord % 3 = 0 THEN caption || '!' ELSE caption END END AS caption FROM {figures} WHERE fig_ord % 13 > 0"""


@query(f"""WITH n AS ({NOW}), f AS (SELECT 'p/' || fig_ord AS source_path, sha256(coalesce(caption, '')) AS now FROM n WHERE fig_ord % 2 = 0), b AS (SELECT doc_id, page, label, sha256(coalesce(caption, label)) AS now FROM n WHERE fig_ord % 2 = 1 AND label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, page, label ORDER BY fig_ord) = 1)
SELECT e.source_path, CASE WHEN coalesce(f.now, b.now) IS NULL THEN evidence_type || ' missing' WHEN coalesce(f.now, b.now) <> e.sha256 THEN 'hash differs' END AS reason FROM ({VISUALS}) e LEFT JOIN f ON evidence_type = 'figure' AND f.source_path = e.source_path LEFT JOIN b ON evidence_type = 'table' AND b.doc_id = e.doc_id AND b.page = e.page AND b.label = e.label""")
def j14_verify_visuals(t):
    """Tables that share page and label, tables without a label, and changed or vanished visuals."""
    figures, tables = visuals(t)
    made = evidence.figure_evidence(figures).unionByName(evidence.table_evidence(tables))
    now_figures, now_tables = visuals(t, changed=True)
    return evidence.verify_visuals(made, now_figures, now_tables.withColumn("ord", F.col("fig_ord"))).select("source_path", "reason")


TOPIC = "Blue Rose of the method"
TYPES = "CASE evidence_id % 6 WHEN 0 THEN 'background' WHEN 1 THEN 'method' WHEN 2 THEN 'experiment' WHEN 3 THEN 'discussion' WHEN 4 THEN 'abstract' ELSE 'other' END"


def routed_sql(part: str) -> str:
    hits = " + ".join(f"2 * ((length(c) - length(replace(c, '{w}', ''))) // {len(w)})" for w in evidence.KEYWORDS[part])
    terms = " + ".join(f"CASE WHEN contains(c, '{w}') THEN 1 ELSE 0 END" for w in ("blue", "rose", "of", "the", "method"))
    prefers = ", ".join(f"'{x}'" for x in evidence.SECTION_PREFERENCES[part])
    bonus = {"problem": "page <= 2 THEN 4", "method": "page > 1 AND page < last THEN 2"}.get(part, "page >= greatest(1, last - 2) THEN 4")
    return f"""SELECT *, CAST({hits} + {terms} + CASE WHEN {TYPES} IN ({prefers}) THEN 3 ELSE 0 END + CASE WHEN {bonus} ELSE 0 END AS INT) AS score
 FROM (SELECT *, lower(coalesce(section, '') || ' ' || claim || ' ' || coalesce(excerpt, '')) AS c, coalesce(max(CASE WHEN evidence_type = 'text' THEN page END) OVER (PARTITION BY paper_id), 1) AS last FROM {{notes}})"""


ROUTED = routed_sql("experiment")


def routed(t):
    return evidence.routed(t("notes"), "experiment", TOPIC)


@query(" UNION ALL ".join(f"SELECT evidence_id, '{p}' AS part, score FROM ({routed_sql(p)})" for p in evidence.KEYWORDS))
def f25_routing_score(t):
    parts = [evidence.routed(t("notes"), p, TOPIC).select("evidence_id", F.lit(p).alias("part"), "score") for p in evidence.KEYWORDS]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT evidence_id, evidence_type AS type, page, section, substr(claim, 1, 900) AS claim, substr(coalesce(excerpt, ''), 1, 1000) AS excerpt FROM {notes}")
def p19_compact_evidence(t):
    return retrieve.compact_evidence(t("notes"))


@query(f"SELECT evidence_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, page, ord) AS rank FROM (SELECT * FROM ({ROUTED}) QUALIFY row_number() OVER (PARTITION BY paper_id, page ORDER BY score DESC, page, ord) <= 2)) WHERE rank <= 8")
def w05_select_text(t):
    return evidence.select_text(routed(t), 8).select("evidence_id", "rank")


@query(f"SELECT evidence_id, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, ord) AS rank FROM ({ROUTED}) WHERE evidence_type <> 'text' QUALIFY rank <= 5")
def k06_select_visuals(t):
    return evidence.select_visuals(routed(t), 5).select("evidence_id", "rank")


@query("SELECT evidence_id, evidence_type FROM {evidence} WHERE evidence_type <> 'table'")
def u05_evidence_pool(t):
    rows = t("evidence").select("evidence_id", "evidence_type")
    return evidence.evidence_pool(rows.where("evidence_type = 'text'"), rows.where("evidence_type = 'figure'"))


@query("""WITH x AS (SELECT evidence_id, p_partkey % 53 AS doc_id, p_partkey % 3 AS paper_id, 'f' || (p_partkey % 4) AS file_sha256 FROM (SELECT *, evidence_id AS p_partkey FROM {evidence})), d AS (SELECT DISTINCT paper_id AS doc_id, paper_id % 3 AS paper_id, 'f' || (paper_id % 2) AS file_sha256 FROM {evidence})
SELECT x.evidence_id, CASE WHEN d.paper_id IS NULL THEN 'no document' WHEN d.paper_id <> x.paper_id THEN 'paper differs' ELSE 'file differs' END AS violation FROM x LEFT JOIN d USING (doc_id) WHERE d.paper_id IS NULL OR d.paper_id <> x.paper_id OR d.file_sha256 <> x.file_sha256""")
def j15_check_links(t):
    e = t("evidence")
    rows = e.select("evidence_id", (F.col("evidence_id") % 53).alias("doc_id"), (F.col("evidence_id") % 3).alias("paper_id"), F.concat(F.lit("f"), F.col("evidence_id") % 4).alias("file_sha256"))
    docs = e.select(F.col("paper_id").alias("doc_id"), (F.col("paper_id") % 3).alias("paper_id"), F.concat(F.lit("f"), F.col("paper_id") % 2).alias("file_sha256")).distinct()
    return evidence.check_links(rows, docs).select("evidence_id", "violation")


@query("""SELECT p.paper_id, coalesce(string_agg(evidence_id::VARCHAR, ',' ORDER BY ord) FILTER (WHERE evidence_type = 'text'), '') AS texts, coalesce(string_agg(evidence_id::VARCHAR, ',' ORDER BY ord) FILTER (WHERE evidence_type = 'figure'), '') AS figures,
 coalesce(string_agg(evidence_id::VARCHAR, ',' ORDER BY ord) FILTER (WHERE evidence_type = 'table'), '') AS tables FROM (SELECT c_custkey AS paper_id FROM customer) p LEFT JOIN {evidence} e ON e.paper_id = p.paper_id GROUP BY p.paper_id""")
def j26_paper_detail(t):
    out = evidence.paper_detail(t("customer").select(F.col("c_custkey").cast("long").alias("paper_id")), t("evidence"))
    return out.select("paper_id", *[F.array_join(c, ",").alias(c) for c in ("texts", "figures", "tables")])


# evaluation


@query("""WITH c AS (SELECT count_if(relevant AND predicted) AS tp, count_if(NOT relevant AND predicted) AS fp, count_if(relevant AND NOT predicted) AS fn, count_if(NOT relevant AND NOT predicted) AS tn FROM {gold})
SELECT *, round_even(tp / (tp + fp), 6) AS precision, round_even(tp / (tp + fn), 6) AS recall, round_even(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def a27_confusion(t):
    return evals.confusion(t("gold"))


@query("""WITH s AS (SELECT category, CASE WHEN relevant = predicted THEN 1.0 ELSE 0.5 END AS score FROM {gold})
SELECT category, count(*) AS n, round_even(avg(score), 6) AS mean_score, round_even(avg(CASE WHEN score >= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM s GROUP BY ROLLUP (category)""")
def a29_run_aggregate(t):
    scored = t("gold").withColumn("score", F.when(F.col("relevant") == F.col("predicted"), 1.0).otherwise(0.5))
    return evals.run_aggregate(scored.withColumn("passed", F.col("score") >= 0.8))


@query("SELECT gold, count_if(gold = status) AS correct, count(*) AS total, round_even(count_if(gold = status) / count(*), 3) AS accuracy FROM {checks} GROUP BY ROLLUP (gold)")
def a30_class_accuracy(t):
    return evals.class_accuracy(t("checks"), "gold", "status")


@query("""WITH e AS (SELECT paper_id, list(DISTINCT evidence_id % 12) FILTER (WHERE evidence_type <> 'text') AS a, list(DISTINCT evidence_id % 12) FILTER (WHERE evidence_type <> 'figure') AS b FROM {evidence} GROUP BY 1), s AS (SELECT paper_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM e)
SELECT paper_id, round_even(len(list_intersect(a, b)) / len(b), 6) AS precision, round_even(len(list_intersect(a, b)) / len(a), 6) AS recall, round_even(2 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS f1, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS subset FROM s WHERE len(a) > 0 AND len(b) > 0""")
def a26_set_f1(t):
    key = F.col("evidence_id") % 12
    sets = t("evidence").groupBy("paper_id").agg(F.collect_set(F.when(F.col("evidence_type") != "text", key)).alias("a"), F.collect_set(F.when(F.col("evidence_type") != "figure", key)).alias("b")).where("size(a) > 0 AND size(b) > 0")
    scored = sets.withColumn("s", evals.set_f1(F.col("a"), F.col("b")))
    return scored.select("paper_id", *[F.bround(F.col("s")[c], 6).alias(c) for c in ("precision", "recall", "f1")], evals.is_subset(F.col("a"), F.col("b")).alias("subset"))


@query("SELECT relevant, count(*) AS n FROM {gold} GROUP BY 1")
def u03_split(t):
    yes, no = evals.split(t("gold"), F.col("relevant"))
    return yes.unionByName(no).groupBy("relevant").agg(F.count(F.lit(1)).alias("n"))
