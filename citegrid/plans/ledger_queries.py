"""Queries of ledgers, progress, usage and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger, metrics, resolve
from ..sources.scratch import written
from .registry import query

LEDGER = "SELECT * FROM {work_items} QUALIFY row_number() OVER (PARTITION BY project_id, run_scope, item_key ORDER BY updated_at DESC, ord DESC) = 1"


def items(t):
    return resolve.latest_per_key(t("work_items"), ledger.ITEM, ["updated_at", "ord"])


@query(f"""WITH l AS ({LEDGER}), j AS (SELECT i.*, l.input_hash AS h, l.status, l.attempts AS a FROM {{work_inputs}} i LEFT JOIN l USING (project_id, run_scope, item_key)),
d AS (SELECT *, CASE WHEN h IS NULL THEN 'run' WHEN h <> input_hash THEN 'conflict' WHEN status = 'completed' THEN 'reuse' ELSE 'run' END AS decision FROM j)
SELECT project_id, run_scope, item_key, decision, CASE WHEN decision = 'run' THEN coalesce(a, 0) + 1 ELSE coalesce(a, 0) END AS attempts FROM d""")
def l01_plan_work(t):
    return ledger.plan_work(t("work_inputs"), items(t)).select(*ledger.ITEM, "decision", "attempts")


@query(f"""WITH l AS ({LEDGER}) SELECT project_id, run_scope, item_key, CASE WHEN l.input_hash IS NULL THEN 'run' WHEN l.input_hash <> i.input_hash THEN 'reset' WHEN status = 'completed' THEN 'reuse' ELSE 'run' END AS decision,
 CASE WHEN l.input_hash = i.input_hash AND status = 'completed' THEN attempts ELSE coalesce(attempts, 0) + 1 END AS attempts FROM {{work_inputs}} i LEFT JOIN l USING (project_id, run_scope, item_key)""")
def l01_plan_replaced(t):
    """Changed inputs replace what was there: the attempt is one more, not the first."""
    return ledger.plan_work(t("work_inputs"), items(t), replace_changed=True).select(*ledger.ITEM, "decision", "attempts")


@query(f"""WITH l AS ({LEDGER}), r AS (SELECT project_id, run_scope, item_key, 'completed' AS status, attempts + 1 AS attempts FROM l WHERE status = 'running')
SELECT project_id, run_scope, item_key, coalesce(r.status, l.status) AS status, coalesce(r.attempts, l.attempts) AS attempts FROM l LEFT JOIN r USING (project_id, run_scope, item_key)""")
def l02_finish_work(t):
    have = written(items(t), "ledger")  # made once, and its sorts are not held beside those of the upsert
    done = have.where("status = 'running'").withColumn("status", F.lit("completed")).withColumn("attempts", F.col("attempts") + 1)
    return ledger.finish_work(have, done).select(*ledger.ITEM, "status", "attempts")


@query(f"WITH l AS ({LEDGER}) SELECT project_id, run_scope, item_key FROM l WHERE NOT (starts_with(run_scope, 'scope1') AND item_key IN ('k1', 'k5', 'k9') AND project_id % 2 = 0)")
def l03_invalidate(t):
    have = items(t)
    chosen = have.where("item_key IN ('k1', 'k5', 'k9') AND project_id % 2 = 0").select("project_id", "item_key").distinct()
    return ledger.invalidate(have, chosen, "scope1").select(*ledger.ITEM)


@query("SELECT 'jobs' AS name, count(*) AS n FROM {jobs} WHERE project_id % 10 <> 0 UNION ALL SELECT 'usage', count(*) FROM {usage} WHERE project_id NOT IN (SELECT project_id FROM {projects} WHERE project_id % 10 = 0)")
def l04_reset_project(t):
    left = ledger.reset_project({"jobs": t("jobs"), "usage": t("usage")}, t("projects").where("project_id % 10 = 0"))
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return parts[0].unionByName(parts[1])


@query(f"SELECT project_id, run_scope, item_key, attempts FROM ({LEDGER}) WHERE status = 'completed' AND attempts > 1")
def l05_recovered(t):
    return ledger.recovered(items(t)).select(*ledger.ITEM, "attempts")


PROGRESS = "SELECT CAST(c_custkey AS BIGINT) AS project_id, CASE WHEN c_custkey % 3 > 0 THEN 'label ' || c_custkey END AS label, CAST(c_custkey % 9 AS INT) AS total, CAST(c_custkey % 5 AS INT) AS done FROM customer"
UPDATES = "SELECT CAST(c_custkey + 50 AS BIGINT) AS project_id, CASE WHEN c_custkey % 2 = 0 THEN 'new' END AS label, CASE WHEN c_custkey % 4 = 0 THEN 7 END AS total, CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey % 6 AS INT) END AS done FROM customer"


def _progress(t, strict):
    c = F.col("c_custkey")
    old = t("customer").select(c.cast("long").alias("project_id"), F.when(c % 3 > 0, F.concat(F.lit("label "), c)).alias("label"), (c % 9).cast("int").alias("total"), (c % 5).cast("int").alias("done"))
    new = t("customer").select((c + 50).cast("long").alias("project_id"), F.when(c % 2 == 0, "new").alias("label"), F.when(c % 4 == 0, 7).alias("total"), F.when(c % 5 > 0, (c % 6).cast("int")).alias("done"))
    return ledger.upsert_progress(old, new, ["project_id"], strict)


@query(f"SELECT project_id, coalesce(u.label, o.label) AS label, coalesce(u.total, o.total) AS total, coalesce(u.done, o.done, 0) AS done FROM ({PROGRESS}) o FULL JOIN ({UPDATES}) u USING (project_id)")
def l06_upsert_progress(t):
    return _progress(t, False)


@query(f"SELECT project_id, coalesce(u.label, o.label) AS label, coalesce(u.total, o.total) AS total, CASE WHEN u.is_new THEN coalesce(u.done, 0) ELSE o.done END AS done FROM ({PROGRESS}) o FULL JOIN (SELECT *, true AS is_new FROM ({UPDATES})) u USING (project_id)")
def l06_upsert_progress_strict(t):
    return _progress(t, True)


@query("SELECT evidence_id, CASE WHEN evidence_id % 3 = 0 THEN source WHEN note LIKE '自动复核：%' THEN 'auto_visual_verifier' WHEN note LIKE '图文一致：%' THEN 'auto_consistency' ELSE 'human' END AS source FROM {reviews}")
def l09_backfill_sources(t):
    rows = t("reviews").withColumn("source", F.when(F.col("evidence_id") % 3 == 0, F.col("source")))
    return ledger.backfill_sources(rows).select("evidence_id", "source")


@query("""WITH a AS (SELECT o_orderkey AS analysis_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status, o_orderkey % 3 AS t, CASE WHEN o_orderkey % 2 = 0 THEN 'step ' || (o_orderkey % 5) END AS step FROM orders), n AS (SELECT l_orderkey AS analysis_id, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY 1)
SELECT analysis_id, CAST(CASE WHEN t = 0 THEN coalesce(n, 0) ELSE t END AS BIGINT) AS total_visuals, CAST(CASE WHEN t = 0 AND status <> 'failed' THEN coalesce(n, 0) ELSE 0 END AS BIGINT) AS completed_visuals,
 CASE WHEN t = 0 AND n IS NOT NULL AND status = 'completed' THEN 'visuals_completed' WHEN t = 0 AND n IS NOT NULL AND status = 'failed' THEN 'visuals_failed' ELSE step END AS current_step FROM a LEFT JOIN n USING (analysis_id)""")
def l09_backfill_visuals(t):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    rows = t("orders").select(k.alias("analysis_id"), status.alias("status"), (k % 3).cast("long").alias("total_visuals"), F.lit(0).cast("long").alias("completed_visuals"), F.when(k % 2 == 0, F.concat(F.lit("step "), k % 5)).alias("current_step"))
    regions = t("lineitem").where("l_linenumber > 2").select(F.col("l_orderkey").alias("analysis_id"))
    return ledger.backfill_visuals(rows, regions).select("analysis_id", "total_visuals", "completed_visuals", "current_step")


@query("""SELECT d.doc_id FROM documents d WHERE d.doc_id % 5 <> 4 AND NOT EXISTS (SELECT 1 FROM documents a WHERE a.doc_id % 3 = 0 AND a.doc_id % 4 <> 0 AND a.doc_id = d.doc_id AND sha256(a.text) = sha256(d.text))""")
def j01_pending_documents(t):
    docs = t("documents").select("doc_id", F.when(F.col("doc_id") % 5 != 4, F.col("doc_id")).otherwise(-1).alias("paper_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    papers = t("documents").select(F.col("doc_id").alias("paper_id"))
    analyses = docs.where("doc_id % 3 = 0").select("doc_id", "sha256", F.when(F.col("doc_id") % 4 == 0, 2).otherwise(3).alias("pipeline_version"), F.lit("completed").alias("status"))
    return ledger.pending_documents(docs, papers, analyses).select("doc_id")


JOB = "SELECT * FROM {jobs} QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, job_id DESC) = 1"


@query(f"SELECT project_id, job_id, status FROM ({JOB})")
def a06_latest_job(t):
    return ledger.latest_job(t("jobs")).select("project_id", "job_id", "status")


@query(f"SELECT project_id, title FROM {{projects}} WHERE status = 'running' AND project_id IN (SELECT project_id FROM ({JOB}) WHERE status = 'failed')")
def j19_zombie_projects(t):
    return ledger.zombie_projects(t("projects"), t("jobs")).select("project_id", "title")


RESULTS = "SELECT request_id AS project_id, ord % 4 AS revision, stable_id FROM {papers}"


@query(f"WITH r AS ({RESULTS}), m AS (SELECT project_id, max(revision) AS revision FROM r GROUP BY 1) SELECT p.request_id AS project_id, p.stable_id FROM {{papers}} p JOIN r ON r.project_id = p.request_id AND r.stable_id = p.stable_id JOIN m ON m.project_id = r.project_id AND m.revision = r.revision")
def j20_current_papers(t):
    papers = t("papers").select(F.col("request_id").alias("project_id"), "stable_id", (F.col("ord") % 4).alias("revision"))
    return ledger.current_papers(papers.drop("revision"), papers, papers.select("project_id", "revision"))


@query("""WITH g AS (SELECT o_orderkey AS id, o_custkey AS project_id, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey END AS paper_id FROM orders), s AS (SELECT DISTINCT o_custkey AS project_id, o_orderkey AS paper_id FROM orders WHERE o_orderkey % 5 = 0)
SELECT g.id, g.paper_id, p.title FROM g LEFT JOIN (SELECT ord, title FROM {papers}) p ON p.ord = g.paper_id WHERE g.paper_id IS NULL OR EXISTS (SELECT 1 FROM s WHERE s.project_id = g.project_id AND s.paper_id = g.paper_id)""")
def j21_progress_board(t):
    k = F.col("o_orderkey")
    progress = t("orders").select(k.alias("id"), F.col("o_custkey").alias("project_id"), F.when(k % 7 > 0, k).alias("paper_id"))
    chosen = t("orders").where(k % 5 == 0).select(F.col("o_custkey").alias("project_id"), k.alias("paper_id"))
    papers = t("papers").select(F.col("ord").alias("paper_id"), "title")
    return ledger.progress_board(progress, chosen, papers).select("id", "paper_id", "title")


PART = "['problem', 'method', 'experiment', 'critical', 'overview'][1 + {k} % 5]"


@query(f"""WITH s AS (SELECT DISTINCT o_custkey AS project_id, o_orderkey % 3 AS paper_id FROM orders), p AS (SELECT unnest(['problem', 'method', 'experiment', 'critical', 'overview']) AS part),
w AS (SELECT o_custkey AS project_id, o_orderkey % 3 AS paper_id, {PART.format(k='o_orderkey')} AS part, o_orderkey AS k, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3, o_orderkey % 5 ORDER BY o_orderdate DESC, o_orderkey) = 1),
c AS (SELECT *, nullif(CASE WHEN status = 'F' THEN CASE part WHEN 'problem' THEN CASE WHEN k % 2 = 0 THEN 'core_problem=P' || k ELSE '' END WHEN 'method' THEN 'methods=M' || k || CASE WHEN k % 2 = 0 THEN ';mechanisms=N' || k ELSE '' END WHEN 'overview' THEN 'overview=O' || k END END, '') AS content FROM w),
b AS (SELECT o_custkey AS project_id, (o_orderkey + 1) % 3 AS paper_id, {PART.format(k='(o_orderkey // 3)')} AS part, CASE WHEN o_orderkey % 2 = 0 THEN 'running' ELSE 'failed' END AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, (o_orderkey + 1) % 3, (o_orderkey // 3) % 5 ORDER BY o_orderkey DESC) = 1)
SELECT s.project_id, s.paper_id, p.part, coalesce(t.title, 'untitled') AS paper_title, CASE WHEN c.content IS NOT NULL THEN 'completed' ELSE coalesce(b.status, 'queued') END AS status, coalesce(c.content, '') AS content, CASE WHEN s.paper_id = 0 AND p.part = 'method' THEN 'ask ' || s.project_id END AS note
FROM s CROSS JOIN p LEFT JOIN c ON c.project_id = s.project_id AND c.paper_id = s.paper_id AND c.part = p.part LEFT JOIN b ON b.project_id = s.project_id AND b.paper_id = s.paper_id AND b.part = p.part LEFT JOIN {{papers}} t ON t.ord = s.paper_id""")
def j22_analysis_blocks(t):
    k, project = F.col("o_orderkey"), F.col("o_custkey").alias("project_id")
    part = lambda i: F.get(F.array(*map(F.lit, ledger.PART_FIELDS)), (i % 5).cast("int")).alias("part")
    of = lambda name, letter, test=None: (F.lit(name), F.concat(F.lit(letter), k) if test is None else F.when(test, F.concat(F.lit(letter), k)).otherwise(""))
    content = F.create_map(*of("core_problem", "P", k % 2 == 0), *of("methods", "M"), *of("mechanisms", "N", k % 2 == 0), *of("overview", "O"), F.lit("limitations"), F.lit(None).cast("string"))
    rows, paper = t("orders"), (k % 3).alias("paper_id")
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status")
    worked = rows.select(project, paper, part(k), status, content.alias("content"), F.col("o_orderdate").alias("updated_at"), k.alias("ord"))
    board = rows.select(project, ((k + 1) % 3).alias("paper_id"), part(F.floor(k / 3)), F.when(k % 2 == 0, "running").otherwise("failed").alias("status"), k.alias("ord"))
    notes = rows.select(project).distinct().select("project_id", F.lit(0).cast("long").alias("paper_id"), F.lit("method").alias("part"), F.concat(F.lit("ask "), "project_id").alias("note"))
    papers = t("papers").select(F.col("ord").alias("paper_id"), "title")
    out = ledger.analysis_blocks(rows.select(project, paper).distinct(), worked, board, papers, notes)
    text = F.array_join(F.transform(F.map_entries("content"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return out.withColumn("content", F.coalesce(text, F.lit("")))


@query("SELECT paper_ord, stable_id FROM {oa_papers} WHERE paper_ord % 4 = 1")
def j24_missing_documents(t):
    states = t("oa_papers").select("paper_ord", F.when(F.col("paper_ord") % 4 == 1, "awaiting_upload").otherwise("acquired").alias("status"))
    return ledger.missing_documents(t("oa_papers"), states).select("paper_ord", "stable_id")


@query("""SELECT claim_ord, concat_ws(',', CASE WHEN kind = 'supported' AND coalesce(n, 0) = 0 THEN 'supported_has_evidence' END, CASE WHEN kind = 'inference' AND coalesce(n, 0) > 0 THEN 'inference_has_none' END, CASE WHEN field_no > 6 THEN 'field_known' END) AS violations
FROM {claims} LEFT JOIN (SELECT claim_ord, count(*) AS n FROM {refs} GROUP BY 1) USING (claim_ord)""")
def p06_violations(t):
    sizes = t("refs").groupBy("claim_ord").agg(F.count(F.lit(1)).alias("n"))
    rows = t("claims").join(sizes, "claim_ord", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rules = {"supported_has_evidence": "kind <> 'supported' OR n > 0", "inference_has_none": "kind <> 'inference' OR n = 0", "field_known": "field_no <= 6"}
    return ledger.violations(rows, rules).select("claim_ord", F.array_join("violations", ",").alias("violations"))


@query("SELECT project_id, item_key, count(*) AS n_rows FROM {work_items} GROUP BY ALL HAVING count(*) > 1")
def p22_audit_unique(t):
    return ledger.audit_unique(t("work_items"), ["project_id", "item_key"])


@query("SELECT claim_ord, pos, evidence_id FROM {refs} WHERE evidence_id NOT IN (SELECT evidence_id FROM {evidence} WHERE page <> 4)")
def p22_audit_reference(t):
    return ledger.audit_reference(t("refs"), t("evidence").where("page <> 4"), "evidence_id", "evidence_id").select("claim_ord", "pos", "evidence_id")


@query("""SELECT 'item_once' AS rule, project_id || '|' || item_key AS key, count(*) AS n_rows FROM {work_items} GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'known_evidence', CAST(evidence_id AS VARCHAR), count(*) FROM {refs} WHERE evidence_id NOT IN (SELECT evidence_id FROM {evidence} WHERE page <> 4) GROUP BY ALL
UNION ALL SELECT 'job_status', status, count(*) FROM {jobs} WHERE status NOT IN ('queued', 'running', 'completed') GROUP BY ALL
UNION ALL SELECT 'one_active_job', CAST(project_id AS VARCHAR), count(*) FROM {jobs} WHERE status IN ('queued', 'running') GROUP BY ALL HAVING count(*) > 1""")
def p22_audit_constraints(t):
    rules = [
        ledger.Constraint("item_once", "unique", "items", ("project_id", "item_key")), ledger.Constraint("known_evidence", "reference", "refs", ("evidence_id",), "evidence", ("evidence_id",)),
        ledger.Constraint("job_status", "allowed", "jobs", ("status",), values=("queued", "running", "completed")), ledger.Constraint("one_active_job", "at_most_one", "jobs", ("project_id",), active="status IN ('queued', 'running')"),
    ]
    return ledger.audit_constraints({"items": t("work_items"), "refs": t("refs"), "evidence": t("evidence").where("page <> 4"), "jobs": t("jobs")}, rules)


@query("SELECT id, event_type FROM {traces} WHERE event_type = 'click' AND success ORDER BY created_at, id LIMIT 50 OFFSET 20")
def p07_list_traces(t):
    return metrics.list_traces(t("traces"), "click", True, 50, 20).select("id", "event_type")


@query("SELECT project_id, count(*) AS total, count_if(success) AS succeeded, count_if(NOT success) AS failed, round_even(count_if(success) / count(*), 6) AS success_rate, round_even(avg(latency_ms), 6) AS avg_latency_ms, count_if(event_type = 'recovery') AS recoveries FROM {traces} GROUP BY 1")
def a12_trace_metrics(t):
    return metrics.trace_metrics(t("traces"))


@query("SELECT event_type, count(*) AS n FROM {traces} GROUP BY 1")
def a12_traces_by_type(t):
    return metrics.traces_by_type(t("traces"))


@query("SELECT project_id, count(*) AS total, count_if(status = 'completed') AS completed, count_if(status = 'failed') AS failed, count_if(status = 'running') AS running, count_if(status = 'completed' AND attempts > 1) AS recovered FROM {work_items} GROUP BY 1")
def a13_work_item_metrics(t):
    return metrics.work_item_metrics(t("work_items"))


@query("SELECT project_id, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS calls, count_if(kind = 'vision') AS vision_calls, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS first_at FROM {usage} GROUP BY 1")
def a14_usage_totals(t):
    return metrics.usage_totals(t("usage")).withColumn("first_at", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH a AS (SELECT o_custkey AS project_id, o_custkey * 20 + o_orderkey % 4 AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status, o_orderkey % 9 AS page_count, o_orderkey % 5 AS total_visuals, o_orderkey % 3 AS completed_visuals, 'step ' || (o_orderkey % 6) AS current_step, o_orderkey % 7 AS updated_at FROM orders),
g AS (SELECT project_id, project_id * 20 + job_id % 6 AS doc_id FROM {jobs} WHERE job_id % 2 = 0), k AS (SELECT project_id FROM a UNION SELECT project_id FROM g)
SELECT k.project_id, CAST(coalesce((SELECT sum(n) FROM (SELECT doc_id, max(page_count) AS n FROM a WHERE a.project_id = k.project_id AND status = 'completed' GROUP BY doc_id)), 0) AS BIGINT) AS analyzed_pages,
 (SELECT count(*) FROM g WHERE g.project_id = k.project_id) AS analyzed_visuals, CAST(coalesce(p.total_visuals, 0) AS BIGINT) AS total_visuals, CAST(coalesce(p.completed_visuals, 0) AS BIGINT) AS completed_visuals, p.current_step
FROM k LEFT JOIN (SELECT project_id, sum(total_visuals) AS total_visuals, sum(completed_visuals) AS completed_visuals, max(current_step) AS current_step FROM a WHERE updated_at = (SELECT max(l.updated_at) FROM a l WHERE l.doc_id = a.doc_id) GROUP BY 1) p ON p.project_id = k.project_id""")
def a15_analysis_metrics(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    rows = t("orders").select(c.cast("long").alias("project_id"), (c * 20 + k % 4).alias("doc_id"), status.alias("status"), (k % 9).alias("page_count"), (k % 5).alias("total_visuals"), (k % 3).alias("completed_visuals"), F.concat(F.lit("step "), k % 6).alias("current_step"), (k % 7).alias("updated_at"))
    regions = t("jobs").where("job_id % 2 = 0").select("project_id", (F.col("project_id") * 20 + F.col("job_id") % 6).alias("doc_id"))
    return metrics.analysis_metrics(rows, regions)


@query("""WITH u AS (SELECT project_id, sum(tokens) AS tk, count_if(kind = 'vision') AS vn, min(created_at) AS f FROM {usage} GROUP BY 1), w AS (SELECT DISTINCT project_id, project_id * 10 AS bt, project_id % 5 AS bv, project_id % 4 AS q, project_id % 11 = 0 AS g, project_id % 13 = 0 AS p FROM {projects} WHERE project_id % 3 > 0),
m AS (SELECT *, greatest(0, epoch_us(TIMESTAMP '2024-01-02 12:00:00') - epoch_us(CAST(f AS TIMESTAMP))) AS us FROM w FULL JOIN u USING (project_id)),
j AS (SELECT *, greatest(0, coalesce(tk, 0) - coalesce(bt, 0)) AS tokens_used, greatest(0, coalesce(vn, 0) - coalesce(bv, 0)) AS vision_used, CASE WHEN q = 1 THEN 90.0 WHEN q = 2 THEN 0.0 ELSE CAST(coalesce(us // 60 + CASE WHEN us % 60 > 30 OR us % 60 = 30 AND us // 60 % 2 = 1 THEN 1 ELSE 0 END, 0) AS DOUBLE) / 1000000 END AS minutes_used FROM m),
r AS (SELECT *, CASE WHEN tokens_used >= 300000 THEN 'tokens' WHEN vision_used >= 15 THEN 'vision' WHEN minutes_used >= 120 THEN 'minutes' END AS reason FROM j)
SELECT project_id, CAST(tokens_used AS BIGINT) AS tokens_used, vision_used, minutes_used, reason, CASE WHEN p THEN 'user_paused' WHEN g THEN 'gate_open' WHEN reason IS NOT NULL THEN 'exceeded' ELSE 'within' END AS state FROM r""")
def a16_budget_state(t):
    """Two thirds of the projects have a window; it began at a known time, an unreadable one, or (blank, null) with the first usage."""
    p = F.col("project_id")
    since = F.when(p % 4 == 1, "2024-01-02T10:30:00").when(p % 4 == 2, "soon").when(p % 4 == 3, "")
    windows = t("projects").where(p % 3 > 0).select("project_id").distinct().select("project_id", (p * 10).alias("base_tokens"), (p % 5).alias("base_vision"), since.alias("since"), (p % 11 == 0).alias("gate_open"), (p % 13 == 0).alias("paused"))
    return metrics.budget_state(t("usage"), windows, 300000, 15, 120.0, "2024-01-02 12:00:00")


@query("SELECT id, project_id, CAST(running_tokens AS BIGINT) AS running_tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY project_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS running_tokens FROM {usage}) WHERE running_tokens >= 100000 AND running_tokens - tokens < 100000")
def w09_budget_crossings(t):
    return metrics.budget_crossings(t("usage"), 100000).select("id", "project_id", "running_tokens")
