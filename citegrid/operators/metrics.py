"""Usage, traces, budgets and progress metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_traces(traces: DataFrame, event_type: str | None = None, success: bool | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    out = traces
    if event_type is not None:
        out = out.where(F.col("event_type") == event_type)
    if success is not None:
        out = out.where(F.col("success") == success)
    return out.orderBy("created_at", "id").offset(offset).limit(limit)


def trace_metrics(traces: DataFrame, by: str = "project_id") -> DataFrame:
    """Totals, failures, rate and mean latency (nulls aside) of each project."""
    return traces.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"),
        F.bround(F.try_divide(F.count_if("success").cast("double"), F.count(F.lit(1)).cast("double")), 6).alias("success_rate"),
        F.bround(F.avg("latency_ms"), 6).alias("avg_latency_ms"), F.count_if(F.col("event_type") == "recovery").alias("recoveries"),
    )


def traces_by_type(traces: DataFrame) -> DataFrame:
    return traces.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def work_item_metrics(items: DataFrame) -> DataFrame:
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return items.groupBy("project_id").agg(F.count(F.lit(1)).alias("total"), of("completed"), of("failed"), of("running"), F.count_if((F.col("status") == "completed") & (F.col("attempts") > 1)).alias("recovered"))


def usage_totals(usage: DataFrame) -> DataFrame:
    return usage.groupBy("project_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("calls"), F.count_if(F.col("kind") == "vision").alias("vision_calls"), F.min("created_at").alias("first_at"))


def review_counts(reviews: DataFrame) -> DataFrame:
    return reviews.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("confirmed", "doubted", "excluded", "unreviewed")])


def elapsed_minutes(since: Column, as_of: Column) -> Column:
    """Minutes from an ISO text (no zone: UTC) to a time; blank or unreadable: 0; never below 0."""
    at = F.try_to_timestamp(F.nullif(F.trim(since), F.lit("")))
    return F.coalesce(F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(60_000_000.0)), F.lit(0.0))


def budget_state(usage: DataFrame, windows: DataFrame, tokens: int, vision: int, minutes: float, as_of: str) -> DataFrame:
    """Usage of each project's window against its limits: state and reason.

    windows: project_id, base_tokens, base_vision, since (ISO text), gate_open, paused; a project with usage and no window
    has an empty one. A window without since began with the project's first usage. A pause by the user wins, an open gate
    keeps its state.
    """
    first = F.min(F.col("created_at").cast("timestamp"))
    totals = usage.groupBy("project_id").agg(F.sum("tokens").alias("_tokens"), F.count_if(F.col("kind") == "vision").alias("_vision"), first.alias("_first"))
    joined = windows.join(totals, "project_id", "full")
    over = lambda total, base: F.greatest(F.lit(0), F.coalesce(total, F.lit(0)) - F.coalesce(base, F.lit(0)))
    now = F.to_timestamp(F.lit(as_of))
    from_first = F.coalesce(F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros("_first")) / F.lit(60_000_000.0)), F.lit(0.0))
    spent = F.when(F.coalesce("since", F.lit("")) == "", from_first).otherwise(elapsed_minutes(F.col("since"), now))
    rows = joined.withColumn("tokens_used", over("_tokens", "base_tokens")).withColumn("vision_used", over("_vision", "base_vision")).withColumn("minutes_used", F.bround(spent, 6))
    reason = F.when(F.col("tokens_used") >= tokens, "tokens").when(F.col("vision_used") >= vision, "vision").when(F.col("minutes_used") >= minutes, "minutes")
    state = F.when(F.col("paused"), "user_paused").when(F.col("gate_open"), "gate_open").when(F.col("reason").isNotNull(), "exceeded").otherwise("within")
    return rows.withColumn("reason", reason).withColumn("state", state).select("project_id", "tokens_used", "vision_used", "minutes_used", "reason", "state")


def budget_crossings(usage: DataFrame, tokens: int, bucket: str = "day") -> DataFrame:
    """The usage rows of each project at which its running tokens reach the limit.

    Tokens are summed by project and bucket of time first; the running sum goes over buckets, and rows are ordered
    within a bucket only, so that a project with very many rows is spread over its buckets.
    """
    rows = usage.withColumn("_bucket", F.date_trunc(bucket, F.col("created_at").cast("timestamp")))
    sums = rows.groupBy("project_id", "_bucket").agg(F.sum("tokens").alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy("project_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select("project_id", "_bucket", F.coalesce(earlier, F.lit(0)).alias("_before"))
    inside = F.sum("tokens").over(Window.partitionBy("project_id", "_bucket").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0))
    running = rows.join(before, ["project_id", "_bucket"]).withColumn("running_tokens", F.col("_before") + inside).drop("_bucket", "_before")
    return running.where((F.col("running_tokens") >= tokens) & (F.col("running_tokens") - F.col("tokens") < tokens))


def analysis_metrics(analyses: DataFrame, regions: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Per project: analyzed_pages, analyzed_visuals, total_visuals, completed_visuals, current_step.

    Pages are those of each document's largest completed run, whichever run is latest; visuals and the step are those of
    the runs with a document's latest time (all of them where times are equal). With `documents`, of these only.
    """
    if documents is not None:
        chosen = documents.select("doc_id").distinct()
        analyses, regions = analyses.join(chosen, "doc_id", "left_semi"), regions.join(chosen, "doc_id", "left_semi")
    pages = analyses.where("status = 'completed'").groupBy("project_id", "doc_id").agg(F.max("page_count").alias("n")).groupBy("project_id").agg(F.sum("n").alias("analyzed_pages"))
    latest = analyses.groupBy("doc_id").agg(F.max("updated_at").alias("updated_at"))
    progress = analyses.join(latest, ["doc_id", "updated_at"], "left_semi").groupBy("project_id").agg(*[F.sum(c).alias(c) for c in ("total_visuals", "completed_visuals")], F.max("current_step").alias("current_step"))
    counts = regions.groupBy("project_id").agg(F.count(F.lit(1)).alias("analyzed_visuals"))
    known = analyses.select("project_id").unionByName(regions.select("project_id")).distinct()
    out = known.join(pages, "project_id", "left").join(counts, "project_id", "left").join(progress, "project_id", "left")
    return out.select("project_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("analyzed_pages", "analyzed_visuals", "total_visuals", "completed_visuals")], "current_step")
