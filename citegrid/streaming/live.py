"""Streaming forms: request de-duplication, trace windows, the budget gate, and live tables.

Live tables are logs of batches: each micro-batch writes its rows under its own number, so that a repeated batch
overwrites itself, and readers take the latest row of each key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.resolve import latest_per_key


def dedup_requests(stream: DataFrame, ttl: str = "900 seconds", key: str = "request_key", ts: str = "ts") -> DataFrame:
    """The first of identical requests within the time to live."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def windowed_trace_metrics(stream: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Calls, failures and latency of each project and window; rows later than the delay are dropped."""
    span = F.window("created_at", window, slide) if slide else F.window("created_at", window)
    rows = stream.withWatermark("created_at", delay).groupBy(span.alias("w"), "project_id")
    out = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("success")).alias("failed"), F.sum("latency_ms").alias("latency_ms"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "project_id", "total", "failed", "latency_ms")


class BudgetGate(StatefulProcessor):
    """Per project: tokens and vision calls since the last acknowledgement; one event when a limit is reached.

    Rows: kind usage (tokens, vision) advances, kind ack starts anew and closes the gate. Rows of a micro-batch are taken
    in the order of their time and id, so micro-batches must come in that order too. A project's rows of one micro-batch are
    held at once; the stream's reader bounds them (maxFilesPerTrigger), whatever a project has in all. Most projects have a few
    rows in a micro-batch, so they are gone through as plain values: frames would cost a project more than its rows.
    """

    columns = ("created_at", "id", "kind", "tokens")

    def __init__(self, tokens: int, vision: int):
        self.limits = tokens, vision

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("budget", "tokens long, vision long, open boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        used, seen, is_open = self.state.get() if self.state.exists() else (0, 0, False)
        columns = [[v for part in parts for v in part] for parts in zip(*([part[c].to_numpy().tolist() for c in self.columns] for part in rows), strict=True)]
        events = []
        for _, i, kind, tokens in sorted(zip(*columns, strict=True), key=lambda r: r[:2]):
            if kind == "ack":
                used, seen, is_open = 0, 0, False
                continue
            used, seen = used + int(tokens), seen + (kind == "vision")
            if not is_open and (used >= self.limits[0] or seen >= self.limits[1]):
                events.append((key[0], i, "tokens" if used >= self.limits[0] else "vision", used, seen))
                is_open = True
        self.state.update((used, seen, is_open))
        if events:
            yield pd.DataFrame(events, columns=["project_id", "id", "reason", "tokens", "vision"])

    def close(self) -> None:
        pass


def budget_gate(stream: DataFrame, tokens: int, vision: int) -> DataFrame:
    """Gate events of a stream of (project_id, id, created_at, kind, tokens); needs the RocksDB state store."""
    schema = "project_id long, id long, reason string, tokens long, vision long"
    return stream.groupBy("project_id").transformWithStateInPandas(BudgetGate(tokens, vision), schema, "Append", "None")


class WindowGate(StatefulProcessor):
    """Per project: tokens and vision calls since the last acknowledged window; one event when a limit is reached.

    Rows are sums of closed windows (start, tokens, vision, acks), a few a project; they come in the order of their windows over
    micro-batches, and are put into it within one.
    """

    def __init__(self, tokens: int, vision: int):
        self.limits = tokens, vision

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window_budget", "tokens long, vision long, open boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        used, seen, is_open = self.state.get() if self.state.exists() else (0, 0, False)
        events = []
        for start, tokens, vision, acks in pd.concat(rows)[["start", "tokens", "vision", "acks"]].sort_values("start").itertuples(index=False):
            used, seen = used + int(tokens), seen + int(vision)
            over = "tokens" if used >= self.limits[0] else "vision" if seen >= self.limits[1] else None
            if over and not is_open:
                events.append((key[0], start, over, used, seen))
                is_open = True
            if acks:
                used, seen, is_open = 0, 0, False
        self.state.update((used, seen, is_open))
        yield pd.DataFrame(events, columns=["project_id", "start", "reason", "tokens", "vision"])

    def close(self) -> None:
        pass


def window_gate(stream: DataFrame, tokens: int, vision: int, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Gate events of (project_id, created_at, kind, tokens) by windows of time; needs the RocksDB state store.

    Usage is summed by project and window first, combined before the shuffle, and a window is judged once, when the watermark
    has closed it: so neither the split into micro-batches nor their order within the delay changes an event, and a project
    with very many rows costs the gate one row a window. An acknowledgement (kind ack) takes effect at the end of its window.
    """
    ack = F.col("kind") == "ack"
    sums = stream.withWatermark("created_at", delay).groupBy(F.window("created_at", window).alias("w"), "project_id").agg(
        F.coalesce(F.sum(F.when(~ack, F.col("tokens"))), F.lit(0)).alias("tokens"), F.count_if(F.col("kind") == "vision").alias("vision"), F.count_if(ack).alias("acks"),
    )
    closed = sums.select("project_id", F.col("w.start").alias("start"), "tokens", "vision", "acks")
    schema = "project_id long, start timestamp, reason string, tokens long, vision long"
    return closed.groupBy("project_id").transformWithStateInPandas(WindowGate(tokens, vision), schema, "Append", "None")


def live_upsert(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch to the log at target; read_live gives the current rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_live(spark: SparkSession, target: str, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    return latest_per_key(spark.read.parquet(target), keys, ["batch", *order_cols]).drop("batch")


def ingest_documents(stream: DataFrame, target: str, checkpoint: str, content: str = "content") -> StreamingQuery:
    """Add documents whose hash the target does not have, the first of each hash in a batch.

    Hashes are kept in a table of their own, parted by their first two digits, so that a batch reads neither documents nor
    the hashes of prefixes that it does not hold.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, log = batch.sparkSession, f"{target.rstrip('/')}-hashes"
        digest = F.sha2(F.col(content).cast("binary"), 256)
        new = batch.withColumn("sha256", digest).dropDuplicates(["sha256"]).withColumn("prefix", F.substring("sha256", 1, 2))
        if number:
            prefixes = [r["prefix"] for r in new.select("prefix").distinct().collect()]  # 256 at most
            had = spark.read.schema("sha256 string, batch long, prefix string").parquet(log)
            new = new.join(had.where(F.col("prefix").isin(prefixes) & (F.col("batch") < number)).select("sha256"), "sha256", "left_anti")
        new.drop("prefix").write.mode("overwrite").parquet(f"{target}/batch={number}")
        kept = spark.read.schema("sha256 string").parquet(f"{target}/batch={number}")
        kept.withColumn("prefix", F.substring("sha256", 1, 2)).write.mode("overwrite").partitionBy("prefix").parquet(f"{log}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact_live(spark: SparkSession, target: str, keys: Sequence[str], order_cols: Sequence[str], new_target: str) -> None:
    """The current rows of a log as a log of one batch at another place, to be read and continued in its stead."""
    read_live(spark, target, keys, order_cols).write.mode("overwrite").parquet(f"{new_target}/batch=-1")
