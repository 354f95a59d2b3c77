"""Work ledgers as data: what to run, what was reused, resets, progress and boards."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .resolve import latest_per_key, upsert

ITEM = ("project_id", "run_scope", "item_key")


def plan_work(inputs: DataFrame, ledger: DataFrame, replace_changed: bool = False) -> DataFrame:
    """inputs with decision (reuse, run, reset or conflict) and the attempts that the run would make."""
    have = ledger.select(*ITEM, F.col("input_hash").alias("_hash"), F.col("status").alias("_status"), F.col("attempts").alias("_attempts"))
    same = F.col("_hash") == F.col("input_hash")
    decision = F.when(F.col("_hash").isNull(), "run").when(~same, "reset" if replace_changed else "conflict").when(F.col("_status") == "completed", "reuse").otherwise("run")
    had = F.coalesce("_attempts", F.lit(0))
    attempts = F.when(F.col("decision").isin("run", "reset"), had + 1).otherwise(had)
    return inputs.join(have, [*ITEM], "left").withColumn("decision", decision).withColumn("attempts", attempts.cast("int")).drop("_hash", "_status", "_attempts")


def finish_work(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """ledger with the results' status, attempts and times laid over it."""
    return upsert(ledger, results, ITEM, "ord")


def invalidate(ledger: DataFrame, items: DataFrame, scope_prefix: str) -> DataFrame:
    """ledger without the chosen (project_id, item_key) rows of scopes that begin with the prefix."""
    gone = ledger.where(F.startswith("run_scope", F.lit(scope_prefix))).join(items.select("project_id", "item_key"), ["project_id", "item_key"], "left_semi").select(*ITEM)
    return ledger.join(gone.distinct(), [*ITEM], "left_anti")


def reset_project(tables: dict[str, DataFrame], project_ids: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the projects."""
    ids = project_ids.select("project_id").distinct()
    return {name: df.join(ids, "project_id", "left_anti") for name, df in tables.items()}


def recovered(ledger: DataFrame) -> DataFrame:
    return ledger.where("status = 'completed' AND attempts > 1")


def upsert_progress(progress: DataFrame, updates: DataFrame, keys: Sequence[str], strict_reference: bool = False) -> DataFrame:
    """progress with updates: a null label, total or done keeps the old value.

    strict_reference: a null done of an update counts as 0.
    """
    old = progress.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("label", "total", "done")])
    done = F.coalesce("done", F.lit(0)) if strict_reference else F.coalesce("done", "_done", F.lit(0))
    is_new = F.col("_from_update")
    new = updates.withColumn("_from_update", F.lit(True)).join(old, [*keys], "full")
    return new.select(*keys, F.coalesce("label", "_label").alias("label"), F.coalesce("total", "_total").alias("total"), F.when(is_new, done).otherwise(F.col("_done")).alias("done"))


#: How the notes of automatic passes begin, and the source that each tells.
NOTE_SOURCES = {"自动复核：": "auto_visual_verifier", "图文一致：": "auto_consistency"}


def backfill_sources(reviews: DataFrame) -> DataFrame:
    """reviews with a source where there was none: that of the automatic pass whose mark begins the note, else human."""
    told = F.lit("human")
    for mark, source in NOTE_SOURCES.items():
        told = F.when(F.startswith(F.coalesce("note", F.lit("")), F.lit(mark)), source).otherwise(told)
    return reviews.withColumn("source", F.coalesce("source", told))


def backfill_visuals(analyses: DataFrame, regions: DataFrame) -> DataFrame:
    """analyses whose total_visuals is 0 although they have regions, with the regions counted.

    All count as completed, except in failed runs; the step says how a completed or failed run ended.
    """
    counts = regions.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("_n"))
    open_row = (F.col("total_visuals") == 0) & F.col("_n").isNotNull()
    step = F.when(F.col("status") == "completed", "visuals_completed").when(F.col("status") == "failed", "visuals_failed").otherwise(F.col("current_step"))
    done = F.when(F.col("status") == "failed", 0).otherwise(F.col("_n"))
    out = analyses.join(counts, "analysis_id", "left").withColumn("_open", open_row)
    for name, value in (("completed_visuals", done), ("current_step", step), ("total_visuals", F.col("_n"))):
        out = out.withColumn(name, F.when(F.col("_open"), value).otherwise(F.col(name)))
    return out.drop("_n", "_open")


def pending_documents(documents: DataFrame, papers: DataFrame, analyses: DataFrame, version: int = 3) -> DataFrame:
    """Documents of known papers that no completed analysis of this version and hash covers."""
    done = analyses.where((F.col("status") == "completed") & (F.col("pipeline_version") == version)).select("doc_id", "sha256")
    return documents.join(papers.select("paper_id"), "paper_id", "left_semi").join(done, ["doc_id", "sha256"], "left_anti")


def latest_job(jobs: DataFrame) -> DataFrame:
    return latest_per_key(jobs, ["project_id"], ["created_at", "job_id"])


def zombie_projects(projects: DataFrame, jobs: DataFrame) -> DataFrame:
    """Running projects whose latest job failed."""
    failed = latest_job(jobs).where("status = 'failed'").select("project_id")
    return projects.where("status = 'running'").join(failed, "project_id", "left_semi")


def current_papers(papers: DataFrame, results: DataFrame, revisions: DataFrame) -> DataFrame:
    """Papers in the results of their project's latest revision."""
    latest = revisions.groupBy("project_id").agg(F.max("revision").alias("revision"))
    return papers.join(results.join(latest, ["project_id", "revision"], "left_semi").select("project_id", "stable_id"), ["project_id", "stable_id"], "left_semi")


def progress_board(progress: DataFrame, selections: DataFrame, papers: DataFrame) -> DataFrame:
    """Progress rows of selected papers, and those of whole projects, with titles.

    Rows of whole projects have no paper: they have no title either, and would all meet in one task if they were joined.
    """
    chosen = progress.join(selections.select("project_id", "paper_id"), ["project_id", "paper_id"], "left_semi").join(papers.select("paper_id", "title"), "paper_id", "left")
    return chosen.unionByName(progress.where("paper_id IS NULL").withColumn("title", F.lit(None).cast(papers.schema["title"].dataType)))


#: Fields of a section's result that a block of each part shows.
PART_FIELDS = {"problem": ("core_problem", "relevance_to_topic"), "method": ("methods", "mechanisms"), "experiment": ("experimental_setup", "main_results"), "critical": ("limitations",), "overview": ("overview",)}


#: Titles of this many bytes at most are broadcast.
BROADCAST_BYTES = 8 << 20


def with_titles(rows: DataFrame, papers: DataFrame) -> DataFrame:
    """rows with the _title of their paper, null where it is unknown.

    Many rows may have one paper, so they are not dealt out by it: the titles of their papers alone are written, measured and
    broadcast, and only beyond BROADCAST_BYTES joined by a shuffle.
    """
    asked = rows.select("paper_id").distinct()
    titles = written(papers.select("paper_id", F.col("title").alias("_title")).join(asked, "paper_id", "left_semi"), "titles")
    size = titles.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("_title"), F.lit(0)) + 16), F.lit(0))).first()[0]
    return rows.join(F.broadcast(titles) if size <= BROADCAST_BYTES else titles, "paper_id", "left")


def analysis_blocks(selections: DataFrame, sections: DataFrame, board: DataFrame, papers: DataFrame, notes: DataFrame) -> DataFrame:
    """One row per selected paper (project_id, paper_id) and part: paper_title, status, content, note.

    sections: project_id, paper_id, part, status, content (map of field to text), updated_at, ord; the latest of each
    part counts, the first where times are equal, if it is completed. A part with content is completed; without, its status
    is that of the progress board (project_id, paper_id, part, status, ord), else queued. notes: what was asked for a part.

    Sections and board are one table, cut to what a block shows and put together once by paper, with a column for each part;
    papers become a row a part only after the joins.
    """
    paper, parts = ["project_id", "paper_id"], [*PART_FIELDS]
    known = lambda df: df.dropna(subset=paper).where(F.col("part").isin(parts))
    fields = F.create_map(*[x for part, names in PART_FIELDS.items() for x in (F.lit(part), F.array(*map(F.lit, names)))])
    shown = F.map_filter("content", lambda k, v: F.array_contains(fields[F.col("part")], k) & (F.coalesce(v, F.lit("")) != ""))
    content = F.when((F.col("status") == "completed") & (F.size(shown) > 0), shown)
    told = known(sections).select(*paper, "part", content.alias("content"), F.struct("updated_at", -F.col("ord")).alias("_at"))
    stands = known(board).select(*paper, "part", F.col("status").alias("_board"), F.col("ord").alias("_ord"))
    of = lambda part, order: F.when(F.col("part") == part, F.col(order))  # noqa: E731  rows without an order are passed over
    latest = [x for i, p in enumerate(parts) for x in (F.max_by("content", of(p, "_at")).alias(f"_content{i}"), F.max_by("_board", of(p, "_ord")).alias(f"_board{i}"))]
    found = told.unionByName(stands, allowMissingColumns=True).groupBy(*paper).agg(*latest)
    asked = known(notes).groupBy(*paper).agg(F.collect_list(F.struct("part", "note")).alias("_asked"))
    out = with_titles(selections.select(*paper).join(asked, paper, "left").join(found, paper, "left"), papers)
    blocks = F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"_content{i}").alias("content"), F.col(f"_board{i}").alias("_board")) for i, p in enumerate(parts)])
    out = out.select(*paper, "_title", "_asked", F.explode(blocks).alias("_b")).select(*paper, "_title", "_asked", "_b.*")
    mine = F.transform(F.filter("_asked", lambda n: n["part"] == F.col("part")), lambda n: n["note"])
    status = F.when(F.col("content").isNotNull(), "completed").otherwise(F.coalesce("_board", F.lit("queued")))
    return out.select(*paper, "part", F.coalesce("_title", F.lit("untitled")).alias("paper_title"), status.alias("status"), "content", F.explode_outer(mine).alias("note"))


def missing_documents(papers: DataFrame, acquisitions: DataFrame) -> DataFrame:
    return papers.join(acquisitions.where("status = 'awaiting_upload'").select("paper_ord"), "paper_ord", "left_semi")


def result_cards(papers: DataFrame, acquisitions: DataFrame, availability: DataFrame) -> DataFrame:
    """papers, with all that they say of their origin, the state of their download (full_text: null before one was tried)
    and what is predicted for it (full_text_hint)."""
    state = F.when(F.col("acquired").isNotNull(), "acquired").otherwise("awaiting_upload")
    hint = F.struct("level", "label", "detail", "host", "candidates")
    out = papers.join(acquisitions.select("paper_ord", state.alias("full_text")), "paper_ord", "left")
    return out.join(availability.select("paper_ord", hint.alias("full_text_hint")), "paper_ord", "left")


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """df with violations: the names of the rules (name to SQL of what must hold) that a row breaks."""
    broken = F.array(*[F.when(~F.coalesce(F.expr(test), F.lit(False)), name) for name, test in rules.items()])
    return df.withColumn("violations", F.array_compact(broken))


def audit_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def audit_reference(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key no row of parent has."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


@dataclass(frozen=True)
class Constraint:
    """A rule over a table: its keys are unique, have a parent, are among allowed values, or stand at most once among active rows.

    kind: unique (columns), reference (columns; parent and parent_columns), allowed (one column; values), at_most_one
    (columns; active, the SQL of what counts). Keys with a null break no rule.
    """

    name: str
    kind: str
    table: str
    columns: tuple[str, ...]
    parent: str = ""
    parent_columns: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    active: str = "true"


def audit_constraints(tables: dict[str, DataFrame], rules: Sequence[Constraint]) -> DataFrame:
    """rule, key, n_rows of every key that breaks a rule.

    Each table is read once: a row gives one key for each rule it takes part in, as child or as parent, and keys are counted with
    map-side combine, whatever rows a key has.
    """
    if unknown := {r.kind for r in rules} - {"unique", "reference", "allowed", "at_most_one"}:
        raise ValueError(f"kinds of constraints: {sorted(unknown)}")
    parts = []
    for name, table in tables.items():
        takes: list[Column] = []
        for rule in rules:
            for own, columns, is_child in ((rule.table, rule.columns, True), (rule.parent, rule.parent_columns, False)):
                if own != name:
                    continue
                test = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
                if is_child and rule.kind == "at_most_one":
                    test = test & F.expr(rule.active)
                if is_child and rule.kind == "allowed":
                    test = test & ~F.col(columns[0]).cast("string").isin(*rule.values)
                key = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
                takes.append(F.when(test, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.kind).alias("kind"), key.alias("key"), F.lit(is_child).alias("child"))))
        if takes:
            parts.append(table.select(F.explode(F.array_compact(F.array(*takes))).alias("r")).select("r.*"))
    counts = reduce(DataFrame.unionByName, parts).groupBy("rule", "kind", "key").agg(F.count_if("child").alias("n_rows"), F.count_if(~F.col("child")).alias("_parents"))
    broken = F.when(F.col("kind") == "reference", (F.col("_parents") == 0) & (F.col("n_rows") > 0)).when(F.col("kind") == "allowed", F.col("n_rows") > 0).otherwise(F.col("n_rows") > 1)
    return counts.where(broken).select("rule", "key", "n_rows")
