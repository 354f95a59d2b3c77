"""Evidence: chunks and their addresses, routing to parts, and checks against the source."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.layout import section_type
from ..sources.batches import pieces

#: For each part of an analysis, the section types it prefers and the words it looks for.
SECTION_PREFERENCES = {"problem": ("abstract", "background"), "method": ("method",), "experiment": ("experiment",), "critical": ("discussion", "experiment")}
KEYWORDS = {
    "problem": ("摘要", "引言", "背景", "问题", "目的", "挑战", "贡献", "abstract", "introduction", "problem", "challenge", "objective", "contribution", "propose"),
    "method": ("方法", "算法", "模型", "流程", "公式", "步骤", "框架", "method", "algorithm", "model", "framework", "equation", "architecture", "processing"),
    "experiment": ("实验", "数据", "指标", "结果", "比较", "验证", "精度", "消融", "experiment", "dataset", "metric", "result", "baseline", "comparison", "accuracy", "ablation"),
    "critical": ("讨论", "结论", "局限", "不足", "未来", "适用", "discussion", "conclusion", "limitation", "future", "applicable", "uncertainty"),
}


def chunks(pages: DataFrame, size: int = 950, overlap: int = 140, key: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """key, chunk_no, span_start, span_end, excerpt, sha256 of each chunk of the rows' text; blank texts give none.

    One pass over Arrow batches: a row is cut where it lies, and what a chunk is known by (its place and hash) is made with
    it, so that no text is shuffled, joined or searched for.
    """
    made = "chunk_no int, span_start int, span_end int, excerpt string, sha256 string"
    schema = T.schema_of(pages, key) + made
    names = [*key, *[x.split()[0] for x in made.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole)):
            rows, of = [], []
            for i, text in enumerate(batch.column(len(key))):
                cut = T.chunk_spans(text.as_py() or "", size, overlap)
                rows += [(n, a, b, e, hashlib.sha256(e.encode()).hexdigest()) for n, (a, b, e) in enumerate(cut)]
                of += [i] * len(cut)
            owners = [batch.column(j).take(pa.array(of, pa.int64())) for j in range(len(key))]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*owners, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    return pages.select(*key, "text").mapInArrow(run, schema)


def chunk_runs(runs: DataFrame, pages: DataFrame, size: int = 950, overlap: int = 140) -> DataFrame:
    """Chunks of the block runs (doc_id, page, run, text) of each page, and of the page's text where it has no runs' blocks.

    Numbered through each page in the order of its runs; places are within the run.
    """
    bare = pages.where(~F.col("has_blocks")).select("doc_id", "page", F.lit(0).cast("long").alias("run"), "text")
    rows = runs.select("doc_id", "page", F.col("run").cast("long").alias("run"), "text").unionByName(bare)
    return chunks(rows, size, overlap, ("doc_id", "page", "run"))


def build_evidence(chunked: DataFrame) -> DataFrame:
    """Text evidence of chunks: locator and id. A text that stands in several chunks of a page is one evidence, the first.

    Only places and hashes are grouped; the excerpts of repeated chunks are dropped before the shuffle.
    """
    once = chunked.groupBy("doc_id", "page", "sha256").agg(F.min_by(F.struct("chunk_no", "span_start", "span_end", "excerpt"), "chunk_no").alias("_c")).select("doc_id", "page", "sha256", "_c.*")
    return located(once, F.concat_ws(":", F.lit("text"), "page", "span_start", "span_end", "sha256"))


def figure_evidence(figures: DataFrame) -> DataFrame:
    """Evidence of figures (doc_id, page, figure_id, label, caption, path, sha256 of the picture)."""
    rows = figures.select("doc_id", "page", F.lit("figure").alias("evidence_type"), F.coalesce("label", "figure_id").alias("label"), F.col("caption").alias("excerpt"), F.col("path").alias("source_path"), "sha256", F.col("figure_id").alias("_id"))
    return located(rows, F.concat_ws(":", F.lit("figure"), "page", "_id", "sha256")).drop("_id")


def table_evidence(tables: DataFrame) -> DataFrame:
    """Evidence of tables (doc_id, page, table_id, label, caption, path of the page's picture or null).

    The hash is that of the caption, or of the label or id where there is none.
    """
    known_by = F.coalesce(F.nullif("caption", F.lit("")), F.nullif("label", F.lit("")), "table_id")
    rows = tables.select("doc_id", "page", F.lit("table").alias("evidence_type"), F.coalesce(F.nullif("label", F.lit("")), "table_id").alias("label"), F.col("caption").alias("excerpt"), F.coalesce("path", F.concat(F.lit("pages/"), "page")).alias("source_path"), F.sha2(known_by.cast("binary"), 256).alias("sha256"), F.col("table_id").alias("_id"))
    return located(rows, F.concat_ws(":", F.lit("table"), "page", "_id", "sha256")).drop("_id")


def located(rows: DataFrame, locator: Column) -> DataFrame:
    """rows with their locator and the id that follows from it."""
    return rows.withColumn("locator", locator).withColumn("evidence_id", F.sha2(F.concat_ws("|", "doc_id", "locator"), 256))


def keep_known_ids(made: DataFrame, known: DataFrame) -> DataFrame:
    """made with the ids that earlier evidence of the same document and locator has."""
    had = known.groupBy("doc_id", "locator").agg(F.min("evidence_id").alias("_had"))
    return made.join(had, ["doc_id", "locator"], "left").withColumn("evidence_id", F.coalesce("_had", "evidence_id")).drop("_had").select(*made.columns)


def verify_visuals(evidence: DataFrame, figures: DataFrame, tables: DataFrame) -> DataFrame:
    """Figure and table evidence with ok and reason: the picture is there with the same hash; the caption hashes to the same.

    A figure is found by its path, a table by page and label, the first (by ord, if there is one, and id) where several have
    one; a table without a label is not found again.
    """
    pictures = figures.select("doc_id", F.lit("figure").alias("evidence_type"), F.col("path").alias("_key"), F.col("sha256").alias("_now")).groupBy("doc_id", "evidence_type", "_key").agg(F.collect_set("_now").alias("_now"))
    place = lambda label: F.to_json(F.struct(F.col("page").alias("page"), label.alias("label")))
    order = F.struct(*[c for c in ("ord", "table_id") if c in tables.columns])
    hashed = F.sha2(F.coalesce(F.nullif("caption", F.lit("")), F.nullif("label", F.lit("")), "table_id").cast("binary"), 256)
    captions = tables.where(F.coalesce("label", F.lit("")) != "").select("doc_id", F.lit("table").alias("evidence_type"), place(F.col("label")).alias("_key"), F.array(hashed).alias("_now"), order.alias("_order"))
    captions = captions.groupBy("doc_id", "evidence_type", "_key").agg(F.min_by("_now", "_order").alias("_now"))
    keyed = evidence.withColumn("_key", F.when(F.col("evidence_type") == "table", place(F.col("label"))).otherwise(F.col("source_path")))
    joined = keyed.join(pictures.unionByName(captions), ["doc_id", "evidence_type", "_key"], "left")
    reason = F.when(F.col("_now").isNull(), F.concat("evidence_type", F.lit(" missing"))).when(~F.array_contains("_now", F.col("sha256")), "hash differs")
    return joined.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()).select(*evidence.columns, "reason", "ok")


def verify_sources(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """evidence with ok and reason: the page exists, its slice is the excerpt, and the hash is the excerpt's."""
    joined = evidence.join(pages.select("doc_id", "page", F.col("text").alias("_text")), ["doc_id", "page"], "left")
    piece = F.substr("_text", F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))
    reason = F.when(F.col("_text").isNull(), "page missing").when(piece != F.col("excerpt"), "text differs").when(F.sha2(F.col("excerpt").cast("binary"), 256) != F.col("sha256"), "hash differs")
    return joined.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()).drop("_text")


def occurrences(text: Column, word: str) -> Column:
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def routing_score(text: Column, section_type: Column, page: Column, last_page: Column, part: str, topic_terms: Sequence[str] = (), keywords: Sequence[str] | None = None) -> Column:
    """Twice the keyword hits, the topic terms found, 3 for a preferred section, and the part's page bonus.

    The method part favours pages between the first and the last, problem the first two, the others the last three.
    """
    low = F.lower(text)
    score = F.lit(0)
    for k in KEYWORDS[part] if keywords is None else keywords:
        score = score + 2 * occurrences(low, k)
    for t in topic_terms:
        score = score + F.when(F.contains(low, F.lit(t)), 1).otherwise(0)
    score = score + F.when(section_type.isin(*SECTION_PREFERENCES[part]), 3).otherwise(0)
    bonus = {"problem": F.when(page <= 2, 4), "method": F.when((page > 1) & (page < last_page), 2)} | dict.fromkeys(("experiment", "critical"), F.when(page >= F.greatest(F.lit(1), last_page - 2), 4))
    return score + bonus[part].otherwise(0)


def topic_terms(topic: str) -> list[str]:
    """The words of two or more characters of a topic, case folded."""
    return [t.casefold() for t in re.findall(r"\w{2,}", topic)]


def routed(evidence: DataFrame, part: str, topic: str = "", group: Sequence[str] = ("paper_id",)) -> DataFrame:
    """evidence (section, claim, excerpt, page, evidence_type) with its score for a part: words of section, claim and excerpt count.

    The last page is that of the paper's text evidence.
    """
    last = evidence.where("evidence_type = 'text'").groupBy(*group).agg(F.max(F.coalesce("page", F.lit(1))).alias("_last"))
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    content = F.concat_ws(" ", none("section"), none("claim"), none("excerpt"))
    joined = evidence.join(last, [*group], "left")
    score = routing_score(content, section_type(none("section")), F.coalesce("page", F.lit(1)), F.coalesce("_last", F.lit(1)), part, topic_terms(topic))
    return joined.withColumn("score", score).drop("_last")


def select_text(scored: DataFrame, k: int, per_page: int = 2, group: Sequence[str] = ("paper_id",)) -> DataFrame:
    """At most per_page rows of a page, then the best k of each group."""
    order = [F.desc("score"), F.asc("page"), F.asc("ord")]
    capped = scored.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "page").orderBy(*order))).where(F.col("_n") <= per_page)
    return capped.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k).drop("_n")


def select_visuals(scored: DataFrame, k: int, group: Sequence[str] = ("paper_id",)) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), F.asc("ord")))
    return scored.where(F.col("evidence_type") != "text").withColumn("rank", rank).where(F.col("rank") <= k)


def evidence_pool(text: DataFrame, visual: DataFrame) -> DataFrame:
    return text.unionByName(visual, allowMissingColumns=True)


def resolve_crops(evidence: DataFrame, figures: DataFrame, tables: DataFrame) -> DataFrame:
    """Picture and caption of visual evidence: figures by path, tables by page and label; the first by ord where several have one."""
    order = F.col("ord") if "ord" in figures.columns else F.coalesce("caption", F.lit(""))
    named = figures.groupBy("doc_id", F.col("path").alias("source_path")).agg(F.min_by(F.struct("caption"), order).alias("_c"))
    figure = evidence.where("evidence_type = 'figure'").join(named, ["doc_id", "source_path"], "left").withColumn("crop", F.col("source_path")).withColumn("_caption", F.col("_c.caption")).drop("_c")
    first = tables.where("crop IS NOT NULL").groupBy("doc_id", "page", "label").agg(F.min_by(F.struct("crop", "caption"), "ord").alias("_t"))
    table = evidence.where("evidence_type = 'table'").join(first, ["doc_id", "page", "label"], "left").withColumn("crop", F.col("_t.crop")).withColumn("_caption", F.col("_t.caption")).drop("_t")
    return figure.unionByName(table).withColumn("caption", F.coalesce("_caption", "excerpt")).drop("_caption")


def check_links(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """Evidence whose document is missing, of another paper, or of another file."""
    joined = evidence.join(documents.select("doc_id", F.col("paper_id").alias("_paper"), F.col("file_sha256").alias("_file")), "doc_id", "left")
    reason = F.when(F.col("_paper").isNull(), "no document").when(F.col("_paper") != F.col("paper_id"), "paper differs").when(F.col("_file") != F.col("file_sha256"), "file differs")
    return joined.withColumn("violation", reason).where("violation IS NOT NULL").drop("_paper", "_file")


def paper_detail(papers: DataFrame, evidence: DataFrame) -> DataFrame:
    """papers with counts and the ids of their evidence by type, in order."""
    lists = evidence.groupBy("paper_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("evidence_type") == t, F.struct("ord", "evidence_id")))), lambda x: x["evidence_id"]).alias(f"{t}s") for t in ("text", "figure", "table")])
    none = F.array().cast("array<bigint>")
    out = papers.join(lists, "paper_id", "left")
    for t in ("text", "figure", "table"):
        out = out.withColumn(f"{t}s", F.coalesce(f"{t}s", none))
    return out
