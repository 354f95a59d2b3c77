"""Page layout: blocks, reading order, roles, sections, captions and runs of text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions.text import collapse

PAGE = ("doc_id", "page")


def spans_to_blocks(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, page, block, line, span, text, size) as blocks: line texts joined by line ends, largest size."""
    keys = [*PAGE, "block"]
    lines = spans.groupBy(*keys, "line").agg(collapse(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda x: x["text"]), "")).alias("text"), F.max("size").alias("size"))
    blocks = lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("line", "text")))), lambda x: x["text"]), "\n").alias("text"), F.max("size").alias("size"))
    return blocks.where(F.trim("text") != "")


def reading_order(blocks: DataFrame, page_width: float) -> DataFrame:
    """blocks with read_ord: full-width blocks, left column, right column where a page has both and four narrow blocks."""
    w, narrow = Window.partitionBy(*PAGE), (F.col("x1") - F.col("x0")) < 0.6 * page_width
    right = (F.col("x0") + F.col("x1")) / 2 > page_width * 0.5
    columns = (F.count_if(narrow & right).over(w) > 0) & (F.count_if(narrow & ~right).over(w) > 0) & (F.count_if(narrow).over(w) >= 4)
    band = F.when(~F.col("_columns") | ~narrow, 0).when(~right, 1).otherwise(2)
    order = [F.asc("_band"), F.bround(F.col("y0").cast("double"), 1), F.asc("x0"), F.asc("ord")]
    return blocks.withColumn("_columns", columns).withColumn("_band", band).withColumn("read_ord", F.row_number().over(w.orderBy(*order))).drop("_columns", "_band")


def page_median_size(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("median_size", F.median("size").over(Window.partitionBy(*PAGE)))


def with_roles(blocks: DataFrame, page_height: float) -> DataFrame:
    """blocks (with median_size) and their role."""
    role = L.block_role(F.col("text"), F.col("y0"), F.col("y1"), F.col("size"), F.lit(page_height), F.col("median_size"))
    return blocks.withColumn("role", role)


def content_blocks(blocks: DataFrame, roles: Sequence[str] = ("body", "caption")) -> DataFrame:
    return blocks.where(F.col("role").isin(*roles))


def page_text(blocks: DataFrame) -> DataFrame:
    """Text of each page: its blocks but margins in reading order."""
    kept = blocks.where(~F.col("role").isin("header", "footer", "page_number"))
    return kept.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("read_ord", "text"))), lambda x: x["text"]), "\n").alias("text"))


def section_spans(headings: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections from headings (doc_id, ord, title, page): each ends where the next begins, and has a type."""
    last = pages.groupBy("doc_id").agg(F.max("page").alias("page_count"))
    nxt = F.lead("page").over(Window.partitionBy("doc_id").orderBy("ord"))
    out = headings.withColumn("_next", nxt).join(last, "doc_id")
    return out.select("doc_id", "ord", "title", F.col("page").alias("start_page"), F.greatest(F.col("page"), F.coalesce("_next", "page_count")).alias("end_page"), L.section_type(F.col("title")).alias("type"))


def _section_pages(sections: DataFrame) -> DataFrame:
    return sections.withColumn("page", F.explode(F.sequence("start_page", "end_page")))


def section_of_page(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """pages with the last section that covers them: the section's page range is exploded, so the join is on equality."""
    best = _section_pages(sections).groupBy(*PAGE).agg(F.max_by("title", "ord").alias("section"), F.max_by("type", "ord").alias("section_type"))
    return pages.join(best, [*PAGE], "left")


def drop_reference_pages(pages: DataFrame, sections: DataFrame) -> DataFrame:
    return pages.join(_section_pages(sections.where("type = 'references'")).select(*PAGE), [*PAGE], "left_anti")


def nearest_caption(regions: DataFrame, blocks: DataFrame, kind: str, limit: int = 2000) -> DataFrame:
    """regions (doc_id, page, region_id, y0, y1) of a kind (figure or table) with the caption of that kind on their page that is
    nearest above or below."""
    captions = blocks.where(L.is_caption(F.col("text"), kind)).select(*PAGE, F.col("ord").alias("_ord"), F.col("y0").alias("_y0"), F.col("y1").alias("_y1"), collapse(F.col("text")).alias("_text"))
    gap = F.least(F.abs(F.col("_y0") - F.col("y1")), F.abs(F.col("y0") - F.col("_y1")))
    best = regions.join(captions, [*PAGE]).groupBy(*PAGE, "region_id").agg(F.min_by("_text", F.struct(gap, "_ord")).alias("caption"))
    out = regions.join(best, [*PAGE, "region_id"], "left")
    return out.withColumn("label", L.caption_label(F.col("caption"))).withColumn("caption", F.substring("caption", 1, limit))


def figure_candidates(raw: DataFrame) -> DataFrame:
    """Regions large enough for a figure (vector ones need a caption too), one per image hash of a document."""
    area = F.col("width") * F.col("height")
    raster = (F.col("width") >= 80) & (F.col("height") >= 80)
    vector = (F.col("width") >= 100) & (F.col("height") >= 80) & F.col("caption").isNotNull()
    good = (area >= 20000) & F.when(F.col("kind") == "raster", raster).otherwise(vector)
    first = F.row_number().over(Window.partitionBy("doc_id", "sha256").orderBy("ord"))
    return raw.where(good).withColumn("_n", first).where("_n = 1").drop("_n")


def block_runs(blocks: DataFrame) -> DataFrame:
    """Body and caption blocks between headings, joined: doc_id, page, run, heading, text."""
    w = Window.partitionBy(*PAGE).orderBy("read_ord")
    heading = F.col("role") == "heading"
    numbered = blocks.withColumn("run", F.count_if(heading).over(w)).withColumn("_heading", F.last(F.when(heading, F.col("text")), True).over(w))
    texts = numbered.where(F.col("role").isin("body", "caption")).groupBy(*PAGE, "run")
    return texts.agg(F.max("_heading").alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("read_ord", "text"))), lambda x: x["text"]), "\n").alias("text"))
