"""Mentions of figures and tables in prose: extraction, linking, caps and what is missing."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.layout import core_key, strip_marker, visual_key
from ..functions.text import schema_of, strip

#: How figures and tables are referred to, and how a compound reference goes on.
FIGURE_REF = r"\b(?:fig(?:ures?|s)?\.?)\s*(S?\d+(?:\(?[a-z]\)?)?)\b"
FIGURE_MORE = r"\s*(?:,|;|&|and|to|–|—|-)\s*(S?\d+(?:\(?[a-z]\)?)?)\b"
TABLE_REF = r"\btables?\.?\s*(\d+[A-Za-z]?)\b"
COMPOUND = 90
_RUN = re.compile(FIGURE_REF + "(?P<more>(?:" + FIGURE_MORE.replace("(S?", "(?:S?") + ")*)", re.IGNORECASE)
_MORE, _TABLE = re.compile(FIGURE_MORE, re.IGNORECASE), re.compile(TABLE_REF, re.IGNORECASE)
_NO_BRACKETS = str.maketrans("", "", "()")
_HIT = "array<struct<kind:string,key:string,start:int,snippet:string>>"


def head_mentions(pages: DataFrame) -> DataFrame:
    """doc_id, page, hit_ord, kind, key of the first token of each reference, without a UDF."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit("(?i)" + pattern), 1), lambda k: F.struct(F.lit(kind).alias("kind"), F.lower(strip_marker(k)).alias("key")))

    kinds = [of("figure", FIGURE_REF), of("table", TABLE_REF)]
    return pages.select("doc_id", "page", "hit_ord", F.explode(F.concat(*kinds)).alias("h")).select("doc_id", "page", "hit_ord", "h.kind", "h.key")


def _references(text: str) -> list[tuple[str, str, int]]:
    """(kind, key, place) of every reference of a text: figures first, those of one compound at the place of its head."""
    found = []
    for run in _RUN.finditer(text):
        goes_on = [m[1] for m in _MORE.finditer(run["more"]) if m.start() < COMPOUND]
        found += [("figure", key, run.start()) for key in (run[1], *goes_on)]
    return found + [("table", m[1], m.start()) for m in _TABLE.finditer(text)]


def _hits(text: str) -> list[tuple[str, str, int, str]]:
    """(kind, key, place, snippet) of every reference of a text."""
    found = _references(text)
    around = {at: " ".join(text[max(0, at - 160) : at + 240].split())[:400] for at in {at for _, _, at in found}}
    return [(kind, key.translate(_NO_BRACKETS).strip().lower(), at, around[at]) for kind, key, at in found]


def find_mentions(text: Column) -> Column:
    """array<struct<kind, key, start, snippet>> with compound references and places, as an Arrow-backed UDF.

    Matches with offsets have no built-in function. A snippet is 160 characters before and 240 after a place, collapsed.
    """

    @F.pandas_udf(_HIT)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([_hits(x) for x in values.fillna("")], index=values.index, dtype=object)

    return run(text)


def mention_hits(pages: DataFrame) -> DataFrame:
    """doc_id, page, hit_ord, pos, kind, key, snippet of every reference.

    One pass over Arrow batches that gives flat columns; a text that stands several times in a batch is searched once.
    """
    keys = ["doc_id", "page", "hit_ord"]
    made = {"pos": pa.int32(), "kind": pa.string(), "key": pa.string(), "snippet": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys)).dictionary_encode()
            found = [_hits(text) for text in texts.dictionary.to_pylist()]
            rows = [(pos, kind, key, snippet) for hits in found for pos, (kind, key, _, snippet) in enumerate(hits)]
            if rows:
                flat = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), made.values(), strict=True)], names=list(made))
                lists = pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), flat).take(texts.indices)
                of = pc.list_parent_indices(lists)
                yield pa.RecordBatch.from_arrays([*(batch.column(j).take(of) for j in range(len(keys))), *lists.flatten().flatten()], names=[*keys, *made])

    return pages.select(*keys, "text").mapInArrow(run, schema_of(pages, keys) + "pos int, kind string, key string, snippet string")


def link_mentions(hits: DataFrame, visuals: DataFrame) -> DataFrame:
    """hits ⋈ visuals (doc_id, kind, fig_ord, label): on the key, or on the parent's where the hit names a sub-figure."""
    keyed = visuals.withColumn("key", visual_key(F.col("label"))).where("key IS NOT NULL").select("doc_id", "kind", "fig_ord", "key")
    core = core_key(F.col("key"))
    tries = F.array_compact(F.array(F.struct(F.col("key").alias("k"), F.lit(True).alias("exact")), F.when(core.isNotNull() & (core != F.col("key")), F.struct(core.alias("k"), F.lit(False).alias("exact")))))
    probes = hits.withColumnRenamed("key", "hit_key").withColumn("key", F.col("hit_key"))
    probes = probes.withColumn("_t", F.explode(tries)).withColumn("exact", F.col("_t.exact")).withColumn("key", F.col("_t.k")).drop("_t")
    return probes.join(keyed, ["doc_id", "kind", "key"]).drop("key")


def unmatched_references(hits: DataFrame, figures: DataFrame) -> DataFrame:
    """Figures that prose refers to and no figure has, exactly or as parent: key, label, page and place of the first mention."""
    have = figures.select("doc_id", visual_key(F.col("label")).alias("have")).where("have IS NOT NULL").distinct()
    wanted = hits.where("kind = 'figure'").withColumn("core", core_key(F.col("key")))
    gone = wanted.join(have.withColumnRenamed("have", "key"), ["doc_id", "key"], "left_anti").join(have.withColumnRenamed("have", "core"), ["doc_id", "core"], "left_anti")
    out = gone.groupBy("doc_id", "key").agg(F.min_by("page", "hit_ord").alias("page"), F.min("hit_ord").alias("first_hit"))
    return out.select("doc_id", "key", F.concat(F.lit("Fig. "), "key").alias("label"), "page", "first_hit")


def repair_figures(unmatched: DataFrame, figures: DataFrame, pages: DataFrame) -> DataFrame:
    """Stand-in figures (a whole page) for references whose label no figure has and whose page has a picture."""
    low = lambda c: F.lower(F.col(c))
    new = unmatched.join(figures.select("doc_id", low("label").alias("_l")).distinct(), (unmatched["doc_id"] == figures["doc_id"]) & (F.lower(unmatched["label"]) == F.col("_l")), "left_anti")
    return new.join(pages.where("has_screenshot").select("doc_id", "page"), ["doc_id", "page"], "left_semi").withColumn("stand_in", F.lit(True))


def attach_mentions(links: DataFrame, cap: int = 6) -> DataFrame:
    """At most cap distinct snippets of each visual, first mentions first; for labels that are unique in a document."""
    own = links.groupBy("doc_id", "kind", "fig_ord", "snippet").agg(F.min(F.struct("hit_ord", "pos")).alias("_o"), F.min_by("page", F.struct("hit_ord", "pos")).alias("page"))
    ranked = own.withColumn("mention_no", F.row_number().over(Window.partitionBy("doc_id", "kind", "fig_ord").orderBy("_o")))
    return ranked.where(F.col("mention_no") <= cap).drop("_o")


_ATTACHED = "doc_id long, kind string, fig_ord long, page int, snippet string, mention_no int"


def greedy_attach(hits: DataFrame, visuals: DataFrame, cap: int = 6) -> DataFrame:
    """The exact rule where labels repeat: each hit goes to the first matching visual that is not full, does not have its
    snippet and is not captioned by it.

    The choice depends on what came before, but only among equal numbers: a document is parted by kind and leading number
    of the key. Of hits with one key and snippet, only as many count as there are visuals, since each takes one of them or
    finds none open from then on; the others are dropped before. Spark sorts each part, visuals first; then one pass runs
    over the sorted rows and holds the visuals of one part at a time.
    """
    keyed = visuals.withColumn("key", visual_key(F.col("label"))).where("key IS NOT NULL").select("doc_id", "kind", "fig_ord", "key", "caption")
    number = F.coalesce(core_key(F.col("key")), F.col("key"))
    keyed, numbered = keyed.withColumn("number", number), hits.withColumn("number", number)
    by = ["doc_id", "kind", "number"]
    have = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("_visuals"))
    again = F.row_number().over(Window.partitionBy(*by, "key", "snippet").orderBy("hit_ord", "pos"))
    useful = numbered.join(have, by).withColumn("_again", again).where(F.col("_again") <= F.col("_visuals")).select(*by, "key", "hit_ord", "pos", "page", "snippet")
    shelf = keyed.select(*by, "key", F.lit(False).alias("is_hit"), F.col("fig_ord").alias("at"), F.lit(0).alias("pos"), F.lit(None).cast("int").alias("page"), F.coalesce("caption", F.lit("")).alias("text"))
    rows = shelf.unionByName(useful.select(*by, "key", F.lit(True).alias("is_hit"), F.col("hit_ord").alias("at"), "pos", "page", F.col("snippet").alias("text")))
    return rows.repartition(*by).sortWithinPartitions(*by, "is_hit", "at", "pos").mapInArrow(_attach(cap), _ATTACHED)


def _attach(cap: int):
    """Batches of rows sorted by part, visuals before hits, to the hits' visuals."""
    names = [c.split()[0] for c in _ATTACHED.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shelf, by_key = None, [], {}  # by visual: number, caption and the snippets it took; visuals that are not full, by key
        for batch in batches:
            out = []
            for doc, kind, number, key, is_hit, at, _, page, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (doc, kind, number) != part:
                    part, shelf, by_key = (doc, kind, number), [], {}
                if not is_hit:
                    by_key.setdefault(key, []).append(len(shelf))
                    shelf.append((at, " ".join(text.split()), {}))
                    continue
                free = heapq.merge(*[by_key.get(n, []) for n in {key, number}])
                place = next((v for v in free if text not in shelf[v][2] and shelf[v][1] != text), None)
                if place is None:
                    continue
                fig, _, taken = shelf[place]
                taken[text] = len(taken) + 1
                out.append((doc, kind, fig, page, text, len(taken)))
                if len(taken) == cap:
                    for open_ones in by_key.values():
                        if place in open_ones:
                            open_ones.remove(place)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def on_page(mentions: DataFrame, visuals: DataFrame, n: int, distinct: bool = True) -> DataFrame:
    """visuals (doc_id, kind, page, fig_ord) with those mentions (doc_id, page, mention_no, snippet) of their page that can be among
    their first n, distinct: by snippets.

    These are the page's own first n, so mentions are combined and ranked by page before they meet its visuals; a visual with
    several pages has more, to be ranked again.
    """
    keys = ["doc_id", "page"]
    rows = mentions.groupBy(*keys, "snippet").agg(F.min("mention_no").alias("mention_no")) if distinct else mentions.select(*keys, "snippet", "mention_no")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("mention_no"))
    return rows.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n").join(visuals.select(*keys, "kind", "fig_ord"), keys)


def top_mentions(mentions: DataFrame, n: int = 4, distinct: bool = True) -> DataFrame:
    rows = mentions.groupBy("doc_id", "kind", "fig_ord", "snippet").agg(F.min("mention_no").alias("mention_no")) if distinct else mentions
    rank = F.row_number().over(Window.partitionBy("doc_id", "kind", "fig_ord").orderBy("mention_no"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def number_mentions(mentions: DataFrame, n: int = 8) -> DataFrame:
    """The first n mentions of each visual, numbered from 1."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "kind", "fig_ord").orderBy("mention_no"))
    return mentions.withColumn("mention_index", rank).where(F.col("mention_index") <= n)


def layout_warnings(unmatched: DataFrame, pages: DataFrame, figures: DataFrame, limit: int = 6, light: int = 40) -> DataFrame:
    """The first references without a figure, by page and then by first mention, and figure pages with next to no text."""
    first = unmatched.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "first_hit"))).where(F.col("_n") <= limit)
    empty = pages.where(F.char_length(strip(F.col("text"))) < light).join(figures.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
    return first.select("doc_id", "page", F.lit("unmatched").alias("warning"), "label").unionByName(empty.select("doc_id", "page", F.lit("text_light").alias("warning"), F.lit("").alias("label")))
