"""Landed bibliographic records of several sources as one table of papers."""

from __future__ import annotations

import html
import time
import warnings
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bind, collapse, normalize_doi, normalize_title, reconstruct_abstract, strip
from .scratch import written

_LOCATION = "struct<landing_page_url:string,pdf_url:string,host_type:string,is_oa:boolean,version:string,license:string,source:struct<display_name:string,type:string,host_organization_name:string>>"
OPENALEX = (
    "id string, doi string, display_name string, title string, publication_year int, cited_by_count int, abstract_inverted_index map<string,array<int>>, "
    f"authorships array<struct<author:struct<display_name:string,orcid:string>>>, primary_location {_LOCATION}, best_oa_location {_LOCATION}, locations array<{_LOCATION}>"
)
CROSSREF = (
    "DOI string, title array<string>, abstract string, publisher string, `container-title` array<string>, `is-referenced-by-count` int, score double, author array<struct<given:string,family:string>>, "
    "`published-print` struct<`date-parts`:array<array<int>>>, `published-online` struct<`date-parts`:array<array<int>>>"
)
ARXIV = "id string, title string, summary string, published string, doi string, author array<struct<name:string>>, link array<struct<_href:string,_title:string,_rel:string>>"
#: The column that holds a line which is no record; `union_sources` counts and drops such rows.
CORRUPT = "_corrupt"


def _landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that is no JSON is a row with only _corrupt."""
    return spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def unescape(c: Column) -> Column:
    """HTML's entities as characters, for which Spark has no function."""

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: html.unescape(x) if x is not None else None)

    return run(c)


def _filled(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def _records(source: str, own: Column, score: Column | None = None) -> list[Column]:
    """What merging gathers of a record's origin."""
    score = F.lit(None).cast("double") if score is None else score
    record = F.struct(F.lit(source).alias("source"), own.alias("id"), score.alias("score"))
    return [F.array(F.lit(source)).alias("sources"), F.array(record).alias("source_records")]


def read_openalex(spark: SparkSession, path: str, query: str | None = None) -> DataFrame:
    """Works: id without its prefix, first filled title, named authors (with their ORCID in author_records), citations at least
    0, venue and publisher, the best open-access file or else its page, and all locations."""
    works = _landed(spark, path, OPENALEX)
    source, best = F.col("primary_location.source"), F.col("best_oa_location")
    people = F.filter(F.transform("authorships", lambda a: F.struct(a["author"]["display_name"].alias("name"), a["author"]["orcid"].alias("orcid"))), lambda a: F.coalesce(a["name"], F.lit("")) != "")
    people = F.coalesce(people, F.array().cast("array<struct<name:string,orcid:string>>"))
    doi = normalize_doi(F.col("doi"))
    own = F.substring_index("id", "/", -1)
    return works.select(
        F.coalesce(doi, own).alias("stable_id"), own.alias("source_id"), F.coalesce(_filled(F.col("display_name"), F.col("title")), F.lit("Untitled")).alias("title"),
        reconstruct_abstract(F.col("abstract_inverted_index")).alias("abstract"), doi.alias("doi"), F.lit(None).cast("string").alias("arxiv_id"), F.col("publication_year").alias("year"),
        F.greatest(F.lit(0), F.coalesce("cited_by_count", F.lit(0))).alias("citation_count"), F.transform(people, lambda a: a["name"]).alias("authors"), people.alias("author_records"), source["display_name"].alias("venue"), source["host_organization_name"].alias("publisher"),
        F.lit("openalex").alias("source"), F.lit(query).cast("string").alias("query"), _filled(best["pdf_url"], best["landing_page_url"]).alias("open_access_url"), "best_oa_location", "locations", own.alias("openalex_id"), *_records("openalex", own), CORRUPT,
    )


def explode_locations(works: DataFrame) -> DataFrame:
    """Locations of works, the best one first, one per URL: the file's, or else that of its page."""
    all_of = F.concat(F.array("best_oa_location"), F.coalesce("locations", F.array().cast(works.schema["locations"].dataType)))
    rows = works.select("stable_id", F.posexplode(all_of).alias("pos", "l")).where("l IS NOT NULL")
    filled = {c: F.nullif(F.col(f"l.{c}"), F.lit("")) for c in ("pdf_url", "landing_page_url", "host_type", "version", "license")}
    flat = rows.select("stable_id", "pos", F.coalesce(filled["pdf_url"], filled["landing_page_url"]).alias("url"), *[c.alias(n) for n, c in filled.items()], F.nullif("l.source.type", F.lit("")).alias("source_type"), F.coalesce("l.is_oa", F.lit(False)).alias("is_oa"))
    kept = [c for c in flat.columns if c not in ("stable_id", "url")]
    return flat.where("url IS NOT NULL").groupBy("stable_id", "url").agg(F.min_by(F.struct(*kept), "pos").alias("l")).select("stable_id", "url", "l.*")


def read_crossref(spark: SparkSession, path: str, query: str | None = None) -> DataFrame:
    """Items: joined title and venue, year of the print else online date, authors from given and family names."""
    items = _landed(spark, path, CROSSREF)
    part = lambda c: F.get(F.get(F.col(f"`{c}`.`date-parts`"), F.lit(0)), F.lit(0))
    year, doi = F.when(F.col("`published-print`").isNotNull(), part("published-print")).otherwise(part("published-online")), normalize_doi(F.col("DOI"))
    title = F.coalesce(F.nullif(F.array_join("title", " "), F.lit("")), F.lit("Untitled"))
    names = F.filter(F.transform("author", lambda a: F.concat_ws(" ", F.nullif(a["given"], F.lit("")), F.nullif(a["family"], F.lit("")))), lambda n: n != "")
    named = F.concat_ws(":", F.lit("crossref"), normalize_title(title), F.coalesce(year.cast("string"), F.lit("None")))
    return items.select(
        F.coalesce(doi, named).alias("stable_id"), F.coalesce(doi, normalize_title(title)).alias("source_id"), title.alias("title"), F.col("abstract"), doi.alias("doi"), F.lit(None).cast("string").alias("arxiv_id"), year.alias("year"),
        F.greatest(F.lit(0), F.coalesce("`is-referenced-by-count`", F.lit(0))).alias("citation_count"), F.coalesce(names, F.array()).cast("array<string>").alias("authors"),
        F.nullif(strip(unescape(F.array_join(F.col("`container-title`"), " "))), F.lit("")).alias("venue"), F.nullif(strip(F.col("publisher")), F.lit("")).alias("publisher"), F.lit("crossref").alias("source"), F.lit(query).cast("string").alias("query"), *_records("crossref", doi, F.col("score")), CORRUPT,
    )


def _year_of(published: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(published, r"^(\d{4})", 1), F.lit("")), F.lit("9999")).cast("int")


def _preprints(rows: DataFrame, query: str | None) -> DataFrame:
    """Papers of rows (arxiv_id, title, abstract, doi, published, authors, pdf_url)."""
    own = F.col("arxiv_id")
    return rows.select(
        F.coalesce(_filled(F.col("doi")), F.concat(F.lit("arxiv:"), own)).alias("stable_id"), own.alias("source_id"), "title", "abstract", _filled(F.col("doi")).alias("doi"), own.alias("arxiv_id"),
        _year_of(F.col("published")).alias("year"), F.lit(0).alias("citation_count"), F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), F.lit(None).cast("string").alias("venue"), F.lit(None).cast("string").alias("publisher"),
        F.lit("arxiv").alias("source"), F.lit(query).cast("string").alias("query"), F.col("pdf_url").alias("open_access_url"), *_records("arxiv", own),
    )


def versionless(identifier: Column) -> Column:
    """The last part of a preprint's address, without its version."""
    return F.regexp_replace(F.substring_index(F.regexp_replace(strip(identifier), "/+$", ""), "/", -1), r"v\d+$", "")


def read_arxiv(spark: SparkSession, path: str, year_from: int | None = None, year_to: int | None = None, query: str | None = None) -> DataFrame:
    """Atom entries: versionless id, the DOI if one is given (it is then the stable id), year of publication, collapsed texts,
    the link titled pdf; null years stay."""
    rows = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", True).schema(ARXIV).load(path)
    pdf = F.try_element_at(F.filter("link", lambda x: x["_title"] == "pdf"), F.lit(-1))["_href"]
    made = rows.select(
        F.regexp_replace(F.substring_index("id", "/", -1), r"v\d+$", "").alias("arxiv_id"), F.coalesce(collapse(F.col("title")), F.lit("Untitled")).alias("title"), F.nullif(collapse(F.col("summary")), F.lit("")).alias("abstract"),
        "doi", "published", F.transform("author", lambda a: F.coalesce(collapse(a["name"]), F.lit(""))).alias("authors"), pdf.alias("pdf_url"),
    )
    return in_years(_preprints(made, query), year_from, year_to)


#: Where a tool's answer may hold its result, looked at before other fields. Levels that are looked through.
HOLDERS, LEVELS = ("result", "data", "content", "structuredContent"), 8
_TOOL_PAPERS = "array<struct<id:string,paper_id:string,stable_id:string,title:string,abstract:string,published:string,year:int,doi:string,url:string,pdf_url:string,open_access_url:string,authors:array<variant>>>"


def _inside(value: Column) -> Column:
    """What a JSON value holds, in the order in which it is looked through: a text's own JSON, a list's items, an object's fields."""
    kind = F.schema_of_variant(value)
    fields = lambda m: F.concat(
        F.filter(F.transform(F.array(*map(F.lit, HOLDERS)), lambda k: F.try_element_at(m, k)), lambda x: x.isNotNull()),
        F.transform(F.filter(F.map_entries(m), lambda e: ~e["key"].isin(*HOLDERS)), lambda e: e["value"]),
    )
    return (
        F.when(kind == "STRING", F.array(F.try_parse_json(F.try_variant_get(value, "$", "string"))))
        .when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get(value, "$", "array<variant>"))
        .when(F.startswith(kind, F.lit("OBJECT")), bind(F.try_variant_get(value, "$", "map<string,variant>"), fields))
    )


def find_papers(value: Column, levels: int = LEVELS) -> Column:
    """The papers field of the first object that has one, looking through texts that are JSON, lists and objects; null if none."""
    own = F.try_variant_get(value, "$.papers", "variant")
    if not levels:
        return own
    below = F.filter(F.transform(_inside(value), lambda x: find_papers(x, levels - 1)), lambda x: x.isNotNull())
    return F.coalesce(own, F.get(below, F.lit(0)))


def read_arxiv_tool(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The same from a tool's JSON lines: the list of papers may lie in texts, lists, `structuredContent` and other fields.

    Ids are id or paper_id, links url or pdf_url; authors are names or objects with a name; blank ids are skipped. Lists of
    papers in this library's own form (stable_id) are taken as they are. An answer without a list of papers gives a row with
    only _corrupt.
    """
    raw = spark.read.text(path).where("trim(value) <> ''").withColumn("_papers", find_papers(F.try_parse_json("value")))
    lists = F.try_variant_get("_papers", "$", _TOOL_PAPERS)
    raw = raw.select(lists.alias("_list"), F.when(lists.isNull(), F.col("value")).alias(CORRUPT))
    name = lambda a: F.coalesce(F.try_variant_get(a, "$.name", "string"), F.when(F.schema_of_variant(a) == "STRING", F.try_variant_get(a, "$", "string")))
    rows = raw.select(CORRUPT, F.get(F.col("_list.stable_id"), F.lit(0)).isNotNull().alias("_own"), F.explode_outer("_list").alias("p"))
    kept = rows.where(F.col(CORRUPT).isNotNull() | (strip(_filled(F.col("p.id"), F.col("p.paper_id"), F.col("p.stable_id"))) != ""))
    made = kept.select(
        CORRUPT, "_own", F.when(F.col("_own"), F.col("p.stable_id")).alias("_stable"), F.when(F.col("_own"), F.col("p.year")).alias("_year"), F.when(F.col("_own"), F.col("p.doi")).alias("doi"),
        versionless(F.when(F.col("_own"), F.regexp_replace("p.stable_id", "^arxiv:", "")).otherwise(_filled(F.col("p.id"), F.col("p.paper_id")))).alias("arxiv_id"), F.coalesce(_filled(F.col("p.title")), F.lit("Untitled")).alias("title"),
        F.col("p.abstract").alias("abstract"), F.col("p.published").alias("published"), F.transform("p.authors", lambda a: F.coalesce(name(a), F.lit("None"))).alias("authors"), _filled(F.col("p.url"), F.col("p.pdf_url"), F.when(F.col("_own"), F.col("p.open_access_url"))).alias("pdf_url"),
    )
    own = F.col("arxiv_id")
    whole = lambda c: F.when(F.col(CORRUPT).isNull(), c)
    return made.select(
        whole(F.coalesce("_stable", F.concat(F.lit("arxiv:"), own))).alias("stable_id"), own.alias("source_id"), whole(F.col("title")).alias("title"), "abstract", "doi", own.alias("arxiv_id"), F.coalesce("_year", _year_of(F.col("published"))).alias("year"), F.lit(0).alias("citation_count"),
        F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), F.lit(None).cast("string").alias("venue"), F.lit(None).cast("string").alias("publisher"), F.lit("arxiv").alias("source"), F.lit(query).cast("string").alias("query"), F.col("pdf_url").alias("open_access_url"),
        *_records("external-arxiv", own), CORRUPT,
    )


def in_years(papers: DataFrame, year_from: int | None, year_to: int | None) -> DataFrame:
    out = papers
    if year_from is not None:
        out = out.where(F.col("year").isNull() | (F.col("year") >= year_from))
    if year_to is not None:
        out = out.where(F.col("year").isNull() | (F.col("year") <= year_to))
    return out


def scan_papers(spark: SparkSession, path: str, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """A Parquet table of papers; the year range reaches the scan as a pushed filter or a partition filter."""
    out = spark.read.parquet(path)
    for bound, op in ((year_from, ">="), (year_to, "<=")):
        if bound is not None:
            out = out.where(f"year {op} {int(bound)}")
    return out


STATUS = "source string, ok boolean, error string, papers long, corrupt long, latency_ms long"


def union_sources(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Union of the sources that could be read, and their status: source, ok, error, papers, corrupt (rows that were no
    record, which are left out) and latency_ms.

    sources gives for each name how to read it. Each is read once and written, so that whatever fails while its files are
    read is that source's failure, and later steps do not read them again. A failed source gives a warning; if all fail, that is an error.
    """
    good, status = [], []
    for name, read in sources.items():
        began, error, papers, corrupt = time.monotonic(), None, 0, 0
        try:
            found = written(read(), f"source-{name}")
            bad = F.col(CORRUPT).isNotNull() if CORRUPT in found.columns else F.lit(False)
            papers, corrupt = found.agg(F.count_if(~bad), F.count_if(bad)).first()
            good.append(found.where(~bad).drop(CORRUPT))
        except Exception as e:  # noqa: BLE001  a source's failure is data
            error = f"{type(e).__name__}: {str(e).strip().splitlines()[0][:300] if str(e).strip() else ''}"
            warnings.warn(f"{name}: {error}", stacklevel=2)
        status.append((name, error is None, error, papers, corrupt, round((time.monotonic() - began) * 1000)))
    if not good:
        raise RuntimeError("all sources failed: " + "; ".join(f"{s[0]}: {s[2]}" for s in status))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), good), spark.createDataFrame(status, STATUS)


def lookup_metadata(ids: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Metadata of ids (id): the primary source by id or DOI, else the secondary one by DOI; provenance says which."""
    doi = normalize_doi(F.col("id"))
    keyed = ids.select("id", doi.alias("_doi"))
    one = lambda df, key: df.groupBy(key.alias("_k")).agg(F.min_by(F.struct("title", "year", "doi"), "stable_id").alias("_m")).where("_k IS NOT NULL")
    by_id, by_doi, other = one(primary, F.col("source_id")), one(primary, F.col("doi")), one(secondary, F.col("doi"))
    joined = keyed.join(by_id.withColumnsRenamed({"_k": "id", "_m": "_a"}), "id", "left").join(by_doi.withColumnsRenamed({"_k": "_doi", "_m": "_b"}), "_doi", "left").join(other.withColumnsRenamed({"_k": "_doi", "_m": "_c"}), "_doi", "left")
    provenance = F.when(F.coalesce("_a", "_b").isNotNull(), "primary").when(F.col("_c").isNotNull(), "secondary").otherwise("not_found")
    return joined.withColumn("_m", F.coalesce("_a", "_b", "_c")).select("id", provenance.alias("provenance"), "_m.title", "_m.year", "_m.doi")
