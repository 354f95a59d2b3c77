"""Where full text can be had: candidate order, availability, stale links and what a fetch log says."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import access as A
from .ranking import top_per_group

#: Publishers that often refuse downloads, and indexes that never hold the text.
PUBLISHERS = (
    "sciencedirect.com", "elsevier.com", "onlinelibrary.wiley.com", "wiley.com", "link.springer.com", "springer.com", "tandfonline.com", "sagepub.com", "academic.oup.com", "ieeexplore.ieee.org",
    "dl.acm.org", "iopscience.iop.org", "pubs.acs.org", "pubs.rsc.org", "cell.com", "science.org", "jamanetwork.com", "nejm.org", "bmj.com", "thelancet.com",
)
INDEXES = ("doaj.org", "pubmed.ncbi.nlm.nih.gov", "semanticscholar.org", "scilit.net", "ouci.dntb.gov.ua", "openalex.org", "crossref.org", "scite.ai", "connectedpapers.com", "researchgate.net")


def _is_publisher(publishers: Sequence[str]) -> Column:
    return (F.lower(F.coalesce("source_type", F.lit(""))) == "journal") | A.host_in(A.host_of(F.col("url")), publishers)


def usable_locations(locations: DataFrame, papers: DataFrame, publishers: Sequence[str] = PUBLISHERS) -> DataFrame:
    """Locations that are worth a try, and a paper's own URL if no usable or stale location has it.

    Dropped: empty URLs, stale ones, and those of publishers or journals that are not open.
    """
    filled = locations.where(F.coalesce("url", F.lit("")) != "")
    usable = filled.where(~F.coalesce("stale", F.lit(False)) & ~(_is_publisher(publishers) & ~F.coalesce("is_oa", F.lit(False))))
    stale = locations.where(F.coalesce("stale", F.lit(False))).select("paper_ord", "url")
    taken = usable.select("paper_ord", "url").unionByName(stale)
    own = papers.where(F.coalesce("open_access_url", F.lit("")) != "").select("paper_ord", F.col("open_access_url").alias("url")).join(taken, ["paper_ord", "url"], "left_anti")
    legacy = own.withColumn("is_oa", F.lit(True)).withColumn("stale", F.lit(False)).withColumn("pos", F.lit(1 << 60))
    return usable.unionByName(legacy, allowMissingColumns=True)


def order_candidates(usable: DataFrame, publishers: Sequence[str] = PUBLISHERS, indexes: Sequence[str] = INDEXES) -> DataFrame:
    """One row per paper and final URL (file URL, else page), best first: position, final_url, is_pdf, tier.

    Order: repositories, unknown hosts, publishers, indexes; within these file URLs, open copies, author versions, URL.
    """
    tier = F.when(A.host_in(A.host_of(F.col("url")), indexes), 3).when(F.lower(F.coalesce("source_type", F.lit(""))) == "repository", 0).when(_is_publisher(publishers), 2).otherwise(1)
    flag = lambda c: F.when(c, 0).otherwise(1)
    has_pdf = F.coalesce("pdf_url", F.lit("")) != ""
    version = F.lower(F.coalesce("version", F.lit(""))).isin("acceptedversion", "submittedversion")
    key = F.struct(tier.alias("t"), flag(has_pdf).alias("p"), flag(F.coalesce("is_oa", F.lit(False))).alias("o"), flag(version).alias("v"), F.col("url").alias("u"), F.col("pos").alias("n"))
    best = usable.select("paper_ord", F.when(has_pdf, F.col("pdf_url")).otherwise(F.col("url")).alias("final_url"), has_pdf.alias("is_pdf"), key.alias("key"))
    best = best.groupBy("paper_ord", "final_url").agg(F.min("key").alias("key"), F.min_by("is_pdf", "key").alias("is_pdf"))
    ranked = best.withColumn("position", F.row_number().over(Window.partitionBy("paper_ord").orderBy("key")))
    return ranked.select("paper_ord", "position", "final_url", "is_pdf", F.col("key.t").alias("tier"))


def insert_preprint(candidates: DataFrame, papers: DataFrame, publishers: Sequence[str] = PUBLISHERS) -> DataFrame:
    """candidates with a paper's preprint file put before its first publisher URL, else last; position counted anew."""
    url = A.preprint_pdf_url(F.col("arxiv_id"), F.col("stable_id"))
    own = papers.select("paper_ord", url.alias("final_url")).where("final_url IS NOT NULL").join(candidates.select("paper_ord", "final_url"), ["paper_ord", "final_url"], "left_anti")
    first = candidates.where(A.host_in(A.host_of(F.col("final_url")), publishers)).groupBy("paper_ord").agg(F.min("position").alias("_first"))
    made = own.join(first, "paper_ord", "left").select("paper_ord", (F.coalesce(F.col("_first").cast("double"), F.lit(1e9)) - 0.5).alias("_at"), "final_url", F.lit(True).alias("is_pdf"), F.lit(True).alias("synthesized"))
    both = candidates.select("paper_ord", F.col("position").cast("double").alias("_at"), "final_url", "is_pdf", F.lit(False).alias("synthesized")).unionByName(made)
    return both.withColumn("position", F.row_number().over(Window.partitionBy("paper_ord").orderBy("_at"))).drop("_at")


def candidates_of(locations: DataFrame, papers: DataFrame, publishers: Sequence[str] = PUBLISHERS, indexes: Sequence[str] = INDEXES) -> DataFrame:
    return insert_preprint(order_candidates(usable_locations(locations, papers, publishers), publishers, indexes), papers, publishers)


#: What a label means for whoever picks a paper.
DETAILS = {
    "direct_pdf": "an open copy's PDF address at {host} is recorded and can be fetched as it is",
    "landing_page": "an open page at {host} is recorded; the PDF address has to be read from it, and an upload may be needed",
    "index_only": "only index pages ({host}) are recorded, which hold no PDF; an open copy is looked up when the analysis starts",
    "publisher_only": "only the publisher's site ({host}) is recorded, which often refuses automatic downloads",
    "doi_link": "only a DOI link is recorded; whether it leads to a PDF depends on where it resolves",
    "doi_only": "no open location is recorded; the DOI is used to look one up when the analysis starts",
    "none": "neither an open location nor a DOI is recorded; the PDF has to be uploaded",
}


def predict_full_text(candidates: DataFrame, papers: DataFrame, publishers: Sequence[str] = PUBLISHERS, indexes: Sequence[str] = INDEXES) -> DataFrame:
    """paper_ord, level, label, detail, host, candidates: what the first https candidate promises.

    Resolver links are lookups, not places: they count only where there is nothing else.
    """
    shaped = candidates.where(A.is_https_shaped(F.col("final_url"))).withColumn("_host", A.host_of(F.col("final_url")))
    usable = ~F.col("_host").isin(*A.DOI_HOSTS)
    best = shaped.groupBy("paper_ord").agg(
        F.count_if(usable).alias("_usable"), F.count(F.lit(1)).alias("_shaped"),
        F.min_by(F.struct("final_url", "is_pdf", "_host"), F.when(usable, F.col("position"))).alias("_best"),
    )
    joined = papers.select("paper_ord", "doi").join(best, "paper_ord", "left")
    tier = A.url_tier(F.col("_best.final_url"), publishers, indexes)
    some, doi, linked = F.coalesce("_usable", F.lit(0)) > 0, F.coalesce("doi", F.lit("")) != "", F.coalesce("_shaped", F.lit(0)) > 0
    label = (
        F.when(some & (tier == 1) & F.col("_best.is_pdf"), "direct_pdf").when(some & (tier == 1), "landing_page").when(some & (tier == 3), "index_only").when(some, "publisher_only")
        .when(doi & linked, "doi_link").when(doi, "doi_only").otherwise("none")
    )
    level = F.when(F.col("label") == "direct_pdf", "direct").when(F.col("label") == "landing_page", "likely").when(F.col("label") == "none", "manual").otherwise("uncertain")
    out = joined.withColumn("label", label).withColumn("level", level)
    host = F.when(some, F.coalesce(F.nullif("_best._host", F.lit("")), F.lit("unknown"))).when(doi, "doi.org")
    count = F.when(some, F.col("_usable")).when(doi & linked, F.col("_shaped")).otherwise(0)
    out = out.withColumn("host", host)
    told = F.create_map(*[F.lit(x) for pair in DETAILS.items() for x in pair])[F.col("label")]
    detail = F.replace(told, F.lit("{host}"), F.coalesce("host", F.lit("")))
    return out.select("paper_ord", "level", "label", detail.alias("detail"), "host", count.cast("long").alias("candidates"))


def availability_counts(availability: DataFrame) -> DataFrame:
    return availability.agg(F.count_if(F.col("level") == "direct").alias("direct"), F.count_if(F.col("level") == "likely").alias("likely"), F.count_if(F.col("level").isin("uncertain", "manual")).alias("manual"))


def mark_stale(locations: DataFrame, gone: DataFrame) -> DataFrame:
    """Locations that the gone URLs newly make stale (only changed rows)."""
    return locations.where(~F.coalesce("stale", F.lit(False))).join(gone.select("url").distinct(), "url", "left_semi").withColumn("stale", F.lit(True))


def clear_stale_urls(papers: DataFrame, gone: DataFrame) -> DataFrame:
    """Papers whose own URL is among the gone ones, without it (only changed rows), lest it become a candidate again."""
    return papers.join(gone.select(F.col("url").alias("open_access_url")).distinct(), "open_access_url", "left_semi").withColumn("open_access_url", F.lit(None).cast("string")).select(*papers.columns)


def classify_fetch(log: DataFrame) -> DataFrame:
    return log.withColumn("outcome", A.fetch_outcome(F.col("status"), F.col("media_type")))


def acquisition_outcome(log: DataFrame, limit: int = 1000) -> DataFrame:
    """Per paper the first URL that worked, else its failures in order (cut), and how many URLs are gone."""
    rows = classify_fetch(log)
    failed = rows.where("outcome <> 'ok'").select("paper_ord", "pos", F.concat_ws(": ", "url", "outcome").alias("f")).distinct()
    # A failure takes more than one character, so no more than `limit` of them show; Spark cuts to these before the shuffle.
    failed = top_per_group(failed, ["paper_ord"], [F.asc("pos"), F.asc("f")], limit, "_n")
    texts = failed.groupBy("paper_ord").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "f"))), lambda x: x["f"]), "; "), 1, limit).alias("failures"))
    firsts = rows.groupBy("paper_ord").agg(F.min_by("url", F.when(F.col("outcome") == "ok", F.struct("pos", "url"))).alias("acquired"), F.count_distinct(F.when(F.col("outcome") == "gone", F.col("url"))).alias("gone_urls"))
    return firsts.join(texts, "paper_ord", "left").withColumn("failures", F.when(F.col("acquired").isNull(), F.col("failures")))


def new_candidates(candidates: DataFrame, attempted: DataFrame) -> DataFrame:
    return candidates.join(attempted.select("paper_ord", F.col("url").alias("final_url")).distinct(), ["paper_ord", "final_url"], "left_anti")


def refresh_candidates(papers: DataFrame, candidates: DataFrame, metadata: DataFrame) -> DataFrame:
    """Papers without a candidate: the file URL that metadata has for their DOI, or the reason why there is none."""
    bare = papers.join(candidates.select("paper_ord").distinct(), "paper_ord", "left_anti").select("paper_ord", "doi")
    found = bare.join(metadata.select("doi", "found_url", "failed"), "doi", "left")
    reason = F.when(F.coalesce("doi", F.lit("")) == "", "no_doi").when(F.coalesce("failed", F.lit(False)), "lookup_failed").when(F.col("found_url").isNull(), "none_found").otherwise("found")
    return found.select("paper_ord", "found_url", reason.alias("reason"))
