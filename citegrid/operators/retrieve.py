"""Search: concept filter, lexical score, judgements, ranking and caps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.layout import useful_section
from .ranking import rank_in_groups, top_per_group

#: Distinct terms up to which phrases are literals of the plan; above, they are joined by their words.
LITERAL_TERMS = 1000


@dataclass(frozen=True)
class Request:
    """What is searched for."""

    question: str
    keywords: tuple[str, ...] = ()
    year_from: int | None = None
    year_to: int | None = None
    maximum_papers: int = 5


def _terms(values: Sequence[str]) -> list[str]:
    import re

    return [t for t in (" ".join(re.sub(r"[^\w\s]", " ", v.lower()).split()) for v in values) if t]


def search_text() -> Column:
    """Title and abstract as phrases are looked for in them: whole texts, so case is lowered where they lie."""
    return T.normalize_title(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit(""))), "lower")


def concept_filter(papers: DataFrame, groups: Sequence[Sequence[str]], excluded: Sequence[str], literal_terms: int = LITERAL_TERMS) -> DataFrame:
    """papers with matched (terms found, in group order, repeats kept) and included.

    A paper is included if a term of any group stands in it as whole words (or there is no group) and no excluded term
    does. Term lists above literal_terms are joined by their word runs rather than written into the plan.
    """
    wanted, banned = [t for g in groups for t in _terms(g)], _terms(excluded)
    if len(wanted) + len(banned) > literal_terms:
        return _concept_join(papers, wanted, banned)
    # The text is bound with its padding, once; each term is a search for a literal.
    hit = lambda x, t: F.contains(x, F.lit(f" {t} "))
    either = lambda tests: reduce(Column.__or__, tests, F.lit(False))
    matched = lambda x: F.array_compact(F.array(*[F.when(hit(x, t), t) for t in wanted]).cast("array<string>"))
    found = T.bind(T.padded(search_text()), lambda x: F.struct(matched(x).alias("matched"), either([hit(x, t) for t in banned]).alias("banned")))
    keyed = papers.withColumn("_found", found).withColumn("matched", F.col("_found.matched"))
    return keyed.withColumn("included", ((F.size("matched") > 0) | F.lit(not wanted)) & ~F.col("_found.banned")).drop("_found")


def _concept_join(papers: DataFrame, wanted: list[str], banned: list[str]) -> DataFrame:
    """The same by an equi-join on runs of words; needs a column ord that tells papers apart."""
    rows = [(t, i, False) for i, t in enumerate(wanted)] + [(t, i, True) for i, t in enumerate(banned)]
    terms = papers.sparkSession.createDataFrame(rows, "term string, place int, banned boolean")
    longest = max((t.count(" ") + 1 for t in wanted + banned), default=1)

    def runs(words: Column) -> Column:
        """Runs of 1 to `longest` words, each length from the one before and the words that follow."""
        out, grams = [words], words
        for n in range(2, longest + 1):
            grams = F.zip_with(grams, F.slice(words, n, F.greatest(F.lit(0), F.size(words) - n + 1)), lambda a, b: F.concat(a, F.lit(" "), b))
            out.append(grams)
        return F.array_distinct(F.array_compact(F.flatten(F.array(*out))))

    hits = papers.select("ord", F.explode(T.bind(F.split(search_text(), " "), runs)).alias("term")).join(terms, "term")
    found = hits.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.when(~F.col("banned"), F.struct("place", "term")))), lambda x: x["term"]).alias("matched"), F.bool_or("banned").alias("_banned"))
    out = papers.join(found, "ord", "left").withColumn("matched", F.coalesce("matched", F.array().cast("array<string>")))
    return out.withColumn("included", ((F.size("matched") > 0) | F.lit(not wanted)) & ~F.coalesce("_banned", F.lit(False))).drop("_banned")


def filter_or_all(papers: DataFrame, keep: str, by: str) -> DataFrame:
    """Rows with keep; all rows of a group of which none has it, with fallback_used."""
    kept = papers.groupBy(by).agg(F.count_if(F.col(keep)).alias("_kept"), F.count(F.lit(1)).alias("group_rows"))
    joined = papers.join(kept, by)
    return joined.withColumn("fallback_used", F.col("_kept") == 0).where(F.col(keep) | F.col("fallback_used")).withColumnRenamed("_kept", "group_kept")


def lexical_score(title: Column, abstract: Column, year: Column, request: Request) -> Column:
    """0.50 title + 0.30 abstract + 0.15 keyword + 0.05 recency overlap, clipped and rounded half-even to 6 places."""
    goal, words = T.plain_tokens(" ".join([request.question, *request.keywords])), T.plain_tokens(" ".join(request.keywords))
    if not goal:
        return F.lit(0.0)
    recency = F.lit(0.0)
    if request.year_from is not None and request.year_to is not None:
        span = float(max(1, request.year_to - request.year_from))
        recency = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (year - request.year_from) / F.lit(span))), F.lit(0.0))
    share = lambda part, whole: F.size(F.array_intersect(F.array(*map(F.lit, whole)), part)).cast("double") / len(whole)

    def score(s: Column) -> Column:
        in_title = share(s["title"], goal)
        keyword = share(F.concat(s["title"], s["body"]), words) if words else in_title
        return F.lit(0.5) * in_title + F.lit(0.3) * share(s["body"], goal) + F.lit(0.15) * keyword + F.lit(0.05) * recency

    # The goal's terms in title and abstract are found once, and bound; what else stands there does not count.
    found = F.struct(T.tokens_among(title, goal).alias("title"), T.tokens_among(abstract, goal).alias("body"))
    return T.bind(found, lambda s: F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score(s))), 6))


def with_lexical_score(papers: DataFrame, request: Request) -> DataFrame:
    return papers.withColumn("lexical_score", lexical_score(F.col("title"), F.col("abstract"), F.col("year"), request))


def lexical_candidates(papers: DataFrame, request: Request, top_n: int = 10, by: Sequence[str] = ("request_id",)) -> DataFrame:
    """The rows that a judge is shown: the first min(top_n, max(maximum_papers, 3)) of each request."""
    n = min(top_n, max(request.maximum_papers, 3))
    return top_per_group(papers, by, [F.desc("lexical_score"), F.asc("stable_id")], n, "lex_rank")


def attach_decisions(papers: DataFrame, decisions: DataFrame) -> DataFrame:
    """papers with the last decision on each (include, semantic, reason, aspects); decisions on others are ignored."""
    last = decisions.groupBy("stable_id").agg(F.max_by(F.struct("include", "semantic", "reason", "aspects"), "ord").alias("_d"))
    return papers.join(last, "stable_id", "left").select(*[papers[c] for c in papers.columns], "_d.include", "_d.semantic", "_d.reason", "_d.aspects")


def final_rank(papers: DataFrame, question: str, by: Sequence[str] = ("request_id",), limit: int | None = None) -> DataFrame:
    """Judged papers by their judgement, then the others by lexical score; rejected ones go.

    With a limit, Spark cuts each request to it before the shuffle; without one, the ranks of a request come from a
    range shuffle, so that a request with very many papers is no single sort. ord tells a request's papers apart.
    """
    left = papers.where(F.coalesce("include", F.lit(True)))
    tier = F.when(F.col("semantic").isNotNull(), 0).otherwise(1)
    order = [tier, F.desc("semantic"), F.desc("lexical_score"), F.asc("stable_id")]
    final = F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("semantic", "lexical_score"))), 6)
    shared = F.array_sort(F.array_intersect(T.tokens(F.lit(question)), T.tokens(F.col("title"))))
    if limit is None:
        # Only what orders a paper is written and sorted; its scores are not made again, and the rest of it is joined to its rank.
        slim = rank_in_groups(left.select(*by, "ord", "semantic", "lexical_score", "stable_id"), by, order, "rank").drop("stable_id")
        keys = [*by, "ord"]
        rest = left.select(*[c for c in papers.columns if c in keys or c not in ("semantic", "lexical_score")])
        ranked = rest.join(slim, keys).select(*papers.columns, "rank")
    else:
        ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= limit)
    return ranked.withColumn("final_score", final).withColumn("matched_aspects", F.when(F.col("semantic").isNotNull(), F.col("aspects")).otherwise(shared))


def select_top(ranked: DataFrame, n: int) -> DataFrame:
    return ranked.where(F.col("rank") <= n)


def cap_per_query(papers: DataFrame, maximum_papers: int, query: str = "query") -> DataFrame:
    """The first min(30, max(2 * maximum_papers, 10)) rows of each query."""
    return top_per_group(papers, [query], [F.asc("ord")], min(30, max(2 * maximum_papers, 10)), "query_rank")


def enrich_abstracts(papers: DataFrame, metadata: DataFrame, cap: int = 10, by: str = "request_id") -> DataFrame:
    """Blank abstracts and years of the first `cap` papers of a request with an arXiv id, filled from metadata as they came."""
    open_rows = papers.where((F.coalesce("arxiv_id", F.lit("")) != "") & (T.strip(F.coalesce("abstract", F.lit(""))) == ""))
    first = top_per_group(open_rows.select(by, "ord", "arxiv_id"), [by], [F.asc("ord")], cap).select("ord", "arxiv_id")
    found = first.join(metadata.select("arxiv_id", F.col("abstract").alias("_abstract"), F.col("year").alias("_year")), "arxiv_id").drop("arxiv_id")
    out = papers.join(found, "ord", "left")
    return out.withColumn("abstract", F.when(F.coalesce(T.strip(F.col("_abstract")), F.lit("")) != "", F.col("_abstract")).otherwise(F.col("abstract"))).withColumn("year", F.coalesce("year", "_year")).drop("_abstract", "_year")


def search_counters(papers: DataFrame, key: str, included: Column, maximum_papers: int) -> DataFrame:
    """One row of stage counts (raw, unique by key, kept of the first records, selected, duplicates, dropped).

    One pass: records of a key are counted with map-side combine, and the first one by ord tells whether the key is kept.
    """
    each = papers.select(key, "ord", included.alias("_in")).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min_by("_in", "ord").alias("_in"))
    counts = each.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_raw"), F.count(F.lit(1)).alias("n_unique"), F.count_if("_in").alias("n_kept"))
    counts = counts.withColumn("n_selected", F.least("n_kept", F.lit(maximum_papers).cast("long")))
    return counts.withColumn("n_duplicates", F.col("n_raw") - F.col("n_unique")).withColumn("n_dropped", F.col("n_unique") - F.col("n_kept"))


def source_summary(status: DataFrame, papers: DataFrame) -> DataFrame:
    """Latency of the slowest source that answered, failures, and the merged size."""
    head = status.agg(F.max(F.when(F.col("ok"), F.col("latency_ms"))).alias("latency_ms"), F.count_if(~F.col("ok")).alias("failed"))
    return head.join(F.broadcast(papers.agg(F.count(F.lit(1)).alias("total"))), F.lit(True))


def search_cards(papers: DataFrame, text: str) -> DataFrame:
    """Papers whose title or authors hold the text, case aside."""
    return papers.where(F.contains(F.lower(F.concat_ws(" ", "title", F.array_join("authors", " "))), F.lit(text.lower())))


def compact(papers: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """What a judge reads of a paper: id, title, year and the relevant snippet."""
    return papers.select("stable_id", "title", "year", T.relevant_snippet(F.coalesce("abstract", F.lit("")), terms, limit).alias("snippet"))


def compact_evidence(evidence: DataFrame) -> DataFrame:
    """What a model reads of evidence: id, type, page, a useful section title, and claim and excerpt cut to length."""
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n).alias(c)
    return evidence.select("evidence_id", F.col("evidence_type").alias("type"), "page", useful_section(F.col("section")).alias("section"), cut("claim", 900), cut("excerpt", 1000))
