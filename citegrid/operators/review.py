"""Claims, the evidence they cite, and the order in which people review it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import global_rank


def flatten_claims(wide: DataFrame, id_cols: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per claim of the array columns `fields`: ids, field_no, field, pos and the claim's columns."""
    rows = F.array(*[F.struct(F.lit(i).alias("field_no"), F.lit(f).alias("field"), F.col(f).alias("claims")) for i, f in enumerate(fields)])
    by_field = wide.select(*id_cols, F.explode(rows).alias("_f")).select(*id_cols, "_f.field_no", "_f.field", F.posexplode("_f.claims").alias("pos", "_c"))
    return by_field.select(*id_cols, "field_no", "field", "pos", "_c.*")


def explode_citations(claims: DataFrame, refs: DataFrame) -> DataFrame:
    """A row for each evidence that a supported claim cites, with the claim's number of citations."""
    sizes = refs.groupBy("claim_ord").agg(F.count(F.lit(1)).alias("evidence_count"))
    cited = claims.where("kind = 'supported'").join(sizes, "claim_ord")
    return cited.join(refs, "claim_ord").select("evidence_id", "claim_ord", "pos", "paper_id", "field_no", "scope", "value", "evidence_count")


def citation_index(citations: DataFrame) -> DataFrame:
    """evidence_id, cited_by, supports_comparison, first and last citing claim: mergeable, whatever the fan-in."""
    return citations.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("cited_by"), F.bool_or(F.col("scope") == "comparison").alias("supports_comparison"), F.min("claim_ord").alias("first_claim"), F.max("claim_ord").alias("last_claim"))


def review_targets(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """The first claim that cites each figure or table."""
    visual = evidence.where(F.col("evidence_type").isin("figure", "table")).select("evidence_id")
    return citations.join(visual, "evidence_id", "left_semi").groupBy("evidence_id").agg(F.min_by(F.struct("claim_ord", "value"), F.struct("claim_ord", "pos")).alias("_c")).select("evidence_id", "_c.claim_ord", "_c.value")


def impact_preview(citations: DataFrame) -> DataFrame:
    """What excluding each evidence would do: claims that lose their only source, and those that keep others."""
    alone = F.col("evidence_count") == 1
    return citations.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("cited_total"), F.count_if(alone).alias("downgrade"), F.count_if(~alone).alias("retained"), F.bool_or(F.col("scope") == "comparison").alias("supports_comparison"))


def priority_score(cited_by: Column, supports_comparison: Column, doubted: Column, confidence: Column) -> Column:
    flag = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.lit(0.45) * F.least(cited_by.cast("double"), F.lit(5.0)) / F.lit(5.0) + F.lit(0.25) * flag(supports_comparison) + F.lit(0.20) * flag(doubted) + F.lit(0.10) * (F.lit(1.0) - confidence)


def build_queue(evidence: DataFrame, reviews: DataFrame, index: DataFrame) -> DataFrame:
    """Evidence left to review: segment and priority.

    Excluded rows go, so do rows that a person decided without doubt, and text that no claim cites. Doubted and cited is
    high_risk; undecided by people, a figure or table, and cited twice or more is high_impact; the rest is normal.
    """
    joined = evidence.join(reviews.select("evidence_id", "status", "source"), "evidence_id", "left").join(index.select("evidence_id", "cited_by", "supports_comparison"), "evidence_id", "left")
    cited, doubted = F.coalesce("cited_by", F.lit(0)), F.coalesce(F.col("status") == "doubted", F.lit(False))
    human = F.coalesce(F.col("source") == "human", F.lit(False))
    left = joined.where(~F.coalesce(F.col("status") == "excluded", F.lit(False)) & ~(human & ~doubted) & ~((cited == 0) & (F.col("evidence_type") == "text")))
    segment = F.when(doubted & (cited > 0), "high_risk").when(~human & (cited >= 2) & F.col("evidence_type").isin("figure", "table"), "high_impact").otherwise("normal")
    score = priority_score(cited, F.coalesce("supports_comparison", F.lit(False)), doubted, F.col("confidence").cast("double"))
    return left.withColumn("segment", segment).withColumn("priority", F.bround(score, 9)).withColumn("cited_by", cited).drop("supports_comparison")


def filter_segment(queue: DataFrame, segment: str) -> DataFrame:
    return queue if segment == "all" else queue.where(F.col("segment").isin("high_risk", "high_impact"))


def order_queue(queue: DataFrame) -> DataFrame:
    """queue with position, from the highest priority on."""
    return global_rank(queue, [F.desc("priority"), F.asc("ord")], "position")


def queue_stats(queue: DataFrame, reviews: DataFrame) -> DataFrame:
    counts = queue.agg(F.count_if(F.col("segment") == "high_risk").alias("high_risk"), F.count_if(F.col("segment") == "high_impact").alias("high_impact"), F.count(F.lit(1)).alias("actionable"))
    return counts.join(F.broadcast(reviews.agg(F.count_if(F.col("status") == "excluded").alias("excluded"))), F.lit(True))


def undecided(evidence: DataFrame, reviews: DataFrame) -> DataFrame:
    """Evidence without a review that says more than unreviewed."""
    return evidence.join(reviews.where("status <> 'unreviewed'").select("evidence_id"), "evidence_id", "left_anti")


def drop_excluded(evidence: DataFrame, reviews: DataFrame) -> DataFrame:
    return evidence.join(reviews.where("status = 'excluded'").select("evidence_id"), "evidence_id", "left_anti")


def inline_evidence(claims: DataFrame, refs: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims with the evidence they cite as an array in citation order; ids without a row are left out."""
    found = refs.join(evidence.select("evidence_id", "evidence_type", "page"), "evidence_id")
    lists = found.groupBy("claim_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "evidence_id", "evidence_type", "page"))), lambda x: F.struct(x["evidence_id"], x["evidence_type"], x["page"])).alias("evidence"))
    none = F.array().cast(lists.schema["evidence"].dataType)
    return claims.join(lists, "claim_ord", "left").withColumn("evidence", F.coalesce("evidence", none))


def consensus(checks: DataFrame) -> DataFrame:
    """doubted if any check is inconsistent, confirmed if all are consistent, else null; and counts."""
    n = {s: F.count_if(F.col("status") == s) for s in ("consistent", "inconsistent", "unverifiable")}
    rows = checks.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("n_checks"), *[c.alias(f"n_{s}") for s, c in n.items()])
    return rows.withColumn("status", F.when(F.col("n_inconsistent") > 0, "doubted").when(F.col("n_consistent") == F.col("n_checks"), "confirmed"))


def high_risk_count(citations: DataFrame, reviews: DataFrame) -> DataFrame:
    """Doubted evidence that a supported claim cites."""
    return reviews.where("status = 'doubted'").join(citations.select("evidence_id").distinct(), "evidence_id", "left_semi").agg(F.count(F.lit(1)).alias("high_risk"))


def cited_ids(claims: DataFrame, refs: DataFrame) -> DataFrame:
    """paper_id and each distinct evidence id that its claims cite."""
    return claims.select("claim_ord", "paper_id").join(refs.select("claim_ord", "evidence_id"), "claim_ord").select("paper_id", "evidence_id").distinct()


def sanitize_claims(claims: DataFrame, refs: DataFrame, allowed: DataFrame) -> DataFrame:
    """Claims with a citation that is not allowed become inferences without citations."""
    bad = refs.join(allowed.select("evidence_id").distinct(), "evidence_id", "left_anti").select("claim_ord").distinct().withColumn("_bad", F.lit(True))
    sizes = refs.groupBy("claim_ord").agg(F.count(F.lit(1)).alias("n_refs"))
    joined = claims.join(bad, "claim_ord", "left").join(sizes, "claim_ord", "left")
    return joined.withColumn("kind", F.when(F.col("_bad"), "inference").otherwise(F.col("kind"))).withColumn("n_refs", F.when(F.col("_bad"), 0).otherwise(F.coalesce("n_refs", F.lit(0))).cast("long")).drop("_bad")
