"""Evaluation: overlap scores, confusion, task scores, accuracy and layout checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_f1(expected: Column, predicted: Column) -> Column:
    """struct(precision, recall, f1) of two arrays as sets; both empty: 1, one empty: 0."""
    e, p = F.array_distinct(expected), F.array_distinct(predicted)
    both = F.size(F.array_intersect(e, p)).cast("double")
    empty = (F.size(e) == 0) & (F.size(p) == 0)
    ratio = lambda n: F.when(empty, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(both, n), F.lit(0.0)))
    return F.struct(ratio(F.size(p).cast("double")).alias("precision"), ratio(F.size(e).cast("double")).alias("recall"), ratio((F.size(p) + F.size(e)) / 2).alias("f1"))


def confusion(rows: DataFrame, gold: str = "relevant", predicted: str = "predicted") -> DataFrame:
    """TP, FP, FN, TN and precision, recall, F1 to 6 places; empty denominators give 0."""
    g, p = F.col(gold), F.col(predicted)
    counts = rows.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    ratio = lambda a, b: F.bround(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return counts.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _task_f1(expected: Column, predicted: Column) -> Column:
    """F1 of two lists as sets; 0 where they share nothing, also where both are empty."""
    none = F.array().cast("array<string>")
    e, p = F.array_distinct(F.coalesce(expected, none)), F.array_distinct(F.coalesce(predicted, none))
    both = F.size(F.array_intersect(e, p)).cast("double")
    precision, recall = F.try_divide(both, F.size(p)), F.try_divide(both, F.size(e))
    return F.coalesce(F.try_divide(F.lit(2.0) * precision * recall, precision + recall), F.lit(0.0))


def score_tasks(tasks: DataFrame, pass_at: float = 0.8) -> DataFrame:
    """tasks (category, reference, prediction: the structs of `sources.files.TASKS`) with score and passed.

    search: F1 of ids; figure: mean of the count's score and the types' F1; evidence: claims that cite evidence from valid
    sources, over those expected; else: mean of the required fields present and the mean review of five. A score is rounded
    to 6 places, but passes by its full value. An empty list of claims, fields or reviews scores 0, 1 and 0.
    """
    ref, pred = F.col("reference"), F.col("prediction")
    gap = F.abs(ref["count"] - pred["count"]) / F.greatest(F.lit(1), ref["count"])
    count_score = F.lit(1.0) - F.least(F.lit(1.0), gap)
    cited = F.filter(pred["claims"], lambda c: (F.coalesce(F.size(c["evidence_ids"]), F.lit(0)) > 0) & F.coalesce(c["source_valid"], F.lit(False)))
    supported = F.coalesce(F.try_divide(F.size(cited).cast("double"), F.size(ref["claims"])), F.lit(0.0))
    required = F.array_distinct(ref["required_fields"])
    present = F.coalesce(F.try_divide(F.size(F.array_intersect(required, pred["present_fields"])).cast("double"), F.size(required)), F.lit(1.0))
    reviews = F.coalesce(F.try_divide(F.aggregate(pred["review_scores"], F.lit(0.0), lambda a, x: a + x), F.size(pred["review_scores"]) * F.lit(5.0)), F.lit(0.0))
    score = (
        F.when(F.col("category") == "search", _task_f1(ref["relevant_ids"], pred["selected_ids"])).when(F.col("category") == "figure", (count_score + _task_f1(ref["types"], pred["types"])) / 2)
        .when(F.col("category") == "evidence", supported).otherwise((present + reviews) / 2)
    )
    whole = tasks.withColumn("score", score)
    return whole.withColumn("passed", F.col("score") >= pass_at).withColumn("score", F.bround("score", 6))


def run_aggregate(results: DataFrame) -> DataFrame:
    """Mean score and pass rate by category, and overall (category null)."""
    return results.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg(F.col("score").cast("double")), 6).alias("mean_score"), F.bround(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"))


def class_accuracy(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Correct, total and accuracy to 3 places by gold class, and overall (class null)."""
    right = F.count_if(F.col(gold) == F.col(predicted))
    return rows.rollup(gold).agg(right.alias("correct"), F.count(F.lit(1)).alias("total"), F.bround(right / F.count(F.lit(1)), 3).alias("accuracy"))


def layout_quality(documents: DataFrame) -> DataFrame:
    """Flags of a parsed document against its gold columns, and whether all hold."""
    flags = {
        "label_found": "array_contains(figure_labels, gold_label)", "page_right": "figure_page = gold_page", "mentions_found": "size(array_except(gold_mention_pages, mention_pages)) = 0",
        "header_absent": "NOT contains(body_text, gold_header)", "page_numbers": "n_page_numbers >= n_pages", "references_excluded": "NOT array_contains(evidence_pages, gold_references_page)",
        "sections_typed": "size(array_except(gold_section_types, section_types)) = 0",
    }
    out = documents.select("*", *[F.coalesce(F.expr(sql), F.lit(False)).alias(name) for name, sql in flags.items()])
    every = F.lit(True)
    for name in flags:
        every = every & F.col(name)
    return out.withColumn("all_pass", every)


def split(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that keep, and the rest (null counts as no)."""
    yes = F.coalesce(keep, F.lit(False))
    return df.where(yes), df.where(~yes)


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0
