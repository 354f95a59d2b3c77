"""Record resolution: merging, de-duplication, latest rows and upserts.

"First" always means the smallest `ord`, which every landed table carries. Group keys may be hot, so what is collected
is limited to the short lists that a merged record holds; everything else is a mergeable aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_title
from ..sources.scratch import written


def paper_key(papers: DataFrame) -> DataFrame:
    """papers with stable_key: DOI, else source id, else title and year."""
    title = F.concat(F.lit("title:"), normalize_title(F.col("title")), F.lit(":"), F.coalesce(F.col("year").cast("string"), F.lit("unknown")))
    key = F.coalesce(F.concat(F.lit("doi:"), F.nullif("doi", F.lit(""))), F.concat(F.lit("openalex:"), F.lower(F.nullif("source_id", F.lit("")))), title)
    return papers.withColumn("stable_key", key)


def merge_key(papers: DataFrame) -> DataFrame:
    """papers with merge_key: DOI, else arXiv id, else title and year."""
    title = F.concat(F.lit("title:"), normalize_title(F.col("title")), F.lit(":"), F.coalesce(F.col("year").cast("string"), F.lit("None")))
    key = F.coalesce(F.concat(F.lit("doi:"), F.nullif("doi", F.lit(""))), F.concat(F.lit("arxiv:"), F.nullif("arxiv_id", F.lit(""))), title)
    return papers.withColumn("merge_key", key)


def _distinct_in_order(value: str, keys: list[str], rows: DataFrame) -> DataFrame:
    """For each key, the distinct values in order of first use: one row a value first, so a hot key stays short."""
    firsts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min("ord").alias("_o"))
    return firsts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias(f"{value}s"))


def first_filled(value: str) -> Column:
    """The first value, in order, that is neither null nor empty."""
    return F.min_by(value, F.when(F.coalesce(F.col(value), F.lit("")) != "", F.col("ord"))).alias(value)


def _first_record(papers: DataFrame, taken: set[str]) -> Column:
    """The first record's other columns, as one struct."""
    return F.min_by(F.struct(*[c for c in papers.columns if c not in taken]), "ord").alias("_first")


def merge_sources(papers: DataFrame) -> DataFrame:
    """One row per merge key: the whole first record, with first filled texts, most citations, and the lists of all.

    First filled are abstract, doi, arxiv_id, open_access_url, venue and publisher; sources and queries are distinct in
    order, source_records has the (source, id) of every record in order. Further columns are the first record's.
    """
    keyed, fills = merge_key(papers), [c for c in ("abstract", "doi", "arxiv_id", "open_access_url", "venue", "publisher") if c in papers.columns]
    made = {*fills, "ord", "citation_count", "source", "query", "merge_key"}
    merged = keyed.groupBy("merge_key").agg(
        F.min("ord").alias("group_ord"), _first_record(keyed, made), *[first_filled(c) for c in fills],
        F.max("citation_count").alias("citation_count"), F.count(F.lit(1)).alias("records"),
    )
    merged = merged.select("*", "_first.*").drop("_first")
    own_id = F.col("source_id") if "source_id" in papers.columns else F.col("stable_id")
    records = keyed.groupBy("merge_key", "source", own_id.alias("id")).agg(F.sort_array(F.collect_list("ord")).alias("_o"))
    told = records.select("merge_key", F.explode("_o").alias("_o"), "source", "id").groupBy("merge_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "source", "id"))), lambda x: F.struct(x["source"].alias("source"), x["id"].alias("id"))).alias("source_records"))
    lists = [_distinct_in_order(c, ["merge_key"], keyed).withColumnRenamed("querys", "queries") for c in ("source", "query")]
    return merged.join(lists[0], "merge_key", "left").join(lists[1], "merge_key", "left").join(told, "merge_key", "left")


def deduplicate(papers: DataFrame) -> DataFrame:
    """One row per stable key: the whole first record, with the longest abstract of its group (the first of these), the first
    filled DOI, most citations and the ordered queries."""
    keyed = paper_key(papers)
    longest = F.struct(F.char_length(F.coalesce("abstract", F.lit(""))), -F.col("ord"))
    made = {"ord", "abstract", "doi", "citation_count", "query", "stable_key"}
    unique = keyed.groupBy("stable_key").agg(
        F.min("ord").alias("group_ord"), _first_record(keyed, made), first_filled("doi"),
        F.max_by("abstract", longest).alias("abstract"), F.max("citation_count").alias("citation_count"), F.count(F.lit(1)).alias("records"),
    ).select("*", "_first.*").drop("_first")
    return unique.join(_distinct_in_order("query", ["stable_key"], keyed).withColumnRenamed("querys", "queries"), "stable_key", "left")


def duplicate_report(papers: DataFrame) -> DataFrame:
    """Groups of more than one record: key, size, the members' ids in order, and the line for the log."""
    slim = paper_key(papers).select("stable_key", "ord", "source_id")
    several = slim.groupBy("stable_key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = slim.join(several, "stable_key").groupBy("stable_key", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source_id"))), lambda x: x["source_id"]).alias("members"))
    return members.withColumn("log", F.format_string("Merged %d records using %s", "size", "stable_key"))


def dedup_by_hash(df: DataFrame, scope: Sequence[str], hash_col: str, ord_col: str) -> DataFrame:
    """The first row of each (scope, hash)."""
    names = [c for c in df.columns if c not in (*scope, hash_col)]
    best = df.groupBy(*scope, hash_col).agg(F.min_by(F.struct(*names), ord_col).alias("_r"))
    return best.select(*scope, hash_col, "_r.*").select(*df.columns)


def latest_per_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """The row of each key that is last by order_cols; partial aggregation, so a hot key is no single sort."""
    names = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(*order_cols)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """base with updates laid over it by key; of several rows of a key, the last by order_col, updates first."""
    tagged = base.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(tagged, keys, ("_new", order_col)).drop("_new")


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at path, or None where nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def upsert_into(path: str, updates: DataFrame, keys: Sequence[str], order_col: str, parts: int = 64) -> list[int]:
    """Lay updates over the table at path, which is parted by a hash of its keys (_part); the parts that were written again.

    Rows that the table has already, as they are, touch nothing. Of the others' parts alone the rows are read, merged and written over
    (each part's files are replaced by Spark's dynamic partition overwrite); files of other parts stay as they are. Doing the
    same again changes nothing, so a stream may call this for each of its batches, and again for one that it repeats.
    Columns must have types that can be compared; a table keeps the number of parts that it began with.
    """
    spark, names = updates.sparkSession, updates.columns
    own = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("_part")
    fresh, base = updates.select("*", own), stored(spark, path)
    if base is not None:
        parts_met = [r["_part"] for r in fresh.select("_part").distinct().collect()]  # as many as the table has parts at most
        had = base.where(F.col("_part").isin(parts_met)).select(*[F.col(c).alias(f"_had_{c}") for c in names], F.col("_part").alias("_had_part"))
        same = [F.equal_null(F.col(c), F.col(f"_had_{c}")) for c in names]
        fresh = fresh.join(had, [F.col("_part") == F.col("_had_part"), *same], "left_anti")
    fresh = written(fresh, "fresh")
    touched = sorted(r["_part"] for r in fresh.select("_part").distinct().collect())
    if touched:
        old = fresh.limit(0) if base is None else base.where(F.col("_part").isin(touched)).select(*names, "_part")
        merged = written(upsert(old, fresh, keys, order_col), "merged")
        merged.repartition("_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)
    return touched


def first_seen(df: DataFrame, key: str, ord_col: str = "ord") -> DataFrame:
    """Distinct keys with group_ord, their number in order of first use (one row a key before the global order)."""
    from ..operators.ranking import global_rank

    return global_rank(df.groupBy(key).agg(F.min(ord_col).alias("first_ord")), [F.col("first_ord")], "group_ord")
