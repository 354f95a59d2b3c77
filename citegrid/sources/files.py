"""Landed files: parsed documents, binaries, evaluation sets; sinks and pluggable readers."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .batches import batch_of, frame_of, pieces

_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
PARSED = (
    "document_id string, file_sha256 string, page_count int, pages array<struct<page_number:int,text:string>>, sections array<struct<title:string,type:string,start_page:int,end_page:int>>, "
    f"figures array<struct<figure_id:string,label:string,page_number:int,caption:string,type:string,path:string,bbox:{_BOX}>>, tables array<struct<label:string,page_number:int,caption:string,cells:array<array<string>>>>"
)
_CLAIM = "struct<evidence_ids:array<string>,source_valid:boolean>"
#: One struct holds the fields of all categories of tasks; a task has those of its own.
TASKS = (
    "dataset_id string, tasks array<struct<task_id:string,category:string,reference:struct<relevant_ids:array<string>,count:int,types:array<string>,claims:array<string>,required_fields:array<string>>,"
    f"prediction:struct<selected_ids:array<string>,count:int,types:array<string>,claims:array<{_CLAIM}>,present_fields:array<string>,review_scores:array<double>>,scoring:string>>"
)
CHILDREN = ("pages", "sections", "figures", "tables")


def read_parsed(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """One table per child list of landed documents (a file each, or a line each), each row with its document and place (ord)."""
    docs = spark.read.schema(PARSED).option("multiLine", multi_line).json(path)
    return {c: docs.select("document_id", F.posexplode(c).alias("ord", "r")).select("document_id", "ord", "r.*") for c in CHILDREN}


def land_binaries(spark: SparkSession, path: str, max_bytes: int = 50 << 20, magic: str = "%PDF-", suffix: str = ".pdf", known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Files that may enter (path, length, sha256, is_new; one a content), and the others with the reason.

    A content that `known` (path, sha256) has gives that earlier entry instead, and is not new. Only length and hash leave the
    scan; contents are never shuffled. Spark's file scan leaves empty files out.
    """
    files = spark.read.format("binaryFile").load(path)
    begins = F.decode(F.substring("content", 1, len(magic)), "ISO-8859-1") == magic
    reason = F.when(~F.endswith(F.lower("path"), F.lit(suffix)), "suffix").when(F.col("length") > max_bytes, "too large").when(~begins, "not a pdf")
    slim = files.select("path", "length", F.sha2("content", 256).alias("sha256"), reason.alias("reason"))
    good = slim.where("reason IS NULL").groupBy("sha256").agg(F.min("path").alias("path"), F.min_by("length", "path").alias("length"))
    if known is None:
        good = good.withColumn("is_new", F.lit(True))
    else:
        had = known.groupBy("sha256").agg(F.min("path").alias("_had"))
        good = good.join(had, "sha256", "left").withColumn("is_new", F.col("_had").isNull()).withColumn("path", F.coalesce("_had", "path")).drop("_had")
    return good, slim.where("reason IS NOT NULL")


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of evaluation sets, one row each."""
    return spark.read.schema(TASKS).option("multiLine", True).json(path).select("dataset_id", F.explode("tasks").alias("t")).select("dataset_id", "t.*")


def write_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_sink(df: DataFrame, path: str, checkpoint: str | None = None):
    """Append to a Parquet table; a stream is started and returned."""
    if df.isStreaming:
        return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    df.write.mode("append").parquet(path)
    return None


def judge_batch(df: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame], schema: str, error_column: str = "judge_error") -> DataFrame:
    """Rows that a user's model gives for batches of df; of a batch that fails each row is judged alone.

    A row that fails alone gives one row with the error, and the columns that schema and df share, so that what is lost
    does not depend on how rows fall into batches. A batch is a piece of 4 MB, or one row, of what Spark sends (up to 64 MB),
    as mapInPandas would show it: only the piece stands as Python values.
    """
    whole_schema = f"{schema}, {error_column} string"
    to, zone = to_arrow_schema(StructType.fromDDL(whole_schema)), df.sparkSession.conf.get("spark.sql.session.timeZone")
    names = to.names[:-1]

    def failed(row: pd.DataFrame, error: Exception) -> pd.DataFrame:
        return row.reindex(columns=names).assign(**{error_column: f"{type(error).__name__}: {error}"})

    def judged(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        try:
            yield judge(part).reindex(columns=names).assign(**{error_column: None})
        except Exception as e:  # noqa: BLE001  a judge's failure is data
            if len(part) == 1:
                yield failed(part, e)
            else:
                for i in range(len(part)):
                    yield from judged(part.iloc[[i]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for piece in pieces(whole):
                yield from (batch_of(frame, to, zone) for frame in judged(frame_of(piece)))
            del whole, piece
            gc.collect()  # frames that stand in circles keep the batch whose buffers they share

    return df.mapInArrow(run, whole_schema)


class LandedPapers(DataSource):
    """A reader for register_source to start from: Parquet files of papers wherever pyarrow's file systems reach.

    Options: path, a folder's URI. Each file is a partition; comparisons of the year are pushed down to the files' statistics
    and rows, and only the columns of the schema are read; rows come as Arrow batches.
    """

    @classmethod
    def name(cls) -> str:
        return "landed_papers"

    def schema(self) -> str:
        return "ord long, stable_id string, title string, year int, citation_count int"

    def reader(self, schema) -> DataSourceReader:
        return _PapersReader(self.options["path"], [f.name for f in schema])


class _PapersReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.bounds = path, columns, []

    def pushFilters(self, filters):  # noqa: N802  Spark's name
        for f in filters:
            op = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}.get(type(f))
            if op and f.attribute == ("year",):
                self.bounds.append((op, f.value))
            else:
                yield f  # Spark applies what is not taken over

    def partitions(self) -> list[InputPartition]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(self.path)
        return [InputPartition(f) for f in sorted(ds.dataset(folder, filesystem=store, format="parquet").files)]

    def read(self, partition: InputPartition):
        import operator

        import pyarrow.dataset as ds
        from pyarrow import fs

        test = None
        for op, value in self.bounds:
            one = {"==": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}[op](ds.field("year"), value)
            test = one if test is None else test & one
        store, _ = fs.FileSystem.from_uri(self.path)
        yield from ds.dataset(partition.value, filesystem=store, format="parquet").to_batches(columns=self.columns, filter=test)


def register_source(spark: SparkSession, reader: type[DataSource]) -> str:
    """Make a Python data source available to spark.read.format(name); gives the name."""
    if not issubclass(reader, DataSource):
        raise TypeError(f"{reader.__name__} is no DataSource")
    spark.dataSource.register(reader)
    return reader.name()
