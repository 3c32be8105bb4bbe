"""Shared pieces of the llm operators: table access, shared scratch tables, span helpers."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the given folder, read by Spark only (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where it is unset, one of its own in local mode, else an error."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="quantjobs-")
        spark.sparkContext.setCheckpointDir(place)
    return place


#: Paths that ``saved`` has written since the calls of ``finished`` now under way began, innermost last.
_written = threading.local()


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quantjobs-{name}-{uuid.uuid4().hex}"
    for paths in getattr(_written, "stack", [])[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The result of ``make``, saved; the tables that it saved on the way, on which nothing rests any more, are removed."""
    stack = _written.stack = getattr(_written, "stack", [])
    stack.append([])
    try:
        out = make()
        steps, stack[-1] = stack[-1], []
    finally:
        stack.pop()
    out = saved(out, name)
    context = out.sparkSession.sparkContext
    for path in steps:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
    return out


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Keeps Arrow batches of whole texts small, so that Python workers need little memory. A smaller setting stays.

    The results of the operators are lazy, so the session's setting can't be put back behind them.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def whole_text(col: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def spread(df: DataFrame, *cols: str, by: int = 1) -> DataFrame:
    """``df`` dealt out over the session's shuffle partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * by
    return df.repartition(n, *cols)


def span_string(spans: str, kinds: list[str]) -> Column:
    """``kind:start:end`` of an array of (start, rank, end), by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(
            F.array_sort(F.col(spans)),
            lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names in any case; an operator's output replaces such columns."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def with_columns_of(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with further columns."""
    return StructType([*df.schema.fields, *_parse_datatype_string(ddl).fields])
