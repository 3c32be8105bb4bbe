"""Reading, cleaning, merging and publishing of the domain tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BARS = "symbol string, date string, open double, high double, low double, close double, volume double"
INSTRUMENTS = "symbol string, name string, sector string, industry string, broker_name string"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the folder in spark.checkpoint.dir and read again: what several steps read is made once.

    Without that setting a folder of its own is made in local mode; on a cluster it is an error. The files stay.
    """
    spark = df.sparkSession
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="quantjobs-")
        spark.sparkContext.setCheckpointDir(place)
    path = f"{place}/quantjobs-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finite(col: str) -> Column:
    """The number, null where it is NaN or infinite."""
    c = F.col(col)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clean_bars(raw: DataFrame) -> DataFrame:
    """Dates coerced, rows without a valid date dropped, non-finite numbers nulled."""
    numbers = {c: finite(c) for c, kind in raw.dtypes if kind == "double"}
    return raw.withColumns(numbers | {"date": F.try_to_timestamp(F.col("date").cast("string")).cast("date")}).dropna(subset=["date"])


def read_bars(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Daily bars of a fixed schema from CSV (with a header) or Parquet."""
    reader = spark.read if fmt == "parquet" else spark.read.schema(BARS).option("header", True)
    return clean_bars(reader.format(fmt).load(path))


def clean_instruments(raw: DataFrame, order: str = "seq") -> DataFrame:
    """One row a symbol, the first by ``order``: trimmed, names filled in, error sectors and null symbols dropped."""
    for c in INSTRUMENTS.split(", "):
        name = c.split()[0]
        raw = raw.withColumn(name, F.trim(F.col(name)) if name in raw.columns else F.lit(None).cast("string"))
    fixed = raw.withColumns({"name": F.coalesce("name", "symbol"), "sector": F.replace("sector", F.lit("&"), F.lit("and")), "industry": F.replace("industry", F.lit("&"), F.lit("and"))})
    ok = fixed.where(F.col("symbol").isNotNull() & (F.col("symbol") != "") & ~F.coalesce(F.lower("sector").contains("error"), F.lit(False)))
    first = Window.partitionBy("symbol").orderBy(order)
    return ok.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("symbol", "name", "sector", "industry", "broker_name")


def read_instruments(spark: SparkSession, path: str) -> DataFrame:
    """The instrument dimension from CSV with ``#`` comments."""
    raw = spark.read.schema("symbol string, name string, sector string, industry string, broker_name string").option("comment", "#").csv(path)
    return clean_instruments(raw.withColumn("seq", F.monotonically_increasing_id()))


def parse_history(lines: DataFrame, schema: str, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of JSON lines; blank lines are neither."""
    full = lines.where(F.trim(line) != "").select(F.col(line).alias("_line"), F.from_json(line, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("_row"))
    bad = F.col("_row").isNull() | F.col("_row._bad").isNotNull()
    return full.where(~bad).select("_row.*").drop("_bad"), full.where(bad).select(F.col("_line").alias(line))


def read_history(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows and malformed lines of a JSON-lines file."""
    return parse_history(spark.read.text(path), schema)


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row a key of both tables, the new table's first, then by ``order`` descending."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rank = Window.partitionBy(*keys).orderBy(F.desc("_new"), *[F.desc(c) for c in order or []])
    return both.withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_n", "_new")


def upsert_at_rest(spark: SparkSession, path: str, new: DataFrame, keys: list[str], partition: str, batch: str, order: list[str] | None = None) -> bool:
    """Upserts a batch into the table at ``path``, which is partitioned by ``partition``; False if the batch is in already.

    Only the partitions that the batch touches are read and replaced; the files of all others stay as they are. The
    partition must be one of ``keys``, or follow from them, so that a key never moves. Applied batches are listed beside
    the table. A batch that fails halfway may be repeated: its rows take the place of themselves. Columns that only one
    side has are null on the other. One batch at a time.
    """
    data, log = f"{path}/data", f"{path}/batches"
    done = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    if done(f"{log}/_SUCCESS") and not spark.read.parquet(log).where(F.col("batch") == batch).isEmpty():
        return False
    new = scratch(new, "batch")
    touched = [r[0] for r in new.select(partition).distinct().collect()]  # a value for each partition
    if touched:
        rows = latest_rows(new, keys, order)
        if done(f"{data}/_SUCCESS"):
            old = spark.read.option("mergeSchema", True).parquet(data)
            rows = scratch(upsert_latest(old.where(F.col(partition).isin([t for t in touched if t is not None]) | (F.col(partition).isNull() if None in touched else F.lit(False))), rows, keys, order), "merged")
        rows.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(data)
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(log)
    return True


def latest_rows(df: DataFrame, keys: list[str], order: list[str] | None) -> DataFrame:
    """One row a key, the first by ``order`` descending."""
    rank = Window.partitionBy(*keys).orderBy(*([F.desc(c) for c in order] if order else [F.lit(1)]))
    return df.withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_n")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def latest_run(df: DataFrame, col: str) -> DataFrame:
    """The rows of the greatest value of ``col``."""
    return df.join(F.broadcast(df.agg(F.max(col).alias(col))), col, "left_semi")  # one row


def last_skips(skip_log: DataFrame) -> DataFrame:
    """(symbol, skip_data) of the last entry by ``seq`` of each symbol."""
    return skip_log.groupBy("symbol").agg(F.max_by("skip_data", "seq").alias("skip_data"))


def drop_skipped(df: DataFrame, skip_log: DataFrame) -> DataFrame:
    """``df`` without the symbols whose last entry is ["ALL"]."""
    return df.join(last_skips(skip_log).where(F.array_contains("skip_data", "ALL")), "symbol", "left_anti")


def missing_dates(symbols: DataFrame, bars: DataFrame, skip_log: DataFrame, holidays: DataFrame, start: str, end: str) -> DataFrame:
    """(symbol, date) of weekdays without a bar, a holiday or a skip entry; symbols skipped as a whole give none."""
    skips = last_skips(skip_log)
    wanted = drop_skipped(symbols.select("symbol").distinct(), skip_log).select("symbol", F.explode(F.expr(f"sequence(date'{start}', date'{end}')")).alias("date")).where(F.weekday("date") < 5)
    open_ = wanted.join(holidays.select("date"), "date", "left_anti")
    skipped = skips.select("symbol", F.explode("skip_data").alias("d")).select("symbol", F.try_to_timestamp("d").cast("date").alias("date"))
    return open_.join(bars.select("symbol", "date"), ["symbol", "date"], "left_anti").join(skipped, ["symbol", "date"], "left_anti").select("symbol", "date")


def append_evolving(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables under the union of their columns, the old ones first; absent ones are null."""
    return old.unionByName(new, allowMissingColumns=True)


def reconcile(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys of both sides, keys missing on either, and whether none is missing."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, keys, "full_outer")
    counts = both.agg(F.count("_l").alias("n_left"), F.count("_r").alias("n_right"), F.count_if(F.col("_r").isNull()).alias("missing_right"), F.count_if(F.col("_l").isNull()).alias("missing_left"))
    return counts.withColumn("valid", (F.col("missing_right") == 0) & (F.col("missing_left") == 0))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Publishes ``df``, non-finite numbers as null."""
    out = df.withColumns({c: finite(c) for c, kind in df.dtypes if kind in ("double", "float")})
    out.write.mode("overwrite").partitionBy(*partition_by or []).format(fmt).options(header=True).save(path)


def daily_composition(bars: DataFrame, weights: DataFrame, value: float = 1.0) -> DataFrame:
    """(date, composition): JSON of {symbol: {weight, value}} of the symbols traded that day."""
    rows = bars.join(weights, "symbol").select("date", "symbol", F.struct("weight", F.round(F.col("weight") * F.col("close") * value, 6).alias("value")).alias("v"))
    return rows.groupBy("date").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol", "v"))))).alias("composition"))
