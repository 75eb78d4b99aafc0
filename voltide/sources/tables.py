"""Partitioned Parquet bar tables: write, append, read, merge and repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltide.operators.cleaning import calendar_columns, dedup_bars
from voltide.operators.features import add_log_return
from voltide.plans.series import Series, over_series

PARTITIONS = ("symbol", "year", "month")


def write_partitioned(df: DataFrame, path: str, partitions: Sequence[str] = PARTITIONS, rows_per_file: int = 5_000_000) -> None:
    """Parquet partitioned by symbol, year and month; only the partitions present in ``df`` are replaced.

    The shuffle key adds the day where the table has one, so a hot month is written by several tasks, and
    ``maxRecordsPerFile`` bounds the files.
    """
    keys = [*partitions, "day"] if "day" in df.columns else list(partitions)
    (
        df.repartition(*keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*partitions)
        .parquet(path)
    )


def append_bars(df: DataFrame, path: str, partitions: Sequence[str] = PARTITIONS) -> bool:
    """Append unless empty; tells whether anything was written. A hot month is written by several tasks."""
    if df.isEmpty():
        return False
    keys = [*partitions, "day"] if "day" in df.columns else list(partitions)
    df.repartition(*keys).write.mode("append").partitionBy(*partitions).parquet(path)
    return True


def scan_bars(spark: SparkSession, path: str, symbols: Sequence[str] | None = None,
              start: str | None = None, end: str | None = None) -> DataFrame:
    """Read a bar table; symbol and the years of the range prune directories, the range itself row groups."""
    df = spark.read.parquet(path)
    if symbols:
        df = df.where(F.col("symbol").isin(*symbols))
    if start:
        df = df.where((F.col("year") >= int(start[:4])) & (F.col("timestamp") >= F.lit(start).cast("timestamp")))
    if end:
        df = df.where((F.col("year") <= int(end[:4])) & (F.col("timestamp") < F.lit(end).cast("timestamp")))
    return df


def merged_bars(df: DataFrame, s: Series, newest: Sequence[str]) -> DataFrame:
    """One bar per key and time, calendar columns and returns recomputed over the merged series."""
    single = dedup_bars(df, [*s.keys, s.time], newest)
    return calendar_columns(add_log_return(single.drop("log_return"), s), s.time)


def consolidate(spark: SparkSession, source: str, target: str, s: Series, newest: Sequence[str]) -> DataFrame:
    """Rewrite an appended table as a clean one at ``target`` and return its rows per month.

    The table read is never overwritten: readers switch to ``target`` once it is complete.
    """
    write_partitioned(merged_bars(spark.read.parquet(source), s, newest), target)
    return spark.read.parquet(target).groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("n"))


def backfill_plan(bars: DataFrame, s: Series, page: int = 1000) -> DataFrame:
    """Missing ranges of the grid cut into request pages of ``page`` candles (page bounds are inclusive).

    Only rows next to a hole reach the ``explode``; a hole of any length becomes pages, not candles.
    """
    def build(d, f):
        return d.withColumn("_next", F.lead(s.time, 1).over(f.ordered))

    holes = over_series(bars.select(*s.keys, s.time), s, build, after=1)
    here, following = F.unix_seconds(s.time), F.unix_seconds("_next")
    holes = holes.where(following - here > s.step).select(
        *s.keys, (here + s.step).alias("_from"), (following - s.step).alias("_to")
    )
    pages = holes.withColumn("_page", F.explode(F.sequence(F.col("_from"), F.col("_to"), F.lit(page * s.step))))
    last = F.least(F.col("_page") + (page - 1) * s.step, F.col("_to"))
    return pages.select(
        *s.keys, F.timestamp_seconds("_page").alias("page_start"), F.timestamp_seconds(last).alias("page_end"),
        ((last - F.col("_page")) / s.step + 1).cast("long").alias("n_candles"),
    )


def range_pages(spark: SparkSession, start: str, end: str, step: int = 60, page: int = 1000) -> DataFrame:
    """Request pages for whole days ``start`` to ``end`` (up to 23:59:59), in epoch milliseconds."""
    lo = F.unix_seconds(F.lit(start).cast("timestamp"))
    hi = F.unix_seconds(F.lit(f"{end} 23:59:59").cast("timestamp"))
    pages = spark.range(1).select(F.explode(F.sequence(lo, hi, F.lit(page * step))).alias("_p"), hi.alias("_hi"))
    stop = F.least(F.col("_p") + page * step - 1, F.col("_hi"))
    return pages.select((F.col("_p") * 1000).alias("start_ms"), (stop * 1000).alias("end_ms"))


def backfill_merge(history: DataFrame, fetched: DataFrame, s: Series) -> DataFrame:
    """History plus the fetched bars it lacks, returns recomputed. History wins where both have a bar."""
    keys = [*s.keys, s.time]
    fresh = fetched.join(history.select(*keys), keys, "left_anti")
    columns = [c for c in history.columns if c != "log_return"]
    return add_log_return(history.select(*columns).unionByName(fresh.select(*columns)), s)


def write_report_csv(df: DataFrame, path: str) -> None:
    """A report-sized table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def partition_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows per partition of a table."""
    return spark.read.parquet(path).groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("n"))


def save_params(params: DataFrame, path: str) -> None:
    """Fitted parameters as a Parquet table partitioned by ``model``; other models in it are kept."""
    params.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)


def load_params(spark: SparkSession, path: str, model: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("model") == model)
