"""Late bars: put them into the table and recompute the returns they touch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voltide.plans.series import Series
from voltide.session import materialise
from voltide.sources.tables import PARTITIONS, merged_bars, write_partitioned


def _months(table: DataFrame, late: DataFrame) -> DataFrame:
    """Partitions to rewrite (touched, or next after a touched one) and those read for the bar before them."""
    touched = late.select(*PARTITIONS).distinct().withColumn("touched", F.lit(1))
    of_symbols = table.select(*PARTITIONS).join(late.select("symbol").distinct(), "symbol", "left_semi")
    known = of_symbols.distinct().withColumn("touched", F.lit(0)).unionByName(touched)
    order = Window.partitionBy("symbol").orderBy("year", "month")
    months = known.groupBy(*PARTITIONS).agg(F.max("touched").alias("touched"))
    months = months.withColumn("rewrite", (F.col("touched") == 1) | (F.coalesce(F.lag("touched").over(order), F.lit(0)) == 1))
    return months.withColumn("needed", F.col("rewrite") | F.coalesce(F.lead("rewrite").over(order), F.lit(False)))


def late_repair(path: str, s: Series, newest: Sequence[str], schema: StructType | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that merges a batch of late bars into the table at ``path``.

    Only the months a late bar falls in, and the month after (whose first return changes), are rewritten. The new
    rows are staged before they replace anything, and a repeated batch changes nothing. ``schema`` is needed for a
    table that may still be empty.
    """

    def merge(late: DataFrame, batch_id: int) -> None:
        spark = late.sparkSession
        table = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
        late = late.select(*table.columns)
        months = materialise(_months(table, late), f"months-{batch_id}")
        wanted = months.where(F.col("needed"))
        rows = table.join(wanted.select(*PARTITIONS), list(PARTITIONS), "left_semi").unionByName(late)
        fixed = merged_bars(rows, s, newest).join(
            months.where(F.col("rewrite")).select(*PARTITIONS), list(PARTITIONS), "left_semi"
        )
        write_partitioned(materialise(fixed.select(*table.columns), f"repair-{batch_id}"), path)

    return merge
