"""How one long time series is split over many tasks, exactly.

A symbol may hold a third of all rows, so no window here is partitioned by symbol alone. Rows are
placed in *chunks* of at most ``chunk_rows`` grid steps. A window that looks back ``before`` rows (or
ahead ``after`` rows) gets copies of the neighbouring rows it needs ("halo" rows), computed from the
row counts of sub-chunks, so gaps in the time grid do not matter. Halo rows are dropped afterwards.
Anything unbounded (row index, running sums) adds the offset of the chunk, taken from a table with
one row per chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

PARTS = 16  # sub-chunks per chunk: a halo copies whole sub-chunks


@dataclass(frozen=True)
class Series:
    """Keys, order and grid of a set of time series; ``time`` is unique within the keys."""

    keys: tuple[str, ...] = ("symbol",)
    time: str = "timestamp"
    step: int = 3600
    chunk_rows: int = 8192

    def by(self, *extra: str) -> Series:
        return replace(self, keys=self.keys + extra)

    @property
    def part_seconds(self) -> int:
        return max(1, self.step * self.chunk_rows // PARTS)

    def part(self) -> Column:
        return F.floor(F.unix_seconds(F.col(self.time)) / F.lit(self.part_seconds))

    def chunk(self) -> Column:
        return F.floor(self.part() / F.lit(PARTS))


@dataclass(frozen=True)
class Frames:
    """Window specs inside a chunk, and the same window as SQL text."""

    ordered: WindowSpec
    sql: str

    def rows(self, n: int) -> WindowSpec:
        """The current row and the n-1 rows before it."""
        return self.ordered.rowsBetween(-n + 1, 0)

    def between(self, start: int, end: int) -> WindowSpec:
        return self.ordered.rowsBetween(start, end)

    @property
    def running(self) -> WindowSpec:
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)


def _place(df: DataFrame, s: Series, before: int, after: int) -> DataFrame:
    """Add ``_chunk`` and ``_halo``; halo rows are copies for a neighbouring chunk."""
    keys = list(s.keys)
    if not before and not after:
        return df.withColumns({"_chunk": s.chunk(), "_halo": F.lit(False)})
    tagged = df.withColumn("_part", s.part())
    chunk = F.floor(F.col("_part") / F.lit(PARTS))
    series = Window.partitionBy(*keys)
    order = series.orderBy("_part")
    sizes = (
        tagged.groupBy(*keys, "_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_own", chunk)
        .withColumns(
            {
                "_end": F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)),
                "_after": F.lead("_own").over(order),
                "_before": F.lag("_own").over(order),
            }
        )
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )
    targets = F.array(F.col("_own"))
    if before:
        entered = F.when(F.col("_after") != F.col("_own"), F.col("_after"))
        frame = series.orderBy("_end").rangeBetween(0, before - 1)
        sizes = sizes.withColumn("_later", F.collect_list(entered).over(frame))
        targets = F.concat(targets, F.col("_later"))
    if after:
        left = F.when(F.col("_before") != F.col("_own"), F.col("_before"))
        frame = series.orderBy("_start").rangeBetween(-(after - 1), 0)
        sizes = sizes.withColumn("_earlier", F.collect_list(left).over(frame))
        targets = F.concat(targets, F.col("_earlier"))
    reach = sizes.select(*keys, "_part", "_own", F.array_distinct(targets).alias("_targets"))
    return (
        tagged.join(reach, [*keys, "_part"])
        .withColumn("_chunk", F.explode("_targets"))
        .withColumn("_halo", F.col("_chunk") != F.col("_own"))
        .drop("_part", "_own", "_targets")
    )


def over_series(
    df: DataFrame,
    s: Series,
    build: Callable[[DataFrame, Frames], DataFrame],
    before: int = 0,
    after: int = 0,
) -> DataFrame:
    """Run ``build(rows, frames)`` per chunk; exact if windows reach at most ``before``/``after`` rows."""
    placed = _place(df, s, before, after)
    parts = ", ".join(f"`{c}`" for c in (*s.keys, "_chunk"))
    frames = Frames(Window.partitionBy(*s.keys, "_chunk").orderBy(s.time), f"PARTITION BY {parts} ORDER BY `{s.time}`")
    return build(placed, frames).where(~F.col("_halo")).drop("_chunk", "_halo")


def _offsets(placed: DataFrame, s: Series, value: Column) -> DataFrame:
    """Per chunk: sum of ``value`` over all earlier chunks, and over the whole series."""
    series = Window.partitionBy(*s.keys)
    earlier = series.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.groupBy(*s.keys, "_chunk")
        .agg(F.sum(value).alias("_sum"))
        .select(
            *s.keys,
            "_chunk",
            F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
            F.sum("_sum").over(series).alias("_total"),
        )
    )


def with_running_sum(df: DataFrame, s: Series, value: Column, name: str, total: str | None = None) -> DataFrame:
    """Sum of ``value`` up to and including each row, in two levels (chunk offset + local sum)."""
    placed = df.withColumns({"_chunk": s.chunk(), "_value": value})
    offsets = _offsets(placed, s, F.col("_value"))
    local = Window.partitionBy(*s.keys, "_chunk").orderBy(s.time).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(offsets, [*s.keys, "_chunk"]).withColumn(name, F.col("_offset") + F.sum("_value").over(local))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_chunk", "_value", "_offset", "_total")


def with_row_index(df: DataFrame, s: Series, name: str = "rn", total: str = "n_rows") -> DataFrame:
    """Exact 0-based position of each row in its series, and the length of the series."""
    return with_running_sum(df, s, F.lit(1), name, total).withColumn(name, F.col(name) - 1)
