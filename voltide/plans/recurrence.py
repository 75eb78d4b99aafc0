"""First-order recurrences over long series, scanned chunk by chunk.

``h[t] = max(a[t] * h[t-1] + b[t], floor)`` with ``h[-1] = start``. A run of such steps is again of the form
``max(A * h + B, L)``, so each chunk is first reduced to (A, B, L), the short table of chunks is scanned
for the value entering each chunk, and the chunks are then expanded independently. Exact for any chunking.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.plans.series import Series


def _fold_chunks(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Value entering each chunk: a scan over one small row per chunk."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        h = pdf["_start"].iloc[0]
        carried = []
        for a, b, low in zip(pdf["_a"], pdf["_b"], pdf["_low"]):
            carried.append(h)
            h = max(a * h + b, low)
        return pdf.assign(_carry=carried)[[*keys, "_chunk", "_carry"]]

    schema = T.StructType([chunks.schema[c] for c in (*keys, "_chunk")] + [T.StructField("_carry", T.DoubleType())])
    return chunks.groupBy(*keys).applyInPandas(scan, schema)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _expand(a: pd.Series, b: pd.Series, carry: pd.Series, floor: pd.Series) -> pd.Series:
    out = []
    for xs, ys, h, low in zip(a, b, carry, floor):
        values = []
        for x, y in zip(xs.tolist(), ys.tolist()):
            h = max(x * h + y, low)
            values.append(h)
        out.append(values)
    return pd.Series(out)


def linear_recurrence(df: DataFrame, s: Series, a: Column, b: Column, start: Column, out: str, floor: float = 1e-10) -> DataFrame:
    """Add column ``out`` with the recurrence; ``start`` is constant within a series.

    Rows are packed once per chunk (bounded by ``chunk_rows``); the other columns stay in the JVM and only the two
    coefficient arrays cross to Python, which has to walk them in order.
    """
    keys = list(s.keys)
    payload = [c for c in df.columns if c not in keys]
    row = F.struct(
        F.col(s.time).alias("_t"), a.cast("double").alias("_a"), b.cast("double").alias("_b"), start.cast("double").alias("_s"),
        F.struct(*payload).alias("_row"),
    )
    packed = df.groupBy(*keys, s.chunk().alias("_chunk")).agg(
        F.array_sort(F.collect_list(row)).alias("_rows")  # by time, which is unique in a series
    )
    none = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(float("-inf")).alias("low"))

    def then(acc: Column, x: Column) -> Column:
        low = F.greatest(x["_a"] * acc["low"] + x["_b"], F.lit(floor))
        # -inf * 0 is NaN: before the first step there is no lower bound to carry
        low = F.when(acc["low"] == float("-inf"), F.lit(floor)).otherwise(low)
        return F.struct((x["_a"] * acc["a"]).alias("a"), (x["_a"] * acc["b"] + x["_b"]).alias("b"), low.alias("low"))

    folded = packed.select(*keys, "_chunk", F.aggregate("_rows", none, then).alias("_f"), F.col("_rows")[0]["_s"].alias("_start"))
    chunks = folded.select(
        *keys, "_chunk", F.col("_f.a").alias("_a"), F.col("_f.b").alias("_b"), F.col("_f.low").alias("_low"), "_start"
    )
    joined = packed.join(_fold_chunks(chunks, keys), [*keys, "_chunk"])
    values = _expand(
        F.transform("_rows", lambda x: x["_a"]), F.transform("_rows", lambda x: x["_b"]), F.col("_carry"), F.lit(floor)
    )
    each = joined.withColumn("_h", values).select(*keys, F.explode(F.arrays_zip("_rows", "_h")).alias("_z"))
    return each.select(*[F.col(c) if c in keys else F.col(f"_z._rows._row.{c}").alias(c) for c in df.columns], F.col("_z._h").alias(out))
