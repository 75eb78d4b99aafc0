"""Chunking must never change a result."""

import numpy as np
import pandas as pd
import pytest
from conftest import random_bars
from pyspark.sql import functions as F

from voltide.operators import features as W
from voltide.operators import spells as P
from voltide.operators.regime_stats import return_autocorrelation
from voltide.plans.recurrence import linear_recurrence
from voltide.plans.series import Series, over_series, with_row_index

WHOLE = Series(step=3600)
TINY = Series(step=3600, chunk_rows=48)


def table(df):
    return df.toPandas().sort_values(["symbol", "timestamp"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def bars(make):
    return make(random_bars(400))


def test_feature_matrix_is_the_same_in_small_chunks(bars):
    one = table(W.feature_matrix(W.add_log_return(bars, WHOLE), WHOLE))
    many = table(W.feature_matrix(W.add_log_return(bars, TINY), TINY))
    assert len(one.columns) - 10 == 41
    pd.testing.assert_frame_equal(one, many, atol=1e-8, rtol=1e-8)


def test_lead_reaches_across_chunks(bars):
    def build(d, f):
        return d.withColumn("next3", F.lead("timestamp", 3).over(f.ordered))

    pd.testing.assert_frame_equal(table(over_series(bars, WHOLE, build, after=3)), table(over_series(bars, TINY, build, after=3)))


def test_row_index_is_exact(bars):
    got = table(with_row_index(bars, TINY))
    assert (got["rn"] == got.groupby("symbol").cumcount()).all()
    assert (got["n_rows"] == got.groupby("symbol")["rn"].transform("size")).all()


def test_spells_and_autocorrelation_across_chunks(bars):
    rows = W.add_log_return(bars, WHOLE).withColumn("regime", (F.floor(F.unix_seconds("timestamp") / 30000) % 3).cast("int"))
    for fn in (P.regime_spells, P.transition_matrix, return_autocorrelation):
        a, b = fn(rows, WHOLE).toPandas(), fn(rows, TINY).toPandas()
        keys = list(a.columns[:3])
        pd.testing.assert_frame_equal(a.sort_values(keys, ignore_index=True), b.sort_values(keys, ignore_index=True))


def test_row_order_does_not_matter(make):
    pdf = random_bars(120, seed=3)
    shuffled = pdf.sample(frac=1, random_state=1)
    a, b = (table(W.rsi(make(x), TINY)) for x in (pdf, shuffled))
    pd.testing.assert_frame_equal(a, b)


def test_recurrence_equals_a_loop(bars):
    rows = bars.withColumns({"a": F.lit(0.9), "b": F.col("volume_base") / 50 - 0.4})
    got = table(linear_recurrence(rows, TINY, F.col("a"), F.col("b"), F.lit(1.0), "h", floor=0.05))
    for _, g in got.groupby("symbol"):
        h, want = 1.0, []
        for b in g["b"]:
            h = max(0.9 * h + b, 0.05)
            want.append(h)
        np.testing.assert_allclose(g["h"], want, rtol=1e-12)
