import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
from compare import spark_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = spark_session()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make(spark):
    """DataFrame of rows with a ``timestamp`` given as epoch seconds."""

    def build(pdf: pd.DataFrame, time: str = "timestamp"):
        out = spark.createDataFrame(pdf)
        return out.withColumn(time, F.timestamp_seconds(F.col(time)))

    return build


def random_bars(n: int, seed: int = 0, step: int = 3600, gap: float = 0.3, symbols=("A", "B")) -> pd.DataFrame:
    """Bars with gaps, runs of constant prices and zero volumes."""
    rng = np.random.default_rng(seed)
    parts = []
    for k, symbol in enumerate(symbols):
        at = np.flatnonzero(rng.random(int(n / (1 - gap))) > gap)[:n]
        moves = rng.normal(0, 0.01, len(at)) * (rng.random(len(at)) > 0.2)
        moves[40:90] = 0.0
        close = 100 * (k + 1) * np.exp(np.cumsum(moves))
        volume = np.where(rng.random(len(at)) > 0.3, rng.integers(1, 50, len(at)), 0).astype(float)
        volume[100:140] = 0.0
        parts.append(pd.DataFrame({
            "symbol": symbol, "timestamp": (1_700_000_000 // step + at) * step, "price_open": close, "price_high": close * 1.01,
            "price_low": close * 0.99, "price_close": close, "volume_base": volume, "volume_quote": volume * close, "num_trades": 3,
        }))
    return pd.concat(parts, ignore_index=True)
