"""Registered queries against their SQL on the small tables (VOLTIDE_ALL=1 runs every one)."""

import os

import __spark_entry__ as contract
import pytest
from compare import difference, duck

SF = "/root/testdata/sf0.001"
SOME = ("scan_kline_csv", "decode_kline_json", "consolidate", "valid_candles", "quality_report", "vol_quantiles_exact", "regime_stats",
        "feature_matrix", "hourly_feature_matrix", "transition_triggers", "evaluate_regimes", "backfill_plan", "rolling_forecast_given",
        "rolling_forecast_regime_lagged", "garch_scores_given", "permutation_hits_given", "insample_regime_variance", "sequence_windows", "stream_dedup", "stream_log_return", "late_repair")
ORACLE = contract.oracle_sql()
NAMES = list(ORACLE) if os.environ.get("VOLTIDE_ALL") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    got = contract.queries()[name](spark, SF).toPandas()
    assert difference(got, con.execute(ORACLE[name]).df()) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    from voltide.oracle import ORACLE as every

    assert set(every) <= set(contract.queries())
