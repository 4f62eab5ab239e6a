"""Every query with SQL against DuckDB; windowed ones again with tiny chunks."""

import pytest
from conftest import SF

import check
from __spark_entry__ import entry, oracle_sql, queries

SQL = oracle_sql()
WINDOWED = """band_rate_per_loop jump_null_ffill fill_backward fill_both fill_mean interp_linear interp_nearest diff_prepend
opening_speed local_max_pm20 rolling_mean3 shift40 crossing_down crossing_up dilate10 smooth_signal smoothing_spline turning_angles speed_lag10
jump_origin_filter skeleton_filter spine_filter_full low_likelihood_filter mutual_gaze pair_features manual_dense run_length
width_filter width_sweep confusion_counts transitions steady_start freq_score block_score welch_power interp_bridged
negative_control head_inside""".split()


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    rows, error = check.compare(spark, con, SF, queries()[name], SQL[name])
    assert error is None
    assert rows > 0


@pytest.mark.parametrize("name", WINDOWED)
def test_matches_sql_across_chunks(spark, con, small_chunks, name):
    rows, error = check.compare(spark, con, SF, queries()[name], SQL[name])
    assert error is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_operator_is_covered():
    from trackspark.plans.catalogue import IDS

    have = {i for ids in IDS.values() for i in ids.split()}
    want = ([f"S{i}" for i in range(1, 11)] + [f"P{i}" for i in range(1, 27)] + [f"F{i}" for i in range(1, 25)] + [f"C{i}" for i in range(1, 17)]
            + [f"W{i}" for i in range(1, 28)] + [f"J{i}" for i in range(1, 15)] + [f"A{i}" for i in range(1, 29)] + [f"R{i}" for i in range(1, 20)]
            + [f"V{i}" for i in range(1, 7)] + [f"Q{i}" for i in range(1, 7)] + [f"M{i}" for i in range(1, 20)] + [f"E{i}" for i in range(1, 12)]
            + [f"T{i}" for i in range(1, 5)] + [f"U{i}" for i in range(1, 5)] + [f"X{i}" for i in range(1, 6)] + [f"Z{i}" for i in range(1, 5)])
    assert [w for w in want if w not in have] == []
