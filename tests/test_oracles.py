"""Every registered query at sf0.001 against its SQL oracle (or only that it runs)."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare
from tests.conftest import SF

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# long runs without an oracle; their parts are covered one by one
SLOW = {"flow_generate_log", "a11_best_window", "n8_roll_forward", "m7_tsd_match", "v3b_factor_embedding_times"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, name):
    ok, msg = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert ok is not False, msg


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["metric"] for r in rows} == {"log_mae", "mae", "hour_emd", "day_emd", "day_hour_emd", "cal_emd"}
