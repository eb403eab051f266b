"""Hot groups: with a tiny segment size every ordered operator must give the same rows."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare
from tests.conftest import SF

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = [
    "e01_pairing", "e01b_strict_pairing", "e01c_fifo_pairing", "e05_positions", "e07_durations", "e12_max_abs", "e13_user_index",
    "e15_next_task", "e16_duration_bins", "e17_occurrence", "p1_timeline_contained", "p6_thin_arrivals", "a1_gaps_per_day",
    "a2_gaps_global", "a4_renumber", "a5_window_gaps", "a7_moving_count", "f1_dfg", "f3_footprint_loops", "f9_steps", "f10_causal_links",
    "w1_expanded", "w2_wip", "w4_occupancy", "w6_mean_states", "m5_mae_pairs", "t6_assemble_linear", "n1_ngrams", "n4_arrival_ngrams",
    "f6_prefix_model", "c5_enabling_time", "c15_apply_alignment", "e06_traces", "e18_case_profile", "m3_dl_cases", "m6_dl_mae_cases", "s2_xes", "v4_full_sentences",
    "g2_distributions", "a6_window_stats", "w5_features_own_role",
]
# sessions and conversations are short: segments of four rows
SHORT = [
    "f4_variants", "f4_variants_conversations", "f6_prefix_model", "f6_prefix_model_conversations", "f7_bigram_model", "f7_fourgram_model",
    "g11_work_sets", "g11_case_partitions", "g12_resource_given_workset", "m3_dl_variants", "t7_covering_partitions", "s13_reuse",
]


@pytest.fixture()
def tiny_segments(spark):
    spark.conf.set("spark.caseloom.segment.rows", "20")
    yield
    spark.conf.unset("spark.caseloom.segment.rows")


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, tiny_segments, name):
    ok, msg = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert ok, msg


def test_hot_case_is_cut(spark, tiny_segments):
    from checks.base import l2

    df = l2(spark, SF)
    assert "seg" in df.columns
    sizes = df.groupBy("caseid", "seg").count().agg({"count": "max"}).first()[0]
    assert sizes <= 40


def test_small_log_stays_whole(spark):
    from checks.base import l2

    assert "seg" not in l2(spark, SF).columns


@pytest.mark.parametrize("name", [n for n in SHORT if n in ORACLES])
def test_same_rows_of_short_cases(spark, con, name):
    spark.conf.set("spark.caseloom.segment.rows", "4")
    try:
        ok, msg = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    finally:
        spark.conf.unset("spark.caseloom.segment.rows")
    assert ok, msg


def test_one_row_per_hot_case(spark, tiny_segments):
    from checks.base import l2
    from caseloom.operators.shape import traces
    from pyspark.sql import functions as F

    log = l2(spark, SF)
    rows = traces(log)
    assert rows.agg(F.sum(F.size("tasks"))).first()[0] == log.count()
    assert rows.count() == log.select("caseid").distinct().count()


def awkward(spark):
    """Record order against time order, null resources, tied times, one hot case."""
    import datetime

    at = datetime.datetime(2024, 1, 1)
    rows = []
    for k in range(120):
        when = at + datetime.timedelta(minutes=(k * 37) % 60)
        rows.append(("c", f"Activity {k % 3}", None if k % 2 else "u", when, "start", 2 * k))
        rows.append(("c", f"Activity {k % 3}", None if k % 2 else "u", when + datetime.timedelta(minutes=5), "complete", 2 * k + 1))
    return spark.createDataFrame(rows, "caseid string, task string, user string, ts timestamp_ntz, transition string, pos long")


def rows_of(df):
    return sorted((tuple(r) for r in df.drop("seg").collect()), key=repr)


@pytest.mark.parametrize("name", ["pair_lifecycle", "pair_strict", "pair_fifo"])
def test_record_order_and_null_keys(spark, monkeypatch, name):
    from caseloom.functions import ordered as O
    from caseloom.operators import shape

    monkeypatch.setattr(O, "surely_small", lambda df, limit: False)
    life = awkward(spark)
    fn = getattr(shape, name)
    cut = O.segment(life, ["caseid"], "ts", limit=20)
    assert "seg" in cut.columns
    spark.conf.set("spark.caseloom.segment.rows", "20")
    try:
        assert rows_of(fn(cut)) == rows_of(fn(life))
    finally:
        spark.conf.unset("spark.caseloom.segment.rows")


def test_segments_of_long_prefixes_and_fractions(spark, monkeypatch):
    from caseloom.functions import ordered as O

    monkeypatch.setattr(O, "surely_small", lambda df, limit: False)
    df = spark.createDataFrame([(f"Activity {k:05d}", k / 1000) for k in range(400)], "name string, share double")
    for order in ("name", "share"):
        cut = O.segment(df, [], order, limit=40)
        assert cut.groupBy("seg").count().agg({"count": "max"}).first()[0] <= 80
        assert rows_of(O.row_index(cut, [], [order], "n")) == rows_of(O.row_index(df, [], [order], "n"))
