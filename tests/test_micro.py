"""Hand-made logs for the behaviours that are easy to get wrong, and brute-force comparisons."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.functions import distance as D
from caseloom.model import LIFECYCLE, LOG
from caseloom.operators import arrivals as A
from caseloom.operators import blocks as B
from caseloom.operators import conform as C
from caseloom.operators import flow as W
from caseloom.operators import graph as GR
from caseloom.operators import metrics as M
from caseloom.operators import profile as G
from caseloom.operators import sample as P
from caseloom.operators import shape as S
from caseloom.operators import split as SP

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def life(spark, text, case="c"):
    """'A+ B+ A-': starts (+) and completes (-), one minute apart."""
    rows = [(case, x[:-1], "u", at(k), "start" if x[-1] == "+" else "complete", k) for k, x in enumerate(text.split())]
    return spark.createDataFrame(rows, LIFECYCLE)


def seqs(spark, *words):
    rows = [(f"c{i}", t, "u", at(k), at(k), k) for i, w in enumerate(words) for k, t in enumerate(w)]
    return spark.createDataFrame(rows, LOG)


def pairs_of(df):
    return sorted((r["task"], (r["start_ts"] - T0).seconds // 60, (r["end_ts"] - T0).seconds // 60) for r in df.collect())


@pytest.mark.parametrize(
    "text, want",
    [
        ("A+ B+ A- A+ A- B-", [("A", 0, 2), ("A", 3, 4), ("B", 1, 5)]),
        ("A+ A+ A-", [("A", 0, 2), ("A", 1, 2)]),
        ("A+ A- B+", [("A", 0, 1)]),
        ("A+ B+ A-", []),
    ],
)
def test_pairing(spark, text, want):
    assert pairs_of(S.pair_lifecycle(life(spark, text))) == want


def test_strict_pairing_drops_unequal_counts(spark):
    assert S.pair_strict(life(spark, "A+ A+ A-")).count() == 0
    assert pairs_of(S.pair_strict(life(spark, "A+ A+ A- A-"))) == [("A", 0, 2), ("A", 1, 3)]


def test_fifo_pairing_skips_orphans(spark):
    assert pairs_of(S.pair_fifo(life(spark, "A- A+ A- A- A+ A-"))) == [("A", 1, 2), ("A", 4, 5)]


@pytest.mark.parametrize(
    "enable, start, end, want",
    [(0, 5, 20, (300, 900, 0)), (10, 0, 20, (0, 600, 600)), (30, 0, 20, (0, 1200, 1200)), (20, 0, 20, (0, 1200, 1200))],
)
def test_replay_metrics(spark, enable, start, end, want):
    df = spark.createDataFrame([(at(start), at(end), at(enable))], "start_ts timestamp_ntz, end_ts timestamp_ntz, enable_ts timestamp_ntz")
    r = S.replay_metrics(df).first()
    assert (r["wait_us"], r["proc_us"], r["multi_us"]) == tuple(x * 1_000_000 for x in want)


def test_category_index(spark):
    got = {r["name"]: r["id"] for r in S.category_index(seqs(spark, "BAC"), "task").collect()}
    assert got == {"Start": 0, "B": 1, "A": 2, "C": 3, "End": 4}


def test_duration_bins(spark):
    rows = [("c", "A", "u", at(0), at(0) + dt.timedelta(seconds=s), k) for k, s in enumerate([1, 2, 3, 4, 10])]
    df = S.duration_bins(spark.createDataFrame(rows, LOG)).orderBy("pos")
    assert [r["bin"] for r in df.collect()] == [0, 0, 0, 1, 1]


def test_footprint(spark):
    rel = {(r["a"], r["b"]): r["rel"] for r in W.footprint(seqs(spark, "ABC", "ACB", "AAD", "DED")).collect()}
    want = {"AB": "PRECEDES", "BA": "FOLLOWS", "BC": "PARALLEL", "CB": "PARALLEL", "AA": "FOLLOWS", "AD": "PRECEDES", "DA": "FOLLOWS", "DE": "PRECEDES", "ED": "PRECEDES", "AE": "NOT_CONNECTED"}
    assert {k: rel[tuple(k)] for k in want} == want


def test_ngrams(spark):
    df = spark.createDataFrame([(["s", "a", "b", "e"],)], "seq array<string>")
    got = sorted(r["ctx"] + [r["nxt"]] for r in W.ngram_pairs(df, 3).collect())
    assert got == sorted([["s", "a", "b"], ["a", "b", "e"], ["s", "a"], ["b", "e"]])


def test_parallel_block(spark):
    got = B.parallel_blocks(life(spark, "A+ A- B+ C+ B- C- D+ D-")).orderBy("pos").collect()
    assert [r["task"] + r["transition"][0] for r in got] == ["Bs", "Cs", "Bc", "Cc"]
    assert {(r["before"], r["after"]) for r in got} == {("A", "D")}


def test_block_model_with_sub_block(spark):
    text = "A+ A- B+ C+ B- D+ E+ D- E- C- F+ F-"
    items = lambda r: tuple("".join(e["names"]) if not e["sub"] else tuple(e["names"]) for e in r["item"])
    rows = {(r["kind"], tuple(r["key"]), items(r)) for r in B.block_model(life(spark, text)).collect()}
    assert ("first", (), ("B", "C")) in rows
    assert ("seq", ("B",), ("B", ("D", "E"))) in rows
    assert ("seq", ("C",), ("C",)) in rows
    assert ("sub", ("D", "D", "E"), ("D",)) in rows and ("sub", ("E", "D", "E"), ("E",)) in rows


def test_names_are_no_syntax(spark):
    """Activities whose names hold the signs of blocks come back from the model."""
    new = {"A": "[A | F]", "B": "x+y>(z)", "C": "(c", "D": "d>|", "E": "\\e,;", "F": "f]"}
    rows = life(spark, "A+ A- B+ C+ B- D+ E+ D- E- C- F+ F-").replace(new, subset=["task"])
    tokens = [r["token"] for r in B.step_sequence(rows).orderBy("step").collect()]
    seq = spark.createDataFrame([(1, ["addstart", *tokens, "addend"])], "caseid long, seq array<string>")
    got = {r["act"]: r for r in P.expand_blocks(seq, B.block_model(rows)).collect()}
    name = {r["idx"]: a for a, r in got.items()}
    nxt = {a: sorted(name[i] for i in r["next"] or []) for a, r in got.items()}
    a, b, c, d, e, f = new.values()
    assert nxt == {"addstart": [a], a: sorted([b, c]), b: sorted([d, e]), c: [f], d: [f], e: [f], f: ["addend"], "addend": []}


def test_expanded_block_links(spark):
    life_rows = life(spark, "A+ A- B+ C+ B- D+ E+ D- E- C- F+ F-")
    token = "[A | F]"
    seq = spark.createDataFrame([(1, ["addstart", "A", token, "F", "addend"])], "caseid long, seq array<string>")
    rows = {r["act"]: r for r in P.expand_blocks(seq, B.block_model(life_rows)).collect()}
    name = {r["idx"]: a for a, r in rows.items()}
    nxt = {a: sorted(name[i] for i in r["next"] or []) for a, r in rows.items()}
    assert nxt == {"addstart": ["A"], "A": ["B", "C"], "B": ["D", "E"], "C": ["F"], "D": ["F"], "E": ["F"], "F": ["addend"], "addend": []}
    assert sorted(name[i] for i in rows["F"]["last"]) == ["C", "D", "E"]


def test_trace_split_rounds_half_to_even(spark):
    log = seqs(spark, "A", "A", "A", "A", "A")
    assert SP.timeline_trace(log, 0.5).filter("split = 'test'").count() == 2


def test_arrival_chunks(spark):
    rows = [(f"c{i:02}", "A", "u", at(i), at(i), i) for i in range(14)]
    log = spark.createDataFrame(rows, LOG)
    sizes = [r["count"] for r in SP.arrival_chunks(log).groupBy("chunk").count().orderBy("chunk").collect()]
    kept = [r["count"] for r in SP.thinned_cases(log).groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [3, 3, 2, 2, 2, 2] and kept == [3, 1, 2, 1, 2, 1]


@pytest.mark.parametrize("probs, want", [([0.5, 0.6], [0.5, 0.5]), ([0.33] * 3, [0.34, 0.33, 0.33]), ([0.0, 1.0], [0.01, 0.99])])
def test_probability_repair(spark, probs, want):
    df = spark.createDataFrame([("g", f"p{k}", p) for k, p in enumerate(probs)], "gate string, t_path string, prob double")
    assert [r["prob"] for r in GR.repair_probabilities(df).orderBy("t_path").collect()] == pytest.approx(want)


def test_gateway_cycle_ends(spark):
    nodes = spark.createDataFrame(
        [("s", "start", "Start", "s"), ("a", "task", "A", "a"), ("g", "gate", "", "g"), ("h", "gate2", "", "h"), ("e", "end", "End", "e")],
        "node_id string, type string, name string, element_id string",
    )
    edges = spark.createDataFrame([("s", "h"), ("h", "a"), ("a", "g"), ("g", "h"), ("h", "g"), ("g", "e")], "src string, dst string")
    got = {(r["a"], r["b"]) for r in GR.next_tasks(nodes, edges).collect()}
    assert got == {("Start", "A"), ("Start", "End"), ("A", "A"), ("A", "End")}


def test_emd_is_zero_for_identical_logs(spark):
    log = seqs(spark, "ABC", "AD")
    spans = S.case_spans(log)
    times = M.span_times(spans)
    got = M.emd(times, times.withColumn("run_num", F.lit(0)), "day_hour_emd").first()["sim_val"]
    assert got == 0
    assert M.mae_matching(spans, spans.withColumn("run_num", F.lit(0))).first()["sim_val"] == 0


def test_identical_logs_match_fully(spark):
    log = seqs(spark, "ABC", "ACB", "AAD", "DED")
    for metric in ("dl", "tsd"):
        assert M.matched_score(log, log, metric, 0.001).first()["sim_val"] == pytest.approx(1.0)


def test_matching_is_near_the_optimum(spark):
    rng = random.Random(3)
    words = lambda: ["".join(rng.choice("ABCD") for _ in range(rng.randint(2, 6))) for _ in range(6)]
    x, y = words(), words()
    got = M.matched_score(seqs(spark, *x), seqs(spark, *y), "dl", 0.001).first()["sim_val"]
    cost = [[dl(a, b) / max(len(a), len(b)) for b in y] for a in x]
    best = min(sum(cost[i][p[i]] for i in range(6)) for p in itertools.permutations(range(6)))
    assert got == pytest.approx(1 - best / 6, abs=0.0011)


def dl(a, b):
    """Textbook unrestricted Damerau-Levenshtein."""
    last, big = {}, len(a) + len(b)
    d = {(-1, -1): big}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = big, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = big, j
    for i in range(1, len(a) + 1):
        col = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), col
            hit = a[i - 1] == b[j - 1]
            if hit:
                col = j
            d[i, j] = min(d[i - 1, j - 1] + (not hit), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_edit_distances_against_plain_loops():
    rng = random.Random(1)
    a, b = ([[rng.randint(1, 4) for _ in range(rng.randint(1, 9))] for _ in range(300)] for _ in range(2))
    (x, lx), (y, ly) = D.pad(a), D.pad(b)
    assert (D.damerau_levenshtein(x, lx, y, ly, 4) == [dl(p, q) for p, q in zip(a, b)]).all()


def test_timed_distance_by_hand():
    par = np.zeros((3, 3), bool)
    one = lambda *v: np.array([v])
    size = np.array([2])
    same = D.timed_distance(one(1, 2), size, one(0.5, 1.0), one(0.5, 0.0), one(1, 2), size, one(0.3, 0.5), one(0.1, 0.9), par)
    assert same[0] == pytest.approx(0.5 * 0.2 + 0.5 * 0.4 + 1.0 * 0.5)
    # a swap of tasks that are not parallel costs what the cell costs (different tasks: 1)
    swap = D.timed_distance(one(1, 2), size, one(1.0, 1.0), one(0.0, 0.0), one(2, 1), size, one(0.9, 0.7), one(0.0, 0.0), par)
    assert swap[0] == pytest.approx(1.0)
    par[1, 2] = par[2, 1] = True
    # parallel tasks: the cost of matching the right-hand task with its swapped partner
    swap = D.timed_distance(one(1, 2), size, one(1.0, 1.0), one(0.0, 0.0), one(2, 1), size, one(0.9, 0.7), one(0.0, 0.0), par)
    assert swap[0] == pytest.approx(0.1)


def test_invariants(spark):
    """Probabilities sum to 1, splits are complete, draws repeat, work in progress ends at 0."""
    from caseloom.operators import wip as X

    log = seqs(spark, "ABC", "ACB", "AAD", "DED")
    model = W.transitions(W.prefix_pairs(W.bounded_sequences(log)))
    sums = [r["s"] for r in model.groupBy("ctx").agg(F.sum("prob").alias("s")).collect()]
    assert sums == pytest.approx([1.0] * len(sums), abs=1e-9)
    split = SP.random_cases(log, 0.5, seed=2)
    assert split.count() == log.count() and split.groupBy("caseid").agg(F.countDistinct("split").alias("k")).filter("k > 1").count() == 0
    draw = lambda: sorted(map(tuple, (r["seq"] for r in P.sample_sequences(spark, model, 20, seed=4).collect())))
    first = draw()
    assert len(first) == 20 and first == draw() and all(s[0] == "addstart" and s[-1] == "addend" for s in first)
    wip = X.process_wip(S.add_start_end(log)).orderBy("ts").collect()
    assert wip[-1]["wip"] == 0 and min(r["wip"] for r in wip) >= 0


def test_variates_have_their_moments(spark):
    from caseloom.functions import rand as R

    df = spark.range(20000).select(
        R.gamma(F.xxhash64("id"), F.lit(2.0), F.lit(3.0)).alias("g"),
        R.lognormal(R.uniform(1, "id"), R.uniform(2, "id"), F.lit(5.0), F.lit(4.0)).alias("l"),
        R.triangular(R.uniform(1, "id"), F.lit(0.0), F.lit(1.0), F.lit(5.0)).alias("t"),
    )
    r = df.agg(F.avg("g"), F.var_pop("g"), F.avg("l"), F.var_pop("l"), F.avg("t")).first()
    assert r[0] == pytest.approx(6, rel=0.03) and r[1] == pytest.approx(18, rel=0.08)
    assert r[2] == pytest.approx(5, rel=0.03) and r[3] == pytest.approx(4, rel=0.1) and r[4] == pytest.approx(2, rel=0.03)


def test_distribution_rules(spark):
    rows = [("fixed", 7.0)] * 5 + [("few", float(k)) for k in range(1, 11)]
    got = {r["task"]: (r["dname"], r["mean"], r["arg1"]) for r in G.fit_distributions(spark.createDataFrame(rows, "task string, v double"), ["task"], "v").collect()}
    assert got == {"fixed": ("FIXED", 7.0, 0.0), "few": ("EXPONENTIAL", 0.0, 5.5)}


def test_synthetic_arrivals(spark):
    rates = spark.createDataFrame([(w, h, 2.0, 1.0, 3.0) for w in range(7) for h in range(24)], "weekday int, hour int, expected double, low double, high double")
    got = P.arrivals_from_rates(rates, dt.datetime(2024, 2, 1), 500).collect()
    assert sorted(r["caseid"] for r in got) == list(range(1, 501))
    assert min(r["timestamp"] for r in got) >= dt.datetime(2024, 2, 1)


def test_moving_count_has_open_left_end(spark):
    rows = [("a", at(0)), ("b", at(180)), ("c", at(359))]
    df = spark.createDataFrame(rows, "caseid string, ts timestamp_ntz")
    assert {r["caseid"]: r["arrivals"] for r in A.moving_count(df).collect()} == {"a": 1, "b": 1, "c": 2}


def test_a_far_outlier_makes_no_bins(spark):
    from caseloom.operators import profile as G

    r = random.Random(9)
    body = [r.gauss(100, 10) for _ in range(1200)]
    rows = [("far", v) for v in body + [1e9]] + [("farther", v) for v in body + [1e18]] + [("plain", v) for v in body]
    df = spark.createDataFrame(rows, "task string, v double")
    got = {x["task"]: x["dname"] for x in G.fit_distributions(df, ["task"], "v").collect()}
    assert set(got) == {"far", "farther", "plain"} and got["plain"] in ("NORMAL", "LOGNORMAL", "GAMMA")


def test_errors_by_places_equal_those_of_all_bins(spark, monkeypatch):
    from caseloom.operators import profile as G

    r = random.Random(10)
    df = spark.createDataFrame([("a", r.expovariate(0.01)) for _ in range(2000)] + [("a", 60_000.0)], "task string, v double")
    whole = {x["dname"]: x["sse"] for x in G.distribution_errors(df, ["task"], "v").collect()}
    monkeypatch.setattr(G, "SINGLE_BINS", 64)
    parts = {x["dname"]: x["sse"] for x in G.distribution_errors(df, ["task"], "v").collect()}
    assert whole == pytest.approx(parts, rel=1e-3)


def test_roles_that_look_alike_keep_their_columns(spark):
    from caseloom.operators import wip as WI

    names = WI.role_columns(["Role 1", "Role-1", "role_1", "Other"])
    assert names == {"Role 1": "role_1", "Role-1": "role_1_2", "role_1": "role_1_3", "Other": "other"}


def test_prefix_trie_is_the_prefix_model(spark):
    from caseloom.model import ORDER

    log = seqs(spark, "ABC", "ACB", "AAD", "DED", "A", "ABCABC", "ABC")
    model = W.transitions(W.prefix_pairs(W.bounded_sequences(log)))
    trie = W.prefix_trie(log, ORDER)
    rows = lambda df: sorted(((tuple(r["ctx"]), r["nxt"], r["n"], r["prob"]) for r in df.collect()))
    assert rows(W.with_contexts(trie, log, ORDER)) == rows(model)
    drawn = lambda df: sorted(map(tuple, (r["seq"] for r in df.collect())))
    assert drawn(P.sample_trie(spark, trie, 30, seed=4)) == drawn(P.sample_sequences(spark, model, 30, seed=4))


def test_times_over_a_long_chain_of_links(spark):
    from caseloom.operators import context as X

    n = 50_000
    rows = [(1, k, k, [k - 1] if k else None, 1, 2) for k in range(n)] + [(2, 0, 0, None, 5, 10), (2, 1, 1, [0], 1, 1), (2, 2, 2, [0, 1, 9], 3, 1)]
    df = spark.createDataFrame(rows, "caseid int, idx int, key int, last array<int>, wait_us long, proc_us long")
    df = df.withColumn("arrival", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    got = X.assemble_links(df).select("caseid", "idx", *[(F.unix_micros(F.col(c).cast("timestamp")) % 1_000_000).alias(c) for c in ("start_ts", "end_ts")])
    by = {(r["caseid"], r["idx"]): (r["start_ts"], r["end_ts"]) for r in got.collect()}
    assert by[1, 0] == (0, 2) and by[1, n - 1] == (3 * (n - 1), 3 * (n - 1) + 2)
    assert [by[2, k] for k in range(3)] == [(0, 10), (11, 12), (15, 16)]


@pytest.mark.parametrize("low", [-2.5, 0.0, 0.7, 4.0])
def test_normal_draws_above_a_bound(spark, low):
    """Mean and share above a further point as the truncated normal has them; no draw at or below the bound."""
    import statistics

    from caseloom.functions import rand as R

    n = 20_000
    df = spark.range(n).select("id", R.normal_above(F.xxhash64("id"), F.lit(low)).alias("z"))
    z = np.array([r["z"] for r in df.collect()])
    phi = statistics.NormalDist()
    above = phi.cdf(-low)
    mean = phi.pdf(low) / above
    assert (z > low).all() and abs(z.mean() - mean) < 5 * z.std() / n**0.5
    share = phi.cdf(-low - 0.3) / above
    assert abs((z > low + 0.3).mean() - share) < 5 * (share * (1 - share) / n) ** 0.5
    again = df.repartition(3).orderBy("id").collect()
    assert [r["z"] for r in again] == list(z)
    assert spark.range(1).select(R.normal_above(F.col("id"), F.lit(None).cast("double")).alias("z")).first()["z"] is None
