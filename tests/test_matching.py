"""Matchings of numbers and of sequences against plain versions."""

import random

import numpy as np
import pytest

from caseloom.functions.distance import damerau_levenshtein, levenshtein, pad
from caseloom.operators import matching
from caseloom.operators import nearest as N


def plain(x, y):
    short, long = sorted((sorted(x), sorted(y)), key=len)
    free = len(long) - len(short)
    cost = np.zeros(free + 1, np.int64)
    for i, v in enumerate(short):
        cost = np.minimum.accumulate(cost) + np.abs(np.array(long[i : i + free + 1]) - v)
    return int(cost.min())


def stretch(x, y):
    """y and gaps of a union, as the operator makes them."""
    short, long = sorted((x, y), key=len)
    values = sorted(set(x) | set(y))
    net = [long.count(v) - short.count(v) for v in values]
    return np.cumsum(net), np.diff(values, append=values[-1]), len(long) - len(short)


def test_thresholds_give_the_best_matching():
    r = random.Random(1)
    for _ in range(300):
        top = r.choice([4, 30, 1000])
        x, y = ([r.randint(0, top) for _ in range(r.randint(1, 25))] for _ in range(2))
        levels, w, free = stretch(x, y)
        cut = r.randint(1, 6)
        node = matching.joined([matching.leaf(levels[a : a + cut], w[a : a + cut]) for a in range(0, len(w), cut)])
        cost = sum(int(g) * (max(-t, 0) + max(t - free, 0)) for g, t in zip(w.tolist(), levels.tolist()))
        for level in range(max(node.lo, 0) + 1, min(node.hi, free) + 1):
            s, low = node.at(np.array([level]))
            cost += (node.w - int(s[0])) // 2 + int(low[0])
        assert cost == plain(x, y)


@pytest.mark.parametrize("small", [False, True])
def test_matching_of_runs(spark, monkeypatch, small):
    if small:  # many groups, three levels of joins, blocks of few levels
        for name, value in (("GROUP", 7), ("PART", 3), ("FAN", 3), ("LEVELS", 4), ("BLOCKS", 5)):
            monkeypatch.setattr(matching, name, value)
    r = random.Random(2)
    one = [r.randint(0, 500) for _ in range(150)]
    runs = {k: [r.randint(0, 500) + r.choice([0, 0, 40]) for _ in range(n)] for k, n in enumerate((150, 1, 110, 149, 260, 30))}
    runs[6] = one[:]
    runs[None] = [5] * 100 + [400] * 20
    a = spark.createDataFrame([(v,) for v in one] + [(None,)], "v long")
    b = spark.createDataFrame([(k, v) for k, vs in runs.items() for v in vs] + [(0, None), (9, None)], "run int, v long")
    got = {row["run"]: (row["pairs"], int(row["cost"])) for row in matching.match_on_line(a, b).collect()}
    assert got == {k: (min(len(v), len(one)), plain(one, v)) for k, v in runs.items()}
    assert matching.match_on_line(a.limit(0), b).collect() == []


def test_a_hot_value_and_a_long_shift(spark, monkeypatch):
    monkeypatch.setattr(matching, "GROUP", 64)
    r = np.random.default_rng(3)
    one = np.concatenate([r.integers(0, 10**12, 3000), np.full(1500, 77)]).tolist()
    other = np.concatenate([r.integers(3 * 10**11, 2 * 10**12, 4000), np.full(2000, 77)]).tolist()
    a = spark.createDataFrame([(int(v),) for v in one], "v long")
    b = spark.createDataFrame([(1, int(v)) for v in other], "run int, v long")
    assert int(matching.match_on_line(a, b).first()["cost"]) == plain(one, other)


def all_pairs(left, right, swaps):
    ids = {c: k + 1 for k, c in enumerate(sorted({c for x in [*left, *right] for c in x}))}
    code = lambda side: pad([[ids[c] for c in x] for x in side])
    (x, lx), (y, ly) = code([a for a in left for _ in right]), code([b for _ in left for b in right])
    d = damerau_levenshtein(x, lx, y, ly, len(ids)) if swaps else levenshtein(x, lx, y, ly)
    return d.reshape(len(left), len(right))


def sequences(r, n, mean):
    base = [[r.choice("ABCDE") for _ in range(max(0, int(r.gauss(mean, mean / 3))))] for _ in range(n // 3)]
    out = set()
    for _ in range(n):
        s = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2, 4])):
            k = r.randrange(len(s) + 1)
            s[k : k + r.randint(0, 2)] = r.choice(["", "A", "F", "BC"])
            if len(s) > 2 and r.random() < 0.5:
                k = r.randrange(len(s) - 1)
                s[k], s[k + 1] = s[k + 1], s[k]
        out.add("".join(s))
    return sorted(out)


@pytest.mark.parametrize("swaps", [False, True])
def test_nearest_sequences(spark, swaps):
    r = random.Random(5)
    left = sequences(r, 60, 9) + ["", "Q", "ZZZZZZZZZZZZZZZZZZZZZZ"]
    right = sequences(r, 60, 9) + sequences(r, 20, 2)
    right = sorted(set(right))
    a = spark.createDataFrame([(k, list(x)) for k, x in enumerate(left)] + [(999, None)], "a long, x array<string>")
    b = spark.createDataFrame([(k, list(y)) for k, y in enumerate(right)], "b long, y array<string>")
    d = all_pairs(left, right, swaps)
    want = {(i, j, int(d[i, j])) for i in range(len(left)) for j in np.flatnonzero(d[i] == d[i].min()).tolist()}
    assert {tuple(row) for row in N.nearest(a, b, swaps).collect()} == want
    assert N.nearest(a, b.limit(0), swaps).collect() == [] == N.nearest(a.limit(0), b, swaps).collect()
    # the index keeps every pair in reach, and few others
    for limit in (1, 2):
        pairs = {tuple(row) for row in N.candidates(a.filter("x is not null"), b, limit, swaps).collect()}
        assert {(i, j) for i, j in np.argwhere(d <= limit).tolist()} <= pairs
        assert limit > 1 or len(pairs) < 0.25 * d.size


def test_similar_profiles(spark):
    from caseloom.operators import profile as G

    r = np.random.default_rng(7)
    dense = np.zeros((90, 40), int)
    for k in range(90):
        own = r.choice(40, r.integers(1, 9), replace=False)
        dense[k, own] = r.integers(1, 20, len(own))
    dense[60:75] = dense[:15] * 3 + (r.random((15, 40)) < 0.05)
    dense[75:80] = dense[1]
    dense[80] = 4  # constant: no correlation
    dense[81] = 4
    dense[81, 3] = 5
    counts = [(int(i), int(j), int(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    df = spark.createDataFrame(counts, "id long, feature long, n long")
    with np.errstate(invalid="ignore"):
        c = np.corrcoef(dense)
    for t in (0.1, 0.5, 0.7, 0.95):
        got = {(x["a"], x["b"]): x["r"] for x in G.similar_profiles(df, t).collect()}
        want = {(i, j): c[i, j] for i in range(90) for j in range(i + 1, 90) if c[i, j] > t + 1e-9}
        assert want.keys() <= got.keys() and all(c[k] > t - 1e-9 for k in got)
        assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_roles_link_proportional_profiles(spark):
    from caseloom.operators import profile as G

    rows = [(f"u{k}", t, n * (k + 1)) for k in range(6) for t, n in (("A", 2), ("B", 1))] + [("v", t, 1) for t in "CD"] + [("w", t, 1) for t in "ABCDE"]
    log = spark.createDataFrame([(u, t) for u, t, n in rows for _ in range(n)], "user string, task string")
    edges = {(x["a"], x["b"]) for x in G.similar_users(log, 0.7).collect()}
    assert edges == {(f"u{k}", "u0") for k in range(1, 6)}


def plain_auction(c, epsilon):
    """All free cases bid at once; the highest bid wins, ties by the later case."""
    n, m = c.shape
    price, owner = np.zeros(m), np.full(m, -1)
    while len(free := np.setdiff1d(np.arange(n), owner)):
        bids = {}
        for i in free:
            order = np.lexsort((np.arange(m), c[i] + price))[:2]
            v = (c[i] + price)[order]
            bids.setdefault(order[0], []).append((price[order[0]] + v[-1] - v[0] + epsilon, i))
        for j, offers in bids.items():
            price[j], owner[j] = max(offers)
    return {(int(owner[j]), int(j)) for j in np.flatnonzero(owner >= 0)}


@pytest.mark.parametrize("held", [0, 60, 1 << 20])
def test_auction_asks_for_few_costs(monkeypatch, held):
    """Only the cheapest right cases of each left one are held; the matching is that of the whole matrix."""
    from caseloom.operators import metrics as M

    monkeypatch.setattr(M, "HELD", held)
    monkeypatch.setattr(M, "LEAST", 2)
    r = np.random.default_rng(9)
    for n, m in ((1, 1), (1, 4), (12, 12), (12, 20), (20, 21), (5, 9)):
        c = r.integers(1, 6, (n, m)) / 10 + (r.random((n, m)) if m == 20 else 0)
        if m == 9:  # a case without costs takes what it gets
            c[2] = np.nan
        asked = []

        def tiles(prices, most, cases=None):
            asked.append(most)
            for i in range(n) if cases is None else cases.tolist():
                order = np.lexsort((np.arange(m), c[i] + prices))[:most]
                js, end = np.sort(order).astype(np.int32), order[-1]
                bound, last = ((c[i] + prices)[end], int(end)) if m > most else (np.inf, m)
                yield {"i": i, "js": js.tobytes(), "costs": c[i][js].tobytes(), "bound": bound, "last": last}

        got = M.auction(tiles, n, m, 0.01)
        assert {(i, j) for i, j, _ in got} == plain_auction(c, 0.01)
        assert all(x == c[i, j] or i == 2 and m == 9 for i, j, x in got)
        assert held < 1 << 20 or len(asked) == 1
    assert M.auction(tiles, 0, 3, 0.01) == []
    with pytest.raises(ValueError):
        M.auction(tiles, 3, 2, 0.01)


def words_log(spark, texts, seed):
    import datetime as dt

    r, t0 = random.Random(seed), dt.datetime(2024, 1, 1)
    rows = []
    for k, w in enumerate(texts):
        at = t0
        for p, x in enumerate(w):
            end = at + dt.timedelta(minutes=r.randint(0, 50))
            rows.append((f"c{k}", x, "u", at, end, p))
            at = at + dt.timedelta(minutes=r.randint(1, 60))
    return spark.createDataFrame(rows, "caseid string, task string, user string, start_ts timestamp_ntz, end_ts timestamp_ntz, pos long")


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("sizes", [(23, 30), (30, 23)])
def test_matched_score_in_few_jobs(spark, monkeypatch, small, sizes):
    from caseloom.functions.distance import damerau_levenshtein_table, timed_distance
    from caseloom.operators import flow as W
    from caseloom.operators import metrics as M

    if small:  # several tiles of both sides, and costs that are asked for again
        for name, value in (("MOST", 7), ("TILE", 3), ("HELD", 100), ("LEAST", 4)):
            monkeypatch.setattr(M, name, value)
    r = random.Random(4)
    sides = [["".join(r.choice("ABC") for _ in range(r.randint(2, 9))) for _ in range(n)] for n in sizes]
    log, sim = (words_log(spark, x, seed) for seed, x in enumerate(sides))
    a, b, names = M.paired_profiles(log, sim)
    a, b = (sorted(x.collect(), key=lambda row: row["caseid"]) for x in (a, b))
    x, y = ([row["codes"] for row in side] for side in (a, b))
    longest = np.maximum.outer([len(s) for s in x], [len(s) for s in y])
    parallel, _ = M._settings("tsd", None, None, names, W.footprint(log))
    tsd = np.empty(longest.shape)
    one = lambda row: [np.array([row[c]]) for c in ("codes", "p", "w")]
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            (s, sp, sw), (t, tp, tw) = one(q), one(p)
            tsd[i, j] = timed_distance(s, np.array([s.size]), sp, sw, t, np.array([t.size]), tp, tw, parallel)[0]
    for metric, c, epsilon in (("dl", damerau_levenshtein_table(x, y) / longest, 0.01), ("tsd", tsd / longest, 0.02)):
        c = c.T if len(a) > len(b) else c
        pairs = plain_auction(c, epsilon)
        group = f"match-{metric}-{small}-{sizes}"
        spark.sparkContext.setJobGroup(group, metric)
        got = M.matched_score(log, sim, metric, epsilon).first()["sim_val"]
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup("other", "other")
        assert got == pytest.approx(1 - np.mean([c[i, j] for i, j in pairs]), abs=1e-12)
        assert small or jobs < 60
