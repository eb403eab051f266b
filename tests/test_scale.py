"""What grows with the input: steps that are read several times run once."""

import datetime as dt
import os
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseloom.functions import distance as D
from caseloom.model import LIFECYCLE
from caseloom.operators import blocks as B
from caseloom.operators import embed as E
from caseloom.operators import profile as G
from caseloom.operators import sample as P
from caseloom.operators import samples as N
from caseloom.operators import wip as X
from caseloom.sources import logs as L
from caseloom.sources import sinks as SK

T0 = dt.datetime(2024, 1, 1)


def test_block_model_runs_its_input_once(spark):
    rows = []
    for c in range(5):
        for k, x in enumerate("A+ A- B+ C+ B- D+ C- D- E+ E-".split()):
            rows.append((f"c{c}", x[:-1], "u", T0 + dt.timedelta(minutes=k), "start" if x[-1] == "+" else "complete", k))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    life = spark.createDataFrame(rows, LIFECYCLE)
    life = life.mapInArrow(count, life.schema)
    got = B.block_model(life).filter("kind = 'first'").collect()
    assert [(r["token"], r["n"], r["prob"]) for r in got] == [("[A | E]", 5, 1.0)]
    assert seen.value == len(rows)


def test_blocks_may_begin_with_activities_without_a_name(spark):
    rows = []
    for k, (t, d) in enumerate([("A", "+"), ("A", "-"), ("B", "+"), (None, "+"), ("B", "-"), (None, "-"), ("E", "+"), ("E", "-")]):
        rows.append(("c", t, "u", T0 + dt.timedelta(minutes=k), "start" if d == "+" else "complete", k))
    # the items are tried on rows of their own, where the unnamed activity is one of the first
    acts = [{"pos": p, "task": t, "next": None, "next_act": None, "block_end": 9, "is_first": True} for p, t in ((2, "B"), (3, None))]
    batch = pa.RecordBatch.from_pylist([{"token": "[A | E]", "acts": acts}])
    items = pa.Table.from_batches(B._block_items([batch])).to_pylist()
    assert [e["names"] for e in items[0]["item"]] == [[None], ["B"]]
    assert B.block_model(spark.createDataFrame(rows, LIFECYCLE)).filter("kind = 'first'").count() == 1


def plain_silhouette(rows):
    """Pairs one by one."""
    out = []
    for i, (x, c) in enumerate(rows):
        far = {}
        for j, (y, o) in enumerate(rows):
            if o is not None:
                far.setdefault(o, []).append(float(np.linalg.norm(np.array(x) - np.array(y))))
        own = far.pop(c, [])
        if c is None or len(own) < 2:
            out.append(0.0)
            continue
        a, b = sum(own) / (len(own) - 1), min((sum(v) / len(v) for v in far.values()), default=None)
        out.append((b - a) / max(a, b) if b is not None and max(a, b) else 0.0)
    return sum(out) / len(out)


def test_silhouettes_of_several_clusterings_read_the_points_once(spark, monkeypatch):
    monkeypatch.setattr(E, "TILE", 4)
    monkeypatch.setattr(E, "CELLS", 16)
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=3).tolist(), None if k == 7 else k % 4) for k in range(30)] + [(30 + k, [1.0, 1.0, 1.0], 5) for k in range(3)] + [(40, [1.0, 1.0, 1.0 + 1e-7], 0)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "id long, vec array<double>, cluster int")
    df = df.mapInArrow(count, df.schema)
    ways = {1: F.col("cluster"), 2: F.col("cluster") % 2}
    got = {r["method"]: r["silhouette"] for r in E.silhouettes(df, ways).collect()}
    assert seen.value == len(rows)
    want = {1: plain_silhouette([(v, c) for _, v, c in rows]), 2: plain_silhouette([(v, None if c is None else c % 2) for _, v, c in rows])}
    assert got.keys() == want.keys() and all(abs(got[m] - want[m]) < 1e-9 for m in want)


def test_distance_tables_equal_the_pairwise_distances():
    rng = np.random.default_rng(1)
    draw = lambda n, size, letters: [rng.integers(1, letters + 1, rng.integers(0, size + 1)) for _ in range(n)]
    for letters, size in ((2, 5), (3, 9), (6, 14), (1, 4)):
        left, right = draw(20, size, letters), draw(17, size, letters)
        i, j = (g.ravel() for g in np.indices((20, 17)))
        (a, la), (b, lb) = D.pad(left), D.pad(right)
        assert (D.damerau_levenshtein_table(left, right).ravel() == D.damerau_levenshtein(a[i], la[i], b[j], lb[j], letters)).all()
        sides = [[(s, rng.random(len(s)) * rng.integers(0, 2, len(s)), rng.random(len(s))) for s in side] for side in (left, right)]
        (pa, wa), (pb, wb) = ([D.pad([s[k] for s in side], dtype=float)[0] for k in (1, 2)] for side in sides)
        par = rng.random((letters + 1, letters + 1)) < 0.5
        want = D.timed_distance(a[i], la[i], pa[i], wa[i], b[j], lb[j], pb[j], wb[j], par)
        assert (D.timed_distance_table(*sides, par).ravel() == want).all()


def seconds(f):
    t = time.process_time()
    f()
    return time.process_time() - t


def test_distances_take_many_cells_at_once():
    """A pair of a table costs a small part of a pair measured cell by cell (before: an eighth)."""
    rng = np.random.default_rng(2)
    left, right = ([rng.integers(1, 6, rng.integers(50, 90)) for _ in range(n)] for n in (40, 1000))
    (a, la), (b, lb) = D.pad([left[k % 40] for k in range(200)]), D.pad(right[:200])
    one = seconds(lambda: D.damerau_levenshtein(a, la, b, lb, 5)) / 200
    assert seconds(lambda: D.damerau_levenshtein_table(left, right)) / 40_000 < one / 40
    # with times (before: a seventeenth)
    par = np.zeros((6, 6), bool)
    par[1, 2] = par[2, 1] = True
    left, right = ([(s, rng.random(len(s)), rng.random(len(s))) for s in side] for side in (left, right))
    ((a, la), (b, lb)), (pa, wa), (pb, wb) = (
        [D.pad([x[0] for x in side]) for side in ([left[k % 40] for k in range(200)], right[:200])],
        *([D.pad([x[k] for x in side], dtype=float)[0] for k in (1, 2)] for side in ([left[k % 40] for k in range(200)], right[:200])),
    )
    one = seconds(lambda: D.timed_distance(a, la, pa, wa, b, lb, pb, wb, par)) / 200
    assert seconds(lambda: D.timed_distance_table(left, right, par)) / 40_000 < one / 28


def test_timed_tables_of_few_sequences(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(D, "TIMED", 3)
    for letters in (1, 2, 4):
        par = rng.random((letters + 1, letters + 1)) < 0.5
        # times beyond 1, and none: a replacement can cost more than 1
        left, right = ([(rng.integers(1, letters + 1, n), 3 * rng.random(n) * rng.integers(0, 2, n), rng.random(n) * rng.integers(0, 2, n)) for n in rng.integers(0, 9, 11)] for _ in range(2))
        i, j = (g.ravel() for g in np.indices((11, 11)))
        (a, la), (b, lb) = (D.pad([s[0] for s in side]) for side in (left, right))
        (pa, wa), (pb, wb) = ([D.pad([s[k] for s in side], dtype=float)[0] for k in (1, 2)] for side in (left, right))
        want = D.timed_distance(a[i], la[i], pa[i], wa[i], b[j], lb[j], pb[j], wb[j], par)
        assert (D.timed_distance_table(left, right, par).ravel() == want).all()


def test_words_of_bits_hand_on_their_carries(monkeypatch):
    rng = np.random.default_rng(3)
    for letters, lanes in ((1, 8192), (2, 8192), (2, 5), (4, 1)):
        monkeypatch.setattr(D, "LANES", lanes)
        base = rng.integers(1, letters + 1, 210)
        edited = []
        for n in (0, 1, 15, 16, 17, 32, 33, 63, 64, 65, 70, 127, 128, 129, 190, 200):
            s = base[: n + 6].tolist()
            for k in rng.integers(0, n + 5, 6).tolist():
                s[k], s[k + 1] = s[k + 1], s[k]
            edited.append(np.array(s[:n], int))
        right = edited[::2] + [base[3:150]]
        i, j = (g.ravel() for g in np.indices((len(edited), len(right))))
        (a, la), (b, lb) = D.pad(edited), D.pad(right)
        want = D.damerau_levenshtein(a[i], la[i], b[j], lb[j], letters).reshape(len(edited), len(right))
        assert (D.damerau_levenshtein_table(edited, right) == want).all()


def test_training_rows_are_as_few_partitions_as_they_need(spark):
    rows = spark.range(0, 1000, 1, 40).select(F.concat(F.lit("c"), F.col("id") % 7).alias("caseid"), F.col("id").alias("ngram_num"))
    got = N.training_rows(rows)
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert N.training_rows(rows, 50).rdd.getNumPartitions() == 20
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    few = spark.range(0, 10, 1, 2).select(F.lit("c").alias("caseid"), F.col("id").alias("ngram_num"))
    assert N.training_rows(few).rdd.getNumPartitions() == 2


def test_features_read_their_log_once(spark):
    rows = [(f"c{c}", t, u, T0 + dt.timedelta(minutes=c + k), T0 + dt.timedelta(minutes=c + k + 2), 10 * c + k, r)
            for c in range(4) for k, (t, u, r) in enumerate([("Start", "Start", None), ("a", "u1", "R1"), ("b", "u2", "R2"), (None, None, None), ("End", "End", None)])]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    log = spark.createDataFrame(rows, "caseid string, task string, user string, start_ts timestamp_ntz, end_ts timestamp_ntz, pos long, role string")
    log = log.mapInArrow(count, log.schema)
    roles = spark.createDataFrame([("u1", "R1"), ("u2", "R2"), ("u3", "R2")], "user string, role string")
    got = {(r["caseid"], r["pos"]): r for r in X.attach_features(log, roles, mode="own").collect()}
    assert seen.value == len(rows) == len(got)

    def state(at, hit):
        return sum((r[3] <= at) - (r[4] <= at) for r in rows if hit(r))

    for r in rows:
        g = got[r[0], r[5]]
        for tag, at in (("st", r[3]), ("end", r[4])):
            if r[6] is not None:
                assert g[f"{tag}_t_wip"] == state(at, lambda x: x[1] == r[1] and x[6] is not None)
                assert g[f"{tag}_oc"] == state(at, lambda x: x[6] == r[6]) / (1 if r[6] == "R1" else 2)
            elif r[1] is None:
                assert g[f"{tag}_t_wip"] is None and g[f"{tag}_oc"] is None


def test_window_draws_stop_for_widths_that_have_enough(spark, monkeypatch):
    rows = [(1, k, d, G.EXPONENTIAL, 0.0, 300.0, 0.0, 9) for k in range(1, 25) for d in range(7)]
    rows += [(12, 1, 0, G.FIXED, 9000.0, 0.0, 0.0, 4), (12, 2, 3, G.GAMMA, 20000.0, 4e6, 0.0, 1), (12, 1, 4, G.FIXED, 0.0, 0.0, 0.0, 50)]
    model = spark.createDataFrame(rows, "w int, window int, weekday int, dname string, mean double, arg1 double, arg2 double, num int")
    start, asked = dt.datetime(2024, 1, 1), []
    real = P.draw_distribution
    monkeypatch.setattr(P, "draw_distribution", lambda d, *a: asked.append(d.select("w", "id").distinct().collect()) or real(d, *a))
    got = P.arrivals_from_windows(model, start, 100).collect()
    slots = [tuple(r) for part in asked for r in part]
    assert len(slots) == len(set(slots))  # no window is drawn twice
    assert max(i for w, i in slots if w == 1) < 60 * 24 <= max(i for w, i in slots if w == 12)
    times = {w: [r["timestamp"] for r in sorted(got, key=lambda r: r["n"]) if r["w"] == w] for w in (1, 12)}
    assert all(len(t) == 100 and t == sorted(t) and t[0] > start for t in times.values())
    fixed = [t for t in times[12] if t.weekday() == 0]
    assert {(t.hour, t.minute) for t in fixed} == {(2, 30), (5, 0), (7, 30), (10, 0)}
    assert {t.weekday() for t in times[12]} == {0, 3}


def test_xes_files_are_as_many_as_their_text_needs(spark, tmp_path):
    rows = [(f"c{c}", f"task {k}", None if k == 1 else "u", T0 + dt.timedelta(minutes=k), "start", k) for c in range(40) for k in range(3)]
    life = spark.createDataFrame(rows, LIFECYCLE).repartition(1)
    path = str(tmp_path / "log")
    SK.write_xes(life, path, file_bytes=4096)
    files = list((tmp_path / "log").glob("part-*"))
    assert len(files) > 5 and max(f.stat().st_size for f in files) < 5 * 4096
    got = sorted(tuple(r) for r in L.read_xes(spark, path).select("caseid", "task", "user", "ts", "transition", "pos").collect())
    assert got == sorted((c, t, u or SK.NO_RESOURCE, ts, tr, k) for c, t, u, ts, tr, k in rows)


def test_what_a_part_was_made_from_is_deleted(spark):
    from caseloom import session

    def files():
        return {os.path.join(a, f) for a, _, names in os.walk(session.checkpoint_dir(spark).removeprefix("file:")) for f in names if not f.startswith(".")}

    before = files()
    rows = session.store(spark.range(100))
    mine = files() - before

    def inner():
        return session.cut(session.store(rows).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")))

    def outer():
        a = session.passing(spark, inner)
        return session.cut(a).join(a.withColumnRenamed("s", "t"), "k")

    got = session.passing(spark, outer)
    assert {f.removeprefix("file://") for f in got.inputFiles()} | mine == {f for f in files() - before if f.endswith(".parquet")} | mine
    assert not [f for f in files() - before if "/rdd-" in f]
    assert sorted(tuple(r) for r in got.collect()) == [(k, sum(range(k, 100, 7)), sum(range(k, 100, 7))) for k in range(7)]
    assert rows.count() == 100 and session._written == []
    kept = files()
    with pytest.raises(ZeroDivisionError):
        session.passing(spark, lambda: session.cut(rows).limit(1 // 0))
    assert files() == kept and session._written == []
    session.discard(got)
    assert files() - before == mine


def test_generated_log_leaves_little_behind(spark):
    """The parts of the generator go when they are used: what is left is what the last step reads."""
    from caseloom import session
    from caseloom.plans.generate import generate
    from tests.test_matching import words_log

    def size():
        return sum(os.path.getsize(os.path.join(a, f)) for a, _, names in os.walk(session.checkpoint_dir(spark).removeprefix("file:")) for f in names if f.endswith(".parquet"))

    from checks.base import lifecycle_of

    log = words_log(spark, ["ABCAB", "ABD", "ACB", "BCA", "ABCD"] * 8, 3).withColumnRenamed("task", "name").withColumn("task", F.col("name")).drop("name")
    vectors = spark.createDataFrame([(t, [float(k), 1.0]) for k, t in enumerate("ABCD")], "name string, vec array<double>")
    before, written = size(), []
    life = lifecycle_of(log.withColumn("seg", F.lit(0)))
    old = session.store

    def counting(df):
        out = old(df)
        written.append(sum(os.path.getsize(f.removeprefix("file:").removeprefix("//")) for f in out.inputFiles()))
        return out

    with pytest.MonkeyPatch.context() as patch:
        for name in ("caseloom.operators.blocks", "caseloom.operators.sample", "caseloom.operators.nearest", "caseloom.session"):
            patch.setattr(f"{name}.store", counting)
        out = generate(log, life, vectors, 20, T0)
        assert out.select("caseid").distinct().count() == 20
    assert size() - before < sum(written) / 4
