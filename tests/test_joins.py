import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spikeloom.operators import joins, ordered


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_asof_known_answers(spark):
    frames = frame(spark, [(1, t, i) for i, t in enumerate([0, 1000, 2000, 3000])], "k long, f long, i long")
    want = frame(spark, [(1, t) for t in (500, 1500, 2999)], "k long, t long")
    got = joins.asof_join(want, frames, ["k"], "t", "f", ["i"], bucket=700.0)
    assert sorted((r.t, r.i) for r in got.collect()) == [(500, 0), (1500, 1), (2999, 2)]
    near = frame(spark, [(1, t, i) for i, t in enumerate([0, 100, 200, 300, 400])], "k long, f long, i long")
    want = frame(spark, [(1, t) for t in (149, 151, 200, 50, 150, 250, 350, -5, 999)], "k long, t long")
    got = {r.t: r.i for r in joins.asof_join(want, near, ["k"], "t", "f", ["i"], "nearest", bucket=130.0).collect()}
    assert got == {149: 1, 151: 2, 200: 2, 50: 0, 150: 1, 250: 2, 350: 3, -5: 0, 999: 4}


def test_asof_random_against_brute_force(spark):
    rng = random.Random(1)
    right = [(rng.randrange(3), rng.randrange(200), i) for i in range(60)]
    left = [(rng.randrange(4), rng.randrange(220)) for _ in range(80)] + [(None, 5), (1, None)]
    a = frame(spark, [(k, t, n) for n, (k, t) in enumerate(left)], "k long, t long, n long")
    b = frame(spark, right, "k long, f long, i long")
    for how in ("backward", "forward"):
        for strict in (False, True):
            got = {r.n: (r.f, r.i) for r in joins.asof_join(a, b, ["k"], "t", "f", ["f", "i"], how, strict, bucket=17.0).collect()}
            for n, (k, t) in enumerate(left):
                if t is None:
                    continue
                ok = [(f, i) for kk, f, i in right if kk == k and ((f < t or f == t and not strict) if how == "backward" else (f > t or f == t and not strict))]
                best = (max(ok) if how == "backward" else (lambda f0: max(x for x in ok if x[0] == f0))(min(ok)[0])) if ok else (None, None)
                assert got[n] == best, (how, strict, k, t)


def test_range_join_overlaps_and_bounds(spark):
    p = frame(spark, [(1, t / 2) for t in range(40)] + [(1, None), (None, 3.0)], "k long, t double")
    s = frame(spark, [(1, 0, 2.0, 6.0), (1, 1, 5.0, 9.5), (1, 2, None, 3.0), (1, 3, 8.0, 7.0)], "k long, i int, s double, e double")
    got = sorted((r.i, r.t) for r in joins.range_join(p, s, ["k"], "t", "s", "e", 1.7).collect())
    assert got == sorted((i, t / 2) for t in range(40) for i, a, b in ((0, 2, 6), (1, 5, 9.5)) if a <= t / 2 < b)
    closed = joins.range_join(p, s, ["k"], "t", "s", "e", 1.7, closed=True)
    assert closed.count() == len(got) + 2


def test_progressive_match_is_one_to_one(spark):
    rows = [(1, 10, 0, 0.1), (1, 11, 0, 0.2), (2, 10, 0, 0.3), (2, 11, 1, 0.5), (3, 12, 4, 0.1), (4, 12, 4, 0.2), (None, 13, 0, 0.0)]
    m = joins.progressive_match(frame(spark, rows, "a long, b long, d long, g double"), "a", "b", "d", [0, 1, 4], [F.col("d"), F.col("g"), F.col("a"), F.col("b")])
    assert sorted((r.a, r.b, r.pass_no) for r in m.collect()) == [(1, 10, 0), (2, 11, 1), (3, 12, 2)]


def test_compare_tables(spark):
    nan = float("nan")
    a = frame(spark, [(1, 1.0), (2, nan), (3, 2.0), (4, None), (5, 1.0)], "k long, v double")
    b = frame(spark, [(1, 1.0 + 1e-7), (2, nan), (3, 3.0), (4, None), (6, 1.0)], "k long, v double")
    got = {r.k: r.status for r in joins.compare_tables(a, b, ["k"], "v").collect()}
    assert got == {1: "close", 2: "equal", 3: "differs", 4: "equal", 5: "only_a", 6: "only_b"}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 50)), min_size=1, max_size=30))
def test_running_sum_and_previous(spark, rows):
    df = frame(spark, [(k, t, i) for i, (k, t) in enumerate(rows)], "k long, t long, i long")
    got = ordered.with_previous(ordered.running_sum(df, ["k"], ["t", "i"], F.floor(F.col("t") / 9), F.col("t"), "s"), ["k"], ["t", "i"], F.floor(F.col("t") / 9), F.col("t"), "p")
    out = {r.i: (r.s, r.p) for r in got.collect()}
    for i, (k, t) in enumerate(rows):
        before = sorted((u, j) for j, (kk, u) in enumerate(rows) if kk == k and (u, j) < (t, i))
        assert out[i] == (sum(u for u, _ in before), before[-1][0] if before else None)


def test_longest_run_ties_go_to_the_earliest(spark):
    df = frame(spark, [(1, t) for t in (0.0, 1.0, 2.0, 9.0, 10.0, 11.0, 30.0)] + [(1, None), (2, 4.0)], "k long, t double")
    for width in (1.7, 4.0, 100.0):
        got = {r.k: (r.run_start, r.run_end, r.n_rows) for r in ordered.longest_run(df, ["k"], "t", 1.5, width).collect()}
        assert got == {1: (0.0, 2.0, 3), 2: (4.0, 4.0, 1)}
