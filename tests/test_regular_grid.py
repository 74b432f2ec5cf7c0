import math
import random

import pytest

from spikeloom.operators.regular_grid import event_rates, regular_grid

DDL = "src long, t double, y double, arrived long, id long, chunk string, b string, x string"


def brute(rows, step, k=2, least=2.0):
    last = {}
    for src, t, y, arrived, i, *_ in rows:
        if None in (src, t, y) or math.isinf(t) or math.isnan(t) or math.isnan(y) or t < 0 or y < 0:
            continue
        last[src, t / step] = max(last.get((src, t / step), (-1, -1, -1.0)), (arrived, i, y))
    out = {}
    for s in {a for a, _ in last}:
        pts = [(x, v[2]) for (a, x), v in last.items() if a == s]
        bins = {math.floor(x) for x, _ in pts}
        for b in range(min(bins), max(bins) + 1):
            near = [(x - b - 0.5, y) for x, y in pts if abs(math.floor(x) - b) <= k]
            w = [1 - (d / (k + 0.5)) ** 2 for d, _ in near]
            s0, s1, s2 = (sum(a * d**p for a, (d, _) in zip(w, near)) for p in range(3))
            t0, t1 = (sum(a * d**p * y for a, (d, y) in zip(w, near)) for p in range(2))
            held = s0 >= 0.01
            support = s0 * s0 / sum(a * a for a in w) if held else 0.0
            det = s0 * s2 - s1 * s1
            fit = (s2 * t0 - s1 * t1) / det if held and det > 1e-6 * s0 * s0 else t0 / s0 if held else None
            n = sum(math.floor(x) == b for x, _ in pts)
            status = "observed" if n else "filled" if support >= least - 1e-6 and fit is not None else "missing"
            out[s, b] = (n, support, max(fit, 0.0) if status != "missing" else None, status)
    return out


def run(spark, rows, **kw):
    got = regular_grid(spark.createDataFrame(rows, DDL), "src", "t", "y", 0.5, ("arrived", "id"), **kw).collect()
    return {(r.source_key, r.bin_no): (r.n_readings, r.support, r.value, r.status) for r in got}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == b[k][0] and a[k][3] == b[k][3], k
        assert a[k][1] == pytest.approx(b[k][1], abs=1e-5)
        assert (a[k][2] is None) == (b[k][2] is None)
        if a[k][2] is not None:
            assert a[k][2] == pytest.approx(b[k][2], abs=1e-4)


def test_against_brute_force_across_chunks(spark):
    rng = random.Random(3)
    rows = []
    for src in range(4):
        t = 0.0
        for i in range(250):
            t += rng.choice([0.1, 0.3, 0.6, 1.7, 6.0 if rng.random() < 0.1 else 0.4])
            rows.append((src, t, rng.uniform(0, 9), i, i, "c", "b", "x"))
    same(run(spark, rows), brute(rows, 0.5))
    same(run(spark, rows, chunk_bins=7), brute(rows, 0.5))
    same(run(spark, rows, chunk_bins=7, hot_rows=8), brute(rows, 0.5))
    same(run(spark, rows, hot_rows=0), brute(rows, 0.5))


def test_dirt(spark):
    nan = float("nan")
    rows = [
        (1, 0.2, 3.0, 1, 1, "", "", ""), (1, 0.2, 5.0, 2, 2, "", "", ""), (1, 0.2, 4.0, 2, 1, "", "", ""),  # sent again: the newest counts
        (1, None, 3.0, 1, 3, "", "", ""), (1, 0.4, None, 1, 4, "", "", ""), (1, nan, 1.0, 1, 5, "", "", ""), (1, 0.4, nan, 1, 6, "", "", ""),
        (1, float("inf"), 1.0, 1, 11, "", "", ""), (1, -3.0, 1.0, 1, 7, "", "", ""), (1, 0.4, -1.0, 1, 8, "", "", ""), (None, 0.4, 1.0, 1, 9, "", "", ""),
        (1, 4.1, 7.0, 1, 10, "", "", ""), (1, 4.1, 7.0, 1, 10, "", "", ""),
    ]
    got = run(spark, rows)
    same(got, brute(rows, 0.5))
    assert got[1, 0][0] == 1 and got[1, 0][2] == pytest.approx(5.0)
    assert got[1, 4][3] == "missing"


def test_empty_and_one_reading(spark):
    assert run(spark, []) == {}
    assert list(run(spark, [(1, 2.0, 3.0, 1, 1, "", "", "")])) == [(1, 4)]


def test_event_rates(spark):
    df = spark.createDataFrame([(1, 7, 1.0), (1, 7, 1.0), (1, 8, 1.0), (1, 7, 25.0), (1, 7, None), (None, 7, 1.0), (1, 7, -1.0), (1, 7, float("inf")), (1, 7, float("nan")), (1, 7, 1e300)], "src long, unit long, t double")
    got = {r.time: r.value for r in event_rates(df, "src", "t", 10.0, ("unit",)).collect()}
    assert got == {5.0: 0.2, 25.0: 0.1}


def test_a_time_far_off_is_unfolded_in_blocks(spark):
    rows = [(1, 0.2, 3.0, 1, 1, "", "", ""), (1, 600_000.2, 3.0, 1, 2, "", "", ""), (2, 1e300, 3.0, 1, 3, "", "", "")]
    got = regular_grid(spark.createDataFrame(rows, DDL), "src", "t", "y", 0.5, ("arrived", "id"))
    by = {r.status: r["count"] for r in got.groupBy("status").count().collect()}
    assert by == {"observed": 2, "missing": 1_200_001 - 2}
