import random
import statistics

import pytest
from pyspark.sql import functions as F

from spikeloom.operators import joins, ordered, population
from spikeloom.sources import writers


def rows(seed, n=300, keys=(1, 2, None)):
    rng = random.Random(seed)
    return [(rng.choice(keys), i, round(rng.random() * 50, 2), rng.randrange(9)) for i in range(n)]


def test_neighbours_and_peaks(spark):
    data = rows(1)
    df = spark.createDataFrame(data, "k long, id long, t double, v long")
    got = {r.id: (r.a, r.b) for r in ordered.with_neighbours(df.dropDuplicates(["k", "t"]), ["k"], "t", F.floor(F.col("t") / 3), F.col("v"), "a", "b").collect()}
    kept = {r.id for r in df.dropDuplicates(["k", "t"]).collect()}
    for key in (1, 2, None):
        own = sorted(x for x in data if x[0] == key and x[1] in kept and x[1] in got)
        own.sort(key=lambda x: x[2])
        for i, x in enumerate(own):
            assert got[x[1]] == (own[i - 1][3] if i else None, own[i + 1][3] if i + 1 < len(own) else None)


def test_exact_median(spark):
    nan = float("nan")
    data = [*rows(2), (3, 1, 5.0, 1), (4, 1, None, 1), (4, 2, nan, 1)]
    df = spark.createDataFrame(data, "k long, id long, t double, v long")
    got = {r.k: r.median for r in ordered.exact_median(df, ["k"], "t", 2.5).collect()}
    want = {k: statistics.median(x[2] for x in data if x[0] == k) for k in (1, 2, None, 3)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert ordered.exact_median(df.limit(0), ["k"], "t", 2.5).count() == 0


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_against_brute_force(spark, direction, strict):
    if direction == "nearest" and strict:
        return
    left, right = [(k, i, t) for k, i, t, _ in rows(3, 80)], [(k, 1000 + i, t) for k, i, t, _ in rows(4, 60)]
    left += [(1, 900, right[0][2]), (1, 901, None)]
    right += [(1, 2000, right[0][2]), (None, 2001, 1.0), (1, 2002, None)]
    a, b = spark.createDataFrame(left, "k long, id long, t double"), spark.createDataFrame(right, "k long, hit long, at double")
    got = {r.id: (r.at, r.hit) for r in joins.asof_join(a, b, ["k"], "t", "at", ["at", "hit"], direction, strict, bucket=4.0).collect()}
    assert len(got) == len(left)
    for k, i, t in left:
        near = [(x, h) for kk, h, x in right if kk is not None and kk == k and x is not None and t is not None]
        back = [p for p in near if (p[0] < t if strict else p[0] <= t)] if t is not None else []
        fore = [p for p in near if (p[0] > t if strict else p[0] >= t)] if t is not None else []
        last = max(back, default=None)
        first = min(fore, key=lambda p: (p[0], -p[1]), default=None)
        want = last if direction == "backward" else first if direction == "forward" else None
        if direction == "nearest":
            want = first if last is None else last if first is None or t - last[0] <= first[0] - t else first
        assert got[i] == (want or (None, None)), (k, i, t)


def test_fdr_against_brute_force(spark):
    rng = random.Random(5)
    data = [(rng.choice("ab") if i % 7 else None, i, rng.choice([None, 0.0, 1.0, round(rng.random() ** 3, 3)])) for i in range(200)]
    df = spark.createDataFrame(data, "g string, id long, p double")
    for by in (["g"], []):
        got = {r.id: r.p_adjusted for r in population.fdr_adjusted(df, by, "p", cells=16).collect()}
        for group in {x[0] for x in data} if by else {"all"}:
            own = sorted((p, i) for g, i, p in data if p is not None and (not by or g == group))
            low = 1.0
            for rank in range(len(own), 0, -1):
                low = min(low, own[rank - 1][0] * len(own) / rank)
                assert got[own[rank - 1][1]] == pytest.approx(low)
        assert len(got) == sum(p is not None for *_, p in data)


def test_a_forced_append_swaps_whole_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    writers.append_new(df((1, "a"), (2, "b")), path, ["k"])
    writers.append_new(df((2, "x"), (3, "c")), path, ["k"])
    writers.append_new(df((1, "z")), path, ["k"], force=True)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "z"), (2, "b"), (3, "c")]
    (tmp_path / "t").rename(tmp_path / "t.old")  # a crash in the middle of a swap
    writers.append_new(df((4, "d")), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "z"), (2, "b"), (3, "c"), (4, "d")]
    assert not list(tmp_path.glob("*.old")) and not list(tmp_path.glob("*.new"))


def test_islands_of_a_stream_end_with_time(spark, tmp_path):
    from spikeloom.streaming import streams

    src, out, at = str(tmp_path / "in"), str(tmp_path / "out"), lambda s: 1_600_000_000 + s
    write = lambda *r: spark.createDataFrame([(k, at(t)) for k, t in r], "k long, s long").selectExpr("k", "timestamp_seconds(s) AS t").coalesce(1).write.mode("append").parquet(src)
    write((1, 0), (1, 2), (1, 3), (1, 20), (2, 5), (None, 1))
    run = lambda: streams.run_available(streams.islands(spark.readStream.schema("k long, t timestamp").parquet(src), "k", "t", 5_000_000), out, str(tmp_path / "cp"))
    run()
    write((3, 100))
    run()
    write((3, 200))
    run()
    got = sorted((r.key if r.key is not None else -1, (r.run_start // 1_000_000) - at(0), (r.run_end // 1_000_000) - at(0), r.n_rows) for r in spark.read.parquet(out).collect())
    assert got == [(-1, 1, 1, 1), (1, 0, 3, 3), (1, 20, 20, 1), (2, 5, 5, 1), (3, 100, 100, 1)]
