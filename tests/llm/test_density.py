import math
import random

from spikeloom.llm.density import grid_clusters

DIMS, BINS = {"x": (0.0, 1.0), "y": (0.0, 1.0)}, {"x": 20, "y": 20}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double, key string, n string, label string, c0 string, density string")


def run(spark, rows, **kw):
    members, cells = grid_clusters(frame(spark, [(*r, "k", "n", "l", "c", "d") for r in rows]), "id", DIMS, BINS, **kw)
    return {r.key: r.cluster_key for r in members.collect()}, cells


def blob(rng, ids, cx, cy, s):
    return [(i, min(0.999, max(0, rng.gauss(cx, s))), min(0.999, max(0, rng.gauss(cy, s)))) for i in ids]


def test_blobs_strays_and_dirt(spark):
    rng = random.Random(1)
    rows = blob(rng, range(100, 400), 0.2, 0.2, 0.03) + blob(rng, range(500, 800), 0.8, 0.7, 0.03)
    rows += [(1, 0.5, 0.95), (2, 0.95, 0.05)]  # strays
    rows += rows[:40]  # repeated rows
    rows += [(3, None, 0.2), (4, float("nan"), 0.2), (5, -0.2, 0.2), (6, 1.4, 0.2), (None, 0.2, 0.2)]
    got, _ = run(spark, rows, dense_share=0.006)
    first = {got[i] for i in range(100, 400) if i in got}
    second = {got[i] for i in range(500, 800) if i in got}
    assert first == {100} and second == {500}
    assert not {1, 2, 3, 4, 5, 6, None} & set(got)
    assert len(got) > 590


def test_a_long_snake_is_one_cluster(spark):
    rows = [(i, 0.025 + 0.05 * (i % 20), 0.5) for i in range(400)] + [(1000 + i, 0.025, 0.025 + 0.05 * (i % 20)) for i in range(400)]
    got, _ = run(spark, rows, dense_share=0.004)
    assert set(got.values()) == {0} and len(got) == 800


def test_against_a_flood(spark):
    rng = random.Random(7)
    rows = [(i, rng.random(), rng.random() ** 2) for i in range(600)]
    got, _ = run(spark, rows, dense_share=0.004, min_share=0.0)
    cell = {i: (min(19, int(x * 20)), min(19, int(y * 20))) for i, x, y in rows}
    n = {}
    for c in cell.values():
        n[c] = n.get(c, 0) + 1
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    dens = {}
    for (x, y), k in n.items():
        for a, b in around:
            dens[x + a, y + b] = dens.get((x + a, y + b), 0) + k * 0.5 ** (abs(a) + abs(b))
    dense = {c for c, v in dens.items() if v / 4 / 600 >= 0.004}
    label = {}
    for c in sorted(dense):
        stack = [c] if c not in label else []
        while stack:
            p = stack.pop()
            if p not in label:
                label[p] = c
                stack += [q for a, b in around if (q := (p[0] + a, p[1] + b)) in dense]
    for ring in range(2):
        new = {}
        for c in set(cell.values()) - set(label):
            near = [(dens[q], -((q[0] + 1) * 22 + q[1] + 1), q) for a, b in around if (q := (c[0] + a, c[1] + b)) in label and (ring == 0 or q in n)]
            if near:
                new[c] = label[max(near)[2]]
        label.update(new)
    want = {i: label[c] for i, c in cell.items() if c in label}
    first = {}
    for i, l in want.items():
        first[l] = min(first.get(l, math.inf), i)
    assert got == {i: first[l] for i, l in want.items()}


def test_four_dimensions_and_the_sum_of_densities(spark):
    rng = random.Random(3)
    dims = {c: (0.0, 1.0) for c in "abcd"}
    centre = lambda: rng.choice([(0.25, 0.25, 0.3, 0.3), (0.7, 0.75, 0.7, 0.8)])
    rows = [(i, *[min(0.99, max(0.01, rng.gauss(m, 0.05))) for m in centre()]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    members, cells = grid_clusters(df, "id", dims, {c: 8 for c in "abcd"}, dense_share=0.0, min_share=0.0)
    assert abs(sum(r.density for r in cells.collect()) - 1) < 1e-9
    got = {r.key: r.cluster_key for r in grid_clusters(df, "id", dims, {c: 8 for c in "abcd"}, dense_share=0.004)[0].collect()}
    side = {i: a > 0.5 for i, a, *_ in rows}
    assert len(set(got.values())) == 2 and all(side[i] == side[k] for i, k in got.items()) and len(got) > 560


def test_empty_and_one(spark):
    assert run(spark, [])[0] == {}
    assert run(spark, [(9, 0.5, 0.5)])[0] == {9: 9}
