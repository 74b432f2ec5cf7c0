import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeloom.operators import directions, imaging, pathways


def flood(mask):
    out, k = np.zeros(mask.shape, int), 0
    for s in map(tuple, np.argwhere(mask)):
        if not out[s]:
            k += 1
            stack = [s]
            while stack:
                r, c = stack.pop()
                if 0 <= r < mask.shape[0] and 0 <= c < mask.shape[1] and mask[r, c] and not out[r, c]:
                    out[r, c] = k
                    stack += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    return out


def test_connected_parts_against_a_flood():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.7, 1.0, 0.0):
        m = rng.random((14, 17)) < share
        assert np.array_equal(imaging.components_2d(m), flood(m))
    spot = np.zeros((6, 6), bool)
    spot[0, 0] = spot[3, 2:5] = True
    assert imaging.without_specks(spot).sum() == 3


def test_field_soma_and_segment(spark):
    y, x = np.mgrid[:21, :21]
    blob = np.exp(-((x - 12) ** 2 + (y - 8) ** 2) / 8.0)
    cube = np.sin(np.linspace(0, 6, 60))[:, None, None] * blob * 10
    got = imaging.field_size(cube)
    assert (got["center_row"], got["center_col"]) == (8, 12) and got["area"] == np.sum(blob >= 0.5)
    assert imaging.swing_center(cube) == (8, 12) and imaging.soma_of(cube) == (8, 12)
    t, r, c = imaging.refined_soma(cube, (6, 11))
    assert (r, c) == (8, 12) and cube[t, r, c] == cube.min()
    assert imaging.signal_quality(cube, (8, 12))[1]
    assert imaging.prepared_sta(cube).shape == (60, 25, 25)
    ax = cube.copy()
    ax[t - 3, 8, 15] = 0.8 * cube.min()
    assert imaging.initial_segment(ax, (t, 8, 12)) == (t - 3, 8, 15)
    assert imaging.lanes_filled(cube, [3, 99])[5, 5, 3] == pytest.approx(cube.mean())
    assert len(imaging.small_cubes(np.zeros((6, 7, 5)))[0]) == 2 * 3 and len(imaging.small_cubes(np.zeros((3, 9, 9)))[0]) == 0
    assert imaging.centroid_path(np.array([[0, 0], [1, 0], [9, 9], [2, 0.0]]), 2).tolist() == [True, True, False, True]
    df = spark.createDataFrame([(1, cube.ravel().tolist(), [60, 21, 21]), (2, [1.0], [9, 9, 9]), (3, None, None)], "u int, d array<double>, s array<int>")
    f = imaging.cube_udf(imaging.field_size, ["center_row", "area"])(F.col("d"), F.col("s"))
    rows = {r.u: r.f for r in df.select("u", f.alias("f")).collect()}
    assert rows[1].center_row == 8 and all(rows[i].area is None or math.isnan(rows[i].area) for i in (2, 3))


def test_on_off_detection():
    seg = np.array([0, 1, 200, 210, 20, 10, 0.0])
    assert imaging.onset_candidates(seg).tolist() == [3] and imaging.first_off(seg, 3, 210.0) == 4
    assert imaging.onset_candidates(np.array([-3.0, -1.0])).tolist() == [1]
    assert imaging.area_mean(np.ones((2, 5, 5)), 0, 4, 3).tolist() == [1, 1]


def test_sections_and_selectivity(spark):
    centres = spark.createDataFrame([(1, 5, 6, 100), (2, 9, 9, 100)], "unit int, row int, col int, movie_start int")
    timing = spark.createDataFrame([(5, 6, list(range(0, 2400, 100)), list(range(20, 2420, 100)))], "row int, col int, on array<int>, off array<int>")
    spans = directions.direction_spans(centres, timing, "movie_start")
    assert spans.count() == 24 and {r.unit for r in spans.collect()} == {1}
    s = spark.createDataFrame([(1, f) for f in (89, 90, 130, 131, 290, 905)] + [(2, 100)], "unit int, frame long")
    got = sorted((r.frame, r.direction, r.rep, r.movie_frame) for r in directions.section_by_direction(s, spans, ["unit"], "frame", "movie_start").collect())
    assert got == [(90, 0, 0, -10), (130, 0, 0, 30), (290, 2, 0, 190), (905, 0, 1, 805)]
    sharp = [[r + 1.0, r, r - 1.0] for r in (30.0, 24.0, 9.0, 2.0, 1.0, 2.0, 9.0, 24.0)]
    df = spark.createDataFrame([(1, sharp), (2, [[1.0] * 3] * 8), (3, None), (4, [[1.0]])], "k int, m array<array<double>>")
    a, b = ({r.k: r.f for r in df.select("k", directions.selectivity_struct(F.col("m"), F.col("k")).alias("f")).collect()} for _ in range(2))
    assert a[1] == b[1] and a[1].ds_p < 0.01 and a[1].dsi > 0.9 and (a[1].preferred < 1 or a[1].preferred > 359)
    assert a[2].ds_p == 1 and a[2].dsi == pytest.approx(0, abs=1e-9)
    assert a[3].dsi is None or math.isnan(a[3].dsi)
    d = directions.duration_stats(spans, ["direction"], "from_frame", "to_frame").first()
    assert (d.shortest, d.longest, d.sd, d.n_negative) == (40, 40, 0, 0)


def test_optic_nerve_head():
    rng = np.random.default_rng(1)
    starts = rng.uniform(5, 60, (12, 2))
    goal = np.array([50.0, 20.0])
    ang = np.degrees(np.arctan2(*(goal - starts).T[::-1]))
    assert pathways.best_head(starts, ang) == pytest.approx(tuple(goal))
    far = np.degrees(np.arctan2(*(np.array([400.0, 33.0]) - starts).T[::-1]))
    p = pathways.best_head(starts, far)
    assert np.hypot(p[0] - 33, p[1] - 33) == pytest.approx(98, abs=1e-6)
    bad = ang.copy()
    bad[0] += 70
    at, use = pathways.refined_head(starts, bad)
    assert not use[0] and at == pytest.approx(tuple(goal), abs=1e-6)
    assert pathways.best_head(starts[:1], ang[:1]) is None and pathways.best_head(starts, np.zeros(12)) is None
