"""Two-segment fit against a brute-force hinge grid, and the curve rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.operators import curves as cur


def hinge_sse(x, y, b):
    h = np.maximum(x - b, 0.0)
    A = np.column_stack([np.ones_like(x), x, h])
    coef, *_ = np.linalg.lstsq(A, y, rcond=None)
    r = y - A @ coef
    return float(r @ r), float(coef[0] + coef[1] * b)


def fit_rows(spark, groups):
    rows = [(g, "T", f"m{g}{i:05d}", float(d)) for g, ds in groups.items() for i, d in enumerate(ds)]
    df = spark.createDataFrame(rows, "category string, tech string, material string, demand double")
    return {r.category: r for r in cur.curve_fit(df).collect()}


def test_fit_not_worse_than_dense_grid(spark):
    rng = np.random.default_rng(3)
    groups = {}
    for g in range(6):
        n = int(rng.integers(8, 60))
        groups[f"g{g}"] = np.sort(rng.choice([0, 1, 1, 2, 3, 5, 8, 13], size=n))[::-1]
    fits = fit_rows(spark, groups)
    for g, d in groups.items():
        y = np.cumsum(d).astype(float)
        x = np.arange(1, len(d) + 1, dtype=float)
        f = fits[g]
        if len(d) <= 2 or len(set(d)) <= 1:
            continue
        ours, _ = hinge_sse(x, y, f.fit_x)
        grid = min(hinge_sse(x, y, b)[0] for b in np.linspace(1, len(d), 4000))
        assert ours <= grid + 1e-6 * max(1.0, grid), (g, ours, grid)
        assert 1 <= f.fit_x <= len(d)
        _, yb = hinge_sse(x, y, f.fit_x)
        assert abs(yb - f.fit_y) <= 1e-6 * max(1.0, abs(yb))


def test_points_rules(spark):
    demand = spark.createDataFrame(
        [("A", "T", "a1", 5.0), ("A", "T", "a2", 5.0), ("A", "T", "a3", 5.0),     # one distinct value -> midpoint rule
         ("B", "T", "b1", 1.0), ("B", "T", "b2", 2.0),                            # n <= 2 -> midpoint rule
         ] + [("C", "T", f"c{i}", float(v)) for i, v in enumerate([9, 7, 5, 3, 2, 1, 1, 0, 0, 0])],
        "category string, tech string, material string, demand double")
    grid = spark.createDataFrame([("A", "T"), ("B", "T"), ("C", "T"), ("E", "T")], "category string, tech string")
    pts = {(r.category, r.break_idx): r for r in cur.curve_points(cur.curve_fit(demand), grid).collect()}
    assert (pts[("A", 1)].x, pts[("A", 1)].y, pts[("A", 2)].x, pts[("A", 2)].y) == (1.0, 7.5, 3.0, 15.0)
    assert (pts[("B", 1)].x, pts[("B", 1)].y) == (1.0, 1.5)
    assert all(pts[("E", i)].x == 0 and pts[("E", i)].y == 0 for i in range(3))   # empty group
    c0, c1, c2 = pts[("C", 0)], pts[("C", 1)], pts[("C", 2)]
    assert (c0.x, c0.y) == (0.0, 0.0) and c1.x <= c2.x and c1.y <= c2.y and c2.y == 28.0
    conc = {r.category: r.concave for r in cur.curve_concavity(cur.curve_points(cur.curve_fit(demand), grid)).collect()}
    assert conc == {"C": 1}


def test_json_round_trip(spark):
    pts = spark.createDataFrame([("HHS", "BODY", 0, 0.0, 0.0), ("HHS", "BODY", 1, 2.5, 7.0), ("HHS", "", 2, 9.0, 11.0)],
                                "category string, tech string, break_idx int, x double, y double")
    back = {(r.param, r.category, r.tech, r.break_idx): r.value
            for r in cur.curves_from_json(cur.curves_to_json(pts)).collect()}
    assert back[("breakpoints", "HHS", "BODY", 1)] == 2.5
    assert back[("pieceval", "HHS", "", 2)] == 11.0


def test_interpolate(spark):
    pts = spark.createDataFrame([("C", "T", "fitted", 0, 0.0, 0.0), ("C", "T", "fitted", 1, 2.0, 8.0),
                                 ("C", "T", "fitted", 2, 10.0, 12.0)],
                                "category string, tech string, rule string, break_idx int, x double, y double")
    at = spark.createDataFrame([("C", "T", 1.0), ("C", "T", 6.0), ("C", "T", 50.0)],
                               "category string, tech string, x_eval double")
    ys = sorted(r.y_eval for r in cur.interpolate(pts, at).collect())
    assert ys == [4.0, 10.0, 12.0]


def every_split(demand):
    """The best candidate per group from scoring every split."""
    blocks = cur.curve_blocks(demand)
    every = blocks.join(cur.fitted_groups(cur.group_stats(blocks)), ["category", "tech"]).withColumn(
        "t", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("cnt"))))
    best = cur.score_splits(every).groupBy("category", "tech").agg(F.min_by(F.struct("bp_x", "bp_y", "sse"), F.struct("sse", "bp_x")).alias("b"))
    return {r.category: tuple(r.b) for r in best.collect()}


@pytest.mark.parametrize("fanout", [2, 5, 256])
def test_bounded_search_is_that_of_every_split(spark, monkeypatch, fanout):
    rng = np.random.default_rng(11)
    groups = {"flat": [9] * 7 + [4] * 23 + [1] * 40 + [0] * 17, "steps": [5] * 50 + [0] * 300, "two": [3, 3, 1]}
    for g in range(4):
        groups[f"g{g}"] = sorted(rng.geometric(0.3 - 0.05 * g, size=120 + 40 * g) - 1, reverse=True)
    demand = spark.createDataFrame([(g, "T", f"{g}{i}", float(d)) for g, ds in groups.items() for i, d in enumerate(ds)],
                                   "category string, tech string, material string, demand double")
    monkeypatch.setattr(cur, "FANOUT", fanout)
    got = {r.category: (r.fit_x, r.fit_y, r.fit_sse) for r in cur.curve_fit(demand).collect()}
    assert got == every_split(demand)


def test_few_splits_are_scored(spark, monkeypatch):
    """Most blocks of a large group are excluded by their bound: far fewer splits are scored than there are parts."""
    rng = np.random.default_rng(5)
    ds = sorted((int(x) for x in rng.zipf(1.7, size=30_000) % 400), reverse=True)
    demand = spark.createDataFrame([("HOT", "T", f"m{i}", float(d)) for i, d in enumerate(ds)],
                                   "category string, tech string, material string, demand double").persist()
    scored = []
    whole = cur.score_splits

    def counted(points):
        scored.append(points.count())
        return whole(points)

    monkeypatch.setattr(cur, "score_splits", counted)
    f = cur.curve_fit(demand).first()
    monkeypatch.setattr(cur, "score_splits", whole)
    assert (f.fit_x, f.fit_y, f.fit_sse) == every_split(demand)["HOT"]
    assert sum(scored) < len(ds) / 10, scored
