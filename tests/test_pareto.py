"""Pareto movement against a brute-force sorted running sum (ties by material)."""

import random

import pandas as pd

from stowage.operators import consumption as con


def brute(orders: dict[str, int]) -> dict[str, str]:
    df = pd.DataFrame(sorted(orders.items(), key=lambda kv: (-kv[1], kv[0])), columns=["m", "o"])
    total = int(df.o.sum())
    cum = df.o.cumsum()
    share = cum / total if total else cum * 0.0
    return dict(zip(df.m, ["H" if s <= 0.80 else "M" for s in share]))


def run(spark, orders: dict[str, int], parts: int = 4):
    stats = spark.createDataFrame([(m, 0, o) for m, o in orders.items()],
                                  "material string, line_down_orders long, orders long")
    out = con.consumption_movement(stats, range_parts=parts)
    return {r.material: r.movement for r in out.collect()}


def test_pareto_random_with_big_tie_blocks(spark):
    rng = random.Random(7)
    for trial in range(4):
        orders = {}
        for i in range(400):
            # a few heavy hitters, then large blocks of equal counts (straddle inside a tie block)
            orders[f"m{rng.randrange(10**6):06d}"] = rng.choice([1, 1, 1, 2, 2, 3, 5, 40, 41])
        want = brute(orders)
        assert run(spark, orders) == want, trial


def test_pareto_all_equal_and_zero(spark):
    eq = {f"m{i:03d}": 3 for i in range(50)}
    assert run(spark, eq, parts=3) == brute(eq)
    zero = {f"z{i}": 0 for i in range(5)}
    assert set(run(spark, zero).values()) == {"H"}


def test_pareto_tie_block_over_many_ranges(spark):
    """One block of equal counts straddles the cut, and each search round cuts it into many ranges."""
    orders = {f"k{i:05d}": 2 for i in range(5000)} | {f"a{i}": 100 for i in range(20)}
    assert run(spark, orders, parts=16) == brute(orders)
