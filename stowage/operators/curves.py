"""Cumulative demand curves and their two-segment fit.

A curve group is (category, technology) for the forward curves (demand =
per-user line-down orders of the parts using that technology) and the category
for the reserve curves (demand = orders).  Parts are ranked by demand desc and
y_k is the running demand total of the first k parts.

Scale: one group may hold a third of all parts, so nothing here sorts a group in
one task.  Ranks are compressed into *blocks* of equal demand (one row per
distinct demand value), and inside a block the curve is a straight line, so
every prefix sum the fit needs has a closed form in the block's row offset.  The
block table is small; ranges of splits inside blocks are bounded from below by the
errors of two free lines around them, and only ranges that can hold the best split
are cut further and scored; the best split per group is a ``min_by`` aggregate.

Fit (replaces a stochastic global search): exact continuous two-segment least
squares after Hudson (1966, JASA 61, "Fitting segmented curves whose join
points have to be estimated").  For each split k between parts k and k+1:
(a) fit the two sides separately; if the lines cross inside [k, k+1] that is a
candidate; (b) the joined fit with its hinge at data point k.  The smallest
error wins, ties to the smallest break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.session import materialize
from stowage.sources.fixtures import ALL_TECHS

# Share used when the fitted break reaches the total, and the
# concavity tolerance.
CAP_SHARE = 0.80
CONCAVE_TOL = 1e-9
# Ranges that a range of splits is cut into in a round, and the rounding slack of an error bound in shares of the sum of
# squares.
FANOUT = 256
BOUND_SLACK = 1e-12


def forward_demand(enriched: DataFrame, techs: list[str] = ALL_TECHS) -> DataFrame:
    """(category, tech, material, demand) for every part using a technology."""
    long = enriched.unpivot(["category", "material", "ld_orders_per_user"], list(techs), "tech", "flag")
    return long.filter(F.col("flag") == 1).select("category", "tech", "material",
                                                  F.col("ld_orders_per_user").alias("demand"))


def reserve_demand(enriched: DataFrame) -> DataFrame:
    """(category, tech='', material, demand=orders) over every part of a category."""
    return enriched.select("category", F.lit("").alias("tech"), "material", F.col("orders").alias("demand"))


def curve_blocks(demand: DataFrame) -> DataFrame:
    """W2 in block form: per group and distinct demand value (desc), the rank range and running totals.

    Columns: category, tech, demand, cnt, rank_start, rank_end, cum_start, cum_end
    plus the running sums over earlier blocks that the fit needs (s_y, s_xy, s_yy).
    Row k of the curve is recovered inside its block as cum_start + demand * (k - rank_start + 1).
    """
    hist = demand.groupBy("category", "tech", "demand").agg(F.count(F.lit(1)).alias("cnt"))
    g = ["category", "tech"]
    before = Window.partitionBy(*g).orderBy(F.desc("demand")).rowsBetween(Window.unboundedPreceding, -1)
    d, m = F.col("demand"), F.col("cnt").cast("double")
    r0, c0 = F.col("r0"), F.col("c0")
    h = (hist.withColumn("r0", F.coalesce(F.sum("cnt").over(before), F.lit(0)).cast("double"))
         .withColumn("c0", F.coalesce(F.sum(d * F.col("cnt")).over(before), F.lit(0.0))))
    # full-block contributions to sum y, sum x*y, sum y^2 (closed forms with t = cnt)
    h = h.withColumn("b_y", _sum_y(r0, c0, d, m)).withColumn("b_xy", _sum_xy(r0, c0, d, m)) \
        .withColumn("b_yy", _sum_yy(r0, c0, d, m))
    h = (h.withColumn("s_y", F.coalesce(F.sum("b_y").over(before), F.lit(0.0)))
         .withColumn("s_xy", F.coalesce(F.sum("b_xy").over(before), F.lit(0.0)))
         .withColumn("s_yy", F.coalesce(F.sum("b_yy").over(before), F.lit(0.0))))
    return h.select("category", "tech", "demand", F.col("cnt").cast("bigint").alias("cnt"),
                    (r0 + 1).cast("bigint").alias("rank_start"), (r0 + m).cast("bigint").alias("rank_end"),
                    (c0 + d).alias("cum_start"), (c0 + d * m).alias("cum_end"),
                    "r0", "c0", "s_y", "s_xy", "s_yy")


# Closed-form partial sums over rows 1..t of a block (r0 rows and c0 demand before it, demand d each),
# as SQL text with the same operation order as the column helpers below.
_SUM_Y = "{t} * c0 + demand * {t} * ({t} + 1) / 2"
_SUM_XY = ("r0 * c0 * {t} + (r0 * demand + c0) * {t} * ({t} + 1) / 2"
           " + demand * {t} * ({t} + 1) * (2 * {t} + 1) / 6")
_SUM_YY = "{t} * c0 * c0 + c0 * demand * {t} * ({t} + 1) + demand * demand * {t} * ({t} + 1) * (2 * {t} + 1) / 6"


def _sum_y(r0, c0, d, t):
    return t * c0 + d * t * (t + 1) / 2


def _sum_xy(r0, c0, d, t):
    return r0 * c0 * t + (r0 * d + c0) * t * (t + 1) / 2 + d * t * (t + 1) * (2 * t + 1) / 6


def _sum_yy(r0, c0, d, t):
    return t * c0 * c0 + c0 * d * t * (t + 1) + d * d * t * (t + 1) * (2 * t + 1) / 6


def group_stats(blocks: DataFrame) -> DataFrame:
    """Per group n, total, distinct demand values and the full sums."""
    return blocks.groupBy("category", "tech").agg(
        F.sum("cnt").cast("bigint").alias("n"),
        F.max("cum_end").alias("total"),
        F.count(F.lit(1)).cast("bigint").alias("n_distinct"),
        F.max(F.col("s_y") + _sum_y(F.col("r0"), F.col("c0"), F.col("demand"), F.col("cnt").cast("double")))
        .alias("t_y"),
        F.max(F.col("s_xy") + _sum_xy(F.col("r0"), F.col("c0"), F.col("demand"), F.col("cnt").cast("double")))
        .alias("t_xy"),
        F.max(F.col("s_yy") + _sum_yy(F.col("r0"), F.col("c0"), F.col("demand"), F.col("cnt").cast("double")))
        .alias("t_yy"))


def fitted_groups(stats: DataFrame) -> DataFrame:
    """Groups with something to fit: more than two parts and more than one demand value."""
    return stats.filter((F.col("n") > 2) & (F.col("n_distinct") > 1))


def _sums_at(t: str, p: str) -> list[str]:
    """Prefix sums over ranks 1..k at offset ``t`` of a block (closed forms inside it), named ``<p>k``, ``<p>x1``, ..."""
    t = f"CAST({t} AS DOUBLE)"
    k = f"(r0 + {t})"
    return [f"{k} AS {p}k", f"{k} * ({k} + 1) / 2 AS {p}x1", f"{k} * ({k} + 1) * (2 * {k} + 1) / 6 AS {p}x2",
            f"s_y + ({_SUM_Y.format(t=t)}) AS {p}y", f"s_xy + ({_SUM_XY.format(t=t)}) AS {p}xy",
            f"s_yy + ({_SUM_YY.format(t=t)}) AS {p}yy"]


#: The same sums over all ranks of the group.
_N = "CAST(n AS DOUBLE)"
_TOTALS = [f"{_N} AS N", f"{_N} * ({_N} + 1) / 2 AS tx1", f"{_N} * ({_N} + 1) * (2 * {_N} + 1) / 6 AS tx2",
           "t_y AS ty", "t_xy AS txy", "t_yy AS tyy"]


def score_splits(points: DataFrame) -> DataFrame:
    """Both candidates of every split: rows of a block (with its group's totals) and an offset ``t`` in it.

    Computed as a chain of small projections (prefix sums, then centred moments,
    then fits) so each generated expression stays small.
    """
    # Spark SQL expression text: one JVM call per projection instead of one per operator.
    p = points.selectExpr("category", "tech", *_sums_at("t", "p"), *_TOTALS).withColumnRenamed("pk", "K").where("K < N")
    # right-side sums
    p = p.selectExpr("*", "N - K AS mR", "tx1 - px1 AS rx1", "tx2 - px2 AS rx2", "ty - py AS ry",
                     "txy - pxy AS rxy", "tyy - pyy AS ryy")
    # centred moments: left, right, and the hinge regressor h = (x - k)+ over all points
    p = p.selectExpr(
        "category", "tech", "K", "N", "mR", "px1", "py", "rx1", "ry", "tx1", "ty", "tx2", "txy", "tyy",
        "K * px2 - px1 * px1 AS lxx", "K * pxy - px1 * py AS lxy", "K * pyy - py * py AS lyy",
        "mR * rx2 - rx1 * rx1 AS rxx", "mR * rxy - rx1 * ry AS rxy_", "mR * ryy - ry * ry AS ryy_",
        "rx1 - mR * K AS sh", "rx2 - 2 * K * rx1 + mR * K * K AS shh", "rx2 - K * rx1 AS sxh",
        "rxy - K * ry AS syh")
    p = p.selectExpr("*", "N * tx2 - tx1 * tx1 AS cxx", "N * sxh - tx1 * sh AS cxh", "N * shh - sh * sh AS chh",
                     "N * txy - tx1 * ty AS cxy", "N * syh - sh * ty AS chy", "N * tyy - ty * ty AS cyy")
    # fits: two free lines, and the joined (hinge) fit
    p = p.selectExpr("*", "try_divide(lxy, lxx) AS sL", "try_divide(rxy_, rxx) AS sR",
                     "try_divide(lyy - try_divide(lxy * lxy, lxx), K) AS eL",
                     "try_divide(ryy_ - try_divide(rxy_ * rxy_, rxx), mR) AS eR",
                     "cxx * chh - cxh * cxh AS det")
    p = p.selectExpr("*", "try_divide(py - sL * px1, K) AS iL", "try_divide(ry - sR * rx1, mR) AS iR",
                     "try_divide(chh * cxy - cxh * chy, det) AS beta", "try_divide(cxx * chy - cxh * cxy, det) AS gamma")
    p = p.selectExpr("*", "try_divide(iR - iL, sL - sR) AS cross", "(ty - beta * tx1 - gamma * sh) / N AS alpha")
    cand = p.selectExpr("category", "tech", """explode(array(
        named_struct('ok', K >= 2 AND mR >= 2 AND sL != sR AND cross >= K AND cross <= K + 1,
                     'sse', greatest(eL + eR, 0.0), 'bp_x', cross, 'bp_y', iL + sL * cross, 'kind', 0),
        named_struct('ok', K >= 2 AND det != 0,
                     'sse', greatest((cyy - beta * cxy - gamma * chy) / N, 0.0), 'bp_x', K,
                     'bp_y', alpha + beta * K, 'kind', 1))) AS c""")
    return cand.selectExpr("category", "tech", "c.*").where("coalesce(ok, false)")


def least_errors(ranges: DataFrame) -> DataFrame:
    """A bound that no split in a range of offsets ``lo`` .. ``hi`` of a block can beat, as ``least``, with a rounding slack.

    With the break anywhere between ranks k(lo) and k(hi) + 1, the points up to k(lo) lie on one line and those after
    k(hi) on another, whatever the points between them do.  So the error is at least that of two free lines through
    these two sets, which follows from the sums at both ends of the range.
    """
    p = ranges.selectExpr("*", *_sums_at("lo", "a"), *_sums_at("hi", "b"), *[t for t in _TOTALS if not t.endswith(" AS N")])
    p = p.selectExpr("*", f"{_N} - bk AS m", "tx1 - bx1 AS rx1", "tx2 - bx2 AS rx2", "ty - by AS ry", "txy - bxy AS rxy",
                     "tyy - byy AS ryy")
    p = p.selectExpr("*", "try_divide(ak * ayy - ay * ay - try_divide(pow(ak * axy - ax1 * ay, 2), ak * ax2 - ax1 * ax1), ak) AS eL",
                     "try_divide(m * ryy - ry * ry - try_divide(pow(m * rxy - rx1 * ry, 2), m * rx2 - rx1 * rx1), m) AS eR")
    least = f"greatest(coalesce(eL, 0.0), 0.0) + greatest(coalesce(eR, 0.0), 0.0) - {BOUND_SLACK} * t_yy"
    return p.selectExpr(*ranges.columns, f"{least} AS least")


def best_splits(blocks: DataFrame, stats: DataFrame) -> DataFrame:
    """The best candidate of every fitted group, scoring only splits that can be it.

    Every block starts as one range of splits.  A round scores both ends of every range, which gives each group the
    least error so far; a range whose :func:`least_errors` lie above it can't hold the best split and goes, the
    others are cut into at most FANOUT ranges.  The rounds end when no range that is left has a split
    inside, after about log(block size) / log(FANOUT) of them.  The result is that of scoring every split.
    """
    g = ["category", "tech"]
    ranges = blocks.join(fitted_groups(stats), g).withColumn("lo", F.lit(1).cast("bigint")).withColumn("hi", F.col("cnt"))
    best = None
    while True:
        ends = ranges.withColumn("t", F.explode(F.array_distinct(F.array("lo", "hi"))))
        found = score_splits(ends).drop("ok")
        best = found if best is None else best.unionByName(found)
        best = materialize(best.groupBy(*g).agg(F.min_by(F.struct("sse", "bp_x", "bp_y", "kind"), F.struct("sse", "bp_x")).alias("b"))
                           .select(*g, "b.*"), "curve_best")
        kept = (least_errors(ranges.filter("hi - lo > 1")).join(best.select(*g, "sse"), g, "left")
                .filter("sse IS NULL OR least <= sse"))
        step = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") - 1) / FANOUT)).cast("bigint")
        cut = kept.withColumn("step", step).withColumn("from", F.explode(F.sequence(F.col("lo") + 1, F.col("hi") - 1, "step")))
        ranges = materialize(cut.withColumn("hi", F.least(F.col("from") + F.col("step") - 1, F.col("hi") - 1)).withColumn(
            "lo", F.col("from")).select(*ranges.columns), "curve_ranges")
        if ranges.isEmpty():
            return best


def curve_fit(demand: DataFrame) -> DataFrame:
    """D12 + A18: per group n, total, distinct values, and the best break (before the cap rule)."""
    blocks = materialize(curve_blocks(demand), "curve_blocks")  # read twice: totals, splits
    stats = materialize(group_stats(blocks), "curve_stats", True)
    best = best_splits(blocks, stats)
    return stats.join(best, ["category", "tech"], "left").select(
        "category", "tech", "n", "total", "n_distinct",
        F.col("bp_x").alias("fit_x"), F.col("bp_y").alias("fit_y"), F.col("sse").alias("fit_sse"))


def curve_points(fit: DataFrame, grid: DataFrame) -> DataFrame:
    """Three points per group of the grid; empty groups give zeros, small/flat ones the midpoint rule,
    fitted ones the break, with y capped at 80% of the total when the fit reaches it."""
    j = grid.join(fit, ["category", "tech"], "left")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    total = F.coalesce(F.col("total"), F.lit(0.0))
    degenerate = (n <= 2) | (F.coalesce(F.col("n_distinct"), F.lit(0)) <= 1)
    x1 = F.when(degenerate, F.floor(n / 2).cast("double")).otherwise(F.col("fit_x"))
    y1 = F.when(degenerate, total * 0.5).otherwise(
        F.when(F.col("fit_y") >= total, total * CAP_SHARE).otherwise(F.col("fit_y")))
    pts = F.array(
        F.struct(F.lit(0).alias("break_idx"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        F.struct(F.lit(1).alias("break_idx"), x1.alias("x"), y1.alias("y")),
        F.struct(F.lit(2).alias("break_idx"), n.alias("x"), total.alias("y")))
    return j.select("category", "tech", F.when(degenerate, "degenerate").otherwise("fitted").alias("rule"),
                    F.explode(pts).alias("p")).select("category", "tech", "rule", "p.*")


def curve_wide(points: DataFrame) -> DataFrame:
    g = points.groupBy("category", "tech", "rule").agg(
        *[F.max(F.when(F.col("break_idx") == i, F.col(c))).alias(f"{c}{i}") for i in (1, 2) for c in ("x", "y")])
    return g


def curve_concavity(points: DataFrame) -> DataFrame:
    """Slopes of the two segments; concave when the second is not steeper (fitted groups only)."""
    w = curve_wide(points).filter(F.col("rule") == "fitted")
    s1 = F.try_divide(F.col("y1"), F.col("x1"))
    s2 = F.try_divide(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    return w.select("category", "tech", s1.alias("slope1"), s2.alias("slope2"),
                    F.when(s2 <= s1 + CONCAVE_TOL, 1).otherwise(0).alias("concave"))


def interpolate(points: DataFrame, at: DataFrame, x_col: str = "x_eval") -> DataFrame:
    """Value of each 3-point curve at ``at[x_col]`` (clamped to the curve's range)."""
    w = curve_wide(points)
    j = at.join(w, ["category", "tech"], "left")  # a group without a curve has no reach: y is 0
    x = F.greatest(F.lit(0.0), F.least(F.col(x_col), F.col("x2")))
    seg1 = F.when(F.col("x1") > 0, F.col("y1") * x / F.col("x1")).otherwise(F.col("y1"))
    seg2 = F.when(F.col("x2") > F.col("x1"),
                  F.col("y1") + (F.col("y2") - F.col("y1")) * (x - F.col("x1")) / (F.col("x2") - F.col("x1"))) \
        .otherwise(F.col("y2"))
    y = F.when(x <= F.col("x1"), seg1).otherwise(seg2)
    return j.select(*at.columns, F.coalesce(y, F.lit(0.0)).alias("y_eval"))


def curves_to_json(points: DataFrame) -> DataFrame:
    """S10 export: one JSON object per group, keys are tuple text "('cat', 'tech', i)"."""
    key = F.when(F.col("tech") == "", F.format_string("('%s', %d)", "category", "break_idx")) \
        .otherwise(F.format_string("('%s', '%s', %d)", "category", "tech", "break_idx"))
    g = points.groupBy("category", "tech").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(key, F.col("x"))))).alias("breakpoints"),
        F.to_json(F.map_from_entries(F.collect_list(F.struct(key, F.col("y"))))).alias("pieceval"))
    return g


def curves_from_json(js: DataFrame) -> DataFrame:
    """S10 import: parse the tuple-keyed JSON back into long rows without evaluating any text."""
    out = None
    for param in ("breakpoints", "pieceval"):
        e = js.select(F.lit(param).alias("param"),
                      F.explode(F.from_json(param, "map<string,double>")).alias("key", "value"))
        out = e if out is None else out.unionByName(e)
    parts = F.regexp_extract_all(F.col("key"), F.lit(r"'([^']*)'|(-?\d+)"), 0)
    txt = F.transform(parts, lambda p: F.regexp_replace(p, "'", ""))
    n = F.size(txt)
    return out.select(
        "param", F.get(txt, 0).alias("category"),
        F.when(n == 3, F.get(txt, 1)).otherwise(F.lit("")).alias("tech"),
        F.get(txt, n - 1).cast("int").alias("break_idx"), "value")
