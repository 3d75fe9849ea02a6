from pyspark.sql import functions as F

from stowage.functions import cleaning as fn


def _one(spark, expr, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(expr(F.col("v")).alias("o")).collect()]


def test_clean_int_strips_and_rounds_half_even(spark):
    out = _one(spark, fn.clean_int, ["1,034", "12 EA", "12-", "", None, "2.5", "3.5", "-7", "1.2.3"])
    assert out == [1034, 12, None, None, None, 2, 4, -7, None]


def test_clean_int_commas_and_integral(spark):
    df = spark.createDataFrame([("1,200",), ("3.5",), ("x",)], "v string")
    r = df.select(fn.clean_int_commas("v").alias("d"), fn.is_integral(fn.clean_int_commas("v")).alias("i")).collect()
    assert [(x.d, x.i) for x in r] == [(1200.0, True), (3.5, False), (None, True)]


def test_clean_float_and_ts(spark):
    assert _one(spark, lambda c: fn.clean_float(c), ["1,5", "2.25", "abc"]) == [15.0, 2.25, None]
    assert _one(spark, lambda c: fn.clean_float(c, strip_commas=False), ["1,5", "2.25"]) == [None, 2.25]
    ts = _one(spark, fn.clean_ts, ["2024-01-02 03:04:05", "nope"])
    assert ts[1] is None and ts[0].year == 2024


def test_tokens_and_missing_like(spark):
    df = spark.createDataFrame([("A; LC",), ("ZZ,",), ("B/P",)], "v string")
    toks = [r[0] for r in df.select(fn.split_tokens("v")).collect()]
    assert toks == [["A", "LC"], ["ZZ", ""], ["B", "P"]]
    assert _one(spark, lambda c: fn.is_missing_like(c), [None, " nan ", "<NA>", "", "A"]) == [True, True, True, True, False]
    assert _one(spark, fn.desc_or_unknown, [None, "0", "?", "x"]) == ["UNK", "UNK", "UNK", "x"]


def test_sanitize_and_priority(spark):
    assert _one(spark, fn.sanitize_name, ["  paint shop-2 ", "__", "a--b__"]) == ["PAINT_SHOP_2", None, "A_B"]
    assert _one(spark, fn.normalize_priority, ["h", "M", "X", None]) == ["H", "M", "L", "L"]


def test_category_key_and_dims(spark):
    df = spark.createDataFrame([("H", "M", None), (None, None, "S")], "p string, m string, s string")
    keys = [r[0] for r in df.select(fn.category_key("p", "m", "s")).collect()]
    assert keys == ["HM", "S"]
    df2 = spark.createDataFrame([("HM",)], "c string")
    r = df2.select(fn.category_dim("c", 1), fn.category_dim("c", 2), fn.category_dim("c", 3)).first()
    assert tuple(r) == ("H", "M", None)


def test_volume_and_per_user(spark):
    df = spark.createDataFrame([(0.05, 10.0, 0.02, 3.0, 2.0, 0.0), (0.05, None, 0.02, 3.0, None, 3.0)],
                               "mv double, st double, cf double, o double, ldo double, nu double")
    r = df.select(fn.sku_volume("mv", "st", "cf").alias("v"), fn.per_user("o", "nu").alias("p"),
                  fn.line_down_per_user("ldo", "nu").alias("l")).collect()
    assert r[0].v == 0.2 and r[0].p == 0.0 and r[0].l == 0.0
    assert r[1].v is None and r[1].p == 1.0 and r[1].l == 0.0


def test_display_percent(spark):
    assert _one(spark, fn.display_percent, [0.0, 0.004, 0.125, 0.135], "double") == [None, 0.01, 0.12, 0.14]


def test_minmax_radius(spark):
    df = spark.createDataFrame([(1.0, 1.0, 3.0), (3.0, 1.0, 3.0), (2.0, 2.0, 2.0)], "v double, a double, b double")
    assert [r[0] for r in df.select(fn.minmax_radius("v", "a", "b")).collect()] == [10.0, 30.0, 30.0]


def test_parse_variable(spark):
    df = spark.createDataFrame([("SKUuniquePct[HHS, CABINET , NORTH]",), ("objective value",)], "v string")
    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(fn.parse_variable("v"))]).collect()
    assert tuple(rows[0]) == ("SKUuniquePct", "HHS", "CABINET", "NORTH", None)
    assert tuple(rows[1]) == ("objective value", None, None, None, None)
