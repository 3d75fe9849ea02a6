from conftest import SF001
from stowage.operators import consumption as con
from stowage.operators import dims as dm
from stowage.operators import cost_center as cc
from stowage.operators import master as mst
from stowage.operators import stock as stk
from stowage.sources import fixtures as fx


def test_stock_first_bin_wins_and_sizing(spark):
    raw = spark.createDataFrame([
        (1, "m1", "N0-3", "25"), (2, "m1", "N2-1", "3"),      # first bin (shelf) wins; stock not summed
        (3, "m2", "N0-3", None),                            # null stock on a shelf -> M
        (4, "m3", "N2-4", "31"), (5, "m4", "N2-4", "30"),     # lift cutoff is strict
        (6, "m5", "N1-5", "1,000"), (7, "m6", "ZZ", "5"),   # rack -> L; unknown bin -> no size
        (8, None, "N2-1", "1"),
    ], "row_no long, material string, code string, total_stock_raw string")
    out = {r.material: r for r in stk.stock_sized(raw, fx.dim(spark, SF001, "dim_location_type"), fx.dim(spark, SF001, "dim_size")).collect()}
    assert set(out) == {"m1", "m2", "m3", "m4", "m5", "m6"}
    assert (out["m1"].size, out["m1"].total_stock, out["m1"].storage_type) == ("S", 25, "N0-3")
    assert out["m2"].size == "M" and out["m3"].size == "S" and out["m4"].size == "M"
    assert (out["m5"].size, out["m5"].size_id, out["m5"].total_stock) == ("L", 3, 1000)
    assert out["m6"].size is None and out["m6"].size_id is None
    assert stk.stock_rejects(stk.stock_sized(raw, fx.dim(spark, SF001, "dim_location_type"), fx.dim(spark, SF001, "dim_size"))).count() == 2


def test_master_substring_tokens(spark):
    raw = spark.createDataFrame([
        ("a", "PAINT", None, 100, 1), ("b", None, "m", 899, 2), ("c", "ZZ,", "H", 1, 3), ("d", "A; LC", None, 1, 4),
        ("e", " , ", None, 1, 5), ("a", "B", "H", 1, 9),
    ], "material string, std_desc string, priority string, mrp_controller long, row_no long")
    out = {r.material: r for r in mst.master_flags(raw, dm.token_map_or_default(fx.dim(spark, SF001, "dim_token_map").limit(0))).collect()}
    a = out["a"]   # first record only; PAINT contains A and P
    assert (a.ASSEMBLY, a.BODY, a.PAINT, a.UNK, a.priority) == (1, 0, 1, 0, None)
    b = out["b"]   # null description -> UNK; controller 899 -> movement L
    assert (b.UNK, b.movement, b.priority) == (1, "L", "m")
    assert out["c"].UNK == 1 and out["c"].ASSEMBLY == 0          # unmatched token -> UNK, empty token ignored
    assert (out["d"].ASSEMBLY, out["d"].UNK) == (1, 1)            # UNK may coexist here
    e = out["e"]   # only missing-like tokens -> no technology at all
    assert (e.ASSEMBLY, e.BODY, e.PAINT, e.UNK) == (0, 0, 0, 0)


def test_cost_center_and_consumption_tech(spark):
    raw_cc = spark.createDataFrame([("1001", "TX-200"), ("1001", "TX-300"), ("1002", "TX-100"), ("abc", "TX-400"),
                                    ("01003", "TX-400")], "cost_center string, department string")
    tech = cc.cost_center_tech(raw_cc)
    loaded = {r.cost_center: r for r in cc.cost_center_loaded(tech).collect()}
    assert set(loaded) == {1001, 1003}
    assert (loaded[1001].BODY, loaded[1001].PAINT, loaded[1001].ASSEMBLY) == (1, 1, 0)
    cons = spark.createDataFrame([
        ("m1", "1001", 1, "OR01"), ("m1", "9999", 2, "OR09"),   # concrete + miss -> UNK pruned
        ("m2", "1002", 3, "OR01"),                              # center filtered out -> miss -> UNK
        ("m3", " 1003 ", 4, "OR01"),
    ], "material string, cost_center string, order_no long, order_type string")
    out = {r.material: r for r in con.consumption_tech(cons, cc.cost_center_loaded(tech)).collect()}
    assert (out["m1"].BODY, out["m1"].PAINT, out["m1"].UNK) == (1, 1, 0)
    assert (out["m2"].UNK, out["m2"].BODY) == (1, 0)
    assert out["m3"].ASSEMBLY == 1 and out["m3"].UNK == 0


def test_consumption_priority_and_orders(spark):
    cons = spark.createDataFrame([("m1", 1, "OR09"), ("m1", 1, "OR09"), ("m1", 2, "OR01"), ("m2", None, "OR01"),
                                  (None, 5, "OR09")], "material string, order_no long, order_type string").selectExpr("*", "'1' AS cost_center")
    cons = con.consumption_lines(cons)
    st = {r.material: r for r in con.consumption_stats(cons).collect()}
    assert set(st) == {"m1", "m2"}
    assert (st["m1"].line_down_orders, st["m1"].orders) == (2, 2)
    assert (st["m2"].line_down_orders, st["m2"].orders) == (0, 0)
    pr = {r.material: r.priority for r in con.consumption_priority(con.consumption_stats(cons)).collect()}
    assert pr == {"m1": "H", "m2": "L"}
