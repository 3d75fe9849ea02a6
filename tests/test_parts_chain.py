from stowage.operators import parts as prt

COLS = ("material string, priority string, movement string, size string, orders double, line_down_orders double, "
        "total_stock double, num_users double, ASSEMBLY int, BODY int, PAINT int, UNK int, size_id int, "
        "storage_type string")


def base(spark, rows):
    return spark.createDataFrame(rows, COLS)


def row(m, pr=None, mv=None, a=0, b=0, p=0, u=0):
    return (m, pr, mv, "S", None, None, 5.0, None, a, b, p, u, 1, "C1")


def test_master_overwrites_matches_only(spark):
    parts = base(spark, [row("m1", "H"), row("m2", "H")])
    master = spark.createDataFrame([("m1", None, "L", 1, 0, 0, 1), ("zz", "H", None, 0, 0, 0, 0)],
                                   "material string, priority string, movement string, ASSEMBLY int, BODY int, PAINT int, UNK int")
    out = {r.material: r for r in prt.parts_with_master(parts, master).collect()}
    assert (out["m1"].priority, out["m1"].movement, out["m1"].ASSEMBLY, out["m1"].UNK) == (None, "L", 1, 1)
    assert out["m2"].priority == "H" and "zz" not in out


def test_priority_movement_tech_and_normalize(spark):
    parts = base(spark, [row("m1"), row("m2", "x", "L", u=1), row("m3", a=1, u=1)])
    prio = spark.createDataFrame([("m1", "H", 3), ("m2", "H", 2)], "material string, priority string, line_down_orders long")
    p4 = {r.material: r for r in prt.parts_with_priority(parts, prio).collect()}
    assert (p4["m1"].priority, p4["m1"].line_down_orders) == ("H", 3.0)
    assert (p4["m2"].priority, p4["m2"].line_down_orders) == ("x", 2.0)   # only null priorities are filled
    assert (p4["m3"].priority, p4["m3"].line_down_orders) == ("L", 0.0)
    mov = spark.createDataFrame([("m1", "H", 7), ("m2", "M", 9)], "material string, movement string, orders long")
    p5 = {r.material: r for r in prt.parts_with_movement(prt.parts_with_priority(parts, prio), mov).collect()}
    assert (p5["m1"].movement, p5["m1"].orders) == ("H", 7.0)
    assert (p5["m2"].movement, p5["m2"].orders) == ("L", 0.0)             # movement already set: no orders
    assert (p5["m3"].movement, p5["m3"].orders) == ("L", 0.0)
    tech = spark.createDataFrame([("m2", 0, 1, 0, 0), ("m1", 0, 0, 0, 1)],
                                 "material string, ASSEMBLY int, BODY int, PAINT int, UNK int")
    p6 = {r.material: r for r in prt.parts_with_tech(parts, tech).collect()}
    assert (p6["m2"].BODY, p6["m2"].UNK, p6["m2"].num_users) == (1, 0, 1.0)
    assert (p6["m1"].UNK, p6["m1"].num_users) == (0, 0.0)                 # incoming UNK is not written
    assert (p6["m3"].ASSEMBLY, p6["m3"].UNK, p6["m3"].num_users) == (1, 0, 1.0)
    p8 = {r.material: r for r in prt.parts_normalized(prt.parts_with_tech(parts, tech)).collect()}
    assert (p8["m1"].UNK, p8["m1"].num_users, p8["m1"].priority) == (1, 0.0, "L")
    assert p8["m2"].priority == "L"
