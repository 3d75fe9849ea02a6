import pytest
from pyspark.sql import functions as F

from conftest import SF001
from stowage.functions import contracts as ct
from stowage.operators import dims as dm
from stowage.plans import params as pm
from stowage.sources import files, fixtures as fx


def test_fk_filter_drops_unknown_location(spark):
    rel = fx.dim(spark, SF001, "dim_tech_location")
    out = dm.fk_filter(rel, [(fx.dim(spark, SF001, "dim_tech"), ["tech_id"]), (fx.dim(spark, SF001, "dim_location"), ["location_id"])])
    assert out.count() == rel.count() - 1 and out.filter(F.col("location_id") > 25).count() == 0
    lt = dm.fk_filter(fx.dim(spark, SF001, "dim_location_type"), [(fx.dim(spark, SF001, "dim_location"), ["location_id"]),
                                                           (fx.dim(spark, SF001, "dim_type"), ["type_id"])])
    assert lt.filter(F.col("code") == "LOST").count() == 0


def test_upsert_delete_replace_group(spark):
    t = spark.createDataFrame([("A", "ASSEMBLY"), ("B", "BODY")], "value string, tech_name string")
    ch = spark.createDataFrame([("B", "PAINT"), ("Q", "UNK")], "value string, tech_name string")
    assert sorted(map(tuple, dm.upsert(t, ch, ["value"]).collect())) == [("A", "ASSEMBLY"), ("B", "PAINT"), ("Q", "UNK")]
    assert [r.value for r in dm.delete(t, spark.createDataFrame([("A",)], "value string"), ["value"]).collect()] == ["B"]
    lt = fx.dim(spark, SF001, "dim_location_type")
    rows = spark.createDataFrame([(1, 5, "NEW", 3)], "location_id int, type_id int, code string, current_units int")
    out = dm.replace_group(lt, rows, ["location_id"])
    assert sorted(r.code for r in out.filter(F.col("location_id") == 1).collect()) == ["NEW"]
    assert out.count() == lt.filter("location_id <> 1").count() + 1


def test_row_counts_next_id_default_map(spark):
    rc = {r.table: r.rows for r in dm.row_counts({"tech": fx.dim(spark, SF001, "dim_tech"),
                                                   "size": fx.dim(spark, SF001, "dim_size")}).collect()}
    assert rc == {"tech": 4, "size": 3}
    assert dm.next_id(fx.dim(spark, SF001, "dim_tech"), "tech_id").first()[0] == 5
    empty = spark.createDataFrame([], "value string, tech_name string")
    assert dm.token_map_or_default(empty).count() == len(dm.DEFAULT_TOKEN_MAP)
    assert dm.token_map_or_default(fx.dim(spark, SF001, "dim_token_map")).count() == fx.dim(spark, SF001, "dim_token_map").count()
    own = spark.createDataFrame([("Q", "PAINT")], "value string, tech_name string")
    assert [tuple(r) for r in dm.token_map_or_default(own).collect()] == [("Q", "PAINT")]


def test_location_derive_and_grids(spark):
    locs = fx.dim(spark, SF001, "dim_location").withColumn("location", F.lower(F.concat(F.lit(" "), "location")))
    out = {r.location_id: r for r in dm.derive_location(locs, fx.dim(spark, SF001, "dim_priority")).collect()}
    assert out[3].location == "NATION_2" and out[3].travel_time == 14 and out[3].reserve_allowed == 1
    g = pm.loc_tech_grid(fx.dim(spark, SF001, "dim_tech"), fx.dim(spark, SF001, "dim_location"), fx.dim(spark, SF001, "dim_tech_location"))
    assert g.count() == 4 * 25 and g.filter("tech_name = 'UNK' AND compatible = 1").count() == 25
    tl = pm.type_loc_grid(fx.dim(spark, SF001, "dim_type"), fx.dim(spark, SF001, "dim_location"), fx.dim(spark, SF001, "dim_location_type"))
    assert tl.count() == 6 * 25 and tl.filter("type = 'ECONOMY' AND location = 'NATION_2'").first().current_units >= 1.0
    assert tl.filter("type = 'ECONOMY' AND location = 'NATION_3'").first().current_units == 0.0


def test_contracts(spark):
    df = spark.createDataFrame([("m", "C1", "5", "x")], "material string, code string, total_stock_raw string, extra string")
    v, missing, extra = ct.validate(df, "stock")
    assert v.columns == ["material", "code", "total_stock_raw"] and extra == ["extra"]
    with pytest.raises(ct.ContractError):
        ct.validate(df.drop("code"), "stock")
    with pytest.raises(ct.ContractError):
        ct.validate(df.withColumn("code", F.lit(1)), "stock")
    out = ct.enforce_output(spark.createDataFrame([("m",)], "material string"), "material_to_tech", {"UNK": 0})
    r = out.first()
    assert r.UNK == 0 and r.BODY is None
    c = ct.coerce(spark.createDataFrame([("1,2 EA", "3,5")], "a string, b string"), {"a": "int", "b": "double"}, "stock")
    assert tuple(c.first()) == (12, 35.0)
    c = ct.coerce(spark.createDataFrame([("1,2", "1,5")], "a string, b string"), {"a": "int", "b": "double"}, "master")
    assert tuple(c.first()) == (12, None)  # only the integers of the master export lose their commas


def test_export_read_and_workspace(spark, tmp_path):
    df = spark.createDataFrame([("m1", "C1", "1,005")], "Material string, `Storage Type` string, `Total Stock` string")
    p = files.write_csv(df, str(tmp_path / "stock"))
    got = files.read_export(spark, p, {"material": "material", "STORAGE  type": "code", " total stock": "total_stock_raw"})
    assert tuple(got.first()) == ("m1", "C1", "1,005")
    with pytest.raises(ct.ContractError):
        files.read_export(spark, p, {"Plant": "plant"})
    ws = files.Workspace(spark, str(tmp_path / "ws"))
    assert ws.ready(["parts"]) == {"parts": False}
    ws.init({"parts": ct.load_contract("stock_output")})
    assert ws.ready(["parts"]) == {"parts": False} and ws.ready(["parts"], require_rows=False) == {"parts": True}
    ws.replace("parts", spark.createDataFrame([("m1", "S")], "material string, size string"),
               ct.load_contract("stock_output"))
    r = ws.read("parts").first()
    assert r.material == "m1" and r.total_stock is None and ws.ready(["parts"]) == {"parts": True}
    assert len(ws.preview("parts")) == 1 and len(ws.versions("parts")) == 2
    by_uri = files.Workspace(spark, f"file://{tmp_path}/ws")  # the same tables by a URI
    assert by_uri.read("parts").count() == 1 and not (tmp_path / "file:").exists()
