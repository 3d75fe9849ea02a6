"""Jobs from export files to workspace tables, and the dimension functions without a query of their own."""

import pytest

from conftest import SF001
from stowage import jobs
from stowage.functions.contracts import ContractError
from stowage.operators import dims as dm
from stowage.sources import files, fixtures as fx


def test_stock_job_keeps_rejects_aside(spark, tmp_path):
    export = spark.createDataFrame([("1", "a", "N2-1", "1,005"), ("2", "b", "LOST-9", "3"), ("3", "c", "N0-3", "?")],
                                   "row string, ` material` string, `STORAGE type` string, `Total  Stock` string")
    path = files.write_csv(export, str(tmp_path / "stock"))
    ws = files.Workspace(spark, str(tmp_path / "ws"))
    table = jobs.build_stock(ws, path, fx.dim(spark, SF001, "dim_location_type"), fx.dim(spark, SF001, "dim_size"))
    got = ws.read(table).collect()
    assert [(r.material, r.total_stock, r.size) for r in got] == [("a", 1005, "S")]
    assert {r.material for r in ws.read("stock_rejects").collect()} == {"b", "c"}


def test_job_without_a_required_header(spark, tmp_path):
    path = files.write_csv(spark.createDataFrame([("1",)], "`Cost Center` string"), str(tmp_path / "cc"))
    with pytest.raises(ContractError):
        jobs.build_cost_center(files.Workspace(spark, str(tmp_path / "ws")), path)


def test_dimension_loads(spark, tmp_path):
    ws = files.Workspace(spark, str(tmp_path / "ws"))
    dims = {n: fx.dim(spark, SF001, n) for n in ("dim_location", "dim_type", "dim_location_type")}
    jobs.reset_dimensions(ws, dims)
    assert ws.ready(list(dims)) == dict.fromkeys(dims, True)
    path = files.write_csv(dims["dim_location_type"], str(tmp_path / "lt"))
    jobs.load_dimension_export(ws, "dim_location_type", path, dims["dim_location_type"].schema,
                               [(dims["dim_location"], ["location_id"]), (dims["dim_type"], ["type_id"])])
    kept = ws.read("dim_location_type")
    assert kept.count() == dims["dim_location_type"].count() - 1 and dict(kept.dtypes) == dict(dims["dim_location_type"].dtypes)
    assert {r.type_id for r in dm.one_group(kept, "location_id", 3).collect()} == {
        r.type_id for r in dims["dim_location_type"].filter("location_id = 3").collect()}
    listed = [r.location_id for r in dm.listing(dims["dim_location"], ["location_id"]).collect()]
    assert listed == sorted(listed)


def test_workflow_outputs_are_saved_by_name(spark, tmp_path):
    from stowage.pipeline import stages

    s = stages(spark, SF001)
    ws = files.Workspace(spark, str(tmp_path / "ws"))
    names = jobs.save_outputs(ws, {"parts": s.parts(), "i_sku": s.category_summary(), "i_sku_user": s.category_tech(),
                                   "i_sku_type": s.category_type()})
    assert ws.ready(names) == dict.fromkeys(names, True)
    assert ws.read("i_sku").columns[:2] == ["category_id", "category"]
    assert ws.read("i_sku_user").count() == s.category_tech().count()
