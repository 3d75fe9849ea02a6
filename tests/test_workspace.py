"""Commits, conflicts, cascades and bucket updates of a workspace; ingest order; registering a technology."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF001
from stowage import jobs
from stowage.functions.contracts import ContractError
from stowage.operators import consumption as con
from stowage.session import ensure_checkpoint_dir, materialize, stage_scope
from stowage.sources import fixtures as fx
from stowage.sources.files import read_export, write_csv
from stowage.sources.workspace import ConflictError, Workspace, bucket_of


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "material string")


def test_two_writers_never_share_a_number(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    a, b = ws.transaction(), ws.transaction()
    a.replace("x", rows(spark, "1"))
    b.replace("y", rows(spark, "2", "3"))
    assert (b.commit(), a.commit()) == (1, 2)  # other tables: the later one takes the next number
    assert ws.read("x").count() == 1 and ws.read("y").count() == 2
    a, b = ws.transaction(), ws.transaction()
    a.replace("x", rows(spark, "4"))
    b.replace("x", rows(spark, "5"))
    a.commit()
    with pytest.raises(ConflictError):
        b.commit()
    assert [r.material for r in ws.read("x").collect()] == ["4"] and ws.versions("x") == [1, 2]


def test_a_read_table_that_changed_refuses_the_commit(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    ws.replace("x", rows(spark, "1"))
    t = ws.transaction()
    t.replace("y", t.read("x"))
    ws.replace("x", rows(spark, "2"))
    with pytest.raises(ConflictError):
        t.commit()
    assert ws.current("y") is None


def test_the_number_is_claimed_once(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    assert ws.files.claim(ws._log(1), '{"tables": {}}')
    assert not ws.files.claim(ws._log(1), '{"tables": {"x": 1}}')
    assert ws.manifest().tables == {} and [p.name for p in (tmp_path / "log").glob("*.json")] == ["000000000001.json"]


def test_crash_between_tables_shows_neither(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    ws.replace("x", rows(spark, "old"))
    with pytest.raises(RuntimeError):
        with ws.transaction() as t:
            t.replace("x", rows(spark, "new"))
            t.replace("y", rows(spark, "new"))
            raise RuntimeError("lost driver")
    assert [r.material for r in ws.read("x").collect()] == ["old"] and ws.current("y") is None
    assert ws.vacuum(grace=3600) == 0  # young folders may belong to a commit under way
    assert ws.vacuum(grace=-1) == 2 and ws.read("x").count() == 1


def test_old_versions_are_removed(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    for v in "abc":
        ws.replace("x", rows(spark, v))
    assert [r.material for r in ws.read("x", number=1).collect()] == ["a"]
    assert ws.vacuum(keep=1, grace=-1) == 2 and ws.versions("x") == [3] and ws.read("x").count() == 1


def test_only_changed_buckets_are_replaced(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path), buckets=4)
    first = spark.range(200).select(F.col("id").cast("string").alias("material"), F.lit(1).alias("n"))
    with ws.transaction() as t:
        assert t.replace_buckets("x", first, "material") == ["0", "1", "2", "3"]
    before = ws.manifest().tables["x"]
    second = first.withColumn("n", F.when(F.col("material") == "7", 2).otherwise(F.col("n")))
    home = first.filter("material = '7'").select(bucket_of("material", 4)).first()[0]
    with ws.transaction() as t:
        assert t.replace_buckets("x", second, "material") == [home]
    after = ws.manifest().tables["x"]
    assert {b for b in before.folders if before.folders[b] != after.folders[b]} == {home} and after.version == 2
    assert sorted(map(tuple, ws.read("x").collect())) == sorted(map(tuple, second.collect()))
    with ws.transaction() as t:
        assert t.replace_buckets("x", second, "material") == []
    assert ws.current("x") == 2  # the same rows: the same version
    with ws.transaction() as t:  # rows of one bucket are gone
        assert t.replace_buckets("x", second.filter(bucket_of("material", 4) != home), "material") == [home]
    assert ws.read("x").filter(bucket_of("material", 4) == home).count() == 0


def test_columns_of_unlike_versions_read_as_one(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path), buckets=2)
    old = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1)], "material string, BODY int")
    with ws.transaction() as t:
        t.replace_buckets("x", old, "material")
    with ws.transaction() as t:
        t.add_column("x", "TOOLING", T.IntegerType(), 0)
        t.add_column("x", "TOOLING", T.IntegerType(), 0)  # again: nothing
    assert {tuple(r) for r in ws.read("x").collect()} == {("a", 1, 0), ("b", 0, 0), ("c", 1, 0)}
    home = old.filter("material = 'a'").select(bucket_of("material", 2)).first()[0]
    some = ws.read("x").filter(bucket_of("material", 2) == home).withColumn("TOOLING", F.lit(1))
    n = some.count()
    with ws.transaction() as t:
        t.replace_buckets("x", some, "material", only=[home])
    got = ws.read("x")
    assert got.columns == ["material", "BODY", "TOOLING"] and got.count() == 3 and got.filter("TOOLING = 1").count() == n
    with pytest.raises(ContractError), ws.transaction() as t:
        t.add_column("x", "tooling", T.IntegerType(), 0)


def test_cascade_and_states(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    jobs.reset_dimensions(ws, {n: fx.dim(spark, SF001, n) for n in ("dim_location", "dim_type", "dim_location_type")})
    with ws.transaction() as t:
        t.replace("stock", rows(spark, "1"))
        t.replace("parts", rows(spark, "1"))
    ws.replace("dim_type", ws.read("dim_type"))
    got = {r.table: (r.state, r.changed) for r in ws.states().collect()}
    assert got["dim_location_type"] == ("empty", None) and got["stock"] == ("stale", "dim_location_type")
    assert got["parts"] == ("stale", "stock") and got["dim_location"] == ("ready", None)
    ws.replace("dim_location_type", fx.dim(spark, SF001, "dim_location_type"))
    with ws.transaction() as t:
        t.replace("stock", rows(spark, "1"))
    assert {r.table: r.state for r in ws.states(["dim_location_type", "stock", "parts", "i_sku"]).collect()} == {
        "dim_location_type": "ready", "stock": "ready", "parts": "stale", "i_sku": "missing"}


@pytest.mark.parametrize("split", ["128m", "200b"])
def test_input_order_over_files_and_splits(spark, tmp_path, split):
    """The first row of a material is that of the files' order, however they are split."""
    lines = spark.range(300).select(F.format_string("m%d", F.col("id") % 40).alias("Material"), F.col("id").cast("string").alias("At"))
    path = write_csv(lines.repartitionByRange(3, F.col("At").cast("int")).sortWithinPartitions(F.col("At").cast("int")), str(tmp_path / "x"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = read_export(spark, path, {"material": "material", "at": "at"}, order_col="row_no")
        if split != "128m":
            assert df.rdd.getNumPartitions() > 5
        first = df.groupBy("material").agg(F.min_by("at", "row_no").alias("at"))
        assert {(r.material, r["at"]) for r in first.collect()} == {(f"m{k}", str(k)) for k in range(40)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_register_technology(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    jobs.reset_dimensions(ws, {"dim_tech": fx.dim(spark, SF001, "dim_tech")})
    ws.replace("parts", spark.createDataFrame([("a", 1)], "material string, BODY int"))
    assert jobs.register_technology(ws, " final check ") == "FINAL_CHECK"
    assert tuple(ws.read("parts").first()) == ("a", 1, 0)
    assert [tuple(r) for r in ws.read("dim_tech").orderBy("tech_id").collect()][-1] == (5, "FINAL_CHECK")
    jobs.register_technology(ws, "Final Check")
    assert ws.read("dim_tech").count() == 5
    for bad in ("", "  ", "??"):
        with pytest.raises(ContractError):
            jobs.register_technology(ws, bad)


def test_stage_scope_removes_its_tables(spark):
    with stage_scope(spark) as folder:
        kept = materialize(spark.range(5), "x")
        assert folder.rsplit("/", 1)[-1] in kept.inputFiles()[0] and kept.count() == 5
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert ensure_checkpoint_dir(spark)


def test_lines_count_an_order_once(spark):
    """An order at several centers counts once; lines without an order count none, but their line-downs and centers do."""
    raw = spark.createDataFrame([("m", 1, "c1", "OR09"), ("m", 1, "c2", "OR01"), ("m", 1, "c2", "OR09"), ("m", 2, "c2", "OR01"),
                                 ("m", None, "c3", "OR09"), ("m", None, "c3", "OR01"), (None, 1, "c1", "OR09"), ("n", 1, None, "OR01")],
                                "material string, order_no long, cost_center string, order_type string")
    lines = con.consumption_lines(raw)
    assert lines.count() == 5 and lines.agg(F.sum("line_down")).first()[0] == 4
    got = {r.material: (r.line_down_orders, r.orders) for r in con.consumption_stats(lines).collect()}
    assert got == {"m": (3, 2), "n": (0, 1)}


def test_lines_are_shuffled_once(spark):
    """After a join on the order key, only pre-aggregated pairs are shuffled; there is one scan of the fact."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = con.consumption_lines(fx.raw_consumption(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("l_orderkey#") and plan.count("FileScan") == 2  # lines and orders
    assert plan.count("Exchange hashpartitioning") == 3  # both sides of the join, and the pairs
