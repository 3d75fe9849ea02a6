"""Tasks over the order lines keep their size as the fact grows, with the same results."""

import re

from pyspark.sql import functions as F

from conftest import SF001
from stowage import jobs, session
from stowage.operators import consumption as con
from stowage.operators import stock as stk
from stowage.pipeline import stages
from stowage.sources import fixtures as fx
from stowage.sources.files import export_bytes, write_csv
from stowage.sources.workspace import Workspace


def test_line_tasks_dont_grow_with_the_fact(spark, monkeypatch):
    """However few partitions the session has, no task takes more than its share of the lines; the results are the same."""
    want = [sorted(map(tuple, df.collect())) for df in _consumption(spark)]
    monkeypatch.setattr(session, "ROWS_PER_TASK", 500)
    own = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        s = stages(spark, SF001)
        rows = [r.n for r in s.cons_lines().groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert [sorted(map(tuple, df.collect())) for df in _consumption(spark)] == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)
    assert len(rows) >= 12 and max(rows) <= 750  # the fixed partitions would hold half of them each


def _consumption(spark):
    s = stages(spark, SF001)
    return s.cons_priority(), s.cons_movement(), s.cons_tech()


def test_a_hot_pair_is_dealt_to_many_tasks(spark):
    """Two thirds of all lines have one material and center, some without an order: its rows add up over its slices."""
    rows = [("hot", i if i % 5 else None, "7", "OR09" if i % 3 == 0 else "OR01") for i in range(4000)]
    rows += [(f"m{i % 90}", i // 4, str(i % 11), "OR01") for i in range(2000)]
    raw = spark.createDataFrame(rows, "material string, order_no long, cost_center string, order_type string").repartition(8)
    want = sorted(map(tuple, con.consumption_stats(con.consumption_lines(raw)).collect()))
    lines = con.consumption_lines(raw, 25, by_order=False)
    assert sorted(map(tuple, con.consumption_stats(lines).collect())) == want
    hot = lines.filter("material = 'hot'").withColumn("pid", F.spark_partition_id()).select("pid", "line_down").collect()
    assert len(hot) == 6 and len({r.pid for r in hot}) > 1 and sum(r.line_down for r in hot) == 1334


def test_job_deals_lines_by_the_size_of_the_export(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 500)
    raw = fx.raw_consumption(spark, SF001)
    path = write_csv(raw.select(*[F.col(c).alias(h) for h, c in jobs.HEADERS["consumption"].items()]), str(tmp_path / "cons"))
    assert export_bytes(spark, path) // jobs.LINE_BYTES >= raw.count()
    ws = Workspace(spark, str(tmp_path / "ws"))
    jobs.build_cost_center(ws, write_csv(fx.raw_cost_center(spark, SF001).select(
        *[F.col(c).alias(h) for h, c in jobs.HEADERS["cost_center"].items()]), str(tmp_path / "cc")))
    jobs.build_consumption(ws, path)
    got = sorted(map(tuple, ws.read("material_to_movement").select("material", "movement", "orders").collect()))
    assert got == sorted(map(tuple, stages(spark, SF001).cons_movement().select("material", "movement", "orders").collect()))


def test_merge_tasks_dont_grow_with_the_materials(spark, monkeypatch):
    """However few partitions the session has, no task merges more than its share of the materials; the rows are the same."""
    want = [sorted(map(repr, df.collect())) for df in _merged(stages(spark, SF001))]
    monkeypatch.setattr(session, "RECORDS_PER_TASK", 40)
    own = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("2", "64"):  # few; more than are asked for, which would be coalesced to as many as there are cores
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            s = stages(spark, SF001)
            assert [sorted(map(repr, df.collect())) for df in _merged(s)] == want
            for df in (s.parts_with_master(), s.parts()):
                rows = [r.n for r in df.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
                assert len(rows) >= 8 and max(rows) <= 80 < sum(rows) / 2
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", own)


def _merged(s):
    return s.parts_with_movement(), s.parts(), s.known_materials(), s.master()


def test_first_rows_of_a_hot_key_are_dealt_to_many_tasks(spark):
    """Most rows have one key: its first row is found from slices, of which no task holds all; null keys are a key."""
    rows = [("hot", (i * 7919) % 5003, i % 3, f"v{i}") for i in range(5003)]
    rows += [(None if i % 40 == 0 else f"m{i % 40}", 900 - i, 0, str(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, a long, b int, v string").repartition(6)
    want = sorted(map(repr, stk.first_per_key(df, "k", "a", "b").collect()))
    got = stk.first_per_key(df, "k", "a", "b", parts=25)
    assert sorted(map(repr, got.collect())) == want and len(want) == 41
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(k#\d+, _slice#\d+, 25\), REPARTITION_BY_NUM", plan)
