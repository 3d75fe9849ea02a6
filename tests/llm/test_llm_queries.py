"""Registered queries against their SQL, and the pipeline against a plain run of its stages."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from stowage.llm import pii, queries, simhash

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).fetchdf()
    got = queries.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    keys = (["item_id", "rank"] if "item_id" in cols else
            [c for c in ("anchor_id", "positive_id", "doc_id", "query_id", "rank") if c in cols])
    pd.testing.assert_frame_equal(got[cols].sort_values(keys).reset_index(drop=True),
                                  want[cols].sort_values(keys).reset_index(drop=True), check_dtype=False)


def test_all_registered():
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in names)] == []
    assert set(entry.oracle_sql()) <= names


def test_shards_balanced(spark):
    p = queries.QUERIES["op2_shard_bytes"](spark, SF).toPandas()
    sizes = p.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 2 * p["size"].max()
    for _, g in p.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    again = queries.QUERIES["op2_shard_bytes"](spark, SF).toPandas()
    assert p.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_pipeline_decisions(spark):
    """Every stage's rows against a plain computation from the rows before it."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = docs.toPandas().set_index("doc_id")
    kept = corpus_pipeline.quality_stage(spark, docs, SMALL)
    assert set(r["doc_id"] for r in kept.select("doc_id").collect()) <= set(first.index)

    deduped = corpus_pipeline.near_dedup_stage(spark, kept, SMALL).toPandas().set_index("doc_id")
    rows = kept.toPandas().sort_values("doc_id")
    fps = np.array([simhash.fingerprint(t.encode()) for t in rows.text], dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.arange(len(fps))
    while True:
        low = np.where(near, label[None, :], len(fps)).min(1)
        if (low == label).all():
            break
        label = low
    assert set(deduped.index) == set(rows.doc_id.values[np.unique(label)])

    redacted = corpus_pipeline.pii_stage(spark, kept, SMALL).toPandas().set_index("doc_id")
    for i, t in redacted.text.items():
        assert not [s for s in pii.base_spans(t) if s[1] in (0, 2, 3)]
        if not pii.base_spans(first.text[i]) and not pii.candidates(first.text[i], []):
            assert t == first.text[i] and redacted.n_chars[i] == first.n_chars[i]

    mixed = corpus_pipeline.mix_stage(spark, kept, SMALL)
    pieces = corpus_pipeline.pack_stage(spark, mixed, SMALL).toPandas()
    assert pieces["copy"].nunique() == mixed.count()
    assert sorted(pieces.groupby("copy").doc_id.first()) == sorted(mixed.toPandas().doc_id)
    total = corpus_pipeline.run(spark, SMALL).toPandas()
    assert total.groupby("sequence_id").length.sum().iloc[:-1].eq(2048).all()
