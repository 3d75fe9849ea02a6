"""Edge cases of every operator and pipeline stage: nulls, empty and long texts, repeated rows, empty tables, clashing names."""

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from stowage.llm import lm, mixing, packing, pii, quality, rules, search, sharding, simhash, toxicity

#: Columns that a table may have besides its own, named as the operators' inner columns are.
CLASH = ["seq", "key", "size", "fp", "id", "part", "score", "c", "t", "row", "plan_", "mix_key", "seq_", "key_", "redacted"]
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASH]])
LABEL = "doc_id long, quality int, toxic int"


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["lo", "the", "of", "tion", "enk", "raar", "mita", "oust"]) * r.randint(1, 2) for _ in range(n))


def doc_rows():
    long = words(1, 60_000)  # a long text, several slices long
    rows = [(None, None, None, None), (None, None, None, None), (1, None, "en", "a"), (2, "", "en", "a"),
            (3, " \t\n\r ", None, "a"), (4, "one", "en", None), (5, long, "en", "b"), (6, long, "en", "b"),
            (7, "mail bob@x.org or +1 (234) 555-2345 now", "en", "b"), (8, words(2, 80), "de", "c"),
            (8, words(2, 80), "de", "c"), (8, words(2, 80), "de", "c"), (9, "x" * 700_000, "en", "c")]
    rows += [(k, words(k, 60 + k % 7), "en", "abc"[k % 3]) for k in range(10, 60)]
    return [(i, t, la, s, None if t is None else len(t), *["z"] * len(CLASH)) for i, t, la, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(doc_rows(), DOC).repartition(4).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, int(k % 3 > 0), int(k % 4 == 0)) for k in range(5, 60)] + [(None, 1, 1), (11, None, None), (12, 1, 0), (12, 0, 1)]
    return spark.createDataFrame(rows, LABEL).persist()


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], LABEL)


N = len(doc_rows())


def test_mix(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == N
    assert all(r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (None, 1, 2, 3)} == {0}
    by = {}
    for r in rows:
        s = by.setdefault(r["source"], [r["target"], r["source_size"], 0, 0])
        s[2] += r["taken"]
        s[3] = max(s[3], r["size"])
    assert all(abs(t - got) <= most and t <= 2 * size + 1e-9 for t, size, got, most in by.values())
    assert abs(sum(t for t, *_ in by.values()) - 1.5 * sum(s[1] for s in by.values())) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))  # reruns agree
    assert mixing.mix(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.mixed_documents(none).count() == 0


def test_mix_of_one_repeated_row(spark):
    """All rows of a source alike: they are still split near the target."""
    docs = spark.createDataFrame([(1, "a b c", "x")] * 100 + [(2, "d", "y")] * 300, "doc_id long, text string, source string")
    rows = mixing.mix(docs, weights=(1, 2), share=0.5).collect()
    for s in "xy":
        got = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 3


def test_shard(docs, none):
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == N
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["size"] == 1 and r["text_crc32"] == 0 for r in rows if r["doc_id"] in (None, 1, 2))
    assert sharding.shard(none).count() == 0


def test_search_edges(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5]), (3, []), (4, None),
            (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1e30, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = search.top_k(v, k=3).collect()
    assert {r["query_id"] for r in got} == {0, 100}
    top = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 0)
    assert top == [(1, 8), (2, 1), (3, 100)]
    assert not {4, 5, 6, 7} & {r["vec_id"] for r in got}
    assert search.top_k(v.where("false")).count() == 0
    assert search.top_k(v.where("vec_id = 1")).count() == 0


def test_rules(docs, none):
    rows = rules.apply_rules(docs).collect()
    assert len(rows) == N
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (None, 1, 2, 3, 4, 9))
    assert rules.apply_rules(none).count() == 0


def test_toxicity(docs, none, labels, no_labels):
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == N and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(docs, no_labels).collect()} == {0.5}


def test_quality(docs, none, labels, no_labels):
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == N and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert quality.score_quality(none, labels).count() == 0
    assert {r["score"] for r in quality.score_quality(docs, no_labels).collect()} == {0.5}
    assert quality.keep_quality(docs, labels).columns == docs.columns


def test_pack(docs, none):
    rows = packing.pack(docs, length=256).collect()
    by = {}
    for r in rows:
        by.setdefault(r["row"], []).append((r["start"], r["length"], r["doc_tokens"]))
        assert len(r["ids"]) == 4 * r["length"]
    assert len(by) == N
    for pieces in by.values():
        at = 0
        for start, length, total in sorted(pieces):
            assert start == at
            at += length
        assert at == total
    fill = {}
    for r in rows:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for seq, pieces in fill.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 256 or seq == max(fill)
    assert packing.pack(none).count() == 0


def test_language(docs, none):
    rows = lm.score_language(docs).collect()
    assert len(rows) == N
    empty = [r for r in rows if r["doc_id"] in (None, 1, 2, 3)]
    assert all(r["n_tokens"] == 1 for r in empty) and len({round(r["score"], 9) for r in empty}) == 1
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in rows)
    assert lm.score_language(none).count() == 0


def test_pii(docs, none):
    rows = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert rows[7]["base"] == "email:5:14,phone:18:35" and rows[7]["n_email"] == 1 and rows[7]["n_phone"] == 1
    assert rows[1]["spans"] == rows[2]["spans"] == ""
    out = pii.redact_pii(docs)
    assert out.columns == docs.columns
    seven = out.where("doc_id = 7").first()
    assert seven["text"] == "mail <EMAIL> or <PHONE> now" and seven["n_chars"] == len(seven["text"])
    assert out.where("text is null").count() == 3
    assert pii.find_pii(none).count() == 0


def test_simhash(docs, none):
    rows = simhash.simhash_classes(docs).collect()
    assert len(rows) == N
    blank = {r["component_id"] for r in rows if r["doc_id"] in (None, 1, 2, 3)}
    assert blank == {1}
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r["component_id"] for r in rows})
    assert simhash.simhash_classes(none).count() == 0 and simhash.simhash_dedup(none).count() == 0


def test_stages_on_edges(spark, docs, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == table.columns
            assert out.count() <= 2 * table.count()
        corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).count()


def test_language_model_leaves_no_used_up_files(spark):
    """What a step has read for the last time goes: shuffle files of the training, and its stage tables but the scored items."""
    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {b for b in blocks.mkString(" ").split() if b.startswith("shuffle_")}

    docs = spark.createDataFrame([(k, words(k, 60)) for k in range(40)], "doc_id long, text string")
    tables, before = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")) / "tables", shuffles()
    old = {p.name for p in tables.iterdir()} if tables.exists() else set()
    out = lm.score_language(docs)
    for _ in range(50):  # they are removed by messages to the executors
        if not (left := shuffles() - before):
            break
        time.sleep(0.2)
    assert not left
    new = [p.name for p in tables.iterdir() if p.name not in old]
    assert len(new) == 2 and all(n.startswith("llm-lm-scored") for n in new)
    assert sorted(r.score for r in out.collect()) == sorted(r.score for r in out.collect()) and out.count() == 40
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
