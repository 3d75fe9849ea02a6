"""Lexical search, hard negatives and nearest neighbours against brute force, and on edge rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from stowage.llm import bond, graph, lexical

EXTRA = ["seq", "sketch", "term", "q", "label_", "anchor", "v", "shard", "score", "rank"]


# ---------------------------------------------------------------- lexical search

def lexical_brute(docs, items, k):
    """The same rule in plain Python, one document after the other."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+",
                                 re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(split(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for seq, (i, c) in enumerate(held):
            m = 100 - 75 + (75 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in split(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, seq, i))
        out += [(item, r + 1, x[4], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def text_rows():
    r = random.Random(4)
    vocab = [f"w{k}" for k in range(400)] + ["Über", "naïve", "日本", "x1", "The"]
    rows = [(k, " ".join(r.choices(vocab[:r.choice([20, 120, 405])], k=r.randint(1, 90)))) for k in range(300)]
    rows += [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (900, None), (901, ""), (902, " ,.; "), (5, rows[5][1]), (5, rows[5][1])]
    rows += [(1000 + k, "w7 w8-w9, the W7") for k in range(150)]  # a large group of copies
    rows += [(2000, "w300 " * 300 + "w301"), (2001, ("w5 w6, " * 40_000) + "w399")]  # frequencies beyond a byte, a long text
    return rows


def item_rows():
    r = random.Random(5)
    items = [(k, " ".join(r.choices([f"W{j}" for j in range(405)], k=r.randint(1, 30)))) for k in range(40)]
    return items + [(100, None), (101, ""), (102, "nowhere"), (103, "w300 w300 w301"), (104, "ÜBER über naïve 日本 the"),
                    (103, "w300 w300 w301"), (105, "w5 w399"), (106, "w7 w8 w9")]


def test_lexical_brute(spark, monkeypatch):
    docs = spark.createDataFrame([(*x, *["z"] * len(EXTRA)) for x in text_rows()],
                                 "doc_id long, text string, " + ", ".join(f"{c} string" for c in EXTRA)).repartition(5)
    items = spark.createDataFrame([(*x, "z", "z") for x in item_rows()], "item_id long, text string, terms string, qtf string")
    for blocks in (lexical.BLOCK_TERMS, 2 * lexical.BLOCK_TERMS // lexical.BLOCK_ITEMS):  # one block of items, then many
        monkeypatch.setattr(lexical, "BLOCK_TERMS", blocks)
        got = lexical.rank_documents(docs, items, k=7).collect()
        assert sorted(map(tuple, got), key=str) == lexical_brute(text_rows(), item_rows(), 7)


def test_lexical_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    # one document with both its terms: weights floor(1000 ln(4/3)) = 287, m = 100
    assert [tuple(r) for r in lexical.rank_documents(docs, items).collect()] == [(1, 1, 1, 287 * (1000000000 // 1800))]
    assert lexical.rank_documents(docs.where("false"), items).count() == 0
    assert lexical.rank_documents(docs.where("text is null"), items).count() == 0
    assert lexical.rank_documents(docs, items.where("false")).count() == 0


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 16)
    text = ("Alpha beta-" + "g" * 50 + " Alpha, Ünder ").encode() * 9
    assert lexical.term_counts(text) == {b"alpha": 18, b"beta": 9, b"g" * 50: 9, "Ünder".encode(): 9}


def test_sketch_bounds():
    """No score lies above its bound, neither before nor after the second hash function."""
    rows = text_rows()
    counts = [lexical.term_counts((t or "").encode()) for _, t in rows]
    df = Counter(t for c in counts for t in c)
    index = lexical.Index(None, None, sum(bool(c) for c in counts), sum(c.total() for c in counts))
    terms = [[{"term": t, "qtf": n, "df": df[t]} for t, n in lexical.term_counts((x or "").encode()).items() if df[t]]
             for _, x in item_rows()]
    block = lexical._Block([{"qseq": k, "item": k, "terms": t} for k, t in enumerate(terms) if t], index)
    m = np.array([25 + (75 * c.total() * index.n_docs) // index.n_terms for c in counts])
    impacts = block.impacts([lexical.sketch(c) for c in counts], m)
    first, all_rows = impacts[0] @ block.table, np.arange(len(rows))
    for q in range(len(block.items)):
        second = block.refined(impacts, q, all_rows)
        exact = np.array([block.score(q, c, int(x)) for c, x in zip(counts, m)])
        assert (exact <= second).all() and (second <= first[:, q]).all()
        assert (exact == second).mean() > 0.9  # tight


# ---------------------------------------------------------------- hard negatives

def negatives_brute(rows, every, positives, negatives):
    held = [(i, s, la, [math.floor(256 * float(np.float32(x))) for x in v]) for s, (i, v, la) in enumerate(rows)
            if i is not None and la is not None and v is not None
            and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    out = []
    for i, s, la, v in held:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, t, lb) for j, t, lb, w in held if t != s)
        for p in [x for x in scored if x[3] == la][:positives]:
            fit = [x for x in scored if x[3] != la and 30 * -p[0] <= 100 * -x[0] <= 90 * -p[0]]
            out += [(i, p[1], r + 1, x[1], -p[0], -x[0]) for r, x in enumerate(fit[:negatives])]
    return sorted(out)


def vector_rows(seed=3, n=700, dims=24):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(6, dims))
    rows = []
    for k in range(n):
        g = int(r.integers(0, 6))
        v = (centre[g] + r.normal(size=dims) * r.choice([0.05, 0.5])).astype(np.float32)
        rows.append((k, [float(x) for x in v], g if r.random() < 0.7 else int(r.integers(0, 6))))
    same = rows[11][1]
    rows += [(2000 + k, same, 1) for k in range(300)]  # a large group of copies under one label
    rows += [(10, rows[10][1], rows[10][2]), (None, same, 1), (3001, None, 1), (3002, [], 2), (3003, same[:5], 3),
             (3004, [None] + same[1:], 1), (3005, [float("nan")] + same[1:], 1), (3006, [float("inf")] + same[1:], 1),
             (3010, same, None), (3020, [0.0] * dims, 2), (3030, [-x for x in same], 1)]
    return rows


def test_negatives_brute(spark, monkeypatch):
    monkeypatch.setattr(bond, "ROWS", 64)  # many blocks
    rows = vector_rows()
    v = spark.createDataFrame([(*x, *["z"] * len(EXTRA)) for x in rows],
                              "vec_id long, embedding array<float>, label int, " + ", ".join(f"{c} string" for c in EXTRA))
    want = negatives_brute(rows, 10, 5, 10)
    assert len({x[0] for x in want}) > 50
    for anchors in (bond.ANCHORS, 30):
        monkeypatch.setattr(bond, "ANCHORS", anchors)
        assert sorted(map(tuple, bond.mine_negatives(v, every=10).collect())) == want


def test_negatives_large_values(spark):
    """Products beyond a double's exact integers are still exact."""
    r = random.Random(8)
    rows = [(k, [float(r.randrange(2 ** 20)) * 2 ** r.randrange(2) for _ in range(6)], k % 3) for k in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, bond.mine_negatives(v, every=5, positives=2, negatives=3).collect())) == \
        negatives_brute(rows, 5, 2, 3)
    assert bond.mine_negatives(v.where("false")).count() == 0
    assert bond.mine_negatives(v.where("vec_id = 5")).count() == 0
    assert bond.mine_negatives(v.where("vec_id % 3 = 0"), every=5).count() == 0  # one label only


def test_vertical_scan_prunes():
    """The scan reads few columns of rows that are out of reach, and its scores are exact."""
    r = np.random.default_rng(1)
    m = np.sort(r.integers(-50, 50, size=(500, 32)).astype(float), axis=0)
    block = bond.Block(0, 0, np.arange(500), np.arange(500), np.zeros(500, np.int64), np.ascontiguousarray(m.T), m.min(0), m.max(0))
    anchor = r.integers(1, 50, size=32).astype(float)
    order = np.argsort(-np.abs(anchor), kind="stable")
    left = []

    def prune(low, high):
        keep = high >= np.sort(low)[-5]
        left.append(int(keep.sum()))
        return keep

    rows, scores = bond.vertical_scan(block, anchor, order, np.arange(500), prune)
    assert (scores == (m @ anchor)[rows]).all() and set(np.argsort(-(m @ anchor))[:5]) <= set(rows)
    assert left[-1] < 100 and left == sorted(left, reverse=True)


# ---------------------------------------------------------------- nearest neighbours

def nearest_brute(rows, every, k):
    held = [(i, s, np.array(v, dtype=np.float32).astype(float)) for s, (i, v, *_) in enumerate(rows)
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    dims = max(len(v) for _, _, v in held)
    m = np.zeros((len(held), dims))
    for r, (_, _, v) in enumerate(held):
        m[r, :len(v)] = v
    m /= np.sqrt((m * m).sum(1))[:, None]
    ids, out = np.array([h[0] for h in held]), {}
    for r in np.flatnonzero(ids % every == 0):
        s = (m * m[r]).sum(1)
        s[r] = -9
        best = np.lexsort((np.arange(len(s)), ids, -np.round(s, 12)))[:min(k, len(s) - 1)]
        out.setdefault(int(ids[r]), []).append([(int(ids[b]), s[b]) for b in best])
    return out


def recall(got, want, k):
    hits = total = 0
    for q, lists in want.items():
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        least = lists[0][-1][1] - 1e-12
        hits += sum(r["score"] >= least for r in mine)
        total += sum(map(len, lists))
    return hits / total


@pytest.mark.parametrize("shard_rows", [16384, 300])
def test_nearest_recall(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(graph, "SHARD_ROWS", shard_rows)
    rows = vector_rows(n=1500)
    v = spark.createDataFrame([(*x, *["z"] * len(EXTRA)) for x in rows],
                              "vec_id long, embedding array<float>, label int, " + ", ".join(f"{c} string" for c in EXTRA))
    got = graph.nearest(v, k=5, every=10).collect()
    want = nearest_brute(rows, 10, 5)
    assert {r["query_id"] for r in got} == set(want) and len(got) == 5 * sum(map(len, want.values()))
    assert recall(got, want, 5) >= 0.95
    for q in (2000, 2010):  # copies: equal scores go by id
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in mine] == [11, *(x for x in range(2000, 2006) if x != q)][:5]
    again = graph.nearest(v, k=5, every=10).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_nearest_recall_of_table(spark):
    """Recall of the registered query's parameters against brute force on the given vectors."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = graph.nearest(v, k=5, every=50).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in v.orderBy("vec_id").collect()]
    want = nearest_brute(rows, 50, 5)
    assert recall(got, want, 5) >= 0.9
    by = {(q, i): s for q, lists in want.items() for i, s in lists[0]}
    assert all(abs(r["score"] - by.get((r["query_id"], r["vec_id"]), r["score"])) < 1e-12 for r in got)


def test_nearest_edges(spark):
    rows = [(0, [1.0, 0.0]), (50, [2.0, 0.0]), (50, [2.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0]), (3, []), (4, None),
            (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, 0.0]), (None, [1.0, 0.0]), (8, [-3e37, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = graph.nearest(v, k=9).collect()
    first = [(r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 0]
    assert sorted(first) == [(1, 2, 1.0), (2, 50, 1.0), (3, 50, 1.0), (4, 1, 0.0), (5, 8, -1.0)]
    assert sum(r["query_id"] == 50 for r in got) == 2 * 5
    assert graph.nearest(v.where("false")).count() == 0
    assert graph.nearest(v.where("vec_id in (1, 2)")).count() == 0
    assert graph.nearest(v.where("vec_id = 0")).count() == 0


def test_robust_prune_keeps_diverse_edges():
    angle = np.radians([0, 10, 12, 14, 90, 95, 180])
    unit = np.stack([np.cos(angle), np.sin(angle)], 1).astype(np.float32)
    out = graph.robust_prune(unit, np.array([0]), np.array([[1, 2, 3, 4, 5, 6, -1, 0, 1]]), 3, 1.2)
    assert out.tolist() == [[1, -1, -1]] or out[0, 0] == 1
    assert 2 not in out and 3 not in out  # nearer to node 1 than to node 0
