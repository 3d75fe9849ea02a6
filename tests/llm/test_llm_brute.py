"""The operators against brute force, exact round trips or held-out accuracy on the given tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stowage.llm import lm, pii, queries, quality, rules, search, simhash, toxicity
from stowage.llm.common import hashed_counts, ngram_hashes
from stowage.llm.packing import encoder, hilbert_keys, tokenizer_dir

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def brute_classes(fps, bits):
    """Smallest index reachable over links of at most ``bits`` bits."""
    f = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= bits
    label = np.arange(len(f))
    while True:
        low = np.where(near, label[None, :], len(f)).min(1)
        if (low == label).all():
            return label
        label = low


@pytest.mark.parametrize("bits", [1, 2, 3, 4, 5])
def test_simhash_links_of_dense_groups(spark, bits):
    """Random fingerprints, chains around some, and a crowded ball of more than one block."""
    r = random.Random(bits)
    fps = [r.getrandbits(64) for _ in range(300)]
    for f in fps[:40]:
        for _ in range(4):
            for b in r.sample(range(64), r.randint(1, bits + 1)):
                f ^= 1 << b
            fps.append(f)
    centre = r.getrandbits(64)
    for _ in range(700):  # all in the low half: one signature of the high half for all
        fps.append(centre ^ sum(1 << b for b in r.sample(range(32), r.randint(0, 6))))
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    got = {r["fp"]: r["root"] for r in simhash.simhash_components(df, bits).collect()}
    want = brute_classes(fps, bits)
    pairs = {}
    for f, w in zip(fps, want):
        pairs.setdefault(int(w), set()).add(got[int(np.uint64(f).astype(np.int64))])
    assert all(len(v) == 1 for v in pairs.values())
    assert len({next(iter(v)) for v in pairs.values()}) == len(pairs)


def test_fingerprint_bits():
    import xxhash

    text = "One two  three\tfour two three four".encode()
    w = WORD.findall(text.lower())
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"A b") == xxhash.xxh64_intdigest(b"a b", 42)


def test_simhash_query(spark, texts):
    rows = queries.QUERIES["op10_simhash_variants"](spark, SF).collect()
    ids = sorted(texts)
    fps = [simhash.fingerprint(texts[i].encode()) for i in ids]
    want = brute_classes(fps, 3)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {
        (i, f"{f:016x}", ids[w]) for i, f, w in zip(ids, fps, want)}


def test_search_is_exact(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((3000, 8)).astype(np.float32)
    x[500:1500] = x[7]  # one vector held by a third of all rows
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for row in search.top_k(df, k=10, pivots=8).collect():
        got.setdefault(row["query_id"], {})[row["rank"]] = (row["vec_id"], row["score"])
    q = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    for i in range(0, 3000, 100):
        s = q @ q[i]
        best = sorted((k for k in range(3000) if k != i), key=lambda k: (-s[k], k))[:10]
        assert [got[i][n + 1] for n in range(10)] == [(k, s[k]) for k in best]


def test_rules_counts():
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = Counter(zip(w, w[1:], w[2:]))
        rep = {i + d for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep))

    r = random.Random(3)
    for _ in range(300):
        t = "".join(r.choice(["a", "b", "ab", " ", " ", "\n", "%", "é", " ", "<"]) for _ in range(r.randint(0, 60)))
        assert rules.text_counts(t) == brute(t)


def test_rules_on_labels(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_quality_rules"](spark, SF01).collect()}
    lab = spark.read.parquet(f"{SF01}/labels.parquet").collect()
    good = [got[r["doc_id"]]["kept"] for r in lab if r["quality"] == 1 and not got[r["doc_id"]]["base_failed"]]
    bad = [got[r["doc_id"]]["kept"] for r in lab if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_quantile_sketch(spark):
    r = np.random.default_rng(2)
    v = np.concatenate([np.zeros(100), r.lognormal(0, 2, 5000)])
    df = spark.createDataFrame([("en", float(x)) for x in v], "lang string, f double")
    q = rules.quantiles(rules.sketch(df, ["lang"], ["f"]), ["lang"], {"a": 0.1, "b": 0.5, "c": 0.99}).first()
    for name, at in (("a", 0.1), ("b", 0.5), ("c", 0.99)):
        assert abs(q[name] - np.quantile(v, at, method="inverted_cdf")) <= 0.011 * q[name] + 1e-6


@pytest.mark.parametrize("name,label,least", [("op5_toxicity_nb", "toxic", 0.9), ("op8_quality_neighbours", "quality", 0.95)])
def test_classifiers_held_out(spark, name, label, least):
    got = {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF01).collect()}
    mod, rest = (5, 0) if label == "toxic" else (4, 2)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % mod == rest) for i, r in got.items())
    held = [r for r in spark.read.parquet(f"{SF01}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([got[r["doc_id"]]["predicted"] == r[label] for r in held]) >= least


def test_chosen_grams_agree_with_one_by_one():
    place = np.full(toxicity.SLOTS, -1, dtype=np.int32)
    texts = [b"", b"ab", b"you idiot there", b"x" * 100, "é moron ".encode() * 3]
    place[toxicity.distinct_grams(texts[2])] = np.arange(len(toxicity.distinct_grams(texts[2])))
    n = int(place.max()) + 1
    doc, feature = toxicity.chosen_grams(texts, place, n)
    for k, t in enumerate(texts):
        want = {int(place[g]) for g in toxicity.distinct_grams(t) if place[g] >= 0}
        assert sorted(feature[doc == k].tolist()) == sorted(want)


def test_toxicity_recall(spark):
    """Held-out toxic texts are found, and clean ones left alone."""
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_toxicity_nb"](spark, "/root/testdata/sf0.1").where("held_out").collect()}
    held = [r for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if r["doc_id"] in got]
    said = {y: np.mean([got[r["doc_id"]]["predicted"] for r in held if r["toxic"] == y]) for y in (0, 1)}
    assert said[1] >= 0.8 and said[0] <= 0.02


def test_toxicity_takes_every_telling_gram(spark):
    """A vocabulary of which each toxic text has only one word: no n-gram is left out for being one of many."""
    r = random.Random(9)
    def word():
        return "".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(9))
    bad, plain = [word() for _ in range(150)], [word() for _ in range(400)]
    docs, labels = [], []
    for k in range(6000):
        toxic = int(k % 2)
        text = r.sample(plain, 10) + ([bad[k // 2 % 150]] if toxic else [])
        r.shuffle(text)
        docs.append((k, " ".join(text)))
        labels.append((k, 0, toxic))
    got = toxicity.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"),
                                  spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
                                  per_class=3000).where("held_out").collect()
    right = [r["predicted"] == r["doc_id"] % 2 for r in got]
    assert len(right) > 1000 and np.mean(right) >= 0.97


def test_logistic_against_dense_newton():
    """The sparse fit reaches the loss of a dense regression fitted by Newton steps."""
    r = np.random.default_rng(4)
    x = (r.random((300, 20)) < 0.3) * 1.0
    y = (r.random(300) < 1 / (1 + np.exp(-x @ r.normal(0, 1, 20)))).astype(float)
    scale, rows, l2 = r.uniform(0.5, 2, 20), np.full(300, 1 / 300), 1e-2
    doc, feature = np.nonzero(x)
    w, b = toxicity.fit_logistic(doc, feature, scale, y, rows, l2=l2)
    full = np.hstack([x * scale, np.ones((300, 1))])
    pen = np.append(np.full(20, l2), 0)
    def loss(v):
        z = full @ v
        return (rows * (np.logaddexp(0, z) - y * z)).sum() + (pen * v * v).sum() / 2
    v = np.zeros(21)
    for _ in range(30):
        p = 1 / (1 + np.exp(-full @ v))
        v -= np.linalg.solve((full * (rows * p * (1 - p))[:, None]).T @ full + np.diag(pen) + 1e-12 * np.eye(21),
                             full.T @ ((p - y) * rows) + pen * v)
    assert abs(loss(np.append(w, b)) - loss(v)) < 1e-4


def test_hashed_counts_agree_with_one_by_one():
    texts = [b"", b"a", b"abcabc", b"zz top"]
    got = hashed_counts(texts, (1, 2, 3), 64)
    for t, row in zip(texts, got):
        want = np.zeros(64)
        for n in (1, 2, 3):
            for h in ngram_hashes(np.frombuffer(t, np.uint8), n):
                want[int(h) & 63] += 1
        assert (row == want).all()
    long = b"lorem ipsum " * 60_000  # more than one slice
    one = hashed_counts([long], (2, 3), 256)[0]
    many = np.zeros(256)
    for n in (2, 3):
        many += np.bincount(ngram_hashes(np.frombuffer(long, np.uint8), n) & np.uint32(255), minlength=256)
    assert (one == many).all()


def test_shape():
    assert quality.shape(b"The the THE  12 a%%\nb b!") == b"Aa a A  0 a%%\na R!" or quality.shape(b"go go") == b"a R"
    assert quality.shape(b"") == b""


def test_base_spans_against_plain_patterns():
    plain = [re.compile(p) for p in (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def brute(t):
        out = []
        for k, p in enumerate(plain):
            for m in p.finditer(t):
                d = re.sub("[^0-9]", "", m.group())
                ok = (True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")),
                      14 <= len(d) <= 19 and pii._luhn(d), 10 <= len(d) <= 15)[k]
                if ok:
                    out.append((m.start(), k, m.end()))
        return sorted(out)

    r = random.Random(1)
    for _ in range(20_000):
        t = "".join(r.choice(["a", "@", ".", "1", "23", "255", "0", "+", "-", " ", "(", ")", "b.c", "4111111111111111", "\n"])
                    for _ in range(r.randint(1, 14)))
        assert pii.base_spans(t) == brute(t)
    assert pii.base_spans("9" * 200_000 + "a" * 200_000) == []  # long runs take linear time


def test_secrets_found(spark, texts):
    got = {r["doc_id"]: r["spans"] for r in queries.QUERIES["op9_pii_weak_labels"](spark, SF01).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    for i, t in docs.items():
        for m in re.finditer(r'AKIA[0-9A-Z]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = ")[0-9a-f]{40}', t):
            assert f"secret:{m.start()}:{m.end()}" in got[i]


def test_pii_gradient_takes_all_pairs(spark):
    """More pairs than the 20,000 that were once kept; each counts in the gradient."""
    n = 30_000
    pairs = spark.range(n).selectExpr("if(id < 20000, '1', '2') AS votes", "array(int(id % 500), 511) AS slots", "1L AS n")
    loss, got, bend = pii._sums(pairs, {"1": 0.0, "2": 1.0}, np.zeros(pii.SLOTS + 1))
    assert got[-1] == 20_000 * 0.5 - 10_000 * 0.5 and got[511] == got[-1] and got[:500].sum() == got[-1]
    assert abs(loss - n * np.log(2)) < 1e-6 and bend[-1, -1] == bend[511, 511] == bend[511, -1] == n / 4
    assert (bend == bend.T).all() and (np.diag(bend)[:500] == 15).all() and bend[0, 1] == 0


def test_pii_estimates_row_by_row():
    """EM over counts of patterns equals EM over the rows themselves, posteriors from plain products."""
    r = np.random.default_rng(5)
    truth = r.random(800) < 0.3
    rows = np.stack([np.where(r.random(800) < 0.4, 0, np.where(truth ^ (r.random(800) < miss), 2, 1))
                     for miss in (0.05, 0.1, 0.2, 0.3)], 1)
    patterns, which, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    model = pii.estimate(patterns, counts.astype(float))
    q = [0.9 if (x == 2).sum() > (x == 1).sum() else 0.1 if (x == 1).sum() > (x == 2).sum() else 0.3 for x in rows]
    for _ in range(100):
        said = {}
        for j in range(4):
            for v in (1, 2):
                p = [(sum(w for w, x in zip(u, rows) if x[j] == v) + 1) / (sum(u) + 3) for u in ([1 - a for a in q], q)]
                said[j, v] = sorted(p, reverse=v == 1)
        prior = min(max(sum(q) / len(q), 0.05), 0.95)
        new = []
        for x in rows:
            p = [1 - prior, prior]
            for j, v in enumerate(x):
                if v:
                    p = [p[0] * said[j, v][0], p[1] * said[j, v][1]]
            new.append(p[1] / sum(p))
        moved, q = max(abs(a - b) for a, b in zip(q, new)), new
        if moved < 1e-9:
            break
    assert np.allclose(model.posterior(patterns)[which.ravel()], q, atol=1e-6)
    assert np.mean((np.array(q) > 0.5) == truth) > 0.85


def test_pii_added_spans_against_one_by_one(spark):
    """The spans that are added are those of a dense logistic regression on all candidates, one row each."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    found = [(r["doc_id"], r["text"], s) for r in docs.collect() for s in pii.candidates(r["text"], pii.base_spans(r["text"]))]
    patterns, which, counts = np.unique([pii.votes(t, s) for _, t, s in found], axis=0, return_inverse=True,
                                        return_counts=True)
    y = pii.estimate(patterns, counts.astype(float)).posterior(patterns)[which.ravel()]
    x = np.zeros((len(found), pii.SLOTS + 1))
    x[:, -1] = 1
    for row, (_, t, s) in zip(x, found):
        row[list(pii.span_features(t, s))] = 1
    ridge, w = np.append(np.full(pii.SLOTS, pii.RIDGE), 1e-9), np.zeros(pii.SLOTS + 1)
    for _ in range(400):  # an upper bound of the Hessian: each step lessens the loss
        p = 1 / (1 + np.exp(-x @ w))
        bend = x.T @ (x * np.maximum(p * (1 - p), 0.02)[:, None]) / len(x) + np.diag(ridge)
        w -= 0.5 * np.linalg.solve(bend, x.T @ (p - y) / len(x) + ridge * w)
    z = x @ w
    want = {(i, pii.written([s])) for (i, _, s), v in zip(found, z) if v > 0.02}
    unsure = {(i, pii.written([s])) for (i, _, s), v in zip(found, z) if abs(v) <= 0.02}
    got = {(r["doc_id"], s) for r in queries.QUERIES["op9_pii_weak_labels"](spark, SF01).collect()
           for s in r["spans"].split(",") if s.split(":")[0] in ("secret", "number")}
    assert want and want <= got <= want | unsure


def test_quality_votes_one_by_one(spark):
    """Scores against sorted lists of plain cosines; copies with unlike labels are equally near, and smaller ids vote."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    model.vectors = np.vstack([model.vectors] * 3)  # each labelled vector thrice, with labels of their own
    n = len(model.label)
    model.label, model.weight = np.concatenate([model.label, 1 - model.label, np.ones(n)]), np.ones(3 * n)
    data = [r["text"].encode() for r in docs.orderBy("doc_id").collect()]
    lat = (quality.hashed_vectors(data) - model.mean) @ model.axes
    for v, got in zip(lat, model.scores(data)):
        near = [float(np.dot(v, u) / np.linalg.norm(v)) for u in model.vectors]
        top = sorted(range(3 * n), key=lambda k: (-round(near[k % n], 5), k))[:10]
        vote = [max(near[k], 0) ** 4 for k in top]
        assert sum(vote) == 0 or abs(sum(a * model.label[k] for a, k in zip(vote, top)) / sum(vote) - got) < 0.11


def test_language_base_and_order(spark, texts):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op7_lm_context_mixing"](spark, SF).collect()}
    tokens = {i: WORD.findall(t.encode().lower()) + [None] for i, t in texts.items()}
    learnt = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in learnt for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, w in tokens.items():
        assert rows[i]["n_tokens"] == len(w) and rows[i]["train_tokens"] == n
        assert rows[i]["n_known"] == sum(c[x] > 0 for x in w)
        assert abs(rows[i]["base_score"] - sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6
    held = [i for i in tokens if i not in learnt]
    bits = -sum(rows[i]["score"] for i in held) * np.log2(10) / sum(len(b" ".join(tokens[i][:-1])) + 1 for i in held)
    assert bits < 3.2  # bits per byte of texts that weren't learnt


def counts_of(items, n, borders=None, room=8):
    """What a corpus of these items says, from plain dictionaries, with tables that are large enough to have no collisions."""
    s, _ = lm._symbols(items, n)
    tables = []
    for c in s.context:
        seen = np.zeros((1 << 20, 2))
        sym, entry = lm._entry(s.byte)
        np.add.at(seen, (lm._hashes(c, sym, lm.NODE[entry]) >> np.uint64(44), lm.BIT[entry]), s.weight[sym])
        tables.append(lm._codes(seen[:, 0], seen[:, 1]))
    borders = np.zeros(0, np.uint64) if borders is None else borders
    shared = lm._among(s.word, borders)
    return lm.Counts(tables, borders, s.word[shared], s.weight[shared])


def test_language_exact_counts_without_sorts_match_dictionaries(monkeypatch):
    """Bits behind beginnings with one byte, several and none learnt, counted for few beginnings at a time."""
    monkeypatch.setattr(lm, "GROUPS_AT_ONCE", 3)
    rng = np.random.default_rng(3)
    begin = np.sort(rng.integers(0, 1 << 55, 60, dtype=np.uint64)) << np.uint64(8)
    pair = np.unique(np.concatenate([b | rng.integers(0, 256, 1 + k % 4, dtype=np.uint64) for k, b in enumerate(begin)]))
    n = rng.choice([0, 1, 2, 15, 16, 40, 4095, 4096, 123_456_789], len(pair))
    seen = Counter()
    path = [[(int(p) >> 8, int(lm.NODE[e]), int(lm.BIT[e])) for e in lm._entry(np.array([int(p) & 255]))[1]] for p in pair]
    for steps, m in zip(path, n.tolist()):
        for step in steps:
            seen[step] += m
    want = [lm._codes(*np.array([[seen[b, node, 0]], [seen[b, node, 1]]]))[0] for steps in path for b, node, _ in steps]
    assert lm._exact(pair, n).tolist() == want
    assert all(lm._codes(np.array([m]), np.array([0]))[0] >> 8 == np.searchsorted(lm._BETWEEN, m) for m in n)
    key = rng.integers(0, 40, 500)
    for got, of in zip(lm._distinct(key), np.unique(key, return_index=True, return_inverse=True)):
        assert (got == of).all()


def test_language_items_add_up_over_steps(monkeypatch):
    """However small the steps and what is held, the items of learnt and other texts are counted once per task's share."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, 40)).encode() for _ in range(50)] + [b""]
    out = [k % 5 == 0 for k in range(51)]

    def counted(size):
        got, rows = Counter(), 0
        for at in range(0, 51, size):
            batch = pa.record_batch({"t": pa.array(texts[at:at + size], pa.binary()), "out": pa.array(out[at:at + size])})
            for b in lm._count_items([batch]):
                rows += b.num_rows
                for w, m, x in zip(*(b.column(c).to_pylist() for c in ("word", "mark", "n"))):
                    got[w, m] += x
        return got, rows

    want, items = counted(51)
    assert items == len(want) and sum(want.values()) == sum(len(t.split()) + 1 for t, o in zip(texts, out) if not o)
    monkeypatch.setattr(lm, "STEP_BYTES", 300)
    monkeypatch.setattr(lm, "HELD", 50)
    got, rows = counted(17)
    assert got == want and set(got) == set(want) and rows > items


def test_language_probabilities_sum_to_one():
    """Over all bytes that may follow a beginning, whatever was learnt."""
    items, n = [b"the \0\1", b"then \0\1", b"of \0\2", b"that \0\1"], np.array([3, 2, 4, 1])
    counts, mixer = counts_of(items, n), lm.Mixer()
    s, _ = lm._symbols(items, n)
    mixer.learn(s, counts.of_part(s))
    for begin in (b"", b"t", b"th", b"xyz"):
        every = [begin + bytes((b,)) + b" \0\1" for b in range(256)]
        x, which = lm._symbols(items + every, np.append(n, np.zeros(256, np.int64)))
        lp = mixer.log10(x, counts.of_part(x), mixer.refined())[which]
        at = sum(len(i) - 2 for i in items) + np.arange(256) * (len(begin) + 2) + len(begin)
        assert abs((10 ** lp[at]).sum() - 1) < 1e-4


def test_language_own_occurrence_is_taken_out():
    """What predicts an occurrence while weights are learnt is the table entry without it."""
    for n0, n1 in ((0, 1), (3, 0), (2, 9), (15, 15)):
        code = int(lm._codes(np.array([n0]), np.array([n1]))[0])
        for k in range(lm.K):
            assert lm.ENTRY_WITHOUT[k][code] == lm.ENTRY[k][int(lm._codes(np.array([max(n0 - 1, 0)]), np.array([n1]))[0])]
            assert lm.ENTRY_WITHOUT[k][65536 + code] == lm.ENTRY[k][int(lm._codes(np.array([n0]), np.array([max(n1 - 1, 0)]))[0])]
    big = lm._COUNT[lm._codes(np.array([0]), np.array([123_456_789]))[0] & 255]
    assert abs(big / 123_456_789 - 1) < 0.06


def test_words_so_far_are_counted_exactly():
    """Parts of items, with what is behind the beginnings across their border, give the codes of one exact count."""
    r = np.random.default_rng(5)
    c = Counter(bytes(w) for w in r.integers(97, 100, (4000, 5), dtype=np.uint8)) + Counter({b"ab": 7, b"a": 3, b"abc": 4})
    items = sorted(w + b" " + bytes((0, m)) for w in c for m in range(2))
    n = np.array([c[i[:-3]] + i[-1] for i in items])
    behind, marked = Counter(), Counter()
    for i, m in zip(items, n.tolist()):
        for k in range(len(i) - 2):
            behind[i[:k], i[k]] += m
            marked[i[:k], i[k], i[-1]] += m
    whole, which = lm._symbols(items, n)
    assert len(whole.marked) == len(marked) and sorted(whole.weight) == sorted(marked.values())
    assert len(set(whole.word.tolist())) == len(behind) and len(which) == sum(len(i) - 2 for i in items)
    cut = next(k for k in range(len(items) // 2, len(items)) if items[k - 1][:-3] != items[k][:-3])
    borders = lm._beginnings([(items[cut - 1][:-3], items[cut][:-3])])
    one, many = counts_of(items, n).of_part(whole), counts_of(items, n, borders)
    shared = set(whole.marked[lm._among(whole.word, borders)].tolist())
    assert 0 < len(shared) < len(whole.marked)
    sym, _ = lm._entry(whole.byte)
    want = {}
    for m, w, k in zip(whole.marked[sym].tolist(), one[3].tolist(), one[4].tolist()):
        want.setdefault(m, []).append((w, k))
    for part in (slice(0, cut), slice(cut, None)):
        s, _ = lm._symbols(items[part], n[part])
        of_part, got = many.of_part(s), {}
        for m, w, k in zip(s.marked[lm._entry(s.byte)[0]].tolist(), of_part[3].tolist(), of_part[4].tolist()):
            got.setdefault(m, []).append((w, k))
        for m, codes in got.items():
            assert codes == [(w, 0 if m in shared else k) for w, k in want[m]]


def test_language_contexts():
    """Two and four bytes, the mark and two bytes, the word so far without and with the mark."""
    s, which = lm._symbols([b"abcde \0\1", b"xbcde \0\1", b"abcde \0\2"], np.array([1, 1, 1]))
    a, b, c = which[[4, 10, 16]]  # the "e" of each
    assert [x[a] == x[b] for x in s.context] == [True, False, True] and s.word[a] != s.word[b]
    assert [x[a] == x[c] for x in s.context] == [True, True, False] and s.word[a] == s.word[c]
    assert len({s.marked[x] for x in (a, b, c)}) == 3


def test_language_marks():
    """The mark is the last short word ahead; a text begins without one."""
    texts = [b"Le petit chat de la maison", b"maison", b"", b"the end"]
    want = Counter()
    for t in texts:
        mark = 0
        for w in [*t.lower().split(), b""]:
            want[(w + b" " if w else lm.END) + mark.to_bytes(2)] += 1
            mark = lm.mark_of(w) if len(w) <= lm.MARK_BYTES else mark
    step = lm._step(texts)
    assert Counter(dict(zip(step.items, np.bincount(step.ids).tolist()))) == want
    assert step.size.tolist() == [7, 2, 1, 3]


@pytest.mark.parametrize("sf", [SF01, "/root/testdata/sf0.1"])
def test_language_beats_its_base(spark, sf):
    """Held-out texts take fewer bits than by the unigram base."""
    rows = queries.QUERIES["op7_lm_context_mixing"](spark, sf).where("held_out").selectExpr("sum(score)", "sum(base_score)")
    score, base = rows.first()
    assert base < score < 0


def test_language_order_of_words(spark, texts):
    """Held-out texts with their words shuffled are less likely."""
    held = {i: t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 == 2}
    r = random.Random(3)
    docs = [(i, t, 0) for i, t in texts.items()]
    docs += [(i, " ".join(r.sample(t.split(), len(t.split()))), 1) for i, t in held.items()]
    rows = lm.score_language(spark.createDataFrame(docs, "doc_id long, text string, turn int")).where("held_out").collect()
    per = {}
    for row in rows:
        per.setdefault(row["doc_id"], []).append((row["base_score"], row["score"]))
    assert all(len(v) == 2 and abs(v[0][0] - v[1][0]) < 1e-6 for v in per.values())
    assert sum(abs(a[1] - b[1]) > 1e-3 for a, b in per.values()) > 0.9 * len(per)


def test_packed_ids(spark, texts):
    rows = queries.QUERIES["op6_pack_hilbert"](spark, SF).collect()
    enc = encoder(tokenizer_dir(), "byte_bpe_50k")
    per = {}
    for r in rows:
        per.setdefault(r["doc_id"], []).append(r)
    total = 0
    for i, t in texts.items():
        ids = np.array(enc.whole.encode(t, add_special_tokens=False).ids + [1], dtype="<u4")
        total += len(ids)
        for r in per[i]:
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())
        assert sum(r["length"] for r in per[i]) == len(ids)
    assert len({r["sequence_id"] for r in rows}) == -(-total // 2048)


def test_special_token_strings():
    enc = encoder(tokenizer_dir(), "byte_bpe_50k")
    t = "a <|endoftext|> b"
    assert enc.ids(t).tolist() == enc.whole.encode(t, add_special_tokens=False).ids


def test_hilbert_neighbours():
    """Consecutive cells of the curve differ by one step on one axis, and each cell has its own key."""
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
