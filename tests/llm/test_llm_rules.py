"""Adaptive limits of the quality rules against a plain computation, and groups that get limits of their own."""

import math
import random

import pytest

from stowage.llm import quality, rules
from corpus_pipeline import quality_stage


def fence_brute(values, slack):
    """One group's limits from its values, rounded to sketch buckets."""
    v = sorted(0.0 if x < rules.TINY else rules.GAMMA ** math.ceil(math.log(x) / math.log(rules.GAMMA)) * 2 / (1 + rules.GAMMA)
               for x in values)
    q1, q2, q3 = (v[math.ceil(q * len(v)) - 1] for q in (0.25, 0.5, 0.75))
    if q2 > q1:
        high = q2 + rules.SPREADS * max(q2 - q1, slack)
    else:
        above = [x for x in v if x >= q2]
        gaps = [math.sqrt((a + slack) * (b + slack)) - slack for a, b in zip(above, above[1:]) if b + slack > rules.GAP * (a + slack)]
        high = gaps[0] if gaps else v[-1] * rules.GAMMA
    return (q2 - rules.SPREADS * max(q3 - q2, slack) if q3 > q2 else -1.0), high


def features(text):
    n, chars, symbols, dup, again = rules.text_counts(text)
    m = max(n, 1)
    return {"word_length": chars / m, "symbols": symbols / m, "repeat_lines": dup / (text.count("\n") + 1), "repeat_words": again / m}


def kept_brute(docs):
    sound = []
    for k, (text, lang, source) in enumerate(docs):
        n, *_, again = rules.text_counts(text or "")
        if not (n < 50 or 100 * again > 50 * n):
            sound.append((k, lang, source, features(text)))
    kept = set()
    for k, lang, source, own in sound:
        ok = True
        for f, x in own.items():
            for group in ([s for s in sound if s[1:3] == (lang, source)], [s for s in sound if s[1] == lang], sound):
                if len(group) >= rules.LEAST:
                    break
            low, high = fence_brute([s[3][f] for s in group], rules.SLACK[f])
            ok &= low <= x <= high
        if ok:
            kept.add(k)
    return kept


def corpus():
    """Two sources of unlike habits: one uses symbols as a matter of course, the other never; both hold some junk."""
    r = random.Random(9)

    def text(letters, symbols, lines=4, n=120):
        words = ["".join(r.choices("abcdefgh", k=max(1, int(r.gauss(letters, 1))))) for _ in range(n)]
        for k in r.sample(range(n), symbols):
            words[k] += "#"
        size = n // lines
        return "\n".join(" ".join(words[k:k + size]) for k in range(0, n, size))

    docs = [(text(5, r.randint(20, 60)), "en", "code") for _ in range(120)] + [(text(6, 0), "en", "news") for _ in range(120)]
    docs += [(text(5, 40), "en", "news") for _ in range(6)]      # as many symbols as code has: junk among news
    docs += [(text(14, 0), "en", "news") for _ in range(5)]      # long words
    docs += [(text(6, 0), "de", "blog") for _ in range(20)] + [(text(6, 0), "de", "web") for _ in range(40)]  # small groups
    docs += [(text(6, 0) + "\n" + " ".join(["again and again"] * 30), "en", "news") for _ in range(4)]
    docs += [(None, "en", "news"), ("", None, None), ("too short", "en", "code"), (text(6, 0), None, None)]
    return docs


def test_kept_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(k, *d) for k, d in enumerate(docs)], "doc_id long, text string, lang string, source string")
    rows = {r["doc_id"]: r for r in rules.apply_rules(df).collect()}
    want = kept_brute(docs)
    assert {k for k, r in rows.items() if r["kept"]} == want
    code = [k for k, d in enumerate(docs) if d[2] == "code" and len(d[0]) > 20]
    odd = [k for k, d in enumerate(docs) if d[2] == "news" and d[0] and d[0].count("#") == 40]
    assert sum(k in want for k in code) > 110 and not any(k in want for k in odd)  # the same symbols, other verdicts


def test_limits_follow_the_group(spark):
    df = spark.createDataFrame([(k, *d) for k, d in enumerate(corpus())], "doc_id long, text string, lang string, source string")
    _, value = None, rules._features()
    counted = df.select("lang", "source", rules.counts_col(df.text).alias("c")).select("lang", "source", "c.*").where("n_words >= 50")
    sk = rules.sketch(counted.select("lang", "source", *[c.alias(k) for k, c in value.items()]), ["lang", "source"], list(value))
    got = {(r["lang"], r["source"]): r["limits"] for r in rules.limits(sk).collect()}
    assert got["en", "code"]["symbols"]["high"] > 3 * got["en", "news"]["symbols"]["high"]
    assert got["en", "code"]["word_length"] != got["en", "news"]["word_length"]


@pytest.mark.parametrize("table,at_least", [("sf0.1", 0.6)])
def test_most_limits_come_from_the_sketch(spark, table, at_least):
    """In the given documents most limits are those of one group alone (the values are rounded to buckets)."""
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    value = rules._features()
    counted = docs.select("lang", "source", rules.counts_col(docs.text).alias("c")).select("lang", "source", "c.*").where(
        "n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words")
    sk = rules.sketch(counted.select("lang", "source", *[c.alias(k) for k, c in value.items()]), ["lang", "source"], list(value))
    own = [r for r in rules.fences(sk, ["lang", "source"]).collect() if r["rows"] >= rules.LEAST]
    for f in ("word_length", "symbols", "repeat_words"):
        found = [(r["low"], r["high"]) for r in own if r["feature"] == f]
        assert len(set(found)) >= at_least * len(found)


def test_without_labels_all_documents_stay(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (3, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_quality(docs, none).count() == 3
    strangers = spark.createDataFrame([(77, 0, 0), (78, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep_quality(docs, strangers).count() == 3
    none.write.parquet(f"{tmp_path}/labels.parquet")
    assert quality_stage(spark, docs, str(tmp_path)).count() == 3
