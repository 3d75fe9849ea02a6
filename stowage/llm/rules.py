"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stowage.llm.common import WORD, bound_batches, stage_table

_WORD = re.compile(WORD)
_SYMBOL = re.compile(r"[#*$%&|<>]")

#: Relative width of a sketch bucket, and values that a bucket can't tell from zero.
GAMMA, TINY = 1.002, 1e-6
#: Least rows of a (language, source) sketch; smaller groups take the merged sketch of their language, or of all.
LEAST = 50
#: Features, and what guards a limit against a spread or a value near zero (in the feature's unit).
SLACK = {"word_length": 0.01, "symbols": 0.1, "repeat_lines": 0.15, "repeat_words": 0.15}
#: Spreads between the median and a limit, and the factor between neighbouring values that makes a gap.
SPREADS, GAP = 12, 3.0


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = _WORD.findall(text)
    n = len(words)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif _WORD.search(line):
            seen.add(line)
    first: dict[tuple[str, str, str], int] = {}
    again = bytearray(n)
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        j = first.setdefault(window, i)
        if j != i:
            again[i:i + 3] = again[j:j + 3] = b"\1\1\1"
    return n, sum(map(len, words)), len(_SYMBOL.findall(text)), dup, sum(again)


def counts_col(text: Column) -> Column:
    @F.arrow_udf("struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long, "
                 "n_lines: long>")
    def count(texts: pa.Array) -> pa.Array:
        rows = [(*text_counts(t or ""), (t or "").count("\n") + 1) for t in texts.to_pylist()]
        cols = zip(*rows) if rows else [[]] * 6
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                          names=["n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                 "n_repeat_words", "n_lines"])

    return count.asNondeterministic()(text)


def _features() -> dict[str, Column]:
    n = F.greatest("n_words", F.lit(1))
    return {"word_length": F.col("word_chars") / n, "symbols": F.col("n_symbols") / n,
            "repeat_lines": F.col("n_dup_lines") / F.col("n_lines"), "repeat_words": F.col("n_repeat_words") / n}


def sketch(rows: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """A quantile sketch of each feature for each group: (by, feature, bucket, n).

    A bucket holds the values from GAMMA ** (bucket - 1) to GAMMA ** bucket, bucket null those
    below TINY, so a quantile is known within 0.1 %.  Sketches merge by adding the counts of equal
    buckets, which is what Spark's partial aggregation does, in any order and with the same result.
    """
    long = rows.select(*by, F.explode(F.create_map(*[x for f in features for x in (F.lit(f), F.col(f))]))
                       .alias("feature", "value"))
    bucket = F.when(F.col("value") >= TINY, F.ceil(F.log("value") / math.log(GAMMA)).cast("int"))
    return long.groupBy(*by, "feature", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketches: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
    """Quantiles of sketches: (by, feature, rows, a column for each of ``at``); groups hold some hundred buckets."""
    w = W.partitionBy(*by, "feature")
    run = (sketches.withColumn("rows", F.sum("n").over(w))
           .withColumn("upto", F.sum("n").over(w.orderBy(F.col("bucket").asc_nulls_first())
                                               .rowsBetween(W.unboundedPreceding, 0))))
    value = F.coalesce(F.pow(F.lit(GAMMA), F.col("bucket")) * (2 / (1 + GAMMA)), F.lit(0.0))
    return run.groupBy(*by, "feature", "rows").agg(*[
        F.min(F.when(F.col("upto") >= q * F.col("rows"), value)).alias(name) for name, q in at.items()])


def fences(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Lowest and highest accepted value of each group's features: (by, feature, rows, low, high), all from its sketch.

    Where the values around the median differ, a limit lies SPREADS spreads from the median, a spread being the
    distance between the median and the quartile on the other side: up to half of a group may be junk, all of it on one
    side, without widening its own limit.  Where a quarter of the values below the median equal it (a feature that is zero
    in most texts), the highest value is where the sketch first has a gap above the median: two
    neighbouring values, each plus SLACK, of which one is GAP times the other; the limit is their geometric middle.
    Without a gap all values are accepted.
    """
    w = W.partitionBy(*by, "feature")
    up = w.orderBy(F.col("bucket").asc_nulls_first())
    slack = F.create_map(*[x for f, s in SLACK.items() for x in (F.lit(f), F.lit(s))])[F.col("feature")]
    value = F.coalesce(F.pow(F.lit(GAMMA), F.col("bucket")) * (2 / (1 + GAMMA)), F.lit(0.0))
    run = (sketches.withColumn("rows", F.sum("n").over(w)).withColumn("slack", slack).withColumn("value", value)
           .withColumn("upto", F.sum("n").over(up.rowsBetween(W.unboundedPreceding, 0)))
           .withColumn("next", F.lead("value").over(up)))
    for name, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75)):
        run = run.withColumn(name, F.min(F.when(F.col("upto") >= q * F.col("rows"), F.col("value"))).over(w))
    v, n, s = F.col("value") + F.col("slack"), F.col("next") + F.col("slack"), F.col("slack")
    gap = F.when((F.col("value") >= F.col("q2")) & (n > GAP * v), F.sqrt(v * n) - s)
    per = run.groupBy(*by, "feature", "rows", "slack", "q1", "q2", "q3").agg(
        F.min(gap).alias("gap"), (F.max("value") * GAMMA).alias("top"))
    high = F.when(F.col("q2") > F.col("q1"), F.col("q2") + SPREADS * F.greatest(F.col("q2") - F.col("q1"), s)).otherwise(
        F.coalesce("gap", "top"))
    low = F.when(F.col("q3") > F.col("q2"), F.col("q2") - SPREADS * F.greatest(F.col("q3") - F.col("q2"), s)).otherwise(-1.0)
    return per.select(*by, "feature", "rows", low.alias("low"), high.alias("high"))


def limits(sketches: DataFrame) -> DataFrame:
    """(lang, source, limits): for each group a map from feature to its lowest and highest accepted value.

    The limits are the :func:`fences` of the group's own sketch; a group with fewer than LEAST rows takes those of the
    merged sketch of its language, then of all.
    """
    group = fences(sketches, ["lang", "source"])
    lang = fences(sketches.groupBy("lang", "feature", "bucket").agg(F.sum("n").alias("n")), ["lang"])
    all_ = fences(sketches.groupBy("feature", "bucket").agg(F.sum("n").alias("n")), [])
    g, l, a = group.alias("g"), lang.alias("l"), all_.alias("a")
    joined = (g.join(l, F.col("g.lang").eqNullSafe(F.col("l.lang")) & (F.col("g.feature") == F.col("l.feature")))
              .join(a, F.col("g.feature") == F.col("a.feature")))
    pick = {x: F.when(F.col("g.rows") >= LEAST, F.col(f"g.{x}")).when(F.col("l.rows") >= LEAST, F.col(f"l.{x}"))
            .otherwise(F.col(f"a.{x}")) for x in ("low", "high")}
    return (joined.select(F.col("g.lang").alias("lang"), F.col("g.source").alias("source"),
                          F.col("g.feature").alias("feature"), *[c.alias(x) for x, c in pick.items()])
            .groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct(
                "feature", F.struct("low", "high")))).alias("limits")))  # one entry per feature


def _judged(docs: DataFrame, keep: list[Column], text_col: str, lang_col: str, source_col: str):
    """(rows with counts and base_failed, limits of their groups)."""
    bound_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
                       counts_col(F.col(text_col)).alias("c")).select("*", "c.*").drop("c")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stage_table(rows.withColumn("base_failed", failed), "rules-rows")
    f = _features()
    sound = rows.where(~F.col("base_failed")).select("lang", "source", *[c.alias(k) for k, c in f.items()])
    lim = stage_table(limits(stage_table(sketch(sound, ["lang", "source"], list(f)), "rules-sketch")), "rules-limits")
    lim = lim.select(F.col("lang").alias("llang"), F.col("source").alias("lsource"), "limits")
    inside = F.lit(True)
    for name, value in f.items():
        inside &= value.between(F.col("limits")[name]["low"], F.col("limits")[name]["high"])
    judged = rows.join(lim, F.col("lang").eqNullSafe(F.col("llang")) & F.col("source").eqNullSafe(F.col("lsource")),
                       "left")
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                source_col: str = "source") -> DataFrame:
    """Judge every whole text: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A text fails at once if it has fewer than 50 words or over half of its words lie in repeated
    3-word windows.  The others are kept if mean word length, symbols per word, share of repeated
    lines and share of repeated words lie within the limits of their language and source,
    which follow from quantile sketches of these features (see :func:`limits`).

    Null texts have no words and fail; null languages and sources are groups of their own; repeated
    rows are judged alike, and values on a limit are kept; very long texts are counted whole; an empty table gives no
    rows.  Other columns are not read.
    """
    return _judged(docs, [F.col(id_col).alias("id_")], text_col, lang_col, source_col).select(
        F.col("id_").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")
