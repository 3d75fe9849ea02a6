"""Mixing sources to target weights by hash thresholds from nested token histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stowage.llm.common import WORD, fresh, row_seq, stage_table

#: Hex digits of a hash that one histogram level looks at (4,096 buckets), and of a whole key.
STEP, KEY = 3, 30


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(doc_id: Column, seq: Column) -> Column:
    """30 hex digits: 15 of the id's md5, then 15 of the row number's, which only tell repeated ids apart."""
    return F.concat(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15),
                    F.substring(F.md5(seq.cast("string").cast("binary")), 1, 15))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Target words of each source: ``share`` of all words by weight, at most ``most`` times its own.

    ``sizes``: source, size.  Sources by code point, null last, weigh ``weights`` in
    turn.  What a full source can't take is shared anew by weight; with sources
    sorted by cap per weight this is one running sum instead of a loop: the first
    source that stays below its cap fixes the level of all that follow.
    Returns source, source_size, weight, target.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    src = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
           .withColumn("rank", F.row_number().over(by_name) - 1)
           .withColumn("weight", F.element_at(w, (F.col("rank") % len(weights) + 1).cast("int")))
           .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
           .withColumn("per", F.col("cap") / F.col("weight")))
    by_per = W.orderBy("per", "rank")
    src = (src.withColumn("all", F.lit(float(share)) * F.sum("source_size").over(W.partitionBy()))
           .withColumn("left", F.col("all") - F.coalesce(
               F.sum("cap").over(by_per.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
           .withColumn("heavy", F.sum("weight").over(by_per.rowsBetween(0, W.unboundedFollowing)))
           .withColumn("open", F.col("weight") * F.col("left") / F.col("heavy") < F.col("cap"))
           .withColumn("first", F.min(F.when(F.col("open"), F.struct("per", "rank", "left", "heavy")))
                       .over(W.partitionBy())))
    below = F.struct("per", "rank") < F.struct(F.col("first.per").alias("per"), F.col("first.rank").alias("rank"))
    return src.select("source", "source_size", "weight",
                      F.when(F.col("first").isNull() | below, F.col("cap"))
                      .otherwise(F.col("weight") * F.col("first.left") / F.col("first.heavy")).alias("target"))


def hash_thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each (source, budget) the cut such that rows with key < cut hold about ``budget`` words.

    ``rows``: source, size, key; ``budgets``: source, budget (several budgets of a
    source get nested cuts, as a cut grows with its budget).  Words are summed by
    source and hash bucket; the bucket in which the running sum passes the budget is
    refined by the next digits of the key, and only this one, until it holds one row,
    which is taken if that comes nearer.  No rows are sorted or collected: each
    level is an aggregate of at most 4,096 rows for a source and budget.

    Returns source, budget, cut.
    """
    cols = ["source", "budget"]
    open_ = stage_table(budgets.select("source", "budget", F.lit("").alias("prefix"),
                                       F.col("budget").cast("double").alias("left")).distinct(), "mix-open")
    done = []
    for level in range(KEY // STEP):
        at = level * STEP
        here = F.substring("key", at + 1, STEP)
        o = open_.select(F.col("source").alias("osource"), "budget", "prefix", "left")
        inside = rows.withColumn("head", F.substring("key", 1, at))
        if level:
            border = o.select("osource", F.col("prefix").alias("opre")).distinct()
            inside = inside.join(border, F.col("source").eqNullSafe(F.col("osource")) &
                                 (F.col("head") == F.col("opre")), "left_semi")
        hist = inside.groupBy("source", "head", here.alias("bucket")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        by = W.partitionBy("source", "budget").orderBy("bucket")
        found = (hist.join(o, F.col("source").eqNullSafe(F.col("osource")) & (F.col("head") == F.col("prefix")))
                 .withColumn("upto", F.sum("size").over(by.rowsBetween(W.unboundedPreceding, 0)))
                 .where(F.col("upto") >= F.col("left"))  # only buckets from the border on
                 .withColumn("nth", F.row_number().over(by)).where("nth = 1")
                 .select("source", "budget", F.concat("prefix", "bucket").alias("prefix"), "size", "n",
                         (F.col("left") - F.col("upto") + F.col("size")).alias("left")))
        found = stage_table(found, f"mix-level{level}")
        single = (F.col("n") == 1) if at + STEP < KEY else F.lit(True)
        # "~" sorts after every hex digit: prefix~ takes the whole bucket in
        done.append(found.where(single).select(*cols, F.when(2 * F.col("left") >= F.col("size"),
                                                             F.concat("prefix", F.lit("~")))
                                               .otherwise(F.col("prefix")).alias("cut")))
        open_ = found.where(~single).select("source", "budget", "prefix", "left")
        if open_.isEmpty():
            break
    cuts = done[0]
    for d in done[1:]:
        cuts = cuts.unionByName(d)
    return stage_table(cuts, "mix-cuts")


def mixture(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
            id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
    """(rows, plan): the sized rows and, per source, how often a row is taken.

    ``rows``: id, source, size, key, one per document.  ``plan``: source, source_size,
    target, whole (times every row is taken), cut (rows with key < cut once more).
    """
    rows = stage_table(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                                   token_count(F.col(text_col)).alias("size"),
                                   mix_key(F.col(id_col), row_seq()).alias("key")), "mix-rows")
    targets = (source_targets(rows, weights, share, most)
               .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                           .otherwise(F.lit(0)))
               .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))
    targets = stage_table(targets, "mix-targets")
    cuts = hash_thresholds(rows, targets.where("budget > 0").select("source", "budget"))
    c = cuts.select(F.col("source").alias("csource"), "cut")
    plan = (targets.join(c, F.col("source").eqNullSafe(F.col("csource")), "left")
            .select(F.col("source").alias("psource"), "source_size", "target", "whole",
                    F.coalesce("cut", F.lit("")).alias("cut")))
    return rows, stage_table(plan, "mix-plan")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document a mix of all sources takes.

    The size of a document is its number of words.  The mix has ``share`` times the
    words of all documents, shared among the sources by ``weights`` (see
    :func:`source_targets`).  Every document of a source is taken ``whole`` times, and those
    whose key lies below the source's cut once more, so no document is taken more
    than ``most`` (rounded up) times, and a source's words are within half the size
    of its border document of the target.

    Keys depend on the id alone, so reruns and larger corpora agree.  Null sources
    are one source, the last; null or empty texts have size 0 and add nothing; rows
    with equal ids share the key's first half and are told apart by their place in
    the input.  An empty table gives no rows.  Other columns are not read.

    Returns id_col, size, source, source_size, target, copies, taken.
    """
    rows, plan = mixture(docs, weights, share, most, id_col, text_col, source_col)
    copies = (F.col("whole") + F.when(F.col("key") < F.col("cut"), 1).otherwise(0)).cast("long")
    return (rows.join(plan, F.col("source").eqNullSafe(F.col("psource")))
            .select(F.col("id").alias(id_col), "size", "source", "source_size", "target", copies.alias("copies"),
                    (copies * F.col("size")).alias("taken")))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
                    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with the columns of ``docs``.

    Texts are not shuffled as long as the plan (a row per source) is small enough to
    be broadcast by its measured size.
    """
    _, plan = mixture(docs, weights, share, most, id_col, text_col, source_col)
    src, seq, n = fresh(docs, "mix_source"), fresh(docs, "mix_key"), fresh(docs, "mix_nth")
    p = plan.select(F.struct("psource", "whole", "cut").alias("plan_")).toDF(fresh(docs, "mix_plan"))
    plan_col = p.columns[0]
    keyed = docs.withColumn(seq, mix_key(F.col(id_col), row_seq())).withColumn(src, F.col(source_col))
    copies = F.col(f"{plan_col}.whole") + F.when(F.col(seq) < F.col(f"{plan_col}.cut"), 1).otherwise(0)
    return (keyed.join(p, F.col(src).eqNullSafe(F.col(f"{plan_col}.psource")))
            .withColumn(n, F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
            .select(*docs.columns))
