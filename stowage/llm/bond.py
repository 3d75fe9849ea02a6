"""Hard negatives by vertical scans: dimensions in columns, read in each anchor's order, candidates pruned by bounds."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stowage.llm.blocks import BlockTable, blocks_of
from stowage.llm.common import bound_batches, stage_table
from stowage.llm.vectors import finite_rows, matrix

#: Rows of a column block, and its bytes where vectors are long; anchors of a block, and their bytes.
ROWS, ROW_BYTES, ANCHORS, ANCHOR_BYTES = 4096, 16 << 20, 1024, 16 << 20
#: Dimensions read between two looks at the candidates.
STEP = 8
#: Doubles hold integers up to here exactly.
EXACT = 2.0 ** 53

_BLOCK = pa.schema([("low", pa.int64()), ("high", pa.int64()), ("ids", pa.binary()), ("seqs", pa.binary()),
                    ("labels", pa.binary()), ("cols", pa.binary()), ("least", pa.binary()), ("most", pa.binary())])


def column_blocks(rows: DataFrame, dims: int) -> DataFrame:
    """Rows (id, seq, label, v) as blocks of at most ROWS rows: a column per dimension with its least and largest value.

    Rows are range-partitioned by (label, seq), so that most blocks hold one label and a label with very many rows
    spreads over partitions.
    """
    size = max(1, min(ROWS, ROW_BYTES // (8 * dims)))

    def run(batches):
        held: list[tuple] = []
        count = 0

        def block(ids, seqs, labels, m):
            by = np.lexsort((seqs, ids))  # columns of a block go by id: equal scores resolve in this order
            cols = np.ascontiguousarray(m[by].T)
            pack = lambda x, t: x.astype(t).tobytes()
            return pa.RecordBatch.from_pylist([{
                "low": int(labels.min()), "high": int(labels.max()), "ids": pack(ids[by], "<i8"),
                "seqs": pack(seqs[by], "<i8"), "labels": pack(labels[by], "<i8"), "cols": pack(cols, "<f8"),
                "least": pack(cols.min(1), "<f8"), "most": pack(cols.max(1), "<f8")}], schema=_BLOCK)

        for b in batches:
            held.append((*(b.column(c).to_numpy() for c in ("id", "seq", "label")), matrix(b.column("v"), dims)))
            count += b.num_rows
            while count >= size:
                whole = [np.concatenate(x) for x in zip(*held)]
                yield block(*(x[:size] for x in whole))
                held, count = [tuple(x[size:] for x in whole)], count - size
        if count:
            yield block(*(np.concatenate(x) for x in zip(*held)))

    return (rows.repartitionByRange("label", "seq").sortWithinPartitions("label", "seq")
            .select("id", "seq", "label", "v")
            .mapInArrow(run, "low long, high long, ids binary, seqs binary, labels binary, cols binary, least binary, "
                             "most binary"))


class Block(NamedTuple):
    low: int
    high: int
    ids: np.ndarray
    seqs: np.ndarray
    labels: np.ndarray
    cols: np.ndarray
    least: np.ndarray
    most: np.ndarray


def _unpack(batches, exact: bool):
    for b in batches:
        for r in b.to_pylist():
            ids = np.frombuffer(r["ids"], "<i8")
            parts = [np.frombuffer(r["cols"], "<f8").reshape(-1, len(ids)), np.frombuffer(r["least"], "<f8"),
                     np.frombuffer(r["most"], "<f8")]
            if not exact:  # Python's integers
                parts = [np.vectorize(int, otypes=[object])(p) for p in parts]
            yield Block(r["low"], r["high"], ids, np.frombuffer(r["seqs"], "<i8"), np.frombuffer(r["labels"], "<i8"),
                        *parts)


def vertical_scan(block: Block, anchor: np.ndarray, order: np.ndarray, alive: np.ndarray, prune):
    """Exact scores of the candidates that ``prune`` leaves: (rows, scores).

    The dimensions are read in ``order``, STEP at a time.  After each step a candidate's score lies between its partial
    score plus the least, and plus the largest, that the unread dimensions can add in this block; ``prune(low, high)``
    gets these bounds and returns the bitmap of those to go on with.
    """
    a, least, most = anchor[order], block.least[order], block.most[order]
    low, high = np.minimum(a * least, a * most), np.maximum(a * least, a * most)
    rest_low, rest_high = low.sum() - np.cumsum(low), high.sum() - np.cumsum(high)
    partial = np.zeros(len(alive), dtype=block.cols.dtype)
    for at in range(0, len(order), STEP):
        end = min(at + STEP, len(order))
        partial = partial + a[at:end] @ block.cols[order[at:end]][:, alive]
        if end < len(order):
            keep = prune(partial + rest_low[end - 1], partial + rest_high[end - 1])
            if not keep.all():
                alive, partial = alive[keep], partial[keep]
                if not len(alive):
                    break
    return alive, partial


def _kth(values: np.ndarray, k: int):
    """The k-th largest value; None if there are fewer."""
    return None if len(values) < k else np.sort(values)[len(values) - k]


class _Best:
    """The k best (score, id, seq) so far, higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def add(self, scores, ids, seqs) -> None:
        by = np.argsort(-scores, kind="stable")[:self.k]  # rows of a block go by id
        self.rows = sorted([*self.rows, *((-scores[j], int(ids[j]), int(seqs[j])) for j in by)])[:self.k]

    def cut(self):
        return -self.rows[-1][0] if len(self.rows) == self.k else None


class _Anchor(NamedTuple):
    seq: int
    label: int
    vec: np.ndarray
    order: np.ndarray


def _anchors(rows, dims: int, exact: bool) -> list[_Anchor]:
    out = []
    for r in rows:
        vec = np.zeros(dims)
        vec[:len(r["v"])] = r["v"]
        order = np.argsort(-np.abs(vec), kind="stable")
        out.append(_Anchor(r["seq"], r["label"], vec if exact else np.array([int(x) for x in vec], dtype=object), order))
    return out


_FOUND = "anchor int, slot int, score decimal(38,0), id long, seq long"


def _found(best: list[list[_Best]]):
    rows = [(a, s, -r[0], r[1], r[2]) for a, slots in enumerate(best) for s, b in enumerate(slots) for r in b.rows]
    cols = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()),
         pa.array([int(x) for x in cols[2]], pa.decimal128(38, 0)), pa.array(cols[3], pa.int64()),
         pa.array(cols[4], pa.int64())], names=["anchor", "slot", "score", "id", "seq"])


def _scan_positives(anchors: list[_Anchor], k: int, exact: bool):
    """This task's k best rows of each anchor's own label."""
    def run(batches):
        best = [[_Best(k)] for _ in anchors]
        for block in _unpack(batches, exact):
            for a, (own,) in zip(anchors, best):
                if not block.low <= a.label <= block.high:
                    continue
                alive = np.flatnonzero((block.labels == a.label) & (block.seqs != a.seq))
                cut = own.cut()

                def prune(low, high):
                    here = _kth(low, k)
                    floor = max((x for x in (cut, here) if x is not None), default=None)
                    return np.ones(len(low), bool) if floor is None else (high >= floor).astype(bool)

                if len(alive):
                    rows, scores = vertical_scan(block, a.vec, a.order, alive, prune)
                    own.add(scores, block.ids[rows], block.seqs[rows])
        yield _found(best)
    return run


def _scan_negatives(anchors: list[_Anchor], windows: list[list[tuple]], k: int, low: int, high: int, exact: bool):
    """This task's k best rows of another label within each window of an anchor's positives."""
    def run(batches):
        best = [[_Best(k) for _ in w] for w in windows]
        for block in _unpack(batches, exact):
            for a, scores_of, held in zip(anchors, windows, best):
                if not scores_of or block.low == block.high == a.label:
                    continue
                alive = np.flatnonzero(block.labels != a.label)
                cuts = [b.cut() for b in held]

                def prune(least, most):
                    keep = np.zeros(len(least), bool)
                    for positive, cut in zip(scores_of, cuts):
                        inside = (100 * most >= low * positive) & (100 * least <= high * positive)
                        sure = (100 * least >= low * positive) & (100 * most <= high * positive)
                        here = _kth(least[sure.astype(bool)], k)
                        for floor in (cut, here):
                            if floor is not None:
                                inside = inside & (most >= floor)
                        keep |= inside.astype(bool)
                    return keep

                rows, scores = vertical_scan(block, a.vec, a.order, alive, prune)
                for positive, b in zip(scores_of, held):
                    fit = ((100 * scores >= low * positive) & (100 * scores <= high * positive)).astype(bool)
                    if fit.any():
                        b.add(scores[fit], block.ids[rows[fit]], block.seqs[rows[fit]])
        yield _found(best)
    return run


def mine_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30,
                   high: int = 90, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding",
                   label: Column | str = "label") -> DataFrame:
    """Hard negatives of each anchor (ids divisible by ``every``) and each of its first ``positives`` positives, exactly.

    Components count as floor(scale * x), a score is the integer inner product with the anchor.  Positives are the other
    rows of the anchor's label with the highest scores; negatives are the rows of other labels with the highest scores
    from ``low`` to ``high`` percent of the positive's.

    Rows lie in blocks of columns, one per dimension (:func:`column_blocks`).  An anchor reads a block's columns in the
    order of its own components' magnitude; what the unread columns can add at least and at most, from their least and
    largest values, bounds every candidate, and the candidates that can reach neither the k best nor a window are taken out
    (:func:`vertical_scan`).  Those that are left have exact scores.  Anchors come in blocks (ANCHORS, or ANCHOR_BYTES); the
    driver holds one.  A task passes on its k best of an anchor and window, so no pairs are written.

    Ties go to the smaller id, then the earlier row.  Rows without id or label, and null vectors or such with a null or
    non-finite component, take no part; shorter vectors are padded with zeros; a repeated row is another row, as a
    candidate and as an anchor (its results come again).  Anchors without positives, or whose windows hold nothing, give no
    rows, as does an empty table.  Where a product could exceed a double's exact integers, Python's integers are used;
    components end at 2 ** 53 and scores at the ends of a long.  Other columns aren't read.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    end = F.lit(EXACT)
    rows = finite_rows(vectors, id_col, vec_col, label=(F.col(label) if isinstance(label, str) else label).cast("long"))
    rows = stage_table(rows.where("label IS NOT NULL").withColumn(
        "v", F.transform("v", lambda x: F.floor(F.greatest(-end, F.least(end, x * scale))).cast("double"))), "bond-rows")
    found = BlockTable(spark, "bond-found", "anchor_id long, positive_id long, rank int, negative_id long, "
                                            "positive_score long, negative_score long")
    size = rows.agg(F.max(F.size("v")).alias("dims"),
                    F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))).alias("top")).first()
    if size["dims"] is None:
        return found.read()
    dims = max(1, size["dims"])
    exact = 100 * dims * size["top"] ** 2 < EXACT
    blocks = stage_table(column_blocks(rows, dims), "bond-blocks")
    by = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "seq")
    most = max(1, min(ANCHORS, ANCHOR_BYTES // (8 * dims)))
    long = lambda c: F.greatest(F.lit(-2 ** 63), F.least(F.lit(2 ** 63 - 1), F.col(c))).cast("long")
    for held in blocks_of(rows.where(F.col("id") % every == 0).select("id", "seq", "label", "v").toLocalIterator(), most):
        anchors = _anchors(held, dims, exact)
        first = (blocks.mapInArrow(_scan_positives(anchors, positives, exact), _FOUND)
                 .withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= positives)
                 .orderBy("anchor", "nth").collect())  # at most ``positives`` rows for each anchor of the block
        windows: list[list] = [[] for _ in anchors]
        known = []
        for r in first:
            known.append((r["anchor"], len(windows[r["anchor"]]), held[r["anchor"]]["id"], r["id"], r["score"]))
            windows[r["anchor"]].append(float(r["score"]) if exact else int(r["score"]))
        pairs = spark.createDataFrame(known, "anchor int, slot int, anchor_id long, positive_id long, "
                                             "positive decimal(38,0)")
        last = (blocks.mapInArrow(_scan_negatives(anchors, windows, negatives, low, high, exact), _FOUND)
                .withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives))
        found.add(last.join(F.broadcast(pairs), ["anchor", "slot"])  # a block's anchors times ``positives``
                  .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
                          long("positive").alias("positive_score"), long("score").alias("negative_score")))
    return found.read()
