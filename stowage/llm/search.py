"""Exact top-k inner-product search with a pivot-distance index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stowage.llm.common import bound_batches, row_seq, stage_table

#: Rows of the sample on which the pivots are fitted, rounds of the fit, rows of an annulus, queries of a block.
SAMPLE, ROUNDS, ANNULUS, QUERY_BLOCK = 2048, 6, 1024, 128
#: Annuli looked at in the first round; each later round looks at GROWTH times as many.
FIRST, GROWTH = 4, 4
#: Doubles hold integers up to here exactly.
EXACT = 2.0 ** 53


def usable(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, seq, v, norm): vectors as floor(scale * x), packed doubles; null ids and vectors that hold null, NaN or
    infinite components take no part."""
    def pack(batches):
        for b in batches:
            vec = b.column("v")
            n = np.array(vec.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            flat = np.asarray(vec.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
            with np.errstate(over="ignore"):
                flat = np.clip(np.floor(scale * flat), -2.0 ** 62, 2.0 ** 62)
            ends = np.cumsum(n)
            rows = [flat[e - m:e] for e, m in zip(ends, n)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("seq"), pa.array([r.astype("<f8").tobytes() for r in rows], pa.binary()),
                 pa.array([float(r @ r) for r in rows], pa.float64())], names=["id", "seq", "v", "norm"])

    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), row_seq().alias("seq"),
                          F.col(vec_col).alias(vec_col)).where(F.col("id").isNotNull() & F.col(vec_col).isNotNull() & fine)
    return rows.select("id", "seq", F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(
        pack, "id long, seq long, v binary, norm double")


def _matrix(blobs, dims: int) -> np.ndarray:
    out = np.zeros((len(blobs), dims))
    for k, b in enumerate(blobs):
        v = np.frombuffer(b, dtype="<f8")
        out[k, :len(v)] = v
    return out


def fit_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Centres of a k-means on the sample, started from spread rows of a fixed seed."""
    rng = np.random.default_rng(5)
    centre = sample[rng.permutation(len(sample))[:pivots]].copy()
    for _ in range(ROUNDS):
        near = _distances(sample, centre).argmin(1)
        for p in range(len(centre)):
            if (near == p).any():
                centre[p] = sample[near == p].mean(0)
    return centre


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))


def _raised(m: np.ndarray, top: float) -> np.ndarray:
    """Candidates with one more component that gives all the norm sqrt(top): the nearest is then the one with the
    largest inner product."""
    return np.hstack([m, np.sqrt(np.maximum(top - (m * m).sum(1), 0))[:, None]])


def _blocks(rows: DataFrame, size: int, dims: int, centre: np.ndarray) -> DataFrame:
    """Sorted rows (id, seq, v, pivot, dist) cut into blocks of at most ``size`` rows of one pivot."""
    def run(batches):
        part, nth = TaskContext.get().partitionId(), 0
        held: list[dict] = []

        def block():
            nonlocal held, nth
            held.sort(key=lambda r: (r["id"], r["seq"]))
            m = _matrix([r["v"] for r in held], dims)
            flat = np.hstack([m, np.zeros((len(m), 1))])  # as queries: nothing in the raised component
            out = {"block": (part << 32) | nth, "pivot": held[0]["pivot"], "lo": min(r["dist"] for r in held),
                   "hi": max(r["dist"] for r in held), "ids": np.array([r["id"] for r in held], "<i8").tobytes(),
                   "seqs": np.array([r["seq"] for r in held], "<i8").tobytes(), "m": m.astype("<f8").tobytes(),
                   "far": _distances(flat, centre).astype("<f8").tobytes()}
            held, nth = [], nth + 1
            return pa.RecordBatch.from_pylist([out], schema=schema)

        schema = pa.schema([("block", pa.int64()), ("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()),
                            ("ids", pa.binary()), ("seqs", pa.binary()), ("m", pa.binary()), ("far", pa.binary())])
        for b in batches:
            for r in b.to_pylist():
                if held and (len(held) >= size or held[0]["pivot"] != r["pivot"]):
                    yield block()
                held.append(r)
        if held:
            yield block()

    return (rows.repartitionByRange("pivot", "dist", "id", "seq").sortWithinPartitions("pivot", "dist", "id", "seq")
            .mapInArrow(run, "block long, pivot int, lo double, hi double, ids binary, seqs binary, m binary, far binary"))


def _products(q: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return q @ c.T
    big = q.astype(object) @ c.T.astype(object) if q.size and c.size else np.zeros((len(q), len(c)))
    return np.clip(big, -2 ** 63, 2 ** 63 - 1)


def _search(k: int, dims: int, exact: bool, slack: float):
    """Best k of each (query, annulus) pair that the triangle inequality doesn't exclude."""
    def run(batches):
        for b in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for r in b.to_pylist():
                qid, qseq = np.frombuffer(r["qids"], "<i8"), np.frombuffer(r["qseqs"], "<i8")
                far = np.frombuffer(r["qfar"], "<f8").reshape(len(qid), -1)[:, r["pivot"]]
                reach = np.array(r["reach"])
                go = np.flatnonzero((far - r["hi"] <= reach + slack) & (r["lo"] - far <= reach + slack))
                if not len(go):
                    continue
                cid, cseq = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["seqs"], "<i8")
                s = _products(np.frombuffer(r["qm"], "<f8").reshape(len(qid), dims)[go],
                              np.frombuffer(r["m"], "<f8").reshape(len(cid), dims), exact)
                own = qseq[go][:, None] == cseq[None, :]
                order = np.argsort(np.where(own, np.inf, -s), axis=1, kind="stable")[:, :k]  # columns go by id
                rows = np.repeat(np.arange(len(go)), order.shape[1])
                cols = order.ravel()
                keep = ~own[rows, cols]
                rows, cols = rows[keep], cols[keep]
                out.append((qseq[go][rows], qid[go][rows], cseq[cols], cid[cols], s[rows, cols]))
            if out:
                parts = [np.concatenate([o[j] for o in out]) for j in range(5)]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(p) for p in parts[:4]), pa.array([int(x) for x in parts[4]], pa.int64())],
                    names=["qseq", "query_id", "cseq", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, pivots: int = 32, scale: float = 1024.0,
          id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k largest inner products of each query (ids divisible by ``every``) with all other rows, exactly.

    Components count as floor(scale * x).  One more component makes all candidates equally long, which turns the
    largest inner product into the smallest distance.  Index: every row is keyed by its nearest of ``pivots``
    pivots (fitted on SAMPLE rows) and its distance to it, range-partitioned and sorted by this key, and cut into
    annuli of at most ANNULUS rows, so that a vector held by very many rows spreads over annuli.  Search: blocks
    of queries look at the nearest annuli of their own pivot, then at further ones in the order of
    their lower bound | d(q, pivot) - d(x, pivot) |, GROWTH times as many each round, and stop once the bound lies beyond
    their k-th distance.  Queries, annuli and pairs of them are Spark tables throughout.

    Ties go to the smaller id.  Vectors that are null or hold null or non-finite components, and rows without id, take no
    part; shorter vectors count as padded with zeros; a repeated row is a candidate for (and a query besides) its copies.
    Products that overflow a double's exact integers are computed with Python's integers and end at the ends of a long.
    An empty table, or one without queries, gives no rows.

    Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = stage_table(usable(vectors, id_col, vec_col, scale), "search-rows")
    size = rows.agg((F.max(F.octet_length("v")) / 8).cast("int").alias("dims"), F.max("norm").alias("top")).first()
    if size["dims"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, top = max(1, size["dims"]), float(size["top"])
    exact, slack = top < EXACT, 1e-6 * (top ** 0.5 + 1)
    sample = rows.orderBy(F.xxhash64("id", "seq"), "id", "seq").limit(SAMPLE).select("v").collect()
    centre = fit_pivots(_raised(_matrix([r["v"] for r in sample], dims), top), pivots)

    def assign(as_query: bool):
        def run(batches):
            for b in batches:
                m = _matrix(b.column("v").to_pylist(), dims)
                d = _distances(np.hstack([m, np.zeros((len(m), 1))]) if as_query else _raised(m, top), centre)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("seq"), b.column("v"), pa.array(near, pa.int32()),
                     pa.array(d[np.arange(len(d)), near])], names=["id", "seq", "v", "pivot", "dist"])
        return run

    kind = "id long, seq long, v binary, pivot int, dist double"
    index = stage_table(_blocks(rows.mapInArrow(assign(False), kind), ANNULUS, dims, centre).drop("far"), "search-index")
    asked = rows.where(F.col("id") % every == 0).mapInArrow(assign(True), kind)
    queries = stage_table(_blocks(asked, QUERY_BLOCK, dims, centre).select(
        F.col("block").alias("qblock"), F.col("pivot").alias("own"), F.col("ids").alias("qids"),
        F.col("seqs").alias("qseqs"), F.col("m").alias("qm"), F.col("far").alias("qfar")), "search-queries")

    def ranges(batches):  # per query block and pivot the nearest and farthest query; per query its place
        for b in batches:
            out = []
            for r in b.to_pylist():
                far = np.frombuffer(r["qfar"], "<f8").reshape(-1, len(centre))
                out += [{"qblock": r["qblock"], "own": r["own"], "pivot": p, "qlo": float(far[:, p].min()),
                         "qhi": float(far[:, p].max())} for p in range(len(centre))]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("qblock", pa.int64()), ("own", pa.int32()), ("pivot", pa.int32()), ("qlo", pa.float64()),
                ("qhi", pa.float64())]))

    def members(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                m = np.frombuffer(r["qm"], "<f8").reshape(-1, dims)
                out += [{"qblock": r["qblock"], "slot": s, "qseq": int(q), "norm": float(n)} for s, (q, n) in
                        enumerate(zip(np.frombuffer(r["qseqs"], "<i8"), (m * m).sum(1)))]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("qblock", pa.int64()), ("slot", pa.int32()), ("qseq", pa.int64()), ("norm", pa.float64())]))

    span = queries.select("qblock", "own", "qfar").mapInArrow(
        ranges, "qblock long, own int, pivot int, qlo double, qhi double")
    slots = stage_table(queries.select("qblock", "qseqs", "qm").mapInArrow(
        members, "qblock long, slot int, qseq long, norm double"), "search-slots")
    annuli = index.select("block", "pivot", "lo", "hi")
    bound = F.greatest(F.lit(0.0), F.col("lo") - F.col("qhi"), F.col("qlo") - F.col("hi"))
    gap = F.abs((F.col("lo") + F.col("hi")) / 2 - (F.col("qlo") + F.col("qhi")) / 2)
    pairs = stage_table(
        span.join(annuli, "pivot").select("qblock", "block", bound.alias("bound"), (F.col("own") != F.col("pivot"))
                                          .alias("other"), gap.alias("gap"))
        .withColumn("nth", F.row_number().over(W.partitionBy("qblock").orderBy("bound", "other", "gap", "block"))),
        "search-pairs")
    found = spark.createDataFrame([], "qseq long, query_id long, cseq long, vec_id long, score long")
    done, upto = 0, FIRST
    by_query = W.partitionBy("qseq").orderBy(F.desc("score"), "vec_id", "cseq")
    while True:
        # how far each query still has to look: its k-th distance
        kth = found.groupBy("qseq").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
        reach = F.when(F.col("kth").isNull() | F.lit(not exact), F.lit(float("inf"))).otherwise(
            F.sqrt(F.greatest(F.lit(0.0), F.lit(top) + F.col("norm") - 2.0 * F.col("kth"))))
        reaches = (slots.join(kth, "qseq", "left").select("qblock", "slot", reach.alias("reach")).groupBy("qblock")
                   .agg(F.max("reach").alias("widest"), F.transform(  # QUERY_BLOCK entries at most
                       F.array_sort(F.collect_list(F.struct("slot", "reach"))), lambda s: s["reach"]).alias("reach")))
        reaches = stage_table(reaches, "search-reach")
        left = pairs.where(F.col("nth") > done).join(reaches, "qblock").where(F.col("bound") <= F.col("widest") + slack)
        if done and left.isEmpty():
            break
        work = (left.where(F.col("nth") <= upto).select("qblock", "block", "reach").join(queries.drop("own"), "qblock")
                .join(index, "block"))
        new = work.mapInArrow(_search(k, dims, exact, slack),
                              "qseq long, query_id long, cseq long, vec_id long, score long")
        found = stage_table(found.unionByName(new).withColumn("rank", F.row_number().over(by_query))
                            .where(F.col("rank") <= k).drop("rank"), "search-found")
        done, upto = upto, upto * GROWTH
    return found.withColumn("rank", F.row_number().over(by_query)).select("query_id", "rank", "vec_id", "score")
