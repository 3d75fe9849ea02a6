"""Approximate nearest neighbours by cosine: a robust-pruned directed graph per shard, searched by beams."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stowage.llm.blocks import BlockTable, blocks_of
from stowage.llm.common import bound_batches, stage_table
from stowage.llm.vectors import finite_rows, matrix

#: Rows of a shard, and its bytes where vectors are long; queries of a block, and their bytes.
SHARD_ROWS, SHARD_BYTES, QUERIES, QUERY_BYTES = 16384, 64 << 20, 2048, 32 << 20
#: Edges of a node, width of the beam that builds and of the one that searches, relaxation of the pruning.
DEGREE, BUILD_BEAM, BEAM, ALPHA = 32, 64, 128, 1.2
#: Nodes that a step of the beam expands at once, entry points, nodes inserted or queries searched at a time, and their
#: components (fewer at a time where vectors are long).
EXPAND, ENTRIES, BATCH, BATCH_SIZE = 4, 16, 256, 1 << 18


def _batch(dims: int) -> int:
    return max(8, min(BATCH, BATCH_SIZE // max(1, dims)))


def beam_search(unit: np.ndarray, edges: np.ndarray, entry: np.ndarray, queries: np.ndarray, width: int):
    """The ``width`` most similar nodes that greedy beams from ``entry`` reach: (nodes, similarities), best first.

    All queries step together: each expands its EXPAND best nodes not expanded yet, looks at their unseen neighbours and
    keeps the best ``width`` of all.  It ends when the beams hold only expanded nodes.  Missing places are -1.
    """
    n = len(queries)
    node = np.full((n, width), -1)
    sim = np.full((n, width), -np.inf, np.float32)
    done = np.ones((n, width), bool)
    seen = np.zeros((n, len(unit) + 1), bool)  # the last column takes the missing neighbours
    seen[:, -1] = True
    first = entry[:width]
    node[:, :len(first)], sim[:, :len(first)], done[:, :len(first)] = first, queries @ unit[first].T, False
    seen[:, first] = True
    order = np.argsort(-sim, axis=1, kind="stable")
    node, sim, done = (np.take_along_axis(x, order, 1) for x in (node, sim, done))
    active = np.arange(n)
    while len(active):
        open_ = ~done[active]
        pick = open_ & (np.cumsum(open_, axis=1) <= EXPAND)
        go = pick.any(1)
        active, pick = active[go], pick[go]
        if not len(active):
            break
        done[active] |= pick
        row, col = np.nonzero(pick)
        near = edges[node[active[row], col]]  # picked x DEGREE
        row = np.repeat(row, near.shape[1])
        near = near.ravel()
        fresh = ~seen[active[row], near]
        row, near = row[fresh], near[fresh]
        key = np.unique(row * np.int64(len(unit) + 1) + near)  # two picks may share a neighbour
        row, near = key // (len(unit) + 1), key % (len(unit) + 1)
        seen[active[row], near] = True
        got = np.einsum("ij,ij->i", unit[near], queries[active[row]])
        per = np.bincount(row, minlength=len(active))
        place = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
        new_node = np.full((len(active), max(int(per.max(initial=0)), 1)), -1)
        new_sim = np.full(new_node.shape, -np.inf, np.float32)
        new_node[row, place], new_sim[row, place] = near, got
        all_node = np.hstack([node[active], new_node])
        all_sim = np.hstack([sim[active], new_sim])
        all_done = np.hstack([done[active], new_node < 0])
        order = np.argsort(-all_sim, axis=1, kind="stable")[:, :width]
        node[active], sim[active], done[active] = (np.take_along_axis(x, order, 1) for x in (all_node, all_sim, all_done))
    return node, sim


def robust_prune(unit: np.ndarray, at: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Edges of the nodes ``at`` from their candidates (rows of nodes, -1 for none).

    The nearest candidate gets an edge and takes out all candidates to which it is nearer, by the factor ``alpha``, than the
    node itself is; the next nearest follows, up to ``degree`` edges.  Distances are Euclidean between unit vectors.
    """
    some = (cand >= 0) & (cand != at[:, None])
    sim = np.where(some, np.einsum("ijk,ik->ij", unit[cand], unit[at]), -np.inf)
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    left = np.isfinite(sim)
    left[:, 1:] &= cand[:, 1:] != cand[:, :-1]  # equal nodes are equally similar, hence neighbours mostly
    vec = unit[cand]
    between = vec @ vec.transpose(0, 2, 1)
    far = 1 - sim
    out = np.full((len(at), degree), -1)
    rows = np.arange(len(at))
    for k in range(degree):
        go = left.any(1)
        if not go.any():
            break
        best = left.argmax(1)  # candidates go by similarity
        out[go, k] = cand[rows[go], best[go]]
        left &= ~((alpha ** 2) * (1 - between[rows, best]) <= far)
        left[rows, best] = False
        left &= cand != out[:, k][:, None]
    return out


def build_graph(unit: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 0):
    """Edges (nodes x degree, -1 for none) and entry points of a graph over the rows of ``unit``.

    Nodes are inserted in random order, in batches that double up to BATCH: a beam over the graph so far proposes
    neighbours, :func:`robust_prune` keeps diverse ones, and each of those gets an edge back, pruned again where it has
    too many.
    """
    rng = np.random.default_rng(seed)
    n = len(unit)
    order = rng.permutation(n)
    edges = np.full((n + 1, degree), -1)
    middle = int((unit @ unit.mean(0)).argmax()) if n else 0
    first = np.unique(np.concatenate([[middle], order[:ENTRIES - 1]]))[:n]
    entry = np.concatenate([[middle], first[first != middle]]) if n else first
    for k, v in enumerate(entry):  # the entry points know each other
        others = np.delete(entry, k)[:degree]
        edges[v, :len(others)] = others
    rest = order[~np.isin(order, entry)]
    at, size, most = 0, 8, _batch(unit.shape[1])
    while at < len(rest):
        batch = rest[at:at + size]
        at, size = at + size, min(2 * size, most)
        node, _ = beam_search(unit, edges, entry, unit[batch], beam)
        edges[batch] = robust_prune(unit, batch, node, degree, alpha)
        target, source = edges[batch].ravel(), np.repeat(batch, degree)
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, start, count = np.unique(target, return_index=True, return_counts=True)
        free = (edges[nodes] < 0).sum(1)
        place = np.arange(len(target)) - np.repeat(start, count)
        fits = np.repeat(count <= free, count)
        edges[target[fits], (degree - np.repeat(free, count) + place)[fits]] = source[fits]
        full = np.flatnonzero(count > free)
        for some in (full[count[full] <= degree], full[count[full] > degree]):  # few nodes get very many edges at once
            for part in range(0, len(some), most):
                pick = some[part:part + most]
                cand = np.full((len(pick), degree + int(count[pick].max())), -1)
                cand[:, :degree] = edges[nodes[pick]]
                for r, p in enumerate(pick):
                    cand[r, degree:degree + count[p]] = source[start[p]:start[p] + count[p]]
                edges[nodes[pick]] = robust_prune(unit, nodes[pick], cand, degree, alpha)
    return edges[:n], entry


def build_shard(ids: np.ndarray, seqs: np.ndarray, m: np.ndarray) -> dict:
    """A shard's graph over its distinct vectors, with the rows of each by ascending id."""
    by = np.lexsort((seqs, ids))
    ids, seqs, m = ids[by], seqs[by], m[by]
    vec, which = np.unique(m, axis=0, return_inverse=True)
    which = which.ravel()
    rows = np.argsort(which, kind="stable")  # rows of one vector together, by id
    start = np.searchsorted(which[rows], np.arange(len(vec) + 1))
    unit = (vec / norms(vec)[:, None]).astype(np.float32)
    edges, entry = build_graph(unit)
    return {"vec": vec, "unit": unit, "edges": edges.astype(np.int32), "entry": entry, "ids": ids[rows],
            "seqs": seqs[rows], "start": start}


def norms(m: np.ndarray) -> np.ndarray:
    """Euclidean lengths; scaled first, so that large and small components neither overflow nor vanish."""
    top = np.abs(m).max(axis=1, initial=0)
    top = np.where(top > 0, top, 1)
    return top * np.sqrt(((m / top[:, None]) ** 2).sum(1))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of equal rows of ``a`` and ``b``; the same for equal vectors wherever they lie."""
    return ((a / norms(a)[:, None]) * (b / norms(b)[:, None])).sum(1)


def search_shard(shard: dict, queries: np.ndarray, qseqs: np.ndarray, k: int, beam: int):
    """The k most similar rows that a beam finds for each query, its own row left out: (query, id, seq, score)."""
    out = []
    unit = (queries / norms(queries)[:, None]).astype(np.float32)
    most = _batch(queries.shape[1])
    for at in range(0, len(queries), most):
        node, _ = beam_search(shard["unit"], shard["edges"], shard["entry"], unit[at:at + most], beam)
        row, col = np.nonzero(node >= 0)
        node = node[row, col]
        score = cosines(queries[at + row], shard["vec"][node])
        start, end = shard["start"][node], shard["start"][node + 1]
        take = np.minimum(end - start, k + 1)  # rows of one vector: the smallest ids, one of which may be the query
        member = np.repeat(start, take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
        row, score = np.repeat(row + at, take), np.repeat(score, take)
        other = shard["seqs"][member] != qseqs[row]
        row, score, member = row[other], score[other], member[other]
        by = np.lexsort((shard["seqs"][member], shard["ids"][member], -score, row))
        row, score, member = row[by], score[by], member[by]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < k
        out.append((row[best], shard["ids"][member[best]], shard["seqs"][member[best]], score[best]))
    return [np.concatenate(x) for x in zip(*out)]


def build_index(rows: DataFrame, dims: int, total: int) -> DataFrame:
    """(shard, graph) of rows (id, seq, v): every row lies in the graph of one shard, chosen by a hash of its row number."""
    most = max(256, min(SHARD_ROWS, SHARD_BYTES // (8 * dims)))
    shards = -(-total // most)

    def run(batches):
        ids, seqs, m, now = [], [], [], None

        def graph():
            whole = build_shard(np.concatenate(ids), np.concatenate(seqs), np.concatenate(m))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([pickle.dumps(whole)], pa.binary())],
                                              names=["shard", "graph"])

        for b in batches:
            shard = b.column("shard").to_numpy()
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for first, last in zip([0, *cuts], [*cuts, len(shard)]):
                if first == last:
                    continue
                if now is not None and shard[first] != now:
                    yield graph()
                    ids, seqs, m = [], [], []
                now = int(shard[first])
                part = b.slice(first, last - first)
                ids.append(part.column("id").to_numpy())
                seqs.append(part.column("seq").to_numpy())
                m.append(matrix(part.column("v"), dims))
        if now is not None:
            yield graph()

    return (rows.withColumn("shard", F.pmod(F.xxhash64("seq"), F.lit(shards)).cast("int"))
            .repartitionByRange(shards, "shard").sortWithinPartitions("shard", "seq").select("id", "seq", "v", "shard")
            .mapInArrow(run, "shard int, graph binary"))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, beam: int = BEAM, id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """About the k nearest rows by cosine of each query (ids divisible by ``every``) among all other rows.

    Index: rows are dealt to shards of about SHARD_ROWS rows (or SHARD_BYTES); each shard is one robust-pruned graph over its
    distinct vectors (:func:`build_graph`), a row of a written table, so that any number of copies of a vector is one
    node.  Search: queries come in blocks (QUERIES, or QUERY_BYTES), of which the driver holds one; a beam searches
    every shard for all of them, and the k best of all shards count.  Scores are exact cosines, in double
    precision, of the original vectors.  The answer is approximate: a beam can miss a neighbour; the tests hold recall
    above 0.9 of brute force.

    Equal scores go by ascending id, then by row.  Rows without id and vectors that are null, zero, empty or hold a null
    or non-finite component take no part; shorter vectors are padded with zeros; a repeated row is a candidate for
    its copies and a query besides them (its results come again); fewer candidates than k give fewer rows, an empty table
    none.  Other columns aren't read.  Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = stage_table(finite_rows(vectors, id_col, vec_col).where(F.exists("v", lambda x: x != 0)), "graph-rows")
    found = BlockTable(spark, "graph-found", "query_id long, rank int, vec_id long, score double")
    size = rows.agg(F.max(F.size("v")).alias("dims"), F.count(F.lit(1)).alias("rows")).first()
    if not size["rows"]:
        return found.read()
    dims = size["dims"]
    index = stage_table(build_index(rows, dims, size["rows"]), "graph-index")

    def run(batches, queries, qseqs):
        best = None  # the k best of this task's shards
        for b in batches:
            for blob in b.column("graph"):
                got = search_shard(pickle.loads(blob.as_py()), queries, qseqs, k, beam)
                both = got if best is None else [np.concatenate(x) for x in zip(best, got)]
                by = np.lexsort((both[2], both[1], -both[3], both[0]))
                both = [x[by] for x in both]
                place = np.arange(len(by)) - np.searchsorted(both[0], both[0])
                best = [x[place < k] for x in both]
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["query", "vec_id", "seq", "score"])

    by = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "seq")
    most = max(1, min(QUERIES, QUERY_BYTES // (8 * dims)))
    for held in blocks_of(rows.where(F.col("id") % every == 0).select("id", "seq", "v").toLocalIterator(), most):
        queries = np.zeros((len(held), dims))
        for r, q in enumerate(held):
            queries[r, :len(q["v"])] = q["v"]
        qseqs = np.array([q["seq"] for q in held])
        names = spark.createDataFrame([(r, q["id"]) for r, q in enumerate(held)], "query long, query_id long")
        ranked = (index.select("graph").mapInArrow(lambda batches, q=queries, s=qseqs: run(batches, q, s),
                                                   "query long, vec_id long, seq long, score double")
                  .withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k))
        found.add(ranked.join(F.broadcast(names), "query")  # a block's queries
                  .select("query_id", "rank", "vec_id", "score"))
    return found.read()
