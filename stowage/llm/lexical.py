"""Exact ranked lexical search over hashed max-sketches of documents."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stowage.llm.blocks import BlockTable, blocks_of
from stowage.llm.common import bound_batches, byte_texts, row_seq, stage_table

#: Terms: runs of ASCII letters, digits and bytes of characters beyond ASCII.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xFF]")
#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 22
#: Coordinates of a sketch, and its independent hash functions (bits of one crc32 each).
COORDS, SHIFTS = 4096, (0, 12)
#: Frequencies are held in a byte; this one stands for "so many or more", whose impact is bounded by its limit.
FULL_TF = 255
#: Terms whose document counts a task holds before it passes them on.
HELD_TERMS = 500_000
#: Items and terms of one block of queries; documents by bound that give the first threshold.
BLOCK_ITEMS, BLOCK_TERMS, SEEDS = 1024, 1 << 18, 32
#: Rows of a sketch matrix.
ROWS = 256


def term_counts(text: bytes) -> Counter:
    """Frequencies of the terms of a whole text, A-Z in lower case."""
    counts: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            gap = _BREAK.search(text, end)
            end = gap.start() if gap else len(text)
        counts.update(_TERM.findall(text[at:end].lower()))
        at = end
    return counts


def impact(tf, m):
    """Impact of a term that occurs ``tf`` times in a document of length norm ``m`` (integers)."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(n_docs: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def sketch(counts: Counter) -> bytes:
    """Per hash function the highest frequency at each coordinate, as sorted (coordinate, frequency) lists.

    An impact grows with its frequency at any one length norm, so the impact of the highest frequency is the highest
    impact: the coordinatewise maxima can be stored before the corpus's mean length is known.
    """
    h = np.fromiter(map(zlib.crc32, counts), np.uint32, len(counts))
    tf = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), FULL_TF).astype(np.uint8)
    up = np.argsort(tf, kind="stable")
    out = []
    for shift in SHIFTS:
        top = np.zeros(COORDS, np.uint8)
        top[(h[up] >> np.uint32(shift)) & np.uint32(COORDS - 1)] = tf[up]  # the highest is written last
        at = np.flatnonzero(top)
        out += [struct.pack("<H", len(at) % 65536), at.astype("<u2").tobytes(), top[at].tobytes()]
    return b"".join(out)


class Index(NamedTuple):
    """``docs``: seq, id, n, text, sketch, a row per document; ``terms``: term, df partial counts of the whole corpus."""

    docs: DataFrame
    terms: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Sketches and term statistics of all documents, in one pass over the whole texts."""
    schema = pa.schema([("seq", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("text", pa.binary()),
                        ("sketch", pa.binary()), ("term", pa.binary()), ("df", pa.int64())])

    def counted(df: Counter) -> pa.RecordBatch:
        none = pa.nulls(len(df))
        return pa.RecordBatch.from_arrays(
            [*(none.cast(schema.field(k).type) for k in range(5)), pa.array(list(df.keys()), pa.binary()),
             pa.array(list(df.values()), pa.int64())], schema=schema)

    def run(batches):
        df: Counter = Counter()
        for b in batches:
            texts = byte_texts(b.column("text"))
            n, sketches = [], []
            for t in texts:
                c = term_counts(t)
                df.update(c.keys())
                n.append(c.total())
                sketches.append(sketch(c))
            none = pa.nulls(len(texts))
            yield pa.RecordBatch.from_arrays(
                [b.column("seq"), b.column("id"), pa.array(n, pa.int64()), pa.array(texts, pa.binary()),
                 pa.array(sketches, pa.binary()), none.cast(pa.binary()), none.cast(pa.int64())], schema=schema)
            if len(df) > HELD_TERMS:
                yield counted(df)
                df = Counter()
        if df:
            yield counted(df)

    bound_batches(docs.sparkSession)
    rows = docs.select(row_seq().alias("seq"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    both = stage_table(rows.mapInArrow(
        run, "seq long, id long, n long, text binary, sketch binary, term binary, df long"), "lexical-index")
    held = both.where("term IS NULL").select("seq", "id", "n", "text", "sketch")
    total = held.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return Index(held, both.where("term IS NOT NULL").select("term", "df"), total["docs"], total["terms"])


def _query_terms(queries: DataFrame, index: Index, id_col: str, text_col: str) -> DataFrame:
    """(qseq, item, terms: term, qtf, df): a row per item that holds a term of the corpus."""
    def run(batches):
        for b in batches:
            out = []
            for q, i, t in zip(b.column("qseq").to_pylist(), b.column("item").to_pylist(), byte_texts(b.column("text"))):
                out += [{"qseq": q, "item": i, "term": w, "qtf": c} for w, c in term_counts(t).items()]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                [("qseq", pa.int64()), ("item", pa.int64()), ("term", pa.binary()), ("qtf", pa.int64())]))

    rows = stage_table(queries.select(row_seq().alias("qseq"), F.col(id_col).cast("long").alias("item"),
                                      F.col(text_col).alias("text"))
                       .mapInArrow(run, "qseq long, item long, term binary, qtf long"), "lexical-queries")
    df = (index.terms.join(rows.select("term").distinct(), "term", "left_semi").groupBy("term")
          .agg(F.sum("df").alias("df")))
    return stage_table(rows.join(df, "term").groupBy("qseq", "item")
                       .agg(F.collect_list(F.struct("term", "qtf", "df")).alias("terms")), "lexical-weights")


class _Block:
    """A block of items as weights over terms, and over the sketch coordinates that the terms hash to."""

    def __init__(self, rows, index: Index):
        self.items = [(r["qseq"], r["item"]) for r in rows]
        self.terms = [{bytes(t["term"]): t["qtf"] * weight(index.n_docs, t["df"]) for t in r["terms"]} for r in rows]
        hashes = [np.fromiter(map(zlib.crc32, t), np.uint32, len(t)) for t in self.terms]
        self.weights = [np.fromiter(t.values(), np.float64, len(t)) for t in self.terms]
        self.slots, self.at = [], []  # per hash function: coordinate -> column, and each item's columns
        for shift in SHIFTS:
            coords = [((h >> np.uint32(shift)) & np.uint32(COORDS - 1)).astype(np.int64) for h in hashes]
            used = np.unique(np.concatenate(coords))
            slot = np.full(COORDS, -1)
            slot[used] = np.arange(len(used))
            self.slots.append((slot, len(used)))
            self.at.append([slot[c] for c in coords])
        self.table = np.zeros((self.slots[0][1], len(rows)))
        for q, (at, w) in enumerate(zip(self.at[0], self.weights)):
            np.add.at(self.table[:, q], at, w)

    def impacts(self, sketches: list[bytes], m: np.ndarray) -> list[np.ndarray]:
        """Per hash function the highest impacts (documents x used coordinates)."""
        out = [np.zeros((len(sketches), width)) for _, width in self.slots]
        for k, blob in enumerate(sketches):
            at = 0
            for (slot, _), dense in zip(self.slots, out):
                n = struct.unpack_from("<H", blob, at)[0]
                column = slot[np.frombuffer(blob, "<u2", n, at + 2)]
                tf = np.frombuffer(blob, np.uint8, n, at + 2 + 2 * n).astype(np.int64)
                use = column >= 0
                column, tf = column[use], tf[use]
                dense[k, column] = np.where(tf < FULL_TF, impact(tf, int(m[k])), 1_000_000)
                at += 2 + 3 * n
        return out

    def refined(self, impacts: list[np.ndarray], q: int, rows: np.ndarray) -> np.ndarray:
        """Bounds of item ``q`` from the lesser maximum of both hash functions at each term."""
        low = np.minimum(*(i[rows[:, None], at[q][None, :]] for i, at in zip(impacts, self.at)))
        return low @ self.weights[q]

    def score(self, q: int, counts: Counter, m: int) -> int:
        return sum(w * impact(tf, m) for t, w in self.terms[q].items() if (tf := counts.get(t)))


def _norms(b: pa.RecordBatch, index_size: tuple[int, int]) -> np.ndarray:
    n_docs, n_terms = index_size
    return np.array([25 + (75 * n * n_docs) // n_terms for n in b.column("n").to_pylist()], dtype=np.int64)


def _slices(batches):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _seed_bounds(block: _Block, size: tuple[int, int]):
    """The SEEDS highest bounds of each item in this task: (q, seq, bound)."""
    def run(batches):
        top = [(np.zeros(0), np.zeros(0, np.int64)) for _ in block.items]
        cut = np.zeros(len(block.items))
        for b in _slices(batches):
            impacts = block.impacts(b.column("sketch").to_pylist(), _norms(b, size))
            seqs = b.column("seq").to_numpy()
            first = impacts[0] @ block.table
            for q in np.flatnonzero((first > cut).any(0)):
                rows = np.flatnonzero(first[:, q] > cut[q])
                bound = np.concatenate([top[q][0], block.refined(impacts, q, rows)])
                seq = np.concatenate([top[q][1], seqs[rows]])
                best = np.lexsort((seq, -bound))[:SEEDS]
                top[q] = bound[best], seq[best]
                if len(best) == SEEDS:
                    cut[q] = top[q][0][-1]
        for q, (bound, seq) in enumerate(top):
            some = bound > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(some.sum(), q, np.int32)), pa.array(seq[some]), pa.array(bound[some])],
                names=["q", "seq", "bound"])
    return run


def _seed_scores(block: _Block, size: tuple[int, int]):
    """Exact scores of the seeds: rows of (n, text, items) to (q, score)."""
    def run(batches):
        for b in batches:
            m, out = _norms(b, size), []
            for k, (text, items) in enumerate(zip(b.column("text").to_pylist(), b.column("items").to_pylist())):
                counts = term_counts(text)
                out += [(q, block.score(q, counts, int(m[k]))) for q in items]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()),
                                              pa.array([o[1] for o in out], pa.int64())], names=["q", "score"])
    return run


def _rescore(block: _Block, size: tuple[int, int], floor: np.ndarray, k: int):
    """The k best of each item among this task's documents: bounds in descending order until one is below the k-th."""
    def run(batches):
        best: list[list[tuple]] = [[] for _ in block.items]
        cut = floor.copy()
        for b in _slices(batches):
            m = _norms(b, size)
            impacts = block.impacts(b.column("sketch").to_pylist(), m)
            first = impacts[0] @ block.table
            texts, seqs, ids = b.column("text"), b.column("seq").to_pylist(), b.column("id").to_pylist()
            counted: dict[int, Counter] = {}
            for q in np.flatnonzero((first >= cut).any(0)):
                rows = np.flatnonzero(first[:, q] >= cut[q])
                bound = block.refined(impacts, q, rows)
                for at in np.argsort(-bound, kind="stable"):
                    if bound[at] < cut[q]:
                        break
                    r = int(rows[at])
                    if r not in counted:
                        counted[r] = term_counts(texts[r].as_py())
                    score = block.score(q, counted[r], int(m[r]))
                    if score >= cut[q]:
                        best[q].append((-score, ids[r] is None, ids[r] or 0, seqs[r]))
                        if len(best[q]) >= k:
                            best[q] = sorted(best[q])[:k]
                            cut[q] = max(cut[q], -best[q][-1][0])
        rows = [(q, *r) for q, found in enumerate(best) for r in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([None if r[2] else r[3] for r in rows], pa.int64()),
             pa.array([r[4] for r in rows], pa.int64()), pa.array([-r[1] for r in rows], pa.int64())],
            names=["q", "id", "seq", "score"])
    return run


def search(index: Index, queries: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text",
           id_col: str = "doc_id") -> DataFrame:
    """The k documents with the highest scores above 0 for each row of ``queries``, exactly.

    Items come in blocks (BLOCK_ITEMS items, BLOCK_TERMS terms; a longer item is a block of its own); the driver holds one.
    For a block, every sketch is looked up for all items at once: the weights of an item's terms, summed by coordinate,
    times the highest impacts there, bound a document's score from above; where that bound reaches the
    threshold, the lesser maximum of two hash functions at each term tightens it.  The SEEDS highest bounds of an item
    are scored from the texts, and their k-th score is its first threshold.  Then every task scores the documents
    whose bound reaches the threshold, in descending order of bounds, raises the threshold as it goes and stops at a bound
    below it.  Only k rows an item and task leave it; nothing is dropped that could reach the first k.

    Equal scores go by ascending id (null ids last, then by row).  Null and blank texts hold no term and are never found;
    items without a term of the corpus give no rows; a repeated item gives its rows again and a repeated document takes
    a rank for each of its rows; an empty table gives no rows.  Very long texts are cut into terms in pieces and
    counted whole.  Other columns aren't read.  Returns item_col, rank, id_col, score.
    """
    spark = queries.sparkSession
    weighted = _query_terms(queries, index, item_col, text_col)
    found = BlockTable(spark, "lexical-found", "item long, rank int, id long, score long")
    size = (index.n_docs, index.n_terms)
    weigh = lambda r: max(len(r["terms"]), BLOCK_TERMS // BLOCK_ITEMS)
    for rows in blocks_of(weighted.toLocalIterator(), BLOCK_TERMS, weigh):
        block = _Block(rows, index)
        nth = F.row_number().over(W.partitionBy("q").orderBy(F.desc("bound"), "seq"))
        seeds = stage_table(index.docs.select("seq", "n", "sketch").mapInArrow(
            _seed_bounds(block, size), "q int, seq long, bound double").withColumn("nth", nth).where(F.col("nth") <= SEEDS)
            .groupBy("seq").agg(F.collect_list("q").alias("items")), "lexical-seeds")  # at most the block's items
        scores = (index.docs.join(seeds, "seq").select("n", "text", "items")
                  .mapInArrow(_seed_scores(block, size), "q int, score long"))
        kth = (scores.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"))))
               .where(F.col("nth") == k).select("q", "score").collect())  # a row per item of the block
        floor = np.ones(len(block.items))
        for r in kth:
            floor[r["q"]] = max(1, r["score"])
        names = spark.createDataFrame([(q, *i) for q, i in enumerate(block.items)], "q int, qseq long, item long")
        ranked = (index.docs.mapInArrow(_rescore(block, size, floor, k), "q int, id long, seq long, score long")
                  .withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(
                      F.desc("score"), F.col("id").asc_nulls_last(), "seq"))).where(F.col("rank") <= k))
        found.add(ranked.join(names, "q").select("item", "rank", "id", "score"))
    return found.read().select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """:func:`search` over an index built from ``docs`` (doc_id, text) for ``queries`` (item_id, text)."""
    return search(build_index(docs), queries, k)
