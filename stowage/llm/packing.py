"""Packing of tokenized documents along a Hilbert curve of their hashed vectors."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stowage.llm.common import bound_batches, row_seq, stage_table

#: Axes of the curve and bits of each.
AXES, AXIS_BITS = 4, 12
#: The end token that follows each document.
END_ID = 1




def tokenizer_dir() -> str:
    """Folder of the public vocabulary files; TOKENIZER_DIR names another one."""
    named = os.environ.get("TOKENIZER_DIR")
    if named:
        return named
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


class Encoder:
    """Ids of a byte-level BPE, as its ``.json`` file gives them in the tokenizers library.

    The ``.tiktoken`` file beside it holds the same vocabulary as ranks, with which
    tiktoken gives the same ids several times as fast.  A text that holds the string of a special token, which
    tokenizers turns into the token's id, goes through tokenizers itself.
    """

    def __init__(self, folder: str, name: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(os.path.join(folder, f"{name}.json"))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


@functools.cache
def encoder(folder: str, name: str) -> Encoder:
    return Encoder(folder, name)


@functools.cache
def directions(vocabulary: int) -> np.ndarray:
    """A random direction for each token id, from a fixed seed."""
    return np.random.default_rng(7).standard_normal((vocabulary, AXES)).astype(np.float32)


def hilbert_keys(axes: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of ``axes`` (integers of ``bits`` bits), by Skilling's transform."""
    x = axes.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[:, i] & q) != 0
            t = (x[:, 0] ^ x[:, i]) & p
            x[:, 0] = np.where(on, x[:, 0] ^ p, x[:, 0] ^ t)
            if i:
                x[:, i] = np.where(on, x[:, i], x[:, i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def document_axes(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A document's hashed bag of tokens projected to AXES dimensions, as integers of AXIS_BITS bits.

    Each token adds its random direction; over the square root of the length the
    sum of unrelated tokens is about standard normal, and its tanh is spread over the axis.
    """
    v = table[ids].sum(0) / max(1.0, len(ids)) ** 0.5
    return ((np.tanh(v / 4) + 1) / 2 * ((1 << AXIS_BITS) - 1)).astype(np.int64)


def token_rows(docs: DataFrame, folder: str, name: str, text_col: str) -> "F.Column":
    """struct<curve, n, ids>: Hilbert key, number of ids with the end id, ids as unsigned 16-bit (32 if need be)."""
    @F.arrow_udf("struct<curve: long, n: long, wide: boolean, ids: binary>")
    def tokenize(texts: pa.Array) -> pa.Array:
        enc = encoder(folder, name)
        wide = enc.whole.get_vocab_size() > 1 << 16
        table = directions(enc.whole.get_vocab_size())
        axes, n, blobs = [], [], []
        for t in texts.to_pylist():
            ids = enc.ids(t) if t else np.zeros(0, dtype=np.uint32)
            axes.append(document_axes(ids, table))
            n.append(len(ids) + 1)
            blobs.append(np.append(ids, END_ID).astype("<u4" if wide else "<u2").tobytes())
        keys = hilbert_keys(np.array(axes).reshape(-1, AXES), AXIS_BITS)
        return pa.StructArray.from_arrays([pa.array(keys), pa.array(n, pa.int64()), pa.array([wide] * len(n)),
                                           pa.array(blobs, pa.binary())], names=["curve", "n", "wide", "ids"])

    return tokenize.asNondeterministic()(F.col(text_col))


def _running(batches):
    """Appends the tokens that lie before each row in its partition."""
    before = 0
    for b in batches:
        n = b.column("n").to_numpy()
        at = before + np.cumsum(n) - n
        before += int(n.sum())
        yield b.append_column("before", pa.array(at))


def _pieces(length: int):
    def run(batches):
        for b in batches:
            index, start, size, seq, off, blobs = [], [], [], [], [], []
            wide = b.column("wide").to_pylist()
            for k, (at, n, ids) in enumerate(zip(b.column("at").to_pylist(), b.column("n").to_pylist(), b.column("ids"))):
                all_ids = np.frombuffer(ids.as_buffer(), dtype="<u4" if wide[k] else "<u2")
                s = 0
                while s < n:
                    o = (at + s) % length
                    m = min(n - s, length - o)
                    index.append(k)
                    start.append(s)
                    size.append(m)
                    seq.append((at + s) // length)
                    off.append(o)
                    blobs.append(all_ids[s:s + m].astype("<u4").tobytes())
                    s += m
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(index, pa.int64())), b.column("seq").take(pa.array(index, pa.int64())),
                 pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(blobs, pa.binary()),
                 b.column("n").take(pa.array(index, pa.int64())), pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
                names=["id", "row", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, length: int = 2048, tokenizer: str = "byte_bpe_50k", folder: str | None = None,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``length`` tokens, neighbours along a Hilbert curve together.

    Every document's bag of token ids is hashed and projected to four axes, whose Hilbert key
    orders the documents.  They are range-partitioned by (key, id, row), so even a key
    that a third of all documents share is spread.  The tokens of each
    partition are totalled, the running sum of the totals (a row per partition) is
    each partition's place, and the stream of all tokens is cut at every ``length``: every
    sequence but the last is full, so at most ``length - 1`` tokens are padding.

    A null or empty text is its end token alone; long texts run over many sequences; repeated rows
    are packed each (column row tells them apart); null ids sort first; an
    empty table gives no rows.  Other columns are not read.

    Returns one row per piece: id_col, row, start (ids of the document before it), length,
    ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = folder or tokenizer_dir()
    rows = docs.select(F.col(id_col).alias("id"), row_seq().alias("seq"),
                       token_rows(docs, folder, tokenizer, text_col).alias("t")).select("id", "seq", "t.*")
    rows = stage_table(rows, "pack-tokens")  # else range partitioning, which samples first, tokenizes twice
    sorted_ = rows.repartitionByRange("curve", "id", "seq").sortWithinPartitions("curve", "id", "seq")
    kind = dict(rows.dtypes)["id"]
    cols = f"id {kind}, seq long, curve long, n long, wide boolean, ids binary, before long"
    parts = stage_table(sorted_.mapInArrow(_running, cols).drop("curve")
                        .withColumn("part", F.spark_partition_id()), "pack-ids")
    totals = (parts.groupBy("part").agg(F.sum("n").alias("tokens"))
              .select("part", F.coalesce(F.sum("tokens").over(
                  W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base")))
    placed = (parts.join(F.broadcast(totals), "part")  # as many rows as range partitions, a setting
              .select("id", "seq", "n", "wide", "ids", (F.col("base") + F.col("before")).alias("at")))
    out = placed.mapInArrow(_pieces(length), f"id {kind}, row long, start long, length long, ids binary, "
                                             "doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
