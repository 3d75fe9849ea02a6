"""SimHash near-duplicates by deletion-variant signatures of fingerprint segments."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import WORD, bound_batches, byte_texts, row_seq, stage_table
from stowage.llm.components import components

_WORD = re.compile(WORD.encode())
BITS = 64
#: Words of a run whose shingles are hashed at a time.
RUN = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, as an unsigned integer.

    A-Z are lower-cased; shingles are ``width`` words joined by spaces (fewer words: all of
    them; none: 0), repeats included; a bit is set if it is set in over half the hashes.
    """
    words = _WORD.findall(text.lower())
    if not words:
        return 0
    width = min(width, len(words))
    n, ones, digest = len(words) - width + 1, np.zeros(BITS, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, RUN):
        run = words[at:at + RUN + width - 1]
        shingles = [b" ".join(t) for t in zip(*(run[k:] for k in range(width)))]
        h = np.array([digest(s, 42) for s in shingles], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint_col(text: Column, width: int = 3) -> Column:
    """The fingerprint as a signed long (the same 64 bits)."""
    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, width) for t in byte_texts(texts)], dtype=np.uint64).view(np.int64))

    return simhash.asNondeterministic()(text)  # so that Spark doesn't evaluate it twice


def segments_for(max_bits: int) -> int:
    """The fewest segments such that, at ``max_bits`` differing bits, one segment differs by at most one bit."""
    return (max_bits + 2) // 2


def variant_keys(fps: DataFrame, max_bits: int) -> DataFrame:
    """Signatures of each fingerprint: (key, fp, side).

    The 64 bits are cut into ``m`` segments.  A segment has one exact signature and one
    variant for each of its bits with this bit taken out; ``side`` is the bit taken out
    (null for exact).  Two segments that are equal share the exact signature; two that differ in
    one bit share the variant of this bit, on different sides.
    """
    m = segments_for(max_bits)
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")  # narrow rows, many keys
    cuts = [BITS * k // m for k in range(m + 1)]
    rows = []
    for s in range(m):
        lo, n = cuts[s], cuts[s + 1] - cuts[s]
        seg = f"(shiftrightunsigned(fp, {lo}) & {(1 << n) - 1}L)" if n < BITS else "fp"
        rows.append(f"array(struct({s} as seg, -1 as bit, {seg} as rest, cast(null as int) as side))")
        rows.append(f"transform(sequence(0, {n - 1}), b -> struct({s} as seg, b as bit, "
                    f"{seg} & ~shiftleft(1L, b) as rest, cast(shiftrightunsigned({seg}, b) & 1L as int) as side))")
    return fps.select("fp", F.explode(F.expr(f"concat({', '.join(rows)})")).alias("k")).select(
        F.struct("k.seg", "k.bit", "k.rest").alias("key"), "fp", "k.side")


#: Fingerprints of one block of a crowded signature.
BLOCK = 256


def _cell_links(fps: np.ndarray, max_bits: int):
    """Links that connect, within one cell, all fingerprints joined by chains of at most ``max_bits`` steps."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits
    label = np.arange(len(fps))
    while True:
        low = np.where(near, label[None, :], len(fps)).min(1)
        low = np.minimum(low, label)
        if (low == label).all():
            break
        label = low
    member = np.flatnonzero(label != np.arange(len(fps)))
    return fps[member], fps[label[member]]


def crowded_links(cells: DataFrame, max_bits: int) -> DataFrame:
    """(a, b) links of cells: rows (key, i, j, fp), each cell bounded, partitioned and sorted by cell here."""
    def run(batches):
        held: list[np.ndarray] = []
        now = None
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.array(b.column("cell").to_numpy(zero_copy_only=False))
            fps = np.array(b.column("fp").to_numpy(zero_copy_only=False)).view(np.uint64)
            cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            out = []
            for first, last in zip([0, *cuts], [*cuts, len(ids)]):
                if now is not None and ids[first] != now:
                    out.append(_cell_links(np.unique(np.concatenate(held)), max_bits))
                    held = []
                now = ids[first]
                held.append(fps[first:last])
            if out:
                yield _links(out)
        if held:
            yield _links([_cell_links(np.unique(np.concatenate(held)), max_bits)])

    def _links(found):
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return (cells.select(F.xxhash64("key", "i", "j").alias("cell"), "fp").repartition("cell")
            .sortWithinPartitions("cell").mapInArrow(run, "a long, b long"))


def near_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``max_bits`` bits of each other.

    ``fps``: distinct fp.  Signatures are grouped first (a count and the smallest and largest
    fingerprint for each, pre-aggregated); a signature of one fingerprint, or whose
    fingerprints lie on one side, is done.  One of two fingerprints gives its pair at once.  The
    few with more are cut into blocks of about BLOCK fingerprints, and all
    pairs of blocks are verified in cells of bounded size, each of which returns a
    spanning forest of its links: every pair is compared, but not every pair written.
    """
    keys = variant_keys(fps, max_bits)
    n, ones = F.col("n"), F.col("ones")
    groups = (keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("side").alias("ones"),
                                      F.min("fp").alias("a"), F.max("fp").alias("b"))
              .where((n > 1) & (ones.isNull() | ((ones > 0) & (ones < n)))))
    groups = stage_table(groups.where((n > 2) | (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)),
                         "simhash-groups")
    pairs = groups.where("n = 2").select("a", "b")
    blocks = groups.where("n > 2").select(F.col("key").alias("gkey"),
                                          F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    cells = (keys.join(blocks, F.col("key") == F.col("gkey"))
             .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
             .select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .select("key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    return pairs.unionByName(crowded_links(cells, max_bits)).distinct()


def simhash_components(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """(fp, root): for each distinct fingerprint of ``prints`` (a column fp) its component's smallest."""
    fps = stage_table(prints.select("fp").distinct(), "simhash-fps")
    roots = stage_table(components(near_links(fps, max_bits)), "simhash-roots")
    return (fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
            .select("fp", F.coalesce("root", "fp").alias("root")))


def simhash_classes(docs: DataFrame, width: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Near-duplicate classes of documents by SimHash: id_col, fingerprint, component_id.

    Fingerprints of ``width``-word shingles link at ``max_bits`` or fewer differing
    bits; component_id is the smallest id reachable over links.  Copies share one
    fingerprint, so all work on links is done for distinct fingerprints only.

    Null, empty and blank texts have fingerprint zero and link like any other; repeated
    rows share a class and each get a row; a null id never names a class unless all ids of the
    class are null; an empty table gives no rows.  Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    prints = stage_table(docs.select(F.col(id_col).alias("id"), fingerprint_col(F.col(text_col), width).alias("fp")),
                         "simhash-prints")
    roots = simhash_components(prints, max_bits)
    low = prints.groupBy("fp").agg(F.min("id").alias("id")).join(roots, "fp")
    names = stage_table(low.groupBy("root").agg(F.min("id").alias("component_id"))
                        .join(roots, "root").select("fp", "component_id"), "simhash-names")
    return prints.join(names, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0"))
                                           .alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, width: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One document of each class (the smallest id, nulls last, then the first row), with the columns of ``docs``."""
    bound_batches(docs.sparkSession)
    own = [F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))
    rows = stage_table(docs.select(*own, key.alias("key_"), row_seq().alias("seq_"),
                                   fingerprint_col(F.col(text_col), width).alias("fp")), "simhash-rows")
    roots = simhash_components(rows.select("fp"), max_bits)
    # the first row of each fingerprint, then of each class: both pre-aggregated
    first = rows.groupBy("fp").agg(F.min(F.struct("key_", "seq_")).alias("first")).join(roots, "fp")
    keep = stage_table(first.groupBy("root").agg(F.min("first").alias("first")).select("first.seq_"), "simhash-keep")
    # always a merge join: were small inputs broadcast, the plan would change with the size
    return (rows.join(keep.hint("merge"), "seq_", "left_semi")
            .select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)]))
