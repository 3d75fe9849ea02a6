"""A bounded sample of labelled documents, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import crc_rest, fresh, stage_table


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, mod: int, held: int,
                    id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(text, label) of at most ``per_class`` labelled documents of each class, and the size of each class.

    Only ids with crc32(id as text) mod ``mod`` other than ``held`` are learnt from.  Rows
    without id or label don't count; an id labelled twice has the larger label; of rows with
    one id the smallest text counts.  The chosen ids are the first by hash, and
    being at most 2 * per_class rows they are broadcast, so texts aren't shuffled.
    """
    lab = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
           .groupBy(F.col(id_col).alias("sid")).agg(F.max(label_col).cast("int").alias("label"))
           .where(crc_rest(F.col("sid"), mod) != held))
    sizes = {int(r["label"]): int(r["n"]) for r in lab.where("label in (0, 1)").groupBy("label")
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [lab.where(F.col("label") == c).orderBy(F.xxhash64("sid"), "sid").limit(per_class) for c in (0, 1)]
    chosen = stage_table(parts[0].unionByName(parts[1]), "labelled-ids")
    text = docs.select(F.col(id_col).alias("sid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = text.join(F.broadcast(chosen), "sid").groupBy("sid", "label").agg(F.min("text").alias("text"))
    return stage_table(found.select("sid", "text", "label"), "labelled-texts").orderBy("sid"), sizes


def with_score(docs: DataFrame, score, name: str = "score") -> tuple[DataFrame, str]:
    """``docs`` and one more column, under a name that ``docs`` doesn't have."""
    col = fresh(docs, name)
    return docs.withColumn(col, score), col
