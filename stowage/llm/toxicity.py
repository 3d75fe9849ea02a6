"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import PIECE, bound_batches, byte_texts, crc_rest, groups_by_bytes, ngram_hashes
from stowage.llm.labelled import labelled_sample

#: n-gram orders, and slots of their hashes.
ORDERS, SLOTS = (3, 4, 5, 6), 1 << 19
#: Chi-square (one degree of freedom) that one n-gram in a thousand without any bearing on the label reaches by chance.
CHANCE = 10.83


def _padded(text: bytes) -> bytes:
    return b" " + text.lower() + b" "


def _hashes(text: bytes):
    """Hashes of all n-grams of a text, a slice at a time."""
    whole = np.frombuffer(_padded(text), dtype=np.uint8)
    for at in range(0, len(whole), PIECE):
        for n in ORDERS:
            yield ngram_hashes(whole[at:at + PIECE + n - 1], n) & np.uint32(SLOTS - 1)


def distinct_grams(text: bytes) -> np.ndarray:
    seen = np.zeros(SLOTS, dtype=bool)
    for h in _hashes(text):
        seen[h] = True
    return np.flatnonzero(seen).astype(np.int32)


def chosen_grams(texts: list[bytes], place: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the chosen n-grams of each text, each pair once, in order.  ``place``: slot -> feature or -1."""
    found = [np.zeros(0, dtype=np.int64)]
    for first, last in groups_by_bytes(texts, PIECE):
        if last - first == 1:
            for h in _hashes(texts[first]):
                p = place[h]
                found.append(np.unique(p[p >= 0]) + np.int64(first * features))
            continue
        padded = [_padded(t) for t in texts[first:last]]
        lens = np.array([len(t) for t in padded])
        data = np.frombuffer(b"".join(padded), dtype=np.uint8)
        ends = np.repeat(np.cumsum(lens), lens)
        doc = np.repeat(np.arange(first, last), lens)
        for n in ORDERS:
            h = ngram_hashes(data, n) & np.uint32(SLOTS - 1)
            p = place[h]
            hit = np.flatnonzero(p >= 0)
            hit = hit[hit + n <= ends[hit]]
            found.append(np.unique(doc[hit] * features + p[hit]))
    return np.divmod(np.unique(np.concatenate(found)), max(features, 1))


@dataclass
class ToxicModel:
    """``weight`` of each chosen n-gram (its log-count ratio times the fitted weight), ``bias``; slot -> feature."""
    place: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        doc, feature = chosen_grams(texts, self.place, len(self.weight))
        z = np.bincount(doc, weights=self.weight[feature], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_logistic(doc: np.ndarray, feature: np.ndarray, scale: np.ndarray, y: np.ndarray, rows: np.ndarray,
                 steps: int = 300, l2: float = 1e-4):
    """Weights and bias of a logistic regression with row weights, by adaptive full-batch gradients.

    Row ``doc`` has the value ``scale[feature]`` at each ``feature`` paired with it, else 0.
    """
    w, b = np.zeros(len(scale)), 0.0
    gw, gb = np.full(len(scale), 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(doc, weights=(w * scale)[feature], minlength=len(y)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * rows
        g = np.bincount(feature, weights=e[doc], minlength=len(scale)) * scale + l2 * w
        gw += g * g
        gb += e.sum() ** 2
        w -= 0.5 * g / np.sqrt(gw)
        b -= 0.5 * e.sum() / np.sqrt(gb)
    return w, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", mod: int = 5, held: int = 0,
                 per_class: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """Fit on at most ``per_class`` labelled documents of each class.

    The n-grams of order 3 to 6 of a lower-cased text count once per text.  Each one's ratio is
    r = log((p / |p|) / (q / |q|)) of its smoothed document counts in both classes.  All n-grams take part whose
    chi-square chance doesn't explain (CHANCE; in small samples a quarter of the texts, as none can have more
    than their number), however many they are, and a logistic regression is fitted on
    r times presence, rows weighted so that the classes keep their shares.  Counts and presence are
    found where the texts are; the driver gets one count pair per slot and the features of each sampled text.
    Without documents of both classes the score is the constant share of label 1 (0.5 without labels).
    """
    sample, sizes = labelled_sample(docs, labels, label_col, per_class, mod, held, id_col, text_col)
    docs0, docs1 = (sample.where(F.col("label") == c).count() for c in (0, 1))
    if not (docs0 and docs1):
        share = 0.5 if not sizes else float(np.clip(sizes.get(1, 0) / sum(sizes.values()), 1e-9, 1 - 1e-9))
        return ToxicModel(np.full(SLOTS, -1, np.int32), np.zeros(0), float(np.log(share / (1 - share))))

    def grams(batches):
        n = np.zeros((2, SLOTS), dtype=np.int64)
        for b in batches:
            for t, y in zip(byte_texts(b.column("text")), b.column("label").to_pylist()):
                n[y, distinct_grams(t)] += 1
        used = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[0, used]), pa.array(n[1, used])],
                                         names=["slot", "n0", "n1"])

    found = (sample.mapInArrow(grams, "slot long, n0 long, n1 long").groupBy("slot")
             .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow())  # SLOTS rows at most
    n0, n1 = np.zeros(SLOTS), np.zeros(SLOTS)
    slot = found["slot"].to_numpy()
    n0[slot], n1[slot] = found["n0"].to_numpy(), found["n1"].to_numpy()
    ratio = np.log((n1 + 1) / (n1 + 1).sum()) - np.log((n0 + 1) / (n0 + 1).sum())
    both, total = n0 + n1, docs0 + docs1
    chi = (n1 * (docs0 - n0) - n0 * (docs1 - n1)) ** 2 * total / np.maximum(
        both * (total - both) * docs0 * docs1, 1e-9)
    top = np.flatnonzero(chi >= min(CHANCE, total / 4))
    place = np.full(SLOTS, -1, dtype=np.int32)
    place[top] = np.arange(len(top))

    def present(batches):
        for b in batches:
            texts = byte_texts(b.column("text"))
            doc, feature = chosen_grams(texts, place, len(top))
            upto = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("sid"), b.column("label"), pa.ListArray.from_arrays(
                pa.array(upto), pa.array(feature.astype(np.int32)))], names=["sid", "label", "has"])

    kind = dict(sample.dtypes)["sid"]
    rows = (sample.mapInArrow(present, f"sid {kind}, label int, has array<int>").orderBy("sid").toArrow()
            .combine_chunks())  # 2 * per_class rows at most
    feature = rows["has"].combine_chunks().flatten().to_numpy()
    doc = np.repeat(np.arange(rows.num_rows), pa.compute.list_value_length(rows["has"]).to_numpy())
    y = rows["label"].to_numpy().astype(float)
    share = sizes[1] / (sizes[0] + sizes[1])
    w, b = fit_logistic(doc, feature, ratio[top], y, np.where(y == 1, share / max(docs1, 1), (1 - share) / max(docs0, 1)))
    return ToxicModel(place, w * ratio[top], float(b))


def toxicity_score(text: Column, model: ToxicModel) -> Column:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(byte_texts(texts)))

    return score.asNondeterministic()(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, per_class: int = 2048,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Toxicity of every whole text: id_col, held_out, score (0 to 1), predicted (score at least 0.5).

    Null texts count as empty, whose score is the model's bias; repeated rows each get a row; a null id
    hashes as the empty text.  Only ``id_col`` and ``text_col`` are read, and the id only for held_out.
    """
    bound_batches(docs.sparkSession)
    model = fit_toxicity(docs, labels, mod=mod, held=held, per_class=per_class, id_col=id_col, text_col=text_col)
    out = docs.select(F.col(id_col), toxicity_score(F.col(text_col), model).alias("score"))
    return out.select(id_col, (crc_rest(F.col(id_col), mod) == held).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
