"""Quality: nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import bound_batches, byte_texts, crc_rest, groups_by_bytes, hashed_counts
from stowage.llm.labelled import labelled_sample, with_score

#: Dimensions of each half of a hashed vector; the weight of the half of plain n-grams beside that of shapes.
DIMS, PLAIN = 1024, 0.3
#: Bytes of text whose shapes are made at a time; documents whose similarities are computed at a time.
SLICE, BLOCK = 1 << 20, 256

_KIND = np.arange(256, dtype=np.uint8)  # letters of a case, and digits, are one kind each; other ASCII bytes their own
_KIND[ord("a"):ord("z") + 1] = ord("a")
_KIND[ord("A"):ord("Z") + 1] = ord("A")
_KIND[ord("0"):ord("9") + 1] = ord("0")
_KIND[128:] = ord("a")
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_RUN = np.zeros(256, dtype=bool)
_RUN[[ord(c) for c in "aA0R"]] = True
_BYTE = np.random.default_rng(11).integers(1, 1 << 32, 256, dtype=np.uint32) | np.uint32(1)
_PLACE = np.random.default_rng(12).integers(1, 1 << 32, 64, dtype=np.uint32) | np.uint32(1)


def _slice_shape(text: bytes, before: int | None) -> tuple[bytes, int | None]:
    data = np.frombuffer(text, dtype=np.uint8)
    kind, word = _KIND[data], ~_BLANK[data]
    edge = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(start):
        begin = np.zeros(len(data), dtype=np.int64)
        begin[start] = start
        v = _BYTE[data] * _PLACE[(np.arange(len(data)) - np.maximum.accumulate(begin)) & 63]
        v[~word] = 0
        h = np.add.reduceat(v, start)
        again = np.concatenate([[before is not None and int(h[0]) == before], h[1:] == h[:-1]])
        mark = np.zeros(len(data) + 1, dtype=np.int32)
        mark[start[again]] += 1
        mark[end[again]] -= 1
        kind = np.where(np.cumsum(mark)[:-1] > 0, np.uint8(ord("R")), kind)
        before = int(h[-1])
    keep = np.ones(len(kind), dtype=bool)
    keep[1:] = (kind[1:] != kind[:-1]) | ~_RUN[kind[1:]]
    return kind[keep].tobytes(), before


def shape(text: bytes) -> bytes:
    """A text with each run of letters of one case, and of digits, as one character, and words that repeat the
    word before them as R.  Long texts are cut into slices after blanks."""
    out, at, before = [], 0, None
    while at < len(text):
        to = at + SLICE
        if to < len(text):
            cut = max(text.rfind(b" ", at, to), text.rfind(b"\n", at, to))
            to = cut + 1 if cut > at else to
        part, before = _slice_shape(text[at:to], before)
        out.append(part)
        at = to
    return b"".join(out)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def hashed_vectors(texts: list[bytes]) -> np.ndarray:
    """Two halves of hashed n-gram shares (square roots, unit length): plain bytes, and shapes."""
    def half(counts):
        return _unit(np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)))

    return np.hstack([PLAIN * half(hashed_counts(texts, (1, 2, 3), DIMS)),
                      half(hashed_counts([shape(t) for t in texts], (1, 2, 3, 4), DIMS))])


@dataclass
class QualityModel:
    """Latent-semantic projection (``mean``, ``axes``) and the labelled vectors with their votes."""
    mean: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    share: float
    neighbours: int

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = []
        for first, last in groups_by_bytes(texts, 1 << 20):
            for at in range(first, last, BLOCK):
                out.append(self._block(texts[at:min(at + BLOCK, last)]))
        return np.concatenate(out) if out else np.zeros(0)

    def _block(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.label):
            return np.full(len(texts), self.share)
        near = _unit((hashed_vectors(texts) - self.mean) @ self.axes) @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        # equal similarities, to the precision of the products, in the order of the labelled ids
        order = np.rint(near * 2.0 ** 20).astype(np.int64) * near.shape[1] - np.arange(near.shape[1])
        top = np.argpartition(-order, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** 4 * self.weight[top]
        total = vote.sum(1)
        return np.where(total > 0, (vote * self.label[top]).sum(1) / np.maximum(total, 1e-300), self.share)


def latent_axes(x: np.ndarray, rank: int) -> np.ndarray:
    """The first ``rank`` right singular vectors, by randomized subspace iteration with a fixed seed."""
    z = x @ np.random.default_rng(3).standard_normal((x.shape[1], rank + 32)).astype(x.dtype)
    for _ in range(4):
        z = x @ (x.T @ np.linalg.qr(z)[0])
    return np.linalg.svd(np.linalg.qr(z)[0].T @ x, full_matrices=False)[2][:rank].T


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", mod: int = 4, held: int = 2,
                per_class: int = 2048, rank: int = 64, neighbours: int = 10, id_col: str = "doc_id",
                text_col: str = "text") -> QualityModel:
    """Latent-semantic vectors of at most ``per_class`` labelled documents of each class.

    A document is a vector of hashed byte n-grams of its text and of its shape, made where
    the text is; the driver gets these vectors (at most 2 * per_class rows of 2 * DIMS floats)
    and keeps their first ``rank`` singular directions.  A labelled document votes with its class's
    size over the class's sample size, so classes keep their shares.
    Without labels of both classes the score is the constant share of label 1 (0.5 without labels).
    """
    sample, sizes = labelled_sample(docs, labels, label_col, per_class, mod, held, id_col, text_col)
    share = 0.5 if not sizes else sizes.get(1, 0) / sum(sizes.values())
    none = np.zeros(0)
    if len(sizes) < 2:
        return QualityModel(none, none, none, none, none, share, neighbours)

    def vectors(batches):
        for b in batches:
            texts = byte_texts(b.column("text"))
            for first, last in groups_by_bytes(texts, 1 << 20):
                v = hashed_vectors(texts[first:last]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column("sid")[first:last], b.column("label")[first:last],
                                                  pa.array([r.tobytes() for r in v], pa.binary())],
                                                 names=["sid", "label", "v"])

    kind = dict(sample.dtypes)["sid"]
    rows = sample.mapInArrow(vectors, f"sid {kind}, label int, v binary").orderBy("sid").toArrow()
    if not rows.num_rows:  # no labelled id among the documents
        return QualityModel(none, none, none, none, none, share, neighbours)
    x = np.frombuffer(b"".join(rows["v"].to_pylist()), dtype=np.float32).reshape(rows.num_rows, -1)
    y = rows["label"].to_numpy()
    mean = x.mean(0)
    axes = latent_axes(x - mean, min(rank, *x.shape)).astype(np.float32)
    there = np.array([max(1, (y == c).sum()) for c in (0, 1)])
    weight = np.array([sizes[0], sizes[1]])[y] / there[y]
    return QualityModel(mean, axes, _unit((x - mean) @ axes), y.astype(float), weight, share, neighbours)


def quality_score(text: Column, model: QualityModel) -> Column:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(byte_texts(texts)))

    return score.asNondeterministic()(text)


def score_quality(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, threshold: float = 0.7,
                  per_class: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Quality of every whole text: id_col, held_out, score (0 to 1), predicted (score at least ``threshold``).

    Exact cosines of each document with all labelled vectors, in blocks of documents; the nearest
    ``neighbours`` vote by the fourth power of their similarity; of equal similarities (to 2 ** -20) the smaller labelled
    ids vote.  Very long texts are hashed whole, in slices.  Null texts count as empty, which is the vector
    of no n-grams; repeated rows each get a row; a null id hashes as the empty text.  Only ``id_col`` and ``text_col`` are
    read, and the id only for held_out.
    """
    bound_batches(docs.sparkSession)
    model = fit_quality(docs, labels, mod=mod, held=held, per_class=per_class, id_col=id_col, text_col=text_col)
    out = docs.select(F.col(id_col), quality_score(F.col(text_col), model).alias("score"))
    return out.select(id_col, (crc_rest(F.col(id_col), mod) == held).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, threshold: float = 0.7,
                 per_class: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with a score of at least ``threshold``, with the columns of ``docs``.

    Null texts count as empty, very long ones are scored whole, repeated rows are judged alike.  Without labels of
    both classes among the documents nothing tells them apart, and all are kept; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    model = fit_quality(docs, labels, mod=mod, held=held, per_class=per_class, id_col=id_col, text_col=text_col)
    if not len(model.label):
        return docs
    scored, col = with_score(docs, quality_score(F.col(text_col), model))
    return scored.where(F.col(col) >= threshold).select(*docs.columns)
