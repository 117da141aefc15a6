"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words, pairs of neighbours and pairs with one word between (skip-grams) are hashed to SPACE places, and so are the stems
of long words; a feature is there or not. Per-coordinate learning rates and L1 shrinkage leave few weights that are not zero; those are
what is broadcast.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from digestlake.llm.decontaminate import WORD_BYTES, _texts
from digestlake.llm.labelled import labelled_sample
from digestlake.llm.tables import id_and_text, slices
from digestlake.llm.words import Words, chain, mix

SPACE = 1 << 20
STEM_BYTES = 4
#: The bound of the labelled rows that are learnt from.
TRAIN_ROWS = 8_192
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 8.0, 1.0, 4


@dataclass
class Weights:
    """The model: places of weights that are not zero, the weights, and the bias."""

    place: np.ndarray
    weight: np.ndarray
    bias: float


def stems(words: Words) -> np.ndarray:
    """Names of the first STEM_BYTES bytes of words that are longer, 0 for others."""
    code = np.frombuffer(words.raw, np.uint8)
    name = np.zeros(len(words.name), np.uint64)
    long = np.flatnonzero(words.end - words.start > STEM_BYTES)
    for k in range(STEM_BYTES):
        name[long] = name[long] << np.uint64(8) | code[words.start[long] + k]
    return name


def features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed features and the text each is of, by kind: words, their stems, pairs, skip-grams.

    Stems stand in for forms of a word that the sample does not hold.
    """
    text = words.text_of()
    names = words.name
    skip = mix(names[:-2] * np.uint64(0xD6E8FEB86659FD93) ^ names[2:] ^ np.uint64(0x33)) if len(names) > 2 else names[:0]
    stem = stems(words)
    there = stem > 0
    yield (mix(stem[there] ^ (np.uint64(0x44) << np.uint64(56))) & np.uint64(SPACE - 1)).astype(np.int32), text[there]
    for made, span in ((mix(names ^ np.uint64(0x11)), 1), (chain(names, 2, 0x22), 2), (skip, 3)):
        inside = text[: len(made)] == text[span - 1 : span - 1 + len(made)]
        yield (made[inside] & np.uint64(SPACE - 1)).astype(np.int32), text[: len(made)][inside]


def feature_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The distinct features of each text."""
    for some in slices(texts, len):
        parts = list(features(Words(some, WORD_BYTES)))
        cuts = [np.searchsorted(text, np.arange(len(some) + 1)) for _, text in parts]
        for k in range(len(some)):
            yield np.unique(np.concatenate([f[c[k] : c[k + 1]] for (f, _), c in zip(parts, cuts, strict=True)]))


def fit(sets: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> Weights:
    """FTRL-proximal over the rows in the order given. Without rows of both labels the weights are all zero."""
    z, n = np.zeros(SPACE + 1), np.zeros(SPACE + 1)
    share = float(np.mean(labels)) if len(labels) else 0.5
    l1 = np.full(SPACE + 1, L1)
    l1[SPACE] = 0.0  # the bias, last of each row's features, is not shrunk to zero

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1[at], 0.0, -(zi - np.sign(zi) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    if 0 < share < 1:
        for _ in range(epochs):
            for at, y in zip(sets, labels.tolist(), strict=True):
                at = np.r_[at, SPACE]
                w = weights(at)
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
                sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
                z[at] += g - sigma * w
                n[at] += g * g
    every = weights(np.arange(SPACE + 1))
    place = np.flatnonzero(every[:SPACE])
    return Weights(place.astype(np.int32), every[place].astype(np.float32), float(every[SPACE]))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Weights:
    """Learn from at most rows labelled documents; labels has doc_id and label columns. One task learns, as FTRL
    takes rows in order; what it holds is bounded by rows."""
    sample = labelled_sample(docs, labels, rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, y = [], []
        for b in batches:
            sets += feature_sets(_texts(b))
            y += b.column("label").to_pylist()
        w = fit(sets, np.array(y, np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([w.place.tobytes()]), pa.array([w.weight.tobytes()]), pa.array([w.bias])], ["place", "weight", "bias"])

    ordered = sample.repartition(1).sortWithinPartitions("turn", "doc_id", "text")
    row = ordered.mapInArrow(learn, "place binary, weight binary, bias double").first()
    if row is None:
        return Weights(np.empty(0, np.int32), np.empty(0, np.float32), 0.0)
    return Weights(np.frombuffer(row["place"], np.int32), np.frombuffer(row["weight"], np.float32), row["bias"])


class Scorer:
    def __init__(self, model: Weights):
        self.bias = model.bias
        self.dense = np.zeros(SPACE, np.float32)
        self.dense[model.place] = model.weight

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        scores = []
        for some in slices(texts, len):
            at, text = [], []
            for f, t in features(Words(some, WORD_BYTES)):
                hit = np.flatnonzero(self.dense[f])
                at.append(f[hit].astype(np.int64))
                text.append(t[hit])
            once = np.unique(np.concatenate(text) * SPACE + np.concatenate(at))
            margin = self.bias + np.bincount(once // SPACE, self.dense[once % SPACE], len(some))
            scores.append(1 / (1 + np.exp(-np.clip(margin, -35, 35))))
        return np.concatenate(scores) if scores else np.empty(0)


def toxicity(docs: DataFrame, model: Weights, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for every row. Null and empty texts get the bias alone; repeated rows equal scores."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            s = scorer(_texts(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return id_and_text(docs).mapInArrow(score, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: Weights, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            yield b.filter(pa.array(scorer(_texts(b)) < threshold))

    return docs.mapInArrow(clean, docs.schema)
