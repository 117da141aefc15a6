"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words, hashed; pairs of neighbouring characters by class (letters by frequency and case, digits,
blanks, each kind of sign); and how its words are spread: by length, and by how often they recur within some hundred words.
All are shares per mille. The terms of a bounded labelled sample are weighted by rarity and
reduced by a truncated SVD; the reduced vectors are broadcast, every document is projected, and all its
cosines with all of them are computed in blocks. The nearest neighbours' labels vote with their similarity.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from digestlake.llm.decontaminate import _texts
from digestlake.llm.labelled import labelled_sample
from digestlake.llm.tables import id_and_text, slices
from digestlake.llm.words import EXACT_BYTES, MIX_1, STRETCH, Words, mix

#: The bound of the labelled rows whose vectors are broadcast: 1 MB of vectors.
TRAIN_ROWS = 4_096
DIMENSIONS, NEIGHBOURS, BLOCK = 48, 15, 1024
#: Similarities are raised to this power, so that near neighbours count for more.
SHARPNESS = 8


def _byte_classes() -> tuple[np.ndarray, int]:
    """A class for every byte: common letters alone, others by kind, every ASCII sign alone."""
    of, n = np.zeros(256, np.int64), 1
    for group in (*("a", "e", "i", "o", "n", "r", "s", "t", "h", "d", "l", "u"), "bcfgjkmpqvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c", *"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
        for c in group.encode():
            of[c] = n
        n += 1
    of[0x80:0xC0], of[0xC0:0xE0], of[0xE0:] = n, n + 1, n + 2
    return of, n + 3


CLASS_OF, CLASSES = _byte_classes()
#: Places that words are hashed to; words of a stretch within which recurrences count; bins of recurrence and of length.
WORD_PLACES, RECURRENCE, BINS = 1024, 200, 9
TERMS = CLASSES * CLASSES + WORD_PLACES + 2 * BINS


def term_counts(texts: list[bytes]) -> np.ndarray:
    """One row of float32 per text: the shares of its terms. All of a text counts; a text without words has none."""
    rows = np.zeros((len(texts), TERMS), np.float32)
    words = Words(texts, EXACT_BYTES)
    ends = np.cumsum([CLASSES * CLASSES, WORD_PLACES, BINS, BINS])
    for k, t in enumerate(texts):
        for a in range(0, max(0, len(t) - 1), STRETCH):
            c = CLASS_OF[np.frombuffer(t, np.uint8, min(STRETCH + 1, len(t) - a), a)]
            rows[k, : ends[0]] += np.bincount(c[:-1] * CLASSES + c[1:], minlength=ends[0]) * (1000.0 / len(t))
        own = slice(int(words.first[k]), int(words.first[k + 1]))
        names, n = words.name[own], own.stop - own.start
        if n:
            share = 1000.0 / n
            rows[k, ends[0] : ends[1]] = np.bincount((names % np.uint64(WORD_PLACES)).astype(np.int64), minlength=WORD_PLACES) * share
            _, which, times = np.unique(mix(names + (np.arange(n) // RECURRENCE).astype(np.uint64) * MIX_1), return_inverse=True, return_counts=True)
            rows[k, ends[1] : ends[2]] = np.bincount(np.minimum(BINS - 1, np.ceil(np.log2(times))).astype(np.int64), times, BINS) * share
            rows[k, ends[2] :] = np.bincount(np.minimum(BINS - 1, (words.end[own] - words.start[own]) // 4), minlength=BINS) * share
    return rows


@dataclass
class Neighbours:
    """The model: weights of terms, the projection, and the labelled vectors, of length 1."""

    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        v = (np.log1p(counts) * self.weight) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Exact cosines with all labelled vectors, BLOCK texts at a time."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        scores, m = [], len(self.labels)
        k = min(NEIGHBOURS, m)
        for a in range(0, len(counts), BLOCK):
            # steps of a millionth, so that neither a block's shape nor the order of sums shows; of equal cosines the first labelled row's counts
            steps = np.rint((self.project(counts[a : a + BLOCK]) @ self.vectors.T).astype(np.float64) * 1e6).astype(np.int64)
            near = np.sort(np.argpartition(steps * m - np.arange(m), m - k, axis=1)[:, m - k :], axis=1)
            weight = np.clip(np.take_along_axis(steps, near, axis=1) / 1e6, 1e-3, 1) ** SHARPNESS
            vote = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
            scores.append(np.where(counts[a : a + BLOCK].any(axis=1), vote, self.labels.mean()))
        return np.concatenate(scores).astype(np.float64) if scores else np.empty(0)


def fit(counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Neighbours:
    """Truncated SVD by power iteration on a random start of fixed seed."""
    rarity = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    x = np.log1p(counts) * rarity
    start = np.random.default_rng(7).standard_normal((x.shape[1], min(dimensions + 8, max(1, len(x))))).astype(np.float32)
    for _ in range(6):
        start, _ = np.linalg.qr(x.T @ (x @ start))
    _, _, turn = np.linalg.svd(x @ start, full_matrices=False)
    model = Neighbours(rarity, (start @ turn.T)[:, :dimensions].astype(np.float32), np.empty((0, 0), np.float32), labels.astype(np.float32))
    model.vectors = model.project(counts)
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Neighbours:
    """Learn from at most rows labelled documents, half of either label where there are as many.

    Their term counts, bounded by rows, come to the driver as sparse bytes.
    """
    sample = labelled_sample(docs, labels, rows, balanced=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, value = [], []
            for some in slices(_texts(b), len):
                for row in term_counts(some):
                    at = np.flatnonzero(row)
                    place.append(at.astype(np.int16).tobytes())
                    value.append(row[at].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("turn"), b.column("doc_id"), b.column("label"), pa.array(place, pa.binary()), pa.array(value, pa.binary())], ["turn", "doc_id", "label", "place", "value"])

    found = sorted(sample.mapInArrow(count, "turn long, doc_id long, label int, place binary, value binary").collect())
    counts = np.zeros((len(found), TERMS), np.float32)
    for k, r in enumerate(found):
        counts[k, np.frombuffer(r["place"], np.int16)] = np.frombuffer(r["value"], np.float32)
    if not found:
        return Neighbours(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.empty((0, 1), np.float32), np.empty(0, np.float32))
    return fit(counts, np.array([r["label"] for r in found]))


def quality(docs: DataFrame, model: Neighbours, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for every row. Null and empty texts have no terms and score the mean label of the sample;
    without labelled rows every score is 0.5. Of equally near neighbours those of lesser turn and doc_id vote. Repeated rows score
    equally; an empty table gives no rows. A very long text takes some 24 bytes a word."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [held.value.score(term_counts(some)) for some in slices(_texts(b), lambda t: len(t) + 8000)]
            s = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return id_and_text(docs).mapInArrow(score, "doc_id long, score double, predicted int")
