"""Stupid-backoff language-model scores of every document, with its own occurrences held out.

The score of a word after another is c(ab) / c(a) where the pair occurs outside of the document, else BACKOFF *
c(b) / N where the word does, else BACKOFF ** 2 / N. Counts are of all documents, less those of the scored one in
the numerators and the denominators alike.

Documents are dealt into packs by a hash of doc_id. A pack explodes its n-grams into its distinct ones, with their counts, as sorted
64-bit names that are cut by hash range; each range of names is summed over all packs into its part of the count
tables and joined back, in the same task, to what each pack asked; the answers return to the packs, whose
documents are then scored and summed. Names travel whole, as the gaps between sorted ones, so that two n-grams share
a count only where all 64 bits agree. The packs' exchange is made once and read twice.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestlake.llm.tables import id_and_text, slices
from digestlake.llm.words import SHINGLE_BYTES, Words, chain, mix
from digestlake.session import shuffle_partitions

BACKOFF = 0.4
#: Mean bytes of text in a pack, and of a range of names in all packs together.
PACK_BYTES, RANGE_BYTES = 8 << 20, 24 << 20
PAIR, SINGLE = 0x61, np.uint64(0x62)


def grams(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all words; names of all pairs by the place of the first; which of those lie within one text."""
    text = words.text_of()
    return mix(words.name ^ SINGLE), chain(words.name, 2, PAIR), text[:-1] == text[1:] if len(text) > 1 else np.empty(0, bool)


def pack_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a pack, sorted, and how often each occurs in it."""
    parts = []
    for some in slices(texts, len):
        single, pairs, inside = grams(Words(some, SHINGLE_BYTES))
        parts.append(np.unique(np.r_[single, pairs[inside]], return_counts=True))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def summed(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(names, kind="stable")
    names, counts = names[order], counts[order]
    first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else np.empty(0, np.int64)
    return names[first], np.add.reduceat(counts, first) if len(first) else counts


def narrow(names: np.ndarray) -> bytes:
    """Sorted distinct names, whole: the bytes of a gap, the first name, then each gap to the next in as many bytes as the widest takes."""
    gaps = np.diff(names)
    width = max(1, -(-int(gaps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + names[:1].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widen(raw: bytes) -> np.ndarray:
    width, rest = raw[0], np.frombuffer(raw, np.uint8, offset=9)
    gaps = np.zeros((len(rest) // width, 8), np.uint8)
    gaps[:, :width] = rest.reshape(-1, width)
    return np.cumsum(np.r_[np.frombuffer(raw, "<u8", 1, 1), gaps.view("<u8").reshape(-1)], dtype=np.uint64)


def log_scores(texts: list[bytes], names: np.ndarray, counts: np.ndarray, total: int, alpha: float = BACKOFF) -> Iterator[tuple[int, float]]:
    """Of each text: its words and the sum of its log scores. names: sorted, with their counts in all documents."""
    for some in slices(texts, len):
        words = Words(some, SHINGLE_BYTES)
        single, pairs, inside = grams(words)
        c_single = counts[np.searchsorted(names, single)] if len(single) else np.empty(0, np.int64)
        c_pairs = np.zeros(len(pairs), np.int64)
        c_pairs[inside] = counts[np.searchsorted(names, pairs[inside])]
        for k in range(len(some)):
            a, b = int(words.first[k]), int(words.first[k + 1])
            if a == b:
                yield 0, 0.0
                continue
            others = max(1, total - (b - a))
            own = lambda x: (u := np.unique(x, return_inverse=True, return_counts=True))[2][u[1]]
            word = c_single[a:b] - own(single[a:b])
            backed = np.where(word > 0, alpha * word, alpha**2) / others
            value = np.empty(b - a)
            value[0] = backed[0] / alpha  # the first word has no pair to back off from
            if b - a > 1:
                pair = c_pairs[a : b - 1] - own(pairs[a : b - 1])
                value[1:] = np.where(pair > 0, pair / np.maximum(word[:-1], 1), backed[1:])
            yield b - a, float(np.log(np.minimum(value, 1.0)).sum())


def lm_scores(docs: DataFrame, alpha: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, log_score (the sum over the words), mean_log_score (0 without words) for every row of docs.

    A null or empty text has no words and scores 0. Repeated rows score each, and count for one another.
    """
    docs = id_and_text(docs)
    n_words = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    size, total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(F.when(F.col("text").isNotNull(), n_words)), F.lit(0))).first()
    parts = shuffle_partitions(docs.sparkSession)
    packs = max(1, -(-size // PACK_BYTES))
    bits = max(0, int(size // RANGE_BYTES).bit_length())
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(packs)).cast("int").alias("pack"), "doc_id", "text").repartition(max(parts, min(packs, 20_000)), "pack")

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        names, counts = pack_grams(_bytes(frame))
        span = (names >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(names), np.int64)
        cuts = np.searchsorted(span, np.arange((1 << bits) + 1))
        rows = [(k, narrow(names[a:b]), counts[a:b].astype("<i4").tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
        out = pd.DataFrame(rows, columns=["range", "names", "counts"])
        out.insert(0, "pack", int(frame["pack"].iloc[0]))
        return out.astype({"range": "int32", "pack": "int32"})

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        asked = [widen(x) for x in frame["names"]]
        names, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for some in slices(list(zip(asked, frame["counts"], strict=True)), lambda x: len(x[0]), 4 << 20):
            names, counts = summed(np.concatenate([names, *(x[0] for x in some)]), np.concatenate([counts, *(np.frombuffer(x[1], "<i4") for x in some)]))
        width = 4 if counts.max(initial=0) < 2**31 else 8
        told = [counts[np.searchsorted(names, x)].astype(f"<i{width}").tobytes() for x in asked]
        return pd.DataFrame({"pack": frame["pack"], "range": frame["range"], "width": width, "told": told}).astype({"width": "int32"})

    def score(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        names, _ = pack_grams(_bytes(frame))  # in the order in which it asked
        told = told.sort_values("range")
        counts = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(t, f"<i{w}") for t, w in zip(told["told"], told["width"], strict=True))])
        found = list(log_scores(_bytes(frame), names, counts, total, alpha))
        n, s = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.float64)
        return pd.DataFrame({"doc_id": frame["doc_id"].array, "n_words": n, "log_score": s, "mean_log_score": s / np.maximum(n, 1)})

    asked = dealt.groupBy("pack").applyInPandas(ask, "pack int, range int, names binary, counts binary")
    told = asked.groupBy("range").applyInPandas(answer, "pack int, range int, width int, told binary")
    return dealt.groupBy("pack").cogroup(told.groupBy("pack")).applyInPandas(score, "doc_id long, n_words long, log_score double, mean_log_score double")


def _bytes(frame: pd.DataFrame) -> list[bytes]:
    return [t.encode() if isinstance(t, str) else b"" for t in frame["text"]]
