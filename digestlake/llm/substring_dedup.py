"""Removal of repeated passages by recompression.

Recompression rewrites a text in rounds. Each round first names maximal runs of one symbol, then names pairs of a left and
a right symbol; which side a symbol is on, and every name, is a hash of what it stands for, so that all tasks name alike without
a dictionary. Equal passages so get the same symbols inside, whatever surrounds them. Beside each symbol stands its context:
the words that fix it, its own and a few around. A window of consecutive words is held by its anchor: of the
symbols whose context it covers one of the highest round, by hash. Equal windows have equal anchors.

Spark then finds the anchors that several documents share, names the windows that these hold, finds in which document each
window name starts first, and takes from every later document the words under its windows. Texts move only to the
documents' own keys, and only names, never windows or pairs of documents, are exchanged otherwise.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestlake.llm.decontaminate import _texts
from digestlake.llm.tables import id_and_text, slices
from digestlake.llm.words import EXACT_BYTES, Words, chain, mix
from digestlake.session import discard, stash

WINDOW = 13
#: More rounds give symbols of more words, but wider contexts, so that more anchors are needed to hold all windows: on prose of
#: short words 0.17, 0.19, 0.23, 0.33 and 0.42 a word for one to five rounds.
ROUNDS = 3
RUN, JOIN, STEP = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), 0x9E3779B97F4A7C15
STEP_BACK = pow(STEP, -1, 1 << 64)


class Symbols:
    """The symbols of one round: names, first and last word, and the context lo ... hi. first, last: of each symbol's document."""

    def __init__(self, name, start, end, lo, hi, first, last):
        self.name, self.start, self.end, self.lo, self.hi, self.first, self.last = name, start, end, lo, hi, first, last

    def beside(self) -> np.ndarray:
        """Which symbols follow another of the same document."""
        return np.r_[False, self.first[1:] == self.first[:-1]] if len(self.name) else np.empty(0, bool)

    def runs(self, word: np.ndarray) -> "Symbols":
        """Maximal runs of one symbol become one. That a run ends is seen from the next word if this differs from where the
        symbol would go on, else from the whole next symbol."""
        n = len(self.name)
        head = np.flatnonzero(~(self.beside() & np.r_[False, self.name[1:] == self.name[:-1]]))
        size = np.diff(np.r_[head, n])
        tail = head + size - 1
        name = np.where(size > 1, mix(self.name[head] * RUN + size.astype(np.uint64)), self.name[head])
        start, end, first, last = self.start[head], self.end[tail], self.first[head], self.last[head]
        lo, hi = np.minimum.reduceat(self.lo, head), np.maximum.reduceat(self.hi, head)
        before, after = np.maximum(head - 1, 0), np.minimum(tail + 1, n - 1)
        same = (start > first) & (word[np.maximum(start - 1, 0)] == word[end])
        new_lo = np.where(same, np.minimum(lo, self.lo[before]), np.minimum(lo, start - 1))
        new_hi = np.where(same, np.maximum(hi, self.hi[before]), hi)
        same = (end < last) & (word[np.minimum(end + 1, len(word) - 1)] == word[self.start[tail]])
        new_lo = np.where(same, np.minimum(new_lo, self.lo[after]), new_lo)
        new_hi = np.where(same, np.maximum(new_hi, self.hi[after]), np.maximum(new_hi, end + 1))
        return Symbols(name, start, end, new_lo, new_hi, first, last)

    def pairs(self, turn: int) -> "Symbols":
        """A left symbol and a right one after it become one. That one stays alone is seen from its whole neighbour."""
        n = len(self.name)
        right = (mix(self.name ^ mix(np.array([turn + 1], np.uint64))) & np.uint64(1)).astype(bool)
        beside = self.beside()
        second = beside & right & np.r_[False, ~right[:-1]]
        joins = np.r_[second[1:], False]
        head = np.flatnonzero(~second)
        j, alone = joins[head], ~joins[head]
        next_ = np.minimum(head + 1, n - 1)
        name = np.where(j, mix(self.name[head] * JOIN + self.name[next_]), self.name[head])
        start, first, last = self.start[head], self.first[head], self.last[head]
        end = np.where(j, self.end[next_], self.end[head])
        on_right = right[head]
        # the neighbour that matters: the joined or next symbol of a left one, the previous one of a right one
        other = np.where(j | ~on_right, next_, np.maximum(head - 1, 0))
        there = np.where(alone & on_right, start > first, self.end[head] < last)
        lo = np.where(there, np.minimum(self.lo[head], self.lo[other]), np.where(on_right, first - 1, self.lo[head]))
        hi = np.where(there, np.maximum(self.hi[head], self.hi[other]), np.where(on_right, self.hi[head], last + 1))
        return Symbols(name, start, end, lo, hi, first, last)


def rounds(words: Words) -> Iterator[Symbols]:
    n = np.diff(words.first)
    at = np.arange(len(words.name))
    s = Symbols(words.name, at, at, at, at, np.repeat(words.first[:-1], n), np.repeat(words.first[1:] - 1, n))
    yield s
    for turn in range(ROUNDS):
        s = s.runs(words.name).pairs(turn)
        yield s


def anchors(words: Words, window: int = WINDOW) -> np.ndarray:
    """The anchor of the window that starts at each word; 0 where no whole window of the document starts."""
    n = len(words.name)
    best = np.zeros(n, np.uint64)
    if not n:
        return best
    sizes = np.diff(words.first)
    starts = np.repeat(words.first[1:] - window, sizes) >= np.arange(n)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(n, STEP, np.uint64)])
    back = np.cumprod(np.r_[np.uint64(1), np.full(n, STEP_BACK, np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum(words.name * powers[:n], dtype=np.uint64)]
    for level, s in reversed(list(enumerate(rounds(words)))):
        open_ = np.r_[0, np.cumsum(starts & (best == 0))]
        if not open_[-1]:
            break
        from_, to = np.maximum(s.hi - window + 1, s.first), s.lo
        held = np.flatnonzero((s.hi - s.lo < window) & (s.lo >= s.first) & (s.hi <= s.last))
        held = held[open_[to[held] + 1] > open_[from_[held]]]
        from_, to, lo, hi = from_[held], to[held], s.lo[held], s.hi[held]
        key = mix((sums[hi + 1] - sums[lo]) * back[lo] + (hi - lo).astype(np.uint64))
        key = np.uint64(level + 1) << np.uint64(60) | key >> np.uint64(4)
        here = np.zeros(n, np.uint64)
        for d in range(window):
            reach = from_ + d <= to
            np.maximum.at(here, from_[reach] + d, key[reach])
        fill = starts & (best == 0)
        best[fill] = here[fill]
    return best


def _anchored(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, anchor: the distinct anchors of each document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for some in slices(list(zip(ids.tolist(), _texts(b), strict=True)), lambda x: len(x[1])):
                words = Words([t for _, t in some], EXACT_BYTES)
                found = anchors(words, window)
                keys = [np.unique(found[a:e]) for a, e in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
                keys = [k[k > 0] for k in keys]
                owner = np.repeat(np.array([i for i, _ in some], np.int64), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(keys).view(np.int64))], ["doc_id", "anchor"])

    return docs.mapInArrow(find, "doc_id long, anchor long")


def _window_names(docs: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """doc_id, name, proof: the distinct windows that shared anchors hold, of the documents in shared (doc_id, anchors).

    name has 64 bits, proof 32 bits of another name that is made of another naming of the words. Windows of which both
    agree, 96 bits, are taken as equal.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(b.column("doc_id").to_pylist(), _texts(b), b.column("anchors"), strict=True))
            for some in slices(rows, lambda x: len(x[1])):
                words = Words([t for _, t, _ in some], EXACT_BYTES, proofs=True)
                found, (names, proofs) = anchors(words, window).view(np.int64), named(words, window)
                for (doc_id, _, keys), a, e in zip(some, words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                    own = found[a : max(a, e - window + 1)]
                    hit = np.isin(own, keys.values.to_numpy())
                    held, proof = names[a : a + len(own)][hit], proofs[a : a + len(own)][hit]
                    order = np.lexsort((proof, held))
                    held, proof = held[order], proof[order]
                    once = np.r_[True, (held[1:] != held[:-1]) | (proof[1:] != proof[:-1])][: len(held)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(once.sum()), doc_id, np.int64)), pa.array(held[once]), pa.array(proof[once])], ["doc_id", "name", "proof"])

    return docs.join(shared, "doc_id").select("doc_id", "text", "anchors").mapInArrow(_joined(name), "doc_id long, name long, proof int")


def named(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The name and the proof of the window that starts at each word."""
    return chain(words.name, window, window).view(np.int64), (chain(words.proof, window, 1000 + window) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _joined(make):
    """Gathers the many small batches that make yields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in make(batches):
            held.append(b)
            n += b.num_rows
            if n > 100_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if n:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _first_of(rows: DataFrame, *key: str) -> DataFrame:
    """key, first: for each key in several documents, the least doc_id."""
    return rows.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("other")).where("first < other").select(*key, "first")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, names (array of struct<name, proof>): of each document its windows that start in one with a smaller doc_id too."""
    docs = id_and_text(docs).where("doc_id is not null and text is not null")
    anchored = stash(_anchored(docs, window), "anchors")
    shared = stash(anchored.join(_first_of(anchored, "anchor"), "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors")), "shared")
    discard(anchored)
    windows = stash(_window_names(docs, shared, window), "windows")
    discard(shared)
    first = stash(_first_of(windows, "name", "proof"), "first")  # the shuffle of the aggregate goes before that of the join begins
    repeats = stash(windows.join(first, ["name", "proof"]).where("doc_id > first").groupBy("doc_id").agg(F.collect_list(F.struct("name", "proof")).alias("names")), "repeats")
    discard(windows, first)
    return repeats


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) for every row of docs.

    A word goes if a window of consecutive words that covers it also starts in a document with a smaller doc_id;
    windows are judged on the input. Null and empty texts have no words. Rows without a doc_id, and repeats within one
    document or in rows of one doc_id, stay. An empty table gives no rows. A very long text is taken whole by one task, at some
    300 bytes a word.
    """
    return _kept(docs, window, "kept", lambda kept: kept.decode())


def kept_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """As without_repeats, with the SHA-256 digest of the kept words made where the texts are."""
    return _kept(docs, window, "kept_sha256", lambda kept: hashlib.sha256(kept).hexdigest())


def _kept(docs: DataFrame, window: int, column: str, shape) -> DataFrame:
    docs = id_and_text(docs)
    repeats = repeated_windows(docs, window)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept = [], [], []
            for text, names in zip(_texts(b), b.column("names"), strict=True):
                words = text.translate(EXACT_BYTES).split()
                n.append(len(words))
                cover = np.zeros(len(words), bool)
                if names.is_valid and len(words) >= window:
                    known, proved = (names.values.field(k).to_numpy() for k in (0, 1))
                    own, proofs = named(Words([text], EXACT_BYTES, proofs=True), window)
                    hit = np.isin(own, known)
                    at = np.flatnonzero(hit)
                    right = set(zip(known.tolist(), proved.tolist(), strict=True))
                    hit[at] = [pair in right for pair in zip(own[at].tolist(), proofs[at].tolist(), strict=True)]
                    depth = np.zeros(len(words) + 1, np.int64)
                    depth[: len(hit)] += hit
                    depth[window : window + len(hit)] -= hit
                    cover = np.cumsum(depth)[:-1] > 0
                gone.append(int(cover.sum()))
                kept.append(shape(b" ".join([w for w, c in zip(words, cover.tolist(), strict=True) if not c] if gone[-1] else words)))
            columns = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", column])

    return docs.join(repeats, "doc_id", "left").select("doc_id", "text", "names").mapInArrow(strip, f"doc_id long, n_words long, n_removed long, {column} string")
