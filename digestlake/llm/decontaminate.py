"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item gives windows of consecutive words (a shorter item is one window). The shingles of all
windows, pairs of neighbouring words, are ordered by how rare they are in the documents; containment of a
whole window needs its rarest shingle, so that one prefix shingle per window is looked up among the shingles of
each document. A hit must lie where the whole window fits (length and position), and all its words are then compared.

The benchmark is read in slices of at most SLICE_BYTES of text, each broadcast by itself, against all documents.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestlake.llm.tables import id_and_text, slices
from digestlake.llm.words import Words, byte_table, chain, mix

WINDOW = 10
#: Bound of the benchmark text that is collected and broadcast at once.
SLICE_BYTES = 16 << 20
#: Words are runs of ASCII letters, digits and everything beyond ASCII, lower-cased in A-Z.
WORD_BYTES = byte_table(letters=b"abcdefghijklmnopqrstuvwxyz0123456789")
PAIR, SINGLE = 0x51, 0x52


def shingle_names(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring words by the place of the first (also across texts: positions are checked later), and single words."""
    return chain(words.name, 2, PAIR), mix(words.name ^ np.uint64(SINGLE))


class WindowIndex:
    """The windows of some items, and their prefix shingles once rarity is known."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        words = Words([t for _, t in items], WORD_BYTES)
        pairs, singles = shingle_names(words)
        self.items = [i for i, _ in items]
        ends = words.first
        counts = np.diff(ends)
        sizes = np.minimum(counts, window)
        each = np.where(counts > 0, counts - sizes + 1, 0)
        owner = np.repeat(np.arange(len(items)), each)
        begin = ends[:-1][owner] + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        size = sizes[owner]
        known: dict[bytes, int] = {}
        window_of = np.empty(len(begin), np.int64)
        names, kept = words.name, []
        for k, (a, n) in enumerate(zip(begin.tolist(), size.tolist(), strict=True)):
            window_of[k] = known.setdefault(names[a : a + n].tobytes(), len(known))
            if window_of[k] == len(kept):
                kept.append(k)
        self.begin, self.size = begin[kept], size[kept]
        self.names = names
        order = np.argsort(window_of, kind="stable")
        self.item_of, self.item_cut = owner[order], np.searchsorted(window_of[order], np.arange(len(kept) + 1))
        width = np.maximum(self.size - 1, 1)
        self._window = np.repeat(np.arange(len(kept)), width)
        self._offset = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
        at = self.begin[self._window] + self._offset
        self._shingle = np.where(self.size[self._window] > 1, pairs[np.minimum(at, len(pairs) - 1)] if len(pairs) else 0, singles[at]) if len(at) else np.empty(0, np.uint64)
        self.shingles = np.unique(self._shingle)

    def order_by_rarity(self, counts: np.ndarray) -> None:
        """counts: of each of self.shingles in the documents. The rarest shingle of each window becomes its prefix."""
        rarity = counts[np.searchsorted(self.shingles, self._shingle)]
        order = np.lexsort((self._offset, self._shingle, rarity, self._window))
        first = order[np.r_[True, np.diff(self._window[order]) > 0]] if len(order) else order
        by_name = first[np.argsort(self._shingle[first], kind="stable")]
        self.prefix, self.prefix_cut = np.unique(self._shingle[by_name], return_index=True)
        self.prefix_cut = np.r_[self.prefix_cut, len(by_name)]
        self.post_window, self.post_offset = self._window[by_name], self._offset[by_name]
        del self._shingle, self._window, self._offset

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Windows that occur, and the place of the first word of each occurrence."""
        found = [np.empty((2, 0), np.int64)]
        for names in shingle_names(words):
            place, slot = look_up(self.prefix, names)
            n = self.prefix_cut[slot + 1] - self.prefix_cut[slot]
            post = np.repeat(self.prefix_cut[slot] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            window, at = self.post_window[post], np.repeat(place, n) - self.post_offset[post]
            size = self.size[window]
            text = np.searchsorted(words.first, np.repeat(place, n), side="right") - 1
            fits = (at >= words.first[text]) & (at + size <= words.first[text + 1])
            window, at = window[fits], at[fits]
            for k in range(int(self.size.max(initial=0))):
                live = k < self.size[window]
                same = ~live
                same[live] = self.names[self.begin[window[live]] + k] == words.name[at[live] + k]
                window, at = window[same], at[same]
            found.append(np.stack([window, at]))
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1))


def look_up(sorted_names: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where names are among sorted_names: places in names, and slots in sorted_names. A bit table settles most."""
    if not len(sorted_names) or not len(names):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits = np.uint64(64 - max(16, min(24, int(len(sorted_names)).bit_length() + 4)))
    table = np.zeros(1 << (64 - int(bits)), bool)
    table[(sorted_names >> bits).astype(np.int64)] = True
    place = np.flatnonzero(table[(names >> bits).astype(np.int64)])
    slot = np.searchsorted(sorted_names, names[place])
    slot[slot == len(sorted_names)] = 0
    good = sorted_names[slot] == names[place]
    return place[good], slot[good]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _rarity(docs: DataFrame, shingles: np.ndarray) -> np.ndarray:
    """How often each shingle occurs in all documents: summed per task, then by Spark."""
    held = docs.sparkSession.sparkContext.broadcast(shingles)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value), np.int64)
        for b in batches:
            for some in slices(_texts(b), len):
                for names in shingle_names(Words(some, WORD_BYTES)):
                    np.add.at(total, look_up(held.value, names)[1], 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["shingle", "n"])

    rows = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toPandas()
    held.unpersist()
    counts = np.zeros(len(shingles), np.int64)
    counts[rows["shingle"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def indexes(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> Iterator[WindowIndex]:
    """One index per slice of the benchmark. Items without words, null texts among them, have no windows."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(64)), F.lit(0))).first()[0]
    n = 1 + size * 5 // 4 // slice_bytes  # slices are filled by hash: a quarter more than the mean is allowed for
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else items
        index = WindowIndex(sorted((r["item_id"], r["text"].encode()) for r in part.collect()), window)
        index.order_by_rarity(_rarity(docs, index.shingles) if len(index.shingles) else np.empty(0, np.int64))
        yield index


def hits(texts: list[bytes], index: WindowIndex) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """Of each text: its words, the places of hit words, the items with windows in it."""
    for some in slices(texts, len):
        words = Words(some, WORD_BYTES)
        window, at = index.matches(words)
        depth = np.zeros(len(words.name) + 1, np.int64)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + index.size[window], -1)
        hit = np.flatnonzero(np.cumsum(depth)[:-1] > 0)
        cuts = np.searchsorted(hit, words.first)
        text = np.searchsorted(words.first, at, side="right") - 1
        order = np.argsort(text, kind="stable")
        window, spans = window[order], np.searchsorted(text[order], np.arange(len(some) + 1))
        for k in range(len(some)):
            own = np.unique(window[spans[k] : spans[k + 1]])
            items = sorted({index.items[i] for w in own for i in index.item_of[index.item_cut[w] : index.item_cut[w + 1]].tolist()})
            yield int(words.first[k + 1] - words.first[k]), hit[cuts[k] : cuts[k + 1]] - words.first[k], items


SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, contaminated boolean"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items, contaminated for every row of docs.

    items: ids, sorted as strings, of the items that have a window in the text. A null or empty text has no words and no
    hits. Repeated rows are judged each. An empty benchmark hits nothing; an empty docs gives no rows.
    """
    docs = id_and_text(docs)
    parts = [_hits_of(docs, index) for index in indexes(docs, benchmark, window, slice_bytes)]
    if len(parts) == 1:
        return parts[0].select("doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), "items", (F.size("hit") > 0).alias("contaminated"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    whole = every.groupBy("doc_id", "text_id").agg(
        F.max("n_words").alias("n_words"),
        F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.explode(F.sequence(F.lit(1), (F.count("*") / len(parts)).cast("int"))).alias("copy"),
    )
    return whole.select("doc_id", "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"))


def _hits_of(docs: DataFrame, index: WindowIndex) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(index)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(hits(_texts(b), held.value))
            columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1].astype(np.int32) for f in found], pa.list_(pa.int32())), pa.array([f[2] for f in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_id"), *columns], ["doc_id", "text_id", "n_words", "hit", "items"])

    return docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_id"), "text").mapInArrow(mark, "doc_id long, text_id string, n_words long, hit array<int>, items array<string>")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of docs, all columns, whose text has no word of a benchmark window."""
    kept = docs
    for index in indexes(id_and_text(docs), benchmark, window, slice_bytes):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not len(f[1]) for f in hits(_texts(b), held.value)], pa.bool_()))

        kept = kept.mapInArrow(clean, docs.schema)
    return kept


