"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph is a line; its digest is of its exact bytes. A section ends after a paragraph that its digest picks; its digest is
of its paragraphs', and the root's of the sections'. So equal roots mean equal texts, and where roots differ the
differing branches lead to the edit. Below paragraphs the tree keeps short codes of phrases, cut after words that
a hash picks, so that an edit moves no cut but its own; they locate edits within paragraphs and tell how alike texts are.
"""

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestlake.llm.tables import id_and_text, slices
from digestlake.llm.words import EXACT_BYTES, Words, mix
from digestlake.session import shuffle_partitions

#: A phrase ends after one word in PHRASE, and after LONGEST words at most; a section after one paragraph in SECTION.
PHRASE, LONGEST, SECTION = 3, 8, 8
#: The first words of a text are phrases each, so that very short texts have a tree too.
LEAD = 8
CODE_BYTES = 6
#: Letters of a code, written in base 64.
LETTERS = CODE_BYTES * 4 // 3


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Tree:
    """The fingerprint of one text: the digests of its sections, its paragraphs as spans of phrases, and the phrases' codes."""

    def __init__(self, text: bytes, letters: str, codes: np.ndarray, cuts: list[int]):
        """letters: LETTERS for each phrase; cuts: where the phrases of each line begin."""
        self.letters, self.codes = letters, codes
        self.sections: list[tuple[bytes, list[tuple[int, int]]]] = []
        own: list[bytes] = []
        spans: list[tuple[int, int]] = []
        for line, span in zip(text.split(b"\n"), zip(cuts, [*cuts[1:], len(codes)], strict=True), strict=True):
            own.append(_digest(line))
            spans.append(span)
            if own[-1][0] % SECTION == 0:
                self.sections.append((_digest(b"".join(own)), spans))
                own, spans = [], []
        if own:
            self.sections.append((_digest(b"".join(own)), spans))
        self.root = _digest(b"".join(d for d, _ in self.sections))

    def text(self) -> str:
        """root;section,paragraph,paragraph...;section...: section digests in short, paragraphs as their phrases' codes."""
        return self.root.hex() + "".join(";" + s[:4].hex() + "".join("," + self.letters[LETTERS * a : LETTERS * b] for a, b in spans) for s, spans in self.sections)


def _codes(raw: bytes) -> np.ndarray:
    whole = np.zeros((len(raw) // CODE_BYTES, 8), np.uint8)
    whole[:, -CODE_BYTES:] = np.frombuffer(raw, np.uint8).reshape(-1, CODE_BYTES)
    return whole.view(">i8").ravel().astype(np.int64)


def trees(texts: list[str]) -> Iterator[Tree]:
    for some in slices([t.encode() for t in texts], len):
        words = Words(some, EXACT_BYTES)
        n = len(words.name)
        first = np.repeat(words.first[:-1], np.diff(words.first))
        breaks = np.flatnonzero(np.frombuffer(b"\n".join(some) + b"\n", np.uint8) == 10)  # the last one of a text ends it
        line = np.searchsorted(breaks, words.start)
        place = np.arange(n)
        picked = words.name % np.uint64(PHRASE) == 0
        since = place - np.maximum(np.maximum.accumulate(np.where(picked, place, -1)), first - 1) if n else place
        ends = picked | (since % LONGEST == 0) | (place - first < LEAD)
        starts = np.r_[True, ends[:-1] | (line[1:] != line[:-1])] if n else np.empty(0, bool)
        begin = np.flatnonzero(starts)
        rel = (place - begin[np.cumsum(starts) - 1]).astype(np.uint64) if n else place.astype(np.uint64)
        names = mix(np.add.reduceat(mix(words.name + rel), begin)) if n else np.empty(0, np.uint64)
        raw = names.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES].tobytes()
        letters, codes = base64.b64encode(raw).decode(), _codes(raw)
        own_line = line[begin]
        own_text = np.searchsorted(begin, words.first)
        end_break = np.searchsorted(breaks, words.offset[1:] - 1)  # of each text: its last line
        cut_of = np.searchsorted(own_line, np.arange(len(breaks) + 1))
        line_from = 0
        for k, text in enumerate(some):
            a, b = int(own_text[k]), int(own_text[k + 1])
            cuts = (cut_of[line_from : int(end_break[k]) + 1] - a).tolist()
            yield Tree(text, letters[LETTERS * a : LETTERS * b], codes[a:b], cuts)
            line_from = int(end_break[k]) + 1


def likeness_of(root_a: bytes | str, codes_a: np.ndarray, root_b: bytes | str, codes_b: np.ndarray) -> float:
    """1 for equal roots; else the share of leaves that both have, below 1."""
    if root_a == root_b:
        return 1.0
    if not len(codes_a) or not len(codes_b):
        return 0.0
    a, n = np.unique(codes_a, return_counts=True)
    b, m = np.unique(codes_b, return_counts=True)
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.where(b[at] == a, np.minimum(n, m[at]), 0).sum())
    total = len(codes_a) + len(codes_b)
    return min(2 * both / total, 1 - 1 / (total + 1))


def parsed(fingerprint: str) -> tuple[str, list[tuple[str, list[bytes]]]]:
    root, *sections = fingerprint.split(";")
    return root, [(p[0], [base64.b64decode(x) for x in p[1:]]) for p in (s.split(",") for s in sections)]


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, from these alone."""
    (root_a, sections_a), (root_b, sections_b) = parsed(a), parsed(b)
    codes = lambda sections: _codes(b"".join(p for _, paragraphs in sections for p in paragraphs))
    return likeness_of(root_a, codes(sections_a), root_b, codes(sections_b))


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """Where b differs from a: (paragraph of b, phrase in it), found by following the branches that a does not have."""
    (root_a, sections_a), (root_b, sections_b) = parsed(a), parsed(b)
    if root_a == root_b:
        return []
    known_sections, known_paragraphs = {s for s, _ in sections_a}, {p for _, ps in sections_a for p in ps}
    known = {p[k : k + CODE_BYTES] for _, ps in sections_a for p in ps for k in range(0, len(p), CODE_BYTES)}
    found, n = [], 0
    for name, paragraphs in sections_b:
        for p in paragraphs:
            if name not in known_sections and p not in known_paragraphs:
                found += [(n, k // CODE_BYTES) for k in range(0, len(p), CODE_BYTES) if p[k : k + CODE_BYTES] not in known]
            n += 1
    return found


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint for every row of docs. Null texts count as empty; equal texts have equal fingerprints."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t.text() for t in trees([t or "" for t in b.column("text").to_pylist()])], pa.string())], ["doc_id", "fingerprint"])

    return id_and_text(docs).mapInArrow(make, "doc_id long, fingerprint string")


#: Rows of a part where there are many; fewer, but rows_per_part at least, while that keeps the session's partitions busy.
PART_ROWS = 65_536
#: Sampled ids of a part, by which the parts are cut.
SAMPLED = 16


def with_next(docs: DataFrame, rows_per_part: int = 4_000) -> DataFrame:
    """part, extra, doc_id, text, sorted in each partition so that a row of extra = 0 is followed by the next document.

    Order: doc_id descending, then text; null ids last. A sample of the ids, without texts, cuts them into parts; a second pass over the
    ids finds the first document of each part. That one is also sent, marked extra, to the end of the part before, and the
    very first to the end of the last. So texts are exchanged once. What the driver holds and broadcasts are 24 bytes a part, and 8 for each
    sampled id: 20 MB and 100 MB at 5e10 documents (100 TB), 2 kB and 8 kB at 256,000. Rows of one doc_id are in one part.
    """
    spark = docs.sparkSession
    docs = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("rank", F.coalesce(F.col("doc_id"), F.lit(-(2**63))))
    n = docs.count()
    parts = max(1, -(-n // PART_ROWS), min(-(-n // rows_per_part), max(shuffle_partitions(spark), -(-n // PART_ROWS))))
    drawn = np.sort(docs.select("rank").sample(fraction=min(1.0, 2 * SAMPLED * parts / n), seed=11).toPandas()["rank"].to_numpy(np.int64)) if parts > 1 else np.empty(0, np.int64)
    cuts = spark.sparkContext.broadcast(np.unique(drawn[np.arange(1, parts) * len(drawn) // parts]) if len(drawn) else drawn)

    def part(rank: pd.Series) -> pd.Series:
        return pd.Series(len(cuts.value) - np.searchsorted(cuts.value, rank.to_numpy(np.int64), side="right")).astype("int32")

    in_part = F.pandas_udf(part, "int")
    heads = docs.select(in_part("rank").alias("part"), "rank").groupBy("part").agg(F.max("rank").alias("head")).toPandas().sort_values("part")
    first = spark.sparkContext.broadcast(dict(zip(heads["head"].tolist(), np.roll(heads["part"].to_numpy(), 1).tolist(), strict=True)))

    def before(rank: pd.Series) -> pd.Series:
        """The part before, for the first document of a part; -1 for others."""
        return pd.Series([first.value.get(r, -1) for r in rank.tolist()], dtype="int32")

    placed = docs.withColumns({"part": in_part("rank"), "before": F.pandas_udf(before, "int")("rank")})
    own = F.struct("part", F.lit(0).alias("extra"))
    also = F.struct(F.col("before").alias("part"), F.lit(1).alias("extra"))
    sent = placed.select(F.explode(F.when(F.col("before") >= 0, F.array(own, also)).otherwise(F.array(own))).alias("to"), "rank", "doc_id", "text").select("to.part", "to.extra", "rank", "doc_id", "text")
    return sent.repartition(max(parts, shuffle_partitions(spark)), "part").sortWithinPartitions("part", "extra", F.desc("rank"), "text").select("part", "extra", "doc_id", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compared(docs: DataFrame) -> DataFrame:
    """For every row of docs its fingerprint, that of its edited text, and its likeness to this and to the next document's.

    The edited text has its last half replaced by the start of the next document. A null text counts as
    empty; an only document is its own next one; an empty table gives no rows. A very long text is held whole by one task, as
    its fingerprint is, at some 40 bytes a word.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: its part, extra, doc_id and text
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("part", "extra", "doc_id", "text")), strict=True))
            rows = [held, *rows] if held else rows
            pairs = [(x, y) for x, y in zip(rows[:-1], rows[1:], strict=True) if x[1] == 0 and x[0] == y[0]]
            held = rows[-1] if rows else None
            for some in slices(pairs, lambda p: len(p[0][3]) + len(p[1][3])):
                yield _compared([(x[2], x[3], y[3]) for x, y in some])

    return with_next(docs).mapInArrow(compare, SCHEMA)


def _compared(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    made = [edited(text, after) for _, text, after in rows]
    # in a run of rows the next text is the next row's: each text is taken apart once
    chained = [k == len(rows) - 1 or rows[k + 1][1] is not r[2] for k, r in enumerate(rows)]
    own, lone, changed = list(trees([r[1] for r in rows])), trees([r[2] for r, c in zip(rows, chained, strict=True) if c]), trees(made)
    next_ = [next(lone) if c else own[k + 1] for k, c in enumerate(chained)]
    out = []
    for (doc_id, text, _), new, a, b, c in zip(rows, made, own, changed, next_, strict=True):
        near = [likeness_of(a.root, a.codes, x.root, x.codes) for x in (b, c)]
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), a.text(), b.text(), *near))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])
