"""BPE encoding and decoding of whole texts with a compiled lexicon of the corpus' frequent words.

Three steps: the words of all documents are counted (combined per batch, then by Spark); the most frequent ones,
as many as the parameter says, are merged once and compiled into a minimal acyclic transducer; every document
is then encoded by walking the transducer, and words outside of it are merged exactly.
"""

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestlake.llm.bpe import Memory, Pieces, Vocabulary, vocabulary
from digestlake.llm.tables import id_and_text, slices
from digestlake.llm.transducer import Transducer, compile_words, ragged
from digestlake.session import stash

#: Words in the lexicon: the bound of what is sent to the driver and broadcast (about 3 MB of words, 4 MB compiled).
LEXICON_WORDS = 65_536
#: Bytes of text whose ids a worker holds before it hands them on.
OUTPUT_BYTES = 1 << 20
#: Words longer than this many bytes are not compiled; they are merged where they occur.
LEXICON_BYTES = 48


def word_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """word binary, n long: how often each pre-token of at most LEXICON_BYTES bytes occurs in all documents.

    Texts that the library has to split are counted by the words that it gives.
    """

    def batch(words: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
        keep = np.fromiter(map(len, words), np.int64, len(words)) <= LEXICON_BYTES
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).filter(pa.array(keep)), pa.array(counts[keep])], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        for b in batches:
            texts = [t for t in b.column("text").to_pylist() if t]
            plain = [vocab.is_plain(t) for t in texts]
            for some in slices([t for t, p in zip(texts, plain, strict=True) if p], len):
                pieces = Pieces(some)
                yield batch(pieces.spelled(np.arange(len(pieces.names))), pieces.counts)
            for some in slices([t for t, p in zip(texts, plain, strict=True) if not p], len):
                split = Counter(w for t in some for w in vocab.words(t) if not isinstance(w, int))
                yield batch(list(split), np.fromiter(split.values(), np.int64, len(split)))

    rows = id_and_text(docs).select("text").mapInArrow(count, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, tokenizer: str, size: int) -> list[bytes]:
    """The most frequent words that occur at least twice, at most size.

    The counts are binned by their logarithm, sixteen bins an octave; whole bins are taken from the top while they
    fit, so that no task sends more than its share of the result.
    """
    counts = stash(word_counts(docs, tokenizer).where("n > 1"), "word-counts")
    octave = F.floor(16 * F.log2("n"))
    bins = counts.groupBy(octave.alias("bin")).count().orderBy(F.desc("bin")).collect()
    total, least = 0, None
    for row in bins:
        total += row["count"]
        if total > size:
            break
        least = row["bin"]
    top = counts.where(octave >= least).select("word").collect() if least is not None else []
    return sorted(bytes(r["word"]) for r in top)


def lexicon(docs: DataFrame, tokenizer: str, size: int = LEXICON_WORDS) -> bytes:
    """The compiled transducer of the most frequent words."""
    words = frequent_words(docs, tokenizer, size)
    ids, counts = vocabulary(tokenizer).merged(words) if words else (np.empty(0, np.int64), np.empty(0, np.int64))
    cuts = np.split(ids, np.cumsum(counts)[:-1]) if words else []
    return compile_words({w: c.tolist() for w, c in zip(words, cuts, strict=True)})


@lru_cache(maxsize=1)
def _encoder(tokenizer: str, holder: "_Block") -> "Encoder":
    return Encoder(vocabulary(tokenizer), Transducer(holder.block))


class _Block:
    """Hashes by its digest alone, so that the mapping is kept while the same lexicon is in use."""

    def __init__(self, block: bytes):
        self.block, self.digest = block, hashlib.sha256(block).hexdigest()

    def __hash__(self) -> int:
        return hash(self.digest)

    def __eq__(self, other) -> bool:
        return self.digest == other.digest


class Encoder:
    """Encodes whole texts on one worker."""

    def __init__(self, vocab: Vocabulary, lexicon: Transducer):
        self.vocab, self.lexicon = vocab, lexicon
        self.memory, self.store, self.used = Memory(), np.empty(1 << 20, "<u4"), 0

    def remembered(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Where in the store the ids of each distinct word begin, and how many they are."""
        value, unknown = self.memory.get(pieces.names, pieces.checks)
        if len(unknown):
            ids, counts = self.word_ids(pieces.spelled(unknown))
            if len(self.memory.names) + len(unknown) > self.memory.limit:
                self.memory.clear()
                self.used = 0
                if len(unknown) < len(value):
                    return self.remembered(pieces)
            while self.used + len(ids) > len(self.store):
                self.store = np.r_[self.store, np.empty_like(self.store)]
            self.store[self.used : self.used + len(ids)] = ids
            value[unknown] = (self.used + np.cumsum(counts) - counts) << 32 | counts
            self.used += len(ids)
            self.memory.put(pieces.names[unknown], pieces.checks[unknown], value[unknown])
        return value >> 32, value & 0xFFFFFFFF

    def word_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        place = self.lexicon.find(words)
        known, rest = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        ids_known, n_known = self.lexicon.output(place[known])
        ids_rest, n_rest = self.vocab.merged([words[k] for k in rest]) if len(rest) else (ids_known[:0], n_known[:0])
        counts = np.empty(len(words), np.int64)
        counts[known], counts[rest] = n_known, n_rest
        begin = np.empty(len(words), np.int64)
        begin[known] = np.cumsum(n_known) - n_known
        begin[rest] = len(ids_known) + np.cumsum(n_rest) - n_rest
        return np.r_[ids_known, ids_rest][ragged(begin, counts)], counts

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """The place of each text and its ids as little-endian unsigned 32-bit integers; in no fixed order."""
        plain = [k for k, t in enumerate(texts) if t and self.vocab.is_plain(t)]
        for some in slices(plain, lambda k: len(texts[k]), 1 << 20):
            pieces = Pieces([texts[k] for k in some])
            (begin, counts), start = self.remembered(pieces), 0
            for k, end in zip(some, pieces.ends.tolist(), strict=True):
                w = pieces.word[start:end]
                yield k, self.store[ragged(begin[w], counts[w])]
                start = end
        for k in sorted(set(range(len(texts))).difference(plain)):
            words = self.vocab.words(texts[k]) if texts[k] else []
            found, each = self.word_ids([w for w in words if not isinstance(w, int)]) if words else (np.empty(0, np.int64), np.empty(0, np.int64))
            cuts = iter(np.split(found, np.cumsum(each)[:-1]))
            yield k, np.concatenate([np.empty(0, np.int64), *([w] if isinstance(w, int) else next(cuts) for w in words)]).astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        """What the library's decode gives for a file without a decoder: the pieces, special ones too, joined by spaces."""
        return " ".join(map(self.vocab.pieces.__getitem__, ids.tolist()))


def encode_documents(docs: DataFrame, tokenizer: str, size: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids binary (little-endian unsigned 32-bit), decoded string for every row of docs.

    Null and empty texts give no ids and an empty decoded string; repeated rows are encoded each; an empty
    table gives no rows. tokenizer: path of the tokenizer file on every worker. A very long text is taken whole by one task, at
    some 60 bytes a character.
    """
    return _encoded(docs, tokenizer, size, "doc_id long, n_tokens long, ids binary, decoded string", lambda ids, text: (ids.tobytes(), text))


def encoded_ids(docs: DataFrame, tokenizer: str, size: int = LEXICON_WORDS) -> DataFrame:
    """As encode_documents, with the SHA-256 digest of the decoded text, made where the text is, in place of the text itself."""
    return _encoded(docs, tokenizer, size, "doc_id long, n_tokens long, ids binary, decoded_sha256 string", lambda ids, text: (ids.tobytes(), hashlib.sha256(text.encode()).hexdigest()))


def encoding_digests(docs: DataFrame, tokenizer: str, size: int = LEXICON_WORDS) -> DataFrame:
    """As encode_documents, with SHA-256 digests made where the texts are, in place of ids and decoded text."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return _encoded(docs, tokenizer, size, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, text: (sha(ids.tobytes()), sha(text.encode())))


def _encoded(docs: DataFrame, tokenizer: str, size: int, schema: str, shape) -> DataFrame:
    block: Broadcast = docs.sparkSession.sparkContext.broadcast(_Block(lexicon(docs, tokenizer, size)))
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.binary() if "binary" in x else pa.string() for x in schema.split(", ")[2:]]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(tokenizer, block.value)
        for b in batches:
            rows = list(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True))
            for some in slices(rows, lambda r: 100 + len(r[1] or ""), OUTPUT_BYTES):
                n, made = np.zeros(len(some), np.int64), [None] * len(some)
                for k, ids in coder.encode([t for _, t in some]):
                    n[k], made[k] = len(ids), shape(ids, coder.decode(ids))
                columns = [pa.array([m[c] for m in made], kind) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array(n), *columns], names)

    return id_and_text(docs).mapInArrow(encode, schema)
