"""Token counts of whole texts by rank-synchronous merging of ragged arrays."""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestlake.llm.bpe import Memory, Pieces, vocabulary
from digestlake.llm.tables import id_and_text, slices


@lru_cache(maxsize=2)
def _memory(path: str) -> Memory:
    return Memory()


def count_tokens(texts: list[str | None], path: str) -> np.ndarray:
    """Tokens of each text; a null or empty text has none."""
    vocab, memory = vocabulary(path), _memory(path)
    found = np.zeros(len(texts), np.int64)
    plain = [k for k, t in enumerate(texts) if t and vocab.is_plain(t)]
    for some in slices(plain, lambda k: len(texts[k]), 1 << 20):
        pieces = Pieces([texts[k] for k in some])
        counts, unknown = memory.get(pieces.names, pieces.checks)
        if len(unknown):
            counts[unknown] = vocab.merged(pieces.spelled(unknown))[1]
            memory.put(pieces.names[unknown], pieces.checks[unknown], counts[unknown])
        upto = np.r_[0, np.cumsum(counts[pieces.word])][pieces.ends]
        found[some] = np.diff(np.r_[0, upto])
    for k in set(range(len(texts))).difference(plain):
        if texts[k]:
            words = vocab.words(texts[k])
            found[k] = sum(isinstance(w, int) for w in words)
            found[k] += vocab.merged([w for w in words if not isinstance(w, int)])[1].sum() if found[k] < len(words) else 0
    return found


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs, without a shuffle.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; an empty table gives no rows.
    tokenizer: path of the tokenizer file on every worker. A very long text is taken whole by one task, at some 60 bytes a
    character. Words count as equal where two unrelated 64-bit names of them agree.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            n = count_tokens(texts, tokenizer)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = id_and_text(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
