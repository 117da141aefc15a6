"""Words of whole texts as flat arrays: where each starts and ends, its 64-bit name, and the text it is of."""

from functools import lru_cache

import numpy as np

#: ASCII white space, which alone separates the words of the shingle operators.
BLANKS = b" \t\n\x0b\x0c\r"
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def byte_table(separators: bytes = b"", lower: bool = True, letters: bytes = b"") -> bytes:
    """A bytes.translate table: A-Z to a-z, and every byte that is no part of a word to a space.

    Words are what lies between separators, or the runs of letters; bytes of multi-byte characters count as letters.
    """
    table = bytearray(range(256))
    for c in range(256):
        if lower and 65 <= c <= 90:
            table[c] = c + 32
        if c in separators or (letters and c < 128 and table[c] not in letters):
            table[c] = 32
    return bytes(table)


SHINGLE_BYTES = byte_table(BLANKS)
EXACT_BYTES = byte_table(BLANKS, lower=False)


#: Bytes of text that are taken apart at once; what this takes beside the words' places and names is bounded by it.
STRETCH = 1 << 20
FACTOR = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    return np.cumprod(np.full(STRETCH, FACTOR, np.uint64))


def _proof_weights(begin: int, size: int) -> np.ndarray:
    return mix(np.arange(begin + 1, begin + size + 1, dtype=np.uint64)) | np.uint64(1)


@lru_cache(maxsize=1)
def _first_proof_weights() -> np.ndarray:
    return _proof_weights(0, STRETCH)


def _long_name(word: np.ndarray) -> np.uint64:
    """The unmixed name of a word of any length, a stretch of it at a time."""
    total, ahead = 0, 1
    for a in range(0, len(word), STRETCH):
        part = word[a : a + STRETCH].astype(np.uint64) + np.uint64(1)
        total += int((part * _powers()[: len(part)]).sum(dtype=np.uint64)) * ahead
        ahead = ahead * pow(FACTOR, STRETCH, 1 << 64) % (1 << 64)
    return np.uint64(total % (1 << 64))


class Words:
    """All words of some texts in order. first[k]:first[k + 1] are those of text k.

    Beside the texts it takes some 24 bytes a word, and a bounded amount for the stretch that is being taken apart; neither
    a very long text nor a very long word takes more. With proofs each word has a second name, which has nothing to do with the first.
    """

    def __init__(self, texts: list[bytes], table: bytes, proofs: bool = False):
        self.raw = b"\n".join([*texts, b""]).translate(table)
        parts, at = [], 0
        while at < len(self.raw):
            upto = min(len(self.raw), at + STRETCH)
            upto = self.raw.rfind(b" ", at, upto) + 1 or self.raw.find(b" ", at) + 1  # in the midst of a word longer than a stretch: its end
            parts.append(_taken_apart(np.frombuffer(self.raw, np.uint8, upto - at, at), at, proofs))
            at = upto
        join = lambda k, kind: np.concatenate([np.empty(0, kind), *(p[k] for p in parts)])
        self.start, self.end, self.name = join(0, np.int64), join(1, np.int64), join(2, np.uint64)
        self.proof = join(3, np.uint64)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offset = np.r_[0, np.cumsum(lengths)]  # of each text in raw
        self.first = np.searchsorted(self.start, self.offset)
        self.first[-1] = len(self.start)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def chain(names: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Names of all runs of size consecutive words: entry i is of words i ... i + size - 1, in this order."""
    n = len(names) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    made = np.full(n, seed, np.uint64)
    for k in range(size):
        made = made * np.uint64(0xD6E8FEB86659FD93) + names[k : k + n]
        made ^= made >> np.uint64(32)
    return mix(made)


def _taken_apart(code: np.ndarray, at: int, proofs: bool) -> tuple[np.ndarray, ...]:
    """Starts, ends, names and, if asked for, proofs of the words of a stretch that ends with a blank; at: where it begins."""
    if len(code) > STRETCH:  # one long word and a blank
        size = len(code) - 1
        begin = int(np.argmax(code != 32))
        word, proof = code[begin:size], np.zeros(int(proofs), np.uint64)
        for a in range(0, len(word) if proofs else 0, STRETCH):
            part = word[a : a + STRETCH].astype(np.uint64) + np.uint64(1)
            proof += (part * _proof_weights(a, len(part))).sum(dtype=np.uint64)
        return np.array([at + begin]), np.array([at + size]), mix(np.array([_long_name(word)], np.uint64)), proof
    inside = code != 32
    edge = np.flatnonzero(np.diff(np.r_[False, inside].view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    sizes = end - start
    if not len(sizes):
        return start, end, np.empty(0, np.uint64), np.empty(0, np.uint64)
    upto = np.cumsum(sizes) - sizes
    rel = np.arange(int(sizes.sum())) - np.repeat(upto, sizes)
    letters = code[inside].astype(np.uint64) + np.uint64(1)
    names = mix(np.add.reduceat(letters * _powers()[rel], upto))
    return start + at, end + at, names, np.add.reduceat(letters * _first_proof_weights()[rel], upto) if proofs else names[:0]
