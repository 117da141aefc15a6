"""Byte-pair encoding of whole texts, after a tokenizer file of the word-end kind.

The file gives the normalizer, the pre-tokenizer, the vocabulary and the merges; nothing is trained here.
Two operators stand on this module: token counts (rank-synchronous merging of ragged arrays) and
encoding/decoding (a minimal acyclic transducer for frequent words, merging for the rest).
"""

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

from digestlake.llm.words import mix

#: The byte-level alphabet keeps printable Latin-1 bytes and moves the others, in order, to U+0100 and up.
KEPT_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Fixed value: the only pre-tokenizer pattern that this module reads.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters up to here are classed by Python as the tokenizers library does.
PLAIN_END = 0x24F
NO_PAIR = np.int32(2**31 - 1)
SPACE, LETTER, NUMBER, OTHER = range(4)
#: What may follow an apostrophe in a word of its own, first match first.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
SPACES = "\t\n\x0b\x0c\r \x85\xa0"
#: Words whose pieces a worker remembers; beyond it the memory starts anew.
MEMORY_WORDS = 400_000


def _plain() -> tuple[re.Pattern, np.ndarray]:
    """What finds a character that Python and the library may treat differently; the class of each other one."""
    odd = [c for c in map(chr, range(PLAIN_END + 1)) if len(c.lower()) > 1 or ord(c.lower()) > PLAIN_END]
    kinds = {"L": LETTER, "N": NUMBER}
    classes = [SPACE if chr(c) in SPACES else kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(PLAIN_END + 1)]
    return re.compile(f"[{''.join(odd)}{chr(PLAIN_END + 1)}-\U0010ffff]"), np.array(classes, np.uint8)


NOT_PLAIN, CLASS_OF = _plain()


def byte_alphabet() -> list[str]:
    kept = set(KEPT_BYTES)
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(moved)) for b in range(256)]


class Vocabulary:
    """One tokenizer file, as arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, splits = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or splits[0]["pattern"] != {"Regex": SPLIT_PATTERN}:
            raise ValueError(f"{path}: only byte-level BPE with word ends and the known split pattern is read here")
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.pieces = [""] * (1 + max(max(ids.values()), *(t["id"] for t in spec["added_tokens"])))
        for piece, i in ids.items():
            self.pieces[i] = piece
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for piece, i in self.special.items():
            self.pieces[i] = piece
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = byte_alphabet()
        self.inner = np.array([ids[c] for c in letters], np.int32)
        self.last = np.array([ids[c + end] for c in letters], np.int32)
        left, right, made = (np.empty(len(model["merges"]), np.int64) for _ in range(3))
        for k, (a, b) in enumerate(model["merges"]):
            left[k], right[k], made[k] = ids[a], ids[b], ids[a + b]
        self.size = np.int64(len(self.pieces))
        self.made = made.astype(np.int32)
        self._index(left * self.size + right)
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.from_letter = {c: b for b, c in enumerate(letters)}

    def _index(self, keys: np.ndarray) -> None:
        """Two-place hashing of pairs: each lies in one of two slots, so that a look-up is two gathers."""
        bits = max(12, int(np.ceil(np.log2(max(1, len(keys)) * 5))))
        self.shift = np.uint64(64 - bits)
        slot_rank = np.full(1 << bits, -1, np.int64)
        places = np.stack([self._slots(keys, k) for k in (0, 1)], axis=1).tolist()
        for rank in range(len(keys)):
            at, moves = places[rank][0], 0
            while rank >= 0:
                rank, slot_rank[at] = int(slot_rank[at]), rank
                if rank >= 0:
                    one, two = places[rank]
                    at, moves = two if at == one else one, moves + 1
                    if moves > 500:
                        raise ValueError("the merges do not fit their table")
        self.slot_key = np.where(slot_rank >= 0, keys[slot_rank], -1)
        self.slot_rank = np.where(slot_rank >= 0, slot_rank, NO_PAIR).astype(np.int32)

    def _slots(self, keys: np.ndarray, which: int) -> np.ndarray:
        factor = np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[which])
        return ((keys.astype(np.uint64) * factor) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        one = self._slots(keys, 0)
        found = np.where(self.slot_key[one] == keys, self.slot_rank[one], NO_PAIR)
        miss = np.flatnonzero(found == NO_PAIR)
        two = self._slots(keys[miss], 1)
        found[miss] = np.where(self.slot_key[two] == keys[miss], self.slot_rank[two], NO_PAIR)
        return found

    def is_plain(self, text: str) -> bool:
        return (text.isascii() or not NOT_PLAIN.search(text)) and not ("<" in text and self.cut_special and self.cut_special.search(text))

    def words(self, text: str) -> list:
        """The pre-tokens of one text in order: bytes, or an int for a special token.

        For texts with special tokens or with characters beyond PLAIN_END: the library itself normalizes and
        splits these, as the Unicode tables of Python and of the library differ there.
        """
        found: list = []
        for k, part in enumerate(self.cut_special.split(text) if self.cut_special else [text]):
            if k % 2:
                found.append(self.special[part])
            elif part:
                found += [bytes(map(self.from_letter.__getitem__, w)) for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))]
        return found

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has.

        Rank-synchronous: the words lie end to end in one array; in each round every word applies all
        occurrences of its lowest-ranked pair (from the left where they overlap) at once. A symbol's only merge
        ranks after those of its parts, so that no round uncovers a pair of lower rank, and the result is that
        of merging one by one.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[raw].astype(np.int64)
        ends = np.cumsum(sizes)
        ids[ends - 1] = self.last[raw[ends - 1]]
        owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        rank = np.full(len(ids), NO_PAIR, np.int32)
        rank[:-1] = self.ranks(ids[:-1], ids[1:])
        rank[ends - 1] = NO_PAIR
        done_ids, done_word = [ids[:0]], [owner[:0]]
        while len(ids):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.r_[first, len(ids)])
            each = np.repeat(lowest, lengths)
            over = each == NO_PAIR
            if over.any():
                done_ids.append(ids[over])
                done_word.append(owner[over])
                keep = ~over
                ids, owner, rank, each = ids[keep], owner[keep], rank[keep], each[keep]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == each)
            chained = np.r_[False, at[1:] == at[:-1] + 1]
            if chained.any():  # a run of one symbol: every other pair
                start = at[~chained]
                at = at[(at - start[np.cumsum(~chained) - 1]) % 2 == 0]
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            at -= np.arange(len(at))  # where the merged symbols are now
            fresh = np.unique(np.r_[at, at[at > 0] - 1])
            fresh = fresh[fresh < len(ids) - 1]
            same = owner[fresh] == owner[fresh + 1]
            rank[at] = NO_PAIR
            fresh = fresh[same]
            rank[fresh] = self.ranks(ids[fresh], ids[fresh + 1])
        all_words = np.concatenate(done_word)
        order = np.argsort(all_words, kind="stable")
        return np.concatenate(done_ids)[order], np.bincount(all_words, minlength=len(words))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Pieces:
    """Pre-tokens of some plain texts: distinct words, and the word at each place of each text."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts).lower() + "\n"
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = CLASS_OF[code]
        start = np.empty(len(code), bool)
        start[0] = kind[0] != SPACE
        start[1:] = (kind[1:] != SPACE) & ((kind[1:] != kind[:-1]) | (kind[1:] == NUMBER))
        mark = np.flatnonzero((code == ord("'")) & start)
        if len(mark):
            self._contract(code, kind, start, mark)
        begin = np.flatnonzero(start)
        inside = kind != SPACE
        stop = np.flatnonzero(inside[:-1] & (~inside[1:] | start[1:])) + 1
        sizes = stop - begin
        upto = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else sizes
        rel = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(upto, sizes)
        weights = _weights(int(sizes.max()) if len(sizes) else 0)
        letters = code[inside].astype(np.uint64) + np.uint64(1)
        names, checks = (np.add.reduceat(letters * w[rel], upto) if len(sizes) else np.empty(0, np.uint64) for w in weights)
        del letters, rel
        self.names, where, self.word = np.unique(names, return_index=True, return_inverse=True)
        self.checks = checks[where]
        if (self.checks[self.word] != checks).any():  # two words of one name: both numbers together name them then
            self.names, where, self.word = np.unique(mix(names ^ mix(checks)), return_index=True, return_inverse=True)
            self.checks = checks[where]
        self.counts = np.bincount(self.word, minlength=len(self.names))
        raw = joined.encode()
        if len(raw) == len(code):
            cut = np.stack([begin[where], stop[where]])
        else:
            at = np.r_[0, np.cumsum(1 + (code > 0x7F))]
            cut = at[np.stack([begin[where], stop[where]])]
        self._raw, self._cut = raw, cut
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1  # lower-casing keeps the length of plain texts
        self.ends = np.searchsorted(begin, np.cumsum(lengths))  # of each text, in places

    @staticmethod
    def _contract(code: np.ndarray, kind: np.ndarray, start: np.ndarray, mark: np.ndarray) -> None:
        mark = mark[mark < len(code) - 1]
        after = np.zeros(len(mark), np.int64)
        for tail in CONTRACTIONS:
            fits = after == 0
            for k, c in enumerate(tail, 1):
                fits &= code[np.minimum(mark + k, len(code) - 1)] == ord(c)
            after[fits] = len(tail)
        mark, after = mark[after > 0], after[after > 0]
        start[mark + 1] = False
        rest = mark + after + 1
        rest = rest[rest < len(code)]
        start[rest[kind[rest] != SPACE]] = True

    def spelled(self, which: np.ndarray) -> list[bytes]:
        a, b = self._cut[:, which].tolist()
        raw = self._raw
        return [raw[x:y] for x, y in zip(a, b, strict=True)]


#: Words up to so many characters are named from a table that a worker keeps.
TABLE = 1 << 12


@lru_cache(maxsize=1)
def _table() -> tuple[np.ndarray, np.ndarray]:
    return _made_weights(TABLE)


def _made_weights(size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.full(size, 0x9E3779B97F4A7C15, np.uint64)), mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)


def _weights(longest: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place in a word the factors of its two names: powers of one number, and numbers that have no relation."""
    return _table() if longest <= TABLE else _made_weights(longest)


class Memory:
    """What a worker has learnt of words, by the two 64-bit names that Pieces gives them, as arrays sorted by the first."""

    def __init__(self, limit: int = MEMORY_WORDS):
        self.limit = limit
        self.clear()

    def get(self, names: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which of the words are unknown: those of which not both names agree."""
        if not len(self.names):
            return np.zeros(len(names), np.int64), np.arange(len(names))
        at = np.searchsorted(self.names, names)
        at[at == len(self.names)] = 0
        return self.values[at], np.flatnonzero((self.names[at] != names) | (self.checks[at] != checks))

    def clear(self) -> None:
        self.names, self.checks, self.values = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)

    def put(self, names: np.ndarray, checks: np.ndarray, values: np.ndarray) -> None:
        if len(self.names) + len(names) > self.limit:
            self.clear()
        names, checks, values = np.r_[self.names, names], np.r_[self.checks, checks], np.r_[self.values, values]
        order = np.argsort(names, kind="stable")
        self.names, self.checks, self.values = names[order], checks[order], values[order]
