"""A minimal acyclic transducer over byte strings, laid out in one flat block that workers memory-map.

Words share prefixes and, after minimization, suffixes. Each arc carries how many words precede those behind
it, so that the sum along a path is the word's place in the sorted list; a ragged table after the automaton
gives the ids that are the word's output.
"""

import mmap
import tempfile

import numpy as np

MAGIC = 0x4C455831


def compile_words(outputs: dict[bytes, list[int]]) -> bytes:
    """The block for words and their output ids. Any order; no word may be empty."""
    words = sorted(outputs)
    register: dict[tuple, int] = {}
    nodes: list[tuple[bool, tuple[tuple[int, int], ...]]] = []  # final, ((byte, node), ...)

    def settle(final: bool, arcs: tuple[tuple[int, int], ...]) -> int:
        key = (final, arcs)
        if key not in register:
            register[key] = len(nodes)
            nodes.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # the nodes along the last word, not settled yet
    before = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            path[-1][1].append((before[len(path) - 1], settle(final, tuple(arcs))))

    for word in words:
        shared = 0
        while shared < min(len(word), len(before)) and word[shared] == before[shared]:
            shared += 1
        close(shared)
        path += [[False, []] for _ in range(len(word) - shared)]
        path[-1][0] = True
        before = word
    close(0)
    root = settle(path[0][0], tuple(path[0][1]))

    below = np.zeros(len(nodes), np.int64)  # words from each node on; arcs lead to nodes settled earlier
    for k, (final, arcs) in enumerate(nodes):
        below[k] = final + sum(below[n] for _, n in arcs)
    first = np.zeros(len(nodes) + 1, np.int32)
    first[1:] = np.cumsum([len(arcs) for _, arcs in nodes])
    label, target, skip = (np.empty(int(first[-1]), np.int32) for _ in range(3))
    for k, (final, arcs) in enumerate(nodes):
        passed = int(final)
        for j, (byte, n) in enumerate(arcs, int(first[k])):
            label[j], target[j], skip[j] = byte, n, passed
            passed += below[n]
    finals = np.array([final for final, _ in nodes], np.int32)
    ends = np.cumsum([0, *(len(outputs[w]) for w in words)]).astype(np.int32)
    ids = np.array([i for w in words for i in outputs[w]], np.int32)
    head = np.array([MAGIC, len(nodes), len(label), len(words), len(ids), root], np.int32)
    return b"".join(x.tobytes() for x in (head, first, finals, label, target, skip, ends, ids))


class Transducer:
    """A compiled block, mapped from an unlinked file of the worker's own."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(self._map, np.int32, 6)
        if head[0] != MAGIC:
            raise ValueError("not a transducer block")
        _, n_nodes, n_arcs, n_words, n_ids, self.root = map(int, head)
        at = 24

        def part(n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(self._map, np.int32, n, at)
            at += 4 * n
            return x

        self.first, self.final = part(n_nodes + 1), part(n_nodes)
        self.label, self.target, self.skip = part(n_arcs), part(n_arcs), part(n_arcs)
        self.ends, self.ids = part(n_words + 1), part(n_ids)
        #: Arcs by (node, byte): sorted, as each node's arcs are in the order of their bytes.
        self._arc = np.repeat(np.arange(n_nodes, dtype=np.int64), np.diff(self.first)) * 256 + self.label

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word among the compiled ones, -1 for others. All words step byte by byte at once."""
        found = np.full(len(words), -1, np.int64)
        if not words or not len(self._arc):
            return found
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        start = np.r_[0, np.cumsum(sizes)[:-1]]
        live = np.flatnonzero(sizes > 0)
        node, place = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64)
        depth = 0
        while len(live):
            ended = sizes[live] == depth
            if ended.any():
                good = ended & (self.final[node] == 1)
                found[live[good]] = place[good]
                live, node, place = live[~ended], node[~ended], place[~ended]
                if not len(live):
                    break
            key = node * 256 + raw[start[live] + depth]
            at = np.searchsorted(self._arc, key)
            at[at == len(self._arc)] = 0
            good = self._arc[at] == key
            at, live = at[good], live[good]
            node, place = self.target[at].astype(np.int64), place[good] + self.skip[at]
            depth += 1
        return found

    def output(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places, one after the other, and how many each has."""
        begin, count = self.ends[places].astype(np.int64), np.diff(self.ends)[places].astype(np.int64)
        return self.ids[ragged(begin, count)], count


def ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indexes begin[k] ... begin[k] + count[k] - 1 for all k in turn."""
    upto = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(begin - upto, count)
