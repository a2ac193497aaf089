"""Word shingles and their signatures, made in workers with NumPy over Arrow batches.

Words are the longest runs of letters and digits of the lower-cased text, and each character from U+4E00 to U+9FFF by
itself. A shingle is the 64-bit hash of some successive words; a text's shingles are distinct and sorted.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np

FIND = re.compile(r"[一-鿿]|[^\W_一-鿿]+").findall
#: Of each 16-bit character: 1 if it belongs to a word, 2 if it is a word by itself.
KINDS = np.fromiter((chr(c).isalnum() for c in range(1 << 16)), np.uint8, 1 << 16)
HAN, AFTER_HAN = 0x4E00, 0xA000
KINDS[HAN:AFTER_HAN] = 2
#: Characters that are cut into words at once, a bound on memory.
PIECE = 1_000_000
#: Word hashes that a worker remembers before it starts afresh: a bound on memory without effect on results.
MEMORY = 500_000
#: Comparisons of a sketch: minima of which 4 bits are kept.
LANES = 64
WORDS = LANES // 16
#: Trees of a forest, and the minima (16 bits each) of one tree's label.
TREES, LEVELS = 18, 4
_RANDOM = np.random.Generator(np.random.PCG64(20240601))
MULTIPLY = _RANDOM.integers(0, 1 << 31, TREES * LEVELS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
FLIP = _RANDOM.integers(0, 1 << 32, TREES * LEVELS, dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Hashes of words, made when they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = made = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return made


class Shingler:
    """Turns texts into shingles; one per worker."""

    def __init__(self, width: int):
        self.width = width
        self.known = _Hashes()
        self.han, self.met = np.zeros(AFTER_HAN - HAN, np.uint64), np.zeros(AFTER_HAN - HAN, bool)

    def _found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of words of each lower-cased text, and the hashes of all; words found one by one."""
        words = [FIND(t) for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        return counts, np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.uint64, int(counts.sum()))

    def _hashed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_found``, for all characters at once: a word is looked up once, however often the texts hold it."""
        joined = f" {' '.join(texts)} "
        units = np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), np.uint16)
        if len(units) != len(joined):  # some text holds characters of more than 16 bits
            if len(texts) == 1:
                return self._found(texts)
            half = len(texts) // 2
            (low, hashes), (high, others) = self._hashed(texts[:half]), self._hashed(texts[half:])
            return np.append(low, high), np.append(hashes, others)
        kinds = KINDS[units]
        inner, han = np.flatnonzero(kinds == 1), np.flatnonzero(kinds == 2)
        edges = np.flatnonzero(np.diff(kinds == 1)) + 1
        begins, ends = edges[::2], edges[1::2]
        place = np.zeros(len(units), np.int64)
        place[begins] = place[han] = 1
        place = np.cumsum(place)
        hashes = np.empty(place[-1], np.uint64)
        if len(han):
            letters = units[han] - np.uint16(HAN)
            for c in np.unique(letters[~self.met[letters]]).tolist():
                self.han[c], self.met[c] = self.known[chr(HAN + c)], True
            hashes[place[han] - 1] = self.han[letters]
        if len(begins):
            sizes = ends - begins
            offsets = inner - np.repeat(begins, sizes)
            letters = units[inner]
            keys = np.add.reduceat(_mix(offsets.astype(np.uint64) << np.uint64(16) | letters), np.cumsum(sizes) - sizes)
            _, first, of = np.unique(keys, return_index=True, return_inverse=True)
            if (sizes != sizes[first][of]).any() or (letters != units[np.repeat(begins[first][of], sizes) + offsets]).any():  # equal keys of different words
                return self._found(texts)
            known = [self.known[joined[x:y]] for x, y in zip(begins[first].tolist(), ends[first].tolist())]
            hashes[place[begins] - 1] = np.array(known, np.uint64)[of]
        return np.diff(place[np.cumsum([0, *(len(t) + 1 for t in texts)])]), hashes

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted distinct shingles of each text; empty for a text with fewer words than the width."""
        if len(texts) > 1 and sum(map(len, texts)) > PIECE:
            half = len(texts) // 2
            return self.many(texts[:half]) + self.many(texts[half:])
        if len(self.known) > MEMORY:
            self.known.clear()
        counts, flat = self._hashed([t.lower() for t in texts])
        if len(flat) < self.width:
            return [np.zeros(0, np.uint64) for _ in texts]
        last = len(flat) - self.width + 1
        hashed = np.zeros(last, np.uint64)
        for k in range(self.width):
            hashed = _mix(hashed + flat[k : k + last] + np.uint64(k + 1))
        # Those that lie within one text are sorted text by text; repeats are dropped for all texts at once.
        sizes = np.maximum(counts - self.width + 1, 0)
        ends = np.cumsum(sizes)
        inside = hashed[np.arange(ends[-1]) + np.repeat(np.cumsum(counts) - counts - ends + sizes, sizes)]
        start, starts = 0, []
        for end in ends.tolist():
            inside[start:end].sort()
            if end > start:
                starts.append(start)
            start = end
        kept = np.ones(len(inside), bool)
        kept[1:] = inside[1:] != inside[:-1]
        kept[starts] = True
        return np.split(inside[kept], np.append(0, np.cumsum(kept))[ends[:-1]])


def signatures(shingles: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tree labels (rows x TREES, 64 bits: LEVELS minima of 16 bits, first on top) and sketches (rows x WORDS)."""
    sizes = np.fromiter(map(len, shingles), np.int64, len(shingles))
    short = (np.concatenate(shingles) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    minima = np.empty((TREES * LEVELS, len(shingles)), np.uint32)
    for i in range(TREES * LEVELS):
        minima[i] = np.minimum.reduceat((short ^ FLIP[i]) * MULTIPLY[i], starts)
    folded = ((minima * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint64)
    labels = np.zeros((len(shingles), TREES), np.uint64)
    for level in range(LEVELS):
        labels = (labels << np.uint64(16)) | folded[level * TREES : (level + 1) * TREES].T
    sketches = np.zeros((len(shingles), WORDS), np.uint64)
    for lane in range(LANES):
        sketches[:, lane // 16] |= (folded[lane] & np.uint64(15)) << np.uint64(4 * (lane % 16))
    return labels.view(np.int64), sketches.view(np.int64)


ONES = np.uint64(0x1111111111111111)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lanes in which sketches agree; ``a`` and ``b`` are (rows x words) of equal shape."""
    out = np.full(len(a), LANES, np.int32)
    for word in range(a.shape[1]):
        x = (a[:, word] ^ b[:, word]).view(np.uint64)
        x = x | (x >> np.uint64(1))
        x = x | (x >> np.uint64(2))
        out -= np.bitwise_count(x & ONES).astype(np.int32)
    return out


def least_agreeing(threshold: float, deviations: float = 3.3) -> int:
    """Fewest agreeing lanes of a pair at the threshold, up to so many standard deviations below the mean."""
    p = threshold + (1 - threshold) / 16
    return max(1, int(np.floor(LANES * p - deviations * np.sqrt(LANES * p * (1 - p)))))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Shingles that both of two sorted distinct arrays hold."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
