"""Problem 6: token ids of a whole corpus under a public byte-level BPE vocabulary.

Texts are cut into pieces by the vocabulary's pattern. The distinct pieces of a batch are put into a trie, here as
their sorted list, whose neighbours share their prefixes. A depth-first walk gives each node the *last token* of the
encoding of the node's prefix; it follows from the last tokens of shorter prefixes on the same path, so a prefix that
many pieces share is computed once. A piece's encoding is read backwards along its path.

The last token of a prefix is the one token that ends the prefix and may stand after the last token of what is before
it. Two tokens may stand side by side if undoing their merges at the seam, latest first, never shows two tokens that
would have been merged earlier. Ids equal those of the merge loop for every text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces and chunks that a worker remembers before it starts afresh: a bound on memory without effect on results.
MEMORY = 600_000
#: Texts that are encoded together.
TOGETHER = 256


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public tokenizers keep their files; callers may pass any other path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a rank file: one base64 token and its id per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _halves(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """The two tokens whose merge makes each token of more than one byte."""
    halves = {}
    for token, rank in ranks.items():
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= rank:
                raise ValueError(f"token {rank} can't be made by merges")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        halves[rank] = (ranks[parts[0]], ranks[parts[1]])
    return halves


class Vocabulary:
    """Ranks with what the walk needs; of fixed size (some 50,000 tokens), made once and sent to the workers."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.halves = _halves(ranks)
        self.longest = max(map(len, ranks))
        self.seams = self._seams()

    def _seams(self) -> frozenset[tuple[bytes, bytes]]:
        """What a token may hold on either side of a seam between two characters beyond ASCII, at most 4 bytes each."""
        seams = set()
        for token in self.ranks:
            for i in range(1, len(token)):
                if token[i] >= 0xC0 and token[i - 1] >= 0x80:
                    left, right = token[:i], token[i:]
                    starts = [k for k in range(len(left)) if left[k] & 0xC0 != 0x80]
                    ends = [k for k in range(1, len(right)) if right[k] & 0xC0 != 0x80]
                    seams.add((left[starts[-1] :] if starts else left, right[: ends[0]] if ends else right))
        return frozenset(seams)


class Encoder:
    """Encodes batches of texts in one worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.ranks, self.halves, self.longest = vocabulary.ranks, vocabulary.halves, vocabulary.longest
        self.seams = vocabulary.seams
        self.pairs = {pair: token for token, pair in self.halves.items()}
        self.length = {rank: len(token) for token, rank in self.ranks.items()}
        self.find = regex.compile(PATTERN).findall
        self.cut = re.compile(r"(?<=\S)(?= )").split
        self.blank_first = re.compile(r"\s ").search
        self.chunks: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        self.known: set[tuple[str, str]] = set()
        self.shut: set[tuple[str, str]] = set()

    def _may_stand(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow token ``a`` in an encoding."""
        known = self.beside.get((a, b))
        if known is None:
            left, right, limit, known = a, b, 1 << 60, True
            while True:
                merged = self.pairs.get((left, right))
                if merged is not None and merged < limit:
                    known = False
                    break
                if left > right:
                    if left not in self.halves:
                        break
                    limit, left = left, self.halves[left][1]
                else:
                    if right not in self.halves:
                        break
                    limit, right = right + 1, self.halves[right][0]
            self.beside[a, b] = known
        return known

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Encodings of sorted distinct words, by a depth-first walk over the trie that the list stands for."""
        last: list[int] = [-1]
        before, out = b"", []
        get, longest, length, may = self.ranks.get, self.longest, self.length, self._may_stand
        for word in words:
            shared, limit = 0, min(len(before), len(word))
            while shared < limit and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    token = get(word[start:end])
                    if token is not None and (start == 0 or may(last[start], token)):
                        break
                last.append(token)
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= length[last[at]]
            out.append(np.array(ids[::-1], np.int32).tobytes())
            before = word
        return out

    def _open(self, a: str, b: str) -> bool:
        """Whether some token may reach across the seam between the characters ``a`` and ``b``."""
        left, right = a.encode(), b.encode()
        return any((left[i:], right[:j]) in self.seams for i in range(len(left)) for j in range(1, len(right) + 1))

    def _units(self, piece: str) -> list[str]:
        """Parts of a piece that merges can't join: cut between characters beyond ASCII that no token bridges."""
        if piece.isascii() or len(piece) < 3:
            return [piece]
        pairs = list(zip(piece, piece[1:]))
        if not self.known.issuperset(pairs):
            for pair in set(pairs).difference(self.known):
                self.known.add(pair)
                if pair[0] >= "\x80" and pair[1] >= "\x80" and not self._open(*pair):
                    self.shut.add(pair)
        shut = self.shut
        if shut.issuperset(pairs):
            return list(piece)
        cuts = [0, *(i for i, pair in enumerate(pairs, 1) if pair in shut), len(piece)]
        return [piece[i:j] for i, j in zip(cuts, cuts[1:])]

    def _split(self, text: str) -> list[str]:
        """The text cut before blanks that follow a visible character, where no piece reaches across."""
        if self.blank_first(text) or text[:1] == " ":
            return self.cut(text)
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers in native order."""
        if len(self.chunks) > MEMORY or len(self.units) > MEMORY:
            self.chunks.clear(), self.units.clear()
        if len(self.beside) + len(self.known) > 4 * MEMORY:
            self.beside.clear(), self.known.clear(), self.shut.clear()
        split = [self._split(t) if t else [] for t in texts]
        fresh = set().union(*split).difference(self.chunks)
        if fresh:
            parts = {c: [u for piece in self.find(c) for u in self._units(piece)] for c in fresh}
            words = sorted((u.encode(), u) for u in set().union(*parts.values()).difference(self.units))
            for (_, unit), ids in zip(words, self._learn([w for w, _ in words])):
                self.units[unit] = ids
            ids_of = self.units.__getitem__
            for chunk, units in parts.items():
                self.chunks[chunk] = b"".join(map(ids_of, units))
        get = self.chunks.__getitem__
        return [b"".join(map(get, x)) for x in split]


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str | None = None) -> Vocabulary:
    """The vocabulary of a rank file, made once per process."""
    path = path or vocabulary_path()
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(load_ranks(path))
    return _VOCABULARIES[path]


def encode_texts(df: DataFrame, key: str, text: str, path: str | None = None, counts_only: bool = False) -> DataFrame:
    """``key`` and ``ids ARRAY<INT>`` (or ``n_tokens INT``) of every row.

    An empty text gives an empty list (0), a null text null. Marker strings of special tokens are ordinary text.
    Other columns of ``df`` are not read. No shuffle: one narrow pass.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))
    kind = df.select(F.col(key)).schema[0].dataType.simpleString()
    column = "n_tokens" if counts_only else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                texts = part.column(1).to_pylist()
                raw = encoder.encode([t or "" for t in texts])
                none = np.array([t is None for t in texts], bool)
                sizes = np.array([len(r) // 4 for r in raw], np.int32)
                if counts_only:
                    values = pa.array(sizes, mask=none)
                else:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    values = pa.ListArray.from_arrays(
                        pa.array(offsets, pa.int32(), mask=np.append(none, False)),
                        pa.array(np.frombuffer(b"".join(raw), np.int32)),
                    )
                yield pa.RecordBatch.from_arrays([part.column(0), values], [key, column])

    schema = f"`{key}` {kind}, {column} {'int' if counts_only else 'array<int>'}"
    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)
