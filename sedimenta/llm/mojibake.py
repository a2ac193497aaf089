"""Problem 8: texts decoded with a wrong encoding, found and restored with a noisy-channel model.

The source model is the corpus itself: how often each word beyond ASCII, each pair of neighbouring Chinese characters
and each symbol beyond ASCII occurs in all documents. The channel is a wrong encoding W in place of the right one R. A token is
undone by writing it in W, which gives a lattice of bytes with wildcards where bytes were lost, and reading the lattice
in R along the most likely path. A token is garbled if some channel explains it far better than it explains itself.
"""

from __future__ import annotations

import codecs
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.session import cut

# The channels that are considered, as (wrong encoding, right encoding).
CHANNELS = [
    ("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"), ("mac-roman", "utf-8"),
    ("cp1251", "utf-8"), ("koi8-r", "utf-8"), ("cp866", "utf-8"), ("cp1250", "utf-8"), ("iso8859-15", "utf-8"),
    ("gb18030", "utf-8"), ("cp932", "utf-8"), ("big5", "utf-8"), ("cp949", "utf-8"), ("euc-jp", "utf-8"),
    ("cp1252", "gbk"), ("latin-1", "gbk"), ("big5", "gbk"), ("cp932", "gbk"), ("cp949", "gbk"), ("cp437", "gbk"),
    ("cp1251", "gbk"), ("mac-roman", "gbk"), ("cp1252", "big5"), ("gb18030", "big5"),
    ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp866", "koi8-r"), ("koi8-r", "cp866"),
    ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1252", "koi8-r"), ("latin-1", "koi8-r"), ("mac-cyrillic", "cp1251"), ("cp1252", "cp866"),
    ("cp850", "cp1252"), ("cp437", "cp1252"), ("mac-roman", "cp1252"), ("cp1252", "mac-roman"), ("cp1252", "cp850"), ("cp1252", "cp437"),
    ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("gb18030", "cp1252"), ("cp932", "cp1252"), ("koi8-r", "cp1252"), ("iso8859-5", "cp1251"),
]
#: A word enters the model with at least this share of all words counted, so the model has at most 2,000,000 words.
SHARE = 5e-7
#: Nats by which a channel must explain a token better than it explains itself, and for a token with a lost character.
GAIN, GAIN_LOST = 3.0, 2.0
#: Nats that the tokens of a garbled text must gain together.
GAIN_TEXT = 6.0
#: Tokens that a worker remembers before it starts afresh: a bound on memory without effect on results.
MEMORY = 300_000
LOST = "�"
_LOSSY = re.compile(rf"((?:[^\W\d_]|{LOST})+)")

#: Symbols that right texts have between letters; any other symbol beyond ASCII there belongs to the word.
_BETWEEN = "’‘“”–—…‑·•«»/"
_LETTER = r"(?:(?![一-鿿])[^\W\d_])"
_PARTS = re.compile(rf"[一-鿿]+|{_LETTER}+(?:(?:(?![{_BETWEEN}])[^\w\s\x00-\x7f])+{_LETTER}+)*|[^\w\s]").findall
_TOKENS = re.compile(r"[^ \t\r\n]+").findall
#: Characters up to which a garbled sequence in quotation marks is a quotation; a longer one is a garbled part of the text.
QUOTE = 24
_QUOTED = re.compile(r"“[^“”\n]{1,%s}”|\"[^\"\n]{1,%s}\"|`[^`\n]{1,%s}`|(?<![^\s(])«[^«»\n]{1,%s}»(?![^\s.,;:!?)])|„[^„“”\n]{1,%s}[“”]|‘[^‘’\n]{1,%s}’|「[^「」\n]{1,%s}」|'[^'\n ]{1,%s}'".replace("%s", str(QUOTE)))


#: A symbol stuck between letters, which no right reading has.
_STUCK = re.compile(r"[^\W\d_](?![’'·\-‐‑–/.])[^\w\s\x00-\x7f]+(?=[^\W\d_])|(?<!\w)[^\w\s\x00-\x7f“„«‘(¿¡]+(?=[^\W\d_])").search
_DOUBT = re.compile("[\x80-\x9fÃÂÐÑâÅãïΓ├┬┤╬ÔÇ锟鈥聽]").search
_HAN_RUN = re.compile(r"[一-鿿]{4}").search
_BEYOND = re.compile(r"[^\x00-\x7f]").search
_BLANK = frozenset("\t\r\n　\xa0\u202f\u2009\ufeff\ufe0f\u200d\u200b\xad")


def words_of(text: str) -> list[str]:
    """What the model counts: pairs of neighbouring Chinese characters, other words and symbols beyond ASCII."""
    out = []
    for part in _PARTS(text.lower()):
        if part.isascii() or part == LOST:
            continue
        if "一" <= part[0] <= "鿿":
            out += map("".join, zip(part, part[1:])) if len(part) > 1 else [part]
        else:
            out.append(part)
    return out


def counted(df: DataFrame, text: Column) -> DataFrame:
    """``word, n`` over all texts: counted in the workers first, so the shuffle holds each word once per flush."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            for word in [w for w in counts if len(w) > 1 and not w.isalnum()]:  # words with symbols inside are never known
                del counts[word]
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            tokens: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                if text and not text.isascii():
                    tokens.update(t for t in _TOKENS(text) if not t.isascii())
            for token, times in tokens.items():
                if times == 1:
                    counts.update(words_of(token))
                else:
                    for word in words_of(token):
                        counts[word] += times
            if len(counts) > MEMORY:
                yield flush()
        if counts:
            yield flush()

    parts = df.select(text.alias("text")).filter("text IS NOT NULL").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(counts: DataFrame, share: float = SHARE) -> dict[str, int]:
    """The words with at least ``share`` of all counts: at most 1 / share of them, whatever the size of the corpus."""
    counts = cut(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.filter(F.col("n") >= share * total).toArrow()
    return dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist()))


def _writers() -> dict[str, dict[str, bytes]]:
    """For each one-byte encoding, the byte of each character; bytes without a character stand for themselves."""
    out = {}
    for wrong in {w for w, _ in CHANNELS}:
        if wrong in ("gb18030", "gbk", "cp932", "big5", "cp949", "euc-jp"):
            continue
        table = {chr(b): bytes([b]) for b in range(256)} if wrong != "latin-1" else {}
        own = {}
        for b in range(256):
            try:
                own[bytes([b]).decode(wrong)] = bytes([b])
            except UnicodeDecodeError:
                pass
        out[wrong] = {c: b for c, b in table.items() if 0x80 <= ord(c) < 0xA0 or ord(c) < 0x80} | own
    return out


class Channel:
    """Undoes wrong decodings of tokens under the word model; one per worker."""

    def __init__(self, model: dict[str, int]):
        self.model = model
        self.total = sum(model.values()) + 1
        self.floor = math.log(0.3 / self.total)
        self.logs = {word: math.log(n / self.total) for word, n in model.items()}
        self.writers = _writers()
        self.maps = {wrong: {ord(char): byte[0] for char, byte in table.items() if len(char) == 1} for wrong, table in self.writers.items()}
        self.known: dict[str, tuple[float, str | None, str]] = {}
        self.patterns: dict[str, list[str]] | None = None
        self.fitting: dict[str, dict[tuple, list[str]]] = {}
        self.preceding: dict[str, dict[str, float]] | None = None
        self.alone: dict[str, float] = {}
        self.chars: Counter[str] = Counter()
        for word, n in model.items():
            for char in word:
                if char >= "\x80":
                    self.chars[char] += n

    def score(self, text: str) -> tuple[float, int, int]:
        """Log-likelihood of the words beyond ASCII, how many there are, and how many of them are unknown."""
        words = words_of(text)
        known = self.logs
        total, unknown = 0.0, 0
        for word in words:
            gained = known.get(word)
            if gained is None:
                total += self.floor - 6.0 * max(0, len(word) - 4)
                unknown += 1
            else:
                total += gained
        return total, len(words), unknown

    def _bytes(self, text: str, wrong: str) -> list[int] | None:
        """The bytes of ``text`` in ``wrong``; None stands for a lost byte. Nothing if it can't be written so."""
        table = self.writers.get(wrong)
        if table is not None:
            if LOST not in text:
                try:
                    return list(codecs.charmap_encode(text, "strict", self.maps[wrong])[0])
                except UnicodeEncodeError:
                    return None
            out: list[int | None] = []
            for char in text:
                byte = table.get(char)
                if byte is not None:
                    out.append(byte[0])
                elif char == LOST:
                    out.append(None)
                else:
                    return None
            return out
        out = []
        try:
            for part in text.split(LOST):
                out += part.encode(wrong)
                out.append(None)
        except UnicodeEncodeError:
            return None
        return out[:-1]

    def _read(self, data: list[int | None], right: str) -> str | None:
        """The lattice read in ``right``: by the codec where no byte is lost, else along the most likely path."""
        if None not in data:
            try:
                return bytes(data).decode(right)
            except UnicodeDecodeError:
                text = bytes(data).decode(right, "replace")
                spoilt = text.count(LOST)
                whole = len(text) - len(text.encode("ascii", "ignore")) - spoilt
                if spoilt == 1 and text.endswith(LOST) and whole:
                    return text[:-1]
                return text if whole >= 4 * spoilt else None
        return self._viterbi(data, right)

    def _viterbi(self, data: list[int | None], right: str) -> str | None:
        """Best path through the byte lattice; a wildcard stands for a lost byte or two, a stray byte stays lost."""
        if right not in ("utf-8", "gbk", "big5"):
            text = "".join(LOST if byte is None else bytes([byte]).decode(right, "replace") for byte in data)
            return "".join(self._wild(part) or part for part in _LOSSY.split(text))
        fits = self._fits(right)
        size, spoilt = len(data), 1.5 * self.floor
        states: dict[int, dict[str, tuple[float, str]]] = {0: {"": (0.0, "")}}
        precede, alone, nothing = self._before(), self.alone, {}
        unseen = math.log(0.3 / self.total) - 6.0
        for at in range(size):
            tails = states.pop(at, None)
            if not tails:
                continue
            here = sorted(tails.values(), key=lambda x: -x[0])
            first = data[at]
            moves: list[tuple[int, str, float]] = []
            if first is None:
                moves.append((at + 1, "", -2.0))
                moves.append((at + 1, LOST, spoilt))
            elif first < 0x80:
                moves.append((at + 1, chr(first), 0.0))
            else:
                moves.append((at + 1, LOST, spoilt))
                for length in (2, 3):
                    for hidden in (0, 1):
                        seen = data[at : at + length - hidden]
                        if len(seen) < length - hidden or hidden and None not in seen:
                            continue
                        shown: list[int | None] = []
                        for byte in seen:
                            shown += [None, None] if byte is None and hidden and len(seen) + shown.count(None) < length + 1 and None not in shown else [byte]
                        for char in fits.get(tuple(shown), ()) if len(shown) == length else ():
                            moves.append((at + len(seen), char, 0.0))
            for end, char, cost in moves:
                kept = states.setdefault(end, {})
                if char and char >= "\x80" and char != LOST:
                    before = precede.get(char, nothing)
                    if len(before) < len(tails):
                        reached = [(tails[tail], gained) for tail, gained in before.items() if tail in tails]
                    else:
                        reached = [(x, before[tail]) for tail, x in tails.items() if tail in before]
                    if len(reached) < len(tails):  # the best of the others: all of them gain the same
                        other = next(x for x in here if x[1][-1:] not in before)
                        reached.append((other, alone.get(char, unseen)))
                    best = None
                    for x, gained in reached:
                        if best is None or x[0] + gained > best[0]:
                            best = (x[0] + gained, x[1])
                    if char not in kept or kept[char][0] < best[0]:
                        kept[char] = (best[0], best[1] + char)
                    continue
                for score, text in here:
                    tail = char or text[-1:]
                    if tail not in kept or kept[tail][0] < score + cost:
                        kept[tail] = (score + cost, text if char == LOST and text.endswith(LOST) else text + char)
        ends = states.get(size)
        return max(ends.values())[1] if ends else None

    def _before(self) -> dict[str, dict[str, float]]:
        """For each character, the characters (or nothing) that the model has before it, and the log share of the pair."""
        if self.preceding is None:
            self.preceding = {}
            for word, n in self.model.items():
                if len(word) <= 2:
                    self.preceding.setdefault(word[-1], {})[word[:-1]] = math.log(n / self.total)
            self.alone = {char: math.log((n + 0.3) / self.total) - 6.0 for char, n in self.chars.items()}
        return self.preceding

    def _fits(self, right: str) -> dict[tuple, list[str]]:
        """The model's characters beyond ASCII by their bytes in ``right``, with any of the later bytes unknown."""
        if right not in self.fitting:
            table: dict[tuple, list[str]] = {}
            for char, _ in sorted(self.chars.items(), key=lambda x: (-x[1], x[0])):
                try:
                    raw = tuple(char.encode(right))
                except UnicodeEncodeError:
                    continue
                masks = {2: [(0, 0), (0, 1)], 3: [(0, 0, 0), (0, 1, 0), (0, 0, 1), (0, 1, 1)]}.get(len(raw), [])
                for mask in masks:
                    table.setdefault(tuple(None if m else b for b, m in zip(raw, mask)), []).append(char)
            self.fitting[right] = table
        return self.fitting[right]

    def _wild(self, word: str) -> str | None:
        """The likeliest word of the model that fits a word with lost characters; None if none does.

        A mark stands for one lost character or two. Words are independent of each other in the model, so the likeliest
        path through a token is that of its words.
        """
        if LOST not in word or len(word) < 2:
            return None
        if self.patterns is None:
            self.patterns = {}
            for known, n in sorted(self.model.items(), key=lambda x: (-x[1], x[0])):
                if len(known) > 1 and not "一" <= known[0] <= "鿿":
                    shape = "".join(c if c.isascii() else LOST for c in known)
                    self.patterns.setdefault(shape, []).append(known)
        low, best = word.lower(), None
        for extra in range(low.count(LOST) + 1):
            at = [k for k, c in enumerate(low) if c == LOST]
            longer = low
            for k in at[:extra][::-1]:
                longer = longer[:k] + LOST + longer[k:]
            shape = "".join(c if c.isascii() else LOST for c in longer)
            for known in self.patterns.get(shape, ()):
                if all(a in (LOST, b) for a, b in zip(longer, known)):
                    if best is None or self.model[known] > 30**extra * self.model[best[1]]:
                        best = (longer, known)
                    break  # the others are rarer
        if best is None:
            return None
        cased = word if len(best[1]) == len(word) else best[0]
        return "".join(b.upper() if a.isupper() or a == LOST and word.isupper() else b for a, b in zip(cased, best[1]))

    def undo(self, token: str) -> tuple[float, str | None, str]:
        """(gain in nats, channel or None, restored token) of the best explanation of a token with characters beyond ASCII."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) > MEMORY:
                self.known.clear()
            found = self.known[token] = self._undo(token)
        return found

    def _undo(self, token: str) -> tuple[float, str | None, str]:
        own, count, unknown = self.score(token)
        lost = LOST in token
        if not lost and (not count or own / count > -11.8 and unknown * 5 <= count) and not _doubtful(token) and not _STUCK(token):
            return 0.0, None, token
        head, han = _BEYOND(token).group(), _HAN_RUN(token) is not None
        best: tuple[float, str | None, str] = (0.0, None, token)
        for wrong, right in CHANNELS:
            if han and right not in ("utf-8", "gbk", "big5"):  # one-byte encodings don't give runs of these
                continue
            text, before = token, -math.inf
            while True:  # the gain grows from layer to layer, or it ends
                table = self.writers.get(wrong)
                if table is not None and text is token and head not in table and head != LOST:
                    break
                data = self._bytes(text, wrong)
                read = self._read(data, right) if data else None
                if read is None or read == text:
                    break
                spoilt = not read.isprintable() and any(not c.isprintable() and c not in _BLANK and c != LOST for c in read)
                if spoilt and right != "utf-8":
                    break  # no layer below it could be better
                score, words, missing = self.score(read)
                missing += read.count(LOST)
                score += self.floor * read.count(LOST)
                if right not in ("utf-8", "gbk", "big5"):
                    spoilt = spoilt or missing > 0 or not words or _STUCK(read) is not None
                if not spoilt and not lost and all(c.isalnum() or c < "\x80" for c in token):  # symbols don't come from letters, but for those of three bytes in UTF-8
                    spoilt = any(c >= "\x80" and not c.isalnum() and (right != "utf-8" or c < "\u2000") for c in read)
                gain = score - own - 1.0
                if words and missing * 6 <= words and not spoilt and gain > best[0]:
                    best = (gain, f"{right} read as {wrong}", read)
                if right != "utf-8" or gain <= before:
                    break
                text, before = read, gain  # perhaps decoded wrongly more than once
        if lost and best[1] is None:
            text = "".join(self._wild(part) or part for part in _LOSSY.split(token))
            best = (GAIN_LOST, "bytes lost", text)
        return best


def _doubtful(token: str) -> bool:
    """Whether a token holds characters that wrong decodings are full of."""
    return _DOUBT(token) is not None


def _told(line: str, token: str, restored: str) -> bool:
    """Whether a line that holds a garbled token names its right form beside it: then it speaks about the token."""
    core, plain = token.strip(".,;:!?()[]，。；："), restored.strip(".,;:!?()[]，。；：")
    rest = line.replace(core, " ", 1)
    return plain != "" and re.search(rf"(?<!\w){re.escape(plain)}(?!\w)", rest) is not None


class Restorer:
    """Finds and restores garbled parts of texts; one per worker."""

    def __init__(self, model: dict[str, int]):
        self.channel = Channel(model)

    def restore(self, text: str) -> tuple[int, str, Counter]:
        """(garbled tokens, restored text, channels). A null text is the caller's; an empty one has none."""
        if text.isascii():
            return 0, text, Counter()
        undo = self.channel.undo
        if all(undo(t)[1] is None for t in _TOKENS(text) if not t.isascii()):
            return 0, text, Counter()
        out, garbled, total, channels = [], 0, 0.0, Counter()
        for line in text.split("\n"):
            if line.isascii():
                out.append(line)
                continue
            bare = _QUOTED.sub(lambda m: " " * len(m.group()), line)
            fixed, at = [], 0
            for match in re.finditer(r"[^ \t\r\n]+", bare):
                token = match.group()
                if token.isascii():
                    continue
                gain, channel, read = self.channel.undo(token)
                if channel is None or gain < (GAIN_LOST if LOST in token else GAIN) or _told(line, token, read):
                    continue
                garbled += 1
                total += GAIN_TEXT if LOST in token else gain
                channels[channel] += 1
                fixed += [line[at : match.start()], read]
                at = match.end()
            out.append("".join([*fixed, line[at:]]))
        if total < GAIN_TEXT:
            return 0, text, Counter()
        return garbled, "\n".join(out), channels


def restored(df: DataFrame, key: str, text: str, model: dict[str, int]) -> DataFrame:
    """``key, garbled, channel, text`` of the rows with a garbled token, ``text`` restored as far as it can be.

    Null and empty texts have no row. ``channel`` is the one that explains most tokens. One narrow pass.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.select(F.col(key)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                garbled, read, channels = restorer.restore(text)
                if garbled:
                    rows.append((i, garbled, min(channels, key=lambda c: (-channels[c], c)), read))
            if rows:
                at, garbled, names, texts = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(garbled, pa.int32()), pa.array(names), pa.array(texts)], [key, "garbled", "channel", "text"])

    wanted = df.select(F.col(key), F.col(text).alias("text")).filter(r"text RLIKE '[^\\x00-\\x7f]'")
    return wanted.mapInArrow(run, f"`{key}` {kind}, garbled int, channel string, text string")
