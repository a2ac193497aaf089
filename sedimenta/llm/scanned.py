"""Problem 2: text of scanned pages, its noise found line by line and the text repaired into paragraphs.

The language model is the corpus: words, hyphenated compounds and pairs of neighbouring Chinese characters of all
bodies, the lines that are headings in many of them, and the phrases that recur as lines within many of them.

A text is taken for scanned by a score: page numbers that count, running headers and footers that cut sentences, words
broken at line ends and stray blanks between Chinese characters speak for it, lines of Markdown against it.

1. Lines of page furniture are taken out: page numbers, and lines that recur at page seams, even when misread.
2. What is left is one stream of characters without its line ends. A shortest path through its lattice decides for each
   word and each Chinese character whether it stands as it is, is misread, goes on after a stray blank, a hyphen or a
   line end, or is two words that lost their blank. Words are walked as prefixes of the vocabulary, with confusions.
3. Paragraph boundaries are the cheapest segmentation of the lines, by dynamic programming.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.session import cut

# What scanners read, and what it was.
CONFUSIONS = [
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("1", "i"), ("1", "l"), ("l", "i"), ("i", "l"), ("l", "t"), ("0", "o"), ("o", "a"), ("a", "o"), ("5", "s"), ("8", "b"), ("9", "g"), ("6", "é"), ("6", "b"),
    ("b", "h"), ("h", "b"), ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("vv", "w"), ("w", "vv"), ("m", "in"), ("in", "m"), ("ni", "m"), ("h", "li"), ("li", "h"),
    ("u", "n"), ("n", "u"), ("tt", "ü"), ("ii", "ü"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("a", "ä"), ("o", "ö"), ("u", "ü"), ("e", "é"), ("q", "g"), ("g", "q"), ("y", "v"), ("v", "y"), ("!", "l"), ("|", "l"), ("é", "e"), ("lt", "k"), ("fi", "ﬁ"),
    ("B", "ß"), ("r", "n"), ("s", "5"), ("j", "i"), ("ö", "o"), ("ä", "a"), ("ü", "u"),
]
# Chinese characters that are read for each other, one group each.
LOOKALIKES = (
    "木本术 市布 贞页负贝 囹图圄圆困 仵件忤 人入八 问间向同闻 日旧曰目白 末未朱 丈文又 宙审亩 厍库 抉块快决 异导 己已巳 大太犬夫天 土士上 千干于 王玉主 田由甲申 自目 侍待持 今令 刀力 九丸 午牛 名各 代伐 折拆析 侯候 辩辨 "
    "治冶 没设 住往佳 晴睛 请清情 侧测则 拔拨 复夏 密蜜 准淮 史吏 体休 何伺 徒徙 微徽 怏快 戌戍 扳板 技枝 报执 毎每 洁诘 淸清 了子 万方 用甩 风凤 乌鸟 买卖 历厉 厂广 止正 壮状 处外 己巳 母毌 密宻 录彔 汁计 沐沭 未来 "
    "理埋 現现 表袤 袖抽 栏拦 档挡 模摸 根报 标杯 段投 组绀 细绸 给绐 结绪 续绩 编偏 缩绾 综棕 词诃 译泽 读续 证讧 项顶 须顺 预顸 题匙 颗颖 饮钦 验脸 版板 换挟 据掘 描猫 推椎 核该 格恪 级极 约的 线钱 统绕 时吋 明朋 是昰 晚挽"
).split()
_DIGITS = r"[0-9lIoOSB]{1,4}"
_DIGIT = frozenset("0123456789lIoOSB")
#: A line that is a page number.
PAGE = re.compile(
    rf"(?:[-–—~·] ?{_DIGITS} ?[-–—~·]|\[ ?{_DIGITS} ?\]|\( ?{_DIGITS} ?\)|(?=[lIoOSB]*[0-9]){_DIGITS}|{_DIGITS} ?/ ?{_DIGITS}|[ivxl]{{1,7}}|[IVX]{{1,7}}"
    rf"|(?:[Pp]a[gq][ec]|[Ss][ec][il1]t[ec]|S\.|[Pp]\.|PAGE|SEITE|Bl\.|Blatt) ?{_DIGITS}(?: ?(?:of|0f|von|sur|de|/|av|VON|OF|SUR) ?{_DIGITS})?|第 ?{_DIGITS} ?页(?:[ ,，/]*共 ?{_DIGITS} ?页)?)"
)
HYPHEN = re.compile(r"([^\W\d_]{2,}|[^\W_]{2,})[-‐‑¬\xad]\s*$")
_BESIDE = re.compile(rf"\A{_DIGITS}\s{{2,}}|\s{{2,}}{_DIGITS}\Z")
_HYPHENS = tuple("-‐‑¬\xad")
# Chinese characters are left out within the class: a look ahead before each character took several times as long.
_WORD = re.compile(r"[^\W_一-鿿]+(?:[’'][^\W_一-鿿]+)*")
_TOKEN = re.compile(r"[^\W_一-鿿]+").finditer
_LETTERS = re.compile(r"[^\W\d_一-鿿]+")
_PLAIN = re.compile(r"[^\W_一-鿿]*[^\W\d_一-鿿][^\W_一-鿿]*").findall
_COMPOUND = re.compile(r"[^\W\d_一-鿿]{2,}(?:-[^\W\d_一-鿿]{2,})+")
_HAN = re.compile(r"[一-鿿]+")
_HAN_RUN = re.compile(r"[一-鿿]+(?:\n[一-鿿]+)*")
#: One blank between two Chinese characters, as only scanners leave it; lines of cells have more or wider gaps.
_STRAY = re.compile(r"(?<=[一-鿿，、])[ ](?=[一-鿿])")
_SPACED = re.compile(r"(?<=[一-鿿，。；：、])[ \t]+|[ \t]+(?=[一-鿿，。；：、])")
#: A line that a sentence does not end with.
_OPEN = re.compile(r"[^.!?。！？:：…|>]\s*\Z").search
_PIECES = re.compile(r"\s*[·|–—]\s*|\s{2,}")
#: Lines of Markdown: headings, fences and comments, which no scanner makes, and others, which may be misread text (a
#: row of a table ends with its bar, else the first letter may be a misread l).
_MARKDOWN = re.compile(r"^(?:(#{1,6} |```|<!--)|(?:\|(?=[ :]|.*\|[ \t]*\r?$)|> |[*+] |- (?!\d)).*)", re.M).finditer
#: Lines that a heading, fence or comment counts as.
PLAINLY = 8
_BROKEN = re.compile(r"[-‐‑¬\xad](?<=[^\W\d_]{2}.)[ \t]*\r?$", re.M).search
#: Entries of the model have at least this share of their kind's counts, so there are at most 2,000,000 of each kind.
SHARE = 5e-7
MEMORY = 300_000
KINDS = "wchler"
#: Nats by which another reading of a Chinese character must beat it: if the two look alike, and if not.
CHANGE, STRANGE = math.log(100), math.log(3000)


def _edges(text: str, start: int, end: int) -> tuple[str, str]:
    """What stands before and after a run of Chinese characters: 0 a digit, a another letter, a dot anything else or nothing."""
    kind = lambda char: "0" if char.isdigit() else "a" if char.isalpha() else "."
    start -= text[start - 1 : start] == "\n"
    end += text[end : end + 1] == "\n"
    return kind(text[start - 1 : start] if start else ""), kind(text[end : end + 1])


def _recurring(text: str) -> set[str]:
    """Phrases of the lines that recur within a text: their pieces, and their last words marked with ``*``."""
    lines = [t for t in map(str.strip, text.split("\n")) if t]
    if len(set(lines)) == len(lines):
        return set()
    found = set()
    for line, n in Counter(lines).items():
        if n > 1 and line[0].isalpha():
            pieces = {p.lower() for p in _PIECES.split(line) if len(p) > 1}
            found |= pieces | {"*" + p.split()[-1] for p in pieces if " " in p}
    return found


def counted(df: DataFrame, body: Column) -> DataFrame:
    """``kind, word, n`` over all bodies: w words, c compounds, h pairs of Chinese characters, e their runs' edges, l heading
    lines, r bodies within which a line recurs that is or ends with the phrase (``*`` before a last word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {kind: Counter() for kind in KINDS}

        def flush() -> pa.RecordBatch:
            rows = [(k, w, n) for k, c in counts.items() for w, n in c.items()]
            for c in counts.values():
                c.clear()
            kinds, words, ns = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(words, pa.string()), pa.array(ns, pa.int64())], ["kind", "word", "n"])

        for batch in batches:
            tokens: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                tokens.update(text.lower().split())
                counts["r"].update(_recurring(text))
                if "#" in text:
                    counts["l"].update(h.strip().lower() for h in re.findall(r"(?m)^#{1,6} +(.{1,40}?)\s*$", text))
            for token, times in tokens.items():
                if token.isascii():
                    found = _LETTERS.findall(token)
                else:
                    found = _LETTERS.findall(token)
                    for match in _HAN.finditer(token):
                        run_ = match.group()
                        for pair in map("".join, zip(run_, run_[1:])):
                            counts["h"][pair] += times
                        before, after = _edges(token, *match.span())
                        counts["e"][before + run_[0]] += times
                        counts["e"][run_[-1] + after] += times
                for word in found:
                    counts["w"][word] += times
                if "-" in token:
                    for word in _COMPOUND.findall(token):
                        counts["c"][word] += times
            if sum(map(len, counts.values())) > MEMORY:
                yield flush()
        yield flush()

    parts = df.select(body.alias("body")).filter("body IS NOT NULL AND body != ''").mapInArrow(run, "kind string, word string, n long")
    return parts.groupBy("kind", "word").agg(F.sum("n").alias("n"))


def model(counts: DataFrame, share: float = SHARE) -> dict[str, dict[str, int]]:
    """The entries with at least ``share`` of their kind's counts: at most 1 / share of each kind."""
    counts = cut(counts)
    totals = counts.groupBy("kind").agg(F.sum("n").alias("total"))
    kept = counts.join(F.broadcast(totals), "kind").filter(F.col("n") >= share * F.col("total")).toArrow()
    out: dict[str, dict[str, int]] = {kind: {} for kind in KINDS}
    for kind, word, n in zip(*(kept.column(c).to_pylist() for c in ("kind", "word", "n"))):
        out[kind][word] = n
    return out


def _broken(text: str) -> re.Match | None:
    """The word before a hyphen that ends a line."""
    return HYPHEN.search(text) if text.rstrip()[-1:] in _HYPHENS else None


@dataclass
class Line:
    """One line of a body."""

    number: int
    text: str
    furniture: bool = False
    kinds: set[str] = field(default_factory=set)
    words: list[str] = field(default_factory=list)


_FOLDS = str.maketrans("1i0a5cb6é9tuäöü", "llooeshee9fnoon")


def _fold(text: str) -> str:
    """A form that misread lines share with right ones."""
    text = "".join(text.lower().split())
    for a, b in (("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("ri", "n"), ("in", "m"), ("li", "h"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        text = text.replace(a, b)
    return text.translate(_FOLDS)


def _near(a: str, b: str) -> bool:
    """Whether two folded lines are the same but for a few characters."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 5 or a[:2] != b[:2] and a[-2:] != b[-2:] and a[2:5] != b[2:5]:
        return False
    row = list(range(len(b) + 1))
    most = max(1, len(a) // 8)
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


def _value(text: str) -> int:
    """The first number of a page number, Roman ones too."""
    found = re.search(r"[0-9lIoOSB]{1,4}", text)
    if found and re.search(r"[0-9]", text):
        return int(found.group().translate(str.maketrans("lIoOSB", "110058")))
    total, before = 0, 0
    for char in text.lower()[::-1]:
        one = {"i": 1, "v": 5, "x": 10, "l": 50}.get(char, 0)
        total += -one if one < before else one
        before = max(before, one)
    return total


class Decoder:
    """Finds and repairs the noise of scanned texts; one per worker."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.words, self.compounds, self.pairs, self.lines = (counts[k] for k in "wchl")
        self.total = sum(self.words.values()) + 1
        self.beside = self.pairs | counts.get("e", {})
        self.heading_least = max(4, sum(self.lines.values()) // 1000)
        recurring = counts.get("r", {})
        least = max(3, sum(recurring.values()) / 200)
        self.running = {_fold(phrase) for phrase, n in recurring.items() if n >= least and phrase[0] != "*"}
        self.houses = {phrase[1:] for phrase, n in recurring.items() if n >= least and phrase[0] == "*"}
        self.alike: dict[str, set[str]] = {}
        for group in LOOKALIKES:
            for char in group:
                self.alike.setdefault(char, set()).update(group.replace(char, ""))
        self.after: dict[str, dict[str, int]] = {}
        self.before: dict[str, dict[str, int]] = {}
        for pair, n in self.beside.items():
            self.after.setdefault(pair[0], {})[pair[1]] = n
            self.before.setdefault(pair[1], {})[pair[0]] = n
        self.most_after = {char: max(found.values()) for char, found in self.after.items()}
        self.most_before = {char: max(found.values()) for char, found in self.before.items()}
        self.fixed: dict[str, str | None] = {}
        self.called: dict[str, str] = {}  # cleared when it is full, which changes nothing
        self.common = frozenset(w for w, n in self.words.items() if n * 2e4 >= self.total)
        likely = [w for w, n in self.words.items() if n * 1e6 >= 3 * self.total]
        self.prefixes = {w[:k] for w in likely for k in range(1, len(w) + 1)}
        self.reads: dict[str, list[tuple[str, str]]] = {}
        for read, true in CONFUSIONS:
            self.reads.setdefault(read[0], []).append((read, true))

    # Furniture ------------------------------------------------------------------------------------------------------

    def _heading(self, text: str) -> bool:
        return self.lines.get(text.strip().lower(), 0) >= self.heading_least

    def _runs(self, text: str, folded: str) -> str:
        """The phrase of many bodies' running lines that a line holds, even misread; empty if it holds none."""
        pieces = _PIECES.split(text)
        for piece in pieces:
            f = folded if len(pieces) == 1 else _fold(piece)
            if f in self.running:
                return f
            last = piece.split()[-1:]
            if piece[:1].isupper() and " " in piece and last[0][0].isupper() and last[0].lower() in self.houses:
                return piece
            near = next((r for r in self.running if -3 < len(r) - len(f) < 3 and _near(f, r)), "") if len(f) > 4 else ""
            if near:
                return near
        return ""

    def furniture(self, lines: list[Line], title: str | None, broken: int) -> float:
        """Marks page furniture; returns how many page seams speak for a scanned text, one half for mere hints of it.

        ``broken``: other signs of a scan."""
        full = [line for line in lines if line.text.strip()]
        if not full:
            return 0
        last = len(full) - 1
        names = [_fold(title)] if title and len(title) > 3 else []
        bare: list[str] = []
        pages: dict[int, tuple[str, int]] = {}
        misread: set[int] = set()
        unfit: set[int] = set()
        for i, line in enumerate(full):
            text = line.text.strip()
            if PAGE.fullmatch(text):
                bare.append("")
                form = re.sub(r"[0-9lIoOSB]+|^[ivxlIVX]+$", "#", text)
                pages[i] = (form, _value(text))
                misread |= {i} if form == "#" and not text.isdigit() and re.search(r"[0-9]", text) else set()
                continue
            rest = _BESIDE.sub("", text) if text[0] in _DIGIT or text[-1] in _DIGIT else text
            bare.append(rest if (len(rest) >= 4 or "一" <= rest[:1] <= "鿿" and len(rest) > 1) and rest[-1] not in ".;,。；，:：" else "")
            if rest != text and bare[i]:
                pages[i] = ("beside", _value(text.replace(rest, "")))
        plain = [i for i in pages if pages[i][0] == "#"]
        for before, i, after in zip([None, *plain], plain, [*plain[1:], None]):
            value = pages[i][1]
            if i in misread and not (before is not None and 0 < value - pages[before][1] <= 2 or after is not None and 0 < pages[after][1] - value <= 2):
                unfit.add(i)  # a misread bare number is one only where it continues the count
        for i in unfit:
            del pages[i]
            bare[i] = full[i].text.strip() if len(full[i].text.strip()) == 4 else ""
        same = Counter(bare)
        if not pages and not broken and not names and len(same) - ("" in same) == len(full) - same[""]:
            return 0  # no number, no sign, no title and no line that recurs
        near = {j for i in pages for j in range(i - 2, i + 3)} | {0, 1, last - 1, last}
        widest = max(len(line.text) for line in full)
        # Without page numbers every line that is not full may be furniture, else lines at seams and those that recur.
        folded = [_fold(t) if t and (i in near or same[t] > 1 or not pages and len(t) < 0.8 * widest) else "" for i, t in enumerate(bare)]
        phrases = ["" if not f or self._heading(t) else self._runs(t, f) for f, t in zip(folded, bare)]

        def named(i: int) -> bool:
            """Whether a line is the title, perhaps with something beside it."""
            f = folded[i]
            return bool(f) and any(_near(f, n) or len(n) > 5 and n in f and len(f) < 3 * len(n) for n in names) and not self._heading(bare[i])

        told = [bool(phrase) or named(i) for i, phrase in enumerate(phrases)]
        likely = told.__getitem__
        if not pages and not broken and not any(told):
            return 0  # only such lines could speak for a scan
        around = lambda i: (j for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j <= last)
        exact = Counter(f for f, t in zip(folded, bare) if f and not self._heading(t))
        at_seam = {j for i in pages for j in around(i)} | {0, 1, last - 1, last} & set(range(last + 1))
        groups: list[list[int]] = []
        homes: dict[str, list[int]] = {}
        for i in sorted(i for i in range(last + 1) if folded[i] and exact[folded[i]] and (i in at_seam or i in pages or exact[folded[i]] > 1)):
            home = homes.get(folded[i]) or next((g for g in groups if _near(folded[g[0]], folded[i])), None)
            if home is None:
                home = []
                groups.append(home)
            home.append(i)
            homes[folded[i]] = home
        again = {i: len(g) for g in groups for i in g}
        for phrase, n in Counter(p for p in phrases if p).items():
            for i in (i for i in range(last + 1) if n > 1 and phrases[i] == phrase):
                again[i] = max(again.get(i, 0), n)
        by_form: dict[str, list[int]] = {}
        for i, (form, _) in pages.items():
            by_form.setdefault(form, []).append(i)
        seams = 0
        for form, at in by_form.items():
            values = [pages[i][1] for i in at]
            steps = [b - a for a, b in zip(values, values[1:])]
            apart = all(b - a > 2 for a, b in zip(at, at[1:]))  # a page holds some lines
            counting = bool(steps) and apart and sum(0 < x <= 2 for x in steps) * 2 >= len(steps)
            for i in at:
                helped = any(likely(j) or again.get(j, 0) > 1 for j in around(i) if j not in pages)
                counted_ = form not in ("#", "beside") or counting
                if form == "beside" and not (again.get(i, 0) > 1 or likely(i)):
                    continue
                if counted_ and (counting or helped or len(at) == 1) or helped and len(at) == 1 or form not in ("#", "beside") and broken:
                    full[i].furniture = True
                    seams += 1
        marked = {i for i in range(last + 1) if full[i].furniture}

        def cuts(i: int) -> bool:
            """Whether the line cuts a sentence: what stands before it, other furniture apart, does not end one."""
            before = next((full[j].text for j in range(i - 1, -1, -1) if j not in marked), "")
            return 0 < i < last and len(before) >= 0.6 * widest and bool(_OPEN(before))

        cutting, size = 0, -1
        while len(marked) > size:  # a header may stand beside a footer that only the header's page shows to be one
            size = len(marked)
            for i in range(last + 1) if marked or broken or again else ():
                if i in marked or not bare[i]:
                    continue
                beside = bool(marked) and (i in (0, last) or any(j in marked for j in around(i)))
                repeats = again.get(i, 0) > 1 and (told[i] or len(bare[i]) < 0.8 * widest or any(j in pages for j in around(i)))  # full lines recur by chance
                if (told[i] or repeats) and (beside or cuts(i)) or told[i] and repeats:
                    marked.add(i)
                    cutting += told[i] and bare[i][0].isalpha() and cuts(i)
        hinted = not cutting and any(i in (0, last) and phrases[i] or likely(i) and again.get(i, 0) > 1 for i in marked)
        if not cutting and last > 2 and phrases[last]:
            marked.add(last)
            hinted = True
        if not seams and not broken and not cutting and not hinted:
            for line in full:
                line.furniture = False
            return 0
        for i in marked:
            full[i].furniture = True
        kept = {folded[i] for i in range(last + 1) if full[i].furniture and folded[i]}
        for i, line in enumerate(full):
            if kept and not line.furniture and bare[i] and not self._heading(bare[i]) and any(_near(folded[i] or _fold(bare[i]), k) for k in kept):
                line.furniture = True
        return seams + cutting + 0.5 * hinted

    # Words ----------------------------------------------------------------------------------------------------------

    def fix(self, word: str) -> str | None:
        """The word that a misread word was, or None if it stands: some word that is far more frequent explains it."""
        low = word.lower()
        if low not in self.fixed:
            if len(self.fixed) > MEMORY:
                self.fixed.clear()
            self.fixed[low] = self._fix(low)
        return self.fixed[low]

    def _fix(self, low: str) -> str | None:
        """Walks the prefixes of the vocabulary along a word with up to two confusions.

        One confusion needs a word 25 times as frequent, two need 120 times; short words, which meet others by chance,
        need more.
        """
        if len(low) < 2 or low.isdigit():
            return None
        own = self.words.get(low, 0) + 1
        best: list[tuple[int, str] | None] = [None, None, None]
        walk = [(0, "", 0)]
        while walk:
            i, prefix, edits = walk.pop()
            if i == len(low):
                n = self.words.get(prefix, 0)
                least = (0, 25, 120)[edits] if len(low) > 4 else (0, 25, 3600)[edits] if len(low) == 4 else (0, 200, 6000)[edits]
                if edits and prefix != low and n * 1e6 >= 3 * self.total and n >= least * own and (best[edits] is None or (n, prefix) > best[edits]):
                    best[edits] = (n, prefix)
                continue
            if prefix + low[i] in self.prefixes:
                walk.append((i + 1, prefix + low[i], edits))
            if edits < 2:
                for read, true in self.reads.get(low[i], ()):
                    if prefix + true in self.prefixes and low.startswith(read, i):
                        walk.append((i + len(read), prefix + true, edits + 1))
        found = best[1] or best[2]
        return found[1] if found else None

    def known(self, word: str) -> int:
        return self.words.get(word.lower(), 0)

    def _name_fix(self, bit: str, names: Counter) -> str | None:
        """The name of the text that a rare capitalised word differs from in one letter, if it stands there often."""
        if len(bit) > 4 and bit[0].isupper() and names.get(bit, 0) <= 1 and self.known(bit) * 2e5 < self.total:
            for name, times in names.items():
                if times >= 3 and name != bit and len(name) == len(bit) and sum(a != b for a, b in zip(name, bit)) == 1 and self.known(name) > 3 * self.known(bit):
                    return name
        return None

    def _cost(self, word: str) -> float:
        """Nats that a word costs in the stream; an unknown one the more the longer it is."""
        n = self.words.get(word.lower(), 0)
        return -math.log(n / self.total) if n else math.log(self.total) + 3.0 + 0.3 * len(word)

    def _readings(self, bit: str, names: Counter) -> list[tuple[float, str]]:
        """What a token may be: itself, or the word or name that it is a misreading of."""
        if bit.isdigit() or bit.isupper() and 2 <= len(bit) <= 4:
            return [(0.0, bit)]
        if "ﬁ" in bit or "ﬂ" in bit:
            whole = bit.replace("ﬁ", "fi").replace("ﬂ", "fl")
            return [(self._cost(whole), whole)]
        own = (self._cost(bit), bit)
        fixed = self.fix(bit) or self._name_fix(bit, names)
        if fixed is None:
            return [own]
        right = fixed.capitalize() if bit[0].isupper() else fixed
        return [own, (min(self._cost(right) + 1.0, own[0] - 0.1), right)]

    # The lattice ----------------------------------------------------------------------------------------------------

    def _nodes(self, text: str) -> list[tuple[int, int, str, str]]:
        """The places where arcs start: (start, end, characters, what lies before the next one) of words and Chinese runs.

        Between words lies a ``blank``, a ``line`` end, a ``hyphen`` with a line end, or what keeps them ``apart``. Words of
        lines that hold nothing but common words can only stand as they are, and are left out.
        """
        nodes: list[tuple[int, int, str, str]] = []
        start = 0
        rows = text.split("\n")
        for at, row in enumerate(rows):
            if not self.common.issuperset(_PLAIN(row.lower())) or _broken(row) or at and _broken(rows[at - 1]):
                for match in _TOKEN(row):
                    nodes.append((start + match.start(), start + match.end(), match.group(), "apart"))
            start += len(row) + 1
        for k in range(len(nodes) - 1):
            first, end, bit, _ = nodes[k]
            between = text[end : nodes[k + 1][0]]
            if between == " ":
                nodes[k] = (first, end, bit, "blank")
            elif between.strip(" ") == "\n":
                nodes[k] = (first, end, bit, "line")
            elif between[:1] in _HYPHENS and between[1:].strip(" ") == "\n" and between.count("\n") == 1:
                nodes[k] = (first, end, bit, "hyphen" if _broken(text[text.rfind("\n", 0, end) + 1 : end + 1]) else "apart")
        runs = [(m.start(), m.end(), m.group(), "apart") for m in _HAN_RUN.finditer(text)]
        return sorted(nodes + runs) if runs else nodes

    def segment(self, text: str, names: Counter) -> list[tuple[int, int, str, str]]:
        """The cheapest path through the lattice over a stream: (start, end, kind, what stands there) of its changes.

        Lines are kept apart by line ends, which words and Chinese runs cross. An arc takes a word as it is or misread
        (``char``), as two words that lost their blank (``split``), or goes on over stray blanks and line ends
        (``merge``) and hyphens at line ends (``hyphen``; a broken word may be misread as well). In a Chinese run every
        character is an arc, and its state is the character that it is read as.
        """
        nodes = self._nodes(text)
        seen = self._seen(text, nodes)
        best: list[tuple[float, int, list]] = [(0.0, 0, [])] + [(math.inf, 0, [])] * len(nodes)

        def offer(end: int, cost: float, start: int, *changes: tuple[int, int, str, str]) -> None:
            if cost < best[end][0]:
                best[end] = (cost, start, list(changes))

        for i, (start, end, bit, glue) in enumerate(nodes):
            base = best[i][0]
            if "一" <= bit[0] <= "鿿":
                offer(i + 1, base, i, *self._likeliest(text, start, end, seen))
                continue
            if bit.lower() in self.common:
                offer(i + 1, base + self._cost(bit), i)
            else:
                for cost, word in self._readings(bit, names):
                    offer(i + 1, base + cost, i, *([(start, end, "char", word)] if word != bit else []))
                if not self.known(bit) and bit.isalpha():
                    for k in range(3, len(bit) - 2):
                        if bit[:k].lower() in self.common and bit[k:].lower() in self.common:
                            offer(i + 1, base + self._cost(bit[:k]) + self._cost(bit[k:]) + 6.0, i, (start, end, "split", bit[:k] + " " + bit[k:]))
            whole, price, kind, least, parts, j = bit, 0.0, "merge", self.known(bit), [bit], i
            while glue != "apart" and j + 1 < len(nodes):
                after = nodes[j + 1][2]
                if glue == "hyphen":
                    if not (after[:1].isalpha() and (j > i or self._hyphenated(text[text.rfind("\n", 0, end) + 1 : end], bit, after))):
                        break
                    kind = "hyphen"
                else:
                    price += 5.0 if glue == "blank" else 8.0
                whole, j = whole + after, j + 1
                parts.append(after)
                least = min(least, self.known(after))
                if kind == "hyphen" and j == i + 1:
                    apart = sum(min(self._cost(part), self._cost(part.lower())) for part in parts)
                    for cost, word in self._readings(whole, names):
                        offer(j + 1, base + min(cost, apart - 0.1), i, (start, nodes[j][1], "hyphen", word))
                elif self.known(whole) > 20 * max(1, least) and (min(map(len, parts)) > 1 or j > i + 1):
                    offer(j + 1, base + self._cost(whole) + price, i, (start, nodes[j][1], kind, whole))
                if whole.lower() not in self.prefixes:
                    break
                glue = nodes[j][3]
        changes, at = [], len(nodes)
        while at:
            _, before, found = best[at]
            changes += found[::-1]
            at = before
        return changes[::-1]

    # Chinese runs ---------------------------------------------------------------------------------------------------

    def _call(self, left: str, char: str, right: str) -> str:
        """The character that stands between these two ``STRANGE`` times as often as this one does, or nothing."""
        key = left + char + right
        if key not in self.called:
            if len(self.called) > MEMORY:
                self.called.clear()
            least = (self.beside.get(left + char, 0) + 0.5) * (self.beside.get(char + right, 0) + 0.5) * math.exp(STRANGE)
            best = (0, "")
            if self.most_after.get(left, 0) * self.most_before.get(right, 0) >= least:
                after, before = self.after[left], self.before[right]
                small, large = (after, before) if len(after) < len(before) else (before, after)
                for other, n in small.items():
                    found = n * large.get(other, 0)
                    if found >= least and other != char and "一" <= other <= "鿿" and (found, other) > best:
                        best = (found, other)
            self.called[key] = best[1]
        return self.called[key]

    def _seen(self, text: str, nodes: list[tuple[int, int, str, str]]) -> dict[str, set[str]]:
        """What the characters of a text are read as between the characters of its runs: may stand at edges too."""
        seen: dict[str, set[str]] = {}
        called = self.called
        for _, _, run, _ in nodes:
            if "一" <= run[0] <= "鿿":
                run = run.replace("\n", "")
                for at in range(1, len(run) - 1):
                    other = called.get(run[at - 1 : at + 2])
                    if other is None:
                        other = self._call(*run[at - 1 : at + 2])
                    if other:
                        seen.setdefault(run[at], set()).add(other)
        return seen

    def _likeliest(self, text: str, start: int, end: int, seen: dict[str, set[str]]) -> list[tuple[int, int, str, str]]:
        """The changes on the cheapest path through a Chinese run.

        Costs are those of pairs of neighbouring characters and of edges with what stands beside them. A character may be
        itself, one that looks like it or that the same text shows in its place, or, for more, one that its neighbours call
        for. Where there is no choice all paths go the same way, so only stretches with choices are searched.
        """
        run = text[start:end]
        head, tail = _edges(text, start, end)
        places = None
        if "\n" in run:
            places = [k for k in range(start, end) if text[k] != "\n"]
            run = run.replace("\n", "")
        alike, called = self.alike, self.called
        options: dict[int, list[tuple[str, float]]] = {}
        last = len(run) - 1
        for at, char in enumerate(run):
            others = alike.get(char)
            if others or char in seen:
                options[at] = [(char, 0.0), *((other, CHANGE) for other in sorted({*(others or ()), *seen.get(char, ())} - {char}))]
            if 0 < at < last:
                found = called.get(run[at - 1 : at + 2])
                if found is None:
                    found = self._call(run[at - 1], char, run[at + 1])
                if found and all(found != other for other, _ in options.get(at, ())):
                    options.setdefault(at, [(char, 0.0)]).append((found, STRANGE))
        changes = []
        get, log = self.beside.get, math.log

        def cheapest(states: dict[str, tuple[float, tuple]], follows: str) -> tuple[float, tuple]:
            least, way = math.inf, ()
            for before, (cost, path) in states.items():
                cost -= log(get(before + follows, 0) + 0.5)
                if cost < least:
                    least, way = cost, path
            return least, way

        begun: dict[str, tuple[float, tuple]] | None = None
        for at in sorted(options):
            if begun is None or at - 1 not in options:
                begun = {run[at - 1] if at else head: (0.0, ())}
            step: dict[str, tuple[float, tuple]] = {}
            for other, fee in options[at]:
                cost, path = cheapest(begun, other)
                step[other] = (cost + fee, (path, at, other) if fee else path)
            begun = step
            if at + 1 not in options:
                after = run[at + 1] if at < last else tail
                path = cheapest(begun, after)[1]
                found = []
                while path:
                    path, k, other = path
                    place = places[k] if places else start + k
                    found.append((place, place + 1, "char", other))
                changes += found[::-1]
        return changes

    # The whole text -------------------------------------------------------------------------------------------------

    def decode(self, body: str, first: int, title: str | None, repair: bool = True) -> tuple[list[tuple[int, str]], str] | None:
        """(line number, kind) of each noisy line, and the repaired text if asked for; None if the text was not scanned."""
        marked = sum(PLAINLY if m.group(1) else not PAGE.fullmatch(m.group().strip()) for m in _MARKDOWN(body))
        rows = [t.rstrip("\r") for t in body.split("\n")]
        stray = 0 if body.isascii() else len(_STRAY.findall(body))
        if stray:
            stray = sum(len(_STRAY.findall(row)) for row in rows if "  " not in row.strip() and "|" not in row)
        stray = stray if stray > 1 else 0
        if marked > stray + len(rows):
            return None  # more than its seams can be
        lines = [Line(first + i, row) for i, row in enumerate(rows)]
        broken, hyphens = 0, _BROKEN(body)
        for line, after in zip(lines, lines[1:]) if hyphens else ():
            cut_ = _broken(line.text)
            start = _LETTERS.match(after.text.strip()) if cut_ else None
            broken += bool(start and self.known(cut_.group(1) + start.group()))
        seams = self.furniture(lines, title, broken + stray)
        if marked > seams + broken + stray or not (seams or broken or stray or hyphens):
            return None
        text = [line for line in lines if not line.furniture and line.text.strip()]
        names = Counter(w for line in text for w in _WORD.findall(line.text) if w[0].isupper())
        rows = [_SPACED.sub("", line.text.strip()) for line in text]
        widest = max(map(len, rows), default=0)
        # A Chinese line that is not full ends there; the mark after it keeps its run apart from the next one.
        rows = [row + "\x1f" if "一" <= row[-1:] <= "鿿" and len(row) < 0.7 * widest else row for row in rows]
        stream = "\n".join(rows)
        changes = self.segment(stream, names)
        owner = [at for at, row in enumerate(rows) for _ in range(len(row) + 1)]
        joined = 0
        for start, end, kind, word in changes:
            at = owner[start]
            if kind == "hyphen":
                joined += 1
                text[at].kinds.add("hyphen")
                left = stream[start:end].split("\n")[0].rstrip("".join(_HYPHENS) + " ")
                whole = "".join(match.group() for match in _TOKEN(stream[start:end]))
                if word.lower() != whole.lower():
                    differs = next((k for k, (x, y) in enumerate(zip(whole.lower(), word.lower())) if x != y), len(word))
                    text[at if differs < len(left) else owner[end - 1]].kinds.add("char")
            elif kind == "char":
                text[at].kinds.add("char")
        if not seams and not joined and not stray:
            return None
        if seams < 1 and joined + stray + sum("char" in line.kinds for line in text) < 2:
            return None
        noise = [(line.number, "furniture") for line in lines if line.furniture]
        noise += [(line.number, kind) for line in text for kind in line.kinds]
        return sorted(noise), self._repaired(lines, text, stream, changes) if repair else ""

    def _hyphenated(self, before: str, left: str, right: str) -> bool:
        """Whether a hyphen at a line's end only breaks a word; a compound keeps its hyphen anyway."""
        if left.isupper() and len(left) <= 4 and right[:1].isdigit():
            return False
        joined, split = (left + right).lower(), f"{left}-{right}".lower()
        chain = re.search(r"[^\W\d_]+(?:-[^\W\d_]+)+\Z", before)
        if chain and f"{chain.group()}-{right}".lower() in self.compounds:
            return False
        compound, whole = self.compounds.get(split, 0), self.words.get(joined, 0)
        if compound or whole:
            return whole >= compound
        if self.fix(joined) is not None:
            return True
        if right[:1].isupper():
            return False
        return not (self.known(left) * 1e5 >= self.total and self.known(right) * 1e5 >= self.total and len(left) > 2)

    def _repaired(self, lines: list[Line], text: list[Line], stream: str, changes: list[tuple[int, int, str, str]]) -> str:
        """The text without furniture and line ends, words repaired, in paragraphs."""
        parts, at = [], 0
        for start, end, _, word in changes:
            ends = stream.count("\n", start, end)
            tail = re.match(r"[’'][^\W_]+|[.,;:!?)»”’]+", stream[end:]) if ends else None  # what belongs to the joined word
            parts += [stream[at:start], word, tail.group() if tail else "", "\n" * ends]
            at = end + (tail.end() if tail else 0)
        rows = [row.strip() for row in "".join([*parts, stream[at:]]).replace("\x1f", "").split("\n")]
        gaps = []
        position = {line.number: k for k, line in enumerate(text)}
        blank, seam = False, False
        for line in lines:
            if line.number in position:
                if position[line.number]:
                    gaps.append((blank, seam))
                blank = seam = False
            elif line.furniture:
                seam = True
            else:
                blank = True
        paragraphs = self._paragraphs(rows, gaps)
        return "\n\n".join(self._flow(rows[a:b]) for a, b in paragraphs)

    def _paragraphs(self, parts: list[str], gaps: list[tuple[bool, bool]]) -> list[tuple[int, int]]:
        """The cheapest segmentation of the lines: breaks belong at blank lines after sentences and beside headings.

        The state is whether the paragraph is still its first line: one line that ends no sentence is no paragraph unless
        it is a heading. Every gap is decided in the light of all others, at whatever distance.
        """
        n = len(parts)
        widest = max(map(len, parts), default=1) or 1
        ended = [re.search(r"[.!?。！？:：…”»)]\Z", p.strip()) is not None for p in parts]
        head = [self._heading(p) for p in parts]
        alone = [0.0 if head[i] or ended[i] else 0.8 for i in range(n)]
        paths: dict[bool, tuple[float, tuple]] = {True: (0.0, ())}
        for at in range(1, n):
            blank, seam = gaps[at - 1]
            beside = head[at - 1] or head[at]
            soft = ended[at - 1] and (blank or len(parts[at - 1]) < 0.7 * widest)
            apart = 0.4 + (0.2 if beside else 0.3 if soft and not seam else 1.5 if soft else 3.0 if blank and not seam else 5.0)
            together = 3.0 if beside else 2.0 if blank and ended[at - 1] and not seam else 1.0 if blank and not seam else 0.0
            fees = {state: cost + (alone[at - 1] if state else 0.0) for state, (cost, _) in paths.items()}
            state = min(fees, key=lambda s: (fees[s], s))
            longer = min(paths, key=lambda s: (paths[s][0], s))
            paths = {True: (fees[state] + apart, (paths[state][1], at)), False: (paths[longer][0] + together, paths[longer][1])}
        path = min(paths.items(), key=lambda x: (x[1][0] + (alone[-1] if x[0] and n else 0.0), x[0]))[1][1] if n else ()
        cuts = []
        while path:
            path, at = path
            cuts.append(at)
        bounds = [0, *cuts[::-1], n]
        return [(a, b) for a, b in zip(bounds, bounds[1:]) if b > a]

    @staticmethod
    def _flow(parts: list[str]) -> str:
        out = ""
        for part in parts:
            glue = "" if not out or not part or "一" <= out[-1] <= "鿿" or "一" <= part[0] <= "鿿" or out[-1] in "，。；：、" else " "
            out += glue + part
        return re.sub(r" {2,}", " ", out)


def _decoded(df: DataFrame, key: str, counts: dict[str, dict[str, int]], schema: str, rows_of, repair: bool) -> DataFrame:
    """Runs the decoder over all of ``df`` (``key, body, first, title``) and yields ``rows_of`` each result."""
    shared = df.sparkSession.sparkContext.broadcast(counts)
    names = [part.split()[0].strip("`") for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            rows = []
            for row_id, body, first, title in zip(*(c.to_pylist() for c in batch.columns)):
                result = decoder.decode(body, first, title, repair)
                if result is not None:
                    rows += rows_of(row_id, result)
            if rows:
                columns = list(zip(*rows))
                arrays = [pa.array(columns[0], batch.column(0).type), *(pa.array(c, pa.int32()) if isinstance(c[0], int) else pa.array(c, pa.string()) for c in columns[1:])]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return df.filter("body != ''").select(key, "body", "first", "title").mapInArrow(run, schema)


def noise(df: DataFrame, key: str, counts: dict[str, dict[str, int]]) -> DataFrame:
    """``key, line_no, kind`` of the noisy lines; ``df`` has ``key, body, first`` (number of the body's first line), ``title``."""
    kind = df.select(key).schema[0].dataType.simpleString()
    return _decoded(df, key, counts, f"`{key}` {kind}, line_no int, kind string", lambda i, r: [(i, line, k) for line, k in r[0]], False)


def repaired(df: DataFrame, key: str, counts: dict[str, dict[str, int]]) -> DataFrame:
    """``key, text``: the scanned texts as continuous paragraphs."""
    kind = df.select(key).schema[0].dataType.simpleString()
    return _decoded(df, key, counts, f"`{key}` {kind}, text string", lambda i, r: [(i, r[1])], True)
