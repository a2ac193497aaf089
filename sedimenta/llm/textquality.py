"""Problem 1: per-document text quality statistics, and an ordered rule list that tells prose from lists, tables and junk.

``lines`` gives every line its figures and ``statistics`` every document, in native Spark: one pass over the lines, one
aggregation by document with map-side partials. Which lines are sentences is decided by an ordered rule list over a line's
figures, induced by incremental reduced-error pruning (``induce``) and exported with its learned thresholds to a SQL CASE
expression (``case_sql``). A document is no prose if the greater part of its characters is outside of such lines, which is
how the problem defines it and not learned.

The tables hold no labels, so the lines of a bounded sample of documents (``SAMPLE``) are labelled by a slow grammar in
Python that judges whole paragraphs (``label_lines``) and would not be affordable on the whole corpus. ``python -m
sedimenta.llm.textquality DIRECTORY`` induces ``RULES`` anew and prints the errors on held-out documents.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The figures of a line that rules may test.
FEATURES = ["chars", "words", "mean_word_length", "symbol_share", "letter_share", "digit_share", "common_share", "han", "han_common_share", "ended", "marked", "cells"]
#: Documents of a training sample at most, and lines of them.
SAMPLE, SAMPLE_LINES = 6000, 24000

#: (conditions, class): the first rule whose conditions (feature, operator, threshold) all hold decides. Class 1: a sentence.
Rule = tuple[list[tuple[str, str, float]], int]


def lines(df: DataFrame, key: str, body: Column, common: Mapping[str, Sequence[str]]) -> DataFrame:
    """``key``, the text of each line and its ``FEATURES``, of each body that is not null and not blank.

    Headings, comments and blank lines have no row. ``common`` maps a language to its function words; Chinese words
    (language ``zh``) are searched anywhere, each by itself, the others as whole words of at least two letters.
    """
    latin = sorted({w for lang, ws in common.items() if lang != "zh" for w in ws if w and len(w) > 1})
    han = sorted({w for w in common.get("zh", []) if w}, key=lambda w: (-len(w), w))
    single, longer = "".join(w for w in han if len(w) == 1), [w for w in han if len(w) > 1]
    less = lambda column, other: F.length(column) - F.length(other)
    count = lambda column, mark: less(column, F.replace(column, F.lit(mark))) / len(mark)
    raw, bare, line = F.col("raw"), F.col("bare"), F.col("line")
    rows = df.select(key, body.alias("body")).filter(r"body RLIKE '\\S'").select(key, F.explode(F.split("body", "\n")).alias("raw"))
    # What has no row is told from the raw line, in one pattern: a filter on ``line`` would make each line several times.
    rows = rows.filter(~raw.rlike(r"\A *+(?:> ?)*+(?:[\r\t ]*+\z|<!--|#{1,6} (?![\r\t ]*+[\x85\x{2028}\x{2029}]?\z))"))
    loose = reduce(or_, (raw.endswith(end) for end in "\r\t \x85\u2028\u2029"))  # else nothing stands before the end
    rows = rows.select(key, F.trim(F.when(loose, F.regexp_replace(raw, r"[\r\t ]+$", "")).otherwise(raw)).alias("bare"))
    rows = rows.select(key, F.when(bare.startswith(">"), F.regexp_replace(bare, r"^(?:> ?)+", "")).otherwise(bare).alias("line"))
    # A line has no line end, which thus can mark matches. Words of any length become ``xx`` in ``short``: what stands
    # between them is what the other figures need, in a fraction of the characters. Lone letters never touch.
    rows = rows.select(
        key,
        "line",
        F.regexp_replace(line, r"\p{L}{2,}+", "xx").alias("short"),
        F.regexp_replace(F.concat(F.lit(" "), F.lower(line)), rf"\P{{L}}(?:{_trie(latin)})(?!\p{{L}})", "\n").alias("without"),
        F.when(F.octet_length(line) != F.length(line), F.length(F.regexp_replace(line, r"[^\x{4e00}-\x{9fff}]++", ""))).otherwise(0).alias("han"),
    )
    short = F.col("short")
    han_common = less(line, F.translate(line, single, "")) if single else F.lit(0)
    if longer:  # plain searches are several times faster than one pattern of all words
        # A function of arrays also keeps this projection out of the stage's one method, which would be too long to be compiled.
        found = lambda total, word: total + less(line, F.replace(line, word)) / F.length(word)
        han_common = han_common + F.aggregate(F.array(*map(F.lit, longer)), F.lit(0.0), found)
    rows = rows.select(
        "*",
        F.regexp_replace(F.replace(short, F.lit("xx")), r"\p{L}++", "").alias("other"),
        F.regexp_replace(short, r"\t|;(?! \p{L})| [|>»/] |\||(?<=\S),(?=\S)| {3,}|\.{4,}", "\n").alias("split"),
    )
    other = F.col("other")
    counts = rows.select(
        key,
        "line",
        (F.length(line) - less(other, F.replace(F.replace(other, F.lit(" ")), F.lit("\t")))).cast("double").alias("chars"),
        count(short, "xx").alias("words"),
        count(F.col("without"), "\n").cast("int").alias("common"),
        F.col("han").cast("double").alias("han"),
        F.when(F.col("han") > 0, han_common).otherwise(0).alias("han_common"),
        less(line, other).alias("letters"),
        less(other, F.regexp_replace(other, "[0-9]++", "")).alias("digits"),
        short.rlike(r"[.!?…。！？]['\"”»’)\]]*$").cast("double").alias("ended"),
        F.substring(line, 1, 12).rlike(r"^(?:[-*+•] |\d{1,3}[.)] |\d{1,2}\.\d{1,2} |\||\[[ x]\]|[0-9a-f]{8} |\d{4}-\d\d-\d\dT)").cast("double").alias("marked"),
        count(F.col("split"), "\n").alias("cells"),
    )
    per = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    c = F.col
    return counts.select(
        "*",
        per(c("letters") - c("han"), c("words")).alias("mean_word_length"),
        per(c("chars") - c("letters") - c("digits"), c("chars")).alias("symbol_share"),
        per(c("letters"), c("chars")).alias("letter_share"),
        per(c("digits"), c("chars")).alias("digit_share"),
        per(c("common"), c("words")).alias("common_share"),
        per(c("han_common"), c("han")).alias("han_common_share"),
    )


def statistics(df: DataFrame, key: str, body: Column, common: Mapping[str, Sequence[str]], rules: Sequence[Rule] | None = None) -> DataFrame:
    """``key`` and the statistics of each body that is not null and not blank, with ``no_prose`` (1 or 0).

    Shares are of characters that are not blank, in lines that are no headings or comments; a document of headings only
    has nulls in all shares and is prose.
    """
    measured = lines(df, key, body, common).withColumn("sentence", F.expr(case_sql(RULES if rules is None else rules)))
    share = lambda condition: F.sum(F.when(condition, F.col("chars")).otherwise(0.0))
    sums = measured.groupBy(key).agg(
        *(F.sum(name).cast("long").alias(name) for name in ("chars", "words", "han", "letters", "digits")),
        F.sum("common").alias("common"),
        F.sum("han_common").alias("han_common"),
        F.count("*").alias("lines"),
        share(F.col("sentence") == 1).alias("in_sentences"),
        share(F.col("ended") > 0).alias("in_ended"),
        share(F.col("marked") > 0).alias("in_marked"),
        share(F.col("cells") > 1).alias("in_cells"),
        share(F.col("chars") >= 40).alias("in_long"),
    )
    per = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return sums.select(
        key,
        "chars",
        "words",
        "lines",
        per("in_sentences", "chars").alias("sentence_share"),
        F.coalesce(per("common", "words"), F.lit(0.0)).alias("common_share"),
        F.coalesce(per("han_common", "han"), F.lit(0.0)).alias("han_common_share"),
        F.coalesce((F.col("letters") - F.col("han")) / F.nullif(F.col("words"), F.lit(0)), F.lit(0.0)).alias("mean_word_length"),
        ((F.col("chars") - F.col("letters") - F.col("digits")) / F.col("chars")).alias("symbol_share"),
        per("digits", "chars").alias("digit_share"),
        per("in_ended", "chars").alias("ended_share"),
        per("in_marked", "chars").alias("marked_share"),
        per("in_cells", "chars").alias("cell_share"),
        ((F.col("words") + F.col("han")) / F.col("lines")).alias("words_per_line"),
        per("in_long", "chars").alias("long_line_share"),
        (F.col("in_sentences") * 2 < F.col("chars")).cast("int").alias("no_prose"),
    )


def _trie(words: Sequence[str]) -> str:
    """A pattern of all words with shared beginnings written once, longer words first; matches nothing without words."""
    if not words:
        return r"\z\A"
    by_first: dict[str, list[str]] = {}
    for word in words:
        by_first.setdefault(word[0], []).append(word[1:])
    arms = []
    for first, rests in sorted(by_first.items()):
        more = [r for r in rests if r]
        tail = "" if not more else f"(?:{_trie(more)})" + ("?" if len(more) < len(rests) else "")
        arms.append(re.escape(first) + tail)
    return "|".join(arms)


def case_sql(rules: Sequence[Rule]) -> str:
    """The rule list as a SQL CASE expression: the class of the first rule that holds, else 0."""
    arms = [f"WHEN {' AND '.join(f'{name} {op} {value!r}D' for name, op, value in conditions)} THEN {verdict}" for conditions, verdict in rules if conditions]
    return f"CASE {' '.join(arms)} ELSE 0 END" if arms else "0"


# Induction -----------------------------------------------------------------------------------------------------------


def _covers(conditions: list[tuple[str, str, float]], row: Mapping[str, float]) -> bool:
    return all(row[name] < value if op == "<" else row[name] >= value for name, op, value in conditions)


def _grow(rows: list[tuple[Mapping[str, float], int, float]]) -> list[tuple[str, str, float]]:
    """Adds the condition of greatest information gain until no negative example is covered."""
    conditions: list[tuple[str, str, float]] = []
    covered = rows
    while any(not y for _, y, _ in covered) and len(conditions) < 6:
        p, n = sum(w for _, y, w in covered if y), sum(w for _, y, w in covered if not y)
        base = math.log2(p / (p + n)) if p else 0.0
        best = (0.0, None)
        for name in FEATURES:
            values = sorted((row[name], y, w) for row, y, w in covered)
            below_p = below_n = 0.0
            for (value, y, w), (following, _, _) in zip(values, values[1:]):
                below_p, below_n = below_p + w * y, below_n + w * (not y)
                if following == value:
                    continue
                cut = round((value + following) / 2, 4)
                for op, tp, tn in (("<", below_p, below_n), (">=", p - below_p, n - below_n)):
                    if tp > 1e-9:
                        gain = tp * (math.log2(tp / (tp + max(tn, 0.0))) - base)
                        if gain > best[0] + 1e-9:
                            best = (gain, (name, op, cut))
        if best[1] is None:
            break
        conditions.append(best[1])
        covered = [x for x in covered if _covers([best[1]], x[0])]
    return conditions


def induce(rows: list[tuple], seed: int = 1) -> list[Rule]:
    """Incremental reduced-error pruning: grow a rule on two thirds, prune its last conditions on the rest, keep it
    while it is right more often than not, take away what it covers, and go on.

    ``rows`` are (features, class) or (features, class, weight).
    """
    rng = random.Random(seed)
    left, rules = [(*row, 1.0)[:3] for row in rows], []
    while any(y for _, y, _ in left):
        rng.shuffle(left)
        at = 2 * len(left) // 3
        grown = _grow(left[:at])
        if not grown:
            break

        def worth(conditions: list[tuple[str, str, float]], test: list = left[at:]) -> float:
            hit = [(y, w) for row, y, w in test if _covers(conditions, row)]
            return sum(w if y else -w for y, w in hit) / sum(w for _, w in hit) if hit else -1.0

        best = max((grown[:k] for k in range(1, len(grown) + 1)), key=lambda c: (round(worth(c), 6), -len(c)))
        if worth(best) <= 0.5 or sum(y for row, y, _ in left if _covers(best, row)) < 3:
            break
        rules.append((best, 1))
        left = [x for x in left if not _covers(best, x[0])]
    return rules


# Labels --------------------------------------------------------------------------------------------------------------

_LIST = re.compile(r"\s*(?:[-*+•] |\d{1,3}[.)] |\d{1,2}\.\d{1,2}\s|\||\[[ x]\])")
_DUMP = re.compile(r"[0-9a-f]{8} |\d{4}-\d\d-\d\dT\d\d:|[!-~]{45,}\s*$|[\w.]+ = \S+$")
_SPLIT = re.compile(r"\t|;(?! \w)| [|>»/] |\||(?<=\S),(?=\S)| {3,}|\.{4,}")
_WORDS = re.compile(r"(?:(?![一-鿿])[^\W\d_]){2,}")
_HAN = re.compile(r"[一-鿿]")


def label_lines(body: str, common: Mapping[str, Sequence[str]]) -> list[tuple[str, int, int]]:
    """(line, its characters, 1 if it belongs to sentences) of every line that is no heading, comment or blank.

    Paragraphs are judged as wholes: their function words against all their words, after lines with list marks, cells,
    dumps or few letters were taken out.
    """
    latin = {w for lang, ws in common.items() if lang != "zh" for w in ws if len(w) > 1}
    han = re.compile("|".join(sorted(common.get("zh", ["$^"]), key=lambda w: (-len(w), w))) or "$^")
    out: list[tuple[str, int, int]] = []
    seen: Counter[str] = Counter()
    for paragraph in re.split(r"\n[ \t\r]*\n", body):
        kept: list[int] = []
        for raw in paragraph.split("\n"):
            line = re.sub(r"^(?:> ?)+", "", raw.strip())
            chars = len(re.sub(r"\s", "", line))
            if not chars or re.match(r"#{1,6} |<!--", line):
                continue
            out.append((line, chars, 0))
            letters = sum(c.isalpha() for c in line)
            seen[line] += 1
            if not (_LIST.match(raw) or _DUMP.match(line) or len(_SPLIT.findall(line)) >= 2 or letters < 0.55 * chars or seen[line] > 2):
                kept.append(len(out) - 1)
        text = " ".join(out[k][0] for k in kept)
        words, hans = _WORDS.findall(text.lower()), len(_HAN.findall(text))
        if hans > len(words):
            good = hans >= 6 and sum(len(w) for w in han.findall(text)) >= 0.08 * hans
        else:
            good = len(words) >= 4 and sum(w in latin for w in words) >= 0.24 * len(words) and len(set(words)) >= 0.2 * len(words) ** 0.75
        for k in kept if good else ():
            out[k] = (*out[k][:2], 1)
    return out


def label(body: str, common: Mapping[str, Sequence[str]]) -> int | None:
    """1 if most characters of the body are in something other than sentences; None for a body without lines to judge."""
    found = label_lines(body, common)
    return int(sum(n for _, n, y in found if y) * 2 < sum(n for _, n, _ in found)) if found else None


# Induced from the lines of the training sample at sf0.1; see ``main``.
RULES: list[Rule] = [
    ([("common_share", ">=", 0.239), ("ended", ">=", 0.5), ("words", ">=", 15.5)], 1),
    ([("letter_share", ">=", 0.7764), ("mean_word_length", "<", 5.6548), ("han_common_share", ">=", 0.0851), ("han", ">=", 27.5)], 1),
    ([("common_share", ">=", 0.1779), ("common_share", ">=", 0.2697), ("words", ">=", 6.5), ("letter_share", ">=", 0.9314), ("common_share", ">=", 0.3406), ("letter_share", ">=", 0.9618)], 1),
    ([("common_share", ">=", 0.1779), ("common_share", ">=", 0.2697), ("marked", "<", 0.5), ("mean_word_length", ">=", 4.7071), ("letter_share", "<", 0.9613), ("letter_share", ">=", 0.8774)], 1),
    ([("common_share", ">=", 0.1742), ("common_share", ">=", 0.2697), ("words", ">=", 6.5), ("cells", "<", 2.0), ("words", ">=", 11.5), ("chars", ">=", 56.5)], 1),
    ([("common_share", ">=", 0.1779), ("common_share", ">=", 0.2583), ("words", ">=", 4.5), ("cells", "<", 2.0), ("marked", "<", 0.5), ("common_share", ">=", 0.3485)], 1),
    ([("common_share", ">=", 0.1779), ("letter_share", ">=", 0.9534), ("common_share", ">=", 0.233), ("chars", ">=", 39.5)], 1),
    ([("han_common_share", ">=", 0.0426), ("symbol_share", "<", 0.1206), ("han", ">=", 16.5), ("symbol_share", ">=", 0.0328), ("chars", ">=", 26.5)], 1),
    ([("common_share", ">=", 0.0871), ("chars", "<", 65.5), ("words", ">=", 8.5), ("cells", "<", 0.5), ("marked", "<", 0.5), ("common_share", ">=", 0.2071)], 1),
    ([("common_share", ">=", 0.0955), ("chars", "<", 69.5), ("marked", "<", 0.5), ("cells", "<", 0.5), ("chars", ">=", 39.5), ("common_share", ">=", 0.1742)], 1),
    ([("han_common_share", ">=", 0.0465), ("symbol_share", "<", 0.1404), ("letter_share", ">=", 0.653), ("han", ">=", 12.5), ("han_common_share", ">=", 0.0931)], 1),
    ([("common_share", ">=", 0.075), ("chars", "<", 58.5), ("marked", "<", 0.5), ("ended", ">=", 0.5), ("chars", "<", 35.5)], 1),
    ([("common_share", ">=", 0.0801), ("chars", "<", 63.5), ("marked", "<", 0.5), ("cells", "<", 0.5), ("chars", ">=", 34.5), ("symbol_share", "<", 0.0412)], 1),
    ([("ended", ">=", 0.5), ("letter_share", "<", 0.9302), ("symbol_share", "<", 0.1319), ("chars", "<", 102.5), ("words", "<", 2.5), ("letter_share", ">=", 0.8844)], 1),
    ([("ended", ">=", 0.5), ("digit_share", ">=", 0.0659), ("letter_share", ">=", 0.5369), ("digit_share", ">=", 0.096), ("digit_share", ">=", 0.2071)], 1),
    ([("cells", "<", 0.5), ("marked", "<", 0.5), ("chars", "<", 49.5), ("han_common_share", ">=", 0.0347), ("letter_share", ">=", 0.5612), ("digit_share", ">=", 0.0785)], 1),
    ([("letter_share", ">=", 0.7945), ("common_share", ">=", 0.0871), ("mean_word_length", "<", 5.275), ("chars", "<", 111.0), ("common_share", "<", 0.2426), ("symbol_share", "<", 0.0421)], 1),
]


def train(spark, directory: str) -> tuple[list[Rule], dict[str, float]]:
    """The rule list of the labelled sample of ``directory``, and the shares of held-out lines and documents it gets wrong.

    Every fifth sampled document is held out. The sample is the first ``SAMPLE`` documents by hash of their key, and of its
    lines the first ``SAMPLE_LINES``; it is what comes to the driver, nothing else.
    """
    from sedimenta.functions.frontmatter import body
    from sedimenta.sources.tables import table

    words = table(spark, directory, "common_words").groupBy("lang").agg(F.collect_list("word").alias("ws")).collect()
    common = {r.lang: r.ws for r in words}
    mirror = table(spark, directory, "mirror_documents").select("file_id", body(F.col("content")).alias("body")).filter("body IS NOT NULL")
    sample = mirror.orderBy(F.xxhash64("file_id")).limit(SAMPLE)
    texts = {r.file_id: r.body for r in sample.collect()}
    labels = {(i, line): y for i, text in texts.items() for line, _, y in label_lines(text, common)}
    held = sorted(texts)[::5]
    figures = lines(sample, "file_id", F.col("body"), common)
    rows = [(r.asDict(), labels.get((r.file_id, r.line))) for r in figures.orderBy(F.xxhash64("file_id", "line")).limit(4 * SAMPLE_LINES).collect()]
    apart = set(held)
    rows = [(f, y) for f, y in rows if y is not None]
    rules = induce([(f, y, f["chars"]) for f, y in rows if f["file_id"] not in apart][:SAMPLE_LINES])
    test = [x for x in rows if x[0]["file_id"] in apart]
    verdict = lambda f: next((c for conditions, c in rules if _covers(conditions, f)), 0)
    wrong = sum(f["chars"] for f, y in test if verdict(f) != y) / max(1.0, sum(f["chars"] for f, _ in test))
    truth = {i: label(texts[i], common) for i in held}
    judged = {r.file_id: r.no_prose for r in statistics(sample.filter(F.col("file_id").isin(held)), "file_id", F.col("body"), common, rules).collect()}
    off = sorted(i for i in held if truth[i] is not None and judged.get(i, 0) != truth[i])
    return rules, {"lines": len(rows), "characters wrong": wrong, "documents": len(held), "documents wrong": len(off), "which": off}


def main(directory: str) -> None:
    """Induces a rule list from the labelled documents of ``directory`` and prints it with its held-out errors."""
    from sedimenta.session import local_session

    rules, figures = train(local_session(8), directory)
    print(figures)
    for rule in rules:
        print(f"    {rule!r},")


if __name__ == "__main__":
    import sys

    main(sys.argv[1])
