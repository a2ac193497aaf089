"""Quality factors, tokens, tags and version keys against values worked out by hand."""

import math
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import text as T
from sedimenta.operators import scoring, simhash, tagging, tfidf, versions


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_length(spark):
    texts = ["x" * n for n in (0, 1, 1999, 2000, 4000, 9000)]
    assert column(spark, texts, T.length_score) == pytest.approx([0, 0.05, 99.95, 100, 50, 50])
    assert column(spark, [None], T.length_score) == [0]


def test_structure(spark):
    full = "# a\n## b\n### c\n- item\n```\n|a|b|c|\n||\n[t](u)"
    cases = ["#\n\nfoo", full, "", "* x", "no", "|||||", "| | | |", "# a\r\n# b\r\n# c\r\n", " # a", None]
    assert column(spark, cases, T.structure_score) == [30, 90, 0, 15, 0, 15, 0, 40, 0, 0]


def test_freshness(spark):
    now = datetime(2026, 1, 1)
    ages = [30, 31, 180, 181, 365, 366, 10000]
    times = [now - timedelta(days=d) for d in ages] + [None]
    got = column(spark, times, lambda c: T.freshness_score(c, F.lit(now)), "timestamp")
    assert got == pytest.approx([100, 99.7, 55, 54.85, 27.25, 39.99, 10, 50])


def test_keywords(spark):
    assert column(spark, ["api API Api", "架构设计", "nothing", "", None], T.keyword_hits) == [3, 2, 0, 0, 0]
    assert column(spark, ["", "api", "x" * 1000 + "api"], T.keyword_score) == pytest.approx([0, 50, 1 / 1003 / 0.005 * 100])


def test_entropy(spark):
    texts = ["aabb", "", "😀a", "a" * 50, None, "x" * 100_000 + "y"]
    want = []
    for t in texts:
        n = Counter(t or "")
        want.append(None if t is None else -sum(c / len(t) * math.log2(c / len(t)) for c in n.values()) + 0.0)
    got = column(spark, texts, T.char_entropy)
    assert got[4] is None and [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None], abs=1e-9)


def test_score_ignores_other_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, None, 7, "x"), (2, "# a\n" * 600, 7, None)], "id int, text string, score int, length string")
    rows = {r.id: r for r in scoring.score(df, "text").collect()}
    assert rows[1].score == int(50 * 0.15) and rows[1].length == "x"
    assert rows[2].score_detail.structure == 40 and rows[2].score_detail.passed == (rows[2].score >= 30)
    assert scoring.score(df.limit(0), "text").count() == 0


def test_similarity_terms(spark):
    assert column(spark, ["Ab c-de 机器x学习", "", None, "一"], T.similarity_terms) == [["ab", "de", "机器", "器学", "学习"], [], [], []]


def test_tags(spark):
    rows = [(1, "架构设计", ""), (2, "架构 设计 API", ""), (3, "x", "test Test"), (4, "docker kubernetes Container", ""), (5, None, None), (6, "javascript", ""), (7, "plan design plan design api", "")]
    got = {r.i: r.tags for r in tagging.tag(spark.createDataFrame(rows, "i int, c string, t string"), "c", "t").collect()}
    assert got == {1: [], 2: ["architecture", "design", "api"], 3: ["testing"], 4: ["devops"], 5: [], 6: ["java", "frontend"], 7: ["planning", "design", "api"]}
    assert tagging.tag(spark.createDataFrame(rows, "i int, c string, t string"), "c", "t", 0).filter("size(tags) > 0").count() == 0


def test_version_keys(spark):
    names = ["a/report_v1.docx.md", "report_final.docx.md", "spec-v3-draft.md", "rel_1.2.3.md", ".hidden", "noext", None, "x_Version12_20240101.pdf"]
    assert column(spark, names, versions.version_key) == ["report.docx.md", "report.docx.md", "specdraft.md", "rel_.3.md", ".hidden.hidden", "noext.noext", None, "x.pdf"]


def test_merge_prefers_score_length_time_then_first(spark):
    rows = [(1, "a_v1.md", "x", 5, None), (2, "a_v2.md", "xx", 5, None), (3, "a_final.md", "xx", 5, None), (4, "b.md", None, None, None), (5, None, "x", 9, None)]
    df = spark.createDataFrame(rows, "id int, path string, content string, score int, at timestamp")
    got = {r.id: r.merged_into for r in versions.merge(df, "id", "path", "content", "at").collect()}
    assert got == {1: 2, 2: None, 3: 2, 4: None, 5: None}


def test_simhash_classes_and_bands(spark):
    df = spark.createDataFrame([(1, "1"), (2, "2"), (3, None), (4, "some words here"), (5, "some words here")], "id int, text string")
    prints = simhash.fingerprints(df, "id", "text")
    assert {r.rep_id: r.members for r in simhash.classes(prints, "id").collect()} == {1: 3, 4: 2}
    assert simhash.bands(prints, "id").count() == 20
    with pytest.raises(ValueError):
        simhash.bands(prints, "id", 8)


def test_bands_lose_no_pair(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = base + [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(3)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame(list(enumerate(signed)), "id long, fingerprint long")
    reps = {}
    for i, v in enumerate(values):
        reps.setdefault(v, i)
    want = {(min(i, j), max(i, j)) for v, i in reps.items() for w, j in reps.items() if i < j and (v ^ w).bit_count() <= 3}
    assert {(r.id_a, r.id_b) for r in simhash.similar_pairs(prints, "id").collect()} == want


def test_tfidf_two_documents_with_one_shared_term(spark):
    # unshared terms weigh nothing among two documents, so one shared term is all there is
    df = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "id int, text string")
    assert [(r.id_a, r.id_b, round(r.cosine, 9)) for r in tfidf.similar_pairs(df, "id", "text").collect()] == [(1, 2, 1.0)]


def test_tfidf_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    words = ["w" + a + b for a in "abcdefgh" for b in "abcd"]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(12)]
        texts += [" ".join(base), " ".join(base[:-1] + [rng.choice(words)]), " ".join(base[:-4] + [rng.choice(words) for _ in range(4)])]
    texts += ["", None, texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    counts = [Counter((t or "").split()) for t in texts]
    seen = Counter(w for c in counts for w in c)
    vectors = [{w: n / sum(c.values()) * math.log(len(texts) / (1 + seen[w])) for w, n in c.items()} for c in counts]
    norm = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    for threshold in (0.5, 0.85):
        reps = [i for i, t in enumerate(texts) if texts.index(t) == i]
        want = {(i, j) for i in reps for j in reps if i < j and norm[i] and norm[j]
                and sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()) / (norm[i] * norm[j]) >= threshold}
        assert {(r.id_a, r.id_b) for r in tfidf.similar_pairs(df, "id", "text", threshold).collect()} == want
    assert tfidf.copies(df, "id", "text").filter("id != rep_id").orderBy("id").collect()[-1].asDict() == {"id": len(texts) - 1, "rep_id": 0}


def _related(spark):
    import random

    rng = random.Random(11)
    words = ["v" + a + b for a in "abcdefghij" for b in "abcdefghij"]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(20)]
        texts += [" ".join(base), " ".join(base[:-1] + [rng.choice(words)]), " ".join(base[:-4] + [rng.choice(words) for _ in range(4)])]
    return spark.createDataFrame([(f"k{i:03}", t) for i, t in enumerate([*texts, "", None, texts[3], "alone"])], "id string, text string").repartition(3)


def test_tfidf_pairs_meet_in_blocks_without_a_shuffle_of_candidates(spark):
    pairs = tfidf.similar_pairs(_related(spark), "id", "text", 0.6)
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_tfidf_blocks_vocabulary_and_copies_leave_pairs_equal(spark, monkeypatch):
    rows = _related(spark)
    pairs = lambda: sorted((r.id_a, r.id_b, round(r.cosine, 9)) for r in tfidf.similar_pairs(rows, "id", "text", 0.6).collect())
    want = pairs()
    assert len(want) > 60 and all(a < b for a, b, _ in want)
    monkeypatch.setattr(tfidf, "BLOCK", 17)
    monkeypatch.setattr(tfidf, "AT_ONCE", 3)
    monkeypatch.setattr(tfidf, "FURTHER", 0.0)
    assert pairs() == want
    monkeypatch.setattr(tfidf, "VOCABULARY", 0)
    monkeypatch.setattr(tfidf, "BROADCAST_IDS", 0)
    assert pairs() == want
    assert tfidf.similar_pairs(rows.filter("1 = 0"), "id", "text").count() == 0
