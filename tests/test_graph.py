"""Greedy resolution and connected components against plain loops."""

import random

import pytest

from sedimenta.operators import components, dedup
from sedimenta.plans import extract as X


def fold(pairs, score):
    dead, out = set(), {}
    for i, j in sorted(set(pairs)):
        if i in dead or j in dead:
            continue
        loser, winner = (j, i) if score[i] >= score[j] else (i, j)
        dead.add(loser)
        out[loser] = winner
    return out


@pytest.mark.parametrize("seed,part", [(0, 10**6), (1, 10**6), (2, 10**6), (3, 10**6), (1, 30), (3, 0)])
def test_resolve_is_the_fold_in_order(spark, monkeypatch, seed, part):
    monkeypatch.setattr(dedup, "PART", part)  # larger parts are resolved in rounds
    rng = random.Random(seed)
    n = 60
    score = [rng.choice([rng.randint(0, 100), 50]) for _ in range(n)]
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range([20, 70, 200, 900][seed])}
    if seed == 1:
        pairs |= {(i, j) for i in range(20) for j in range(i + 1, 20)}
    df = spark.createDataFrame(sorted(pairs) + sorted(pairs)[:3], "id_a long, id_b long")
    scores = spark.createDataFrame(list(enumerate(score)), "id long, score int")
    assert {r.loser: r.winner for r in dedup.resolve(df, scores).collect()} == fold(pairs, score)


def test_resolve_examples(spark):
    scores = spark.createDataFrame([(1, 50), (2, 40), (3, 50), (4, None)], "id long, score int")
    chain = spark.createDataFrame([(1, 2), (2, 3)], "id_a long, id_b long")
    assert {r.loser: r.winner for r in dedup.resolve(chain, scores).collect()} == {2: 1}
    empty = dedup.resolve(chain.limit(0), scores)
    assert empty.count() == 0 and empty.columns == ["loser", "winner"]
    upset = spark.createDataFrame([(1, 2), (1, 3)], "id_a long, id_b long")
    high = spark.createDataFrame([(1, 50), (2, 60), (3, 10)], "id long, score int")
    assert {r.loser: r.winner for r in dedup.resolve(upset, high).collect()} == {1: 2}


@pytest.mark.parametrize("few", [10**6, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [tuple(rng.sample(range(100, 160), 2)) for _ in range(40)] + [(7, 7), (200, 201), (201, 200)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "id_a long, id_b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components.components(spark.createDataFrame([], "id_a long, id_b long")).count() == 0


def test_pipeline_statuses(spark):
    long = "# Architecture\n\n" + "The system design report describes the algorithm and the performance of the API. " * 20
    rows = [(1, long, "p/a_v1.md"), (2, long, "p/b.md"), (3, long + " More words follow here in this longer copy of it.", "p/a_v2.md"), (4, "short", "p/c.md"), (5, None, "p/d.md"), (6, "", None)]
    df = spark.createDataFrame(rows, "id long, text string, path string")
    done = {r.id: (r.status, r.similar_to) for r in X.extract(df, "id", "text", path="path", merge=True, use_simhash=True).collect()}
    assert done[1] == ("kept", None) and done[2] == ("duplicate", 1)
    assert len(done) == 6 and done[4][0] in ("low_score", "duplicate")
    all_alike = X.duplicates_tfidf(df.withColumn("score", df.id.cast("int")), "id", "text", 0)
    assert {r.id for r in all_alike.filter("status = 'kept'").collect()} == {6}
    assert X.extract(df.limit(0), "id", "text").count() == 0


def test_duplicates_of_small_blocks_are_those_of_one(spark, monkeypatch):
    from sedimenta.operators import tfidf

    base = [" ".join(f"{c}{d}word" for d in "abcdefgh") for c in "qrstuv"]
    rows = [(i, t, i % 7) for i, t in enumerate([*base, *(t + " extra" for t in base), *base])]
    df = spark.createDataFrame(rows, "id long, text string, score int")
    found = lambda: {r.id: r.similar_to for r in X.duplicates_tfidf(df, "id", "text", 0.8).collect()}
    want = found()
    assert sum(v is not None for v in want.values()) == 12
    monkeypatch.setattr(tfidf, "BLOCK", 2)
    assert found() == want


def test_extract_writes_no_texts_to_the_shared_folder(spark, monkeypatch):
    kept = []
    cut = X.cut
    monkeypatch.setattr(X, "cut", lambda frame: kept.append(frame.columns) or cut(frame))
    df = spark.createDataFrame([(1, "alpha beta gamma", "a.md"), (2, "alpha beta gamma", "b.md"), (3, None, "c.md")], "id long, text string, path string")
    for merge in (False, True):
        done = X.extract(df, "id", "text", path="path", merge=merge)
        assert {r.id: r.similar_to for r in done.collect()} == {1: None, 2: 1, 3: None} and {"text", "path"} <= {*done.columns}
    assert kept and not any("text" in columns for columns in kept)
