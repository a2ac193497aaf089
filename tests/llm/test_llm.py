"""The training-data operators against brute force, public tokenizers and round trips."""

import random
import re
from collections import Counter
from datetime import datetime
from math import comb

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedimenta.llm import bpe, forest, mojibake, neardup, packing, scanned, shingles, survivors, textquality

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def texts(seed, groups, copies):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [rng.choice(WORDS) + rng.choice("abcd") for _ in range(rng.randint(8, 40))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            out.append(" ".join(words))
    return out


def sets(text, width=3):
    words = shingles.FIND((text or "").lower())
    return set(zip(*(words[k:] for k in range(width))))


def similar(a, b, threshold=0.5):
    return bool(a or b) and len(a & b) >= threshold * len(a | b)


# Tokens --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.vocabulary_path()), special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.vocabulary())


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aabc  \n\t'1中文字测试。éü")), max_size=60))
def test_ids_equal_the_merge_loop(encoder, reference, text):
    assert np.frombuffer(encoder.encode([text])[0], np.int32).tolist() == reference(text)


def test_ids_of_odd_texts(spark, encoder, reference):
    odd = ["", None, "a" * 5000, " " * 300 + "x", "<|endoftext|> a", "日本語です。これは", "x" + "\n" * 99, "é‍🙂🙂", "中" * 3000]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(odd)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode_texts(df, "doc_id", "text").collect()}
    assert got == {i: None if t is None else reference(t) for i, t in enumerate(odd)}
    counts = {r.doc_id: r.n_tokens for r in bpe.encode_texts(df, "doc_id", "text", counts_only=True).collect()}
    assert counts == {i: None if t is None else len(reference(t)) for i, t in enumerate(odd)}
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_memory_bound_changes_nothing(encoder, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    small = bpe.Encoder(bpe.vocabulary())
    for text in texts(1, 4, 2) * 2:
        assert np.frombuffer(small.encode([text])[0], np.int32).tolist() == reference(text)


# Packing -------------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(sizes=st.lists(st.integers(0, 50), max_size=60))
def test_first_fit_decreasing(sizes):
    bins = packing.first_fit_decreasing(sizes, 50)
    free, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((k for k, f in enumerate(free) if f >= sizes[i]), None)
        if at is None:
            at = len(free)
            free.append(50)
        free[at] -= sizes[i]
        want[i] = at
    assert bins == [want[i] for i in range(len(sizes))]


def test_packing_keeps_items_whole(spark):
    sizes = [0, None, 3, 10, 10, 25, 7, 7, 7, 1] * 5
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n int")
    rows = packing.pack(df, len(sizes), [(1, 10), (2, 100), (3, None), (4, 0)], "doc_id", "n", group=20).collect()
    assert {r.container_id for r in rows} == {1, 2}
    for container, capacity in ((1, 10), (2, 100)):
        own = [r for r in rows if r.container_id == container]
        used, parts = Counter(), Counter()
        for r in own:
            if r.part_tokens is not None:
                used[r.group_no, r.bin_no] += r.part_tokens
                parts[r.doc_id] += r.part_tokens
        assert max(used.values()) <= capacity
        assert all(parts[i] == (s or 0) for i, s in enumerate(sizes))
        assert all(sum(r.doc_id == i for r in own) == max(1, -(-(s or 0) // capacity)) for i, s in enumerate(sizes))
        assert {r.doc_id for r in own if r.bin_no is None} == {i for i, s in enumerate(sizes) if s is None}
    assert packing.pack(df.limit(0), 0, [(1, 10)], "doc_id", "n").count() == 0


# Near-duplicates -----------------------------------------------------------------------------------------------------


def brute(rows, threshold=0.5):
    found = {i: sets(t) for i, t in rows}
    keys = sorted(found)
    return {(a, b) for k, a in enumerate(keys) for b in keys[k + 1 :] if similar(found[a], found[b], threshold)}


def frame(spark, rows):
    return spark.createDataFrame([("g", i, t) for i, t in rows], "src string, id long, text string")


def found_pairs(spark, rows):
    pairs, members = neardup.similar(frame(spark, rows), "src", 3, 0.5)
    return {(r.id_a, r.id_b) for r in neardup.expand(pairs, members, "src").collect()}


def test_pairs_equal_brute_force(spark):
    rows = list(enumerate(texts(3, 30, 6) + ["", None, "one two", "这是一个测试文本吗", "这是一个测试文本呢", "a b c", "a b c", "A, b! c?"]))
    assert found_pairs(spark, rows) == brute(rows)
    assert found_pairs(spark, rows[:0]) == set()


def test_a_large_group_of_copies_is_expanded_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "EXPAND", 3)
    members = spark.createDataFrame([("a", i, 0) for i in range(10)] + [("a", 20, 20), ("a", 21, 20), ("b", 0, 0)], "src string, id long, rep_id long")
    pairs = spark.createDataFrame([("a", 0, 20)], "src string, id_a long, id_b long")
    got = sorted(tuple(r) for r in neardup.expand(pairs, members, "src").collect())
    inside = [("a", i, j) for i in range(10) for j in range(i + 1, 10)] + [("a", 20, 21)]
    assert got == sorted(inside + [("a", i, j) for i in range(10) for j in (20, 21)])


def test_classes(spark):
    rows = list(enumerate(texts(8, 6, 4) + ["lone words stand here", "a b c", "a b c"]))
    pairs, members = neardup.similar(frame(spark, rows), "src", 3, 0.5)
    got = {r.id: r for r in neardup.classes(pairs, members, "src").collect()}
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(rows):
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert set(got) == {x for p in brute(rows) for x in p}
    assert all(r.class_id == root(i) for i, r in got.items())


def test_hot_runs_are_split_without_loss(spark, monkeypatch):
    rng = random.Random(2)
    base = [rng.choice(WORDS) + str(k) for k in range(60)]
    rows = []
    for i in range(220):
        words = list(base)
        words[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(words)))
    whole = found_pairs(spark, rows)
    monkeypatch.setattr(neardup, "HOT_RUN", 20)
    monkeypatch.setattr(neardup, "BLOCK", 40)
    monkeypatch.setattr(neardup, "ONE_IN", 1)
    assert found_pairs(spark, rows) == whole == brute(rows)


def test_signature_tree_finds_what_a_scan_finds():
    from sedimenta.llm.sigtree import SignatureTree, alike

    made = shingles.Shingler(3).many(texts(9, 40, 8))
    sizes = np.array([len(s) for s in made])
    sketches = shingles.signatures(made)[1]
    least = shingles.least_agreeing(0.5)
    i, j = np.triu_indices(len(made), 1)
    near = alike(sizes, sketches, i, j, 0.5, least)
    a, b = SignatureTree(sizes, sketches).pairs(0.5, least)
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())} == set(zip(i[near].tolist(), j[near].tolist()))


def refused(rows):
    kept, out = [], set()
    for _, i, text in sorted(rows, key=lambda r: (r[0], r[1])):
        own = sets(text)
        if own and any(similar(own, k) for k in kept):
            out.add(i)
        else:
            kept.append(own)
    return out


def test_joint_recall_at_the_threshold():
    depth, agree = neardup.depth_for(0.5), 0.5 + 0.5 / 16
    forest_keeps = 1 - (1 - 0.5**depth) ** shingles.TREES
    sketch_loses = sum(comb(shingles.LANES, k) * agree**k * (1 - agree) ** (shingles.LANES - k) for k in range(shingles.least_agreeing(0.5)))
    assert forest_keeps * (1 - sketch_loses) >= 0.994


def test_shingles_look_a_word_up_once_a_batch():
    class Counted(type(shingles.Shingler(3).known)):
        def __missing__(self, word):
            self[word] = made = len(self) + 1
            return made

        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    asked, shingler = [], shingles.Shingler(3)
    shingler.known = Counted({w: i for i, w in enumerate(WORDS)})
    assert len(shingler.many([" ".join(WORDS)] * 50)) == 50 and sorted(asked) == sorted(WORDS)


@given(st.lists(st.text("abX9_ -\t\x1c\xa0éßİſ一鿿ꀀ二²Ⅷ٣𝒳\ud800", max_size=30), max_size=8))
@settings(max_examples=60, deadline=None)
def test_shingles_are_those_of_the_words_found(batch):
    shingler = shingles.Shingler(2)
    whole = shingler.many(batch)
    one_by_one = shingles.Shingler(2)
    one_by_one._hashed = one_by_one._found
    assert [x.tolist() for x in whole] == [x.tolist() for x in one_by_one.many(batch)]
    assert [len(x) for x in whole] == [len(sets(t, 2)) for t in batch]


def test_pairs_are_compared_in_pieces(monkeypatch):
    from sedimenta.llm import sigtree

    made = shingles.Shingler(3).many(texts(9, 40, 8))
    _, sketches = shingles.signatures(made)
    sizes, run, least = np.array([len(s) for s in made], np.int32), np.repeat([1, 2, 3, 3], 80), shingles.least_agreeing(0.5)
    pairs = lambda: {(min(p), max(p)) for p in zip(*(x.tolist() for x in neardup._compare(run, sizes, sketches, 0.5, least)))}
    whole, asked, alike = pairs(), [], sigtree.alike

    def counted(sizes, sketches, i, j, *rest):
        asked.append(len(i))
        return alike(sizes, sketches, i, j, *rest)

    for module in (neardup, sigtree):
        monkeypatch.setattr(module, "alike", counted)
        monkeypatch.setattr(module, "AT_ONCE", 4096, raising=False)
    monkeypatch.setattr(neardup, "SHORT_RUN", 80)
    assert pairs() == whole and len(whole) > 100 and max(asked) <= 4096


@pytest.mark.parametrize("together", [[(1, 1), (2, 2), (3, 3), (4, 4)], [(1, 1), (2, 4)], [(1, 4)]])
def test_forest_accepts_batch_by_batch(spark, together):
    rng = random.Random(4)
    rows = [(rng.randint(1, 4), i, t) for i, t in enumerate(texts(5, 12, 6) + ["", "x", "a b c d", "a b c d"])]
    df = spark.createDataFrame(rows, "arrival int, id long, text string")
    index, got = forest.Forest(spark, 3, 0.5), set()
    for first, last in together:
        got |= {r.id for r in index.accept(df.filter(F.col("arrival").between(first, last)), df.select("id", "text")).collect()}
    assert got == refused(rows)


def shuffled(spark):
    """Rows that each stage so far has written to its shuffle, by stage."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    java = spark.sparkContext._jvm.java.util.ArrayList
    stages = context.statusStore().stageList(java(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), java())
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}


def test_the_trees_of_the_forest_take_turns_on_disk(spark):
    rows = [(k // 300 + 1, k, t) for k, t in enumerate(texts(6, 100, 6))]
    df = spark.createDataFrame(rows, "arrival int, id long, text string")
    before, index, got = shuffled(spark), forest.Forest(spark, 3, 0.5), set()
    for batch in (1, 2):
        got |= {r.id for r in index.accept(df.filter(F.col("arrival") == batch), df.select("id", "text")).collect()}
    most = max(n for stage, n in shuffled(spark).items() if stage not in before)
    assert got == refused(rows) and 0 < most <= len(rows) * shingles.TREES / 3


@pytest.mark.parametrize("hot", [False, True])
def test_passes_leave_candidates_equal(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(neardup, "HOT_RUN", 4)
        monkeypatch.setattr(neardup, "BLOCK", 3)
        monkeypatch.setattr(neardup, "ONE_IN", 1)
    signed = neardup.cut(neardup.sign(frame(spark, list(enumerate(texts(7, 10, 8)))), ["src", "id"], F.col("text"), 3))
    signed = signed.withColumn("fresh", F.col("id") % 3 == 0)
    once, *several = (sorted(map(tuple, neardup.candidates(signed, "src", "id", 0.5, "fresh", n).collect())) for n in (1, 4, 18))
    assert len(once) > 50 and several == [once, once]


def test_rounds_cover_all_batches():
    made = forest.rounds([(1, 100), *((k, 10) for k in range(2, 32))])
    assert made == [(1, 1), (2, 21), (22, 31)] and forest.rounds([]) == []


# Survivors -----------------------------------------------------------------------------------------------------------


def test_file_keys(spark):
    same = ["a/b/report.pdf.md", "A\\B\\Report_v2.pdf.MD", "./a//b/report - Copy.pdf.md", "a/b/Copy%20of%20report%20(3).pdf.md", "a/b/report_final_final.pdf.md", "a/b/report 2024-03-04.pdf.md",
            "a/b/report - 副本.pdf.md", "a/b/report_终稿.pdf.md", "a/b/draft report.pdf.md", "a/b/report_V6.7.pdf.md", "a/b/report_revc.pdf.md", "a/b/report_Entwurf.pdf.md", "a/b/report_20240304.pdf.md"]
    other = ["a/b/report_chapter_1.pdf.md", "a/b/report_chapter_2.pdf.md", "a/c/report.pdf.md", "a/b/report.docx.md", "a/b/v2.pdf.md", "a/b/report_0000001.pdf.md", "a/b/100%.pdf.md", None]
    rows = [(p, survivors_key) for p, survivors_key in [(p, None) for p in same + other]]
    df = spark.createDataFrame(rows, "path string, x string").select("path", survivors.file_key(F.col("path")).alias("k"))
    keys = {r.path: r.k for r in df.collect()}
    assert {keys[p] for p in same} == {"a/b/report.pdf.md"}
    rest = [keys[p] for p in other]
    assert len(set(rest)) == len(rest) and "a/b/report.pdf.md" not in rest and keys[None] is None


def test_suppliers_and_votes(spark):
    rows = [("k", 3, 5, True), ("k", 1, 5, True), ("k", 2, 9, False), ("l", 4, 1, True), (None, 5, 1, True), (None, 6, 1, True), ("m", 7, 1, False), ("m", 8, 2, False)]
    df = spark.createDataFrame(rows, "k string, id long, v long, ok boolean")
    long = survivors.unpivot(df, F.col("k"), F.col("id"), {"f": (F.col("v"), F.col("ok"), F.col("v"))})
    assert {tuple(r) for r in survivors.suppliers(long, ["f"]).collect()} == {(1, 1), (7, None)}
    voted = survivors.voted(survivors.unpivot(df, F.col("k"), F.col("id"), {"f": (F.col("v").cast("string"), F.col("ok"), F.lit(1.0))}))
    assert {r.group_key: r.value for r in voted.collect()} == {"k": "5", "l": "1"}
    assert survivors.pivot_back(voted, "group_key", "value", ["f", "g"]).filter("g IS NULL").count() == 2


def test_survivors_are_whole_records(spark, tmp_path):
    from sedimenta.llm import queries

    schema = "file_id long, path string, title string, content string, score int, doc_format string, origin string, modified_at timestamp, ingested_at timestamp"
    at = lambda day: datetime(2024, 1, day)
    rows = [(1, "a/b.md", "T", "one", 1, "pdf", "x", at(1), at(9)), (2, "A/B_v2.md", "T", " two\n\n", 2, "pdf", "y", at(1), at(9)), (3, "a/b - Copy.md", None, "one ", None, "pdf", "y", at(1), at(9)),
            (4, "a/b_v3.md", "U", "three", 3, "pdf", "z", at(1), at(9)), (5, "c.md", None, " ", None, None, None, None, at(9)), (6, "d.md", "D", None, 4, "md", "x", None, at(9)), (7, None, "N", "n", 4, "md", "x", None, at(9)),
            (8, "C_final.md", None, None, None, None, None, None, at(9)), (9, "d (2).md", "D", None, 4, "md", "x", None, at(9)), (10, "once.md", "O", "once", 4, "md", "x", None, at(9))]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/mirror_documents.parquet")
    spark.createDataFrame([("x", 2), ("y", 4), ("z", 2)], "origin string, trust_rank int").write.parquet(f"{tmp_path}/origins.parquet")
    got = {r.file_key: r for r in queries.p3_survivors(spark, str(tmp_path)).collect()}
    assert set(got) == {"a/b.md", "c.md", "d.md"}
    assert (got["a/b.md"].content, got["a/b.md"].path, got["a/b.md"].title) == ("one", "a/b.md", "T")
    assert (got["c.md"].content, got["c.md"].path, got["d.md"].content, got["d.md"].path) == (None, "c.md", None, "d.md")


# Wrong encodings -----------------------------------------------------------------------------------------------------

CLEAN = (
    "Die größere Prüfliste wurde für die Störungsmeldung geändert. Die Übersicht über die Qualität bleibt geöffnet. "
    "La qualité de la synthèse a été vérifiée à la clôture, l’étude reste détaillée et la règle n’a pas changé. "
    "由于索引增长超出预期，数据管理员决定翻译模板库。下一步是在所有工作区测量评分规则，并把驳回率进行对比。 "
    "Поскольку файл опоздал, копия будет отложена. Только временная метка остаётся в каждом отделе. "
)


@pytest.fixture(scope="module")
def restorer():
    counts = Counter()
    for token in mojibake._TOKENS(CLEAN * 400):
        counts.update(mojibake.words_of(token))
    return mojibake.Restorer(dict(counts))


@pytest.mark.parametrize("wrong,right", [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp437", "utf-8"), ("mac-roman", "utf-8"), ("cp1251", "utf-8"), ("gb18030", "utf-8")])
def test_round_trip(restorer, wrong, right):
    text = CLEAN.encode(right).decode(wrong, "replace")
    garbled, read, _ = restorer.restore(text)
    assert garbled > 5
    if "�" not in text:
        assert read == CLEAN
    else:
        assert sum(a == b for a, b in zip(read.split(), CLEAN.split())) > 0.5 * len(CLEAN.split())


def test_one_byte_encodings_and_lost_bytes(restorer):
    russian = "Поскольку файл опоздал, копия будет отложена."
    assert restorer.restore(russian.encode("koi8-r").decode("cp1251"))[1] == russian
    german = "Die größere Prüfliste wurde für die Störungsmeldung geändert."
    assert restorer.restore(german.encode("cp1252").decode("cp850"))[1] == german
    assert restorer.restore(german.encode("cp1252").decode("utf-8", "replace"))[1] == german


def test_clean_and_quoted_texts_are_no_cases(restorer):
    quoted = ["The test feeds the literal string `Ã¼` and expects `ü`.", "If you see “Ã©” where “é” should be", "Known issue: older viewers print â€™ instead of ’."]
    for text in [CLEAN, "", "plain", "é", *quoted]:
        assert restorer.restore(text)[0] == 0


def test_lattice_lets_all_fitting_characters_compete():
    lead = "中".encode()[:2]
    others = [c for c in map(chr, range(0x4E00, 0x4E40)) if c.encode()[:2] == lead and c != "中"]
    assert len(others) > 24
    model = {c + "的": 1000 for c in others} | {"国中": 5, "中心": 5, "心的": 5}
    channel = mojibake.Channel(model)
    data = [*"国".encode(), *lead, None, *"心".encode()]
    assert channel._viterbi(data, "utf-8") == "国中心"
    big5 = [*"國".encode("big5"), "中".encode("big5")[0], None, *"心".encode("big5")]
    assert mojibake.Channel({"國中": 5, "中心": 5})._viterbi(big5, "big5") == "國中心"


def test_restored_rows(spark, restorer):
    rows = [(1, CLEAN), (2, None), (3, ""), (4, CLEAN.encode().decode("cp1252", "ignore"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = mojibake.lexicon(mojibake.counted(spark.createDataFrame([(CLEAN,)] * 50, "text string"), F.col("text")))
    got = mojibake.restored(df, "doc_id", "text", model).collect()
    assert [r.doc_id for r in got] == [4]
    empty = mojibake.lexicon(mojibake.counted(df.limit(0), F.col("text")))
    assert empty == {} and mojibake.restored(df.limit(0), "doc_id", "text", empty).count() == 0


# Scanned pages -------------------------------------------------------------------------------------------------------


def scan():
    bodies = [
        "The nightly report lists every mirror folder and every missing\nimage of the week. The records office will trans-\nlate the customer portal in the week.",
        "The review of the long-\nterm archive is taken after the second audit, and every\nrnissing image of the customer portal is taken after",
        "the week. The records office lists the second portal, and the\nreview of every folder will trans-\nlate the nightly archive after the audit.",
    ]
    return "\n".join(f"Mirror Archive\n{body}\n- {n} -" for n, body in enumerate(bodies, 1))


@pytest.fixture(scope="module")
def model(spark):
    plain = "The nightly report lists every mirror folder and every missing image of the week. The records office will translate the customer portal, and the review of the long-term archive is taken after the second audit. " * 300
    df = spark.createDataFrame([(plain,), ("# Summary\n" * 50,), (None,), ("",)], "body string")
    return scanned.model(scanned.counted(df, F.col("body")))


def test_noise_of_a_scan(model):
    noise, text = scanned.Decoder(model).decode(scan(), 1, "Other")
    lines = scan().split("\n")
    kinds = {k: {n for n, kind in noise if kind == k} for k in ("furniture", "hyphen", "char")}
    assert kinds["furniture"] == {i for i, line in enumerate(lines, 1) if line == "Mirror Archive" or line.startswith("- ")}
    assert kinds["hyphen"] == {i for i, line in enumerate(lines, 1) if line.endswith("trans-")}
    assert kinds["char"] == {i for i, line in enumerate(lines, 1) if "rnissing" in line}
    assert "translate the customer portal" in text and "rnissing" not in text and "Mirror Archive" not in text and "- 1 -" not in text


def test_what_is_no_scan(model):
    decoder = scanned.Decoder(model)
    for text in ["", "# Title\n" + scan(), "1\n2\n3\nplain words", "just a line with a rnissing word", "\n".join(f"item {i}" for i in range(50))]:
        assert decoder.decode(text, 1, None) is None


def test_one_line_like_markdown_is_no_veto(model):
    for line, other in [("- 2 -", "- l2 -"), ("- 1 -", "- l -"), ("late the customer portal", "|ate the customer portal"), ("image of the week", "- image of the week")]:
        body = scan().replace(line, other)
        found = scanned.Decoder(model).decode(body, 1, "Other")
        assert body != scan() and found is not None
        assert sum(kind == "furniture" for _, kind in found[0]) == 6
    rows = "\n".join(f"| a | {i} |" for i in range(9))
    assert scanned.Decoder(model).decode(scan() + "\n" + rows, 1, "Other") is None


def test_misread_characters_at_the_edges_of_chinese_runs(spark):
    plain = "本章说明成本模型与知识库。评审时间超过8页，文件12页。人名入库，负责人在。" * 300
    counts = scanned.model(scanned.counted(spark.createDataFrame([(plain,)], "body string"), F.col("body")))
    decoder = scanned.Decoder(counts)
    for right, read in [("。本章说明", "。木章说明"), ("文件12页。", "文件12贞。"), ("知识库。评", "知识厍。评"), ("评审时间超", "评宙时问超"), ("文件12页。", "丈仵12贞。")]:
        changed = {start: word for start, _, _, word in decoder.segment(read, Counter())}
        assert "".join(changed.get(i, c) for i, c in enumerate(read)) == right
        assert set(changed) == {i for i, c in enumerate(read) if c != right[i]}
    assert decoder.segment(plain, Counter()) == []


def chinese(spark, footers=40):
    plain = "本章说明成本模型与知识库。评审时间超过8页，文件12页。人名入库，负责人在。发布经理认为链接检查在预发布环境中的积压量不应超过。"
    bodies = [(plain * 40,)] * 20 + [("内部资料\n" + plain + "\n内部资料\n" + plain,)] * footers
    return scanned.Decoder(scanned.model(scanned.counted(spark.createDataFrame(bodies, "body string"), F.col("body"))))


def test_chinese_scan_without_page_numbers(spark):
    lines = ["本章说明成 本模型与知识库。评审时间", "超过8页，文件12页。人名入库，负责人", "内部资料", "在。发市经理认为链接 检查在预发布环境", "中的积压量不应超过。本章说明成本模型", "内部资料", "与知 识库。评审时间超过8页，丈件12", "页。人名入库，负责人在。"]
    noise, text = chinese(spark).decode("\n".join(lines), 1, None)
    assert noise == [(3, "furniture"), (4, "char"), (6, "furniture"), (7, "char")]
    assert "负责人在。发布经理认为链接检查" in text and "内部资料" not in text and "文件12页" in text
    assert chinese(spark).decode("\n".join(lines[3:5]).replace(" ", ""), 1, None) is None  # slips outside scans are none


def test_furniture_has_no_length_limit(model):
    long = "Mirror Archive of every nightly report and every customer portal of the records office and of the second audit of the week"
    noise, _ = scanned.Decoder(model).decode(scan().replace("Mirror Archive", long), 1, None)
    assert sum(kind == "furniture" for _, kind in noise) == 6


def test_words_go_on_over_several_gaps_and_paragraphs_over_many_lines(model):
    decoder = scanned.Decoder(model)
    changes = decoder.segment("every mis sing image and the trans-\nlate of a cus to mer portal", Counter())
    assert [(kind, word) for _, _, kind, word in changes] == [("merge", "missing"), ("hyphen", "translate"), ("merge", "customer")]
    body = "\n".join("every missing image of the nightly report and of" for _ in range(900))
    assert decoder._paragraphs(body.split("\n"), [(False, False)] * 899) == [(0, 900)]
    assert decoder._paragraphs(["The audit is taken."] * 3, [(True, False)] * 2) == [(0, 1), (1, 2), (2, 3)] and decoder._paragraphs([], []) == []


def test_misread_bare_page_numbers_and_headers(model):
    numbered = lambda *numbers: "\n".join(numbers[int(line[2]) - 1] if line[:2] == "- " else line for line in scan().split("\n"))
    furniture = lambda body: {body.split("\n")[n - 1] for n, kind in scanned.Decoder(model).decode(body, 1, "Other")[0] if kind == "furniture"}
    assert furniture(numbered("14", "l5", "16")) == {"14", "l5", "16", "Mirror Archive"}
    assert furniture(numbered("14", "S9", "15")) == {"14", "15", "Mirror Archive"}
    far = "every image of the week\nthe nightly report of it\nMirror Arch1ve\nthe second audit of it\nthe portal of the archive\nthe week"
    assert furniture(scan().replace("\nimage of the week", "\n" + far + "\nimage of the week")) == {"- 1 -", "- 2 -", "- 3 -", "Mirror Archive", "Mirror Arch1ve"}


def test_noise_rows(spark, model):
    df = spark.createDataFrame([(1, scan(), 4, None), (2, None, 1, "x"), (3, "", 1, None)], "file_id long, body string, first int, title string")
    rows = scanned.noise(df, "file_id", model).collect()
    assert {r.file_id for r in rows} == {1} and min(r.line_no for r in rows) == 4
    assert scanned.repaired(df, "file_id", model).count() == 1 and scanned.noise(df.limit(0), "file_id", model).count() == 0


# Text quality --------------------------------------------------------------------------------------------------------

def test_words_without_chinese_characters():
    """The classes leave Chinese characters out by themselves and find what the look ahead before each character found."""
    rng = random.Random(5)
    text = "".join(rng.choice("abÉß1٣_-’' \n中文鿿一ﬁΣ²ⅷ") for _ in range(20000))
    letter, sign = r"(?:(?![一-鿿])[^\W\d_])", r"(?:(?![一-鿿])[^\W_])"
    slow = {"_WORD": rf"{sign}+(?:[’']{sign}+)*", "_TOKEN": rf"{sign}+", "_LETTERS": rf"{letter}+", "_PLAIN": rf"{sign}*(?:{letter}|[ﬁﬂ]){sign}*", "_COMPOUND": rf"{letter}{{2,}}(?:-{letter}{{2,}})+"}
    for name, pattern in slow.items():
        found = getattr(scanned, name)
        found = getattr(found, "__self__", found)
        assert found.findall(text) == re.findall(pattern, text) and "(?!" not in found.pattern


COMMON = {"en": ["the", "of", "and", "is", "to", "in", "a"], "zh": ["的", "在", "没有"]}


def test_statistics_and_rules(spark):
    rows = [(1, "The size of the report is known to the team and kept in the archive."), (2, "- alpha beta\n- gamma delta\n- epsilon"), (3, "a\tb\tc\n1\t2\t3"), (4, " \n"), (5, None), (6, "# Only"),
            (7, "在所有工作区没有变化，数据管理员决定翻译模板库的规则"), (8, "> The end of the line is broken and\n> goes on in the next line of the text")]
    df = spark.createDataFrame(rows, "file_id long, body string")
    got = {r.file_id: r for r in textquality.statistics(df, "file_id", F.col("body"), COMMON).collect()}
    assert {i: r.no_prose for i, r in got.items()} == {1: 0, 2: 1, 3: 1, 7: 0, 8: 0}
    assert got[1].sentence_share == 1 and got[2].marked_share == 1 and got[1].words == 15
    assert textquality.statistics(df.limit(0), "file_id", F.col("body"), {}).count() == 0


def test_line_figures(spark):
    """Each line is made once, its figures come from what stands between words; a letter of any plane is a letter beside a word."""
    odd = ["\U0001d49cof the of", "> > a;b; c,d | e...\t12 .\r", "# a heading", "> ## another", "#", "> \t", " <!-- x", "x \u2028", "可以 the 可", "The OF 'the' xx x"]
    figures = textquality.lines(spark.createDataFrame([(1, "\n".join(odd))], "file_id int, body string"), "file_id", F.col("body"), COMMON)
    got = [(r.line, r.chars, r.words, r.common, r.han, r.letters, r.digits, r.ended, r.cells) for r in figures.collect()]
    assert got == [
        ("\U0001d49cof the of", 8, 3, 2, 0, 8, 0, 0, 0),
        ("a;b; c,d | e...\t12 .", 15, 0, 0, 0, 5, 2, 1, 4),
        ("#", 1, 0, 0, 0, 0, 0, 0, 0),
        ("x\u2028", 2, 0, 0, 0, 1, 0, 0, 0),
        ("可以 the 可", 6, 2, 1, 3, 6, 0, 0, 0),
        ("The OF 'the' xx x", 13, 4, 3, 0, 11, 0, 0, 0),
    ]
    plan = figures._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"[\r\t ]+$") == 1 and "regexp_extract_all" not in plan


def test_induced_rules_hold_on_unseen_rows():
    rng = random.Random(0)

    def row():
        features = {name: rng.random() for name in textquality.FEATURES}
        return features, int(features["common_share"] < 0.4 or features["cells"] >= 0.8 and features["digit_share"] >= 0.5)

    rules = textquality.induce([row() for _ in range(800)])
    unseen = [row() for _ in range(500)]
    right = sum(int(any(textquality._covers(c, f) for c, _ in rules)) == y for f, y in unseen)
    assert right >= 0.93 * len(unseen) and "CASE WHEN" in textquality.case_sql(rules) and textquality.case_sql([]) == "0"


def test_rules_induced_from_labelled_lines_hold_on_held_out_documents(spark, tmp_path):
    rng = random.Random(5)
    nouns = "report archive team folder index author review portal glossary office".split()
    bodies = []
    for k in range(240):
        prose = [" ".join(f"The {rng.choice(nouns)} of the {rng.choice(nouns)} is known to a {rng.choice(nouns)} and kept in the {rng.choice(nouns)}." for _ in range(2)) for _ in range(6)]
        other = [["- " + rng.choice(nouns), "\t".join(rng.choices(nouns, k=4)), " | ".join(rng.choices(nouns, k=3)), f"{rng.getrandbits(90):x}", " ".join(rng.choices(nouns, k=12))][k % 5] for _ in range(40)]
        bodies.append("\n".join(prose + other[:3] if k % 2 else prose[:1] + other))
    spark.createDataFrame(list(enumerate(bodies)), "file_id long, content string").write.parquet(f"{tmp_path}/mirror_documents.parquet")
    spark.createDataFrame([(lang, w) for lang, ws in COMMON.items() for w in ws], "lang string, word string").write.parquet(f"{tmp_path}/common_words.parquet")
    rules, figures = textquality.train(spark, str(tmp_path))
    assert rules and figures["documents"] == 48 and figures["documents wrong"] <= 1 and figures["characters wrong"] < 0.05


def test_labels():
    assert textquality.label("The size of the report is known to the team.", COMMON) == 0
    assert textquality.label("- a list\n- of items\n- and more", COMMON) == 1
    assert textquality.label("\n \n", COMMON) is None
