"""DuckDB SQL of the registered queries, written apart from the Spark plans to check them."""

from __future__ import annotations

from sedimenta.functions.text import KEY_TERMS
from sedimenta.operators.tagging import PATTERNS, SYNONYMS
from sedimenta.operators.versions import MARKS
from sedimenta.sources.files import IMAGES, SUPPORTED

_S = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_AS_OF = "TIMESTAMPTZ '2026-06-01 00:00:00+00'"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LENGTH = "CASE WHEN least(length(t) / 2000.0::DOUBLE, 2::DOUBLE) <= 1 THEN least(length(t) / 2000.0::DOUBLE, 2::DOUBLE) * 100 ELSE 100::DOUBLE - (least(length(t) / 2000.0::DOUBLE, 2::DOUBLE) - 1) * 50 END"
_HEADS = f"len(regexp_extract_all(t, {_q('(?m)^#{1,6}' + _S + '+.+')}))"
_STRUCTURE = (
    f"least((CASE WHEN {_HEADS} >= 1 THEN 30 ELSE 0 END + CASE WHEN {_HEADS} >= 3 THEN 10 ELSE 0 END"
    f" + CASE WHEN regexp_matches(t, {_q('(?m)^' + _S + '*[-*]' + _S + '+.+')}) THEN 15 ELSE 0 END"
    f" + CASE WHEN regexp_matches(t, {_q('(?m)^```')}) THEN 10 ELSE 0 END"
    " + CASE WHEN length(t) - length(replace(t, '|', '')) > 4 THEN 15 ELSE 0 END"
    r" + CASE WHEN regexp_matches(t, '\[.+?\]\(.+?\)') THEN 10 ELSE 0 END)::DOUBLE, 100)"
)
_DAYS = f"floor(epoch_us({_AS_OF}) / 86400000000.0::DOUBLE - epoch_us(modified_at) / 86400000000.0::DOUBLE)"
_FRESH = (
    f"CASE WHEN modified_at IS NULL THEN 50::DOUBLE WHEN days <= 30 THEN 100::DOUBLE WHEN days <= 180 THEN 100::DOUBLE - (days - 30) * 0.3::DOUBLE"
    " WHEN days <= 365 THEN 55::DOUBLE - (days - 180) * 0.15::DOUBLE ELSE greatest(10::DOUBLE, 40::DOUBLE - (days - 365) * 0.01::DOUBLE) END"
)
_DAYS_EXACT = f"((epoch_us({_AS_OF}) - epoch_us(modified_at)) // 86400000000)"
_HITS = " + ".join(f"len(regexp_extract_all(t, {_q('(?i)' + k)}))" for k in KEY_TERMS)
_KEYWORDS = (
    "CASE WHEN length(t) = 0 THEN 0::DOUBLE WHEN hits / length(t)::DOUBLE < 0.005::DOUBLE THEN hits / length(t)::DOUBLE / 0.005::DOUBLE * 100"
    " WHEN hits / length(t)::DOUBLE <= 0.03::DOUBLE THEN 100::DOUBLE ELSE greatest(50::DOUBLE, 100::DOUBLE - (hits / length(t)::DOUBLE - 0.03::DOUBLE) * 2000) END"
)
_UNIQUE = "CASE WHEN length(t) = 0 THEN 0::DOUBLE WHEN h < 4 THEN 20::DOUBLE WHEN h < 8 THEN 50::DOUBLE ELSE least(100::DOUBLE, 70::DOUBLE + (h - 8) * 7.5::DOUBLE) END"


def _scored(source: str, key: str, text: str, fresh: str = "50::DOUBLE", more: str = "") -> str:
    """CTEs that end in ``scored`` with the five factors and the score."""
    return f"""
base AS (SELECT {key} AS id, coalesce({text}, '') AS t{more} FROM {source}),
chars AS (SELECT id, c, count(*) AS n FROM (SELECT id, unnest(string_split(t, '')) AS c FROM base WHERE t != '') GROUP BY id, c),
entropy AS (SELECT id, 0.0::DOUBLE - sum(n / total * log2(n / total)) AS h FROM (SELECT id, n::DOUBLE AS n, sum(n) OVER (PARTITION BY id)::DOUBLE AS total FROM chars) GROUP BY id),
factors AS (
  SELECT id, t, {_LENGTH} AS length, {_STRUCTURE} AS structure, {fresh} AS freshness, {_KEYWORDS} AS keywords, {_UNIQUE} AS uniqueness
  FROM (SELECT base.*, coalesce(h, 0) AS h, {_HITS} AS hits{", " + _DAYS_EXACT + " AS days" if more else ""} FROM base LEFT JOIN entropy USING (id))),
scored AS MATERIALIZED (
  SELECT *, trunc(length * 0.2::DOUBLE + structure * 0.25::DOUBLE + freshness * 0.15::DOUBLE + keywords * 0.2::DOUBLE + uniqueness * 0.2::DOUBLE)::INT AS score FROM factors)"""


_TERMS = """
base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
han AS (SELECT doc_id, regexp_replace(t, '[^一-鿿]', '', 'g') AS z FROM base),
tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(t), '[a-z]{2,}')) AS term FROM base
  UNION ALL SELECT doc_id, substr(z, i, 2) FROM (SELECT doc_id, z, unnest(range(1, length(z))) AS i FROM han WHERE length(z) >= 2)),
counts AS (SELECT doc_id, term, count(*) AS n FROM tokens GROUP BY ALL),
totals AS (SELECT doc_id, sum(n) AS total FROM counts GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY ALL),
weighted AS (
  SELECT doc_id, term, n, df, n / total::DOUBLE AS tf, ln((SELECT count(*) FROM documents) / (1 + df)::DOUBLE) AS idf
  FROM counts JOIN totals USING (doc_id) JOIN dfs USING (term)),
vectors AS (SELECT *, tf * idf AS w FROM weighted)"""
_COPIES = "copies AS (SELECT doc_id, CASE WHEN length(text) > 0 THEN min(doc_id) OVER (PARTITION BY text) ELSE doc_id END AS rep_id FROM documents)"
_PAIRS = f"""{_TERMS}, {_COPIES},
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM vectors GROUP BY ALL),
reps AS (SELECT v.doc_id, term, w FROM vectors v JOIN copies c ON v.doc_id = c.doc_id AND c.doc_id = c.rep_id WHERE w != 0),
dots AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, sum(a.w * b.w) AS dot FROM reps a JOIN reps b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS MATERIALIZED (SELECT id_a, id_b, dot / (na.norm * nb.norm) AS cosine FROM dots JOIN norms na ON na.doc_id = id_a JOIN norms nb ON nb.doc_id = id_b WHERE dot / (na.norm * nb.norm) >= 0.85 - 1e-9)"""
_PRINTS = """
tokens_ AS (SELECT doc_id, w, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[一-鿿]{2,}|[a-z]{2,}')) AS w FROM documents) GROUP BY ALL),
hashed AS (SELECT doc_id, times, ('0x' || right(md5(w), 16))::UBIGINT AS h FROM tokens_),
bits AS (SELECT doc_id, i, sum(CASE WHEN (h >> i::UBIGINT) & 1::UBIGINT = 1 THEN times ELSE -times END) > 0 AS one FROM hashed, (SELECT unnest(range(64)) AS i) GROUP BY ALL),
numbers AS (SELECT doc_id, sum(CASE WHEN NOT one THEN 0::HUGEINT WHEN i = 63 THEN -(2::HUGEINT ** 63)::HUGEINT ELSE (1::HUGEINT << i::HUGEINT) END) AS f FROM bits GROUP BY ALL),
prints AS (SELECT doc_id, coalesce(f, 0)::BIGINT AS fingerprint FROM documents LEFT JOIN numbers USING (doc_id))"""
_SIM_PAIRS = f"""{_PRINTS},
classes AS (SELECT fingerprint, min(doc_id) AS rep_id FROM prints GROUP BY ALL),
pairs AS MATERIALIZED (
  SELECT a.rep_id AS id_a, b.rep_id AS id_b, bit_count(xor(a.fingerprint, b.fingerprint)) AS distance
  FROM classes a JOIN classes b ON a.rep_id < b.rep_id AND bit_count(xor(a.fingerprint, b.fingerprint)) <= 3)"""


def _greedy(classes: str) -> str:
    """CTEs from ``pairs``, ``scored`` and a table of (doc_id, rep_id) to ``resolved``: a fold over pairs in order."""
    return f"""
ranked AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY id_a, id_b) AS rn, id_a, id_b, CASE WHEN a.score >= b.score THEN id_b ELSE id_a END AS loser, CASE WHEN a.score >= b.score THEN id_a ELSE id_b END AS winner
  FROM pairs JOIN scored a ON a.id = id_a JOIN scored b ON b.id = id_b),
fold(rn, dead, winners) AS (
  SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[]
  UNION ALL
  SELECT r.rn, CASE WHEN list_contains(dead, id_a) OR list_contains(dead, id_b) THEN dead ELSE list_append(dead, loser) END, CASE WHEN list_contains(dead, id_a) OR list_contains(dead, id_b) THEN winners ELSE list_append(winners, winner) END
  FROM fold JOIN ranked r ON r.rn = fold.rn + 1),
last_fold AS (SELECT dead, winners FROM fold ORDER BY rn DESC LIMIT 1),
fallen AS (SELECT dead[i] AS doc_id, winners[i] AS winner FROM (SELECT dead, winners, unnest(range(1, len(dead) + 1)) AS i FROM last_fold)),
resolved AS (
  SELECT c.doc_id, CASE WHEN c.rep_id != c.doc_id THEN c.rep_id ELSE f.winner END AS similar_to FROM {classes} c LEFT JOIN fallen f ON f.doc_id = c.doc_id)"""


_SYNONYMS = ", ".join(f"({_q(w)}, {_q(t)})" for w, t in SYNONYMS.items())


def _tags(source: str, key: str, text: str, title: str) -> str:
    """CTEs that end in ``tagged`` (id, tags)."""
    patterns = " UNION ALL ".join(f"SELECT id, {_q(tag)}, least(len(regexp_extract_all(t, {_q(p)})), 5), {(1 << 41) + i} FROM texts" for i, (p, tag) in enumerate(PATTERNS))
    return f"""
synonyms(word, tag) AS (VALUES {_SYNONYMS}),
texts AS (SELECT {key} AS id, coalesce({text}, '') AS t, coalesce({title}, '') AS title FROM {source}),
title_words AS (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT id, regexp_extract_all(lower(title), '[一-鿿]+|[a-z]+') AS l FROM texts)),
text_words AS (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT id, regexp_extract_all(lower(t), '[一-鿿]{{2,}}|[a-z]{{2,}}') AS l FROM texts)),
hits AS (
  SELECT id, tag, 3 AS points, i AS place FROM title_words JOIN synonyms ON word = l[i]
  UNION ALL SELECT id, tag, 1, {1 << 40} + i FROM text_words JOIN synonyms ON word = l[i]
  UNION ALL SELECT * FROM ({patterns}) p(id, tag, points, place) WHERE points > 0),
sums AS (SELECT id, tag, sum(points) AS points, min(place) AS place FROM hits GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY points DESC, place) AS rn FROM sums),
tagged AS (SELECT texts.id, coalesce(string_agg(tag, ',' ORDER BY rn), '') AS tags FROM texts LEFT JOIN placed ON placed.id = texts.id AND rn <= 5 GROUP BY texts.id)"""


_NAME = "split_part(path, '/', -1)"
_STEM = f"CASE WHEN contains({_NAME}, '.') AND length({_NAME}) - length(split_part({_NAME}, '.', -1)) > 1 THEN left({_NAME}, length({_NAME}) - length(split_part({_NAME}, '.', -1)) - 1) ELSE {_NAME} END"


def _version() -> str:
    stem = _STEM
    for mark in MARKS:
        stem = f"regexp_replace({stem}, {_q(mark)}, '', 'gi')"
    stem = rf"regexp_replace(regexp_replace({stem}, '[_\-]{{2,}}', '_', 'g'), '^[_\-]+|[_\-]+$', '', 'g')"
    return f"({stem} || '.' || CASE WHEN contains({_NAME}, '.') THEN split_part({_NAME}, '.', -1) ELSE {_NAME} END)"


_EXT = r"lower(regexp_extract(regexp_replace(path, '(?i)\.md$', ''), '[^/]\.([^./]*)$', 1))"
_CLASS = f"CASE WHEN {_EXT} IN ({', '.join(map(_q, SUPPORTED))}) THEN 'convert' WHEN {_EXT} IN ({', '.join(map(_q, IMAGES))}) THEN 'copy' ELSE 'skip' END"
_STRICT = r"'(?s)\A---\n(.*?)\n---\n'"
_FILE_STEM = rf"CASE WHEN regexp_matches({_NAME}, '.\.[^.]*$') THEN regexp_replace({_NAME}, '\.[^.]*$', '') ELSE {_NAME} END"


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    own = "CASE WHEN score IS NULL THEN 'error' WHEN score < 40 THEN 'skipped' ELSE 'converted' END"
    rendered = rf"""
SELECT file_id, md5(concat_ws(chr(10), '---', 'title: "' || ti || '"', 'source: "file:///' || path || '"', CASE WHEN path != '' THEN 'source_relative: "' || path || '"' END,
  'converted_at: "' || strftime(ingested_at AT TIME ZONE 'UTC', '%Y-%m-%d') || '"', 'original_format: "' || doc_format || '"', 'conversion_status: "' || st || '"',
  CASE WHEN score IS NOT NULL THEN 'file_size: "' || score || '"' END, 'origin: "' || origin || '"', '---',
  CASE st WHEN 'skipped' THEN '# ' || ti || chr(10) || chr(10) || '> ⚠️ 此文件类型为 `.' || doc_format || '`，暂不支持转换。' || chr(10) || '> [打开源文件](file:///' || path || ')'
    WHEN 'error' THEN '# ' || ti || chr(10) || chr(10) || '> ❌ 转换失败。' ELSE '' END)) AS rendered
FROM (SELECT *, coalesce(title, '') AS ti, {own} AS st FROM mirror_documents)"""
    vault = rf"""
SELECT 'sedimenta/' || path AS relative, md5(CASE WHEN regexp_matches(content, {_STRICT})
  THEN '---' || chr(10) || m || CASE WHEN regexp_matches(m, '(?m)^tags:') THEN '' ELSE chr(10) || 'tags: []' END || CASE WHEN regexp_matches(m, '(?m)^created:') THEN '' ELSE chr(10) || 'created: "2026-06-01"' END
    || chr(10) || '---' || chr(10) || chr(10) || regexp_replace(content, {_STRICT}, '')
  ELSE '---' || chr(10) || 'title: "' || ({_FILE_STEM}) || '"' || chr(10) || 'created: "2026-06-01"' || chr(10) || 'tags: []' || chr(10) || '---' || chr(10) || chr(10) || content END) AS content_md5
FROM (SELECT *, regexp_extract(content, {_STRICT}, 1) AS m FROM mirror_documents WHERE content IS NOT NULL)"""
    parsed = rf"""
SELECT file_id, coalesce(nullif(regexp_extract(m, '(?m)^title: "(.*)"$', 1), ''), {_FILE_STEM}) AS title, nullif(regexp_extract(content, '(?m)^source: "file:///(.+)"$', 1), '') AS source,
  length(regexp_replace(regexp_replace(content, {_STRICT}, ''), '\A{_S}+|{_S}+\z', '', 'g')) AS body_chars
FROM (SELECT *, regexp_extract(content, {_STRICT}, 1) AS m FROM mirror_documents)"""
    prefix = "repeat('../', length(path) - length(replace(path, '/', '')) + 1) || 'mirror/' || regexp_extract(path, '^(.*/)?')"
    ref = r"!\[.*?\]\(([^)]+)\)"
    links = rf"""
SELECT file_id, len(list_filter(regexp_extract_all(t, '{ref}', 1), lambda x: NOT regexp_matches(x, '^https?://'))) AS local_references, length(regexp_replace(t, '!\[.*?\]\([^)]+\)', '', 'g')) AS stripped_chars,
  md5(replace(replace(replace(regexp_replace(replace(replace(replace(t, '](http://', chr(1)), '](https://', chr(2)), '](../', chr(3)), '!\[([^\]' || chr(1) || chr(2) || chr(3) || ']*)\]\(([^)]+)\)', '![\1](' || {prefix} || '\2)', 'g'), chr(1), '](http://'), chr(2), '](https://'), chr(3), '](../')) AS rebased
FROM (SELECT file_id, path, coalesce(content, '') AS t FROM mirror_documents)"""
    name_json = "CASE WHEN json_valid(tags) THEN CASE WHEN json_type(tags) = 'ARRAY' THEN CAST(tags AS JSON) END END"
    tag_rows = f"SELECT DISTINCT id, x ->> '$' AS tag FROM (SELECT id, unnest(CAST({name_json} AS JSON[])) AS x FROM notes) WHERE x ->> '$' IS NOT NULL AND x ->> '$' != ''"
    real = "SELECT DISTINCT source_note_id AS s, target_note_id AS t FROM note_links WHERE source_note_id != target_note_id"
    nl = "chr(10)"
    anchor = lambda n: f"'<!-- Slide number: {n} -->' || {nl} || {nl}"
    bare = f"regexp_replace(coalesce(title, ''), '\\A{_S}+|{_S}+\\z', '', 'g')"
    page_one = f"{anchor(1)} || '📊 **T**（S）' || {nl} || {nl} || '**概述**：O' || {nl} || {nl} || 'B' || CASE WHEN {bare} = '' THEN '' ELSE {nl} || {nl} || '<details><summary>markitdown 原文（兜底参考）</summary>' || {nl} || {bare} || {nl} || '</details>' END"
    page_two = f"regexp_replace({anchor(2)} || coalesce(doc_format, ''), '{_S}+\\z', '') || {nl} || {nl} || '> 📊 **整页理解**: ⚠️ 本页图表语义识别失败（VLM 请求异常），原始文字已保留'"
    ref_all = r"list_filter(regexp_extract_all(t, '!\[.*?\]\([^)]+\)', 0), lambda x: NOT regexp_matches(x, '^!\[.*?\]\(https?://'))"
    swap = lambda text, old, new: f"CASE WHEN {old} IS NULL OR strpos({text}, {old}) = 0 THEN {text} ELSE left({text}, strpos({text}, {old}) - 1) || {new} || substr({text}, strpos({text}, {old}) + length({old})) END"
    mirrored = f"docs AS (SELECT file_id AS doc_id, content AS text, path, modified_at FROM mirror_documents), {_SIM_PAIRS.replace('FROM documents', 'FROM docs')}, {_scored('mirror_documents', 'file_id', 'content', _FRESH, ', modified_at')}, members AS (SELECT doc_id, rep_id FROM prints JOIN classes USING (fingerprint)), {_greedy('members')}"
    stamp = lambda c: f"coalesce(try_cast(replace({c}, 'T', ' ') AS TIMESTAMPTZ), NULL)"
    return {
        "score_length": f"SELECT doc_id, round({_LENGTH}, 6) AS length_score FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
        "score_structure": f"SELECT doc_id, {_STRUCTURE} AS structure_score FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
        "score_freshness": f"SELECT file_id, round({_FRESH}, 6) AS freshness_score FROM (SELECT *, {_DAYS_EXACT} AS days FROM mirror_documents)",
        "keyword_hits": f"SELECT doc_id, hits, round({_KEYWORDS}, 6) AS keyword_score FROM (SELECT *, {_HITS} AS hits FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))",
        "char_entropy": f"WITH {_scored('documents', 'doc_id', 'text')} SELECT doc_id, round(CASE WHEN text IS NULL THEN NULL ELSE coalesce(h, 0) END, 6) AS entropy, round(uniqueness, 6) AS uniqueness_score FROM documents LEFT JOIN entropy ON entropy.id = doc_id JOIN scored ON scored.id = doc_id",
        "value_score": f"WITH {_scored('documents', 'doc_id', 'text')} SELECT id AS doc_id, score, round(length, 6) AS length, round(structure, 6) AS structure, round(freshness, 6) AS freshness, round(keywords, 6) AS keywords, round(uniqueness, 6) AS uniqueness, score >= 30 AS passed FROM scored",
        "value_score_passed": f"WITH {_scored('documents', 'doc_id', 'text')} SELECT lang, count(*) AS documents, max(score) AS best FROM scored JOIN documents ON doc_id = id WHERE score >= 30 GROUP BY lang",
        "mirror_score": f"WITH {_scored('mirror_documents', 'file_id', 'content', _FRESH, ', modified_at')} SELECT id AS file_id, score AS value_score FROM scored",
        "term_frequency": f"WITH {_TERMS} SELECT doc_id, term, n, round(tf, 9) AS tf FROM weighted",
        "document_frequency": f"WITH {_TERMS} SELECT term, df, round(ln((SELECT count(*) FROM documents) / (1 + df)::DOUBLE), 9) AS idf FROM dfs",
        "tfidf_norms": f"WITH {_TERMS} SELECT doc_id, round(sqrt(sum(w * w)), 6) AS norm FROM vectors GROUP BY doc_id",
        "tfidf_top_terms": f"WITH {_TERMS} SELECT doc_id, rank, term, n, round(w, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term) AS rank FROM vectors) WHERE rank <= 3",
        "tfidf_similar_pairs": f"WITH {_PAIRS} SELECT id_a, id_b, round(cosine, 6) AS cosine FROM pairs",
        "tfidf_classes": f"WITH {_COPIES} SELECT doc_id, rep_id FROM copies",
        "tfidf_dedup": f"WITH RECURSIVE {_PAIRS}, {_scored('documents', 'doc_id', 'text').replace('base AS', 'base_ AS').replace('FROM base ', 'FROM base_ ').replace('base.*', 'base_.*')}, {_greedy('copies')} SELECT doc_id, CASE WHEN similar_to IS NULL THEN 'kept' ELSE 'duplicate' END AS status, similar_to FROM resolved",
        "simhash_fingerprint": f"WITH {_PRINTS} SELECT doc_id, fingerprint FROM prints",
        "simhash_bands": f"WITH {_PRINTS} SELECT doc_id, band::INT AS band, ((fingerprint & (65535::BIGINT << (16 * least(band, 2))::BIGINT)) >> (16 * band)::BIGINT) AS band_key FROM prints, (SELECT unnest(range(3)) AS band) UNION ALL SELECT doc_id, 3, ((fingerprint >> 48::BIGINT) & 65535::BIGINT) FROM prints",
        "simhash_similar_pairs": f"WITH {_SIM_PAIRS} SELECT id_a, id_b, distance FROM pairs",
        "simhash_dedup": f"WITH RECURSIVE {_SIM_PAIRS}, {_scored('documents', 'doc_id', 'text')}, members AS (SELECT doc_id, rep_id FROM prints JOIN classes USING (fingerprint)), {_greedy('members')} SELECT doc_id, CASE WHEN similar_to IS NULL THEN 'kept' ELSE 'duplicate' END AS status, similar_to FROM resolved",
        "similarity_components": f"WITH RECURSIVE {_SIM_PAIRS}, sides AS (SELECT id_a AS u, id_b AS v FROM pairs UNION SELECT id_b, id_a FROM pairs), reach AS (SELECT DISTINCT u, u AS c FROM sides UNION SELECT sides.v, reach.c FROM reach JOIN sides ON sides.u = reach.u) SELECT u AS id, min(c) AS component FROM reach GROUP BY u",
        "auto_tags": f"WITH {_tags('mirror_documents', 'file_id', 'content', 'title')} SELECT id AS file_id, tags FROM tagged",
        "version_key": f"SELECT file_id, {_version()} AS version_key FROM mirror_documents",
        "version_merge": f"SELECT file_id, version_key, nullif(best, file_id) AS merged_into FROM (SELECT file_id, version_key, first_value(file_id) OVER (PARTITION BY version_key ORDER BY coalesce(score, 0) DESC, length(coalesce(content, '')) DESC, coalesce(epoch_us(modified_at), 0) DESC, file_id) AS best FROM (SELECT *, {_version()} AS version_key FROM mirror_documents))",
        "extension_classify": f"SELECT file_id, {_EXT} AS extension, {_CLASS} AS class FROM mirror_documents",
        "format_filter": f"SELECT {_EXT} AS extension, count(*) AS files FROM mirror_documents WHERE {_EXT} IN ('pdf', 'docx') GROUP BY 1",
        "frontmatter_parse": parsed,
        "frontmatter_render": rendered,
        "vault_frontmatter": vault,
        "image_references": links,
        "slide_anchors": f"SELECT file_id, '2' AS failed_pages, md5({page_one} || {nl} || {page_two} || {nl} || {anchor(3)} || coalesce(path, '')) AS injected FROM mirror_documents",
        "slide_layouts": f"SELECT file_id, md5({anchor(1)} || coalesce(title, '') || {nl} || {nl} || '<!-- Slide number: 2 -->' || {nl} || '> 🗂 **版式**: 标题(整页宽) · ' || coalesce(origin, '-') || {nl} || {nl} || coalesce(doc_format, '') || {nl} || {nl} || {anchor(3)} || coalesce(path, '')) AS with_layout FROM mirror_documents",
        "shape_notes": f"SELECT file_id, CASE WHEN n % 7 = 0 THEN '标题' WHEN n % 7 = 1 THEN '占位符' WHEN n % 5 = 0 THEN '图表' WHEN n % 3 = 0 THEN '表格 2×4' WHEN n % 2 = 0 THEN '图片' WHEN regexp_replace(coalesce(title, ''), '{_S}+', '', 'g') != '' THEN '正文' END AS role, CASE WHEN h IS NULL THEN '' WHEN w >= 900 THEN '整页宽' WHEN h >= 900 THEN '整页高' WHEN w < 500 AND h < 600 THEN CASE WHEN l + w / 2.0 < 500 THEN '左栏' ELSE '右栏' END ELSE CASE WHEN l + w / 2.0 < 500 THEN '左' ELSE '右' END || CASE WHEN t + h / 2.0 < 500 THEN '上' ELSE '下' END END AS region FROM (SELECT file_id, title, file_id AS n, file_id * 37 % 1000 AS l, file_id * 53 % 1000 AS t, file_id * 71 % 1000 AS w, CASE WHEN file_id % 11 != 0 THEN file_id * 29 % 1000 END AS h FROM mirror_documents)",
        "image_pairs": f"SELECT file_id, least(len(r), 2) AS pairs, md5({swap('t1', 'r2', chr(39) + '(f_images/b.png)' + chr(39))}) AS replaced FROM (SELECT *, {swap('t', 'r1', chr(39) + '(f_images/a.png)' + chr(39))} AS t1 FROM (SELECT *, '(' || r[1] || ')' AS r1, '(' || r[2] || ')' AS r2 FROM (SELECT file_id, t, list_filter(regexp_extract_all(t, '{ref}', 1), lambda x: NOT regexp_matches(x, '^https?://')) AS r FROM (SELECT file_id, coalesce(content, '') AS t FROM mirror_documents))))",
        "image_notes": f"SELECT file_id, md5({swap('t', 'f', 'f || chr(10) || chr(10) || ' + chr(39) + '> 📷 **图片识别**: a chart' + chr(39))}) AS noted, md5({swap('t', 'f', chr(39) + chr(39))}) AS dropped FROM (SELECT file_id, t, {ref_all}[1] AS f FROM (SELECT file_id, coalesce(content, '') AS t FROM mirror_documents))",
        "name_order": f"SELECT file_id, (d = '')::INT AS none, CASE WHEN d = '' THEN 0 ELSE d::BIGINT END AS number, name, CASE WHEN file_id % 2 = 0 THEN file_id ELSE 0 END AS page FROM (SELECT file_id, {_NAME} AS name, regexp_extract({_NAME}, '([0-9]+)', 1) AS d FROM mirror_documents)",
        "text_layers": f"SELECT source AS source, coalesce(sum(length(regexp_replace(text, '\\A{_S}+|{_S}+\\z', '', 'g'))) / nullif(count(text), 0)::DOUBLE >= 50, false) AS has_text_layer FROM documents GROUP BY source",
        "skip_existing": "SELECT file_id FROM mirror_documents d WHERE NOT EXISTS (SELECT 1 FROM mirror_documents e WHERE e.file_id % 3 = 0 AND e.path = d.path)",
        "recognition_reasons": "SELECT reason, count(*) AS pictures FROM (SELECT CASE WHEN n % 13 = 0 THEN 'missing' WHEN n * 97 % 3000 < 500 THEN 'too small' WHEN n % 7 != 0 AND (n * 11 % 300 < 50 OR n * 17 % 300 < 50) THEN 'low resolution' WHEN n % 7 = 0 THEN 'kept' WHEN n % 5 != 0 AND n % 40 < 10 AND n * 3 % 40 < 10 AND n * 7 % 40 < 10 THEN 'solid colour' ELSE 'kept' END AS reason FROM (SELECT file_id AS n FROM mirror_documents)) WHERE reason != 'kept' GROUP BY reason",
        "first_pages": "WITH p AS (SELECT coalesce(doc_format, '-') AS file, lpad(file_id::VARCHAR, 8, '0') || '/page' || (file_id % 20) || '.png' AS path, file_id % 20 AS n FROM mirror_documents), q AS (SELECT *, CASE WHEN n = 0 THEN row_number() OVER (PARTITION BY file, n = 0 ORDER BY path) ELSE n END AS page FROM p) SELECT file, page, path FROM (SELECT *, row_number() OVER (PARTITION BY file, page ORDER BY n = 0, path) AS r FROM q) WHERE r = 1",
        "extract_metadata": f"SELECT file_id, md5(CASE WHEN regexp_matches(t, {_STRICT}) THEN '---' || chr(10) || m || x || '---' || chr(10) || chr(10) || regexp_replace(t, {_STRICT}, '') ELSE '---' || chr(10) || x || '---' || chr(10) || chr(10) || t END) AS with_scores FROM (SELECT file_id, t, regexp_extract(t, {_STRICT}, 1) AS m, chr(10) || 'dk_score: ' || coalesce(score, 0) || chr(10) || 'dk_score_detail:' || chr(10) || '  length: 12.3' || chr(10) || '  structure: 50.0' || chr(10) || '  freshness: 0.2' || chr(10) || '  keywords: 100.0' || chr(10) || '  uniqueness: 66.7' || chr(10) || 'dk_tags: [\"' || coalesce(doc_format, '') || '\", \"' || coalesce(origin, '') || '\"]' || chr(10) AS x FROM (SELECT *, coalesce(content, '') AS t FROM mirror_documents))",
        "extract_counters": f"WITH RECURSIVE {mirrored}, kept AS (SELECT d.doc_id, s.score, first_value(d.doc_id) OVER (PARTITION BY {_version()} ORDER BY s.score DESC, length(coalesce(text, '')) DESC, coalesce(epoch_us(modified_at), 0) DESC, d.doc_id) AS best FROM docs d JOIN resolved r ON r.doc_id = d.doc_id AND r.similar_to IS NULL JOIN scored s ON s.id = d.doc_id) SELECT status, count(*) AS documents FROM (SELECT CASE WHEN r.similar_to IS NOT NULL THEN 'duplicate' WHEN k.best != k.doc_id THEN 'merged' WHEN k.score < 30 THEN 'low_score' ELSE 'kept' END AS status FROM resolved r LEFT JOIN kept k ON k.doc_id = r.doc_id) GROUP BY status",
        "incremental_changed": "WITH seen AS (SELECT path, max(modified_at) AS m, true AS there FROM mirror_documents WHERE file_id % 2 = 0 GROUP BY path) SELECT file_id, d.path FROM mirror_documents d LEFT JOIN seen s USING (path) WHERE s.m IS NULL OR d.modified_at IS NULL OR d.modified_at > s.m",
        "extract_pipeline": f"WITH RECURSIVE {_PAIRS}, {_scored('documents', 'doc_id', 'text').replace('base AS', 'base_ AS').replace('FROM base ', 'FROM base_ ').replace('base.*', 'base_.*')}, {_greedy('copies')}, {_tags('documents', 'doc_id', 'text', 'NULL')} SELECT r.doc_id, score, tags, CASE WHEN similar_to IS NOT NULL THEN 'duplicate' WHEN score < 30 THEN 'low_score' ELSE 'kept' END AS status, similar_to FROM resolved r JOIN scored s ON s.id = r.doc_id JOIN tagged t ON t.id = r.doc_id",
        "note_tag_names": f"SELECT tag, count(*) AS notes FROM ({tag_rows}) GROUP BY tag",
        "resolve_tag_ids": f"WITH wanted AS (SELECT DISTINCT tag AS name FROM ({tag_rows})), known AS (SELECT name, min(id) AS id FROM tags WHERE id % 2 = 0 GROUP BY name), top AS (SELECT max(id) AS base FROM tags WHERE id % 2 = 0) SELECT w.name, k.id, false AS is_new FROM wanted w JOIN known k USING (name) UNION ALL SELECT name, base + row_number() OVER (ORDER BY name), true FROM wanted, top WHERE name NOT IN (SELECT name FROM known)",
        "topic_counts": "WITH c AS (SELECT id, coalesce(alias_for, id) AS cid FROM tags) SELECT g.id AS tag_id, g.name, count(DISTINCT n.note_id) AS notes FROM note_tags n JOIN c ON c.id = n.tag_id JOIN tags g ON g.id = c.cid GROUP BY g.id, g.name",
        "tag_merge_suggestions": "WITH l AS (SELECT DISTINCT note_id, tag_id FROM note_tags), s AS (SELECT tag_id, count(*) AS n FROM l GROUP BY ALL), p AS (SELECT a.tag_id AS tag_a, b.tag_id AS tag_b, count(*) AS common FROM l a JOIN l b ON a.note_id = b.note_id AND a.tag_id < b.tag_id GROUP BY ALL) SELECT tag_a, tag_b, common, round(common / (x.n + y.n - common)::DOUBLE, 9) AS jaccard FROM p JOIN s x ON x.tag_id = tag_a JOIN s y ON y.tag_id = tag_b WHERE common / (x.n + y.n - common)::DOUBLE >= 0.02",
        "stale_notes": f"SELECT id, ((epoch({_AS_OF})::BIGINT - floor(epoch(touched))::BIGINT) // 86400) AS age_days FROM (SELECT id, coalesce({stamp('updated_at')}, {stamp('created_at')}) AS touched FROM notes) WHERE (epoch({_AS_OF})::BIGINT - floor(epoch(touched))::BIGINT) // 86400 > 365",
        "note_link_degrees": f"SELECT note_id, sum(i)::BIGINT AS links_in, sum(o)::BIGINT AS links_out FROM (SELECT s AS note_id, 0 AS i, 1 AS o FROM ({real}) UNION ALL SELECT t, 1, 0 FROM ({real})) GROUP BY note_id",
        "duplicate_titles": "SELECT min(id) AS class_id, count(*) AS notes, array_to_string(list_slice(list(title ORDER BY id), 1, 3), ', ') || CASE WHEN count(*) > 3 THEN ' (+' || (count(*) - 3) || ')' ELSE '' END AS titles FROM notes WHERE title IS NOT NULL GROUP BY title HAVING count(*) > 1",
    }
