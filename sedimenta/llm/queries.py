"""The registered queries of the training-data problems, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.frontmatter import body
from sedimenta.llm import bpe, forest, mojibake, neardup, packing, scanned, survivors, textquality
from sedimenta.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


# Problem 1 ---------------------------------------------------------------------------------------------------------


def p1_statistics(spark: SparkSession, directory: str) -> DataFrame:
    """Text statistics of every body that is not blank, with the verdict of the rule list."""
    rows = table(spark, directory, "common_words").groupBy("lang").agg(F.collect_list("word").alias("words")).collect()
    mirror = table(spark, directory, "mirror_documents")
    return textquality.statistics(mirror, "file_id", body(F.col("content")), {r.lang: r.words for r in rows})


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """The records whose body is for the greater part something other than sentences."""
    return p1_statistics(spark, directory).filter("no_prose = 1").select("file_id")


# Problem 2 ---------------------------------------------------------------------------------------------------------


def _scans(spark: SparkSession, directory: str) -> tuple[DataFrame, dict[str, dict[str, int]]]:
    mirror = table(spark, directory, "mirror_documents").withColumn("body", body(F.col("content")))
    matter = F.substring("content", F.lit(1), F.length("content") - F.length("body"))
    counts = scanned.model(scanned.counted(mirror, F.col("body")))
    return mirror.withColumn("first", (F.length(matter) - F.length(F.replace(matter, F.lit("\n"))) + 1).cast("int")), counts


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """The noisy lines of text from scanned pages: broken words, misread characters, page furniture."""
    mirror, counts = _scans(spark, directory)
    return scanned.noise(mirror, "file_id", counts)


def p2_repaired(spark: SparkSession, directory: str) -> DataFrame:
    """The texts from scanned pages as continuous paragraphs without noise."""
    mirror, counts = _scans(spark, directory)
    return scanned.repaired(mirror, "file_id", counts)


# Problem 3 ---------------------------------------------------------------------------------------------------------


def _ranked(spark: SparkSession, directory: str) -> DataFrame:
    records = table(spark, directory, "mirror_documents")
    ranks = table(spark, directory, "origins").groupBy("origin").agg(F.min("trust_rank").alias("trust_rank"))
    return records.join(ranks, "origin", "left").withColumn("group", survivors.file_key(F.col("path")))


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """Who supplies content, path and score of each file that came in more than once.

    TESTDATA.md fixes one rule per field, so votes are not added up over equal values, which would let two copies of a
    poor value beat a better one; a vote is the rule's order: (characters, recency), recency, (trust, recency).
    """
    recent = F.coalesce(F.unix_micros("modified_at"), F.lit(-(1 << 62)))
    solid = F.length(F.regexp_replace(body(F.col("content")), r"(?U)\s+", ""))
    nothing = F.lit(None).cast("string")
    vote = lambda first: F.struct(first.cast("long").alias("first"), recent.alias("recent"))
    fields = {
        "content": (nothing, F.coalesce(solid, F.lit(0)) > 0, vote(F.coalesce(solid, F.lit(0)))),
        "path": (nothing, F.lit(True), vote(F.lit(0))),
        "score": (nothing, F.col("score").isNotNull(), vote(-F.coalesce("trust_rank", F.lit(1 << 30)))),
    }
    long = survivors.unpivot(_ranked(spark, directory), F.col("group"), F.col("file_id"), fields)
    wide = survivors.suppliers(long.drop("value"), list(fields))
    return wide.unpivot("group_id", list(fields), "field_name", "file_id").filter("file_id IS NOT NULL")


def p3_survivors(spark: SparkSession, directory: str) -> DataFrame:
    """One whole record per file that came in more than once: each field's value with the greatest sum of source trust times recency decay.

    A vote is 1 / trust_rank (1/100 where the origin is unknown) halved for every 180 days before the newest ingest of
    the whole table; a record without ``modified_at`` counts as three years old. Values that differ only in blanks at
    their ends are one value. ``content`` and ``path`` are large: their votes go to a hash of the value, and the text comes
    from the winner's first record.
    """
    rows = _ranked(spark, directory)
    newest = table(spark, directory, "mirror_documents").agg(F.max("ingested_at").alias("newest"))
    rows = rows.join(F.broadcast(newest))
    days = F.coalesce((F.unix_seconds("newest") - F.unix_seconds("modified_at")) / 86400, F.lit(1095.0))
    vote = F.pow(F.lit(2.0), -days / 180) / F.coalesce("trust_rank", F.lit(100))
    plain = lambda name: F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))
    names, large = ["title", "score", "doc_format"], ["content", "path"]
    vote = F.round(vote, 9).cast("decimal(20,9)")
    fields = {name: (plain(name), plain(name).isNotNull(), vote) for name in names}
    fields |= {name: (F.sha2(plain(name), 256), plain(name).isNotNull(), vote) for name in large}
    fields["record"] = (F.lit("any"), F.lit(True), F.lit(0).cast("decimal(20,9)"))  # counts the group
    winners = survivors.voted(survivors.unpivot(rows, F.col("group"), F.col("file_id"), fields))
    several = winners.filter("field_name = 'record' AND first_id != last_id").select("group_key")
    winners = winners.join(several, "group_key", "left_semi")
    found = survivors.pivot_back(winners, "group_key", "value", names)
    first = survivors.pivot_back(winners, "group_key", "winner_id", large)
    records = table(spark, directory, "mirror_documents")
    for name in large:
        texts = records.select(F.col("file_id").alias("supplier"), plain(name).alias(name))
        chosen = first.select("group_key", F.col(name).alias("supplier"))
        found = found.join(chosen.filter("supplier IS NOT NULL").join(texts, "supplier").drop("supplier"), "group_key", "left")
    return found.withColumnRenamed("group_key", "file_key")


# Problem 4 ---------------------------------------------------------------------------------------------------------

#: TESTDATA.md: three successive words, half of the sequences that either text has.
WIDTH, THRESHOLD = 3, 0.5


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Notes that repeat a note accepted before, batch after batch.

    A null title counts as empty. Notes whose ``content`` is null or empty are accepted and not compared.
    """
    notes = table(spark, directory, "notes").filter("content IS NOT NULL AND content != ''")
    joined = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.col("content"))
    texts = notes.select("id", F.coalesce("batch_no", F.lit(1 << 30)).alias("arrival"), joined.alias("text"))
    counts = [(r.arrival, r.c) for r in texts.groupBy("arrival").agg(F.count("*").alias("c")).collect()]
    index = forest.Forest(spark, WIDTH, THRESHOLD)
    found = None
    for first, last in forest.rounds(counts):
        batch = texts.filter(F.col("arrival").between(first, last))
        refused = index.accept(batch, texts.select("id", "text"))
        found = refused if found is None else found.unionByName(refused)
    if found is None:
        found = texts.select("id")
    return found.select(F.col("id").alias("note_id"))


# Problem 5 ---------------------------------------------------------------------------------------------------------

def _bodies(spark: SparkSession, directory: str) -> DataFrame:
    mirror = table(spark, directory, "mirror_documents").select(
        F.lit("mirror_documents").alias("src"), F.col("file_id").alias("id"), body(F.col("content")).alias("text")
    )
    notes = table(spark, directory, "notes").select(F.lit("notes").alias("src"), "id", F.col("content").alias("text"))
    return mirror.unionByName(notes)


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """All similar pairs of records of one table, copies included."""
    pairs, members = neardup.similar(_bodies(spark, directory), "src", WIDTH, THRESHOLD)
    return neardup.expand(pairs, members, "src")


def p5_groups(spark: SparkSession, directory: str) -> DataFrame:
    """Every record that is like another one: its group, its representative among equal texts, and its number of links.

    A link is a similar record of different text, by representatives; a group is whatever links and copies connect.
    """
    pairs, members = neardup.similar(_bodies(spark, directory), "src", WIDTH, THRESHOLD)
    return neardup.classes(pairs, members, "src")


# Problem 6 ---------------------------------------------------------------------------------------------------------


def p6_ids(spark: SparkSession, directory: str) -> DataFrame:
    """``doc_id`` and the ids of every text under byte_bpe_50k."""
    return bpe.encode_texts(table(spark, directory, "documents"), "doc_id", "text")


# Problem 7 ---------------------------------------------------------------------------------------------------------


def p7_packing(spark: SparkSession, directory: str) -> DataFrame:
    """Where every text lies, for each capacity of ``containers``."""
    documents = table(spark, directory, "documents")
    sized = bpe.encode_texts(documents, "doc_id", "text", counts_only=True)
    capacities = [tuple(r) for r in table(spark, directory, "containers").select("container_id", "capacity_tokens").distinct().collect()]
    return packing.pack(sized, documents.count(), sorted(capacities), "doc_id", "n_tokens")


def p7_fill(spark: SparkSession, directory: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.fill(p7_packing(spark, directory))


# Problem 8 ---------------------------------------------------------------------------------------------------------


def p8_restored(spark: SparkSession, directory: str) -> DataFrame:
    """The garbled documents, restored as far as they can be, and the encoding that was taken for another."""
    documents = table(spark, directory, "documents")
    model = mojibake.lexicon(mojibake.counted(documents, F.col("text")))
    return mojibake.restored(documents, "doc_id", "text", model)


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    """The documents whose text was decoded with another encoding than its own, wholly or in part."""
    return p8_restored(spark, directory).select("doc_id")


def queries() -> dict[str, Query]:
    """All queries by name."""
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express on whole tables."""
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    block = quote(r"(?s)\A---[ \t]*\r?\n(?:.*?\n)??---[ \t]*\r?(?:\n|\z)")
    bare = f"CASE WHEN starts_with(content, '---') THEN regexp_replace(content, {block}, '') ELSE content END"
    space = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    marks = f"{survivors.MARKER}|{survivors.HAN}"
    ends = rf"(?: ?(?:\((?:\d{{1,4}}|{marks})\)|{survivors.HAN})| {survivors.MARKER})+\z"
    starts = rf"\A(?:(?:\((?:\d{{1,4}}|{marks})\)|{survivors.HAN}) ?|{survivors.MARKER} )+"
    names = rf"""
paths AS (SELECT *, regexp_replace(regexp_replace(replace(lower(url_decode(replace(path, '+', '%2B'))), '\', '/'), '/(?:\.?/)+', '/', 'g'), '\A(?:\./+)+', '') AS p FROM mirror_documents),
parts AS (SELECT *, regexp_extract(p, '(?s)\A(.*/)?') AS folder, regexp_extract(p, '(?s)([^/]*)\z', 1) AS name FROM paths),
stems AS (SELECT *, regexp_extract(name, '((?:\.[a-z][a-z0-9]{{0,4}}){{1,2}})\z', 1) AS ending FROM parts),
spaced AS (SELECT *, trim(regexp_replace(left(name, length(name) - length(ending)), '[\s_\-. ]+', ' ', 'g')) AS s FROM stems),
keyed AS (SELECT *, regexp_replace(folder, '[\s_\- ]+', ' ', 'g') || coalesce(nullif(trim(regexp_replace(regexp_replace(s, {quote(ends)}, ''), {quote(starts)}, '')), ''), s) || ending AS k FROM spaced)"""
    found = f"""WITH {names},
votes AS (SELECT k, file_id, score, coalesce(epoch_us(modified_at), -(1::BIGINT << 62)) AS recent, coalesce(trust_rank, 1 << 30) AS trust, coalesce(length(regexp_replace({bare}, '{space}+', '', 'g')), 0) AS solid FROM keyed LEFT JOIN origins USING (origin)),
several AS (SELECT k, min(file_id) AS group_id FROM votes GROUP BY k HAVING count(*) > 1),
ranked AS (
  SELECT group_id, 'content' AS field_name, file_id, row_number() OVER (PARTITION BY group_id ORDER BY solid DESC, recent DESC, file_id) AS r FROM votes JOIN several USING (k) WHERE solid > 0
  UNION ALL SELECT group_id, 'path', file_id, row_number() OVER (PARTITION BY group_id ORDER BY recent DESC, file_id) FROM votes JOIN several USING (k)
  UNION ALL SELECT group_id, 'score', file_id, row_number() OVER (PARTITION BY group_id ORDER BY trust, recent DESC, file_id) FROM votes JOIN several USING (k) WHERE score IS NOT NULL)
SELECT group_id, field_name, file_id FROM ranked WHERE r = 1"""
    pairs = rf"""WITH texts AS (
  SELECT 'mirror_documents' AS src, file_id AS id, {bare} AS t FROM mirror_documents WHERE content IS NOT NULL
  UNION ALL SELECT 'notes', id, content FROM notes WHERE content IS NOT NULL),
words AS (SELECT src, id, regexp_extract_all(regexp_replace(lower(t), '([一-鿿])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+') AS w FROM texts),
shingles AS (SELECT DISTINCT src, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT src, id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)),
sizes AS (SELECT src, id, count(*) AS n FROM shingles GROUP BY ALL),
common AS (SELECT a.src, a.id AS id_a, b.id AS id_b, count(*) AS c FROM shingles a JOIN shingles b ON a.src = b.src AND a.s = b.s AND a.id < b.id GROUP BY ALL)
SELECT common.src, id_a, id_b FROM common JOIN sizes x ON x.src = common.src AND x.id = id_a JOIN sizes y ON y.src = common.src AND y.id = id_b WHERE 2 * c >= x.n + y.n - c"""
    return {"p3_found": found, "p5_found": pairs}
