"""Reports on the note store: topics, merge suggestions between tags, stale notes, groups of like titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.operators import tfidf
from sedimenta.operators.components import components
from sedimenta.session import cut


def tag_names(notes: DataFrame) -> DataFrame:
    """``id, tag`` of the distinct tags in the JSON text ``tags``; text that is no JSON array has none."""
    names = F.from_json("tags", "array<string>")
    return notes.select("id", F.explode(names).alias("tag")).filter("tag IS NOT NULL AND tag != ''").distinct()


def canonical(tags: DataFrame) -> DataFrame:
    """``id, canonical_id``: an alias stands for what it is an alias of; one step, as the store keeps them."""
    return tags.select("id", F.coalesce("alias_for", "id").alias("canonical_id"))


def topics(note_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """``tag_id, name, notes``: distinct notes of each tag, aliases counted with what they stand for."""
    links = note_tags.join(F.broadcast(canonical(tags)), note_tags["tag_id"] == F.col("id")).select("note_id", "canonical_id").distinct()
    named = tags.select(F.col("id").alias("canonical_id"), "name")
    return links.groupBy("canonical_id").agg(F.count("*").alias("notes")).join(F.broadcast(named), "canonical_id").select(F.col("canonical_id").alias("tag_id"), "name", "notes")


def merge_suggestions(note_tags: DataFrame, threshold: float) -> DataFrame:
    """``tag_a, tag_b, common, jaccard`` of tags whose sets of notes overlap at least so much.

    Pairs are counted per note; tags per note are few by nature, so no pair list grows with a popular tag.
    """
    links = note_tags.select("note_id", "tag_id").distinct()
    sizes = links.groupBy("tag_id").agg(F.count("*").alias("n"))
    other = links.select("note_id", F.col("tag_id").alias("tag_b"))
    common = links.withColumnRenamed("tag_id", "tag_a").join(other, "note_id").filter("tag_a < tag_b").groupBy("tag_a", "tag_b").agg(F.count("*").alias("common"))
    both = common.join(sizes.toDF("tag_a", "n_a"), "tag_a").join(sizes.toDF("tag_b", "n_b"), "tag_b")
    share = F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))
    return both.select("tag_a", "tag_b", "common", share.alias("jaccard")).filter(F.col("jaccard") >= threshold)


def timestamp(text: Column) -> Column:
    """The time of an ISO-8601 text in any of the store's spellings, null for anything else; no zone means UTC."""
    return F.try_to_timestamp(F.regexp_replace(text, "T", " "))


def stale(notes: DataFrame, as_of: Column, days: int) -> DataFrame:
    """``id, age_days`` of notes last touched more than so many days ago; without an update the creation counts."""
    touched = F.coalesce(timestamp(F.col("updated_at")), timestamp(F.col("created_at")))
    return notes.select("id", F.floor((F.unix_seconds(as_of) - F.unix_seconds(touched)) / 86400).cast("long").alias("age_days")).filter(F.col("age_days") > days)


def link_degrees(links: DataFrame) -> DataFrame:
    """``note_id, links_in, links_out`` over distinct links between different notes."""
    real = links.filter("source_note_id != target_note_id").select("source_note_id", "target_note_id").distinct()
    ends = real.select(F.explode(F.array(F.struct(F.col("source_note_id").alias("note_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_note_id").alias("note_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("note_id").agg(F.sum("i").alias("links_in"), F.sum("o").alias("links_out"))


def duplicate_groups(members: DataFrame, classes: DataFrame, most: int = 3) -> DataFrame:
    """``class_id, notes, titles``: groups of at least two notes with their first titles and how many more there are.

    ``members`` has ``id, title``, ``classes`` has ``id, class_id``. Only the first titles of a group are kept while it is
    aggregated, so a group's size doesn't matter.
    """
    joined = members.join(classes, "id")
    counts = joined.groupBy("class_id").agg(F.count("*").alias("notes")).filter("notes > 1")
    first = F.min(F.struct("id", "title"))
    heads, rest = [], joined.join(counts.select("class_id"), "class_id", "left_semi")
    for _ in range(most):
        head = rest.groupBy("class_id").agg(first.alias("h")).select("class_id", "h.id", "h.title")
        heads.append(head)
        rest = rest.join(head.select("class_id", "id"), ["class_id", "id"], "left_anti")
    union = heads[0]
    for head in heads[1:]:
        union = union.unionByName(head)
    titles = union.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("title", F.lit("")).alias("title")))).alias("t"))
    shown = F.array_join(F.transform("t", lambda x: x["title"]), ", ")
    more = F.when(F.col("notes") > most, F.concat(F.lit(" (+"), (F.col("notes") - most).cast("string"), F.lit(")"))).otherwise("")
    return counts.join(titles, "class_id").select("class_id", "notes", F.concat(shown, more).alias("titles"))


def similar_groups(notes: DataFrame, note_tags: DataFrame, tags: DataFrame, threshold: float = 0.6, most: int = 3, most_tags: int = 5) -> DataFrame:
    """``class_id, notes, similarity, titles, common_tags`` of notes whose title and content are alike, the likest first.

    A group is what cosines of at least the threshold connect, ``similarity`` its greatest; ``titles`` are the first ones and how
    many more there are, ``common_tags`` the first tags that all its notes share. Null titles and contents count as empty.
    """
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    rows = notes.select("id", "title", text.alias("text"))
    pairs = cut(tfidf.similar_pairs(rows, "id", "text", threshold))
    copied = cut(tfidf.copies(rows.filter("text != '\n'"), "id", "text").filter("id != rep_id"))
    links = pairs.select("id_a", "id_b", "cosine").unionByName(copied.select(F.col("rep_id").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("cosine")))
    classes = cut(components(links.select("id_a", "id_b")).withColumnRenamed("component", "class_id"))
    groups = duplicate_groups(rows.select("id", "title"), classes, most)
    best = links.join(classes.withColumnRenamed("id", "id_a"), "id_a").groupBy("class_id").agg(F.max("cosine").alias("similarity"))
    tagged = note_tags.distinct().join(classes.withColumnRenamed("id", "note_id"), "note_id").groupBy("class_id", "tag_id").agg(F.count("*").alias("n"))
    shared = tagged.join(groups.select("class_id", "notes"), "class_id").filter("n = notes").join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    names = shared.groupBy("class_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, most_tags), ", ").alias("common_tags"))
    joined = groups.join(best, "class_id").join(names, "class_id", "left")
    return joined.select("class_id", "notes", F.least(F.lit(1.0), "similarity").alias("similarity"), "titles", F.coalesce("common_tags", F.lit("")).alias("common_tags"))
