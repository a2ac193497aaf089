"""The registered queries of the engine's own operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import frontmatter, images, slides
from sedimenta.functions import text as T
from sedimenta.operators import components, scoring, simhash, tagging, tfidf, versions
from sedimenta.plans import extract as X
from sedimenta.plans import notes as N
from sedimenta.plans import pipeline
from sedimenta.sources import files, pictures, recognition, sinks
from sedimenta.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
#: The instant at which ages are measured in the queries.
AS_OF = "2026-06-01 00:00:00"


def _as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


def _documents(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents")


def _mirror(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "mirror_documents")


def score_length(spark: SparkSession, directory: str) -> DataFrame:
    return _documents(spark, directory).select("doc_id", F.round(T.length_score(F.col("text")), 6).alias("length_score"))


def score_structure(spark: SparkSession, directory: str) -> DataFrame:
    return _documents(spark, directory).select("doc_id", T.structure_score(F.col("text")).alias("structure_score"))


def score_freshness(spark: SparkSession, directory: str) -> DataFrame:
    fresh = T.freshness_score(F.col("modified_at"), _as_of())
    return _mirror(spark, directory).select("file_id", F.round(fresh, 6).alias("freshness_score"))


def keyword_hits(spark: SparkSession, directory: str) -> DataFrame:
    return _documents(spark, directory).select("doc_id", T.keyword_hits(F.col("text")).alias("hits"), F.round(T.keyword_score(F.col("text")), 6).alias("keyword_score"))


def char_entropy(spark: SparkSession, directory: str) -> DataFrame:
    scored = _documents(spark, directory).select("doc_id", "text", T.char_entropy("text").alias("h"))
    return scored.select("doc_id", F.round("h", 6).alias("entropy"), F.round(T.uniqueness_score(F.col("h"), F.col("text")), 6).alias("uniqueness_score"))


def value_score(spark: SparkSession, directory: str) -> DataFrame:
    scored = scoring.score(_documents(spark, directory), "text")
    return scored.select("doc_id", "score", *(F.round(F.col("score_detail")[n], 6).alias(n) for n in T.WEIGHTS), F.col("score_detail.passed").alias("passed"))


def value_score_passed(spark: SparkSession, directory: str) -> DataFrame:
    return scoring.passing(scoring.score(_documents(spark, directory), "text")).groupBy("lang").agg(F.count("*").alias("documents"), F.max("score").alias("best"))


def mirror_score(spark: SparkSession, directory: str) -> DataFrame:
    return scoring.score(_mirror(spark, directory).drop("score"), "content", F.col("modified_at"), _as_of()).select("file_id", F.col("score").alias("value_score"))


def term_frequency(spark: SparkSession, directory: str) -> DataFrame:
    return tfidf.weights(_documents(spark, directory), "doc_id", "text").select("doc_id", "term", "n", F.round("tf", 9).alias("tf"))


def document_frequency(spark: SparkSession, directory: str) -> DataFrame:
    return tfidf.weights(_documents(spark, directory), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.round(F.max("idf"), 9).alias("idf"))


def tfidf_norms(spark: SparkSession, directory: str) -> DataFrame:
    return tfidf.weights(_documents(spark, directory), "doc_id", "text").groupBy("doc_id").agg(F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 6).alias("norm"))


def tfidf_top_terms(spark: SparkSession, directory: str) -> DataFrame:
    return tfidf.top_terms(_documents(spark, directory), "doc_id", "text", 3).select("doc_id", "rank", "term", "n", F.round("weight", 6).alias("weight"))


def tfidf_similar_pairs(spark: SparkSession, directory: str) -> DataFrame:
    pairs = tfidf.similar_pairs(_documents(spark, directory), "doc_id", "text")
    return pairs.select("id_a", "id_b", F.round("cosine", 6).alias("cosine"))


def tfidf_classes(spark: SparkSession, directory: str) -> DataFrame:
    return tfidf.copies(_documents(spark, directory), "doc_id", "text")


def tfidf_dedup(spark: SparkSession, directory: str) -> DataFrame:
    scored = scoring.score(_documents(spark, directory), "text")
    return X.duplicates_tfidf(scored, "doc_id", "text").select("doc_id", "status", "similar_to")


def simhash_fingerprint(spark: SparkSession, directory: str) -> DataFrame:
    return simhash.fingerprints(_documents(spark, directory), "doc_id", "text")


def simhash_bands(spark: SparkSession, directory: str) -> DataFrame:
    return simhash.bands(simhash.fingerprints(_documents(spark, directory), "doc_id", "text"), "doc_id").select("doc_id", "band", "band_key")


def simhash_similar_pairs(spark: SparkSession, directory: str) -> DataFrame:
    return simhash.similar_pairs(simhash.fingerprints(_documents(spark, directory), "doc_id", "text"), "doc_id")


def simhash_dedup(spark: SparkSession, directory: str) -> DataFrame:
    scored = scoring.score(_documents(spark, directory), "text")
    return X.duplicates_simhash(scored, "doc_id", "text").select("doc_id", "status", "similar_to")


def similarity_components(spark: SparkSession, directory: str) -> DataFrame:
    return components.components(simhash.similar_pairs(simhash.fingerprints(_documents(spark, directory), "doc_id", "text"), "doc_id"))


def auto_tags(spark: SparkSession, directory: str) -> DataFrame:
    return tagging.tag(_mirror(spark, directory), "content", "title").select("file_id", F.array_join("tags", ",").alias("tags"))


def version_key(spark: SparkSession, directory: str) -> DataFrame:
    return _mirror(spark, directory).select("file_id", versions.version_key(F.col("path")).alias("version_key"))


def version_merge(spark: SparkSession, directory: str) -> DataFrame:
    return versions.merge(_mirror(spark, directory), "file_id", "path", "content", "modified_at").select("file_id", "version_key", "merged_into")


def extension_classify(spark: SparkSession, directory: str) -> DataFrame:
    source = F.regexp_replace("path", r"(?i)\.md$", "")
    return _mirror(spark, directory).select("file_id", files.extension(source).alias("extension"), files.classify(source).alias("class"))


def format_filter(spark: SparkSession, directory: str) -> DataFrame:
    source = F.regexp_replace("path", r"(?i)\.md$", "")
    return _mirror(spark, directory).filter(files.classify(source, ["PDF", ".docx"]).isNotNull()).groupBy(files.extension(source).alias("extension")).agg(F.count("*").alias("files"))


def frontmatter_parse(spark: SparkSession, directory: str) -> DataFrame:
    parsed = _mirror(spark, directory).select("file_id", frontmatter.parse(F.col("content"), F.col("path")).alias("p"), slides.source_file(F.col("content")).alias("source"))
    return parsed.select("file_id", "p.title", "source", F.length("p.body").alias("body_chars"))


def frontmatter_render(spark: SparkSession, directory: str) -> DataFrame:
    status = F.when(F.col("score").isNull(), "error").when(F.col("score") < 40, "skipped").otherwise("converted")
    made = frontmatter.render(F.coalesce("title", F.lit("")), F.col("path"), F.col("path"), F.col("doc_format"), status, F.date_format("ingested_at", "yyyy-MM-dd"), F.col("score").cast("string"), {"origin": F.col("origin")})
    return _mirror(spark, directory).select("file_id", F.md5(made).alias("rendered"))


def vault_frontmatter(spark: SparkSession, directory: str) -> DataFrame:
    made = sinks.vault(_mirror(spark, directory).filter("content IS NOT NULL"), "path", "content", F.lit("2026-06-01"))
    return made.select("relative", F.md5("content").alias("content_md5"))


def image_references(spark: SparkSession, directory: str) -> DataFrame:
    text = F.coalesce(F.col("content"), F.lit(""))
    return _mirror(spark, directory).select(
        "file_id", F.size(images.local_references(text)).alias("local_references"), F.length(images.strip_references(text)).alias("stripped_chars"), F.md5(images.rebase(text, F.col("path"), "mirror")).alias("rebased"),
    )


def _deck(df: DataFrame) -> DataFrame:
    """Adds ``deck``, a text of three slides made of a record's title, format and path."""
    anchor = lambda n: f"<!-- Slide number: {n} -->\n\n"
    some = lambda name: F.coalesce(name, F.lit(""))
    return df.withColumn("deck", F.concat(F.lit(anchor(1)), some("title"), F.lit("\n\n" + anchor(2)), some("doc_format"), F.lit("\n\n" + anchor(3)), some("path")))


def slide_anchors(spark: SparkSession, directory: str) -> DataFrame:
    said = F.create_map(F.lit(1), F.lit("[DK-标题]T[DK-概述]O[DK-结构]S[DK-正文]B"), F.lit(2), F.lit("[图片识别失败: x]"))
    done = slides.inject_pages(F.col("deck"), said)
    return _deck(_mirror(spark, directory)).select("file_id", F.array_join(slides.failed_pages(done).cast("array<string>"), ",").alias("failed_pages"), F.md5(done).alias("injected"))


def slide_layouts(spark: SparkSession, directory: str) -> DataFrame:
    notes = F.create_map(F.lit(2), F.array(F.lit("标题(整页宽)"), F.coalesce("origin", F.lit("-"))))
    return _deck(_mirror(spark, directory)).select("file_id", F.md5(slides.inject_layout(F.col("deck"), notes)).alias("with_layout"))


def shape_notes(spark: SparkSession, directory: str) -> DataFrame:
    n = F.col("file_id").cast("long")
    shape = F.struct(
        F.when(n % 7 == 0, "TITLE").when(n % 7 == 1, "BODY").alias("placeholder"), (n % 5 == 0).alias("chart"), F.when(n % 3 == 0, F.lit(2)).alias("rows"), F.lit(4).alias("columns"),
        F.when(n % 2 == 0, F.lit(13)).otherwise(F.lit(1)).alias("kind"), F.coalesce("title", F.lit(" ")).alias("text"),
    )
    region = slides.shape_region(n * 37 % 1000, n * 53 % 1000, n * 71 % 1000, F.when(n % 11 != 0, n * 29 % 1000), F.lit(1000), F.lit(1000))
    return _mirror(spark, directory).select("file_id", slides.shape_role(shape).alias("role"), region.alias("region"))


def image_pairs(spark: SparkSession, directory: str) -> DataFrame:
    text = F.coalesce("content", F.lit(""))
    pairs = images.image_map(text, F.array(F.lit("a.png"), F.lit("b.png")), F.lit("f"))
    return _mirror(spark, directory).select("file_id", F.size(pairs).alias("pairs"), F.md5(images.replace_references(text, pairs)).alias("replaced"))


def image_notes(spark: SparkSession, directory: str) -> DataFrame:
    text = F.coalesce("content", F.lit(""))
    pairs = images.image_map(text, F.array(F.lit("a.png")), F.lit("f"))
    noted = images.inject_recognised(text, pairs, F.create_map(F.lit("a.png"), F.lit("a chart")))
    return _mirror(spark, directory).select("file_id", F.md5(noted).alias("noted"), F.md5(images.drop_positions(text, F.array(F.lit(0)))).alias("dropped"))


def name_order(spark: SparkSession, directory: str) -> DataFrame:
    page = slides.page_number(F.concat(F.lit("x/page"), F.col("file_id").cast("string"), F.when(F.col("file_id") % 2 == 0, ".png").otherwise(".jpg")))
    return _mirror(spark, directory).select("file_id", images.sort_key(F.col("path")).alias("k"), page.alias("page")).select("file_id", "k.none", "k.number", "k.name", "page")


def text_layers(spark: SparkSession, directory: str) -> DataFrame:
    return files.text_layer(_documents(spark, directory), "source", "text")


def skip_existing(spark: SparkSession, directory: str) -> DataFrame:
    mirror = _mirror(spark, directory).select("file_id", F.col("path").alias("output"))
    existing = _mirror(spark, directory).filter("file_id % 3 = 0").select(F.col("path").alias("relative"))
    return pipeline.missing(mirror, existing, "output").select("file_id")


def recognition_reasons(spark: SparkSession, directory: str) -> DataFrame:
    n = F.col("file_id").cast("long")
    flat = F.when(n % 5 != 0, F.array(*((n * k % 40).cast("double") for k in (1, 3, 7))))
    verdict = recognition.worth_recognising(F.when(n % 13 != 0, n * 97 % 3000), F.when(n % 7 != 0, n * 11 % 300), F.when(n % 7 != 0, n * 17 % 300), flat)
    return pictures.reasons(_mirror(spark, directory).select(verdict.alias("v")).select("v.*"))


def first_pages(spark: SparkSession, directory: str) -> DataFrame:
    n = F.col("file_id")
    named = F.concat(F.lpad(n.cast("string"), 8, "0"), F.lit("/page"), (n % 20).cast("string"), F.lit(".png"))
    pages = _mirror(spark, directory).select(F.coalesce("doc_format", F.lit("-")).alias("file"), named.alias("path"), F.lit(None).cast("binary").alias("content"))
    return recognition.numbered_pages(pages, "file").select("file", "page", "path")


def extract_metadata(spark: SparkSession, directory: str) -> DataFrame:
    detail = F.struct(*(F.lit(v).alias(n) for n, v in {"length": 12.34, "structure": 50.05, "freshness": 0.25, "keywords": 100.0, "uniqueness": 66.66}.items()))
    tags = F.array(F.coalesce("doc_format", F.lit("")), F.coalesce("origin", F.lit("")))
    made = frontmatter.with_scores(F.coalesce("content", F.lit("")), F.coalesce("score", F.lit(0)), detail, tags)
    return _mirror(spark, directory).select("file_id", F.md5(made).alias("with_scores"))


def incremental_changed(spark: SparkSession, directory: str) -> DataFrame:
    mirror = _mirror(spark, directory)
    target = mirror.filter("file_id % 2 = 0").select("path", F.col("modified_at"))
    return X.changed(mirror, target, "path", "modified_at").select("file_id", "path")


def extract_pipeline(spark: SparkSession, directory: str) -> DataFrame:
    done = X.extract(_documents(spark, directory), "doc_id", "text")
    return done.select("doc_id", "score", F.array_join("tags", ",").alias("tags"), "status", "similar_to")


def extract_counters(spark: SparkSession, directory: str) -> DataFrame:
    mirror = _mirror(spark, directory).drop("score")
    return X.counters(X.extract(mirror, "file_id", "content", "title", "path", "modified_at", _as_of(), use_simhash=True, merge=True))


def note_tag_names(spark: SparkSession, directory: str) -> DataFrame:
    return N.tag_names(table(spark, directory, "notes")).groupBy("tag").agg(F.count("*").alias("notes"))


def resolve_tag_ids(spark: SparkSession, directory: str) -> DataFrame:
    names = N.tag_names(table(spark, directory, "notes")).select(F.col("tag").alias("name"))
    known = table(spark, directory, "tags").filter("id % 2 = 0").select("id", "name")
    return sinks.resolve_ids(names, known)


def topic_counts(spark: SparkSession, directory: str) -> DataFrame:
    return N.topics(table(spark, directory, "note_tags"), table(spark, directory, "tags"))


def tag_merge_suggestions(spark: SparkSession, directory: str) -> DataFrame:
    found = N.merge_suggestions(table(spark, directory, "note_tags"), 0.02)
    return found.select("tag_a", "tag_b", "common", F.round("jaccard", 9).alias("jaccard"))


def stale_notes(spark: SparkSession, directory: str) -> DataFrame:
    return N.stale(table(spark, directory, "notes"), _as_of(), 365)


def note_link_degrees(spark: SparkSession, directory: str) -> DataFrame:
    return N.link_degrees(table(spark, directory, "note_links"))


def duplicate_titles(spark: SparkSession, directory: str) -> DataFrame:
    notes = table(spark, directory, "notes").filter("title IS NOT NULL")
    first = notes.groupBy("title").agg(F.min("id").alias("class_id"))
    return N.duplicate_groups(notes.select("id", "title"), notes.join(first, "title").select("id", "class_id"))


def queries() -> dict[str, Query]:
    """All queries by name."""
    return {name: f for name, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_") and name != "queries"}
