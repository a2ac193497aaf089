"""Column expressions on the image references of Markdown text; references to the web never count by position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = r"!\[.*?\]\(([^)]+)\)"
_AHEAD = r"(?=!\[.*?\]\([^)]+\))"


def local_references(text: Column) -> Column:
    """The targets of all references that do not point to the web, in order."""
    return F.filter(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), lambda r: ~r.rlike("^https?://"))


def image_map(text: Column, images: Column, folder: Column) -> Column:
    """Array of (ref, new_path): the i-th local reference and the i-th image; what either has more stays unmatched."""
    refs = local_references(text)
    size = F.least(F.size(refs), F.size(images))
    paired = F.zip_with(F.slice(refs, F.lit(1), size), F.slice(images, F.lit(1), size), lambda r, i: F.struct(r.alias("ref"), F.concat(folder, F.lit("_images/"), i).alias("new_path")))
    return F.when(size > 0, paired).otherwise(F.array().cast("array<struct<ref:string,new_path:string>>"))


def replace_references(text: Column, pairs: Column) -> Column:
    """For each pair in order, the first occurrence of ``(ref)`` becomes ``(new_path)``."""

    def one(done: Column, pair: Column) -> Column:
        old, new = F.concat(F.lit("("), pair["ref"], F.lit(")")), F.concat(F.lit("("), pair["new_path"], F.lit(")"))
        at = F.call_function("instr", done, old)
        return F.when(at == 0, done).otherwise(F.concat(F.substring(done, F.lit(1), at - 1), new, F.substring(done, at + F.length(old), F.length(done))))

    return F.aggregate(pairs, text, one)


def rebase(text: Column, relative: Column, mirror: str) -> Column:
    """Local references that do not climb already get ``../`` for each folder above and the path into the mirror."""
    folder = F.regexp_extract(relative, r"^(.*/)?", 0)
    depth = F.length(folder) - F.length(F.translate(folder, "/", ""))
    prefix = F.concat(F.repeat(F.lit("../"), depth + 1), F.lit(mirror + "/"), folder)
    quoted = F.regexp_replace(prefix, r"([\\$])", r"\\$1")
    return F.regexp_replace(text, F.lit(r"!\[([^\]]*)\]\((?!https?://|\.\./)([^)]+)\)"), F.concat(F.lit("![$1]("), quoted, F.lit("$2)")))


def strip_references(text: Column) -> Column:
    """The text without image references."""
    return F.regexp_replace(text, r"!\[.*?\]\([^)]+\)", "")


def _parts(text: Column) -> Column:
    return F.split(text, _AHEAD)


def _local(part: Column) -> Column:
    return part.rlike(r"^!\[.*?\]\((?!https?://)[^)]+\)")


def _numbered(text: Column, change) -> Column:
    """Changes each part that starts with a local reference: ``change(part, position)``, positions from 0."""
    parts = _parts(text)

    def one(part: Column, i: Column) -> Column:
        position = F.size(F.filter(F.slice(parts, F.lit(1), i), _local))
        return F.when(_local(part), change(part, position)).otherwise(part)

    return F.array_join(F.transform(parts, one), "")


def drop_positions(text: Column, positions: Column) -> Column:
    """The text without the local references at the given positions."""
    cut = lambda part: F.regexp_replace(part, r"^!\[.*?\]\([^)]+\)", "")
    return _numbered(text, lambda part, i: F.when(F.array_contains(positions, i), cut(part)).otherwise(part))


def inject_recognised(text: Column, pairs: Column, recognised: Column) -> Column:
    """Puts a quote with its description below each local reference whose image (by file name) was recognised."""

    def add(part: Column, i: Column) -> Column:
        pair = F.get(pairs, i)
        said = recognised[F.element_at(F.split(pair["new_path"], "/"), -1)]
        head = F.regexp_extract(part, r"^!\[.*?\]\([^)]+\)", 0)
        rest = F.substring(part, F.length(head) + 1, F.length(part))
        return F.when(F.coalesce(said, F.lit("")) != "", F.concat(head, F.lit("\n\n> 📷 **图片识别**: "), said, rest)).otherwise(part)

    return _numbered(text, add)


def recognised_ok(said: Column) -> Column:
    """Whether the recognition of an image succeeded: not empty and not starting with a bracket."""
    return F.coalesce(said, F.lit("")).rlike(r"\A[^\[]")


def sort_key(name: Column) -> Column:
    """Orders image names by their first number, names without one last."""
    plain = F.element_at(F.split(name, "/"), -1)
    digits = F.regexp_extract(plain, r"(\d+)", 1)
    return F.struct((digits == "").cast("int").alias("none"), F.coalesce(F.try_to_number(F.when(digits != "", F.lpad(digits, 18, "0")), F.lit("9" * 18)), F.lit(0)).cast("long").alias("number"), plain.alias("name"))
