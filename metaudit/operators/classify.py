"""Attribute rows against the confidentiality profile and the dictionary.

``profile`` has (tag, action), ``patterns`` (ordinal, mask, action), ``dictionary`` (tag, name, vr) and its
patterns (ordinal, mask, name, vr); the loaders in ``sources.tables`` make them. Each attribute row meets the
exact entries in one equi-join, whose counted small side is broadcast, and the masks, a few dozen rows of a
standard, as literal conditions of the plan. So a classification needs no exchange of the attributes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import is_private

BURNED_IN = "00280301"
#: Rows of a profile or dictionary up to which it is sent to every task; the standard has some five thousand.
MOST_ENTRIES = 100_000
#: Tags that differ from file to file by design; their values are not compared.
PER_INSTANCE_TAGS = ("00080018", "00080013", "00080032", "00080033", "0008002a", "00200012", "00201041", "00020003")


def entries(table: DataFrame) -> DataFrame:
    """A table of a standard's entries, sent to every task if it has ``MOST_ENTRIES`` at most: attributes have few tags, so a shuffle by tag would gather them in few tasks."""
    return F.broadcast(table) if table.limit(MOST_ENTRIES + 1).count() <= MOST_ENTRIES else table


def first_mask(tag: Column, patterns: DataFrame) -> Column:
    """A struct of ordinal and the other columns of the first mask in table order that ``tag`` matches, else null. The masks are collected: they are part of a standard."""
    others = [c for c in patterns.columns if c != "mask"]
    kind = F.lit(None).cast(patterns.select(F.struct(*others).alias("m")).schema["m"].dataType)
    rows = patterns.filter("mask IS NOT NULL").orderBy("ordinal").collect()
    if not rows:
        return kind
    forms = ["^" + r["mask"].replace("x", "[0-9a-f]") + "$" for r in rows]
    found = kind
    for form, row in reversed(list(zip(forms, rows, strict=True))):
        found = F.when(F.rlike(tag, F.lit(form)), F.struct(*[F.lit(row[c]).cast(patterns.schema[c].dataType).alias(c) for c in others])).otherwise(found)
    return F.when(F.rlike(tag, F.lit("|".join(forms))), found)


def match_masks(tags: DataFrame, patterns: DataFrame) -> DataFrame:
    """(tag, ordinal and the patterns' other columns): the first mask in table order that a tag matches, once for each tag."""
    met = tags.select("tag").distinct().withColumn("m", first_mask(F.col("tag"), patterns))
    return met.filter("m IS NOT NULL").select("tag", "m.*")


def classify(attributes: DataFrame, profile: DataFrame, patterns: DataFrame) -> DataFrame:
    """The attributes that are findings, with ``kind`` (burned-in, private, annex-e) and ``action``.

    Burned-in annotation comes first, then private tags, then the profile: an exact row wins over a mask even if its
    action is null. What the profile does not list is no finding."""
    exact = profile.select("tag", F.col("action").alias("_action"), F.lit(True).alias("_exact"))
    joined = attributes.join(entries(exact), "tag", "left").withColumn("_mask", F.when(F.col("_exact").isNull(), first_mask(F.col("tag"), patterns.select("ordinal", "mask", "action"))))
    kind = F.when(F.col("tag") == BURNED_IN, "burned-in").when(is_private(F.col("tag")), "private").when(F.col("_exact") | F.col("_mask").isNotNull(), "annex-e")
    found = joined.withColumn("kind", kind).filter("kind IS NOT NULL")
    return found.select(*attributes.columns, "kind", F.when(F.col("kind") == "annex-e", F.coalesce("_action", "_mask.action")).alias("action"))


def field_kinds(tags: DataFrame, profile: DataFrame, patterns: DataFrame) -> dict[str, str]:
    """The kind of each of ``tags`` (tag) that is a finding; for fields that are columns of a table, so a row each."""
    return {r["tag"]: r["kind"] for r in classify(tags.select("tag"), profile, patterns).select("tag", "kind").collect()}


def name_fields(attributes: DataFrame, dictionary: DataFrame, patterns: DataFrame) -> DataFrame:
    """``attributes`` with ``name`` and ``listed_vr``: none for private tags, else those of the exact entry, the first mask, or "Group Length" and UL for element 0000."""
    exact = dictionary.select("tag", F.struct("name", "vr").alias("_exact"))
    joined = attributes.drop("name").join(entries(exact), "tag", "left")
    mask = first_mask(F.col("tag"), patterns.select("ordinal", "mask", "name", "vr"))
    group_length = F.when(F.endswith("tag", F.lit("0000")), F.struct(F.lit("Group Length").alias("name"), F.lit("UL").alias("vr")))
    entry = F.when(~is_private(F.col("tag")), F.coalesce("_exact", F.when(mask.isNotNull(), F.struct(mask["name"].alias("name"), mask["vr"].alias("vr"))), group_length))
    return joined.withColumn("_entry", entry).select(*[c for c in attributes.columns if c != "name"], F.col("_entry.name").alias("name"), F.col("_entry.vr").alias("listed_vr"))


def identifying(findings: DataFrame) -> DataFrame:
    """Findings that may identify; burned-in annotation is a statement about the image."""
    return findings.filter("kind <> 'burned-in'")
