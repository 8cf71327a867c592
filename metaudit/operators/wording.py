"""Findings as sentences. The wording is fixed, as reports are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.display import either, field_name, filled, format_mm, plural
from .classify import entries

#: The sentence of each kind of finding; each ``{}`` is filled in.
SENTENCES = {
    "varying-value": "{} is not the same on every file",
    "extra-field": "{} appears on {} of {} files only",
    "position-gap": "A slice may be missing — {} mm between two slices where {} mm is expected",
    "duplicate-position": "Two slices occupy the same position",
    "inconsistent-pixel-spacing": "{} {} different pixel dimensions from the rest",
    "inconsistent-orientation": "Slices in this series are not all in the same plane",
    "inconsistent-identifier": "Slices in this series belong to different studies",
    "mixed-modality, folder": "This folder holds more than one kind of scan — {}",
    "mixed-modality, series": "This series contains {} from a different kind of scan — {} among {}",
}


def finding_words(facts: DataFrame) -> DataFrame:
    """``facts`` (one row a finding) with ``text``. Uses kind, scope, name (of the field), n_files, n_series_files, expected, actual and ``kinds``: the modalities and their numbers of files as an array of (n, modality), most frequent first."""
    c = F.col
    rest = F.slice("kinds", 2, 1_000_000)
    names = lambda a: F.transform(a, lambda k: k["modality"])
    others = F.aggregate(rest, F.lit(0).cast("bigint"), lambda a, k: a + k["n"])
    counted = F.array_join(F.transform("kinds", lambda k: F.concat(k["modality"], F.lit(" ("), plural(k["n"], "file"), F.lit(")"))), ", ")
    parts = {
        "varying-value": [c("name")],
        "extra-field": [c("name"), c("n_files").cast("string"), c("n_series_files").cast("string")],
        "position-gap": [format_mm(c("actual")), format_mm(c("expected"))],
        "inconsistent-pixel-spacing": [plural(c("n_files"), "file"), either(c("n_files") == 1, "has", "have")],
        "mixed-modality, folder": [counted],
        "mixed-modality, series": [plural(others, "file"), F.array_join(names(rest), " and "), F.get("kinds", F.lit(0))["modality"]],
    }
    mixed = F.concat(F.lit("mixed-modality, "), either(c("scope") == "folder", "folder", "series"))
    sentence = F.when(c("kind") == "mixed-modality", mixed).otherwise(c("kind"))
    words = F.coalesce(*[F.when(sentence == kind, filled(text, *parts.get(kind, []))) for kind, text in SENTENCES.items()])
    return facts.withColumn("text", words)


def finding_facts(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Finding-file rows as one row a finding with what ``finding_words`` needs. ``names`` has (tag, name).

    Findings are grouped by what tells them apart, so rows that lie by series stay where they are."""
    from .checks import FINDING_KEY

    facts = ("expected", "actual", "n_series_files")
    per_value = rows.groupBy(*FINDING_KEY, F.when(F.col("kind") == "mixed-modality", F.col("value")).alias("modality")).agg(*[F.max(c).alias(c) for c in facts], F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "modality", "n")))
    one = per_value.groupBy(*FINDING_KEY).agg(*[F.max(c).alias(c) for c in facts], F.sum("n").alias("n_files"), ordered.alias("kinds"))
    return named(one, names)


def named(facts: DataFrame, names: DataFrame) -> DataFrame:
    """Facts with ``name``, that of their tag."""
    met = facts.join(entries(names.select("tag", F.col("name").alias("_name"))), "tag", "left")
    return met.withColumn("name", field_name(F.col("_name"), F.col("tag"))).drop("_name")
