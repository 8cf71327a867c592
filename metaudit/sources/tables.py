"""Reference tables: the confidentiality profile, the dictionary and the transfer syntaxes, with their quality checks.

The standards' tables are inputs of the user; nothing of them is kept here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import NORMAL

#: Syntax of a mask and of an action, and the columns of actions that a profile must have.
MASK = "^[0-9a-fx]{8}$"
ACTION = r"^[XZDKCU](/[XZDKCU])*\*?$"
ACTION_COLUMNS = 11
#: Masks that the profile's pattern rows must hold, besides one row for odd groups.
PROFILE_MASKS = ("50xxxxxx", "60xx3000", "60xx4000")

_ATTRIBUTES = "array<struct<tag: string, name: string, retired: boolean, inStandardCompositeIod: boolean, actions: map<string,string>>>"
_PATTERNS = "array<struct<tagPattern: string, match: string, mask: string, name: string, retired: boolean, inStandardCompositeIod: boolean, actions: map<string,string>>>"


def load_profile(spark: SparkSession, path: str, column: str = "basic") -> tuple[DataFrame, DataFrame]:
    """(profile, patterns) from the profile's JSON file; ``action`` is the action of one column of the table."""
    raw = spark.read.schema(f"source struct<edition: string>, attributes {_ATTRIBUTES}, patterns {_PATTERNS}").json(path, multiLine=True)
    profile = raw.select("source.edition", F.explode("attributes").alias("a")).select("edition", "a.*").withColumn("action", F.col("actions")[column])
    patterns = raw.select("source.edition", F.posexplode("patterns").alias("ordinal", "p")).select("edition", "ordinal", "p.*").withColumn("action", F.col("actions")[column])
    return profile, patterns


def load_dictionary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(dictionary, patterns) from the dictionary's JSON file, whose attributes are keyed by tag."""
    raw = spark.read.schema("source struct<edition: string>, attributes map<string,struct<name: string, vr: string>>, patterns array<struct<tagPattern: string, mask: string, name: string, vr: string>>").json(path, multiLine=True)
    entries = raw.select("source.edition", F.explode("attributes").alias("tag", "a")).select("edition", "tag", "a.*")
    return entries, raw.select("source.edition", F.posexplode("patterns").alias("ordinal", "p")).select("edition", "ordinal", "p.*")


def load_transfer_syntaxes(spark: SparkSession, path: str) -> DataFrame:
    """(uid, name) from a JSON object of names by identifier."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("uid", "name"))


def _violations(rows: DataFrame, subject: str, **rules) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return rows.select(F.col(subject).cast("string").alias("subject"), F.explode(found).alias("violation"))


def _repeats(rows: DataFrame, subject: str) -> DataFrame:
    return rows.groupBy(F.col(subject).cast("string").alias("subject")).count().filter("count > 1").select("subject", F.lit("occurs more than once").alias("violation"))


def validate_profile(profile: DataFrame, patterns: DataFrame, columns: int = ACTION_COLUMNS) -> DataFrame:
    """(subject, violation): tag and mask syntax, known match kinds, repeated tags, action grammar, number of action columns, missing pattern rows."""
    grammar = F.forall(F.map_values("actions"), lambda a: a.isNull() | F.rlike(a, F.lit(ACTION)))
    parts = [
        _violations(profile, "tag", **{"tag is not normalised": F.rlike("tag", F.lit(NORMAL)), "has an empty name": F.coalesce(F.col("name"), F.lit("")) != "", "has an unknown action": grammar, "has not all action columns": F.size("actions") == columns}),
        _violations(patterns, "tagPattern", **{"unknown match": F.col("match").isin("nibbleMask", "oddGroup"), "invalid mask": (F.col("match") != "nibbleMask") | F.rlike("mask", F.lit(MASK)), "has an unknown action": grammar}),
        _repeats(profile, "tag"),
        _repeats(patterns, "tagPattern"),
    ]
    present = patterns.agg(F.collect_set("mask").alias("m"), F.count_if(F.col("match") == "oddGroup").alias("odd"))  # a few pattern rows
    wanted = F.array(*[F.struct(F.lit(m).alias("subject"), F.array_contains("m", m).alias("there")) for m in PROFILE_MASKS], F.struct(F.lit("oddGroup").alias("subject"), (F.col("odd") > 0).alias("there")))
    parts.append(present.select(F.explode(wanted).alias("w")).filter("NOT w.there").select("w.subject", F.lit("pattern row is missing").alias("violation")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def validate_dictionary(dictionary: DataFrame, patterns: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """(subject, violation): tag and mask syntax, repeats, and an edition other than the profile's."""
    found = _violations(dictionary, "tag", **{"tag is not normalised": F.rlike("tag", F.lit(NORMAL))}).unionByName(_violations(patterns, "mask", **{"invalid mask": F.rlike("mask", F.lit(MASK))}))
    found = found.unionByName(_repeats(dictionary, "tag"))
    if profile is not None:
        editions = dictionary.select(F.col("edition").alias("subject")).distinct().join(profile.select(F.col("edition").alias("subject")).distinct(), "subject", "left_anti")
        found = found.unionByName(editions.select("subject", F.lit("edition differs from the profile's").alias("violation")))
    return found
