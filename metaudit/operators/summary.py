"""Summaries over files and findings. Lists of files stay rows; arrays are made in the report only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import either, filled, plural
from .checks import IDENTIFYING_KINDS
from .classify import identifying


def field_values(findings: DataFrame) -> DataFrame:
    """(path, value, vr, length, n_files): the distinct values of each identifying path; null and empty are values of their own."""
    return identifying(findings).groupBy("path", "value").agg(F.min("vr").alias("vr"), F.min("length").alias("length"), F.count("*").alias("n_files"))


def field_summary(findings: DataFrame, total: Column) -> DataFrame:
    """(path, tag, name, action, kind, present_in, total, n_values): the union of identifying fields over all files, by path."""
    firsts = [F.min(c).alias(c) for c in ("tag", "name", "action", "kind")]
    per_value = identifying(findings).groupBy("path", "value").agg(F.count("*").alias("n"), *firsts)
    merged = per_value.groupBy("path").agg(*firsts, F.sum("n").alias("present_in"), F.count("*").alias("n_values"))
    return merged.select("path", "tag", "name", "action", "kind", "present_in", total.cast("bigint").alias("total"), "n_values")


def numbered(findings: DataFrame) -> DataFrame:
    """``findings`` with ``place``: the number of each within its file by path."""
    return findings.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("path")))


def burned_in_values(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(value, n): how many files declare each burned-in value (first path of a file); null for files that do not carry the field."""
    declared = findings.filter("kind = 'burned-in'").groupBy("file").agg(F.coalesce(F.min_by("value", "path"), F.lit("")).alias("value"))
    return files.select("file").join(declared, "file", "left").groupBy("value").agg(F.count("*").alias("n"))


#: Values that the sentence on burned-in annotation names at most; ``burned_in_values`` has all of them as rows.
NAMED_VALUES = 100

#: The sentences on burned-in annotation; each ``{}`` is filled in.
BURNED_IN = {
    "none": "No file declares burned-in annotation.",
    "every": "All {} {} burned-in annotation: {}",
    "listed": "Burned-in annotation: {}{}",
    "clause": "{} {} {}",
    "absent": "; {} {} not carry the field",
}
#: The lines of the headline.
HEADLINE = (
    "{} read across {} series",
    "{} could identify a patient",
    "{} identifying field{} not the same on every file",
    "{} structural inconsistenc{} between files",
)


def burned_in_text(counts: DataFrame, most: int = NAMED_VALUES) -> DataFrame:
    """One row, (text): the counts in a sentence, most frequent value first. Beyond ``most`` values it says how many more there are, in how many files.

    The wording is fixed, as reports are compared."""
    value, n = F.col("value"), F.col("n")
    first = counts.filter("value IS NOT NULL").orderBy(-n, value).limit(most).agg(F.array_sort(F.collect_list(F.struct((-n).alias("k"), "value", "n"))).alias("v"))
    total = counts.agg(F.coalesce(F.sum(F.when(value.isNull(), n)), F.lit(0)).alias("absent"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("value").alias("values"), F.coalesce(F.sum(F.when(value.isNotNull(), n)), F.lit(0)).alias("declared"))
    one = total.crossJoin(first)  # one row each
    verb = lambda n: either(n == 1, "declares", "declare")
    clause = lambda x, i: filled(BURNED_IN["clause"], F.when(i == 0, plural(x["n"], "file")).otherwise(x["n"].cast("string")), verb(x["n"]), x["value"])
    rest = F.col("declared") - F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    more = F.when(F.col("values") > most, filled(", {} {} one of {}", rest.cast("string"), verb(rest), plural(F.col("values") - most, "other value"))).otherwise(F.lit(""))
    absent = F.when(F.col("absent") > 0, filled(BURNED_IN["absent"], F.col("absent").cast("string"), either(F.col("absent") == 1, "does", "do"))).otherwise(F.lit(""))
    listed = filled(BURNED_IN["listed"], F.array_join(F.transform("v", clause), ", "), F.concat(more, absent))
    every = filled(BURNED_IN["every"], plural(F.col("total"), "file"), verb(F.col("total")), F.get("v", F.lit(0))["value"])
    return one.select(F.when(F.col("values") == 0, F.lit(BURNED_IN["none"])).when((F.col("values") == 1) & (F.col("absent") == 0), every).otherwise(listed).alias("text"))


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    """One row: files selected, read, skipped as not DICOM or as a directory file, and failed."""
    is_ = lambda o, r=None: F.count_if((F.col("outcome") == o) & (F.lit(True) if r is None else F.col("reason") == r))
    return outcomes.agg(F.count("*").alias("selected"), is_("read").alias("read"), is_("skipped", "not-dicom").alias("not_dicom"), is_("skipped", "dicomdir").alias("dicomdir"), is_("failed").alias("failed"))


def file_summary(attributes: DataFrame, findings: DataFrame) -> DataFrame:
    """One row a file: fields at all depths, identifying findings by kind, and whether burned-in annotation is declared."""
    fields = attributes.groupBy("file").agg(F.count("*").alias("fields"))
    kind = lambda k: F.count_if(F.col("kind") == k)
    found = findings.groupBy("file").agg(kind("annex-e").alias("annex_e"), kind("private").alias("private"), kind("burned-in").alias("burned_in"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return fields.join(found, "file", "left").select("file", "fields", *[zero(c) for c in ("annex_e", "private", "burned_in")], (F.coalesce("annex_e", F.lit(0)) + F.coalesce("private", F.lit(0))).alias("identifying"))


def finding_counts(rows: DataFrame) -> DataFrame:
    """One row from finding-file rows: how many findings concern identifying fields, and how many are structural."""
    found = rows.select("check_no", "kind", "scope", "study", "series", "path", "tag", "item").distinct()
    known = F.col("kind").isin(*IDENTIFYING_KINDS)
    return found.agg(F.count_if(known).alias("not_consistent"), F.count_if(~known).alias("structural"))


def headline(counts: DataFrame) -> DataFrame:
    """(line_no, text) from one row (files, series, fields, not_consistent, structural); the last two lines only where they say something. The wording is fixed."""
    c = F.col
    texts = (
        filled(HEADLINE[0], plural(c("files"), "file"), c("series").cast("string")),
        filled(HEADLINE[1], plural(c("fields"), "field")),
        F.when(c("not_consistent") > 0, filled(HEADLINE[2], c("not_consistent").cast("string"), either(c("not_consistent") == 1, " is", "s are"))),
        F.when(c("structural") > 0, filled(HEADLINE[3], c("structural").cast("string"), either(c("structural") == 1, "y", "ies"))),
    )
    lines = F.array(*[F.struct(F.lit(k).alias("line_no"), text.alias("text")) for k, text in enumerate(texts, 1)])
    return counts.select(F.explode(lines).alias("l")).select("l.*").filter("text IS NOT NULL")


def folder_name(files: DataFrame) -> DataFrame:
    """One row, (folder): the first segment that all relative paths share, else null."""
    slash = F.locate("/", F.col("relative_path"))
    root = F.when(slash > 0, F.substring_index("relative_path", "/", 1))
    return files.select(root.alias("root")).agg(F.when((F.count("*") == F.count("root")) & (F.min("root") == F.max("root")), F.min("root")).alias("folder"))
