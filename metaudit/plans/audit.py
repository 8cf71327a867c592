"""A whole audit: from a folder of files, or from stored attribute rows, to findings, checks and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, classify, series, summary
from ..sources import scan as scanning
from ..sources.folder import read_folder
from ..sources.scratch import written


@dataclass
class Audit:
    """The tables of an audit. ``findings`` have names and actions, ``finding_files`` one row for each file of each series finding."""

    outcomes: DataFrame
    attributes: DataFrame
    findings: DataFrame
    files: DataFrame
    ordered: DataFrame
    series: DataFrame
    finding_files: DataFrame
    names: DataFrame

    def fields(self) -> DataFrame:
        total = self.files.count()
        return summary.field_summary(self.findings, F.lit(total))


def audit_rows(outcomes: DataFrame, attributes: DataFrame, profile: DataFrame, patterns: DataFrame, dictionary: DataFrame, dictionary_patterns: DataFrame) -> Audit:
    """An audit of attribute rows; they are written once, named, and everything else reads them."""
    named = written(classify.name_fields(attributes, dictionary, dictionary_patterns), "attributes")
    findings = classify.classify(named, profile, patterns)
    files = series.instances(named)
    ordered = written(series.order_series(files), "ordered")
    rows = written(checks.check_series(files, ordered, findings), "finding-files")
    return Audit(outcomes, named, findings, files, ordered, series.series_table(ordered), rows, named.select("tag", "name").distinct())


def audit_folder(spark: SparkSession, root: str, profile: DataFrame, patterns: DataFrame, dictionary: DataFrame, dictionary_patterns: DataFrame) -> Audit:
    """An audit of all files below ``root``. The VRs of implicit files come from the dictionary, a table of a few thousand rows."""
    vrs = {r["tag"]: r["vr"].split(" or ")[0] for r in dictionary.filter("vr IS NOT NULL").select("tag", "vr").collect()}
    scanned = written(series.keyed(read_folder(spark, root, vrs)), "scanned")  # files are read once
    return audit_rows(scanning.outcomes(scanned), scanning.attributes(scanned), profile, patterns, dictionary, dictionary_patterns)


#: Series that a part of the sorted list holds.
PART_SERIES = 1 << 15


def series_labels(series_rows: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """(study, series, position, label): the declared number, or else the position in the sorted list. Columns ``kept`` go along.

    Positions come from counts of sorted partitions, not from a window over all series."""
    parts = max(series_rows.sparkSession.sparkContext.defaultParallelism, -(-series_rows.count() // PART_SERIES)) if kept else None
    placed = series_rows.select("study", "series", "series_number", *kept)
    placed = placed.orderBy("study", "series") if parts is None else placed.repartitionByRange(parts, "study", "series").sortWithinPartitions("study", "series")
    placed = written(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "labels")
    counts = placed.groupBy("_part").count()
    before = counts.alias("a").join(counts.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy(F.col("a._part").alias("_part")).agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("_before"))  # a row a partition
    position = F.col("_before") + F.col("_at") + 1
    return placed.join(F.broadcast(before), "_part").select("study", "series", position.alias("position"), F.coalesce("series_number", position.cast("string")).alias("label"), *kept)
