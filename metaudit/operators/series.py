"""Files as instances, grouped into studies and series and ordered within a series.

All windows are by study and series: one exchange serves the ladder and the ordinals. Series that are too large
for a task are sorted in parts (``ranking``). Where the order of input rows would decide, the file key does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import number, numbers, orientations_agree, project, slice_normal
from ..sources.scratch import written
from .ranking import SUM, carried, sorted_parts

#: Top-level tags of the instance view.
INSTANCE_TAGS = {
    "study": "0020000d",
    "series": "0020000e",
    "sop": "00080018",
    "instance_number": "00200013",
    "modality": "00080060",
    "description": "0008103e",
    "orientation": "00200037",
    "position": "00200032",
    "spacing": "00280030",
    "series_number": "00200011",
}


def top_level(attributes: DataFrame, tags: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """One row for every file with the top-level values of ``tags`` as columns; of a tag that repeats the last value counts. ``keys`` are columns that all rows of a file share: attributes that lie by one of them stay where they are."""
    is_ = lambda t: (F.col("depth") == 0) & (F.col("tag") == t)
    return attributes.groupBy(*keys, "file").agg(*[F.max_by(F.when(is_(t), F.col("value")), F.when(is_(t), F.col("pos"))).alias(c) for c, t in tags.items()]).drop(*keys)


def keyed(scanned: DataFrame) -> DataFrame:
    """Scanned files (with ``attributes``, an array) with ``study`` and ``series``, so that their attribute rows need not be joined with them."""
    value = lambda tag: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter("attributes", lambda a: (a["depth"] == 0) & (a["tag"] == tag)), lambda a: a["value"])), -1)
    return scanned.withColumns({"study": value(INSTANCE_TAGS["study"]), "series": value(INSTANCE_TAGS["series"])})


def instances(attributes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The instance view: a row for every file of ``attributes``, numbers parsed. Geometry with a wrong number of readable values counts as absent and sets ``malformed_geometry``. ``keys`` are those of ``top_level``."""
    wide = top_level(attributes, INSTANCE_TAGS, keys)
    orientation, position = numbers(F.col("orientation"), 6), numbers(F.col("position"), 3)
    malformed = (F.col("orientation").isNotNull() & orientation.isNull()) | (F.col("position").isNotNull() & position.isNull())
    return wide.select(
        "file", "study", "series", "sop", number(F.col("instance_number")).alias("instance_number"), "modality", "description",
        orientation.alias("orientation"), position.alias("position"), "spacing", "series_number", malformed.alias("malformed_geometry"),
    )


def ungrouped_reason(study: Column, series: Column) -> Column:
    """Why a file belongs to no series, or null. An empty identifier is present."""
    return F.when(study.isNull() & series.isNull(), "missing-both").when(study.isNull(), "missing-study").when(series.isNull(), "missing-series")


def ungrouped(files: DataFrame) -> DataFrame:
    """(file, reason) of the files without a study or series."""
    return files.select("file", ungrouped_reason(F.col("study"), F.col("series")).alias("reason")).filter("reason IS NOT NULL")


#: Files of a series above which its places are worked out in parts instead of by a window.
HOT_FILES = 1_000_000


def order_series(files: DataFrame, hot_files: int = HOT_FILES) -> DataFrame:
    """The grouped files with ``ordered_by``, ``orientation_consistent``, ``distance``, ``n_files`` of the series and ``ordinal`` (from 0).

    By distance along the normal if the orientations agree and every file has geometry; else by instance number
    if every file has one; else by file. Columns of ``files`` that the ladder does not need pass through. Series of
    more than ``hot_files`` files, which are counted first, are sorted by many tasks; their rows are the same."""
    grouped = files.filter("study IS NOT NULL AND series IS NOT NULL")
    large = grouped.groupBy("study", "series").agg(F.count("*").alias("n")).filter(F.col("n") > hot_files).select("study", "series")
    large = written(large, "large-series")
    if large.isEmpty():
        return _by_windows(grouped)
    return _by_windows(grouped.join(large, ["study", "series"], "left_anti")).unionByName(_by_parts(grouped.join(large, ["study", "series"], "left_semi")))


def _has_geometry() -> Column:
    return F.col("orientation").isNotNull() & F.col("position").isNotNull()


def _first_orientation() -> Column:
    return F.min_by("orientation", F.when(F.col("orientation").isNotNull(), F.col("file")))


def _agrees() -> Column:
    return F.bool_and(F.coalesce(orientations_agree(F.col("orientation"), F.col("_first")), F.lit(True)))


def _placed(ladder: DataFrame) -> DataFrame:
    """``ordered_by`` and ``distance`` from what the ladder found out about the series."""
    by = F.when(F.col("orientation_consistent") & F.col("_geometry") & F.col("_normal").isNotNull(), "position").when(F.col("_numbered"), "instance-number").otherwise("filename")
    return ladder.withColumn("ordered_by", by).withColumn("distance", F.when(F.col("ordered_by") == "position", project(F.col("position"), F.col("_normal"))))


def _by_windows(files: DataFrame) -> DataFrame:
    """One exchange serves the ladder and the ordinals."""
    group = Window.partitionBy("study", "series")
    ladder = files.withColumn("_first", _first_orientation().over(group)).withColumns(
        {
            "orientation_consistent": _agrees().over(group),
            "_normal": slice_normal(F.col("_first")),
            "_geometry": F.bool_and(_has_geometry()).over(group),
            "n_files": F.count("*").over(group),
            "_numbered": F.bool_and(F.col("instance_number").isNotNull()).over(group),
        }
    )
    return with_ordinal(_placed(ladder)).drop("_first", "_normal", "_geometry", "_numbered")


def _by_parts(files: DataFrame) -> DataFrame:
    """The same for series of any size: aggregates instead of windows, and ordinals that are carried from part to part."""
    keys = ["study", "series"]
    about = files.groupBy(*keys).agg(_first_orientation().alias("_first"), F.bool_and(_has_geometry()).alias("_geometry"), F.count("*").alias("n_files"), F.bool_and(F.col("instance_number").isNotNull()).alias("_numbered"))
    about = written(about, "large-about")
    agree = files.join(about.select(*keys, "_first"), keys).groupBy(*keys).agg(_agrees().alias("orientation_consistent"))
    ladder = files.join(about.join(agree, keys), keys).withColumn("_normal", slice_normal(F.col("_first")))
    parts = sorted_parts(_placed(ladder).withColumn("_key", order_key()), keys, ["_key", "file"], "large-parts")
    ranked = carried(parts, keys, {"ordinal": (F.lit(1), SUM)}).withColumn("ordinal", (F.col("ordinal") - 1).cast("int"))
    return ranked.drop("_first", "_normal", "_geometry", "_numbered", "_key", "_part", "_at")


def order_key() -> Column:
    """What a series is sorted by before the file, by its ``ordered_by``."""
    return F.when(F.col("ordered_by") == "position", F.col("distance")).when(F.col("ordered_by") == "instance-number", F.col("instance_number"))


def with_ordinal(placed: DataFrame) -> DataFrame:
    """``ordinal`` (from 0) within a series by the key that ``ordered_by`` names, then the file."""
    return placed.withColumn("ordinal", F.row_number().over(Window.partitionBy("study", "series").orderBy(order_key(), "file")) - 1)


def most_common(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value): the most frequent value of each group, the smallest of equally frequent ones; null if there is none. Two-step counts, so a group is never gathered."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = F.min_by(value, F.when(F.col(value).isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))))
    return counts.groupBy(*keys).agg(best.alias(value))


def declared_numbers(ordered: DataFrame) -> DataFrame:
    """(study, series, series_number): of ``series_table`` what labels need."""
    return ordered.groupBy("study", "series").agg(_declared_number())


def _declared_number() -> Column:
    return F.min_by("series_number", F.when(F.col("series_number").isNotNull(), F.col("ordinal"))).alias("series_number")


def series_table(ordered: DataFrame) -> DataFrame:
    """One row a series: size, how it is ordered, its most common modality and description, and the number declared by its first file that has one."""
    keys = ["study", "series"]
    base = ordered.groupBy(*keys).agg(F.count("*").alias("n_files"), F.first("ordered_by").alias("ordered_by"), F.first("orientation_consistent").alias("orientation_consistent"), _declared_number())
    return base.join(most_common(ordered, keys, "modality"), keys).join(most_common(ordered, keys, "description"), keys)
