"""Folders as streams: new files become rows as they arrive, and only what they touch is checked again.

A batch touches series identifiers. Findings are about a series within its study, or about one identifier under
several studies, so what a batch can change is all files of the identifiers that it touches, under any study: that
is closed, and is what is checked again. Instances and findings are kept by a hash of the identifier
(``store.KeyedStore``), of which a batch reads the parts that it touches. What concerns the whole folder is made of the
stored instances when it is asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import checks, classify, series
from ..sources.folder import stream_folder
from ..sources.scan import attributes, outcomes
from ..sources.scratch import written
from .store import PARTS, KeyedStore

INSTANCES = "file string, study string, series string, sop string, instance_number double, modality string, description string, orientation array<double>, position array<double>, spacing string, series_number string, malformed_geometry boolean"
FINDINGS = "file string, series string, path string, tag string, kind string, value string"
#: Finding rows of series; a row whose kind is null says that the identifier was checked.
CHECKS = checks.FINDING_FILES


def _key() -> Column:
    """Files without a series are dealt out by their own name."""
    return F.coalesce("series", "file")


class Watched:
    """The tables of a watched folder below ``out``."""

    def __init__(self, spark: SparkSession, out: str, parts: int = PARTS):
        self.spark, self.out = spark, out
        self.instances, self.findings, self.checks = (KeyedStore(spark, f"{out}/{n}", parts) for n in ("instances", "findings", "checks"))

    def add(self, rows: DataFrame, batch: int, profile: DataFrame, patterns: DataFrame) -> None:
        """Store the attributes of a batch's files, and check the series identifiers that it touches."""
        files = written(series.instances(rows), "instances")
        found = classify.classify(rows, profile, patterns).join(files.select("file", "series"), "file")
        self.instances.put(files, batch, _key())
        self.findings.put(found.select(*[f.split(" ")[0] for f in FINDINGS.split(", ")]), batch, _key())
        touched = written(files.select("series").filter("series IS NOT NULL").distinct().withColumn("part", self.instances.part(F.col("series"))), "touched")
        parts = [r[0] for r in touched.select("part").distinct().collect()]  # the store's parts at most
        self.checks.put(self.checked(touched.select("series"), parts), batch, F.col("series"))

    def checked(self, touched: DataFrame, parts: list[int]) -> DataFrame:
        """The finding rows of the identifiers in ``touched`` (series), which lie in ``parts``, and a row for each identifier."""
        files = self.instances.get(INSTANCES, parts).drop("batch").join(touched, "series", "left_semi")
        found = self.findings.get(FINDINGS, parts).drop("batch").join(touched, "series", "left_semi").drop("series")
        return recheck(files, found).unionByName(touched, allowMissingColumns=True)

    def latest(self) -> DataFrame:
        """All finding rows as they stand: those of each identifier from the last batch that touched it, and those of the whole folder."""
        rows = self.checks.get(CHECKS)
        return _last(rows).filter("kind IS NOT NULL").drop("batch").unionByName(checks.mixed_modality_folder(self.instances.get(INSTANCES).drop("batch")))

    def compact(self, most: int = 16) -> int:
        """Merge the folders of parts that have more than ``most``, and drop checks that later ones replace; between batches."""
        return self.instances.compact(INSTANCES, most, key=_key()) + self.findings.compact(FINDINGS, most, key=_key()) + self.checks.compact(CHECKS, most, _last, F.col("series"))


def _last(rows: DataFrame) -> DataFrame:
    """The rows of each identifier's last batch."""
    return rows.join(rows.groupBy("series").agg(F.max("batch").alias("batch")), ["series", "batch"], "left_semi")


def recheck(files: DataFrame, findings: DataFrame) -> DataFrame:
    """The finding rows about series of whole identifiers: of all their ``files`` (instances) under any study, and the files' ``findings``."""
    ordered = written(series.order_series(files), "touched-series")
    return checks.check_series(files, ordered, findings).filter(F.col("scope") == "series")


def watch_folder(spark: SparkSession, root: str, out: str, profile: DataFrame, patterns: DataFrame, vrs: dict[str, str] | None = None, after: Callable[[DataFrame, int], None] | None = None, once: bool = True, parts: int = PARTS, compact_every: int = 64) -> StreamingQuery:
    """Append outcomes, attributes, findings and instances of new files below ``root`` to tables below ``out``, and check again what each batch touches. No state but the lists of files seen.

    A batch that is run again after a failure takes the files that it has read before, and replaces its own folders; with
    ``once``, a run that makes up for a failed batch ends with it, and the next one goes on. ``after`` gets the batch's attributes. Every ``compact_every`` batches the tables are compacted."""
    tables = Watched(spark, out, parts)
    files = spark._jvm.org.apache.hadoop.fs

    def store(batch: DataFrame, batch_id: int) -> None:
        part = f"batch={batch_id}"
        put = lambda rows, name: rows.write.mode("overwrite").parquet(f"{out}/{name}/{part}")
        done = files.Path(f"{out}/scanned/{part}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            put(batch, "scanned")  # files are read once
        scanned = spark.read.schema(batch.schema).parquet(f"{out}/scanned/{part}")
        put(outcomes(scanned), "outcomes")
        put(attributes(scanned), "attributes")
        rows = spark.read.parquet(f"{out}/attributes/{part}")
        tables.add(rows, batch_id, profile, patterns)
        if after is not None:
            after(rows, batch_id)
        if compact_every and batch_id % compact_every == compact_every - 1:
            tables.compact()

    writer = stream_folder(spark, root, f"{out}/_log", vrs).writeStream.foreachBatch(store).option("checkpointLocation", f"{out}/_checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_checks(spark: SparkSession, out: str, parts: int = PARTS) -> DataFrame:
    """The finding rows of a watched folder as they stand, the same as those of one audit of all its files."""
    return Watched(spark, out, parts).latest()
