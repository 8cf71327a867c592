"""Exact deduplication with streaming state (native: DataFrame functions only).

The digests of the arriving rows are read as a stream. A streaming aggregation keeps, for each digest and
without expiry, how often it came and which row stays (smallest identifier, with the locator of its
content), in RocksDB on the executors' disks; the checkpoints lie in the shared folder, in a folder of the
caller's that later calls go on with, or one of a single call. Digests that came more than once are hits: the
full bytes of their rows, found by the locators, are compared, and rows of one digest with different bytes
are grouped by their text instead. Texts of other rows are not shuffled.

Defined results: a null text is the empty text; the row with the smallest id stays, rows with a null id
come last, and equal ids are told apart by their locator, so of rows that repeat wholly exactly one is
kept; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, among, conf_set, drop_path, located, materialise, new_path, packed, text_or_empty, without

#: Bounded memory for all state stores of an executor; the state itself is on disk.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # open stores would hold memory and disk between batches
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


_KEEPER = "struct<no_id: boolean, doc_id: bigint, at: struct<file: string, row: bigint>>"


def track_digests(spark: SparkSession, arrivals: DataFrame, checkpoint: str, max_bytes_per_trigger: int = 64 << 30, root: str | None = None) -> DataFrame:
    """Run the stateful stream over the table ``arrivals`` (doc_id, at, digest), or all such below ``root``, as far as it goes; returns (digest, n, keeper).

    A later call with the same checkpoint takes up the state and reads only files that are new."""
    stream = spark.readStream.schema(arrivals.schema).option("maxBytesPerTrigger", max_bytes_per_trigger).option("recursiveFileLookup", "true").parquet(root or arrivals.inputFiles()[0].rpartition("/")[0])
    keeper = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")
    state = stream.groupBy("digest").agg(F.count("*").alias("n"), F.min(keeper).alias("keeper"))

    def changed(batch: DataFrame, batch_id: int) -> None:  # a batch that is run again replaces its own folder
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{checkpoint}/changes/batch={batch_id}")

    with conf_set(spark, STATE_CONF):
        run = state.writeStream.outputMode("update").option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).foreachBatch(changed).start()
        run.awaitTermination()
    return _changes(spark, checkpoint).groupBy("digest").agg(F.max("n").alias("n"), F.min("keeper").alias("keeper"))  # counts only grow, keepers only fall


def _changes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(digest, n, keeper) after each batch that changed a digest's state."""
    return spark.read.schema(f"digest binary, n bigint, keeper {_KEEPER}").option("recursiveFileLookup", "true").parquet(f"{checkpoint}/changes")


def _once(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` written to a path, unless an earlier try has done so; read back."""
    spark = rows.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _locator() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at")


def _call(docs: DataFrame, digest) -> str:
    """A name for the rows of a call, by their ids and texts."""
    h = F.xxhash64(F.col("doc_id").cast("long"), digest(normalised(text_or_empty())))
    n, first, second = docs.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64(h, F.lit(1)).cast("decimal(38,0)"))).first()
    return uuid.uuid5(uuid.NAMESPACE_OID, f"{n} {first} {second}").hex


def _earlier(spark: SparkSession, checkpoint: str, hits: DataFrame) -> DataFrame:
    """(doc_id, at, digest, bytes) of the rows of earlier calls that were kept under a digest of the hits, from the checkpoint's own tables."""
    kept = _changes(spark, checkpoint).join(hits.select("digest").distinct(), "digest").select("digest", "keeper.doc_id", "keeper.at").distinct()
    kept = materialise(kept.join(hits.select("at"), "at", "left_anti"), "earlier")
    rows = spark.read.schema("row struct<text: string>").option("recursiveFileLookup", "true").parquet(f"{checkpoint}/rows")
    return among(rows.select(_locator(), normalised(text_or_empty("row.text")).alias("bytes")), kept).select("doc_id", "at", "digest", "bytes")


def _find(base: DataFrame, digest, checkpoint: str | None = None, call: str = "") -> DataFrame:
    """``find_copies`` of located rows. With a checkpoint they lie below it, and ``call`` names them."""
    spark = base.sparkSession
    folder, call = checkpoint or new_path(spark, "exact-dedup"), call or uuid.uuid4().hex
    rows = base.select(F.col("row.doc_id").cast("long").alias("doc_id"), "at", digest(normalised(text_or_empty("row.text"))).alias("digest"), F.lit(call).alias("call"))
    # A call that is repeated after a failure finds its arrivals where the stream may have read them already.
    arrivals = _once(rows, f"{folder}/arrivals/{call}").drop("call")
    if arrivals.isEmpty():
        return _decided(arrivals.withColumns({"n": F.lit(0).cast("long"), "keeper": F.lit(None).cast(_KEEPER)}))
    groups = materialise(track_digests(spark, rows, folder, root=f"{folder}/arrivals"), "groups")  # so that Spark can split a hot digest of the join
    decided = materialise(_decided(arrivals.join(groups, "digest")), "decided")

    # Full bytes of all hits, and of no other row: equal texts of a digest have an equal least and greatest text.
    hits = decided.filter("group_size > 1").select("doc_id", "digest", "at")
    text = normalised(text_or_empty())
    compared = among(base.select(F.col("row.text").alias("text"), "at").select("at", text.alias("bytes")), hits)
    if checkpoint is None:
        drop_path(spark, folder)
    else:
        compared = compared.select("doc_id", "at", "digest", "bytes").unionByName(_earlier(spark, folder, hits))
    differ = compared.groupBy("digest").agg((F.min("bytes") != F.max("bytes")).alias("differ")).filter("differ").select("digest")
    differ = materialise(differ, "collisions")
    if differ.isEmpty():
        return decided
    keeper = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")
    clashing = compared.join(differ, "digest", "left_semi")
    by_text = clashing.groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.min(keeper).alias("keeper"))
    parted = _decided(clashing.join(hits.select("at"), "at", "left_semi").join(by_text, ["digest", "bytes"]))
    return decided.join(differ, "digest", "left_anti").unionByName(parted)


def _base(docs: DataFrame, digest, checkpoint: str | None, batch: str | None) -> tuple[DataFrame, str]:
    """The located rows of a call, and its name. With a checkpoint they are copied below it, once, so that later calls need nothing else."""
    if checkpoint is None:
        return located(docs), ""
    call = batch or _call(docs, digest)
    return _once(docs.select(packed(docs.columns).alias("row")), f"{checkpoint}/rows/{call}").select("row", _locator()), call


def find_copies(docs: DataFrame, digest=sha256_digest, checkpoint: str | None = None, batch: str | None = None) -> DataFrame:
    """(doc_id, at, digest, keep_id, group_size, kept), one row for each row of ``docs``. ``at`` is the row's locator.

    With a ``checkpoint``, a folder that all executors share, the state is kept there: a later call with it takes
    its rows for new ones and decides them beside all rows of earlier calls, of which the checkpoint holds copies.
    A call whose rows have the ids and texts of an earlier one's is a repeat of it, say after a failure, and counts no row
    twice; ``batch``, a name for the call, tells them apart instead. The state has as many partitions as
    spark.sql.shuffle.partitions says at the first call. Without a checkpoint the state is dropped in the end. Texts that
    differ under one digest are told apart within a call and from the rows kept before."""
    base, call = _base(docs, digest, checkpoint, batch)
    return _find(base, digest, checkpoint, call)


def _decided(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "at", "digest", F.col("keeper.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("keeper.at")).alias("kept"))


def drop_copies(docs: DataFrame, digest=sha256_digest, checkpoint: str | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay."""
    base, call = _base(docs, digest, checkpoint, batch)
    return without(base, _find(base, digest, checkpoint, call).filter("NOT kept").select("at")).select("row.*")


def query(spark, sf_dir):
    found = find_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM d"""
