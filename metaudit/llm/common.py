"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it, and what lies between (Java regular expressions).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Tables of keys up to so many rows are sent to every task; larger ones are joined by a shuffle.
SMALL_ROWS = 20_000

_own_folders: dict[str, str] = {}
_stored: dict[str, list[str]] = {}


@contextmanager
def conf_set(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is made, which only a local session can use.
    """
    conf = spark.sparkContext.getConf()
    if root := conf.get("spark.checkpoint.dir"):
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="spark-metaudit-")
    return _own_folders[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/metaudit/{uuid.uuid4().hex}-{label}"


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    _stored.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(spark: SparkSession) -> frozenset[str]:
    """The paths of the tables that ``materialise`` has written in this application and that are still there."""
    return frozenset(_stored.get(spark.sparkContext.applicationId, []))


def drop_stored(spark: SparkSession, before: frozenset[str], keep: Sequence[DataFrame] = ()) -> None:
    """Delete the tables written since ``before = stored(spark)``, but for those that ``keep`` reads. For callers that have stored their results."""
    own = _stored.get(spark.sparkContext.applicationId, [])
    read = {f.rpartition("/")[0].rpartition("/metaudit/")[2] for df in keep for f in df.inputFiles()}
    for path in [p for p in own if p not in before and p.rpartition("/metaudit/")[2] not in read]:
        drop_path(spark, path)
        own.remove(path)


def named(column: str) -> Column:
    """A column by its name as it is, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(columns: Sequence[str]) -> Column:
    """A struct of the columns, whatever their names."""
    return F.struct(*[named(c) for c in columns])


def _reads_rows_once(docs: DataFrame) -> bool:
    """Whether a frame is a read of files with columns and rows chosen, so that a file and row number stand for one row."""
    plan = [docs._jdf.queryExecution().analyzed()]
    while plan:
        node = plan.pop()
        if node.nodeName() not in ("Project", "Filter", "LogicalRelation", "Relation", "SubqueryAlias") and not node.nodeName().startswith("Relation"):
            return False
        plan += [node.children().apply(i) for i in range(node.children().length())]
    return True


def located(docs: DataFrame) -> DataFrame:
    """(row, at): all columns of ``docs`` as a struct, and a locator that finds the row again, file and row number.

    A frame that is not a plain read of files is written to the shared folder first."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at")
    if not any(c.lower() == "_metadata" for c in docs.columns) and _reads_rows_once(docs):
        try:
            return docs.select(packed(docs.columns).alias("row"), at)
        except AnalysisException:  # a format without row numbers
            pass
    return materialise(docs.select(packed(docs.columns).alias("row")), "arrivals").select("row", at)


def small(keys: DataFrame, most: int | None = None) -> DataFrame:
    """Keys marked for sending to every task if they are ``most`` rows at most; else as they are, for a join by shuffle."""
    most = SMALL_ROWS if most is None else most
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


#: Bits of the filter that stands for a large set of keys: 16 MB at most, sent to every task.
FILTER_BITS = 1 << 27


def _flagged(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """``rows`` with ``_maybe``: false where the key is surely not among ``keys``, by a bitmap of hashed keys of a fixed size."""
    place = F.pmod(F.xxhash64(F.col(on)), F.lit(FILTER_BITS)) + 1
    bits = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    at = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "_bucket", "left")
    return joined.withColumn("_maybe", F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))).drop("_bucket", "_bits")


def among(rows: DataFrame, keys: DataFrame, on: str = "at") -> DataFrame:
    """``rows`` joined with ``keys`` on the keys' unique column ``on``; of rows without a key few are shuffled."""
    marked = small(keys)
    if marked is not keys:
        return rows.join(marked, on)
    return _flagged(rows, keys, on).filter("_maybe").drop("_maybe").join(keys, on)


def without(rows: DataFrame, keys: DataFrame, on: str = "at") -> DataFrame:
    """The ``rows`` whose key is not among ``keys``; of those few are shuffled."""
    marked = small(keys)
    if marked is not keys:
        return rows.join(marked, on, "left_anti")
    flagged = _flagged(rows, keys, on)
    unsure = flagged.filter("_maybe").drop("_maybe").join(keys, on, "left_anti")
    return flagged.filter("NOT _maybe").drop("_maybe").unionByName(unsure)


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """array<bigint> of the values folded up to and with each entry; ``add`` is associative. It goes by blocks of the square root of the entries, as a fold that appends takes the square of a block's length."""
    none = F.array().cast("array<bigint>")
    start = F.lit(None).cast("bigint")
    put = lambda acc, x: F.when(acc.isNull(), x.cast("bigint")).otherwise(add(acc, x.cast("bigint")))

    def along(entries: Column, first: Column) -> Column:
        return F.aggregate(entries, none, lambda acc, x: F.concat(acc, F.array(put(F.coalesce(F.get(acc, F.size(acc) - 1), first), x))))

    def cut(entries: Column) -> Column:
        n = F.size(entries)
        width = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
        numbers = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda b: F.slice(entries, b * width + 1, width))

    def whole(blocks: Column) -> Column:
        firsts = F.concat(F.array(start), along(F.transform(blocks, lambda b: F.aggregate(b, start, put)), start))
        return F.flatten(F.zip_with(blocks, firsts, lambda b, first: F.when(b.isNotNull(), along(b, first)).otherwise(none)))

    return bound(bound(values, cut), whole)


def running_sums(sizes: Column) -> Column:
    return running(sizes, lambda a, x: a + x)


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once: what a lambda function names is otherwise made anew for each entry."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))  # a name or the path to a field


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count_words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space, without building the words."""
    marks = F.regexp_replace(text, WORD, "x")
    return F.length(F.regexp_replace(marks, SPACE, "")).cast("long")


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def text_hash() -> Column:
    return F.xxhash64(text_or_empty())


def sampled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text_hash, y) of the labelled rows of ``docs``, one for each id and text, ``max_rows`` at most: those with the smallest hashes, so that reruns agree."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col("doc_id").alias("doc_id"), text_hash().alias("text_hash")).join(known, "doc_id").dropDuplicates(["doc_id", "text_hash"])
    rows = materialise(rows.withColumn("h", F.xxhash64("doc_id", "text_hash")), "labelled")
    count = rows.count()
    if count > 4 * max_rows:  # so that the sort takes few rows of each task; a share of the range of hashes with about four times the rows wanted
        few = rows.filter(F.col("h") < int(2**64 * 4 * max_rows / count) - 2**63)
        rows = few if few.count() >= max_rows else rows
    return rows.orderBy("h", "doc_id", "text_hash").limit(max_rows).select("doc_id", "text_hash", "y")
