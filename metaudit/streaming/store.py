"""Tables that grow by batches and are read by key.

Rows lie in parts by a hash of their key, and in a folder of their batch within it, so who asks for some keys reads
their parts alone, however large the table is. ``compact`` makes one folder of those of a part. A batch that is
run again replaces its own folders; a reader passes over folders that a compaction has taken in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a table; fixed once it has rows.
PARTS = 256


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.spark, self.path, self.parts = spark, path, parts

    def part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def put(self, rows: DataFrame, batch: int, key: Column) -> None:
        """Add the rows of a batch, with the column ``batch``."""
        self._write(rows.withColumns({"batch": F.lit(batch).cast("long"), "part": self.part(key)}), "of", batch)

    def _write(self, rows: DataFrame, kind: str, batch: int) -> None:
        dealt = rows.withColumn(kind, F.lit(batch)).hint("rebalance", "part")  # a large part is several files
        dealt.write.partitionBy("part", kind).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def _folders(self, parts: Sequence[int] | None) -> dict[int, list[tuple[str, int, str]]]:
        """By part: (kind, batch, path) of the folders that count."""
        files = self.spark._jvm.org.apache.hadoop.fs
        where = files.Path(self.path)
        system = where.getFileSystem(self.spark._jsc.hadoopConfiguration())

        def below(path) -> list[tuple[str, int]]:
            found = [s.getPath().getName().partition("=") for s in system.listStatus(path)] if system.exists(path) else []
            return [(k, int(v)) for k, eq, v in found if eq]

        out = {}
        for part in parts if parts is not None else [v for k, v in below(where) if k == "part"]:
            own = below(files.Path(f"{self.path}/part={part}"))
            taken_in = max((v for k, v in own if k == "upto"), default=-1)
            counts = [(k, v) for k, v in own if (k == "upto" and v == taken_in) or (k == "of" and v > taken_in)]
            out[part] = [(k, v, f"{self.path}/part={part}/{k}={v}") for k, v in counts]
        return out

    def get(self, schema, parts: Sequence[int] | None = None) -> DataFrame:
        """The rows of some parts, or all, with the columns of ``schema`` and ``batch``."""
        paths = [path for own in self._folders(parts).values() for _, _, path in own]
        whole = f"{schema}, batch long"
        return self.spark.read.schema(whole).parquet(*paths) if paths else self.spark.createDataFrame([], whole)

    def compact(self, schema, most: int = 16, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows, key: Column | None = None) -> int:
        """Make one folder of each part that has more than ``most``, with the rows that ``keep`` keeps; returns how many parts. No batch may be written meanwhile."""
        full = {part: own for part, own in self._folders(None).items() if len(own) > most}
        if not full:
            return 0
        last = max(v for own in full.values() for _, v, _ in own)
        self._write(keep(self.get(schema, list(full))).withColumn("part", self.part(key)), "upto", last)
        files = self.spark._jvm.org.apache.hadoop.fs
        for own in full.values():
            for kind, v, path in own:
                if (kind, v) != ("upto", last):
                    files.Path(path).getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(files.Path(path), True)
        return len(full)
