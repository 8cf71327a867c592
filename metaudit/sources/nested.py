"""Nested attribute records of users' own tables as attribute rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(records: DataFrame, nodes: str = "nodes", items: str = "items") -> DataFrame:
    """(file, path, tag, vr, value, length, length_encoding, item_count, depth, pos) of records (file, nodes).

    ``nodes`` is an array of structs with a tag, any of vr, value, length and length_encoding, and, down to the depth that the
    schema has, ``items``: an array of arrays of such structs. Parents come before their children. A null array has no rows."""
    level = records.select("file", F.posexplode(nodes).alias("k", "n")).select("file", F.lit(None).cast("string").alias("prefix"), F.array("k").alias("order"), "n")
    every, depth = None, 0
    while True:
        kind: T.StructType = level.schema["n"].dataType
        path = F.concat_ws("/", "prefix", "n.tag")
        field = lambda name, to, kind=kind: (F.col(f"n.{name}") if name in kind.names else F.lit(None)).cast(to).alias(name)
        count = F.when(F.col(f"n.{items}").isNotNull(), F.size(f"n.{items}")) if items in kind.names else F.lit(None)
        rows = level.select("file", path.alias("path"), F.col("n.tag").alias("tag"), field("vr", "string"), field("value", "string"), field("length", "bigint"), field("length_encoding", "string"), count.cast("int").alias("item_count"), F.lit(depth).alias("depth"), "order")
        every = rows if every is None else every.unionByName(rows)
        if items not in kind.names:
            break
        inner = level.select("file", path.alias("path"), "order", F.posexplode(f"n.{items}").alias("i", "item"))
        level = inner.select("file", "order", F.concat_ws("/", "path", F.col("i").cast("string")).alias("prefix"), "i", F.posexplode("item").alias("k", "n")).select("file", "prefix", F.concat("order", F.array("i", "k")).alias("order"), "n")
        depth += 1
    placed = every.withColumn("pos", F.row_number().over(Window.partitionBy("file").orderBy("order")) - 1)
    return placed.drop("order")
