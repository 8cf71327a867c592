"""Tables in the shared folder that cut a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written under spark.checkpoint.dir and read back; a local session without that setting gets a temporary folder."""
    context = df.sparkSession.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-metaudit-"))
    path = f"{root}/metaudit/{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
