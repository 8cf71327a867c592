"""Places and running values along sorted groups of any size.

A window over a group sorts all of it in one task. Here the rows are dealt out by ranges of group and order, so a
large group is spread over as many parts as it fills; each part works its running values out for itself, and
what the parts before it add up to, a row for each group and part, is carried into it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: How running values are made: the aggregate of a part, and how two parts' values make one. The last value is that of the latest row that has one.
Kind = tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]
SUM: Kind = (F.sum, lambda before, own: before + own)
XOR: Kind = (F.bit_xor, lambda before, own: before.bitwiseXOR(own))
LAST: Kind = (lambda c: F.last(c, ignorenulls=True), lambda before, own: F.coalesce(own, before))


def sorted_parts(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], label: str) -> DataFrame:
    """``rows``, written, with ``_part`` and ``_at``: the number of a part of the sorted rows, and the place in it. Order within a group is by ``order``, nulls first; rows that are equal in it share a part."""
    ranged = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    return written(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), label)


def carried(parts: DataFrame, group: Sequence[str], values: dict[str, tuple[Column, Kind]], before: bool = False) -> DataFrame:
    """``parts`` with running values along ``_part`` and ``_at`` of each group: up to and with each row, or up to the row ``before`` it.

    ``parts`` is read twice: give a stored table. Groups are compared null-safely."""
    group = list(group)
    inner = Window.partitionBy(*group, "_part").orderBy("_at")
    inner = inner.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    own = parts.withColumns({f"_own_{n}": kind[0](c).over(inner) for n, (c, kind) in values.items()})
    # F.last takes the rows as they come, so the aggregate of a part is its greatest place's value.
    latest = {n: F.max_by(c, F.when(c.isNotNull(), F.col("_at"))) if kind is LAST else kind[0](c) for n, (c, kind) in values.items()}
    totals = parts.groupBy(*group, "_part").agg(*[v.alias(n) for n, v in latest.items()])
    along = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col("_part").alias("_p"), *[kind[0](F.col(n)).over(along).alias(f"_before_{n}") for n, (_, kind) in values.items()])
    carry = carry.filter(" OR ".join(f"_before_{n} IS NOT NULL" for n in values))
    met = F.col("_part") == F.col("_p")
    for k, g in enumerate(group):
        met = met & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    joined = own.join(carry, met, "left")
    whole = {n: F.when(F.col(f"_before_{n}").isNull(), F.col(f"_own_{n}")).when(F.col(f"_own_{n}").isNull(), F.col(f"_before_{n}")).otherwise(kind[1](F.col(f"_before_{n}"), F.col(f"_own_{n}"))) for n, (_, kind) in values.items()}
    return joined.withColumns(whole).drop("_p", *[f"_g{k}" for k in range(len(group))], *[f"_{x}_{n}" for n in values for x in ("own", "before")])
