"""Mixing sources to target weights by systematic sampling (native: DataFrame functions only).

Every document of a source has the same expected number of copies, target / source size. Their prefix
sum within the source, shifted by one random offset of the source, is emitted once for each integer that
it crosses. Documents are ordered by size, so that equal steps also take words evenly.

The prefix sum needs no task that holds a whole source: rows are numbered within blocks of at most about
``block_rows`` rows (source, size octave, hash of id and text; rows with more copies than that are dealt out
by their locators), and block counts give each block its start. Only the targets are worked out over all
sources in one task, a row a source.

Defined results: a null text has size 0; the null source comes last; a null id sorts first; rows that
repeat are rows of their own and share the copies that fall to their positions, and rows of one source with
the same id and text that differ in other columns are told apart by their locators; an empty table gives an
empty result; extra columns are ignored or kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, located, materialise, small, text_or_empty


def _number(md5: Column) -> Column:
    """The first 32 bits of an md5 as a number; the same in any engine."""
    return F.conv(F.substring(md5, 1, 8), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float], max_factor: int) -> DataFrame:
    """Targets of all sources, from (source, source_size): weights repeat along the sources by code point,
    null last, and share all words; a target stops at ``max_factor`` times its source's size and its excess
    goes to the others by weight. One row a source, so the windows over all sources are small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("w", F.get(cycle, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))).withColumn("cap", F.col("source_size") * max_factor)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    filled = ranked.withColumns(
        {
            "capped": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "w_left": F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
            "total": F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    ).withColumn("level", (F.col("total") - F.col("capped")) / F.col("w_left"))
    # The level at which the targets add up to all words: the largest that its own source can still reach.
    reached = F.when(F.col("cap") / F.col("w") >= F.col("level"), F.col("level"))
    best = F.max(reached).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return filled.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * best).alias("target"))


def _plan(base: DataFrame, weights: Sequence[float], max_factor: int, seed: str, block_rows: int) -> DataFrame:
    """``plan_copies`` of located rows, with their locators ``at``."""
    text = text_or_empty("row.text")
    rows = base.select(
        "at",
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.source").alias("source"),
        count_words(text).alias("size"),
        F.md5(F.concat(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.lit("|"), text).cast("binary")).alias("key"),
    ).withColumn("octave", F.length(F.bin("size")))
    rows = materialise(rows, "sized")  # texts are read once; the steps below read sizes and sources only
    octaves = rows.groupBy("source", "octave").agg(F.count("*").alias("octave_rows"), F.sum("size").alias("octave_size"))
    targets = source_targets(octaves.groupBy("source").agg(F.sum("octave_size").alias("source_size")), weights, max_factor)
    salts = octaves.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), F.col("octave").alias("o"), "source_size", "target", F.expr(f"octave_rows div {int(block_rows)} + 1").alias("salts")
    )
    copied = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows).select("key", F.ceil(F.col("n") / block_rows).alias("parts"))
    salted = (
        rows.join(salts, F.col("source").eqNullSafe(F.col("s")) & (F.col("octave") == F.col("o")))
        .join(small(materialise(copied, "copied")), "key", "left")
        .withColumns({"salt": F.pmod(_number(F.col("key")), F.col("salts")), "part": F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("at"), F.col("parts"))).cast("long")})
        .drop("s", "o", "salts", "parts")
    )
    blocks = ["source", "octave", "salt", "part"]
    counts = salted.groupBy(*blocks).agg(F.count("*").alias("n"))
    along = Window.partitionBy("source").orderBy("octave", "salt", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("source").alias("s"), F.col("octave").alias("o"), F.col("salt").alias("b"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("start"))
    block = Window.partitionBy(*blocks).orderBy("size", F.col("doc_id").asc_nulls_first(), "key", "at")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("octave") == F.col("o")) & (F.col("salt") == F.col("b")) & (F.col("part") == F.col("p"))
    ranked = salted.withColumn("place", F.row_number().over(block)).join(starts, same).withColumn("rank", F.col("start") + F.col("place"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _number(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("source"), F.lit(""))).cast("binary"))) / F.lit(4294967296.0)
    copies = F.floor(F.col("each") * F.col("rank") + F.col("offset")) - F.floor(F.col("each") * (F.col("rank") - 1) + F.col("offset"))
    return ranked.withColumns({"each": each, "offset": offset}).select("at", "doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def plan_copies(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_factor: int = 3, seed: str = "mix", block_rows: int = 100_000) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) with a row for each document."""
    return _plan(located(docs), weights, max_factor, seed, block_rows).drop("at")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_factor: int = 3, seed: str = "mix", block_rows: int = 100_000) -> DataFrame:
    """The mixture itself: each document as often as planned, with the columns of ``docs``."""
    base = located(docs)
    planned = _plan(base, weights, max_factor, seed, block_rows).filter("copies > 0").select("at", "copies")
    return base.join(planned, "at").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


PLAN_SQL = r"""
d AS (SELECT doc_id, source, md5(concat(coalesce(doc_id::VARCHAR, ''), '|', coalesce(text, ''))) AS key, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM {docs}),
r AS (SELECT *, length(bin(size)) AS octave FROM d),
o AS (SELECT source, octave, count(*) AS n, sum(size)::BIGINT AS s FROM r GROUP BY ALL),
w AS (SELECT source, sum(s)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM o GROUP BY source),
f AS (SELECT *, source_size * 3 AS cap,
             coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
             (sum(w) OVER (ORDER BY source_size * 3 / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS w_left,
             (sum(source_size) OVER ())::BIGINT AS total FROM w),
l AS (SELECT max((total - capped) / w_left) AS level FROM f WHERE cap / w >= (total - capped) / w_left),
t AS (SELECT source, source_size, least(cap::DOUBLE, w * level) AS target FROM f, l),
b AS (SELECT r.*, t.source_size, t.target,
             ('0x' || substr(r.key, 1, 8))::BIGINT % (o.n // 100000 + 1) AS salt
      FROM r JOIN o ON r.source IS NOT DISTINCT FROM o.source AND r.octave = o.octave JOIN t ON r.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY octave, salt, size, doc_id NULLS FIRST, key) AS rank,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END::DOUBLE AS each,
             ('0x' || substr(md5('mix|' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM b),
c AS (SELECT doc_id, source, size, source_size, target, (floor(each * rank + u) - floor(each * (rank - 1) + u))::BIGINT AS copies FROM k)"""


def query(spark, sf_dir):
    planned = plan_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = f"WITH {PLAN_SQL.format(docs='documents')} SELECT doc_id, size, source_size, target, size * copies AS taken FROM c"
