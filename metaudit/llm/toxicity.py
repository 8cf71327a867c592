"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, word pairs and pairs with one word between (letters and digits,
lower-cased), hashed to 2**bits places. Follow-the-regularised-leader with per-coordinate rates and an L1
term learns from a bounded sample of labelled rows, in one task or in several whose weights are averaged,
and leaves few weights. Texts become the numbers of their features before they are gathered. The table of weights has a fixed size of 4 * 2**bits bytes and is broadcast; texts
are scored whole, a run of documents at a time.

Defined results: a null or empty text has no feature and gets the score of the intercept; labels that are
null or belong to no document are not used, and of several labels of an id the highest counts; rows with the
same id and text are learned from once; without labels every score is 0.5; rows that repeat are rows of their own; an empty table gives an empty result;
extra columns are ignored or kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .common import crc_mod, located, materialise, packed, sampled, table, text_hash, without

BITS = 20


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of all n-grams and skip-grams of a run of texts, repeats included."""
    starts, ends, owner = tk.words(data, offsets, tk.ALNUM)
    h = tk.word_hashes(data, starts, ends)
    owners, hashes = [owner], [h]
    for step in (1, 2):  # pairs, and pairs around one word
        same = owner[step:] == owner[:-step] if len(owner) > step else np.zeros(0, bool)
        owners.append(owner[: len(same)][same])
        hashes.append(tk.combine(h[: len(same)][same], h[step:][same] if len(same) else h[:0], step))
    return np.concatenate(owners), (np.concatenate(hashes) >> np.uint64(64 - bits)).astype(np.int64)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, size: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights of ``size`` places and, last, the intercept, which has no L1 term. A row is an array of distinct places."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(z, n, shrink):
        return np.where(np.abs(z) <= shrink, 0.0, (np.sign(z) * shrink - z) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for at, y in zip(rows, labels, strict=True):
            zi, ni = z[at], n[at]
            w, bias = weights(zi, ni, l1), float(weights(z[size], n[size], 0.0))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
            z[size] += g - (np.sqrt(n[size] + g * g) - np.sqrt(n[size])) / alpha * bias
            n[size] += g * g
    return np.append(weights(z[:size], n[:size], l1), weights(z[size], n[size], 0.0))


def hashed(texts: DataFrame, bits: int) -> DataFrame:
    """All columns but ``text``, and ``places``: the distinct places of each text's features."""
    rest = [c for c in texts.columns if c != "text"]
    schema = texts.select(*rest, F.array().cast("array<int>").alias("places")).schema

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in tk.runs(batch.column(0)):  # a run at a time, as places take more room than texts
                owner, at = features(data, offsets, bits)
                pairs = np.unique((owner << bits) | at)
                cuts = np.searchsorted(pairs >> bits, np.arange(last - first + 1)).astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(cuts), pa.array((pairs & ((1 << bits) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns[1:], places], [*rest, "places"])

    return texts.select("text", *rest).mapInArrow(make, schema)


def train(docs: DataFrame, labels: DataFrame, label: str, bits: int = BITS, max_rows: int = 16_000, shards: int = 1, epochs: int = 6, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.6, l2: float = 0.0) -> np.ndarray:
    """The weights. ``max_rows`` bounds the labelled rows of ``docs`` that are learned from; of more, those with the smallest hashes are taken.

    ``l1`` is for one row: sums of gradients scatter by the square root of the rows of the rarer label, so the term grows with that root, at every size."""
    size = 1 << bits
    chosen = sampled(docs, labels, label, max_rows)
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), text_hash().alias("text_hash")).join(F.broadcast(chosen), ["doc_id", "text_hash"])  # max_rows rows at most
    rows = hashed(texts.select("doc_id", "text", "text_hash", "y"), bits).dropDuplicates(["doc_id", "text_hash"])
    sharded = rows.withColumn("order", F.xxhash64("doc_id", "text_hash", F.lit(7))).withColumn("shard", F.pmod("order", F.lit(shards)))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "doc_id", "text_hash"])
        each = list(rows["places"])
        y = rows["y"].to_numpy(float)
        w = ftrl(each, y, size, epochs, alpha, beta, l1 * np.sqrt(min(y.sum(), (1 - y).sum())), l2)
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": at, "w": w[at]})

    learned = sharded.groupBy("shard").applyInPandas(fit, "at long, w double")
    weights = np.zeros(size + 1, np.float32)
    for row in learned.groupBy("at").agg(F.sum("w").alias("w")).collect():  # 2**bits rows at most, few after L1
        weights[row["at"]] = row["w"] / shards
    return weights


def with_score(docs: DataFrame, weights: np.ndarray, keep: list[str], name: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the score of each whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    bits = int(np.log2(len(weights) - 1))
    rows = docs.select(F.col("text").alias("text"), packed(keep).alias("row"))
    schema = rows.select("row", F.lit(0.0).alias("score")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            out = np.full(batch.num_rows, float(w[-1]))
            for first, last, data, offsets in tk.runs(batch.column(0)):
                owner, at = features(data, offsets, bits)
                used = w[at] != 0
                pairs = np.unique((owner[used] << bits) | at[used])
                out[first:last] += np.bincount(pairs >> bits, w[pairs & ((1 << bits) - 1)], last - first)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], ["row", "score"])

    return rows.mapInArrow(score, schema).select("row.*", F.col("score").alias(name))


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, **options) -> DataFrame:
    """Columns ``keep`` (all) and ``toxicity``. Rows whose crc32(id) mod 4 is 2 are held out of the training."""
    training = docs.filter(crc_mod(F.col("doc_id"), 4) != 2)
    return with_score(docs, train(training, labels, "toxic", **options), docs.columns if keep is None else keep, "toxicity")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""
    base = located(docs)
    scored = score_toxicity(base.select("row.doc_id", F.col("row.text").alias("text"), "at"), labels, ["at"], **options)
    return without(base, materialise(scored.filter(F.col("toxicity") >= threshold).select("at"), "toxic")).select("row.*")


def query(spark, sf_dir):
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))
