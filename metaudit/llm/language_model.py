"""Language-model scoring by deleted interpolation of n-gram estimates (words and word pairs).

The probability of a word after another is a mixture of the pair's and the word's maximum-likelihood
estimates and a uniform part. The weights depend on a bucket of the context's frequency and are learned by
expectation-maximisation on held-out counts: each training event is deleted from the counts that predict it.

Counts are exact and cover all training documents. Documents are taken in chunks of a few megabytes of text,
stored as numbers of each chunk's own words; texts are read once. A chunk sends its distinct words and pairs
(64-bit hashes, sorted, with its training counts) to buckets of the hash range; each bucket adds up and
answers with the totals in the order asked. So every distinct n-gram of a chunk travels once, frequent ones
too. The number of buckets follows from the measured size of the questions, so that no task holds more than
a chunk or a bucket of ``bucket_bytes``. There are as many messages as chunks times buckets; corpora of many
terabytes want larger chunks and buckets.

Defined results: a null or empty text is the end token alone; without training documents every base
probability is 1 and the model is uniform; a null id counts as the empty text when training and held-out
documents are parted; rows that repeat are rows of their own; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .common import conf_set, crc_mod, drop_path, materialise, new_path, table

CHUNK_BYTES = 3 << 20
END = np.uint64(0x5851F42D4C957F2D)  # stands for the end of a text, and as a context for its beginning
#: Parts of an octave in which estimates are told apart for the mixture weights, and their range.
FINE, OCTAVES = 8, 64


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, np.ndarray, np.ndarray]]:
    """(number, ids, held_out, lengths, hashes) of chunks of whole documents (text, doc_id, held_out); each document ends with END."""
    part, number = TaskContext.get().partitionId() << 32, 0
    ids, held, lengths, hashes, size = [], [], [], [], 0
    for batch in batches:
        every_id, every_held = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
        for first, last, data, offsets in tk.runs(batch.column(0)):
            starts, ends, owner = tk.words(data, offsets, tk.NOT_SPACE)
            n = np.bincount(owner, minlength=last - first) + 1
            stops = np.cumsum(n) - 1
            h = np.empty(int(n.sum()), np.uint64)
            inner = np.ones(len(h), bool)
            inner[stops] = False
            h[inner], h[stops] = tk.word_hashes(data, starts, ends), END
            ids += every_id[first:last]
            held.append(every_held[first:last])
            lengths.append(n)
            hashes.append(h)
            size += len(data)
            if size >= CHUNK_BYTES:
                yield part + number, ids, np.concatenate(held), np.concatenate(lengths), np.concatenate(hashes)
                ids, held, lengths, hashes, size, number = [], [], [], [], 0, number + 1
    if ids:
        yield part + number, ids, np.concatenate(held), np.concatenate(lengths), np.concatenate(hashes)


def pairs(lengths: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, pair hashes) of all tokens; the first of a text comes after END."""
    context = np.empty_like(h)
    context[1:] = h[:-1]
    if len(h):
        context[np.cumsum(lengths) - lengths] = END
    return context, tk.combine(context, h, 3)


def _planes(values: np.ndarray) -> bytes:
    """The bytes of all values by their place: those of the high places are mostly alike and compress."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _from_planes(raw: bytes, kind: str, offset: int = 0, n: int | None = None) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, np.uint8, -1 if n is None else n * width, offset).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys as steps from one to the next."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _from_steps(raw: bytes, offset: int = 0, n: int | None = None) -> np.ndarray:
    return np.cumsum(_from_planes(raw, "<u8", offset, n), dtype=np.uint64)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in 4 bytes each where they fit, else 8; the first byte says which."""
    width = 4 if counts.max(initial=0) < 1 << 32 else 8
    return bytes([width]) + _planes(counts.astype(f"<u{width}"))


def _wide(raw: bytes) -> np.ndarray:
    return _from_planes(raw, f"<u{raw[0]}", 1)


def bucket_edges(buckets: int) -> np.ndarray:
    return (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)


def kept(docs: DataFrame) -> DataFrame:
    """(chunk, ids, held, n, tokens, body): each chunk's documents as numbers of its own sorted words."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, held, lengths, h in chunks(batches):
            own, inverse = np.unique(h, return_inverse=True)
            body = zstandard.ZstdCompressor(level=1).compress(_steps(own) + _planes(lengths.astype(np.uint32)) + _planes(inverse.astype(np.uint32)))
            columns = [pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held.tolist()], pa.list_(pa.bool_())), pa.array([len(own)], pa.int64()), pa.array([len(h)], pa.int64()), pa.array([body], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "held", "n", "tokens", "body"])

    return docs.mapInArrow(keep, "chunk long, ids array<long>, held array<boolean>, n long, tokens long, body binary")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """A chunk at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own words, number of the word at each token, lengths of the documents) of a chunk."""
    raw, n, docs = zstandard.ZstdDecompressor().decompress(row["body"]), row["n"], len(row["ids"])
    lengths = _from_planes(raw, "<u4", 8 * n, docs).astype(np.int64)
    return _from_steps(raw, 0, n), _from_planes(raw, "<u4", 8 * n + 4 * docs), lengths


def asked(stored: DataFrame, buckets: int) -> DataFrame:
    """(kind, bucket, chunk, keys, counts): what each stored chunk asks of each bucket; kind 1 words, 2 pairs."""
    edges = bucket_edges(buckets)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, at, lengths = _opened(row)
            h = words[at]
            training = np.repeat(~np.array(row["held"], bool), lengths)
            for kind, keys in ((1, h), (2, pairs(lengths, h)[1])):
                own, inverse = np.unique(keys, return_inverse=True)
                counts = np.bincount(inverse, training, len(own)).astype("<u4")
                cuts = [0, *np.searchsorted(own, edges, "left"), len(own)]
                some = [(b, cuts[b], cuts[b + 1]) for b in range(buckets) if cuts[b] < cuts[b + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(some), pa.int32()), pa.array([b for b, _, _ in some], pa.int32()), pa.array([row["chunk"]] * len(some), pa.int64()), pa.array([_steps(own[i:j]) for _, i, j in some], pa.binary()), pa.array([_planes(counts[i:j]) for _, i, j in some], pa.binary())],
                    ["kind", "bucket", "chunk", "keys", "counts"],
                )

    return stored.mapInArrow(ask, "kind int, bucket int, chunk long, keys binary, counts binary")


def answered(questions: DataFrame) -> DataFrame:
    """(kind, bucket, chunk, totals, different, total): totals in the order asked; the row with a null chunk has the bucket's number of different keys with a count, and their sum."""

    def add_up(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [_from_steps(k) for k in rows["keys"]]
        own, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(inverse, np.concatenate([_from_planes(c, "<u4") for c in rows["counts"]]), len(own)).astype(np.int64)
        back = np.split(totals[inverse], np.cumsum([len(k) for k in keys])[:-1])
        own_row = {"kind": rows["kind"].iloc[0], "bucket": rows["bucket"].iloc[0]}
        out = [own_row | {"chunk": c, "totals": _narrow(b), "different": None, "total": None} for c, b in zip(rows["chunk"], back, strict=True)]
        out.append(own_row | {"chunk": None, "totals": None, "different": int((totals > 0).sum()), "total": int(totals.sum())})
        return pd.DataFrame(out).astype({"chunk": "Int64", "different": "Int64", "total": "Int64"})

    return questions.groupBy("kind", "bucket").applyInPandas(add_up, "kind int, bucket int, chunk long, totals binary, different long, total long")


def events(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, word counts, context counts, pair counts) of all tokens of a chunk, from its documents and answers."""
    own, at, lengths = _opened(row)
    context, both = pairs(lengths, own[at])
    totals = {1: [], 2: []}
    for a in sorted(row["answers"], key=lambda a: (a["kind"], a["bucket"])):
        totals[a["kind"]].append(_wide(a["totals"]))
    words, joint = (np.concatenate(totals[k]).astype(np.int64) for k in (1, 2))
    inverse = np.unique(both, return_inverse=True)[1]
    # A word's frequency as a context is its own, as every text ends with END; END stands for the beginning.
    return lengths, words[at], words[np.searchsorted(own, context)], joint[inverse]


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts that were not seen, then one bucket an octave."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 0)


def estimates(words: np.ndarray, context: np.ndarray, joint: np.ndarray, tokens: int, kinds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Maximum-likelihood estimates of the pair and of the word, and the uniform part."""
    return joint / np.maximum(context, 1), words / max(tokens, 1), 1 / (kinds + 1)


def histogram(chunked: DataFrame, tokens: int, kinds: int) -> DataFrame:
    """(bucket, pair, word, n): how many training events, each deleted from its own counts, have a context of a bucket and estimates of a size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            lengths, words, context, joint = events(row)
            use = np.repeat(~np.array(row["held"], bool), lengths)
            words, context, joint = words[use] - 1, context[use] - 1, joint[use] - 1
            f2, f1, f0 = estimates(words, context, joint, tokens - 1, kinds)
            size = [np.where(f > 0, np.clip(np.round(np.log2(np.maximum(f, 1e-300) / f0) * FINE) + FINE * OCTAVES, 1, 2 * FINE * OCTAVES), 0).astype(np.int64) for f in (f2, f1)]
            key, n = np.unique((context_bucket(context) << 24) | (size[0] << 12) | size[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    return chunked.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def mixture_weights(keys: np.ndarray, n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights (pair, word, uniform) of each of 65 buckets by expectation-maximisation; buckets without events use those of the nearest lower one."""
    bucket = keys >> 24
    ratio = [np.where(s > 0, 2.0 ** ((s - FINE * OCTAVES) / FINE), 0.0) for s in ((keys >> 12) & 4095, keys & 4095)]
    f = np.stack([*ratio, np.ones(len(keys))], 1)
    weights = np.zeros((65, 3))
    last = np.array([0.0, 0.9, 0.1])
    for b in range(65):
        own = bucket == b
        if own.any():
            w, fb, nb = np.array([1 / 3, 1 / 3, 1 / 3]), f[own], n[own]
            for _ in range(rounds):
                share = fb * w
                w = (share / share.sum(1, keepdims=True) * nb[:, None]).sum(0) / nb.sum()
            w = np.maximum(w, 1e-6)  # the uniform part stays above zero
            last = w / w.sum()
        weights[b] = last
    weights[0] = np.array([0.0, *weights[0, 1:]]) / weights[0, 1:].sum()  # an unseen context has no pairs
    return weights


def score_texts(docs: DataFrame, modulus: int = 7, held: int = 2, bucket_bytes: int = 24 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). Rows whose crc32(id) mod ``modulus`` is ``held`` are not learned from."""
    spark = docs.sparkSession
    rows = docs.select(F.col("text").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), modulus) == held).alias("held"))
    stored = materialise(kept(rows), "words", first := new_path(spark, "words"))
    asks = stored.agg(F.coalesce(F.sum(F.col("n") + F.col("tokens")), F.lit(0))).first()[0] * 12  # bytes at most: a key and a count for each word and pair
    with conf_set(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}):  # a chunk is a large row
        answers = materialise(answered(asked(stored, max(1, -(-asks // bucket_bytes)))), "answers", second := new_path(spark, "answers"))
    stats = answers.filter("chunk IS NULL AND kind = 1").agg(F.coalesce(F.sum("different"), F.lit(0)).alias("v"), F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()
    kinds, tokens = int(stats["v"]), int(stats["n"])
    replies = answers.filter("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "totals")).alias("answers"))
    chunked = materialise(stored.join(replies, "chunk"), "chunks")
    for path in (first, second):
        drop_path(spark, path)
    with conf_set(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}):
        counted = histogram(chunked, tokens, kinds).collect()  # sizes and buckets have a fixed range
    weights = mixture_weights(np.array([r["key"] for r in counted], np.int64), np.array([r["n"] for r in counted], float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            lengths, words, context, joint = events(row)
            f2, f1, f0 = estimates(words, context, joint, tokens, kinds)
            w = weights[context_bucket(context)]
            logs = np.log10(w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] * f0)
            base = np.log10((words + 1) / (tokens + kinds + 1))
            at = np.cumsum(lengths) - lengths
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(lengths), pa.array(np.add.reduceat((words > 0).astype(np.int64), at)), pa.array(np.full(len(at), tokens)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(logs, at))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return chunked.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))
