"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees over binned features learns one lookup table for each feature, then one for
each of the strongest pairs. A text's score is the sum of its bins' entries. The model is learned from the
features of a bounded sample of labelled rows; it is a few tables, and every whole text is scored by
vectorised bin lookups.

Defined results: a null or empty text has all features zero; labels that are null or belong to no document
are not used, and of several labels of an id the highest counts; rows with the same id and text are learned
from once; without labels every score is 0.5; rows that repeat get scores of their own; an empty table gives
an empty result; extra columns are ignored or kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .common import crc_mod, packed, sampled, table, text_hash

FEATURES = (
    "words", "word_length", "upper", "digits", "symbols", "punctuation", "exclamations", "bars", "lines", "line_length",
    "repeated_lines", "distinct_words", "top_word", "repeated_triples", "beyond_ascii", "short_words", "longest_word", "sentence_length",
)


def _class(chars: str | range) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars] if isinstance(chars, str) else list(chars)] = True
    return t


_CLASSES = {
    "upper": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": _class("0123456789"), "symbols": _class("%*#$&@^~_=+<>{}[]\\/`"), "punctuation": _class(".,;:?'\"()-"),
    "exclamations": _class("!"), "bars": _class("|"), "beyond_ascii": _class(range(128, 256)), "stops": _class(".!?"),
}
_NOT_NEWLINE = ~_class("\n")


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text, how many different values it has and how often the most frequent one comes."""
    if len(h) == 0:
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, owner))
    o, h = owner[order], h[order]
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(h)))
    most = np.zeros(n)
    np.maximum.at(most, o[at], counts)
    return np.bincount(o[at], minlength=n).astype(float), most


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a run."""
    n, length = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
    count = {k: _sums(t[data], offsets) for k, t in _CLASSES.items()}
    starts, ends, owner = tk.words(data, offsets, tk.NOT_SPACE)
    h, size = tk.word_hashes(data, starts, ends), ends - starts
    words = np.bincount(owner, minlength=n).astype(float)
    some = np.maximum(words, 1)
    distinct, top = _repeats(owner, h, n)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, size)
    ls, le, lo = tk.words(data, offsets, _NOT_NEWLINE)
    lines = np.bincount(lo, minlength=n).astype(float)
    different_lines, _ = _repeats(lo, tk.word_hashes(data, ls, le), n)
    same = owner[2:] == owner[:-2]
    triples, to = tk.combine(tk.combine(h[:-2], h[1:-1], 1), h[2:], 2)[same] if len(h) > 2 else h[:0], owner[:-2][same] if len(h) > 2 else owner[:0]
    many, (different, _) = np.bincount(to, minlength=n), _repeats(to, triples, n)
    full = {
        "words": np.log1p(words), "word_length": np.bincount(owner, size, n) / some, **{k: count[k] / length for k in ("upper", "digits", "symbols", "punctuation", "exclamations", "bars", "beyond_ascii")},
        "lines": lines / some, "line_length": np.log1p(words / np.maximum(lines, 1)), "repeated_lines": 1 - different_lines / np.maximum(lines, 1), "distinct_words": distinct / some, "top_word": top / some,
        "repeated_triples": 1 - different / np.maximum(many, 1), "short_words": np.bincount(owner, size <= 3, n) / some, "longest_word": np.log1p(longest), "sentence_length": np.log1p(words / np.maximum(count["stops"], 1)),
    }
    full["repeated_lines"][lines == 0] = 0
    full["repeated_triples"][many == 0] = 0
    return np.stack([full[k] for k in FEATURES], 1)


@dataclass
class Model:
    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        logit = np.full(len(x), self.bias)
        for k, t in enumerate(self.tables):
            logit += t[b[k]]
        for i, j, t in self.pairs:
            logit += t[b[i], b[j]]
        return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def _split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[int, float]:
    """The best cut of a row of bins and its gain."""
    if len(g) < 2:
        return 0, 0.0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(np.argmax(gain))
    return k + 1, float(gain[k])


def _shallow(g: np.ndarray, h: np.ndarray, rate: float, ridge: float) -> np.ndarray:
    """A tree of up to four leaves over the bins, as a table."""
    cut, _ = _split(g, h, ridge)
    cuts = {0, len(g), cut, _split(g[:cut], h[:cut], ridge)[0], cut + _split(g[cut:], h[cut:], ridge)[0]}
    out, ordered = np.zeros(len(g)), sorted(cuts)
    for a, b in zip(ordered[:-1], ordered[1:], strict=True):
        out[a:b] = rate * g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _shallow_pair(g: np.ndarray, h: np.ndarray, rate: float, ridge: float) -> np.ndarray:
    """A tree that cuts one feature, then the other on each side; the better order of both."""
    best, table = -1.0, np.zeros(g.shape)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        cut, _ = _split(gg.sum(1), hh.sum(1), ridge)
        out, gained = np.zeros(gg.shape), 0.0
        for a, b in ((0, cut), (cut, len(gg))):
            if a == b:
                continue
            k, _ = _split(gg[a:b].sum(0), hh[a:b].sum(0), ridge)
            for c, d in ((0, k), (k, gg.shape[1])):
                s, t = gg[a:b, c:d].sum(), hh[a:b, c:d].sum()
                out[a:b, c:d] = rate * s / (t + ridge)
                gained += s * s / (t + ridge)
        if gained > best:
            best, table = gained, out.T if turned else out
    return table


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, n_pairs: int = 6, pair_rounds: int = 60, rate: float = 0.1, ridge: float = 5.0) -> Model:
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    model = Model(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], [])
    if len(x) == 0:
        return model
    b, logit = model.bins(x), np.full(len(x), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, t in enumerate(model.tables):  # cyclic: each feature in turn
            g, h = slopes()
            step = _shallow(np.bincount(b[k], g, len(t)), np.bincount(b[k], h, len(t)), rate, ridge)
            t += step
            logit += step[b[k]]
    g, h = slopes()
    gains = []
    for i, j in combinations(range(x.shape[1]), 2):
        at, m = (b[i] // 4) * bins + b[j] // 4, bins * bins
        s, t = np.bincount(at, g, m), np.bincount(at, h, m)
        gains.append(((s * s / (t + ridge)).sum(), i, j))
    for _, i, j in sorted(gains, reverse=True)[:n_pairs]:
        model.pairs.append((i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))))
    for _ in range(pair_rounds):
        for i, j, t in model.pairs:
            g, h = slopes()
            at = b[i] * t.shape[1] + b[j]
            step = _shallow_pair(np.bincount(at, g, t.size).reshape(t.shape), np.bincount(at, h, t.size).reshape(t.shape), rate, ridge)
            t += step
            logit += step[b[i], b[j]]
    return model


def _over_texts(docs: DataFrame, keep: list[str], make, kind: str) -> DataFrame:
    """Columns ``keep`` and a column ``out`` made from the features of each run of texts."""
    rows = docs.select(F.col("text").alias("text"), packed(keep).alias("row"))
    schema = rows.select("row", F.lit(None).cast(kind).alias("out")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(features(data, offsets)) for _, _, data, offsets in tk.runs(batch.column(0))]
            out = np.concatenate(made) if made else np.zeros(0)
            values = pa.array(list(out)) if out.ndim == 2 else pa.array(out, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(1), values], ["row", "out"])

    return rows.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, **options) -> Model:
    """``max_rows`` bounds the labelled rows of ``docs`` that are learned from; of more, those with the smallest hashes are taken. Their features, 18 numbers each, come to the driver."""
    chosen = sampled(docs, labels, label, max_rows)
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), text_hash().alias("text_hash")).join(F.broadcast(chosen), ["doc_id", "text_hash"])  # max_rows rows at most
    made = _over_texts(texts, ["doc_id", "text_hash", "y"], lambda x: x, "array<double>").select("row.*", "out").dropDuplicates(["doc_id", "text_hash"])
    rows = sorted(made.collect(), key=lambda r: (r["doc_id"], r["text_hash"]))  # one for each of the chosen at most
    x = np.array([r["out"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows], float), **options)


def score_quality(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, **options) -> DataFrame:
    """Columns ``keep`` (all) and ``quality_score``. Rows whose crc32(id) mod 3 is 1 are held out of the training."""
    model = train(docs.filter(crc_mod(F.col("doc_id"), 3) != 1), labels, **options)
    return _over_texts(docs, docs.columns if keep is None else keep, model.score, "double").select("row.*", F.col("out").alias("quality_score"))


def query(spark, sf_dir):
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
