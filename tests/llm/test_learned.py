"""The operators with numpy in their tasks, against plain Python or held-out rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from metaudit.llm import language_model, near_dedup, quality, toxicity
from metaudit.llm import tokens as tk

DOCS = "doc_id bigint, text string, extra int"
ODD = ["", None, " ", "a", "A b\tc", "é😀 x", "one two three four five six", "ONE  two\nthree four five six", "w " * 40_000, "x" * 3_000_000]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return lower(text or "").replace("\t", " ").replace("\n", " ").split(" ") if text and text.strip(" \t\n") else []


def split(text):
    return [w for w in words(text) if w]


def table(spark, tmp_path, rows, schema=DOCS, name="t"):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def test_words_of_runs():
    got = []
    for first, last, data, offsets in tk.runs(pa.array(ODD)):
        starts, ends, owner = tk.words(data, offsets, tk.NOT_SPACE)
        texts = [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
        hashes = tk.word_hashes(data, starts, ends)
        got += [(first + o, lower(t), h) for o, t, h in zip(owner.tolist(), texts, hashes.tolist(), strict=True)]
        assert last > first
    assert [(o, t) for o, t, _ in got] == [(k, w) for k, t in enumerate(ODD) for w in split(t)]
    by_word = {}
    for _, t, h in got:
        assert by_word.setdefault(t, h) == h
    assert len(set(by_word.values())) == len(by_word)


def brute_print(text):
    w = split(text)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_simhash(spark, tmp_path):
    docs = table(spark, tmp_path, [(k, t, 0) for k, t in enumerate(ODD)] + [(None, "a", 0), (3, "a", 1)])
    for r in near_dedup.find_groups(docs).collect():
        text = "a" if r["doc_id"] is None else ODD[r["doc_id"]]
        assert r["fp"] & tk.MASK == brute_print(text)
        assert r["component_id"] == {1: 0, 2: 0, 7: 6, None: 3}.get(r["doc_id"], r["doc_id"])
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_copies(docs).collect()) == [0, 3, 4, 5, 6, 8, 9]
    assert near_dedup.find_groups(docs.limit(0)).count() == 0


def brute_components(prints, radius):
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                label[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_links_lose_nothing(spark):
    """Chains and clusters of fingerprints, also where values are cut into many tiles."""
    rng = random.Random(1)
    prints = [rng.getrandbits(64) for _ in range(150)] + [0, 1, 3, 0xFFFF, (1 << 64) - 1]
    for _ in range(600):
        x = rng.choice(prints)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        prints.append(x)
    base = rng.getrandbits(64)
    prints += [base ^ rng.getrandbits(8) << 50 for _ in range(200)]
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp bigint")
    want = brute_components(prints, 4)
    groups = {}
    for k, w in enumerate(want):
        groups.setdefault(w, set()).add(prints[k])
    for tile_rows in (4096, 7):
        roots = {r["node"] & tk.MASK: r["root"] & tk.MASK for r in near_dedup.connect(near_dedup.links(frame, 4, tile_rows)).collect()}
        got = {}
        for p in prints:
            got.setdefault(roots.get(p, p), set()).add(p)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_connect_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(200, 201)], "u bigint, v bigint")
    got = {r["node"]: r["root"] for r in near_dedup.connect(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 201: 200}


def test_language_model(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["the", "of", "a", f"w{rng.randint(0, 60)}"]) for _ in range(rng.randint(0, 80))), 0) for k in range(300)] + [(1000 + k, t, 0) for k, t in enumerate(ODD)] + [(None, "the of", 1), (7, "the the", 1)]
    docs = table(spark, tmp_path, rows)
    got = language_model.score_texts(docs).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    counts = Counter(w for i, t, _ in rows if not held(i) for w in [*split(t), ""])
    total, kinds = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, _ in rows:
        w = [*split(t), ""]
        want[(i, held(i), len(w), sum(counts[x] > 0 for x in w), total, round(sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w), 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    out = [r for r in got if r["held_out"] and r["n_tokens"] > 5 and r["n_known"] == r["n_tokens"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert language_model.score_texts(docs.limit(0)).count() == 0


def test_mixture_is_a_distribution():
    """Over all words the model's probabilities after a context add up to one."""
    keys = np.array([(b << 24) | (300 << 12) | s for b in (1, 3) for s in (400, 500, 600)])
    w = language_model.mixture_weights(keys, np.array([5.0, 3, 2, 8, 1, 1]))
    assert np.allclose(w.sum(1), 1) and (w[:, 2] > 0).all() and w[0, 0] == 0
    counts = {("a", "a"): 2, ("a", "b"): 1, ("b", "a"): 1}
    unigrams, kinds = {"a": 3, "b": 1}, 2
    for u, c in (("a", 3), ("b", 1)):
        m = w[language_model.context_bucket(np.array([c]))[0]]
        total = sum(m[0] * counts.get((u, v), 0) / c + m[1] * unigrams[v] / 4 + m[2] / (kinds + 1) for v in unigrams) + m[2] / (kinds + 1)
        assert math.isclose(total, 1)


def labelled(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(900):
        bad = k % 5 == 0
        w = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 60))]
        if bad:
            w.insert(rng.randint(0, len(w)), rng.choice(["vile", "awful"]))
        rows.append((k, (" ".join(w) + ".") if k % 7 else " ".join(x.upper() + "!!" for x in w), 0))
        labels.append((k, int(k % 7 > 0), int(bad)))
    rows += [(2000 + k, t, 0) for k, t in enumerate(ODD)] + [(None, "vile", 1), (3, "w1", 1)]
    labels += [(3, 1, None), (None, 1, 1), (5000, 0, 1)]
    return table(spark, tmp_path, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), rows


def test_toxicity(spark, tmp_path):
    docs, labels, rows = labelled(spark, tmp_path, 3)
    got = toxicity.score_toxicity(docs, labels, ["doc_id", "text"]).collect()
    assert len(got) == len(rows) and all(0 <= r["toxicity"] <= 1 for r in got)
    known = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and r["text"] != "w1"]
    assert all((r["toxicity"] >= 0.3) == (r["doc_id"] % 5 == 0) for r in known if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    again = {(r["doc_id"], r["text"]): r["toxicity"] for r in toxicity.score_toxicity(docs.repartition(5), labels, ["doc_id", "text"]).collect()}
    assert all(again[(r["doc_id"], r["text"])] == r["toxicity"] for r in got)
    kept = toxicity.drop_toxic(docs.withColumn("toxicity", F.lit("clash")), labels)
    assert kept.columns == [*docs.columns, "toxicity"] and {r["toxicity"] for r in kept.collect()} == {"clash"}
    assert toxicity.score_toxicity(docs, labels.limit(0), ["doc_id"]).filter("toxicity = 0.5").count() == len(rows)
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_quality(spark, tmp_path):
    docs, labels, rows = labelled(spark, tmp_path, 4)
    got = quality.score_quality(docs, labels, ["doc_id"]).collect()
    assert len(got) == len(rows) and all(0 <= r["quality_score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and r["doc_id"] != 3 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum((r["quality_score"] >= 0.5) == (r["doc_id"] % 7 > 0) for r in held) >= 0.98 * len(held)
    assert quality.score_quality(docs, labels.limit(0), ["doc_id"]).filter("quality_score = 0.5").count() == len(rows)
    assert quality.score_quality(docs.limit(0), labels, ["doc_id"]).count() == 0


def test_pairs_are_learned():
    """Two features that only matter together."""
    rng = np.random.default_rng(5)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000], rounds=30)
    assert (0, 1) in [(i, j) for i, j, _ in model.pairs]
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9
