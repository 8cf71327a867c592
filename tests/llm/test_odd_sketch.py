"""Near copies by odd sketches against comparing all pairs of sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metaudit.llm import odd_sketch
from metaudit.llm.near_dedup import shingle_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, percent=85):
    """The component of each row by position (smallest id that is reachable), and how many there are."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    low = {g: min((r[0] for r, o in zip(rows, group, strict=True) if o == g and r[0] is not None), default=None) for g in group}
    return [low[g] for g in group], len(low)


def edited(rng, words, share):
    return [w if rng.random() >= share else f"e{rng.randrange(10**6)}" for w in words]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 40, 150, 400]))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    texts += [" ".join(edited(rng, b, rng.choice([0.003, 0.01, 0.02, 0.03, 0.05]))) for b in base for _ in range(3)]
    dense = [f"d{rng.randrange(3000)}" for _ in range(200)]  # a group in which many pairs lie about the limit
    texts += [" ".join(edited(rng, dense, rng.choice([0.005, 0.012, 0.016, 0.02, 0.03]))) for _ in range(60)]
    texts += [texts[0].upper(), "  " + texts[1].replace(" ", "\t\n"), texts[-1], texts[-1]]
    texts += ["", None, " \n", "", "one two", "one  two", "ONE two", "three", "é è", "É è", "long " + " ".join(f"x{k}" for k in range(20_000))]
    ids = [*range(len(texts))]
    rng.shuffle(ids)
    out = list(zip(ids, texts, strict=True))
    return [*out, (None, texts[0]), (None, "only here, without an id"), out[3], (ids[4], "another text of the same id")]


@pytest.mark.parametrize(("percent", "tile_rows"), [(85, 2048), (85, 4), (90, 2048)])
def test_components_match_brute_force(spark, tmp_path, rows, percent, tile_rows):
    spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("sid", "at", "row", "size", "key", "root", "a.b")}).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    got = odd_sketch.near_groups(docs, percent, tile_rows=tile_rows).collect()
    key = lambda r: tuple(map(str, r))
    want = sorted(((i, len(shingles(t)), c) for (i, t), c in zip(rows, brute(rows, percent)[0], strict=True)), key=key)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == want
    if tile_rows > 4 and percent == 85:
        kept = odd_sketch.drop_near_copies(docs)
        assert kept.columns == docs.columns
        assert kept.count() == brute(rows)[1]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert odd_sketch.near_groups(docs).count() == 0 and odd_sketch.drop_near_copies(docs).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert odd_sketch.query(spark, str(tmp_path)).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_sketches_estimate_similarities():
    """The mean estimate is right, and sketches of pairs at the limit stay below MOST_BITS."""
    rng, n = np.random.default_rng(3), 1000
    for similarity in (0.85, 0.95):
        bits, agree = [], []
        for _ in range(200):
            h = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            both = round(2 * similarity * n / (1 + similarity))
            other = np.concatenate([h[:both], rng.integers(0, 1 << 63, n - both, dtype=np.uint64)])
            samples = odd_sketch.minhashes(np.repeat([0, 1], n), np.concatenate([np.sort(h), np.sort(other)]), 2)
            a, b = odd_sketch.odd_sketches(samples).view(np.uint64)
            bits.append(int(np.bitwise_count(a ^ b).sum()))
            agree.append((samples[:, 0] == samples[:, 1]).mean())
        assert abs(np.mean(agree) - similarity) < 0.006
        assert abs(odd_sketch.similarity_estimate(np.array(bits)).mean() - similarity) < 0.01
        assert max(bits) < odd_sketch.MOST_BITS


def test_sets_are_whole_texts():
    texts = pa.array(["a b c d e f", "A B", "", None])
    data, offsets = np.frombuffer(b"a b c d e fA B", np.uint8), np.array([0, 11, 14, 14, 14])
    owner, _ = shingle_sets(data, offsets, 5)
    assert np.bincount(owner, minlength=len(texts)).tolist() == [2, 1, 0, 0]
