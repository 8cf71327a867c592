"""Centroid clustering against comparing all distances."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaudit.llm import centroids


def lloyd(kept, k, rounds, seed="2"):
    """{row: (cluster, distance)} and the centroids, from (vec_id, integers)."""
    order = sorted(range(len(kept)), key=lambda r: (hashlib.sha256(f"{seed}:{'' if kept[r][0] is None else kept[r][0]}".encode()).hexdigest(), kept[r][1]))
    c = [list(kept[r][1]) for r in order[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            if mine := [v for (_, v), o in zip(kept, own, strict=True) if o == j]:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [near(v)[::-1] for _, v in kept], c


def test_search_is_exact_with_ties():
    rng = np.random.default_rng(5)
    v = rng.integers(-3, 4, (3000, 3))  # many equal distances and equal centroids
    c = np.concatenate([rng.integers(-3, 4, (20, 3)), v[:5], v[:5]])
    state = np.full(len(v), -1, np.int32), np.full(len(v), -1, np.int32), np.zeros(len(v)), np.zeros(len(v))
    before = c
    for _ in range(8):
        centroids.Search(c, before).assign(v, *state)
        apart = ((v[:, None] - c[None]) ** 2).sum(2)
        assert (state[0] == apart.argmin(1)).all()
        rest = apart.copy()
        rest[np.arange(len(v)), state[0]] = 1 << 40
        assert (state[3] <= np.sqrt(rest.min(1)) + 1e-12).all() and (state[2] >= np.sqrt(apart.min(1)) - 1e-12).all()
        before, c = c, c + rng.integers(-1, 2, c.shape)


def test_bounds_spare_most_searches(monkeypatch):
    rng = np.random.default_rng(6)
    c = rng.integers(-5000, 5000, (30, 8))
    v = c[rng.integers(0, 30, 20_000)] + rng.integers(-200, 201, (20_000, 8))
    state = np.full(len(v), -1, np.int32), np.full(len(v), -1, np.int32), np.zeros(len(v)), np.zeros(len(v))
    centroids.Search(c, c).assign(v, *state)
    searched = []
    monkeypatch.setattr(centroids.Search, "_search", lambda self, rows, *a, f=centroids.Search._search: (searched.append(len(rows)), f(self, rows, *a)))
    centroids.Search(c + 1, c).assign(v, *state)
    assert sum(searched) < 200


@pytest.mark.parametrize("k", [1, 2, 7, 500])
def test_clusters_match_brute_force(spark, k):
    rng = np.random.default_rng(k)
    data = [(int(n), [float(x) for x in rng.normal(size=4)]) for n in rng.integers(0, 150, 200)]  # ids repeat
    data += [(500, data[0][1])] * 40 + [(None, data[1][1])]
    odd = [(600, None), (601, []), (602, [1.0, 2.0, 3.0]), (603, [1.0, None, 0.0, 0.0]), (604, [float("nan"), 0.0, 0.0, 0.0]), (605, [float("inf"), 0.0, 0.0, 0.0]), (606, [1e9, 0.0, 0.0, 0.0])]
    docs = spark.createDataFrame(data + odd, "vec_id bigint, embedding array<double>").withColumns({c: F.lit("x") for c in ("v", "near", "distance", "a.b", "cluster")})
    rows, about = centroids.cluster(docs, k, dims=4)
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in data]
    want, c = lloyd(kept, k, 5)
    got = sorted((str(r["vec_id"]), list(r["v"]), r["near"], r["distance"]) for r in rows.collect())
    assert got == sorted((str(i), v, *w) for (i, v), w in zip(kept, want, strict=True))
    assert [list(a[1]) for a in about] == c
    assert sum(a[3] for a in about) == sum(w[1] for w in want) and sum(a[2] for a in about) == len(kept)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    rows, about = centroids.cluster(docs)
    assert rows.count() == 0 and about == []
    docs.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert centroids.query(spark, str(tmp_path)).count() == 0
