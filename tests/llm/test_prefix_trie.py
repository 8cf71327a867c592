"""The prefix trie against a plain one."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaudit.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    """{(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)}"""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}\n{role or ''}\n{text or ''}".encode()).digest(), text or ""))
    whole = {c: [(r, x) for *_, r, _, x in sorted(t)] for c, t in convs.items()}
    built = {}
    for c, own in whole.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = whole.get(c - c % 20, [])[:h] + own[h:]
    member = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            member.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in member:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, {}
    for p in sorted(member, key=len, reverse=True):
        low = children.get(p, [])
        leaves[p] = sum(leaves[x] for x in low) if low else 1
        saved[p] = sum(saved[x] for x in low) + (len(member[p]) - 1) * (len(p[-1][1].split()) if p else 0)
        ends = ",".join(str(c) for c in sorted(member[p]) if len(built[c]) == len(p))
        out[min(member[p]), len(p)] = (min(member[p[:-1]]) if p else None, len(member[p]), len(low), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())
    return out


def result(df):
    got = [((r["conv_id"], r["depth"]), (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"])) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def shared_starts(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b b", "c c c"])))
    rows += [(20 * n, t, "user", f"w{t}") for t in range(150)]  # one long conversation, and one that goes the same way
    rows += [(20 * n + 1, t, "user", f"w{t}") for t in range(140)]
    rows += [(20 * n + 20 + k, 0, "user", "same") for k in range(40)]
    odd = [(7, None, None, None), (7, None, "user", None), (9, 3, "x", "tie"), (9, 3, "x", "tie"), (9, 3, "w", "tie"), (None, 0, "user", "lost"), (5 * 20 * n, 0, "", "")]
    rows += odd
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "block"), [(1, 60, 10**6), (2, 40, 30), (3, 12, 5)])
def test_nodes_match_a_plain_trie(spark, seed, n, block):
    rows = shared_starts(seed, n)
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("depth", "member", "k1", "_part", "place", "a.b")})
    assert result(prefix_trie.prefix_trie(table, block=block)) == plain(rows)


def test_a_conversation_in_many_parts(spark, monkeypatch):
    """Hash parts of a conversation, and ids in small pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE", 8)
    rows = [(40, t, "user", f"w{t % 7}") for t in range(3000)] + [(c, t, "user", "one") for c in range(100, 180) for t in range(2)]
    assert result(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(4), block=2000)) == plain(rows)


@pytest.mark.parametrize("kind", ["chain", "star", "random", "forest"])
def test_decomposition_is_balanced_and_right(kind):
    rng = random.Random(4)
    n = 3000
    parent = {"chain": range(-1, n - 1), "star": [-1] + [0] * (n - 1), "random": [-1, *(rng.randrange(k) for k in range(1, n))], "forest": [-1 if k % 100 == 0 else rng.randrange(k - k % 100, k) for k in range(n)]}[kind]
    parent, worth = list(parent), np.array([[rng.randrange(5), rng.randrange(100)] for _ in range(n)])
    parts, root = {}, [0] * n
    for k in range(n):
        root[k] = k if parent[k] < 0 else root[parent[k]]
        parts.setdefault(root[k], []).append(k)
    want = worth.copy()
    for k in range(n - 1, -1, -1):
        if parent[k] >= 0:
            want[parent[k]] += want[k]
    assert (prefix_trie.decompose(parent, worth, list(parts.values())) == want).all()


def test_empty_table(spark, tmp_path):
    table = spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)
    assert prefix_trie.prefix_trie(table).count() == 0 and prefix_trie.prefix_trie(table.limit(0)).count() == 0
