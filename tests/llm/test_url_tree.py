"""The template tree against a plain Python version."""

import math
import random

import pytest
from pyspark.sql import functions as F

from metaudit.llm import url_filter


def similar(n, b, fn, fb, z):
    share = (fb + 1) / (fn + 2)
    return abs((b + share) / (n + 1) - share) <= z * math.sqrt(share * (1 - share) / (n + 1))


def brute(rows, max_children=16, z=1.96, strength=4.0):
    """{(host, shape): (template, labelled, bad, purity)}"""
    tree = {}
    for host, shape, bad in rows:
        t = tree.setdefault((host, shape), [shape, 0, 0])
        t[1] += bad is not None
        t[2] += bool(bad)
    star = lambda t, k: (*t[:k], "*", *t[k + 1 :])
    levels = max((len(shape) for _, shape, _ in rows), default=0)
    for k in range(levels):
        kids, family = {}, {}
        for (host, _), (t, n, b) in tree.items():
            if len(t) > k:
                for table, key in ((kids, (host, t[:k], t[k])), (family, (host, t[:k]))):
                    x = table.setdefault(key, [0, 0])
                    x[0] += n
                    x[1] += b
        many = {f for f in family if sum(key[:2] == f for key in kids) > max_children}
        for (host, _), e in tree.items():
            f = (host, e[0][:k])
            if len(e[0]) > k and f in many and similar(*kids[*f, e[0][k]], *family[f], z):
                e[0] = star(e[0], k)
    for k in reversed(range(levels)):
        branch, pooled = {}, {}
        for (host, _), (t, n, b) in tree.items():
            if len(t) > k:
                for table, key in ((branch, (host, t)), (pooled, (host, star(t, k)))):
                    x = table.setdefault(key, [0, 0])
                    x[0] += n
                    x[1] += b
        for (host, _), e in tree.items():
            if len(e[0]) > k:
                (n, b), (fn, fb) = branch[host, e[0]], pooled[host, star(e[0], k)]
                if similar(n, b, fn, fb, z):
                    e[0] = star(e[0], k)
    n, b = sum(e[1] for e in tree.values()), sum(e[2] for e in tree.values())
    out = {}
    for (host, shape), (t, _, _) in tree.items():
        own = [e for (h, _), e in tree.items() if h == host]
        prior = (sum(e[2] for e in own) + strength * (b + 1) / (n + 2)) / (sum(e[1] for e in own) + strength)
        tn, tb = (sum(e[k] for e in own if e[0] == t) for k in (1, 2))
        out[host, shape] = (t, tn, tb, round((tb + strength * prior) / (tn + strength), 9))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_tree(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(1500):
        host = rng.choice(["a.net", "a.net", "b.net", "c.net"])
        first = rng.choice(["news", "spam", "shop", "{n}"])
        shape = (first, *(rng.choice([f"p{rng.randint(0, 30)}", "x", "{n}"]) for _ in range(rng.randint(0, 3))))
        bad = None if rng.random() < 0.4 else rng.random() < (0.9 if first == "spam" else 0.1)
        rows.append((host, shape, bad))
    frame = spark.createDataFrame([(h, list(s), b) for h, s, b in rows], "host string, shape array<string>, is_bad boolean")
    got = {(r["host"], tuple(r["shape"])): (tuple(r["template"]), r["labelled"], r["bad"], r["purity"]) for r in url_filter.template_tree(frame).withColumn("purity", F.round("purity", 9)).collect()}
    assert got == brute(rows)
