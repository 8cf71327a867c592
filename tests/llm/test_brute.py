"""The learned and statistical operators against plain Python versions of the same methods."""

import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from metaudit.llm import common, language_model, mixing, near_dedup, pii, quality, toxicity
from metaudit.llm import tokens as tk
from tests.llm.test_learned import lower, split
from tests.llm.test_native import brute_spans, table


def crc(i):
    return zlib.crc32(str("" if i is None else i).encode())


# --- toxicity


def grams(text):
    w = regex.findall(r"[0-9a-z\u0080-\U0010ffff]+", lower(text or ""))
    return [*w, *zip(w, w[1:]), *((a, None, b) for a, b in zip(w, w[2:]))]


def test_features_are_grams():
    texts = ["a b a c", "", "A-b, c d é", "b c", None, "x"]
    place = {}
    for first, last, data, offsets in tk.runs(pa.array(texts)):
        owner, at = toxicity.features(data, offsets, 40)
        for k in range(first, last):
            mine, want = sorted(at[owner == k - first].tolist()), grams(texts[k])
            assert len(mine) == len(want)
            for g in set(want):
                place.setdefault(g, set())
    every = {g for t in texts for g in grams(t)}
    one = {g: None for g in every}
    # The same gram has the same place in every text, and different grams have different ones.
    joined = [" ".join(t or "" for t in texts)]
    for _, _, data, offsets in tk.runs(pa.array(joined)):
        assert len(set(toxicity.features(data, offsets, 40)[1].tolist())) == len(set(grams(joined[0])))
    assert len(one) == len(every)


def plain_ftrl(rows, labels, epochs, alpha, beta, l1):
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        shrink = 0.0 if k == "bias" else l1
        if abs(z[k]) <= shrink:
            return 0.0
        return (math.copysign(shrink, z[k]) - z[k]) / ((beta + math.sqrt(n[k])) / alpha)

    for _ in range(epochs):
        for places, y in zip(rows, labels):
            w = {k: weight(k) for k in [*places, "bias"]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for k, v in w.items():
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * v
                n[k] += g * g
    return {k: weight(k) for k in list(z)}


def test_toxicity_weights(spark, tmp_path):
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice(["vile", "x", "y"]) if k % 3 == 0 and rng.random() < 0.4 else f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 15)))) for k in range(120)]
    rows += [rows[3], rows[3], (3, "another text"), (None, "vile")]
    docs = table(spark, tmp_path, rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(110)] + [(3, 0), (5, None), (999, 1)], "doc_id bigint, toxic int")
    got = toxicity.train(docs, labels, "toxic", bits=16, l1=0.05)
    seen = docs.withColumn("h", common.text_hash()).withColumn("o", F.xxhash64("doc_id", "h", F.lit(7))).orderBy("o").collect()
    learned = {(r["doc_id"], r["text"]): r for r in seen if r["doc_id"] is not None and r["doc_id"] < 110}
    places = []
    for _, _, data, offsets in tk.runs(pa.array([t for _, t in learned])):
        owner, at = toxicity.features(data, offsets, 16)
        places = [sorted(set(at[owner == k].tolist())) for k in range(len(learned))]
    y = [int(i % 3 == 0) for i, _ in learned]
    want = plain_ftrl(places, y, 6, 1.0, 1.0, 0.05 * math.sqrt(min(sum(y), len(y) - sum(y))))
    vector = np.zeros(len(got))
    for k, v in want.items():
        vector[-1 if k == "bias" else k] = v
    assert np.allclose(got, vector, atol=1e-5) and (vector != 0).sum() > 5
    assert np.array_equal(got, toxicity.train(docs.repartition(3), labels, "toxic", bits=16, l1=0.05))


def test_the_sample_is_bounded(spark, tmp_path):
    rows = [(k % 40, f"t{k % 60}") for k in range(600)] + [(1, "t1")] * 500
    docs = table(spark, tmp_path, rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(50)], "doc_id bigint, q int")
    whole = common.sampled(docs, labels, "q", 10_000).collect()
    assert len(whole) == len({(i, t) for i, t in rows})
    some = [tuple(r) for r in common.sampled(docs, labels, "q", 7).collect()]
    assert len(some) == 7 and sorted(some) == sorted(tuple(r) for r in common.sampled(docs.repartition(5), labels, "q", 7).collect())


# --- quality


def plain_gam(x, y, bins, rounds, n_pairs, pair_rounds, rate=0.1, ridge=5.0):
    """The score of each row, from loops over rows."""
    n, m = len(x), len(x[0])
    share = min(max(sum(y) / n, 1e-3), 1 - 1e-3)
    logit = [math.log(share / (1 - share))] * n
    edges = [sorted(set(np.quantile([r[k] for r in x], [i / bins for i in range(1, bins)]).tolist())) for k in range(m)]
    b = [[sum(e <= r[k] for e in edges[k]) for k in range(m)] for r in x]
    size = [len(e) + 1 for e in edges]

    def slopes():
        p = [1 / (1 + math.exp(-v)) for v in logit]
        return [t - q for t, q in zip(y, p)], [q * (1 - q) for q in p]

    def cut(g, h):  # the best place to cut a list of bins
        best, at = None, 0
        for k in range(1, len(g)):
            gain = sum(g[:k]) ** 2 / (sum(h[:k]) + ridge) + sum(g[k:]) ** 2 / (sum(h[k:]) + ridge)
            if best is None or gain > best + 1e-12:
                best, at = gain, k
        return at

    def gather(cells, count):
        g, h = slopes()
        sg, sh = [0.0] * count, [0.0] * count
        for c, a, d in zip(cells, g, h):
            sg[c] += a
            sh[c] += d
        return sg, sh

    for _ in range(rounds):
        for k in range(m):
            cells = [r[k] for r in b]
            g, h = gather(cells, size[k])
            first = cut(g, h)
            marks = sorted({0, size[k], first, cut(g[:first], h[:first]), first + cut(g[first:], h[first:])})
            step = {}
            for lo, hi in zip(marks, marks[1:]):
                step |= {c: rate * sum(g[lo:hi]) / (sum(h[lo:hi]) + ridge) for c in range(lo, hi)}
            logit = [v + step[c] for v, c in zip(logit, cells)]
    gains = []
    for i, j in combinations(range(m), 2):
        cells = [(r[i] // 4) * bins + r[j] // 4 for r in b]
        g, h = gather(cells, bins * bins)
        gains.append((sum(s * s / (t + ridge) for s, t in zip(g, h)), i, j))
    for _ in range(pair_rounds):
        for _, i, j in sorted(gains, reverse=True)[:n_pairs]:
            g, h = gather([r[i] * size[j] + r[j] for r in b], size[i] * size[j])
            options = []
            for turned in (False, True):
                at = (lambda p, q: q * size[j] + p) if turned else (lambda p, q: p * size[j] + q)
                outer, inner = (size[j], size[i]) if turned else (size[i], size[j])
                sums = lambda v, ps, qs: sum(v[at(p, q)] for p in ps for q in qs)  # noqa: B023, E731
                first = cut([sums(g, [p], range(inner)) for p in range(outer)], [sums(h, [p], range(inner)) for p in range(outer)])
                step, gained = {}, 0.0
                for ps in (range(first), range(first, outer)):
                    if not ps:
                        continue
                    k = cut([sums(g, ps, [q]) for q in range(inner)], [sums(h, ps, [q]) for q in range(inner)])
                    for qs in (range(k), range(k, inner)):
                        s, t = sums(g, ps, qs), sums(h, ps, qs)
                        step |= {at(p, q): rate * s / (t + ridge) for p in ps for q in qs}
                        gained += s * s / (t + ridge)
                options.append((gained, step))
            step = options[1][1] if options[1][0] > options[0][0] else options[0][1]
            logit = [v + step[r[i] * size[j] + r[j]] for v, r in zip(logit, b)]
    return [1 / (1 + math.exp(-v)) for v in logit]


def test_quality_model():
    rng = np.random.default_rng(3)
    x = rng.random((150, 4)).round(2)
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 0.6) | (x[:, 2] > 0.9)).astype(float)
    options = {"bins": 8, "rounds": 6, "n_pairs": 2, "pair_rounds": 4}
    got = quality.fit(x, y, **options).score(x)
    assert np.allclose(got, plain_gam(x.tolist(), y.tolist(), **options), atol=1e-9)


# --- language model


def plain_mixture(texts, held):
    """log10 probability of each text: word pairs, words and a uniform part, mixed by buckets of the context's frequency."""
    train = [t for t, h in zip(texts, held) if not h]
    words, pairs = Counter(), Counter()
    for t in train:
        w = ["", *t, ""]
        words.update(w[1:])
        pairs.update(zip(w, w[1:]))
    n, v = sum(words.values()), len(words)
    bucket = lambda c: int(math.log2(c)) + 1 if c > 0 else 0
    events = defaultdict(Counter)
    for t in train:
        w = ["", *t, ""]
        for u, x in zip(w, w[1:]):
            c = words[u] - 1
            events[bucket(c)][(pairs[u, x] - 1) / max(c, 1), (words[x] - 1) / (n - 1), 1 / (v + 1)] += 1
    weights, last = {}, (0.0, 0.9, 0.1)
    for b in range(65):
        if events[b]:
            w, total = (1 / 3, 1 / 3, 1 / 3), sum(events[b].values())
            for _ in range(50):
                share = [0.0, 0.0, 0.0]
                for f, k in events[b].items():
                    mixed = sum(a * p for a, p in zip(w, f))
                    for i in range(3):
                        share[i] += k * w[i] * f[i] / mixed
                w = tuple(s / total for s in share)
            w = tuple(max(a, 1e-6) for a in w)
            last = tuple(a / sum(w) for a in w)
        weights[b] = last
    weights[0] = (0.0, *(a / sum(weights[0][1:]) for a in weights[0][1:]))
    out = []
    for t in texts:
        w = ["", *t, ""]
        out.append(sum(math.log10(weights[bucket(words[u])][0] * pairs[u, x] / max(words[u], 1) + weights[bucket(words[u])][1] * words[x] / n + weights[bucket(words[u])][2] / (v + 1)) for u, x in zip(w, w[1:])))
    return out


def test_language_model_score(spark, tmp_path):
    """Estimates are told apart by an eighth of an octave for the weights only, so scores differ by little."""
    rng = random.Random(4)
    rows = []
    for k in range(500):
        w = [rng.choice(["the", "of", f"w{int(rng.paretovariate(0.7))}"])]
        for _ in range(rng.randint(0, 40)):
            w.append("end" if w[-1] == "the" and rng.random() < 0.6 else rng.choice(["the", "of", f"w{int(rng.paretovariate(0.7))}"]))
        rows.append((k, " ".join(w)))
    rows += [(500, ""), (501, None), (7, rows[7][1])]
    docs = table(spark, tmp_path, rows, "doc_id bigint, text string")
    want = plain_mixture([split(t) for _, t in rows], [crc(i) % 7 == 2 for i, _ in rows])
    by = defaultdict(set)
    for (i, _), s in zip(rows, want):
        by[i].add(s)
    for size in (24 << 20, 2000):  # one bucket, and many
        got = language_model.score_texts(docs, bucket_bytes=size).collect()
        assert len(got) == len(rows)
        for r in got:
            assert all(abs(r["score"] - s) <= 0.01 * abs(s) + 0.01 for s in by[r["doc_id"]])


# --- personal data


def plain_added(texts, dev=1.96, bits=4.0, generalise=0.6, remove=0.9):
    """{text number: spans added by the method}"""
    term = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}'’-]*[\p{L}\p{N}]")
    held, terms, places = [], [], []
    for t in texts:
        own, free = set(), list(t)
        for a, kind, z in brute_spans(t):
            digits = "".join(c for c in t[a:z] if c.isdigit())
            value = t[a:z].lower() if kind < 2 else digits
            part = (value.rpartition("@")[2], ".".join(value.split(".")[:3]), digits[:6], digits[:4])[kind]
            own |= {(kind, value), (kind, "part", part)}
            free[a:z] = " " * (z - a)
        held.append(own)
        places.append([(m.start(), m.end(), m.group().lower()) for m in term.finditer("".join(free))])
        terms.append({p[2] for p in places[-1]})
    total, n_c, n_t, n_ct = len(texts), Counter(c for h in held for c in h), Counter(w for t in terms for w in t), Counter()
    for h, t in zip(held, terms):
        n_ct.update((c, w) for c in h for w in t)
    out = {}
    for k, (h, t) in enumerate(zip(held, terms)):
        kinds = {}
        for c in h:
            usual = n_c[c] / total
            if n_c[c] == total:
                continue
            for w in t:
                given, n = n_ct[c, w] / n_t[w], n_t[w]
                low = (given + dev**2 / (2 * n) - dev * math.sqrt(given * (1 - given) / n + dev**2 / (4 * n * n))) / (1 + dev**2 / n)
                kinds[w] = max(kinds.get(w, -math.inf), 1 + math.log2(low) / min(-math.log2(usual), bits))
        out[k] = sorted((a, 5 if kinds[w] >= remove else 4, z) for a, z, w in places[k] if kinds.get(w, 0) >= generalise)
    return out


def test_added_spans(spark):
    rng = random.Random(9)
    common_words = ["the", "on", "mail", "visit", "é😀x", "call", "it's", "re-use"]
    texts = []
    for k in range(400):
        w = [rng.choice(common_words) for _ in range(rng.randint(0, 12))]
        who = rng.randint(0, 25)
        if rng.random() < 0.5:
            w.insert(0, f"Name{who}")
            w.append(f"u{who}@d{who % 4}.org" if who < 13 else rng.choice([f"10.0.{who}.7", "4111 1111 1111 1111", f"+49 170 12345{who:02d}"]))
            w.append(rng.choice(["", f"and x{k}@d1.org", "10.0.0.1-Zed"]))
        elif rng.random() < 0.2:
            w.append(f"Name{who}")
        texts.append(" ".join(w))
    rows = [(k, t) for k, t in enumerate(texts)]
    want = plain_added(texts)
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["added"]] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want and sum(map(len, want.values())) > 100 and {k for v in want.values() for _, k, _ in v} == {4, 5}


def planted(documents, people=20, seed=5):
    """Texts of which each person's address stands in four; a code name stands in the same four, beside ordinary words of any frequency, rare ones too."""
    rng = random.Random(seed)
    texts = [[f"w{int(rng.paretovariate(0.6))}" for _ in range(30)] + [f"only{k}x{j}" for j in range(3)] for k in range(documents)]
    for k, d in enumerate(rng.sample(range(documents), 4 * people)):
        texts[d] += [f"Code{k // 4}name", f"p{k // 4}@shared.org" if k // 4 % 2 else f"p{k // 4}@own{k // 4}.org"]
    for k in rng.sample(range(documents), documents // 20):
        texts[k].append(f"q{k}@shared.org")
    for t in texts:
        rng.shuffle(t)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("documents", [500, 10_000])
def test_planted_terms_at_two_corpus_sizes(spark, documents):
    """All code names are found and few ordinary words, whatever the size of the corpus."""
    texts = planted(documents)
    got = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).filter("size(added) > 0").collect()
    marked = [r["text"][s["start"] : s["end"]] for r in got for s in r["added"]]
    right = sum(m.startswith("Code") for m in marked)
    words = sum(len(r.split()) for r in texts if "@" in r)
    print(f"{documents} documents: {right} of 80 places of planted terms, {len(marked) - right} of {words} other words beside addresses")
    assert right == 80 and len(marked) - right <= 8


# --- near copies


def plain_groups(texts, similarity=0.8, size=5):
    sets = []
    for t in texts:
        w = split(t)
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    label = list(range(len(texts)))
    find = lambda x: x if label[x] == x else find(label[x])
    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a == b or (a & b and len(a & b) >= similarity * len(a | b)):
            label[max(find(i), find(j))] = min(find(i), find(j))
    return [find(k) for k in range(len(texts))]


def test_near_groups(spark, tmp_path):
    rng = random.Random(11)
    texts = ["", None, " \t", "a b", "A  b", "a b c", "one two three four five", "One two three four five", "one two three four six"]
    for _ in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"v{rng.randint(0, 99)}"
            texts.append(" ".join(w))
            if rng.random() < 0.2:
                texts.append(texts[-1].upper())
    rows = list(enumerate(texts)) + [(None, texts[20]), (5, "a b c")]
    docs = table(spark, tmp_path, rows, "doc_id bigint, text string")
    want = plain_groups([t for _, t in rows])
    lowest = {}
    for (i, _), c in zip(rows, want):
        lowest[c] = min(lowest.get(c, 1 << 40), 1 << 40 if i is None else i)
    want = Counter((i, lowest[c]) for (i, _), c in zip(rows, want))
    assert len(set(lowest.values())) < 0.9 * len(rows)
    for tile_rows in (8192, 16):
        got = Counter((r["doc_id"], r["component_id"]) for r in near_dedup.near_groups(docs, tile_rows=tile_rows).collect())
        assert got == want
    kept = [r["doc_id"] for r in near_dedup.drop_near_copies(docs).collect()]
    assert sorted(kept) == sorted(lowest.values())


# --- mixing


def plain_mix(rows, targets, block_rows=100_000):
    """How often each row of (doc_id, source, text) is taken; one block a source's size octave."""
    import hashlib

    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    by = defaultdict(list)
    for k, (i, source, text) in enumerate(rows):
        size = len(split(text))
        key = hashlib.md5(f"{'' if i is None else i}|{text or ''}".encode()).hexdigest()
        by[source].append((len(f"{size:b}"), size, i is not None, i or 0, key, k))
    out = Counter()
    for source, own in by.items():
        words = sum(o[1] for o in own)
        each = targets[source] / words if words else 0.0
        offset = number(f"mix|{source or ''}") / 4294967296
        for rank, o in enumerate(sorted(own), 1):
            i, _, text = rows[o[-1]]
            out[i, text] += math.floor(each * rank + offset) - math.floor(each * (rank - 1) + offset)
    return +out


def test_mixed_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, rng.choice(["a", "b", "c", None]), " ".join("w" for _ in range(rng.randint(0, 30)))) for k in range(600)] + [(None, "a", "x y"), (5, "b", None), (6, "b", "w w"), (6, "b", "w w")]
    docs = table(spark, tmp_path, rows, "doc_id bigint, source string, text string")
    targets = {r["source"]: r["target"] for r in mixing.plan_copies(docs).select("source", "target").distinct().collect()}
    got = Counter((r["doc_id"], r["text"]) for r in mixing.mix_sources(docs).collect())
    assert got == plain_mix(rows, targets)
