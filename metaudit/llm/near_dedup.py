"""SimHash near-dedup: tiled exact comparison of fingerprints with exclusive-or and bit counts.

Each text gets a 64-bit SimHash of its word shingles. Distinct fingerprints within ``radius`` bits of each
other are linked. Two such fingerprints agree on at least one of radius + 1 bands of bits, so tiles only
meet within a band's value; that loses no link. Within it all pairs of tiles are compared exactly with
numpy, a window of population counts at a time: pairs whose counts differ by more than the radius are
skipped. A value with many fingerprints is cut into tiles of one population count and a hash, of about
``tile_rows`` rows, and only tiles whose counts lie within the radius meet.

A pair of tiles gives the edges of a spanning forest, not all pairs. Components are found by large-star
and small-star rounds over those edges, each written to the shared folder.

``near_groups`` and ``drop_near_copies`` take the similarity of sets of five words instead. Fingerprints of two
words of 64 bits, compared in tiles in the same way within classes of set sizes that 0.8 allows, find the
pairs that may reach it, bitmaps of the sets rule out most of those that don't, and the sets of each pair that is
left are compared exactly. A pair that differs in more
bits than RADII is lost; that is about one in a thousand at a similarity of just 0.8.

Defined results: a null or empty text, or one of white space alone, has fingerprint zero and is linked as
any other (its set is empty, like that of others without words); fewer words than a shingle are one shingle; equal texts share a fingerprint; a component's id is
its smallest document id, nulls apart (null if it has none); rows that repeat are rows of their own; an
empty table gives an empty result; extra columns are ignored or kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .common import among, conf_set, located, materialise, packed, table, without

_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 256))
#: Shingles whose bits are added up at a time.
_STEP = 1 << 15


def simhash(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    words = text.translate(_LOWER).split()  # at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, _STEP):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(first[k : k + _STEP], last[k : k + _STEP], strict=True)], np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(docs: DataFrame, keep: list[str] = (), shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, row): the fingerprint as a signed 64-bit number; ``row`` has the columns ``keep``."""
    row = packed(keep) if keep else F.lit(None).cast("int")
    rows = docs.select(F.col("text").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"))
    schema = rows.select("doc_id", F.lit(0).cast("long").alias("fp"), "row").schema

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((simhash(t, shingle, seed) for _, _, d, o in tk.runs(batch.column(0)) for t in (d[a:b].tobytes() for a, b in zip(o[:-1], o[1:], strict=True))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(fp.view(np.int64)), batch.column(2)], ["doc_id", "fp", "row"])

    return rows.mapInArrow(sign, schema)


def components_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each of ``n`` nodes' components under the edges (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    while (label != (up := label[label])).any():
        label = up
    return label


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between two tiles, or within one."""
    own = right is None
    right = left if own else right
    left, right = (x[np.argsort(np.bitwise_count(x), kind="stable")] for x in (left, right))
    lc, rc = np.bitwise_count(left).astype(int), np.bitwise_count(right).astype(int)
    n = len(left)
    edges_i, edges_j = [], []
    for a in range(0, n, 256):
        b = min(a + 256, n)
        lo, hi = np.searchsorted(rc, lc[a] - radius, "left"), np.searchsorted(rc, lc[b - 1] + radius, "right")
        if hi <= lo:
            continue
        near = np.bitwise_count(left[a:b, None] ^ right[None, lo:hi]) <= radius
        i, j = np.nonzero(near)
        i, j = i + a, j + lo
        if own:
            i, j = i[i < j], j[i < j]
        edges_i.append(i)
        edges_j.append(j if own else j + n)
    if not edges_i or not sum(map(len, edges_i)):
        return left[:0], left[:0]
    label = components_of(n if own else n + len(right), np.concatenate(edges_i), np.concatenate(edges_j))
    nodes = left if own else np.concatenate([left, right])
    child = np.flatnonzero(label != np.arange(len(label)))
    u, v = nodes[child], nodes[label[child]]
    return u[u != v], v[u != v]


def bands(fp: Column, radius: int) -> Column:
    """radius + 1 disjoint runs of bits that cover all 64."""
    count = radius + 1
    cuts = [64 * k // count for k in range(count + 1)]
    return F.array(*[F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def links(prints: DataFrame, radius: int, tile_rows: int = 4096) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (fp) that connect all that lie within the radius, directly or not."""
    keys = prints.select("fp", F.posexplode(bands(F.col("fp"), radius)).alias("band", "value"))
    large = keys.groupBy("band", "value").agg(F.count("*").alias("n")).filter(F.col("n") > tile_rows)
    large = materialise(large, "large")
    placed = keys.join(large, ["band", "value"], "left").select(
        "band", "value", "fp",
        F.when(F.col("n").isNull(), F.lit(-1)).otherwise(F.bit_count("fp")).alias("ones"),
        F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / tile_rows))).cast("int").alias("part"),
    )
    tiles = placed.groupBy("band", "value", "ones", "part").agg(F.collect_list("fp").alias("tile"))
    none = F.lit(None).cast("array<bigint>")
    within = tiles.filter("ones < 0 AND size(tile) > 1").select(F.col("tile").alias("l"), none.alias("r"))
    # Tiles meet by their keys; the fingerprints then come to each pair by both keys, so no task makes all pairs of a value with their contents.
    key = F.struct("band", "value", "ones", "part")
    names = placed.filter("ones >= 0").select("band", "value", "ones", "part").distinct().select("band", "value", F.col("ones").alias("o"), key.alias("k"))
    a, b = (names.select("band", "value", F.col("o").alias(f"{x}o"), F.col("k").alias(f"{x}k")) for x in "lr")
    meets = (F.col("lk") <= F.col("rk")) & (F.col("ro") - F.col("lo") <= radius)
    cut = tiles.filter("ones >= 0").select(key.alias("k"), "tile")
    pairs = a.join(b, ["band", "value"]).filter(meets).select("lk", "rk")
    left = pairs.join(cut.select(F.col("k").alias("lk"), F.col("tile").alias("l")), "lk")
    across = left.join(cut.select(F.col("k").alias("rk"), F.col("tile").alias("r")), "rk").select("l", F.when(F.col("lk") != F.col("rk"), F.col("r")).alias("r"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            l, r = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                x = l[k].values.to_numpy().view(np.uint64)
                y = r[k].values.to_numpy().view(np.uint64) if r[k].is_valid else None
                u, v = forest(x, y, radius)
                us.append(u)
                vs.append(v)
            u, v = (np.concatenate(e).view(np.int64) if e else np.zeros(0, np.int64) for e in (us, vs))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    found = within.mapInArrow(compare, "u long, v long")
    if not large.isEmpty():
        found = found.unionByName(across.repartition(F.xxhash64("l", "r")).mapInArrow(compare, "u long, v long"))
    return found.distinct()


def connect(edges: DataFrame, label: str = "stars") -> DataFrame:
    """(node, root): the least node of each component, for all nodes of the edges (u, v) but the roots.

    Large-star and small-star rounds; each node's least neighbour is a plain aggregate, so a hub is no group."""
    state, before = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), label), None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        state = materialise(small, label)


def _group(signed: DataFrame, radius: int) -> DataFrame:
    """(doc_id, fp, component_id) of signed rows."""
    prints = materialise(signed.groupBy("fp").agg(F.min("doc_id").alias("low")), "prints")
    roots = connect(links(prints, radius))
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    lows = members.join(prints, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("low").alias("component"))
    linked = members.join(lows, "root").select(F.col("node").alias("fp"), "component")
    named = prints.join(linked, "fp", "left").select("fp", F.coalesce("component", "low").alias("component_id"))
    return signed.join(named, "fp").select("doc_id", "fp", "component_id")


def find_groups(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): one row a document, by fingerprints alone."""
    return _group(materialise(fingerprints(docs, (), shingle, seed).select("doc_id", "fp"), "signed"), radius)


# --- near copies by the similarity of their sets of shingles; fingerprints find the pairs to be compared

#: Salts of what is made of a shingle's hash: the second word of the fingerprint, the digest and the bitmap of the set.
_SECOND, _DIGEST, _BITMAP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Bits of the bitmap in which each shingle of a set turns one bit over: sets differ in as many shingles at least as their bitmaps do in bits.
BITMAP = 1024
#: Bits in which the first word, and both words, may differ for a pair to be compared. At a similarity of 0.8
#: a bit differs with a chance of 0.15: 9.7 of 64 on average, with a deviation of 2.9, and 19.4 of 128 with 4.1.
RADII = (20, 32)
#: Distance of both words below which most pairs are near copies, and how many such pairs of a set are tried besides its nearest.
LIKELY, PICKS = 20, 3


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct shingles of a run of texts, sorted; fewer words than a shingle are one."""
    starts, ends, owner = tk.words(data, offsets, tk.NOT_SPACE)
    h = tk.word_hashes(data, starts, ends)
    count = np.bincount(owner, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    owners, hashes, now = [], [], h
    for size in range(1, shingle + 1):  # ``now`` has the hashes of all runs of ``size`` words
        at = first[count == size] if size < shingle else np.flatnonzero(owner[: len(now)] == owner[size - 1 :])
        owners.append(owner[at])
        hashes.append(now[at])
        if size < shingle:
            now = tk.combine(now[:-1], h[size:], size) if len(now) else now
    o, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((h, o))
    o, h = o[order], h[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    return o[new], h[new]


def _words_of(owner: np.ndarray, h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A 64-bit SimHash of each set."""
    ones = np.zeros((len(count), 64), np.int64)
    for k in range(0, len(h), _STEP):
        o = owner[k : k + _STEP]
        at = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        ones[o[at]] += np.add.reduceat(np.unpackbits(h[k : k + _STEP].astype(">u8").view(np.uint8)).reshape(-1, 64), at, 0, np.int64)
    return np.packbits(2 * ones > count[:, None], 1).view(">u8").ravel().astype(np.uint64)


def _bitmaps(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """The bitmap of each set, a row of bytes."""
    cell = (tk.mix(h ^ _BITMAP) % np.uint64(BITMAP)).astype(np.int64)
    out = np.zeros((n, BITMAP // 8), np.uint8)
    for k in range(0, n, 4096):
        a, b = np.searchsorted(owner, [k, k + 4096])
        m = min(4096, n - k)
        out[k : k + m] = np.packbits((np.bincount((owner[a:b] - k) * BITMAP + cell[a:b], minlength=m * BITMAP) & 1).astype(np.uint8).reshape(m, BITMAP), 1)
    return out


def sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """(at, doc_id, size, f0, f1, digest, bits) of (text, at, doc_id): size of the set of shingles, 128-bit SimHash, digest and bitmap of the set."""
    schema = texts.select("at", "doc_id", *[F.lit(0).cast("long").alias(c) for c in ("size", "f0", "f1", "digest")], F.lit(b"").alias("bits")).schema

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, bits = [], []
            for first, last, data, offsets in tk.runs(batch.column(0)):
                owner, h = shingle_sets(data, offsets, shingle)
                bits += [b.tobytes() for b in _bitmaps(owner, h, last - first)]
                count = np.bincount(owner, minlength=last - first)
                digest = np.zeros(last - first, np.uint64)
                np.add.at(digest, owner, tk.mix(h ^ _DIGEST))
                made.append(np.stack([count.astype(np.int64), *[x.view(np.int64) for x in (_words_of(owner, h, count), _words_of(owner, tk.mix(h ^ _SECOND), count), digest)]]))
            columns = np.concatenate(made, 1) if made else np.zeros((4, 0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *map(pa.array, columns), pa.array(bits, pa.binary())], ["at", "doc_id", "size", "f0", "f1", "digest", "bits"])

    return texts.select("text", "at", "doc_id").mapInArrow(make, schema)


def near_pairs(a: np.ndarray, b: np.ndarray | None, similarity: float, radii: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the pairs of two tiles, or within one, that may be near copies, some rows of the first at a time.

    A tile is a record array with f0, f1, size and bits, ordered by the population count of f0. Bitmaps that differ in more bits
    than sets of this similarity can differ in shingles rule a pair out for certain."""
    own, b = b is None, a if b is None else b
    ac, bc = np.bitwise_count(a["f0"]).astype(int), np.bitwise_count(b["f0"]).astype(int)
    for k in range(0, len(a), 256):
        m = min(k + 256, len(a))
        lo, hi = np.searchsorted(bc, ac[k] - radii[0], "left"), np.searchsorted(bc, ac[m - 1] + radii[0], "right")
        if hi <= lo:
            continue
        i, j = np.nonzero(np.bitwise_count(a["f0"][k:m, None] ^ b["f0"][None, lo:hi]) <= radii[0])
        i, j = i + k, j + lo
        if own:
            i, j = i[i < j], j[i < j]
        apart = np.bitwise_count(a["f0"][i] ^ b["f0"][j]).astype(int) + np.bitwise_count(a["f1"][i] ^ b["f1"][j])
        x, y = a["size"][i], b["size"][j]
        may = (apart <= radii[1]) & (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9)
        i, j, apart = i[may], j[may], apart[may]
        most = (1 - similarity) / (1 + similarity) * (a["size"][i] + b["size"][j]) + 1e-9
        may = np.concatenate([np.bitwise_count(a["bits"][i[q : q + 65536]] ^ b["bits"][j[q : q + 65536]]).sum(1, np.int64) for q in range(0, len(i), 65536)] or [np.zeros(0, np.int64)]) <= most
        yield i[may], j[may], apart[may]


_TILE = np.dtype([("f0", np.uint64), ("f1", np.uint64), ("size", np.int64), ("sid", np.int64), ("root", np.int64), ("bits", np.uint64, (BITMAP // 64,))])


def _tile(column: pa.Array, k: int) -> np.ndarray:
    fields = column[k].values
    out = np.zeros(len(fields), _TILE)
    out["bits"] = np.frombuffer(b"".join(fields.field("bits").to_pylist()), np.uint64).reshape(out["bits"].shape)
    for name in _TILE.names[:-1]:
        out[name] = fields.field(name).to_numpy().astype(np.int64).view(_TILE[name])
    return out[np.argsort(np.bitwise_count(out["f0"]), kind="stable")]


def _tile_pairs(sets: DataFrame, similarity: float, tile_rows: int) -> DataFrame:
    """(l, r): pairs of tiles of the sets (sid, size, f0, f1, root) whose sizes may be near enough; r is null for a tile with itself.

    Sets of similar texts lie in one class of sizes or in two that adjoin."""
    width = float(np.log(1 / similarity * (1 + 1e-4)))
    classed = sets.withColumn("c", F.when(F.col("size") > 0, F.floor(F.log(F.col("size").cast("double")) / width)).otherwise(F.lit(-2)).cast("int"))
    sizes = classed.groupBy("c").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("parts"))  # a row a class
    placed = classed.join(F.broadcast(sizes), "c").withColumn("p", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    tiles = materialise(placed.groupBy("c", "p").agg(F.collect_list(F.struct(*_TILE.names)).alias("tile")), "tiles")
    a, b = (tiles.select(F.col("c").alias(f"{x}c"), F.col("p").alias(f"{x}p")) for x in "lr")
    meets = a.join(b.withColumn("lc", F.explode(F.array(F.col("rc"), F.col("rc") - 1))), "lc").filter("lc < rc OR lp <= rp")
    of = lambda x: tiles.select(F.col("c").alias(f"{x}c"), F.col("p").alias(f"{x}p"), F.col("tile").alias(x))
    met = meets.join(of("l"), ["lc", "lp"]).join(of("r"), ["rc", "rp"])
    return met.select("l", F.when((F.col("lc") != F.col("rc")) | (F.col("lp") != F.col("rp")), F.col("r")).alias("r"))


def _candidates(sets: DataFrame, similarity: float, radii: tuple[int, int], tile_rows: int, few: bool) -> DataFrame:
    """(u, v) of sets with different roots, written: for each set its nearest candidate and some of those that are likely (``few``), or all candidate pairs."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a = _tile(batch.column(0), k)
                b = _tile(batch.column(1), k) if batch.column(1)[k].is_valid else None
                right, shift = (a, 0) if b is None else (b, len(a))
                both = a if b is None else np.concatenate([a, b])
                none = np.iinfo(np.int64).max
                best = np.full((PICKS + 1, len(both)), none)
                for i, j, apart in near_pairs(a, b, similarity, radii):
                    differ = a["root"][i] != right["root"][j]
                    i, j, apart = i[differ], j[differ], apart[differ]
                    u, v = a["sid"][i], right["sid"][j]
                    if not few:
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.zeros(len(u), np.int64)), pa.array(apart)], ["u", "v", "pick", "score"])
                        continue
                    for pick in range(PICKS + 1):  # the nearest, then the least by a hash of the pair
                        x, y, score = i, j + shift, apart
                        if pick:
                            near = apart <= LIKELY
                            x, y = x[near], y[near]
                            low, high = np.minimum(u[near], v[near]), np.maximum(u[near], v[near])
                            score = (tk.mix(tk.combine(low.view(np.uint64), high.view(np.uint64), pick)) >> np.uint64(41)).astype(np.int64)
                        np.minimum.at(best[pick], x, score << 40 | y)
                        np.minimum.at(best[pick], y, score << 40 | x)
                if few:
                    pick, some = np.nonzero(best < none)
                    found = best[pick, some]
                    yield pa.RecordBatch.from_arrays([pa.array(both["sid"][some]), pa.array(both["sid"][found & ((1 << 40) - 1)]), pa.array(pick), pa.array(found >> 40)], ["u", "v", "pick", "score"])

    pairs = _tile_pairs(sets, similarity, tile_rows)
    with conf_set(sets.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "8"}):  # tiles are large rows
        found = materialise(pairs.mapInArrow(compare, "u long, v long, pick long, score long"), "candidates")
    if few:
        found = found.groupBy("u", "pick").agg(F.min_by("v", F.struct("score", "v")).alias("v"))
    return materialise(found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets of shingles are as similar as that, written."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("sid")).distinct().join(sets.select("sid", F.col("rep.at").alias("at")), "sid")
    found = among(texts.select("text", "at"), materialise(wanted, "wanted")).select("text", "sid")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for first, last, data, offsets in tk.runs(batch.column(0)):
                owner, h = shingle_sets(data, offsets, shingle)
                lists += np.split(h.view(np.int64), np.searchsorted(owner, np.arange(1, last - first)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lists, pa.list_(pa.int64()))], ["sid", "set"])

    of = materialise(found.mapInArrow(make, "sid long, set array<long>"), "shingles")
    joined = pairs.join(of.select(F.col("sid").alias("u"), F.col("set").alias("x")), "u").join(of.select(F.col("sid").alias("v"), F.col("set").alias("y")), "v")
    shared = joined.select("u", "v", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("both"))
    return materialise(shared.filter(F.col("both") >= similarity * (F.col("n") - F.col("both")) - 1e-9).select("u", "v"), "near")


def _near_groups(base: DataFrame, similarity: float, shingle: int, radii: tuple[int, int], tile_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows, sets) of located rows: rows (at, doc_id, sid), and sets (sid, root, rep) where ``rep`` is the row of a set that stays before others."""
    texts = base.select(F.col("row.text").alias("text"), "at", F.col("row.doc_id").cast("long").alias("doc_id"))
    made = materialise(sketches(texts, shingle), "sketches")
    same = ["size", "f0", "f1", "digest"]
    rep = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")
    sets = materialise(made.groupBy(*same).agg(F.min(rep).alias("rep"), F.first("bits").alias("bits")).withColumn("sid", F.monotonically_increasing_id()), "sets")
    rows = made.join(sets.select(*same, "sid"), same).select("at", "doc_id", "sid")

    def rooted(edges: DataFrame) -> DataFrame:
        roots = connect(edges).select(F.col("node").alias("sid"), "root")
        return materialise(sets.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid")), "rooted")

    # Each set is first compared with a few candidates, which joins the members of dense groups; then all pairs that are still apart are,
    # of the sets that have a candidate at all.
    tried = _candidates(sets.withColumn("root", F.col("sid")), similarity, radii, tile_rows, True)
    near = _verified(tried, sets, texts, shingle, similarity)
    active = tried.select(F.explode(F.array("u", "v")).alias("sid")).distinct()
    left = rooted(near).join(active, "sid", "left_semi")
    rest = _verified(_candidates(left, similarity, radii, tile_rows, False), sets, texts, shingle, similarity)
    return rows, rooted(near.unionByName(rest)).select("sid", "root", "rep")


def near_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, radii: tuple[int, int] = RADII, tile_rows: int = 8192) -> DataFrame:
    """(doc_id, component_id): one row a document. Texts whose sets of ``shingle`` words have a Jaccard similarity of ``similarity`` or more are linked."""
    rows, sets = _near_groups(located(docs), similarity, shingle, radii, tile_rows)
    lows = sets.groupBy("root").agg(F.min("rep").alias("low"))
    return rows.join(sets.select("sid", "root"), "sid").join(lows, "root").select("doc_id", F.col("low.doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, radii: tuple[int, int] = RADII, tile_rows: int = 8192) -> DataFrame:
    """One row of each group of ``near_groups`` stays: the one with the smallest id, of rows that share it the first by locator; rows without an id give way to rows with one."""
    base = located(docs)
    rows, sets = _near_groups(base, similarity, shingle, radii, tile_rows)
    stay = sets.groupBy("root").agg(F.min("rep").alias("low")).select("low.at")
    return without(base, materialise(rows.select("at").join(stay, "at", "left_anti"), "gone")).select("row.*")


def query(spark, sf_dir):
    found = find_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
