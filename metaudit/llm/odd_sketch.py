"""MinHash near-dedup with odd sketches: links of sets of words whose Jaccard similarity reaches a percentage.

A document is its set of distinct shingles of five words, lower-cased. Equal sets are one set from here on, with
the smallest id for all. Each set gets SAMPLES MinHash values. They are folded into a bitmap in which each value
turns one bit over, an odd sketch: bits that two sketches do not share stand for samples that differ, and the
number of such bits tells a high similarity far more exactly than as many bits of plain samples would.

BANDS bands of ROWS values each find the candidates: sets that agree on a band. Odd sketches verify them with
an exclusive-or and a bit count, and so do bitmaps of the whole sets, which differ in no more bits than the sets do
in shingles; who may reach the similarity is compared on full sets, in whole numbers.
No step takes all pairs of a band's value with their contents:

1. each set meets the least set of each of its values, of which the nearest sketch is compared in full, then
   those that are still apart. That joins the members of dense groups with a comparison or two each;
2. values whose sets are still in several components are cut into tiles of one class of set sizes and a hash,
   large components apart from the rest, and tiles whose classes allow the similarity are compared by their
   sketches alone, but for those of one component. Each set is compared in full with its nearest, then all
   candidate pairs still apart are.

At a similarity of 85 % a pair shares no band with a chance of 8e-7, and its sketches differ by more than
MOST_BITS with one below that; nothing else is lost.

Defined results: a null or empty text, or one of white space alone, has an empty set, is linked with nothing and
is its own component; fewer words than a shingle are one shingle; a component's id is its smallest document id,
nulls apart (null if it has none); rows that repeat are rows of their own, and rows of one id are linked only if
their sets are; an empty table gives an empty result; extra columns are ignored or kept as they are, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .common import among, conf_set, located, materialise, table, without
from .near_dedup import connect, shingle_sets

SAMPLES, BANDS, ROWS = 256, 24, 5
#: Bits of an odd sketch.
BITS = 512
#: Sketches of sets that are similar by 85 % differ in 66 bits on average, with a deviation of 10; so many stand for a similarity of 0.68.
MOST_BITS = 120
#: A table of numbers that make one hash into many.
_XOR, _TIMES = (tk.mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(step)) for step in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
_TIMES |= np.uint64(1)


def minhashes(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """SAMPLES MinHash values of each of ``n`` sets of hashes, given in order of their owner; zero for an empty set."""
    out = np.zeros((SAMPLES, n), np.uint64)
    if len(h):
        at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        for s in range(SAMPLES):
            out[s, owner[at]] = np.minimum.reduceat((h ^ _XOR[s]) * _TIMES[s], at)
    return out


def parities(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """(n, BITS / 64) bitmaps in which each hash, given in order of its owner, turns one bit over."""
    out = np.zeros((n, BITS // 64), np.int64)
    cell = (tk.mix(h) % np.uint64(BITS)).astype(np.int64)
    for k in range(0, n, 4096):
        a, b = np.searchsorted(owner, [k, k + 4096])
        m = min(4096, n - k)
        odd = np.bincount((owner[a:b] - k) * BITS + cell[a:b], minlength=m * BITS) & 1
        out[k : k + m] = np.packbits(odd.astype(np.uint8).reshape(m, BITS), 1).view(np.int64)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """The bitmaps of the columns of samples."""
    n = samples.shape[1]
    salted = samples + np.arange(1, SAMPLES + 1, dtype=np.uint64)[:, None] * np.uint64(0xA24BAED4963EE407)
    return parities(np.repeat(np.arange(n), SAMPLES), salted.T.ravel(), n)


def similarity_estimate(bits: np.ndarray | int) -> np.ndarray:
    """The share of equal samples that a number of differing bits stands for."""
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * np.asarray(bits) / BITS, 1e-9))


def sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """(at, doc_id, size, d0, d1, odd, whole, bands) of (text, at, doc_id): size and digest of the set, odd sketches of its samples and of itself, and a key for each band."""
    schema = texts.select("at", "doc_id", *[F.lit(0).cast("long").alias(c) for c in ("size", "d0", "d1")], *[F.array().cast("array<long>").alias(c) for c in ("odd", "whole")], F.array().cast("array<long>").alias("bands")).schema
    names = ["at", "doc_id", "size", "d0", "d1", "odd", "whole", "bands"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, odd, whole, bands = [], [], [], [], []
            for first, last, data, offsets in tk.runs(batch.column(0)):
                n = last - first
                owner, h = shingle_sets(data, offsets, shingle)
                sizes.append(np.bincount(owner, minlength=n))
                digest = np.zeros((2, n), np.uint64)
                for k, salt in enumerate((0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
                    np.add.at(digest[k], owner, tk.mix(h ^ np.uint64(salt)))
                digests.append(digest.view(np.int64))
                samples = minhashes(owner, h, n)
                odd += list(odd_sketches(samples))
                whole += list(parities(owner, h, n))
                keys = np.zeros((BANDS, n), np.uint64)
                for b in range(BANDS):
                    keys[b] = b
                    for s in samples[b * ROWS : (b + 1) * ROWS]:
                        keys[b] = tk.combine(keys[b], s, b)
                bands += list(keys.T.copy().view(np.int64))
            d = np.concatenate(digests, 1) if digests else np.zeros((2, 0), np.int64)
            size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(size.astype(np.int64)), pa.array(d[0]), pa.array(d[1]), pa.array(odd, pa.list_(pa.int64())), pa.array(whole, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], names)

    return texts.select("text", "at", "doc_id").mapInArrow(make, schema)


def _near(pairs: DataFrame, percent: int) -> DataFrame:
    """``pairs`` with columns odd and size of both sides that may be similar enough, with ``bits``, in how many their sketches differ."""
    word = lambda side, k: F.get(side, F.lit(k))
    bits = lambda u, v: sum((F.bit_count(word(u, k).bitwiseXOR(word(v, k))) for k in range(BITS // 64)), F.lit(0))
    near = _sized(pairs, percent).withColumn("bits", bits("uo", "vo")).filter(F.col("bits") <= MOST_BITS)
    return near.filter((100 + percent) * bits("uw", "vw") <= (100 - percent) * (F.col("us") + F.col("vs")))  # sets differ in as many shingles at least


def _sized(pairs: DataFrame, percent: int) -> DataFrame:
    """A set of this similarity has at least so many percent of the other's shingles."""
    return pairs.filter(100 * F.least("us", "vs") >= percent * F.greatest("us", "vs"))


def _nearest(pairs: DataFrame) -> DataFrame:
    """(u, v) of each u's pair with the fewest differing bits."""
    best = pairs.groupBy("u").agg(F.min_by("v", F.struct("bits", "v")).alias("v"))
    return best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (u, v) of which the intersection has ``percent`` of the union's shingles or more, on full sets; written."""
    pairs = materialise(pairs.select("u", "v").distinct(), "pairs")
    if pairs.isEmpty():
        return pairs
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("sid")).distinct().join(sets.select("sid", "at"), "sid")
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
    return materialise(shared.filter(100 * F.col("both").cast("long") >= percent * (F.col("n") - F.col("both")).cast("long")).select("u", "v"), "near")


_TILE = np.dtype([("odd", np.uint64, (BITS // 64,)), ("whole", np.uint64, (BITS // 64,)), ("size", np.int64), ("sid", np.int64), ("root", np.int64)])


def _tile(column: pa.Array, k: int) -> np.ndarray:
    fields = column[k].values
    out = np.zeros(len(fields), _TILE)
    for name in ("odd", "whole"):
        out[name] = fields.field(name).flatten().to_numpy().view(np.uint64).reshape(out[name].shape)
    for name in ("size", "sid", "root"):
        out[name] = fields.field(name).to_numpy()
    return out


def tile_pairs(a: np.ndarray, b: np.ndarray, percent: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bits) of the sets of two tiles in different components whose sketches and sizes allow the similarity, some rows of the first at a time."""
    for k in range(0, len(a), 64):
        some = a[k : k + 64]
        bits = np.bitwise_count(some["odd"][:, None] ^ b["odd"][None]).sum(2, np.int64)
        x, y = some["size"][:, None], b["size"][None]
        may = (bits <= MOST_BITS) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (some["root"][:, None] != b["root"][None])
        i, j = np.nonzero(may)
        if own:
            i, j = i[i + k < j], j[i + k < j]
        least = np.concatenate([np.bitwise_count(some["whole"][i[q : q + 65536]] ^ b["whole"][j[q : q + 65536]]).sum(1, np.int64) for q in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
        may = (100 + percent) * least <= (100 - percent) * (some["size"][i] + b["size"][j])  # sets differ in as many shingles at least
        i, j = i[may], j[may]
        yield i + k, j, bits[i, j]


def _open_pairs(keys: DataFrame, sets: DataFrame, percent: int, tile_rows: int, nearest: bool) -> DataFrame:
    """(u, v, bits) of candidates in different components, written. ``keys`` (key, sid) of values that several sets share; ``sets`` with their root. ``nearest``: of each task's pairs only those that are the nearest of either set."""
    width = float(np.log(100 / percent * (1 + 1e-6)))
    placed = keys.join(sets.select("sid", "root", "size", "odd", "whole"), "sid").withColumn("c", F.floor(F.log(F.col("size").cast("double")) / width).cast("int"))
    roots = placed.groupBy("key").agg((F.min("root") != F.max("root")).alias("open")).filter("open").select("key")
    placed = materialise(placed.join(materialise(roots, "open"), "key", "left_semi"), "placed")
    # The members of a component with many sets of a value are tiles of their own, which need not meet each other; the rest share tiles.
    sizes = materialise(placed.groupBy("key", "c", "root").agg(F.count("*").alias("n")), "sizes")
    label = F.when(2 * F.col("n") >= tile_rows, F.col("root")).otherwise(F.lit(-1))
    parts = sizes.withColumn("t", label).groupBy("key", "c", "t").agg(F.ceil(F.sum("n") / tile_rows).cast("int").alias("parts"))
    labels = sizes.select("key", "c", "root", label.alias("t")).join(parts, ["key", "c", "t"])
    dealt = placed.join(labels, ["key", "c", "root"]).withColumn("p", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    tiles = materialise(dealt.groupBy("key", "c", "t", "p").agg(F.collect_list(F.struct(*_TILE.names)).alias("tile")), "tiles")
    at = ("c", "t", "p")
    name = lambda x: tiles.select("key", *[F.col(k).alias(f"{x}{k}") for k in at])
    once = "(lc < rc OR lt < rt OR (lt = rt AND lp <= rp)) AND NOT (lt = rt AND lt >= 0)"
    meets = name("l").join(name("r").withColumn("lc", F.explode(F.array(F.col("rc"), F.col("rc") - 1))), ["key", "lc"]).filter(once)
    of = lambda x: tiles.select("key", *[F.col(k).alias(f"{x}{k}") for k in at], F.col("tile").alias(x))
    met = meets.join(of("l"), ["key", *(f"l{k}" for k in at)]).join(of("r"), ["key", *(f"r{k}" for k in at)])
    alone = (F.col("lc") == F.col("rc")) & (F.col("lt") == F.col("rt")) & (F.col("lp") == F.col("rp"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = not batch.column(1)[k].is_valid
                a = _tile(batch.column(0), k)
                b = a if own else _tile(batch.column(1), k)
                best: dict[int, tuple[int, int]] = {}
                for i, j, bits in tile_pairs(a, b, percent, own):
                    u, v = a["sid"][i], b["sid"][j]
                    if not nearest:
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(bits)], ["u", "v", "bits"])
                        continue
                    for x, y in ((u, v), (v, u)):
                        order = np.lexsort((y, bits, x))
                        first = order[np.flatnonzero(np.concatenate([[True], x[order][1:] != x[order][:-1]]))] if len(order) else order
                        for p, q, z in zip(x[first].tolist(), y[first].tolist(), bits[first].tolist(), strict=True):
                            best[p] = min(best.get(p, (z, q)), (z, q))
                if nearest:
                    yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array([q for _, q in best.values()], pa.int64()), pa.array([z for z, _ in best.values()], pa.int64())], ["u", "v", "bits"])

    with conf_set(sets.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "8"}):  # tiles are large rows
        return materialise(met.select("l", F.when(~alone, F.col("r")).alias("r")).mapInArrow(compare, "u long, v long, bits long"), "candidates")


def _groups(base: DataFrame, percent: int, shingle: int, tile_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows, sets) of located rows: rows (at, doc_id, size, sid), sid null without words; sets (sid, root, doc_id, at), the row of a set that stays before others."""
    texts = base.select(F.col("row.text").alias("text"), "at", F.col("row.doc_id").cast("long").alias("doc_id"))
    made = materialise(sketches(texts, shingle), "sketches")
    same = ["size", "d0", "d1"]
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")).alias("rep")
    sets = made.filter("size > 0").groupBy(*same).agg(rep, F.first("odd").alias("odd"), F.first("whole").alias("whole"), F.first("bands").alias("bands"))
    sets = materialise(sets.withColumn("sid", F.monotonically_increasing_id()).select("sid", *same, "odd", "whole", "bands", F.col("rep.doc_id").alias("doc_id"), F.col("rep.at").alias("at"), F.col("rep.no_id").alias("no_id")), "sets")
    rows = made.select("at", "doc_id", *same).join(sets.select(*same, "sid"), same, "left").select("at", "doc_id", "size", "sid")

    # Values that several sets share, with the least of them: from the first of these on, sets without a candidate are left alone.
    keys = sets.select(F.explode("bands").alias("key"), "sid")
    met = materialise(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("sid").alias("least")).filter("n > 1").select("key", "least"), "met")
    keys = materialise(among(keys, met, "key"), "keys")

    def rooted(edges: DataFrame) -> DataFrame:
        roots = connect(edges).select(F.col("node").alias("sid"), "root")
        return materialise(sets.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid")).select("sid", "root", "size", "odd", "whole", "doc_id", "no_id", "at"), "rooted")

    side = lambda s, x: s.select(F.col("sid").alias(x), F.col("odd").alias(f"{x}o"), F.col("whole").alias(f"{x}w"), F.col("size").alias(f"{x}s"), *([F.col("root").alias(f"{x}r")] if "root" in s.columns else []))
    stars = keys.filter("sid > least").select(F.col("sid").alias("u"), F.col("least").alias("v")).distinct()
    stars = materialise(_near(stars.join(side(sets, "u"), "u").join(side(sets, "v"), "v"), percent).select("u", "v", "bits"), "stars")
    near = verified(_nearest(stars), sets, texts, shingle, percent)
    now = rooted(near)

    def joined(pairs: DataFrame) -> None:
        """Compare pairs in full, and join the components of those that are similar."""
        nonlocal near, now
        if not (found := verified(pairs, sets, texts, shingle, percent)).isEmpty():
            near = near.unionByName(found)
            now = rooted(near)

    end = lambda x: now.select(F.col("sid").alias(x), F.col("root").alias(f"{x}r"))
    joined(materialise(stars.join(end("u"), "u").join(end("v"), "v").filter("ur <> vr").select("u", "v"), "apart"))
    for nearest in (True, False):
        found = _open_pairs(keys.select("key", "sid"), now, percent, tile_rows, nearest)
        joined(_nearest(found) if nearest else found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    return rows, now.select("sid", "root", "no_id", "doc_id", "at")


def near_groups(docs: DataFrame, percent: int = 85, shingle: int = 5, tile_rows: int = 2048) -> DataFrame:
    """(doc_id, at, n_shingles, component_id), one row a document; ``at`` is the row's locator."""
    rows, sets = _groups(located(docs), percent, shingle, tile_rows)
    lows = sets.groupBy("root").agg(F.min("doc_id").alias("component"))
    named = materialise(sets.select("sid", "root").join(lows, "root").select("sid", "component"), "named")
    component = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return rows.join(named, "sid", "left").select("doc_id", "at", F.col("size").alias("n_shingles"), component.alias("component_id"))


def drop_near_copies(docs: DataFrame, percent: int = 85, shingle: int = 5, tile_rows: int = 2048) -> DataFrame:
    """One row of each component stays, that with the smallest id (of rows that share it the first by locator; rows without an id give way to rows with one), and every row without words."""
    base = located(docs)
    rows, sets = _groups(base, percent, shingle, tile_rows)
    stay = sets.groupBy("root").agg(F.min(F.struct("no_id", "doc_id", "at")).alias("low")).select("low.at")
    return without(base, materialise(rows.filter("sid IS NOT NULL").select("at").join(stay, "at", "left_anti"), "gone")).select("row.*")


def query(spark, sf_dir):
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
l AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.doc_id WHERE r.c < l.v)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.c) AS component_id, s.doc_id = min(r.c) AS kept FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, s.s"""
