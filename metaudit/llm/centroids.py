"""Centroid clustering: Lloyd's rounds by Shallot search, exact in integers.

Each vector remembers its nearest centroid with an upper bound of its distance, and its second-nearest with a
lower bound of all distances but the nearest. After a round the bounds move by how far the centroids went. A
vector whose upper bound stays below the lower one, or below half the way from its centroid to the next, keeps
its centroid unread. For each other one both remembered centroids are measured, and the closer one starts the
search: its neighbours come in order of distance, within a ball around it whose radius, the distance to it and
to the second-best so far, shrinks with each better one found. What lies in the ball is compared in integers.

Bounds are rounded outwards, so that a centroid at an equal distance is never ruled out: results are those of
comparing all distances. A round reads the vectors once. Its tasks write the vectors with their bounds, and as
their last rows what their vectors add up to for each centroid, so that a round shuffles a row for each task,
centroid and component. The driver holds the centroids alone, ``k`` rows.

Defined results: a vector with another number of components than ``dims``, or with one that is null, not finite
or outside +-2^27 / scale (whose squares would not fit), is left out; components that fit are
floor(scale * x); equal distances go to the smaller number; a centroid without vectors stays where it is; with
fewer vectors than ``k`` each is a centroid; the starting vectors come by the SHA-256 of seed and id (a null id
is the text ''), then by components; rows that repeat are vectors of their own; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import conf_set, drop_stored, materialise, stored, table

#: Components of this size at most, so that 64 squared differences fit in 63 bits.
MOST = 1 << 27
#: Bounds are widened by this share whenever they are made or moved.
WIDEN = 1e-12
#: Vectors that are searched at a time.
BLOCK = 4096

STATE = "vec_id long, v array<int>, near int, second int, upper double, lower double, distance long"
#: A row is a vector with its state, or what a task's vectors add up to for one centroid.
ROUND = f"{STATE}, cluster int, n long, sums array<long>, inertia long"


def integers(vectors: DataFrame, dims: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v): the vectors that are kept, as integers."""
    x = F.transform(F.col("embedding"), lambda e: F.floor(e.cast("double") * scale))
    fits = F.forall("embedding", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e.cast("double")) < MOST / scale), F.lit(False)))
    kept = vectors.filter(F.coalesce((F.size("embedding") == dims) & fits, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<int>").alias("v"))


class Search:
    """The centroids (k x dims), how far they have moved since the bounds were made, and who is near whom."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray):
        self.c, self.k = centroids, len(centroids)
        root = lambda d: np.sqrt(d.astype(float))
        self.moved = root(((centroids - before) ** 2).sum(1)) * (1 + WIDEN)
        apart = np.stack([((centroids - c) ** 2).sum(1) for c in centroids])
        far = apart.copy()
        np.fill_diagonal(far, -1)
        self.order = np.argsort(far, 1, kind="stable")  # itself first, then by distance
        self.way = root(np.take_along_axis(apart, self.order, 1)) * (1 - WIDEN)
        self.half = self.way[:, 1] / 2 if self.k > 1 else np.full(1, np.inf)
        most = np.argsort(-self.moved, kind="stable")
        self.furthest, self.most, self.next = most[0], self.moved[most[0]], self.moved[most[1]] if self.k > 1 else 0.0

    def squared(self, v: np.ndarray, to: np.ndarray) -> np.ndarray:
        return ((v - self.c[to]) ** 2).sum(1)

    def assign(self, v: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Move the bounds and change the state of the vectors in place; ``near`` < 0 is a new vector."""
        new = near < 0
        near[new] = 0
        second[new] = min(1, self.k - 1)
        by = np.where(near == self.furthest, self.next, self.most)
        upper[:] = np.where(new, np.inf, (upper + self.moved[near]) * (1 + WIDEN))
        lower[:] = np.where(new, -np.inf, lower - by - WIDEN * (np.abs(lower) + by))
        bound = np.maximum(lower, self.half[near])
        for some in np.array_split(open_ := np.flatnonzero(~(upper < bound)), max(1, -(-len(open_) // BLOCK))):
            d = self.squared(v[some], near[some])
            upper[some] = np.sqrt(d) * (1 + WIDEN)
            left = ~(upper[some] < bound[some])
            if left.any():
                self._search(some[left], d[left], v, near, second, upper, lower)

    def _search(self, rows, d, v, near, second, upper, lower) -> None:
        x, a, b = v[rows], near[rows].astype(np.int64), second[rows].astype(np.int64)
        e = self.squared(x, b)
        swap = (e < d) | ((e == d) & (b < a))
        a, b, d, e = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, e, d), np.where(swap, d, e)
        if self.k > 1:
            start, first = a.copy(), np.sqrt(d.astype(float)) * (1 + WIDEN)  # the ball's centre
            going = np.arange(len(rows))
            for step in range(1, self.k):
                radius = first[going] + np.sqrt(e[going].astype(float)) * (1 + WIDEN)
                going = going[self.way[start[going], step] <= radius]
                if not len(going):
                    break
                j = self.order[start[going], step]
                there = j != b[going]  # the second was measured already
                at, j = going[there], j[there]
                z = self.squared(x[at], j)
                best = (z < d[at]) | ((z == d[at]) & (j < a[at]))
                good = ~best & ((z < e[at]) | ((z == e[at]) & (j < b[at])))
                up, mid = at[best], at[good]
                b[up], e[up] = a[up], d[up]
                a[up], d[up] = j[best], z[best]
                b[mid], e[mid] = j[good], z[good]
        near[rows], second[rows] = a, b
        upper[rows] = np.sqrt(d.astype(float)) * (1 + WIDEN)
        lower[rows] = np.sqrt(e.astype(float)) * (1 - WIDEN) if self.k > 1 else np.inf


def _round(rows: DataFrame, centroids: np.ndarray, before: np.ndarray, label: str) -> DataFrame:
    """Assign every vector, written with the sums; ``before`` are the centroids of the round before."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids, before)
        sums, counts, inertia = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("near", pa.int32()), ("second", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("distance", pa.int64()), ("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("inertia", pa.int64())])
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dims)
            near, second, upper, lower = (np.array(batch.column(c).to_numpy(zero_copy_only=False)) for c in range(2, 6))
            search.assign(v, near, second, upper, lower)
            distance = search.squared(v, near)
            np.add.at(sums, near, v)
            np.add.at(inertia, near, distance)
            counts += np.bincount(near, minlength=k)
            empty = [pa.nulls(n, schema.field(c).type) for c in range(7, 11)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(schema.field(1).type), *map(pa.array, (near, second, upper, lower, distance)), *empty], schema=schema)
        own = np.flatnonzero(counts)
        if len(own):
            empty = [pa.nulls(len(own), schema.field(c).type) for c in range(7)]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(own.astype(np.int32)), pa.array(counts[own]), pa.array(list(sums[own]), pa.list_(pa.int64())), pa.array(inertia[own])], schema=schema)

    with conf_set(rows.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "8192"}):
        return materialise(rows.mapInArrow(run, ROUND), label)


def _vectors(done: DataFrame) -> DataFrame:
    return done.filter("cluster IS NULL").select(*[f.split(" ")[0] for f in STATE.split(", ")])


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2") -> tuple[DataFrame, list[tuple[int, tuple[int, ...], int, int]]]:
    """(vec_id, v, near, second, upper, lower, distance) of all vectors after the last round, and of each centroid its number, components, vectors and their summed squared distance."""
    spark = vectors.sparkSession
    before = stored(spark)
    kept = materialise(integers(vectors, dims, scale), "vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = [r["v"] for r in kept.orderBy(digest, "v").limit(k).collect()]  # k rows
    number = lambda x, kind: F.lit(x).cast(kind)
    new = kept.select("vec_id", "v", number(-1, "int").alias("near"), number(-1, "int").alias("second"), number(0, "double").alias("upper"), number(0, "double").alias("lower"), number(0, "long").alias("distance"))
    if not first:
        return new.select(*[f.split(" ")[0] for f in STATE.split(", ")]), []
    centroids = np.array(first, np.int64)
    rows, last = new, centroids
    for turn in range(rounds + 1):
        done = _round(rows, centroids, last, f"round-{turn}")
        rows = _vectors(done)
        drop_stored(spark, before, [done])
        totals = done.filter("cluster IS NOT NULL")
        if turn < rounds:
            each = totals.select("cluster", "n", F.posexplode("sums").alias("at", "x"))
            added = each.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n")).collect()  # k x dims rows
            last, centroids = centroids, centroids.copy()
            for r in added:
                centroids[r["cluster"], r["at"]] = int(r["x"]) // r["n"]
    final = {r["cluster"]: r for r in totals.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia")).collect()}  # k rows
    return rows, [(c, tuple(map(int, centroids[c])), final[c]["n"] if c in final else 0, final[c]["inertia"] if c in final else 0) for c in range(len(centroids))]


def query(spark, sf_dir):
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"))
    every = sum(c[3] for c in centroids)
    known = [(number, own, every, hashlib.sha256(",".join(map(str, components)).encode()).hexdigest()) for number, components, _, own in centroids]
    about = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select("vec_id", F.col("near").alias("cluster"), "distance").join(F.broadcast(about), "cluster")  # k rows


def _oracle(k: int = 40, rounds: int = 5) -> str:
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM v QUALIFY c < {k})",
    ]
    for t in range(rounds + 1):
        apart = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, min((({apart}), c)) AS best FROM v, c{t} c GROUP BY r)")
        if t < rounds:
            steps.append(f"s{t} AS MATERIALIZED (SELECT best[2] AS c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.best, unnest(v.v) AS x, generate_subscripts(v.v, 1) AS i FROM a{t} a JOIN v USING (r)) GROUP BY ALL)")
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.v, o.v) AS v FROM c{t} o LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{t} GROUP BY c) n USING (c))")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, best[2]::INTEGER AS cluster, best[1]::BIGINT AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia,
       (sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.c = a.best[2]"""


ORACLE = _oracle()
