"""Conversation prefix trie: which conversations share their first turns, and what that saves.

Each conversation is rebuilt from the head of an earlier one (``rebuilt``). A prefix is known by its length and
by the exclusive-or of 128-bit hashes of its turns and their places, so prefixes are running values that parts
of a conversation are worked out in separately (``ranking``); a conversation of any length is no group. A node
belongs to the smallest conversation through it (its owner); owner and depth name it. What is under a node is
added up by centroid decomposition of the forest of parent edges:

* every component has a top and is cut at its centroid, the deepest node under which half of it or more lies:
  each subtree below the centroid is a component, and so is what is above it;
* the total of the centroid and all under it is added to each node from the centroid's parent up to the
  component's top. These are nodes of the owner's own conversation, so one equi-join finds them, however long
  the way is;
* the centroid is done. A component is at most half of the one that it was cut from, so rounds grow with the logarithm.

Components of at most BLOCK nodes are finished in one task each, in the same way; those larger are cut by joins.
How many nodes lie under each node, which tells where the centroids are, is counted from the conversations.

Defined results: turns come by turn (null first), then role and the digest of role and text; a null text or role is
empty; rows without a conversation id are left out; rows that repeat are turns of their own; a conversation
without turns after rebuilding is a member of the root alone; without conversations there is no root, and the
result is empty; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import SUM, XOR, carried, sorted_parts
from .common import count_words, materialise, small, table

#: Nodes of a component that one task finishes at most.
BLOCK = 16_384
#: Bytes of ids that are joined into one piece.
PIECE = 1 << 20


def head_length(conv_id: Column) -> Column:
    """How many turns a conversation takes over, 0 to 3."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 4).cast("int")


def rebuilt(conversations: DataFrame, span: int = 20) -> tuple[DataFrame, DataFrame]:
    """(turns, members): turns (conv_id, depth from 1, words, k1, k2) of the rebuilt conversations with the key of the prefix that ends there; members (conv_id, length) of every conversation. Both written.

    A conversation's first turns are those of the first of its ``span`` neighbours by id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat_ws("\n", F.length(role).cast("string"), role, text).cast("binary"), 256))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"), count_words(text).alias("words"))
    parts = sorted_parts(rows, ["conv_id"], ["turn", "role", "digest"], "turns")
    own = carried(parts, ["conv_id"], {"place": (F.lit(1), SUM)})  # from 1
    own = materialise(own.select("conv_id", "place", "digest", "words", "_part"), "own")
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(span))
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"base": base, "h": head_length(F.col("conv_id"))})
    convs = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("bn")), "base", "left")
    convs = materialise(convs.select("conv_id", "base", "n", "h", F.least(F.col("h"), F.coalesce("bn", F.lit(0))).cast("int").alias("m")), "convs")
    first = own.filter(F.col("place") <= 3).select(F.col("conv_id").alias("base"), "place", "digest", "words")
    heads = convs.join(first, "base").filter("place <= m").select("conv_id", F.col("place").alias("depth"), "digest", "words", F.lit(-1).alias("_part"))
    rest = own.join(convs.select("conv_id", "h", "m"), "conv_id").filter("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("m")).alias("depth"), "digest", "words", "_part")
    salted = {f"z{k}": F.xxhash64(F.lit(k), F.col("depth"), F.col("digest")) for k in (1, 2)}
    placed = materialise(heads.unionByName(rest).withColumns(salted | {"_at": F.col("depth")}).drop("digest"), "placed")
    keyed = carried(placed, ["conv_id"], {"k1": (F.col("z1"), XOR), "k2": (F.col("z2"), XOR)})
    turns = materialise(keyed.select("conv_id", "depth", "words", "k1", "k2", "z1", "z2"), "rebuilt")
    members = convs.select("conv_id", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return turns, materialise(members, "members")


def nodes_of(turns: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths): nodes (conv_id, depth, parent_conv_id, n_convs, n_children, leaf, saved); paths (member, depth, conv_id), the node of each conversation at each depth from 0. Both written."""
    key = ["depth", "k1", "k2"]
    found = turns.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("words").alias("words"), F.first(F.struct((F.col("depth") - 1).alias("depth"), F.col("k1").bitwiseXOR(F.col("z1")).alias("k1"), F.col("k2").bitwiseXOR(F.col("z2")).alias("k2"))).alias("above"))
    found = materialise(found, "found")
    top = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")  # one row
    owner = turns.select(F.col("conv_id").alias("member"), *key).join(found.select(*key, "conv_id"), key).select("member", "depth", "conv_id")
    roots = members.select(F.col("conv_id").alias("member"), F.lit(0).cast("long").alias("depth")).crossJoin(F.broadcast(top.select("conv_id")))
    paths = materialise(owner.unionByName(roots), "paths")
    up = found.select(F.col("conv_id").alias("parent_conv_id"), *[F.col(c).alias(f"_{c}") for c in key])
    low = found.filter("depth > 1").join(up, [F.col("above.depth") == F.col("_depth"), F.col("above.k1") == F.col("_k1"), F.col("above.k2") == F.col("_k2")]).drop("_depth", "_k1", "_k2")
    high = found.filter("depth = 1").crossJoin(F.broadcast(top.select(F.col("conv_id").alias("parent_conv_id"))))
    named = [x.select("conv_id", "depth", "parent_conv_id", "n_convs", "words") for x in (low, high)]
    named.append(top.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("words")))
    every = materialise(named[0].unionByName(named[1]).unionByName(named[2]), "named")
    children = every.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    out = every.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    worth = {"leaf": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}
    return materialise(out.withColumns(worth).drop("words"), "nodes"), paths


# --- centroid decomposition

_STATE = ["conv_id", "depth", "parent_conv_id", "leaf", "saved", "more_leaf", "more_saved", "top_conv", "top_depth", "below", "total"]


def _sizes(paths: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, depth, below): how many nodes are under each node, itself included. Under a node are, of each of its conversations, the nodes that it owns from there on."""
    owned = paths.filter("member = conv_id").groupBy("member").agg(F.min("depth").alias("from"))
    own = paths.join(owned.join(members.withColumnRenamed("conv_id", "member"), "member"), "member")
    return own.groupBy("conv_id", "depth").agg(F.sum(F.col("length") - F.greatest("from", "depth") + 1).alias("below"))


def _cut(state: DataFrame, paths: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """One round: (done, state) of large components, both with the columns of _STATE, from one written table."""
    comp = ["top_conv", "top_depth"]
    heavy = state.filter("2 * below >= total").groupBy(*comp).agg(F.min_by(F.struct(F.col("conv_id").alias("z"), F.col("depth").alias("zd")), F.struct("below", (-F.col("depth")).alias("d"))).alias("c"))
    cuts = materialise(heavy.select(*comp, "c.z", "c.zd"), f"cuts-{turn}")
    # The conversations through each centroid, with the node that comes next in each.
    through = paths.join(cuts.select(F.col("z").alias("conv_id"), F.col("zd").alias("depth"), *comp), ["conv_id", "depth"]).select("member", *comp, F.col("depth").alias("zd"))
    after = paths.select("member", (F.col("depth") - 1).alias("zd"), F.col("conv_id").alias("child"))
    through = through.join(after, ["member", "zd"], "left").withColumnRenamed("member", "conv_id")
    marked = state.join(through, ["conv_id", *comp], "left").withColumns({"under": F.coalesce(F.col("depth") >= F.col("zd"), F.lit(False)), "at": F.coalesce(F.col("depth") == F.col("zd"), F.lit(False))})
    marked = materialise(marked, f"marked-{turn}")
    # What is under a centroid counts for each node from its parent to the component's top.
    sums = marked.filter("under").groupBy(*comp).agg(F.sum("leaf").alias("sl"), F.sum("saved").alias("ss"), F.count("*").alias("sn"))
    sums = materialise(sums.join(cuts, comp), f"sums-{turn}")
    way = sums.join(paths.select(F.col("member").alias("z"), "depth", "conv_id"), "z").filter("depth < zd AND depth >= top_depth").select("conv_id", "depth", "sl", "ss", "sn")
    upper = marked.filter("NOT under").join(way, ["conv_id", "depth"], "left").join(small(sums.select(*comp, F.col("sn").alias("gone"))), comp)
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))  # noqa: E731
    upper = upper.withColumns({"more_leaf": F.col("more_leaf") + none("sl"), "more_saved": F.col("more_saved") + none("ss"), "below": F.col("below") - none("sn"), "total": F.col("total") - F.col("gone")}).select(*_STATE)
    tops = marked.filter("under AND NOT at AND depth = zd + 1").select(F.col("conv_id").alias("child"), F.col("depth").alias("cd"), F.col("below").alias("ct"))
    lower = marked.filter("under AND NOT at").withColumn("cd", F.col("zd") + 1).join(tops, ["child", "cd"]).withColumns({"top_conv": F.col("child"), "top_depth": F.col("cd"), "total": F.col("ct")}).select(*_STATE)
    centre = marked.filter("at").join(small(sums.select(*comp, "sl", "ss")), comp).withColumns({"more_leaf": F.col("more_leaf") + F.col("sl") - F.col("leaf"), "more_saved": F.col("more_saved") + F.col("ss") - F.col("saved")}).select(*_STATE)
    both = materialise(upper.unionByName(lower).withColumn("done", F.lit(False)).unionByName(centre.withColumn("done", F.lit(True))), f"cut-{turn}")
    return both.filter("done").select(*_STATE), both.filter("NOT done").select(*_STATE)


def decompose(parent: list[int], worth: np.ndarray, parts: list[list[int]]) -> np.ndarray:
    """``worth`` (a row a node) added up under each node by centroid decomposition. ``parent`` has each node's parent's number; each of ``parts`` is a tree, parents first."""
    out, below, label, work = worth.copy(), [0] * len(parent), [0] * len(parent), [p for p in parts if len(p) > 1]
    while work:
        part = work.pop()
        for v in part:
            below[v] = 1
        for v in reversed(part[1:]):
            below[parent[v]] += below[v]
        z = min((v for v in part if 2 * below[v] >= len(part)), key=below.__getitem__)
        pieces: dict[int, list[int]] = {}
        label[part[0]] = -1  # what is above the centroid
        for k, v in enumerate(part):
            if k:
                label[v] = v if parent[v] == z else label[parent[v]]
            if v != z:
                pieces.setdefault(label[v] if part[0] != z or k else -1, []).append(v)
        total = sum((worth[p].sum(0) for top, p in pieces.items() if top != -1), worth[z])
        out[z] += total - worth[z]
        v = z
        while v != part[0]:
            v = parent[v]
            out[v] += total
        work += [p for p in pieces.values() if len(p) > 1]
    return out


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of whole components, whose rows come one after the other, parents first."""

    def results(t: pa.Table) -> pa.RecordBatch:
        c = {n: t.column(n).to_numpy() for n in ("conv_id", "depth", "leaf", "saved", "more_leaf", "more_saved", "top_conv", "top_depth")}
        up = t.column("parent_conv_id").fill_null(-1).to_numpy()
        own, above = (list(zip(ids.tolist(), depths.tolist(), strict=True)) for ids, depths in ((c["conv_id"], c["depth"]), (up, c["depth"] - 1)))
        number = {node: k for k, node in enumerate(own)}
        starts = np.flatnonzero(np.concatenate([[True], (c["top_conv"][1:] != c["top_conv"][:-1]) | (c["top_depth"][1:] != c["top_depth"][:-1])]))
        parts = [list(range(a, b)) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(own)], strict=True)]
        sums = decompose([number.get(a, -1) for a in above], np.stack([c["leaf"], c["saved"]], 1), parts)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (c["conv_id"], c["depth"], sums[:, 0] + c["more_leaf"], sums[:, 1] + c["more_saved"])], ["conv_id", "depth", "n_leaves", "saved_tokens"])

    held: pa.Table | None = None
    for batch in batches:
        more = pa.Table.from_batches([batch])
        held = more if held is None else pa.concat_tables([held, more])
        if held.num_rows < 4 * BLOCK:
            continue
        tops, depths = held.column("top_conv").to_numpy(), held.column("top_depth").to_numpy()
        last = int(np.flatnonzero((tops != tops[-1]) | (depths != depths[-1]))[-1] + 1)  # one component has fewer rows than are held
        yield results(held.slice(0, last))
        held = held.slice(last)
    if held is not None and held.num_rows:
        yield results(held)


def rollup(nodes: DataFrame, paths: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens): leaf and saved of ``nodes`` added up under each node."""
    count = nodes.count()
    state = nodes.select("conv_id", "depth", "parent_conv_id", "leaf", "saved")
    sizes = _sizes(paths, members) if count > block else state.select("conv_id", "depth", F.lit(1).cast("long").alias("below"))
    top = nodes.filter("depth = 0").select(F.col("conv_id").alias("top_conv"), F.col("depth").alias("top_depth"))  # one row
    zero = F.lit(0).cast("long")
    state = state.join(sizes, ["conv_id", "depth"]).crossJoin(F.broadcast(top)).withColumns({"more_leaf": zero, "more_saved": zero, "total": F.lit(count).cast("long")}).select(*_STATE)
    finished, whole, turn = [], [], 0
    while count > block:
        done, state = _cut(state, paths, turn)
        finished.append(done.select("conv_id", "depth", (F.col("leaf") + F.col("more_leaf")).alias("n_leaves"), (F.col("saved") + F.col("more_saved")).alias("saved_tokens")))
        whole.append(state.filter(F.col("total") <= block))
        state = state.filter(F.col("total") > block)
        turn += 1
        if state.isEmpty():
            break
    else:
        whole.append(state)
    rest = whole[0]
    for w in whole[1:]:
        rest = rest.unionByName(w)
    comp = ["top_conv", "top_depth"]
    out = rest.repartition(*comp).sortWithinPartitions(*comp, "depth").mapInArrow(_finish, "conv_id long, depth long, n_leaves long, saved_tokens long")
    for f in finished:
        out = out.unionByName(f)
    return out


# --- digests of the ids that end at a node


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, depth, first, ids): sorted ids of a node as text, cut into pieces."""
    node, first, ids, size = None, 0, [], 0
    made: list[tuple] = []

    def flush() -> None:
        if ids:
            made.append((*node, first, ",".join(ids)))

    for batch in batches:
        for conv, depth, member in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if (conv, depth) != node or size > PIECE:
                flush()
                node, first, ids, size = (conv, depth), member, [], 0
            ids.append(str(member))
            size += len(ids[-1]) + 1
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], ["conv_id", "depth", "first", "ids"])
            made = []
    flush()
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], ["conv_id", "depth", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, depth, ends_sha256) of pieces that come in order; no more than a piece is at hand."""
    node, digest = None, None
    for batch in batches:
        made = []
        for conv, depth, ids in zip(*(batch.column(k) for k in (0, 1, 3)), strict=True):
            if (conv.as_py(), depth.as_py()) == node:
                digest.update(b"," + ids.as_py().encode())
                continue
            if node:
                made.append((*node, digest.hexdigest()))
            node, digest = (conv.as_py(), depth.as_py()), hashlib.sha256(ids.as_py().encode())
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], ["conv_id", "depth", "ends_sha256"])
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], ["conv_id", "depth", "ends_sha256"])


def end_digests(paths: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of the nodes at which conversations end: of their ids in ascending order, joined by commas.

    Ids are sorted and joined in ranges; one task then reads the pieces of a node in order, as SHA-256 asks for."""
    node = ["conv_id", "depth"]
    ends = materialise(paths.join(members.select(F.col("conv_id").alias("member"), F.col("length").alias("depth")), ["member", "depth"]).select(*node, "member"), "ends")
    pieces = ends.repartitionByRange(*node, "member").sortWithinPartitions(*node, "member").mapInArrow(_pieces, "conv_id long, depth long, first long, ids string")
    return pieces.repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, span: int = 20, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row a node."""
    turns, members = rebuilt(conversations, span)
    nodes, paths = nodes_of(turns, members)
    ends = end_digests(paths, members)
    out = nodes.join(rollup(nodes, paths, members, block), ["conv_id", "depth"]).join(ends, ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def query(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || chr(10) || role || chr(10) || text)) AS place FROM t),
d AS (SELECT DISTINCT conv_id, conv_id - ((conv_id % 20) + 20) % 20 AS base FROM o),
c AS MATERIALIZED (
  SELECT d.*, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii((conv_id::VARCHAR)[i:i])::UBIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda k: k::UBIGINT)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)) AS state FROM d),
h AS MATERIALIZED (SELECT conv_id, base, (xor(state, 4294967295::UBIGINT) % 4)::BIGINT AS h FROM c),
m AS MATERIALIZED (SELECT h.*, least(h, (SELECT count(*) FROM o WHERE o.conv_id = h.base)) AS m FROM h),
r AS MATERIALIZED (
  SELECT m.conv_id, o.place AS depth, o.role, o.text FROM m JOIN o ON o.conv_id = m.base AND o.place <= m.m
  UNION ALL SELECT m.conv_id, o.place - m.h + m.m, o.role, o.text FROM m JOIN o ON o.conv_id = m.conv_id AND o.place > m.h),
p AS MATERIALIZED (
  SELECT conv_id AS member, depth, text, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM r
  UNION ALL SELECT conv_id, 0, '', '' FROM m),
n AS MATERIALIZED (SELECT depth, k, min(member) AS conv_id, count(*) AS n_convs, any_value(len(regexp_extract_all(text, '[^ 	-]+'))) AS words FROM p GROUP BY depth, k),
q AS MATERIALIZED (SELECT p.member, p.depth, n.conv_id FROM p JOIN n USING (depth, k)),
u AS MATERIALIZED (SELECT n.*, q.conv_id AS parent_conv_id FROM n LEFT JOIN q ON q.member = n.conv_id AND q.depth = n.depth - 1),
f AS MATERIALIZED (SELECT u.*, (SELECT count(*) FROM u x WHERE x.parent_conv_id = u.conv_id AND x.depth = u.depth + 1) AS n_children FROM u),
s AS (SELECT q.conv_id, q.depth, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.words)::BIGINT AS saved_tokens FROM f JOIN q ON q.member = f.conv_id AND q.depth <= f.depth GROUP BY ALL),
e AS (SELECT q.conv_id, q.depth, string_agg(q.member::VARCHAR, ',' ORDER BY q.member) AS ids FROM q JOIN (SELECT member, max(depth) AS depth FROM q GROUP BY member) USING (member, depth) GROUP BY ALL)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM f JOIN s USING (conv_id, depth) LEFT JOIN e USING (conv_id, depth)"""
