"""Benchmark decontamination by template canonicalisation (native: DataFrame functions only).

Words become template tokens: lower-case without outer punctuation, or a typed placeholder for a number, a
unit or a name (a capitalised word within a sentence). Windows of five tokens of documents and benchmark
items meet in a hash join. Along one alignment of an item and a document each slot value of the item must
stand for one value in the document; then different values are a re-parameterised question. A document
leaks an item if it holds at least 0.8 of the item's windows. A window of fewer than two literal words says
too little as a template: it only meets windows with the same values.

Before that, documents that cannot leak are set aside without loss: who holds 0.8 of an item's windows
holds one of any set of more than 0.2 of them, so it has all literal words of one window of such a set, the
rarest of these words (the window's anchor) among them. Of each item the windows with the rarest anchors are
taken, by how many documents have the word; a window with a word that no document has needs no look at all.
Documents and anchors meet by an equi-join on words, and windows are compared for the pairs of document and
item that met so, not for all items that share a window. The cost of a document thus grows with the items
that it shares a rare word with, not with the benchmark; only where all words of an item are common does it
meet many documents.

Defined results: a null or empty text has no tokens and leaks nothing; an item without tokens never
matches; an item of fewer than five tokens is one window of its length; of an item made of placeholders
only copies with its values leak, not the question with others; rows that repeat are rows of their
own; with an empty table nothing leaks; extra columns are ignored or kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, among, located, materialise, small, text_or_empty, without

#: Measures and currencies that count as units.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams ton tons pound pounds ounce ounces ml l liter liters litre litres "
    "second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur percent degrees"
).split()
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
WINDOW, SHARE, LITERALS = 5, 0.8, 2


_STOP = "\u0001"
_INNER = r"\x20\x09-\x0D"


def tokens(text: Column) -> Column:
    """array<struct<token, value>>: ``value`` is what a placeholder stands for, else null.

    Punctuation is handled in the whole text at once: stops at the end of a word become one mark, other outer
    punctuation goes. A word after a mark, or the first one, starts a sentence."""
    marked = F.regexp_replace(F.translate(text, _STOP, "\u0002"), rf"[.!?:][^\p{{L}}\p{{N}}{_INNER}]*(?![^{_INNER}])", _STOP)
    bare = F.regexp_replace(marked, rf"(?<![^{_INNER}])[^\p{{L}}\p{{N}}{_STOP}{_INNER}]+|[^\p{{L}}\p{{N}}{_STOP}{_INNER}]+(?![^{_STOP}{_INNER}])", "")
    words = F.filter(F.split(bare, SPACE), lambda w: w != "")
    stops = F.transform(words, lambda w: F.endswith(w, F.lit(_STOP)))
    # Each word beside whether the one before it ends a sentence; the longer array's last entry has no word.
    ahead = F.zip_with(words, F.concat(F.array(F.lit(True)), stops), lambda w, s: F.struct(F.translate(w, _STOP, "").alias("core"), s.alias("starts")))

    def token(c: Column) -> Column:
        core, low = c["core"], F.lower(c["core"])
        kind = (
            F.when((core >= "0") & (core < ":") & F.rlike(core, F.lit(r"^[0-9]+([.,:/][0-9]+)*$")), F.lit(NUMBER))
            .when(low.isin(UNITS), F.lit(UNIT))
            .when(~c["starts"] & (core != low) & F.rlike(core, F.lit(r"^\p{Lu}\p{L}*\p{Ll}")), F.lit(NAME))
        )
        return F.struct(F.coalesce(kind, low).alias("token"), F.when(kind.isNotNull(), low).alias("value"))

    return F.transform(F.filter(ahead, lambda c: F.coalesce(c["core"], F.lit("")) != ""), token)


def windows(size: int) -> Column:
    """array<struct<at, key, slots>> of all windows of ``size`` tokens of the columns ``tok`` and ``val``; slots are joined by spaces, empty for literal words. Where literal words are short the key has the values too."""
    starts = F.when(F.size("tok") >= size, F.sequence(F.lit(0), F.size("tok") - size)).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice("tok", i + 1, size), " ").alias("key"), F.array_join(F.slice("val", i + 1, size), " ", "").alias("slots")))

    def keyed(w: Column) -> Column:
        # Without values the slots are spaces alone, which is told apart cheaply.
        literal = F.size(F.filter(F.split(w["slots"], " "), lambda v: v == ""))
        short = (F.length(w["slots"]) >= size) & (literal < min(LITERALS, size)) if size > 1 else w["slots"] != ""
        return F.struct(w["at"].alias("at"), F.when(short, F.concat_ws(f" {_STOP} ", w["key"], w["slots"])).otherwise(w["key"]).alias("key"), w["slots"].alias("slots"))

    return F.transform(cut, keyed)


def tokenised(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, tok, val), written: what reads windows would otherwise make the tokens anew for each."""
    made = rows.select(F.col(key).alias(key), tokens(text_or_empty()).alias("t"))
    return materialise(made.select(key, F.transform("t", lambda t: t["token"]).alias("tok"), F.transform("t", lambda t: t["value"]).alias("val")), label)


def _plain_words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def item_windows(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """(item_id, size, n, at, key, slots) of all items' windows, written; and the window sizes in use, five at most."""
    items = tokenised(benchmark.select(F.col("item_id").alias("item_id"), F.col("text").alias("text")), "item_id", "item-tokens").filter(F.size("tok") > 0)
    parts = [items.filter(F.size("tok") >= WINDOW).select("item_id", F.lit(WINDOW).alias("size"), windows(WINDOW).alias("w"))]
    parts += [items.filter(F.size("tok") == k).select("item_id", F.lit(k).alias("size"), windows(k).alias("w")) for k in range(1, WINDOW)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    rows = every.select("item_id", "size", F.explode("w").alias("w")).select("item_id", "size", "w.*")
    counts = rows.groupBy("item_id").agg(F.count_distinct("key").alias("n"))
    found = materialise(rows.join(counts, "item_id"), "items")
    return found, [r[0] for r in found.select("size").distinct().collect()]  # of 1 to 5


def key_words(items: DataFrame) -> DataFrame:
    """(item_id, n, key, words): the different windows of each item, with the words that a document must have for them. Values in a key are such words."""
    literal = F.filter(F.split("key", " "), lambda w: ~w.isin(NUMBER, UNIT, NAME))
    words = F.array_distinct(F.filter(F.flatten(F.transform(literal, _plain_words)), lambda w: w != ""))
    return items.select("item_id", "n", "key").distinct().select("item_id", "n", "key", words.alias("words"))


def document_counts(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, n_docs) for the words of ``vocabulary`` that occur in ``rows`` (text); added up before the shuffle."""
    words = rows.select(F.explode(F.array_distinct(_plain_words(F.col("text")))).alias("word"))
    few = small(vocabulary)
    if few is not vocabulary:
        return words.join(few, "word").groupBy("word").agg(F.count("*").alias("n_docs"))
    return words.groupBy("word").agg(F.count("*").alias("n_docs")).join(vocabulary, "word")


def anchors(keys: DataFrame, counts: DataFrame) -> DataFrame:
    """(item_id, anchor, words): of each item as many windows as a leaking document cannot all miss, those with the rarest words. Windows with a word that is in no document are left out; those without words have the anchor ''."""
    rare = F.struct(F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "word")
    ranked = keys.select("item_id", "n", "key", "words", F.explode_outer("words").alias("word")).join(small(counts), "word", "left")
    ranked = ranked.groupBy("item_id", "n", "key").agg(F.min(F.when(F.col("word").isNotNull(), rare)).alias("rarest"), F.first("words").alias("words"))
    lone = F.struct(F.coalesce("rarest.n_docs", F.lit(2**62)).alias("n_docs"), F.coalesce("rarest.word", F.lit("")).alias("anchor"), "words")
    needed = F.floor(F.col("n") * (1 - SHARE) + 1e-9) + 1
    taken = ranked.groupBy("item_id", "n").agg(F.array_sort(F.collect_list(lone)).alias("l"))
    return taken.select("item_id", F.explode(F.slice("l", F.lit(1), needed.cast("int"))).alias("l")).filter("l.n_docs > 0").select("item_id", "l.anchor", "l.words")


def compare(base: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(suspects, leaks) of located rows: suspects (uid, at, doc_id), leaks (uid, item_id, matched, windows); both written.

    Texts are read four times, twice for ever fewer rows, and only words and windows of those that may leak are shuffled."""
    rows = base.select("at", F.col("row.doc_id").alias("doc_id"), text_or_empty("row.text").alias("text"))
    items, sizes = item_windows(benchmark)
    keys = materialise(key_words(items), "keys")
    counts = materialise(document_counts(rows, keys.select(F.explode("words").alias("word")).distinct()), "counts")
    # A number stands for the words of a window: items that share it are looked up afterwards.
    anchored = materialise(anchors(keys, counts).withColumn("words", F.array_sort("words")).withColumn("window", F.xxhash64("words")), "anchors")
    windows_of = anchored.select("window", "anchor", "words").distinct()
    shortest = windows_of.agg(F.coalesce(F.min(F.length("anchor")), F.lit(0))).first()[0]
    # Which anchors a document has: an equi-join of its words that are no shorter than any anchor.
    words = F.filter(F.array_distinct(F.concat(_plain_words(F.col("text")), F.array(F.lit("")))), lambda w: F.length(w) >= shortest)
    met = materialise(rows.select("at", F.explode(words).alias("anchor")).join(small(windows_of.select("anchor").distinct()), "anchor"), "anchored")
    # Of those documents, the ones that have all words of a window whose anchor they have.
    needed = met.join(windows_of, "anchor").groupBy("at").agg(F.collect_set(F.struct("window", "words")).alias("needed"))
    having = among(rows, met.select("at").distinct()).select("at", "doc_id", _plain_words(F.col("text")).alias("have")).join(needed, "at")
    whole = F.transform(F.filter("needed", lambda n: F.size(F.array_except(n["words"], "have")) == 0), lambda n: n["window"])
    close = having.select("at", "doc_id", whole.alias("held")).filter(F.size("held") > 0)
    suspects = materialise(close.withColumn("uid", F.monotonically_increasing_id()), "suspects")
    pairs = materialise(suspects.select("uid", F.explode("held").alias("window")).join(small(anchored.select("window", "item_id")), "window").select("uid", "item_id").distinct(), "candidates")
    found = tokenised(among(rows.select("at", "text"), suspects.select("at", "uid")), "uid", "suspect-tokens")
    held = None
    for size in sizes:
        part = found.select("uid", F.lit(size).alias("size"), F.explode(windows(size)).alias("w")).select("uid", "size", F.col("w.at").alias("d_at"), F.col("w.key").alias("key"), F.col("w.slots").alias("d_slots"))
        held = part if held is None else held.unionByName(part)
    if held is None:
        return suspects, base.sparkSession.createDataFrame([], "uid bigint, item_id bigint, matched bigint, windows bigint")
    known = items.select("size", "key").distinct()
    few = small(known)
    if few is not known:  # what no item has is not shuffled
        held = held.join(few, ["size", "key"], "left_semi")
    values = lambda c: F.transform(F.split(c, " "), lambda v: F.when(v != "", v))
    # Windows meet within a candidate pair: a window that many documents and items share is no key of its own.
    asked = pairs.join(small(items), "item_id")
    met = held.join(asked, ["uid", "size", "key"]).select("uid", "item_id", "n", "key", (F.col("d_at") - F.col("at")).alias("shift"), F.arrays_zip(values("slots").alias("i"), values("d_slots").alias("d")).alias("slots"))
    met = materialise(met, "met")
    slots = met.select("uid", "item_id", "shift", F.explode("slots").alias("s")).filter("s.i IS NOT NULL").groupBy("uid", "item_id", "shift", "s.i").agg((F.min("s.d") != F.max("s.d")).alias("bad"))
    bad = slots.filter("bad").select("uid", "item_id", "shift").distinct()
    whole = met.join(bad, ["uid", "item_id", "shift"], "left_anti").groupBy("uid", "item_id").agg(F.count_distinct("key").alias("matched"), F.max("n").cast("bigint").alias("windows"))
    return suspects, materialise(whole.filter(F.col("matched") >= SHARE * F.col("windows") - 1e-9), "leaks")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, windows, share), one row for each leaking document and item."""
    suspects, leaks = compare(located(docs), benchmark)
    return suspects.select("uid", "doc_id").join(leaks, "uid").select("doc_id", "item_id", "matched", "windows", F.round(F.col("matched") / F.col("windows"), 6).alias("share"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item."""
    base = located(docs)
    suspects, leaks = compare(base, benchmark)
    return without(base, suspects.join(leaks, "uid", "left_semi").select("at")).select("row.*")


def query(spark, sf_dir):
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same in SQL, windows of all sizes compared. ``matched`` counts different windows on consistent alignments.
_SQL_TOKENS = r"""
{x}1 AS (SELECT id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w FROM ({source}))),
{x}0 AS (SELECT id, i, regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS core, regexp_matches(w, '[.!?:][^\p{{L}}\p{{N}}]*$') AS stops FROM {x}1),
{x}2 AS (SELECT id, i, core, coalesce(lag(stops) OVER (PARTITION BY id ORDER BY i), TRUE) AS starts FROM {x}0 WHERE core <> '' OR stops),
{x}3 AS (SELECT id, i, lower(core) AS low, CASE WHEN regexp_matches(core, '^[0-9]+([.,:/][0-9]+)*$') THEN '<num>' WHEN lower(core) IN ({units}) THEN '<unit>' WHEN NOT starts AND regexp_matches(core, '^\p{{Lu}}\p{{L}}*\p{{Ll}}') THEN '<name>' END AS kind FROM {x}2 WHERE core <> ''),
{x}4 AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS p, coalesce(kind, low) AS t, CASE WHEN kind IS NOT NULL THEN low END AS v FROM {x}3),
{x}5 AS (SELECT id, p, [t, lead(t, 1) OVER k, lead(t, 2) OVER k, lead(t, 3) OVER k, lead(t, 4) OVER k] AS ts, [v, lead(v, 1) OVER k, lead(v, 2) OVER k, lead(v, 3) OVER k, lead(v, 4) OVER k] AS vs,
               count(*) OVER (PARTITION BY id) AS n FROM {x}4 WINDOW k AS (PARTITION BY id ORDER BY p)),
{x}6 AS (SELECT id, p, n, s, ts[1:s] AS ts, vs[1:s] AS slots FROM {x}5, (SELECT unnest(range(1, 6)) AS s) WHERE p + s - 1 <= n AND {sizes}),
{x} AS (SELECT id, p, s, slots, array_to_string(ts, ' ') || CASE WHEN len(list_filter(slots, lambda v: v IS NULL)) < least(2, s) THEN chr(1) || array_to_string(list_transform(slots, lambda v: coalesce(v, '')), ' ') ELSE '' END AS key FROM {x}6)"""
_UNITS_SQL = ", ".join(f"'{u}'" for u in UNITS)
ORACLE = (
    "WITH u AS (SELECT row_number() OVER () AS id, doc_id, text FROM documents),"
    + _SQL_TOKENS.format(x="b", source="SELECT item_id AS id, text FROM benchmark", units=_UNITS_SQL, sizes="s = least(n, 5)")
    + ","
    + _SQL_TOKENS.format(x="d", source="SELECT id, text FROM u", units=_UNITS_SQL, sizes="s IN (SELECT s FROM b)")
    + """,
n AS (SELECT id, count(DISTINCT key) AS windows FROM b GROUP BY id),
m AS (SELECT d.id, b.id AS item_id, d.key, d.p - b.p AS shift, unnest(b.slots) AS item_value, unnest(d.slots) AS doc_value FROM d JOIN b ON d.s = b.s AND d.key = b.key),
x AS (SELECT DISTINCT id, item_id, shift FROM (SELECT id, item_id, shift, item_value FROM m WHERE item_value IS NOT NULL GROUP BY ALL HAVING min(doc_value) <> max(doc_value))),
l AS (SELECT id, item_id, count(DISTINCT key) AS matched FROM m ANTI JOIN x USING (id, item_id, shift) GROUP BY ALL)
SELECT doc_id, item_id, matched, windows, round(matched / windows, 6) AS share FROM l JOIN n ON l.item_id = n.id JOIN u ON u.id = l.id WHERE matched >= 0.8::DOUBLE * windows - 1e-9"""
)
