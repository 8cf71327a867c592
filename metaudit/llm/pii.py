"""Personal data: base patterns, and information-theoretic sanitisation (native: DataFrame functions only).

Base spans are emails, ip addresses, card and phone numbers. Their values are the protected entities, and
so are the parts that several values share: a mail domain, the first three numbers of an ip address, the
first six digits of a card, the first four of a phone. All terms of a document that holds an entity are
candidates, at any distance from it. Over all documents of the corpus the pointwise mutual information of
term and entity says how much of the entity's information content the term gives away, that is, how many
bits are left to guess. What counts is the lower confidence bound of that information (Wilson's bound on
the entity's probability given the term), so that a term which was seen once, and so comes with that
document's entities by chance, proves nothing at any corpus size. An entity's information counts up to
``bits``: the threshold then asks for the same evidence in small and large corpora, while an entity that
many documents hold (a hot mail domain) asks for more. Terms that reach the lower threshold are generalised
wherever they occur in the entity's documents, those that reach the upper one are removed. Copies of a
document count as documents, so the words that only they have look as if they revealed what copies share:
drop copies first.

All counts are of documents and of what lies outside base spans. A document gives a pair for each of its
different terms and entities; documents without entities are only counted.

Defined results: a null text is empty; documents without base spans get none from the method; rows that
repeat are rows of their own, in the counts too; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, materialise, running, running_sums, text_or_empty

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"A-Za-z0-9._%+-"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Patterns that find the same leftmost matches as the contract's in linear time: an email starts where a
#: run of its characters starts or the last match ended, an ip where a run of digits starts, a card is a whole
#: run of digits of the right length.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap signs without which a text has no match.
SIGNS = {"email": r"@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
TERM = r"[\p{L}\p{N}][\p{L}\p{N}'’-]*[\p{L}\p{N}]"
_SPAN = "struct<start:bigint,kind:int,end:bigint,value:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    figures = F.split(F.reverse(_digits(value)), "")
    doubled = F.transform(F.filter(figures, lambda x: x != ""), lambda x, i: x.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.rlike(value, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, kind: int = 0) -> Column:
    """array<struct<start, kind, end, value>> of all leftmost matches, in code points from 0. What lies between matches gives their places."""

    def span(m: Column, end: Column) -> Column:
        return F.struct((end - F.length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m.alias("value"))

    def placed(found: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.size(found))
        return F.zip_with(found, running_sums(F.zip_with(gaps, found, lambda g, m: g + F.length(m))), span)

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _that_hold(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _holds(kind, s["value"]))


def base_spans(text: Column) -> Column:
    none = F.array().cast(f"array<{_SPAN}>")
    parts = []
    for i, kind in enumerate(KINDS):
        sign = F.contains(text, F.lit("@")) if kind == "email" else F.rlike(text, F.lit(SIGNS[kind]))
        parts.append(F.when(sign, _that_hold(kind, matches(text, PATTERNS[kind], i))).otherwise(none))
    return F.array_sort(F.concat(*parts))


#: Code points of the pieces that a text is cut into, so that a cut needs no walk from the beginning.
_PIECE = 1024


def _cut(pieces: Column, begin: Column, end: Column) -> Column:
    """The text of code points begin to end, from its pieces."""
    first, last = F.floor(begin / _PIECE).cast("int"), F.floor((end - 1) / _PIECE).cast("int")
    ahead, behind = (begin % _PIECE + 1).cast("int"), ((end - 1) % _PIECE + 1).cast("int")
    within = F.substring(F.get(pieces, first), ahead, (end - begin).cast("int"))
    across = F.concat(F.substr(F.get(pieces, first), ahead), F.array_join(F.slice(pieces, first + 2, last - first - 1), ""), F.substring(F.get(pieces, last), F.lit(1), behind))
    return F.when(end <= begin, F.lit("")).when(first == last, within).otherwise(across)


def _rewritten(text: Column, spans: Column, put: Callable[[Column, Column, Column], Column]) -> Column:
    """The text with ``put(span, at, ahead)`` for each span and what lies ahead of it; ``at`` is where the spans before it end."""
    zero = F.lit(0).cast("bigint")

    def joined(pieces: Column) -> Column:
        def over(ends: Column) -> Column:
            made = F.zip_with(spans, F.concat(F.array(zero), ends), lambda s, at: F.when(s.isNotNull(), put(s, at, _cut(pieces, at, s["start"]))))
            return F.concat(F.array_join(made, ""), _cut(pieces, F.coalesce(F.get(ends, F.size(ends) - 1), zero), F.length(text).cast("bigint")))

        return bound(running(F.transform(spans, lambda s: s["end"]), F.greatest), over)

    return bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)), joined)


def _outside(text: Column, spans: Column) -> Column:
    """The text with blanks in place of the spans, so that what lies beside them keeps its place."""
    return _rewritten(text, spans, lambda s, at, ahead: F.concat(ahead, F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(at, s["start"]), F.lit(0)).cast("int"))))


def entities(span: Column) -> Column:
    """The protected value of a base span and the part of it that other values may share."""
    kind, digits = span["kind"], _digits(span["value"])
    value = F.when(kind <= 1, F.lower(span["value"])).otherwise(digits)
    part = F.when(kind == 0, F.substring_index(value, "@", -1)).when(kind == 1, F.substring_index(value, ".", 3)).when(kind == 2, F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))
    return F.array(F.concat_ws(":", kind, value), F.concat_ws(":", kind, F.lit("part"), part))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def candidates(found: DataFrame) -> DataFrame:
    """(uid, term) of all terms outside base spans of (uid, text, base), once for each text; made within its row."""
    return found.select("uid", F.explode(F.array_distinct(F.transform(_terms(_outside(F.col("text"), F.col("base"))), F.lower))).alias("term"))


def places(found: DataFrame) -> DataFrame:
    """(uid, term, start, end) of each term outside base spans."""

    def placed(free: Column) -> Column:
        def at(terms: Column) -> Column:
            gaps = F.slice(F.transform(F.split(free, TERM, -1), F.length), 1, F.size(terms))
            ends = running_sums(F.zip_with(gaps, terms, lambda g, m: g + F.length(m)))
            return F.zip_with(terms, ends, lambda m, end: F.struct(F.lower(m).alias("term"), (end - F.length(m)).alias("start"), end.alias("end")))

        return bound(_terms(free), at)

    return found.select("uid", F.explode(bound(_outside(F.col("text"), F.col("base")), placed)).alias("p")).select("uid", "p.*")


def disclosure(n_ct: Column, total: int, z: float, bits: float, n_c: Column | None = None) -> Column:
    """Share of an entity's information that a term gives away for sure (``z`` deviations), from the documents with both (n_ct), the entity (n_c) and the term (n_t): 1 less the bits left to guess over the entity's bits, or over ``bits`` where it has more."""
    n_t, usual = F.col("n_t"), (F.col("n_c") if n_c is None else n_c) / max(total, 2)  # one document or none has no entities that count
    given, z2 = n_ct / n_t, z * z
    least = (given + z2 / (2 * n_t) - z * F.sqrt(given * (1 - given) / n_t + z2 / (4 * n_t * n_t))) / (1 + z2 / n_t)
    return 1 + F.log2(least) / F.least(-F.log2(usual), F.lit(bits))


def revealing(docs: DataFrame, held: DataFrame, around: DataFrame, total: int, z: float, bits: float, least: float) -> DataFrame:
    """(uid, term, reveals) for the pairs of ``held`` (uid, entity) and ``around`` (uid, term) that reach ``least``."""
    plain = docs.select(text_or_empty().alias("text")).filter(F.size(base_spans(F.col("text"))) == 0)
    words = plain.select(F.explode(F.array_distinct(F.transform(_terms(F.col("text")), F.lower))).alias("term")).unionByName(around.select("term"))
    n_t = words.groupBy("term").agg(F.count("*").alias("n_t"))  # added up before the shuffle
    n_c = held.groupBy("entity").agg(F.count("*").alias("n_c")).filter(F.col("n_c") < total)
    # Terms and an entity of one document meet once, so all such entities of a document are disclosed alike: that is decided by term.
    counted = materialise(held.join(n_c, "entity"), "counted")
    lone = counted.filter("n_c = 1").select("uid").distinct()
    near = materialise(around.join(n_t, "term"), "near")
    once = near.select("uid", "term", disclosure(F.lit(1), total, z, bits, F.lit(1)).alias("reveals")).filter(F.col("reveals") >= least)
    alone = once.join(lone, "uid").select("uid", "term", "reveals")
    # A pair occurs n_c or n_t times at most; what cannot reach the threshold with that is not counted.
    most = disclosure(F.least("n_c", "n_t"), total, z, bits)
    shared = materialise(near.join(counted.filter("n_c > 1"), "uid").filter(most >= least), "pairs")
    n_ct = shared.groupBy("entity", "term", "n_c", "n_t").agg(F.count("*").alias("n_ct"))
    met = n_ct.select("entity", "term", disclosure(F.col("n_ct"), total, z, bits).alias("reveals")).filter(F.col("reveals") >= least)
    return alone.unionByName(shared.join(met, ["entity", "term"]).select("uid", "term", "reveals"))


def find_personal_data(docs: DataFrame, z: float = 1.96, bits: float = 4.0, generalise_at: float = 0.6, remove_at: float = 0.9) -> DataFrame:
    """(doc_id, text, base, added), one row a document: ``base`` and ``added`` are arrays of spans; added kinds are 4 (generalise) and 5 (remove). ``text`` is null where there is no span."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    found = F.size("base") > 0
    rows = materialise(rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.when(found, F.col("text")).alias("text"), "base"), "personal")
    holders = rows.filter("text IS NOT NULL")
    held = materialise(holders.select("uid", F.explode(F.array_distinct(F.flatten(F.transform("base", entities)))).alias("entity")), "held")
    kind = F.when(F.max("reveals") >= remove_at, F.lit(5)).otherwise(F.lit(4))
    marked = revealing(docs, held, candidates(holders), rows.count(), z, bits, generalise_at).groupBy("uid", "term").agg(kind.alias("kind"))
    span = F.struct("start", "kind", "end", F.lit(None).cast("string").alias("value"))
    added = places(holders).join(marked, ["uid", "term"]).groupBy("uid").agg(F.array_sort(F.collect_list(span)).alias("added"))
    return rows.join(added, "uid", "left").select("doc_id", "text", "base", F.coalesce("added", F.array().cast(f"array<{_SPAN}>")).alias("added"))


#: What stands in a sanitised text for each kind of span.
PLACEHOLDERS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", "")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its placeholder; of spans that overlap the first counts."""
    marks = F.array(*[F.lit(p) for p in PLACEHOLDERS])
    return _rewritten(text, spans, lambda s, at, ahead: F.when(s["start"] >= at, F.concat(ahead, F.get(marks, s["kind"]))).otherwise(F.lit("")))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text, spans): texts with base spans and revealing terms replaced; ``text`` is null where nothing was found."""
    found = find_personal_data(docs, **options)
    spans = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", sanitised(F.col("text"), spans).alias("text"), spans.alias("spans"))


def query(spark, sf_dir):
    names = F.array(*[F.lit(k) for k in (*KINDS, "generalise", "remove")])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
