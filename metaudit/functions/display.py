"""Column functions that word values and findings. None of them shows a value unless it is asked to."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tags import format_tag, is_binary_vr

MASK = "●" * 8
#: What each action code of the profile means.
ACTION_GLOSS = {
    "X": "remove",
    "U": "replace with a new UID",
    "D": "replace with a dummy value",
    "Z": "blank, or replace with a dummy",
    "K": "keep",
    "C": "clean",
    "Z/D": "blank, or a dummy where the field cannot be empty",
    "X/Z": "remove, or blank",
    "X/D": "remove, or replace with a dummy",
    "X/Z/D": "remove, blank, or replace with a dummy",
    "X/Z/U*": "remove, blank, or replace with a new UID",
}
#: Why a file belongs to no series.
UNGROUPED_WORDS = {"missing-study": "no study identifier", "missing-series": "no series identifier", "missing-both": "neither identifier"}
ORDER_WORDS = {
    "position": "Ordered by position",
    "instance-number": "Ordered by instance number, as not every file has a usable position",
    "filename": "Ordered by file name, as neither positions nor instance numbers serve",
}
PRIVATE_REASON = "a private field: only its maker knows what it holds"


def _words(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])[key]


def plain_text(value: Column, vr: Column, length: Column) -> Column:
    """A value as words: byte counts for binary data, and marks for what has no text."""
    size = F.when(length.isNull(), F.lit("<binary, length not stated>")).otherwise(F.concat(F.lit("<binary, "), F.format_number(length, 0), F.when(length == 1, F.lit(" byte>")).otherwise(F.lit(" bytes>"))))
    return F.when(is_binary_vr(vr), size).when(value == "", "(empty)").when(value.isNull() & (vr == "SQ"), "(sequence)").when(value.isNull(), "(not shown)").otherwise(value)


def is_maskable(value: Column, vr: Column) -> Column:
    return ~is_binary_vr(vr) & value.isNotNull() & (value != "")


def masked(value: Column, vr: Column, length: Column) -> Column:
    """Eight dots, whatever the value's length, for what has text; else as ``plain_text``."""
    return F.when(is_maskable(value, vr), F.lit(MASK)).otherwise(plain_text(value, vr, length))


def shown_in_view(value: Column, vr: Column, length: Column, identifying: Column) -> Column:
    """What a view shows by default: dots for values that have text and identify, the plain text of all others."""
    return F.when(identifying & is_maskable(value, vr), F.lit(MASK)).otherwise(plain_text(value, vr, length))


def action_gloss(action: Column) -> Column:
    """The words for an action code; an unknown code stands for itself."""
    return F.coalesce(_words(action, ACTION_GLOSS), action)


def either(condition: Column, yes: str, no: str) -> Column:
    return F.when(condition, F.lit(yes)).otherwise(F.lit(no))


def filled(sentence: str, *parts: Column) -> Column:
    """The sentence with each ``{}`` replaced by a column in turn; null if one of them is null."""
    first, *others = sentence.split("{}")
    return F.concat(F.lit(first), *[c for part, text in zip(parts, others, strict=True) for c in (part, F.lit(text))])


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), either(n == 1, "", "s"))


def format_mm(mm: Column) -> Column:
    """At most three decimals, without trailing zeros; halves round up."""
    thousandths = F.floor(mm * 1000 + 0.5).cast("bigint")
    whole = F.floor(F.abs(thousandths) / 1000).cast("bigint").cast("string")
    rest = F.rtrim(F.lpad((F.abs(thousandths) % 1000).cast("string"), 3, "0"), F.lit("0"))
    return F.concat(F.when(thousandths < 0, F.lit("-")).otherwise(F.lit("")), whole, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")))


def file_list(files: Column, limit: int = 5) -> Column:
    """The first names and how many more."""
    first = F.array_join(F.slice(files, 1, limit), ", ")
    return F.when(F.size(files) <= limit, first).otherwise(F.concat(first, F.lit(", and "), (F.size(files) - limit).cast("string"), F.lit(" more")))


def field_name(name: Column, tag: Column) -> Column:
    return F.coalesce(name, format_tag(tag))


def slug(name: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(made, F.lit("")) == "", F.lit("files")).otherwise(made)


def report_filename(folder: Column, extension: str, now: Column, prefix: str = "metaudit") -> Column:
    return F.concat(F.lit(f"{prefix}-"), slug(folder), F.lit("-"), F.date_format(now, "yyyy-MM-dd"), F.lit(f".{extension}"))


def ungrouped_words(reason: Column) -> Column:
    return _words(reason, UNGROUPED_WORDS)


def order_words(ordered_by: Column) -> Column:
    return _words(ordered_by, ORDER_WORDS)


def presence_words(present: Column, total: Column) -> Column:
    return F.when(present == total, F.concat(F.lit("in all "), total.cast("string"), F.lit(" files"))).otherwise(F.concat(F.lit("in "), present.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" files")))
