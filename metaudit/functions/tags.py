"""Column functions on attribute tags and value representations (VRs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: VRs without text.
BINARY_VRS = ("OB", "OW", "OF", "OD", "OL", "OV", "UN")
NORMAL = "^[0-9a-f]{8}$"
#: The accepted spellings of a tag.
SPELLINGS = (r"^\([0-9a-fA-F]{4},[0-9a-fA-F]{4}\)$", r"^[0-9a-fA-F]{4},[0-9a-fA-F]{4}$", r"^(0[xX]|[xX])?[0-9a-fA-F]{8}$")


def normalize_tag(tag: Column, strict: bool = False) -> Column:
    """8 lowercase hex digits from any accepted spelling; others give null, or with ``strict`` an error that names the input."""
    trimmed = F.regexp_replace(tag, r"^\s+|\s+$", "")
    known = F.rlike(trimmed, F.lit("|".join(f"(?:{s})" for s in SPELLINGS)))
    hexes = F.lower(F.right(F.regexp_replace(trimmed, "[(),]", ""), F.lit(8)))
    otherwise = F.raise_error(F.concat(F.lit('Invalid tag "'), F.coalesce(tag, F.lit("null")), F.lit('"'))) if strict else F.lit(None)
    return F.when(known, hexes).otherwise(otherwise.cast("string"))


def is_normalized(tag: Column) -> Column:
    return F.coalesce(F.rlike(tag, F.lit(NORMAL)), F.lit(False))


def format_tag(tag: Column) -> Column:
    """(GGGG,EEEE)"""
    return F.concat(F.lit("("), F.upper(F.substring(tag, 1, 4)), F.lit(","), F.upper(F.substring(tag, 5, 4)), F.lit(")"))


def tag_group(tag: Column) -> Column:
    return F.conv(F.substring(tag, 1, 4), 16, 10).cast("int")


def tag_element(tag: Column) -> Column:
    return F.conv(F.substring(tag, 5, 4), 16, 10).cast("int")


def is_private(tag: Column) -> Column:
    """Odd groups are private; the last hex digit of the group tells."""
    return F.substring(tag, 4, 1).isin(*"13579bdf")


def is_private_creator(tag: Column) -> Column:
    return is_private(tag) & tag_element(tag).between(0x10, 0xFF)


def is_binary_vr(vr: Column) -> Column:
    return vr.isin(*BINARY_VRS)


def first_vr(vr: Column) -> Column:
    """The first of a compound VR such as "US or SS"."""
    return F.get(F.split(vr, " or "), F.lit(0))


def tag_of_path(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_depth(path: Column) -> Column:
    """0 at the top level, one more for each sequence item around."""
    return (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))) / 2
