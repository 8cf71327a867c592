"""Metadata scan: folders of files as outcome rows and attribute rows.

``read_folder`` is a data source of its own (``sources.folder``): partitions are planned by files and bytes, and
each opens one file system. ``scan`` takes a table of files instead, of which Spark has listed or read the contents.

A file is read through a window that moves along it up to the pixel data, past values that nobody asked for.
Every outcome is told in one pass: a file that cannot be opened, that is cut short or that gives fewer bytes
than its size states is a row, never an error of the task.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import BINARY_VRS

#: Fixed values of the file format: string VRs, VRs with a long header, numeric VRs by width and type.
STRING_VRS = "AE AS CS DA DS DT IS LO LT PN SH ST TM UC UI UR UT".split()
LONG_VRS = "OB OD OF OL OV OW SQ SV UC UN UR UT UV".split()
NUMBERS = {"US": "<u2", "SS": "<i2", "UL": "<u4", "SL": "<i4", "FL": "<f4", "FD": "<f8", "AT": "<u2"}
UNDEFINED = 0xFFFFFFFF
PIXEL_DATA = "7fe00010"
DIRECTORY_CLASS = "1.2.840.10008.1.3.10"
IMPLICIT = "1.2.840.10008.1.2"
REFUSED = {"1.2.840.10008.1.2.2": "big-endian files are not read", "1.2.840.10008.1.2.1.99": "deflated files are not read"}
#: Tags that tell how a file is read.
NEEDED = frozenset(("00020002", "00020010"))
MOST_NUMBERS, DEEPEST = 16, 32
#: Bytes that are read at once: as few at first, and more where one read goes on where the last one ended.
FIRST_BYTES, GROWTH, MOST_BYTES = 1 << 16, 4, 1 << 22
#: Values that are longer are skipped rather than read with what comes before and after them, if nobody asked for them.
SKIPPED_BYTES = 1 << 12

ATTRIBUTES = "path string, tag string, vr string, value string, length bigint, length_encoding string, item_count int, depth int, pos int"
SCANNED = f"file string, outcome string, reason string, message string, bytes_read bigint, attributes array<struct<{ATTRIBUTES.replace(' string', ': string').replace(' bigint', ': bigint').replace(' int', ': int')}>>"


def number_text(x: float) -> str:
    """A number with the fewest digits that name it, without an exponent for ordinary sizes."""
    if isinstance(x, np.float32):
        text = np.format_float_positional(x, unique=True, trim="-") if x == 0 or 1e-7 <= abs(x) < 1e21 else repr(float(str(x)))
        return "NaN" if math.isnan(x) else ("Infinity" if x > 0 else "-Infinity") if math.isinf(x) else text
    if isinstance(x, float):
        if math.isnan(x) or math.isinf(x):
            return "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
        return str(int(x)) if x == int(x) and abs(x) < 1e21 else repr(x)
    return str(int(x))


def numbers_text(raw: bytes, vr: str) -> str | None:
    """Numeric values joined with backslashes, sixteen at most; None if the bytes are not whole values."""
    width = 4 if vr == "AT" else np.dtype(NUMBERS[vr]).itemsize
    if len(raw) % width:
        return None
    values = np.frombuffer(raw, NUMBERS[vr])
    if vr == "AT":
        texts = [f"({a:04X},{b:04X})" for a, b in values.reshape(-1, 2)[:MOST_NUMBERS]]
    else:
        texts = [number_text(float(v) if vr == "FD" else v) for v in values[:MOST_NUMBERS]]
    count = len(raw) // width
    return "\\".join(texts) + (f" … ({count} values in all)" if count > MOST_NUMBERS else "")


class Window:
    """The bytes of a file of ``size`` bytes, of which a few are at hand. ``read(at, n)`` gives bytes of the file."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size, self.start, self.held, self.total, self.step = read, size, 0, b"", 0, FIRST_BYTES

    def get(self, at: int, n: int) -> bytes:
        """Bytes from ``at``, fewer only at the end of the file."""
        end, last = min(at + n, self.size), self.start + len(self.held)
        if not (self.start <= at and end <= last):
            kept = self.held[at - self.start :] if self.start <= at <= last else b""
            grows = at + len(kept) == last and len(self.held) > 132  # one read after the other
            self.step = min(max(self.step, FIRST_BYTES) * GROWTH, MOST_BYTES) if grows else self.step
            begin = at + len(kept)
            more = self.read(begin, max(end - begin, min(self.step, self.size - begin)))
            self.total += len(more)
            self.start, self.held = at, kept + more
            if len(self.held) < end - at:
                raise ValueError("the file gives fewer bytes than its size states")
        return self.held[at - self.start : end - self.start]


class _Reader:
    """Reads the elements of one file in order and notes a row for each. ``wanted`` are the tags whose values are read; None means all."""

    def __init__(self, data: Window, vrs: dict[str, str], wanted: frozenset[str] | None = None):
        self.data, self.vrs, self.wanted, self.rows, self.pixels = data, vrs, wanted, [], None

    def elements(self, at: int, end: int, implicit: bool, prefix: str, depth: int, until: str = "") -> int:
        """Read up to ``end``, a delimiter or the pixel data; returns where it stopped. ``until`` is the group of the file's own header."""
        if depth > DEEPEST:
            raise ValueError("sequences are nested too deeply")
        while at + 8 <= end:
            head = self.data.get(at, 12)
            group, element = struct.unpack_from("<HH", head)
            tag = f"{group:04x}{element:04x}"
            if until and tag[:4] != until:
                return at
            if tag == PIXEL_DATA and depth == 0:
                self.pixels = (at + 8, struct.unpack_from("<I", head, 4)[0]) if implicit else (at + 12, struct.unpack_from("<I", head, 8)[0]) if len(head) == 12 else None
                return end
            if group == 0xFFFE:
                if element in (0xE00D, 0xE0DD):
                    return at + 8
                at += 8
                continue
            if implicit:
                vr, length, at = self.vrs.get(tag, "UN"), struct.unpack_from("<I", head, 4)[0], at + 8
            else:
                vr = head[4:6].decode("latin-1")
                if vr in LONG_VRS:
                    if len(head) < 12:
                        raise ValueError(f"({tag}) runs past the end of the file")
                    length, at = struct.unpack_from("<I", head, 8)[0], at + 12
                else:
                    length, at = struct.unpack_from("<H", head, 6)[0], at + 8
            at = self.element(tag, vr, length, at, end, implicit, prefix, depth)
        return at

    def element(self, tag: str, vr: str, length: int, at: int, end: int, implicit: bool, prefix: str, depth: int) -> int:
        path = f"{prefix}/{tag}" if prefix else tag
        row = {"path": path, "tag": tag, "vr": vr, "value": None, "length": None, "length_encoding": None, "item_count": None, "depth": depth, "pos": len(self.rows)}
        self.rows.append(row)
        nested = vr == "SQ" or (vr == "UN" and length == UNDEFINED) or (implicit and vr == "UN" and length >= 8 and self.data.get(at, 4) == b"\xfe\xff\x00\xe0")
        if nested:
            row["length_encoding"] = "undefined" if length == UNDEFINED else "defined"
            stop = end if length == UNDEFINED else at + length
            if stop > end:
                raise ValueError(f"({tag}) runs past the end of the file")
            return self.items(row, at, stop, implicit or vr == "UN", depth, length == UNDEFINED)
        if length == UNDEFINED:
            raise ValueError(f"({tag}) has an undefined length")
        if at + length > end:
            raise ValueError(f"({tag}) runs past the end of the file")
        asked = self.wanted is None or tag in self.wanted or length <= SKIPPED_BYTES
        if vr in STRING_VRS and asked:
            row["value"] = self.data.get(at, length).decode("utf-8", "replace").partition("\0")[0].strip(" ")
        elif vr in NUMBERS and asked:
            row["value"] = numbers_text(self.data.get(at, length), vr)
        if vr in BINARY_VRS:
            row["length"] = length
        return at + length

    def items(self, row: dict, at: int, stop: int, implicit: bool, depth: int, open_ended: bool) -> int:
        count = 0
        while at + 8 <= stop:
            group, element, length = struct.unpack("<HHI", self.data.get(at, 8))
            at += 8
            if (group, element) == (0xFFFE, 0xE0DD):
                break
            if (group, element) != (0xFFFE, 0xE000):
                raise ValueError(f"({row['tag']}) holds something other than items")
            end = stop if length == UNDEFINED else at + length
            if end > stop:
                raise ValueError(f"({row['tag']}) has an item that runs past its end")
            reached = self.elements(at, end, implicit, f"{row['path']}/{count}", depth + 1)
            at = reached if length == UNDEFINED else end
            count += 1
        row["item_count"] = count
        return at if open_ended else stop


PIXELS = "file string, has_pixels boolean, encapsulated boolean, pixel_bytes bigint, offset_table array<bigint>, fragments array<struct<offset: bigint, length: bigint>>, message string"


def read_pixels(data: bytes | Window, vrs: dict[str, str] | None = None) -> tuple:
    """(has_pixels, encapsulated, pixel_bytes, offset_table, fragments) of one file, from the headers of its pixel data: what lies between is passed over. ``pixel_bytes`` are those of native data that are there."""
    reader = _read(data, vrs, frozenset())
    if reader.pixels is None:
        return False, False, None, None, None
    data, (at, length) = reader.data, reader.pixels
    if length != UNDEFINED:
        return True, False, min(length, data.size - at), None, None
    data.step, items, table = FIRST_BYTES // 16, [], None
    while at + 8 <= data.size:
        group, element, size = struct.unpack("<HHI", data.get(at, 8))
        if (group, element) != (0xFFFE, 0xE000):
            break
        if at + 8 + size > data.size:
            raise ValueError("a fragment runs past the end of the file")
        if table is None:
            table, first = np.frombuffer(data.get(at + 8, size - size % 4), "<u4").tolist(), at + 8 + size
        else:
            items.append({"offset": at - first, "length": size})
        at += 8 + size
    else:
        raise ValueError("the file ends before the last fragment does")
    return True, True, None, table or [], items


def scan_pixels(files: DataFrame, vrs: dict[str, str] | None = None) -> DataFrame:
    """A row a file of ``files`` (file) with what ``pixels.boundary_facts`` and ``decodability`` ask about its pixel data; files that cannot be read have a message."""

    def one(file: str) -> tuple:
        close = lambda: None
        try:
            read, size, close = opened(file)
            return (file, *read_pixels(Window(read, size), vrs), None)
        except Exception as e:  # a bad file is a row
            return file, None, None, None, None, None, str(e) or "the file could not be read"
        finally:
            close()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k in range(0, len(rows), 256):
                yield pd.DataFrame([one(f) for f in rows["file"][k : k + 256]], columns=["file", "has_pixels", "encapsulated", "pixel_bytes", "offset_table", "fragments", "message"])

    return files.select("file").mapInPandas(read, PIXELS)


def read_metadata(data: bytes | Window, vrs: dict[str, str] | None = None, wanted: frozenset[str] | None = None) -> list[dict]:
    """Attribute rows of one file. ``vrs``: VR by tag for files that do not state it; ``wanted``: the only tags whose longer values are read, if given."""
    return _read(data, vrs, wanted).rows


def _read(data: bytes | Window, vrs: dict[str, str] | None, wanted: frozenset[str] | None) -> _Reader:
    if isinstance(data, bytes):
        data = Window(lambda at, n, whole=data: whole[at : at + n], len(data))
    if not has_mark(data.get(0, 132)):
        raise ValueError("there is no file header")
    reader = _Reader(data, vrs or {}, None if wanted is None else wanted | NEEDED)
    at = reader.elements(132, data.size, False, "", 0, until="0002")
    syntax = next((r["value"] for r in reader.rows if r["tag"] == "00020010"), "") or ""
    if syntax in REFUSED:
        raise ValueError(REFUSED[syntax])
    reader.elements(at, data.size, syntax == IMPLICIT, "", 0)
    return reader


def has_mark(data: bytes) -> bool:
    return data[128:132] == b"DICM"


def has_magic(content: Column) -> Column:
    """The mark at bytes 128 to 131, for files that are at hand as a column."""
    return F.coalesce(F.substring(content, 129, 4) == F.lit(b"DICM"), F.lit(False))


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, relative_path, size): all files below ``root``, listed and not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return as_files(files, root)


def as_files(files: DataFrame, root: str) -> DataFrame:
    folder = re.sub("^[a-z0-9]+:/*", "/", root).rstrip("/")  # as it stands in the files' paths
    base = folder.rpartition("/")[2]
    below = F.get(F.split("path", re.escape(f"{folder}/"), 2), F.lit(1))
    return files.select(F.col("path").alias("file"), F.concat(F.lit(f"{base}/"), below).alias("relative_path"), F.col("length").alias("size"))


def opened(file: str, where: fs.FileSystem | None = None) -> tuple[Callable[[int, int], bytes], int, Callable[[], None]]:
    """(read, size, close) of a file. ``where`` is its file system, if one is open."""
    if where is None:  # file:/a is how listings name a local file
        where, file = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", file)) if re.match("[a-z0-9]+:", file) else (fs.LocalFileSystem(), file)
    handle = where.open_input_file(file)

    def read(at: int, n: int) -> bytes:
        """All bytes that can be had: a store may give fewer at once."""
        got = b""
        while len(got) < n and (more := handle.read_at(n - len(got), at + len(got))):
            got += more
        return got

    return read, handle.size(), handle.close


def read_outcome(open_file: Callable[[], tuple], vrs: dict[str, str] | None, wanted: frozenset[str] | None = None) -> tuple:
    """(outcome, reason, message, bytes read, attributes) of one file."""
    data, close = None, lambda: None
    try:
        read, size, close = open_file()
        data = Window(read, size)
        data.step = 132
        if size < 132 or not has_mark(data.get(0, 132)):
            return "skipped", "not-dicom", None, data.total, None
        data.step = FIRST_BYTES - 132
        rows = read_metadata(data, vrs, wanted)
        if any(r["tag"] == "00020002" and r["value"] == DIRECTORY_CLASS for r in rows if r["depth"] == 0):
            return "skipped", "dicomdir", None, data.total, None
        return "read", None, None, data.total, [r for r in rows if wanted is None or r["tag"] in wanted]
    except Exception as e:  # a bad file is a row
        return "failed", None, str(e) or "the file could not be read", data.total if data else 0, None
    finally:
        close()


def scan(files: DataFrame, vrs: dict[str, str] | None = None, tags: Iterable[str] | None = None) -> DataFrame:
    """(file, outcome, reason, message, bytes_read, attributes): one row a file of ``files`` (file). ``vrs`` is the dictionary's VR by tag, of a few thousand entries; ``tags`` the only ones that are wanted.

    Outcomes are read, skipped (reason not-dicom or dicomdir) and failed (with a message). Files are opened through Arrow's
    file systems: local and mounted folders, and the stores that its build knows. For other stores give ``content`` beside
    ``file``, the whole file as Spark's readers give it."""
    wanted, has = None if tags is None else frozenset(tags), "content" in files.columns

    def source(row) -> Callable[[], tuple]:
        if has and row.content is not None:
            whole = bytes(row.content)
            return lambda: (lambda at, n: whole[at : at + n], len(whole), lambda: None)
        return lambda: opened(row.file)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k in range(0, len(rows), 256):  # so that few files' rows are at hand
                out = [(r.file, *read_outcome(source(r), vrs, wanted)) for r in rows[k : k + 256].itertuples(index=False)]
                yield pd.DataFrame(out, columns=["file", "outcome", "reason", "message", "bytes_read", "attributes"])

    return files.select("file", *(["content"] if has else [])).mapInPandas(read, SCANNED)


def outcomes(scanned: DataFrame) -> DataFrame:
    return scanned.drop("attributes", "bytes_read", "study", "series")


def attributes(scanned: DataFrame) -> DataFrame:
    """(file, path, tag, vr, value, length, length_encoding, item_count, depth, pos) of the files read, with study and series if ``scanned`` has them."""
    keys = [c for c in ("study", "series") if c in scanned.columns]
    return scanned.filter("outcome = 'read'").select("file", *keys, F.explode("attributes").alias("a")).select("file", *keys, "a.*")
