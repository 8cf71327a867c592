"""Pixel jobs: which files can be decoded, which fragments make a frame, frame samples and grey levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import voi

#: Transfer syntaxes that can be decoded, and how they store samples.
SYNTAXES = {"1.2.840.10008.1.2": "native", "1.2.840.10008.1.2.1": "native", "1.2.840.10008.1.2.5": "rle", "1.2.840.10008.1.2.4.50": "jpeg"}
#: Photometric forms of JPEG images.
JPEG_FORMS = ("MONOCHROME1", "MONOCHROME2", "YBR_FULL", "YBR_FULL_422", "RGB")
#: Top-level tags of the triage.
IMAGE_TAGS = {
    "syntax": "00020010", "samples": "00280002", "photometric": "00280004", "planar": "00280006", "frames": "00280008", "rows": "00280010",
    "columns": "00280011", "bits_allocated": "00280100", "bits_stored": "00280101", "high_bit": "00280102",
}


def decodability(images: DataFrame, registry: DataFrame, frame: int = 0) -> DataFrame:
    """``images`` with syntax_name, ``decodability`` (ok, unsupported-syntax, no-pixel-data, unsupported-format, defect) and ``problem``.

    ``images``: one row a file with the columns of IMAGE_TAGS (numbers as numbers), ``has_pixels``, ``encapsulated``, ``fragments``
    and ``offsets`` (lengths of the fragment list and the offset table); ``offsets_match`` (whether the frame's entry of the table, and
    the one after it, are those of fragments in this order) and ``pixel_bytes`` (length of native pixel data) may be missing.
    ``registry``: (uid, name). The first test that fails decides."""
    c = F.col
    kind = F.create_map(*[F.lit(x) for pair in SYNTAXES.items() for x in pair])
    named = images.join(registry.select(c("uid").alias("syntax"), c("name").alias("_name")), "syntax", "left")
    named = named.withColumns({"syntax_name": F.coalesce("_name", F.lit("an unrecognised transfer syntax")), "_kind": kind[c("syntax")]}).drop("_name")
    samples, planar, frames, form = F.coalesce("samples", F.lit(1)), F.coalesce("planar", F.lit(0)), F.coalesce("frames", F.lit(1)), F.coalesce("photometric", F.lit(""))
    matched = F.coalesce("offsets_match", F.lit(True)) if "offsets_match" in images.columns else F.lit(True)
    held = c("pixel_bytes") if "pixel_bytes" in images.columns else F.lit(None).cast("bigint")
    open_frames = c("encapsulated") & (frames > 1) & ~F.when(c("offsets") > 0, (c("offsets") >= frame + 1) & matched).otherwise(c("fragments") == frames)
    needed = (frame + 1) * c("rows").cast("bigint") * c("columns") * samples * F.floor(c("bits_allocated") / 8)
    jpeg, native_like = c("_kind") == "jpeg", c("_kind") != "jpeg"
    missing = F.array_join(F.array_compact(F.array(*[F.when(c(x).isNull(), F.lit(x)) for x in ("rows", "columns", "bits_allocated", "bits_stored", "high_bit")])), ", ")
    grey, rgb = (samples == 1) & form.isin("MONOCHROME1", "MONOCHROME2"), (samples == 3) & (form == "RGB")
    tests = [
        (c("_kind").isNull(), "unsupported-syntax", "the transfer syntax is not supported"),
        (~c("has_pixels"), "no-pixel-data", "there is no pixel data"),
        ((c("_kind") != "native") != c("encapsulated"), "defect", "transfer syntax and element encoding disagree"),
        (form == "PALETTE COLOR", "unsupported-format", "palette colour"),
        (F.lit(frame) >= frames, "defect", "the frame is out of range"),
        (native_like & F.startswith(form, F.lit("YBR")), "unsupported-format", "YBR samples"),
        (native_like & rgb & (planar != 0), "unsupported-format", "colour planes"),
        (jpeg & open_frames, "unsupported-format", "frame boundaries cannot be resolved"),
        (jpeg & ~(samples.isin(1, 3) & form.isin(*JPEG_FORMS)), "defect", "samples and photometric form do not go together"),
        (jpeg & (c("rows").isNull() | c("columns").isNull()), "defect", "missing attributes"),
        (native_like & (missing != ""), "defect", "missing attributes"),
        (native_like & ~c("bits_allocated").isin(8, 16), "defect", "bits allocated are neither 8 nor 16"),
        (native_like & ~grey & ~rgb, "defect", "samples and photometric form do not go together"),
        (native_like & open_frames, "unsupported-format", "frame boundaries cannot be resolved"),
        ((c("_kind") == "native") & (held < needed), "defect", "the pixel data end before the frame does"),
    ]
    verdict, problem = F.lit("ok"), F.lit(None).cast("string")
    for test, result, words in reversed(tests):
        failed = F.coalesce(test, F.lit(False))
        verdict, problem = F.when(failed, F.lit(result)).otherwise(verdict), F.when(failed, F.lit(words)).otherwise(problem)
    return named.withColumns({"decodability": verdict, "problem": problem}).drop("_kind")


def boundary_facts(fragments: DataFrame, images: DataFrame, frame: int = 0) -> DataFrame:
    """(file, fragments, offsets, offsets_match) for ``decodability``. ``fragments``: (file, idx, offset); ``images``: (file, offset_table).

    The table's entry of the frame must be the offset of a fragment, and the entry after it that of a later fragment; the
    last entry's frame goes on to the end. Counted by file, so no list of fragments is made."""
    c = F.col
    wanted = images.select("file", F.coalesce(F.size("offset_table"), F.lit(0)).alias("offsets"), F.get("offset_table", F.lit(frame)).alias("_from"), F.get("offset_table", F.lit(frame + 1)).alias("_to"))
    met = wanted.join(fragments.select("file", "idx", "offset"), "file", "left")
    found = met.groupBy("file").agg(F.count("idx").alias("fragments"), F.first("offsets").alias("offsets"), F.first("_to").alias("_to"), F.min(F.when(c("offset") == c("_from"), c("idx"))).alias("_first"), F.max(F.when(c("offset") == c("_to"), c("idx"))).alias("_next"))
    ends = (c("offsets") == frame + 1) | F.coalesce(c("_next") > c("_first"), F.lit(False))
    return found.select("file", c("fragments").cast("int").alias("fragments"), F.greatest("offsets", F.lit(0)).alias("offsets"), F.when(c("offsets") > 0, c("_first").isNotNull() & ends).alias("offsets_match"))


def fragments_to_frames(fragments: DataFrame, images: DataFrame) -> DataFrame:
    """(file, idx, frame) of encapsulated fragments. ``fragments``: (file, idx, offset); ``images``: (file, frames, offset_table).

    One frame takes all; a table gives each frame the fragments from its offset up to the next; without one, as many
    fragments as frames are one each. Frames whose boundaries cannot be resolved get no row; where a table that does
    not rise gives a fragment to several frames, the one that starts last has it."""
    sized = fragments.join(images, "file").withColumn("_n", F.count("*").over(Window.partitionBy("file")))
    table = F.coalesce(F.col("offset_table"), F.array().cast("array<bigint>"))
    starts = images.select("file", F.posexplode("offset_table").alias("_frame", "offset"))
    starts = starts.join(fragments.select("file", "offset", "idx"), ["file", "offset"], "left").withColumn("_next", F.lead("idx").over(Window.partitionBy("file").orderBy("_frame")))
    last = F.col("_frame") == F.max("_frame").over(Window.partitionBy("file"))
    starts = starts.withColumn("_last", last).filter("idx IS NOT NULL AND (_last OR _next > idx)")
    opened = starts.groupBy("file", "idx").agg(F.max(F.struct(F.col("_frame").alias("frame"), F.when(~F.col("_last"), F.col("_next")).alias("to"))).alias("_opens"))
    # Each fragment belongs to the frame that the last fragment with an entry opened.
    along = Window.partitionBy("file").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.join(opened, ["file", "idx"], "left").withColumn("_in", F.last("_opens", ignorenulls=True).over(along))
    within = F.when((F.col("_in.to").isNull() | (F.col("idx") < F.col("_in.to"))) & (F.col("_in.frame") < F.col("frames")), F.col("_in.frame"))
    frame = F.when(F.col("frames") <= 1, F.lit(0)).when(F.size(table) > 0, within).when(F.col("_n") == F.col("frames"), F.col("idx").cast("int"))
    return placed.select("file", "idx", frame.alias("frame")).filter("frame IS NOT NULL")


def unpack_segment(segment: bytes, length: int) -> bytes:
    """PackBits: a count of literals below 128, a repeat above it, nothing at 128. A segment that ends early is an error."""
    out, at = bytearray(), 0
    while len(out) < length:
        if at >= len(segment):
            raise ValueError("a run-length segment ends before its pixels do")
        n = segment[at]
        at += 1
        if n < 128:
            piece = segment[at : at + min(n + 1, length - len(out))]
            if len(piece) < min(n + 1, length - len(out)):
                raise ValueError("a run-length segment ends before its pixels do")
            out += piece
            at += n + 1
        elif n > 128:
            if at >= len(segment):
                raise ValueError("a run-length segment ends before its pixels do")
            out += segment[at : at + 1] * min(257 - n, length - len(out))
            at += 1
    return bytes(out)


def unpack_frame(frame: bytes, pixels: int, samples: int, width: int) -> bytes:
    """Little-endian samples of a run-length frame, whose segments hold the most significant bytes first."""
    count = int.from_bytes(frame[:4], "little")
    if count != samples * width or count > 15:
        raise ValueError(f"a run-length frame has {count} segments where {samples * width} are expected")
    starts = [int.from_bytes(frame[4 + 4 * k : 8 + 4 * k], "little") for k in range(count)]
    if starts[0] != 64:
        raise ValueError("the first run-length segment does not follow the header")
    out = bytearray(pixels * count)
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(frame)], strict=True)):
        sample, byte = divmod(k, width)
        out[sample * width + width - 1 - byte :: count] = unpack_segment(frame[a:b], pixels)
    return bytes(out)


def frame_samples(frames: DataFrame) -> DataFrame:
    """(file, frame, words, error) from (file, frame, data, pixels, samples, width, packed): stored words of each frame; a frame that cannot be unpacked is a row with an error."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                words, error = None, None
                try:
                    data = unpack_frame(r.data, r.pixels, r.samples, r.width) if r.packed else r.data
                    if len(data) < r.pixels * r.samples * r.width:
                        raise ValueError("a frame has fewer bytes than pixels")
                    words = np.frombuffer(data, f"<u{r.width}", r.pixels * r.samples).astype(np.int64)
                except ValueError as e:
                    error = str(e)
                out.append((r.file, r.frame, words, error))
            yield pd.DataFrame(out, columns=["file", "frame", "words", "error"])

    return frames.mapInPandas(unpack, "file string, frame int, words array<bigint>, error string")


def render(frames: DataFrame) -> DataFrame:
    """``frames`` with ``grey`` (0..255), and the window used. Uses words, bits_stored, high_bit, signed, slope, intercept, center, width and inverted; a null center or width means the window of the frame's own range."""
    c = F.col
    values = F.transform("words", lambda w: voi.rescale(voi.stored_value(w, c("bits_stored"), c("high_bit"), c("signed")), c("slope"), c("intercept")))
    ranged = frames.withColumn("_x", values).withColumns({"_low": F.array_min("_x"), "_high": F.array_max("_x")})
    middle, spread = voi.window_of(c("_low"), c("_high"))
    declared = c("center").isNotNull() & c("width").isNotNull()
    ranged = ranged.withColumns({"used_center": F.when(declared, c("center")).otherwise(middle), "used_width": F.when(declared, c("width")).otherwise(spread)})
    return ranged.withColumn("grey", F.transform("_x", lambda x: voi.grey_level(x, c("used_center"), c("used_width"), c("inverted")))).drop("_x", "_low", "_high")
