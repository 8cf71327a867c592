"""Consistency checks over ordered series.

Each check gives rows, one for each file of each finding (``FINDING_FILES``), so a finding that names a
million files is a million rows. ``collapse`` makes one row a finding with arrays, for reports.

Checks of positions, orientation and modality mark the ordered files by windows of their series, so that one
exchange serves them all and no table is joined with itself; the checks of fields do the same by series and path.

``ordered`` comes from ``series.order_series``; ``findings`` from ``classify.classify``. The key of a
series is (study, series) except where a check looks across studies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import POSITION_TOLERANCE, SPACING_TOLERANCE, number
from ..sources.scratch import written
from .classify import PER_INSTANCE_TAGS
from .ranking import LAST, SUM, carried
from .series import HOT_FILES

FINDING_FILES = (
    "check_no int, kind string, scope string, study string, series string, path string, tag string, item string, "
    "file string, ordinal bigint, value string, expected_value string, expected double, actual double, n_series_files bigint"
)
KINDS = (
    "position-gap", "duplicate-position", "inconsistent-pixel-spacing", "inconsistent-orientation", "mixed-modality",
    "varying-value", "extra-field", "inconsistent-identifier", "mixed-modality",
)
#: Kinds that concern identifying fields; the others are structural.
IDENTIFYING_KINDS = ("varying-value", "extra-field")
SERIES = ("study", "series")
#: Columns of findings that have all that the checks of fields need of their file.
PLACED = (*SERIES, "ordinal", "n_files")


_FIELDS = [f.split(" ") for f in FINDING_FILES.split(", ")]
_ONE = "struct<" + ", ".join(f"{n}: {t}" for n, t in _FIELDS) + ">"


def _finding(check_no: int, kind: str, scope: str = "series", **columns: Column) -> Column:
    """A struct of the common columns of a finding row; what a check does not set is null."""
    fixed = {"check_no": F.lit(check_no), "kind": F.lit(kind), "scope": F.lit(scope)} | columns
    return F.struct(*[fixed.get(n, F.lit(None)).cast(t).alias(n) for n, t in _FIELDS])


def _rows(found: DataFrame, check_no: int, kind: str, scope: str = "series", **columns: Column) -> DataFrame:
    return found.select(_finding(check_no, kind, scope, **columns).alias("f")).select("f.*")


def _kept(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


#: A check as marks: the windows' columns in the order in which they are made, and what a row then finds, an array.
Marks = tuple[list[dict[str, Column]], Column]


def _found(rows: DataFrame, checks: Sequence[Marks]) -> DataFrame:
    found = F.flatten(F.array(*[F.coalesce(f, F.array().cast(f"array<{_ONE}>")) for _, f in checks]))
    # The series is the row's own, so rows that lie together by series still do.
    return rows.select("series", F.explode(found).alias("f")).select(*[F.col(n if n == "series" else f"f.{n}") for n, _ in _FIELDS])


def largest_series(ordered: DataFrame) -> int:
    """The number of files of the series identifier that has most, under all studies: no series has more."""
    return ordered.groupBy("series").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def _marked(ordered: DataFrame, checks: Sequence[Marks], without_windows: Callable[[DataFrame], DataFrame], hot_files: int = HOT_FILES, largest: int | None = None) -> DataFrame:
    """The finding rows of checks that mark rows, from one pass over the table.

    Series of more than ``hot_files`` files, as the column n_files tells, get the same columns by ``without_windows``. If it is known
    that the ``largest`` series has fewer, none is looked for, as that would read the whole table once more."""
    known = "n_files" in ordered.columns and (largest is None or largest > hot_files)
    hot = F.coalesce(F.col("n_files") > hot_files, F.lit(False)) if known else None
    large = None if hot is None or ordered.filter(hot).isEmpty() else without_windows(ordered.filter(hot))
    rows = ordered if large is None else ordered.filter(~hot)
    for steps, _ in checks:
        for columns in steps:
            rows = rows.withColumns(columns)
    return _found(rows, checks) if large is None else _found(rows, checks).unionByName(_found(large, checks))


def _joined_back(rows: DataFrame, made: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns that ``made`` has for their keys, which may be null."""
    other = made.select(*[F.col(k).alias(f"_j{n}") for n, k in enumerate(keys)], *[c for c in made.columns if c not in keys])
    met = F.col(keys[0]).eqNullSafe(F.col("_j0"))
    for n, k in enumerate(keys[1:], 1):
        met = met & F.col(k).eqNullSafe(F.col(f"_j{n}"))
    return rows.join(other, met, "left").drop(*[f"_j{n}" for n in range(len(keys))])


#: Consecutive files of a large series that are worked on together.
BLOCK_FILES = 1 << 17


def _placed_columns(tolerance: float, block: int = BLOCK_FILES) -> Callable[[DataFrame], DataFrame]:
    """What the marks of positions and modality need, by blocks of ordinals with carried values, and by counts."""

    def add(ordered: DataFrame) -> DataFrame:
        placed = F.col("ordered_by") == "position"
        blocks = written(ordered.withColumns({"_part": F.floor(F.col("ordinal") / block), "_at": F.col("ordinal")}), "blocks")
        rows = carried(blocks, SERIES, {"_before": (F.struct("file", "distance"), LAST)}, before=True)
        step = F.col("distance") - F.col("_before.distance")
        rows = rows.withColumns({"_previous": F.col("_before.file"), "_step": F.when(placed, step), "_near": F.coalesce(step <= tolerance, F.lit(False))}).withColumn("_bucket", F.floor(F.col("_step") / tolerance + 0.5))
        rows = written(rows.drop("_before"), "steps")
        buckets = rows.filter("_step IS NOT NULL").groupBy(*SERIES, "_bucket").agg(F.count("*").alias("n"), F.min_by("_step", "ordinal").alias("f"))
        usual = buckets.groupBy(*SERIES).agg(F.sum("n").alias("_steps"), F.min_by("f", F.struct((-F.col("n")).alias("n"), "f")).alias("_usual"))
        rows = written(carried(rows, SERIES, {"_island": (F.when(F.col("_near"), 0).otherwise(1), SUM)}), "islands")
        sizes = rows.groupBy(*SERIES, "_island").agg((F.count("*") > 1).alias("_several")).filter("_several")
        kinds = rows.groupBy(*SERIES).agg(F.min("modality").alias("_low"), F.max("modality").alias("_high"))
        return _joined_back(_joined_back(_joined_back(rows, usual, SERIES), sizes, [*SERIES, "_island"]), kinds, SERIES)

    return add


def _field_columns(exempt: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """What the marks of fields need, by counts."""

    def add(joined: DataFrame) -> DataFrame:
        path = [*SERIES, "path"]
        rows = written(joined.withColumn("_v", _compared_value(exempt)), "fields")
        values = rows.groupBy(*path, "_v").agg(F.count("*").alias("n"))
        known = F.when(F.col("_v").isNotNull(), F.col("n"))
        about = values.groupBy(*path).agg(F.sum("n").alias("_n"), F.coalesce(F.sum(known), F.lit(0)).alias("_all"), F.min_by("_v", F.when(F.col("_v").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("_v").alias("v")))).alias("_usual_value"))
        return _joined_back(rows, about, path)

    return add


def _gap_marks(tolerance: float) -> Marks:
    group, along = Window.partitionBy(*SERIES), Window.partitionBy(*SERIES).orderBy("ordinal")
    bucket = Window.partitionBy(*SERIES, "_bucket")
    placed = F.col("ordered_by") == "position"
    steps = [
        {"_previous": F.lag("file").over(along), "_step": F.when(placed, F.col("distance") - F.lag("distance").over(along))},
        {"_bucket": F.floor(F.col("_step") / tolerance + 0.5)},
        {"_n": F.count("_step").over(bucket), "_first": F.min_by("_step", F.when(F.col("_step").isNotNull(), F.col("ordinal"))).over(bucket)},
        {"_steps": F.count("_step").over(group), "_usual": F.min_by("_first", F.when(F.col("_step").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("f")))).over(group)},
    ]
    pair = [_finding(1, KINDS[0], **_kept(*SERIES), expected=F.col("_usual"), actual=F.col("_step"), item=F.col("ordinal"), file=F.col(f), ordinal=at) for f, at in (("_previous", F.col("ordinal") - 1), ("file", F.col("ordinal")))]
    return steps, F.when((F.col("_steps") >= 2) & (F.abs(F.col("_step") - F.col("_usual")) > tolerance), F.array(*pair))


def _duplicate_marks(tolerance: float) -> Marks:
    along = Window.partitionBy(*SERIES).orderBy("ordinal")
    placed = F.col("ordered_by") == "position"
    steps = [
        {"_near": F.coalesce(F.col("distance") - F.lag("distance").over(along) <= tolerance, F.lit(False))},
        {
            "_island": F.sum(F.when(F.col("_near"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)),
            "_several": F.col("_near") | F.coalesce(F.lead("_near").over(along), F.lit(False)),
        },
    ]
    return steps, F.when(placed & F.col("_several"), F.array(_finding(2, KINDS[1], **_kept(*SERIES, "file", "ordinal"), item=F.col("_island"))))


def _orientation_marks() -> Marks:
    return [], F.when(~F.col("orientation_consistent"), F.array(_finding(4, KINDS[3], **_kept(*SERIES, "file", "ordinal"))))


def _modality_marks() -> Marks:
    group = Window.partitionBy(*SERIES)
    steps = [{"_low": F.min("modality").over(group), "_high": F.max("modality").over(group)}]
    return steps, F.when(F.col("modality").isNotNull() & (F.col("_low") != F.col("_high")), F.array(_finding(5, KINDS[4], **_kept(*SERIES, "file", "ordinal"), value=F.col("modality"))))


def position_gaps(ordered: DataFrame, tolerance: float = POSITION_TOLERANCE) -> DataFrame:
    """Steps between consecutive positions that differ from the series' most frequent step, for series of three files or more.

    The most frequent step is that of the largest bucket of hundredths; its first value stands for it, the smaller of equally frequent ones."""
    return _marked(ordered, [_gap_marks(tolerance)], _placed_columns(tolerance))


def duplicate_positions(ordered: DataFrame, tolerance: float = POSITION_TOLERANCE) -> DataFrame:
    """Runs of two or more files whose consecutive positions lie within the tolerance; runs may chain."""
    return _marked(ordered, [_duplicate_marks(tolerance)], _placed_columns(tolerance))


def _leads(tolerance: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Distinct spacings (study, series, row, col, first, n) of a series in order of first use, with the spacing that leads each one's group.

    Leads lie in a grid with cells as wide as the tolerance, so a spacing meets those of nine cells."""
    cell = tolerance * (1 + 1e-9)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, grid = None, {}
        for batch in batches:
            out = []
            for study, series, run, row, col, first in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if (study, series, run) != now:
                    now, grid = (study, series, run), {}
                x, y = int(row // cell), int(col // cell)
                near = [g for dx in (-1, 0, 1) for dy in (-1, 0, 1) for g in grid.get((x + dx, y + dy), ()) if abs(g[1] - row) <= tolerance and abs(g[2] - col) <= tolerance]
                lead = min(near, default=None)
                if lead is None:
                    lead = (first, row, col)
                    grid.setdefault((x, y), []).append(lead)
                out.append(lead)
            made = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 3, 4, 6)), *made], ["study", "series", "row", "col", "n", "lead", "lead_row", "lead_col"])

    return fold


#: Distinct spacings of a series up to which they are compared as one array.
FEW_SPACINGS = 64


def _few_spacings(have: DataFrame, kinds: DataFrame, tolerance: float) -> DataFrame:
    """The files with ``own``, the lead of their group, and ``most``, that of the largest group, of series with few distinct spacings: folded as arrays."""

    def close(a: Column, b: Column) -> Column:
        return (F.abs(a["row"] - b["row"]) <= tolerance) & (F.abs(a["col"] - b["col"]) <= tolerance)

    one = F.struct("first", "row", "col", "n")
    lists = kinds.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.when(F.col("read"), one))).alias("all"), F.min(F.when(~F.col("read"), _lone())).alias("lone"))
    leads = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda g: close(g, x)), acc).otherwise(F.concat(acc, F.array(x))))
    own = F.transform("all", lambda x: F.struct(F.get(F.filter("leads", lambda g: close(g, x)), F.lit(0))["first"].alias("lead"), x["n"].alias("n")))
    counted = F.transform("leads", lambda g: F.struct((-F.aggregate(F.filter("own", lambda o: o["lead"] == g["first"]), F.lit(0).cast("bigint"), lambda a, o: a + o["n"])).alias("n"), g["row"].alias("row"), g["col"].alias("col"), g["first"].alias("first")))
    led = lists.withColumn("leads", leads).withColumn("own", own).select(*SERIES, "leads", F.least(F.array_min(counted), F.col("lone")).alias("most"))
    mine = F.get(F.filter("leads", lambda g: close(g, F.struct("row", "col"))), F.lit(0))
    return have.join(led, [*SERIES]).select(*SERIES, "file", "ordinal", "most", F.when(F.col("read"), F.struct(mine["first"].alias("first"), mine["row"].alias("row"), mine["col"].alias("col"))).otherwise(_itself()).alias("own"))


def _lone() -> Column:
    """A file without a readable spacing is a group of one file: it matters for the majority only where no group has two."""
    return F.struct(F.lit(-1).cast("bigint").alias("n"), "row", "col", "first")


def _itself() -> Column:
    return F.struct(F.col("ordinal").cast("bigint").alias("first"), "row", "col")


def _many_spacings(have: DataFrame, kinds: DataFrame, tolerance: float) -> DataFrame:
    """The same for series with many distinct spacings: only those that may be near others are folded, by a grid, each cluster of such apart from the rest."""

    def new_run(c: str, *keys: str) -> Column:
        return F.when(F.col(c) - F.lag(c).over(Window.partitionBy(*SERIES, *keys).orderBy(c)) <= tolerance, 0).otherwise(1)

    def run(c: str, *keys: str) -> Column:
        return F.sum("_new").over(Window.partitionBy(*SERIES, *keys).orderBy(c).rowsBetween(Window.unboundedPreceding, 0))

    near = kinds.filter("read").withColumn("_new", new_run("row")).withColumn("_run", run("row")).withColumn("_new", new_run("col", "_run")).withColumn("_col_run", run("col", "_run"))
    near = near.withColumn("_near", F.count("*").over(Window.partitionBy(*SERIES, "_run", "_col_run")))
    alone = near.filter("_near = 1").select(*SERIES, "row", "col", "n", F.col("first").alias("lead"), F.col("row").alias("lead_row"), F.col("col").alias("lead_col"))
    several = near.filter("_near > 1").repartition(*SERIES, "_run", "_col_run").sortWithinPartitions(*SERIES, "_run", "_col_run", "first")
    several = several.select(*SERIES, F.struct("_run", "_col_run").alias("run"), "row", "col", "first", "n")
    led = alone.unionByName(several.mapInArrow(_leads(tolerance), "study string, series string, row double, col double, n long, lead long, lead_row double, lead_col double"))
    groups = led.groupBy(*SERIES, "lead", "lead_row", "lead_col").agg((-F.sum("n")).alias("n"))
    groups = groups.select(*SERIES, F.struct("n", F.col("lead_row").alias("row"), F.col("lead_col").alias("col"), F.col("lead").alias("first")).alias("g")).unionByName(kinds.filter("NOT read").select(*SERIES, _lone().alias("g")))
    most = groups.groupBy(*SERIES).agg(F.min("g").alias("most"))
    mine = have.join(most, [*SERIES]).join(led.drop("n"), [*SERIES, "row", "col"], "left")
    lead = F.struct(F.col("lead").alias("first"), F.col("lead_row").alias("row"), F.col("lead_col").alias("col"))
    return mine.select(*SERIES, "file", "ordinal", "most", F.when(F.col("read"), lead).otherwise(_itself()).alias("own"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _small_series(have: DataFrame, tolerance: float) -> DataFrame:
    """The outliers, with ``own`` and ``most``, of series of few files: each series is a row, and no table meets another."""

    def close(a: Column, b: Column) -> Column:
        return (F.abs(a["row"] - b["row"]) <= tolerance) & (F.abs(a["col"] - b["col"]) <= tolerance)

    def spacing(x: Column) -> Column:
        return F.struct(x["first"].alias("first"), x["row"].alias("row"), x["col"].alias("col"))

    def leads(files: Column) -> Column:
        fold = lambda acc, x: F.when(~x["read"] | F.exists(acc, lambda g: close(g, x)), acc).otherwise(F.concat(acc, F.array(spacing(x))))
        return F.aggregate(files, F.array().cast("array<struct<first: bigint, row: double, col: double>>"), fold)

    def owned(files: Column, leads: Column) -> Column:
        own = lambda x: F.when(x["read"], F.get(F.filter(leads, lambda g: close(g, x)), F.lit(0))).otherwise(spacing(x))
        return F.transform(files, lambda x: F.struct(x["file"].alias("file"), x["ordinal"].alias("ordinal"), x["read"].alias("read"), own(x).alias("own")))

    def most(leads: Column, owned: Column) -> Column:
        group = lambda n, g: F.struct(n.alias("n"), g["row"].alias("row"), g["col"].alias("col"), g["first"].alias("first"))
        counted = F.transform(leads, lambda g: group(-F.size(F.filter(owned, lambda o: o["read"] & (o["own"]["first"] == g["first"]))), g))
        return F.array_min(F.concat(counted, F.transform(F.filter(owned, lambda o: ~o["read"]), lambda o: group(F.lit(-1), o["own"]))))

    def outliers(owned: Column, most: Column) -> Column:
        return F.transform(F.filter(owned, lambda o: o["own"]["first"] != most["first"]), lambda o: F.struct(o["file"].alias("file"), o["ordinal"].alias("ordinal"), most.alias("most"), o["own"].alias("own")))

    one = F.struct(F.col("ordinal").cast("bigint").alias("first"), "row", "col", "read", "file", "ordinal")
    series = have.groupBy(*SERIES).agg(F.collect_list(one).alias("_files"))
    found = let(F.sort_array("_files"), lambda files: let(leads(files), lambda g: let(owned(files, g), lambda o: let(most(g, o), lambda m: outliers(o, m)))))
    return series.select(*SERIES, F.explode(found).alias("f")).select(*SERIES, "f.*")


def spacing_outliers(ordered: DataFrame, tolerance: float = SPACING_TOLERANCE, few: int = FEW_SPACINGS, largest: int | None = None) -> DataFrame:
    """Files whose pixel spacing is not that of most files of the series.

    Distinct spacings come in order of first use, each joining the first group whose first spacing agrees; equal
    spacings always share a group. A spacing that is not two numbers agrees with none and is a group of its own for each
    file. Series of at most ``few`` files are a row each; in others spacings are counted before they are compared, and only those
    of series that have several are."""
    largest = largest_series(ordered) if largest is None else largest
    pair = F.transform(F.slice(F.split("spacing", r"\\"), 1, 2), number)
    row, col = F.get("_pair", F.lit(0)), F.get("_pair", F.lit(1))

    def parsed(files: DataFrame) -> DataFrame:
        have = files.filter("spacing IS NOT NULL").select(*SERIES, "file", "ordinal", pair.alias("_pair")).select(*SERIES, "file", "ordinal", row.alias("row"), F.when(row.isNotNull(), col).alias("col"))
        return have.withColumn("read", F.col("row").isNotNull() & F.col("col").isNotNull())

    if largest <= few:
        told = _small_series(parsed(ordered), tolerance)
    else:
        sized = ordered if "n_files" in ordered.columns else ordered.withColumn("n_files", F.count("*").over(Window.partitionBy(*SERIES)))
        have = parsed(sized.filter(F.col("n_files") > few))
        kinds = have.groupBy(*SERIES, "row", "col", "read").agg(F.min("ordinal").cast("bigint").alias("first"), F.count("*").alias("n"))
        kinds = kinds.withColumn("_kinds", F.count("*").over(Window.partitionBy(*SERIES))).filter("_kinds > 1 OR NOT read")
        told = _few_spacings(have, kinds.filter(F.col("_kinds") <= few), tolerance).unionByName(_many_spacings(have, kinds.filter(F.col("_kinds") > few), tolerance))
        told = told.unionByName(_small_series(parsed(sized.filter(F.col("n_files") <= few)), tolerance))
    text = lambda s: F.concat_ws("\\", f"{s}.row", f"{s}.col")
    return _rows(told.filter(F.col("own.first") != F.col("most.first")), 3, KINDS[2], **_kept(*SERIES, "file", "ordinal"), value=text("own"), expected_value=text("most"), item=F.col("own.first"))


def orientation_mix(ordered: DataFrame) -> DataFrame:
    """All files of series whose orientations do not agree."""
    return _found(ordered, [_orientation_marks()])


def mixed_modality_series(ordered: DataFrame) -> DataFrame:
    """The files with a modality of series that have two or more."""
    return _marked(ordered, [_modality_marks()], _placed_columns(POSITION_TOLERANCE))


def mixed_modality_folder(files: DataFrame) -> DataFrame:
    """The files with a modality of a folder that has two or more; ungrouped files count. The bounds are one row."""
    have = files.filter("modality IS NOT NULL")
    bounds = have.agg(F.min("modality").alias("_low"), F.max("modality").alias("_high")).filter("_low <> _high")
    return _rows(have.crossJoin(F.broadcast(bounds)), 9, KINDS[8], "folder", file=F.col("file"), value=F.col("modality"))


def _shared_marks() -> Marks:
    alike = Window.partitionBy("series")
    steps = [{"_first_study": F.min("study").over(alike), "_last_study": F.max("study").over(alike)}]
    return steps, F.when(F.col("_first_study") != F.col("_last_study"), F.array(_finding(8, KINDS[7], **_kept("series", "file", "ordinal"), value=F.col("study"))))


def shared_series(ordered: DataFrame) -> DataFrame:
    """The files of series identifiers that occur under more than one study."""
    shared = ordered.select(*SERIES).groupBy("series").agg((F.min("study") != F.max("study")).alias("_shared")).filter("_shared").select("series")
    return _rows(ordered.join(shared, "series", "left_semi"), 8, KINDS[7], **_kept("series", "file", "ordinal"), value=F.col("study"))


def _field_checks(ordered: DataFrame, findings: DataFrame, marks: Sequence[Marks], exempt: Sequence[str], largest: int | None = None) -> DataFrame:
    """Checks of the findings' fields within series, from one pass over the findings.

    Findings that have their file's study and series (``series.keyed``) get the size of their series, a small table, so one
    exchange serves the windows, and only what is found meets the files for its ordinal. Those that are ``PLACED`` meet no table at
    all. Others are joined by file first."""
    field = ["path", "tag", "kind", "value"]
    largest = largest_series(ordered) if largest is None else largest
    if {*PLACED} <= {*findings.columns}:
        return _marked(findings.select(*PLACED, "file", *field), marks, _field_columns(exempt), largest=largest)
    if not {*SERIES} <= {*findings.columns}:
        sized = ordered if "n_files" in ordered.columns else ordered.withColumn("n_files", F.count("*").over(Window.partitionBy(*SERIES)))
        return _marked(findings.select("file", *field).join(sized.select(*SERIES, "file", "ordinal", "n_files"), "file"), marks, _field_columns(exempt), largest=largest)
    sizes = ordered.groupBy(*SERIES).agg(F.count("*").alias("n_files"))
    joined = findings.select(*SERIES, "file", *field).join(sizes, [*SERIES]).withColumn("ordinal", F.lit(None).cast("bigint"))
    found = _marked(joined, marks, _field_columns(exempt), largest=largest)
    return found.drop("ordinal").join(ordered.select(*SERIES, "file", "ordinal"), [*SERIES, "file"]).select(*[F.col(n).cast(t).alias(n) for n, t in _FIELDS])


def _extra_marks() -> Marks:
    steps = [{"_n": F.count("*").over(Window.partitionBy(*SERIES, "path"))}]
    return steps, F.when((F.col("n_files") >= 2) & (F.col("_n") < F.col("n_files")), F.array(_finding(7, KINDS[6], **_kept(*SERIES, "path", "tag", "file", "ordinal"), item=F.col("path"), n_series_files=F.col("n_files"))))


def _compared_value(exempt: Sequence[str]) -> Column:
    compared = (F.col("n_files") >= 2) & (F.col("kind") == "annex-e") & ~F.col("tag").isin(*exempt)
    return F.when(compared, F.coalesce("value", F.lit("")))


def _varying_marks(exempt: Sequence[str]) -> Marks:
    group = Window.partitionBy(*SERIES, "path")
    steps = [
        {"_v": _compared_value(exempt)},
        {"_same": F.count("_v").over(Window.partitionBy(*SERIES, "path", "_v"))},
        {"_all": F.count("_v").over(group), "_usual_value": F.min_by("_v", F.when(F.col("_v").isNotNull(), F.struct((-F.col("_same")).alias("n"), F.col("_v").alias("v")))).over(group)},
    ]
    found = _finding(6, KINDS[5], **_kept(*SERIES, "path", "tag", "file", "ordinal"), value=F.col("_v"), expected_value=F.col("_usual_value"), item=F.col("path"))
    return steps, F.when((F.col("_all") == F.col("n_files")) & (F.col("_v") != F.col("_usual_value")), F.array(found))


def extra_fields(ordered: DataFrame, findings: DataFrame) -> DataFrame:
    """The files that have a finding's path which some but not all files of their series have."""
    return _field_checks(ordered, findings, [_extra_marks()], PER_INSTANCE_TAGS)


def varying_values(ordered: DataFrame, findings: DataFrame, exempt: Sequence[str] = PER_INSTANCE_TAGS) -> DataFrame:
    """Of paths that every file of a series has, with different values: the files without the most frequent value. Null counts as empty."""
    return _field_checks(ordered, findings, [_varying_marks(exempt)], exempt)


def check_series(files: DataFrame, ordered: DataFrame, findings: DataFrame, exempt: Sequence[str] = PER_INSTANCE_TAGS) -> DataFrame:
    """All checks. ``files`` are all files read, grouped or not. Several checks read ``ordered``: give a stored table, or one that lies by series."""
    return series_checks(ordered, findings, exempt).unionByName(mixed_modality_folder(files))


def series_checks(ordered: DataFrame, findings: DataFrame, exempt: Sequence[str] = PER_INSTANCE_TAGS) -> DataFrame:
    """All checks but that of the whole folder. If the inputs lie by series, so do the rows."""
    largest = largest_series(ordered)
    marks = [_duplicate_marks(POSITION_TOLERANCE), _gap_marks(POSITION_TOLERANCE), _orientation_marks(), _modality_marks()]
    # Identifiers of very many files are compared by counts.
    shared = [shared_series(ordered)] if largest > HOT_FILES else []
    marks += [] if shared else [_shared_marks()]
    every = _marked(ordered, marks, _placed_columns(POSITION_TOLERANCE), largest=largest)
    for p in (spacing_outliers(ordered, largest=largest), _field_checks(ordered, findings, [_varying_marks(exempt), _extra_marks()], exempt, largest), *shared):
        every = every.unionByName(p)
    return every


#: What tells findings apart, and their order in a report.
FINDING_KEY = ("check_no", "kind", "scope", "study", "series", "path", "tag", "item")


def collapse(rows: DataFrame) -> DataFrame:
    """One row a finding: ``files`` in series order, and ``values`` by file. For reports: a finding's files must fit in a row."""
    one = F.struct("ordinal", "file", "value")
    found = rows.groupBy(*FINDING_KEY).agg(F.array_sort(F.collect_list(one)).alias("_f"), F.first("expected_value").alias("expected_value"), F.first("expected").alias("expected"), F.first("actual").alias("actual"))
    return found.withColumns({"files": F.transform("_f", lambda f: f["file"]), "values": F.map_from_entries(F.transform(F.filter("_f", lambda f: f["value"].isNotNull()), lambda f: F.struct(f["file"], f["value"])))}).drop("_f")


def diff_findings(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """The rows of either table that the other lacks, repeats counted, with ``side`` (missing or extra)."""
    columns = expected.columns
    missing = expected.exceptAll(actual.select(*columns)).withColumn("side", F.lit("missing"))
    return missing.unionByName(actual.select(*columns).exceptAll(expected).withColumn("side", F.lit("extra")))
