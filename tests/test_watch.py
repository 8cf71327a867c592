import pytest
from pyspark.sql import functions as F

from metaudit.operators import checks, classify, series
from metaudit.sources.folder import read_folder
from metaudit.sources.scan import attributes
from metaudit.streaming import store, watch
from tests import study


@pytest.fixture(scope="module")
def profile(spark):
    return spark.createDataFrame(study.PROFILE, "tag string, action string"), spark.createDataFrame([(0, "60xx3000", "X")], "ordinal int, mask string, action string")


def whole(spark, root, profile):
    """The checks of one audit of all files."""
    rows = attributes(read_folder(spark, str(root))).cache()
    files = series.instances(rows)
    return checks.check_series(files, series.order_series(files), classify.classify(rows, *profile))


def same(a, b):
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(a) == rows(b)


def test_batches_equal_one_audit(spark, profile, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    root.mkdir()
    keys = [*study.ORDER, study.LOOSE]
    # The series R has files of two studies, which come apart: three of the first, then one of the other.
    late = [k for k in keys if k == ("R", 4)] + [k for k in keys if k[0] == "P"][:3]
    batches = [[k for k in keys if k not in late and k[0] != "Q"], late, [k for k in keys if k[0] == "Q"]]
    name = {k: f"IM_{n}" for n, k in enumerate(keys)}
    for n, batch in enumerate(batches):
        for key in batch:
            (root / name[key]).write_bytes(study.file_bytes(*key))
        watch.watch_folder(spark, str(root), str(out), *profile, parts=4, compact_every=3).awaitTermination()
        got = watch.latest_checks(spark, str(out), 4)
        same(got, whole(spark, root, profile))
        if n == 1:
            assert {r["value"] for r in got.filter("kind = 'inconsistent-identifier'").collect()} == {"2.2", "2.3"}
    assert {r["check_no"] for r in got.select("check_no").distinct().collect()} == set(range(1, 10))
    assert spark.read.parquet(f"{out}/outcomes").count() == len(keys)
    tables = watch.Watched(spark, str(out), 4)
    # The third batch has compacted the tables; what remains is one folder a part.
    tables.compact(1)
    assert all(len(own) == 1 for t in (tables.instances, tables.findings, tables.checks) for own in t._folders(None).values())
    same(tables.latest(), whole(spark, root, profile))


def test_a_batch_reads_the_parts_it_touches(spark, profile, tmp_path, monkeypatch):
    tables = watch.Watched(spark, str(tmp_path), 64)
    rows = lambda n: spark.createDataFrame([(f"f{n}-{k}", t, t, "LO", v, None, 0, 0) for k in range(3) for t, v in (("0020000d", "1"), ("0020000e", f"s{n}"), ("00100010", f"x{k}"))], "file string, path string, tag string, vr string, value string, length bigint, depth int, pos int")
    read = []
    monkeypatch.setattr(store.KeyedStore, "get", lambda self, schema, parts=None, f=store.KeyedStore.get: read.append(parts) or f(self, schema, parts))
    for n in range(6):
        read.clear()
        tables.add(rows(n), n, *profile)
        assert read and all(len(p) == 1 for p in read)
        files = tables.instances.get(watch.INSTANCES, read[0]).inputFiles()
        assert len(files) <= 2  # those of one series, or two that share a part
    assert tables.latest().filter("kind = 'varying-value'").count() == 12


def test_a_batch_that_is_run_again(spark, profile, tmp_path):
    """The same batch twice, and after a failure between its tables."""
    root, out = tmp_path / "in", tmp_path / "out"
    root.mkdir()
    for k, key in enumerate(study.ORDER[:9]):
        (root / f"IM_{k}").write_bytes(study.file_bytes(*key))

    def fails(rows, batch):
        raise RuntimeError("planned")

    with pytest.raises(Exception, match="planned"):
        watch.watch_folder(spark, str(root), str(out), *profile, after=fails, parts=4).awaitTermination()
    (root / "IM_99").write_bytes(study.file_bytes(*study.ORDER[9]))  # a new file is a batch of its own
    (root / "IM_0").unlink()  # what was read before is not read again
    seen = []
    for _ in range(2):  # a run that makes up for a failed batch ends with it
        watch.watch_folder(spark, str(root), str(out), *profile, after=lambda rows, n: seen.append((n, rows.select("file").distinct().count())), parts=4).awaitTermination()
    assert seen == [(0, 9), (1, 1)]
    assert spark.read.parquet(f"{out}/outcomes").filter("outcome = 'read'").count() == 10
    (root / "IM_0").write_bytes(study.file_bytes(*study.ORDER[0]))
    same(watch.latest_checks(spark, str(out), 4), whole(spark, root, profile))


def test_store_keeps_schema_and_order_of_batches(spark, tmp_path):
    kept = store.KeyedStore(spark, str(tmp_path / "t"), 4)
    rows = lambda v: spark.range(20).select(F.col("id").cast("string").alias("series"), F.lit(v).alias("v"))
    for n in range(5):
        kept.put(rows(n), n, F.col("series"))
    kept.put(rows(40), 4, F.col("series"))  # replaces the batch
    schema = "series string, v int"
    assert kept.get(schema).groupBy("v").count().count() == 5 and kept.get(schema).count() == 100
    assert kept.compact(schema, 2, watch._last, F.col("series")) == 4 and {r["v"] for r in kept.get(schema).collect()} == {40}
    kept.put(rows(7), 5, F.col("series"))
    assert kept.get(schema).count() == 40 and kept.compact(schema, 2, key=F.col("series")) == 0
    assert kept.get(schema, [0, 1]).count() < 40
