from metaudit.sources.nested import flatten


def test_flatten(spark):
    leaf = "struct<tag: string, value: string>"
    schema = f"file string, nodes array<struct<tag: string, vr: string, value: string, items: array<array<struct<tag: string, value: string, items: array<array<{leaf}>>>>>>>"
    rows = [("f", [("1", "PN", "a", None), ("2", "SQ", None, [[("3", "b", [[("4", "c"), ("5", "d")]])], [("3", "e", None)]]), ("6", "LO", "", [])]), ("g", None)]
    got = [tuple(r) for r in flatten(spark.createDataFrame(rows, schema)).orderBy("file", "pos").select("path", "tag", "value", "depth", "item_count", "pos").collect()]
    assert got == [("1", "1", "a", 0, None, 0), ("2", "2", None, 0, 2, 1), ("2/0/3", "3", "b", 1, 1, 2), ("2/0/3/0/4", "4", "c", 2, None, 3), ("2/0/3/0/5", "5", "d", 2, None, 4), ("2/1/3", "3", "e", 1, None, 5), ("6", "6", "", 0, 0, 6)]
