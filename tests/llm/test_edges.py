"""Odd columns, empty tables, repeated rows and very long rows for all operators."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from metaudit.llm import chat_format, common, decontaminate, exact_dedup, language_model, mixing, near_dedup, odd_sketch, pii, quality, toxicity, url_filter
from tests.llm.test_native import ITEM, ODD, TURNS, WANT, decisions, table

CLASHING = ("_metadata", "a.b", "b`c", "at", "row", "uid", "fp", "key", "size", "source_size", "target", "octave", "copies", "base", "added", "y", "h", "text_hash", "toxicity", "held", "item_id", "digest", "sid", "root")


def clashing(docs):
    return docs.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING if c not in docs.columns])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    rows = [(k, f"w{k} w{k + 1} w{k + 2} mail u{k}@d.org " + " ".join(f"x{k * 31 + j}" for j in range(12)), f"s{k % 2}") for k in range(40)]
    rows += [(3, rows[3][1], "s1"), (3, rows[3][1], "s1"), (None, None, None), (50, "", "s0"), (51, ITEM, "s0"), (52, "vile " * 3, "s1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    clashing(docs).write.parquet(f"{where}/documents.parquet")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), int(k > 45)) for k in range(60)] + [(None, 1, 1), (1, None, None)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{where}/labels.parquet")
    bench = spark.createDataFrame([(1, ITEM), (2, None)], "item_id bigint, text string")
    bench.write.parquet(f"{where}/benchmark.parquet")
    return where, spark.read.parquet(f"{where}/documents.parquet"), labels, bench


def operators(labels, bench):
    return {
        "toxicity": lambda d: toxicity.score_toxicity(d, labels, ["doc_id"]),
        "drop_toxic": lambda d: toxicity.drop_toxic(d, labels),
        "simhash": near_dedup.find_groups,
        "near_groups": near_dedup.near_groups,
        "drop_near_copies": near_dedup.drop_near_copies,
        "pii": pii.find_personal_data,
        "language_model": language_model.score_texts,
        "quality": lambda d: quality.score_quality(d, labels, ["doc_id"]),
        "quality, all columns": lambda d: quality.score_quality(d, labels),
        "mixing": mixing.plan_copies,
        "mix_sources": mixing.mix_sources,
        "exact": exact_dedup.find_copies,
        "drop_copies": exact_dedup.drop_copies,
        "leaks": lambda d: decontaminate.find_leaks(d, bench),
        "drop_leaks": lambda d: decontaminate.drop_leaks(d, bench),
        "odd sketches": odd_sketch.near_groups,
        "drop_near_copies by odd sketches": odd_sketch.drop_near_copies,
        "urls": lambda d: url_filter.judge(d.withColumn("page_id", F.col("doc_id")).withColumn("url", F.concat(F.lit("https://a.org/"), "text"))),
        "chats": lambda d: chat_format.expand(d.select("*", F.col("doc_id").alias("conv_id"), F.lit("assistant").alias("role"), F.lit(1).alias("turn"))),
    }


@pytest.mark.parametrize("name", list(operators(None, None)))
def test_clashing_names_and_empty_tables(tables, name):
    _, docs, labels, bench = tables
    run = operators(labels, bench)[name]
    found = run(docs)
    got = found.count()
    assert got == {"drop_toxic": got, "drop_near_copies": 43, "drop_copies": 43, "mix_sources": got, "leaks": 1, "drop_leaks": 45, "drop_near_copies by odd sketches": got}.get(name, 46)
    if name.startswith(("drop", "mix_")):
        assert found.columns == docs.columns
        assert all(r["a.b"] == "extra a.b" and r["_metadata"] == "extra _metadata" for r in found.collect())
    assert run(docs.limit(0)).count() == 0


def test_pipeline_with_clashing_names_and_empty(spark, tables, tmp_path):
    where, docs, _, _ = tables
    before = common.stored(spark)
    out = corpus_pipeline.run(spark, str(where))
    assert out.columns == docs.columns and {r["a.b"] for r in out.collect()} == {"extra a.b"}
    left = [p for p in common.stored(spark) - before if p.endswith(("-toxicity", "-arrivals", "-sketches"))]
    assert not [p for p in left if p.endswith(("-toxicity", "-sketches"))]  # what earlier stages wrote is gone
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{where}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_large_sets_of_keys(spark, tmp_path, monkeypatch):
    """The same results where keys are too many to be sent to every task."""
    monkeypatch.setattr(common, "SMALL_ROWS", 0)
    docs = table(spark, tmp_path, ODD)
    assert decisions(exact_dedup.find_copies(docs)) == WANT
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(docs).collect()) == [1, 2, 3, 7, 8]
    rows, keys = spark.range(5000).withColumnRenamed("id", "at"), spark.range(0, 5000, 7).withColumnRenamed("id", "at").withColumn("v", F.lit(1))
    assert common.among(rows, keys).count() == keys.count() and common.without(rows, keys.select("at")).count() == 5000 - keys.count()


def test_exploded_rows_are_rows_of_their_own(spark, tmp_path):
    """A frame whose rows share a row of a file is written before rows are told apart."""
    docs = table(spark, tmp_path, [(1, "a", "s", 0), (2, "b", "s", 0)]).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(docs).collect()) == [1, 2]


def test_state_is_kept_for_later_calls(spark, tmp_path):
    check = "file://" + str(tmp_path / "state")
    first = table(spark, tmp_path, [(5, "x y", None, 0), (8, "z", None, 0)], name="one")
    again = table(spark, tmp_path, [(4, "x  y", None, 0), (9, "z", None, 0), (7, "new", None, 0)], name="two")
    assert [tuple(r)[3:] for r in exact_dedup.find_copies(first, checkpoint=check).orderBy("doc_id").collect()] == [(5, 1, True), (8, 1, True)]
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.find_copies(again, checkpoint=check).orderBy("doc_id").collect()]
    assert got == [(4, 4, 2, True), (7, 7, 1, True), (9, 8, 2, False)]
    # With a digest of one value the texts of earlier calls are read again and compared.
    weak = lambda text: F.substring(exact_dedup.sha256_digest(text), 1, 0)
    check += "-weak"
    exact_dedup.find_copies(first.limit(1), digest=weak, checkpoint=check).count()
    got = [(r["doc_id"], r["kept"]) for r in exact_dedup.find_copies(again, digest=weak, checkpoint=check).orderBy("doc_id").collect()]
    assert got == [(4, True), (7, True), (9, True)]


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_call_that_fails_is_repeated(spark, tmp_path, monkeypatch, when):
    """No row counts twice where a call died before or after its rows went into the state."""
    check = "file://" + str(tmp_path / "state")
    exact_dedup.find_copies(table(spark, tmp_path, [(20, "old", None, 0)], name="zero"), checkpoint=check).count()
    plain = table(spark, tmp_path, [(k, f"t{k}", None, 0) for k in range(5)] + [(9, "old", None, 0)], name="one")
    docs = plain.union(plain.limit(0)).repartition(2)  # no plain read of files: it is written anew for each call
    run = exact_dedup.track_digests

    def dies(*args, **named):
        if when == "after":
            run(*args, **named)
        raise RuntimeError("planned")

    monkeypatch.setattr(exact_dedup, "track_digests", dies)
    with pytest.raises(RuntimeError, match="planned"):
        exact_dedup.find_copies(docs, checkpoint=check)
    monkeypatch.setattr(exact_dedup, "track_digests", run)
    for _ in range(2):
        got = sorted((r["doc_id"], r["group_size"], r["kept"]) for r in exact_dedup.find_copies(docs, checkpoint=check).collect())
        assert got == [*((k, 1, True) for k in range(5)), (9, 2, True)]
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(docs, checkpoint=check).collect()) == [0, 1, 2, 3, 4, 9]
    again = {r["doc_id"]: r["group_size"] for r in exact_dedup.find_copies(docs, checkpoint=check, batch="once more").collect()}
    assert again[0] == 2 and again[9] == 3


def test_kept_state_needs_no_other_table(spark, tmp_path):
    """What a call has written besides may go, and so may the files that it read."""
    check = "file://" + str(tmp_path / "state")
    weak = lambda text: F.substring(exact_dedup.sha256_digest(text), 1, 0)
    before = common.stored(spark)
    first = table(spark, tmp_path, [(5, "x y", None, 0), (8, "x y", None, 0)], name="one").union(table(spark, tmp_path, [(6, "x y", None, 0)], name="two"))
    exact_dedup.find_copies(first, digest=weak, checkpoint=check).count()
    common.drop_stored(spark, before)
    for f in first.inputFiles():
        common.drop_path(spark, f)
    got = exact_dedup.find_copies(table(spark, tmp_path, [(4, "new", None, 0), (9, "x y", None, 0)], name="three"), digest=weak, checkpoint=check).collect()
    assert sorted((r["doc_id"], r["kept"]) for r in got) == [(4, True), (9, False)]


def test_copies_of_one_row_are_dealt_out(spark, tmp_path):
    """A row that repeats more often than a block is large, and null ids."""
    rows = [(None, "w w w", "s", 0)] * 500 + [(1, "w w w", "s", 0)] * 500 + [(k, "w " * (k % 9), "t", 0) for k in range(2000)]
    got = mixing.plan_copies(table(spark, tmp_path, rows), block_rows=50)
    taken = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).collect()}
    target = {r["source"]: r["target"] for r in got.select("source", "target").distinct().collect()}
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 10 for s in target)


def test_long_texts_take_no_square(spark):
    began = time.time()
    texts = ["1" * 1_000_000 + " 1.2.3.4", ", ".join(f"u{k}@b{k % 7}.co" for k in range(100_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.sanitise(docs).select("doc_id", F.size("spans").alias("n"), F.substring("text", -20, 20).alias("end"), F.length("text").alias("length")).collect()}
    assert got[0]["end"].endswith("1 [IP]") and got[1]["n"] >= 100_000 and got[1]["length"] == 9 * 100_000 - 2
    turns = spark.range(50_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("é hi").alias("text"))
    one = chat_format.frame(turns).select(F.size("turns").alias("n"), F.col("turns")[49_999]["stop"].alias("stop"), F.length("framed").alias("length")).first()
    assert one["n"] == 50_000 and one["stop"] == one["length"]
    assert time.time() - began < 90


def test_repeated_turns_and_pages(spark):
    rows = [(1, 0, "user", "a", 0), (1, 0, "user", "a", 0), (1, 1, "assistant", "b", 0), (1, 1, "assistant", "b", 0)]
    got = chat_format.read_back(chat_format.expand(spark.createDataFrame(rows, TURNS))).first()
    assert got["n_turns"] == 4 and got["loss_chars"] == 2
    deep = "http://h.net/" + "/".join(f"s{k}" for k in range(60)) + "?q"
    pages = [(1, deep), (1, deep), (2, None), (3, "http://h.net/" + "x" * 100_000), (4, "http://h.net")]
    judged = url_filter.judge(spark.createDataFrame(pages, "page_id int, url string"), max_levels=4).collect()
    assert sorted(r["page_id"] for r in judged) == [1, 1, 2, 3, 4] and all(r["verdict"] in ("allow", "block") for r in judged)
    assert {r["path"] for r in judged if r["page_id"] == 1} == {"/" + "/".join(f"s{k}" for k in range(60))}


def test_labelled_sections_of_a_wide_host_stay_apart(spark):
    """A bad section among many good ones is rejected, also below its fourth level; unlabelled pages follow."""
    path = lambda k: f"http://h.net/{'spam' if k % 20 == 0 else f'topic-{chr(97 + k % 20)}'}/a/b/c/{k}"
    rows = [(k, path(k)) for k in range(800)]
    labels = spark.createDataFrame([(k, k % 20 == 0) for k in range(400)], "page_id int, bad boolean")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id int, url string"), labels=labels).collect()}
    assert all((v == "block") == (k % 20 == 0) for k, v in got.items())


def test_terms_and_entities_of_one_text_make_no_pairs(spark, monkeypatch):
    """Two thousand addresses beside two thousand words: no more pairs than those of entities that texts share."""
    began, made = time.time(), {}
    monkeypatch.setattr(pii, "materialise", lambda df, label, f=common.materialise: made.setdefault(label, f(df, label)))
    text = " ".join(f"u{k}@b{k % 7}.co w{k}" for k in range(2000))
    docs = spark.createDataFrame([(0, text), *((k, f"plain w{k} words") for k in range(1, 200)), (300, "other u1@b1.co here")], "doc_id bigint, text string")
    assert pii.find_personal_data(docs).count() == 201
    assert made["pairs"].count() <= 3 * 2100 and time.time() - began < 60


def test_common_words_and_windows_make_no_pairs(spark, monkeypatch):
    """Documents that share a common word and a common passage with two thousand items meet only the items whose rare words they have; a very long one is read whole."""
    made = {}
    monkeypatch.setattr(decontaminate, "materialise", lambda df, label, f=common.materialise: made.setdefault(label, f(df, label)))
    frame = "read the following extraordinarily long passage and then choose"
    item = lambda k: f"{frame} alpha{k} beta{k} gamma{k} delta{k} one of them"
    bench = spark.createDataFrame([(k, item(k)) for k in range(2000)], "item_id bigint, text string")
    docs = [(k, f"{frame} something else {k}") for k in range(1500)] + [(1500 + k, f"{frame} alpha{k} {frame}") for k in range(50)]
    docs += [(2000, item(7)), (2001, "filler words " * 100_000 + item(8)), (2002, None), (2000, item(7))]
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect())
    assert got == [(2000, 7), (2000, 7), (2001, 8)]
    assert made["anchored"].count() <= 4 * 60 and made["candidates"].count() <= 60 and made["met"].count() <= 60 * 20
