import corpus_pipeline
from tests.llm.test_native import ITEM


def words(k, n=40):
    return " ".join(f"w{(k * 7919 + j * 104729) % 50021}" for j in range(n))


def test_each_stage_takes_effect(spark, tmp_path):
    rows, labels = [], []
    for k in range(400):
        rows.append((k, words(k) + (" vile awful" if k % 8 == 0 else ""), "en", f"s{k % 3}", 1))
        labels.append((k, 1, int(k % 8 == 0)))
    long = words(999, 400)
    rows += [(1000, rows[1][1].replace(" ", "  \t"), "en", "s1", 1), (1001, long, "en", "s1", 1), (1002, long + " end", "en", "s1", 1), (1003, f"{words(77)} {ITEM}", "en", "s0", 1), (1004, None, None, None, None)]
    for name, data, schema in (("documents", rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("labels", labels, "doc_id bigint, quality int, toxic int"), ("benchmark", [(1, ITEM)], "item_id bigint, text string")):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs, sizes, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), [], []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        seen.append(ids)
        sizes.append(len(ids))
    everything = {r[0] for r in rows}
    assert everything - seen[0] == {k for k in range(400) if k % 8 == 0}
    assert seen[0] - seen[1] == {1000} and seen[1] - seen[2] == {1002} and seen[2] - seen[3] == {1003}
    assert seen[4] <= seen[3]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == seen[4]
