"""The operators made of DataFrame functions, on small tables with odd rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from metaudit.llm import chat_format, decontaminate, exact_dedup, mixing, pii, url_filter

DOCS = "doc_id bigint, text string, source string, extra int"


def table(spark, tmp_path, rows, schema=DOCS, name="t"):
    """Written and read back, as operators get their tables."""
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


# --- exact dedup

ODD = [(5, "a  b", "x", 1), (3, "a\tb", "x", 2), (9, None, None, 3), (8, "", "y", 4), (None, "a b", "x", 5), (7, "c", "y", 6), (7, "c", "y", 6), (1, "A b", None, None), (2, "long " * 30_000, "z", 7)]


def decisions(found):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in found.collect())


WANT = sorted([(False, 5, 3, 3, False), (False, 3, 3, 3, True), (False, 9, 8, 2, False), (False, 8, 8, 2, True), (True, 0, 3, 3, False), (False, 7, 7, 2, False), (False, 7, 7, 2, True), (False, 1, 1, 1, True), (False, 2, 2, 1, True)])


def test_exact_dedup(spark, tmp_path):
    assert decisions(exact_dedup.find_copies(table(spark, tmp_path, ODD))) == WANT
    kept = exact_dedup.drop_copies(table(spark, tmp_path, ODD, name="again"))
    assert kept.columns == ["doc_id", "text", "source", "extra"] and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 7, 8]


def test_exact_dedup_compares_full_bytes(spark, tmp_path):
    """With a digest of one value all rows are hits; the bytes decide."""
    weak = lambda text: F.substring(exact_dedup.sha256_digest(text), 1, 0)
    assert decisions(exact_dedup.find_copies(table(spark, tmp_path, ODD), digest=weak)) == WANT


def test_exact_dedup_takes_any_frame_and_empty_tables(spark, tmp_path):
    frame = spark.createDataFrame(ODD, DOCS).withColumnRenamed("extra", "digest").withColumn("at", F.lit(1))
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(frame).collect()) == [1, 2, 3, 7, 8]
    assert exact_dedup.find_copies(table(spark, tmp_path, [])).count() == 0


def test_state_goes_on(spark, tmp_path):
    """Files that come later meet the state of earlier runs."""
    first = spark.createDataFrame([(5, "x", 0)], "doc_id bigint, text string, n int")
    arrivals = lambda df: df.select("doc_id", F.struct(F.lit("f").alias("file"), F.col("n").cast("bigint").alias("row")).alias("at"), exact_dedup.sha256_digest(F.col("text")).alias("digest"))
    path = str(tmp_path / "arrivals")
    arrivals(first).write.parquet(path)
    check = str(tmp_path / "state")
    exact_dedup.track_digests(spark, spark.read.parquet(path), check).collect()
    arrivals(spark.createDataFrame([(4, "x", 1), (9, "y", 2)], "doc_id bigint, text string, n int")).write.mode("append").parquet(path)
    got = exact_dedup.track_digests(spark, spark.read.parquet(path), check).collect()
    assert sorted((r["n"], r["keeper"]["doc_id"]) for r in got) == [(1, 9), (2, 4)]


# --- mixing


def test_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, None: 90}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint"), (1, 2, 3), 3).collect()}
    weight = {"a": 1, "b": 2, "c": 3, None: 1}
    want, capped = {}, set()
    while True:  # reshare the excess until none is above
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        want = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in sizes if x not in capped) for s in sizes}
        above = {s for s in sizes if s not in capped and want[s] > 3 * sizes[s]}
        if not above:
            break
        capped |= above
    assert got == pytest.approx(want)


def test_mixing(spark, tmp_path):
    rows = [(k, "w " * (1 + k % 50), "big" if k % 3 else f"s{k % 5}", k) for k in range(3000)] + [(None, None, None, 1), (5, "", "big", 2)]
    docs = table(spark, tmp_path, rows)
    for block_rows in (100_000, 50):  # blocks change the order, not the shares
        got = mixing.plan_copies(docs, block_rows=block_rows).collect()
        assert len(got) == len(rows)
        by = {}
        for r in got:
            assert 0 <= r["copies"] <= 3
            s = by.setdefault(r["source"], [0, r["target"], r["source_size"]])
            s[0] += r["copies"] * r["size"]
        for taken, target, _ in by.values():
            assert abs(taken - target) <= 0.03 * target + 150
    again = [tuple(r) for r in mixing.plan_copies(docs).drop("row").orderBy("doc_id", "size").collect()]
    assert again == [tuple(r) for r in mixing.plan_copies(docs.repartition(7)).drop("row").orderBy("doc_id", "size").collect()]
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in mixing.plan_copies(docs).collect())
    assert mixing.plan_copies(table(spark, tmp_path, [], name="none")).count() == 0


# --- chat formatting

TURNS = "conv_id bigint, turn bigint, role string, text string, loss int"


def test_chat_format(spark):
    bad = chat_format.HOSTILE
    rows = [(1, 1, "assistant", "b & c", 0), (1, 0, "user", bad, 0), (1, 2, "user", None, 0), (1, 3, "assistant", "&lt;| &amp; \n é", 0), (2, 0, "user", "hi", 0), (3, 0, "sys\ntem", "x", 0), (3, 1, "assistant", bad, 0), (3, 2, "user", "<|im_end|>\n", 0), (None, None, None, None, 0)]
    examples = chat_format.expand(spark.createDataFrame(rows, TURNS))
    got = {r["conv_id"]: r for r in chat_format.read_back(examples).collect()}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0))
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = sorted(examples.filter("conv_id = 1").collect(), key=lambda r: r["target"])
    assert [r["target"] for r in one] == [1, 3] and one[1]["text"].startswith(one[0]["text"])
    assert one[0]["text"][one[0]["loss_begin"] : one[0]["loss_end"]] == "b &amp; c"
    assert [r["loss_begin"] for r in examples.filter("conv_id = 2").collect()] == [None]
    assert chat_format.read_back(chat_format.expand(spark.createDataFrame([], TURNS))).count() == 0


# --- url filter


def test_url_rules(spark):
    urls = ["http://a.org/x", "http://EXAMPLE.org/es/1", "http://m.example.org/en/17?q#f", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/de/9", "http://borg/x", "http://a.org", None, "no scheme", "s://h#://b/c", "http://x.com?u=/fr/"]
    got = {r["url"]: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit("clash"))).join(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), "page_id").collect()}
    rule = {u: (r["host"], r["path"], r["rule"]) for u, r in got.items()}
    assert rule == {
        urls[0]: ("a.org", "/x", "org/"), urls[1]: ("example.org", "/es/1", "example.org/es/"), urls[2]: ("m.example.org", "/en/17", "example.org/en/1"), urls[3]: ("example.org", "/en/2", "org/"),
        urls[4]: ("x.com", "/fr/", "com/fr/"), urls[5]: ("x.com", "/de/9", "com/de/"), urls[6]: ("borg", "/x", None), urls[7]: ("a.org", "", None), None: ("", "", None), urls[9]: ("", "", None), urls[10]: ("h", "", None), urls[11]: ("x.com", "", None),
    }
    assert got[urls[1]]["verdict"] == "block" and got[urls[3]]["verdict"] == "allow"
    assert url_filter.judge(spark.createDataFrame([], "page_id int, url string")).count() == 0


def test_url_templates(spark):
    """Labelled urls reject the template they share, also for urls without a label, and leave others alone."""
    rows = [(k, f"http://h.net/{'spam' if k % 2 else 'news'}/{k}/item") for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2 == 1) for k in range(0, 100)], "page_id int, bad boolean")
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id int, url string"), labels=labels).collect()}
    assert all((r["verdict"] == "block") == (k % 2 == 1) for k, r in got.items())
    assert {r["template"] for r in got.values()} == {"spam/*/*", "news/*/*"}


# --- personal data

CONTRACT = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(v):
    figures = [int(c) for c in v if c.isdigit()][::-1]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(figures)) % 10 == 0


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(CONTRACT.items()):
        for m in re.finditer(pattern, text):
            v, n = m.group(), len(re.sub("[^0-9]", "", m.group()))
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in v.split("."))) or (kind == "card" and 14 <= n <= 19 and luhn(v)) or (kind == "phone" and 10 <= n <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


PRIVATE = [
    "a@b.co, c.d+e%f@g-h.example.org; x@y@z.com a@b.c%d@e.f.g é@b.co", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 79927398713 5 4111111111111111 123456789012345678901234567890",
    "+1 (736) 555-2678 +12 +1.2.3.4.5.6.7.8.9.0 +49-170-1234567x", "", None, "no digits at all", "é😀 a@b.co 😀 10.0.0.1", "x" * 50_000, "1 " * 20_000, "a@" * 5_000, "4111 1111 1111 1111" * 3,
]


def test_base_spans(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(PRIVATE)] + [(0, PRIVATE[0]), (None, PRIVATE[1])], "doc_id bigint, text string").withColumn("base", F.lit(1))
    for r in pii.find_personal_data(rows).collect():
        text = PRIVATE[1 if r["doc_id"] is None else r["doc_id"]] or ""
        assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == brute_spans(text), text[:80]
    assert pii.find_personal_data(rows.limit(0)).count() == 0


def test_revealing_terms(spark):
    """A name that only comes with one address is marked there; common words are not."""
    rows = [(k, f"text number {k} that Zorblax wrote to boss@corp.com about work {k}") for k in range(6)] + [(100 + k, f"text {k} that someone wrote about work, mail u{k}@corp.com") for k in range(60)]
    got = {r["doc_id"]: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for k in range(6):
        assert "Zorblax" not in got[k]["text"] and "boss@corp.com" not in got[k]["text"] and "wrote" in got[k]["text"] and "[EMAIL]" in got[k]["text"]
    assert got[101]["text"] == "text 1 that someone wrote about work, mail [EMAIL]"


def test_entities_of_one_text_and_parts_of_many(spark):
    """A name beside an address that occurs once proves nothing; one that comes with all addresses of a domain does."""
    rows = [(0, "ask Zorblax at boss@corp.com about work")] + [(k, f"ask Umbrella staff at u{k}@umbrella.org about work") for k in range(1, 41)] + [(k, "ask them about work at any time, staff") for k in range(41, 3000)]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    marked = lambda k: [(rows[k][1][s["start"] : s["end"]], s["kind"]) for s in got[k]["added"]]
    assert marked(0) == [] and marked(7) == [("Umbrella", 5)] and marked(50) == []


def test_terms_at_any_distance(spark):
    """A name far from the address is marked at each place; one that also occurs elsewhere tells less; blanks keep places beside overlapping and long spans."""
    far = "Zorblax wrote 1.2.3.4-Zorblax é😀 " + "and then he wrote " * 400 + "to boss@corp.com +1 (736) 555-2678 " + "and then he wrote " * 400 + "ZORBLAX"
    rows = [(0, far)] + [(k, "then Zorblax wrote to boss@corp.com") for k in range(1, 4)] + [(k, "and then he wrote to Quux") for k in range(4, 2000)]
    r = next(r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() if r["doc_id"] == 0)
    assert [far[s["start"] : s["end"]] for s in r["added"]] == ["Zorblax", "Zorblax", "ZORBLAX"]


# --- decontamination

ITEM = "What is the total weight of 12 boxes if each box holds 35 kg of fresh green apples from the farm"


def test_leaks(spark):
    other = "An entirely different question about rivers and mountains that nobody asked before in this little town"
    bench = spark.createDataFrame([(1, ITEM), (2, other), (3, None), (4, "short item here")], "item_id bigint, text string")
    docs = [
        (1, f"intro words. {ITEM} and an end", "s", 0), (2, ITEM.replace("12", "17").replace("35", "90"), "s", 0), (3, ITEM.replace("kg", "pounds").upper().lower(), "s", 0), (4, "What is the total weight of something else entirely", "s", 0),
        (5, None, "s", 0), (6, "", "s", 0), (1, f"intro words. {ITEM} and an end", "s", 0), (None, other, None, None), (7, "x y z. A short item here, said they", "s", 0), (8, "the farm apples green fresh of kg 35 holds box each if boxes 12 of weight total the is What", "s", 0), (9, "word " * 50_000 + ITEM, "s", 0),
    ]
    frame = spark.createDataFrame(docs, DOCS).withColumnRenamed("extra", "uid")
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in decontaminate.find_leaks(frame, bench).collect())
    assert got == [(0, 2), (1, 1), (1, 1), (2, 1), (3, 1), (7, 4), (9, 1)]
    clean = decontaminate.drop_leaks(frame, bench)
    assert clean.columns == frame.columns and sorted(r["doc_id"] for r in clean.collect()) == [4, 5, 6, 8]
    assert decontaminate.find_leaks(frame, bench.limit(0)).count() == 0 and decontaminate.find_leaks(frame.limit(0), bench).count() == 0
    assert decontaminate.drop_leaks(frame, bench.limit(0)).count() == len(docs)


def test_slots_must_be_consistent(spark):
    item = "If Anna has 12 apples and 12 pears how many fruits does she have in all on that day"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, item.replace("12", "30")), (2, item.replace("12", "30", 1))], "doc_id bigint, text string")
    assert [r["doc_id"] for r in decontaminate.find_leaks(docs, bench).collect()] == [1]


def test_windows_short_of_literal_words(spark):
    """Items made of names and numbers leak with their values alone; one template among them does not make a leak."""
    names = "Guests: we saw Anna Bertha Carl Dora Emil Fritz Gustav Heinrich Ida Julius Karl Ludwig"
    sums = "12 3.5 40 7 99 18 250"
    one = "5"
    bench = spark.createDataFrame([(1, names), (2, sums), (3, one)], "item_id bigint, text string")
    docs = [(1, f"so {names} there"), (2, names.replace("a ", "o ")), (3, f"they add {sums} up"), (4, "12 3.5 41 7 98 18 251"), (5, "here we saw Otto Paul Quirin Rosa and more"), (6, "It is 5 now"), (7, "It is 6 now")]
    got = sorted(tuple(r) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).select("doc_id", "item_id", "windows").collect())
    assert got == [(1, 1, 11), (3, 2, 3), (6, 3, 1)]
