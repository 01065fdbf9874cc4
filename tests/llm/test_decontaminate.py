import hashlib
import re

from tempora.llm import decontaminate
from tests.llm import corpus

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


def brute(docs, items):
    out = {}
    for i, t, *_ in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            for s in range(max(1, len(v) - 9) if v else 0):
                x = v[s : s + 10]
                for p in range(len(w) - len(x) + 1):
                    if w[p : p + len(x)] == x:
                        hit.update(range(p, p + len(x)))
                        found.add("null" if item is None else str(item))
        ids = ",".join(sorted(found))
        out[i] = (len(w), len(hit), len(found), ids)
    return out


def check(spark, docs, items):
    d = spark.createDataFrame(docs, corpus.DOC)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.find_leaks(d, b).collect()
    exp = brute(docs, items)
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_hit, len(r["items"]), ",".join(r["items"])) == exp[r.doc_id]
        assert sum(e - s for s, e in zip(r.hit_starts, r.hit_ends)) == r.n_hit


def test_against_brute_force(spark):
    check(spark, corpus.rows(), corpus.items())


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", 7)
    monkeypatch.setattr(decontaminate, "COUNTED", 4)
    check(spark, corpus.rows(8), corpus.items(8))
    same = [(k, "one two three four") for k in range(20)]  # one window of many items is in several blocks
    check(spark, corpus.rows(8), corpus.items(8) + same)


def test_a_crowded_bit_table(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 6)
    monkeypatch.setattr(decontaminate, "FILTER_SHARE", 0)
    check(spark, corpus.rows(9), corpus.items(9))


def test_windows_that_cannot_occur_are_left_out(spark):
    d = spark.createDataFrame(corpus.rows(), corpus.DOC)
    text = next(t for _, t, *_ in corpus.rows() if t and len(t.split()) > 40)
    b = spark.createDataFrame([(1, " ".join(text.split()[:30])), (2, " ".join(f"never{k}" for k in range(5000)))], "item_id bigint, text string")
    filed, members, _ = decontaminate._filed(d, "text", b, "item_id", "text", 10)
    assert 0 < filed.count() <= 21 and {r.item for r in members.select("item").distinct().collect()} == {"1"}


def test_empty_tables(spark):
    d = spark.createDataFrame(corpus.rows(), corpus.DOC)
    b = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find_leaks(d, b).where("n_hit > 0").count() == 0
    assert decontaminate.find_leaks(d.limit(0), b).count() == 0


def test_real_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    exp = brute(docs[:60], items)
    got = {r.doc_id: r for r in decontaminate.op9_decontaminate(spark, d).collect()}
    assert len(got) == len(docs)
    for i, (n, h, k, ids) in exp.items():
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, h, k, hashlib.sha256(ids.encode()).hexdigest(), h > 0)


def test_dropping_keeps_columns(spark):
    d = spark.createDataFrame(corpus.rows(), corpus.DOC).withColumnRenamed("n_chars", "n_hit")
    b = spark.createDataFrame(corpus.items(), "item_id bigint, text string")
    out = decontaminate.drop_leaks(d, b)
    assert out.columns == d.columns
    clean = {i for i, x in brute(corpus.rows(), corpus.items()).items() if not x[1]}
    assert {r.doc_id for r in out.collect()} == clean
