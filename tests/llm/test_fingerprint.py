import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.llm import fingerprint as fp
from tests.llm import corpus


def expected(docs):
    order = sorted(docs, key=lambda d: d[0], reverse=True)
    out = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out[i] = (t, t[: len(t) - half] + nxt[:half], nxt)
    return out


def jaccard(a, b):
    from collections import Counter

    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    top, low = sum((x | y).values()), sum((x & y).values())
    return low / top if top else 1.0


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("fp")
    spark.createDataFrame(corpus.rows(), corpus.DOC).repartition(3).write.parquet(f"{d}/documents.parquet")
    return {r.doc_id: r for r in fp.op3_fingerprint(spark, str(d)).collect()}


def test_edited_texts(result):
    exp = expected([r[:2] for r in corpus.rows()])
    assert result.keys() == exp.keys()
    for i, (t, e, _) in exp.items():
        assert (result[i].n_chars, result[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())


def test_equal_texts_and_likeness(result):
    exp = expected([r[:2] for r in corpus.rows()])
    assert result[5].fingerprint == result[6].fingerprint
    errors = []
    for i, (t, e, n) in exp.items():
        r = result[i]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        errors += [r.near_edited - jaccard(t, e), r.near_next - jaccard(t, n)]
    assert np.abs(errors).max() < 0.3 and np.sqrt(np.mean(np.square(errors))) < 0.08 and abs(np.mean(errors)) < 0.03


def test_collision_rate_is_the_generalised_jaccard_similarity(spark):
    a, b = {f"t{i}": 1 + i % 5 for i in range(40)}, {f"t{i}": 1 + (i * 3) % 5 for i in range(20, 60)}
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
    rows = [(f"{s}{n}", f"{n}-{k}") for n in range(60) for s, x in (("a", a), ("b", b)) for k, w in x.items() for _ in range(w)]
    df = spark.createDataFrame(rows, "id string, w string").groupBy("id").agg(F.collect_list("w").alias("w"))
    sig = {r.id: r.sig for r in fp.signatures(fp.weighted_terms(df, ["id"], "w"), ["id"]).collect()}
    rate = np.mean([np.mean(np.array(sig[f"a{n}"]) == np.array(sig[f"b{n}"])) for n in range(60)])
    assert abs(rate - true) < 4 * np.sqrt(true * (1 - true) / 60 / fp.SAMPLES)


@pytest.mark.parametrize("a,b", [({"x": 1}, {"x": 1, "y": 1}), ({"x": 1}, {"x": 3}), ({"x": 10000, "y": 1}, {"x": 9000, "y": 500}), ({"x": 700, "y": 300, "z": 1}, {"x": 300, "y": 700}), ({f"t{i}": 1 for i in range(80)}, {f"t{i}": 2 for i in range(40, 80)}), ({"x": 40} | {f"t{i}": 1 for i in range(30)}, {"x": 20} | {f"t{i}": 1 for i in range(10, 40)})])
def test_collision_rate_of_few_terms_and_heavy_weights(spark, a, b):
    """64 samples of 1,000 renamed pairs: the standard error is below 0.002."""
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
    rows = [(n, s, k, w) for s, x in ((0, a), (1, b)) for k, w in x.items() for n in range(1000)]
    df = spark.createDataFrame(rows, "n int, s int, k string, w int").repartition(8)
    terms = df.select("n", "s", F.xxhash64(F.concat_ws("-", "k", "n")).alias("term"), F.log(F.col("w").cast("double")).alias("lw"))
    sig = fp.signatures(terms, ["n", "s"]).groupBy("n").agg(F.first(F.when(F.col("s") == 0, F.col("sig")), True).alias("a"), F.first(F.when(F.col("s") == 1, F.col("sig")), True).alias("b"))
    rate = sig.agg(F.avg(fp.likeness(F.col("a"), F.col("b")))).first()[0]
    print(true, rate)
    assert abs(rate - true) < 0.003 + 3 * np.sqrt(true * (1 - true) / 64000)


def printed(text):
    """The fingerprint of a text, from the words on, by plain Python."""
    import math
    import re
    from collections import Counter

    import xxhash

    poly = lambda c, x: sum(k * x**i for i, k in enumerate(c))
    counts = Counter(w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w)
    out = []
    for j in range(fp.SAMPLES):
        best = None
        for word, n in counts.items():
            term = xxhash.xxh64_intdigest(word.encode(), 42)
            h = xxhash.xxh64_intdigest(j.to_bytes(4, "little"), xxhash.xxh64_intdigest(term.to_bytes(8, "little"), 42))
            s = math.sqrt(((h & 0xFFFF) + 0.5) * (1 - fp.TAIL) / 2**16)
            r = s * poly(fp._ABOVE, s) / poly(fp._BELOW, s)
            u = (((h >> 16 & 0xFFFFFF) + 0.5) * fp.LOG_TAIL / 2**24) ** 0.125
            t = math.floor(math.log(n) / r + (h >> 40) / 2**24)
            a = poly(fp._LOG_ABOVE, u) / poly(fp._LOG_BELOW, u) - r * (t - (h >> 40) / 2**24 + 1)
            own = (int((a + 96) * 2**23), (h ^ (t << 7)) & 0xFFFFFFFF)
            best = own if best is None or own < best else best
        out.append("" if best is None else f"{best[1]:08x}")
    return "".join(out)


def test_fingerprints_against_plain_python(result):
    exp = expected([r[:2] for r in corpus.rows()])
    for i, (t, e, n) in exp.items():
        assert (result[i].fingerprint, result[i].edited_fingerprint) == (printed(t), printed(e)), i
        a, b = printed(t), printed(n)
        assert result[i].near_next == (sum(a[k : k + 8] == b[k : k + 8] for k in range(0, 512, 8)) / 64 if a and b else float(a == b))


def test_many_rows_of_one_id(spark, tmp_path):
    """Ids that fill ranges, and nulls, are split; every row is followed by the next in the order of (doc_id, hash of the text)."""
    import xxhash

    docs = [(7, f"seven {k}") for k in range(300)] + [(None, f"none {k}") for k in range(300)] + [(k, f"own {k}") for k in range(100, 400)] + [(-k, None) for k in range(5)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    rows = fp.with_next(df).collect()
    key = lambda d: (d[0] is not None, d[0] or 0, xxhash.xxh64_intdigest((d[1] or "").encode(), 42))
    order = [(i, t or "") for i, t in sorted(docs, key=key, reverse=True)]
    assert sorted((repr(r.doc_id), r.text, r.next_text) for r in rows) == sorted((repr(i), t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    per = {}
    for r in rows:
        per.setdefault(r.bucket, []).append(r.doc_id)
    assert max(map(len, per.values())) < 150 and len({b for b, x in per.items() if 7 in x}) > 3 and len({b for b, x in per.items() if None in x}) > 3


def test_single_empty_and_clashing(spark, tmp_path):
    spark.createDataFrame([(None, None, "x")], "doc_id bigint, text string, fingerprint string").write.parquet(f"{tmp_path}/a/documents.parquet")
    (r,) = fp.op3_fingerprint(spark, f"{tmp_path}/a").collect()
    assert (r.doc_id, r.n_chars, r.fingerprint, r.near_edited, r.near_next) == (None, 0, "", 1.0, 1.0)
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert fp.op3_fingerprint(spark, f"{tmp_path}/b").count() == 0
    df = spark.createDataFrame(corpus.rows(), corpus.DOC)
    assert fp.fingerprints(df).count() == df.count()


def test_the_driver_has_little_to_plan_and_to_write(spark):
    """The plan of 64 samples took 1.3 million characters, and most of the driver's memory; each staged table is five files and folders that the driver makes."""
    from tempora import staging

    terms = spark.range(9).select("id", F.xxhash64("id").alias("term"), F.lit(0.0).alias("lw"))
    sig = fp.signatures(terms, ["id"])
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(sig._jdf.queryExecution(), "formatted")
    assert "Functions [16]" in plan and len(plan) < 400_000
    before = set(staging._PLACES)
    fp.with_next(spark.createDataFrame(corpus.rows(), corpus.DOC))
    assert len(set(staging._PLACES) - before) == 1


def test_any_number_of_samples(spark):
    terms = spark.range(40).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("term"), F.log(F.col("id") + 1.0).alias("lw"))
    full = {r.k: r.sig for r in fp.signatures(terms, ["k"]).collect()}
    for n in (1, 6, 7):
        assert {r.k: r.sig for r in fp.signatures(terms, ["k"], n).collect()} == {k: x[:n] for k, x in full.items()}


def test_a_path_that_only_spark_reads(spark, tmp_path, result):
    spark.createDataFrame(corpus.rows(), corpus.DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.fingerprints.link./in", f"file://{tmp_path}")
    assert {r.doc_id: r for r in fp.op3_fingerprint(spark, "viewfs://fingerprints/in").collect()} == result
