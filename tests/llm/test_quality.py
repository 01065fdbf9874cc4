import numpy as np

from tempora.llm import quality
from tests.llm import corpus


def accuracy(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = quality.op1_quality(spark, d)
    assert out.count() == docs.count()
    rows = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    y, p, s = (np.array([r[c] for r in rows]) for c in ("quality", "predicted", "score"))
    assert ((0 <= s) & (s <= 1)).all()
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    return np.mean(p[y == 1] == 1), np.mean(p[y == 0] == 0), auc


def test_held_out_accuracy(spark):
    good, bad, auc = accuracy(spark, "/root/testdata/sf0.1")
    print(good, bad, auc)
    assert good > 0.97 and bad > 0.85 and auc > 0.95


def test_one_class_and_no_labels(spark):
    docs = spark.createDataFrame(corpus.rows(), corpus.DOC)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score > 0.99 for r in quality.score(docs, quality.fit(docs, none)).collect()} == {True}
    bad = spark.createDataFrame([(3, 0), (4, 0), (5, 0), (None, 1), (6, None)], "doc_id bigint, quality int")
    assert {r.score < 0.01 for r in quality.score(docs, quality.fit(docs, bad)).collect()} == {True}


def test_keep_has_the_columns_of_documents(spark):
    docs = spark.createDataFrame(corpus.rows(), corpus.DOC).withColumnRenamed("source", "score").withColumnRenamed("lang", "f0")
    labels = spark.createDataFrame([(r[0], r[0] % 2) for r in corpus.rows()], "doc_id bigint, quality int")
    assert quality.keep(docs, labels).columns == docs.columns
    assert quality.keep(docs.limit(0), labels).count() == 0


def test_tables_are_added():
    r = np.random.default_rng(3)
    x = r.random((4000, 3))
    y = (((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)) | (x[:, 2] > 0.9)).astype(float)
    m = quality.fit_table(x, y)
    assert np.mean((m.score(x) > 0.5) == y) > 0.95
    z = np.full(len(x), m.bias)
    for k in range(len(x)):
        z[k] += sum(t[np.searchsorted(c, x[k, j], "right")] for j, (c, t) in enumerate(zip(m.cuts, m.tables)))
        z[k] += sum(t[np.searchsorted(m.coarse[i], x[k, i], "right"), np.searchsorted(m.coarse[j], x[k, j], "right")] for i, j, t in m.pairs)
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-z)))


def plain_features(text):
    """FEATURES of one text, by counting."""
    import math
    import re
    from collections import Counter

    raw = text.encode()
    words, lines = re.findall(rb"[^\x20\x09-\x0D]+", raw), [x for x in raw.split(b"\n") if x]
    low, n, size = [w.lower() for w in words], max(1, len(words)), max(1, len(raw))
    letters = sum(chr(c).isalpha() if c < 128 else True for c in raw)
    word = lambda c: 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    top = Counter(low)
    return [
        math.log1p(len(words)), sum(map(len, words)) / n, sum(65 <= c <= 90 for c in raw) / max(1, letters), sum(48 <= c <= 57 for c in raw) / size,
        sum(c in b"#$%&*+/<=>@[\\]^_`{|}~" for c in raw) / size, raw.count(b"!") / n, sum(not any(map(word, w)) for w in words) / n,
        sum(a == b for a, b in zip(low, low[1:])) / n, len(top) / n, sum(len(w) <= 3 for w in words) / n, sum(c in b".,;:?" for c in raw) / n, len(lines) / n,
        sum(c > 127 for c in raw) / size, sum(not word(w[-1]) and w[-1] not in b".,;:?" for w in words) / n, max(top.values(), default=0) / n,
        (len(lines) - len(set(lines))) / max(1, len(lines)), letters / size, math.log1p(max(map(len, words), default=0)),
    ]


def test_features_against_plain_counting(spark):
    texts = [t or "" for _, t, *_ in corpus.rows()] + ["!?", "a\n\na\nb", "#x# A1! ünï -- ...", "\n"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150).collect() if r.text]
    raw = [t.encode() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in raw])])
    got = quality.features(np.frombuffer(b" ".join(raw) + b" ", np.uint8), starts)
    assert got.shape == (len(texts), len(quality.FEATURES))
    for t, row in zip(texts, got):
        assert np.allclose(row, plain_features(t)), (t[:80], dict(zip(quality.FEATURES, zip(row, plain_features(t)))))


def test_repeated_ids_do_not_pass_the_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {k}", "en", "s", 6) for k in range(300)] + [(k, "other words", "en", "s", 6) for k in range(2, 9)], corpus.DOC)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 9)], "doc_id bigint, quality int")
    seen = []
    was = quality.fit_table
    monkeypatch.setattr(quality, "fit_table", lambda x, y: seen.append(len(y)) or was(x, y))
    quality.fit(docs, labels, sample=50)
    assert 0 < seen[0] <= 50
