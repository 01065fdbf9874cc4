import hashlib
import random

import numpy as np
import pytest

from tempora.llm import _exchange, suffix_dedup
from tests.llm import corpus


def brute(docs, w=100):
    texts = [(t or "").encode() for _, t in docs]
    least = {}
    for (i, _), t in zip(docs, texts):
        for s in range(len(t) - w + 1):
            k = t[s : s + w]
            least[k] = min(least.get(k, (i, s)), (i, s))
    out = []
    for (i, _), t in zip(docs, texts):
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - w + 1):
            if least[t[s : s + w]] < (i, s):
                gone[s : s + w] = True
        runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)


def run(spark, docs, path, parts=4):
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(parts).write.parquet(f"{path}/documents.parquet")
    return sorted(tuple(r) for r in suffix_dedup.op2_suffix_dedup(spark, str(path)).collect())


def copies(seed):
    r = random.Random(seed)
    pool = "".join(r.choice("ab cdé") for _ in range(4000))
    docs = []
    for i in range(40):
        parts = []
        for _ in range(r.randint(1, 4)):
            s = r.randrange(3500)
            parts.append(pool[s : s + r.choice([50, 99, 100, 101, 150, 400])] + "".join(r.choice("xyz") for _ in range(r.choice([0, 3, 80]))))
        docs.append((i, "".join(parts)))
    docs += [(50, "!" * 350), (51, "!" * 120), (52, "ab" * 90), (53, "ba" * 90), (54, None), (55, "")]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed,size", [(1, 1 << 22), (2, 1500), (3, 4000)])
def test_against_brute_force(spark, tmp_path, monkeypatch, seed, size):
    monkeypatch.setattr(_exchange, "BLOCK_BYTES", size)
    monkeypatch.setattr(_exchange, "RANGE_KEYS", 50)
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 2000)
    docs = copies(seed)
    assert run(spark, docs, tmp_path) == brute(docs)


def passages(seed):
    """One passage in most documents among different neighbours, lines that start alike, one line repeated everywhere, zero bytes."""
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abc d") for _ in range(n))
    hot, head, zeros = text(260), text(60), "\0" * 130
    docs = []
    for i in range(120):
        parts = [text(r.randrange(90)), hot[: r.choice([120, 200, 260])], text(r.randrange(5)), head + text(60), hot[r.randrange(60) :], r.choice(["", zeros, zeros + "a" * 101])]
        docs.append((i, "".join(r.sample(parts, r.randint(2, 6)))))
    docs += [(k, head + text(30) + hot) for k in range(200, 230)] + [(300, hot), (300, hot)]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("range_bytes,max_ranges,block", [(1 << 22, 1 << 14, 1 << 22), (400, 1 << 14, 700), (700, 6, 1500), (150, 1 << 14, 300)])
def test_hot_passages_across_ranges(spark, tmp_path, monkeypatch, range_bytes, max_ranges, block):
    monkeypatch.setattr(_exchange, "BLOCK_BYTES", block)
    monkeypatch.setattr(_exchange, "RANGE_KEYS", 500)
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(suffix_dedup, "MAX_RANGES", max_ranges)
    monkeypatch.setattr(suffix_dedup, "SMALL", 4)
    seen = []
    was = suffix_dedup._splitters
    monkeypatch.setattr(suffix_dedup, "_splitters", lambda *a: seen.append(was(*a)) or seen[-1])
    docs = passages(3)
    assert run(spark, docs, tmp_path) == brute(docs)
    if block == 700:  # a gram and a whole string fill several ranges
        keys, deep = seen[0]
        assert deep.sum() > 5 and len(set(keys.tolist())) < len(keys)


def test_suffix_order():
    r = np.random.default_rng(5)
    texts = r.integers(0, 2, (700, 21)).astype(np.uint8)
    texts[::3] = texts[0]
    order, common = suffix_dedup.suffix_order(texts)
    rows = [bytes(texts[k]) for k in order]
    assert rows == sorted(bytes(x) for x in texts) and common[0] == -1
    for k in range(1, len(rows)):
        n = next((i for i in range(21) if rows[k][i] != rows[k - 1][i]), 21)
        assert common[k] == n


def test_repeated_ids_and_awkward_documents(spark, tmp_path, monkeypatch):
    docs = [r[:2] for r in corpus.rows()]
    text = docs[10][1] or "z" * 300
    docs += [(300, text), (300, text), (301, "q" + text), (301, "qq" + text)]
    assert run(spark, docs, tmp_path / "a") == brute(docs)
    assert run(spark, [], tmp_path / "b") == []
    alone = [(k, f"{k} " * 100 + "x" * k) for k in range(5)]  # nothing is shared
    assert run(spark, alone, tmp_path / "c") == brute(alone)


def test_segments(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 300)
    buf = np.frombuffer(bytes(random.Random(5).choices(b"abc", k=5000)) + b" ", np.uint8)
    lo, hi, p, _ = suffix_dedup.anchors(np.array([0, 5001]), buf)
    assert np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)]).tolist() == list(range(4901))
    assert ((p >= hi) & (p - lo <= suffix_dedup.REACH)).all()


def test_multikey_sort():
    d = np.random.default_rng(2).integers(0, 3, (500, 6)).astype(np.uint64)
    assert [tuple(r) for r in d[suffix_dedup.multikey_sort(d)]] == sorted(tuple(r) for r in d)


def test_real_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in suffix_dedup.op2_suffix_dedup(spark, "/root/testdata/sf0.001").collect()) == brute(docs)
