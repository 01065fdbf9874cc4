import hashlib
import re

import pytest

from tempora.llm import _exchange, substring_dedup
from tests.llm import corpus


def brute(docs, k=13):
    split = {n: re.findall(r"[^\x20\x09-\x0D]+", t or "") for n, (_, t) in enumerate(docs)}
    least = {}
    for n, w in split.items():
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            least[key] = min(least.get(key, docs[n][0]), docs[n][0])
    out = []
    for n, w in split.items():
        gone = {j for s in range(len(w) - k + 1) if least[tuple(w[s : s + k])] < docs[n][0] for j in range(s, s + k)}
        out.append((docs[n][0], len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out)


def run(spark, docs, path, parts=4):
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(parts).write.parquet(f"{path}/documents.parquet")
    return sorted(tuple(r) for r in substring_dedup.op7_substring_dedup(spark, str(path)).collect())


@pytest.mark.parametrize("size", [1 << 22, 3000])
def test_against_brute_force(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(_exchange, "BLOCK_BYTES", size)
    monkeypatch.setattr(_exchange, "RANGE_KEYS", 500)
    docs = [r[:2] for r in corpus.rows()]
    docs += [(5, docs[3][1]), (5, docs[3][1]), (99, "w " * 40), (98, "w " * 30)]
    assert run(spark, docs, tmp_path) == brute(docs)


def test_real_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in substring_dedup.op7_substring_dedup(spark, "/root/testdata/sf0.001").collect()) == brute(docs)


def test_empty_null_and_spans(spark, tmp_path):
    assert run(spark, [], tmp_path / "a") == []
    assert run(spark, [(1, None), (2, "")], tmp_path / "b") == brute([(1, None), (2, "")])
    df = spark.createDataFrame([(None, "a b c d"), (1, "x a b c y a b c d")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(df, width=3).collect()}
    assert got[None].kept == "a b c d" and got[1].kept == "x y" and (got[1].starts, got[1].ends) == ([1, 5], [4, 9])


def test_structured_words(spark, tmp_path):
    from tests.llm.test_shared import thue_morse

    docs = [(1, " ".join([thue_morse(1024)] * 13)), (2, " ".join([thue_morse(1024, "b", "a")] * 13)), (3, " ".join(thue_morse(64, "a ", "b "))), (4, thue_morse(64, "b ", "a "))]
    assert run(spark, docs, tmp_path) == brute(docs)
