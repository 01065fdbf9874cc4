import hashlib
import math
import re

import corpus_pipeline
from tempora import staging
from tempora.llm import quality
from tests.llm import test_decontaminate, test_ngram_join, test_token_files

D = "/root/testdata/sf0.001"


def mixed(docs):
    """docs(doc_id, text, source): each as often as the mix takes it."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    per = {}
    for i, _, s in docs:
        per[s] = per.get(s, 0) + size[i]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(per, key=lambda s: (s is None, s or "")))}
    target, free, rest = {}, dict(weight), 1.5 * sum(per.values())
    while True:
        over = [s for s in free if 2 * per[s] <= free[s] * rest / sum(free.values())]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * per[s]
        rest -= sum(target[s] for s in over)
        free = {s: w for s, w in free.items() if s not in over}
    target |= {s: w * rest / sum(free.values()) for s, w in free.items()}
    out = []
    for i, t, s in docs:
        rate = target[s] / per[s] if per[s] else 0.0
        u = int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) / 2**52
        out += [(i, t)] * (math.floor(rate) + (u < rate - math.floor(rate)))
    return out


def test_whole_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{D}/labels.parquet"))
    rows = sorted((r.doc_id, r.text, r.source) for r in quality.score(docs, model).where("score >= 0.7").collect())
    assert len(rows) < docs.count()
    first = {i for i, _, c in test_ngram_join.brute([r[:2] for r in rows]) if i == c}
    rows = [r for r in rows if r[0] in first]
    items = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = test_decontaminate.brute(rows, items)
    rows = [r for r in rows if not leaks[r[0]][1]]
    exp = test_token_files.brute(mixed(rows))
    before = set(staging._PLACES)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, D).collect()), key=lambda r: r[1])
    assert got == exp
    assert len(set(staging._PLACES) - before) == 1  # only the result is still there


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, D)
        assert sorted(out.dtypes) == sorted(docs.dtypes)
        assert 0 < out.count()
        assert f(spark, docs.limit(0), D).count() == 0
