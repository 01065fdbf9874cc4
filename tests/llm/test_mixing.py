import pytest

from tempora.llm import mixing
from tests.llm import corpus
from tests.llm.test_pipeline import mixed


def taken(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    return df, sorted((r._id, r._copies) for r in mixing.rated(df, ["doc_id"]).collect())


def test_against_brute_force(spark):
    docs = [(i, t, s) for i, t, _, s, _ in corpus.rows()]
    df, got = taken(spark, docs)
    exp = mixed(docs)
    assert got == sorted((i, sum(1 for j, _ in exp if j == i)) for i, *_ in docs)
    assert sorted(r.doc_id for r in mixing.mix(df).collect()) == sorted(i for i, _ in exp)


def test_caps_and_excess(spark):
    rows = [("a", 10), ("b", 1000), ("c", 1000), (None, 0)]
    t = {r.source: r for r in mixing.targets(spark.createDataFrame(rows, "source string, size bigint")).collect()}
    assert t["a"].target == 20 and t["b"].target == pytest.approx(2 / 3 * (1.5 * 2010 - 20)) and t["c"].target == pytest.approx(1 / 3 * (1.5 * 2010 - 20))
    assert t[None].target == 0 and t[None].rate == 0


def test_empty_null_and_clashing_names(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string, size bigint, rate int")
    assert mixing.mix(df).count() == 0 and mixing.mix(df).columns == df.columns
    df = spark.createDataFrame([(None, None, None), (None, "a b", None), (None, "a b", None)], "doc_id bigint, text string, source string")
    assert sorted(r._size for r in mixing.rated(df, ["doc_id"]).collect()) == [0, 2, 2]


def test_targets_are_met(spark):
    d = "/root/testdata/sf0.1"
    rows = mixing.op6_mixing(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert sum(abs(r["sum(taken)"] - r["max(target)"]) for r in rows) < 0.1 * sum(r["max(target)"] for r in rows)


def test_many_sources(spark):
    """As many sources as hosts: places by code point, caps reshared until none is above."""
    import random

    r = random.Random(4)
    rows = [(f"h{r.randrange(10**6)}.example" if k else None, r.choice([0, 1, 5, 50, 5000])) for k in range(700)]
    rows += [("Ä", 10), ("\U0001f600", 10), ("\uffff", 10)]
    got = {t.source: t.target for t in mixing.targets(spark.createDataFrame(rows, "source string, size bigint").repartition(7)).collect()}
    per = {}
    for s, n in rows:
        per[s] = per.get(s, 0) + n
    names = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight, free, rest, exp = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, set(per), 1.5 * sum(per.values()), {}
    while over := [s for s in free if 2 * per[s] <= weight[s] * rest / sum(weight[x] for x in free)]:
        exp |= {s: 2 * per[s] for s in over}
        free -= set(over)
        rest -= sum(2 * per[s] for s in over)
    w = sum(weight[s] for s in free)
    exp |= {s: weight[s] * rest / w for s in free}
    assert got.keys() == exp.keys() and all(got[s] == pytest.approx(exp[s]) for s in exp) and 3 < len(free) < len(per)
