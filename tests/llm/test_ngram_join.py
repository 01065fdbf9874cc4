import random
import re
import time

import numpy as np
import pytest

from tempora.llm import _exchange, _text, ngram_join
from tests.llm import corpus

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs))


def link_counts(docs):
    sets = [shingles(t) for _, t in docs]
    near = lambda a, b: bool(a & b) and 100 * len(a & b) >= 80 * len(a | b)
    return sorted((d, sum(near(s, t) for j, t in enumerate(sets) if j != i)) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def run(spark, docs, parts=4):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(parts)
    rows = ngram_join.join_similar(df).collect()
    assert sorted((r.doc_id, r.n_links) for r in rows) == link_counts(docs)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows)


def near_copies(seed, n=70, size=100):
    r = random.Random(seed)
    bases = [[f"w{r.randrange(4000)}" for _ in range(size)] for _ in range(5)]
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 3, 4, 5, 6, 8])):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        if r.random() < 0.3:
            w += passage
        docs.append((i, " ".join(w)))
    docs += [(n + i, " ".join(passage + [f"q{i}"] * r.randrange(8))) for i in range(12)]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_copies_against_brute_force(spark, monkeypatch, seed):
    if seed == 2:
        monkeypatch.setattr(ngram_join, "FAMILY_KEYS", 700)  # chunk pairs
    if seed == 3:
        monkeypatch.setattr(ngram_join, "FAMILY_SETS", 9)
    if seed == 2:
        monkeypatch.setattr(_exchange, "BLOCK_BYTES", 4000)
        monkeypatch.setattr(_exchange, "RANGE_KEYS", 300)
    docs = near_copies(seed)
    got, exp = run(spark, docs), brute(docs)
    assert len({x[2] for x in exp}) > 4
    assert got == exp


def test_awkward_documents(spark):
    docs = [r[:2] for r in corpus.rows()] + [(5, "one"), (200, "ONE"), (201, "one two three four"), (202, None)]
    assert run(spark, docs) == brute(docs)


def test_empty_and_null_id(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (2, "z")], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.join_similar(df).collect()} == {(None, None), (1, None), (2, 2)}


def test_real_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = ngram_join.op5_ngram_join(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute(docs)
    assert sorted((r.doc_id, r.n_links) for r in rows) == link_counts(docs)


def test_keep_one(spark):
    df = spark.createDataFrame(corpus.rows() + corpus.rows()[:3], corpus.DOC).withColumnRenamed("source", "component_id")
    out = ngram_join.keep_one(df)
    assert out.columns == df.columns
    comp = {d: c for d, _, c in brute([r[:2] for r in corpus.rows()])}
    assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, c in comp.items() if d == c)


def all_pairs(docs):
    """Pairs of similar documents, and those of equal sets among them."""
    sets = [(d, shingles(t)) for d, t in docs]
    near = {(min(a, b), max(a, b)) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if s & t and 100 * len(s & t) >= 80 * len(s | t)}
    same = dict(sets)
    return near, {p for p in near if same[p[0]] == same[p[1]]}


@pytest.mark.parametrize("family_keys", [4_000_000, 700])
def test_every_pair_is_found_once(spark, monkeypatch, family_keys):
    monkeypatch.setattr(ngram_join, "FAMILY_KEYS", family_keys)
    monkeypatch.setattr(ngram_join, "LINK_ROWS", 50)
    docs = near_copies(2, size=300)
    pairs, members = ngram_join.similar_pairs(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4))
    rows = members.collect()
    assert sorted((r.doc_id, r.n_shingles) for r in rows) == sorted((d, len(shingles(t))) for d, t in docs)
    held = {}
    for r in rows:
        held.setdefault(r.class_id, []).append(r.doc_id)
    alone = held.pop(None, [])
    found = [(a, b) for x in held.values() for a in x for b in x if a < b]
    near, same = all_pairs(docs)
    assert sorted(found) == sorted(same) and not {x for p in near for x in p} & set(alone)
    for p in pairs.collect():
        found += [(min(a, b), max(a, b)) for a in held[p.class_a] for b in held[p.class_b]]
    assert len(near) > 3 * len(docs)
    assert sorted(found) == sorted(near)


def test_repeated_ids_save_no_copy(spark):
    w = [f"w{k}" for k in range(100)]
    a, near, nearer = " ".join(w), " ".join(w[:-1] + ["x"]), " ".join(w[:-1])
    docs = [(1, a), (3, near), (5, nearer), (5, "something else altogether in here"), (5, "  something else altogether in here "), (1, a), (7, None), (7, None), (7, ""), (8, "short"), (None, a + " z")]
    got = sorted((r.doc_id or 0, (r.text or "").strip()) for r in ngram_join.keep_one(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect())
    assert got == [(0, a + " z"), (5, "something else altogether in here"), (7, ""), (7, ""), (8, "short")]
    got = [(r.doc_id, r.text) for r in ngram_join.keep_one(spark.createDataFrame([(2, a), (2, near), (2, nearer)], "doc_id bigint, text string")).collect()]
    assert len(got) == 1


def test_structured_words(spark):
    from tests.llm.test_shared import thue_morse

    docs = [(1, " ".join([thue_morse(2048)] * 4 + ["u"])), (2, " ".join([thue_morse(2048, "b", "a")] * 4 + ["u"]))]
    assert run(spark, docs) == brute(docs)


def test_keys_of_a_block_cost_little_beside_hashing():
    r = random.Random(4)
    buf = np.frombuffer(" ".join(f"w{r.randrange(10**6)}" for _ in range(400_000)).encode() + b" ", np.uint8)
    starts = np.array([0, len(buf)])

    def least(f):
        took = []
        for _ in range(4):
            began = time.perf_counter()
            f()
            took.append(time.perf_counter() - began)
        return min(took)

    hashing = least(lambda: _text.gram_hashes(_text.run_hashes(_text.lower(buf), *_text.runs(buf, _text.SPACED)), 5))
    assert least(lambda: ngram_join.block_keys(np.array([1]), starts, buf)) < 3 * hashing
    keys = ngram_join.block_keys(np.array([1]), starts, buf)[0]
    assert keys.tolist() == sorted(set(ngram_join.shingle_sets(starts, buf)[1].tolist()))


@pytest.mark.parametrize("sides", [False, True])
def test_sets_run_down_a_trie_together(monkeypatch, sides):
    monkeypatch.setattr(ngram_join, "QUERIES", 50, raising=False)
    calls, plain = [], ngram_join.Trie.partners
    monkeypatch.setattr(ngram_join.Trie, "partners", lambda *a: calls.append(1) or plain(*a))
    r = random.Random(5)
    sets = [np.array(sorted({k if r.random() > p else r.randrange(100, 400) for k in range(60)}), np.uint64) for p in [r.choice([0, 0.03, 0.08, 0.2]) for _ in range(230)]]
    whole = [set(x.tolist()) for x in sets]
    many = {}
    for x in whole:
        for k in x:
            many[k] = many.get(k, 0) + 1
    counts = [np.array([many[k] for k in x.tolist()], np.uint32) for x in sets]
    order = [np.lexsort((x, m)) for x, m in zip(sets, counts, strict=True)]
    across = np.array([r.random() < 0.5 for _ in sets]) if sides else None
    links = list(ngram_join.link_family([len(x) for x in sets], [x[o] for x, o in zip(sets, order, strict=True)], [m[o] for m, o in zip(counts, order, strict=True)], across))
    got = [(min(k, j), max(k, j)) for k, p in links for j in p.tolist()]
    near = [(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(whole[a] & whole[b]) >= 80 * len(whole[a] | whole[b]) and (not sides or across[a] != across[b])]
    assert sorted(got) == sorted(near) and 1000 < len(near)
    asked = int(across.sum()) if sides else len(sets)
    assert len(calls) == -(-asked // 50)
