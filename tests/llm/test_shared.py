import random

import numpy as np
import pyarrow as pa
import pytest

from tempora.llm import _exchange, _text
from tempora.llm._components import components
from tempora.llm._shared import discard, stage


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_components_against_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(300, 300 + i) for i in range(1, 50)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_staged_tables_go_when_discarded(spark):
    df = stage(spark.range(5), "five")
    path = df.inputFiles()[0].removeprefix("file:")
    import os

    assert os.path.exists(path)
    discard(df, spark.range(1))
    assert not os.path.exists(path)


def test_packed_keys_round_trip():
    r = np.random.default_rng(4)
    for n in (1, 2, 1000):
        u = np.unique(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        ids = r.integers(-5, 5, len(u)) * 10**15
        a, b, _ = _exchange._decode(_exchange._encode(u, ids), True)
        assert (a == u).all() and (b == ids).all()
        assert (_exchange._decode(_exchange._encode(u, None), False)[0] == u).all()
        tag = r.integers(0, 2**24, len(u)).astype(np.uint32)
        a, b, c = _exchange._decode(_exchange._encode(u, ids, tag), True, True)
        assert (a == u).all() and (b == ids).all() and (c == tag).all()


def thue_morse(n, x="a", y="b"):
    return "".join(y if bin(k).count("1") % 2 else x for k in range(n))


def test_word_hashes_do_not_hang_on_place_or_length(monkeypatch):
    text = ("alpha beta gamma alpha ünï " * 50 + "x" * 300 + " " + "x" * 300).encode()
    buf = np.frombuffer(text, np.uint8)
    a, b = _text.runs(buf, _text.SPACED)
    h = _text.run_hashes(buf, a, b)
    assert len(set(h.tolist())) == 5 and h[-1] == h[-2] and (h[5:250] == h[:245]).all()
    monkeypatch.setattr(_text, "LONG", 100)
    long = _text.run_hashes(buf, a, b)
    assert (long[:-2] == h[:-2]).all() and long[-1] == long[-2] != h[-1]
    g = _text.gram_hashes(h, 3)
    assert len(g) == len(h) - 2 and (g[5:245] == g[:240]).all() and len(_text.gram_hashes(h[:2], 3)) == 0


@pytest.mark.parametrize("n", [8, 64, 1024, 2048, 4096])
def test_structured_words_do_not_collide(n):
    buf = np.frombuffer(f"{thue_morse(n)} {thue_morse(n, 'b', 'a')} {'a' * n} {'a' * (n - 1)}b".encode(), np.uint8)
    assert len(set(_text.run_hashes(buf, *_text.runs(buf, _text.SPACED)).tolist())) == 4


def test_equal_runs(monkeypatch):
    r = random.Random(3)
    words = ["".join(r.choice("ab") for _ in range(r.choice([0, 1, 7, 8, 9, 17, 40]))) for _ in range(400)]
    buf = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    at = ends - [len(w) for w in words]
    i, j = np.array([r.randrange(400) for _ in range(9000)]), np.array([r.randrange(400) for _ in range(9000)])
    keep = np.array([len(words[a]) == len(words[b]) for a, b in zip(i, j)])
    i, j = i[keep], j[keep]
    exp = [words[a] == words[b] for a, b in zip(i, j)]
    for long in (2048, 10):
        monkeypatch.setattr(_text, "LONG", long)
        assert _text.equal_runs(buf, at[i], buf, at[j], (ends - at)[i]).tolist() == exp
    assert 0 < sum(exp) < len(exp)


@pytest.mark.parametrize("crowded", [False, True])
@pytest.mark.parametrize("kind", ["presence", "earlier", "counts"])
def test_two_hops_answer_like_one(spark, monkeypatch, kind, crowded):
    """Answers equal plain counting; crowded: keys of few values, told apart by their tags."""
    r = random.Random(11)
    docs = [(r.randrange(300) if r.random() < 0.9 else None, " ".join(r.choices([f"w{k}" for k in range(4000)] + ["the"] * 300, k=40))) for _ in range(400)]
    blocks = _exchange.pack_blocks(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6), "doc_id", "text", 900)
    assert blocks.count() > 80

    def keys(ids, starts, buf):
        a, b = _text.runs(buf, _text.SPACED)
        h, doc = _text.run_hashes(buf, a, b), np.searchsorted(starts, a, "right") - 1
        tag = (h >> np.uint64(40)).astype(np.uint32) if crowded else np.zeros(len(h), np.uint32)
        h = _text.mix(h % np.uint64(40)) if crowded else h
        order = np.lexsort((ids[doc], tag, h))
        h, tag, doc = h[order], tag[order], doc[order]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (tag[1:] != tag[:-1])]))
        n = np.diff(np.append(new, len(h)))
        return h[new], (n if kind == "counts" else ids[doc[new]]), tag[new]

    def told(block, ids, starts, buf, answer_to):
        u, value, tag = keys(ids, starts, buf)
        return pa.table({"block": [block] * len(u), "key": u.view(np.int64), "tag": tag.astype(np.int64), "value": value.astype(np.int64), "answer": answer_to(u).astype(np.int64)})

    options, got = {"earlier": kind == "earlier", "counts": kind == "counts"}, []
    for fan, batch in ((4096, 4096), (5, 7), (5, 10**6)):
        monkeypatch.setattr(_exchange, "FAN", fan)
        monkeypatch.setattr(_exchange, "BATCH", batch)
        given = _exchange.answers(blocks, keys, 60, tagged=crowded, **options)
        got.append(sorted(map(tuple, _exchange.with_answers(blocks, stage(given, "a"), 60, told, "block bigint, key bigint, tag bigint, value bigint, answer bigint", counts=kind == "counts").collect())))
    assert got[0] == got[1] == got[2] and len({x[-1] for x in got[0]}) > 1
    per = {}
    for _, k, t, v, _ in got[0]:
        per.setdefault((k, t), []).append(v)
    for _, k, t, v, answer in got[0]:
        own = per[k, t]
        assert answer == (sum(own) if kind == "counts" else v > min(own) if kind == "earlier" else len(own) > 1)
