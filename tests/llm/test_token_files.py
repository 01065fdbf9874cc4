import zlib

import numpy as np

from tempora.llm import token_files as tf
from tests.llm import corpus


def brute(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tf.default_tokenizer())
    start, out = 0, []
    for i, text in sorted(docs, key=lambda d: (tf.NO_ID if d[0] is None else d[0], d[1] or "")):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tf.write_and_verify(df).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute(docs)


def test_white_space_and_controls(spark):
    odd = ["a  b", "a   b", " a", "a ", "a  ", "a\n\nb", "a \nb", "a\n b", "\n", " ", "a\tb c", "a b c", "a\r\nb", "<|endoftext|> x", "x<|endoftext|>y", "a\0b c", "it's we'll 12 34a", "a　 b", "é ​ x", "a\n\n\nb", "x \n", "x\n "]
    check(spark, list(enumerate(odd)))


def test_nulls_repeats_and_long_texts(spark, monkeypatch):
    docs = [r[:2] for r in corpus.rows()] + [(None, "null id"), (None, "again"), (5, "repeat"), (5, "repeat"), (70, "word " * 30000)]
    check(spark, docs)


def test_empty_table(spark):
    assert tf.write_and_verify(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_perfect_hash():
    h = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    m = tf.MinimalPerfectHash.build(h)
    assert sorted(m.slots(h).tolist()) == list(range(len(h)))
    again, at = tf.MinimalPerfectHash.load(memoryview(m.dump()))
    assert at == len(m.dump()) and (again.slots(h) == m.slots(h)).all()


def test_strangers_are_told_apart(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id bigint, text string")
    root = tf.write(df, tf.default_tokenizer())
    keys = spark.createDataFrame([(i, 0) for i in range(400, 600)], "key bigint, again bigint")
    assert sorted(r.key for r in tf.look_up(spark, root, keys).collect()) == list(range(400, 500))


def test_structured_words_and_equal_hashes(spark, monkeypatch):
    from tests.llm.test_shared import thue_morse

    docs = [(k, thue_morse(n, *xy)) for k, (n, xy) in enumerate([(1024, "ab"), (1024, "ba"), (2048, "ab"), (2048, "ba"), (4096, "xy"), (4096, "yx")])]
    check(spark, docs)
    encoder = tf.Encoder(tf.default_tokenizer())
    monkeypatch.setattr(tf._text, "run_hashes", lambda buf, a, b: (b - a).astype(np.uint64))  # chunks of one length have one hash
    texts = [t.encode() for t in ("the cat sat on the mat", "a dog ran off and hid", "the cat", thue_morse(64), thue_morse(64, "b", "a"))]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for _ in range(2):
        ids, n = encoder.encode(np.frombuffer(b"".join(texts), np.uint8), starts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [encoder.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in texts]


def test_stores(spark):
    import pytest

    assert tf._open("dbfs:/a/b")[1] == "/dbfs/a/b" and tf._open("file:///x/y")[1] == "/x/y"
    with pytest.raises(ValueError, match="need a folder that pyarrow.fs can write"):
        tf.write(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), tf.default_tokenizer(), root="nowhere://store/x")


def test_a_key_of_many_rows_is_split(spark, monkeypatch):
    monkeypatch.setattr(tf, "FILE_IDS", 200)
    monkeypatch.setattr(tf, "BATCH_BYTES", 300)
    monkeypatch.setattr(tf, "STEP", 7)
    docs = [(9, f"{k} nine nine") for k in range(150)] + [(9, "equal rows " * 3)] * 60 + [(None, f"{k % 5} null") for k in range(90)] + [(k, f"own {k}") for k in range(100, 180)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)
    rows = tf.write_and_verify(df).collect()
    assert sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows], key=lambda r: r[1]) == brute(docs)
    assert sorted(r.occurrence for r in rows if r.doc_id == 9) == list(range(210))
    root = tf.write(df, tf.default_tokenizer())
    files = spark.read.parquet(f"{root}/files").collect()
    assert sum(f.key == 9 for f in files) > 3 and max(f.carried for f in files) > 100 and sum(f.docs for f in files) == len(docs)


def test_executors_write_few_files_through_hadoop(spark, monkeypatch, tmp_path):
    """Without Hadoop's native library each such file starts children of the executor's JVM: their number may not grow with the ranges."""
    from pathlib import Path

    from tempora import staging

    monkeypatch.setattr(staging, "drop_path", lambda *a: None)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in held}
    docs = [(k, f"text {k} of a few words") for k in range(4000)] + [(7, "again")] * 3
    monkeypatch.setattr(staging, "new_path", lambda spark, name: f"file://{tmp_path}/{name}")
    monkeypatch.setattr(tf, "new_path", staging.new_path)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = tf.write_and_verify(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(9))
        out.write.parquet(f"file://{tmp_path}/out")
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got], key=lambda r: r[1]) == brute(docs)
    assert len(list(Path(tmp_path).rglob("data/*.ids"))) > 30 and not list(Path(tmp_path).rglob("tokens*/entries"))
    parts = [p.relative_to(tmp_path).parts[:-1] for p in Path(tmp_path).rglob("part-*.parquet")]
    assert len(parts) < 10, sorted(parts)
