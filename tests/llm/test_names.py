"""Every operator takes tables whose further columns have awkward names, and gives them back unchanged."""

from pyspark.sql import functions as F

from tempora.llm import chat, decontaminate, fingerprint, mixing, ngram_join, quality, substring_dedup, suffix_dedup, token_files, url_filter
from tempora.llm._shared import NO_ID
from tests.llm import corpus

NAMES = ["_size", "_copies", "_id", "_source", "_row", "_score", "_n", "_kept", "_place", "n_words", "n_hit", "items", "score", "fingerprint", "copies", "size", "x.y", "a b", "`q`", "c0", "a0", "n", "s1", "block", "key", "again", "bucket", "pos", "first"]


def awkward(spark):
    df = spark.createDataFrame(corpus.rows(), corpus.DOC)
    return df.select("*", *[(F.col("doc_id") + k).alias(n) for k, n in enumerate(NAMES)])


def same(out, df):
    """The columns of df in out hold for each row what they held."""
    names = out.columns
    for r in out.collect():
        v = dict(zip(names, tuple(r), strict=True))
        for k, n in enumerate(NAMES):
            assert v[f"{n}_input" if f"{n}_input" in v else n] == v["doc_id"] + k
    return names


def test_columns_come_back(spark):
    df = awkward(spark)
    items = spark.createDataFrame(corpus.items(), "item_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[0] % 2) for r in corpus.rows()], "doc_id bigint, quality int")
    assert same(mixing.mix(df), df) == df.columns
    assert same(ngram_join.keep_one(df), df) == df.columns
    assert same(quality.keep(df, labels), df) == df.columns
    assert same(decontaminate.drop_leaks(df, items), df) == df.columns
    leaks = decontaminate.find_leaks(df, items)
    assert {"n_words", "n_words_input", "n_hit_input", "items_input"} <= set(same(leaks, df)) and leaks.where("n_hit > 0").count() > 0
    scored = quality.score(df, quality.fit(df, labels))
    assert {"score", "score_input"} <= set(same(scored, df)) and scored.where("score between 0 and 1").count() == df.count()
    printed = fingerprint.fingerprints(df)
    assert {"fingerprint", "fingerprint_input", "_row"} <= set(same(printed, df)) and printed.where("length(fingerprint) > 0").count() > 0


def test_further_columns_do_not_matter(spark):
    df = awkward(spark)
    few = df.select("doc_id", "text")
    rows = lambda x: sorted(map(repr, x.collect()))
    for f in (suffix_dedup.remove_copies, ngram_join.join_similar, substring_dedup.remove_repeats, token_files.write_and_verify):
        assert rows(f(df)) == rows(f(few))
    turns = spark.createDataFrame([(1, 0, "user", "a", 5), (1, 1, "assistant", "b", 6)], "conv_id bigint, turn bigint, role string, text string, ts bigint")
    assert rows(chat.format_chats(turns)) == rows(chat.format_chats(turns.drop("ts")))
    pages = spark.createDataFrame([(1, "http://a.com/en/1", None, 1, 2)], "page_id bigint, url string, html string, host bigint, verdict bigint")
    assert rows(url_filter.judge(pages)) == rows(url_filter.judge(pages.drop("host", "verdict")))


def test_the_reserved_id_is_null(spark):
    df = spark.createDataFrame([(NO_ID, "a b"), (1, "c d")], "doc_id bigint, text string")
    assert {r.doc_id for r in substring_dedup.remove_repeats(df).collect()} == {None, 1}
