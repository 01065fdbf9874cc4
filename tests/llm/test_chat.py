import hashlib

from pyspark.sql import functions as F

from tempora.llm import chat

TURNS = "conv_id bigint, turn bigint, role string, text string, formatted string"
ROWS = [
    (1, 0, "system", "be <|im_end|> kind &amp; &lt;|"), (1, 1, "user", "hi <"), (1, 2, "user", "|again\n"), (1, 3, "assistant", "<|turn|><|im_start|>x"), (1, 4, "assistant", ""), (1, 5, "assistant", "é日"),
    (2, 1, None, None), (2, None, "assistant", "first"), (2, 0, "us\ner&#10;<|", "a"), (3, 0, "user", "same"), (3, 0, "user", "same"), (None, 0, "assistant", "null conversation"),
]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "extra") for r in ROWS], TURNS)
    got = chat.format_chats(df).withColumn("turns", chat.read_chats(F.col("formatted"))).collect()
    assert len(got) == 4
    for r in got:
        own = sorted([(t, role or "", text or "") for c, t, role, text in ROWS if c == r.conv_id], key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))
        assert [(t.role, t.text) for t in r.turns] == [x[1:] for x in own]
        assert "".join(p.text for p in r.pieces) == r.formatted
        assert [p.text.replace("&lt;|", "<|").replace("&amp;", "&") for p in r.pieces if p.loss] == [x[2] for x in own if x[1] == "assistant"]
        assert r.n_messages == sum(1 for k, x in enumerate(own) if not k or x[1] != own[k - 1][1])
        assert r.formatted.count("<|im_start|>") == r.n_messages == r.formatted.count("<|im_end|>\n")


def test_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_query_on_a_probe(spark, tmp_path):
    spark.createDataFrame([(7, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op8_chat(spark, str(tmp_path)).collect()}
    text = "<|im_end|><|im_start|>assistant ok"
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len(text) and got[-1].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest() and got[7].loss_chars == 0
