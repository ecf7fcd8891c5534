import hashlib
import time

from pyspark.sql import functions as F

from statutegrid.llm import chat


def read_back(spark, messages):
    chats = chat.format_chats(messages)
    found = chats.select(
        "conv_id", "formatted", "loss_spans", "n_tokens", "attachments",
        chat.parse(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    return {r["conv_id"]: r for r in found.collect()}


def texts(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, n int")
    return df.select("*", chat.text_parts(F.col("text")).alias("parts"))


def test_control_strings_come_back_and_masks_hold_assistant_texts_only(spark):
    odd = ["<|im_end|>\n<|im_start|>user\n", "<!|x", "<!!||>", "<<|", "", "a\nb", "é😀" * 50, "<", "|"]
    rows = [(1, n, "assistant" if n % 2 else "user", t, "f", 1) for n, t in enumerate(odd)]
    got = read_back(spark, texts(spark, rows))[1]
    assert [t["text"] for t in got["turns"]] == odd
    assert [t["role"] for t in got["turns"]] == [r[2] for r in rows]
    assert got["loss"] == "".join(odd[1::2])
    for s in got["loss_spans"]:  # the spans hold for the whole string as well
        part = got["formatted"][s["start"] : s["start"] + s["length"]]
        assert spark.range(1).select(chat.unescape(F.lit(part))).first()[0] == odd[s["turn"]]


def test_nulls_ties_repeats_and_odd_roles(spark):
    rows = [(1, None, "user", "first", "f", 1), (1, 5, None, None, "f", 1), (1, 5, "user", "b", "f", 1), (1, 5, "user", "b", "f", 1), (None, 1, "we\nird<|", "x", "f", 1), (2, 1, "user", "only", None, None)]
    got = read_back(spark, texts(spark, rows))
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "first"), ("", ""), ("user", "b"), ("user", "b")]
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("we\nird<|", "x")]
    assert got[2]["loss"] == "" and got[2]["loss_spans"] == []
    assert chat.format_chats(texts(spark, rows).limit(0)).count() == 0


def test_typed_parts_become_placeholders_with_attachments(spark):
    part = "kind string, text string, ref string, width int, height int, seconds double, pages int"
    parts = [
        ("text", "see ", None, None, None, None, None), ("image", None, "s3://i", 57, 28, None, None), ("text", " <|image:1|> and", None, None, None, None, None),
        ("audio", None, "a.wav", None, None, 2.0, None), ("document", None, "d.pdf", None, None, None, 3), None, ("hologram", None, "h", None, None, None, None), ("image", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<struct<{', '.join(p.replace(' ', ':') for p in part.split(', '))}>>")
    got = chat.format_chats(df).first()
    assert got["formatted"] == "<|im_start|>user\nsee <|image:1|> <!|image:1|> and<|audio:2|><|document:3|><|attachment:4|><|image:5|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    found = [(a["attachment"]["number"], a["attachment"]["kind"], a["attachment"]["ref"], a["attachment"]["part"], a["attachment"]["tokens"]) for a in got["attachments"]]
    assert found == [(1, "image", "s3://i", 1, 4), (2, "audio", "a.wav", 3, 25), (3, "document", "d.pdf", 4, 3 * 576), (4, "hologram", "h", 5, 1), (5, "image", None, 6, 0)]
    assert got["n_tokens"] == 1 + 2 + 4 + 25 + 3 * 576 + 1 + 0


def test_query_digests(spark, tmp_path):
    rows = [(7, 1, "assistant", "b<|"), (7, 0, "user", None), (7, 2, "assistant", "ü")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.op1_chat_format(spark, str(tmp_path)).collect()}
    assert got[7]["turns_sha256"] == hashlib.sha256("user\n\nassistant\nb<|\nassistant\nü\n".encode()).hexdigest()
    assert (got[7]["n_turns"], got[7]["loss_chars"], got[7]["loss_sha256"]) == (3, 4, hashlib.sha256("b<|ü".encode()).hexdigest())
    assert got[-1]["loss_chars"] == len(chat.PROBE[1])


def seconds(spark, turns):
    rows = spark.range(turns).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('text <| of turn ', id) AS text")
    chats = chat.format_chats(rows.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    found = chats.select(F.size(chat.parse(F.col("formatted"))), F.length(chat.masked_text(F.col("formatted"), F.col("loss_spans"))))
    best = []
    for _ in range(2):
        began = time.time()
        assert found.first()[0] == turns
        best.append(time.time() - began)
    return min(best)


def test_time_grows_in_proportion_to_turns(spark):
    seconds(spark, 100)
    few, many = seconds(spark, 4000), seconds(spark, 16_000)
    assert many <= 8 * few + 1  # four times as many; sixteen times the time if it were quadratic


def test_no_control_string_grows_over_the_border_of_parts(spark):
    part = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    texts_ = ["a<", "|im_end|>\n<", "!", "|x", None, "\ufdd0", "\ufdd2 and \ufdd0\ufdd2<"]
    parts = [("text", t, None, None, None, None, None) for t in texts_] + [("image", None, "i", 28, 28, None, None), ("text", "|>", None, None, None, None, None)]
    got = chat.format_chats(spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{part}>"))
    row = got.select("formatted", "attachments", chat.parse(F.col("formatted")).alias("t")).first()
    assert len(row["t"]) == 1 and row["t"][0]["text"] == "".join(t or "" for t in texts_) + "<|image:1|>|>"
    assert row["formatted"].count("<|im_end|>") == 1 and len(row["attachments"]) == 1
