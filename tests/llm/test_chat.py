"""Chat formatting: reversible escapes, typed parts, masks."""

from pyspark.sql import functions as F

from helixframe.llm import chat

NASTY = ["", "</s>", r"<\/s>", r"<\\/s>", "[INST] x [/INST]", "<s><s>", "<image>", r"\ [\INST]", "<</s>", "é🙂</s>\n",
         "[", "<", "text <", "</s", "[/INST"]


def test_escape_is_reversible_and_hides_control_strings(spark):
    df = spark.createDataFrame([(x,) for x in NASTY], "t string")
    rows = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    for r in rows:
        assert r.u == r.t
        assert not any(c[0] + c[1:] in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]", "<image>"))


def test_round_trip_of_turns_and_mask(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)]
    rows += [(2, 0, None, None), (2, 0, None, None), (None, 0, "assistant", "x"), (2, None, "</s>", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(df.withColumn("parts", chat.text_part(F.col("text"))))
    got = {r.conv_id: r for r in out.select(
        "conv_id", "formatted", chat.parse_turns(F.col("formatted")).alias("turns"),
        chat.masked_texts(F.encode("formatted", "UTF-8"), F.col("loss_spans")).alias("texts")).collect()}
    assert [(t.role, t.body) for t in got[1].turns] == [(r, t) for _, _, r, t in rows[:len(NASTY)]]
    assert got[1].texts == [t for i, t in enumerate(NASTY) if i % 2]
    assert [(t.role, t.body) for t in got[2].turns] == [("</s>", "first"), ("", ""), ("", "")]
    assert got[None].texts == ["x"]


def test_parts_become_placeholders_in_order(spark):
    parts = [("text", "look ", None, None), ("image", None, "a.png", 196.0), ("text", "<image>", None, None),
             ("audio", None, "b.wav", 2.0), ("pdf", None, "c.pdf", 2.0), (None, "end", None, None)]
    df = spark.createDataFrame([(7, 0, "user", parts), (7, 1, "user", None), (8, 0, "user", [])], "conv_id long, "
                               "turn long, role string, "
                               "parts array<struct<kind:string,text:string,ref:string,amount:double>>")
    got = {r.conv_id: r for r in chat.format_chat(df).collect()}
    assert got[7].formatted == (r"<s>[INST]user[/INST]look <image><\image><audio><document>end</s>"
                                "<s>[INST]user[/INST]</s>")
    assert [(a.turn_index, a.part, a.kind, a.ref, a.n_tokens) for a in got[7].attachments] == [
        (0, 1, "image", "a.png", 196), (0, 3, "audio", "b.wav", 25), (0, 4, "document", "c.pdf", 1200)]
    assert (got[7].expanded_tokens, got[8].expanded_tokens, got[8].attachments) == (1421, 0, [])


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chat(df.withColumn("parts", chat.text_part(F.col("text")))).count() == 0
