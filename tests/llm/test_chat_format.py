from graphloom.llm.chat_format import CONTROL, format_conversations, loss_text


def test_round_trip_of_conflicting_texts(spark):
    texts = [*CONTROL, "\\", "\\\\", "a\\", "<", "[", "|", "<<s>", "<</s>", "[[INST]", "</s>[INST] ok [/INST]", "", None, "<|/|>x<|a|>", "|||>", "plain", "new\nline", "x" * 20000 + "</s>"]
    rows = []
    for k, t in enumerate(texts):
        for n, role in enumerate(["system", "user", "assistant", "assistant", "tool|>", "", None, "</s>"]):
            rows.append((k, n, role, t, 1, "clash"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, source int, formatted string")
    out = format_conversations(df)
    got = out.withColumn("loss", loss_text(out.formatted, out.loss_spans)).collect()
    assert len(got) == len(texts)
    for r in got:
        want = [(role or "", t or "") for k, _, role, t, _, _ in rows if k == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")
        assert len(r.loss_spans) == 2
    plain = next(r for r in got if texts[r.conv_id] == "plain")
    assert plain.escaped  # the roles conflict
    assert format_conversations(df.limit(0)).collect() == []


def test_plain_text_is_left_alone_and_ties_are_ordered(spark):
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", "s"), (None, 1, "user", "n"), (1, 2, "assistant", "<s> is fine?")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in format_conversations(df).collect()}
    assert got[1].formatted == "<<SYS>>s<</SYS>>[INST]a[/INST][INST]b[/INST]<s><s> is fine?</s>" and not got[1].escaped
    assert got[None].formatted == "[INST]n[/INST]"
