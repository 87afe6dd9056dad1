from folioframe.llm import chat

PARTS = "array<struct<type:string,text:string,uri:string,units:double>>"
SCHEMA = f"conv_id bigint, turn bigint, role string, text string, formatted string, parts {PARTS}"


def turn(conv, n, role, text, parts=None):
    return (conv, n, role, text, "clash", parts)


ROWS = [
    turn(1, 1, "assistant", "a|b <|/|> ~0 ~~1 <#image:1:9#>"),
    turn(1, 0, "user", "</s>[INST] ok [/INST]"),
    turn(1, 2, "user", None),
    turn(1, 3, "assistant", ""),
    turn(2, 0, None, "no role"),
    turn(2, None, "we|ird <role>~", "null turn"),
    turn(3, 0, "assistant", "x" * 100_000),
    turn(3, 0, "assistant", "tie"),
    turn(3, 0, "assistant", "tie"),
    turn(None, 0, "assistant", "no id 😀"),
]


def read(df, parts=None):
    formatted = chat.format_chat(df, parts)
    return {r.conv_id: r for r in formatted.collect()}, {r.conv_id: r for r in chat.read_chat(formatted).collect()}


def test_round_trip(spark):
    made, got = read(spark.createDataFrame(ROWS, SCHEMA))
    order = lambda r: (r[1] is not None, r[1], r[2] or "", r[3] is not None, r[3])
    for conv in (1, 2, 3, None):
        rows = sorted((r for r in ROWS if r[0] == conv), key=lambda r: (r[1] if r[1] is not None else -1, r[2] or "", r[3] or ""))
        assert order(rows[0])
        assert [(t.role, t.text) for t in got[conv].turns] == [(r[2] or "", r[3] or "") for r in rows]
        assert got[conv].loss_texts == [r[3] or "" for r in rows if r[2] == "assistant"]
        assert got[conv].n_turns == len(rows) and got[conv].formatted_chars == len(made[conv].formatted)
    assert made[1].formatted.startswith("<|user|>\n~1/s>[INST] ok [/INST]<|/|>\n<|assistant|>\na~2b ~1~2/~2> ~00 ~0~01 ")


def test_mask_spans_hold_the_assistant_texts(spark):
    made, got = read(spark.createDataFrame(ROWS, SCHEMA))
    for conv, m in made.items():
        at, texts = 0, []
        for run in m.runs:
            at += run.skip
            if run.loss:
                texts.append(m.formatted[at : at + run.take].replace("~2", "|").replace("~1", "<").replace("~0", "~"))
            at += run.take
        assert texts == got[conv].loss_texts


def test_attachments(spark):
    part = lambda kind, text=None, uri=None, units=None: (kind, text, uri, units)
    rows = [
        turn(1, 0, "user", None, [part("text", "see <"), part("image", None, "i1", 2.0), part("text", " and "), part("audio", None, "a1", 1.5)]),
        turn(1, 1, "assistant", None, [part("document", None, "d1"), part("odd", "as text"), part(None, None)]),
        turn(2, 0, "user", None, None),
    ]
    made, got = read(spark.createDataFrame(rows, SCHEMA), "parts")
    assert made[1].formatted == "<|user|>\nsee ~1<#image:1:512#> and <#audio:2:38#><|/|>\n<|assistant|>\n<#document:3:512#>as text<|/|>\n"
    assert [(a.k, a.type, a.uri, a.tokens) for a in made[1].attachments] == [(1, "image", "i1", 512), (2, "audio", "a1", 38), (3, "document", "d1", 512)]
    assert made[1].n_attachment_tokens == 1062 and got[1].loss_texts == ["<#document:3:512#>as text"]
    assert made[2].attachments == [] and got[2].turns[0].text == ""


def test_empty(spark):
    assert chat.read_chat(chat.format_chat(spark.createDataFrame([], SCHEMA))).collect() == []
