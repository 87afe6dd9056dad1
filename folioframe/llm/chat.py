"""Chat formatting by a visitor over typed content parts (DataFrame functions only).

`format_chat` takes rows of turns. A turn's content is an array of parts (type, text, uri, units); a plain text column
counts as one text part. The visitor flattens the parts in order: a text part adds its escaped text; an image, audio or
document part adds a placeholder `<#type:k:tokens#>` and an attachment (k, type, uri, tokens), where k counts the
attachments of the conversation from 1 and tokens = ceil(units * TOKENS_PER_UNIT[type]).

Template: each turn is `<|role|>` newline, body, `<|/|>` newline. Every control string begins with `<`, and escaping
leaves no `<` in a text: `~`, `<` and `|` become `~0`, `~1` and `~2`, which `unescape` reverses in the order 2, 1, 0.

Loss mask: `runs`, one a turn: `skip` characters without loss since the last run's end, then `take` characters of the
body, under the loss where `loss` is true (assistant turns). Absolute spans follow by a running sum. Lengths are code
points.

Cases: null role or text counts as empty; a null array of parts, too; an unknown part type is written as its text.
Turns go by (turn, role, text), nulls first, so repeated turn numbers have a fixed order. A null conv_id is a
conversation of its own. Extra columns are ignored; an empty table gives no rows. One conversation is one output row,
so the turns of a conversation meet in one task, already formatted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens that one unit of an attachment takes: image tiles, seconds of audio, document pages.
TOKENS_PER_UNIT = {"image": 256.0, "audio": 25.0, "document": 512.0}
PART = "struct<type:string,text:string,uri:string,units:double>"
LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    for plain, code in (("~", "~0"), ("<", "~1"), ("|", "~2")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in (("|", "~2"), ("<", "~1"), ("~", "~0")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def text_part(text: Column) -> Column:
    """A text column as typed content."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("double").alias("units")))


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*TOKENS_PER_UNIT), F.lit(False))


def _tokens(part: Column) -> Column:
    rate = F.lit(0.0)
    for kind, per in TOKENS_PER_UNIT.items():
        rate = F.when(part["type"] == kind, F.lit(per)).otherwise(rate)
    return F.ceil(F.coalesce(part["units"], F.lit(1.0)) * rate).cast("bigint")


def format_chat(df: DataFrame, parts: str | None = None) -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, runs, attachments, n_attachment_tokens."""
    content = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")) if parts else text_part(F.col("text"))
    text = F.col("text") if "text" in df.columns else F.lit(None).cast("string")
    turns = df.select(
        F.col("conv_id").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        text.alias("key_text"),
        content.alias("parts"),
    )
    # Each row is visited before the shuffle; only the ordinals of attachments wait for the whole conversation.
    visited = turns.select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            "key_text",
            F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n")).alias("head"),
            F.transform("parts", lambda p: F.when(_is_attachment(p), F.lit("")).otherwise(escape(F.coalesce(p["text"], F.lit(""))))).alias("bits"),
            F.transform("parts", lambda p: F.struct(_is_attachment(p).alias("is"), p["type"].alias("type"), p["uri"].alias("uri"), F.when(_is_attachment(p), _tokens(p)).otherwise(F.lit(0).cast("bigint")).alias("tokens"))).alias("refs"),
            F.size(F.filter("parts", _is_attachment)).alias("n_refs"),
        ).alias("t"),
    )
    grouped = visited.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    refs = F.filter(F.flatten(F.col("ts.refs")), lambda r: r["is"])
    known = grouped.withColumn("refs", refs).withColumn(
        "attachments",
        F.transform("refs", lambda r, i: F.struct((i + 1).alias("k"), r["type"].alias("type"), r["uri"].alias("uri"), r["tokens"].alias("tokens"))),
    )
    # A turn's first ordinal is the number of attachments before it; without any, the sums are not needed.
    before = F.when(
        F.size("refs") > 0,
        F.transform(F.sequence(F.lit(1), F.size("ts")), lambda i: F.aggregate(F.slice(F.col("ts.n_refs"), F.lit(1), i - 1), F.lit(0), lambda a, x: a + x)),
    ).otherwise(F.transform("ts", lambda t: F.lit(0)))

    def body(t: Column, start: Column) -> Column:
        def bit(text_bit: Column, i: Column) -> Column:
            ref = t["refs"][i]
            ordinal = start + F.size(F.filter(F.slice(t["refs"], F.lit(1), i + 1), lambda r: r["is"]))
            mark = F.concat(F.lit("<#"), ref["type"], F.lit(":"), ordinal.cast("string"), F.lit(":"), ref["tokens"].cast("string"), F.lit("#>"))
            return F.when(ref["is"], mark).otherwise(text_bit)

        return F.concat_ws("", F.transform(t["bits"], bit))

    turns_out = F.zip_with(
        "ts",
        before,
        lambda t, b: F.struct(t["head"].alias("head"), body(t, b).alias("body"), (t["role"] == LOSS_ROLE).alias("loss")),
    )
    tail = F.lit("<|/|>\n")
    return (
        known.withColumn("out", turns_out)
        .select(
            "conv_id",
            F.size("ts").cast("bigint").alias("n_turns"),
            F.concat_ws("", F.transform("out", lambda o: F.concat(o["head"], o["body"], tail))).alias("formatted"),
            F.transform(
                "out",
                lambda o, i: F.struct(
                    (F.char_length(o["head"]) + F.when(i == 0, F.lit(0)).otherwise(F.lit(6))).alias("skip"),
                    F.char_length(o["body"]).alias("take"),
                    o["loss"].alias("loss"),
                ),
            ).alias("runs"),
            "attachments",
            F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]).alias("n_attachment_tokens"),
        )
    )


def read_chat(formatted: DataFrame) -> DataFrame:
    """The turns and the text under the loss mask, read back from `formatted` and `runs` alone: conv_id, n_turns,
    turns array<struct<role, text>>, loss_texts array<string>, formatted_chars. Placeholders stay in the texts."""
    pieces = F.filter(F.split(F.col("formatted"), r"<\|"), lambda p: (p != "") & ~p.startswith("/|>"))
    turn = F.transform(pieces, lambda p: F.struct(F.substring_index(p, "|>", 1).alias("role"), F.substr(p, F.instr(p, "|>\n") + F.lit(3)).alias("body")))
    masked = F.zip_with("pieces", "runs", lambda p, r: F.when(r["loss"], F.when(F.char_length(p["body"]) == r["take"], p["body"]).otherwise(F.raise_error(F.lit("loss mask and text disagree")).cast("string"))))
    return (
        formatted.withColumn("pieces", turn)
        .withColumn("masked", F.filter(masked, lambda x: x.isNotNull()))
        .select(
            "conv_id",
            F.size("pieces").cast("bigint").alias("n_turns"),
            F.transform("pieces", lambda p: F.struct(unescape(p["role"]).alias("role"), unescape(p["body"]).alias("text"))).alias("turns"),
            F.transform("masked", unescape).alias("loss_texts"),
            F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        )
    )
