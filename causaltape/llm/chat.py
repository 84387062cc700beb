"""Chat formatting with typed content parts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Tokens that one unit of an attachment stands for: a tile of an image, a second of audio, a page of a document.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 800}
PART = "struct<kind:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    """A backslash goes before each backslash and between < and |, so no control string is left in the text."""
    return F.regexp_replace(text, r"(\\|(?<=<)\|)", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """Content of one text part."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), none.cast("string").alias("ref"), none.cast("bigint").alias("units"))).cast(f"array<{PART}>")


def visit(part: Column) -> Column:
    """One part flattened: escaped text, or the placeholder of its kind; a part of another kind leaves nothing."""
    kinds = [F.when(part.kind == k, F.lit(f"<|{k}|>")) for k in TOKENS_PER_UNIT]
    return F.coalesce(F.when(part.kind == "text", escape(F.coalesce(part.text, F.lit("")))), *kinds, F.lit(""))


def attachment(part: Column) -> Column:
    per = F.coalesce(*[F.when(part.kind == k, F.lit(n)) for k, n in TOKENS_PER_UNIT.items()])
    return F.struct(part.kind.alias("kind"), part.ref.alias("ref"), (F.coalesce(part.units, F.lit(1)) * per).cast("bigint").alias("tokens"))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """Rows (conv_id, formatted, mask, attachments, attachment_tokens), one per conversation.

    Each turn becomes START role SEP content END and a newline; control strings inside roles and texts are escaped
    reversibly. `parts` is an array of (kind, text, ref, units); its image, audio and document parts leave ordered
    placeholders, the k-th of which is attachments[k] with the tokens it expands to. `mask` has one entry per turn:
    (skip, take) code points, where the taken ones are an assistant's content and nothing else.

    Rows go by turn, ties by role and then content; null turns come first; a null role counts as empty, null text as
    empty, null or empty parts as no content. Rows of a null conversation id form one conversation; repeated rows are
    repeated turns; an empty table gives an empty result; other columns are ignored. A conversation is one string and
    so one row; the rows of different conversations spread over tasks by their id.
    """
    flat = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.array_join(F.transform(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), visit), "").alias("content"),
            F.transform(F.filter(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), lambda p: p.kind.isin(*TOKENS_PER_UNIT)), attachment).alias("attached"),
        ).alias("t"),
    )
    whole = flat.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escape(t.role), F.lit(SEP))
    mask = lambda t: F.struct(F.length(head(t)).alias("skip"), F.when(t.role == "assistant", F.length(t.content)).otherwise(0).alias("take"))
    attachments = F.flatten(F.transform("turns", lambda t: t.attached))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), t.content, F.lit(END + "\n"))), "").alias("formatted"),
        F.transform("turns", mask).alias("mask"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("bigint"), lambda n, a: n + a.tokens).alias("attachment_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """`format_conversations`' rows with turns (role, text) and the unescaped text under the loss mask, both taken
    from the formatted string and the mask alone."""
    parted = F.split("formatted", r"<\|im_start\|>")
    segments = F.slice(parted, F.lit(2), F.size(parted))
    body = lambda s: F.substring_index(s, END, 1)
    turn = lambda s: F.struct(unescape(F.substring_index(s, SEP, 1)).alias("role"), unescape(F.split(body(s), r"<\|im_sep\|>", 2)[1]).alias("text"))
    taken = F.zip_with(segments, F.col("mask"), lambda s, m: unescape(F.substr(s, m.skip - len(START) + 1, m["take"])))
    return formatted.select("*", F.transform(segments, turn).alias("turns"), F.array_join(taken, "").alias("loss_text"))
