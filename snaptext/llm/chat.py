"""Chat formatting of messages whose content is a list of typed parts.

A conversation becomes one string. Each turn is

    <|turn|>role<|text|>content<|end|>

and a part of its content is text or an attachment, shown as ``<|image|>``, ``<|audio|>`` or
``<|document|>``. The k-th placeholder of a conversation stands for the k-th of its ``attachments``,
which carry the reference and the number of tokens that the placeholder expands to.

Control strings inside roles and texts are escaped by one backslash after their first character, or one
more if there are some already, so that none is left and taking one away gives the text back.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ATTACHMENTS = ("image", "audio", "document")
#: What follows the first character of a control string, of this template and of other common ones.
_FIRST = r"[<\[]"
_REST = r"\||/?s>|/?INST\]|/?SYS>"
#: Tokens per attachment: square patches of an image, frames of audio, pages of a document.
PATCH, PATCH_TOKENS = 28, 1
TOKENS_PER_SECOND = 25
TOKENS_PER_PAGE = 800

PART = (
    "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({_FIRST})(\\*)({_REST})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({_FIRST})\\(\\*)({_REST})", "$1$2$3")


def text_part(text: Column) -> Column:
    """A list of one text part."""
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *empty))


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder stands for; at least 1, 0 for text. Unknown sizes count as the least."""
    patches = F.ceil(F.coalesce(part["width"], F.lit(1)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(1)) / PATCH) * PATCH_TOKENS
    n = (
        F.when(part["kind"] == "image", patches)
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * TOKENS_PER_SECOND))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(1)) * TOKENS_PER_PAGE)
    )
    return F.when(part["kind"].isin(*ATTACHMENTS), F.greatest(n, F.lit(1))).otherwise(F.lit(0)).cast("long")


def _visited(parts: Column) -> Column:
    """What parts put into the string. A kind not known, or null, is treated as text.

    Texts side by side are one text before anything is escaped, so that no control string comes out of two of them.
    """
    is_text = lambda p: ~F.coalesce(p["kind"].isin(*ATTACHMENTS), F.lit(False))
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))

    def visit(seen: Column, part: Column) -> Column:
        longer = F.struct(seen["done"].alias("done"), F.concat(seen["open"], F.coalesce(part["text"], F.lit(""))).alias("open"))
        closed = F.struct(F.concat(seen["done"], escape(seen["open"]), F.lit("<|"), part["kind"], F.lit("|>")).alias("done"), F.lit("").alias("open"))
        return F.when(is_text(part), longer).otherwise(closed)

    return F.aggregate(parts, start, visit, lambda seen: F.concat(seen["done"], escape(seen["open"])))


def format_chats(messages: DataFrame, loss_roles: Iterable[str] = ("assistant",)) -> DataFrame:
    """One row per conversation of (``conv_id``, ``turn``, ``role``, ``parts``).

    Returns ``conv_id``, ``formatted``, ``loss_spans`` (start and end in code points of each content of a
    loss role), ``attachments`` (slot, turn, kind, ref, tokens; in order) and ``expanded_tokens`` (their sum).
    Turns are sorted by ``turn``, nulls first, then by role and content, so that ties and repeated rows
    have one order; repeated rows are repeated turns. A null role is an empty one, null parts are none.
    Rows with a null ``conv_id`` make up one conversation. An empty table gives no rows.
    """
    turn = messages.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    shown = turn.select(
        "conv_id",
        "turn",
        "role",
        head.alias("head"),
        _visited(F.col("parts")).alias("content"),
        F.transform(
            F.filter("parts", lambda p: p["kind"].isin(*ATTACHMENTS)),
            lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")),
        ).alias("attached"),
    )
    # Where a turn starts follows from the turns before it: running sums, then one row per conversation
    # on the same partitioning.
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "content").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("content") + len(END)
    placed = shown.select(
        "*",
        F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0)).alias("start"),
        F.coalesce(F.sum(F.size("attached").cast("long")).over(before), F.lit(0)).alias("slots"),
    )
    from_, to = F.col("start") + F.length("head"), F.col("start") + F.length("head") + F.length("content")
    turns = placed.select(
        "conv_id",
        F.struct(
            "start",
            F.concat("head", "content", F.lit(END)).alias("shown"),
            F.when(F.col("role").isin(*loss_roles), F.struct(from_.alias("start"), to.alias("end"))).alias("loss"),
            F.transform(
                "attached",
                lambda a, i: F.struct((F.col("slots") + i + 1).alias("slot"), F.col("turn").cast("long").alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")),
            ).alias("attached"),
        ).alias("t"),
    )
    # Sorting by start is sorting by turn: no turn is empty.
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), lambda a, b: F.signum(a["start"] - b["start"]).cast("int")).alias("t"))
    return grouped.select(
        "conv_id",
        F.array_join("t.shown", "").alias("formatted"),
        F.filter("t.loss", lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten("t.attached").alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) of a formatted string, unescaped; placeholders of attachments stay in the text."""
    turns = F.filter(F.split(formatted, r"<\|turn\|>"), lambda t: t != "")
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring_index(t, TEXT, 1)).alias("role"),
            unescape(F.regexp_replace(F.substring_index(t, TEXT, -1), r"<\|end\|>$", "")).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""
    )
