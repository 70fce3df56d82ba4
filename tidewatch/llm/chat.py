"""Chat formatting by prefix-target expansion: every assistant turn is an example whose context is all turns before it.

The formatted turns of a conversation follow each other as one stream (`format_turns`). `expand` writes out the examples:
each is the stream up to and with one reply, and only this reply is trainable. An example holds its whole context, so the
examples of a conversation grow with the square of its length; they are made in the window that orders the turns and are
never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
SPLIT = r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n"


def escape(text: Column) -> Column:
    """No `<|` is left: one backslash more between `<` and `|`, however many there are already."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    pieces = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_turns(conversations: DataFrame) -> DataFrame:
    """Columns conv_id, position, turn, segment, start, trainable, context_chars, loss_start, loss_end.

    One row for every row of `conversations` (conv_id, turn, role, text): its segment of the conversation's stream and
    where it starts. Rows of role `assistant` are examples: context_chars code points of the stream come before the
    turn, the escaped reply is the range from loss_start to loss_end; other rows have nulls there. Turns are ordered by
    turn, then role, then text; null turns come first, null roles and texts count as empty, null ids are one
    conversation, repeated rows are repeated turns. Extra columns are ignored, an empty table gives an empty result.
    Offsets come from a window that sorts and spills; the turns of a conversation are never gathered into one value.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    body = escape(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        head.alias("head"), body.alias("body"), F.concat(head, body, F.lit(END + "\n")).alias("segment"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("position", F.row_number().over(order)).withColumn(
        "start", F.coalesce(F.sum(F.length("segment").cast("long")).over(before), F.lit(0).cast("long")))
    trainable = F.col("role") == "assistant"
    at = F.col("start") + F.length("head")
    return rows.select("conv_id", "position", "turn", "segment", "start", trainable.alias("trainable"),
                       F.when(trainable, F.col("start")).alias("context_chars"), F.when(trainable, at).alias("loss_start"),
                       F.when(trainable, at + F.length("body")).alias("loss_end"))


def expand(turns: DataFrame) -> DataFrame:
    """Columns conv_id, position, text, loss_start, loss_end, last: the written-out examples of the formatted `turns`.

    One row for every trainable turn: the stream up to and with it, and the range of the reply in that text (code points,
    end exclusive). If a conversation ends in other turns, one more row holds its whole stream, with nulls for the range.
    `last` is true for the longest row of a conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("position")
    rows = turns.withColumns({
        "text": F.array_join(F.collect_list("segment").over(order.rowsBetween(Window.unboundedPreceding, 0)), ""),
        "last": F.lead("position").over(order).isNull()})
    return rows.where(F.col("trainable") | F.col("last")).select("conv_id", "position", "text", "loss_start", "loss_end", "last")


def render(turns: DataFrame, examples: DataFrame) -> DataFrame:
    """Columns conv_id, position, context, reply: the written-out text of the chosen `examples` (conv_id, position of a
    trainable turn) from the formatted `turns`. Grows with the length of the contexts that are asked for."""
    wanted = examples.select(F.col("conv_id").alias("of"), F.col("position").alias("target")).distinct()
    rows = turns.join(wanted, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("position") <= F.col("target")))
    parts = F.array_sort(F.collect_list(F.struct("position", "segment")))
    return (rows.groupBy("of", "target").agg(parts.alias("parts"))
            .select(F.col("of").alias("conv_id"), F.col("target").alias("position"),
                    F.array_join(F.expr("slice(parts.segment, 1, size(parts) - 1)"), "").alias("context"),
                    F.element_at("parts.segment", -1).alias("reply")))


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose texts look like the template's control strings."""
    text = f"{END}{START}assistant ok"
    probe = conversations.sparkSession.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)],
                                                       "conv_id long, turn long, role string, text string")
    return conversations.select(*[F.col(n).cast(t).alias(n) for n, t in probe.dtypes]).unionByName(probe)


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Writes out all examples, then reads back from their texts: the replies under the masks, one from each example, and
    the turns from the longest one."""
    text = F.col("text")
    reply = F.substring(text, F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))
    masked = F.col("loss_start").isNotNull()
    read = expand(format_turns(conversations)).select(
        "conv_id", F.when(masked, F.struct("position", unescape(reply).alias("reply"))).alias("masked"),
        F.when(masked, F.length(text).cast("long")).alias("size"), F.when(F.col("last"), text).alias("stream"))
    whole = read.groupBy("conv_id").agg(
        F.array_sort(F.collect_list("masked")).alias("masked"), F.first("stream", ignorenulls=True).alias("stream"),
        F.count("size").alias("n_examples"), F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("example_chars"))
    said = F.array_join("masked.reply", "")
    roles, texts = (F.regexp_extract_all("stream", F.lit(SPLIT), F.lit(k)) for k in (1, 2))
    told = F.array_join(F.zip_with(roles, texts, lambda role, t: F.concat(unescape_role(role), F.lit("\n"), unescape(t), F.lit("\n"))), "")
    return whole.select("conv_id", F.size(roles).cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                        F.length(said).cast("long").alias("loss_chars"), F.sha2(said, 256).alias("loss_sha256"),
                        F.length("stream").cast("long").alias("formatted_chars"), "n_examples", "example_chars")
