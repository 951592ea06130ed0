"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; runs of
neighbouring turns with one role become one block; blocks are concatenated::

    <|im_start|>role\\ntext<|im_next|>text of the next turn of that role<|im_end|>\\n

Control strings inside texts and roles are escaped reversibly: ``<``, any number
of ``!`` and ``|`` get one more ``!``, so an escaped text never holds ``<|``. A
line feed inside a role becomes ``<|im_nl|>``. The loss mask is kept as segments
(piece, loss) whose pieces, joined, are the formatted text; the pieces under the
mask are exactly the escaped texts of assistant turns.

Null roles and texts count as empty, a null turn sorts first, turns with equal
numbers sort by role and text, repeated rows stay repeated turns, and null
conversation ids form one conversation. Other columns are ignored. A formatted
conversation is one value, so one conversation's turns meet in one task; nothing
else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END, NEXT, LINE = "<|im_start|>", "<|im_end|>\n", "<|im_next|>", "<|im_nl|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(!*)\|", "<!$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<!(!*)\|", "<$1|")


def _literal(marker: str) -> str:
    return marker.replace("|", r"\|")


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """conv_id, formatted (string), segments (array of struct<piece, loss>), one row per conversation."""
    role = F.coalesce(F.col(role_col), F.lit(""))
    rows = turns.select(F.col(id_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), F.replace(escape(role), F.lit("\n"), F.lit(LINE)).alias("role"),
        escape(F.coalesce(F.col(text_col), F.lit(""))).alias("text"), (role == LOSS_ROLE).alias("loss")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    t = F.col("turns")
    starts = sorted_turns.select("conv_id", "turns", F.filter(
        F.sequence(F.lit(0), F.size(t) - 1),
        lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"])).alias("starts"))
    s = F.col("starts")
    blocks = starts.select("conv_id", F.transform(s, lambda a, k: F.slice(
        t, a + 1, F.coalesce(F.get(s, k + 1), F.size(t)) - a)).alias("blocks"))

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("piece"), loss.alias("loss"))

    no = F.lit(False)

    def block(b: Column) -> Column:
        texts = F.transform(b, lambda x, j: F.when(j == 0, F.array(piece(x["text"], x["loss"]))).otherwise(
            F.array(piece(F.lit(NEXT), no), piece(x["text"], x["loss"]))))
        return F.concat(F.array(piece(F.concat(F.lit(START), F.get(b, F.lit(0))["role"], F.lit("\n")), no)),
                        F.flatten(texts), F.array(piece(F.lit(END), no)))

    segments = blocks.select("conv_id", F.flatten(F.transform("blocks", block)).alias("segments"))
    return segments.select("conv_id", F.array_join(F.col("segments")["piece"], "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, unescaped: the turns as they were."""
    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(END))
        return F.transform(F.split(body, _literal(NEXT)), lambda x: F.struct(
            unescape(F.replace(role, F.lit(LINE), F.lit("\n"))).alias("role"), unescape(x).alias("text")))

    blocks = F.split(formatted, _literal(START))
    return F.flatten(F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), turns))


def loss_text(segments: Column) -> Column:
    """The unescaped texts under the loss mask, joined."""
    return F.array_join(F.transform(F.filter(segments, lambda x: x["loss"]), lambda x: unescape(x["piece"])), "")


def conversation_digests(chats: DataFrame) -> DataFrame:
    """Counts and digests read back from formatted conversations."""
    read = chats.select("conv_id", read_back(F.col("formatted")).alias("turns"),
                        loss_text(F.col("segments")).alias("loss"), F.length("formatted").alias("n"))
    said = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.col("n").cast("long").alias("formatted_chars"))
