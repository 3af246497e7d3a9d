"""Chat formatting by relational operations (Spark expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: a block is OPEN role (SAY or LEARN) text (PART text)* CLOSE.
#: LEARN stands before text under the loss mask, SAY before other text.
OPEN, SAY, LEARN, PART, CLOSE = "<s>", "[INST]", "[/INST]", "[PART]", "</s>"

_CONTROL = r"(?s)([<\[])(s>|/s>|INST\]|/INST\]|PART\])"


def escape(text: Column) -> Column:
    """Double each backslash, then put one behind the first character of control strings."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    """The inverse: a backslash stands for the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv, formatted): each conversation as one string.

    Turns are sorted by number, nulls first, ties by role, then text. Adjacent
    turns of a role become one block whose parts stay apart by PART. Null roles
    and texts count as empty; rows with a null conversation form one conversation.
    Repeated rows are turns of their own. A conversation's result is one string,
    so its turns meet in one row; nothing else is gathered.
    """
    turn = F.struct(F.col(turn_col).alias("n"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    learn = lambda role: F.when(role.isin(*loss_roles), LEARN).otherwise(SAY) if loss_roles else F.lit(SAY)

    def piece(t: Column, i: Column) -> Column:
        before = F.get("turns", i - 1)["role"]
        head = F.concat(F.when(i > 0, CLOSE).otherwise(""), F.lit(OPEN), escape(t["role"]), learn(t["role"]))
        return F.concat(F.when((i > 0) & (before == t["role"]), PART).otherwise(head), escape(t["text"]))

    return (
        turns.select(F.col(conv_col).alias("conv"), turn.alias("t"))
        .groupBy("conv")
        .agg(F.array_sort(F.collect_list("t")).alias("turns"))
        .select(F.col("conv").alias(conv_col), F.concat(F.array_join(F.transform("turns", piece), ""), F.lit(CLOSE)).alias("formatted"))
    )


def read_chats(formatted: Column) -> Column:
    """array<struct<role, text, loss>>: the turns that a formatted string holds."""
    blocks = F.filter(F.split(formatted, CLOSE.replace("/", "\\/")), lambda b: b != "")
    one = r"(?s)^<s>(.*?)(\[/?INST\])(.*)$"
    parts = lambda b: F.transform(
        F.split(F.regexp_extract(b, one, 3), r"\[PART\]"),
        lambda t: F.struct(unescape(F.regexp_extract(b, one, 1)).alias("role"), unescape(t).alias("text"), (F.regexp_extract(b, one, 2) == LEARN).alias("loss")),
    )
    return F.flatten(F.transform(blocks, parts))


def chat_digest(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What op4 returns, read back from formatted strings."""
    turns = chats.select(F.col(conv_col).alias("conv_id"), read_chats(F.col("formatted")).alias("t"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("t", lambda t: t["loss"]), lambda t: t["text"]), "")
    return turns.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
