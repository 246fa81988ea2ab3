r"""Chat formatting: one training example for each assistant turn.

A turn is written ``<|im_start|>role\ntext<|im_end|>\n``. A backslash keeps control strings in
roles and texts from being read as such: it is put inside each of them and before every
backslash, so taking one backslash from each pair ``\x`` gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of common templates (fixed values): each is broken after its first sign.
CONTROL = r"(?<=<)(?=\|[A-Za-z_]+\|>|/?s>|</?SYS>>)|(?<=\[)(?=/?INST\])"
TURN = r"(?s)<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|im_end\|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\|" + CONTROL, r"\\$0")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def rendered(role: Column, text: Column) -> Column:
    """One turn; a line break in a role gets a backslash, so that the first bare one ends it."""
    head = F.regexp_replace(escaped(role), "\n", "\\\\\n")
    return F.concat(F.lit(START), head, F.lit("\n"), escaped(text), F.lit(END + "\n"))


def chat_examples(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    replies: str = "assistant",
) -> DataFrame:
    """Explode every assistant turn into its own example.

    Returns ``conv_id``, ``example`` (0, 1, ...), ``n_turns`` (turns in the example), ``text``
    (all turns before the reply, then the reply), ``loss_start`` and ``loss_length``: the code
    points of ``text``, counted from 0, that are trained on. They cover the reply's own text
    and nothing else. Turns behind the last reply make one more example with nothing
    to train on (``loss_length`` missing), so the output holds every turn of the input.

    Turns are ordered by number, then role, then text; missing numbers come first. Missing
    roles and texts are empty. Repeated rows are turns of their own. Rows without a
    conversation id make up one conversation without an id. Other columns are not looked at.

    A conversation is a row here, as it is in the output: each example holds all that went
    before. The prefixes are cut one by one after the explode and never held together.
    """
    whole = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("_turn"),
    ).groupBy("conv_id").agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    # array_sort puts structs with a missing number first and compares the rest by field.
    is_reply = F.transform("_turns", lambda t: t["role"] == replies)
    ends = F.filter(
        F.transform(is_reply, lambda yes, i: F.when(yes, i + 1)), lambda i: i.isNotNull()
    )
    n = F.size("_turns")
    ends = F.when(
        F.coalesce(F.element_at("_turns", -1)["role"] == replies, F.lit(False)), ends
    ).otherwise(F.concat(ends, F.array(n)))
    blocks = F.transform("_turns", lambda t: rendered(t["role"], t["text"]))
    # Turns are written once for each conversation, below the explode.
    written = whole.select("conv_id", "_turns", blocks.alias("_blocks"), ends.alias("_ends"))
    cut = written.select(
        "conv_id", "_turns", "_blocks", F.posexplode("_ends").alias("example", "_end")
    )
    last = F.element_at("_turns", F.col("_end"))
    full = F.array_join(F.slice("_blocks", 1, F.col("_end")), "")
    length = F.when(last["role"] == replies, F.length(escaped(last["text"])))
    return cut.select(
        "conv_id",
        "example",
        F.col("_end").alias("n_turns"),
        full.alias("text"),
        (F.length(full) - F.lit(len(END) + 1) - length).alias("loss_start"),
        length.alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Conversations read from formatted examples alone: turns and trained text, unescaped.

    Returns ``conv_id``, ``turns`` (array of role and text), ``loss`` (all text under the loss
    masks, in order) and ``formatted_chars`` (code points of all examples).
    """
    masked = F.expr("substring(text, loss_start + 1, loss_length)")
    parts = examples.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(F.struct("example", unescaped(masked).alias("loss")))
        ).alias("_parts"),
        F.max_by("text", "example").alias("_all"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    heads = F.regexp_extract_all("_all", F.lit(TURN), F.lit(1))
    texts = F.regexp_extract_all("_all", F.lit(TURN), F.lit(2))
    turns = F.zip_with(
        heads,
        texts,
        lambda h, t: F.struct(unescaped(h).alias("role"), unescaped(t).alias("text")),
    )
    loss = F.array_join(F.transform("_parts", lambda p: F.coalesce(p["loss"], F.lit(""))), "")
    return parts.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted_chars")
