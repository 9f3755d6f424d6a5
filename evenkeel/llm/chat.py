"""Chat formatting whose output a deterministic parser reads back to the same turns.

Grammar of one formatted conversation (``turn*``)::

    user       <s>[INST] text [/INST]</s>
    system     <s><<SYS>>\\ntext\\n<</SYS>></s>
    assistant  <s>text</s>
    other      <s>[ROLE hex-of-role] text</s>

A conversation is first rendered as it is, parsed, and compared with its turns. Where they differ, the control strings
inside its texts get a backslash after their first character (control strings that carry backslashes already get one
more, so the step can be undone) and the comparison is made again; a conversation that still differs fails the job.
The parser accepts no bare control string inside a text, so formatted texts never hold one.

Only DataFrame functions are used. Rows are shuffled once, by conversation.

Cases: NULL text is an empty text, NULL role an empty role; rows are ordered by (turn, role, text) with NULL first, so
ties and repeated rows all stay; a NULL conv_id is a conversation; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
#: Text before and after the body, by role. Any other role is written out in hex.
FRAMES = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>\n", "\n<</SYS>>"), "assistant": ("", "")}
#: What follows the first character of a control string.
_REST = r"(/?INST\]|/?s>|</?SYS>>|ROLE )"
CONTROL = r"([\[<])" + _REST
GUARDED = r"([\[<])(\\*)" + _REST
_UNGUARD = r"([\[<])\\(\\*)" + _REST


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, GUARDED, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _UNGUARD, "$1$2$3")


def _head(role: Column) -> Column:
    out = F.concat(F.lit("[ROLE "), F.lower(F.hex(F.encode(role, "UTF-8"))), F.lit("] "))
    for name, (head, _) in FRAMES.items():
        out = F.when(role == name, F.lit(head)).otherwise(out)
    return F.concat(F.lit(OPEN), out)


def _tail(role: Column) -> Column:
    out = F.lit("")
    for name, (_, tail) in FRAMES.items():
        out = F.when(role == name, F.lit(tail)).otherwise(out)
    return F.concat(out, F.lit(CLOSE))


def _framed(block: Column, role: str) -> tuple[Column, Column]:
    """Whether a block has the frame of a role, and the body inside it."""
    head, tail = FRAMES[role]
    head = OPEN + head
    fits = (
        block.startswith(head)
        & block.endswith(tail)
        & (F.length(block) >= len(head) + len(tail))
    )
    return fits, F.substr(block, F.lit(len(head) + 1), F.length(block) - len(head) - len(tail))


def _turn(block: Column) -> Column:
    """Parse one block (without its closing mark) to (role, text); NULL text where it breaks the grammar."""
    is_user, user = _framed(block, "user")
    is_system, system = _framed(block, "system")
    is_plain, plain = _framed(block, "assistant")
    named = OPEN + "[ROLE "
    code = F.regexp_extract(block, r"^<s>\[ROLE ([0-9a-f]*)\] ", 1)
    role = (
        F.when(is_user, F.lit("user"))
        .when(is_system, F.lit("system"))
        .when(block.startswith(named), F.decode(F.unhex(code), "UTF-8"))
        .otherwise(F.lit("assistant"))
    )
    body = (
        F.when(is_user, user)
        .when(is_system, system)
        .when(block.startswith(named), F.substr(block, F.length(code) + len(named) + 3, F.length(block)))
        .when(is_plain, plain)
    )
    text = F.when(~F.regexp_like(body, F.lit(CONTROL)), unescaped(body))
    return F.struct(role.alias("role"), text.alias("text"))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    blocks = F.split(formatted, CLOSE)
    return F.transform(F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0))), _turn)


def formatted(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, layout, escapes.

    ``layout`` has one entry per turn, in order: where its block starts in ``formatted`` and how long it is, and the
    span under the loss mask (``loss_start``, ``loss_length``; length 0 for other turns than the assistant's). Spans
    count code points from 0. ``escapes`` is true where control strings had to be escaped.
    """
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    plain, safe = F.col("text"), escaped(F.col("text"))
    before = F.length(_head(F.col("role")))
    around = before + F.length(_tail(F.col("role")))
    rows = rows.withColumn("safe", F.when(F.regexp_like("text", F.lit(GUARDED)), safe).otherwise(plain))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)

    def layout(text: str) -> Column:
        size = around + F.length(text)
        offset = F.coalesce(F.sum(size).over(earlier), F.lit(0))
        spoken = F.col("role") == "assistant"
        return F.struct(
            offset.alias("start"),
            size.alias("length"),
            (offset + before).alias("loss_start"),
            F.when(spoken, F.length(text)).otherwise(F.lit(0)).alias("loss_length"),
        )

    rows = rows.withColumns({"as_is": layout("text"), "as_safe": layout("safe")})
    whole = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "safe", "as_is", "as_safe"))).alias("t")
    )

    def rendered(field: str) -> Column:
        return F.array_join(
            F.transform("t", lambda x: F.concat(_head(x["role"]), x[field], _tail(x["role"]))), ""
        )

    source = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    same = parsed(F.col("formatted")) == F.col("source")
    # The first rendering; where it reads back differently, the second; each is compared with the source.
    first = whole.select("conv_id", "t", rendered("text").alias("formatted"), source.alias("source"))
    first = first.withColumn("escapes", ~same)
    second = first.withColumn("formatted", F.when(F.col("escapes"), rendered("safe")).otherwise(F.col("formatted")))
    checked = F.when(~F.col("escapes") | same, F.col("formatted")).otherwise(
        F.raise_error(F.lit("a formatted conversation does not read back to its turns"))
    )
    return second.select(
        "conv_id",
        checked.alias("formatted"),
        F.when(F.col("escapes"), F.transform("t", lambda x: x["as_safe"]))
        .otherwise(F.transform("t", lambda x: x["as_is"]))
        .alias("layout"),
        "escapes",
    )


def loss_text(formatted: Column, layout: Column) -> Column:
    """The text under the loss mask, unescaped, with nothing between its spans. Linear in the conversation's length."""
    pieces = F.zip_with(
        F.slice(F.split(formatted, CLOSE), 1, F.greatest(F.size(layout), F.lit(0))),
        layout,
        lambda block, at: unescaped(
            F.substr(block, (at["loss_start"] - at["start"] + 1).cast("int"), at["loss_length"].cast("int"))
        ),
    )
    return F.array_join(pieces, "")


def digest(conversations: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    read = formatted(conversations).select(
        "conv_id",
        "formatted",
        parsed(F.col("formatted")).alias("turns"),
        loss_text(F.col("formatted"), F.col("layout")).alias("loss"),
    )
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
