"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role
are merged into one block by an array aggregation, and the blocks are joined to one string:

    ### Role: first message</turn>second message of the same role</turn>\\n
    ### Next role: ...

Backslashes break up every control string inside a role or a text (and stand before every
backslash), so the string can be read back exactly; the loss mask covers the assistant's
messages without marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
OPEN, COLON, CLOSE = "### ", ": ", "</turn>"
ESCAPE = "\\"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    """Reversible: a backslash stands before each backslash and "#" and inside each closing mark, so no control string is left."""
    for mark, safe in ((ESCAPE, ESCAPE * 2), ("#", ESCAPE + "#"), (CLOSE, CLOSE[0] + ESCAPE + CLOSE[1:])):
        text = F.replace(text, F.lit(mark), F.lit(safe))
    return text


def escaped_role(role: Column) -> Column:
    """Like ``escaped``, with a backslash before each colon too, so that a header ends at the first bare one."""
    return F.replace(escaped(role), F.lit(":"), F.lit(ESCAPE + ":"))


def unescaped(text: Column) -> Column:
    """The inverse of ``escaped``: every backslash goes and the character after it stays."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _ordered_turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    turn = F.struct(F.col(turn_col).isNull().alias("none"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.groupBy(F.col(conv_col).alias(conv_col)).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_col, formatted string, n_turns, loss_spans array<struct<start, length>>.

    Turns are sorted by (turn, role, text), so ties and repeated rows have one order and each
    repeated row stays a message of its own; a null turn comes after all others.  A null role or
    text counts as empty; rows of a null conversation form one conversation.  Adjacent messages
    of one role share a header.  Spans count code points of the formatted string and cover the
    escaped text of each assistant message, marks excluded.  An empty table gives no rows;
    further columns are ignored.  A conversation is one row of the result, so its turns meet in
    one task by definition of the format; different conversations spread over all tasks.
    """
    data = _ordered_turns(rows, conv_col, turn_col, role_col, text_col)
    role_at = lambda i: F.get("turns", i)["role"]
    opens = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role_at(i) != role_at(i - 1)))
    data = data.select(conv_col, "turns", F.size("turns").cast("long").alias("n_turns"), opens.alias("opens"))

    def merged(first: Column, k: Column) -> Column:
        upto = F.coalesce(F.get("opens", k + 1), F.size("turns"))
        return F.struct(role_at(first).alias("role"), F.transform(F.slice("turns", first + 1, upto - first),
                                                                  lambda t: escaped(t["text"])).alias("messages"))

    data = data.select(conv_col, "n_turns", F.transform("opens", merged).alias("blocks"))
    block = lambda b: F.concat(F.lit(OPEN), escaped_role(b["role"]), F.lit(COLON), F.array_join(b["messages"], CLOSE), F.lit(CLOSE + "\n"))
    data = data.withColumn("formatted", F.array_join(F.transform("blocks", block), ""))
    # Places of the messages: lengths of all that stands before them, added up over the blocks.
    message = "struct<start: long, length: long>"
    start = F.expr(f"named_struct('at', 0L, 'spans', cast(array() as array<{message}>))")

    def place(state: Column, b: Column) -> Column:
        head = state["at"] + len(OPEN) + F.length(escaped_role(b["role"])) + len(COLON)

        def each(inner: Column, m: Column) -> Column:
            span = F.struct(inner["at"].alias("start"), F.length(m).cast("long").alias("length"))
            return F.struct((inner["at"] + F.length(m) + len(CLOSE)).alias("at"), F.concat(inner["spans"], F.array(span)).alias("spans"))

        walked = F.aggregate(b["messages"], F.struct(head.alias("at"), state["spans"].alias("spans")), each)
        return F.struct((walked["at"] + 1).alias("at"),
                        F.when(b["role"] == ASSISTANT, walked["spans"]).otherwise(state["spans"]).alias("spans"))

    return data.select(conv_col, "formatted", "n_turns", F.aggregate("blocks", start, place)["spans"].alias("loss_spans"))


def read_chats(formatted: DataFrame, formatted_col: str = "formatted", spans_col: str = "loss_spans") -> DataFrame:
    """Read formatted strings back: adds turns array<struct<role, text>> and loss_text (unescaped, nothing between).

    A null string gives null turns; roles and texts may have any length; all other columns stay.
    """
    blocks = F.split(F.col(formatted_col), "\n(?=### )|\n\\z", -1)

    def messages(b: Column) -> Column:
        # The colon that ends a header is the first one without a backslash before it.  Possessive, so that no role is too long for the stack.
        role = F.regexp_extract(b, r"(?s)^### ((?:[^\\:]++|\\.)*+): ", 1)
        body = F.substring(b, F.length(role) + len(OPEN) + len(COLON) + 1, F.length(b))
        parts = F.split(body, CLOSE, -1)
        return F.transform(F.slice(parts, 1, F.size(parts) - 1),
                           lambda m: F.struct(unescaped(role).alias("role"), unescaped(m).alias("text")))

    turns = F.flatten(F.transform(F.filter(blocks, lambda b: b != ""), messages))
    loss = F.array_join(F.transform(F.col(spans_col), lambda s: unescaped(
        F.substring(F.col(formatted_col), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.withColumns({"turns": turns, "loss_text": loss})
