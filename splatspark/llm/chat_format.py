r"""Chat formatting from an event log, in DataFrame functions only.

Events (conv_id, message, seq, kind, role, text) are dealt by conversation and message and folded in the order of seq:

* ``open`` names the role of a message and may bring its first text,
* ``delta`` appends, ``edit`` replaces all text so far, ``regenerate`` drops it,
* ``delete`` takes the message away.

The text of a message is what follows its last ``edit`` or ``regenerate``, so the fold is one pass over a sorted array.
Messages are put in the order of their first event and rendered:

    ### role: text</turn>\n

Control strings in texts and roles are written reversibly: ``\`` as ``\\``, ``</turn>`` as ``\e``, ``###`` as ``\h``, and in
roles ``:`` as ``\c``. The output comes with the spans of the assistant's texts (the loss mask), in code
points of the formatted string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END, HEAD = "### ", "</turn>", "###"
ASSISTANT = "assistant"


def _replace(x: Column, old: str, new: str) -> Column:
    return F.replace(x, F.lit(old), F.lit(new))


def escaped(x: Column, role: bool = False) -> Column:
    x = _replace(_replace(_replace(x, "\\", "\\\\"), END, "\\e"), HEAD, "\\h")
    return _replace(x, ":", "\\c") if role else x


def unescaped(x: Column, role: bool = False) -> Column:
    """Pairs of backslashes are read from the left; what lies between them holds no other backslash but of a mark."""

    def marks(part: Column) -> Column:
        part = _replace(_replace(part, "\\e", END), "\\h", HEAD)
        return _replace(part, "\\c", ":") if role else part

    return F.array_join(F.transform(F.split(x, "\\\\\\\\", -1), marks), "\\")


def folded(events: DataFrame) -> DataFrame:
    """(conv_id, message, first_seq, role, text) of every message that is not deleted.

    Events of one seq are folded in the order of kind and text. A null text is empty, a null role is empty,
    an unknown kind raises.
    """
    kinds = ("delete", "delta", "edit", "open", "regenerate")
    kind = F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("kind of event: "), F.coalesce("kind", F.lit("null")))))
    rows = events.select("conv_id", "message", F.struct("seq", kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role")).alias("e"))
    log = rows.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list("e")).alias("log"))
    numbered = F.transform("log", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i + 1))
    since = F.greatest(F.lit(1), F.coalesce(F.array_max(numbered), F.lit(1)))
    rest = F.slice("log", since, F.size("log"))
    text = F.array_join(F.transform(rest, lambda e: F.when(e["kind"].isin("open", "delta", "edit"), e["text"]).otherwise("")), "")
    role = F.coalesce(F.element_at(F.filter("log", lambda e: e["kind"] == "open"), 1)["role"], F.lit(""))
    found = log.where(~F.exists("log", lambda e: e["kind"] == "delete"))
    opened = F.when(F.exists("log", lambda e: e["kind"] == "open"), role).otherwise(F.lit(""))
    return found.select("conv_id", "message", F.element_at("log", 1)["seq"].alias("first_seq"), opened.alias("role"), text.alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): loss_spans has the place (from 0) and length of each assistant text."""
    turn = F.struct("first_seq", "role", "text", "message")
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(TURN), escaped(t["role"], role=True), F.lit(": ")).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == ASSISTANT).alias("loss")
        ),
    )
    turns = turns.select("conv_id", pieces.alias("pieces"))
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    tail = len(END) + 1
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<at:bigint,length:bigint>>").alias("spans"))
    walk = F.aggregate(
        "pieces",
        start,
        lambda s, p: F.struct(
            (s["at"] + F.char_length(p["head"]) + F.char_length(p["body"]) + tail).cast("bigint").alias("at"),
            F.when(
                p["loss"],
                F.concat(s["spans"], F.array(F.struct((s["at"] + F.char_length(p["head"])).cast("bigint").alias("at"), F.char_length(p["body"]).cast("bigint").alias("length")))),
            ).otherwise(s["spans"]).alias("spans"),
        ),
    )
    return turns.select("conv_id", formatted.alias("formatted"), walk["spans"].alias("loss_spans"))


def parsed(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    parts = F.split(formatted, END + "\n", -1)
    turns = F.slice(parts, 1, F.size(parts) - 1)
    colon = lambda x: F.instr(x, F.lit(": "))
    return F.transform(
        turns,
        lambda x: F.struct(
            unescaped(F.substring(x, F.lit(len(TURN) + 1), colon(x) - len(TURN) - 1), role=True).alias("role"),
            unescaped(F.substring(x, colon(x) + 2, F.char_length(x))).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, s["at"].cast("int") + 1, s["length"].cast("int")))), "")


def events_of_rows(conversations: DataFrame) -> DataFrame:
    """Event log of a table of whole turns (conv_id, turn, role, text), as a client would have sent it: each turn is opened, streamed wrongly, regenerated,
    streamed in two halves with the first one edited between, and some turns come with another message that is deleted. What is left
    of the log is the table.

    Rows of one turn are messages of their own, ordered by role and text; a null turn comes first.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    half = (F.char_length(text) / 2).cast("int")
    first, rest = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.char_length(text))
    base = F.coalesce(F.col("turn").cast("bigint"), F.lit(-(1 << 40))) * 16
    none = F.lit(None).cast("string")
    role = F.col("role").cast("string")

    def event(n: int, kind: str, x: Column = none, of: Column = none, message: Column = F.col("message")) -> Column:
        return F.struct(message.alias("message"), (base + n).alias("seq"), F.lit(kind).alias("kind"), of.alias("role"), x.alias("text"))

    log = [event(0, "open", of=role), event(1, "delta", rest), event(2, "regenerate"), event(3, "delta", first), event(4, "delta", F.lit("?")), event(5, "edit", first), event(6, "delta", rest)]
    gone = -1 - F.col("message")
    deleted = [event(7, "open", first, role, gone), event(8, "delta", rest, message=gone), event(9, "delete", message=gone)]
    some = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) == 0
    numbered = conversations.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("message"))
    rows = numbered.select("conv_id", F.explode(F.when(some, F.array(*log, *deleted)).otherwise(F.array(*log))).alias("e"))
    return rows.select("conv_id", "e.message", "e.seq", "e.kind", "e.role", "e.text")


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of a table of turns. Rows with a null conv_id are one conversation; null texts and roles are empty;
    repeated rows are turns each; an empty table gives none; other columns are not read. A conversation is one value of the output, so it is
    put together in one task, however long it is."""
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    return rendered(folded(events_of_rows(rows)))


def digests(conversations: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    out = formatted_conversations(conversations).withColumn("turns", parsed(F.col("formatted")))
    out = out.withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


#: The conversation that every digest includes: its texts hold control strings of the template.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"

ORACLE = r"""
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '\e'), '###', '\h') AS body,
  replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\e'), '###', '\h'), ':', '\c') AS head FROM c),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
  CAST(sum(length(head) + length(body) + 14) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
