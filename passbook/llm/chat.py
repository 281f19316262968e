"""Conversations rebuilt from event logs and rendered as training text, with DataFrame functions only.

An event log holds, per conversation and in order of ``seq``: ``message`` (a turn with its role and
text), ``delta`` (text appended to a turn), ``edit`` (new text for a turn) and ``regenerate`` (a turn
starts again empty, or with the event's text); each names its message by turn and slot. ``as_log`` makes
such a log of finished turns: some come at once, some streamed in deltas, some as a draft that is
regenerated, some with errors that are edited. Folding is associative, so logs are folded in pieces of
256 sequence numbers first and the pieces afterwards; a long conversation is rendered in segments of 64
turns before anything is gathered by conversation.

A turn is rendered as ``[role]``, a line break, the text, ``</s>`` and a line break, after ``<s>`` at the
start of the conversation. Inside texts and roles ``~``, ``<`` and ``[`` become ``~t``, ``~l`` and ``~b``
(line breaks in roles ``~n``), so no control string can occur there and the output can be read back.
The loss mask covers the texts of assistant turns.

Defined results: a null text or role is empty; rows of one turn number stand in order of role and text,
repeated rows are repeated turns; a null turn number comes first; rows with a null conversation id form
one conversation with a null id; an empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>\n"
MARKS = (("~", "~t"), ("<", "~l"), ("[", "~b"))
LOG_PIECE_BITS, SEGMENT_BITS = 8, 6
DELTAS = 8  # most deltas a streamed text is cut into
ASSISTANT = "assistant"
# The conversation that shows control strings inside texts.
SHOWN_ID, SHOWN_TEXT = -7, "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    for plain, mark in MARKS:
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    for plain, mark in reversed(MARKS):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def as_events(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as an event log; ``slot`` tells rows of one turn number apart."""
    turns = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    slot = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    return turns.select("conv_id", "turn", slot.alias("slot"), F.coalesce("turn", F.lit(0)).alias("seq"), F.lit("message").alias("kind"), "role", "text")


def as_log(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log in which a turn is up to 18 events.

    Which story a turn has follows from a hash of its row. ``seq`` holds the turn above 20 bits of step
    numbers, so it orders the log of a conversation (turns below 2**43) and always the events of a message.
    """
    rows = as_events(turns)
    size = F.greatest(F.ceil(F.length("text") / DELTAS), F.lit(1)).cast("int")
    event = lambda kind, text, role=None: F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("role") if role is None else role.alias("role"), text.alias("text"))
    whole, wrong, nothing = F.col("text"), F.reverse("text"), F.lit("")
    pieces = lambda text: F.transform(F.sequence(F.lit(0), F.lit(DELTAS - 1)), lambda i: event("delta", F.substring(text, i * size + 1, size)))
    message = lambda text: F.array(event("message", text, F.col("role")))
    story = F.pmod(F.xxhash64("conv_id", "turn", "slot", "text"), F.lit(4))
    events = (
        F.when(story == 0, message(whole))
        .when(story == 1, F.concat(message(nothing), pieces(whole)))
        .when(story == 2, F.concat(message(nothing), pieces(wrong), F.array(event("regenerate", nothing)), pieces(whole)))
        .otherwise(F.concat(message(wrong), F.array(event("delta", F.lit("…")), event("edit", F.upper(whole)), event("edit", whole))))
    )
    log = rows.select("conv_id", "turn", "slot", F.posexplode(F.filter(events, lambda e: (e["kind"] != "delta") | (e["text"] != ""))).alias("step", "event"))
    seq = F.shiftleft(F.coalesce("turn", F.lit(0)), 20) + F.col("step")
    return log.select("conv_id", "turn", "slot", seq.alias("seq"), "event.kind", "event.role", "event.text")


def _fold(log: str) -> list[Column]:
    """reset, role and text of a sorted array of (.., reset, role, text): what follows the last reset."""
    last = F.array_max(F.transform(log, lambda x, i: F.when(x["reset"], i).otherwise(-1)))
    after = F.slice(log, F.greatest(last, F.lit(0)) + 1, F.size(log))
    named = F.filter(log, lambda x: x["role"].isNotNull())
    return [
        (last >= 0).alias("reset"),
        F.try_element_at(named, F.lit(-1))["role"].alias("role"),
        F.array_join(F.transform(after, lambda x: x["text"]), "").alias("text"),
    ]


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, slot, role, text) of a log (conv_id, turn, slot, seq, kind, role, text)."""
    keys = ["conv_id", "turn", "slot"]
    entry = F.struct(
        "seq", F.col("kind").isin("message", "edit", "regenerate").alias("reset"),
        F.when(F.col("kind") == "message", F.coalesce("role", F.lit(""))).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    pieces = events.groupBy(*keys, F.shiftright("seq", LOG_PIECE_BITS).alias("piece")).agg(F.sort_array(F.collect_list(entry)).alias("log"))
    pieces = pieces.select(*keys, "piece", *_fold("log"))
    logs = pieces.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("piece", "reset", "role", "text"))).alias("log"))
    folded = logs.select(*keys, *_fold("log")).drop("reset")
    return folded.withColumn("role", F.coalesce("role", F.lit("")))


def segments(messages: DataFrame) -> DataFrame:
    """(conv_id, segment, text, loss): rendered runs of turns and the spans (start, length) under the loss mask."""
    head = F.concat(F.lit("["), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("~n")), F.lit("]\n"))
    body = escape(F.col("text"))
    turn = F.struct(
        "turn", "slot", F.concat(head, body, F.lit(END)).alias("text"), F.length(head).cast("bigint").alias("head"),
        F.length(body).cast("bigint").alias("body"), (F.col("role") == ASSISTANT).alias("loss"),
    )
    rows = messages.groupBy("conv_id", F.shiftright("turn", SEGMENT_BITS).alias("segment")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    placed = F.aggregate(
        "turns", F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["head"] + x["body"] + len(END)).alias("at"),
            F.when(x["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["head"]).alias("start"), x["body"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return rows.select("conv_id", "segment", F.array_join(F.transform("turns", lambda x: x["text"]), "").alias("text"), placed.alias("loss"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): the whole text of each conversation and its loss spans in code points."""
    part = F.struct("segment", "text", F.length("text").cast("bigint").alias("size"), "loss")
    rows = segments(messages).groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    moved = F.aggregate(
        "parts", F.struct(F.lit(len(BEGIN)).cast("bigint").alias("at"), none.alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["size"]).alias("at"),
            F.concat(acc["spans"], F.transform(x["loss"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["length"].alias("length")))).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return rows.select("conv_id", F.concat(F.lit(BEGIN), F.array_join(F.transform("parts", lambda x: x["text"]), "")).alias("formatted"), moved.alias("loss"))


def read_turns(text: Column) -> Column:
    """The turns (role, text) that a rendered run of turns holds."""
    parts = F.split(text, "</s>\n")
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)
    line = lambda x: F.instr(x, F.lit("\n"))
    return F.transform(
        whole, lambda x: F.struct(
            unescape(F.replace(F.substring(x, F.lit(2), line(x) - 3), F.lit("~n"), F.lit("\n"))).alias("role"),
            unescape(F.substring(x, line(x) + 1, F.length(x))).alias("text"),
        ),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from rendered segments."""
    read = rendered.select(
        "conv_id", "segment", F.length("text").cast("bigint").alias("size"), read_turns(F.col("text")).alias("turns"),
        F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "").alias("loss"),
    )
    part = F.struct(
        "segment", F.size("turns").cast("bigint").alias("n"), "size", "loss",
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
    )
    rows = read.select("conv_id", part.alias("part")).groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    text = lambda field: F.array_join(F.transform("parts", lambda x: x[field]), "")
    total = lambda field: F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, x: a + x[field])
    return rows.select(
        "conv_id", total("n").alias("n_turns"), F.sha2(text("said"), 256).alias("turns_sha256"),
        F.length(text("loss")).cast("bigint").alias("loss_chars"), F.sha2(text("loss"), 256).alias("loss_sha256"),
        (total("size") + len(BEGIN)).alias("formatted_chars"),
    )


def with_shown(turns: DataFrame) -> DataFrame:
    shown = turns.sparkSession.range(2).select(
        F.lit(SHOWN_ID).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(SHOWN_TEXT).alias("text"),
    )
    return turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").unionAll(shown)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = with_shown(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return read_back(segments(reconstruct(as_log(turns))))


OP5_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {SHOWN_ID}, 0, 'user', '{SHOWN_TEXT}' UNION ALL SELECT {SHOWN_ID}, 1, '{ASSISTANT}', '{SHOWN_TEXT}'
), m AS (
  SELECT *, replace(replace(replace(role, '~', '~t'), '<', '~l'), '[', '~b') AS er,
         replace(replace(replace(text, '~', '~t'), '<', '~l'), '[', '~b') AS et FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{ASSISTANT}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{ASSISTANT}'), '')) AS loss_sha256,
       CAST({len(BEGIN)} + sum(length(replace(er, chr(10), '~n')) + length(et) + 3 + {len(END)}) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
