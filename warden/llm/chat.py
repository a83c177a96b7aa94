"""Chat transcripts from event logs: events folded into final messages, messages rendered in a template.

An event log has one row for each event: ``conv_id``, ``seq`` (orders the events of a conversation), ``message`` (the
message the event is about), ``kind``, ``role`` and ``text``. Kinds:

* ``delta`` adds its text to the message;
* ``edit`` sets the message's text to its own; deltas that follow add to it;
* ``regenerate`` takes back what the message has and all messages begun after it; deltas that follow are the new attempt.

The log is dealt out by conversation once; sorting, folding, placing and rendering all happen there, in column
expressions alone. Running values are windows over the sorted log, so an event is looked at a fixed number of times
however long its conversation is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELTA, EDIT, REGENERATE = "delta", "edit", "regenerate"
DELTA_CHARS = 1024  # characters of a delta when turns are made into a log
DRAFT_CHARS = 16  # characters of the draft or first attempt that such a log takes back

# Strings that chat templates and tokenizers in public use take for control.
CONTROL = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>",
    "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>",
    "<|eot_id|>", "<unk>", "<pad>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>",
)


@dataclass(frozen=True)
class Template:
    """How turns are marked. A turn is ``open`` role ``between`` text ``close``; the text of ``learned`` is under the loss mask.

    The three marks have ``<`` or ``[`` at their beginning alone, so none can arise where a text meets a mark.
    """

    open: str = "<|im_start|>"
    between: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    learned: str = "assistant"
    control: tuple[str, ...] = field(default=CONTROL)

    def __post_init__(self):
        marks = (self.open, self.between, self.close)
        for mark in (*marks, *self.control):
            if len(mark) < 2 or mark[0] not in "<[" or "\\" in mark:
                raise ValueError(f"a control string begins with < or [ and has no backslash: {mark!r}")
        for mark in marks:
            if "<" in mark[1:] or "[" in mark[1:]:
                raise ValueError(f"a mark has < or [ at its beginning alone: {mark!r}")

    def escape(self, text: Column) -> Column:
        """The text with backslashes doubled and one put after the first character of every control string."""
        marks = sorted({self.open, self.between, self.close, *self.control})
        heads = "|".join(rf"\{m[0]}(?=\Q{m[1:]}\E)" for m in marks)
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), heads, r"$0\\")

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def events_of_turns(turns: DataFrame) -> DataFrame:
    """The log of a table of turns (conv_id, turn, role, text), with events enough to give the same turns.

    Each turn is streamed in deltas of up to ``DELTA_CHARS`` characters. What an assistant says comes as a second attempt,
    after a first that broke off; what others say was first a draft, then edited. Rows of a conversation are ordered by
    turn (null first), then role and text, so rows that share a turn keep a place each. Null text is empty, null role is
    the empty role, null conv_id is a conversation like others. Columns of other names are left out.
    """
    rows = turns.select(
        turns["conv_id"].cast("bigint").alias("conv_id"), turns["turn"].cast("bigint").alias("turn"),
        F.coalesce(turns["role"].cast("string"), F.lit("")).alias("role"),
        F.coalesce(turns["text"].cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("message", F.row_number().over(order).cast("bigint"))
    parts = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0))  # in one pass over the text

    def event(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    first = event(DELTA, F.substring("text", 1, DRAFT_CHARS))
    again = F.transform(parts, lambda p: event(DELTA, p))
    set_to = event(EDIT, F.coalesce(F.get(parts, F.lit(0)), F.lit("")))
    events = F.when(
        F.col("role") == "assistant", F.concat(F.array(first, event(REGENERATE, F.lit(""))), again)
    ).otherwise(F.concat(F.array(first, set_to), F.slice(again, F.lit(2), F.greatest(F.size(again), F.lit(1)))))
    log = rows.select("conv_id", "message", "role", F.posexplode(events).alias("at", "event"))
    seq = F.struct("message", "at").alias("seq")
    return log.select("conv_id", seq, "message", F.col("event.kind").alias("kind"), "role", F.col("event.text").alias("text"))


def fold(log: DataFrame) -> DataFrame:
    """Final messages of an event log: conv_id, message, started (place of its first event that still counts), role, text.

    ``seq`` and ``message`` can be of any type that sorts. The role is that of the first event that still counts and has
    one; null is the empty role, null text is empty, null conv_id is a conversation like others, null seq comes first.
    Events of other kinds, and events without a message, are left out. Of events that share a seq, regenerations come
    first, then edits, then deltas by text. A message all of whose events were taken back with an earlier one is none.
    """
    rank = F.when(F.col("kind") == REGENERATE, 0).when(F.col("kind") == EDIT, 1).otherwise(2)
    log = log.filter(F.col("kind").isin(DELTA, EDIT, REGENERATE) & F.col("message").isNotNull())
    log = log.select("conv_id", "message", "seq", "kind", "role", rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text"))
    # the one exchange is by conversation: all windows and groups below are inside it
    sequence = Window.partitionBy("conv_id").orderBy("seq", "rank", "text")
    log = log.withColumn("at", F.row_number().over(sequence).cast("bigint")).drop("seq", "rank")
    message = Window.partitionBy("conv_id", "message")
    log = log.withColumn("begun", F.min("at").over(message))
    log = log.withColumn("edited", F.max(F.when(F.col("kind") == EDIT, F.col("at"))).over(message))
    later = Window.partitionBy("conv_id").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("undone", F.min(F.when(F.col("kind") == REGENERATE, F.col("begun"))).over(later))
    counts = (F.col("undone").isNull() | (F.col("begun") < F.col("undone"))) & (
        F.col("edited").isNull() | (F.col("at") >= F.col("edited"))
    )
    role = F.min_by("role", F.when(F.col("role").isNotNull(), F.col("at")))
    said = F.sort_array(F.collect_list(F.when(F.col("kind") != REGENERATE, F.struct("at", "text"))))
    return log.filter(counts).groupBy("conv_id", "message").agg(
        F.min("at").alias("started"), F.coalesce(role, F.lit("")).alias("role"),
        F.array_join(F.transform(said, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, template: Template = Template()) -> DataFrame:
    """One row for each conversation: conv_id, formatted, turns.

    ``turns`` has one entry for each turn, in order: ``start`` (characters before its text), ``skip`` (how many of these are
    its own marks and role), ``length`` (of its text as written) and ``learned``. The loss mask is the texts with ``learned``.
    """
    body = template.escape(F.col("text"))
    head = F.concat(F.lit(template.open), template.escape(F.col("role")), F.lit(template.between))
    parts = messages.select("conv_id", "started", "message", "role", head.alias("head"), body.alias("body"))
    place = Window.partitionBy("conv_id").orderBy("started", "message")
    size = F.length("head") + F.length("body") + len(template.close)
    before = F.sum(size.cast("bigint")).over(place.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(
        "conv_id", "head", "body", (F.col("role") == template.learned).alias("learned"),
        F.row_number().over(place).alias("at"), F.coalesce(before, F.lit(0)).alias("before"),
    )
    mark = F.struct(
        (F.col("before") + F.length("head")).alias("start"), F.length("head").alias("skip"),
        F.length("body").alias("length"), "learned",
    )
    written = F.concat("head", "body", F.lit(template.close))
    rows = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", mark.alias("mark"), written.alias("written")))).alias("rows"))
    return rows.select(
        "conv_id", F.array_join(F.transform("rows", lambda r: r["written"]), "").alias("formatted"),
        F.transform("rows", lambda r: r["mark"]).alias("turns"),
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds what the output alone says: ``read`` (role and text of each turn) and ``loss`` (unescaped texts under the mask)."""
    pieces = F.split("formatted", rf"\Q{template.close}\E", -1)  # no text holds the mark; the last piece is empty

    def turn(piece: Column) -> Column:
        inside = F.split(piece, rf"\Q{template.between}\E", 2)
        role = F.substring(F.get(inside, F.lit(0)), F.lit(len(template.open) + 1), F.length(F.get(inside, F.lit(0))))
        return F.struct(template.unescape(role).alias("role"), template.unescape(F.get(inside, F.lit(1))).alias("text"))

    masked = F.zip_with(
        pieces, "turns",
        lambda p, t: F.when(t["learned"], template.unescape(F.substring(p, t["skip"] + 1, t["length"]))),
    )
    return formatted.withColumn("read", F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)).withColumn(
        "loss", F.filter(masked, lambda x: x.isNotNull())
    )


def with_control_conversation(turns: DataFrame) -> DataFrame:
    """The table and conversation -7, whose two turns say what templates take for control."""
    text = "</s>[INST] ok [/INST]"
    own = turns.sparkSession.range(0, 2, 1, 1).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"),
    )
    return turns.select(*own.columns).unionByName(own)


def formatted_digests(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Turns to a log, folded, rendered and read back: counts and digests of each conversation, all from the output.

    Columns conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars, loss_sha256,
    formatted_chars. A conversation becomes one text, so it must fit into a cell (2 GB) and its task's memory.
    """
    done = read_back(render(fold(events_of_turns(turns)), template), template)
    told = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("loss", "")
    return done.select(
        "conv_id", F.size("read").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length(learned).cast("bigint").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
