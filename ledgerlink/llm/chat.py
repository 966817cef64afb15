"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar (fixed values; an opening mark with ``~`` says that its text is escaped):

    conversation := turn*
    turn         := "[INST]" text "[/INST]"                       user
                  | "<s>" text "</s>"                             assistant
                  | "<<SYS>>" text "<</SYS>>"                     system
                  | "[ROLE]" role "[TEXT]" text "[/ROLE]"         any other role

A text ends at the first closing mark of its turn.  Each turn is rendered
plainly and parsed again; where what is recovered isn't the source, its content
is escaped (``~`` to ``~0``, ``<`` to ``~1``, ``[`` to ``~2``), after which it
can't hold any mark, and parsed once more.  Whole conversations are parsed again
too, and one that differed would be an error.

Defined cases: null texts and null roles count as empty (an empty role is one of
the "other" roles); rows of a conversation are ordered by turn (null first),
then role, then text, and repeated rows are turns each; rows with a null
conv_id form one conversation; an empty table gives no rows; other columns are
ignored.  A conversation becomes one string, so it must fit in one (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlink.llm.common import stored

#: role -> opening mark, opening mark of an escaped text, closing mark (fixed values).
MARKS = {
    "user": ("[INST]", "[INST~]", "[/INST]"),
    "assistant": ("<s>", "<s~>", "</s>"),
    "system": ("<<SYS>>", "<<SYS~>>", "<</SYS>>"),
}
OTHER = ("[ROLE]", "[ROLE~]", "[TEXT]", "[/ROLE]")

TURN = (r"(?s)\[INST~?\].*?\[/INST\]|<s~?>.*?</s>|<<SYS~?>>.*?<</SYS>>|\[ROLE~?\].*?\[TEXT\].*?\[/ROLE\]")


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1")), F.lit("["), F.lit("~2"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~2"), F.lit("[")), F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def _rendered(role: Column, text: Column, escaped: bool) -> Column:
    t, r = (escape(text), escape(role)) if escaped else (text, role)
    out = F.concat(F.lit(OTHER[escaped]), r, F.lit(OTHER[2]), t, F.lit(OTHER[3]))
    for name, marks in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(marks[escaped]), t, F.lit(marks[2]))).otherwise(out)
    return out


def _inside(s: Column, start: Column | int, tail: int) -> Column:
    """``s`` without its first ``start`` - 1 and last ``tail`` characters."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.substr(s, start, F.char_length(s) - start + 1 - tail)


def parse_turn(segment: Column) -> Column:
    """Struct (role, text) of one rendered turn."""
    def of(escaped: bool, role: Column, text: Column) -> Column:
        return F.struct((unescape(role) if escaped else role).alias("role"), (unescape(text) if escaped else text).alias("text"))

    out = None
    for escaped in (False, True):
        head = len(OTHER[escaped])
        mark = F.instr(segment, OTHER[2])
        other = of(escaped, F.substr(segment, F.lit(head + 1), mark - head - 1), _inside(segment, mark + len(OTHER[2]), len(OTHER[3])))
        here = F.startswith(segment, F.lit(OTHER[escaped]))
        out = F.when(here, other) if out is None else out.when(here, other)
        for name, marks in MARKS.items():
            out = out.when(F.startswith(segment, F.lit(marks[escaped])), of(escaped, F.lit(name), _inside(segment, len(marks[escaped]) + 1, len(marks[2]))))
    return out


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, in order."""
    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), parse_turn)


def _survives(rendered: Column, role: Column, text: Column) -> Column:
    """Parsing ``rendered`` gives exactly this turn."""
    segments = F.regexp_extract_all(rendered, F.lit(TURN), F.lit(0))
    turn = parse_turn(rendered)
    return (F.size(segments) == 1) & (F.element_at(segments, 1) == rendered) & (turn["role"] == role) & (turn["text"] == text)


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, rendered, escaped: each turn with the first rendering
    that survives its parser."""
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")
    rows = rows.withColumn("plain", _rendered(role, text, False)).withColumn("escaped", ~_survives(F.col("plain"), role, text))
    rows = rows.withColumn("rendered", F.when(F.col("escaped"), _rendered(role, text, True)).otherwise(F.col("plain"))).drop("plain")
    safe = ~F.col("escaped") | _survives(F.col("rendered"), role, text)
    return rows.withColumn("rendered", F.when(safe, F.col("rendered")).otherwise(F.raise_error(F.lit("a turn can't be recovered from its rendering"))))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: one row a conversation.

    ``loss`` has an entry for each turn: where its rendering begins in
    ``formatted``, and start and length of the text that the loss counts (the
    assistant's), null for other turns.  One exchange, by conversation.
    """
    order = ["turn", "role", "text"]
    before = W.partitionBy("conv_id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    turns = format_turns(conversations).withColumn("begin", F.coalesce(F.sum(F.char_length("rendered")).over(before), F.lit(0)))
    opened, closed = F.when(F.col("escaped"), len(MARKS["assistant"][1])).otherwise(len(MARKS["assistant"][0])), len(MARKS["assistant"][2])
    loss = F.when(F.col("role") == "assistant", F.struct((F.col("begin") + opened).alias("start"), (F.char_length("rendered") - opened - closed).cast("long").alias("length")))
    entry = F.struct("turn", "role", "text", "rendered", F.col("begin").alias("begin"), loss.alias("span"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("turns"))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    out = whole.select("conv_id", source.alias("source"), F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"),
                       F.transform("turns", lambda t: F.struct(t["begin"].alias("begin"), t["span"]["start"].alias("start"), t["span"]["length"].alias("length"))).alias("loss"))
    same = parse(F.col("formatted")) == F.col("source")
    return out.select("conv_id", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation can't be recovered from its text"))).alias("formatted"), "loss")


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped.  The spans are read from the segments
    they lie in, so the work is linear in the text."""
    def part(segment: Column, m: Column) -> Column:
        raw = F.substr(segment, (m["start"] - m["begin"] + 1).cast("int"), m["length"].cast("int"))
        escaped = F.startswith(segment, F.lit(MARKS["assistant"][1]))
        return F.when(m["length"].isNull(), F.lit("")).when(escaped, unescape(raw)).otherwise(raw)

    return F.array_join(F.zip_with(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), loss, part), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    rows = formatted.withColumn("turns", parse(F.col("formatted"))).withColumn("learned", loss_text(F.col("formatted"), F.col("loss")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def write_formatted(conversations: DataFrame) -> DataFrame:
    """The formatted conversations written as Parquet and read back."""
    return stored(format_conversations(conversations), "chat")
