"""Chat formatting from event logs. Native: DataFrame expressions only.

A log holds events (conv_id, seq, turn, kind, role, text). Kinds: `message`,
`edit` and `regenerate` set the text of a turn anew; `delta` adds to it; `delete`
removes the turn. Folding gives final messages, rendering one string with a loss
mask per conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template: START role newline text END.
START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common templates, and what stands for them inside texts. A
#: backslash comes first, so that afterwards every backslash begins a code.
CODES = (("\\", "\\b"), ("<|", "\\l"), ("|>", "\\r"), ("<s>", "\\s"), ("</s>", "\\e"), ("[INST]", "\\i"), ("[/INST]", "\\j"), ("<<SYS>>", "\\y"), ("<</SYS>>", "\\z"))
LINE = ("\n", "\\n")


def escaped(text: Column, codes=CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, codes=CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages of an event log.

    The events of a turn apply in order of seq; events that agree in every field
    are one event delivered twice, others of the same seq apply in order of kind,
    role and text. A turn's text is what its last message, edit or regeneration
    set, with the deltas after that; its role is the last one given. A null text
    is empty, a null kind a message, a null conv_id or turn a value of its own.
    Turns are folded apart from each other, so a long conversation is spread out.
    """
    fields = F.struct("seq", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    log = events.groupBy("conv_id", "turn").agg(F.array_sort(F.array_distinct(F.collect_list(fields))).alias("log"))
    sets = F.filter(F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i)), lambda i: i.isNotNull())
    log = log.withColumn("first", F.coalesce(F.array_max(sets), F.lit(0)))
    text = F.array_join(F.transform(F.slice("log", F.col("first") + 1, F.size("log")), lambda e: e["text"]), "")
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    role = F.when(F.size(roles) > 0, F.element_at(roles, -1)).otherwise(F.lit(""))
    live = F.element_at("log", F.col("first") + 1)["kind"] != "delete"
    return log.filter(live).select("conv_id", "turn", role.alias("role"), text.alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, mask.

    mask gives, per turn, three runs of characters (head, text, tail) as chars and whether the
    loss covers them: the texts of loss_role. Every message is rendered, in order of
    turn, a null turn first, then of role and text. A null role or text is empty, a
    null conv_id a conversation of its own; no messages, no rows. Other columns are ignored.
    """
    messages = messages.select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    head = F.concat(F.lit(START), escaped(F.col("role"), (*CODES, LINE)), F.lit("\n"))
    body = escaped(F.col("text"))
    run = lambda chars, loss: F.struct(chars.cast("int").alias("chars"), loss.alias("loss"))
    no = F.lit(False)
    turns = messages.select("conv_id", "turn", head.alias("head"), body.alias("body"), (F.col("role") == loss_role).alias("loss"))
    runs = F.array(run(F.char_length("head"), no), run(F.char_length("body"), F.col("loss")), run(F.lit(len(END)), no))
    turns = turns.select("conv_id", F.struct("turn", F.concat("head", "body", F.lit(END)).alias("piece"), runs.alias("runs")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return whole.select("conv_id", F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("formatted"), F.flatten(F.transform("ts", lambda t: t["runs"])).alias("mask"))


def parsed(rendered: DataFrame) -> DataFrame:
    """conv_id, formatted, turns: role, text and loss text of each turn, read back from the string and its mask.

    An empty string has no turns; rows repeat and null ids stay as they came.
    """
    pieces = F.split("formatted", "<\\|im_end\\|>\n")
    cut = rendered.withColumn("pieces", F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))))

    def turn(piece: Column, i: Column) -> Column:
        head, body = F.get("mask", i * 3), F.get("mask", i * 3 + 1)
        line = F.instr(piece, "\n")
        role = F.substring(piece, len(START) + 1, line - len(START) - 1)
        covered = F.when(body["loss"], unescaped(F.substring(piece, head["chars"] + 1, body["chars"]))).otherwise("")
        return F.struct(unescaped(role, (*CODES, LINE)).alias("role"), unescaped(F.substring(piece, line + 1, F.char_length(piece))).alias("text"), covered.alias("loss"))

    return cut.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns"))


def digests(rendered: DataFrame) -> DataFrame:
    """One row per conversation: what parsed() finds, as counts and digests; no rows for no rows."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("turns", lambda t: t["loss"]), "")
    read = parsed(rendered).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), learnt.alias("learnt"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", "turns_sha256", F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished messages (conv_id, turn, role, text) as an event log, in which every row is one message.

    Its `turn` is a structure of the row's turn and its number among the rows of
    that turn, in order of role and text, so rows that repeat or share a turn,
    null turns too, all stay. Other columns are ignored; no rows, no events.
    """
    plain = conversations.select("conv_id", "turn", "role", "text")
    among = Window.partitionBy("conv_id", "turn").orderBy(*(F.coalesce(c, F.lit("")) for c in ("role", "text")))
    own = F.struct(F.col("turn").alias("turn"), F.row_number().over(among).alias("part"))
    return plain.select("conv_id", F.col("turn").alias("seq"), own.alias("turn"), F.lit("message").alias("kind"), "role", "text")
