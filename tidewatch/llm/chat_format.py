r"""Chat transcripts rebuilt from logs of events, and rendered with a loss mask. DataFrame functions only.

An event log holds per conversation, in order of ``seq``:

* ``message`` opens a message of a role with a text, which may be empty,
* ``delta`` adds a piece of text to the last message,
* ``edit`` gives message number ``target`` (from 0; null: the last one) a new text,
* ``regenerate`` drops all messages after number ``target`` (null: the last one) and starts its text anew, with the
  event's text and the deltas that follow.

Events that name a message which is not there change nothing, and so do kinds that are not listed. The log is folded by
windows over each conversation in order of ``seq``: how many messages there are after an event is the number opened so
far plus a running minimum over regenerations, which gives each event the message it works on. A message is the pieces
from the last event on that set its text. No step copies what came before, so long conversations take linear work.

A turn is rendered as ``### ROLE: TEXT</turn>`` and a line break. A backslash goes before each backslash of role and
text and into each control string in them, so that it is none any more (``### ``, ``</turn>``; in roles also ``: ``); taking
out one backslash before any character undoes this. The mask lists the bytes of assistants' texts.

Null roles and texts are empty. Events with a null ``seq`` come first; events with equal ``seq`` in order of kind, role,
text and target. Rows without a conversation id form one conversation without id. A conversation in which no message is left has an
empty transcript. A conversation is one row of the result, so it must fit into one. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, COLON, END = "### ", ": ", "</turn>\n"  # around role and text
CONTROL = (("### ", "###\\ "), ("</turn>", "<\\/turn>"))
IN_ROLES = ((": ", ":\\ "),)
LEARNED = "assistant"
MANY = 2**31 - 1


def replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escaped(text: Column, is_role: bool = False) -> Column:
    return replaced(text, (("\\", "\\\\"), *CONTROL, *(IN_ROLES if is_role else ())))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def messages(events: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """The messages that are left: ``conv``, ``slot`` (their number), ``role``, ``text``. A conversation without any has
    one row with null ``slot``. ``events``: conversation, seq, kind, role, text, target."""
    own = Window.partitionBy("conv")
    so_far = own.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("kind")
    rows = events.select(
        F.col(conversation).alias("conv"),
        "seq",
        "kind",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("target") >= 0, F.col("target").cast("bigint")).alias("target"),
        (F.col("target") < 0).alias("nowhere"),
    )
    rows = rows.withColumn("at", F.row_number().over(own.orderBy("seq", "kind", "role", "text", "target", "nowhere")))
    rows = rows.withColumn("opened", F.count_if(kind == "message").over(so_far))
    cut = F.when(kind == "regenerate", F.col("target") + 1 - F.col("opened"))
    after = lambda w: F.least(F.lit(0), F.coalesce(F.min("cut").over(w), F.lit(0)))
    rows = rows.withColumn("cut", cut).withColumn("n", F.col("opened") + after(so_far))
    rows = rows.withColumns(
        {
            "left": F.max("opened").over(own) + after(own),
            "before": F.coalesce(F.lag("n").over(own.orderBy("at")), F.lit(0)),
        }
    )
    aimed = F.coalesce("target", F.col("before") - 1)
    aimed = F.when((aimed >= 0) & (aimed < F.col("before")) & ~F.coalesce("nowhere", F.lit(False)), aimed)
    slot = (
        F.when(kind == "message", F.col("n") - 1)
        .when((kind == "delta") & (F.col("before") > 0), F.col("before") - 1)
        .when(kind.isin("edit", "regenerate"), aimed)
    )
    rows = rows.withColumn("slot", slot)
    rows = rows.withColumn("slot", F.when(F.col("slot") < F.col("left"), F.col("slot")))
    opens, sets = kind == "message", kind.isin("message", "edit", "regenerate")
    found = rows.groupBy("conv", "slot").agg(
        F.max_by("role", F.when(opens, F.col("at"))).alias("role"),
        F.max(F.when(sets, F.col("at"))).alias("since"),
        F.array_sort(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("at", "text")))).alias("pieces"),
        F.max("left").alias("left"),
    )
    pieces = F.filter("pieces", lambda p: p["at"] >= F.col("since"))
    text = F.array_join(F.transform(pieces, lambda p: p["text"]), "")
    found = found.filter(F.col("slot").isNotNull() | (F.col("left") <= 0))
    return found.select("conv", "slot", "role", text.alias("text"))


def render(turns: DataFrame, learned: str = LEARNED) -> DataFrame:
    """Per conversation: ``formatted``, its transcript, and ``mask``, the bytes (start from 0, length) to learn from."""
    head = F.concat(F.lit(HEAD), escaped(F.col("role"), is_role=True), F.lit(COLON))
    rows = turns.select("conv", "slot", "role", head.alias("head"), escaped(F.col("text")).alias("body"))
    rows = rows.withColumn("turn", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("turn")).over(before), F.lit(0)) + F.octet_length("head")
    span = F.struct(start.cast("int").alias("start"), F.octet_length("body").alias("length"))
    rows = rows.withColumn("span", F.when(F.col("role") == learned, span))
    listed = rows.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "turn", "span")))).alias("turns")
    )
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return listed.select("conv", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), spans.alias("mask"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a transcript."""
    segments = F.slice(F.split(formatted, END), F.lit(1), F.greatest(F.size(F.split(formatted, END)) - 1, F.lit(0)))
    colon = lambda s: F.instr(s, F.lit(COLON))
    return F.transform(
        segments,
        lambda s: F.struct(
            unescaped(F.substring(s, F.lit(len(HEAD) + 1), colon(s) - len(HEAD) - 1)).alias("role"),
            unescaped(F.substring(s, colon(s) + len(COLON), F.lit(MANY))).alias("text"),
        ),
    )


def learned_text(formatted: Column, mask: Column) -> Column:
    """The text under the mask, as it was before it was escaped."""
    raw = formatted.cast("binary")
    parts = F.transform(mask, lambda m: unescaped(F.substring(raw, m["start"] + 1, m["length"]).cast("string")))
    return F.array_join(parts, "")
