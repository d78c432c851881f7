"""Chat formatting by prefix-target expansion.

Every assistant turn is an example of its own: all turns before it are context, only its reply is trainable. Turns
after the last reply make an example without a trainable part, so that nothing is lost. ``examples`` formats the
turns once and says where each example ends; ``parts`` expands every example to its whole text, in rows of a bounded
number of characters, so neither a long conversation nor one of many replies is ever whole in a row or a task;
``expand`` joins the parts of an example to one text; ``read_back`` parses the expanded parts.

Template: ``<s>role newline text</s> newline`` per turn. In roles and texts a backslash is doubled and one is put
behind the first character of every control string, so no control string of this or of common templates is left.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldorder.llm.common import map_rows, partitions

OPEN, CLOSE = "<s>", "</s>\n"
#: Control strings: sequence marks, instruction and system marks, and whatever starts with <|.
CONTROL = r"([<\[])(?=/?s>|</?SYS>>|/?INST\]|\|)"
#: A block takes the turns that begin within this many characters; a block meets this many examples in one group.
PART, GROUP = 65_536, 1_024
UNESCAPE = re.compile(r"\\(.)", re.S)


def escaped(text: Column, role: bool = False) -> Column:
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    out = F.regexp_replace(out, CONTROL, r"$1\\")
    return F.regexp_replace(out, r"\n", "\\\\\\\n") if role else out  # a role ends at the first plain newline


def unescaped(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def turns(chats: DataFrame) -> DataFrame:
    """One formatted segment per turn, with its place in the conversation's text, its example and its block."""
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), True), F.lit("\n"))
    text = escaped(F.col("text"))
    t = chats.select("conv_id", "turn", "role", "text", head.alias("_head"), text.alias("_body"))
    t = t.withColumn("segment", F.concat("_head", "_body", F.lit(CLOSE)))
    t = t.withColumn("target", F.coalesce(F.col("role") == "assistant", F.lit(False)))
    key = Window.partitionBy("conv_id")
    order = key.orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0))
    t = t.withColumn("example", F.coalesce(F.sum(F.col("target").cast("long")).over(before), F.lit(0)))
    t = t.withColumn("at", F.count(F.lit(1)).over(before)).withColumn("start", start)
    cell = F.floor(F.col("start") / PART)
    t = t.withColumn("_new", F.coalesce(cell != F.lag(cell).over(order), F.lit(False)))
    t = t.withColumn("block", F.sum(F.col("_new").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("last", F.lead("at").over(order).isNull())
    t = t.withColumn("replies", F.sum(F.col("target").cast("long")).over(key))
    loss_start = F.col("start") + F.length("_head")
    return t.select(
        "conv_id", "example", "at", "target", "segment", (F.col("start") + F.length("segment")).alias("text_chars"),
        F.when(F.col("target"), loss_start).alias("loss_start"),
        F.when(F.col("target"), loss_start + F.length("_body")).alias("loss_end"), "block", "last", "replies",
    )


def examples(chats: DataFrame) -> DataFrame:
    """conv_id, example, at, target, segment, text_chars, loss_start, loss_end, block, last, replies: a row per turn.

    An example's whole text is every segment of its conversation up to its target row, which alone has a loss span
    (in that text). Rows are ordered by turn; ties go by role and text, nulls first; repeated rows are turns of
    their own. Null text or role is empty; null conv_id is a conversation like any other; an empty table has no
    examples; other columns are not read. ``block`` numbers runs of turns that begin in the same PART characters,
    ``last`` marks the conversation's last turn, ``replies`` counts its assistant turns.
    """
    return turns(chats)


def parts(ex: DataFrame) -> DataFrame:
    """conv_id, example, part, text, loss_start, loss_end, final, whole: every example's text, expanded.

    The parts of an example, in order of ``part``, are its context and its reply. A part holds whole turns that begin
    within PART characters. Only the ``final`` part has a loss span (in the part's own text), and none in the example of
    the turns after the last reply. ``whole`` marks the example that holds all turns of its conversation. The text is as
    long as the square of a conversation's turns; each block of turns meets GROUP examples at a time, so that many
    replies spread over tasks.
    """
    begin = F.col("text_chars") - F.length("segment")
    spoken = F.array_sort(F.collect_list(F.struct("at", "segment")))
    blocks = ex.groupBy("conv_id", "block").agg(
        F.array_join(F.transform(spoken, lambda x: x["segment"]), "").alias("_text"), F.min(begin).alias("_from"),
        F.min("example").alias("_first"), F.first("replies").alias("_replies"),
    )
    group = F.explode(F.sequence(F.floor(F.col("_first") / GROUP), F.floor(F.col("_replies") / GROUP)))
    blocks = blocks.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), group.alias("_g"), "_text", "_from")
    ends = ex.where("target OR last").select(
        "conv_id", "example", "text_chars", "loss_start", "loss_end", F.col("block").alias("_to"), F.col("last").alias("whole"),
        F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("part"),
    )
    on = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_b")) & (F.floor(F.col("example") / GROUP) == F.col("_g"))
    d = ends.join(blocks, on).withColumn("final", F.col("part") == F.col("_to"))
    length = (F.col("text_chars") - F.col("_from")).cast("int")
    text = F.when(F.col("final"), F.col("_text").substr(F.lit(1), length)).otherwise(F.col("_text"))
    span = [F.when(F.col("final"), F.col(c) - F.col("_from")).alias(c) for c in ("loss_start", "loss_end")]
    return d.select("conv_id", "example", "part", text.alias("text"), *span, "final", "whole")


def expand(ex: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end with each example's whole text in one row; for texts that fit one."""
    d = parts(ex).withColumn("n", F.length("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "")
    before = F.coalesce(F.sum(F.when(~F.col("final"), F.col("n"))), F.lit(0))
    d = d.groupBy("conv_id", "example").agg(text.alias("text"), *[(F.max(c) + before).alias(c) for c in ("loss_start", "loss_end")])
    return d.where("loss_start IS NOT NULL")


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

#: What a row of the text read back holds: turns, trainable text, or the end of a conversation.
TURNS, LOSS, END = 0, 1, 2


def read_back(ex: DataFrame) -> DataFrame:
    """Read the expanded examples: digests of all turns and of all trainable text, per conversation.

    Every part of every example is read. The turns come from the example that holds them all, the trainable text from
    each example's loss span, and formatted_chars is the length of all examples' texts together. What was read streams
    in order through a task that holds one part and two running digests. An empty table gives no rows.
    """
    cols = ["conv_id", "example", "part", "text", "loss_start", "loss_end", "final", "whole"]

    def read(part):
        rest: dict = {}  # characters of parts that give nothing else, added up for a batch
        for i, (conv, example, k, text, a, b, final, whole) in enumerate(part):
            n = rest.setdefault(conv, [i, 0])
            n[1] += len(text)
            if whole:
                said = [split_head(x) for x in segments(text)]
                yield i, TURNS, k, "".join([f"{role}\n{x}\n" for role, _, x in said]), len(said), 0
            if a is not None:
                yield i, LOSS, example, unescaped(text[a:b]), 0, 0
            if whole and final:
                yield i, END, 0, None, 0, 0
        for i, n in rest.values():
            yield i, TURNS, -1, None, 0, n

    got = map_rows(parts(ex), read, cols, ["conv_id"], "kind int, place long, said string, n long, chars long")
    ordered = got.repartition(partitions(ex.sparkSession), "conv_id").sortWithinPartitions("conv_id", "kind", "place")
    state: dict = {}

    def digest(part):
        for i, (kind, said, n, chars) in enumerate(part):
            if not state:
                state.update(sums={TURNS: hashlib.sha256(), LOSS: hashlib.sha256()}, turns=0, loss=0, chars=0)
            state["turns"] += n
            state["chars"] += chars
            if said is not None:
                state["sums"][kind].update(said.encode("utf-8", "surrogatepass"))
                state["loss"] += len(said) if kind == LOSS else 0
            if kind == END:
                yield i, state["turns"], state["sums"][TURNS].hexdigest(), state["loss"], state["sums"][LOSS].hexdigest(), state["chars"]
                state.clear()

    return map_rows(ordered, digest, ["kind", "said", "n", "chars"], ["conv_id"], DIGEST)


def segments(text: str) -> list[str]:
    """The turns of formatted text without their marks."""
    out = text.split(CLOSE)
    assert out.pop() == "" and all(x.startswith(OPEN) for x in out)
    return [x[len(OPEN) :] for x in out]


HEAD = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.S)


def split_head(turn: str) -> tuple[str, str, str]:
    """Role and text of a turn without its marks, both unescaped."""
    m = HEAD.match(turn)
    return unescaped(m[1]), "\n", unescaped(turn[m.end() :])
