"""Conversations from messages that quote each other.

1. Lines are parsed into nested quote levels; a message's own lines are its body,
   without the line that announces a quotation ("... wrote:").
2. Every quoted passage and every paragraph and line of a body is normalised and hashed.
3. A passage links to the message that wrote it: the latest earlier message of the
   conversation that has its hash; beyond the conversation, for passages of ``FAR`` characters
   or more, the first message that has it. A message answers the message that its level-1 passages quote most, or
   else the one before it.
4. Replies are ordered depth first. Messages that follow the one before them form
   segments; only the jumps between segments are walked, and each round doubles the
   jumps that a segment has behind it, so rounds grow with the logarithm of the depth.

A conversation may hold a third of all rows: "the one before" and "the last that"
are running values over slices of ``slice_turns`` turns, never over a conversation.
Only hashes that were quoted are joined to their originals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.session import stage

#: Shorter passages say too little to name a message of another conversation.
FAR = 12
_MARK = re.compile(r"[ \t]{0,3}>")
#: Lines that announce a quotation, in the corpus' languages.
_ANNOUNCES = re.compile(r".*\b(wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$", re.I)
_WORDS = re.compile(r"\w+")
_PARSED = ("text string, passages array<struct<level:int,hash:long,chars:long>>, "
           "own array<long>")


def levels(text: str) -> list[tuple[int, str]]:
    """(quote level, line without its marks) of each line."""
    lines = []
    for line in re.split(r"\r\n|\r|\n", text):
        level = at = 0
        while m := _MARK.match(line, at):
            level, at = level + 1, m.end()
        lines.append((level, line[at + (level > 0 and line.startswith(" ", at)):]))
    return lines


def normal(text: str) -> str:
    return " ".join(_WORDS.findall(text.lower()))


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


def parse(text: str | None):
    """(body, passages as (level, hash, chars), hashes of the body); pieces without a word have no hash."""
    lines = levels(text or "")
    runs: list[tuple[int, list[str]]] = []
    for level, line in lines:
        if runs and runs[-1][0] == level:
            runs[-1][1].append(line)
        else:
            runs.append((level, [line]))
    body: list[str] = []
    passages, own = {}, set()

    def pieces(part: list[str]):
        paragraph: list[str] = []
        found = set()
        for line in [*part, ""]:
            if line.strip():
                paragraph.append(line)
                found.add(normal(line))
            elif paragraph:
                found.add(normal(" ".join(paragraph)))
                paragraph = []
        found.add(normal(" ".join(part)))
        return [p for p in found if p]

    for at, (level, part) in enumerate(runs):
        if level:
            for piece in pieces(part):
                passages[level, _hash(piece)] = len(piece)
            continue
        if at + 1 < len(runs):
            end = len(part)
            while end and not part[end - 1].strip():
                end -= 1
            if end and _ANNOUNCES.match(part[end - 1]):
                part = part[:end - 1]
        own.update(map(_hash, pieces(part)))
        body.append("\n".join(part).strip("\n"))
    if len(runs) > 1:
        own.update(map(_hash, pieces("\n".join(body).split("\n"))))
    kept = "\n".join(b for b in body if b.strip()) if len(runs) > 1 else (text or "")
    return kept, [(level, h, chars) for (level, h), chars in sorted(passages.items())], sorted(own)


def _parsed(messages: DataFrame, text: str) -> DataFrame:
    kept = [c for c in messages.columns if c != text]
    schema = ", ".join(f"`{c}` {messages.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passage = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("chars", pa.int64())]))
        for batch in batches:
            bodies, passages, own = [], [], []
            for value in batch.column(0):
                body, quoted, hashes = parse(value.as_py())
                bodies.append(body)
                passages.append([dict(zip(("level", "hash", "chars"), p)) for p in quoted])
                own.append(hashes)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(bodies, pa.string()), pa.array(passages, passage), pa.array(own, pa.list_(pa.int64()))],
                [*kept, "text", "passages", "own"])

    return messages.select(F.col(text).cast("string").alias("_text"), *kept).mapInArrow(run, f"{schema}, {_PARSED}")


def running_last(rows: DataFrame, group: list[str], at: str, value: Column, slice_turns: int, inclusive: bool = True) -> DataFrame:
    """``rows`` with ``last``: the value with the largest ``at`` so far among the non-null ones, per group.

    ``value`` must not fall as ``at`` grows. Rows with equal ``at`` see each other only if ``inclusive``.
    """
    sliced = rows.withColumn("_slice", F.floor(F.col(at) / F.lit(slice_turns))).withColumn("_value", value)
    tops = sliced.groupBy(*group, "_slice").agg(F.max("_value").alias("_top"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_slice").alias("_s"),
                          F.max("_top").over(before).alias("_carried"))
    same = (F.col("_slice") == F.col("_s"))
    for i, g in enumerate(group):
        same = same & (F.col(g) == F.col(f"_g{i}"))
    inside = Window.partitionBy(*group, "_slice").orderBy(at).rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return sliced.withColumn("_inside", F.max("_value").over(inside)).join(carried, same).withColumn(
        "last", F.coalesce("_inside", "_carried")).drop("_slice", "_value", "_inside", "_carried", "_s", *[f"_g{i}" for i in range(len(group))])


def _quoted_turns(heads: DataFrame, slice_turns: int) -> DataFrame:
    """(conv_id, turn, level, o_conv, o_turn, chars): which message each level's passages quote most."""
    quoted = heads.select("conv_id", "turn", F.explode("passages").alias("p")).select(
        "conv_id", "turn", F.col("p.level").alias("level"), F.col("p.hash").alias("hash"), F.col("p.chars").alias("chars"))
    written = heads.select("conv_id", "turn", F.explode("own").alias("hash")).join(
        quoted.select("hash").distinct(), "hash", "left_semi").groupBy("conv_id", "turn", "hash").agg(F.lit(True).alias("w"))
    asked = quoted.groupBy("conv_id", "turn", "hash").agg(F.lit(False).alias("w"))
    near = running_last(
        written.union(asked.select("conv_id", "turn", "hash", "w")), ["conv_id", "hash"], "turn",
        F.when(F.col("w"), F.col("turn")), slice_turns, inclusive=False).where(~F.col("w")).select(
        "conv_id", "turn", "hash", F.col("last").alias("near_turn"))
    far = written.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("far"))
    met = quoted.join(near, ["conv_id", "turn", "hash"]).join(far, "hash", "left")
    elsewhere = (F.col("far.conv_id") != F.col("conv_id")) & (F.col("chars") >= FAR)
    linked = met.select(
        "conv_id", "turn", "level", "chars",
        F.when(F.col("near_turn").isNotNull(), F.col("conv_id")).when(elsewhere, F.col("far.conv_id")).alias("o_conv"),
        F.coalesce("near_turn", F.when(elsewhere, F.col("far.turn"))).alias("o_turn"))
    sums = linked.where(F.col("o_turn").isNotNull()).groupBy("conv_id", "turn", "level", "o_conv", "o_turn").agg(F.sum("chars").alias("chars"))
    best = F.max(F.struct("chars", (F.col("o_conv") == F.col("conv_id")).alias("here"), "o_turn", "o_conv"))
    return sums.groupBy("conv_id", "turn", "level").agg(best.alias("b")).select(
        "conv_id", "turn", "level", "b.o_conv", "b.o_turn", "b.chars")


def build_conversations(messages: DataFrame, slice_turns: int = 1024) -> DataFrame:
    """Messages (conv_id long, turn long, role, text, ...) as reply-ordered conversations without quotes.

    One row per message: conv_id, turn, its other columns, ``text`` without quotes,
    ``parent_turn`` (null for the first), ``quoted_conv`` and ``quoted_turn`` (what its
    level-1 passages quote, null if unknown), ``n_quotes`` (its levels that found an
    original), ``depth`` (jumps from the first message) and ``reply_order``: numbers
    that sort a conversation depth first. A conversation starts with its lowest turn.

    A null text is empty. Rows without conv_id or turn are conversations of their own:
    no parent, order of nothing but themselves. Repeated turns share their place;
    repeated rows stay. Existing columns of the new names are replaced. An empty table gives an empty one.
    """
    new = ["parent_turn", "quoted_conv", "quoted_turn", "n_quotes", "depth", "reply_order"]
    parsed = stage(_parsed(messages.drop(*new, "passages", "own"), "text"), "quotes-parsed")
    heads = parsed.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    links = stage(_quoted_turns(heads, slice_turns), "quotes-links")
    turns = heads.groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    before = running_last(turns, ["conv_id"], "turn", F.col("turn"), slice_turns, inclusive=False).select(
        "conv_id", "turn", F.col("last").alias("before"))
    first = links.where(F.col("level") == 1).select("conv_id", "turn", F.col("o_conv").alias("quoted_conv"), F.col("o_turn").alias("quoted_turn"))
    counts = links.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"))
    here = (F.col("quoted_conv") == F.col("conv_id")) & (F.col("quoted_turn") < F.col("turn"))
    placed = before.join(first, ["conv_id", "turn"], "left").join(counts, ["conv_id", "turn"], "left").withColumn(
        "parent_turn", F.coalesce(F.when(here, F.col("quoted_turn")), "before"))
    starts = F.when(F.col("before").isNull() | (F.col("parent_turn") != F.col("before")), F.col("turn"))
    tree = stage(running_last(placed, ["conv_id"], "turn", starts, slice_turns).withColumnRenamed("last", "segment"), "quotes-tree")

    # (0, turn, 0) stands for a message of the segment itself, (1, -turn left, first turn) for a jump out of it
    segments = tree.where(F.col("turn") == F.col("segment")).select("conv_id", "segment", "parent_turn")
    attached = stage(segments.join(
        tree.select("conv_id", F.col("turn").alias("parent_turn"), F.col("segment").alias("above")), ["conv_id", "parent_turn"], "left"),
        "quotes-segments")
    root = F.col("parent_turn").isNull()
    none = F.array().cast("array<long>")
    found = stage(attached.select(
        "conv_id", "segment", "above", F.when(root, 0).otherwise(1).alias("depth"),
        F.when(root, none).otherwise(F.array(F.lit(1).cast("long"), -F.col("parent_turn"), F.col("segment"))).alias("path")), "quotes-jumps")
    while not found.where(F.col("above").isNotNull()).isEmpty():
        up = found.select("conv_id", F.col("segment").alias("above"), F.col("above").alias("_next"), F.col("depth").alias("_depth"), F.col("path").alias("_path"))
        found = stage(found.join(up, ["conv_id", "above"], "left").select(
            "conv_id", "segment", F.col("_next").alias("above"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            F.concat(F.coalesce("_path", none), "path").alias("path")), "quotes-jumps")
    found = found.drop("above")
    ordered = tree.join(found, ["conv_id", "segment"]).select(
        "conv_id", "turn", "parent_turn", "quoted_conv", "quoted_turn", F.coalesce("n_quotes", F.lit(0).cast("long")).alias("n_quotes"),
        "depth", F.concat("path", F.array(F.lit(0).cast("long"), F.col("turn"), F.lit(0).cast("long"))).alias("reply_order"))
    out = heads.drop("passages", "own").join(ordered, ["conv_id", "turn"])
    alone = parsed.where(F.col("conv_id").isNull() | F.col("turn").isNull()).drop("passages", "own")
    none = F.lit(None).cast("long")
    return out.unionByName(alone.select(
        "*", none.alias("parent_turn"), none.alias("quoted_conv"), none.alias("quoted_turn"), F.lit(0).cast("long").alias("n_quotes"),
        F.lit(0).alias("depth"), F.array(F.lit(0).cast("long"), F.col("turn"), F.lit(0).cast("long")).alias("reply_order")))
