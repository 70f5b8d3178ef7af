"""Chat formatting by quotation linking.

A message's lines are parsed into quote levels (how many > they begin with); its own lines are level 0. Consecutive
lines of one level are a passage, normalised (A-Z lowered, white space and line breaks as one space), so that a quote
may be wrapped anew or be a part of what was said. Every run of WINDOW words of a quoted passage is hashed, and every
quoted line of fewer words by itself. The same hashes are taken of what the messages of that conversation say
themselves, each indexed once, under the earliest message that says it. Quoted hashes join that index. A message replies
to the message that said most words of what it quotes at its shallowest linked level; ties go to the latest. Threads
then follow from replies: roots and depths come by doubling, each round joining every message to where it has come.
Quoted lines and their attribution lines leave the text. ``position`` numbers a conversation's messages from 0 in the
order of replies: by the turn of the thread's first message, depth, turn, so each stands after the one it answers.

A passage that a third of all messages quote is one row of the index for each of its words; the quoting side is a join
that Spark can split, and votes are summed before they are shuffled. Only conversations in which somebody quotes are
indexed. No conversation is gathered anywhere: positions come from a global sort of slim rows and its partitions' sizes.

Edge cases. Null or empty text: no quotes, an empty body. Null conversation or turn: such rows keep their bodies and are
roots of their own. Repeated rows: each is a row of the result, with the same reply and a position of its own. Quotes of
nothing that was said before: no link; the lines still go. A message never replies to itself or to a later one. A quote
of fewer than WINDOW words links only if it is a whole line. Very long texts are parsed whole. An empty table: an empty
result. Only the named columns are read.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.shipping import ship
from graphloom.llm._common import Scratch, each, settle, small_side, table

#: Words of a window; shorter lines are taken whole.
WINDOW = 5
_QUOTE = re.compile(r"[ \t]*((?:>[ \t]?)+)")
#: The line that mail programs put before a quote: "On ..., somebody wrote:".
_ATTRIBUTION = re.compile(r"[ \t]*on\b.*\bwrote:[ \t]*$", re.IGNORECASE)
_LOWER = {c: c + 32 for c in range(65, 91)}
_QUOTED = pa.list_(pa.struct([("level", pa.int32()), ("h", pa.int64()), ("n", pa.int32())]))
_PARSED = pa.struct([("body", pa.string()), ("quoted", _QUOTED)])


def parse(text: str | None) -> tuple[str, list[tuple[int, list[str]]]]:
    """The text without quotes, and (level, lines) of every quoted passage."""
    body: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in (text or "").split("\n"):
        m = _QUOTE.match(line)
        level = m[1].count(">") if m else 0
        if not level:
            body.append(line)
        else:
            if body and _ATTRIBUTION.match(body[-1]) and not last:
                body.pop()
            if level != last:
                passages.append((level, []))
            passages[-1][1].append(line[m.end() :])
        last = level
    return "\n".join(body).strip("\n"), passages


def hashes(lines: list[str]) -> dict[int, int]:
    """Hash and number of words of every window of a passage and of its lines that are shorter than one."""
    split = [line.translate(_LOWER).split() for line in lines]
    words = [w for line in split for w in line]
    said = [words[i : i + WINDOW] for i in range(len(words) - WINDOW + 1)] + [line for line in split if 0 < len(line) < WINDOW]
    return {xxhash.xxh3_64_intdigest(" ".join(x).encode()) - (1 << 63): len(x) for x in said}


def _parser():
    @F.arrow_udf("struct<body:string,quoted:array<struct<level:int,h:bigint,n:int>>>")
    def parsed(texts: pa.Array) -> pa.Array:
        rows = [parse(t) for t in each(texts)]
        return pa.array([{"body": b, "quoted": [{"level": level, "h": h, "n": n} for level, lines in ps for h, n in hashes(lines).items()]} for b, ps in rows], _PARSED)

    return parsed


def _sayer():
    @F.arrow_udf("array<bigint>")
    def said(bodies: pa.Array) -> pa.Array:
        return pa.array([list(hashes(b.split("\n"))) for b in each(bodies)], pa.list_(pa.int64()))

    return said


def replies(said: DataFrame, quoted: DataFrame) -> DataFrame:
    """(conv, turn, reply_to, n_linked): who said what is quoted. said: (conv, turn, h); quoted: (conv, turn, level, h, n)."""
    index = said.groupBy("conv", "h").agg(F.min("turn").alias("reply_to"))
    asked = quoted.groupBy("conv", "turn", "level", "h").agg(F.max("n").alias("n"))
    linked = asked.join(settle(index), ["conv", "h"]).where("reply_to < turn")
    votes = linked.groupBy("conv", "turn", "level", "reply_to").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_linked"))
    best = F.max(F.struct((-F.col("level")).alias("level"), "n", "reply_to", "n_linked")).alias("best")
    return votes.groupBy("conv", "turn").agg(best).select("conv", "turn", "best.reply_to", "best.n_linked")


def threads(links: DataFrame) -> DataFrame:
    """(conv, turn, root_turn, depth) of every distinct message of a link, by doubling: as many rounds as the depth has bits."""
    scratch = Scratch(links.sparkSession, "threads")
    ends = links.select("conv", "turn").union(links.select("conv", F.col("reply_to").alias("turn"))).distinct()
    state = scratch.keep(ends.join(links, ["conv", "turn"], "left").select("conv", "turn", F.coalesce("reply_to", "turn").alias("at"), F.col("reply_to").isNotNull().cast("long").alias("depth")))
    while True:
        other = state.select("conv", F.col("turn").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        state = scratch.keep(state.join(other, ["conv", "at"]).select("conv", "turn", F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")))
        scratch.forget(scratch.n - 1, scratch.n - 1)
        if not state.where("moved").limit(1).count():
            return state.select("conv", "turn", F.col("at").alias("root_turn"), "depth")


def positions(placed: DataFrame) -> DataFrame:
    """placed with ``position``: the place of each row in its conversation, in the order of replies."""
    ordered = settle(placed.orderBy("conv", "root_turn", "depth", "turn", "row").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = small_side(sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    numbered = ordered.join(before, "part").withColumn("at", F.col("before") + F.col("at")).drop("part", "before")
    firsts = settle(numbered.groupBy(F.col("conv").alias("c")).agg(F.min("at").alias("first")))
    return numbered.join(firsts, F.col("conv").eqNullSafe(F.col("c"))).withColumn("position", F.col("at") - F.col("first")).drop("at", "c", "first")


def link_conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, body, reply_to, root_turn, depth, n_linked, position."""
    ship(messages.sparkSession)
    m = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), _parser()(F.col(text)).alias("p"))
    parsed = settle(m.select("conv", "turn", "role", "p.body", "p.quoted").withColumn("row", F.monotonically_increasing_id()))
    known = parsed.where("conv is not null and turn is not null")
    quoted = known.select("conv", "turn", F.explode("quoted").alias("q")).select("conv", "turn", "q.*")
    asked = small_side(quoted.select("conv").distinct())
    said = known.where("body <> ''").join(asked, "conv", "left_semi").select("conv", "turn", F.explode(_sayer()(F.col("body"))).alias("h"))
    links = settle(replies(said, quoted))
    placed = settle(links.join(threads(links), ["conv", "turn"], "right"))
    slim = parsed.select("row", "conv", "turn").join(placed, ["conv", "turn"], "left").withColumn("root_turn", F.coalesce("root_turn", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    out = parsed.select("row", "role", "body").join(positions(slim), "row")
    return out.select(F.col("conv").alias("conv_id"), "turn", "role", "body", "reply_to", "root_turn", "depth", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "position")


def query(spark, sf_dir: str) -> DataFrame:
    return link_conversations(table(spark, sf_dir, "conversations"))
