"""Chat formatting: quotation linking.

Lines that begin with one or more `>` are quoted, as deep as they have marks; an introduction such as `X wrote:` right
before a quoted line goes with it. Runs of lines of one depth are passages. Passages are normalised (marks, case and white
space) and hashed: whole passages and their lines. Own (unquoted) texts, their paragraphs and their lines are hashed
the same way, but only those are kept of which some quotation has the hash. A quotation belongs to the earliest own text of
its conversation before it that has the hash, or else to the earliest one anywhere.

A message answers the message of its conversation of which it quotes most characters at the lowest depth (ties: the
latest). Replies are ordered by threads: `thread` is the turn that a chain of answers starts from, found by pointer
doubling, and a conversation is read by (thread, turn): every reply comes after what it answers, threads stay whole.

Originals are one row for each hash (and conversation), so that a line that a third of all messages hold joins like any
other; sums come before joins. No conversation is gathered in one task. Null texts are empty; rows with a null conv_id or turn
are roots of their own. Repeated rows each come out, with equal values. Units of every length are linked within their
conversation; to other conversations only those of LEAST characters or more, as short lines prove nothing there. Units of
white space alone aren't any. Other columns pass only if named.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, map_arrow, saved

#: Characters of a normalised unit from which on it can be linked to another conversation.
LEAST = 12
_MARKS = re.compile(r"^\s{0,3}((?:>[ \t]?)+)(.*)$", re.S)
_INTRODUCTION = re.compile(r"(?:wrote|writes|said|schrieb|escribió|a écrit)\s*:\s*$")


def passages(text: str) -> list[tuple[int, list[str]]]:
    """(depth, lines without marks) of each run of lines of one depth; 0: own."""
    found: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        depth, body = (m[1].count(">"), m[2]) if m else (0, line)
        if found and found[-1][0] == depth:
            found[-1][1].append(body)
        else:
            if depth and found and not found[-1][0] and _INTRODUCTION.search(found[-1][1][-1]):
                found[-1][1].pop()
            found.append((depth, [body]))
    return [(d, lines) for d, lines in found if lines]


def own_text(text: str) -> str:
    """What is left without quotations."""
    return "\n".join("\n".join(lines) for d, lines in passages(text) if not d).strip("\n") if ">" in text else text


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _hash(unit: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(unit.encode("utf-8", "replace")), "big", signed=True)


def units(text: str) -> list[tuple[int, int, int, int]]:
    """(depth, passage, hash, characters) of all units: passages, paragraphs of own text, lines."""
    out = {}
    if not text:
        return []
    found = passages(text)
    whole = normal(own_text(text))
    if whole:
        out[0, 0, _hash(whole)] = len(whole)
    for k, (depth, lines) in enumerate(found):
        parts = [" ".join(lines), *lines]
        if not depth:
            parts += re.split(r"\n\s*\n", "\n".join(lines))
        for unit in map(normal, parts):
            if unit:
                out[depth, k if depth else 0, _hash(unit)] = len(unit)
    return [(*key, n) for key, n in out.items()]


def linked(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, thread, depth, n_quotes, n_linked, n_elsewhere) of each different (conv_id, turn)."""
    plain = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = plain.where("conv_id is not null and turn is not null")

    def parsed(b: pa.RecordBatch) -> dict:
        rows = [(c, t, *u) for c, t, text in zip(*(x.to_pylist() for x in b.columns), strict=True) if ">" in text for u in units(text) if u[0]]
        return dict(zip(("conv_id", "turn", "depth", "passage", "hash", "n"), map(list, zip(*rows, strict=True)) if rows else [[]] * 6, strict=True))

    quotes = saved(map_arrow(keyed, parsed, "conv_id long, turn long, depth int, passage int, hash long, n long").distinct())
    wanted = saved(quotes.select("hash").distinct())

    def owned(b: pa.RecordBatch) -> dict:
        rows = [(c, t, u[2]) for c, t, text in zip(*(x.to_pylist() for x in b.columns), strict=True) for u in units(text) if not u[0]]
        return dict(zip(("conv_id", "turn", "hash"), map(list, zip(*rows, strict=True)) if rows else [[]] * 3, strict=True))

    if quotes.isEmpty():
        own = quotes.select("conv_id", "turn", "hash").limit(0)
    else:
        # A line that a third of all messages hold is one row of each conversation before it moves.
        all_own = saved(map_arrow(keyed, owned, "conv_id long, turn long, hash long").groupBy("conv_id", "hash").agg(F.min("turn").alias("turn")))
        own = lookup(all_own, wanted, "hash")
    first = saved(own.groupBy("conv_id", "hash").agg(F.min("turn").alias("original")))
    anywhere = wanted.join(first.groupBy("hash").agg(F.min(F.struct("conv_id", "original")).alias("there")), "hash", "left")  # a row for each hash
    met = lookup(quotes.join(first, ["conv_id", "hash"], "left"), anywhere, "hash")
    met = met.withColumn("there", F.when(F.col("n") >= LEAST, F.col("there")))
    met = met.withColumn("original", F.when(F.col("original") < F.col("turn"), F.col("original")))
    # A passage counts once, by its longest linked unit.
    met = met.groupBy("conv_id", "turn", "depth", "passage").agg(F.max(F.when(F.col("original").isNotNull(), F.struct("n", "original"))).alias("best"), F.max((F.col("there").isNotNull() & ~F.col("there.conv_id").eqNullSafe(F.col("conv_id")))).alias("away"))
    sums = met.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.count("best").alias("n_linked"), F.sum((F.col("best").isNull() & F.col("away")).cast("long")).alias("n_elsewhere"))
    weight = met.where("best is not null").groupBy("conv_id", "turn", "depth", F.col("best.original").alias("parent")).agg(F.sum("best.n").alias("n"))
    chosen = weight.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("depth"), F.col("n"), F.col("parent"))).alias("m"))
    answers = saved(chosen.select("conv_id", "turn", F.col("m.parent").alias("parent")))
    up = saved(answers.select("conv_id", "turn", F.col("parent").alias("thread"), F.lit(1).cast("long").alias("depth")))
    while not up.isEmpty():  # as many rounds as the logarithm of the longest chain
        above = up.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("higher"), F.col("depth").alias("more"))
        joined = saved(up.join(above, ["conv_id", "thread"], "left"))
        up = saved(joined.select("conv_id", "turn", F.coalesce("higher", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        if joined.where("higher is not null").isEmpty():
            break
    out = sums.join(answers, ["conv_id", "turn"], "left").join(up, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "parent", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quotes", "n_linked", "n_elsewhere")


def report(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parent, thread, depth, n_quotes, n_linked, n_elsewhere, text) of every row; text without quotations.

    Only messages with quotations have links to look up; all others are roots: no row of theirs is shuffled but for the join.
    """
    links = linked(messages)
    plain = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")

    def bare(b: pa.RecordBatch) -> pa.RecordBatch:
        text = pa.array([own_text(t or "") for t in b.column(3).to_pylist()], pa.string())
        return pa.record_batch([*b.columns[:3], text], names=b.schema.names)

    own = lambda which: map_arrow(plain.where(which), bare, "conv_id long, turn long, role string, text string")
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    rootless = reduce(lambda df, c: df.withColumn(c, F.lit(None).cast("long")), (c for c in links.columns if c not in ("conv_id", "turn")), own(~known))
    out = own(known).join(links, ["conv_id", "turn"], "left").unionByName(rootless)  # null ids would meet in one task
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", "turn", "role", "parent", F.coalesce("thread", "turn").alias("thread"), *map(zero, ("depth", "n_quotes", "n_linked", "n_elsewhere")), "text")
