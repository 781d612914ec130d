"""Conversation structure repair by weighted interval parsing.

The turns of a conversation should read (s?(ua)+)?, by the initials of their roles. A repair grammar in Chomsky normal
form derives every edited conversation: a nonterminal stands for two states of that pattern between which a span of rows
leads; a rule joins two spans that meet in a state; a row is kept, gets another role or is deleted; and empty turns are
put in around any row (the insertion closure). A cell holds the cheapest derivation of its span, ties by the letters of
its edits, and cells are combined bottom-up by the length of their spans.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.common import Scratch

VISIBLE, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: Cost of an edit: Keep, Rerole, Delete, Insert; and of a turn that stays though its text breaks off.
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
CUT_OFF = 1
#: States: nothing yet, after s, after u, after a. A word may end in START or in ANSWERED.
START, SYSTEM, ASKED, ANSWERED = range(4)
STEPS = {"s": [(START, SYSTEM)], "u": [(START, ASKED), (SYSTEM, ASKED), (ANSWERED, ASKED)], "a": [(ASKED, ANSWERED)]}
#: Rows of a span whose chart tries every split.
SPAN = 16
#: The cheapest (cost, edits) by nonterminal.
Cell = dict[tuple[int, int], tuple[int, str]]


def better(cell: Cell, at: tuple[int, int], found: tuple[int, str]) -> None:
    if at not in cell or found < cell[at]:
        cell[at] = found


#: The nonterminals, and the binary rules: left and right part, and what they make.
PAIRS = [(p, q) for p in range(4) for q in range(4) if p == q or q in (ASKED, ANSWERED) or (p, q) == (START, SYSTEM)]
RULES = [((p, r), (r, q), (p, q)) for p, r in PAIRS for s, q in PAIRS if r == s]


def joined(left: Cell, right: Cell, into: Cell | None = None) -> Cell:
    """All binary rules on two neighbouring spans. Edits of equal cost never begin with each other (they name every row
    of the span once, and only insertions besides), so the least edits of the parts give the least of the whole."""
    out = {} if into is None else into
    for a, b, at in RULES:
        if a in left and b in right:
            (cost, edits), (more, rest) = left[a], right[b]
            if at not in out or cost + more <= out[at][0]:
                better(out, at, (cost + more, edits + rest))
    return out


def insertions() -> Cell:
    """What insertions alone derive: from every state to every other that they reach, and staying put for nothing."""
    step: Cell = {at: (COST["I"], "I") for c in "ua" for at in STEPS[c]}
    out: Cell = {(p, p): (0, "") for p in range(4)}
    for _ in range(4):
        joined(dict(out), step, out)
    return out


@functools.cache
def row_cell(symbol: str) -> Cell:
    """A row's cell: x must go; s, u, a and o (any other role) may stay, in upper case with a text that breaks off."""
    kind, cut = symbol.lower(), CUT_OFF * symbol.isupper()
    out: Cell = {(p, p): (COST["D"], "D") for p in range(4)}
    if kind != "x":
        for at in STEPS.get(kind, []):
            better(out, at, (COST["K"] + cut, "K"))
        for at in [*STEPS["u"], *STEPS["a"]]:
            better(out, at, (COST["R"] + cut, "R"))
    return joined(joined(insertions(), out), insertions())


@functools.lru_cache(50_000)
def chart(symbols: str) -> Cell:
    """The cell of a span of up to SPAN rows: every span within it, by length, from all of its splits."""
    n = len(symbols)
    spans = {(i, i + 1): row_cell(c) for i, c in enumerate(symbols)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell: Cell = {}
            for split in range(i + 1, i + length):
                joined(spans[i, split], spans[split, i + length], cell)
            spans[i, i + length] = cell
    return spans[0, n]


def parse(symbols: str) -> Cell:
    """The cell of a span of any length. Nonterminals are pairs of states, so a span's cell is the same from whichever
    split: beyond SPAN rows, spans of one length are joined to spans of twice that length, up to the whole."""
    return tower([chart(symbols[i : i + SPAN]) for i in range(0, len(symbols), SPAN)])


def tower(cells: list[Cell]) -> Cell:
    while len(cells) > 1:
        cells = [joined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else {}


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(cell[at] for at in ((START, START), (START, ANSWERED)) if at in cell)


LEGAL = {"su", "ua", "au"}


@dataclass
class Repair:
    """report: one row a conversation; rows: the repaired conversations, in order of `place` within each."""

    report: DataFrame
    rows: DataFrame


def noted(df: DataFrame) -> DataFrame:
    """Equal rows become one with their number, `copies`; again marks one whose role and text an earlier turn has."""
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumns({"digest": F.sha2("text", 256), "blank": ~F.col("text").rlike(VISIBLE), "cut": ~F.col("text").rlike(ENDED)})
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("set"), "turn")).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return rows.join(first, same, "left").select("conv_id", "turn", "role", "text", "digest", "copies", "blank", "cut", again.alias("again"))


ORDER = ["turn", "role", "digest"]
COUNTS = ["n", "blank", "duplicate", "truncated", "illegal"]
SEGMENT = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("part", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in (*COUNTS, "low", "high", "turns")],
     T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("edits", T.ArrayType(T.StringType()))]
)
REPORT = T.StructType([T.StructField("conv_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("gaps", *COUNTS[1:], "cost")], T.StructField("audit", T.StringType())])
ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("place", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("edit", T.StringType())])


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string()}[type(kind)]


def batches_of(rows: Iterator[tuple], schema: T.StructType, size: int = 4096, most_chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    arrow = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema.fields])

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(arrow)], schema=arrow)

    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= size or chars >= most_chars:
            yield batch(held)
            held, chars = [], 0
    yield batch(held)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for start in range(0, b.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in b.slice(start, 1024).columns))


def by_conversation(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of rows with one conv_id, the first column: streamed, not gathered."""
    return itertools.groupby(rows, key=lambda r: r[0])


def symbol(role: str, blank: bool, cut: bool, again: bool) -> str:
    kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return "x" if blank or again else kind.upper() if cut else kind


def segments(rows: DataFrame) -> DataFrame:
    """Counts and cells of the stretches of conversations that lie in one partition.

    Rows are dealt by ranges of conversation and turn, so that a conversation of any length is parsed in many tasks.
    """
    dealt = rows.select("conv_id", "turn", "role", "digest", "copies", "blank", "cut", "again").repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def one(conv, own):
            n = blanks = duplicates = cuts = illegal = turns = 0
            low = high = first = last = None
            symbols = []
            for _, turn, role, _, copies, blank, cut, again in own:
                initial = role[:1]
                if last is not None:
                    illegal += last + initial not in LEGAL
                illegal += copies - 1
                first, last = initial if first is None else first, initial
                if turn is not None and turn != high:
                    turns, low, high = turns + 1, turn if low is None else low, turn
                n += copies
                blanks += copies * blank
                duplicates += 0 if blank else copies - 1 + again
                cuts += not blank and not again and cut
                symbols.append(symbol(role, blank, cut, again) + "x" * (copies - 1))
            cell = parse("".join(symbols))
            found = [cell.get(at) for at in PAIRS]
            return conv, part, n, blanks, duplicates, cuts, illegal, low, high, turns, first, last, [f and f[0] for f in found], [f and f[1] for f in found]

        yield from batches_of((one(*x) for x in by_conversation(rows_of(batches))), SEGMENT)

    return dealt.mapInArrow(run, SEGMENT)


def reported(parts: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row a conversation: its stretches, in order, become one. `conversations` names all, also those without rows."""
    named = conversations.select("conv_id").distinct().withColumn("part", F.lit(-1))
    both = parts.unionByName(named, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(conv, own):
            sums, cells = [0, 0, 0, 0], []
            low = high = last = None
            turns = 0
            for _, part, _, *counts, lo, hi, some, first, end, costs, edits in own:
                if part < 0:
                    continue
                sums = [a + b for a, b in zip(sums, counts)]
                if last is not None:
                    sums[3] += last + first not in LEGAL
                last = end
                if lo is not None:  # a turn may lie on both sides of a border
                    turns += some - (lo == high)
                    low, high = lo if low is None else low, hi
                cells.append({at: (c, e) for at, c, e in zip(PAIRS, costs, edits) if c is not None})
            cost, audit = cheapest(tower(cells)) if cells else (0, "")
            return conv, 0 if low is None else high - low + 1 - turns, *sums, cost, audit

        yield from batches_of((one(*x) for x in by_conversation(rows_of(batches))), REPORT)

    return both.mapInArrow(run, REPORT)


def edited(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The rows that the edits leave, in order; rows of a conversation stream past its edits."""
    edits = report.select("conv_id", F.lit(0).alias("kind"), "audit")
    both = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text", "copies").unionByName(edits, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER).select("conv_id", "audit", "role", "text", "copies")

    def one(conv, own) -> Iterator[tuple]:
        audit, at, state, place = next(own)[1], 0, START, 0
        for _, _, role, text, copies in own:
            for _ in range(copies):
                while audit[at] == "I":
                    state = ASKED if state != ASKED else ANSWERED
                    yield conv, place, "user" if state == ASKED else "assistant", "", "I"
                    at, place = at + 1, place + 1
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "K" and role[:1] == "s":
                    state = SYSTEM
                else:
                    state = ASKED if state != ASKED else ANSWERED
                yield conv, place, role if edit == "K" else "user" if state == ASKED else "assistant", text, edit
                place += 1
        while at < len(audit):
            state = ASKED if state != ASKED else ANSWERED
            yield conv, place, "user" if state == ASKED else "assistant", "", "I"
            at, place = at + 1, place + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of((row for x in by_conversation(rows_of(batches)) for row in one(*x)), ROWS)

    return both.mapInArrow(run, ROWS)


def repair(df: DataFrame, spark: SparkSession, conversations: DataFrame | None = None) -> Repair:
    """Diagnose and repair rows (conv_id, turn, role, text).

    report: conv_id, gaps (turn numbers missing between the least and the greatest), blank, duplicate, truncated (rows by
    their first fault: no visible character; role and text of an earlier row; last visible character none of .!?), illegal
    (neighbours whose role initials are not su, ua or au), cost and audit: the letters of the cheapest edits in order that
    make the initials (s?(ua)+)?, ties by the least letters. Keep is free, Rerole to user or assistant costs 2, Delete 3
    (blank rows and duplicates must go), Insert of an empty user or assistant turn 2; each truncated row that stays adds 1.
    rows: conv_id, place, role, text and edit of what the edits leave.

    Rows of a conversation are taken by turn (nulls first), then by role and the digest of the text. A null role or text is one space. A
    null conv_id is a conversation of its own. Rows that repeat in full are neighbours, duplicates after the first. Every
    conversation of `conversations` (by default df) has a row in the report: without rows, zeros and no edits. Other
    columns of df play no part.

    A conversation of any length is parsed in many tasks. Its edits are one value in the report, as the contract wants
    them, so a task holds the letters of a conversation (for 11 nonterminals), but never its texts: those stream.
    """
    scratch = Scratch(spark)
    rows = scratch.table(noted(df))
    report = scratch.table(reported(scratch.table(segments(rows)), df if conversations is None else conversations))
    return Repair(report, edited(rows, report.select("conv_id", "audit")))


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of rows as repair() gives them: their `role:text`, joined by newlines."""
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(conv, own):
            digest = hashlib.sha256()
            for _, place, role, text, _ in own:
                digest.update(f"{'\n' if place else ''}{role}:{text}".encode())
            return conv, digest.hexdigest()

        yield from batches_of((one(*x) for x in by_conversation(rows_of(batches))), schema)

    return rows.mapInArrow(run, schema)  # rows come by conversation and in order of place


def with_digests(found: Repair) -> DataFrame:
    """The report with repaired_sha256, that of the empty text where nothing is left."""
    hashed = digests(found.rows).withColumnRenamed("conv_id", "c")
    none = F.lit(hashlib.sha256().hexdigest())
    both = found.report.join(hashed, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    return both.withColumn("repaired_sha256", F.coalesce("repaired_sha256", none))


def damage(df: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text), damaged by crc32 of conv_id:turn, modulo 20: 0 drops the row, 1 empties its text,
    2 removes .!? from it, 3 repeats the row, 4 makes its role user. Nulls of role and text, and within the key, are
    one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(code == 4, "user").otherwise(space("role"))
    times = F.sequence(F.lit(1), F.when(code == 3, 2).otherwise(1))
    return df.where(code != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")
