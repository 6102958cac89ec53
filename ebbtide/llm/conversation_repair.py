"""Conversation repair by weighted interval parsing: the cheapest edits that make a dialogue regular.

A repaired dialogue is empty, or an optional system turn and then pairs of user and assistant. As a
grammar in Chomsky normal form: a nonterminal [p, q] stands for the turns that lead from state p to
state q of START, SYSTEM, USER, ASSISTANT (the role that came last), with the rules [p, r] -> [p, q] [q, r]
and, as terminals, a row that is kept, given another role, or deleted. Insertions are closed over before
and after each row: [p, q] also covers an empty span, at the price of the turns it takes.

A cell holds for one nonterminal and one span the least (cost, audit), the audit having a letter per edit.
Cells are combined bottom-up by span length, 1, 2, 4, ... rows. One split of a span is enough: any
derivation of [p, r] passes some state q at any place of the span, so the minimum over q at one place is
the minimum over all. Cheapest audits compose, for of two audits of a span at equal cost neither starts
with the other: they hold a letter per row, and what one has more are insertions, which cost.

Rows are sorted by range into parts of bounded size. Most conversations end within one; of those that go
on in the next, each part gives one span, and spans are combined by conversation, FAN at a time, so a
conversation of any length is spread over tasks.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import table
from ebbtide.session import materialize

#: The states, the role initials that lead from one to another, prices of edits.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

WHITE = " \t\n\x0b\x0c\r"
FAN = 64
#: Repaired turns travel to the hash in chunks of so many bytes.
CHUNK_BYTES = 1 << 20

#: (cost, audit, path) per nonterminal; the path names the state before each part of a conversation.
Cells = dict[tuple[int, int], tuple[int, str, str]]


def _closure() -> Cells:
    """Cells of the empty span: nothing, or the fewest insertions that lead from p to q."""
    cells = {(p, p): (0, "", "") for p in range(4)}
    for _ in range(4):
        for (p, q), (cost, audit, path) in list(cells.items()):
            for (state, initial), after in STEPS.items():
                if state == q and initial != "s":  # a system turn cannot be inserted
                    new = (cost + INSERT, audit + "I", path)
                    cells[p, after] = min(cells.get((p, after), new), new)
    return cells


def combine(left: Cells, right: Cells) -> Cells:
    """Cells of two neighbouring spans as one."""
    out: Cells = {}
    for (p, q), (cost, audit, path) in left.items():
        for r in range(4):
            other = right.get((q, r))
            if other:
                new = (cost + other[0], audit + other[1], path + other[2])
                old = out.get((p, r))
                if old is None or new < old:
                    out[p, r] = new
    return out


EMPTY = _closure()


@functools.lru_cache(1 << 10)
def leaf(initial: str | None, truncated: bool, copies: int = 1) -> Cells:
    """Cells of one row, or, with None for its initial, of so many rows that have to go."""
    cells: Cells = {}
    for p in range(4):
        cells[p, p] = (DELETE * copies, "D" * copies, "")
        if initial is None:
            continue
        extra = TRUNCATED if truncated else 0
        for (state, wanted), after in STEPS.items():
            if state == p and wanted != "s":
                cells[p, after] = (REROLE + extra, "R", "")
        if (p, initial) in STEPS:
            cells[p, STEPS[p, initial]] = (extra, "K", "")
    return combine(combine(EMPTY, cells), EMPTY)


@functools.lru_cache(1 << 14)
def _short(rows: tuple) -> Cells:
    if len(rows) == 1:
        return leaf(*rows[0])
    half = 1 << (len(rows) - 1).bit_length() - 1
    return combine(_short(rows[:half]), _short(rows[half:]))


def joined(level: list[Cells]) -> Cells:
    """Neighbouring spans in pairs, level by level, until one is left."""
    while len(level) > 1:
        level = [combine(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else EMPTY


def parse(rows: list[tuple]) -> Cells:
    """Cells of a span of rows (initial, truncated, copies). Eight rows at a time are looked up first:
    most conversations are made of a few patterns."""
    return joined([_short(tuple(rows[i : i + 8])) for i in range(0, len(rows), 8)])


def best(cells: Cells) -> tuple[int, str, str, int]:
    """(cost, audit, path, end state) of the cheapest derivation of a whole conversation."""
    return min((*cells[START, end], end) for end in ENDS if (START, end) in cells)


class Replay:
    """Applies an audit to rows that come one after another; gives the repaired turns as lines."""

    def __init__(self, audit: str, state: int = START):
        self.audit, self.at, self.state = audit, 0, state

    def _next_role(self) -> str:
        self.state = ASSISTANT if self.state == USER else USER
        return "assistant" if self.state == ASSISTANT else "user"

    def insertions(self) -> list[str]:
        lines = []
        while self.audit[self.at : self.at + 1] == "I":
            lines.append(self._next_role() + ":")
            self.at += 1
        return lines

    def row(self, role: str, text: str, copies: int) -> list[str]:
        """What becomes of `copies` alike rows, of which the first at most stays."""
        lines = self.insertions()
        edit = self.audit[self.at]
        if edit == "K":
            self.state = STEPS[self.state, role[:1]]
            lines.append(f"{role}:{text}")
        elif edit == "R":
            lines.append(f"{self._next_role()}:{text}")
        self.at += 1
        for _ in range(copies - 1):
            lines += self.insertions()
            self.at += 1
        return lines


def fault(text: str, first: bool) -> str | None:
    """The first fault of a row: blank, duplicate or truncated."""
    shown = text.strip(WHITE)
    if not shown:
        return "blank"
    if not first:
        return "duplicate"
    return None if shown[-1] in ".!?" else "truncated"


class Span:
    """What is known of consecutive rows of one conversation, as sums that add up over spans."""

    SUMS = ("blank", "duplicate", "truncated", "illegal", "turns")

    def __init__(self, conv_id, place: int):
        self.conv_id, self.place, self.rows = conv_id, place, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.head = self.tail = None

    def add(self, turn: int | None, role: str, text: str, copies: int, first: bool) -> None:
        if not copies:
            return
        kind = fault(text, first)
        gone = copies if kind in ("blank", "duplicate") else copies - 1
        if gone < copies:
            self.rows.append((role[:1], kind == "truncated", 1))
            self.truncated += kind == "truncated"
        if gone:
            self.rows.append((None, False, gone))
            self.blank += gone if kind == "blank" else 0
            self.duplicate += gone if kind != "blank" else 0
        self._meet(role[:1], turn, turn, 1 if turn is not None else 0)
        self.illegal += copies - 1  # a role never follows itself
        self.tail = role[:1]

    def _meet(self, head: str, low, high, turns: int) -> None:
        """The next rows begin with role `head` and have turns from `low` to `high`."""
        if self.tail is not None:
            self.illegal += self.tail + head not in LEGAL
        else:
            self.head = head
        if low is not None:
            self.turns += turns - (low == self.high)
            self.low, self.high = low if self.low is None else self.low, high

    def extend(self, other: dict) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + other[name])
        if other["head"] is not None:
            self._meet(other["head"], other["low"], other["high"], other["turns"])
            self.tail = other["tail"]

    def counts(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal


_WHOLE = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_SPAN = "place long, low long, high long, turns long, head string, tail string, cells string"
_FOUND = f"{_WHOLE}, repaired_sha256 string, {_SPAN}"
_CHUNK = "conv_id long, place long, number long, lines binary"
_HASHED = "conv_id long, repaired_sha256 string"
_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    schema = pa.schema([(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(", "))])
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _open_row(span: Span, cells: Cells) -> tuple:
    """A span of a conversation that may go on; its result is not known yet."""
    packed = json.dumps([[p, q, *cell] for (p, q), cell in cells.items()])
    ends = (span.place, span.low, span.high, span.turns, span.head, span.tail)
    return (*span.counts(), None, None, None, *ends, packed)


def _cells(packed: str) -> Cells:
    return {(p, q): tuple(cell) for p, q, *cell in json.loads(packed)}


def _tupled(batch: pa.RecordBatch, *names: str):
    return zip(*[batch[n].to_pylist() for n in names])


def _parse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations, repaired; and the spans of those at either end of a run of rows."""
    span, texts, starts_run, last, out = None, [], True, None, []

    def finish(ends_run: bool) -> None:
        cells = parse(span.rows)
        if starts_run or ends_run:
            named = {(p, q): (cost, audit, f"{p}@{span.place};") for (p, q), (cost, audit, _) in cells.items()}
            out.append(_open_row(span, named))
            return
        cost, audit, _, _ = best(cells)
        replay = Replay(audit)
        lines = [line for row in texts for line in replay.row(*row)] + replay.insertions()
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((*span.counts(), cost, audit, digest, *[None] * 7))

    for batch in batches:
        for conv, turn, role, text, copies, first, place in _tupled(
            batch, "conv_id", "turn", "role", "text", "copies", "first", "place"
        ):
            broken = last is not None and place != last + 1
            if span is None or broken or conv != span.conv_id:
                if span is not None:
                    finish(broken)
                starts_run = span is None or broken
                span, texts = Span(conv, place), []
            last = place
            span.add(turn, role, text, copies, first)
            if copies and not starts_run:
                texts.append((role, text, copies))
        yield _batch(out, _FOUND)
        out = []
    if span is not None:
        finish(True)
        yield _batch(out, _FOUND)


def _join_spans(left: pa.Table) -> pa.Table:
    """Neighbouring spans of one conversation as one."""
    rows = left.sort_by("place").to_pylist()
    span = Span(rows[0]["conv_id"], rows[0]["place"])
    for row in rows:
        span.extend(row)
    cells = joined([_cells(row["cells"]) for row in rows])
    return pa.Table.from_batches([_batch([_open_row(span, cells)], _FOUND)])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost, audit and path of conversations whose cells are complete."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            cost, audit, path, end = best(_cells(row["cells"]))
            counts = [row[f.split()[0]] for f in _WHOLE.split(", ")[:6]]
            out.append((*counts, cost, audit, f"{path}{end}@"))
        yield _batch(out, f"{_WHOLE}, path string")


def _replay_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns of open conversations in chunks. Before the rows of a span comes a row with its
    cells and the states from which and to which it leads."""
    replay, lines, size, number, conv, at = None, [], 0, 0, None, None

    def chunk() -> pa.RecordBatch:
        nonlocal lines, size, number
        data = "".join(f"\n{line}" for line in lines).encode()
        lines, size, number = [], 0, number + 1
        return _batch([(conv, at, number, data)], _CHUNK)

    for batch in batches:
        for place, own, role, text, copies, cells, step in _tupled(
            batch, "place", "conv_id", "role", "text", "copies", "cells", "step"
        ):
            if cells is not None:
                if replay:
                    lines += replay.insertions()
                    yield chunk()
                before, after = map(int, step.split(">"))
                replay, conv, at, number = Replay(_cells(cells)[before, after][1], before), own, place, 0
            elif copies:
                lines += replay.row(role, text, copies)
                size += len(text)
                if size > CHUNK_BYTES:
                    yield chunk()
    if replay:
        lines += replay.insertions()
        yield chunk()


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per conversation over its chunks, which stream by in order."""
    conv, digest, begun = None, None, False
    for batch in batches:
        out = []
        for own, lines in _tupled(batch, "conv_id", "lines"):
            if digest is None or own != conv:
                if digest is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest, begun = own, hashlib.sha256(), False
            digest.update(lines if begun else lines[1:])
            begun = begun or bool(lines)
        yield _batch(out, _HASHED)
    if digest is not None:
        yield _batch([(conv, digest.hexdigest())], _HASHED)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the damage leaves them, with the number of copies: none of
    those that it drops, which still name their conversation."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    role, text = said("role"), said("text")
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _placed(rows: DataFrame) -> DataFrame:
    """Distinct rows with their copies, sorted and numbered; `first` marks those whose role and text
    their conversation has not had before."""
    keyed = rows.select(
        "*",
        F.col("conv_id").isNotNull().alias("has_conv"),
        F.coalesce("conv_id", F.lit(0)).alias("conv"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce("turn", F.lit(0)).alias("at"),
        F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256).alias("key"),
    )
    unique = ["has_conv", "conv", "has_turn", "at", "key"]
    once = keyed.groupBy(unique).agg(
        F.first("role").alias("role"), F.first("text").alias("text"), F.sum("copies").alias("copies")
    )
    firsts = (
        keyed.where("copies > 0")
        .groupBy("has_conv", "conv", "key")
        .agg(F.min(F.struct("has_turn", "at")).alias("least"))
        .select("has_conv", "conv", "least.has_turn", "least.at", "key", F.lit(True).alias("first"))
    )
    order = ["has_conv", "conv", "has_turn", "at", "role", "key"]
    return (
        once.join(firsts, unique, "left")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            F.when(F.col("has_conv"), F.col("conv")).alias("conv_id"), F.when(F.col("has_turn"), F.col("at")).alias("turn"),
            "role", "text", "copies", F.coalesce("first", F.lit(False)).alias("first"),
            F.monotonically_increasing_id().alias("place"),
        )
    )


def repair(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: its faults, the least cost of a repair, the audit and the hash of the
    repaired turns.

    `conversations` may have a column `copies`, with 0 for rows that only name their conversation. Null
    roles and texts count as one space. Null conversation ids are one conversation. Rows come by turn,
    nulls first; of one turn by role and SHA-256 of role and text; alike rows stand side by side, all
    but the first duplicates. Other columns are not read. An empty table gives no rows.

    Memory is bounded by a part of the sorted rows, whatever the length of a conversation; only its audit
    is one value, and its hash, which cannot be split, streams through one task in chunks.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.col("copies").cast("long") if "copies" in conversations.columns else F.lit(1).cast("long")
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        said(role_col).alias("role"), said(text_col).alias("text"), copies.alias("copies"),
    )
    placed = materialize(_placed(rows), "placed-turns")
    found = materialize(placed.mapInArrow(_parse_rows, _FOUND), "parsed-turns")
    result = [f.split()[0] for f in _WHOLE.split(", ")] + ["repaired_sha256"]
    closed = found.where("cells IS NULL").select(result)
    spans = found.where("cells IS NOT NULL")
    parts = F.shiftright("place", 33)
    most = spans.agg(F.max(parts)).first()[0]
    if most is None:
        return closed
    whole, fan = spans, 1
    while fan <= most or fan == 1:
        fan *= FAN
        whole = materialize(
            whole.groupBy("conv_id", F.floor(F.shiftright("place", 33) / fan)).applyInArrow(_join_spans, _FOUND), "spans"
        )
    decided = materialize(whole.mapInArrow(_decide, f"{_WHOLE}, path string"), "decided")
    steps = decided.select(F.split("path", ";").alias("path")).select(
        F.explode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] AS here, path[i] AS next))"))
    )
    state = lambda c: F.split_part(F.col(c), F.lit("@"), F.lit(1))
    steps = steps.select(
        F.split_part("col.here", F.lit("@"), F.lit(2)).cast("long").alias("place"),
        F.concat(state("col.here"), F.lit(">"), state("col.next")).alias("step"),
    )
    marks = spans.join(steps, "place").select("place", "conv_id", "cells", "step")
    again = placed.join(
        decided.select(F.col("conv_id").alias("id")), F.col("conv_id").eqNullSafe(F.col("id")), "left_semi"
    ).select("place", "conv_id", "role", "text", "copies")
    dealt = marks.unionByName(again, allowMissingColumns=True).withColumn("part", F.shiftright("place", 33))
    chunks = materialize(
        dealt.repartition("part")
        .sortWithinPartitions("place", F.col("cells").isNull())
        .mapInArrow(_replay_rows, _CHUNK),
        "repaired-turns",
    )
    hashed = (
        chunks.repartition("conv_id")
        .sortWithinPartitions("conv_id", "place", "number")
        .mapInArrow(_hash_chunks, _HASHED)
        .withColumnRenamed("conv_id", "id")
    )
    open_ones = decided.join(hashed, F.col("conv_id").eqNullSafe(F.col("id"))).select(result)
    return closed.unionByName(open_ones)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
