"""Repair of conversations: the cheapest edits that make the roles alternate, by Hirschberg's divide and conquer.

A conversation's rows are taken by turn.  Each is kept, given the other role, or deleted, and rows may be
inserted, so that the role initials read ``(s?(ua)+)?``: an automaton of four states (nothing yet, after the
system, after the user, after the assistant).  Of the cheapest edit sequences the one whose initials are
ASCII-least is wanted.

*Crossing.*  From a stretch's first state a forward vector of four costs is taken to its middle, from its last
state a backward one.  The crossing is the state with the least sum.  For ties the forward vector also carries
the order of the four states' least edit strings.  These all hold the same number of rows and end with one, so
none is the beginning of another and their order settles that of the whole strings.  Both halves are then
solved alike.  Nothing but vectors is held.

*On Spark.*  Equal rows are counted first, the rest are range-sorted by conversation and turn, so that a long
conversation lies over many partitions, and cut into chunks of ``2 ** CHUNK_BITS`` rows.  A chunk's part of a
conversation is summed up by the forward vectors from each of the four states.  Such summaries are combined in a
tree, and the crossings go down the tree the same way as within a chunk.  Only a conversation's hash, which has
to read its text in order, is made by one task, as a stream of rows.

Nulls read as one space, but null turns come first and count for no gap; a null conversation id is a
conversation of its own; rows of one turn are taken by role, then by the SHA-256 of the text; a role whose
initial is not s, u or a can only be changed or deleted.  Repeated rows are duplicates of the first.  An empty
table gives an empty result.  Other columns are not read, whatever their names.  Ids and turns are integers.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse.llm.common import bounded_batches, cut, runs, table

CHUNK_BITS = 12  # rows of a chunk, as a power of two
ROW_BITS = 33  # a row's number is its place in its partition, below the partition's number
TREE_BITS = 12  # partitions that are combined in one step, as a power of two
SPACE = " \t\n\x0b\x0c\r"
DAMAGES = 20

START, SYSTEM, USER, ASSISTANT = range(4)
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5  # costs; keeping is free
FORCED = -1  # kind of the rows that must go
#: state after an inserted row, and its role
INSERTED = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
#: state after a kept row with this initial
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "-": {}}
INITIALS = "sua-"
LEGAL = {"su", "ua", "au"}
#: inserted rows that end a conversation, by state
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

Moves = tuple[tuple[tuple[int, int, str | int], ...], ...]  # by state: (state after, cost, what orders ties)
Vector = tuple[tuple[int, int] | None, ...]  # by state: (cost, order among the states)


def row_moves(initial: str, truncated: bool) -> Moves:
    """What can be done with a row without a fault that must go: inserted rows, then the row's own edit."""
    extra = TRUNCATED * truncated
    out = []
    for state in range(4):
        options, at, before = [], state, ""
        for _ in range(3):  # after two inserted rows states come again
            cost = INSERT * len(before)
            options.append((at, cost + DELETE, before + "D"))
            options.append((INSERTED[at][0], cost + RELABEL + extra, before + "R"))
            if at in KEPT[initial]:
                options.append((KEPT[initial][at], cost + extra, before + "K"))
            at, before = INSERTED[at][0], before + "I"
        out.append(tuple(options))
    return tuple(out)


#: by kind: initial and whether truncated.  A row that must go changes no state; rows are better inserted after it
KINDS = [row_moves(i, t) for t in (False, True) for i in INITIALS]
KINDS.append(tuple(((s, 0, "D"),) for s in range(4)))  # FORCED; its cost is the same for all states, counted apart


def unit(state: int) -> Vector:
    return tuple((0, 0) if s == state else None for s in range(4))


def forward(vector: Vector, moves: Moves) -> tuple[Vector, int]:
    """The vector after one more item, less its least cost, and that."""
    best: list[tuple | None] = [None] * 4
    for have, options in zip(vector, moves, strict=True):
        if have is not None:
            for to, cost, tie in options:
                new = (have[0] + cost, have[1], tie)
                if best[to] is None or new < best[to]:
                    best[to] = new
    order = {x: i for i, x in enumerate(sorted(b[1:] for b in best if b))}
    least = min(b[0] for b in best if b)
    return tuple(None if b is None else (b[0] - least, order[b[1:]]) for b in best), least


def backward(costs: tuple[int | None, ...], moves: Moves) -> tuple[int | None, ...]:
    """Costs from each state before an item, of those after it; only their differences count."""
    got = [min((cost + costs[to] for to, cost, _ in options if costs[to] is not None), default=None) for options in moves]
    least = min(x for x in got if x is not None)
    return tuple(None if x is None else x - least for x in got)


@functools.cache
def forward_kind(vector: Vector, kind: int) -> tuple[Vector, int]:
    return forward(vector, KINDS[kind])


@functools.cache
def backward_kind(costs: tuple[int | None, ...], kind: int) -> tuple[int | None, ...]:
    return backward(costs, KINDS[kind])


def crossings(items: list, first: int, last: int, ahead: Callable = forward, back: Callable = backward) -> list[int]:
    """The states before, between and after ``items`` on the audit-least of the cheapest ways from ``first`` to ``last``."""
    states = [first, *[0] * (len(items) - 1), last]
    todo = [(0, len(items))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        left = unit(states[lo])
        for i in range(lo, mid):
            left, _ = ahead(left, items[i])
        right = tuple(0 if s == states[hi] else None for s in range(4))
        for i in range(hi - 1, mid - 1, -1):
            right = back(right, items[i])
        states[mid] = min((left[s][0] + right[s], left[s][1], s) for s in range(4)
                          if left[s] is not None and right[s] is not None)[2]
        todo += [(lo, mid), (mid, hi)]
    return states


@functools.cache
def letters(kind: int, before: int, after: int) -> str:
    """The cheapest edits of one row between two states, ASCII-least."""
    return min((cost, tie) for to, cost, tie in KINDS[kind][before] if to == after)[1]


@dataclass
class Row:
    """Equal rows of a conversation at one place, after their faults are known."""

    number: int
    turn: int | None
    initial: str
    kind: int
    copies: int
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0

    def kinds(self) -> list[int]:
        """Of the first copy, and of the others together."""
        return [self.kind, FORCED] if self.kind != FORCED and self.copies > 1 else [self.kind]

    @property
    def forced(self) -> int:
        return self.copies if self.kind == FORCED else self.copies - 1


@dataclass
class Summary:
    """A stretch of a conversation: costs and order by first and last state, and its counts."""

    moves: Moves
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str = ""
    last: str = ""
    low: int | None = None
    high: int | None = None
    turns: int = 0

    FIELDS = ("costs array<bigint>, orders array<int>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
              "first string, last string, low bigint, high bigint, turns bigint")

    def row(self) -> tuple:
        at = [{to: (cost, tie) for to, cost, tie in options} for options in self.moves]
        cells = [options.get(s) for options in at for s in range(4)]
        return ([None if c is None else c[0] for c in cells], [None if c is None else c[1] for c in cells], self.blank, self.duplicate,
                self.truncated, self.illegal, self.first, self.last, self.low, self.high, self.turns)

    @classmethod
    def of(cls, costs: list, orders: list, *counts) -> Summary:
        cells = list(zip(range(16), costs, orders, strict=True))
        return cls(tuple(tuple((i % 4, c, o) for i, c, o in cells[4 * s:4 * s + 4] if c is not None) for s in range(4)), *counts)

    def whole(self) -> tuple[int, int]:
        """(last state, cost) of a conversation that is this stretch alone."""
        cost, _, state = min((cost + INSERT * len(TAIL[s]), tie, s) for s, cost, tie in self.moves[START])
        return state, cost


def summary(rows: list[Row]) -> Summary:
    kinds = [k for r in rows for k in r.kinds()]
    forced = DELETE * sum(r.forced for r in rows)
    moves = []
    for state in range(4):
        vector, cost = unit(state), forced
        for k in kinds:
            vector, more = forward_kind(vector, k)
            cost += more
        moves.append(tuple((s, v[0] + cost, v[1]) for s, v in enumerate(vector) if v is not None))
    turns = [r.turn for r in rows if r.turn is not None]
    return Summary(
        tuple(moves), sum(r.blank for r in rows), sum(r.duplicate for r in rows), sum(r.truncated for r in rows),
        sum(r.copies - 1 for r in rows) + sum(a.initial + b.initial not in LEGAL for a, b in zip(rows[:-1], rows[1:], strict=True)),
        rows[0].initial, rows[-1].initial, turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)))


def combined(parts: list[Summary]) -> Summary:
    """Of neighbouring stretches."""
    moves = []
    for state in range(4):
        vector, cost = unit(state), 0
        for p in parts:
            vector, more = forward(vector, p.moves)
            cost += more
        moves.append(tuple((s, v[0] + cost, v[1]) for s, v in enumerate(vector) if v is not None))
    dated = [p for p in parts if p.turns]
    return Summary(
        tuple(moves), sum(p.blank for p in parts), sum(p.duplicate for p in parts), sum(p.truncated for p in parts),
        sum(p.illegal for p in parts) + sum(a.last + b.first not in LEGAL for a, b in zip(parts[:-1], parts[1:], strict=True)),
        parts[0].first, parts[-1].last, dated[0].low if dated else None, dated[-1].high if dated else None,
        sum(p.turns for p in dated) - sum(a.high == b.low for a, b in zip(dated[:-1], dated[1:], strict=True)))


def edits(rows: list[Row], first: int, last: int) -> list[tuple[int, str, list[str], str | None]]:
    """(row number, edit initials, inserted roles, the row's new role) of each of ``rows``; the new role is empty for a
    kept row and null for a deleted one."""
    kinds = [k for r in rows for k in r.kinds()]
    states = crossings(kinds, first, last, forward_kind, backward_kind)
    out, at = [], 0
    for r in rows:
        # only a row that need not go can have inserted rows before it
        own = "D" * r.copies if r.kind == FORCED else letters(r.kind, states[at], states[at + 1]) + "D" * (r.copies - 1)
        edit, state, inserted = own.lstrip("I")[0], states[at], []
        for _ in range(len(own) - len(own.lstrip("I"))):
            state, role = INSERTED[state]
            inserted.append(role)
        out.append((r.number, own, inserted, {"K": "", "D": None, "R": INSERTED[state][1]}[edit]))
        at += len(r.kinds())
    return out


def _key(conv: Column) -> list[Column]:
    return [conv.isNull().cast("int").alias("no_conv"), F.coalesce(conv.cast("bigint"), F.lit(0)).cast("bigint").alias("conv")]


CONV = ["no_conv", "conv"]


def sorted_rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The distinct rows with their number of copies, numbered in order of conversation and turn."""
    rows = conversations.select(*_key(F.col(conv_col)), F.col(turn_col).cast("bigint").alias("turn"),
                                F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    rows = rows.groupBy(*CONV, "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    order = [*CONV, F.col("turn").asc_nulls_first(), "role", "digest"]
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    return rows.withColumn("number", F.monotonically_increasing_id())  # of the written partitions, whose order is fixed


def chunk_items(rows: DataFrame) -> DataFrame:
    """What a chunk has to know of its rows (item 1), and which of them are the first of their role and text (item 0)."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    fault = F.when(bare == "", F.lit("blank")).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), F.lit("truncated"))
    items = rows.select("number", *CONV, F.lit(1).alias("item"), "turn", F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"),
                        fault.alias("fault"), "copies")
    seen = rows.groupBy(*CONV, "role", "digest").agg(F.min("number").alias("number")).select("number", *CONV, F.lit(0).alias("item"))
    both = items.unionByName(seen, allowMissingColumns=True)
    return cut(both.withColumn("chunk", F.shiftright("number", CHUNK_BITS)))


def conversations_of(t: pa.Table) -> Iterator[tuple[tuple[int, int], list[Row], tuple[int, int] | None]]:
    """(conversation, its rows, its states) of a chunk's items, sorted by number and item."""
    found: dict[tuple[int, int], list[Row]] = {}
    states: dict[tuple[int, int], tuple[int, int]] = {}
    first = None
    for r in t.to_pylist():
        conv = (r["no_conv"], r["conv"])
        if r["item"] < 0:
            states[conv] = (r["from_state"], r["to_state"])
        elif r["item"] == 0:
            first = r["number"]
        else:
            fault = r["fault"] if r["fault"] == "blank" or first == r["number"] else "duplicate"
            n = r["copies"]
            row = Row(r["number"], r["turn"], r["initial"], FORCED, n)
            if fault == "blank":
                row.blank = n
            elif fault == "duplicate":
                row.duplicate = n
            else:
                row.duplicate, row.truncated = n - 1, int(fault == "truncated")
                row.kind = INITIALS.index(r["initial"]) + len(INITIALS) * row.truncated
            found.setdefault(conv, []).append(row)
    for conv, rows in found.items():
        yield conv, rows, states.get(conv)


def _by(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table], list[tuple]], schema: str) -> DataFrame:
    """Rows of ``work`` for each run of equal integer ``keys``."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for t in runs(batches, keys):
            if got := work(t):
                yield pa.RecordBatch.from_pylist([dict(zip(names, g, strict=True)) for g in got], schema=types)

    from pyspark.sql.pandas.types import to_arrow_schema
    types = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


NODE = "node bigint, no_conv int, conv bigint"


def leaves(items: DataFrame) -> DataFrame:
    """A summary for each chunk and conversation; ``edge`` marks those that may go on in another chunk."""
    def work(t: pa.Table) -> list[tuple]:
        chunk, got = t.column("chunk")[0].as_py(), list(conversations_of(t))
        out = []
        for i, (conv, rows, _) in enumerate(got):
            s = summary(rows)
            out.append((chunk, *conv, int(i in (0, len(got) - 1)), *s.whole(), *s.row()))
        return out

    return cut(_by(items, ["chunk"], ["number", "item"], work, f"{NODE}, edge int, to_state int, cost bigint, {Summary.FIELDS}"))


def _summaries(t: pa.Table) -> list[Summary]:
    names = [x.split()[0] for x in Summary.FIELDS.split(", ")]
    return [Summary.of(*(r[n] for n in names)) for r in t.to_pylist()]


def up(nodes: DataFrame, bits: int) -> DataFrame:
    """Neighbouring nodes of a conversation combined."""
    def work(t: pa.Table) -> list[tuple]:
        s = combined(_summaries(t))
        return [(*(t.column(c)[0].as_py() for c in ("parent", *CONV)), *s.whole(), *s.row())]

    return cut(_by(nodes.withColumn("parent", F.shiftright("node", bits)), ["parent", *CONV], ["node"], work,
                   f"{NODE}, to_state int, cost bigint, {Summary.FIELDS}"))


def down(nodes: DataFrame, states: DataFrame, bits: int) -> DataFrame:
    """(node, conversation, from_state, to_state) of ``nodes``, of those of the nodes that they were combined to."""
    def work(t: pa.Table) -> list[tuple]:
        ends = (t.column(c)[0].as_py() for c in ("from_state", "until_state"))
        got = crossings([s.moves for s in _summaries(t)], *ends)
        keys = zip(*(t.column(c).to_pylist() for c in ("node", *CONV)), strict=True)
        return [(*k, a, b) for k, a, b in zip(keys, got[:-1], got[1:], strict=True)]

    above = states.select(F.col("node").alias("parent"), *CONV, "from_state", F.col("to_state").alias("until_state"))
    both = nodes.withColumn("parent", F.shiftright("node", bits)).join(above, ["parent", *CONV])
    return cut(_by(both, ["parent", *CONV], ["node"], work, f"{NODE}, from_state int, to_state int"))


@dataclass
class Repair:
    """``rows``: numbered distinct rows; ``edits``: (number, conversation, audit, inserted, new_role) of each;
    ``roots``: a summary for each conversation, with its last state and cost."""

    rows: DataFrame
    edits: DataFrame
    roots: DataFrame


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> Repair:
    """The cheapest, ASCII-least edits of every conversation."""
    bounded_batches(conversations.sparkSession)
    rows = sorted_rows(conversations, conv_col, turn_col, role_col, text_col)
    items = chunk_items(rows)
    nodes = leaves(items)
    own = ["node", *CONV, F.lit(START).alias("from_state"), "to_state"]
    apart = nodes.where("edge = 0")
    level, tree = nodes.where("edge = 1"), []
    # first the chunks of a partition, then partitions
    bits = ROW_BITS - CHUNK_BITS
    while not level.groupBy(*CONV).count().where("count > 1").isEmpty():
        tree.append((level, bits))
        level = up(level, bits)
        bits = TREE_BITS
    roots = apart.drop("edge").unionByName(level.drop("edge") if "edge" in level.columns else level)
    states = level.select(*own)
    for children, bits in reversed(tree):
        states = down(children, states, bits)
    known = apart.select(*own).unionByName(states).select(
        F.col("node").alias("chunk"), *CONV, F.lit(-1).alias("item"), F.lit(-1).cast("bigint").alias("number"), "from_state", "to_state")

    def work(t: pa.Table) -> list[tuple]:
        return [(number, *conv, own, inserted, role) for conv, rows, states in conversations_of(t)
                for number, own, inserted, role in edits(rows, *states)]

    done = _by(items.unionByName(known, allowMissingColumns=True), ["chunk"], ["number", "item"], work,
               "number bigint, no_conv int, conv bigint, audit string, inserted array<string>, new_role string")
    tail = F.col("to_state")
    ends = roots.select(F.lit(2 ** 63 - 1).alias("number"), *CONV, F.when(tail == SYSTEM, TAIL[SYSTEM]).when(tail == USER, TAIL[USER]).otherwise("").alias("audit"),
                        F.when(tail == SYSTEM, F.array(F.lit("user"), F.lit("assistant"))).when(tail == USER, F.array(F.lit("assistant")))
                        .otherwise(F.array().cast("array<string>")).alias("inserted"), F.lit(None).cast("string").alias("new_role"))
    return Repair(rows, cut(done.unionByName(ends)), roots)


def repaired_rows(r: Repair) -> DataFrame:
    """(no_conv, conv, number, place, turn, role, text) of the repaired conversations, in order of number and place; inserted rows
    have no turn and an empty text."""
    kept = r.rows.join(r.edits.where("new_role is not null").select("number", "inserted", "new_role"), "number").select(
        *CONV, "number", F.size("inserted").alias("place"), "turn", F.when(F.col("new_role") == "", F.col("role")).otherwise(F.col("new_role")).alias("role"), "text")
    new = r.edits.select(*CONV, "number", F.posexplode("inserted").alias("place", "role")).select(
        *CONV, "number", "place", F.lit(None).cast("bigint").alias("turn"), "role", F.lit("").alias("text"))
    return kept.unionByName(new)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report(r: Repair, all_rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of ``all_rows``.

    A conversation's edits and texts come to one task in order and are hashed as they come.
    """
    gap = F.when(F.col("turns") > 0, F.col("high").cast("decimal(20,0)") - F.col("low") + 1 - F.col("turns")).otherwise(0)
    counts = r.roots.select(*CONV, F.lit(-2).cast("bigint").alias("number"), F.array(
        F.least(gap, F.lit(2 ** 63 - 1)).cast("bigint"), *(F.col(c) for c in COUNTS[1:])).alias("counts"))
    heads = all_rows.select(*_key(F.col(conv_col))).distinct().withColumn("number", F.lit(-3).cast("bigint"))
    # an edit stands before its text
    parts = (heads.unionByName(counts, allowMissingColumns=True).unionByName(r.edits, allowMissingColumns=True)
             .unionByName(r.rows.select(*CONV, "number", "role", "text"), allowMissingColumns=True)
             .withColumn("is_text", F.col("text").isNotNull()))
    columns = [*CONV, "number", "counts", "audit", "inserted", "new_role", "role", "text"]
    names = [conv_col, *COUNTS, "audit", "repaired_sha256"]
    schema = f"`{conv_col}` bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string"

    def run(batches):
        conv = None
        counts, audit, digest, lines = [], [], hashlib.sha256(), 0
        take = None  # the role of the next text, empty for its own

        def put(role: bytes, text: bytes) -> None:
            nonlocal lines
            digest.update(b"\n" * (lines > 0) + role + b":")
            digest.update(text)
            lines += 1

        def flush():
            return [None if conv[0] else conv[1], *(counts or [0] * len(COUNTS)), "".join(audit), digest.hexdigest()]

        for batch in batches:
            done = []
            cols = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            cols = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in cols]
            for no, key, _, stats, edit, inserted, new_role, role, text in zip(*(c.to_pylist() for c in cols), strict=True):
                if conv != (no, key):
                    if conv is not None:
                        done.append(flush())
                    conv, take = (no, key), None
                    counts, audit, digest, lines = [], [], hashlib.sha256(), 0
                if stats is not None:
                    counts = stats
                elif edit is not None:
                    audit.append(edit.decode())
                    for x in inserted:
                        put(x.encode(), b"")
                    take = new_role
                elif text is not None:
                    if take is not None:
                        put(take or role, text)
                    take = None
            if done:
                yield out(done)
        if conv is not None:
            yield out([flush()])

    def out(rows: list[list]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in cols[:-2]] + [pa.array(c, pa.string()) for c in cols[-2:]]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return (parts.repartition(*CONV).sortWithinPartitions(*CONV, "number", "is_text").select(*columns).mapInArrow(run, schema))


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` with every twentieth row or so lost, emptied, cut, repeated or given to the user, by a hash of id and turn."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % DAMAGES
    rows = conversations.select("conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Faults, edits and repaired digest of every conversation of ``conversations``, after damage."""
    conversations = table(spark, sf_dir, "conversations")
    return report(repair(damage(conversations)), conversations)


ORACLE_SQL = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                                        lambda c: ascii(c)::BIGINT),
                         lambda s, b: list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), xor(s, b)),
                         4294967295::BIGINT), 4294967295) % 20 AS d
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM src, range(2) AS copies(k) WHERE d <> 0 AND (k = 0 OR d = 3)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
         rtrim(text, E' \t\n\x0B\f\r') AS bare, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS ini FROM damaged),
faulty AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
         lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au') AS bad FROM numbered),
ins(p, s, letters, cost, lines) AS (VALUES
  (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''), (0, 2, 'I', 5, E'\nuser:'), (1, 2, 'I', 5, E'\nuser:'), (3, 2, 'I', 5, E'\nuser:'),
  (2, 3, 'I', 5, E'\nassistant:'), (0, 3, 'II', 10, E'\nuser:\nassistant:'), (1, 3, 'II', 10, E'\nuser:\nassistant:')),
act(s, letter, ini, t, cost, role) AS (VALUES
  (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL), (1, 'K', 'u', 2, 0, NULL), (3, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL),
  (0, 'R', '*', 2, 1, 'user'), (1, 'R', '*', 2, 1, 'user'), (3, 'R', '*', 2, 1, 'user'), (2, 'R', '*', 3, 1, 'assistant'),
  (0, 'D', '*', 0, 2, NULL), (1, 'D', '*', 1, 2, NULL), (2, 'D', '*', 2, 2, NULL), (3, 'D', '*', 3, 2, NULL)),
dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, '' AS lines FROM conversations
  UNION ALL
  SELECT conv_id, i, t, cost, audit, lines FROM (
    SELECT f.conv_id, f.i, a.t, dp.cost + n.cost + a.cost + CASE WHEN a.letter <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END AS cost,
           dp.audit || n.letters || a.letter AS audit,
           dp.lines || n.lines || CASE WHEN a.letter = 'D' THEN '' ELSE chr(10) || coalesce(a.role, f.role) || ':' || f.text END AS lines,
           row_number() OVER (PARTITION BY f.conv_id, a.t ORDER BY
             dp.cost + n.cost + a.cost + CASE WHEN a.letter <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END, dp.audit || n.letters || a.letter) AS best
    FROM dp JOIN faulty f ON dp.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = dp.i + 1 JOIN ins n ON n.p = dp.state
         JOIN act a ON a.s = n.s AND (a.ini = '*' OR a.ini = f.ini) AND (a.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate')))
  WHERE best = 1),
ended AS (
  SELECT dp.conv_id, dp.cost + n.cost AS cost, dp.audit || n.letters AS audit, dp.lines || n.lines AS lines,
         row_number() OVER (PARTITION BY dp.conv_id ORDER BY dp.cost + n.cost, dp.audit || n.letters) AS best
  FROM dp JOIN ins n ON n.p = dp.state AND n.s IN (0, 3)
       JOIN (SELECT conv_id, max(i) AS i FROM dp GROUP BY conv_id) e ON e.conv_id IS NOT DISTINCT FROM dp.conv_id AND e.i = dp.i),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal
  FROM faulty GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, cost, audit, sha256(substr(lines, 2)) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id WHERE best = 1
"""
