"""Conversation structure repair: Knuth's lightest-derivation agenda over the edits of a conversation.

Items are spans: (p, i, q) says that the first i rows of a block take the grammar of roles from state p to state q. Edits
are the axioms; a span and an edit that follows it derive a longer span. An item's weight is (cost, audit). Joining adds costs
and joins audits, which never makes a weight less than either part's, so items are final in the order of their weights
(Knuth's generalisation of Dijkstra's algorithm), and the first goal to be popped is the lightest.

Rows are sorted in ranges over the whole table. A conversation inside one range is one block. One that a range boundary or
the block size cuts is several: each block derives all pairs of states in its own task, a pass over the blocks' small weights
chooses the states between them, and the blocks are then edited where they lie.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import stored

#: Initials that each state accepts, and the state they lead to: 0 before all, 1 after s, 2 after u, 3 after a.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
STATES, GOALS = tuple(NEXT), (0, 3)
KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 2), ("D", 3), ("I", 2)
TRUNCATED = 1
ROLES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"
#: Rows and characters of a block at most (a row is never cut).
BLOCK_ROWS, BLOCK_CHARS = 1024, 1 << 20
MOST = (1 << 63) - 1

Weight = tuple[int, str]


def edits(code: str) -> Iterator[tuple[int, int, int, Weight]]:
    """The axioms of one row (or, for an empty code, of the gaps between rows): p, rows taken, q, weight.

    A row's code is the initial of its role, "o" if no grammar has it, a capital if the text is truncated, and "x" if the row must go.
    """
    for p in STATES:
        made = NEXT[p].keys() & ROLES.keys()
        if not code:
            yield from ((p, 0, NEXT[p][r], (INSERT[1], INSERT[0])) for r in made)
            continue
        yield p, 1, p, (DELETE[1], DELETE[0])
        if code == "x":
            continue
        initial, fault = code.lower(), TRUNCATED * code.isupper()
        if initial in NEXT[p]:
            yield p, 1, NEXT[p][initial], (KEEP[1] + fault, KEEP[0])
        yield from ((p, 1, NEXT[p][r], (REROLE[1] + fault, REROLE[0])) for r in made if r != initial)


EDITS = {code: {p: [e[1:] for e in edits(code) if e[0] == p] for p in STATES} for code in ["", "x", *"suaoSUAO"]}


@lru_cache(maxsize=1 << 14)
def lightest(codes: str, start: int, goals: tuple[int, ...] = STATES) -> dict[int, Weight]:
    """The lightest weights with which the rows lead from ``start`` to goal states; for the two goals of a whole conversation the
    agenda ends with the first that is popped."""
    n, final, found = len(codes), set(), {}
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    while agenda and len(found) < (1 if goals == GOALS else len(goals)):
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == n and q in goals:
            found[q] = (cost, audit)
        for axioms in (EDITS[""][q], EDITS[codes[i]][q] if i < n else ()):
            for rows, state, (more, name) in axioms:
                if (i + rows, state) not in final:
                    heapq.heappush(agenda, (cost + more, audit + name, i + rows, state))
    return found


def edited(audit: str, start: int, roles: list[str], texts: list[str]) -> list[str]:
    """The ``role:text`` lines that the edits of an audit leave; roles follow from the state, so the audit tells all."""
    state, at, lines = start, 0, []
    for edit in audit:
        if edit != INSERT[0]:
            role, text = roles[at], texts[at]
            at += 1
        if edit == DELETE[0]:
            continue
        if edit != KEEP[0]:
            role = ROLES["a" if state == 2 else "u"]
        if edit == INSERT[0]:
            text = ""
        state = NEXT[state][role[0]]
        lines.append(f"{role}:{text}")
    return lines


class Block:
    """Rows of one conversation in order, and what its report counts of them."""

    def __init__(self, conv: int | None):
        self.conv, self.codes, self.roles, self.texts, self.chars = conv, [], [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns: list[int] = []  # least, greatest
        self.distinct, self.first, self.last = 0, None, None

    def full(self) -> bool:
        return len(self.codes) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if turn is not None:
            self.distinct += not self.turns or turn != self.turns[1]
            self.turns = [self.turns[0] if self.turns else turn, turn]
        initial = role[:1]
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        if fault in ("blank", "duplicate"):
            code, role, text = "x", "", ""
        else:
            code = initial if initial and initial in "sua" else "o"
            code = code.upper() if fault else code
        self.codes.append(code)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)


def gaps(turns: list[int], distinct: int) -> int:
    return min(turns[1] - turns[0] + 1 - distinct, MOST) if turns else 0


def trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times (0 for a dropped row, 2 for a repeated one), by the checksum of conv_id and turn; nulls are one space."""
    blank = F.lit(" ")
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    key = F.concat(F.coalesce(conv.cast("string"), blank), F.lit(":"), F.coalesce(turn.cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), blank), F.coalesce(F.col("text"), blank)
    return conversations.select(
        conv.alias("conv_id"),
        turn.alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number, whether they are the first of their role and text, and their fault; sorted in ranges.

    Equal rows are counted before they are sorted, so no number of copies makes a range large.
    """
    marked = rows.withColumn("sha", F.sha2("text", 256))
    firsts = marked.filter("times > 0").groupBy("conv_id", "role", "sha").agg(F.min(F.struct("turn")).alias("least"))
    firsts = firsts.select("conv_id", "least.turn", "role", "sha", F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("times"), F.lit(True).alias("first"))
    both = marked.select("conv_id", "turn", "role", "sha", "text", "times", F.lit(False).alias("first")).union(firsts)
    each = both.groupBy("conv_id", "turn", "role", "sha").agg(F.first("text", ignorenulls=True).alias("text"), F.sum("times").alias("times"), F.max("first").alias("first"))
    end = trimmed(F.col("text"))
    fault = F.when(end == "", "blank").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    each = each.withColumns({"fault": fault, "lead": F.left("text", F.lit(64))})
    keys = ["conv_id", "turn", "role", "lead", "sha"]
    ranged = each.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    return ranged.select("conv_id", "turn", "role", "text", "times", "first", "fault", F.spark_partition_id().alias("part"))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, int, int, bool]]:
    """Blocks of the sorted rows of a range, the range, their number in it, and whether the block is a whole conversation.

    The first and the last conversation of a range may go on elsewhere; they count as cut.
    """
    block, part, number, cut = None, 0, 0, True
    for batch in batches:
        for conv, turn, role, text, times, first, fault, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B020
            if block is None or conv != block.conv:
                if block is not None:
                    yield block, part, number, not cut
                    cut = False
                block, number = Block(conv), number + 1
            for copy in range(times):
                if block.full():
                    cut = True
                    yield block, part, number, False
                    block, number = Block(conv), number + 1
                block.add(turn, role, text, fault if fault == "blank" else fault if first and not copy else "duplicate")
    if block is not None:
        yield block, part, number, False


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNTS = "blank long, duplicate long, truncated long, illegal long, low long, high long, distinct_turns long, first string, last string, n long"
PARTS = "codes string, roles array<string>, texts array<string>"
DERIVED = f"conv_id long, whole boolean, part int, number int, {REPORT.replace('blank long, duplicate long, truncated long, illegal long, ', '')}, {COUNTS}, costs array<long>, ranks array<int>, {PARTS}"


def batches_of(rows: Iterator[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a whole conversation its report; of a block of another the weights between all states, and its rows."""

    def rows() -> Iterator[dict]:
        for block, part, number, whole in blocks(batches):
            codes = "".join(block.codes)
            low, high = block.turns or (None, None)
            row = {
                "conv_id": block.conv, "whole": whole, "part": part, "number": number, "n": len(codes), "blank": block.blank, "duplicate": block.duplicate,
                "truncated": block.truncated, "illegal": block.illegal, "low": low, "high": high, "distinct_turns": block.distinct, "first": block.first, "last": block.last,
            }
            if whole:
                ((cost, audit),) = lightest(codes, 0, GOALS).values()
                lines = edited(audit, 0, block.roles, block.texts)
                sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
                yield row | {"gaps": gaps(block.turns, block.distinct), "cost": cost, "audit": audit, "repaired_sha256": sha}
            else:
                costs, ranks = [], []
                for p in STATES:
                    reached = lightest(codes, p)
                    order = sorted(audit for _, audit in reached.values())
                    costs += [reached[q][0] if q in reached else None for q in STATES]
                    ranks += [order.index(reached[q][1]) if q in reached else None for q in STATES]
                yield row | {"costs": costs, "ranks": ranks, "codes": codes, "roles": block.roles, "texts": block.texts}

    return batches_of(rows(), arrow_schema(DERIVED))


def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block, from the last of a conversation to the first, the best next state from each state.

    Of equal total costs the least audit of the block decides. Where one audit begins another, the longer goes on with an
    insertion, which the next block could make as well, so the shorter is never the worse choice.
    """

    def rows() -> Iterator[dict]:
        conv, rest = object(), {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["conv_id"] != conv:
                    conv, rest = row["conv_id"], {q: 0 for q in GOALS}
                after, best = {}, []
                for p in STATES:
                    ways = [(row["costs"][4 * p + q] + rest[q], row["ranks"][4 * p + q], q) for q in STATES if q in rest and row["costs"][4 * p + q] is not None]
                    if ways:
                        after[p] = min(ways)[0]
                    best.append(min(ways)[2] if ways else -1)
                rest = after
                yield {name: row[name] for name in ("conv_id", "part", "number", "n", "first", "last", "low", "high")} | {"best": best}

    return batches_of(rows(), arrow_schema(CHOICES), 1024)


def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the first block to the last: the states a block goes from and to, and what lies between it and the one before."""

    def rows() -> Iterator[dict]:
        conv, state, last, turn = object(), 0, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["conv_id"] != conv:
                    conv, state, last, turn = row["conv_id"], 0, None, None
                step = {"part": row["part"], "number": row["number"], "p": state, "q": row["best"][state], "seam": 0, "again": 0}
                state = step["q"]
                if row["n"]:
                    step["seam"] = int(last is not None and last + row["first"] not in ("su", "ua", "au"))
                    last = row["last"]
                if row["low"] is not None:
                    step["again"] = int(turn is not None and turn == row["low"])
                    turn = row["high"]
                yield step

    return batches_of(rows(), arrow_schema(STEPS), 1024)


CHOICES = "conv_id long, part int, number int, n long, first string, last string, low long, high long, best array<int>"
STEPS = "part int, number int, p int, q int, seam long, again long"
EDITED = "conv_id long, part int, number int, blank long, duplicate long, truncated long, illegal long, low long, high long, distinct_turns long, cost long, audit string, lines string"


def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each block, made: its cost, audit and lines (null where none is left)."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                cost, audit = lightest(row["codes"], row["p"])[row["q"]]
                lines = edited(audit, row["p"], row["roles"], row["texts"])
                same = {name: row[name] for name in ("conv_id", "part", "number", "blank", "duplicate", "truncated", "low", "high")}
                counts = {"illegal": row["illegal"] + row["seam"], "distinct_turns": row["distinct_turns"] - row["again"]}
                yield same | counts | {"cost": cost, "audit": audit, "lines": "\n".join(lines) if lines else None}

    return batches_of(rows(), arrow_schema(EDITED), 16)


def join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The report of each conversation from its blocks in order; the checksum takes in block after block."""

    def report(conv: int | None, total: dict, turns: list[int], distinct: int, audit: list[str], sha) -> dict:
        return total | {"conv_id": conv, "gaps": gaps(turns, distinct), "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

    def rows() -> Iterator[dict]:
        held = None
        for batch in batches:
            for row in batch.to_pylist():
                if held is None or row["conv_id"] != held[0]:
                    if held is not None:
                        yield report(*held)
                    held = [row["conv_id"], dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0), [], 0, [], hashlib.sha256()]
                    begun = False
                for name in held[1]:
                    held[1][name] += row[name]
                if row["low"] is not None:
                    held[2] = [held[2][0] if held[2] else row["low"], row["high"]]
                held[3] += row["distinct_turns"]
                held[4].append(row["audit"])
                if row["lines"] is not None:
                    held[5].update(("\n" if begun else "").encode() + row["lines"].encode())
                    begun = True
        if held is not None:
            yield report(*held)

    return batches_of(rows(), arrow_schema(f"conv_id long, {REPORT}"))


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: damage and cheapest repair of each conversation.

    A null conv_id is a conversation like others; null roles and texts are one space, so a null text is blank. Rows of equal
    turn stand in the order of role, of the first 64 characters of the text, then of its checksum; null turns stand first. Rows
    that repeat are duplicates but for the first. A conversation of which nothing is left has zeros, an empty audit and the
    checksum of nothing. Other columns are ignored; an empty table gives an empty result.
    """
    derived = stored(in_order(damaged(conversations)).mapInArrow(derive, DERIVED))
    columns = ["conv_id", *(field.split()[0] for field in REPORT.split(", "))]
    whole = derived.filter("whole").select(*columns)
    cut = derived.filter("not whole")
    weights = cut.select("conv_id", "part", "number", "n", "first", "last", "low", "high", "costs", "ranks")
    back = weights.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("number"))
    chosen = stored(back.mapInArrow(choose, CHOICES))
    steps = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").mapInArrow(follow, STEPS)
    made = cut.join(steps, ["part", "number"]).select(*[name for name in cut.columns if name not in ("costs", "ranks")], "p", "q", "seam", "again").mapInArrow(apply, EDITED)
    ordered = made.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    return whole.union(ordered.mapInArrow(join_blocks, f"conv_id long, {REPORT}").select(*columns))
