"""Conversation structure repair: a backward cost-to-go over turn and grammar state, then a greedy forward walk.

The grammar of role initials is `(s?(ua)+)?`. Its states are: nothing yet, after s, after u, after a. The cost-to-go of a
row and state is the least cost of edits that bring what follows to an accepted end; the walk takes, of the edits whose
cost is tight, the one whose initial (D, I, K, R) is least. As the state alone says which role must follow, the audit
fixes the repaired turns.

Rows are dealt by ranges of (conversation, turn) and sorted, so most conversations lie whole in one task, which settles
them as they stream by. Those that a task's edge cuts, or that are larger than `most_bytes`, are settled in blocks: a
block's costs are a matrix over grammar states and its walk a map of states, and both compose, so that no conversation has to
meet in one task. Only what is told of a block passes through one task, in order, a block at a time, and at the end, for a
digest, the repaired bytes: SHA-256 has to see them one after another.

Cases: null roles and texts count as one space; null conversation ids form one conversation; rows without a turn come first;
rows of one turn are ordered by a digest of role and text, so that repeated rows are neighbours; a role is known by its first
character, an empty one by none that the grammar has; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry.llm.common import materialise, release

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
COSTS = {"D": 4, "I": 3, "R": 3, "truncated": 3}
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that the role which must follow leads to, and where each initial may lead.
FOLLOWS = (USER, USER, ASSISTANT, USER)
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = frozenset(("su", "ua", "au"))
#: Least costs at the end of a conversation, by state.
LAST = (0, 2 * COSTS["I"], COSTS["I"], 0)
_FAR = 1 << 50
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: A row's code: its initial's place here, plus 4 where it must go, plus 8 where it is truncated.
_INITIALS = "sua"


def _code(initial: str, fault: str) -> int:
    return (_INITIALS.index(initial) if initial and initial in _INITIALS else 3) + 4 * (fault in ("blank", "duplicate")) + 8 * (fault == "truncated")


def _moves(code: int) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state the edits of such a row, least initial first: initial, cost, next state."""
    kept, extra = KEEPS.get(_INITIALS[code & 3] if code & 3 < 3 else "", {}), COSTS["truncated"] if code & 8 else 0
    out = []
    for state in range(4):
        moves = [("D", COSTS["D"], state)]
        if not code & 4:
            moves += [("K", extra, kept[state])] if state in kept else []
            moves.append(("R", COSTS["R"] + extra, FOLLOWS[state]))
        out.append(tuple(moves))
    return tuple(out)


MOVES = tuple(_moves(code) for code in range(16))


def _back(code: int, ahead: tuple[int, ...]) -> tuple[int, ...]:
    """Costs-to-go before a row from those behind it; inserts may come first."""
    own = [min(cost + ahead[to] for _, cost, to in moves) for moves in MOVES[code]]
    u, a = min(own[USER], COSTS["I"] + own[ASSISTANT]), min(own[ASSISTANT], COSTS["I"] + own[USER])
    return min(own[START], COSTS["I"] + u), min(own[SYSTEM], COSTS["I"] + u), u, a


def costs_to_go(codes: bytes, last: tuple[int, ...] = LAST) -> list[tuple[int, ...]]:
    """By row, and behind the last one, the costs of all states."""
    out = [last]
    for code in reversed(codes):
        out.append(_back(code, out[-1]))
    return out[::-1]


def matrix(codes: bytes) -> list[int]:
    """The least cost from each state before the rows to each state behind them, as 16 numbers."""
    ends = [costs_to_go(codes, tuple(0 if s == t else _FAR for s in range(4)))[0] for t in range(4)]
    return [min(ends[t][s], _FAR) for s in range(4) for t in range(4)]


def walk(codes: bytes, costs: list[tuple[int, ...]], state: int, ended: bool) -> tuple[str, int]:
    """The edits' initials and the state they end in; `ended` if nothing follows these rows."""
    audit = []
    for i, code in enumerate(codes):
        here, ahead = costs[i], costs[i + 1]
        while True:
            tight = [(name, to) for name, cost, to in MOVES[code][state] if cost + ahead[to] == here[state]]
            if tight and tight[0][0] == "D" or COSTS["I"] + here[FOLLOWS[state]] != here[state]:
                break
            audit.append("I")
            state = FOLLOWS[state]
        audit.append(tight[0][0])
        state = tight[0][1]
    while ended and costs[-1][state]:
        audit.append("I")
        state = FOLLOWS[state]
    return "".join(audit), state


def apply(audit: str, rows: Iterator[tuple[str, str]], state: int = START) -> list[dict]:
    """The turns that the edits make of `rows` (role, text)."""
    turns, rows = [], iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        state = KEEPS[role[0]][state] if edit == "K" else FOLLOWS[state]
        turns.append({"role": role if edit == "K" else NAMES[state], "text": text})
    return turns


def _look(text: str) -> str:
    """What is wrong with a text, taken alone."""
    inner = text.rstrip(SPACE)
    return "blank" if not inner else "truncated" if inner[-1] not in ENDS else ""


class _Tally:
    """What rows add up to: faults, different turns and codes."""

    def __init__(self):
        self.codes, self.n = bytearray(), dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "distinct"), 0)
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, initial: str, look: str, seen: bool) -> None:
        fault = "duplicate" if seen and look != "blank" else look
        if fault:
            self.n[fault] += 1
        if self.last is not None and self.last + initial not in LEGAL:
            self.n["illegal"] += 1
        if turn is not None and turn != self.high:
            self.n["distinct"] += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.first, self.last = initial if self.first is None else self.first, initial
        self.codes.append(_code(initial, fault))

    def told(self) -> dict:
        return self.n | {"first": self.first, "last": self.last, "low": self.low, "high": self.high}


def _joined(a: dict | None, b: dict) -> dict:
    """What two neighbouring runs of rows tell together."""
    if a is None:
        return dict(b)
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "distinct")}
    out["illegal"] += a["last"] is not None and b["first"] is not None and a["last"] + b["first"] not in LEGAL
    out["distinct"] -= a["high"] is not None and a["high"] == b["low"]
    for k, near, far in (("first", a, b), ("low", a, b), ("last", b, a), ("high", b, a)):
        out[k] = near[k] if near[k] is not None else far[k]
    return out


def _counts(told: dict, cost: int) -> dict:
    gaps = told["high"] - told["low"] + 1 - told["distinct"] if told["low"] is not None else 0
    return {"gaps": gaps, "blank": told["blank"], "duplicate": told["duplicate"], "truncated": told["truncated"], "illegal": told["illegal"], "cost": cost}


_TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
_LONGS = [T.StructField(c, T.LongType()) for c in _COUNTS]
_OPEN = [
    T.StructField("block", T.LongType()), T.StructField("idx", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("tie", T.BinaryType()),
    T.StructField("initial", T.StringType()), T.StructField("look", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("present", T.BooleanType()),
]
_TOLD = [T.StructField(c, T.LongType()) for c in ("blank", "duplicate", "truncated", "illegal", "distinct", "low", "high")] + [T.StructField(c, T.StringType()) for c in ("first", "last")]


def _batches(rows: Iterator[dict], schema: T.StructType, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Dictionaries as record batches of about `most` bytes of text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shape, held, size = to_arrow_schema(schema), [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row.get("text") or "") + sum(len(t["text"]) for t in row.get("turns") or ())
        if size > most:
            yield pa.RecordBatch.from_pylist(held, schema=shape)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=shape)
    release()


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def _runs(rows: Iterator[tuple], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Neighbouring rows that share their first `width` values, as streams: each must be read before the next."""
    import itertools

    return itertools.groupby(rows, key=lambda r: r[:width])


def repair(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None, most_bytes: int = 8 << 20) -> DataFrame:
    """Repaired conversations in pieces: conv_id, block, part, whole, gaps, blank, duplicate, truncated, illegal, cost, audit, turns.

    A conversation that one task sees whole is one row. The pieces of others follow one another by (block, part): their
    audits and turns (role, text) are to be joined, and the counts stand in the first one. `present` names a boolean column;
    rows where it is false only name their conversation.
    """
    own = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"), (F.coalesce(F.col(present), F.lit(True)) if present else F.lit(True)).alias("present"),
    )
    own = own.withColumn("tie", F.unhex(F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text"))))
    order = ["conv_id", "turn", "tie", "present"]
    # the last key only deals out rows that are equal
    dealt = own.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(*order, "any").sortWithinPartitions(*order)
    kind = own.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("whole", T.BooleanType()), *_LONGS, T.StructField("audit", T.StringType()), T.StructField("turns", _TURNS), *_OPEN])

    def settle(batches):
        block = TaskContext.get().partitionId()

        def out():
            held: list[tuple] = []
            size, at, now, kept_open, first = 0, 0, None, True, True

            def opened():
                for i, (_, turn, tie, role, text, here) in enumerate(held, at - len(held)):
                    yield {"conv_id": now, "whole": False, "block": block, "idx": i, "turn": turn, "tie": tie, "initial": role[:1], "look": _look(text), "role": role, "text": text, "present": here}

            for row in _rows(batches, "conv_id", "turn", "tie", "role", "text", "present"):
                if first or row[0] != now:
                    if not first:
                        yield from opened() if kept_open else iter([_whole(now, held)])
                        kept_open = False  # only the first and the last conversation of a block may be cut
                    held, size, now, first = [], 0, row[0], False
                held.append(row)
                at, size = at + 1, size + len(row[4]) + 200
                if size > most_bytes:
                    yield from opened()
                    held, size, kept_open = [], 0, True
            yield from opened()

        yield from _batches(out(), schema)

    settled = materialise(dealt.mapInArrow(settle, schema), "conversations")
    whole = settled.where("whole").select("conv_id", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("part"), "whole", *_COUNTS, "audit", "turns")
    cut = settled.where("not whole")
    return whole if cut.isEmpty() else whole.unionByName(_in_blocks(cut, kind))


def _whole(conv: object, held: list[tuple]) -> dict:
    tally, seen = _Tally(), set()
    there = [r for r in held if r[5]]
    for _, turn, tie, role, text, _ in there:
        tally.add(turn, role[:1], _look(text), tie in seen)
        seen.add(tie)
    costs = costs_to_go(bytes(tally.codes))
    audit, _ = walk(bytes(tally.codes), costs, START, True)
    return {"conv_id": conv, "whole": True, "audit": audit, "turns": apply(audit, ((r[3], r[4]) for r in there))} | _counts(tally.told(), costs[0][START])


def _in_blocks(cut: DataFrame, kind: T.DataType) -> DataFrame:
    """Pieces of the conversations that lie in several blocks, or are too large to be held."""
    name = F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string"))).alias("key")
    rows = cut.select(name, "conv_id", *(f.name for f in _OPEN))
    # blocks whose rows have roles and texts that an earlier block has
    ties = rows.where("present").groupBy("key", "tie", "block").agg(F.lit(1).alias("one")).groupBy("key", "tie").agg(F.sort_array(F.collect_set("block")).alias("blocks"))
    seen = ties.where("size(blocks) > 1").select("key", "tie", F.explode(F.expr("slice(blocks, 2, size(blocks))")).alias("block"))
    light = rows.select("key", "block", F.lit(1).alias("kind"), "idx", "tie", "turn", "initial", "look", "present")
    both = light.unionByName(seen.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    grouped = both.repartition("key", "block").sortWithinPartitions("key", "block", "kind", "idx")
    told = T.StructType([T.StructField("key", T.StringType()), T.StructField("block", T.LongType()), T.StructField("codes", T.BinaryType()), T.StructField("costs", T.ArrayType(T.LongType())), *_TOLD])

    def code(batches):
        def out():
            for (key, block), run in _runs(_rows(batches, "key", "block", "kind", "tie", "turn", "initial", "look", "present"), 2):
                tally, known = _Tally(), set()
                for _, _, is_row, tie, turn, initial, look, present in run:
                    if is_row and not present:
                        continue
                    if is_row:
                        tally.add(turn, initial, look, tie in known)
                    known.add(tie)
                codes = bytes(tally.codes)
                yield {"key": key, "block": block, "codes": codes, "costs": matrix(codes)} | tally.told()

        yield from _batches(out(), told)

    blocks = materialise(grouped.mapInArrow(code, told), "conversation-blocks")
    fields = [T.StructField("key", T.StringType()), T.StructField("block", T.LongType())]
    ahead_schema = T.StructType([*fields, T.StructField("ahead", T.ArrayType(T.LongType())), T.StructField("ended", T.BooleanType()), *_LONGS])

    def backward(batches):
        def out():
            names = ("key", "block", "costs", *(f.name for f in _TOLD))
            for (key,), run in _runs(_rows(batches, *names), 1):
                costs, told, held = LAST, None, None
                for _, block, m, *rest in run:
                    if held:
                        yield held
                    held = {"key": key, "block": block, "ahead": list(costs), "ended": told is None}
                    costs = tuple(min(m[4 * s + t] + costs[t] for t in range(4)) for s in range(4))
                    here = dict(zip(names[3:], rest, strict=True))
                    told = here if told is None else _joined(here, told)
                yield held | _counts(told, costs[START])  # the first block has the counts of all

        yield from _batches(out(), ahead_schema)

    of_all = blocks.drop("codes").repartition("key").sortWithinPartitions("key", F.col("block").desc())
    ahead = blocks.select("key", "block", "codes").join(of_all.mapInArrow(backward, ahead_schema), ["key", "block"])
    mapped = T.StructType([*fields, T.StructField("ends", T.ArrayType(T.LongType()))])

    def ends(batches):
        def out():
            for key, block, codes, ahead, ended in _rows(batches, "key", "block", "codes", "ahead", "ended"):
                costs = costs_to_go(codes, tuple(ahead))
                yield {"key": key, "block": block, "ends": [walk(codes, costs, s, ended)[1] for s in range(4)]}

        yield from _batches(out(), mapped)

    begun = T.StructType([*fields, T.StructField("state", T.LongType())])

    def forward(batches):
        def out():
            for (key,), run in _runs(_rows(batches, "key", "block", "ends"), 1):
                state = START
                for _, block, ends in run:
                    yield {"key": key, "block": block, "state": state}
                    state = ends[state]

        yield from _batches(out(), begun)

    states = ahead.mapInArrow(ends, mapped).repartition("key").sortWithinPartitions("key", "block").mapInArrow(forward, begun)
    plan = ahead.join(states, ["key", "block"]).withColumn("kind", F.lit(0))
    texts = rows.where("present").select("key", "conv_id", "block", F.lit(1).alias("kind"), "idx", "role", "text")
    named = plan.join(rows.groupBy("key").agg(F.first("conv_id").alias("conv_id")), "key")
    pieces = T.StructType([T.StructField("conv_id", kind), T.StructField("block", T.LongType()), T.StructField("part", T.LongType()), T.StructField("whole", T.BooleanType()), *_LONGS, T.StructField("audit", T.StringType()), T.StructField("turns", _TURNS)])
    columns = ("key", "block", "kind", "conv_id", "role", "text", "codes", "ahead", "ended", "state", *_COUNTS)

    def piece(batches):
        def out():
            for (_, block), run in _runs(_rows(batches, *columns), 2):
                conv, codes, ahead, ended, state, *counts = (lambda r: (r[3], *r[6:]))(next(run))
                audit, _ = walk(codes, costs_to_go(codes, tuple(ahead)), state, ended)
                counts, part, begin = dict(zip(_COUNTS, counts, strict=True)), 0, 0
                while begin < len(audit) or not part:
                    # a stretch of edits whose texts are about a megabyte
                    stop, size, some = begin, 0, []
                    while stop < len(audit) and size < 1 << 20:
                        if audit[stop] != "I":
                            some.append(next(run)[4:6])
                            size += len(some[-1][1])
                        size, stop = size + 100, stop + 1
                    turns = apply(audit[begin:stop], iter(some), state)
                    state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[turns[-1]["role"][0]] if turns else state
                    yield {"conv_id": conv, "block": block, "part": part, "whole": False, "audit": audit[begin:stop], "turns": turns} | (dict.fromkeys(_COUNTS) if part else counts)
                    part, begin = part + 1, stop

        yield from _batches(out(), pieces)

    together = texts.unionByName(named, allowMissingColumns=True).select("idx", *columns)
    return together.repartition("key", "block").sortWithinPartitions("key", "block", "kind", "idx").mapInArrow(piece, pieces)


def digests(pieces: DataFrame) -> DataFrame:
    """One row for each conversation of `repair`: conv_id, counts, audit and repaired_sha256 over `role:text` lines.

    Conversations in one piece are hashed where they are; the pieces of others stream through a task in order, a piece at a time.
    """
    columns = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = pieces.where("whole").withColumn("repaired_sha256", F.sha2(lines, 256)).select(*columns)
    schema = T.StructType([pieces.schema["conv_id"], *_LONGS, T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches):
        def out():
            for (conv,), rows in _runs(_rows(batches, "conv_id", "audit", "turns", *_COUNTS), 1):
                digest, audit, counts, begun = hashlib.sha256(), [], None, False
                for _, part, turns, *own in rows:
                    counts = own if counts is None else counts
                    audit.append(part)
                    for t in turns:
                        digest.update(f"{chr(10) if begun else ''}{t['role']}:{t['text']}".encode())
                        begun = True
                yield {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()} | dict(zip(_COUNTS, counts, strict=True))

        yield from _batches(out(), schema)

    cut = pieces.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")
    return whole.unionByName(cut.mapInArrow(run, schema).select(*columns))


def damaged(rows: DataFrame) -> DataFrame:
    """`conversations` with the faults that the contract plants; a row that it drops stays with `present` false."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    pick = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), pick.alias("pick"))
    text = F.when(F.col("pick").isin(0, 1), "").when(F.col("pick") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("pick") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("pick") != 0).alias("present"),
        F.explode(F.when(F.col("pick") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return digests(repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), present="present"))
