"""Chat formatting with minimum-cost role repair (operator 2).

A legal chat is an optional system turn and then user and assistant turns by turns, user first.  Each input turn may keep
its role, be relabelled, be merged into the output turn before it, or have an empty turn inserted before it; dynamic
programming over the states of that automaton finds the cheapest repair, which is then rendered.

A conversation may be longer than a task should hold, so rows are range-partitioned by (conv_id, turn).  Only the first
and last conversation of a partition can go on in another; for these, each partition gives the cost between every pair of
states (a 4 x 4 matrix), the driver chains these few matrices and answers with the states at the partition's edges.
Of equally cheap repairs a hash of the rows picks one, so the result doesn't depend on the partitioning.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common as C

BEGIN, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
NEXT = {BEGIN: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ENDS = (USER, ASSISTANT)
MERGE, RELABEL, GUESS, INSERT = 1, 2, 1, 3  # costs; GUESS: giving a role to a turn whose role is unknown
ALIAS = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "gpt": ASSISTANT}
FAR = 1 << 60
HASH_BITS = 32  # the sum of 8-bit tie-breaks of 16 million turns stays below one unit of cost


def _moves(role: int) -> dict[tuple[int, int], tuple[int, str, int]]:
    """(state, next state) -> (cost, action, inserted role) of the cheapest move for a turn of that role (0: unknown)."""
    out: dict = {}

    def offer(s, q, cost, action, inserted=BEGIN):
        if (s, q) not in out or cost < out[s, q][0]:
            out[s, q] = cost, action, inserted

    def label(q):
        return 0 if q == role else RELABEL if role else GUESS

    for s in range(4):
        if s:
            offer(s, s, MERGE + label(s), "merge" if s == role else "merge_relabel")
        for q in NEXT[s]:
            offer(s, q, label(q), "keep" if q == role else "relabel")
        for x in NEXT[s]:
            for q in NEXT[x]:
                offer(s, q, INSERT + label(q), "keep" if q == role else "relabel", x)
    return out


MOVES = [_moves(r) for r in range(4)]


def role_of(name: str | None) -> int:
    return ALIAS.get((name or "").strip().lower(), BEGIN)


def _weights(role: int, tie: int) -> list[tuple[int, int, int]]:
    return [(s, q, (m[0] << HASH_BITS) + ((tie >> (2 * (4 * s + q) % 24)) & 255)) for (s, q), m in MOVES[role].items()]


def forward(turns: list[tuple[int, int]], start: list[int]) -> list[list[int]]:
    """Least cost of each state after each turn."""
    at = [start]
    for role, tie in turns:
        new, old = [FAR] * 4, at[-1]
        for s, q, w in _weights(role, tie):
            if old[s] + w < new[q]:
                new[q] = old[s] + w
        at.append(new)
    return at


def trace(turns: list[tuple[int, int]], at: list[list[int]], end: int) -> list[tuple[int, int]]:
    """(state before, state after) of each turn on the cheapest path that ends in the given state."""
    path = []
    for i in range(len(turns), 0, -1):
        s = min((x for x in _weights(*turns[i - 1]) if x[1] == end), key=lambda x: (at[i - 1][x[0]] + x[2], x[0]))[0]
        path.append((s, end))
        end = s
    return path[::-1]


def only(state: int) -> list[int]:
    return [0 if s == state else FAR for s in range(4)]


def repair(roles: list[str | None]) -> tuple[int, list[tuple[str, str, str | None]]]:
    """(cost, [(output role, action, role of the empty turn inserted before it)]) of one conversation."""
    turns = [(role_of(r), 0) for r in roles]
    if not turns:
        return 0, []
    at = forward(turns, only(BEGIN))
    end = min(ENDS + (SYSTEM,), key=lambda s: (at[-1][s] + (0 if s in ENDS else INSERT << HASH_BITS), s))
    out = []
    for (role, _), (s, q) in zip(turns, trace(turns, at, end)):
        _, action, x = MOVES[role][s, q]
        out.append((NAMES[q], action, NAMES[x] or None))
    return at[-1][end] >> HASH_BITS, out


def _end_cost(at: list[int]) -> int:
    """The best last state; a chat that is a system turn alone is kept as it is, at the cost of an insertion."""
    return min((SYSTEM, *ENDS), key=lambda s: (at[s] + (0 if s in ENDS else INSERT << HASH_BITS), s))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row for each row of ``turns(conv_id, turn, role, text)``: out_role, action (keep, relabel, merge,
    merge_relabel), inserted (role of the empty turn put before it, else null), cost, and piece; the pieces of a
    conversation in the order of (turn, role, text) are its rendered text.  Other columns are kept; result columns replace
    columns of the same name.

    Null and unknown roles take the cheapest role; a null text is empty; a null turn comes first, and rows of the same turn
    stand in the order of their roles and texts.  Rows with a null conv_id are one conversation.
    """
    spark = turns.sparkSession
    made = ("out_role", "action", "inserted", "cost", "piece")
    carried = [c for c in turns.columns if c not in made]
    n = C.parts_for(0, spark)
    order = ["conv_id", "turn", "role", "text"]
    ranged = turns.select(*carried).repartitionByRange(n, *order).sortWithinPartitions(*order)

    def number(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array(range(at, at + k), pa.int64()), *b.columns], ["__part", "__at", *carried])
            at += k

    held = C.save(ranged.mapInArrow(number, StructType([*StructType.fromDDL("__part int, __at long"), *turns.select(*carried).schema])), "op2-turns")
    # a partition's rows may be read as several splits: they are dealt by partition and put in order again
    again = held.repartition(n, "__part").sortWithinPartitions("__part", "__at")

    def tie(turn, role, text):
        return zlib.crc32(f"{turn}\0{role}\0{text}".encode("utf-8", "surrogatepass")) & 0xFFFFFFFF

    def runs(batches):
        """(part, conv_id, rows) of each conversation's stretch in each partition."""
        key, rows = None, []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("__part", *carried)]
            for r in zip(*cols):
                k = (r[0], r[1 + carried.index("conv_id")])
                if rows and k != key:
                    yield key, rows
                    rows = []
                key = k
                rows.append(r[1:])
        if rows:
            yield key, rows

    i_turn, i_role, i_text = (carried.index(c) for c in ("turn", "role", "text"))

    def codes(rows):
        return [(role_of(r[i_role]), tie(r[i_turn], r[i_role], r[i_text])) for r in rows]

    def edges(batches):
        """The first and the last conversation of each partition, with the cost between any two states."""
        part, out, last = None, [], None

        def matrix(k, rows, first):
            t = codes(rows)
            return (k[0], first, k[1], [x for s in range(4) for x in forward(t, only(s))[-1]])

        for k, rows in runs(batches):
            if k[0] != part:
                if last:
                    out.append(matrix(*last, False))
                out.append(matrix(k, rows, True))
                part, last = k[0], None
            else:
                last = k, rows
        if last:
            out.append(matrix(*last, False))
        p, f, c, m = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(f, pa.bool_()), pa.array(c, pa.int64()), pa.array(m, pa.list_(pa.int64()))], ["part", "first", "conv", "cost"])

    # two rows for each shuffle partition at most
    met = sorted(again.mapInArrow(edges, "part int, first boolean, conv long, cost array<long>").collect(), key=lambda r: (r["part"], not r["first"]))
    known: dict[tuple[int, bool], tuple[int, int, bool, bool]] = {}
    i = 0
    while i < len(met):
        j = i + 1
        while j < len(met) and met[j]["conv"] == met[i]["conv"]:
            j += 1
        at = [only(BEGIN)]
        for r in met[i:j]:
            at.append([min(at[-1][s] + r["cost"][4 * s + q] for s in range(4)) for q in range(4)])
        end = _end_cost(at[-1])
        for b in range(j - 1, i - 1, -1):
            r = met[b]
            s = min(range(4), key=lambda s: (at[b - i][s] + r["cost"][4 * s + end], s))
            known[r["part"], r["first"]] = s, end, b == i, b == j - 1
            end = s
        i = j

    def render(batches):
        part, held_back = None, None

        def show(k, rows, place):
            t = codes(rows)
            start, end, opens, closes = known[k[0], place == "first"] if place else (BEGIN, None, True, True)
            at = forward(t, only(start))
            end = _end_cost(at[-1]) if end is None else end
            out = []
            for n_, (r, (role, _), (s, q)) in enumerate(zip(rows, t, trace(t, at, end))):
                cost, action, x = MOVES[role][s, q]
                begun = not opens or n_ > 0
                piece = ""
                if not action.startswith("merge"):
                    piece += "<|end|>\n" if begun else ""
                    piece += f"<|{NAMES[x]}|>\n<|end|>\n" if x else ""
                    piece += f"<|{NAMES[q]}|>\n"
                else:
                    piece += "\n"
                piece += r[i_text] or ""
                if closes and n_ == len(rows) - 1:
                    piece += "<|end|>\n"
                out.append((*r, NAMES[q], action, NAMES[x] or None, cost, piece))
            return out

        def batch(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [*carried, *made])

        from pyspark.sql.pandas.types import to_arrow_schema

        types, out, size = [f.type for f in to_arrow_schema(schema)], [], 0
        for k, rows in runs(batches):
            if k[0] != part:
                if held_back:
                    out += show(*held_back, "last")
                    held_back = None
                out += show(k, rows, "first")
                part = k[0]
            else:
                if held_back:
                    out += show(*held_back, None)
                held_back = k, rows
            if len(out) > 4096:
                yield batch(out)
                out = []
        if held_back:
            out += show(*held_back, "last")
        if out:
            yield batch(out)

    schema = StructType([*turns.select(*carried).schema, *StructType.fromDDL("out_role string, action string, inserted string, cost int, piece string")])
    return again.mapInArrow(render, schema)
