"""Chat formatting with minimum-cost role repair.

A conversation is legal if it is an optional system turn followed by pairs of user and assistant turns. A dynamic
program over the automaton of legal turns chooses for every turn to keep its role, relabel it, merge it with the
turn before or insert an empty turn ahead of it, at the least total cost.

Null or unknown roles match no role and so are relabelled at least; null texts are rendered empty; turns of equal
number are ordered by role and text, null numbers come first; repeated rows are turns of their own. Rows with a
null conversation form one conversation. An empty table gives an empty result; other columns are dropped.

Of equally cheap repairs the one is taken whose states (nothing, system, user, assistant, in this order) come first,
compared turn by turn from the start; between two states the cheapest step, and of equal ones the first in _STEPS.
So the choice does not depend on how turns are spread over tasks. Markers in a text are escaped, so that no text can
open or close a turn: `<|`, and `<\\|` with any number of backslashes, gets one backslash more, and unescaped()
takes it off again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import map_batches, materialise

ROLES = ("system", "user", "assistant")
#: States: nothing yet, then the role of the last turn.
STATES = ("", *ROLES)
LEGAL = {("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}
RELABEL, MERGE, INSERT = 3, 2, 4
#: Cost of ending after each state: an unanswered user turn gets an empty answer, a lone system turn both.
FINAL = np.array([0, 2 * INSERT, INSERT, 0])
_FAR = 1 << 40
_HEAD, _TAIL = "<|{}|>\n", "<|end|>\n"


def _steps(role: str | None) -> list[tuple[int, int, int, str, str, str]]:
    """(from state, to state, cost, action, role given, role inserted before) for a turn of this role, cheapest first."""
    out = []
    for s, last in enumerate(STATES):
        for given in ROLES:
            cost, relabel = (0, "keep") if given == role else (RELABEL, "relabel")
            if (last, given) in LEGAL:
                out.append((s, STATES.index(given), cost, relabel, given, ""))
            if last == given:
                out.append((s, STATES.index(given), cost + MERGE, "merge" if given == role else "relabel+merge", given, ""))
            for filler in ROLES:
                if (last, filler) in LEGAL and (filler, given) in LEGAL:
                    out.append((s, STATES.index(given), cost + INSERT, f"insert+{relabel}", given, filler))
    return sorted(out, key=lambda x: (x[2], x[0], x[1], x[5]))


_STEPS = {r: _steps(r) for r in (*ROLES, None)}


def _matrix(role: str | None) -> list[list[int]]:
    m = [[_FAR] * 4 for _ in STATES]
    for s, t, cost, *_ in _STEPS[role]:
        m[s][t] = min(m[s][t], cost)
    return m


_MATRIX = {r: _matrix(r) for r in (*ROLES, None)}


def _known(role: str | None) -> str | None:
    return role if role in ROLES else None


def _advance(best: list[tuple[int, int]], role: str | None) -> tuple[list[tuple[int, int]], list[int]]:
    """From (cost, rank) of the best path to each state those after one more turn, and the state before; ranks order the paths by their states."""
    m = _MATRIX[_known(role)]
    before = [min(range(4), key=lambda s: (min(best[s][0] + m[s][t], _FAR), best[s][1])) for t in range(4)]
    places = sorted(range(4), key=lambda t: (best[before[t]][1], t))
    return [(min(best[before[t]][0] + m[before[t]][t], _FAR), places.index(t)) for t in range(4)], before


def _from(start: int) -> list[tuple[int, int]]:
    return [(0 if s == start else _FAR, s) for s in range(4)]


def costs(roles: list[str | None]) -> list[int]:
    """From each state to each state the least cost over these turns, then the ranks of these paths among those from the same state: 32 numbers.

    Costs combine by min-plus products; of equal ones the path with the lower ranks, compared piece by piece, has the
    earlier states.
    """
    ends = []
    for start in range(4):
        best = _from(start)
        for r in roles:
            best, _ = _advance(best, r)
        ends.append(best)
    return [c for best in ends for c, _ in best] + [k for best in ends for _, k in best]


def repair(roles: list[str | None], start: int = 0, end: int | None = None) -> list[tuple[str, str, str]]:
    """(action, role, role inserted before) of each turn on the first cheapest path from start to end, or to the cheapest ending."""
    best, befores = _from(start), []
    for r in roles:
        best, before = _advance(best, r)
        befores.append(before)
    state = min(range(4), key=lambda s: (best[s][0] + int(FINAL[s]), best[s][1])) if end is None else end
    out = []
    for r, before in zip(roles[::-1], befores[::-1]):
        out.append(next(x for x in _STEPS[_known(r)] if x[:2] == (before[state], state))[3:])
        state = before[state]
    return out[::-1]


_MARKER, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escaped(text: str) -> str:
    """text without markers."""
    return _MARKER.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def opened(action: str, role: str, filler: str, text: str) -> str:
    """A turn's text and what opens it; a merged turn goes on with the one before."""
    before = _HEAD.format(filler) + _TAIL if filler else ""
    return before + ("\n" if "merge" in action else _HEAD.format(role)) + escaped(text)


#: What closes a conversation after its last turn.
CLOSING = {
    "system": _TAIL + _HEAD.format("user") + _TAIL + _HEAD.format("assistant") + _TAIL,
    "user": _TAIL + _HEAD.format("assistant") + _TAIL,
    "assistant": _TAIL,
}


OUT = "conv_id long, turn long, seq long, role string, action string, inserted string, cost int, rendered string"


def formatted(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each turn: its order seq (by which parts of a conversation sort), repaired role, action, cost and rendered part.

    Turns are range-partitioned in order, so a conversation of any size is spread over tasks. Conversations within
    a partition are repaired there. Of one that crosses partitions each piece is reduced to its 4 x 4 matrices of
    least costs and ranks; their min-plus products give the states at the seams, between which the pieces are
    repaired.
    """
    order = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["conv_id", "turn", "seq", "role", "action", "inserted", "cost", "rendered", "pid", "raw_role", "raw_text"]
    types = [pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 3, pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]

    def finish(turns: list[tuple], steps: list[tuple], closes: bool, first_seq: int) -> list[tuple]:
        """Rows of turns (conv_id, turn, role, text); a turn is closed unless the next one is merged into it, which the next one's row shows."""
        out = []
        for k, ((conv, turn, _, text), (action, given, filler)) in enumerate(zip(turns, steps)):
            part = opened(action, given, filler, text or "")
            cost = (RELABEL if "relabel" in action else 0) + (MERGE if "merge" in action else 0) + (INSERT if filler else 0)
            if "merge" not in action and (k or first_seq):
                part = _TAIL + part
            if closes and k == len(turns) - 1:
                part += CLOSING[given]
                cost += int(FINAL[STATES.index(given)])
            out.append((conv, turn, first_seq + k, given, action, filler or None, cost, part))
        return out

    def batch(rows: list[tuple], n: int = len(names)) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types[:n])], names[:n])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, held, opening, current, sent = TaskContext.get().partitionId(), [], True, None, 0

        def aside() -> pa.RecordBatch:
            """Turns of a conversation that may go on in another partition."""
            return batch([(c, t, (pid << 40) + sent + k, *[None] * 5, pid, r, x) for k, (c, t, r, x) in enumerate(held)])

        for b in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if (held or sent) and row[0] != current:
                    if held and (opening or sent):
                        yield aside()
                    elif held:
                        out += [(*x, None, None, None) for x in finish(held, repair([t[2] for t in held]), True, 0)]
                    held, opening, sent = [], False, 0
                held.append(row)
                current = row[0]
                if len(held) >= 10_000:
                    yield aside()
                    held, sent = [], sent + len(held)
            if out:
                yield batch(out)
        if held:
            yield aside()

    schema = OUT + ", pid int, raw_role string, raw_text string"
    streamed = materialise(map_batches(ordered, stream, schema), "turns")
    seams = streamed.filter("pid is not null")

    def reduce(key: tuple, table: pa.Table) -> pa.Table:
        roles = table.sort_by("seq").column("raw_role").to_pylist()
        return pa.table([[key[0].as_py()], [key[1].as_py()], [costs(roles)]], schema=pa.schema([("conv_id", pa.int64()), ("pid", pa.int32()), ("m", pa.list_(pa.int64()))]))

    def connect(table: pa.Table) -> pa.Table:
        """The states before and after each piece of one conversation; one row comes in for each partition that it touches."""
        table = table.sort_by("pid")
        pieces = table.column("m").to_pylist()
        # of each state the best way there: cost, then the ranks of its pieces
        best: list[tuple[int, tuple[int, ...]]] = [(0 if s == 0 else _FAR, (s,)) for s in range(4)]
        befores = []
        for m in pieces:
            ways = [[(min(best[s][0] + m[4 * s + t], _FAR), (*best[s][1], m[16 + 4 * s + t])) for s in range(4)] for t in range(4)]
            befores.append([min(range(4), key=lambda s: w[s]) for w in ways])  # noqa: B023
            best = [w[s] for w, s in zip(ways, befores[-1])]
        state, ends = min(range(4), key=lambda s: (best[s][0] + int(FINAL[s]), best[s][1])), []
        for before in befores[::-1]:
            ends.append((before[state], state))
            state = before[state]
        ends = ends[::-1]
        first = [i == 0 for i in range(len(pieces))]
        last = [i == len(pieces) - 1 for i in range(len(pieces))]
        return pa.table([table.column("conv_id"), table.column("pid"), pa.array([a for a, _ in ends], pa.int32()), pa.array([b for _, b in ends], pa.int32()), pa.array(first), pa.array(last)], names=["of_conv", "of_pid", "before", "after", "first", "last"])

    def settle(turns: pa.Table, seam: pa.Table) -> pa.Table:
        turns = turns.sort_by("seq")
        ends = seam.to_pylist()[0]
        rows = list(zip(*(turns.column(c).to_pylist() for c in ("conv_id", "turn", "raw_role", "raw_text"))))
        base = 0 if ends["first"] else turns.column("seq")[0].as_py() + (1 << 39)
        done = finish(rows, repair([r[2] for r in rows], ends["before"], ends["after"]), ends["last"], base)
        return pa.Table.from_batches([batch(done, 8)])

    pieces = seams.select("conv_id", "pid", "seq", "raw_role").groupBy("conv_id", "pid").applyInArrow(reduce, "conv_id long, pid int, m array<long>")
    joints = pieces.groupBy("conv_id").applyInArrow(connect, "of_conv long, of_pid int, before int, after int, first boolean, last boolean")
    settled = seams.select("conv_id", "turn", "seq", "pid", "raw_role", "raw_text").groupBy("conv_id", "pid").cogroup(joints.groupBy("of_conv", "of_pid")).applyInArrow(settle, OUT)
    return streamed.filter("pid is null").select(*names[:8]).unionByName(settled)
