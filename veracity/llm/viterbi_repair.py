"""Least-cost repair of conversations' structure by a parallel Viterbi search.

Each row of a conversation is kept (K), gets the role that belongs there (R) or is deleted (D), and
empty turns may be inserted (I), so that the roles' initials read ``(s?(ua)+)?`` at the least cost.
What may follow depends on four states: nothing yet, after s, after u, after a; each letter has one successor state.

* Rows are put in order by a range sort over (conversation, turn), so that a long conversation
  lies in as many parts as its size asks for, and stored as chunks of at most ``CHUNK`` rows.
* Rows equal to an earlier one of their conversation are found by the smallest place of each
  digest; a digest with very many rows is dealt over salts.
* A *run* is what one part holds of one conversation.  Runs are worked through backwards, with a cost for each state;
  only the differences matter, so a cost vector stands for all that differ from it by a constant.
* A run whose conversation goes on in the next part starts from a speculative vector.  Fix-up passes
  follow: a run whose speculation isn't the vector that its right neighbour
  arrived at is run again from that one, next to the old one, until both differ only by a constant; from there on
  the old results hold.  A run in which they never meet also reports what becomes of each
  state, and needs no further pass whatever its neighbour arrives at.  Passes end when nothing changes.
* The stitched vectors lead the tracing: from the state at the start, each row takes the first letter in ASCII
  order that lies on a cheapest way.  The states at the starts of runs are stitched likewise, from each run's four outcomes.

The driver holds some numbers for at most two runs of each part.  A conversation's audit has a letter
for each edit and is one string; the rest of the work has no group that grows with a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.llm.common import drop_stage, ready, stage
from veracity.operators.skew import salted_join

CHUNK = 256
#: Costs of the edits, and of a truncated row that stays.
RENAME, DELETE, INSERT, TRUNCATED_STAYS = 1, 2, 5, 5
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
_KINDS = " sua"  # place of an initial; 0 for all others
#: State after each kept initial, by state before it; None where it may not stand.
_KEEP = {1: (1, None, None, None), 2: (2, 2, None, 2), 3: (None, None, 3, None)}
#: State after the user or assistant turn that may come next.
_NEXT = (2, 2, 3, 2)
_ENDS = (0, 2 * INSERT, INSERT, 0)
_FAR = 1 << 40
_WHITE = r"\x20\x09-\x0D"


class Costs:
    """Vectors of costs to go by state, less their smallest, each known by a
    number; what a row makes of them is worked out once for each kind of row and vector."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self._number: dict[tuple[int, ...], int] = {}
        self._before: dict[tuple[int, int], int] = {}
        self._choice: dict[tuple[int, int, int], tuple[str, int, int]] = {}

    def number(self, v) -> int:
        low = min(v)
        v = tuple(min(x - low, _FAR) for x in v)
        if v not in self._number:
            self._number[v] = len(self.vectors)
            self.vectors.append(v)
        return self._number[v]

    @staticmethod
    def options(row: int, state: int) -> Iterator[tuple[str, int, int]]:
        """(letter, cost, state after) in ASCII order of the letters, insertions left out."""
        fault, kind = divmod(row, 4)
        yield "D", DELETE, state
        if fault in (BLANK, DUPLICATE):
            return
        stays = TRUNCATED_STAYS if fault == TRUNCATED else 0
        if kind and _KEEP[kind][state] is not None:
            yield "K", stays, _KEEP[kind][state]
        yield "R", RENAME + stays, _NEXT[state]

    def _costs(self, row: int, after: tuple[int, ...]) -> list[int]:
        own = [min(c + after[t] for _, c, t in self.options(row, s)) for s in range(4)]
        once = [min(own[s], INSERT + own[_NEXT[s]]) for s in range(4)]
        return [min(own[s], INSERT + once[_NEXT[s]]) for s in range(4)]

    def before(self, row: int, after: int) -> int:
        """The vector before a row, given the one after it."""
        k = (row, after)
        if k not in self._before:
            self._before[k] = self.number(self._costs(row, self.vectors[after]))
        return self._before[k]

    def choice(self, row: int, after: int, state: int) -> tuple[str, int, int]:
        """(letters, cost, state after): the cheapest edits up to and with this row, ASCII-least of equal ones."""
        k = (row, after, state)
        if k not in self._choice:
            v = self.vectors[after]
            costs, letters, paid, s = self._costs(row, v), "", 0, state
            while True:
                found = {x: (c, t) for x, c, t in self.options(row, s) if c + v[t] == costs[s]}
                if "D" not in found and INSERT + costs[_NEXT[s]] == costs[s]:
                    letters, paid, s = letters + "I", paid + INSERT, _NEXT[s]
                    continue
                x = min(found)
                self._choice[k] = (letters + x, paid + found[x][0], found[x][1])
                break
        return self._choice[k]

    def backward(self, rows: bytes, end: int) -> list[int]:
        """The vector after each row, and last the one before the first."""
        out, v, step = [], end, self._before
        for row in reversed(rows):
            out.append(v)
            w = step.get((row, v))
            v = self.before(row, v) if w is None else w
        out.append(v)
        return out[-2::-1] + out[-1:]

    def start(self, rows: bytes, end: int, old: int | None = None, old_start: int | None = None) -> int:
        """The vector before the first row; ``old_start`` as soon as the run from ``old`` is met."""
        v = end
        for row in reversed(rows):
            if v == old:
                return old_start
            v = self.before(row, v)
            old = None if old is None else self.before(row, old)
        return v

    def basis(self, rows: bytes) -> list[tuple[int, ...]]:
        """The costs before the first row for an end in each single state, with their constants."""
        out = []
        for s in range(4):
            v = tuple(0 if t == s else _FAR for t in range(4))
            seen: dict[tuple[int, tuple[int, ...]], tuple[int, tuple[int, ...]]] = {}
            paid = 0
            for row in reversed(rows):
                if (row, v) not in seen:
                    w = [min(x, _FAR) for x in self._costs(row, v)]
                    seen[row, v] = (min(w), tuple(min(x - min(w), _FAR) for x in w))
                more, v = seen[row, v]
                paid += more
            out.append(tuple(x + paid if x < _FAR else _FAR for x in v))
        return out

    def trace(self, rows: bytes, after: list[int], state: int) -> tuple[list[str], int, int]:
        """(letters of each row, cost, state after the last)."""
        out, paid, known = [], 0, self._choice
        for row, v in zip(rows, after[:len(rows)], strict=True):
            got = known.get((row, v, state)) or self.choice(row, v, state)
            out.append(got[0])
            paid += got[1]
            state = got[2]
        return out, paid, state


def ending(state: int) -> str:
    """The insertions that end a conversation."""
    return "I" * (_ENDS[state] // INSERT)


def apply_audit(roles: list[str], texts: list[str], audit: str, state: int) -> tuple[list[str], list[str], int]:
    """(roles, texts, state after) that the edits make of the rows."""
    out_roles, out_texts, at = [], [], 0
    for letter in audit:
        if letter == "I":
            state = _NEXT[state]
            out_roles.append("user" if state == 2 else "assistant")
            out_texts.append("")
            continue
        if letter == "K":
            state = _KEEP[_KINDS.index(roles[at][0])][state]
            out_roles.append(roles[at])
        elif letter == "R":
            state = _NEXT[state]
            out_roles.append("user" if state == 2 else "assistant")
        if letter != "D":
            out_texts.append(texts[at])
        at += 1
    return out_roles, out_texts, state


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with one row in five damaged, as the crc32 of ``conv_id:turn`` says: rows dropped,
    emptied, without their sentence ends, repeated, or given to the user.  Nulls are written as one blank."""
    conv, turn, role, text = (F.col(f"`{c}`") for c in (id_col, turn_col, role_col, text_col))
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    h = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    own = rows.select(conv.alias("conv_id"), turn.alias("turn"), blank(role).alias("role"), blank(text).alias("text"), h.alias("h")).where("h <> 0")
    cut = F.when(F.col("h") == 1, F.lit("")).when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return own.select("conv_id", "turn", F.when(F.col("h") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), cut.alias("text"),
                      F.explode(times).alias("again")).drop("again")


_CHUNKS = "part int, seq long, kinds binary, faults binary, digests binary, illegal long, roles array<string>, texts array<string>"


def _cut_chunks(chunk: int):
    """Chunks of ordered rows (conv_id, kind, fault, digest, role, text)."""
    legal = np.zeros((4, 4), bool)
    legal[1, 2] = legal[2, 3] = legal[3, 2] = True

    def run(batches):
        from pyspark import TaskContext

        part, seq, last = TaskContext.get().partitionId(), 0, None  # last: (conversation, kind) of the row before
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, kind = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.uint8)
            fault, digest = batch.column(2).to_numpy().astype(np.uint8), batch.column(3).to_pylist()
            bad = np.zeros(len(conv), np.int64)
            same = np.array([a == b for a, b in zip(conv[1:], conv[:-1], strict=True)], bool)
            bad[1:] = same & ~legal[kind[:-1], kind[1:]]
            if last is not None and last[0] == conv[0]:
                bad[0] = not legal[last[1], kind[0]]
            last = (conv[-1], int(kind[-1]))
            runs = [0, *(np.flatnonzero(~same) + 1).tolist(), len(conv)]
            at = [i for a, b in zip(runs, runs[1:]) for i in range(a, b, chunk)] + [len(conv)]
            pairs = list(zip(at, at[1:]))
            ends = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at[:-1])), pa.array([part] * len(pairs), pa.int32()), pa.array(range(seq, seq + len(pairs)), pa.int64()),
                 pa.array([kind[a:b].tobytes() for a, b in pairs], pa.binary()), pa.array([fault[a:b].tobytes() for a, b in pairs], pa.binary()),
                 pa.array([b"".join(digest[a:b]) for a, b in pairs], pa.binary()), pa.array([int(bad[a:b].sum()) for a, b in pairs], pa.int64()),
                 pa.ListArray.from_arrays(ends, batch.column(4)), pa.ListArray.from_arrays(ends, batch.column(5))],
                names=["conv_id", "part", "seq", "kinds", "faults", "digests", "illegal", "roles", "texts"])
            seq += len(pairs)

    return run


def _firsts(digests: bytes, faults: bytes) -> list[int]:
    """Rows that aren't blank and differ from those before them in the chunk."""
    seen, out = set(), []
    for i, f in enumerate(faults):
        d = digests[16 * i:16 * i + 16]
        if f != BLANK and d not in seen:
            seen.add(d)
            out.append(i)
    return out


def _list_firsts(batches):
    for batch in batches:
        part, seq, at, key = [], [], [], []
        for p, s, digests, faults in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            own = _firsts(digests, faults)
            part += [p] * len(own)
            seq += [s] * len(own)
            at += own
            key += [digests[16 * i:16 * i + 16] for i in own]
        h = np.frombuffer(b"".join(key), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(seq, pa.int64()), pa.array(at, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])],
                                         names=["part", "seq", "at", "h1", "h2"])


def _with_rows(batches):
    """Chunks (conv_id, part, seq, kinds, faults, digests, again, illegal) with their rows as fault * 4 + kind."""
    for batch in batches:
        rows = []
        for kinds, faults, digests, again in zip(*(batch.column(i).to_pylist() for i in range(3, 7)), strict=True):
            kind, fault = np.frombuffer(kinds, np.uint8), np.frombuffer(faults, np.uint8).copy()
            repeated = np.ones(len(kind), bool)
            repeated[_firsts(digests, faults)] = False
            repeated[again or []] = True
            fault[repeated & (fault != BLANK)] = DUPLICATE
            rows.append((fault * 4 + kind).tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2)), pa.array(rows, pa.binary()), batch.column(7)],
                                         names=["conv_id", "part", "seq", "rows", "illegal"])


def _runs(batches) -> Iterator[tuple[int, object, list[tuple]]]:
    """(part, conversation, chunks) of ordered chunks (part, conv_id, ...); a run is held at a time."""
    key, held = None, []
    for batch in batches:
        for chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key is not None and key != chunk[:2]:
                yield *key, held
                held = []
            key = chunk[:2]
            held.append(chunk)
    if key is not None:
        yield *key, held


@dataclass
class _Run:
    """What is known of a run whose conversation lies in several parts."""

    part: int
    conv: object
    end: tuple[int, ...] | None = None
    start: tuple[int, ...] | None = None
    basis: list[tuple[int, ...]] | None = None
    state: int = 0

    def from_basis(self, end: tuple[int, ...]) -> tuple[int, ...]:
        v = [min(self.basis[t][s] + end[t] for t in range(4)) for s in range(4)]
        return tuple(x - min(v) for x in v)


def _sweep(light: DataFrame, asked: dict, schema: str, made) -> list:
    """Rows that ``made(costs, part, conv, rows, question)`` gives for the runs in question."""
    shared = light.sparkSession.sparkContext.broadcast(asked)
    parts = sorted({p for p, _ in asked})
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        costs = Costs()
        for part, conv, chunks in _runs(batches):
            if (part, conv) in shared.value:
                row = made(costs, part, conv, b"".join(c[3] for c in chunks), shared.value[part, conv])
                yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    want = F.broadcast(light.sparkSession.createDataFrame([(p,) for p in parts], "part int"))  # two for each part at most
    return _ordered(light.join(want, "part")).mapInArrow(run, schema).collect()


def _ordered(light: DataFrame) -> DataFrame:
    return light.repartition("part").sortWithinPartitions("part", "seq").select("part", "conv_id", "seq", "rows", "illegal")


def _stitch(light: DataFrame, groups: list[list[_Run]]) -> None:
    """Fix-up passes until every run's end is what its right neighbour arrived at; then the states at the starts."""
    conv_type = light.schema["conv_id"].dataType.simpleString()
    asked: dict = {(r.part, r.conv): (None, None, _ENDS) for g in groups for r in g}
    by_key = {(r.part, r.conv): r for g in groups for r in g}

    def again(costs, part, conv, rows, question):
        old, old_start, end = question
        n = costs.number
        if old is None:
            return part, conv, list(costs.vectors[costs.start(rows, n(end))]), None
        start = costs.start(rows, n(end), n(old), n(old_start))
        return part, conv, list(costs.vectors[start]), None if start == n(old_start) else [list(b) for b in costs.basis(rows)]

    while asked:
        for part, conv, start, basis in _sweep(light, asked, f"part int, conv_id {conv_type}, start array<long>, basis array<array<long>>", again):
            r = by_key[part, conv]
            r.end, r.start = tuple(asked[part, conv][2]), tuple(start)
            r.basis = [tuple(b) for b in basis] if basis else r.basis
        asked = {}
        for g in groups:
            end = _ENDS
            for r in reversed(g):
                if r.end != end:
                    if r.basis:
                        r.end, r.start = end, r.from_basis(end)
                    else:
                        asked[r.part, r.conv] = (r.end, r.start, end)
                end = r.start

    def outcomes(costs, part, conv, rows, end):
        after = costs.backward(rows, costs.number(end))
        return part, conv, [costs.trace(rows, after, s)[2] for s in range(4)]

    ends = {k: r.end for k, r in by_key.items()}
    found = {(p, c): o for p, c, o in _sweep(light, ends, f"part int, conv_id {conv_type}, outcomes array<int>", outcomes)} if ends else {}
    for g in groups:
        state = 0
        for r in g:
            r.state, state = state, found[r.part, r.conv][state]


@dataclass
class Repaired:
    report: DataFrame  # conv_id, blank, duplicate, truncated, illegal, cost, audit
    turns: DataFrame   # conv_id, part, seq, alone, roles, texts: the repaired rows, in order of (part, seq)


def repair(rows: DataFrame, chunk: int = CHUNK) -> Repaired:
    """Least-cost repair of conversations (conv_id, turn, role, text).

    A conversation's rows are taken by turn, null first; rows of one turn by the
    MD5 of their role and text, repeated rows after one another.  Faults, the first of which
    counts: blank; duplicate of an earlier role and text; truncated.  Blank and duplicate rows must go, truncated
    ones that stay cost 5 more.  ``illegal`` counts neighbours whose initials aren't su, ua or au.

    Null roles and texts are one blank; a role that is empty or begins with another letter can't stay as it is.
    Rows without a conv_id are one conversation.  Very long texts lie in chunks of few rows.  An empty table gives no rows; other
    columns are not read.
    """
    spark = rows.sparkSession
    ready(spark)
    # conversation and role before the text, so that equal digests mean equal rows of one conversation
    known = rows.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("-"))
    kind = F.when(F.substring("role", 1, 1).isin(*_KINDS[1:]), F.instr(F.lit(_KINDS), F.substring("role", 1, 1)) - 1).otherwise(F.lit(0))
    fault = F.when(~F.col("text").rlike(f"[^{_WHITE}]"), F.lit(BLANK)).when(~F.col("text").rlike(rf"[.!?][{_WHITE}]*\z"), F.lit(TRUNCATED)).otherwise(F.lit(OK))
    digest = F.unhex(F.md5(F.concat(name, F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    keyed = known.select("conv_id", "turn", kind.cast("int").alias("kind"), fault.cast("int").alias("fault"), digest.alias("digest"), "role", "text",
                         F.monotonically_increasing_id().alias("uid"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest").asc(), F.col("uid").asc()]
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "kind", "fault", "digest", "role", "text")
    chunks = stage(ordered.mapInArrow(_cut_chunks(chunk), f"conv_id {conv_type}, {_CHUNKS}"), "chunks")

    places = chunks.select("part", "seq", "digests", "faults").mapInArrow(_list_firsts, "part int, seq long, at int, h1 long, h2 long")
    place = F.struct("part", "seq", "at")
    seen = stage(places.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "seen")
    later = salted_join(places, seen.drop("n"), ["h1", "h2"], seen.select("h1", "h2", "n"), "n", ["part", "seq", "at"]).where(place != F.col("first"))
    again = later.groupBy("part", "seq").agg(F.collect_list("at").alias("again"))  # a chunk's rows at most
    light = stage(chunks.select("conv_id", "part", "seq", "kinds", "faults", "digests", "illegal").join(again, ["part", "seq"], "left").select(
        "conv_id", "part", "seq", "kinds", "faults", "digests", "again", "illegal").mapInArrow(
        _with_rows, f"conv_id {conv_type}, part int, seq long, rows binary, illegal long"), "light")
    drop_stage(seen)

    # at most two runs of a part belong to conversations that lie in several parts
    byte = lambda at: F.conv(F.hex(F.substring("rows", at, 1)), 16, 10).cast("int") % 4
    ends = sorted(light.groupBy("part").agg(
        F.min_by(F.struct("conv_id", byte(1).alias("kind")), "seq").alias("first"), F.max_by(F.struct("conv_id", byte(-1).alias("kind")), "seq").alias("last")).collect(),
        key=lambda r: r["part"])
    groups, crossing = [], []
    for a, b in zip(ends, ends[1:]):
        conv = a["last"]["conv_id"]
        if conv == b["first"]["conv_id"]:
            if not groups or groups[-1][-1].part != a["part"] or groups[-1][-1].conv != conv:
                groups.append([_Run(a["part"], conv)])
            groups[-1].append(_Run(b["part"], conv))
            legal = (a["last"]["kind"], b["first"]["kind"]) in ((1, 2), (2, 3), (3, 2))
            crossing.append((conv, b["part"], int(not legal)))
    _stitch(light, groups)
    facts = {(r.part, r.conv): (r.end, r.state, r is g[-1]) for g in groups for r in g}
    illegal = {(p, c): n for c, p, n in crossing}
    shared = spark.sparkContext.broadcast((facts, illegal))

    def run(batches):
        costs = Costs()
        names = ["conv_id", "part", "seq", "alone", "state", "audit", "cost", "blank", "duplicate", "truncated", "illegal"]
        out: list[tuple] = []
        ends, crossed = shared.value

        def made():
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], names=names)

        for part, conv, held in _runs(batches):
            end, state, last = ends.get((part, conv), (_ENDS, 0, True))
            rows = b"".join(c[3] for c in held)
            after = costs.backward(rows, costs.number(end))
            at, cross = 0, crossed.get((part, conv), 0)
            for i, (_, _, seq, own, bad) in enumerate(held):
                letters, cost, nxt = costs.trace(own, after[at:at + len(own)], state)
                audit = "".join(letters)
                if last and i + 1 == len(held):
                    audit, cost = audit + ending(nxt), cost + _ENDS[nxt]
                faults = np.bincount(np.frombuffer(own, np.uint8) // 4, minlength=4).tolist()
                out.append((conv, part, seq, len(held) == 1 and (part, conv) not in ends, state, audit, cost, *faults[1:], bad + (0 if i else cross)))
                at, state = at + len(own), nxt
            if len(out) >= 4096:
                yield made()
        yield made()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = (f"conv_id {conv_type}, part int, seq long, alone boolean, state int, audit string, cost long, blank long, duplicate long, "
              "truncated long, illegal long")
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    traced = stage(_ordered(light).mapInArrow(run, schema), "traced")
    drop_stage(light)
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    parts = F.array_sort(F.collect_list(F.struct("part", "seq", "audit")))
    report = traced.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in counts], F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"))

    def edited(batches):
        for batch in batches:
            got = [apply_audit(roles, texts, audit, state)[:2] for roles, texts, audit, state in zip(*(batch.column(i).to_pylist() for i in range(4, 8)), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *(pa.array([g[k] for g in got], pa.list_(pa.string())) for k in (0, 1))],
                                             names=["conv_id", "part", "seq", "alone", "roles", "texts"])

    turns = chunks.select("part", "seq", "roles", "texts").join(traced.select("conv_id", "part", "seq", "alone", "audit", "state"), ["part", "seq"]).select(
        "conv_id", "part", "seq", "alone", "roles", "texts", "audit", "state").mapInArrow(
        edited, f"conv_id {conv_type}, part int, seq long, alone boolean, roles array<string>, texts array<string>")
    return Repaired(report, turns)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of each conversation's ``role:text`` lines, joined by line ends.

    A conversation of one chunk is hashed where it is; the chunks of longer ones meet in order in one
    task, which holds one at a time (SHA-256 can't be split)."""
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    made = turns.select("conv_id", "part", "seq", "alone", F.size("roles").alias("n"), lines.alias("lines"))
    conv_type = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        open_, conv, total, some, done = False, None, None, False, []
        for batch in batches:
            for c, n, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not open_ or c != conv:
                    if open_:
                        done.append((conv, total.hexdigest()))
                    open_, conv, total, some = True, c, hashlib.sha256(), False
                if n:
                    total.update((("\n" if some else "") + text).encode())
                    some = True
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kinds.field(0).type), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "sha256"])
            done = []
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kinds.field(0).type), pa.array([total.hexdigest()])], names=["conv_id", "sha256"])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"conv_id {conv_type}, sha256 string"
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    long = made.where(~F.col("alone")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").select("conv_id", "n", "lines").mapInArrow(run, schema)
    return made.where("alone").select("conv_id", F.sha2("lines", 256).alias("sha256")).unionByName(long)


def audit(rows: DataFrame, damaged: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of
    ``rows``, for its rows in ``damaged``; one without any there has zeros, no edits and the hash of nothing."""
    found = repair(damaged, chunk)
    columns = {"turn": damaged.schema["turn"].dataType.simpleString(), "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long",
               "cost": "long", "audit": "string", "sha256": "string"}

    def padded(df: DataFrame) -> DataFrame:
        return df.select("conv_id", *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()))

    parts = [rows.select("conv_id").distinct(), damaged.select("conv_id", "turn").distinct(), found.report, digests(found.turns)]
    merged = padded(parts[0])
    for p in parts[1:]:
        merged = merged.unionByName(padded(p))
    wide = lambda c: c.cast("decimal(20,0)")
    gaps = (wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count("turn")).try_cast("long")
    return merged.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
