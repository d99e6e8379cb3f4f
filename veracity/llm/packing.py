"""Best-fit packing of token sequences by a linear grouping scheme.

Texts become token ids with an end id; only texts of more than ``CAPACITY``
ids are cut, into pieces of full length after a first piece with the rest.
What is packed is a count for each length, at most ``CAPACITY`` numbers
whatever the input's size, so the plan is made on the driver:

1. Lengths above ``SMALL`` are ordered and split into at most ``GROUPS``
   groups of equal cardinality; each is rounded up to its group's largest length.
2. The few sizes are packed by configurations, multisets of sizes within the
   capacity: a linear programme of the fewest sequences, its columns generated by knapsacks.
3. Real lengths take the configurations' places, and the last place of a sequence
   the largest length of any group that fits the room that rounding left.  Sequences
   that are full but for a tolerance are kept; the rest goes back to step 1, which
   groups it more finely, with more tolerance when a round keeps nothing.
4. The small lengths go best-fit, largest first, where the least room is left.

The plan is a list of runs (length, first rank, count, first sequence,
offset): pieces of one length, by their rank, go to consecutive sequences at one
offset.  Ranks are counted in parallel: rows of a length are dealt over
salts, so one length may hold any share of the rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracity.llm.common import ready, stage
from veracity.llm.tokens import encoder, vocabulary

CAPACITY = 1024
END_ID = 2
SMALL = 128
GROUPS = 48
SALT_ROWS = 1000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter."""
    first = n % capacity
    out = [(0, first)] if first else []
    return out + [(at, capacity) for at in range(first, n, capacity)]


def group_sizes(counts: dict[int, int], groups: int) -> list[tuple[int, int]]:
    """(size, pieces) of at most ``groups`` groups of equal cardinality, largest
    first: each group's largest length, and how many pieces are rounded up to it."""
    total = sum(counts.values())
    each = max(1, -(-total // groups))
    out: list[list[int]] = []
    room = 0
    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        left = counts[length]
        while left:
            if not room:
                if out and out[-1][0] == length:  # a length that fills whole groups is one size
                    out[-1][1] += left
                    break
                out.append([length, 0])
                room = each
            k = min(left, room)
            out[-1][1] += k
            left, room = left - k, room - k
    return [(size, n) for size, n in out]


def _best_pattern(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The most valuable multiset of sizes within the capacity: an unbounded knapsack."""
    best, by = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int32)
    for g in np.argsort(-worth / np.array(sizes)):
        s, w = sizes[g], worth[g]
        if w <= 1e-12:
            break
        for _ in range(capacity // s):
            new = best[:-s] + w
            better = new > best[s:] + 1e-12
            if not better.any():
                break
            best[s:][better] = new[better]
            by[s:][better] = g
    c = int(best.argmax())
    value, out = float(best[c]), []
    while by[c] >= 0:
        out.append(int(by[c]))
        c -= sizes[by[c]]
    return value, out


def configurations(sizes: list[int], pieces: list[int], capacity: int, steps: int = 600) -> list[tuple[float, list[int]]]:
    """(how often, sizes by index) of the configurations that hold the pieces of
    few sizes in the fewest sequences, as a linear programme: columns are generated by the knapsack of their duals."""
    m = len(sizes)
    basis = [[g] * (capacity // s) for g, s in enumerate(sizes)]
    matrix = np.diag([float(len(b)) for b in basis])
    need = np.array(pieces, float)
    amount = need / np.diag(matrix)
    for _ in range(steps):
        value, pattern = _best_pattern(sizes, np.linalg.solve(matrix.T, np.ones(m)), capacity)
        if value <= 1 + 1e-9:
            break
        column = np.bincount(pattern, minlength=m).astype(float)
        change = np.linalg.solve(matrix, column)
        ratio = np.where(change > 1e-9, np.maximum(amount, 0) / np.maximum(change, 1e-9), np.inf)
        out = int(ratio.argmin())
        basis[out] = pattern
        matrix[:, out] = column
        amount = np.linalg.solve(matrix, need)
    return sorted(((float(x), sorted(b)) for x, b in zip(amount, basis, strict=True) if x > 1e-9), key=lambda c: (-c[0], c[1]))


class _Lengths:
    """Counts of lengths, and the largest one left that is at most some size."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: v for k, v in counts.items() if v}
        self.order = sorted(self.counts)

    def largest(self, most: int, used: dict[int, int]) -> int | None:
        at = bisect_right(self.order, most)
        while at:
            at -= 1
            if self.counts[self.order[at]] > used.get(self.order[at], 0):
                return self.order[at]
        return None

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            del self.order[bisect_left(self.order, length)]


def _substitute(pattern: list[int], sizes: list[int], left: _Lengths, capacity: int) -> list[int]:
    """Real lengths for a configuration's places, largest first.

    Each place takes the largest length left that is rounded up to its size; the room that rounding
    has left over is used by the last place, which takes the largest length of any group that still fits, and
    after it by whatever fits too."""
    used: dict[int, int] = {}
    out: list[int] = []
    room = capacity

    def put(length: int | None) -> bool:
        nonlocal room
        if length is None:
            return False
        out.append(length)
        used[length] = used.get(length, 0) + 1
        room -= length
        return True

    for g in pattern[:-1]:
        put(left.largest(min(sizes[g], room), used))
    while put(left.largest(room, used)):
        pass
    return out


def plan_large(counts: dict[int, int], capacity: int, groups: int) -> list[tuple[int, list[int]]]:
    """(how often, lengths) of the sequences that hold all pieces.

    In rounds: group and round up what is left, find the best configurations of
    the few sizes, substitute real lengths and keep the sequences that end up full but for a tolerance.
    The rest is grouped again, more finely as there is less of it; the tolerance grows when a round keeps nothing."""
    left, out, tolerance = _Lengths(counts), [], 0
    while left.counts:
        grouped = group_sizes(left.counts, groups)
        sizes = [s for s, _ in grouped]
        kept = 0
        for times, pattern in configurations(sizes, [n for _, n in grouped], capacity):
            times = max(1, int(times / 2))  # the rest is grouped again
            while times and left.counts:
                lengths = _substitute(pattern, sizes, left, capacity)
                if capacity - sum(lengths) > tolerance:
                    break
                use = Counter(lengths)
                k = min(times, min(left.counts[x] // n for x, n in use.items()))
                for x, n in use.items():
                    left.take(x, n * k)
                out.append((k, lengths))
                times, kept = times - k, kept + k
        if not kept:
            tolerance = max(1, 2 * tolerance)
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, small: int = SMALL,
         groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(runs, number of sequences) for the counts of lengths 1 to capacity."""
    runs: list[tuple[int, int, int, int, int]] = []
    rank: dict[int, int] = defaultdict(int)
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, count)
    rooms: list[int] = []
    n_seq = 0

    def place(length: int, count: int, seq: int, offset: int) -> None:
        runs.append((length, rank[length], count, seq, offset))
        rank[length] += count

    def keep(room: int, seq: int, count: int) -> None:
        if room and count:
            if not free[room]:
                insort(rooms, room)
            free[room].append((seq, count))

    for k, lengths in plan_large({n: c for n, c in counts.items() if n > small and c}, capacity, groups):
        offset = 0
        for length in lengths:
            place(length, k, n_seq, offset)
            offset += length
        keep(capacity - offset, n_seq, k)
        n_seq += k

    for length in sorted((k for k, v in counts.items() if k <= small and v), reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                new = -(-n // (capacity // length))
                keep(capacity, n_seq, new)
                n_seq += new
                continue
            room = rooms[at]
            seq, have = free[room].pop()
            if not free[room]:
                rooms.pop(at)
            k = min(n, have)
            place(length, k, seq, capacity - room)
            keep(room - length, seq, k)
            keep(room, seq + k, have - k)
            n -= k
    return runs, n_seq


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """The pieces of every text's ids with their places and checksums."""
    ready(docs.sparkSession)
    path = path or vocabulary()

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), bpe.ids_batch(part.column(1).to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for i, (start, n) in enumerate(cut(len(ids), capacity)):
                        rows.append((doc_id, i, start, n, zlib.crc32(ids[start:start + n])))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECES)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece.

    A null text counts as empty and is one piece of the end id alone.  A null
    id stays null.  Rows given twice are packed twice; pieces that are equal in
    all of (length, doc_id, piece) take their places in any order.  An empty
    table gives no rows.  Other columns are not read.
    """
    cutup = stage(pieces(docs, capacity, end_id, path), "pieces")
    counts = {r["length"]: r["n"] for r in cutup.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    # sorted by length and rank: at most some thousand runs, as there are only `capacity` lengths
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast((table[:, 0] * (1 << 44) + table[:, 1], table))
    salts = max(1, -(-sum(counts.values()) // SALT_ROWS))
    salted = cutup.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    base = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base"))
    local = salted.withColumn("rank", F.row_number().over(
        Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")).cast("long") - 1)
    ranked = local.join(base, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))

    def place(batches):
        keys, rows = shared.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, f"{_PIECES}, sequence_id long, offset long")
