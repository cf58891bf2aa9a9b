"""Packing of token sequences by bin completion.

Texts are tokenized and cut where they are read. Only the number of pieces of each length decides how
well they pack, and there are at most ``capacity`` lengths, so a branch-and-bound search over those
counts plans all sequences: it takes the largest length left, lists the undominated fillings of the room
beside it, of any number of pieces, least waste first, and uses each filling as often as the counts allow. A
filling that wastes more than a better plan could afford is not tried, and a search is cut where the sequences so far and the
least number for the rest reach the best plan known; best fit gives the first such plan.

The plan becomes rank intervals of each length. Pieces get their rank within their length in Spark, by
counts over (length, salt), so a length that holds a third of all rows is ranked by many tasks.

Null and empty texts are one piece of the end id. Rows with the same id, null included, are separate
documents. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapegrain.llm import textops as X
from tapegrain.llm.common import materialize, partitions
from tapegrain.llm.tokens import encode_closed, vocabulary_path

CAPACITY, END_ID = 1024, 2
#: Nodes of the search after the first plan; the best plan so far stands when they are used up.
NODES = 5_000
#: Shares of the way from the lower bound to best fit whose tokens a plan may waste freely; -1 wastes none.
GRID = (-1, 0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7)


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches):
            ids, first = encode_closed(path, *X.text_buffer(part.column("text")), end_id)
            n = np.diff(first)
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            piece = X.ranges(np.zeros(len(n), np.int64), count)
            head = n - capacity * (count - 1)
            start = np.where(piece == 0, 0, head[doc] + capacity * (piece - 1))
            length = np.where(piece == 0, head[doc], capacity)
            begin = first[doc] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
            yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()).take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64())})
    return run


#: A filling of at most STOWED pieces is compared with so many listed before it; where it is not, more are tried.
DOMINANCE, STOWED = 16, 6


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of ``b`` can be stowed into bins of the sizes of ``a``."""
    def stow(room: list[int], rest: tuple[int, ...]) -> bool:
        if not rest:
            return True
        return any(r >= rest[0] and stow(room[:i] + [r - rest[0]] + room[i + 1:], rest[1:]) for i, r in enumerate(room))
    return stow(list(a), b)


def reachable(sizes: list[int], most: list[int], room: int) -> list[int]:
    """For each i a bit set of the sums up to ``room`` of pieces from sizes[i:], at most most[i] of a size."""
    out, mask = [1], (1 << room + 1) - 1
    for size, left in zip(reversed(sizes), reversed(most)):
        sums, step = out[-1], 1
        while left > 0:  # 1, 2, 4, ... pieces at once
            n = min(step, left)
            sums |= sums << n * size & mask
            left, step = left - n, 2 * step
        out.append(sums)
    return out[::-1]


def fillings(counts: np.ndarray, room: int, waste: int, steps: list[int]) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room`` with pieces of the counts, any number of them, the largest pieces first.

    Listed are those that leave at most ``waste``, or else those that leave least. Larger pieces first: a filling can only
    be dominated by one listed before. Steps after the first filling are taken from ``steps`` and end with them.
    """
    sizes = [int(x) for x in np.flatnonzero(counts[:room + 1])[::-1] if x > 0]
    most = [min(int(counts[x]), room // x) for x in sizes]
    sums = reachable(sizes, most, room)
    waste = min(max(waste, room + 1 - sums[0].bit_length()), room)
    listed: list[tuple[int, ...]] = []

    def some(i: int, rest: int) -> bool:
        """Whether sizes[i:] fill ``rest`` but for the waste."""
        return rest >= 0 and sums[i] >> max(rest - waste, 0) & (1 << min(rest, waste) + 1) - 1 != 0

    # depth first: which size next, how often, and the room that is left; the last pushed comes first
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    while stack:
        i, rest, filling = stack.pop()
        if listed:
            steps[0] -= 1
            if steps[0] < 0:
                return
        while i < len(sizes) and sizes[i] > rest:
            i += 1
        if i == len(sizes):
            if len(filling) > STOWED or not any(len(f) <= STOWED and dominates(f, filling) for f in listed):
                listed = [*listed, filling][-DOMINANCE:]
                yield filling
            continue
        for n in range(min(most[i], rest // sizes[i]) + 1):
            if some(i + 1, rest - n * sizes[i]):
                stack.append((i + 1, rest - n * sizes[i], filling + (sizes[i],) * n))


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """Lower bound by Martello and Toth: pieces that cannot share, and the volume that cannot fit beside them."""
    size = np.arange(len(counts))
    mass = np.cumsum(counts * size)
    number = np.cumsum(counts)
    k = np.arange(0, capacity // 2 + 1)
    over = number[capacity] - number[capacity - k]  # longer than capacity - k
    middle = number[capacity - k] - number[capacity // 2]
    middle_mass = mass[capacity - k] - mass[capacity // 2]
    small_mass = mass[capacity // 2] - np.where(k > 0, mass[np.maximum(k - 1, 0)], 0)
    spare = middle * capacity - middle_mass
    need = over + middle + np.maximum(0, -(-(small_mass - spare) // capacity))
    return int(max(need.max(), -(-mass[capacity] // capacity)))


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Largest first: into the fullest open sequence with room, else a new one, equal steps together."""
    open_: dict[tuple[int, ...], int] = {}
    by_room: dict[int, list[tuple[int, ...]]] = {}
    for s in range(capacity, 0, -1):
        left = int(counts[s])
        while left:
            room = next((r for r in range(s, capacity + 1) if by_room.get(r)), None)
            if room is None:
                # as many in each new sequence as fit
                each = min(capacity // s, left)
                new, n = (s,) * each, left // each
                left -= n * each
                rest = capacity - s * each
            else:
                old = by_room[room][-1]
                n = min(left, open_[old])
                open_[old] -= n
                if not open_[old]:
                    by_room[room].pop()
                    del open_[old]
                left -= n
                new, rest = old + (s,), room - s
            if new not in open_:
                open_[new] = 0
                by_room.setdefault(rest, []).append(new)
            open_[new] += n
    return [(p, n) for p, n in open_.items() if n]


def _search(counts: np.ndarray, capacity: int, best_n: int, goal: int, free: int, budget: int) -> tuple[list[tuple[tuple[int, ...], int]] | None, int]:
    """A plan of fewer than ``best_n`` sequences, found within ``budget`` nodes, and how many it has; None without one.

    Until ``free`` tokens are wasted, the largest pieces share sequences whatever that wastes; then fillings waste as little as they can.
    """
    counts, best = counts.copy(), None
    mass, used, seen = int((counts * np.arange(len(counts))).sum()), 0, 0
    path: list[tuple[tuple[int, ...], int, int]] = []
    stack: list[Iterator[tuple[int, ...]]] = []
    steps = [20 * budget]
    while best_n > goal and seen < budget:
        spare = (best_n - 1 - used) * capacity - mass  # what a better plan can still waste
        options: Iterator[tuple[int, ...]] = iter(())
        if not mass:
            best, best_n = [(f, n) for f, n, _ in path], used
        elif spare >= 0 and (seen % 8 or used + least_bins(counts, capacity) < best_n):
            s = int(np.flatnonzero(counts)[-1])
            beside = counts.copy()
            beside[s] -= 1
            options = ((s, *f) for f in fillings(beside, capacity - s, min(free, spare), steps) if capacity - s - sum(f) <= spare)
        stack.append(options)
        f = next(stack[-1], None)
        while f is None:
            stack.pop()
            if not stack:
                return best, best_n
            last, n, wasted = path.pop()
            np.add.at(counts, list(last), n)
            used, mass, free = used - n, mass + n * sum(last), free + wasted
            f = next(stack[-1], None)
        size, times = np.unique(f, return_counts=True)
        n, waste = int((counts[size] // times).min()), capacity - sum(f)
        if 0 < waste <= free:
            n = min(n, free // waste)
        wasted = min(free, n * waste)
        counts[size] -= n * times
        path.append((f, n, wasted))
        used, mass, free, seen = used + n, mass - n * sum(f), free - wasted, seen + 1
    return best, best_n


def plan(counts: np.ndarray, capacity: int, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how often each is used, for ``counts[length]`` pieces.

    The tokens that a plan may waste on its largest pieces are those of a number of sequences between the bound and
    the best plan; numbers are tried from a grid, then halfway around the best one.
    """
    counts = counts.astype(np.int64)
    best = best_fit(counts, capacity)
    best_n, goal = sum(n for _, n in best), least_bins(counts, capacity)
    mass, gap, tried = int((counts * np.arange(len(counts))).sum()), best_n - goal, {}

    def attempt(share: float) -> None:
        nonlocal best, best_n
        free = max(0, int((goal + gap * share) * capacity) - mass) if share >= 0 else 0
        if best_n > goal and free not in tried:
            found, n = _search(counts, capacity, best_n, goal, free, nodes // len(GRID) + 2 * len(best))
            tried[free] = n if found else best_n + 1
            best, best_n = (found, n) if found else (best, best_n)

    for share in GRID:
        attempt(share)
    step, centre = 0.1, 0.1
    while step * gap >= 1 and best_n > goal and step > 0.005:
        before = best_n
        for share in (centre - step, centre + step):
            attempt(max(share, 0))
            if best_n < before:
                centre, before = share, best_n
        step /= 2
    return best


def _slots(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, np.ndarray]:
    """For each length its intervals (first rank, sequence of the first, offset), by rank."""
    taken, base = np.zeros(capacity + 1, np.int64), 0
    out: dict[int, list[tuple[int, int, int]]] = {}
    for sizes, n in patterns:
        offset = 0
        for s in sizes:
            out.setdefault(s, []).append((int(taken[s]), base, offset))
            taken[s] += n
            offset += s
        base += n
    return {s: np.array(v, np.int64).T for s, v in out.items()}


def _place(slots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length):
                own = length == s
                first, base, at = slots[int(s)]
                k = np.searchsorted(first, rank[own], side="right") - 1
                seq[own], offset[own] = base[k] + rank[own] - first[k], at[k]
            kept = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.record_batch(kept | {"sequence_id": seq, "offset": offset})
    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    path = path or vocabulary_path()
    made = docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")
    salts = partitions(docs.sparkSession)
    pieces = materialize(made.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")), "pieces")
    number = materialize(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    hist = number.groupBy("length").agg(F.sum("n").alias("n")).toArrow()  # at most one row for each length
    counts = np.zeros(capacity + 1, np.int64)
    counts[hist.column("length").to_numpy()] = hist.column("n").to_numpy()
    slots = _slots(plan(counts, capacity), capacity)
    before = number.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
