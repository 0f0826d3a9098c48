"""Best-fit packing of tokenized documents into sequences of fixed capacity, planned by linear grouping.

What the plan needs of the corpus is how many pieces have each length: at most `capacity` numbers, however large the
corpus. On them, large lengths are rounded up within groups of equal cardinality, so few sizes remain; configurations of
these sizes are optimised by column generation (a covering linear program, its pricing a knapsack); actual lengths then
take the places of the rounded ones, and the rest is placed by best fit, longest first. All steps handle runs of equal
lengths at once. The plan lists, for each length, which ranks go to which sequences; each piece finds its place by the
rank it has among the pieces of its length, so no task sees more than its share and the driver no document.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from ._shared import table
from .wordbpe import VOCABULARY, in_portions, shared_table

CAPACITY, GROUPS, SMALL = 2048, 24, (512, 700, 1024)  # lengths over one of SMALL count as large; the best plan is taken
_SALT_ROWS = 4096

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = 0) -> DataFrame:
    """Pieces of each document's ids and one end_id; only what is longer than capacity is cut."""

    def pieces(batches):
        words = shared_table(vocabulary)
        for b in batches:
            names = b.column(0).to_pylist()
            out = [[], [], [], [], []]
            for lo, texts in in_portions([t or "" for t in b.column(1).to_pylist()]):
                for name, ids in zip(names[lo:], words.encode(texts)):
                    raw = np.append(ids, end_id).astype("<u4").tobytes()
                    for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[at : at + 4 * capacity]
                        for column, x in zip(out, (name, n, at // 4, len(own) // 4, zlib.crc32(own))):
                            column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(pieces, PIECES)


def _groups(counts: dict[int, int], k: int) -> list[list[tuple[int, int]]]:
    """Large lengths, longest first, in k groups of equal cardinality: lists of (length, how many)."""
    total = sum(counts.values())
    out, size, room = [[]], max(1, -(-total // k)), 0
    room = size
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not room:
                out.append([])
                room = size
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
    return [g for g in out if g]


def _knapsack(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The most valuable multiset of sizes within capacity (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1, np.int64)
    least = min(sizes)
    sz, val = np.array(sizes), np.asarray(values)
    for c in range(least, capacity + 1):
        fit = sz <= c
        got = np.where(fit, best[np.maximum(c - sz, 0)] + val, -1.0)
        i = int(got.argmax())
        if got[i] > best[c - 1] + 1e-12:
            best[c], pick[c] = got[i], i
        else:
            best[c] = best[c - 1]
    out, c = [0] * len(sizes), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
            continue
        out[pick[c]] += 1
        c -= sizes[pick[c]]
    return float(best[capacity]), out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[int, list[int]]]:
    """(how many sequences, how many of each size) that cover demand but for a rest, by column generation.

    Revised simplex on the covering program; the counts are the linear program's, rounded down.
    """
    m = len(sizes)
    columns = np.diag([float(capacity // s) for s in sizes])
    inverse = np.linalg.inv(columns)
    x = inverse @ np.array(demand, float)
    for _ in range(rounds):
        prices = inverse.sum(0)
        value, column = _knapsack(sizes, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-7:
            break
        d = inverse @ np.array(column, float)
        up = np.flatnonzero(d > 1e-9)
        if not len(up):
            break
        leave = up[np.argmin(x[up] / d[up])]
        step = x[leave] / d[leave]
        x = x - step * d
        x[leave] = step
        columns[:, leave] = column
        inverse = np.linalg.inv(columns)
        x = np.maximum(inverse @ np.array(demand, float), 0)
    return [(int(n + 1e-9), [int(v) for v in columns[:, j]]) for j, n in enumerate(x) if int(n + 1e-9)]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = 700) -> list[tuple[int, tuple[int, ...]]]:
    """(how many sequences, the lengths in each) that hold exactly the given pieces."""
    left = {n: c for n, c in counts.items() if c}
    done = [(left.pop(capacity), (capacity,))] if capacity in left else []
    runs: list[tuple[int, tuple[int, ...]]] = []
    large = {n: c for n, c in left.items() if n > small}
    if large:
        queue = _groups(large, groups)
        sizes = [g[0][0] for g in queue]
        merged: dict[int, list] = {}
        for s, g in zip(sizes, queue):
            merged.setdefault(s, []).extend(g)
        queue = [merged[s] for s in merged]
        sizes = list(merged)
        need = [sum(n for _, n in g) for g in queue]
        for times, column in configurations(sizes, need, capacity):
            slots = [i for i, n in enumerate(column) for _ in range(n)]
            while times:
                # a slot takes the group's next run of equal lengths; the shortest of these runs bounds the step
                step, use = times, {}
                for i in slots:
                    use[i] = use.get(i, 0) + 1
                use = {i: n for i, n in use.items() if queue[i]}
                if not use:
                    break
                for i, n in use.items():
                    have = queue[i][0][1]
                    step = min(step, max(1, have // n))
                filled = []
                for i, n in use.items():
                    for _ in range(n):
                        if not queue[i]:
                            break
                        length, have = queue[i][0]
                        take = min(step, have)
                        if take < step:
                            break
                        filled.append(length)
                        queue[i][0] = (length, have - take)
                        if have == take:
                            queue[i].pop(0)
                runs.append((step, tuple(filled)))
                times -= step
        for length in large:
            left.pop(length)
        for g in queue:
            for length, n in g:
                left[length] = left.get(length, 0) + n
    # best fit: the rest, longest first, into what is fullest and still has room; equal sequences are filled as one run
    rooms: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    order: list[int] = []

    def put(n: int, lengths: tuple[int, ...]) -> None:
        room = capacity - sum(lengths)
        if room not in rooms:
            rooms[room] = []
            insort(order, room)
        rooms[room].append((n, lengths))

    for n, lengths in runs:
        put(n, lengths)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                whole, rest = divmod(n, each)
                if whole:
                    put(whole, (length,) * each)
                if rest:
                    put(1, (length,) * rest)
                break
            room = order[at]
            have, lengths = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            each = room // length
            whole = min(have, n // each)
            if whole:
                put(whole, lengths + (length,) * each)
                if have > whole:
                    put(have - whole, lengths)
                n -= whole * each
            else:
                put(1, lengths + (length,) * n)
                if have > 1:
                    put(have - 1, lengths)
                n = 0
    return done + [x for room in order for x in rooms[room]]


def _places(runs: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks, first sequences and offsets of the runs that take pieces of this length."""
    taken: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for n, lengths in runs:
        offset = 0
        for x in lengths:
            rank = taken.get(x, 0)
            out.setdefault(x, []).append((rank, base, offset))
            taken[x] = rank + n
            offset += x
        base += n
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows)) for x, rows in out.items()}


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """Adds rank, from 0, among the pieces of equal length. A length is dealt over salts, so a common one is no hot key."""
    salts = max(1, -(-total // _SALT_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    each = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = each.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    return own.join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before")).drop("salt", "own", "before")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of length 1 (the end id). Rows with a null or a repeated doc_id are packed like any
    other. An empty table gives no rows. Other columns are not read.
    """
    pieces = staged(cut_pieces(docs, capacity, vocabulary), "packing")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    places = _places(min((plan(counts, capacity, small=s) for s in SMALL), key=lambda runs: sum(n for n, _ in runs)))

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            by = np.argsort(length, kind="stable")
            for own in np.split(by, np.flatnonzero(np.diff(length[by])) + 1) if len(by) else []:
                first, base, at = places[int(length[own[0]])]
                i = np.searchsorted(first, rank[own], "right") - 1
                sequence[own], offset[own] = base[i] + rank[own] - first[i], at[i]
            kept = b.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"])

    out = ranked(pieces, sum(counts.values())).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("bigint"))
    return out.mapInArrow(place, f"{PIECES}, sequence_id bigint, offset bigint")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of all documents; nulls, repeated rows, empty tables and extra columns as in pack()."""
    return pack(docs)
