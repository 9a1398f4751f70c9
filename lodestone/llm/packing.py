"""Packing of documents into sequences of a fixed window.

Full windows are cut from each document first; what is left of it, shorter than the
window, is packed by non-negative least squares: all combinations of at most three
lengths that fill the window are columns, the histogram of lengths is the right side,
and the solution says how often each combination is used. Repeat counts are rounded
(carrying the error along) and held to what the histogram has; exact fills that are
still possible are then taken greedily, and the rest is laid end to end and cut at the
window. The last, short sequence is cut at falling powers of two, which need no padding.

What the driver holds is bounded by the window, not by the corpus: a histogram of
``window`` counts and at most window^2 / 12 combinations. Ranks of documents among those
of equal length come from prefix sums over the tasks that tokenised them.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lodestone.llm.library import encoder
from lodestone.llm.pretokenise import runs, trim
from lodestone.llm.shared import written

ROUNDS = 120
#: Most tasks that tokenise: each has a row of the histogram for each length.
TASKS = 1 << 16
#: Most bytes of rank bases that are broadcast; more of them are joined by a shuffle.
BROADCAST = 32 << 20


def combinations(window: int, have: np.ndarray) -> np.ndarray:
    """Rows of three lengths a >= b >= c that fill the window (c, or b and c, may be 0),
    all of which the histogram ``have`` holds."""
    out = []
    for a in range(window - 1, (window - 1) // 3, -1):
        if not have[a]:
            continue
        rest = window - a
        b = np.arange((rest + 1) // 2, min(a, rest) + 1)
        c = rest - b
        keep = (have[b] > 0) & ((c == 0) | (have[c] > 0))
        out.append(np.stack([np.full(keep.sum(), a), b[keep], c[keep]], 1))
    return np.concatenate(out) if out else np.empty((0, 3), np.int64)


def repeats(lengths: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Least squares repeat counts >= 0 by accelerated projected gradient; rows are
    weighted by their length, as an unused long piece costs more."""
    weight = np.sqrt(np.arange(window) / window)
    weight[0] = 0
    target = counts * weight
    flat = lengths.ravel()

    def forward(x):
        return np.bincount(flat, np.repeat(x, 3), window) * weight

    def back(r):
        return (r * weight)[lengths].sum(1)

    probe = np.ones(len(lengths))
    for _ in range(15):
        probe = back(forward(probe))
        size = np.linalg.norm(probe)
        probe /= size
    x = y = np.zeros(len(lengths))
    t = 1.0
    for _ in range(ROUNDS):
        new = np.maximum(0, y - back(forward(y) - target) / (size * 1.02))
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / later * (new - x), later
    return x


class Plan:
    """Where the piece of a given length and rank goes. ``packed[l]`` pieces of length l
    lie in combinations, in ranges of ranks; the others in the stream."""

    def __init__(self, counts: np.ndarray, window: int):
        self.window = window
        left = counts.astype(np.int64).copy()
        left[0] = 0
        patterns: list[tuple[int, int, int, int]] = []
        combos = combinations(window, left)
        if len(combos):
            x = repeats(combos, left, window)
            carried = np.floor(np.cumsum(x) + 0.5).astype(np.int64)
            times = np.diff(carried, prepend=0)
            some = np.flatnonzero(times)
            have = left.tolist()
            for (a, b, c), n in zip(combos[some].tolist(), times[some].tolist(), strict=True):
                need: dict[int, int] = {}
                for length in (a, b, c):
                    if length:
                        need[length] = need.get(length, 0) + 1
                n = min(n, *(have[k] // v for k, v in need.items()))
                if n > 0:
                    patterns.append((a, b, c, n))
                    for k, v in need.items():
                        have[k] -= v * n
            left = np.array(have, np.int64)
        self._greedy(left, patterns)
        self._lay_out(counts, left, patterns)

    def _greedy(self, left: np.ndarray, patterns: list) -> None:
        """Longest first, whatever still fills the window exactly."""
        for a in range(self.window - 1, (self.window - 1) // 3, -1):
            while left[a]:
                rest = self.window - a
                b = np.arange((rest + 1) // 2, min(a, rest) + 1)
                c = rest - b
                n = np.minimum(np.where(b == a, (left[a] - 1), left[b]), np.where(c == 0, left[a], np.where((c == b) | (c == a), 0, left[c])))
                n = np.minimum(n, np.where(b == a, left[a] // 2, left[a]))
                k = int(np.argmax(n)) if len(n) else 0
                if not len(n) or n[k] <= 0:
                    break
                n = int(n[k])
                patterns.append((a, int(b[k]), int(c[k]), n))
                left[a] -= n
                left[b[k]] -= n
                if c[k]:
                    left[c[k]] -= n

    def _lay_out(self, counts, left, patterns) -> None:
        used = np.zeros(self.window, np.int64)
        keys, first, offset = [], [], []
        sequence = 0
        for a, b, c, n in patterns:
            at = 0
            for length in (a, b, c):
                if length:
                    keys.append((length, int(used[length])))
                    first.append(sequence)
                    offset.append(at)
                    used[length] += n
                    at += length
            sequence += n
        # of each length: where ranges of ranks begin, the sequence of the first, the offset
        self.ranges: dict[int, tuple[list[int], list[int], list[int]]] = {}
        for (length, rank), sequence_id, at in sorted(zip(keys, first, offset, strict=True)):
            for held, value in zip(self.ranges.setdefault(length, ([], [], [])), (rank, sequence_id, at), strict=True):
                held.append(value)
        self.packed = used.tolist()
        sizes = np.arange(self.window) * left
        self.stream = (np.cumsum(sizes) - sizes).tolist()  # where each length's pieces begin in the stream
        self.base, total = sequence, int(sizes.sum())
        self.whole = total // self.window * self.window  # of the stream that makes full windows
        tail, at, ends = total - self.whole, self.whole, []
        for bit in range(self.window.bit_length(), -1, -1):
            if tail >> bit & 1:
                at += 1 << bit
                ends.append(at)
        self.ends = ends  # of the short sequences
        self.sequences = sequence + self.whole // self.window + len(ends)

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, tokens) of each cut of a piece, in order."""
        if rank < self.packed[length]:
            ranks, first, offset = self.ranges[length]
            k = bisect.bisect_right(ranks, rank) - 1
            return [(first[k] + rank - ranks[k], offset[k], length)]
        at = self.stream[length] + (rank - self.packed[length]) * length
        out = []
        while length:
            if at < self.whole:
                sequence, start = divmod(at, self.window)
                room = self.window - start
            else:
                k = bisect.bisect_right(self.ends, at)
                begin = self.whole if k == 0 else self.ends[k - 1]
                sequence, start, room = self.whole // self.window + k, at - begin, self.ends[k] - at
            take = min(room, length)
            out.append((self.base + sequence, start, take))
            at, length = at + take, length - take
        return out


def tokenised(df: DataFrame, path: str, end: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """Ids of each text, and its ranks in the task that made them: among documents whose
    rest has the same length, and of its full windows. Written, so that ranks stay."""

    def run(batches):
        encode = encoder(path)
        part = TaskContext.get().partitionId()
        ranks, full = np.zeros(window, np.int64), 0
        for batch in batches:
            for first, some in runs(batch.column(1)):
                flat, ends = encode.encoded(some, end)
                tokens = np.diff(ends, prepend=0)
                rest, full_ = tokens % window, np.cumsum(tokens // window)
                # ranks among equal rests: of this run by a stable sort, after those before it
                order = np.argsort(rest, kind="stable")
                begins = np.searchsorted(rest[order], rest[order])
                rank = np.empty(len(rest), np.int64)
                rank[order] = np.arange(len(rest)) - begins
                rank += ranks[rest]
                windows = full + full_ - tokens // window
                ranks += np.bincount(rest, minlength=window)
                full += int(full_[-1])
                # a batch's binary column holds less than 2 GiB: a run is short or one text
                raw = flat.astype(flat.dtype.newbyteorder("<"), copy=False)
                at = (np.append(0, ends) * raw.itemsize).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(at), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(some)), pa.array(np.full(len(some), part, np.int32)), pa.array(tokens), pa.array(rest.astype(np.int32)), pa.array(rank), pa.array(windows), ids],
                    ["id", "part", "tokens", "rest", "rank", "windows", "ids"],
                )
        trim()

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).coalesce(TASKS)
    kind = dict(source.dtypes)["id"]
    return written(source.mapInArrow(run, f"id {kind}, part int, tokens long, rest int, rank long, windows long, ids binary"), "tokenised")


def pack(df: DataFrame, path: str, window: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text", derive=None, derived: str = "ids array<long>") -> DataFrame:
    """One row for each piece of each document: its id, start (ids of the document before
    the piece), length, doc_tokens, sequence_id, offset in the sequence (gapless from 0),
    and what ``derive(ids)`` returns as the one column that ``derived`` declares (by
    default the ids, those of the tokenizers library for ``path``, then ``end``).

    Null and empty texts are the end id alone. Rows with equal or null ids are documents
    of their own. Other columns of the table are ignored. An empty table gives no rows."""
    spark = df.sparkSession
    held = tokenised(df, path, end, window, id_col, text_col)
    size = "<u4" if encoder(path).dtype == np.uint32 else "<u2"
    by = held.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("tokens") / window)).alias("full"))
    by = written(by, "histogram")
    counts = np.zeros(window, np.int64)
    for rest, n in by.groupBy("rest").agg(F.sum("n")).collect():  # at most one row for each length below the window
        counts[rest] = n
    plan = Plan(counts, window)
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = by.select("part", "rest", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank_base"))
    parts = by.groupBy("part").agg(F.sum("full").alias("full"))  # one row for each task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("full").over(before), F.lit(0)).alias("window_base"))
    bases = ranks.join(parts, "part")
    # at most a row for each task and length: sent to all tasks while that is small
    small = parts.count() * window * 24 <= BROADCAST
    placed = held.join(F.broadcast(bases) if small else bases.hint("merge"), ["part", "rest"])
    placed = placed.select("id", "tokens", "rest", (F.col("rank") + F.col("rank_base")).alias("rank"), (F.col("windows") + F.col("window_base")).alias("windows"), "ids")
    shared = spark.sparkContext.broadcast(plan)  # bounded by the window
    derive = derive or (lambda ids: ids.astype(np.int64))
    column = derived.split(" ")[0]

    def run(batches):
        plan = shared.value
        for batch in batches:
            origin, rows = [], []
            for i, (tokens, rest, rank, windows, raw) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True)):
                ids, start = np.frombuffer(raw, size), 0
                where = [(plan.sequences + windows + k, 0, window) for k in range(tokens // window)]
                where += plan.place(rest, rank) if rest else []
                for sequence, offset, length in where:
                    origin.append(i)
                    rows.append((start, length, tokens, sequence, offset, derive(ids[start : start + length])))
                    start += length
            if rows:
                columns = [pa.array(list(c)) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(origin)), *columns], [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", column])
        trim()

    kind = dict(placed.dtypes)["id"]
    return placed.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, {derived}")
