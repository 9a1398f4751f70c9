"""Periodic runs of words: stretches that repeat themselves with a period.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and
of at least max(LEAST, 2q) words, which no neighbouring word extends. Runs are found by
block matching. At scale B, a power of two, the blocks of B words that begin at multiples of
B are keys of an Aho-Corasick automaton over integer sequences (each as the numbers of its two
halves), and the whole document is searched for them. A run of period q has q words and more besides its first period, so an aligned
block of the largest B with 2B - 1 <= max(q, LEAST - q) lies in it and occurs again q words
later: such pairs, at the distances that belong to the scale, are the seeds. Each is extended
word by word in both directions, so no chance decides. A block of a larger scale can only
occur twice if both halves do, which leaves few keys in ordinary text; seeds inside a known
run whose period divides theirs would give that run again and are left out first.

Words are maximal runs of bytes other than ASCII white space. Null and empty texts have no
words and no runs. Rows are taken one by one: repeated rows give equal results, and no row
looks at another. A document is held by one task, in memory that grows with its own words.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.pretokenise import trim

#: Words that a run has at least.
LEAST = 12


def scale(size: int, least: int) -> list[tuple[int, int]]:
    """The ranges of distances (both ends included) that seeds of blocks of ``size`` have."""
    low, high = 2 * size - 1, 4 * size - 2  # what max(q, least - q) may be
    ranges = [(max(1, least - high), min(least - low, (least - 1) // 2)), (max(low, (least + 1) // 2), high)]
    return [(a, b) for a, b in ranges if a <= b]


def located(halves: np.ndarray, size: int) -> np.ndarray | None:
    """For each place the number of the aligned block that occurs there, or -1 where none
    does that occurs twice; None if there is none at all. ``halves`` tells the same of
    blocks of half the size: a block is a key of two of their numbers, and the document is
    searched as the sequences of numbers that are half a block apart. So keys have two
    elements at every scale, and no text makes the automaton follow long chains of borders."""
    n, half = len(halves), size // 2
    at = np.arange(0, n - size + 1, size)
    left, right = halves[at], halves[at + half]
    good = (left >= 0) & (right >= 0)
    if not good.any():
        return None
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    pairs = dict.fromkeys(zip(left[good].tolist(), right[good].tolist(), strict=True))
    for number, pair in enumerate(pairs):
        found.add_word(pair, number)
    found.make_automaton()
    # a row for each remainder of the place, a column more to part the rows
    columns = -(-n // half) + 1
    rows = np.full(columns * half, -1, np.int64)
    rows[:n] = halves
    rows = rows.reshape(columns, half).T.ravel()
    rows[rows < 0] = n  # no block's number
    hits = np.fromiter((x for hit in found.iter(tuple(rows.tolist())) for x in hit), np.int64)
    level = np.full(n, -1, np.int64)
    level[(hits[::2] % columns - 1) * half + hits[::2] // columns] = hits[1::2]
    return repeated(level)


def repeated(level: np.ndarray) -> np.ndarray | None:
    """Numbers of what occurs once become -1; None if nothing is left."""
    known = level >= 0
    often = np.bincount(level[known]) > 1
    level[known] = np.where(often[level[known]], level[known], -1)
    return level if often.any() else None


def seeds(level: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance): aligned blocks, and how far on they occur again."""
    places = np.flatnonzero(level >= 0)
    starts, distances = [], []
    for low, high in scale(size, least):
        nearest = (places - low) // size * size
        for back in range(0, high - low + size, size):
            s = nearest - back
            good = (s >= 0) & (s >= places - high)
            s, p = s[good], places[good]
            good = level[s] == level[p]
            starts.append(s[good])
            distances.append((p - s)[good])
    return (np.concatenate(starts), np.concatenate(distances)) if starts else (places[:0], places[:0])


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the first elements are equal."""
    done, step, n = 0, 64, len(a)
    while done < n:
        differ = a[done : done + step] != b[done : done + step]
        if (k := int(differ.argmax())) or differ[0]:
            return done + k
        done, step = done + step, 2 * step
    return n


def runs(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words, by start, then period."""
    n = len(words)
    if n < least:
        return []
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    level, size = repeated(ids.copy()), 1
    periods: dict[tuple[int, int], int] = {}
    # of the known runs over a place, where the farthest ends, and its period
    reach, inner = np.zeros(n, np.int64), np.ones(n, np.int64)

    def new(s: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (reach[s] < s + q + size) | (q % inner[s] > 0)

    while level is not None:
        s, q = seeds(level, size, least)
        kept = new(s, q)
        s, q = s[kept], q[kept]
        order = np.lexsort((s, q))
        s, q = s[order], q[order]
        for a, b in _groups(q):
            period, at = int(q[a]), s[a:b]
            at = at[new(at, q[a:b])]
            k = 0
            while k < len(at):
                x = int(at[k])
                first = x - agreeing(ids[:x][::-1], ids[period : x + period][::-1])
                last = x + agreeing(ids[x : n - period], ids[x + period :])
                if last - first >= max(period, least - period):
                    end = last + period
                    periods[first, end] = min(period, periods.get((first, end), period))
                    far, short = reach[first:end], inner[first:end]  # views
                    better = (far < end) | ((far == end) & (short > period))
                    far[better], short[better] = end, period
                k = int(np.searchsorted(at, last, "right" if last == x else "left"))
        size *= 2
        if size > n:
            break
        level = located(level, size)
    return sorted((a, e - a, q) for (a, e), q in periods.items())


def _groups(q: np.ndarray):
    """Begins and ends of the stretches of equal values."""
    if not len(q):
        return []
    edges = np.flatnonzero(np.diff(q)) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(q)], strict=True))


def unrolled(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words without those that come after the first period of a run."""
    if not found:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    spans = np.array(found)
    np.add.at(depth, spans[:, 0] + spans[:, 2], 1)
    np.add.at(depth, spans[:, 0] + spans[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def plain(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    """The runs, and the text without repetitions."""
    return [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], b" ".join(unrolled(words, found)).decode("utf-8", "replace")


PLAIN = (("runs array<struct<start:long,length:long,period:long>>", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed string", pa.string()))


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", derive=plain, derived=PLAIN, least: int = LEAST) -> DataFrame:
    """One row for each row of df: its id, and what ``derive(words, runs)`` returns for its
    text, as columns that ``derived`` declares (Spark's name and type, Arrow's type); by
    default its runs and the text without the words after a run's first period, joined by
    single spaces. No shuffle. Other columns go."""
    source = df.select(df[id_col].alias("id"), df[text_col].cast("binary").alias("text"))
    names = [d[0].split(" ")[0] for d in derived]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                rows = []
                for raw in part.column(1).to_pylist():
                    words = (raw or b"").split()
                    rows.append(derive(words, runs(words, least)))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, d[1]) for c, d in zip(columns, derived, strict=True)]], [id_col, *names])
        trim()

    return source.mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, " + ", ".join(d[0] for d in derived))
