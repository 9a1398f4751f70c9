"""Pre-tokenisation without regex: the UTF-8 bytes of many texts become symbols (classes
of code points), symbols are transition functions of a small automaton, and an associative
scan over function composition gives the automaton's state everywhere at once. A look at
(state before, symbol) then says whether a slice starts there.

The slices are those of the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

They stay ranges of the texts' own buffer: an Arrow array that copies nothing, whose
distinct values Arrow finds, so no Python object is made for a slice that is known.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Code points with the White_Space property, besides 9-13 and 32.
WHITE = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# What may follow an apostrophe to make a contraction.
SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")

STATES = START, LETTER, NUMBER, OTHER, SPACE, WHITESPACE, TWO_LEFT, ONE_LEFT, ENDED = range(9)
#: S_LETTER stands where no contraction can be open, S_NEAR for the letters that may be part
#: of one; S_INNER is a byte inside a code point. A text's first symbol counts FIRST more.
SYMBOLS = S_OTHER, S_LETTER, S_NUMBER, S_WHITE, S_SPACE, S_SHORT, S_LONG, S_NEAR, S_INNER = range(9)
FIRST = 9
#: Bytes that one scan takes.
STRIDE = 1 << 21


def _symbol_functions() -> list[tuple[int, ...]]:
    """For each symbol, the state that follows each state; then for each that opens a text."""
    constant = lambda s: tuple(s for _ in STATES)
    letter = tuple(ONE_LEFT if s == TWO_LEFT else ENDED if s == ONE_LEFT else LETTER for s in STATES)
    # an apostrophe inside a run of other characters, or joined to a space, starts no contraction
    opened = lambda to: tuple(OTHER if s in (OTHER, SPACE) else to for s in STATES)
    own = [constant(OTHER), constant(LETTER), constant(NUMBER), constant(WHITESPACE), constant(SPACE), opened(ONE_LEFT), opened(TWO_LEFT), letter, tuple(STATES)]
    return own + [constant(f[START]) for f in own[:7]]


def _newer(kind: str) -> list[int]:
    """Code points that this Python's Unicode data lacks and the tokenizers library's, which
    are newer, count to the general category."""
    from tokenizers import Regex, pre_tokenizers

    lacking = [c for c in range(0x40000) if unicodedata.category(chr(c)) == "Cn"]
    others = pre_tokenizers.Split(Regex(rf"\p{{{kind}}}"), "removed").pre_tokenize_str("".join(map(chr, lacking)))
    left = np.ones(len(lacking), bool)
    for _, (a, b) in others:
        left[a:b] = False
    return [lacking[i] for i in np.flatnonzero(left)]


@functools.cache
def _tables():
    """Symbol of each code point; symbol of each byte (0 for those that open a longer code
    point); composition in the closure of the symbol functions (row first, column after
    it); the state that a constant function yields, or 255; whether a slice starts, by
    symbol and state before (16 states a row)."""
    classes = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            classes[c] = S_LETTER
        elif kind == "N":
            classes[c] = S_NUMBER
    for kind, symbol in (("L", S_LETTER), ("N", S_NUMBER)):
        classes[_newer(kind)] = symbol
    classes[[*range(9, 14), *WHITE]] = S_WHITE
    classes[32] = S_SPACE
    plain = np.concatenate([classes[:128], np.full(64, S_INNER, np.uint8), np.zeros(64, np.uint8)]).tobytes()
    functions = _symbol_functions()
    ids = {f: i for i, f in reversed(list(enumerate(functions)))}
    grown = True
    while grown:
        grown = False
        for f, g in itertools.product(list(functions), repeat=2):
            if (h := tuple(g[s] for s in f)) not in ids:
                ids[h] = len(functions)
                functions.append(h)
                grown = True
    n = len(functions)
    after = np.array([[ids[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint8)
    fixed = np.array([f[0] if len(set(f)) == 1 else 255 for f in functions], np.uint8)
    starts = np.zeros((16, 16), np.uint8)
    starts[FIRST:] = 1
    for s in STATES:
        starts[[S_LETTER, S_NEAR], s] = s not in (LETTER, SPACE, TWO_LEFT, ONE_LEFT)
        starts[S_NUMBER, s] = s not in (NUMBER, SPACE)
        starts[[S_OTHER, S_SHORT, S_LONG], s] = s not in (OTHER, SPACE)
        starts[[S_WHITE, S_SPACE], s] = s not in (SPACE, WHITESPACE)
    return classes, plain, after.ravel(), n, fixed, np.pad(fixed, (0, 256 - n)).tobytes(), starts.tobytes()


def _mapped(x: np.ndarray, table: bytes) -> np.ndarray:
    """Bytes by a table of 256."""
    return np.frombuffer(x.tobytes().translate(table), np.uint8)


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the code points of several UTF-8 bytes each: where they begin, and their values."""
    leads = np.flatnonzero(data >= 0xC0)
    at = [data[np.minimum(leads + k, len(data) - 1)].astype(np.int32) & 0x3F for k in range(4)]
    lead = data[leads].astype(np.int32)
    two, three = (lead & 0x1F) << 6 | at[1], (lead & 0x0F) << 12 | at[1] << 6 | at[2]
    four = (lead & 0x07) << 18 | at[1] << 12 | at[2] << 6 | at[3]
    return leads, np.minimum(np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four)), 0x10FFFF)


def symbols(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """A symbol for each byte. ``firsts`` are the places where texts begin."""
    classes, plain, *_ = _tables()
    out = _mapped(data, plain).copy()
    leads, points = code_points(data)
    out[leads] = classes[points]
    opening = np.zeros(len(data) + 2, bool)
    opening[firsts] = True
    quotes = np.flatnonzero(data == 39)
    if len(quotes):
        one = np.where(opening[quotes + 1], 0, data[np.minimum(quotes + 1, len(data) - 1)])
        two = np.where(opening[quotes + 1] | opening[quotes + 2], 0, data[np.minimum(quotes + 2, len(data) - 1)])
        one[quotes + 1 >= len(data)] = 0
        two[quotes + 2 >= len(data)] = 0
        short = quotes[np.isin(one, [ord(x) for x in SHORT])]
        long = quotes[np.isin(one.astype(np.int32) << 8 | two, [ord(x) << 8 | ord(y) for x, y in LONG])]
        out[short], out[long] = S_SHORT, S_LONG
        out[np.concatenate([short + 1, long + 1, long + 2])] = S_NEAR
    own = out[firsts]
    out[firsts] = FIRST + np.where(own == S_NEAR, S_LETTER, np.where(own == S_INNER, S_OTHER, own))
    return out


def boundaries(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Places at which slices start in the UTF-8 bytes of texts laid end to end; ``firsts``
    are those where texts begin (distinct, ascending, the first at 0)."""
    _, _, after, n, fixed, known, starts = _tables()
    symbol, state, found = symbols(data, firsts), START, []
    for a in range(0, len(data), STRIDE):
        some = symbol[a : a + STRIDE]
        scan, step = some, 1
        open_ = np.flatnonzero((some >= S_SHORT) & (some <= S_INNER))  # functions that are not constant
        if len(open_):
            scan = some.copy()
            if open_[0] == 0:  # the state that the scan before left makes the first function constant
                scan[0] = after[int(np.flatnonzero(fixed == state)[0]) * n + int(scan[0])]
                open_ = open_[1:]
            while len(open_):
                open_ = open_[open_ >= step]
                scan[open_] = after[scan[open_ - step].astype(np.intp) * n + scan[open_]]
                open_ = open_[fixed[scan[open_]] == 255]
                step *= 2
        states = _mapped(scan, known)
        code = some << 4
        code[1:] |= states[:-1]
        code[0] |= state
        begins = _mapped(code, starts)
        state = int(states[-1])
        found.append(np.flatnonzero(begins) + a)
    begins = np.zeros(len(data), bool)
    begins[np.concatenate(found)] = True
    # the last white space before other text parts from the rest of its run
    white = (symbol == S_SPACE) | (symbol == S_WHITE) | (symbol == FIRST + S_SPACE) | (symbol == FIRST + S_WHITE)
    follows = ~white & (symbol < FIRST)
    begins[:-1] |= white[:-1] & follows[1:] & (symbol[1:] != S_INNER)
    wide = np.flatnonzero(white & (data >= 0xC0))
    after_ = wide + 2 + (data[wide] >= 0xE0)
    wide, after_ = wide[after_ < len(data)], after_[after_ < len(data)]
    begins[wide[follows[after_]]] = True
    return np.flatnonzero(begins)


def strings(texts) -> pa.Array:
    """An Arrow string array without nulls, of an Arrow array or a list of strings."""
    if not isinstance(texts, pa.Array):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        return pa.array(raw, pa.binary())
    texts = texts.cast(pa.string()) if pa.types.is_large_string(texts.type) else texts
    return texts.fill_null("") if texts.null_count else texts


def cut(texts) -> tuple[pa.Array, np.ndarray]:
    """The slices of all texts (an Arrow array or a list) in order, as an array of binary
    that shares their buffer, and where those of each text end among them."""
    column = strings(texts)
    _, places, raw = column.buffers()
    offsets = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    low, high = int(offsets[0]), int(offsets[-1])
    if low == high:
        return pa.array([], pa.binary()), np.zeros(len(column), np.int64)
    data = np.frombuffer(raw, np.uint8)[low:high]
    ends = offsets.astype(np.int64) - low
    begins = boundaries(data, np.unique(ends[:-1][ends[:-1] < ends[1:]]))
    pieces = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(np.append(begins, high - low).astype(np.int32)), raw.slice(low, high - low)])
    return pieces, np.searchsorted(begins, ends[1:])


@functools.cache
def _word_bytes() -> tuple[np.ndarray, bytes]:
    """Whether a code point is a word character, and a byte of one."""
    word = np.array([chr(c).isalnum() for c in range(0x110000)])
    word[95] = True
    return word, bytes(word[:128].tolist()) + bytes(128)


def words(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The runs of word characters (letters, digits, _) of all texts, in order: distinct
    ones, the number of each run's among them, and where the runs of each text end."""
    column = pa.array(texts, pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[: len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    if not offsets[-1]:
        return pa.array([], pa.binary()), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: offsets[-1]]
    known, plain = _word_bytes()
    inside = _mapped(data, plain).astype(bool)
    leads, points = code_points(data)
    if len(leads):
        yes = leads[known[points]]
        for k, least in enumerate((0xC0, 0xC0, 0xE0, 0xF0)):
            inside[np.minimum(yes[data[yes] >= least] + k, len(data) - 1)] = True
    edge = np.ones(len(data) + 1, bool)  # between bytes: where a run may begin or end
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    is_word = inside[np.minimum(at[:-1], len(data) - 1)]
    pieces = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), raw.slice(0, len(data))])
    told = pieces.dictionary_encode()
    return told.dictionary, told.indices.to_numpy()[is_word], np.searchsorted(at[:-1][is_word], offsets[1:])


def slices(texts) -> list[list[str]]:
    """The slices of each text, in order; an empty text has none."""
    pieces, ends = cut(texts)
    words = [p.decode("utf-8", "surrogatepass") for p in pieces.to_pylist()]
    return [words[a:b] for a, b in itertools.pairwise([0, *ends.tolist()])]


def portions(column, most: int = 1 << 20, rows: int = 256):
    """Runs of the texts of an Arrow column of about ``most`` characters, as (first index,
    texts), null as empty. Texts become Python strings a few rows at a time."""
    first, size, held = 0, 0, []
    for a in range(0, len(column), rows):
        for t in column.slice(a, rows).to_pylist():
            t = t or ""
            if held and size + len(t) > most:
                yield first, held
                first, size, held = first + len(held), 0, []
            held.append(t)
            size += len(t)
    if held:
        yield first, held


def runs(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, pa.Array]]:
    """The same without Python strings: runs of about ``most`` bytes, as (first index, array)."""
    column = strings(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else []
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, int(offsets[a]) + most, "right")) - 1)
        yield a, column.slice(a, b - a)
        a = b


def gathered(values: list[bytes], indices: np.ndarray, ends: np.ndarray, dtype, last: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts from those of their distinct slices: the runs ``values[i]`` for i in
    ``indices`` laid end to end, ``last`` after each text; and where each text's ids end.
    ``ends`` tells where each text's indices end."""
    size = np.dtype(dtype).itemsize
    if last:
        indices, ends = np.insert(indices, ends, len(values)), ends + np.arange(1, len(ends) + 1)
        values = [*values, last]
    lengths = np.fromiter(map(len, values), np.int64, len(values)) // size
    flat = np.frombuffer(b"".join(values), dtype)
    each = lengths[indices]
    total = int(each.sum())
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    stop = np.cumsum(each, dtype=kind)
    at = (np.cumsum(lengths) - lengths).astype(kind)[indices]
    out = np.empty(total, dtype)
    # slices of one id, most of all, are one take; the others are spread
    one = each == 1
    out[stop[one] - 1] = flat[at[one]]
    more = np.flatnonzero(~one)
    if len(more):
        n = each[more].astype(kind)
        ends_, shift = np.cumsum(n, dtype=kind), stop[more]
        inner = np.arange(int(ends_[-1]), dtype=kind)
        # places in out, then in flat, of the ids of each such slice
        out[inner + np.repeat(shift - ends_, n)] = flat[inner + np.repeat(at[more] + n - ends_, n)]
    return out, np.append(0, stop.astype(np.int64))[ends]


def trim() -> None:
    """Gives memory that is free back to the system, where the C library can."""
    import contextlib
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class PieceCache(dict):
    """Encoded slices, at most two generations of ``most`` entries each: when the young
    one is full it becomes the old one, so frequent slices stay. A worker process keeps one
    such cache at a time: another operator's is emptied when this one is added to."""

    current: PieceCache | None = None

    def __init__(self, encode, most: int = 200_000):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, piece):
        found = self.old.get(piece)
        if found is None:
            found = self.encode(piece)
        self.add({piece: found} if len(piece) <= 64 else {})
        return found

    def add(self, found: dict) -> None:
        if PieceCache.current is not self:
            if PieceCache.current is not None:
                PieceCache.current.clear()
                PieceCache.current.old = {}
            PieceCache.current = self
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self.update(found)
