"""Byte-level BPE encoding and decoding.

Texts are cut into slices by the automaton of ``pretokenise``; each slice is merged by
rank once and then found in a cache. Token offsets in the text's UTF-8 bytes are kept,
so that any token maps back to its place; the tokens' bytes laid end to end are the text.

Null and empty texts have no tokens. Rows keep their id whatever it is (null, repeated);
other columns of the table are ignored.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.pretokenise import PieceCache, cut, gathered, runs, trim

#: Slices longer than this merge through a heap instead of a scan for the least rank.
LONG = 100
NEVER = 1 << 60


class Vocabulary:
    """Ranks of byte strings, and the merges that they imply."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.names = pa.array([b"%d " % i for i in range(len(self.tokens))], pa.large_binary())
        self.bytes = pa.array(self.tokens, pa.large_binary())
        self.cache = PieceCache(lambda piece: np.array(self.merge(piece), np.uint32).tobytes(), 300_000)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: the pair of least rank merges first, the leftmost of equals."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > LONG:
            return self._merge_long(piece)
        get = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(piece[i : i + 2], NEVER) for i in range(len(piece) - 1)]
        while pairs:
            least = min(pairs)
            if least == NEVER:
                break
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], NEVER)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], NEVER)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same in n log n steps: parts are a linked list, pairs a heap whose stale
        entries are passed over."""
        n, get = len(piece), self.ranks.get
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if not gone[i] else n
            if gone[i] or j >= n or end[j] != stop:
                continue
            gone[j], end[i], after[i] = 1, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (k := before[i]) >= 0 and (r := get(piece[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (an Arrow array or a list) laid end to end, and where those of
        each text end. Each distinct slice is looked up once."""
        pieces, ends = cut(texts)
        told = pieces.dictionary_encode()
        found = list(map(self.cache.__getitem__, told.dictionary.to_pylist()))
        return gathered(found, told.indices.to_numpy(), ends, np.uint32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def joined(self, values: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[memoryview]:
        """For each text, the ``values`` (one for each token) of its ids laid end to end."""
        taken = values.take(pa.array(ids))
        if not len(ids):
            return [memoryview(b"")] * len(ends)
        _, places, raw = taken.buffers()
        at = np.frombuffer(places, np.int64)[taken.offset :][np.append(0, ends)].tolist()
        held = memoryview(raw)
        return [held[a:b] for a, b in itertools.pairwise(at)]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token starts in the text's bytes."""
        ends = np.cumsum(self.lengths[ids])
        return ends - self.lengths[ids]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One for each worker process."""
    return Vocabulary(path)


def plain(vocab: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> list:
    """Of each text its token count, its ids, and where in its bytes each token starts."""
    places, begins = vocab.offsets(ids), np.append(0, ends)
    lengths = np.diff(begins)
    first = np.append(places, 0)[begins[:-1]]  # where each text's bytes begin in the run
    lists = lambda x: pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(x.astype(np.int32)))
    return [pa.array(lengths), lists(ids), lists(places - np.repeat(first, lengths))]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", derive=plain, derived: str = "n_tokens long, ids array<int>, offsets array<int>") -> DataFrame:
    """One row for each row of df: its id, and what ``derive(vocabulary, ids, ends)`` returns
    for a run of texts (their ids laid end to end, and where those of each end): a column
    for each that ``derived`` declares. By default token count, ids, byte offsets.
    A text longer than 2 GiB of bytes does not fit Spark's strings, so int offsets do."""
    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    fields = [f.strip().split(" ")[0] for f in derived.split(", ")]
    out = f"`{id_col}` {dict(df.dtypes)[id_col]}, {derived}"

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for first, some in runs(batch.column(1)):
                columns = derive(vocab, *vocab.encode(some))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(some)), *columns], [id_col, *fields])
        trim()

    return source.mapInArrow(run, out)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """df with the text of its ids added; bytes that are no UTF-8 become U+FFFD, null ids
    null. A column that has the new name already is replaced."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def text(ids):
        vocab = vocabulary(path)
        return ids.map(lambda x: None if x is None else vocab.decode(x).decode("utf-8", "replace"))

    return df.withColumn(text_col, text(ids_col))
