"""Token ids by the tokenizers library, for operators that write or pack them.

For a byte-level tokenizer without normaliser the library cuts a text into slices and
encodes each on its own; such slices are found by ``pretokenise``, Arrow tells the distinct
ones of a run of texts, and each of these is given to the library once (a cache of bounded
size). Ids of a text are then gathered by number. Other tokenizers get whole texts."""

from __future__ import annotations

import functools
import itertools
import json
import os

import numpy as np
import pyarrow as pa

from lodestone.llm.pretokenise import PieceCache, cut, gathered, strings

#: New slices that go to the library in one call.
TOGETHER = 1024


class LibraryEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        before = told.get("pre_tokenizer") or {}
        self.sliced = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and told.get("normalizer") is None
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that begin with a space
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token[0] == "Ġ"]] = True
        self.cache = PieceCache(lambda piece: np.array(self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids, self.dtype).tobytes(), 300_000)

    def encoded(self, texts, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (an Arrow array or a list) laid end to end, each followed by the
        id ``end``, and where those of each text end."""
        last = np.array([end], self.dtype).tobytes()
        if not self.sliced:
            rows = [np.array([*self.tokenizer.encode(t or "", add_special_tokens=False).ids, end], self.dtype) for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)]
            return np.concatenate(rows) if rows else np.empty(0, self.dtype), np.cumsum([len(r) for r in rows], dtype=np.int64)
        column = strings(texts)
        pieces, ends = cut(column)
        told = pieces.dictionary_encode()
        distinct = told.dictionary.to_pylist()
        found = list(map(self.cache.get, distinct))
        if None in found:
            new = [i for i, v in enumerate(found) if v is None]
            known = self._learned({distinct[i] for i in new})
            for i in new:
                found[i] = known[distinct[i]]
        return gathered(found, told.indices.to_numpy(), ends, self.dtype, last)

    def encode(self, texts, end: int) -> list[np.ndarray]:
        """Ids of each text, then the id ``end``."""
        flat, ends = self.encoded(texts, end)
        return np.split(flat, ends[:-1]) if len(ends) else []

    def _learned(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """Ids of slices that the cache's young generation lacks. New slices that open with
        their one space go to the library many in one call: laid end to end, it cuts them at
        their spaces, and tokens that begin with a space tell where."""
        old = self.cache.old
        known = {p: v for p in pieces if (v := old.get(p)) is not None}
        words = []
        for piece in pieces.difference(known):
            # a space and what is no white space
            if len(piece) > 1 and piece[0] == 32 < piece[1] and (piece[1] < 128 or not piece[1:].decode("utf-8", "replace").isspace()):
                words.append(piece)
            else:
                known[piece] = self.cache.encode(piece)
        for a in range(0, len(words), TOGETHER):
            some = words[a : a + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(some).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, self.dtype)
            size = ids.itemsize
            edges = [*(np.flatnonzero(self.spaced[ids]) * size).tolist(), len(ids) * size]
            if len(edges) != len(some) + 1:
                raise ValueError("slices do not begin with a token that begins with a space")
            raw = ids.tobytes()
            known.update(zip(some, (raw[x:y] for x, y in itertools.pairwise(edges)), strict=True))
        self.cache.add({p: v for p, v in known.items() if len(p) <= 64})
        return known


@functools.cache
def encoder(path: str) -> LibraryEncoder:
    """One for each worker process."""
    return LibraryEncoder(path)
