"""Token ids of whole texts from a ``tokenizers`` file, with the ids of recurring words kept in the worker.

Only for tokenizers that drop white space, lower-case their text and split letters from ASCII punctuation (but not at
an apostrophe).  Then a text's ids are those of its pieces, one after another: white-space-separated words in ASCII
lower case, with the punctuation at a word's end as a piece of its own where a letter or digit stands before it.  Each
distinct piece is encoded once; texts that may hold a special token's string are encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import kernels as K
from .scratch import worker_cache

MAX_PIECES = 400_000
#: New pieces are encoded in lines of so many, with a control character between them that is always a token of its own.
LINE = 256
MARK = "\x01"

_TAIL = np.zeros(256, bool)
_TAIL[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[b for b in range(0x30, 0x7B) if chr(b).isalnum()]] = True


def load(path: str):
    """The tokenizer of a file, once per worker."""
    cache = worker_cache()
    if ("tokenizer", path) not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        cache["tokenizer", path] = Tokenizer.from_file(path)
    return cache["tokenizer", path]


class PieceIds:
    """Distinct pieces as rows of one flat array of ids; row 0 is the id that ends a document."""

    def __init__(self, path: str, end_id: int):
        self.tokenizer, self.end_id = load(path), end_id
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.known, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and their rows
        self.flat = np.full(1 << 16, self.end_id, "<u4")
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.length[0], self.used, self.rows = 1, 1, 1

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each has."""
        lines = [words[i : i + LINE] for i in range(0, len(words), LINE)]
        coded = self.tokenizer.encode_batch_fast([f" {MARK} ".join(x) + f" {MARK}" for x in lines], add_special_tokens=False)
        out, lengths = [], []
        for line, code in zip(lines, coded, strict=True):
            ids = np.array(code.ids, "<u4")
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) == len(line):
                out.append(np.delete(ids, marks))
                lengths.append(np.diff(marks, prepend=-1) - 1)
            else:  # a piece holds the mark itself
                each = [x.ids for x in self.tokenizer.encode_batch_fast(line, add_special_tokens=False)]
                out.append(np.array([i for ids in each for i in ids], "<u4"))
                lengths.append(np.array([len(ids) for ids in each], np.int64))
        return np.concatenate(out), np.concatenate(lengths)

    def _add(self, words: list[str]) -> np.ndarray:
        """Rows of new pieces."""
        ids, lengths = self._encode(words)
        n, first = len(ids), self.rows
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(words) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.length[first : first + len(words)] = lengths
        self.start[first : first + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + n] = ids
        self.used += n
        self.rows += len(words)
        return np.arange(first, first + len(words))

    def _rows(self, chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a chunk's pieces, and bounds of each document's."""
        data = chunk.data
        starts, ends, bounds = chunk.spans(K.SPACES)
        solid = np.maximum.accumulate(np.where(_TAIL[data], -1, np.arange(len(data))))
        last = solid[ends - 1]
        cut = (last >= starts) & (last + 1 < ends) & _ALNUM[data[np.maximum(last, 0)]]
        more = np.cumsum(np.append(0, cut))
        at = np.arange(len(starts)) + more[:-1]
        a, b = np.zeros(len(starts) + more[-1], np.int64), np.zeros(len(starts) + more[-1], np.int64)
        a[at], b[at] = starts, np.where(cut, last + 1, ends)
        a[at[cut] + 1], b[at[cut] + 1] = last[cut] + 1, ends[cut]
        hashes, first, inverse = np.unique(chunk.span_hash(chunk.prefix_hash(), a, b), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, hashes)
        hit = np.zeros(len(hashes), bool)
        inside = at < len(self.known)
        hit[inside] = self.known[at[inside]] == hashes[inside]
        rows = np.zeros(len(hashes), np.int64)
        rows[hit] = self.row[at[hit]]
        if len(new := np.flatnonzero(~hit)):
            raw = data.tobytes()
            rows[new] = self._add([raw[i:j].decode() for i, j in zip(a[first[new]].tolist(), b[first[new]].tolist(), strict=True)])
            self.known, self.row = np.concatenate([self.known, hashes[new]]), np.concatenate([self.row, rows[new]])
            order = np.argsort(self.known, kind="stable")
            self.known, self.row = self.known[order], self.row[order]
        return rows[inverse], bounds + more[bounds]

    def encode(self, texts: pa.Array) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
        """For each chunk of texts: their places, all ids (an end id after each text), the bounds of each text's ids."""
        for chunk in K.chunks(texts, lower=True):
            if self.rows > MAX_PIECES:
                self.clear()
            if b"<|" in chunk.data.tobytes():
                coded = self.tokenizer.encode_batch_fast([x or "" for x in texts[chunk.first : chunk.first + chunk.n].to_pylist()], add_special_tokens=False)
                ids = [np.array([*x.ids, self.end_id], "<u4") for x in coded]
                yield chunk.rows, np.concatenate(ids), np.cumsum([0, *map(len, ids)])
                continue
            pieces, bounds = self._rows(chunk)
            rows = np.zeros(len(pieces) + chunk.n, np.int64)
            rows[np.arange(len(pieces)) + np.repeat(np.arange(chunk.n), np.diff(bounds))] = pieces
            lengths = self.length[rows]
            ends = np.cumsum(lengths)
            at = np.arange(ends[-1]) + np.repeat(self.start[rows] - (ends - lengths), lengths)
            yield chunk.rows, self.flat[at], np.append(0, ends)[bounds + np.arange(chunk.n + 1)]


def piece_ids(path: str, end_id: int) -> PieceIds:
    cache = worker_cache()
    if ("pieces", path, end_id) not in cache:
        cache["pieces", path, end_id] = PieceIds(path, end_id)
    return cache["pieces", path, end_id]
